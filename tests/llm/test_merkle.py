"""Manifest and proofs against plain trees, with null and hot groups, repeated rows, one-row groups and every vertex height."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from prismet.llm import merkle, queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def path(tree, i):
    out = []
    for row in tree[:-1]:
        first = i - i % 3
        out.append(("".join(row[first:i]), "".join(row[i + 1 : first + 3])))
        i //= 3
    return out


def brute(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (doc_id, source, leaf, claim)."""
    groups = {}
    for ident, source, leaf, claim in rows:
        groups.setdefault(source, []).append((ident is not None, ident or 0, leaf, claim, ident))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s], key=lambda x: x[:4])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for j, s in enumerate(names):
        for i, x in enumerate(sorted(groups[s], key=lambda x: x[:4])):
            own = path(trees[s], i) + path(top, j)
            now = x[3]
            for before, after in own:
                now = h(before, now, after)
            out.append((x[4], x[2], trees[s][-1][0], top[-1][0], h(*[b + a for b, a in own]), now, now == top[-1][0]))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


SCHEMA = "doc_id long, source string, leaf string, claim string"


@pytest.mark.parametrize("height", [1, 2, 4])
def test_any_height_of_vertices_gives_the_same_manifest(spark, height):
    rng = random.Random(1)
    names = [None, "", "hot", "hot", "hot", "é", "z\U0001f600", *[f"s{k}" for k in range(12)]]
    rows = [(k, rng.choice(names), h(str(k)), h(str(k if k % 3 else -k))) for k in range(260)]
    rows += [(None, "hot", h("n"), h("n")), (7, "hot", h("x"), h("x")), (7, "hot", h("x"), h("x")), (9, "alone", h("y"), h("z"))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert ordered(map(tuple, merkle.verified(df, height=height).collect())) == ordered(brute(rows))


@pytest.mark.parametrize("sizes", [[1], [2], [3], [4], [27], [28], [82], [1, 1], [3, 1, 9], [10, 1, 1, 1, 1, 1, 1, 1, 1, 1]])
def test_small_trees(spark, sizes):
    rows = [(k, f"g{g:02d}", h(str(g), str(k)), h(str(g), str(k))) for g, n in enumerate(sizes) for k in range(n)]
    got = merkle.verified(spark.createDataFrame(rows, SCHEMA).coalesce(1), height=2).collect()
    assert ordered(map(tuple, got)) == ordered(brute(rows)) and all(r["verified"] for r in got)


def test_paths_fold_to_the_root_for_their_leaf_only(spark):
    rows = [(k, f"g{k % 2}", h(str(k)), h(str(k))) for k in range(40)]
    got = merkle.verified(spark.createDataFrame(rows, SCHEMA), paths=True).collect()
    for r in got:
        for leaf, right in ((r["leaf"], True), (h("other"), False)):
            for step in r["path"]:
                leaf = h(step["before"], leaf, step["after"])
            assert (leaf == r["root"]) == right


def test_fields_cannot_be_shifted_into_each_other(spark):
    rows = [("ab", "c"), ("a", "bc"), ("-", None), (None, "-"), (None, None), ("", "")]
    got = [r[0] for r in spark.createDataFrame(rows, "x string, y string").select(merkle.leaf_digest(F.col("x"), F.col("y"))).collect()]
    enc = lambda v: "-" if v is None else f"{len(v.encode())}:{v}"
    assert got == [h(enc(x), enc(y)) for x, y in rows] and len(set(got)) == len(rows)


def test_query_on_hostile_rows(spark, tmp_path):
    rows = [(1, "a\nb", "en", "s", 3, "x"), (2, None, None, None, None, "y"), (3, "", "", "", 0, "z"), (None, "é\n", "fr", "s", 2, "w"), (4, "x\n" * 500_000, "en", "s", 1, "v"), (5, "p", "en", "s", None, "u"), (5, "p", "en", "s", None, "u")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, leaf string").write.parquet(f"{tmp_path}/documents.parquet")
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaves = []
    for i, text, lang, source, n, _ in rows:
        digest = lambda t: h(*[enc(v) for v in (i, source, lang, n, t)])  # noqa: B023, E731
        hit = i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        leaves.append((i, source, digest(text), digest(text.replace("\n", "") if hit and text is not None else text)))
    got = queries.op13_merkle_pregel(spark, str(tmp_path)).collect()
    assert ordered(map(tuple, got)) == ordered(brute(leaves))
    assert {r["verified"] for r in got} == {True, False} or all(r["verified"] for r in got)
