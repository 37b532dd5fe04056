"""The registered queries on folders of hostile and of empty tables, and the learned and hashed parts against plain versions."""

import hashlib
import random
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from prismet.llm import quality, queries, toxicity
from tests.llm import brute
from tests.llm.test_contracts import ROWS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, _id string"


def folder(spark, path, rows):
    docs = spark.createDataFrame([(k, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else "hot", None, "x", None) for k, t in rows], SCHEMA)
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(k, k % 2 if k % 3 else None, (k // 2) % 2 if k % 4 else None) for k, _ in rows] + [(10**9, 1, 1)] * bool(rows)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def hostile(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("hostile"), ROWS)


def by_id(df):
    rows = df.collect()
    assert sorted(r["doc_id"] for r in rows) == [k for k, _ in ROWS]
    return {r["doc_id"]: r for r in rows}


def test_queries_of_empty_tables(spark, tmp_path):
    path = folder(spark, tmp_path, [])
    for name, query in queries.queries().items():
        assert query(spark, path).collect() == [], name


def test_op1_and_op2(spark, hostile):
    got = by_id(queries.op1_toxicity_ftrl(spark, hostile))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (brute.crc(str(k)) % 3 == 1) for k, r in got.items())
    got = by_id(queries.op2_secret_ownership(spark, hostile))
    for k, text in ROWS:
        want = brute.secrets(text)
        n = Counter(kind for _, _, kind, _ in want)
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in want)
        r = got[k]
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == (n["assign"], n["access"], n["hex"], hashlib.sha256(joined.encode()).hexdigest())
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))


def test_op3_and_op4(spark, hostile):
    got = by_id(queries.op3_license_signatures(spark, hostile))
    for k, text in ROWS:
        n, places, labels = brute.licenses(text)
        r = got[k]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n, len(places), min(places, default=None), max(places, default=None), ",".join(labels))
        assert set(labels) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    got = by_id(queries.op4_jump_sharding(spark, hostile))
    slots = {}
    for k, text in ROWS:
        r = got[k]
        assert (r["size"], r["text_crc32"], r["law"]) == (len((text or "").encode()) + 1, brute.crc(text), "key") and r["grown_shard"] in (r["shard"], 16)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))


def test_op5_and_op8(spark, hostile):
    want = brute.suffix(ROWS)
    assert {k: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for k, r in by_id(queries.op5_suffix_array(spark, hostile)).items()} == want
    near = brute.near(ROWS)
    assert {k: (r["n_shingles"], r["component_id"], r["kept"]) for k, r in by_id(queries.op8_minhash_join(spark, hostile)).items()} == {k: (n, c, k == c) for k, (n, c) in near.items()}


def sketch(text, scale=8):
    """The sketch by its definition: chained 64-bit hashes of word hashes, the upper 48 bits, those below the limit."""
    h64 = lambda data, seed: xxhash.xxh64_intdigest(data, seed=seed)
    words = [h64(w.encode(), 42) for w in brute.SPACED.findall((text or "").lower())]
    found = set()
    for k in range(max(len(words) - 4, 1) if words else 0):
        h = 42
        for w in words[k : k + 5]:
            h = h64(struct.pack("<Q", w), h)
        found.add(h >> 16)
    low = {x for x in found if x < (1 << 48) // scale}
    return low or ({min(found)} if found else set())


def test_op7_against_its_definition(spark, hostile):
    got = by_id(queries.op7_scaled_sketch(spark, hostile))
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    hexed = lambda s: "".join(f"{x:012x}" for x in sorted(s))
    texts = [t or "" for _, t in ROWS]
    for k, text in enumerate(texts):
        after = texts[(k + 1) % len(texts)]
        m = len(text) // 4
        edited = text[: len(text) - m] + after[:m]
        a, b, c, r = sketch(text), sketch(edited), sketch(after), got[k]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (hexed(a), hexed(b))
        assert (r["near_edited"], r["near_next"]) == pytest.approx((like(a, b), like(a, c)))


def test_op6_op9_and_op10(spark, hostile):
    got = by_id(queries.op6_byte_bpe(spark, hostile))
    assert all(r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest() for r, (_, text) in ((got[k], (k, t)) for k, t in ROWS))
    pieces = queries.op9_shortest_pack(spark, hostile).collect()
    held = {}
    for r in pieces:
        held.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    assert sorted(held) == [k for k, _ in ROWS]
    for parts in held.values():
        parts.sort()
        assert [s for s, _, _ in parts] == [sum(n for _, n, _ in parts[:i]) for i in range(len(parts))] and sum(n for _, n, _ in parts) == parts[0][2]
    got = by_id(queries.op10_decision_list(spark, hostile))
    for k, text in ROWS:
        r, want = got[k], brute.quality(text)
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (*want, failed)
        assert r["kept"] == (not failed and r["rule"] is None)


def test_rule_expressions_cover_what_was_learned(spark):
    rng = random.Random(4)
    rows = [tuple(rng.randrange(1, 400) for _ in quality.COUNTS) for _ in range(300)]
    stats = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in quality.COUNTS))
    table = stats.select("*", *[F.expr(e).cast("double").alias(f"f_{f}") for f, e in quality.FEATURES.items()]).toPandas()
    x = {f: table[f"f_{f}"].to_numpy() for f in quality.FEATURES}
    names = list(x)
    # Thresholds are midpoints, as learning makes them, and values that rows have: ties fall on the side of <=.
    rules = [quality.Rule(tuple((f, rng.choice(["<=", ">"]), float(rng.choice(x[f].tolist()))) for f in rng.sample(names, 3)), 1.0) for _ in range(6)]
    want = np.zeros(len(table), int)
    for k, rule in reversed(list(enumerate(rules, 1))):
        want[quality._covered(x, rule.tests)] = k
    judged = quality.judge(stats.coalesce(1), rules).toPandas()
    keys = list(quality.COUNTS)
    got = {tuple(r[c] for c in keys): 0 if r["rule"] != r["rule"] else int(r["rule"]) for _, r in judged.iterrows()}
    assert all(got[tuple(int(v) for v in table.loc[i, keys])] == want[i] for i in range(len(table)))
    assert len(set(want)) > 2


def test_ftrl_against_its_definition():
    """One coordinate at a time in plain Python: FTRL-proximal as published, on the same order of rows."""
    rng = random.Random(9)
    rows = [np.unique(np.array([rng.randrange(1, 30) for _ in range(8)] + [100 + k % 2] * (k % 3 > 0), np.uint64)) for k in range(120)]
    y = np.array([float(k % 2) for k in range(120)])
    alpha, beta, l1, l2, epochs = 0.5, 1.0, 0.3, 0.1, 4
    model = toxicity.fit(rows, y, alpha=alpha, beta=beta, l1=l1, l2=l2, epochs=epochs, min_rows=3)
    seen = Counter(int(f) for r in rows for f in r)
    z, n, order = Counter(), Counter(), np.random.default_rng(7)

    def weight(f):
        shrink = 0.0 if f == "bias" else l1
        return 0.0 if abs(z[f]) <= shrink else -(z[f] - (shrink if z[f] > 0 else -shrink)) / ((beta + n[f] ** 0.5) / alpha + l2)

    for _ in range(epochs):
        for k in order.permutation(len(rows)).tolist():
            own = [int(f) for f in rows[k] if seen[int(f)] >= 3] + ["bias"]
            w = {f: weight(f) for f in own}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y[k]
            for f in own:
                z[f] += g - ((n[f] + g * g) ** 0.5 - n[f] ** 0.5) / alpha * w[f]
                n[f] += g * g
    want = {f: weight(f) for f in seen if seen[f] >= 3 and weight(f)}
    assert {int(k): w for k, w in zip(model.keys, model.weights, strict=True)} == pytest.approx(want) and model.intercept == pytest.approx(weight("bias"))
    assert len(want) < sum(c >= 3 for c in seen.values()), "L1 sets some weights to zero"
