"""Fixed kinds against a plain scan, places and overlaps against definitions, and the trees against what they were taught."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismet.llm import pii, queries
from tests.llm.test_contracts import ROWS

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def checksum(digits):
    odd = [int(c) for c in digits[::-1]]
    return sum(d if k % 2 == 0 else sum(map(int, str(2 * d))) for k, d in enumerate(odd)) % 10 == 0


def brute(text):
    """kind -> spans."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = {"email": [m.span() for m in EMAIL.finditer(text)]}
    out["ip"] = [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out["card"] = [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and checksum(digits(m[0]))]
    out["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return out


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k in ("email", "ip", "card", "phone") for a, b in spans[k])


def hostile():
    rng = random.Random(8)
    parts = ["a@b.c", "@", ".", "x.y@z-1.example.com", "_", "%+-", "1.2.3.4", "256.1.1.1", "01.002.0003.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559", "+1 (234) 555-0100", "+", "(", " ", "  ", "-", "7", "12", "é", "\U0001f600", "\n", "+44 20 7946 0958", "...", "1.2.3", "at", " (at) ", "me (at) home dot org"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    return texts + ["4111111111111111 " * 300, "a@b.c_d@e.f.g@h.i", "1.2.3.4.5.6.7.8", "+1" + "(" * 40 + "2", "9" * 5000]


def test_fixed_kinds(spark, tmp_path):
    rows = [*ROWS, *[(1000 + k, t) for k, t in enumerate(hostile())], (None, "a@b.c"), (7, "a@b.c"), (7, "a@b.c")]
    spark.createDataFrame([(k, t, "e", "s") for k, t in rows], "doc_id long, text string, email string, start string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op12_candidate_boosting(spark, str(tmp_path)).drop("n_added").collect()), key=str)
    want = []
    for k, t in rows:
        found = brute(t or "")
        want.append((k, *[len(v) for v in found.values()], hashlib.sha256(joined(found).encode()).hexdigest(), joined(found)))
    want.sort(key=str)
    assert [r[:6] for r in got] == [r[:6] for r in want]
    assert all(g[6] == w[6] or g[6].startswith(w[6] + "," * bool(w[6])) for g, w in zip(got, want, strict=True))


def test_long_texts_are_scanned_in_time(spark):
    """Runs of a million characters that could begin a match anywhere, and 60,000 matches in one text."""
    import time

    texts = ["a" * 1_000_000, "a." * 500_000 + "@", "1" * 1_000_000, "1." * 400_000, "+1(" * 300_000, "a@b.c " * 60_000, "555-0100 " * 60_000]
    began = time.time()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n"], r["last"]) for r in pii.scan(df).select("doc_id", F.size("email").alias("n"), F.try_element_at("email", F.lit(-1))["end"].alias("last")).collect()}
    assert got[5] == (60_000, 6 * 59_999 + 5) and got[0] == (0, None) and time.time() - began < 240


def test_running_values(spark):
    rng = random.Random(2)
    lists = [[rng.randint(0, 99) for _ in range(n)] for n in (0, 1, 2, 3, 4, 5, 9, 10, 17, 100, 333)]
    df = spark.createDataFrame([(x,) for x in lists], "x array<bigint>")
    got = df.select(pii.running(F.col("x"), lambda a, b: a + b, F.lit(0)), pii.running(F.col("x"), lambda a, b: F.greatest(a, b), F.lit(0))).collect()
    assert [r[0] for r in got] == [np.cumsum(x).tolist() for x in lists] and [r[1] for r in got] == [np.maximum.accumulate(x).tolist() if x else [] for x in lists]


def test_proposals_know_what_they_cover(spark):
    """``covers`` is overlap with any span of a fixed kind, by comparing all pairs."""
    texts = hostile()
    rows = pii.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    seen = set()
    for r in rows:
        base = [s for k in pii.BASE for s in r[k]]
        for p in r["proposed"]:
            seen.add(p["covers"])
            assert p["covers"] == any(s["start"] < p["end"] and p["start"] < s["end"] for s in base), texts[r["doc_id"]]
        assert [p["start"] for p in r["proposed"]] == sorted(p["start"] for p in r["proposed"])
    assert seen == {True, False}


def test_boosting_learns_conjunctions_and_thresholds_keep_precision():
    rng = np.random.default_rng(3)
    x = {f: rng.integers(0, 10, 4000) for f in "abc"}
    truth = ((x["a"] > 6) & (x["b"] <= 4)).astype(float)
    trees, bias = pii.boost(x, truth, np.ones(4000))
    score = bias + sum(pii._value(t, x) for t in trees)
    assert ((score > 0) == (truth > 0)).mean() > 0.99
    noisy = np.where(rng.random(4000) < 0.1, 1 - truth, truth)
    t = pii.threshold(score, noisy, np.ones(4000), 0.85, 10)
    assert t is not None and noisy[score >= t].mean() >= 0.85
    assert pii.threshold(score, np.zeros(4000), np.ones(4000), 0.5, 1) is None and pii.threshold(np.zeros(0), np.zeros(0), np.zeros(0), 0.5, 1) is None


def test_scores_of_the_expression_are_those_of_the_trees(spark):
    rng = np.random.default_rng(4)
    x = {f: rng.integers(0, 8, 300) for f in ("p", "q")}
    trees, bias = pii.boost(x, ((x["p"] > 3) ^ (x["q"] > 5)).astype(float), np.ones(300), rounds=6)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x["p"], x["q"], strict=True)], "p int, q int").coalesce(1)
    got = [r[0] for r in df.select(pii.Model(trees, bias, {}).score(F.struct("p", "q"))).collect()]
    assert got == pytest.approx((bias + sum(pii._value(t, x) for t in trees)).tolist())


def test_trees_of_a_table_are_those_of_arrays(spark):
    """Sums over a table in many parts grow the trees that all its rows in one place do."""
    rng = np.random.default_rng(5)
    x = {f: rng.integers(0, 9, 500) for f in ("p", "q", "r")}
    y, n = (x["p"] > 5) & (x["q"] <= 3) | (rng.random(500) < 0.1), rng.integers(1, 50, 500)
    rows = [(*map(int, v), bool(c), int(k)) for *v, c, k in zip(*x.values(), y, n, strict=True)]
    df = spark.createDataFrame(rows, "p int, q int, r int, covers boolean, n long").repartition(5)
    for depth in (0, 1, 3):
        assert pii.boost_rows(df, list(x), rounds=3, depth=depth) == pii.boost(x, y.astype(float), n.astype(float), rounds=3, depth=depth)


def test_learning_sees_all_vectors(spark):
    """70,000 different vectors, each as frequent as any other: those that a most frequent 50,000 would leave out decide."""
    k = F.col("id")
    value = {"digits": k % 25, "length": F.floor(k / 25) % 61, "dots": F.floor(k / 1525) % 7, "last": F.floor(k / 10675) % 21}
    x = F.struct(*[value.get(f, F.lit(0)).cast("int").alias(f) for f in pii.FEATURES], F.lit(1).alias("generator"))
    p = F.struct(F.lit(0).cast("long").alias("start"), F.lit(9).cast("long").alias("end"), x.alias("x"), (k % 25 >= 20).alias("covers"))
    model = pii.train(spark.range(70_000).select(k.alias("doc_id"), k.alias("text_key"), F.array(p).alias("proposed")), rounds=2)
    assert list(model.thresholds) == ["number"] and model.trees[0][:2] == ("digits", 19)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_look_alikes_are_added_and_plain_numbers_left_alone(spark):
    """Phone numbers without their plus are found by their form and the words before; part numbers and dates are not."""
    rng = random.Random(6)
    number = lambda: f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    rows = []
    for k in range(700):
        said = f"phone +1 {number()}" if k % 2 else f"order {rng.randint(10**7, 10**8)} of {rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}"
        rows.append((k, f"{prose(rng, 8)} {said} {prose(rng, 8)}", ""))
    rows += [(1000 + k, f"{prose(rng, 8)} phone 1 {number()} {prose(rng, 8)}", "") for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    scanned = pii.stage(pii.scan(df), "spans")
    model = pii.train(scanned)
    out = {r["doc_id"]: r["added"] for r in pii.selected(scanned, model).collect()}
    assert "number" in model.thresholds
    assert all(out[1000 + k] for k in range(5)) and not any(out[k] for k in range(700))
    text = {r["doc_id"]: r["text"] for r in pii.redacted(df).collect()}
    assert all("555" not in text[k] and "[PII]" in text[k] for k in [*range(1, 700, 2), *range(1000, 1005)]) and all(text[k] == rows[k][1] for k in range(0, 700, 2))
    assert pii.redacted(df).columns == df.columns


def test_redaction_over_chunks(spark):
    """Spans over the borders of chunks, that touch, overlap, or contain each other."""
    text = "".join(chr(97 + k % 26) for k in range(9000))
    spans = [(0, 3), (3, 5), (10, 30), (20, 25), (28, 40), (4090, 4100), (8190, 8195), (8999, 9000)]
    df = spark.createDataFrame([(text, [tuple(s) for s in spans]), ("", []), ("\n\U0001f600x", [(1, 2)])], "t string, s array<struct<start:bigint,end:bigint>>")
    got = [r[0] for r in df.select(pii._masked(F.col("t"), F.col("s"), "#")).collect()]
    want = "##" + text[5:10] + "#" + text[40:4090] + "#" + text[4100:8190] + "#" + text[8195:8999] + "#"
    assert got == [want, "", "\n#x"]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op12_candidate_boosting(spark, str(tmp_path)).collect() == []
    assert pii.redacted(spark.createDataFrame([(1, None), (2, "x")], "doc_id long, text string")).count() == 2
