"""Commits that one writer makes, stores that a correction rewrites in part, draws in many tasks, exact means, late slots."""

import random
import threading
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from prismet.functions.exact import percentile
from prismet.operators import compare, incremental, longitudinal, metrics, resampling
from prismet.sources import commits, sinks


def test_of_two_writers_one_publishes_whole(spark, tmp_path):
    root = f"file://{tmp_path}/set"
    first = commits.publish({"a": spark.range(3), "b": spark.range(5)}, root)
    outcome = []

    def write(n):
        try:
            outcome.append((n, commits.publish({"a": spark.range(n), "b": spark.range(n)}, root, after=first)))
        except commits.PublicationConflict:
            outcome.append((n, None))

    threads = [threading.Thread(target=write, args=(n,)) for n in (10, 20, 30)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    won = [n for n, c in outcome if c]
    assert len(won) == 1 and len(outcome) == 3
    assert commits.read(spark, root, "a").count() == commits.read(spark, root, "b").count() == won[0]
    assert commits.read(spark, root, "b", first).count() == 5
    commits.publish({"b": spark.range(7)}, root)
    assert (commits.read(spark, root, "a").count(), commits.read(spark, root, "b").count()) == (won[0], 7)


def test_a_claimed_name_is_never_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/c.json"
    commits.claim(spark, path, "one")
    with pytest.raises(commits.PublicationConflict):
        commits.claim(spark, path, "two")
    assert (tmp_path / "c.json").read_text() == "one" and [p.name for p in tmp_path.iterdir() if p.name.endswith(".part")] == []
    sinks.publish_files(spark, {"r.md": b"x"}, f"file://{tmp_path}/report")
    with pytest.raises(FileExistsError):
        sinks.publish_files(spark, {"r.md": b"y"}, f"file://{tmp_path}/report")
    assert (tmp_path / "report" / "r.md").read_bytes() == b"x"


def test_correction_recomputes_affected_cells_only(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"e{k}", f"c{k % 40}", rng.choice("abcd")) for k in range(2000)]
    events = spark.createDataFrame(rows, "event string, cell string, class string")
    compute = lambda e: metrics.distribution(metrics.class_counts(e)).select("cell", "population", "support", "sci_num")
    store = incremental.CellStore(spark, f"file://{tmp_path}/store", buckets=16)
    assert store.write(compute(events)) == 1
    withdrawn = [f"e{k}" for k in range(0, 2000, 400)]  # all in cell c0
    withdrawn += [e for e, c, _ in rows if c == "c7"]  # the whole of c7
    references = events.select(F.concat(F.lit("cell:"), "cell").alias("src"), F.concat(F.lit("event:"), "event").alias("dst"))
    corrections = spark.createDataFrame([("k1", f"event:{e}") for e in withdrawn], "correction string, target string")
    cells = incremental.affected(corrections, references, "cell")
    assert {r[0] for r in cells.collect()} == {"c0", "c7"}
    left = events.where(~F.col("event").isin(withdrawn))
    asked = []

    def again(own):
        asked.append({r[0] for r in own.collect()})
        return compute(left.join(own, "cell", "left_semi"))

    before = set(store.read().inputFiles())
    assert store.apply(cells, again) == 2 and asked == [{"c0", "c7"}]
    got, want = (sorted(map(tuple, d.collect())) for d in (store.read(), compute(left).select("cell", "population", "support", "sci_num")))
    assert got == want and len(got) == 39
    kept = before & set(store.read().inputFiles())
    assert len(kept) >= len(before) - 2, "buckets that no affected cell is in keep their files"
    assert store.apply(cells.limit(0), again) == 2 and len(asked) == 1


@pytest.mark.parametrize(("units", "replicates", "stretch"), [(2, 7, 3), (5, 200, 97), (8, 300, 256), (1000, 40, 5000), (3, 1, 1 << 20)])
def test_draws_are_those_of_one_generator(spark, units, replicates, stretch):
    rng = random.Random(20260917)
    want = [(r, k, rng.randrange(units)) for r in range(replicates) for k in range(units)]
    df = resampling.index_table(spark, units, 20260917, replicates, stretch=stretch)
    assert sorted(map(tuple, df.collect())) == want
    assert stretch == 1 << 20 or df.rdd.getNumPartitions() > 1


def test_jump_equals_stepping():
    for steps in (0, 1, 623, 624, 19937, 250_001):
        rng = random.Random(9)
        for _ in range(steps):
            rng.getrandbits(32)
        assert resampling.jumped(9, steps).random_raw(50).tolist() == [rng.getrandbits(32) for _ in range(50)]
    assert len(resampling.polynomial()) == 134 and resampling.power(3) == 8


def test_exact_intervals(spark):
    rng = random.Random(2)
    values = {g: [Fraction(rng.randint(-50, 50), rng.randint(1, 400)) for _ in range(5)] for g in ("x", "y")}
    rows = [(g, u, v.numerator, v.denominator) for g, vs in values.items() for u, v in enumerate(vs)]
    rows += [("wide", u, 1, (1 << 61) - 2 * u - 1) for u in range(5)] + [("short", u, 1, 3) for u in range(4)] + [("none", u, None if u else 1, 2) for u in range(5)]
    df = spark.createDataFrame(rows, "g string, unit int, num long, den long")
    draws = compare.replay_indices(5)[:81]
    indices = spark.createDataFrame([(r, k, u) for r, row in enumerate(draws) for k, u in enumerate(row)], "replicate int, draw int, unit int")
    means = resampling.exact_means(df, indices, ["g"], 5)
    got = {(r["g"], r["replicate"]): Fraction(int(r["num"]), int(r["den"])) for r in means.where("status = 'available'").collect()}
    exact = {(g, r): sum((vs[u] for u in row), Fraction(0)) / 5 for g, vs in values.items() for r, row in enumerate(draws)}
    assert got == exact
    assert {r["g"] for r in means.where("status = 'unavailable'").collect()} == {"wide", "short", "none"}
    out = resampling.exact_percentiles(means, ["g"], [(1, 40), (39, 40), (1, 2)], 81).collect()
    for r in out:
        if r["g"] in values:
            q = Fraction(*map(int, r["share"].split("/")))
            assert Fraction(int(r["num"]), int(r["den"])) == percentile([exact[r["g"], k] for k in range(81)], q)
        else:
            assert r["status"] == "unavailable" and r["num"] is None
    assert len(out) == 15


def test_least_common_denominators(spark):
    rows = [("a", d) for d in (4, 6, 10, 7, 9)] + [("b", 1), ("c", (1 << 61) - 1), ("c", (1 << 62) - 57), ("d", 0)]
    got = {r["g"]: r["common"] for r in resampling.common_denominators(spark.createDataFrame(rows, "g string, den long"), ["g"], bits=100).collect()}
    assert (int(got["a"]), int(got["b"]), got["c"], got["d"]) == (1260, 1, None, None)


def test_late_slots_give_the_history_of_the_batch(spark, tmp_path):
    """Slots shuffled within the watermark, over several micro-batches: what is emitted equals the batch operator's result."""
    from prismet.streaming import repair

    rng = random.Random(7)
    rows = [(f"u{u}", c, s, f"2026-01-{s + 1:02d} 00:00:00", rng.choice([True, False, None])) for u in range(3) for c in "ab" for s in range(14)]
    order = sorted(rows, key=lambda r: r[2] + rng.random() * 3.5)
    end = [("u9", "z", 30, "2026-03-01 00:00:00", True)]
    folder = tmp_path / "in"
    schema = "unit string, class string, state long, time string, observed boolean"
    for k, part in enumerate([order[:30], order[30:60], order[60:], end]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{folder}/{k}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}/*").withColumn("time", F.to_timestamp("time"))
    query = repair.repaired_recurrence(source, late="5 days").writeStream.format("memory").queryName("repaired").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    got = {(r["unit"], r["class"], r["state"]): r["recurrence"] for r in spark.table("repaired").collect() if r["unit"] != "u9"}
    batch = longitudinal.recurrence(spark.createDataFrame(rows, schema), ["unit", "class"], "state")
    assert got == {(r["unit"], r["class"], r["state"]): r["recurrence"] for r in batch.collect()}
