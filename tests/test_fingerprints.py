"""Fingerprints do not see order or partitions, see every row and how often it occurs, and lead to the range that changed."""

from pyspark.sql import functions as F

from prismet.operators import fingerprints


def test_fingerprints(spark):
    rows = [(k % 3, k, None if k % 7 == 0 else f"v{k % 50}") for k in range(900)] + [(1, 5, "same")] * 40
    df = spark.createDataFrame(rows, "view int, k int, v string")
    prints = lambda d: {r["view"]: (r["fingerprint"], r["rows"]) for r in fingerprints.fingerprints(d, ["view"], ["k", "v"], node=8).collect()}
    whole = prints(df)
    assert {v: n for v, (_, n) in whole.items()} == {0: 300, 1: 340, 2: 300}
    assert prints(df.repartition(7, "v").orderBy(F.desc("k"))) == whole
    changed = df.withColumn("v", F.when(F.col("k") == 4, "other").otherwise(F.col("v")))
    got = prints(changed)
    assert got[1] != whole[1] and (got[0], got[2]) == (whole[0], whole[2])
    fewer = spark.createDataFrame(rows[:-1], df.schema)
    assert prints(fewer)[1][0] != whole[1][0], "one of 40 equal rows is missing"
    a, b = (fingerprints.trie(d, ["view"], ["k", "v"], node=8) for d in (df, changed))
    ranges = fingerprints.differing(a, b, ["view"]).collect()
    assert 1 <= len(ranges) <= 2 and {r["view"] for r in ranges} == {1} and a.where("view = 1").count() > 20
    assert fingerprints.differing(a, a, ["view"]).count() == 0 and prints(df.limit(0)) == {}


def test_values_cannot_be_shifted(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "-"), ("-", None)], "x string, y string")
    assert df.select(fingerprints.row_digest(F.col("x"), F.col("y"))).distinct().count() == 4
