import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from prismet.functions import exact
from prismet.operators import metrics


def counted(spark, cells):
    return spark.createDataFrame([(c, k, n) for c, counts in cells.items() for k, n in counts.items()], "cell string, class string, n long")


def test_known_distribution(spark):
    row = metrics.distribution(counted(spark, {"x": {"MERGE": 8, "PIVOT": 6, "HEAP": 3, "COUNT": 2, "RADIX": 1}}), threshold="0.10").first()
    assert (row["population"], row["support"], row["threshold_support"]) == (20, 5, 4)
    assert Fraction(row["sci_num"], row["sci_den"]) == Fraction(57, 200)
    assert math.isclose(row["entropy"], 1.3923212547574291, rel_tol=1e-12) and math.isclose(row["effective_entropy"], 4.0241803676091886, rel_tol=1e-12)


def test_random_tables_match_fractions(spark):
    rng = random.Random(1)
    cells = {f"c{k}": {f"k{j}": rng.randint(0, 9) for j in range(rng.randint(1, 8))} for k in range(30)}
    cells = {c: v for c, v in cells.items() if sum(v.values())}
    for r in metrics.metric_results(metrics.distribution(counted(spark, cells))).collect():
        n = list(cells[r["cell"]].values())
        total = sum(n)
        assert r["r_support"]["value"] == sum(x > 0 for x in n)
        assert Fraction(int(r["r_sci"]["num"]), int(r["r_sci"]["den"])) == Fraction(sum(x * x for x in n), total * total)
        assert math.isclose(r["r_entropy"]["value"], -math.fsum(x / total * math.log(x / total) for x in n if x), abs_tol=1e-12)


def test_empty_population_is_undefined_not_zero(spark):
    row = metrics.metric_results(metrics.distribution(counted(spark, {"x": {"a": 0}}))).first()
    assert row["r_support"]["value"] == 0 and row["r_support"]["status"] == "available" and row["r_support"]["qualifiers"] == ["empty_classified_population"]
    assert {row[c]["status"] for c in ("r_entropy", "r_sci", "r_effective_sci")} == {"undefined"} and row["r_threshold"]["status"] == "not_requested"


@pytest.mark.parametrize(("token", "want"), [("0.10", (10, 2)), ("1", (1, 0)), ("1e-2", (1, 2)), ("0", None), ("1.01", None), ("-0.1", None), (" 0.1", None), ("NaN", None), ("1/10", None), (".5", None), (0.5, None), (True, None)])
def test_threshold_tokens(token, want):
    assert exact.threshold_token(token) == want


def test_threshold_is_inclusive_and_exact(spark):
    c = counted(spark, {"x": {"a": 1, "b": 9}, "y": {"a": 0, "b": 3}})
    got = {r["cell"]: r["threshold_support"] for r in metrics.thresholded(c, "0.1").collect()}
    assert got == {"x": 2, "y": 1}
    tight = {r["cell"]: r["threshold_support"] for r in metrics.thresholded(c, "0.1000000000000000000000001").collect()}
    assert tight == {"x": 1, "y": 1}


def test_prefix_holds_places_of_unclassified(spark):
    rows = [("c", k, x) for k, x in enumerate(["a", None, "b", "a", "c"])] + [("d", 0, "a")]
    obs = spark.createDataFrame(rows, "cell string, place int, class string")
    got = {(r["cell"], r["k"]): (r["distinct_k"], r["status"]) for r in metrics.prefix_distinct(obs, [1, 2, 3, 5], ["place"]).collect()}
    assert got[("c", 2)] == (1, "available") and got[("c", 3)] == (2, "available") and got[("c", 5)] == (3, "available")
    assert got[("d", 2)] == (None, "unavailable")
    curve = [r["distinct_k"] for r in metrics.accumulation(obs, ["place"]).where("cell = 'c'").orderBy("k").collect()]
    assert curve == [1, 1, 2, 2, 3]
    with pytest.raises(ValueError):
        metrics.prefix_distinct(obs, [3, 3], ["place"])


def test_coverage_ratios_keep_their_denominators(spark):
    rows = [("c", True, "valid"), ("c", False, "valid"), ("c", True, "invalid"), ("c", False, "not_assessed"), ("d", True, "invalid")]
    got = {r["cell"]: r for r in metrics.coverage(spark.createDataFrame(rows, "cell string, classified boolean, validity string")).collect()}
    assert got["c"]["classification_coverage"]["value"] == 0.5 and got["c"]["classified_valid_coverage"]["value"] == 0.5 and got["c"]["decisive_validity_coverage"]["value"] == 0.75
    assert got["d"]["classified_valid_coverage"]["status"] == "undefined" and got["d"]["classified_valid_coverage"]["reasons"] == ["empty_denominator"]


def test_order_and_contiguity(spark):
    rows = spark.createDataFrame([("c", "s1", 2), ("c", "s2", 1), ("d", "s3", 1), ("d", "s4", 1), ("e", "s5", None)], "cell string, sample_id string, sample_order int")
    got = {r["sample_id"]: (r["order_state"], r["order_place"]) for r in metrics.resolved_order(rows).collect()}
    assert got == {"s1": ("recorded", 2), "s2": ("recorded", 1), "s3": ("conflicting", None), "s4": ("conflicting", None), "s5": ("missing", None)}
    p = spark.createDataFrame([("g", 1), ("g", 2), ("h", 1), ("h", 3), ("i", 2)], "g string, i int")
    assert {r["g"]: r["contiguous"] for r in metrics.contiguous(p, ["g"], "i").collect()} == {"g": True, "h": False, "i": False}


def test_counts_must_add_up(spark):
    totals = spark.createDataFrame([("x", 3), ("y", 5)], "cell string, n long")
    bad = metrics.checked_counts(counted(spark, {"x": {"a": 1, "b": 2}, "y": {"a": 4}}), totals).collect()
    assert [(r["cell"], r["reasons"]) for r in bad] == [("y", ["count_conservation_failure"])]


def test_storage_order_changes_nothing(spark):
    rows = [("c", k, "abcab"[k]) for k in range(5)]
    obs = spark.createDataFrame(rows, "cell string, place int, class string")
    a, b = (metrics.prefix_distinct(x, [2, 4], ["place"]).orderBy("k").collect() for x in (obs, obs.orderBy(F.desc("place")).repartition(3)))
    assert a == b
