"""Queries against their SQL on tables made for one fault each."""

import hashlib
import re
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from prismet.functions import text
from prismet.operators import fingerprints, graph, lineage, shapes, text_pairs

ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def both(spark, folder, name):
    """Rows of a query and of its SQL, sorted."""
    con = duckdb.connect()
    for p in folder.iterdir():
        if p.suffix == ".parquet":
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}/*.parquet'")
    out = entry.queries()[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(f'\"{c}\"' for c in out.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, out.collect()), key=str), sorted(want, key=str)


def test_changed_subject_of_customer_zero(spark, tmp_path):
    """A customer whose key is 0 has a review of another subject too."""
    put(spark, tmp_path, "customer", [(0,), (7,)], "c_custkey long")
    put(spark, tmp_path, "orders", [(k, c, "F", 1.0, None, "5-LOW") for k, c in ((19, 0), (20, 0), (38, 7), (40, 7))], ORDERS)
    got, want = both(spark, tmp_path, "recovery_gates")
    assert got == want and (0, "external_validation", "unavailable", "external_validation_reviewed_subject_changed") in got


def test_fingerprint_of_three_levels(spark):
    """The trie of a view that needs three digits, against the definition."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = [(k,) for k in range(600)]
    hashes = sorted(sha(f"{len(str(k))}:{k}") for k, in rows)
    level = {p: sha(",".join(f"{h}:1" for h in hashes if h.startswith(p))) for p in {h[:3] for h in hashes}}
    for deep in (2, 1, 0):
        level = {p: sha(",".join(level[c] for c in sorted(level) if c.startswith(p))) for p in {c[:deep] for c in level}}
    got = fingerprints.fingerprints(spark.createDataFrame(rows, "k long").withColumn("v", F.lit("a")), ["v"], ["k"], node=2).collect()
    assert [(r["v"], r["fingerprint"], r["rows"]) for r in got] == [("a", level[""], 600)]


def test_measurements_meet_links_by_key(spark, tmp_path):
    """No list of all measurements of a state is made, and none is laid beside each of them."""
    put(spark, tmp_path, "part", [(k, k % 50, "b") for k in range(2000)], "p_partkey long, p_size int, p_brand string")
    got, want = both(spark, tmp_path, "measurement_bindings")
    assert got == want and len(got) == 2000
    plan = entry.queries()["measurement_bindings"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "linked" in plan and "array_contains" not in plan


LINE = "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double"


@pytest.mark.parametrize("name", ["review_problems", "domain_suites", "collection_eligibility"])
def test_tasks_of_bounded_rows(spark, tmp_path, monkeypatch, name):
    """Tasks are as many as the rows need, however few partitions a shuffle has; rows are those of the SQL."""
    put(spark, tmp_path, "orders", [(k, k % 30, "F", 1.0, None, "5-LOW") for k in range(600)], ORDERS)
    put(spark, tmp_path, "customer", [(k,) for k in range(30)], "c_custkey long")
    put(spark, tmp_path, "lineitem", [(k // 4, k % 5, k % 7, float(k % 51)) for k in range(600)], LINE)
    monkeypatch.setattr("prismet.session.TASK_ROWS", 20, raising=False)
    got, want = both(spark, tmp_path, name)
    assert got == want and len(got) >= 150
    plan = entry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().toString()
    parts = [int(x) for x in re.findall(r"hashpartitioning\([^\n]*?, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert parts and min(parts) >= 30


def test_walks_pass_edges_that_lead_nowhere_once(spark):
    """Rounds see edges that lead on only; repeated edges, cycles and the ends of ways come out as before."""
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("y", "z"), ("a", "z")], "src string, dst string")
    assert sorted(map(tuple, graph.inner_edges(edges).distinct().collect())) == [("a", "b"), ("a", "c"), ("b", "c"), ("x", "y"), ("y", "x")]
    assert dict(map(tuple, lineage.levels(None, edges).collect())) == {"a": 0, "b": 1, "c": 2, "d": 3, "x": None, "y": None, "z": None}
    assert {r["node"] for r in lineage.carried(spark.createDataFrame([("y",), ("c",), ("q",)], "node string"), edges).collect()} == {"y", "x", "z", "c", "d", "q"}


def test_tokens_of_asked_parts(spark, tmp_path):
    """Counts alone leave the task if only counts are asked for; long, empty, blank, equal and null texts keep their rows."""
    texts = ["a b c", "a b c", "", " \n", None, "x_1 é; 東京!", "word " * 60_000]
    put(spark, tmp_path, "conversations", [(k, 0, "user", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, entry.queries()["lexical_units"](spark, str(tmp_path)).collect()))
    plain = [text.tokens(t) for t in texts]
    assert got == [(k, 0, *((None,) * 3 if texts[k] is None else (p[0], p[2], len(p[4])))) for k, p in enumerate(plain)]
    out = text_pairs.trigram_sets(spark.read.parquet(f"{tmp_path}/conversations.parquet"), parts=("n_units", "trigrams"))
    assert {r["conv_id"]: r["tok"]["trigrams"] for r in out.where("conv_id < 4").collect()} == {k: plain[k][4] for k in range(4)}
    assert out.select("tok.*").columns == ["n_units", "trigrams"]


def test_reference_walk_writes_references_once(spark, tmp_path, monkeypatch):
    """One table of references for all depths of the records, not one of all nodes for each depth."""
    put(spark, tmp_path, "orders", [(k, 7 * k, "F", 1.0, None, "5-LOW") for k in range(1, 60)], ORDERS)
    lines = [(k, 100 + (k * n) % 9, k % 5, n % 3, "N" if (k + n) % 3 == 0 else "R") for k in range(1, 55) for n in range(k % 6)]
    put(spark, tmp_path, "lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string")
    tables, plain = [], shapes.written
    monkeypatch.setattr(shapes, "written", lambda df: tables.append(plain(df)) or tables[-1])
    got, want = both(spark, tmp_path, "reference_walk")
    assert got == want and len(tables) == 1 and tables[0].count() == len(got)


def put_turns(spark, folder):
    """A conversation of which texts share much, with many copies, beside one of two texts and one of a single text."""
    many = [f"common words {k % 9} and {k % 4} more {'tail ' * (k % 3)}" for k in range(60)] + [f"alone{k}" for k in range(5)]
    turns = [("c", k, "user", t) for k, t in enumerate(many)] + [("d", 0, "user", "a b"), ("d", 1, "user", "a b"), ("e", 0, "user", "z")]
    put(spark, folder, "conversations", turns, "conv_id string, turn int, role string, text string")
    return {(c, k): text.trigrams(text.lexical_units(t)) for c, k, _, t in turns}


def small_blocks(monkeypatch):
    """Blocks and parts of a few, and the budget that left cells out, where there is one."""
    for name, value in (("plans.queries._PAIRS", 0), ("operators.text_pairs.BLOCK", 5), ("operators.text_pairs.MEETINGS", 7), ("operators.text_pairs.DEALT", 2), ("operators.text_pairs.LEAVE", 10)):
        monkeypatch.setattr(f"prismet.{name}", value, raising=False)


def test_no_pair_of_trigrams_is_left_out(spark, tmp_path, monkeypatch):
    """Distances of all pairs that share a trigram, whatever the size of a conversation; copies have those of their text."""
    sets = put_turns(spark, tmp_path)
    small_blocks(monkeypatch)
    want = {}
    for (c, a), (e, b) in combinations(sorted(sets), 2):
        if c == e and (n := len(sets[c, a] & sets[c, b])):
            u = len(sets[c, a] | sets[c, b])
            want[c, a, b] = (n, u, round(1 - n / u, 10))
    got = [tuple(r) for r in entry.queries()["trigram_distance"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) > 1500 and {r[:3]: r[3:] for r in got} == want


def test_mean_of_all_pairs_of_trigrams(spark, tmp_path, monkeypatch):
    """Every conversation has its mean over all pairs, whatever its size."""
    sets = put_turns(spark, tmp_path)
    small_blocks(monkeypatch)
    far = [1 - len(sets[x] & sets[y]) / len(sets[x] | sets[y]) for x, y in combinations(sorted(sets), 2) if x[0] == y[0] == "c"]
    got = {r["cell"]: tuple(r)[1:] for r in entry.queries()["trigram_surface_distance"](spark, str(tmp_path)).collect()}
    assert got == {"c": (65, pytest.approx(sum(far) / len(far), abs=1e-9), "available"), "d": (2, 0.0, "available"), "e": (1, None, "undefined")}
