"""Registered queries of the analytics operators on the star schema, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismet.operators import admission, assay, bindings, compare, evidence, graph, longitudinal, metrics, null_model, responses, study, text_pairs
from prismet.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def _register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _events(spark, d):
    return _t(spark, d, "events").select(F.col("user_id").alias("cell"), F.col("event_type").alias("class"), "ts", "event_id")


_COUNTS = "c AS (SELECT user_id cell, event_type cls, count(*) n FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2)"


@_register(f"WITH {_COUNTS} SELECT cell, CAST(sum(n) AS BIGINT) population, count(*) support, CAST(sum(n * n) AS BIGINT) sci_num, CAST(sum(n) * sum(n) AS BIGINT) sci_den FROM c GROUP BY 1")
def class_distribution(spark, d):
    out = metrics.distribution(metrics.class_counts(_events(spark, d)))
    return out.select("cell", "population", F.col("support").cast("long").alias("support"), "sci_num", "sci_den")


@_register(f"WITH {_COUNTS}, t AS (SELECT cell, sum(n) p, sum(n * ln(n)) s, sum(n * n) q FROM c GROUP BY 1) SELECT cell, round(ln(p) - s / p, 8) entropy, round(exp(ln(p) - s / p), 6) effective_entropy, round(p * p / q, 8) effective_sci FROM t")
def structural_entropy(spark, d):
    out = metrics.distribution(metrics.class_counts(_events(spark, d)))
    return out.select("cell", F.round("entropy", 8).alias("entropy"), F.round("effective_entropy", 6).alias("effective_entropy"), F.round("effective_sci", 8).alias("effective_sci"))


@_register(f"WITH {_COUNTS}, t AS (SELECT *, sum(n) OVER (PARTITION BY cell) p FROM c) SELECT cell, CAST(sum(CASE WHEN 100 * n >= 22 * p THEN 1 ELSE 0 END) AS BIGINT) threshold_support FROM t GROUP BY 1")
def threshold_support(spark, d):
    return metrics.thresholded(metrics.class_counts(_events(spark, d)), "0.22").select("cell", F.col("threshold_support").cast("long").alias("threshold_support"))


@_register(f"WITH {_COUNTS}, r AS (SELECT DISTINCT event_type cls FROM events UNION SELECT 'never'), g AS (SELECT DISTINCT user_id cell FROM events) SELECT g.cell, r.cls AS class, coalesce(c.n, 0) n FROM g CROSS JOIN r LEFT JOIN c ON c.cell = g.cell AND c.cls = r.cls")
def registered_class_counts(spark, d):
    e = _events(spark, d)
    registry = e.select("class").distinct().union(spark.createDataFrame([("never",)], "class string"))
    return metrics.registered_counts(e, e, registry)


@_register(f"WITH {_COUNTS}, t AS (SELECT cell, sum(n) p, count(*) s, sum(n * n) q, sum(n * ln(n)) l FROM c GROUP BY 1) SELECT cell, CAST(s AS DOUBLE) support, round(ln(p) - l / p, 8) entropy, round(q / (p * p), 10) sci, 'available' entropy_status, 'not_requested' threshold_status FROM t")
def metric_statuses(spark, d):
    out = metrics.metric_results(metrics.distribution(metrics.class_counts(_events(spark, d))))
    return out.select("cell", F.col("r_support.value").alias("support"), F.round("r_entropy.value", 8).alias("entropy"), F.round("r_sci.value", 10).alias("sci"), F.col("r_entropy.status").alias("entropy_status"), F.col("r_threshold.status").alias("threshold_status"))


def _rated(spark, d):
    labels = _t(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "valid").when(F.col("quality") == 0, "invalid").alias("validity"))
    docs = _t(spark, d, "documents").select("doc_id", F.col("source").alias("cell"), F.col("lang").alias("class"))
    return docs.join(labels, "doc_id", "left").select("cell", F.col("class").isNotNull().alias("classified"), F.coalesce("validity", F.lit("not_assessed")).alias("validity"))


_RATED = "r AS (SELECT d.source cell, d.lang, CASE WHEN l.quality = 1 THEN 'valid' WHEN l.quality = 0 THEN 'invalid' ELSE 'not_assessed' END v FROM documents d LEFT JOIN labels l USING (doc_id)), k AS (SELECT cell, count(*) selected, count(lang) classified, count(*) FILTER (v = 'valid') valid, count(*) FILTER (v IN ('valid', 'invalid')) decisive, count(*) FILTER (v = 'valid' AND lang IS NOT NULL) classified_valid FROM r GROUP BY 1)"


@_register(f"WITH {_RATED} SELECT cell, selected, classified, valid, decisive, round(classified / selected, 10) classification_coverage, round(valid / selected, 10) valid_fraction_selected, round(decisive / selected, 10) decisive_validity_coverage, CASE WHEN valid > 0 THEN round(classified_valid / valid, 10) END classified_valid_coverage, CASE WHEN valid > 0 THEN 'available' ELSE 'undefined' END classified_valid_status, round(classified_valid / classified, 10) classified_valid_fraction FROM k")
def coverage_ratios(spark, d):
    out = metrics.coverage(_rated(spark, d))
    r = lambda c: F.round(f"{c}.value", 10).alias(c)
    return out.select("cell", "selected", "classified", "valid", "decisive", r("classification_coverage"), r("valid_fraction_selected"), r("decisive_validity_coverage"), r("classified_valid_coverage"), F.col("classified_valid_coverage.status").alias("classified_valid_status"), r("classified_valid_fraction"))


@_register(f"""WITH {_RATED}, g AS (
  SELECT cell, 'classification_coverage' gate, classified a, selected b, 9 t, 10 u, 'unresolved' e FROM k
  UNION ALL SELECT cell, 'decisive_validity_coverage', decisive, selected, 19, 20, 'unresolved' FROM k
  UNION ALL SELECT cell, 'classified_valid_coverage', classified_valid, valid, 9, 10, 'conditional_not_applicable' FROM k
  UNION ALL SELECT cell, 'validity_floor', valid, selected, 4, 5, 'unresolved' FROM k)
SELECT cell, gate, CASE WHEN b = 0 THEN e WHEN a * u >= t * b THEN 'passed' ELSE 'failed' END AS status FROM g""")
def cell_gates(spark, d):
    return compare.cell_gates(metrics.coverage(_rated(spark, d)))


@_register("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) k FROM events), m AS (SELECT user_id cell, max(k) n FROM r GROUP BY 1) SELECT m.cell, CAST(g.k AS INTEGER) k, CASE WHEN m.n >= g.k THEN (SELECT count(DISTINCT event_type) FROM r WHERE r.user_id = m.cell AND r.k <= g.k) END distinct_k, CASE WHEN m.n >= g.k THEN 'available' ELSE 'unavailable' END AS status FROM m CROSS JOIN (SELECT unnest([5, 10, 20]) k) g")
def prefix_distinct_k(spark, d):
    return metrics.prefix_distinct(_events(spark, d), [5, 10, 20], ["ts", "event_id"])


@_register("WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) k, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) f FROM events) SELECT user_id cell, event_id, CAST(k AS INTEGER) k, CAST(sum(CASE WHEN f = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS BIGINT) distinct_k FROM r")
def accumulation_curve(spark, d):
    return metrics.accumulation(_events(spark, d), ["ts", "event_id"]).select("cell", "event_id", "k", "distinct_k")


@_register("SELECT o_orderpriority, o_orderstatus, count(*) n FROM orders GROUP BY 1, 2")
def status_histogram(spark, d):
    return metrics.histogram(_t(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"])


@_register("SELECT 'orders' AS source, o_orderkey source_id, o_custkey target_id FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey) UNION ALL SELECT 'lineitem', l_orderkey, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey) UNION ALL SELECT 'labels', l.doc_id, l.doc_id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)")
def dangling_reference(spark, d):
    def refs(table, source, source_id, target_id, kind):
        return _t(spark, d, table).select(F.lit(source).alias("source"), F.col(source_id).alias("source_id"), F.col(target_id).alias("target_id"), F.lit(kind).alias("target_type"), F.lit(None).cast("string").alias("expected_type"))

    def keys(table, key, kind):
        return _t(spark, d, table).select(F.lit(kind).alias("target_type"), F.col(key).alias("target_id")).distinct()

    links = refs("orders", "orders", "o_orderkey", "o_custkey", "customer").union(refs("lineitem", "lineitem", "l_orderkey", "l_partkey", "part")).union(refs("labels", "labels", "doc_id", "doc_id", "document"))
    targets = keys("customer", "c_custkey", "customer").union(keys("part", "p_partkey", "part")).union(keys("documents", "doc_id", "document"))
    return admission.reference_problems(links, targets).where("problem = 'reference_missing'").select("source", "source_id", "target_id")


@_register("SELECT l_orderkey, l_linenumber, count(*) n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_identity(spark, d):
    return admission.duplicate_identities(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@_register("WITH p AS (SELECT l_orderkey g, unnest(range(1, max(l_linenumber) + 1)) i FROM lineitem GROUP BY 1), n AS (SELECT l_orderkey g, l_linenumber i, count(*) n FROM lineitem GROUP BY 1, 2) SELECT p.g AS order_key, CAST(p.i AS INTEGER) AS position, CASE WHEN n.n IS NULL THEN 'missing' WHEN n.n = 1 THEN 'present' ELSE 'ambiguous' END AS status FROM p LEFT JOIN n ON n.g = p.g AND n.i = p.i")
def position_status(spark, d):
    rows = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("generation_group_id"), F.col("l_linenumber").alias("within_group_index"), F.col("l_partkey").alias("sample_id"))
    planned = rows.groupBy("generation_group_id").agg(F.max("within_group_index").alias("_m")).select("generation_group_id", F.explode(F.sequence(F.lit(1), F.col("_m"))).alias("within_group_index"))
    return admission.positions(planned, rows).select(F.col("generation_group_id").alias("order_key"), F.col("within_group_index").alias("position"), "status")


@_register("SELECT l_orderkey, count(*) n, min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) contiguous FROM lineitem GROUP BY 1")
def position_contiguity(spark, d):
    return metrics.contiguous(_t(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber").select("l_orderkey", "n", "contiguous")


@_register("SELECT coalesce(l.doc_id, d.doc_id) doc_id, CASE WHEN l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL THEN 'selected' WHEN d.doc_id IS NOT NULL THEN 'excluded' ELSE 'unresolved' END selection FROM (SELECT DISTINCT doc_id FROM labels) l FULL JOIN (SELECT DISTINCT doc_id FROM documents) d ON l.doc_id = d.doc_id")
def selection_semi_anti(spark, d):
    return admission.selection(_t(spark, d, "labels"), _t(spark, d, "documents"), "doc_id")


def _daily(spark, d):
    return _t(spark, d, "events").select((F.col("user_id") % 20).alias("unit"), F.datediff(F.col("ts"), F.lit("2024-01-01")).alias("state"), F.col("event_type").alias("class"), "user_id")


def _weekly_sets(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").alias("unit"), F.floor(F.datediff(F.col("ts"), F.lit("2024-01-01")) / 2).cast("int").alias("state"), F.col("event_type").alias("class"))
    return longitudinal.support_sets(e.groupBy("unit", "state", "class").agg(F.count("*").alias("n")), ["unit", "state"])


@_register("""WITH s AS (SELECT user_id unit, CAST(floor(date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) / 2) AS INTEGER) state, list_sort(list(DISTINCT event_type)) c FROM events GROUP BY 1, 2),
p AS (SELECT unit, lag(state) OVER w a, state b, lag(c) OVER w x, c y FROM s WINDOW w AS (PARTITION BY unit ORDER BY state))
SELECT unit, a from_state, b to_state, CAST(len(list_filter(x, lambda e: list_contains(y, e))) AS INTEGER) retained, CAST(len(list_filter(x, lambda e: NOT list_contains(y, e))) AS INTEGER) lost, CAST(len(list_filter(y, lambda e: NOT list_contains(x, e))) AS INTEGER) gained, round(len(list_filter(x, lambda e: list_contains(y, e))) / len(x), 10) retention FROM p WHERE a IS NOT NULL""")
def set_change(spark, d):
    out = longitudinal.consecutive_changes(_weekly_sets(spark, d), "unit", "state")
    return out.select("unit", "from_state", "to_state", F.size("retained").alias("retained"), F.size("became_unobserved").alias("lost"), F.size("newly_observed").alias("gained"), F.round("retention", 10).alias("retention"))


@_register("""WITH o AS (SELECT user_id % 20 unit, event_type cls, CAST(date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) AS INTEGER) state, count(*) n FROM events GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT u.unit, c.cls, s.state FROM (SELECT DISTINCT unit FROM o) u, (SELECT DISTINCT cls FROM o) c, (SELECT CAST(unnest(range((SELECT min(state) FROM o), (SELECT max(state) + 1 FROM o))) AS INTEGER) state) s),
h AS (SELECT g.*, CASE WHEN g.state NOT IN (SELECT state FROM o) THEN NULL ELSE o.n IS NOT NULL AND o.n > 2 END seen FROM g LEFT JOIN o ON o.unit = g.unit AND o.cls = g.cls AND o.state = g.state),
w AS (SELECT *, max(CASE WHEN seen THEN state END) OVER b ls, max(CASE WHEN NOT seen THEN state END) OVER b la, max(CASE WHEN seen IS NULL THEN state END) OVER b lg FROM h WINDOW b AS (PARTITION BY unit, cls ORDER BY state ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT unit, cls AS class, state, CASE WHEN seen IS NULL THEN 'gap' WHEN NOT seen THEN 'absent' WHEN ls IS NULL THEN 'first_observed' WHEN la > ls THEN 'observed_reappearance' WHEN lg > ls THEN 'observed_after_gap' ELSE 'observed' END recurrence FROM w""")
def recurrence(spark, d):
    o = _daily(spark, d).groupBy("unit", "class", "state").agg(F.count("*").alias("n"))
    days = o.agg(F.sequence(F.min("state"), F.max("state")).alias("_s")).select(F.explode("_s").alias("state"))
    grid = o.select("unit").distinct().join(o.select("class").distinct(), F.lit(True)).join(days, F.lit(True))
    held = o.select("state").distinct().withColumn("held", F.lit(True))
    slots = grid.join(o, ["unit", "class", "state"], "left").join(held, "state", "left").withColumn("observed", F.when(F.col("held"), F.coalesce(F.col("n") > 2, F.lit(False))))
    return longitudinal.recurrence(slots, ["unit", "class"], "state").select("unit", "class", "state", "recurrence")


def _panel(spark, d):
    o = _t(spark, d, "orders").join(_t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    state = ((F.year("o_orderdate") - 1992) * 4 + F.quarter("o_orderdate")).cast("int")
    return o.select(F.col("c_mktsegment").alias("panel"), state.alias("state"), F.col("o_orderpriority").alias("class")).groupBy("panel", "state", "class").agg(F.count("*").alias("n"))


_PANEL = "q AS (SELECT c_mktsegment panel, CAST((year(o_orderdate) - 1992) * 4 + quarter(o_orderdate) AS INTEGER) state, o_orderpriority cls, count(*) n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3), v AS (SELECT panel, state, 1 - sum(n * n) / (sum(n) * sum(n)) d FROM q GROUP BY 1, 2)"


def _diversity(spark, d):
    return _panel(spark, d).groupBy("panel", "state").agg(longitudinal.gini(F.sum(F.col("n") * F.col("n")), F.sum("n")).alias("value"))


@_register(f"WITH {_PANEL} SELECT state, count(*) units, CASE WHEN count(*) = 5 THEN round(avg(d), 10) END mean, CASE WHEN count(*) = 5 THEN 'available' ELSE 'unavailable' END AS status FROM v GROUP BY 1")
def panel_curve(spark, d):
    return longitudinal.fixed_mean(_diversity(spark, d), ["state"], "value", 5).select("state", "units", F.round("mean", 10).alias("mean"), "status")


def _volume(spark, d):
    """Order value by priority and year, falling back at the end of the data."""
    return _t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("unit"), F.year("o_orderdate").alias("state")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))


_VOLUME = "v AS (SELECT o_orderpriority unit, year(o_orderdate) state, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) d FROM orders GROUP BY 1, 2)"


@_register(f"WITH {_VOLUME}, s AS (SELECT *, first_value(d) OVER (PARTITION BY unit ORDER BY state) d0 FROM v), c AS (SELECT unit, any_value(d0) d0, min(CASE WHEN d <= 0.97 * d0 THEN state END) crossing FROM s GROUP BY 1) SELECT c.unit, round(c.d0, 2) start_value, CAST(c.crossing AS INTEGER) crossing, CAST((SELECT max(state) FROM v WHERE v.unit = c.unit AND v.state < c.crossing) AS INTEGER) last_above FROM c")
def half_crossing(spark, d):
    return longitudinal.first_crossing(_volume(spark, d), "unit", "state", "value", 0.97).select("unit", F.round("start_value", 2).alias("start_value"), "crossing", "last_above")


@_register(f"WITH {_VOLUME}, s AS (SELECT unit, state - first_value(state) OVER w t, ln(d / first_value(d) OVER w) y FROM v WINDOW w AS (PARTITION BY unit ORDER BY state)), f AS (SELECT unit, count(*) n, sum(t * y) / sum(t * t) b FROM s GROUP BY 1), r AS (SELECT s.unit, max(abs(y - b * t)) m FROM s JOIN f USING (unit) GROUP BY 1) SELECT unit, n states, round(b, 10) beta, round(m, 10) max_residual, CASE WHEN b < 0 AND n >= 4 THEN round(-ln(2) / b, 4) END half_life, CASE WHEN n < 4 THEN 'unavailable' WHEN b >= 0 THEN 'undefined' ELSE 'available' END AS status FROM f JOIN r USING (unit)")
def log_decay_fit(spark, d):
    out = longitudinal.anchored_fit(_volume(spark, d), "unit", "state", "value")
    return out.select("unit", "states", F.round("beta", 10).alias("beta"), F.round("max_residual", 10).alias("max_residual"), F.round("half_life", 4).alias("half_life"), "status")


@_register(f"WITH {_VOLUME}, p AS (SELECT unit, state, state - lag(state) OVER w dt, lag(d) OVER w a, d b FROM v WINDOW w AS (PARTITION BY unit ORDER BY state)) SELECT unit, CAST(state AS INTEGER) state, CASE WHEN b < a THEN round(dt * ln(2) / ln(a / b), 6) END half_life, CASE WHEN b = a THEN 'undefined_no_decay' WHEN b > a THEN 'undefined_growth' ELSE 'available' END half_life_status FROM p WHERE a IS NOT NULL")
def interval_half_life(spark, d):
    w = Window.partitionBy("unit").orderBy("state")
    pairs = _volume(spark, d).withColumns({"dt": F.col("state") - F.lag("state").over(w), "start": F.lag("value").over(w)}).where(F.col("start").isNotNull())
    return longitudinal.interval_half_life(pairs, "dt", "start", "value").select("unit", "state", F.round("half_life", 6).alias("half_life"), "half_life_status")


def _blocks(spark, d):
    o = _t(spark, d, "orders").join(_t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return o.select(F.col("c_mktsegment").alias("block"), F.col("o_orderstatus").alias("condition"), F.col("o_orderpriority").alias("class")).groupBy("block", "condition", "class").agg(F.count("*").alias("n"))


_BLOCKS = "q AS (SELECT c_mktsegment block, o_orderstatus cond, o_orderpriority cls, count(*) n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3), g AS (SELECT block, cond, 1 - sum(n * n) / (sum(n) * sum(n)) d FROM q GROUP BY 1, 2)"
_DIFF = "x AS (SELECT a.block, 'P-F' contrast, a.d - b.d diff FROM g a JOIN g b ON a.block = b.block WHERE a.cond = 'P' AND b.cond = 'F' UNION ALL SELECT a.block, 'O-F', a.d - b.d FROM g a JOIN g b ON a.block = b.block WHERE a.cond = 'O' AND b.cond = 'F')"


def _differences(spark, d):
    cells = _blocks(spark, d).groupBy("block", "condition").agg(longitudinal.gini(F.sum(F.col("n") * F.col("n")), F.sum("n")).alias("value"))
    return compare.contrasts(cells, "block", "condition", "value", [("P", "F"), ("O", "F")])


@_register(f"WITH {_BLOCKS}, {_DIFF} SELECT contrast, count(diff) blocks, CASE WHEN count(diff) = 5 THEN round(avg(diff), 10) END mean, CASE WHEN count(diff) <> 5 THEN round(avg(diff), 10) END subset_mean, CASE WHEN count(diff) = 5 THEN 'available' ELSE 'unavailable' END AS status FROM x GROUP BY 1")
def paired_contrast(spark, d):
    out = compare.block_means(_differences(spark, d), ["contrast"], "difference", 5)
    return out.select("contrast", "blocks", F.round("mean", 10).alias("mean"), F.round("subset_mean", 10).alias("subset_mean"), "status")


@_register("WITH q AS (SELECT c_mktsegment block, o_orderstatus cond, o_orderpriority cls, count(*) n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3), s AS (SELECT *, n / sum(n) OVER (PARTITION BY block, cond) p FROM q) SELECT block, cls AS class, round(sum(CASE WHEN cond = 'P' THEN p ELSE 0 END) - sum(CASE WHEN cond = 'F' THEN p ELSE 0 END), 10) delta FROM s GROUP BY 1, 2")
def frequency_deltas(spark, d):
    return compare.frequency_deltas(_blocks(spark, d), "block", "condition", "class", "P", "F").withColumn("delta", F.round("delta", 10))


_INDICES = ",".join(f"({r},{i})" for r, row in enumerate(compare.replay_indices(5)) for i in row)
_BOOT = f"b AS (SELECT *, row_number() OVER (PARTITION BY contrast ORDER BY block) - 1 u FROM x), m AS (SELECT contrast, r, avg(diff) v FROM b JOIN (VALUES {_INDICES}) i(r, k) ON i.k = b.u GROUP BY 1, 2), z AS (SELECT contrast, quantile_cont(v, 0.025) l, quantile_cont(v, 0.975) h FROM m GROUP BY 1)"


def _intervals(spark, d):
    units = _differences(spark, d).withColumn("unit", F.row_number().over(Window.partitionBy("contrast").orderBy("block")) - 1)
    return compare.intervals(compare.replicate_means(units, compare.index_table(spark, 5), ["contrast"]), ["contrast"])


@_register(f"WITH {_BLOCKS}, {_DIFF}, {_BOOT} SELECT contrast, round(l, 9) low, round(h, 9) high FROM z")
def bootstrap_interval(spark, d):
    return _intervals(spark, d).select("contrast", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@_register(f"WITH {_BLOCKS}, {_DIFF}, {_BOOT} SELECT contrast, CASE WHEN a > 0 AND l > 0 AND h > 0 THEN 'supporting' WHEN a < 0 AND l < 0 AND h < 0 THEN 'contrary' ELSE 'inconclusive' END verdict FROM z JOIN (SELECT contrast, avg(diff) a FROM x GROUP BY 1) USING (contrast)")
def endpoint_verdict(spark, d):
    both = compare.block_means(_differences(spark, d), ["contrast"], "difference", 5).join(_intervals(spark, d), "contrast")
    return both.select("contrast", compare.verdict(F.col("mean"), F.col("low"), F.col("high"), F.col("status") != "available").alias("verdict"))


def _turn_sets(spark, d):
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), " "), lambda w: w != ""))
    return _t(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text")).select(F.col("conv_id").alias("cell"), F.col("turn").alias("ident"), words.alias("items"))


_TURNS = "t AS (SELECT conv_id, turn, list_distinct(list_filter(string_split(lower(min(text)), ' '), lambda w: w <> '')) w FROM conversations GROUP BY 1, 2), p AS (SELECT a.conv_id cell, a.turn a, b.turn b, len(list_intersect(a.w, b.w)) i, len(a.w) + len(b.w) s FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn < b.turn)"


@_register(f"WITH {_TURNS} SELECT cell, a, b, i AS intersection, s - i AS \"union\", round(1 - i / (s - i), 10) distance FROM p WHERE i > 0")
def pair_distance(spark, d):
    return text_pairs.pair_distances(_turn_sets(spark, d), "cell", "ident").withColumn("distance", F.round("distance", 10))


@_register(f"WITH {_TURNS}, n AS (SELECT conv_id cell, count(*) m FROM t GROUP BY 1), g AS (SELECT cell, avg(CASE WHEN i > 0 THEN 1 - i / (s - i) ELSE 1 END) v FROM p GROUP BY 1) SELECT n.cell, n.m, round(g.v, 9) mean_distance, CASE WHEN n.m > 1 THEN 'available' ELSE 'undefined' END AS status FROM n LEFT JOIN g USING (cell)")
def surface_distance(spark, d):
    sets = _turn_sets(spark, d)
    return text_pairs.surface_means(sets, text_pairs.pair_distances(sets, "cell", "ident"), "cell").withColumn("mean_distance", F.round("mean_distance", 9))


def _turn_trigrams(spark, d):
    """Eligible texts only, as in the surveyed distance; SQL has no Unicode categories, so these have no SQL form."""
    turns = _t(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    toks = text_pairs.trigram_sets(turns, parts=("status", "trigrams")).where(F.col("tok.status") == "eligible")
    return toks.select(F.col("conv_id").alias("cell"), F.col("turn").alias("ident"), F.col("tok.trigrams").alias("items"))


@_register()
def trigram_distance(spark, d):
    return text_pairs.set_distances(_turn_trigrams(spark, d), "cell", "ident").withColumn("distance", F.round("distance", 10))


@_register()
def trigram_surface_distance(spark, d):
    return text_pairs.set_means(_turn_trigrams(spark, d), "cell", "ident").withColumn("mean_distance", F.round("mean_distance", 9))


@_register(f"WITH {_TURNS} SELECT conv_id cell, count(*) m, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) pairs, CAST((count(*) - 1) * sum(len(w)) AS BIGINT) visits FROM t GROUP BY 1")
def pair_work(spark, d):
    return text_pairs.pair_work(_turn_sets(spark, d))


@_register(f"WITH {_COUNTS}, t AS (SELECT cell, CAST(sum(n) AS BIGINT) m, CAST(sum(n * (n - 1) / 2) AS BIGINT) w FROM c GROUP BY 1) SELECT cell, m, w same_class_pairs, CAST(m * (m - 1) / 2 AS BIGINT) pairs, CASE WHEN m > 1 THEN round(1 - w / (m * (m - 1) / 2), 10) END nonequivalence FROM t")
def structural_nonequivalence(spark, d):
    return text_pairs.structural_nonequivalence(metrics.class_counts(_events(spark, d))).withColumn("nonequivalence", F.round("nonequivalence", 10))


def _scenarios(spark, d):
    c = _t(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("k"))
    n = _t(spark, d, "nation").join(c.withColumnRenamed("c_nationkey", "n_nationkey"), "n_nationkey").select(F.col("n_regionkey").alias("scenario"), "k")
    return n.groupBy("scenario").agg(F.sum("k").alias("n"), longitudinal.gini(F.sum(F.col("k") * F.col("k")), F.sum("k")).alias("d0"))


_SCEN = "s AS (SELECT n_regionkey scenario, CAST(sum(k) AS BIGINT) n, 1 - sum(k * k) / (sum(k) * sum(k)) d0 FROM nation JOIN (SELECT c_nationkey, count(*) k FROM customer GROUP BY 1) ON c_nationkey = n_nationkey GROUP BY 1)"


@_register(f"WITH {_SCEN} SELECT scenario, CAST(t AS INTEGER) t, round(d0 * pow(1 - 1 / n, t), 10) expected FROM s CROSS JOIN (SELECT unnest(range(0, 13)) t)")
def categorical_forecast(spark, d):
    return null_model.forecast(_scenarios(spark, d), 12).withColumn("expected", F.round("expected", 10))


@_register(f"WITH {_SCEN} SELECT scenario, n, CASE WHEN n > 1 THEN round(ln(2) / -ln(1 - 1 / n), 5) END half_life, CAST(CASE WHEN n = 1 THEN 1 ELSE ceil(ln(2) / -ln(1 - 1 / n)) END AS BIGINT) first_crossing FROM s")
def null_half_life(spark, d):
    return null_model.null_half_life(_scenarios(spark, d)).withColumn("half_life", F.round("half_life", 5))


@_register("WITH p AS (SELECT n_regionkey scenario, n_nationkey cls, k / sum(k) OVER (PARTITION BY n_regionkey) p, 1 / count(*) OVER (PARTITION BY n_regionkey) e, 1 + n_nationkey % 3 w FROM nation JOIN (SELECT c_nationkey, count(*) k FROM customer GROUP BY 1) ON c_nationkey = n_nationkey), u AS (SELECT *, 0.75 * p + 0.25 * e m FROM p) SELECT scenario, cls AS class, round(m, 10) mixed, round(w * m / sum(w * m) OVER (PARTITION BY scenario), 10) selected FROM u")
def mixture_selection(spark, d):
    c = _t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("k"))
    w = Window.partitionBy("scenario")
    n = _t(spark, d, "nation").join(c, "n_nationkey").select(F.col("n_regionkey").alias("scenario"), F.col("n_nationkey").alias("class"), "k")
    n = n.select("scenario", "class", (F.col("k") / F.sum("k").over(w)).alias("p"), (1 / F.count("*").over(w)).alias("e"), (1 + F.col("class") % 3).alias("w"))
    return null_model.mixture(n, "scenario", 0.25).select("scenario", "class", F.round("mixed", 10).alias("mixed"), F.round("selected", 10).alias("selected"))


@_register("WITH q AS (SELECT o_orderpriority k, year(o_orderdate) t, count(*) n FROM orders GROUP BY 1, 2) SELECT k unit, CAST(t AS INTEGER) state, round(exp(sum(ln(1 - 1 / n)) OVER (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING)), 10) multiplier FROM q")
def schedule_multiplier(spark, d):
    q = _t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("unit"), F.year("o_orderdate").alias("state")).agg(F.count("*").alias("n"))
    return null_model.schedule_multiplier(q, "unit", "state").select("unit", "state", F.round("multiplier", 10).alias("multiplier"))


@_register("""WITH g AS (SELECT user_id % 40 k, CAST(date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) AS INTEGER) t, event_type c, count(*) n FROM events GROUP BY 1, 2, 3),
f AS (SELECT a.k, a.t, b.c, coalesce(g.n, 0) n FROM (SELECT DISTINCT k, t FROM g) a CROSS JOIN (SELECT DISTINCT c FROM g) b LEFT JOIN g ON g.k = a.k AND g.t = a.t AND g.c = b.c),
l AS (SELECT *, lag(n) OVER (PARTITION BY k, c ORDER BY t) p FROM f), s AS (SELECT k, t, coalesce(bool_or(n > 0 AND p = 0), false) bad, count(*) FILTER (n > 0 AND p = 0) m FROM l GROUP BY 1, 2)
SELECT k AS unit, t AS state, bad AS inconsistent, CAST(m AS INTEGER) AS classes, NOT coalesce(bool_or(bad) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) evaluated FROM s""")
def path_consistency(spark, d):
    g = _t(spark, d, "events").groupBy((F.col("user_id") % 40).alias("unit"), F.datediff("ts", F.lit("2024-01-01")).alias("state"), F.col("event_type").alias("class")).agg(F.count("*").alias("n"))
    grid = g.select("unit", "state").distinct().join(g.select("class").distinct(), F.lit(True)).join(g, ["unit", "state", "class"], "left").select("unit", "state", "class", F.coalesce("n", F.lit(0)).alias("n"))
    return null_model.path_consistency(grid, "unit", "state").select("unit", "state", "inconsistent", F.size("classes").alias("classes"), "evaluated")


def _trials(spark, d):
    """Line items as trials of their supplier group: success is a returned line, unknown a line of status O with flag N."""
    li = _t(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("unit"), F.year("l_shipdate").alias("stage"), "l_returnflag", "l_linestatus", "l_linenumber")
    return li.select("unit", "stage", F.lit("R").alias("class"), F.when(F.col("l_linestatus") == "F", F.col("l_returnflag")).when(F.col("l_returnflag") == "A", F.col("l_returnflag")).alias("observed_class"), F.lit("completed").alias("completion"), F.lit(False).alias("scoped_declaration"))


_TRIALS = "t AS (SELECT l_suppkey % 10 unit, year(l_shipdate) stage, CASE WHEN l_linestatus = 'F' OR l_returnflag = 'A' THEN l_returnflag END o FROM lineitem), c AS (SELECT unit, stage, count(*) trials, count(*) FILTER (o = 'R') low, count(*) FILTER (o = 'R' OR o IS NULL) high FROM t GROUP BY 1, 2)"


@_register(f"WITH {_TRIALS} SELECT unit, CAST(stage AS INTEGER) stage, trials, low, high FROM c")
def assay_rollup(spark, d):
    out = assay.rollup(assay.trial_outcomes(_trials(spark, d)), ["unit", "stage"])
    return out.select("unit", "stage", "trials", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"))


@_register()
def binomial_tail(spark, d):
    """Exact tails of each customer's filled orders against a chance of 1/3; every customer with orders is one look."""
    trials = _t(spark, d, "orders").select(F.col("o_custkey").alias("unit"), F.lit("F").alias("class"), F.col("o_orderstatus").alias("observed_class"), F.lit("completed").alias("completion"), F.lit(False).alias("scoped_declaration"))
    cells = assay.rollup(assay.trial_outcomes(trials), ["unit"])
    return assay.decisions(cells, "1/3", "1/20", trials.select("unit").distinct().count())


@_register("""WITH RECURSIVE o AS (SELECT o_custkey unit, count(*) trials, count(*) FILTER (o_orderstatus = 'F') low, count(*) FILTER (o_orderstatus = 'F' OR o_orderstatus IS NULL) high FROM orders GROUP BY 1),
b AS (SELECT n, 0 k, CAST(1 AS HUGEINT) c FROM (SELECT DISTINCT trials n FROM o) UNION ALL SELECT n, k + 1, c * (n - k) // (k + 1) FROM b WHERE k < n),
t AS (SELECT unit, trials, low, high, 40 * (SELECT count(*) FROM o) j, CAST(pow(3, trials) AS HUGEINT) w, sum(CASE WHEN k >= low THEN c * CAST(pow(2, n - k) AS HUGEINT) ELSE 0 END) u, sum(CASE WHEN k <= high THEN c * CAST(pow(2, n - k) AS HUGEINT) ELSE 0 END) l FROM o JOIN b ON b.n = o.trials GROUP BY 1, 2, 3, 4)
SELECT unit, trials, low, high, CASE WHEN j * u <= w THEN 'threshold_present' WHEN j * l < w THEN 'threshold_below' ELSE 'unresolved' END AS status FROM t""")
def binomial_status(spark, d):
    return binomial_tail(spark, d).select("unit", "trials", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"), "status")


@_register("""WITH RECURSIVE e AS (SELECT 'n' || c_nationkey s, 'c' || c_custkey t FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
w AS (SELECT 'n' || n_nationkey origin, 'n' || n_nationkey node FROM nation UNION SELECT origin, e.t FROM w JOIN e ON e.s = w.node),
r AS (SELECT 'o' || o_orderkey node, CASE WHEN o_orderstatus = 'F' THEN 'essential' ELSE 'contextual' END strength FROM orders)
SELECT w.origin AS correction, CAST(count(*) FILTER (strength = 'essential') AS BIGINT) invalidated, CAST(count(*) FILTER (strength <> 'essential') AS BIGINT) restricted, CAST((SELECT count(*) FROM r) - count(r.node) AS BIGINT) preserved FROM w LEFT JOIN r USING (node) GROUP BY 1""")
def correction_effects(spark, d):
    """Orders that fall or are restricted if a nation's record is corrected [G2, G3]."""
    uses = _t(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"))
    uses = uses.union(_t(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey"), F.concat(F.lit("c"), "o_custkey")))
    fixes = _t(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("correction")).withColumn("target", F.col("correction"))
    results = _t(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("node"), F.when(F.col("o_orderstatus") == "F", "essential").otherwise("contextual").alias("strength"))
    out = graph.result_effects(graph.impact(fixes, uses), results)
    return out.select("correction", *[F.col(c).cast("long").alias(c) for c in ("invalidated", "restricted", "preserved")])


@_register("SELECT coalesce(a.k, b.k) AS \"key\", coalesce(a.n, 0) left_n, coalesce(b.n, 0) right_n FROM (SELECT c_mktsegment || c_nationkey k, count(*) n FROM customer GROUP BY 1) a FULL JOIN (SELECT c_mktsegment || c_nationkey k, count(*) n FROM customer WHERE c_acctbal > 0 GROUP BY 1) b ON a.k = b.k WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)")
def multiset_differences(spark, d):
    """Multiset equality of two tables [U6, U9]."""
    c = _t(spark, d, "customer").select(F.concat("c_mktsegment", "c_nationkey").alias("key"), "c_acctbal")
    return evidence.multiset_differences(c, c.where("c_acctbal > 0"), ["key"])


@_register("WITH d AS (SELECT source, lang, doc_id IN (SELECT doc_id FROM labels) emitted, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) qualified, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0) audited FROM documents) SELECT source, lang, count(*) planned, CAST(count(*) FILTER (emitted) AS BIGINT) emitted, CAST(count(*) FILTER (qualified) AS BIGINT) qualified, CAST(count(*) FILTER (audited) AS BIGINT) audited FROM d GROUP BY 1, 2")
def denominators(spark, d):
    """Counts of each step in a column of its own [A30]."""
    l = _t(spark, d, "labels").groupBy("doc_id").agg(F.lit(True).alias("emitted"), F.bool_or(F.col("quality") == 1).alias("qualified"), F.bool_or(F.col("toxic") == 0).alias("audited"))
    rows = _t(spark, d, "documents").join(l, "doc_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("emitted", "qualified", "audited")})
    return evidence.denominators(rows, ["source", "lang"])


@_register(f"WITH {_TRIALS}, s AS (SELECT unit, stage, CASE WHEN 3 * low >= trials THEN 'threshold_present' WHEN 3 * high < trials THEN 'threshold_below' ELSE 'unresolved' END st FROM c) SELECT unit, CASE WHEN bool_or(st = 'threshold_present') THEN 'threshold_present' WHEN bool_and(st = 'threshold_below') THEN 'threshold_below' ELSE 'unresolved' END AS status FROM s GROUP BY 1")
def assay_class_status(spark, d):
    return assay.class_status(_empirical(spark, d), ["unit"])


def _empirical(spark, d):
    cells = assay.rollup(assay.trial_outcomes(_trials(spark, d)), ["unit", "stage"])
    return cells.withColumn("status", F.when(3 * F.col("low") >= F.col("trials"), "threshold_present").when(3 * F.col("high") < F.col("trials"), "threshold_below").otherwise("unresolved"))


def _before_after(spark, d):
    n = _t(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("unit"), (F.col("l_partkey") % 25).alias("class"), (F.year("l_shipdate") >= 1996).alias("late")).agg(F.count("*").alias("n"))
    status = F.when(F.col("n") >= 110, "threshold_present").when(F.col("n") < 95, "threshold_below").otherwise("unresolved")
    grid = n.select("unit", "class").distinct()
    pre = grid.join(n.where("NOT late"), ["unit", "class"], "left").select("unit", "class", F.when(F.coalesce("n", F.lit(0)) >= 110, "threshold_present").otherwise("threshold_below").alias("status"))
    return pre, n.where("late").select("unit", "class", status.alias("status"))


@_register("""WITH n AS (SELECT l_suppkey % 10 unit, l_partkey % 25 c, year(l_shipdate) >= 1996 late, count(*) n FROM lineitem GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT unit, c FROM n), b AS (SELECT g.*, coalesce((SELECT n FROM n WHERE n.unit = g.unit AND n.c = g.c AND NOT late), 0) x, (SELECT n FROM n WHERE n.unit = g.unit AND n.c = g.c AND late) y FROM g),
t AS (SELECT unit, count(*) FILTER (x < 110) missing, count(*) FILTER (x < 110 AND y >= 110) recovered, count(*) FILTER (x < 110 AND (y IS NULL OR (y >= 95 AND y < 110))) opened FROM b GROUP BY 1)
SELECT unit, CAST(missing AS BIGINT) missing, CAST(recovered AS BIGINT) recovered, CASE WHEN missing > 0 AND opened = 0 THEN round(recovered / missing, 10) END rate, CASE WHEN missing > 0 THEN round(recovered / missing, 10) END low, CASE WHEN missing > 0 THEN round((recovered + opened) / missing, 10) END high, CASE WHEN missing = 0 THEN 'undefined' WHEN opened > 0 THEN 'unavailable' ELSE 'available' END AS status FROM t""")
def recovery_rate(spark, d):
    out = assay.recovery(*_before_after(spark, d), ["unit"])
    r = lambda c: F.round(c, 10).alias(c)
    return out.select("unit", F.col("missing").cast("long").alias("missing"), F.col("recovered").cast("long").alias("recovered"), r("rate"), r("low"), r("high"), "status")


@_register("WITH RECURSIVE e AS (SELECT 'r' || n_regionkey s, 'n' || n_nationkey t FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders), w AS (SELECT 'r' || r_regionkey origin, 'r' || r_regionkey node, 0 depth FROM region UNION SELECT origin, e.t, depth + 1 FROM w JOIN e ON e.s = w.node) SELECT origin, CAST(depth AS INTEGER) depth, count(*) n FROM w GROUP BY 1, 2")
def dependency_closure(spark, d):
    edge = lambda table, p, a, q, b: _t(spark, d, table).select(F.concat(F.lit(p), F.col(a)).alias("src"), F.concat(F.lit(q), F.col(b)).alias("dst"))
    edges = edge("nation", "r", "n_regionkey", "n", "n_nationkey").union(edge("customer", "n", "c_nationkey", "c", "c_custkey")).union(edge("orders", "c", "o_custkey", "o", "o_orderkey"))
    seeds = _t(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("origin")).withColumn("node", F.col("origin"))
    return graph.closure(seeds, edges).groupBy("origin", "depth").agg(F.count("*").alias("n"))


@_register("WITH v AS (SELECT doc_id, quality a, CASE WHEN toxic IS NOT NULL THEN 1 - toxic END b FROM labels) SELECT count(*) items, CAST(count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS BIGINT) paired, CAST(count(*) FILTER (a = b) AS BIGINT) agreeing, CAST(count(*) FILTER (a IS NULL OR b IS NULL) AS BIGINT) single FROM v")
def rater_agreement(spark, d):
    v = _t(spark, d, "labels")
    both = v.select("doc_id", F.lit(1).alias("slot"), F.col("quality").alias("category")).union(v.select("doc_id", F.lit(2), 1 - F.col("toxic")))
    out = study.agreement(both, "doc_id", "slot", "category")
    return out.select("items", *[F.col(c).cast("long").alias(c) for c in ("paired", "agreeing", "single")])


@_register("WITH r AS (SELECT d.doc_id, d.source, d.lang, row_number() OVER (PARTITION BY source, lang ORDER BY l.doc_id IS NOT NULL DESC, d.doc_id) k FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)) SELECT source, lang, doc_id FROM r WHERE k = 1")
def audit_selection(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source", "lang").join(_t(spark, d, "labels").select("doc_id").distinct().withColumn("chosen", F.lit(True)), "doc_id", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    return study.audit_representatives(docs, ["source", "lang"], "chosen", ["doc_id"]).select("source", "lang", "doc_id")


@_register("SELECT CAST(g AS INTEGER) AS \"group\", CAST(b AS INTEGER) AS block, c AS condition, CAST((g - 1) * 18 + (b - 1) * 3 + instr(list_extract(['ABC', 'ACB', 'BAC', 'BCA', 'CAB', 'CBA'], CAST((b + g - 2) % 6 + 1 AS INTEGER)), c) AS INTEGER) call_order, CAST(1 + (b + instr('ABC', c) + g - 3) % 5 AS INTEGER) AS position FROM (SELECT unnest(range(1, 5)) g), (SELECT unnest(range(1, 7)) b), (SELECT unnest(['A', 'B', 'C']) c)")
def audit_positions(spark, d):
    out = study.audit_positions(study.design(spark))
    return out.select("group", "block", "condition", F.col("call_order").cast("int").alias("call_order"), "position")


@_register("SELECT c_mktsegment segment, count(DISTINCT c_nationkey % 2) currencies, CASE WHEN count(DISTINCT c_nationkey % 2) = 1 THEN sum(CAST(o_totalprice AS DECIMAL(18, 2)))::DOUBLE END total FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1 UNION ALL SELECT n_name, count(DISTINCT c_nationkey % 2), CASE WHEN count(DISTINCT c_nationkey % 2) = 1 THEN sum(CAST(o_totalprice AS DECIMAL(18, 2)))::DOUBLE END FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def spend_single_currency(spark, d):
    o = _t(spark, d, "orders").join(_t(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("currency", F.col("c_nationkey") % 2)
    a = study.spending(o.withColumn("segment", F.col("c_mktsegment")), ["segment"], "o_totalprice", "currency")
    b = study.spending(o.withColumn("segment", F.col("n_name")), ["segment"], "o_totalprice", "currency")
    return a.union(b).select("segment", "currencies", F.col("total").cast("double").alias("total"))


@_register("SELECT conv_id, turn, prev_turn FROM (SELECT conv_id, turn, len(text) n, lag(len(text)) OVER w p, lag(turn) OVER w prev_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE n <= p")
def order_violations(spark, d):
    c = _t(spark, d, "conversations").withColumn("n", F.length("text"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    return study.order_violations(c.withColumn("prev_turn", F.lag("turn").over(w)), "conv_id", "turn", "n").select("conv_id", "turn", "prev_turn")


@_register("SELECT l_partkey AS call, count(DISTINCT l_suppkey) units FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def shared_units(spark, d):
    return compare.shared_units(_t(spark, d, "lineitem").withColumnRenamed("l_partkey", "call"), "call", "l_suppkey")


@_register("SELECT coalesce(a.k, b.k) AS doc_id, CASE WHEN a.k IS NULL THEN 'only_right' WHEN b.k IS NULL THEN 'only_left' ELSE 'value' END AS differs FROM (SELECT doc_id k, max(quality) v FROM labels GROUP BY 1) a FULL JOIN (SELECT doc_id k, CASE WHEN n_chars >= 200 THEN 1 ELSE 0 END v FROM documents) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v IS DISTINCT FROM b.v")
def bridge_mismatches(spark, d):
    a = _t(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("value"))
    b = _t(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") >= 200, 1).otherwise(0).alias("value"))
    return admission.mismatches(a, b, ["doc_id"], ["value"]).select("doc_id", F.array_join("differs", ",").alias("differs"))


@_register("""WITH c AS (SELECT o_orderkey, o_orderstatus, o_custkey % 3 want, l.l_linenumber, l.l_returnflag rf, l.l_linestatus ls, l.l_suppkey % 3 frame, l.l_quantity q, CASE WHEN l.l_linenumber = 5 THEN ' ' ELSE 'seen' END detail FROM orders LEFT JOIN lineitem l ON l.l_orderkey = o_orderkey),
p AS (SELECT o_orderkey, unnest(list_filter([
CASE WHEN l_linenumber IS NULL THEN 'essential_evidence_unresolved' END,
CASE WHEN l_linenumber IS NOT NULL AND frame IS DISTINCT FROM want THEN 'evidence_frame_mismatch' END,
CASE WHEN l_linenumber IS NOT NULL AND l_linenumber = 3 THEN 'evidence_property_mismatch' END,
CASE WHEN l_linenumber IS NOT NULL AND (coalesce(rf, 'R') = 'R' OR q > 45) THEN 'essential_evidence_not_active_or_readable' END,
CASE WHEN l_linenumber IS NOT NULL AND ls IS DISTINCT FROM o_orderstatus THEN 'evidence_assertion_mismatch' END,
CASE WHEN l_linenumber IS NOT NULL AND trim(detail) = '' THEN 'missing_evidence_detail' END], lambda x: x IS NOT NULL)) AS code FROM c)
SELECT o.o_orderkey decision, coalesce(t.problems, '') problems FROM orders o LEFT JOIN (SELECT o_orderkey, string_agg(DISTINCT code, ',' ORDER BY code) problems FROM p GROUP BY 1) t ON t.o_orderkey = o.o_orderkey""")
def decisive_evidence(spark, d):
    lines = _t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("decision"), F.when(F.coalesce("l_returnflag", F.lit("R")) == "R", "withdrawn").otherwise("active").alias("state"), F.when(F.col("l_quantity") > 45, "withheld").otherwise("readable").alias("access"),
        F.array((F.col("l_suppkey") % 3).cast("string")).alias("scopes"), F.when(F.col("l_linenumber") == 3, "validity").otherwise("mechanism").alias("purpose"), F.col("l_linestatus").alias("assertion"), F.when(F.col("l_linenumber") == 5, " ").otherwise("seen").alias("detail"),
    )
    orders = _t(spark, d, "orders").select(F.col("o_orderkey").alias("decision"), (F.col("o_custkey") % 3).cast("string").alias("want_frame"), F.lit("mechanism").alias("want_purpose"), F.col("o_orderstatus").alias("want_outcome"))
    found = evidence.evidence_problems(orders.join(lines, "decision", "left"), "adjudicated_import")
    codes = found.groupBy("decision").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("problems")))), ",").alias("problems"))
    return codes


@_register("SELECT e.user_id unit, coalesce(t.classes, '') AS classes, CAST(coalesce(t.n, 0) AS INTEGER) AS size FROM (SELECT DISTINCT user_id FROM events) e LEFT JOIN (SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS classes, count(DISTINCT event_type) n FROM events WHERE value >= 50 AND event_id % 5 <> 0 GROUP BY 1) t ON t.user_id = e.user_id")
def observed_union(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").alias("unit"), F.col("event_type").alias("class"), F.when(F.col("value") >= 50, "success").otherwise("failure").alias("outcome"), F.when(F.col("event_id") % 5 == 0, F.array(F.lit("restricted"))).alias("reasons"))
    return assay.observed_union(e, "unit").select("unit", F.array_join("classes", ",").alias("classes"), "size")


@_register("WITH e AS (SELECT DISTINCT l_orderkey suite, l_linenumber c FROM lineitem), r AS (SELECT l_orderkey suite, l_linenumber c, bool_and(l_quantity < 48) ok, count(*) n FROM lineitem WHERE l_suppkey % 5 <> 0 GROUP BY 1, 2) SELECT suite, count(*) expected, count(n) performed, CASE WHEN coalesce(bool_or(NOT ok), false) THEN 'violated' WHEN max(n) > 1 THEN 'conflicting' WHEN count(n) < count(*) THEN 'incomplete' ELSE 'passed' END state FROM e LEFT JOIN r USING (suite, c) GROUP BY 1")
def domain_suites(spark, d):
    t = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("suite"), F.col("l_linenumber").alias("case_id"), (F.col("l_quantity") < 48).alias("passed"), "l_suppkey")
    return evidence.domain_results(t.select("suite", "case_id"), t.where("l_suppkey % 5 <> 0"), ["suite"])


@_register("WITH r AS (SELECT event_id id, user_id sample_id, CASE WHEN event_id % 3 = 0 THEN event_id - event_id % 7 END sup FROM events) SELECT r.id, r.sample_id, CASE WHEN bool_or(n.sample_id <> r.sample_id) THEN 'cross_sample_supersession' WHEN count(n.id) > 0 THEN 'selected_revision_superseded' ELSE 'current' END state FROM r LEFT JOIN r n ON n.sup = r.id GROUP BY 1, 2")
def revision_states(spark, d):
    r = _t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("sample_id"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") - F.col("event_id") % 7).alias("supersedes"))
    return graph.successors(r)


@_register("""WITH a AS (SELECT o_orderkey k, o_custkey % 2 cell, CASE WHEN o_custkey % 5 > 0 THEN o_orderkey % 3 END grp, CASE WHEN o_orderkey % 13 = 0 THEN 'not_attempted' ELSE 'completed' END st FROM orders WHERE o_orderkey % 11 <> 0)
SELECT l_orderkey sample, l_linenumber line, array_to_string(list_sort(list_filter([
CASE WHEN a.k IS NULL THEN 'attempt_reference_unresolved' END, CASE WHEN a.cell <> l_suppkey % 2 THEN 'attempt_cell_mismatch' END, CASE WHEN a.grp <> l_partkey % 3 THEN 'attempt_group_mismatch' END,
CASE WHEN a.st = 'not_attempted' THEN 'output_from_unattempted_slot' END], lambda x: x IS NOT NULL)), ',') defects FROM lineitem LEFT JOIN a ON a.k = l_orderkey""")
def attempt_association(spark, d):
    real = _t(spark, d, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("sample_id"), F.col("l_orderkey").alias("attempt_id"), (F.col("l_suppkey") % 2).alias("analysis_cell_id"), (F.col("l_partkey") % 3).alias("generation_group_id"), F.lit(None).cast("string").alias("raw_response"))
    tries = _t(spark, d, "orders").where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("attempt_id"), (F.col("o_custkey") % 2).alias("analysis_cell_id"), F.when(F.col("o_custkey") % 5 > 0, F.col("o_orderkey") % 3).alias("generation_group_id"), F.lit(None).cast("string").alias("raw_response"), F.when(F.col("o_orderkey") % 13 == 0, "not_attempted").otherwise("completed").alias("attempt_status"))
    return admission.association(real, tries).select(F.col("sample_id.l_orderkey").alias("sample"), F.col("sample_id.l_linenumber").alias("line"), F.array_join("defects", ",").alias("defects"))


@_register("WITH r AS (SELECT c_nationkey claim, (['structural_validity', 'external_presence', 'source_integrity', 'tail_retention', 'corrective_capacity'])[c_custkey % 5 + 1] condition, c_custkey % 41 > 0 met, c_custkey % 67 > 0 cur FROM customer) SELECT claim, CASE WHEN count(DISTINCT condition) < 5 THEN 'withheld' WHEN bool_and(met) AND bool_and(cur) THEN 'supported_for_scope' ELSE 'restricted' END disposition, coalesce(string_agg(DISTINCT CASE WHEN NOT met THEN condition END, ',' ORDER BY CASE WHEN NOT met THEN condition END), '') open_conditions FROM r GROUP BY 1")
def integrity_dispositions(spark, d):
    names = F.array(*map(F.lit, evidence.INTEGRITY))
    r = _t(spark, d, "customer").select(F.col("c_nationkey").alias("claim"), F.get(names, (F.col("c_custkey") % 5).cast("int")).alias("condition"), F.when(F.col("c_custkey") % 41 > 0, "met").otherwise("open").alias("state"), (F.col("c_custkey") % 67 > 0).alias("current"))
    return evidence.integrity_claims(r).select("claim", "disposition", F.array_join("open_conditions", ",").alias("open_conditions"))


@_register("WITH i AS (SELECT DISTINCT n_name x FROM nation), o AS (SELECT DISTINCT least(a.n_name, b.n_name) a, greatest(a.n_name, b.n_name) b FROM customer JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = c_custkey % 7) SELECT l.x a, r.x b, o.a IS NOT NULL covered FROM i l JOIN i r ON l.x < r.x LEFT JOIN o ON o.a = l.x AND o.b = r.x")
def registry_pairs(spark, d):
    n = _t(spark, d, "nation").select("n_nationkey", "n_name")
    items = n.select(F.col("n_name").alias("item"))
    c = _t(spark, d, "customer").select("c_nationkey", (F.col("c_custkey") % 7).alias("_k"))
    seen = c.join(n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("a")), "c_nationkey").join(n.select(F.col("n_nationkey").alias("_k"), F.col("n_name").alias("b")), "_k")
    return evidence.pair_coverage(seen, items)


@_register("SELECT doc_id, n_chars artifact, array_to_string(list_sort(list_filter([CASE WHEN count(*) OVER (PARTITION BY n_chars) > 1 THEN 'duplicate_artifact' END, CASE WHEN doc_id % 7 = 0 THEN 'audit_challenge' END, CASE WHEN quality IS NULL THEN 'decision_missing' END], lambda x: x IS NOT NULL)), ',') reasons, NOT (count(*) OVER (PARTITION BY n_chars) > 1 OR doc_id % 7 = 0 OR quality IS NULL) qualified FROM documents LEFT JOIN (SELECT doc_id, max(quality) quality FROM labels GROUP BY 1) USING (doc_id)")
def artifact_qualification(spark, d):
    decided = _t(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("decision"))
    rows = _t(spark, d, "documents").select("doc_id", F.col("n_chars").alias("artifact_id"), (F.col("doc_id") % 7 == 0).alias("challenged"), F.lit(None).cast("array<string>").alias("problems")).join(decided, "doc_id", "left")
    return evidence.qualification(rows).select("doc_id", F.col("artifact_id").alias("artifact"), F.array_join("reasons", ",").alias("reasons"), "qualified")


@_register("WITH w AS (SELECT DISTINCT user_id trajectory, user_id % 20 AS first, user_id % 20 + 4 AS last FROM events) SELECT trajectory, string_agg(DISTINCT event_type, ',' ORDER BY event_type) restrictions FROM w JOIN events ON user_id = trajectory WHERE event_id % 30 > first AND event_id % 30 <= last GROUP BY 1")
def regime_restrictions(spark, d):
    e = _t(spark, d, "events")
    windows = e.select(F.col("user_id").alias("trajectory"), (F.col("user_id") % 20).alias("first"), (F.col("user_id") % 20 + 4).alias("last")).distinct()
    out = evidence.regime_restrictions(windows, e.select(F.col("user_id").alias("trajectory"), (F.col("event_id") % 30).alias("at"), F.col("event_type").alias("kind")))
    return out.select("trajectory", F.array_join("restrictions", ",").alias("restrictions"))


@_register("""WITH RECURSIVE l AS (SELECT c_custkey src, c_custkey // 2 dst FROM customer WHERE c_custkey % 10 <> 9 AND c_custkey > 1 UNION SELECT 9, 19 UNION SELECT 19, 9),
r AS (SELECT c_custkey origin, c_custkey node FROM customer UNION SELECT r.origin, l.dst FROM r JOIN l ON l.src = r.node)
SELECT origin decision, array_to_string(list_filter([CASE WHEN bool_or(node IN (9, 19)) THEN 'circular_evidence_support' END, CASE WHEN bool_or(node % 31 = 0) THEN 'dependent_evidence_unavailable' END], lambda x: x IS NOT NULL), ',') problems FROM r GROUP BY 1""")
def evidence_walk(spark, d):
    c = _t(spark, d, "customer").select("c_custkey")
    links = c.where("c_custkey % 10 <> 9 AND c_custkey > 1").select(F.col("c_custkey").alias("src"), F.expr("c_custkey div 2").alias("dst")).union(spark.createDataFrame([(9, 19), (19, 9)], "src long, dst long"))
    out = evidence.decisive_walk(c.withColumnRenamed("c_custkey", "decision"), links, c.where("c_custkey % 31 = 0").withColumnRenamed("c_custkey", "node"))
    return out.select("decision", F.array_join("problems", ",").alias("problems"))


@_register("""WITH p AS (SELECT l_orderkey cell, l_linenumber % 2 g, l_linenumber i, bool_or(l_quantity < 40) e FROM lineitem GROUP BY 1, 2, 3),
o AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY g, i) n FROM p), t AS (SELECT cell, coalesce(min(CASE WHEN NOT e THEN n END) - 1, count(*)) prefix FROM o GROUP BY 1),
c AS (SELECT cell, count(*) AS groups, sum(ok::BIGINT)::BIGINT complete_groups FROM (SELECT cell, g, bool_and(e) ok FROM p GROUP BY 1, 2) GROUP BY 1)
SELECT cell, groups, complete_groups, prefix, concat_ws(',', CASE WHEN prefix >= 1 THEN '1' END, CASE WHEN prefix >= 2 THEN '2' END, CASE WHEN prefix >= 4 THEN '4' END) eligible FROM c JOIN t USING (cell)""")
def collection_eligibility(spark, d):
    t = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("cell"), (F.col("l_linenumber") % 2).alias("group"), F.col("l_linenumber").alias("index"), (F.col("l_quantity") < 40).alias("emitted"))
    out = study.collection_eligibility(t, t, "cell", "group", "index", [1, 2, 4])
    return out.withColumn("eligible", F.array_join(F.transform("eligible", lambda k: k.cast("string")), ","))


def _answers(spark, d):
    """Responses of five sections that hold a turn each: all of them, one missing, one repeated, the last fence left open."""
    t = _t(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    body = F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\n\\r`~]", " "), F.lit(" x\n"))
    section = lambda k, end="```\n": F.concat(F.lit(f"### Candidate {k}\n```python\n"), body, F.lit(end))
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4))
    whole = [section(k) for k in range(1, 5)]
    text = F.when(kind == 0, F.concat(*whole, section(5))).when(kind == 1, F.concat(whole[0], *whole[2:], section(5))).when(kind == 2, F.concat(whole[0], *whole, section(5))).otherwise(F.concat(*whole, section(5, "")))
    return t.select("conv_id", "turn", text.alias("text"))


_ANSWERS = """t AS (SELECT conv_id, turn, (conv_id + turn) % 4 kind, strlen(regexp_replace(coalesce(min(text), ''), '[\n\r`~]', ' ', 'g')) + 3 n FROM conversations GROUP BY 1, 2)"""


@_register(f"""WITH {_ANSWERS} SELECT conv_id, turn, kind <> 2 order_established, kind = 0 group_complete, CAST(CASE WHEN kind = 2 THEN 2 ELSE 0 END AS INTEGER) extras FROM t""")
def candidate_receipts(spark, d):
    return responses.receipts(_answers(spark, d)).select("conv_id", "turn", "order_established", "group_complete", F.size("extras").alias("extras"))


@_register()
def response_extraction(spark, d):
    out = responses.receipts(_t(spark, d, "conversations").select("conv_id", "turn", "text"))
    return out.select("conv_id", "turn", F.to_json("positions").alias("positions"), "order_established", "group_complete")


@_register()
def lexical_units(spark, d):
    out = text_pairs.trigram_sets(_t(spark, d, "conversations").select("conv_id", "turn", "text"), parts=("status", "n_units", "n_trigrams"))
    return out.select("conv_id", "turn", F.col("tok.status").alias("status"), F.col("tok.n_units").alias("n_units"), F.col("tok.n_trigrams").alias("n_trigrams"))


def _parts(spark, d):
    """Parts as measurements: a brand is their cell, a size their state, a container their panel."""
    p = _t(spark, d, "part").select("p_partkey", "p_size", "p_brand")
    k = F.col("p_partkey")
    return p.select(
        k.alias("measurement"), (k % 40).alias("cell"), (k % 30).alias("state"), (k % 10).alias("panel"), F.when(k % 2 == 0, "all").otherwise("valid").alias("view"), F.when(k % 11 == 0, 9).otherwise(k % 4).cast("long").alias("frame"), (k % 2).alias("protocol"), (k % 5).alias("registry"),
        F.when(k % 17 > 0, F.array(k % 40, k % 3)).alias("samples"), F.lit("first").alias("rule"), F.when(k % 13 > 0, F.lit(8)).alias("planned"),
    )


@_register("""WITH m AS (SELECT p_partkey k, p_partkey % 40 cell, p_partkey % 2 vw, p_partkey % 30 st FROM part),
u AS (SELECT cell, vw, min(st) < max(st) reused FROM m GROUP BY 1, 2)
SELECT k AS measurement, array_to_string(list_sort(list_filter([
CASE WHEN k % 7 = 0 THEN 'measurement_not_linked_by_state' END, CASE WHEN k % 11 = 0 THEN 'measurement_frame_mismatch' END,
CASE WHEN k % 17 = 0 OR m.cell % 9 = 8 THEN 'measurement_selection_unresolved' END,
CASE WHEN k % 17 > 0 AND m.cell % 9 < 8 AND (k % 3 <> 1 AND m.cell <> k % 3 AND m.cell <> 1 OR k % 3 = m.cell OR m.cell = 1 AND k % 3 <> 1) THEN 'measurement_selected_identity_mismatch' END,
CASE WHEN m.cell % 9 < 8 AND m.cell % 6 = 5 THEN 'selection_rule_mismatch' END, CASE WHEN k % 13 = 0 THEN 'measurement_budget_unresolved' END,
CASE WHEN reused THEN 'same_measurement_reused_as_new_state' END], lambda x: x IS NOT NULL)), ',') codes FROM m JOIN u USING (cell, vw)""")
def measurement_bindings(spark, d):
    m = _parts(spark, d)
    cells = spark.range(40).select(F.col("id").alias("cell"), (F.col("id") % 4).alias("frame"), (F.col("id") % 2).alias("protocol"), (F.col("id") % 5).alias("registry"))
    states = spark.range(30).select(F.col("id").alias("state"), F.lit("probe_output").alias("stage_role"))
    chosen = cells.where("cell % 9 < 8").select("cell", F.array("cell", F.lit(1).cast("long")).alias("samples"), F.when(F.col("cell") % 6 == 5, "last").otherwise("first").alias("rule"))
    panels = spark.createDataFrame([], "panel long, frame long, protocol long, registry long, view string, rule string, planned int, stage_role string")
    links = m.where("measurement % 7 > 0").select("state", "measurement")
    return bindings.measurement_bindings(m, cells, states, chosen, panels, links).select("measurement", F.array_join("codes", ",").alias("codes"))


def _slots(spark, d):
    """Mean event values of four panels by day and class; every sixth day is left out by design, panel 3 on day 5 by mistake."""
    e = _t(spark, d, "events").select(F.col("event_type").alias("request"), (F.col("event_id") % 20).alias("state"), (F.col("user_id") % 4).alias("panel"), "value")
    g = e.groupBy("request", "state", "panel").agg(F.sum(F.col("value").cast("decimal(20,4)")).alias("value"))
    skip = F.col("state") % 6 == 4
    slot = F.when(skip & ((F.col("state") != 10) | (F.col("panel") > 0)), "intentionally_unsampled").when((F.col("state") == 5) & (F.col("panel") == 3), "missing").otherwise("observed")
    return g.withColumn("slot", slot).withColumn("value", F.when(F.col("slot") == "observed", F.col("value").cast("double")))


_SLOTS = """g AS (SELECT event_type request, event_id % 20 st, user_id % 4 panel, CAST(sum(CAST(value AS DECIMAL(20,4))) AS DOUBLE) v FROM events GROUP BY 1, 2, 3),
s AS (SELECT request, st, panel, CASE WHEN st % 6 = 4 AND (st <> 10 OR panel > 0) THEN 'skip' WHEN st = 5 AND panel = 3 THEN 'missing' ELSE 'observed' END slot, v FROM g),
p AS (SELECT request, st, count(*) n, count(CASE WHEN slot = 'observed' THEN 1 END) have, count(CASE WHEN slot = 'skip' THEN 1 END) skipped, avg(CASE WHEN slot = 'observed' THEN v END) mean FROM s GROUP BY 1, 2),
w AS (SELECT request, count(DISTINCT panel) n_panels FROM s GROUP BY 1)"""


@_register(f"WITH {_SLOTS} SELECT request, st AS state, round(CASE WHEN have = n_panels THEN mean END, 6) AS mean, CASE WHEN have = n_panels THEN 'available' WHEN skipped = n THEN 'intentionally_unsampled' ELSE 'missing' END status FROM p JOIN w USING (request)")
def curve_points(spark, d):
    return bindings.curve_points(_slots(spark, d)).withColumn("mean", F.round("mean", 6))


@_register(f"""WITH {_SLOTS}, e AS (SELECT request, min(st) a, max(st) b FROM s GROUP BY 1)
SELECT s.request, CASE WHEN bool_or(slot = 'missing' AND s.st IN (a, b)) THEN 'expected_panel_measurement_missing' ELSE '' END endpoint,
concat_ws(',', CASE WHEN bool_or(slot = 'missing') THEN 'expected_panel_measurement_missing' END, CASE WHEN max(CASE WHEN skipped > 0 AND skipped < n THEN 1 ELSE 0 END) = 1 THEN 'incomplete_common_panel_schedule' END) regime
FROM s JOIN e ON e.request = s.request JOIN p ON p.request = s.request AND p.st = s.st GROUP BY 1""")
def curve_reasons(spark, d):
    out = bindings.curve_reasons(_slots(spark, d))
    return out.select("request", F.array_join("endpoint", ",").alias("endpoint"), F.array_join("regime", ",").alias("regime"))


@_register(f"""WITH {_SLOTS}, k AS (SELECT request, panel unit, string_agg(st::VARCHAR, ',' ORDER BY st) times, bool_or(slot = 'missing') lost FROM s WHERE slot <> 'skip' GROUP BY 1, 2),
t AS (SELECT request, count(DISTINCT times) > 1 differ FROM k GROUP BY 1),
c AS (SELECT request, bool_or(u > 1) shared FROM (SELECT event_type request, event_id // 2 call, count(DISTINCT user_id % 4) u FROM events WHERE event_type <> 'click' GROUP BY 1, 2) GROUP BY 1)
SELECT request, unit, times, concat_ws(',', CASE WHEN differ THEN 'root_sensitivity_time_grid_mismatch' END, CASE WHEN lost THEN 'sensitivity_value_unavailable' END, CASE WHEN shared THEN 'shared_panel_call_dependency' END) reasons FROM k JOIN t USING (request) LEFT JOIN c USING (request)""")
def sensitivity_units(spark, d):
    curves = _slots(spark, d).select("request", F.col("panel").alias("unit"), F.col("state").alias("time"), "value", "slot")
    calls = _t(spark, d, "events").where("event_type <> 'click'").select(F.col("event_type").alias("request"), (F.col("user_id") % 4).alias("unit"), F.expr("event_id div 2").alias("call"))
    out = bindings.sensitivity_units(curves, calls)
    return out.select("request", "unit", F.array_join(F.transform("times", lambda t: t.cast("string")), ",").alias("times"), F.array_join("reasons", ",").alias("reasons"))


@_register("""WITH r AS (SELECT c_custkey episode, unnest(['non_injection', 'external_validation', 'expression']) AS role, unnest([0, 1, 2]) i FROM customer),
a AS (SELECT o_custkey episode, o_orderkey % 3 i, o_orderkey k FROM orders),
x AS (SELECT r.episode, r.role, count(k) n, bool_or(k % 19 = 0) changed, bool_or(k % 23 = 0) bad, count(DISTINCT k % 23 = 0) kinds, bool_or(k % 29 = 0) said, bool_or(k % 31 = 0) bare, bool_or(k % 37 = 0) alone FROM r LEFT JOIN a ON a.episode = r.episode AND a.i = r.i GROUP BY 1, 2)
SELECT episode, role, CASE WHEN n > 0 AND NOT (changed OR bad OR said OR bare OR alone) THEN 'eligible' ELSE 'unavailable' END gate, array_to_string(list_sort(list_filter([
CASE WHEN n = 0 THEN role || '_evidence_missing' END, CASE WHEN changed THEN role || '_reviewed_subject_changed' END, CASE WHEN bad THEN role || '_assessment_unsupported' END, CASE WHEN kinds > 1 THEN role || '_assessment_conflict' END,
CASE WHEN said THEN role || '_assertion_mismatch' END, CASE WHEN bare THEN role || '_method_or_detail_missing' END, CASE WHEN alone THEN role || '_reviewer_missing' END], lambda z: z IS NOT NULL)), ',') reasons FROM x""")
def recovery_gates(spark, d):
    # The bits of a key turned over are no key's own, be it 0: a subject that changed differs from every customer's.
    k = F.col("o_orderkey")
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (k % 3).cast("int"))
    rows = _t(spark, d, "orders").select(
        F.col("o_custkey").alias("episode"), pick(bindings.ASSERTIONS).alias("role"), F.when(k % 23 == 0, "not_supported").otherwise("supported").alias("outcome"), F.when(k % 19 == 0, F.bitwise_not("o_custkey")).otherwise(F.col("o_custkey")).alias("subject"),
        F.when(k % 29 == 0, "else").otherwise(pick(bindings.ASSERTIONS.values())).alias("assertion"), pick(bindings.PURPOSES.values()).alias("purpose"), F.lit("review").alias("method"), F.when(k % 31 > 0, "seen").alias("detail"), F.array(F.lit("a")).alias("artifacts"), F.when(k % 37 > 0, F.array(F.lit("r"))).alias("reviewers"),
    )
    out = bindings.scoped_gates(_t(spark, d, "customer").select(F.col("c_custkey").alias("episode"), F.col("c_custkey").alias("subject")), rows)
    return out.withColumn("reasons", F.array_join("reasons", ","))


@_register("""WITH r AS (SELECT o_orderkey AS revision, l_linenumber i, l_suppkey j, l_linenumber IS NOT NULL AND l_suppkey % 9 > 0 AS read, l_linenumber IS NOT NULL AS has FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity < 30) ON l_orderkey = o_orderkey)
SELECT revision, coalesce(string_agg(CASE WHEN has THEN read::VARCHAR END, ',' ORDER BY i, j), '') available, CASE WHEN NOT bool_or(has) THEN 'revision_original_material_missing' WHEN bool_or(has AND NOT read) THEN 'revision_original_material_unavailable' ELSE '' END reasons FROM r GROUP BY 1""")
def revision_ledger(spark, d):
    lines = _t(spark, d, "lineitem").where("l_quantity < 30").select("l_orderkey", F.struct("l_linenumber", "l_suppkey").alias("a"))
    held = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("a")).alias("o")).select(F.col("l_orderkey").alias("revision"), F.transform("o", lambda a: a["l_suppkey"] * 100 + a["l_linenumber"]).alias("originals"))
    orders = _t(spark, d, "orders").select(F.col("o_orderkey").alias("revision")).join(held, "revision", "left")
    artifacts = lines.select((F.col("a.l_suppkey") * 100 + F.col("a.l_linenumber")).alias("artifact"), F.when(F.col("a.l_suppkey") % 9 > 0, "snapshot_read").otherwise("hash_mismatch").alias("status")).distinct()
    out = bindings.revision_ledger(orders, artifacts)
    return out.select("revision", F.array_join(F.transform("available", lambda a: a.cast("string")), ",").alias("available"), F.array_join("reasons", ",").alias("reasons"))


@_register("SELECT o_orderkey AS trial, coalesce(bool_or(l_suppkey % 4 > 0) AND bool_or(l_returnflag = 'N') AND o_orderkey % 8 > 0, false) determinate FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 GROUP BY o_orderkey")
def determinate_failures(spark, d):
    first = _t(spark, d, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_suppkey", "l_returnflag")
    trials = _t(spark, d, "orders").select(F.col("o_orderkey").alias("trial"), F.col("o_orderkey").alias("attempt"), F.lit("a").alias("assay"), F.lit("class_seen").alias("event"))
    attempts = first.select(F.col("l_orderkey").alias("attempt"), F.col("l_suppkey").alias("artifact"))
    artifacts = first.select(F.col("l_suppkey").alias("artifact"), F.when(F.col("l_suppkey") % 4 > 0, "snapshot_read").otherwise("missing").alias("status")).distinct()
    said = first.select(F.col("l_orderkey").alias("trial"), F.col("l_orderkey").alias("attempt"), F.lit("a").alias("assay"), F.lit("class_seen").alias("event"), F.lit("observation").alias("purpose"), (F.col("l_returnflag") == "N").alias("assertion"), (F.col("l_orderkey") % 8 > 0).alias("sound"))
    return bindings.determinate_failures(trials, attempts, artifacts, said)


@_register("SELECT l_orderkey AS call, l_linenumber AS line, CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN 'not_applicable' WHEN coalesce(l_tax <> 0.04, false) OR coalesce(l_returnflag <> 'A' AND l_discount <> 0.04, false) THEN 'inconsistent' WHEN l_returnflag <> 'A' AND l_linestatus = 'F' THEN 'record_consistent' ELSE 'unresolved' END fact FROM lineitem")
def control_facts(spark, d):
    rows = _t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("call"), F.col("l_linenumber").alias("line"), F.when(F.col("l_linenumber") == 7, "presence_penalty").otherwise("temperature").alias("name"), F.lit(0.04).alias("expected"), F.col("l_tax").alias("requested"), F.when(F.col("l_returnflag") != "A", F.col("l_discount")).alias("actual"),
        F.lit(False).alias("exposed"), F.when((F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "R"), "unsupported").otherwise("recorded").alias("enforcement"), (F.col("l_linestatus") == "F").alias("supported"),
    )
    return bindings.control_facts(rows).select("call", "line", "fact")


@_register("SELECT coalesce(o.k, l.k) order_id, CASE WHEN o.k IS NULL THEN 'not_staged' WHEN l.k IS NULL THEN 'not_produced' ELSE 'value_mismatch' END difference FROM (SELECT o_orderkey k, CAST(o_orderkey % 5 AS DECIMAL(38,9)) v FROM orders WHERE o_orderkey % 7 > 0) o FULL JOIN (SELECT l_orderkey k, CAST(max(l_linenumber) AS DECIMAL(38,9)) v FROM lineitem GROUP BY 1) l ON l.k = o.k WHERE o.k IS NULL OR l.k IS NULL OR o.v <> l.v")
def carrier_differences(spark, d):
    staged = _t(spark, d, "orders").where("o_orderkey % 7 > 0").select(F.col("o_orderkey").alias("order_id"), (F.col("o_orderkey") % 5).alias("v"))
    made = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.max("l_linenumber").alias("v"))
    return bindings.carrier_differences(staged, made, ["order_id"], "v")


@_register("""WITH v AS (SELECT user_id cell, count(DISTINCT event_type) v FROM events GROUP BY 1), o AS (SELECT cell, CASE WHEN cell % 7 > 0 AND cell % 5 > 0 THEN v END v, concat_ws(',', CASE WHEN cell % 7 = 0 THEN 'expected_cell_unavailable' END, CASE WHEN cell % 7 > 0 AND cell % 5 = 0 THEN 'operand_value_absent' END) why FROM v)
SELECT a.cell pair, CAST(CASE WHEN a.cell % 9 > 0 THEN a.v - b.v END AS DOUBLE) difference, CASE WHEN a.cell % 9 = 0 THEN 'comparison_incompatible' WHEN a.why <> '' AND b.why <> '' AND a.why <> b.why THEN 'expected_cell_unavailable,operand_value_absent' ELSE CASE WHEN a.why <> '' THEN a.why ELSE b.why END END reasons FROM o a JOIN o b ON b.cell = a.cell + 1""")
def operand_contrasts(spark, d):
    v = _t(spark, d, "events").groupBy(F.col("user_id").alias("cell")).agg(F.count_distinct("event_type").alias("n"))
    values = v.select("cell", F.lit("classified_all").alias("view"), F.lit("support").alias("metric"), F.lit(None).cast("int").alias("k"), F.when(F.col("cell") % 5 > 0, F.col("n")).alias("value"))
    cells = v.where("cell % 7 > 0").select("cell", F.lit("classified_all").alias("view"), F.array("cell").alias("ids"), F.array(F.lit("label:1")).alias("pins"))
    pairs = v.select(F.col("cell").alias("pair"), F.col("cell").alias("left"), (F.col("cell") + 1).alias("right"), (F.col("cell") % 9 > 0).alias("compatible"))
    out = bindings.contrasts(pairs, bindings.operands(values, cells))
    return out.select("pair", F.col("difference").cast("double").alias("difference"), F.array_join("reasons", ",").alias("reasons"))


@_register("""WITH g AS (SELECT unnest(['registration', 'exposure', 'independence']) AS "group"), o AS (SELECT n_nationkey comparison, "group" FROM nation, g),
s AS (SELECT c_nationkey comparison, (['registration', 'exposure', 'independence', 'other'])[c_custkey % 4 + 1] AS "group", c_custkey k FROM customer WHERE c_custkey % 5 = 0),
r AS (SELECT s.* FROM o JOIN s USING (comparison, "group") WHERE "group" = 'registration')
SELECT o.comparison, 'evidence_' || o."group" AS name, CASE WHEN s.k IS NOT NULL AND s.k % 3 > 0 THEN 'record_consistent' ELSE 'unresolved' END status FROM o LEFT JOIN s USING (comparison, "group")
UNION SELECT comparison, 'registration_binding', CASE WHEN k % 25 = comparison THEN 'record_consistent' ELSE 'inconsistent' END FROM r
UNION SELECT comparison, 'registration_before_first_inspected', CASE WHEN k % 7 = 0 THEN 'unresolved' WHEN k % 11 < k % 13 THEN 'record_consistent' ELSE 'inconsistent' END FROM r
UNION SELECT comparison, 'registration_before_first_collected', CASE WHEN k % 11 < k % 17 THEN 'record_consistent' ELSE 'inconsistent' END FROM r""")
def evidence_facts(spark, d):
    k = F.col("c_custkey")
    group = F.get(F.array(*map(F.lit, ["registration", "exposure", "independence", "other"])), (k % 4).cast("int"))
    rows = _t(spark, d, "customer").where("c_custkey % 5 = 0").select(F.col("c_nationkey").alias("comparison"), group.alias("group"), (k % 3 > 0).alias("sound"), (k % 25).alias("digest"), (k % 11).alias("registered"), F.when(k % 7 > 0, k % 13).alias("inspected"), (k % 17).alias("collected"))
    own = _t(spark, d, "nation").select(F.col("n_nationkey").alias("comparison"), F.col("n_nationkey").alias("digest"))
    return bindings.evidence_facts(own, rows, ["registration", "exposure", "independence"])


@_register("""WITH p AS (SELECT l_orderkey k, l_linenumber::VARCHAR q, l_returnflag <> 'A' must, CASE WHEN l_returnflag = 'R' AND l_suppkey % 10 = 0 THEN 'not_applicable' WHEN l_linestatus = 'O' THEN 'satisfied_for_scope' ELSE 'unresolved' END r FROM lineitem),
a AS (SELECT k, string_agg(DISTINCT CASE WHEN must AND r <> 'satisfied_for_scope' THEN q END, ',' ORDER BY CASE WHEN must AND r <> 'satisfied_for_scope' THEN q END) due, count(*) > count(DISTINCT q) twice, bool_or(must AND r = 'not_applicable') void FROM p GROUP BY 1)
SELECT o_orderkey activity, coalesce(due, '') outstanding, concat_ws(',', CASE WHEN twice THEN 'duplicate_value' END, CASE WHEN void THEN 'mandatory_requirement_not_applicable' END, CASE WHEN coalesce(due, '') <> CASE WHEN o_orderkey % 3 = 0 THEN '1' ELSE '' END THEN 'outstanding_requirements_contradiction' END, CASE WHEN o_orderstatus = 'F' AND due IS NOT NULL THEN 'ready_with_outstanding_requirements' END) problems FROM orders LEFT JOIN a ON k = o_orderkey""")
def readiness_problems(spark, d):
    outcome = F.when((F.col("l_returnflag") == "R") & (F.col("l_suppkey") % 10 == 0), "not_applicable").when(F.col("l_linestatus") == "O", "satisfied_for_scope").otherwise("unresolved")
    rows = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("activity"), F.col("l_linenumber").cast("string").alias("requirement"), (F.col("l_returnflag") != "A").alias("mandatory"), outcome.alias("outcome"))
    own = _t(spark, d, "orders").select(F.col("o_orderkey").alias("activity"), F.when(F.col("o_orderstatus") == "F", "ready").otherwise("not_ready").alias("state"), F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("1"))).alias("outstanding"))
    out = bindings.readiness_problems(own, rows)
    return out.select("activity", F.array_join("outstanding", ",").alias("outstanding"), F.array_join("problems", ",").alias("problems"))


@_register("""WITH r AS (SELECT o_orderkey k, o_custkey art, o_custkey % 10 + CASE WHEN o_orderkey % 41 = 0 THEN 1 ELSE 0 END sha, o_custkey % 3 AS who, o_orderkey % 5 > 0 assigned, o_orderkey % 10 > 0 has_class, CASE WHEN o_orderkey % 4 = 0 THEN 'revision' ELSE 'initial' END stage, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 28 > 0 THEN o_orderkey + 1 END ini FROM orders)
SELECT r.k AS review, concat_ws(',', CASE WHEN r.sha <> r.art % 10 THEN 'artifact_hash_mismatch' END, CASE WHEN r.assigned <> r.has_class THEN 'assignment_contradiction' END,
CASE WHEN f.k IS NOT NULL AND (f.stage <> 'initial' OR f.art <> r.art OR f.sha <> r.sha OR f.who <> r.who) THEN 'initial_submission_contradiction' END, CASE WHEN r.ini IS NOT NULL AND f.k IS NULL THEN 'initial_submission_unresolved' END, CASE WHEN (r.stage = 'revision') <> (r.ini IS NOT NULL) THEN 'submission_stage_contradiction' END) problems FROM r LEFT JOIN r f ON f.k = r.ini""")
def review_problems(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = _t(spark, d, "orders").select(
        k.alias("review"), c.alias("artifact"), (c % 10 + F.when(k % 41 == 0, 1).otherwise(0)).alias("sha256"), (c % 3).alias("reviewer"), F.when(k % 5 > 0, "assigned").otherwise("withheld").alias("assignment"), F.when(k % 10 > 0, F.lit("x")).alias("class"),
        F.when(k % 4 == 0, "revision").otherwise("initial").alias("stage"), F.when((k % 4 == 0) & (k % 28 > 0), k + 1).alias("initial"),
    )
    out = bindings.review_problems(rows, _t(spark, d, "customer").select(F.col("c_custkey").alias("artifact"), (F.col("c_custkey") % 10).alias("sha256")))
    return out.select("review", F.array_join("problems", ",").alias("problems"))
