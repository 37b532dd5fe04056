"""Registered queries over nested records, lineages, corrections and exact resampling, with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from prismet.operators import admission, compare, fingerprints, incremental, lineage, metrics, resampling, shapes
from prismet.plans.queries import _INDICES, _register, _t
from prismet.session import shared_place


def _reference(kind, key):
    return F.struct(F.lit(kind).alias("record_type"), key.cast("string").alias("record_id"), F.lit("0.1").alias("record_version"))


def _order_records(spark, d):
    """Orders as nested records: their customer, and of each line the part and, unless it is new, the supplier under its state of knowledge."""
    c = F.col
    line = _t(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", F.coalesce(c("l_returnflag") == "N", F.lit(False)).alias("new"), "l_suppkey").alias("line"))
    ordered = F.array_sort(F.transform(F.collect_list("line"), lambda x: F.struct(x["l_linenumber"].alias("l_linenumber"), x["l_partkey"].cast("string").alias("l_partkey"), x["new"].alias("new"), F.when(~x["new"], x["l_suppkey"].cast("string")).alias("l_suppkey"))))
    known = lambda x: F.struct(F.when(x["new"], "unknown").otherwise("known").alias("state"), F.when(~x["new"], _reference("supplier", x["l_suppkey"])).alias("value"))
    items = line.groupBy("l_orderkey").agg(F.transform(ordered, lambda x: F.struct(x["l_linenumber"].alias("l_linenumber"), _reference("part", x["l_partkey"]).alias("part"), known(x).alias("supplier"))).alias("items"))
    orders = _t(spark, d, "orders").join(items, F.col("l_orderkey") == F.col("o_orderkey"))
    record = F.struct(F.struct(_reference("customer", F.col("o_custkey")).alias("customer")).alias("links"), "items")
    return orders.select(F.col("o_orderkey").alias("record"), F.to_variant_object(record).alias("v"))


@_register("""WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR), l_returnflag = 'N', CAST(l_suppkey AS VARCHAR)) - 1 k FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT DISTINCT o_orderkey AS record, '$.links.customer' AS path, 'customer' target_type, CAST(o_custkey AS VARCHAR) target_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey
UNION ALL SELECT l_orderkey, '$.items[' || k || '].part', 'part', CAST(l_partkey AS VARCHAR) FROM l UNION ALL SELECT l_orderkey, '$.items[' || k || '].supplier.value', 'supplier', CAST(l_suppkey AS VARCHAR) FROM l WHERE l_returnflag <> 'N'""")
def reference_walk(spark, d):
    """References of nested orders at whatever depth they stand, by their paths [X15]."""
    return shapes.deep_references(_order_records(spark, d), ["record"]).select("record", "path", "target_type", "target_id")


def _turn_records(spark, d):
    """Turns as records that were written with less and less care."""
    t, text = F.col("turn"), F.col("text")
    said = F.when(F.col("role") == "system", F.to_json(F.struct(F.lit("unavailable").alias("state")))).when(text.endswith("."), F.to_json(F.struct(F.lit("known").alias("state"), text.alias("value")))).otherwise(F.to_json(F.struct(F.lit("unknown").alias("state"), text.alias("value"))))
    key = lambda n: F.concat_ws(":", F.col("conv_id").cast("string"), n.cast("string"))
    version = F.when(F.col("role") == "assistant", F.lit("0.1")).otherwise(F.lit('"0.1"'))
    earlier = F.when(t > 0, F.concat(F.lit(',"previous":{"record_type":"turn","record_id":"'), key(t - 1), F.lit('","record_version":'), version, F.lit("}"))).otherwise(F.lit(""))
    more = F.when((t >= 4) & (F.col("role") == "user"), F.lit(',"note":[]')).otherwise(F.lit(""))
    line = F.concat(F.lit('{"turn":'), t.cast("string"), F.lit(',"role":'), F.expr("substring(to_json(struct(role)), 9, length(to_json(struct(role))) - 9)"), F.lit(',"said":'), said, earlier, more, F.lit("}"))
    return _t(spark, d, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL AND text IS NOT NULL").select(F.lit("turn").alias("record_type"), key(t).alias("record_id"), F.parse_json(line).alias("v"))


@_register("""WITH c AS (SELECT conv_id || ':' || turn id, * FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL AND text IS NOT NULL)
SELECT id AS record, '$.turn' AS path, 'invalid_field' AS code FROM c WHERE turn < 1 UNION ALL SELECT id, '$.role', 'invalid_field' FROM c WHERE role NOT IN ('user', 'assistant')
UNION ALL SELECT id, '$.said', CASE WHEN role = 'system' THEN 'missing_knowledge_reason' WHEN NOT ends_with(text, '.') THEN 'value_in_unknown_state' ELSE 'invalid_field' END FROM c WHERE role = 'system' OR NOT ends_with(text, '.') OR trim(text) = ''
UNION ALL SELECT id, '$.previous', CASE WHEN turn <= 0 THEN 'missing_required_field' ELSE 'unsupported_reference_version' END FROM c WHERE turn <= 0 OR role = 'assistant' UNION ALL SELECT id, '$.note', 'unknown_record_field' FROM c WHERE turn >= 4 AND role = 'user'""")
def shape_defects(spark, d):
    """Defects of the shapes of records, one row each with the path of the field [S7, S8]."""
    rows = [("turn", "$", f, required, form, known, values, "invalid_field") for f, required, form, known, values in (("turn", True, "positive", False, []), ("role", True, "enum", False, ["user", "assistant"]), ("said", True, "text", True, []), ("previous", True, "ref", False, []))]
    out = shapes.shape_problems(_turn_records(spark, d), shapes.shape_table(spark, rows), types=["turn"])
    return out.select(F.col("record_id").alias("record"), "path", "code")


def _named(kind, *keys):
    return F.concat_ws(":", F.lit(kind), *[k.cast("string") for k in keys])


def _chain(spark, d):
    """Edges from each row to those that name it: regions, nations, customers and suppliers, parts, orders, line items."""
    c, line = F.col, _t(spark, d, "lineitem")
    item = _named("line", c("l_orderkey"), c("l_linenumber"))
    edge = lambda df, src, dst: df.select(src.alias("src"), dst.alias("dst"))
    out = edge(_t(spark, d, "nation"), _named("region", c("n_regionkey")), _named("nation", c("n_nationkey")))
    out = out.union(edge(_t(spark, d, "customer"), _named("nation", c("c_nationkey")), _named("customer", c("c_custkey")))).union(edge(_t(spark, d, "supplier"), _named("nation", c("s_nationkey")), _named("supplier", c("s_suppkey"))))
    out = out.union(edge(_t(spark, d, "orders"), _named("customer", c("o_custkey")), _named("order", c("o_orderkey"))))
    return out.union(edge(line, _named("order", c("l_orderkey")), item)).union(edge(line, _named("supplier", c("l_suppkey")), item)).union(edge(line, _named("part", c("l_partkey")), item))


_CHAIN = """e AS (SELECT DISTINCT * FROM (SELECT 'region:' || n_regionkey src, 'nation:' || n_nationkey dst FROM nation UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier
UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders UNION ALL SELECT 'order:' || l_orderkey, 'line:' || l_orderkey || ':' || l_linenumber FROM lineitem UNION ALL SELECT 'supplier:' || l_suppkey, 'line:' || l_orderkey || ':' || l_linenumber FROM lineitem UNION ALL SELECT 'part:' || l_partkey, 'line:' || l_orderkey || ':' || l_linenumber FROM lineitem))"""


@_register(f"WITH RECURSIVE {_CHAIN}, w AS (SELECT DISTINCT src node, 0 lvl FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT e.dst, lvl + 1 FROM w JOIN e ON e.src = w.node) SELECT node, CAST(max(lvl) AS INTEGER) AS level FROM w GROUP BY 1")
def lineage_levels(spark, d):
    """The longest way to each row from one that names no other [G5]."""
    return lineage.levels(None, _chain(spark, d))


@_register(f"WITH RECURSIVE {_CHAIN}, w AS (SELECT 'customer:' || c_custkey node FROM customer WHERE c_acctbal < 0 UNION SELECT 'order:' || o_orderkey FROM orders WHERE o_orderstatus = 'P' UNION SELECT e.dst FROM w JOIN e ON e.src = w.node) SELECT split_part(node, ':', 1) kind, count(*) n FROM w GROUP BY 1")
def carried_faults(spark, d):
    """Rows behind a customer in debt or a pending order, by kind [G5]."""
    faults = _t(spark, d, "customer").where("c_acctbal < 0").select(_named("customer", F.col("c_custkey")).alias("node")).union(_t(spark, d, "orders").where("o_orderstatus = 'P'").select(_named("order", F.col("o_orderkey"))))
    return lineage.carried(faults, _chain(spark, d)).groupBy(F.split("node", ":")[0].alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_PATHS = """o AS (SELECT *, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) dy, row_number() OVER w - 1 place, lag(o_orderkey) OVER w prev, date_diff('day', lag(CAST(o_orderdate AS DATE)) OVER w, CAST(o_orderdate AS DATE)) gap, first_value(o_orderkey) OVER w head FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
s AS (SELECT o_custkey, o_orderstatus <> 'P' sound, CASE WHEN o_totalprice > 300000 THEN head ELSE prev END <> prev astray, CASE WHEN o_orderpriority <> '5-LOW' THEN gap END dist FROM o WHERE place > 0),
g AS (SELECT o_custkey, bool_or(NOT sound) open, bool_or(sound AND astray) astray, bool_or(sound AND dist IS NULL) unknown, coalesce(sum(CASE WHEN sound THEN dist END), 0) total FROM s GROUP BY 1)"""


@_register(f"""WITH {_PATHS}, f AS (SELECT o_custkey, n, first(CASE WHEN place = 0 AND o_orderpriority <> '1-URGENT' THEN dy END ORDER BY place) a, last(CASE WHEN o_orderpriority <> '1-URGENT' THEN dy END ORDER BY place) z FROM o JOIN (SELECT o_custkey, count(*) n FROM o GROUP BY 1) USING (o_custkey) GROUP BY 1, 2),
r AS (SELECT f.*, list_filter([CASE WHEN unknown OR a IS NULL OR z IS NULL THEN 'recursive_distance_unresolved' END, CASE WHEN open THEN 'transition_history_unresolved' END, CASE WHEN astray THEN 'selected_branch_mismatch' END, CASE WHEN z - a <> total THEN 'recursive_distance_mismatch' END], lambda x: x IS NOT NULL) why FROM f LEFT JOIN g USING (o_custkey))
SELECT o_custkey AS request, CASE WHEN n > 1 AND len(why) = 0 THEN z - a END AS rounds, CASE WHEN n > 1 THEN array_to_string(list_sort(why), ',') ELSE 'selected_path_order_mismatch' END AS reasons FROM r""")
def path_elapsed(spark, d):
    """Days between each customer's first and last order, where every step of the path bears them out [W10, G6]."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = _t(spark, d, "orders").select(
        F.col("o_custkey").alias("trajectory"), (F.row_number().over(w) - 1).alias("place"), F.col("o_orderkey").alias("state"), F.when(F.col("o_orderpriority") != "1-URGENT", F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01"))).alias("coordinate"), F.lag("o_orderkey").over(w).alias("prev"),
        F.datediff(F.to_date("o_orderdate"), F.to_date(F.lag("o_orderdate").over(w))).alias("gap"), F.first("o_orderkey").over(w).alias("head"), "o_orderstatus", "o_orderpriority", "o_totalprice",
    )
    made = o.where("place > 0")
    steps = made.select("trajectory", (F.col("place") - 1).alias("place"), F.col("state").alias("transition"))
    transitions = made.select(F.col("state").alias("transition"), F.col("state").alias("child"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("gap")).alias("distance"), (F.col("o_orderstatus") != "P").alias("sound"))
    parents = made.select(F.col("state").alias("transition"), F.when(F.col("o_totalprice") > 300000, F.col("head")).otherwise(F.col("prev")).alias("parent"))
    asked = o.groupBy("trajectory").agg(F.min_by("state", "place").alias("start"), F.max_by("state", "place").alias("end")).withColumn("request", F.col("trajectory"))
    out = lineage.elapsed(o.select("trajectory", "place", "state", "coordinate"), steps, transitions, parents, asked)
    return out.select("request", F.col("rounds").cast("long").alias("rounds"), F.array_join("reasons", ",").alias("reasons"))


@_register("WITH c AS (SELECT user_id cell, event_type cls, count(*) n FROM events WHERE event_type IS NOT NULL AND event_id % 500 <> 0 GROUP BY 1, 2) SELECT cell, CAST(sum(n) AS BIGINT) population, count(*) support, CAST(sum(n * n) AS BIGINT) sci_num FROM c GROUP BY 1")
def incremental_recount(spark, d):
    """Results by user, stored, then every 500th event withdrawn: only the users that it reaches are computed again [G4]."""
    events = _t(spark, d, "events").select(F.col("user_id").alias("cell"), F.col("event_type").alias("class"), "event_id")

    def results(rows):
        return metrics.distribution(metrics.class_counts(rows)).select("cell", "population", F.col("support").cast("long").alias("support"), "sci_num")

    store = incremental.CellStore(spark, shared_place(spark, "store"))
    store.write(results(events))
    withdrawn = events.where("event_id % 500 = 0")
    store.apply(withdrawn.select("cell").where("cell IS NOT NULL"), lambda cells: results(events.where("event_id % 500 <> 0").join(cells, "cell", "left_semi")))
    return store.read()


@_register(f"""WITH q AS (SELECT o_orderpriority g, c_mktsegment block, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) num, count(*) den FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
l AS (SELECT g, list_reduce(list(den::HUGEINT), lambda a, b: lcm(a, b)) c FROM q GROUP BY 1), b AS (SELECT q.g, row_number() OVER (PARTITION BY q.g ORDER BY block) - 1 u, num * (c // den) s, c FROM q JOIN l USING (g)),
m AS (SELECT g, c, r, sum(s) v FROM b JOIN (VALUES {_INDICES}) i(r, k) ON i.k = b.u GROUP BY 1, 2, 3), k AS (SELECT g, c, v, row_number() OVER (PARTITION BY g ORDER BY v) - 1 p FROM m)
SELECT g AS priority, '1/40' AS share, CAST(sum(CASE WHEN p = 49 THEN v * 1 WHEN p = 50 THEN v * 39 END) AS VARCHAR) num, CAST(max(c) * 200 AS VARCHAR) den FROM k WHERE p IN (49, 50) GROUP BY 1
UNION ALL SELECT g, '39/40', CAST(sum(CASE WHEN p = 1949 THEN v * 39 WHEN p = 1950 THEN v * 1 END) AS VARCHAR), CAST(max(c) * 200 AS VARCHAR) FROM k WHERE p IN (1949, 1950) GROUP BY 1""")
def exact_interval(spark, d):
    """Percentiles of exact means of each priority's share of filled orders over five resampled segments [A16, A17, X6]."""
    o = _t(spark, d, "orders").join(_t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    shares = o.groupBy(F.col("o_orderpriority").alias("priority"), "c_mktsegment").agg(F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("num"), F.count(F.lit(1)).alias("den"))
    units = shares.withColumn("unit", F.row_number().over(Window.partitionBy("priority").orderBy("c_mktsegment")) - 1)
    means = resampling.exact_means(units, compare.index_table(spark, 5), ["priority"], 5)
    out = resampling.exact_percentiles(means, ["priority"], [(1, 40), (39, 40)], compare.REPLICATES)
    return out.select("priority", "share", F.col("num").cast("string").alias("num"), F.col("den").cast("string").alias("den"))


@_register("""WITH h AS (SELECT o_orderpriority v, sha256(strlen(o_orderkey::VARCHAR) || ':' || o_orderkey || strlen(o_custkey::VARCHAR) || ':' || o_custkey || strlen(o_orderstatus) || ':' || o_orderstatus) h, count(*) n FROM orders GROUP BY 1, 2),
d AS (SELECT v, greatest(0, ceil(ln(count(*) / 64.0) / ln(16.0)))::INTEGER deep FROM h GROUP BY 1), l AS (SELECT v, deep, substr(h, 1, deep) p, sha256(string_agg(h || ':' || n, ',' ORDER BY h || ':' || n)) g, sum(n) k FROM h JOIN d USING (v) GROUP BY 1, 2, 3),
m AS (SELECT * FROM l WHERE length(p) < 2 UNION ALL SELECT v, deep, substr(p, 1, 1), sha256(string_agg(g, ',' ORDER BY p)), sum(k) FROM l WHERE length(p) = 2 GROUP BY 1, 2, 3),
r AS (SELECT v, p, g, k FROM m WHERE length(p) = 0 UNION ALL SELECT v, '', sha256(string_agg(g, ',' ORDER BY p)), sum(k) FROM m WHERE length(p) = 1 GROUP BY 1)
SELECT v AS "view", g AS fingerprint, CAST(k AS BIGINT) AS rows FROM r""")
def view_fingerprints(spark, d):
    """One digest for the orders of each priority, whatever their order [V7]."""
    rows = _t(spark, d, "orders").select(F.col("o_orderpriority").alias("view"), "o_orderkey", "o_custkey", "o_orderstatus")
    return fingerprints.fingerprints(rows, ["view"], ["o_orderkey", "o_custkey", "o_orderstatus"], node=64)


@_register("""WITH d AS (SELECT doc_id, text, n_chars // 2 + CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS stop, lang = 'de' AS bare FROM documents),
x AS (SELECT *, strlen(text) n, hex(encode(left(text, CAST(floor(length(text) / 2) AS BIGINT)))) o, substr(hex(encode(text)), 1, CAST(2 * stop AS BIGINT)) h FROM d)
SELECT doc_id AS sample, CASE WHEN bare THEN 'not_supplied' WHEN stop IS NULL OR text IS NULL THEN 'unavailable' WHEN stop <= n AND h = o THEN 'bytes_match' ELSE 'mismatch' END span,
CASE WHEN bare THEN NULL WHEN stop IS NULL THEN 'invalid_extraction_span' WHEN text IS NOT NULL AND NOT (stop <= n AND h = o) THEN 'extraction_span_mismatch' END defect FROM x""")
def extraction_spans(spark, d):
    """Halves of documents as outputs, and the bytes of the documents that they are said to be [J5]; German ones say nothing."""
    docs = _t(spark, d, "documents").select("doc_id", "text", "lang", "n_chars")
    key = lambda kind: F.concat_ws(":", F.lit(kind), F.col("doc_id").cast("string"))
    half = F.left("text", F.floor(F.length("text") / 2).cast("int"))
    contents = docs.select(key("raw").alias("key"), F.col("text").cast("binary").alias("content")).union(docs.select(key("output"), half.cast("binary")))
    stop = F.floor(F.col("n_chars") / 2).cast("long") + F.when(F.col("lang") == "en", 0).otherwise(1)
    spans = docs.select(F.col("doc_id").alias("sample_id"), key("raw").alias("raw"), key("output").alias("output"), (~F.col("lang").eqNullSafe(F.lit("de"))).alias("supplied"), F.when(F.col("n_chars").isNotNull(), F.lit(0).cast("long")).alias("byte_start"), stop.alias("byte_end"))
    return admission.extraction_spans(spans, contents).select(F.col("sample_id").alias("sample"), "span", "defect")
