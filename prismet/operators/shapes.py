"""Nested records as VARIANT: every node with its path, references at any depth, and the shape of each field [X15, S7, S8].

A record's shape is a table, one row for each field, so that records of all types are checked in one pass and a bad field
is a row with its path and code, not an end. Nothing is parsed into fixed columns; what no shape names is reported too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismet.functions.status import is_hash, is_id
from prismet.session import written

VERSION = "0.1"
KNOWLEDGE = ["known", "unknown", "unavailable", "not_applicable"]
_REF_KEYS = ["record_id", "record_type", "record_version"]
_FIELDS = "map<string,variant>"
_ITEMS = "array<variant>"


def kind(v: Column) -> Column:
    """object, array, string, integer, number, boolean or null of a VARIANT; null where there is no value at all."""
    s = F.schema_of_variant(v)
    return (
        F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null")
        .when((s == "BIGINT") | s.rlike(r"^DECIMAL\((19|[23][0-9]),0\)$"), "integer").when(s.isNotNull(), "number")
    )


def fields(v: Column) -> Column:
    return F.try_variant_get(v, "$", _FIELDS)


def items(v: Column) -> Column:
    return F.try_variant_get(v, "$", _ITEMS)


def string(v: Column) -> Column:
    """A VARIANT's string, null for any other kind: numbers are not read as text."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def is_reference(v: Column) -> Column:
    return F.coalesce(F.array_sort(F.map_keys(fields(v))) == F.array(*map(F.lit, _REF_KEYS)), F.lit(False))


def reference_problem(v: Column, types: list[str]) -> Column:
    """Why a VARIANT is no reference to a record of one of the types, or null."""
    f = fields(v)
    part = lambda name: string(F.try_element_at(f, F.lit(name)))
    known = F.coalesce(part("record_type").isin(*types), F.lit(False)) & is_id(part("record_id"))
    return F.when(~is_reference(v) | ~known, "invalid_reference").when(~part("record_version").eqNullSafe(F.lit(VERSION)), "unsupported_reference_version")


def _first(values: Column, problem) -> Column:
    """The first problem of the items of an array."""
    return F.get(F.filter(F.transform(values, problem), lambda p: p.isNotNull()), 0)


def knowledge_problem(v: Column, types: list[str]) -> Column:
    """Why a VARIANT is no value with its state of knowledge, or null."""
    f = fields(v)
    part = lambda name: F.try_element_at(f, F.lit(name))
    state, reason = string(part("state")), part("reason")
    stated = reason.isNotNull() & (kind(reason) != "null")
    blank = F.coalesce(F.trim(string(reason)), F.lit("")) == ""
    value = part("value")
    refs = part("evidence_refs")
    return (
        F.when(f.isNull() | (F.size(F.array_except(F.map_keys(f), F.array(*map(F.lit, ("state", "value", "reason", "evidence_refs"))))) > 0), "invalid_knowledge")
        .when(~F.coalesce(state.isin(*KNOWLEDGE), F.lit(False)), "invalid_knowledge_state")
        .when(stated & blank, "invalid_knowledge_reason")
        .when(state.isin("unavailable", "not_applicable") & ~stated, "missing_knowledge_reason")
        .when((state == "known") & ~F.array_contains(F.map_keys(f), "value"), "missing_known_value")
        .when((state != "known") & value.isNotNull() & (kind(value) != "null"), "value_in_unknown_state")
        .when(F.array_contains(F.map_keys(f), "evidence_refs") & ~F.coalesce(kind(refs) == "array", F.lit(False)), "invalid_evidence_refs")
        .otherwise(_first(F.coalesce(items(refs), F.array().cast(_ITEMS)), lambda r: reference_problem(r, types)))
    )


def _all(v: Column, test) -> Column:
    return F.coalesce(F.forall(items(v), lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))


def _text(v: Column) -> Column:
    return F.coalesce(F.trim(string(v)), F.lit("")) != ""


def _whole(v: Column, least: int) -> Column:
    return F.coalesce((kind(v) == "integer") & (F.try_variant_get(v, "$", "decimal(38,0)") >= least), F.lit(False))


def _locator(v: Column) -> Column:
    f = fields(v)
    part = lambda name: F.try_element_at(f, F.lit(name))
    keys = F.array_sort(F.map_keys(f))
    local = (string(part("kind")) == "local") & (keys == F.array(F.lit("kind"), F.lit("path"))) & _text(part("path"))
    return local | ((string(part("kind")) == "external") & (keys == F.array(F.lit("kind"), F.lit("locator"))) & _text(part("locator")))


def shapes(types: list[str], artifacts: list[str], registry: str) -> dict[str, object]:
    """Plain shapes: name -> test of a VARIANT. Those of references give a code of their own instead."""
    return {
        "any": lambda v: F.lit(True),
        "text": _text,
        "texts": lambda v: _all(v, _text),
        "some_texts": lambda v: _all(v, _text) & (F.size(items(v)) > 0),
        "id": lambda v: is_id(string(v)),
        "null_or_id": lambda v: (kind(v) == "null") | is_id(string(v)),
        "ids": lambda v: _all(v, lambda x: is_id(string(x))),
        "hash": lambda v: is_hash(string(v)),
        "bool": lambda v: kind(v) == "boolean",
        "object": lambda v: kind(v) == "object",
        "text_object": lambda v: F.coalesce(F.forall(F.map_values(fields(v)), _text), F.lit(False)),
        "objects": lambda v: _all(v, lambda x: kind(x) == "object"),
        "positive": lambda v: _whole(v, 1),
        "count": lambda v: _whole(v, 0),
        "null_or_integer": lambda v: kind(v).isin("null", "integer"),
        "locator": _locator,
        "version": lambda v: string(v) == VERSION,
        "artifact": lambda v: F.coalesce(string(F.try_element_at(fields(v), F.lit("record_type"))).isin(*artifacts), F.lit(False)),
        "registry": lambda v: string(F.try_element_at(fields(v), F.lit("record_type"))) == registry,
    }


#: Shapes whose value is a reference, or a list of them: what is wrong with a reference has a code of its own.
REFERRING = {"ref": False, "artifact": False, "registry": False, "refs": True}


def shape_problems(records: DataFrame, shape: DataFrame, *, types: list[str], artifacts: list[str] = ("artifact", "raw_artifact"), registry: str = "reference_registry") -> DataFrame:
    """record_type, record_id, path, code of each defect of ``records`` (record_type, record_id, v).

    ``shape`` (record_type, place, field, required, form, known, values, code): ``place`` is where the field stands ("$" or
    "$.payload"), ``form`` names a plain shape, ``known`` tells whether it is the shape of a known value under its state,
    ``values`` closes a string, ``code`` is that of a value of the wrong shape. It has a row for each field of a type, a
    table of the format and not of the data, so it is broadcast.
    """
    tests = shapes(list(types), list(artifacts), registry)
    rows = records.select("record_type", "record_id", "v", F.map_from_arrays(F.array(F.lit("$"), F.lit("$.payload")), F.array(fields(F.col("v")), F.try_variant_get("v", "$.payload", _FIELDS))).alias("_at"))
    each = rows.drop("v").join(F.broadcast(shape), "record_type").withColumn("_fields", F.try_element_at("_at", F.col("place"))).where(F.col("_fields").isNotNull())
    v = F.try_element_at("_fields", F.col("field"))
    there = F.array_contains(F.map_keys("_fields"), F.col("field"))

    def plain(value: Column) -> Column:
        wrong = F.lit(None).cast("string")
        for name, test in tests.items():
            wrong = F.when((F.col("form") == name) & ~F.coalesce(test(value), F.lit(False)), F.col("code")).otherwise(wrong)
        closed = F.when((F.col("form") == "enum") & ~F.coalesce(F.array_contains("values", string(value)), F.lit(False)), F.col("code"))
        one = F.when(F.col("form").isin(*[k for k, many in REFERRING.items() if not many]), reference_problem(value, list(types)))
        many = F.when(F.col("form") == "refs", F.when(kind(value).eqNullSafe(F.lit("array")), _first(items(value), lambda r: reference_problem(r, list(types)))).otherwise(F.col("code")))
        return F.coalesce(one, many, closed, wrong)

    inner = F.try_element_at(fields(v), F.lit("value"))
    is_known = string(F.try_element_at(fields(v), F.lit("state"))) == "known"
    tagged = F.coalesce(knowledge_problem(v, list(types)), F.when(is_known, plain(inner)))
    missing = F.when(F.col("place") == "$", "missing_required_field").otherwise("missing_support_field")
    code = F.when(~there, F.when(F.col("required"), missing)).when(F.col("known"), tagged).otherwise(plain(v))
    bad = each.select("record_type", "record_id", F.concat_ws(".", "place", "field").alias("path"), code.alias("code")).where("code IS NOT NULL")
    allowed = shape.groupBy("record_type", "place").agg(F.collect_set("field").alias("_allowed"))
    more = rows.drop("v").join(F.broadcast(allowed), "record_type").withColumn("_fields", F.try_element_at("_at", F.col("place")))
    more = more.select("record_type", "record_id", "place", F.explode(F.array_except(F.map_keys("_fields"), "_allowed")).alias("field"))
    unknown = F.when(F.col("place") == "$", "unknown_record_field").otherwise("unknown_support_field")
    return bad.unionByName(more.select("record_type", "record_id", F.concat_ws(".", "place", "field").alias("path"), unknown.alias("code")))


#: Depths that one pass over the records goes down.
DEPTHS = 6


def _node(path: Column, depth: Column, v: Column) -> Column:
    return F.struct(path.alias("path"), depth.alias("depth"), v.alias("v"), fields(v).alias("f"), items(v).alias("i"))


def _names_reference(n: Column) -> Column:
    return F.coalesce(F.array_sort(F.map_keys(n["f"])) == F.array(*map(F.lit, _REF_KEYS)), F.lit(False))


def _below(n: Column) -> Column:
    """The nodes right below a node."""
    deep = n["depth"] + 1
    named = F.transform(F.map_entries(n["f"]), lambda e: _node(F.concat(n["path"], F.lit("."), e["key"]), deep, e["value"]))
    placed = F.transform(n["i"], lambda x, k: _node(F.concat(n["path"], F.lit("["), k.cast("string"), F.lit("]")), deep, x))
    return F.coalesce(named, placed)


def _descended(records: DataFrame, keys: list[str], out: dict, kept, stop_at_references: bool) -> DataFrame:
    """keys and ``out``, expressions over a node, of the nodes that are ``kept``.

    A pass takes each record ``DEPTHS`` levels down, as arrays beside it, and writes what is kept; nodes below which there
    is more go to the next pass, which begins there. So a record is read once for each ``DEPTHS`` of its levels.
    """
    own = {k: f"_key{n}" for n, k in enumerate(keys)}  # an explosion has columns of its own, such as key and value
    level = records.select(*[F.col(k).alias(c) for k, c in own.items()], F.lit("$").alias("_path"), F.lit(0).alias("_depth"), F.col("v").alias("_v"))
    leads = lambda n: (n["f"].isNotNull() | n["i"].isNotNull()) & (~_names_reference(n) if stop_at_references else F.lit(True))
    passes = []
    while True:
        rows = level.withColumn("_0", F.array(_node(F.col("_path"), F.col("_depth"), F.col("_v")))).drop("_path", "_depth", "_v")
        for k in range(DEPTHS):
            rows = rows.withColumn(f"_{k + 1}", F.flatten(F.transform(F.filter(f"_{k}", leads), _below)))
        told = lambda n: F.struct(*[e(n).alias(c) for c, e in out.items()])
        found = [F.transform(F.filter(f"_{k}", kept), lambda n: F.struct(told(n).alias("out"), F.lit(None).cast("struct<path:string,depth:int,v:variant>").alias("more"))) for k in range(DEPTHS)]
        more = F.transform(F.filter(f"_{DEPTHS}", lambda n: leads(n) | kept(n)), lambda n: F.struct(F.when(F.lit(False), told(n)).alias("out"), F.struct(n["path"].alias("path"), n["depth"].alias("depth"), n["v"].alias("v")).alias("more")))
        each = rows.select(*own.values(), F.explode(F.concat(*found, more)).alias("_e"))
        done = written(each.select(*own.values(), "_e.out", "_e.more", F.col("_e.more").isNotNull().alias("_open")))
        passes.append(done.where("NOT _open").select(*[F.col(c).alias(k) for k, c in own.items()], "out.*"))
        left = done.where("_open")
        if not left.take(1):
            break
        level = left.select(*own.values(), F.col("more.path").alias("_path"), F.col("more.depth").alias("_depth"), F.col("more.v").alias("_v"))
    whole = passes[0]
    for p in passes[1:]:
        whole = whole.unionByName(p)
    return whole


def walk(records: DataFrame, keys: list[str], *, stop_at_references: bool = True) -> DataFrame:
    """keys, path, depth, kind, v of every node of ``records`` (keys, v), the record itself at path ``$``.

    Records are read once for several depths, however many nodes stand there. References are leaves unless asked otherwise.
    """
    out = _descended(records, keys, {c: lambda n, c=c: n[c] for c in ("path", "depth", "v")}, lambda n: F.lit(True), stop_at_references)
    return out.select(*keys, "path", "depth", kind(F.col("v")).alias("kind"), "v")


def references(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path, target_type, target_id, target_version of the references among walked nodes."""
    f = fields(F.col("v"))
    part = lambda name: string(F.try_element_at(f, F.lit(name)))
    found = nodes.where(is_reference(F.col("v")))
    return found.select(*keys, "path", part("record_type").alias("target_type"), part("record_id").alias("target_id"), part("record_version").alias("target_version"))


def deep_references(records: DataFrame, keys: list[str]) -> DataFrame:
    """``references`` of ``walk``, without a table of all nodes: only references leave their record."""
    part = lambda name: lambda n: string(F.try_element_at(n["f"], F.lit(name)))
    out = {"path": lambda n: n["path"], "target_type": part("record_type"), "target_id": part("record_id"), "target_version": part("record_version")}
    return _descended(records, keys, out, _names_reference, True)


def shape_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """The table that ``shape_problems`` takes, from (record_type, place, field, required, form, known, values, code)."""
    return spark.createDataFrame(rows, "record_type string, place string, field string, required boolean, form string, known boolean, values array<string>, code string")
