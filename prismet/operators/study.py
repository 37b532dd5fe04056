"""Study layer: registered design, review agreement, audits, collection accounts, spending."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismet.session import gathered

BLOCKS, CONDITIONS, GROUPS, PLACES = 6, ["A", "B", "C"], 4, 5
_ORDERS = ["ABC", "ACB", "BAC", "BCA", "CAB", "CBA"]


def design(spark: SparkSession) -> DataFrame:
    """The registered 72 calls and 360 positions with their global order [S13, W12]."""
    grid = spark.range(GROUPS).select((F.col("id") + 1).cast("int").alias("group")).join(spark.range(BLOCKS).select((F.col("id") + 1).cast("int").alias("block")), F.lit(True))
    order = F.element_at(F.array(*map(F.lit, _ORDERS)), F.pmod(F.col("block") + F.col("group") - 2, F.lit(6)) + 1)
    calls = grid.withColumn("_o", order).select("group", "block", F.explode(F.array(*map(F.lit, CONDITIONS))).alias("condition"), "_o")
    calls = calls.withColumn("call_order", (F.col("group") - 1) * 18 + (F.col("block") - 1) * 3 + F.expr("instr(_o, condition)"))
    return calls.select("group", "block", "condition", "call_order", F.explode(F.sequence(F.lit(1), F.lit(PLACES))).alias("position"))


def sorting_inputs(spark: SparkSession, values: list[int], length: int) -> DataFrame:
    """All sequences over a value list up to a length, numbered in a fixed order [S13]."""
    n, parts = len(values), []
    table = F.array(*map(F.lit, values))
    for k in range(length + 1):
        digits = [F.element_at(table, (F.floor(F.col("id") / n**j) % n + 1).cast("int")) for j in reversed(range(k))]
        parts.append(spark.range(n**k).select(F.lit(k).alias("length"), F.col("id"), (F.array(*digits) if digits else F.array().cast("array<int>")).alias("input")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def audit_positions(positions: DataFrame) -> DataFrame:
    """One systematic position of each call: 1 + (block + condition + group - 3) mod 5 [T5, W14]."""
    c = F.array_position(F.array(*map(F.lit, CONDITIONS)), F.col("condition"))
    return positions.where(F.col("position") == 1 + F.pmod(F.col("block") + c + F.col("group") - 3, F.lit(5)))


def audit_representatives(rows: DataFrame, keys: list[str], chosen: str, order: list[str]) -> DataFrame:
    """One row of each group: one already selected if there is any, else the earliest [T4]."""
    w = Window.partitionBy(*keys).orderBy(F.col(chosen).desc(), *order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def rare_classes(counts: DataFrame) -> DataFrame:
    """Cell-classes with one or two members [A32]."""
    return counts.where(F.col("n").between(1, 2))


def audit_reasons(rows: DataFrame, cell: str = "cell", cls: str = "class") -> DataFrame:
    """Reasons to audit each sample [A32]: systematic, challenged, disputed, rare class."""
    n = F.count(F.lit(1)).over(Window.partitionBy(cell, cls))
    return rows.withColumn("audit_reasons", F.array_compact(F.array(F.when(F.col("systematic"), "systematic"), F.when(F.col("challenged"), "challenged_essential"), F.when(F.col("disputed"), "classification_dispute"), F.when(F.col(cls).isNotNull() & n.between(1, 2), "rare_class"))))


def agreement(reviews: DataFrame, item: str, slot: str, category: str) -> DataFrame:
    """Paired items of two initial slots and how many agree [A28]; items with one review stay in their own denominator."""
    wide = reviews.groupBy(item).agg(F.max(F.when(F.col(slot) == 1, F.col(category))).alias("_a"), F.max(F.when(F.col(slot) == 2, F.col(category))).alias("_b"))
    paired = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    yes = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return wide.agg(F.count(F.lit(1)).alias("items"), yes(paired).alias("paired"), yes(paired & (F.col("_a") == F.col("_b"))).alias("agreeing"), yes(~paired).alias("single"))


def independent_annotations(annotations: DataFrame) -> DataFrame:
    """Sets with at least two people, no exposure to labels, and one rubric [V1]."""
    return annotations.groupBy("set_id", "target", "aspect").agg(F.count_distinct("person").alias("people"), F.bool_or("exposed").alias("exposed"), F.count_distinct("rubric").alias("rubrics")).withColumn("sound", (F.col("people") >= 2) & ~F.col("exposed") & (F.col("rubrics") == 1))


def collection_account(plan: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Planned, emitted, retried and missing slots [A29]; a retry never creates a slot."""
    got = ledger.groupBy(*keys).agg(F.count(F.lit(1)).alias("attempts"), F.max(F.when(F.col("emitted"), 1).otherwise(0)).alias("_e"))
    both = plan.join(got, keys, "left")
    return both.agg(F.count(F.lit(1)).alias("planned"), F.sum(F.coalesce("_e", F.lit(0))).alias("emitted"), F.sum(F.greatest(F.coalesce("attempts", F.lit(0)) - 1, F.lit(0))).alias("retries"), F.sum(F.when(F.col("attempts").isNull(), 1).otherwise(0)).alias("missing"))


def collection_eligibility(plan: DataFrame, ledger: DataFrame, cell: str, group: str, index: str, ks: list[int]) -> DataFrame:
    """Groups, complete groups, emitted prefix and the eligible k of each cell [A29].

    A group is complete if every planned slot was emitted; k is eligible if the first k planned slots, by group and
    index, were: a later success never fills an earlier hole.
    """
    # Plan and ledger lie together by cell once: one grouping by slot, one order within a cell, nothing is joined.
    each = plan.select(cell, group, index, F.lit(True).alias("_plan"), F.lit(False).alias("_e")).unionByName(ledger.where("emitted").select(cell, group, index, F.lit(False).alias("_plan"), F.lit(True).alias("_e")))
    named = F.col(cell).isNotNull() & F.col(group).isNotNull() & F.col(index).isNotNull()  # a slot without a name is never met
    slots = gathered(each, cell).groupBy(cell, group, index).agg(F.bool_or("_plan").alias("_plan"), F.bool_or("_e").alias("_e")).where("_plan").withColumn("_e", F.col("_e") & named)
    placed = slots.withColumn("_n", F.row_number().over(Window.partitionBy(cell).orderBy(group, index)))
    groups = placed.groupBy(cell, group).agg(F.bool_and("_e").alias("_whole"), F.count(F.lit(1)).alias("_slots"), F.min(F.when(~F.col("_e"), F.col("_n"))).alias("_hole"))
    out = groups.groupBy(cell).agg(F.count(F.lit(1)).alias("groups"), F.sum(F.col("_whole").cast("long")).alias("complete_groups"), F.coalesce(F.min("_hole") - 1, F.sum("_slots")).cast("long").alias("prefix"))
    able = F.array_compact(F.array(*[F.when(F.col("prefix") >= k, F.lit(k)) for k in ks]))
    return out.where(F.col(cell).isNotNull()).select(cell, "groups", "complete_groups", "prefix", able.alias("eligible"))


def order_violations(calls: DataFrame, key: str, order: str, time: str) -> DataFrame:
    """Calls whose time does not increase with their registered order [W13]."""
    w = Window.partitionBy(key).orderBy(order)
    return calls.withColumn("_before", F.lag(time).over(w)).where(F.col(time) <= F.col("_before")).drop("_before")


def log_coverage(expected: DataFrame, observed: DataFrame, key: str, place: str | None = None, block: str | None = None) -> DataFrame:
    """missing, unexpected, duplicate, out_of_order or once of each id of a validation log [A33, V2].

    With ``place`` (a column of both tables), an id of ``block`` whose place is not after that of the id expected before
    it is out of order; ids that are not there are passed over.
    """
    seen = observed.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *([F.min(place).alias("_at")] if place else []))
    own = [block] if block else []
    both = expected.select(key, *own, *([F.col(place).alias("_want")] if place else [])).dropDuplicates([key]).withColumn("_e", F.lit(True)).join(seen, key, "full_outer")
    late = F.lit(False)
    if place:
        w = Window.partitionBy(*(own or [F.lit(0)])).orderBy("_want")
        late = F.coalesce(F.col("_at") <= F.last(F.when(F.col("_e"), F.col("_at")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    return both.select(key, F.when(F.col("_e").isNull(), "unexpected").when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "duplicate").when(late, "out_of_order").otherwise("once").alias("coverage"))


def spending(rows: DataFrame, keys: list[str], amount: str, currency: str) -> DataFrame:
    """Exact totals, null if a group has several currencies [A31]."""
    out = rows.groupBy(*keys).agg(F.count_distinct(currency).alias("currencies"), F.sum(F.col(amount).cast("decimal(18,2)")).alias("_t"))
    return out.select(*keys, "currencies", F.when(F.col("currencies") == 1, F.col("_t")).alias("total"))


def control_signature(calls: DataFrame, key: str, controls: list[str]) -> DataFrame:
    """Whether the known control values agree across the calls of a key [V21]."""
    return calls.groupBy(key).agg(*[F.count_distinct(c).alias(f"_{c}") for c in controls]).select(key, *[(F.col(f"_{c}") <= 1).alias(f"{c}_equal") for c in controls])
