"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every 5-word shingle hash (48 bits) below 1/``SCALE`` of the hash range. A text of few shingles may have
none below; its sketch is then its least hash alone. ``merge`` gives the sketch of the union of two texts' shingles from
their sketches: it unites them, and drops a least hash that stood in as soon as a hash below the limit is there. The
share of one sketch found in another estimates containment however unequal the documents are. Native: SQL functions only.

``SCALE = 8`` keeps about one hash in eight words, 12 hexadecimal digits each, a fourth of the text's bytes; the standard
error of a likeness near one half is about 1.4 / sqrt(words). ``scale`` is a parameter of every function.

Defined cases: no words (null or empty text) gives an empty fingerprint; fewer than five words make one shingle; two
empty fingerprints are alike (1.0); equal texts have equal fingerprints; very long texts are read whole; repeated rows
have a fingerprint each; an empty table gives an empty result; columns beside id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismet.llm._ranges import bucket_of, let, range_bounds
from prismet.llm._stage import default_parts

SCALE = 8
WORDS = 5
BITS = 48


def _hash(*columns: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - BITS)


def retained(hashes: Column, *, scale: int = SCALE) -> Column:
    """The sketch of a set of hashes: those below the limit, sorted, or the least one if none is."""
    limit = (1 << BITS) // scale
    return let(hashes, lambda g: let(F.filter(g, lambda x: x < limit), lambda low: F.when((F.size(low) > 0) | (F.size(g) == 0), F.array_sort(F.array_distinct(low))).otherwise(F.array(F.array_min(g)))))


def sketch(text: Column, *, scale: int = SCALE, n: int = WORDS) -> Column:
    """Sorted array of the retained shingle hashes of a text."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")

    def shingles(h: Column) -> Column:
        each = F.transform(F.slice(h, 1, F.greatest(F.size(h) - (n - 1), F.lit(0))), lambda x, i: _hash(x, *[F.get(h, i + k) for k in range(1, n)]))
        return F.when(F.size(h) == 0, F.array().cast("array<long>")).when(F.size(h) < n, F.array(_hash(h))).otherwise(each)

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: retained(shingles(h), scale=scale))


def merge(a: Column, b: Column, *, scale: int = SCALE) -> Column:
    """The sketch of the union of two shingle sets, from their sketches of one scale."""
    return retained(F.array_union(a, b), scale=scale)


def merged(sketches: DataFrame, keys: list[str], *, scale: int = SCALE, column: str = "sketch") -> DataFrame:
    """keys and ``column``: the sketch of all texts of each group. Hashes meet by value first, so a group of any size is dealt over its hashes."""
    each = sketches.select(*keys, F.explode(column).alias("_h")).distinct()
    low = F.col("_h") < (1 << BITS) // scale
    out = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(low, F.col("_h")))).alias("_low"), F.min("_h").alias("_least"))
    return out.select(*keys, F.when(F.size("_low") > 0, F.col("_low")).otherwise(F.array("_least")).alias(column))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard estimate of two sketches, 1.0 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has, 1.0 if a has none."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def as_string(a: Column) -> Column:
    """Twelve hexadecimal digits for each hash, in order."""
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), BITS // 4, "0"))), "")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and sketch of each row; no shuffle."""
    return docs.select(F.col(id_col).alias("doc_id"), sketch(F.col(text_col).cast("string")).alias("sketch"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, next_text, sketch, next_sketch, edited and edited_sketch: each row beside the next by ascending id.

    Rows go to key ranges between quantiles of the ids; the first row of a range is sent to the range before as well, so
    that a window of one range sees every neighbour: one shuffle of the texts, no global order. After the last row comes
    the first. Rows of equal id follow each other by text; null ids count as the least id.
    """
    parts = default_parts(docs.sparkSession)
    ids = docs.select(F.col(id_col).cast("long").alias("_id"))
    bounds = range_bounds(ids, "_id", parts) or [0]
    last = len(bounds) - 1
    key = F.coalesce(F.col("doc_id"), F.lit(bounds[0]).cast("long"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("_key", key).withColumn("_range", bucket_of(F.col("_key"), bounds))
    is_first = F.get(F.array(*[F.lit(b).cast("long") for b in bounds]) if len(bounds) < 64 else F.from_json(F.lit("[" + ",".join(map(str, bounds)) + "]"), "array<long>"), F.col("_range")) == F.col("_key")
    own = F.struct(F.col("_range").alias("r"), F.lit(False).alias("ahead"))
    ahead = F.struct(F.when(F.col("_range") == 0, F.lit(last)).otherwise(F.col("_range") - 1).alias("r"), F.lit(True).alias("ahead"))
    rows = rows.select("doc_id", "text", "_key", F.explode(F.when(is_first, F.array(own, ahead)).otherwise(F.array(own))).alias("_to"))
    rows = rows.select("doc_id", "text", "_key", F.col("_to.r").alias("_range"), F.col("_to.ahead").alias("_ahead"))
    w = Window.partitionBy("_range").orderBy("_ahead", "_key", "text")
    rows = rows.withColumn("next_text", F.lead("text").over(w))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - cut).cast("int")), F.substring(F.coalesce(F.col("next_text"), F.lit("")), F.lit(1), cut))
    rows = rows.withColumn("edited", edited)
    rows = rows.select("doc_id", "_key", "_range", "_ahead", "text", "edited", sketch(F.col("text")).alias("sketch"), sketch(F.col("edited")).alias("edited_sketch"))
    rows = rows.withColumn("next_sketch", F.lead("sketch").over(w))
    return rows.where(~F.col("_ahead")).drop("_key", "_range", "_ahead")
