"""MinHash near-dedup by an inverted join of signature coordinates.

A document's set of 5-word shingles has a signature of ``K`` minima. Each (coordinate, minimum) is a token. Two sets of
Jaccard 0.75 agree on 36 of 48 coordinates on average; a pair is a candidate if it agrees on ``MATCH`` or more, which a
true pair misses about once in 10**8 at the threshold and far less above it. Candidates are confirmed on full sets.

* Equal sets form one class, represented by its least doc_id; copies are never paired.
* Prefix: a pair with ``MATCH`` common tokens has one among the ``K - MATCH + 1`` rarest tokens of both. Tokens of one
  class only are rarest of all and post nothing, so a class without a partner posts next to nothing, and a token that
  a common passage spreads over a third of all documents stays outside the prefixes.
* Skip: in each posting list every class is first compared with one centre, the member with the most common tokens.
  Confirmed links contract to components. Then only lists that still hold several components are merged in full, and
  only for pairs of different components. Long lists are merged in blocks of a fixed size that hold the full sets: a
  pair is compared at its first common list only, and a block gives the links that join its components, not its pairs.

So a group of near copies gives about as many rows as it has members, and no link between components is lost.

Nulls: a null text or one without words has an empty set and links with nothing. Repeated rows are one document; if rows
of one doc_id differ in text, each belongs to the class of its own set. Rows with a null doc_id link with nothing. An empty
table gives an empty result. Very long texts are read whole. Ties: the centre of a list with several members of the most
common tokens is the one of least doc_id. Columns beside id and text do not matter, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismet.llm._sieve import Sieve
from prismet.llm._stage import discard, is_empty, map_arrow, stage
from prismet.llm._text import mix, randoms, shingle_sets, slices, utf8

K = 48
MATCH = 18
PREFIX = K - MATCH + 1
#: Posting lists of up to this many classes are paired by a join, longer ones in blocks of about ``BLOCK``.
SHORT = 16
BLOCK = 1024
#: Shingles that a block holds at most on average, and keys over which the pairs of one centre are dealt.
HELD = 1 << 18
SALTS = 64
_FILTER_BITS = 1 << 26
_A, _B = randoms(101, K), randoms(202, K)
_COORDINATE = np.arange(K, dtype=np.uint64) << np.uint64(32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """K tokens of a set: coordinate in the high half, the minimum of its hash in the low half."""
    low = np.full(K, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 4096):
        low = np.minimum(low, ((shingles[at : at + 4096, None] * _A + _B) >> np.uint64(32)).min(0))
    return (_COORDINATE | low).view(np.int64)


def _sketch(batches):
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        n, lo, hi, tokens = [], [], [], []
        for i, j in slices(offsets):
            for s in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                n.append(len(s))
                lo.append(mix(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64))
                hi.append(mix(s ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64))
                tokens.append(signature(s) if len(s) else np.zeros(0, np.int64))
        ends = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
        flat = pa.ListArray.from_arrays(ends, np.concatenate(tokens) if tokens else np.zeros(0, np.int64))
        cols = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(np.array(lo, np.uint64).view(np.int64)), pa.array(np.array(hi, np.uint64).view(np.int64)), flat]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_key", "n", "lo", "hi", "tokens"])


def _sets(batches):
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for i, j in slices(offsets):
            sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = pa.ListArray.from_arrays(ends, np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), flat], ["rep", "shingles"])


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def text_key(text) -> F.Column:
    """Tells the texts of rows of one id apart; null texts have a key as well."""
    return F.xxhash64(text)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key (which of the rows of one id), n (set size), a 128-bit identity of the set (lo, hi) and its signature tokens. No shuffle."""
    source = _source(docs, id_col, text_col).select("doc_id", "text", text_key("text").alias("text_key"))
    return map_arrow(source, _sketch, "doc_id long, text_key long, n long, lo long, hi long, tokens array<long>")


def _candidates_only(source: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``source`` whose doc_id is in ``ids``. Before texts move, a bitmap drops most others where they are read.

    The bitmap has 16 bits for each id, at most ``_FILTER_BITS`` (8 MB): beyond that it lets more rows through, and the
    join that follows decides in any case.
    """
    spark = source.sparkSession
    ids = stage(ids.select("doc_id").distinct(), "ids")
    n = ids.count()
    bits = min(_FILTER_BITS, 1 << max(16, (16 * n - 1).bit_length()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    held = ids.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {bits}L) % 64 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[held.column("w").to_numpy()] = held.column("b").to_numpy()
    shared = spark.sparkContext.broadcast(words)

    def keep(batches):
        for batch in batches:
            at = batch.column(2).to_numpy()
            hit = (shared.value[at >> 6] >> (at & 63)) & 1 == 1
            yield batch.select(["doc_id", "text"]).filter(pa.array(hit))

    likely = map_arrow(source.select("doc_id", "text", place.alias("at")), keep, "doc_id long, text string")
    return likely.join(ids, "doc_id", "left_semi")


def full_sets(source: DataFrame, ids: DataFrame) -> DataFrame:
    """rep, shingles: the full sets of the documents in ``ids``."""
    return stage(map_arrow(_candidates_only(source, ids), _sets, "rep long, shingles array<long>"), "sets")


def _beside(pairs: DataFrame, held: DataFrame, column: str) -> DataFrame:
    """a, b, _x, _y: pairs (a, b) beside the arrays ``column`` of both documents, from ``held`` (rep, array).

    ``a`` may be one centre of a third of all documents. Its pairs are dealt over ``SALTS`` keys, and its array is sent
    once to each key that holds one, not once a pair; nothing moves after the two arrays have met.
    """
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("_salt"))
    centres = salted.select("a", "_salt").distinct().join(held.select(F.col("rep").alias("a"), F.col(column).alias("_x")), "a")
    others = salted.join(held.select(F.col("rep").alias("b"), F.col(column).alias("_y")), "b")
    return others.join(centres, ["a", "_salt"])


def confirm(pairs: DataFrame, source: DataFrame, percent: int = 75) -> DataFrame:
    """The pairs (a, b) of documents whose full sets have 100 * intersection >= percent * union."""
    sets = full_sets(source, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
    both = _beside(pairs, sets, "shingles").withColumn("i", F.size(F.array_intersect("_x", "_y")))
    return both.where(100 * F.col("i") >= percent * (F.size("_x") + F.size("_y") - F.col("i"))).select("a", "b").distinct()


def _matching(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs that agree on ``MATCH`` coordinates or more."""
    return _beside(pairs, classes, "tokens").where(F.size(F.array_intersect("_x", "_y")) >= MATCH).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (a, b), the component being its least node.

    Alternating large-star and small-star steps: each joins the edges with the least neighbour of a node, never gathers
    the neighbours of one, and is written to the shared folder, so a lost executor costs one step.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).where("v <> m").distinct(), "edges")
    seen = None
    while True:
        both = now.union(now.select("m", "v"))
        least = both.groupBy("v").agg(F.min("m").alias("_l")).select("v", F.least("v", "_l").alias("_l"))
        large = both.where("m > v").join(least, "v").select(F.col("m").alias("v"), F.col("_l").alias("m")).where("v <> m").distinct()
        own = large.groupBy("v").agg(F.min("m").alias("_l"))
        small = large.join(own, "v").select(F.explode(F.array(F.struct("v", F.col("_l").alias("m")), F.struct(F.col("m").alias("v"), F.col("_l").alias("m")))).alias("e"))
        last, now = now, stage(small.select("e.v", "e.m").where("v <> m").distinct(), "stars")
        discard(last)
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if mark == seen:
            nodes = now.select(F.col("v").alias("node"), F.col("m").alias("component"))
            return nodes.union(now.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct())
        seen = mark


_PAIRS = "a long, b long"


def _overlaps(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all pairs of two lists of sets, by products of their incidence matrices."""
    flat = np.concatenate([sets[k] for k in np.union1d(x, y).tolist()])
    values, seen = np.unique(flat, return_counts=True)
    values = values[seen > 1]
    out = np.zeros((len(x), len(y)), np.float32)

    def marks(which, part):
        m = np.zeros((len(which), len(part)), np.float32)
        for r, k in enumerate(which.tolist()):
            at = np.searchsorted(part, sets[k])
            at = at[(at < len(part)) & (part[np.minimum(at, len(part) - 1)] == sets[k])]
            m[r, at] = 1
        return m

    for at in range(0, len(values), 4096):
        part = values[at : at + 4096]
        out += marks(x, part) @ marks(y, part).T
    return out.astype(np.int64)


def _block(table: pa.Table) -> pa.Table:
    """Links that join the components within one block of a long list: compared on full sets, at the first common list."""
    coordinate = table.column("_c")[0].as_py()
    rep, comp, home, mask = (table.column(k).to_numpy() for k in ("rep", "comp", "_home", "mask"))
    sig = np.concatenate([c.flatten().to_numpy() for c in table.column("tokens").chunks]).reshape(-1, K)
    sets = [np.sort(c.values.to_numpy()) for c in table.column("shingles")]
    sizes = np.array([len(s) for s in sets])
    bits = (mask[:, None] >> np.arange(K)) & 1 == 1
    up = {int(c): int(c) for c in comp}

    def root(c):
        while up[c] != c:
            up[c] = c = up[up[c]]
        return c

    # Classes whose own block this is, against all: a pair of two such is compared once, one of two guests elsewhere.
    ia, ib = np.flatnonzero(home), np.arange(len(rep))
    out = []
    for at in range(0, len(ia), 64):
        x = ia[at : at + 64]
        own = np.array([root(int(c)) for c in comp])
        ok = (own[x][:, None] != own[ib][None, :]) & (np.minimum(sizes[x][:, None], sizes[ib][None, :]) * 4 >= 3 * np.maximum(sizes[x][:, None], sizes[ib][None, :]))
        ok &= ~home[None, :] | (x[:, None] < ib[None, :])
        p, q = np.nonzero(ok)
        keep = []
        for k in range(0, len(p), 1 << 16):
            eq = sig[x[p[k : k + (1 << 16)]]] == sig[ib[q[k : k + (1 << 16)]]]
            first = (eq & bits[x[p[k : k + (1 << 16)]]] & bits[ib[q[k : k + (1 << 16)]]]).argmax(1)
            keep.append((eq.sum(1) >= MATCH) & (first == coordinate))
        if not keep:
            continue
        keep = np.concatenate(keep)
        p, q = p[keep], q[keep]
        if not len(p):
            continue
        rows, cols = np.unique(p), np.unique(q)
        both = _overlaps(sets, x[rows], ib[cols])[np.searchsorted(rows, p), np.searchsorted(cols, q)]
        linked = 100 * both >= 75 * (sizes[x[p]] + sizes[ib[q]] - both)
        for a, b in zip(x[p[linked]].tolist(), ib[q[linked]].tolist(), strict=True):
            ra, rb = root(int(comp[a])), root(int(comp[b]))
            if ra != rb:
                up[max(ra, rb)] = min(ra, rb)
                out.append((min(int(rep[a]), int(rep[b])), max(int(rep[a]), int(rep[b]))))
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def postings(classes: DataFrame) -> DataFrame:
    """token, rep, popularity: the prefix tokens of each class that another class has as well."""
    each = classes.select("rep", F.explode("tokens").alias("token"))
    freq = each.groupBy("token").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1")
    mine = Window.partitionBy("rep")
    shared = each.join(freq, "token").withColumns({"_k": F.row_number().over(mine.orderBy("freq", "token")), "_n": F.count(F.lit(1)).over(mine), "popularity": F.sum("freq").over(mine)})
    return shared.where(F.col("_k") <= PREFIX - (K - F.col("_n"))).select("token", "rep", "popularity")


def star_pairs(posts: DataFrame) -> DataFrame:
    """Pairs (centre, member) of the centre of each list with its other classes; the centre is found by an aggregation with map-side maxima."""
    centre = posts.groupBy("token").agg(F.max(F.struct("popularity", (-F.col("rep")).alias("r"))).alias("c"))
    both = posts.join(centre.select("token", (-F.col("c.r")).alias("centre")), "token").where(F.col("rep") != F.col("centre"))
    return both.select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()


def rest_links(posts: DataFrame, classes: DataFrame, parts: DataFrame, source: DataFrame) -> DataFrame:
    """Links between different components in the lists that hold more than one."""
    posts = posts.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    open_lists = posts.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("_x"), F.max("comp").alias("_y")).where("_x <> _y").select("token", "size")
    posts = stage(posts.join(open_lists, "token").select("token", "size", "rep", "comp"), "lists")
    short = posts.where(F.col("size") <= SHORT)
    other = short.select("token", F.col("rep").alias("rep2"), F.col("comp").alias("comp2"))
    joined = short.join(other, "token").where((F.col("rep") < F.col("rep2")) & (F.col("comp") != F.col("comp2")))
    pairs = stage(_matching(joined.select(F.col("rep").alias("a"), F.col("rep2").alias("b")).distinct(), classes), "pairs")
    links = confirm(pairs, source)
    long = posts.where(F.col("size") > SHORT)
    if is_empty(long):
        return links
    # The mask needs the prefix coordinates of a class in all its open lists, short ones included.
    mask = posts.groupBy("rep").agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftright(token, 32) as int))")).alias("mask"))
    sets = full_sets(source, long.select(F.col("rep").alias("doc_id"))).dropDuplicates(["rep"])
    held = classes.groupBy("rep").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens")).join(sets, "rep").join(mask, "rep")
    # The largest component of a list is not compared with itself: its classes go to one block each, those of the other
    # components to all blocks. So a list where a star has joined nearly all costs about its length.
    weighed = long.join(classes.groupBy("rep").agg(F.first("n").alias("n")), "rep").groupBy("token", "comp").agg(F.count(F.lit(1)).alias("_c"), F.sum("n").alias("_n"))
    lists = weighed.groupBy("token").agg(F.max_by("comp", F.struct("_c", "comp")).alias("_major"), F.sum("_c").alias("_size"), F.sum("_n").alias("_n"))
    lists = lists.select("token", "_major", F.ceil(F.greatest(F.col("_size") / BLOCK, F.col("_n") / HELD)).alias("_m"))
    long = long.join(lists, "token").withColumns({"_b": F.pmod(F.xxhash64("rep"), F.col("_m")), "_own": F.col("comp") != F.col("_major")})
    everywhere = F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)
    long = long.withColumn("_o", F.explode(F.when(F.col("_own"), everywhere).otherwise(F.array("_b")))).join(held, "rep")
    long = long.withColumn("_c", F.shiftright("token", 32)).select("token", "_o", "_c", "rep", "comp", "mask", "tokens", "shingles", (F.col("_b") == F.col("_o")).alias("_home"))
    return links.union(long.groupBy("token", "_o").applyInArrow(_block, _PAIRS)).distinct()


def _by_node(rows: DataFrame, several: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text_key, ...) with ``node``: the doc_id, but a hash of id and text for ids with ``several`` texts."""
    known = several.withColumn("_several", F.lit(True))
    node = F.when(F.col("_several"), F.xxhash64("doc_id", "text_key")).otherwise(F.col("doc_id"))
    return rows.join(known, "doc_id", "left").withColumn("node", node).drop("_several")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, n_shingles, component_id (least doc_id reachable) and group of each row.

    ``group`` names the component even where one doc_id, with several texts, is the least of several components.
    """
    source = _source(docs, id_col, text_col)
    sk = stage(sketches(docs, id_col, text_col), "sketches")
    several = stage(sk.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("text_key").alias("_x"), F.max("text_key").alias("_y")).where("_x <> _y").select("doc_id"), "several")
    full = sk.where("n > 0 AND doc_id IS NOT NULL")
    if is_empty(several):
        full = full.withColumn("node", F.col("doc_id"))
    else:
        full = _by_node(full, several)
        source = _by_node(source.withColumn("text_key", text_key("text")), several).select(F.col("node").alias("doc_id"), "text")
    classes = stage(full.groupBy("lo", "hi").agg(F.min("node").alias("rep"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("tokens").alias("tokens")), "classes")
    posts = stage(postings(classes), "postings")
    links = stage(confirm(stage(_matching(star_pairs(posts), classes), "pairs"), source), "links")
    parts = components(links)
    rest = stage(rest_links(posts, classes, parts, source), "rest")
    if not is_empty(rest):
        parts = components(links.union(rest))
    joined = classes.select("lo", "hi", "rep", "least").join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    # A component's name is the least node, which is a doc_id unless that id has several texts.
    named = joined.select("lo", "hi", F.col("component").alias("component_id"), F.col("component").alias("group"))
    if not is_empty(several):
        named = joined.join(joined.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("lo", "hi", "component_id", F.col("component").alias("group"))
    rows = sk.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "lo", "hi")
    return rows.join(named, ["lo", "hi"], "left").select("doc_id", "text_key", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "group")


def first_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, one row of each component: that of the least doc_id, of its texts the one of least key.

    Rows are judged each by its own text: of two rows of one id that differ in text, either may stay or go. Equal rows of
    one id and text are one document, of which one row stays. Rows without a doc_id or without words belong to no group
    and all stay. An empty table stays empty.
    """
    near = stage(near_duplicates(docs, id_col=id_col, text_col=text_col), "near")
    grouped = near.where("n_shingles > 0 AND doc_id IS NOT NULL")
    mine = F.struct("doc_id", "text_key")
    # One row for each component, by map-side minima: a component of a third of all rows is no hot key.
    best = grouped.groupBy("group").agg(F.min(mine).alias("_best"))
    keys = grouped.groupBy("group", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("_n"))
    judged = keys.join(best, "group").withColumn("_stays", mine == F.col("_best"))
    marked = stage(judged.where(~F.col("_stays") | (F.col("_n") > 1)).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "_stays"), "marked")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(row, F.col(id_col).cast("long").alias("_i"), text_key(F.col(text_col).cast("string")).alias("_k"))
    back = [F.col(f"_row.`{c}`") for c in docs.columns]
    same = (F.col("_i") == F.col("_id")) & (F.col("_k") == F.col("_key"))
    likely, free = Sieve(marked, ["_id", "_key"]).split(rows, [F.col("_i"), F.col("_k")])
    out = free.select(*back).unionByName(likely.join(marked, same, "left_anti").select(*back))
    again = marked.where("_stays")
    return out if is_empty(again) else out.unionByName(likely.join(again, same, "left_semi").dropDuplicates(["_i", "_k"]).select(*back))
