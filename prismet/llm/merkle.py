"""Merkle manifest of a dataset, built and checked by Pregel-style supersteps over RDDs.

Each row is a leaf. Leaves of one group (a source), in the order of their ids, form a tree in which every ``ARITY``
consecutive nodes have one parent; the groups' roots, in the order of the groups, form another such tree on top.

A vertex is a subtree of ``height`` levels, at most ``ARITY ** height`` children. In a superstep children send their
digests to their vertex; a vertex that has all of them hashes its levels and forwards its own digest to the next vertex.
A group is done when one digest is left. Reverse supersteps send the siblings' path down: a vertex adds those of its own
levels and passes each child its path, until every leaf folds its path, with the digest claimed for it, to a root.

* A group of any share of all rows is split over vertices like any other: no task holds more than a stretch of the order.
* Vertices stay in the partition where they were formed: going down, only paths of whole subtrees are shuffled, which are
  fewer by ``ARITY ** height`` with each superstep.
* The sorted leaves and each superstep's digests are checkpointed in the shared folder, so a lost executor costs a step.
* The driver learns a line for each partition (its first and last group and their counts) and the root.

Defined cases. A null field is ``-`` in its leaf; a null group comes first and is a group of its own; null ids come first
in it. Leaves of one id are ordered by their digests, equal rows are leaves each. An empty table has no leaves and so no
result. Texts of any length are hashed whole, by the engine's own function. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5, sha256
from itertools import groupby

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismet.llm._stage import default_parts, shared_dir, stage
from prismet.session import ship

ARITY = 3
#: Leaves of a partition of the order, about; also vertices of a partition in a superstep.
HELD = 100_000
SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, path array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the length of the UTF-8 bytes, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """SHA-256 of a row's fields, as hex text."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _digest(parts: list[bytes]) -> bytes:
    return sha256("".join(p.hex() for p in parts).encode()).digest()


def _spread(key: tuple[int, int]) -> int:
    """Where a vertex (tree, number) goes: neighbours to different partitions."""
    return (key[0] * 0x9E3779B1 + key[1] * 0x85EBCA77) & 0x7FFFFFFF


def _levels(digests: list[bytes], n: int, height: int) -> list[list[bytes]]:
    """The levels of a vertex: up to ``height`` of them, fewer where the whole tree of ``n`` nodes ends before."""
    out = [digests]
    while n > 1 and len(out) <= height:
        last = out[-1]
        out.append([_digest(last[k : k + ARITY]) for k in range(0, len(last), ARITY)])
        n = -(-n // ARITY)
    return out


def _after(n: int, height: int) -> int:
    """How many nodes a tree of ``n`` has after one superstep."""
    for _ in range(height):
        n = -(-n // ARITY)
    return n


def _path(levels: list[list[bytes]], slot: int) -> tuple[tuple[bytes, bytes], ...]:
    """Siblings before and after the node of a slot and its ancestors, level by level."""
    out = []
    for row in levels[:-1]:
        first = slot - slot % ARITY
        out.append((b"".join(row[first:slot]), b"".join(row[slot + 1 : first + ARITY])))
        slot //= ARITY
    return tuple(out)


def _fold(digest: bytes, path) -> bytes:
    for before, after in path:
        digest = sha256((before.hex() + digest.hex() + after.hex()).encode()).digest()
    return digest


class Tree:
    """Up and down over trees whose nodes are (tree, position) -> (number of nodes, digest, what else a node carries)."""

    def __init__(self, sc, height: int, most: int):
        self.sc, self.height, self.width = sc, height, ARITY**height
        #: Nodes of the largest tree, and of all trees, at each superstep.
        self.most, self.steps = most, []

    def _parts(self, count: int) -> int:
        return max(1, min(-(-count // HELD), 1 << 20), min(default_parts(SparkSession.active()), -(-count // 1000)))

    def climb(self, nodes: RDD, count: int) -> list[RDD]:
        """The done trees (tree, digest) of each superstep."""
        height, width, done = self.height, self.width, []

        def to_vertex(item):
            (tree, at), (n, digest, more) = item
            return (tree, at // width), (at % width, n, digest, more)

        def forward(item):
            (tree, at), children = item
            rows = sorted((c[:3] for c in children), key=lambda c: c[0])
            n = rows[0][1]
            if [r[0] for r in rows] != list(range(min(width, n - at * width))):
                raise ValueError(f"vertex {tree}, {at} has not all of its children")
            return (tree, at), (_after(n, height), _levels([r[2] for r in rows], n, height)[-1][0], None)

        most, spread = self.most, _spread
        while True:
            parts = self._parts(count)
            sent = nodes.map(to_vertex).partitionBy(parts, spread)
            formed = sent.groupByKey(parts, spread).map(forward, preservesPartitioning=True)
            formed.checkpoint()
            count = formed.count()
            self.steps.append((sent, parts))
            done.append(formed.filter(lambda item: item[1][0] == 1).map(lambda item: (item[0][0], item[1][1])))
            most = _after(most, height)
            if most == 1:
                return done
            nodes = formed.filter(lambda item: item[1][0] > 1)

    def descend(self, starts: list[RDD]) -> RDD:
        """(children, path, what came with it) of the lowest vertices; ``starts[k]``: (tree, (path, more)) of the trees done in superstep k."""
        height, spread, message = self.height, _spread, None

        def received(item):
            key, values = item
            children, path = [], None
            for kind, v in values:
                if kind:
                    path = v
                else:
                    children.append(v)
            rows = sorted(children, key=lambda c: c[0])
            return key, rows, _levels([r[2] for r in rows], rows[0][1], height), path

        def below(item):
            (tree, at), rows, levels, (path, more) = received(item)
            width = ARITY**height
            for k in range(len(rows)):
                yield (tree, at * width + k), (_path(levels, k) + path, more)

        for (sent, parts), own in zip(reversed(self.steps), reversed(starts), strict=True):
            first = own.map(lambda item: ((item[0], 0), item[1]))
            message = (first if message is None else first.union(message)).partitionBy(parts, spread).mapValues(lambda v: (True, v))
            together = sent.mapValues(lambda v: (False, v)).union(message).groupByKey(parts, spread)
            message = together.flatMap(below)
        return together.map(received)


def _numbered(leaves: RDD) -> tuple[RDD, int, int]:
    """((group number, position), (size of group, leaf, (id, claim))) of leaves in order, the number of groups, and the size of the largest."""

    def runs(index: int, rows: Iterator) -> Iterator:
        found, largest, groups = [], 0, 0
        for key, own in groupby(rows, key=lambda r: r[0]):
            n = sum(1 for _ in own)
            found, largest, groups = [*found[:1], (key, n)], max(largest, n), groups + 1
        if found:
            yield index, found[0], found[-1], groups, largest

    # A line for each partition.
    lines = sorted(leaves.mapPartitionsWithIndex(runs).collect(), key=lambda line: line[0])
    # Where a partition's first group goes on from earlier ones: its number, the leaves before, and its full size.
    before, sizes, number, last = {}, {}, -1, ()
    held = 0
    for index, first, final, groups, _ in lines:
        if last != (first[0],):
            number, held = number + 1, 0
        before[index] = (number, held)
        sizes[number] = sizes.get(number, 0) + first[1]
        if groups > 1:
            number, held = number + groups - 1, final[1]
            sizes[number] = final[1]
        else:
            held += first[1]
        last = (final[0],)
    most = max([*sizes.values(), *[line[4] for line in lines]], default=0)

    def number_leaves(index: int, rows: Iterator) -> Iterator:
        if index not in before:
            return
        tree, at = before[index]
        for _, own in groupby(rows, key=lambda r: r[0]):
            run = list(own)
            n = sizes.get(tree, len(run))
            for k, (_, ident, leaf, claim) in enumerate(run):
                yield (tree, at + k), (n, bytes(leaf), (ident, bytes(claim)))
            tree, at = tree + 1, 0

    return leaves.mapPartitionsWithIndex(number_leaves), number + 1, most


def verified(leaves: DataFrame, *, height: int = 4, paths: bool = False) -> DataFrame:
    """Proofs of the leaves (doc_id, source, leaf, claim), digests as hex text: ``SCHEMA``, ``path`` only if asked for.

    ``folded_root`` is what a leaf's path gives with its claim, ``verified`` whether that is the root.
    """
    spark = leaves.sparkSession
    sc = spark.sparkContext
    ship(spark)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))
    rows = leaves.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex("leaf").alias("leaf"), F.unhex("claim").alias("claim"))
    table = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    count = table.count()
    schema = SCHEMA if paths else SCHEMA.rsplit(", path", 1)[0]
    if not count:
        return spark.createDataFrame([], schema)
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("_row")]
    parts = max(-(-count // HELD), min(default_parts(spark), -(-count // 1000)))
    ordered = table.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("source", "doc_id", "leaf", "claim")
    # A group is known by a digest of its name: names may be long.
    in_order = ordered.rdd.map(lambda r: (None if r[0] is None else md5(r[0].encode("utf-8", "surrogatepass")).digest(), r[1], r[2], r[3]))
    in_order.checkpoint()
    nodes, groups, most = _numbered(in_order)

    below = Tree(sc, height, most)
    done = below.climb(nodes, count)
    roots = sc.union([d.map(lambda item, k=k: ((0, item[0]), (groups, item[1], k))) for k, d in enumerate(done)])
    top = Tree(sc, height, groups)
    root = top.climb(roots, groups)[-1].first()[1]
    starts = [sc.parallelize([], 1) for _ in top.steps]
    starts[-1] = sc.parallelize([(0, ((), None))], 1)
    from_top = top.descend(starts)

    def to_groups(item):
        (_, at), rows, levels, (path, _) = item
        width = ARITY**height
        for k, (_, _, digest, step) in enumerate(rows):
            yield step, (at * width + k, (_path(levels, k) + path, digest))

    sent = from_top.flatMap(to_groups)
    lowest = below.descend([sent.filter(lambda item, k=k: item[0] == k).map(lambda item: item[1]) for k in range(len(done))])

    def proofs(item):
        _, rows, levels, (path, subroot) = item
        above = "".join(before.hex() + after.hex() for before, after in path)
        folded = {}
        for k, (_, _, leaf, (ident, claim)) in enumerate(rows):
            own = _path(levels, k)
            here = _fold(claim, own)
            if here not in folded:
                folded[here] = _fold(here, path)
            proof = sha256(("".join(before.hex() + after.hex() for before, after in own) + above).encode()).hexdigest()
            out = (ident, leaf.hex(), subroot.hex(), root.hex(), proof, folded[here].hex(), folded[here] == root)
            yield (*out, [(before.hex(), after.hex()) for before, after in own + path]) if paths else out

    return spark.createDataFrame(lowest.flatMap(proofs), schema)
