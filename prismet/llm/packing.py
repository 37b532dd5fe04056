"""Shortest-pack-first packing over the length histogram.

Documents become token ids, cut into pieces of at most ``size``. Only the histogram of piece lengths, at most ``size``
numbers, is planned: lengths go longest first into the packs with the most room left, and packs of equal filling count
as one pattern. Each piece has a rank among those of its length; intervals of ranks lead to patterns, and so to a
sequence and an offset, without a join.

Nulls: a null text is empty; it still has the closing id. Repeated rows are packed each; pieces of one length that tie
in id, start and content are alike and take neighbouring ranks in any order. An empty table packs nothing. Very long texts
are cut into pieces of ``size`` ids. Columns beside id and text do not matter, whatever their names.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismet.llm._stage import map_arrow, stage
from prismet.llm._text import LOWER, Words, hash_words, slices, utf8

SIZE = 4096
#: Words kept with their ids, about 20 bytes each; when full, the table starts anew.
_WORDS = 2_000_000
_BREAK = np.ones(256, bool)
_BREAK[[0x20, 0x0A]] = False
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_TAIL = np.zeros(256, bool)
_TAIL[list(b".,")] = True


class WordIds:
    """Ids of words by the hash of their bytes: sorted keys, and where their ids stand in one array."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.count, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def add(self, keys: np.ndarray, words: list[str]) -> None:
        """Encode words that are not held yet; ``keys`` ascend."""
        ids = []
        for k in range(0, len(words), 4096):
            ids += [e.ids for e in self.tokenizer.encode_batch_fast(words[k : k + 4096], add_special_tokens=False)]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        at = len(self.flat) + np.cumsum(count) - count
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(count.sum()))])
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.count = np.insert(self.keys, place, keys), np.insert(self.at, place, at), np.insert(self.count, place, count)


@lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def encode_slice(path: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a slice of texts and where each text's ids start.

    The tokenizer drops white space and never merges across it, so each distinct word is encoded once and texts are put
    together from their words. Words of ASCII alone count in lower case, as the tokenizer has them, but for those with a
    bar, which may be special tokens. A full stop or comma after a word's last letter is a word of its own, where the
    tokenizer's own splitting parts it as well.
    """
    held = _word_ids(path)
    w = Words(data, offsets, _BREAK)
    starts, ends = w.starts, w.ends
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    plain = np.concatenate([[0], np.cumsum((data >= 0x80) | (data == 0x7C))])
    raw = np.repeat(plain[ends] > plain[starts], ends - starts)
    own = data[w.inside]
    own = np.where(raw, own, LOWER[own])
    cut = np.flatnonzero((ends - starts > 1) & _TAIL[data[ends - 1]] & _LETTER[data[np.maximum(ends - 2, 0)]])
    rows = w.rows + np.searchsorted(cut, w.rows)
    ends_cut = ends.copy()
    ends_cut[cut] -= 1
    starts, ends = np.insert(starts, cut + 1, ends_cut[cut]), np.insert(ends_cut, cut + 1, ends[cut])
    lengths = ends - starts
    keys, first, which = np.unique(hash_words(own, lengths), return_index=True, return_inverse=True)
    if len(held.keys) + len(keys) > _WORDS:
        held.clear()
    place = np.searchsorted(held.keys, keys)
    new = np.ones(len(keys), bool)
    if len(held.keys):
        new = held.keys[np.minimum(place, len(held.keys) - 1)] != keys
    if new.any():
        to = np.cumsum(lengths)
        whole = own.tobytes()
        held.add(keys[new], [whole[to[k] - lengths[k] : to[k]].decode("utf-8", "replace") for k in first[new].tolist()])
        place = np.searchsorted(held.keys, keys)
    count, at = held.count[place][which], held.at[place][which]
    to = np.cumsum(count)
    ids = held.flat[np.arange(to[-1]) - np.repeat(to - count - at, count)]
    return ids, np.concatenate([[0], to])[rows]


def _pieces(path: str, closing: int, size: int):
    def run(batches):
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        end = np.array([closing], "<u4").tobytes()
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            docs = batch.column(0).to_pylist()
            for i, j in slices(offsets):
                ids, begins = encode_slice(path, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                raw, begins = ids.astype("<u4").tobytes(), begins.tolist()
                rows = []
                for doc, a, b in zip(docs[i:j], begins, begins[1:], strict=False):
                    own, n = raw[4 * a : 4 * b] + end, b - a + 1
                    rows += [(doc, s, min(size, n - s), zlib.crc32(own[4 * s : 4 * (s + size)]), n) for s in range(0, n, size)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    return run


def pieces(docs: DataFrame, tokenizer_path: str, *, closing: int = 2, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: the pieces of each document's ids. No shuffle."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(src, _pieces(tokenizer_path, closing, size), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (how many, lengths): shortest-pack-first over a histogram of lengths.

    Lengths are placed longest first. A length goes to the packs with the most room, as many at once as both sides have;
    where none has room for it, new packs open.
    """
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = {size: []}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            widest = max((r for r, packs in room.items() if packs and r >= length), default=None)
            if widest is None:
                room.setdefault(size - length, []).append((left, (length,)))
                break
            count, lengths = room[widest].pop()
            if not room[widest]:
                del room[widest]
            take = min(count, left)
            if count > take:
                room.setdefault(widest, []).append((count - take, lengths))
            room.setdefault(widest - length, []).append((take, (*lengths, length)))
            left -= take
    return [p for r in sorted(room) for p in room[r]]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """Intervals of (length, rank), ascending: the sequence of the first rank, and the offset that all of them have."""
    length, count, first, offset = [], [], [], []
    sequence = 0
    for n, lengths in patterns:
        at = 0
        for x in lengths:
            length.append(x)
            count.append(n)
            first.append(sequence)
            offset.append(at)
            at += x
        sequence += n
    order = np.argsort(length, kind="stable")
    out = {k: np.array(v, np.int64)[order] for k, v in (("length", length), ("count", count), ("sequence", first), ("offset", offset))}
    total = np.cumsum(out["count"]) - out["count"]
    new = np.concatenate([[True], out["length"][1:] != out["length"][:-1]]) if len(order) else np.zeros(0, bool)
    out["rank"] = total - np.repeat(total[new], np.diff([*np.flatnonzero(new), len(order)])) if len(order) else total
    return out


def ranked(rows: DataFrame, histogram: dict[int, int], *, most: int = 100_000) -> DataFrame:
    """rows with ``_rank``, gapless from 0 within each length. A length is numbered in parts of about ``most`` rows.

    The number of parts is joined from the histogram, at most one row for each length, so the plan does not grow with it.
    """
    spark = rows.sparkSession
    parts = spark.createDataFrame([(int(n), -(-int(c) // most)) for n, c in histogram.items()], "length long, _parts long")
    rows = rows.join(F.broadcast(parts), "length").withColumn("_part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("_parts"))).drop("_parts")
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n")).select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = Window.partitionBy("length", "_part").orderBy("doc_id", "start", "ids_crc32")
    # The window has dealt the rows by (length, part) already: this join moves the counts only.
    out = rows.withColumn("_row", F.row_number().over(own)).join(firsts, ["length", "_part"])
    return out.withColumn("_rank", F.col("_first") + F.col("_row") - 1).drop("_part", "_row", "_first")


def pack(rows: DataFrame, size: int = SIZE, *, most: int = 100_000) -> DataFrame:
    """rows (doc_id, start, length, ...) with sequence_id and offset. ``rows`` should be a written table: it is read twice."""
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = slots(plan(histogram, size))
    # Gaps between lengths are wider than any rank, so that one search finds the interval.
    wide = 1 << 40
    key = table["length"] * wide + table["rank"]
    fields = rows.schema.fieldNames()

    def place(batches):
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            at = np.searchsorted(key, n * wide + rank, "right") - 1
            cols = [batch.column(c) for c in fields]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(table["sequence"][at] + rank - table["rank"][at]), pa.array(table["offset"][at])], [*fields, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return map_arrow(ranked(rows, histogram, most=most).select(*fields, "_rank"), place, f"{schema}, sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """The pieces of ``docs`` with their sequences and offsets."""
    return pack(stage(pieces(docs, tokenizer_path, **options), "pieces"), options.get("size", SIZE))
