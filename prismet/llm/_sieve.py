"""Joins of whole texts with a table of few keys, in which only likely rows are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismet.llm._stage import stage

#: Bits of a bitmap at most, 8 MB as words; it has 16 bits for each key before.
BITS = 1 << 26


class Sieve:
    """Which rows may have a key of ``keys``: their bits in a map that is broadcast as words, a bounded table.

    Beyond ``BITS`` / 16 keys the map lets more rows through. The join that follows decides in any case.
    """

    def __init__(self, keys: DataFrame, columns: list[str]):
        held = stage(keys.select(*columns).distinct(), "keys")
        self.bits = min(BITS, 1 << max(16, (16 * held.count() - 1).bit_length()))
        at, bit = self._at([F.col(c) for c in columns])
        self.words = stage(held.select(F.shiftright(at, 6).alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_set")), "words")

    def _at(self, columns: list[Column]) -> tuple[Column, Column]:
        at = F.pmod(F.xxhash64(*columns), F.lit(self.bits).cast("long"))
        return at, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))

    def split(self, rows: DataFrame, columns: list[Column]) -> tuple[DataFrame, DataFrame]:
        """(rows that may have a key, rows that have none); no shuffle. ``columns`` have the types of the keys."""
        at, bit = self._at(columns)
        held = (F.shiftright(at, 6) == F.col("_word")) & (F.col("_set").bitwiseAND(bit) != 0)
        words = F.broadcast(self.words)
        return rows.join(words, held, "left_semi"), rows.join(words, held, "left_anti")
