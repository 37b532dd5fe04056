"""Lexical units and padded trigrams: runs of underscores, letters and numbers, other visible characters one by one.

Categories are those of Unicode 15.1, which the Python runtime must have; white space is the property of 25 code points.
"""

from __future__ import annotations

import hashlib
import unicodedata
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNICODE = "15.1.0"
#: The White_Space property (fixed values).
WHITE_SPACE = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
_BLANK = {chr(c) for a, b in WHITE_SPACE for c in range(a, b + 1)}


@lru_cache(maxsize=1 << 16)
def _kind(char: str) -> int:
    """2: part of a run, 1: a unit of its own, 0: white space."""
    if char == "_" or unicodedata.category(char)[0] in "LN":
        return 2
    return 0 if char in _BLANK else 1


def lexical_units(text: str) -> list[str]:
    """Units of a text whose line ends are unified."""
    units, run = [], []
    for char in text.replace("\r\n", "\n").replace("\r", "\n"):
        kind = _kind(char)
        if kind == 2:
            run.append(char)
            continue
        if run:
            units.append("".join(run))
            run = []
        if kind:
            units.append(char)
    return units + ["".join(run)] if run else units


def trigrams(units: list[str]) -> set[tuple]:
    """Distinct triples of the units between two boundary marks; the marks differ from any unit by kind."""
    marked = [("boundary", "begin"), *(("text", u) for u in units), ("boundary", "end")]
    return set(zip(marked, marked[1:], marked[2:], strict=False))


def trigram_hash(t: tuple) -> int:
    return int.from_bytes(hashlib.blake2b(repr(t).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


_TOKENIZED = T.StructType([
    T.StructField("status", T.StringType()), T.StructField("reasons", T.ArrayType(T.StringType())), T.StructField("n_units", T.IntegerType()),
    T.StructField("units", T.ArrayType(T.StringType())), T.StructField("trigrams", T.ArrayType(T.LongType())),
])


def tokens(t: str | bytes | None) -> tuple:
    """status, reasons, n_units, units, trigram hashes of a text or of UTF-8 bytes: eligible, ineligible (bad UTF-8, empty, white space only) or unavailable."""
    if unicodedata.unidata_version != UNICODE:
        return ("unavailable", ["host_unicode_category_version_mismatch"], None, [], [])
    if isinstance(t, bytes | bytearray):
        try:
            t = bytes(t).decode()
        except UnicodeDecodeError:
            return ("ineligible", ["invalid_utf8"], None, [], [])
    if t is None or t == "":
        return ("ineligible", ["empty_emitted_text"], 0, [], [])
    units = lexical_units(t)
    return ("eligible", [], len(units), units, sorted(map(trigram_hash, trigrams(units)))) if units else ("ineligible", ["whitespace_only_text"], 0, [], [])


@F.pandas_udf(_TOKENIZED)
def tokenized(texts: pd.Series) -> pd.DataFrame:
    """Tokenization of each text."""
    return pd.DataFrame([tokens(t) for t in texts], columns=["status", "reasons", "n_units", "units", "trigrams"])


#: Characters of the texts whose tokens a task holds at a time, about; a longer text is alone.
PIECE = 200_000


def tokenized_rows(rows: DataFrame, key: str, text: str, parts: tuple[str, ...]) -> DataFrame:
    """key, tok of each row: ``tok`` holds those ``parts`` of the tokenization that are asked for, and ``n_trigrams`` if so.

    Tokens of some texts at a time become Arrow arrays and leave the task, so that its memory is that of a piece and not
    of a batch; parts that nobody asked for are never kept.
    """
    types = {f.name: f.dataType for f in _TOKENIZED.fields} | {"n_trigrams": T.IntegerType()}
    tok = T.StructType([T.StructField(p, types[p]) for p in parts])
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("tok", tok)])
    names = [f.name for f in _TOKENIZED.fields]
    arrow = pa.struct([(p, {"status": pa.string(), "reasons": pa.list_(pa.string()), "n_units": pa.int32(), "units": pa.list_(pa.string()), "trigrams": pa.list_(pa.int64()), "n_trigrams": pa.int32()}[p]) for p in parts])

    def run(batches):
        for batch in batches:
            start, held, size = 0, [], 0
            for n in range(batch.num_rows):
                t = batch.column(1)[n].as_py()
                found = dict(zip(names, tokens(t), strict=True))
                found["n_trigrams"] = len(found["trigrams"])
                held.append({p: found[p] for p in parts})
                size += len(t or "")
                if size >= PIECE or n + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n + 1 - start), pa.array(held, arrow)], names=[key, "tok"])
                    start, held, size = n + 1, [], 0

    return rows.select(key, text).mapInArrow(run, schema)
