"""Byte-level BPE with the tiktoken library and a local rank file.

Long texts are encoded in pieces cut at safe boundaries, places where the pre-splitting pattern always ends a match, so
that the ids are those of the whole text. Long runs of white space and of one kind of character, on which the library's
own pattern engine overflows its stack, are cut by their meaning in the pattern.

Nulls and empty texts have no ids. Repeated rows are encoded each. Ids decode through raw bytes.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismet.llm._stage import map_arrow

#: Texts of up to so many characters are encoded in one call.
WHOLE = 1 << 16
#: White space runs longer than this never reach the pattern engine in one piece.
RUN = 2000
#: White_Space as the pattern's engine has it; Python's own \s also takes four control characters.
_BLANK = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
_SPACES = re.compile(_BLANK + "{%d,}" % RUN)
#: A letter or digit, a space or line feed, a letter: the pattern ends a match before that white space, whatever follows.
_SAFE = re.compile(r"(?<=[A-Za-z0-9])(?= [A-Za-z])")


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _pieces(text: str):
    """Parts of a text whose ids, joined, are those of the text, none of them much longer than ``WHOLE``."""
    at, n = 0, len(text)
    while n - at > WHOLE:
        m = _SAFE.search(text, at + WHOLE // 2)
        to = m.start() if m else n
        yield text[at:to]
        at = to
    yield text[at:]


def encode(enc: tiktoken.Encoding, text: str) -> list[int]:
    """Ids of a text, as ``encode_ordinary`` gives them, for texts of any length."""
    if len(text) <= RUN:
        return enc.encode_ordinary(text)
    out: list[int] = []
    for piece in [text] if len(text) <= WHOLE else _pieces(text):
        at = 0
        for m in _SPACES.finditer(piece):
            # Before a non-space the run without its last character is one match; at the end of the text the whole run is.
            stop = m.end() if m.end() == len(piece) else m.end() - 1
            out += enc.encode_ordinary(piece[at : m.start()])
            out += enc._encode_single_piece(piece[m.start() : stop])
            at = stop
        out += enc.encode_ordinary(piece[at:])
    return out


def decode(enc: tiktoken.Encoding, ids: list[int]) -> bytes:
    """The raw bytes of ids; a sequence cut inside a character still decodes."""
    return enc.decode_bytes(ids)


def tokenize(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, ids (array<int>) of each row; with ``digests`` instead n_tokens, ids_sha256 and decoded_sha256. No shuffle."""

    def run(batches):
        enc = encoding(ranks_path, pattern)
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                ids = [encode(enc, t or "") for t in part.column(1).to_pylist()]
                if digests:
                    cols = [pa.array(map(len, ids), pa.int64()), pa.array([sha256(" ".join(map(str, x)).encode()).hexdigest() for x in ids], pa.string()), pa.array([sha256(decode(enc, x)).hexdigest() for x in ids], pa.string())]
                else:
                    cols = [pa.array(ids, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "ids"]
    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>"
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(src, run, kinds)


def detokenize(rows: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, bytes: the raw bytes of each row's ids; null ids give no bytes."""

    def run(batches):
        enc = encoding(ranks_path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(enc, x or []) for x in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return map_arrow(rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")), run, "doc_id long, bytes binary")
