"""Canonical JSON, fingerprints, and strict parsing: duplicate keys, lost number spellings and bad Unicode are rejected."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Number(str):
    """A JSON number that is not a plain integer, as it was spelled."""


class InputProblem(ValueError):
    pass


def _pairs(items):
    out = {}
    for k, v in items:
        if k in out:
            raise InputProblem("duplicate_json_key")
        out[k] = v
    return out


def _constant(_):
    raise InputProblem("non_finite_number")


def _depth(x, left: int) -> None:
    if left < 0:
        raise InputProblem("json_depth_exceeded")
    for v in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
        _depth(v, left - 1)


def _unpaired(x) -> bool:
    if isinstance(x, str):
        return bool(re.search("[\ud800-\udfff]", x))
    if isinstance(x, dict):
        return any(_unpaired(k) or _unpaired(v) for k, v in x.items())
    return isinstance(x, list) and any(map(_unpaired, x))


def parse_strict(data: bytes, depth: int = 64):
    """The value of UTF-8 JSON bytes without a mark; fractions and exponents stay ``Number`` strings."""
    if data.startswith(b"\xef\xbb\xbf"):
        raise InputProblem("utf8_bom_not_supported")
    try:
        text = data.decode()
    except UnicodeDecodeError as e:
        raise InputProblem("invalid_utf8") from e
    try:
        value = json.loads(text, object_pairs_hook=_pairs, parse_float=Number, parse_constant=_constant)
    except InputProblem:
        raise
    except (ValueError, RecursionError) as e:
        raise InputProblem("invalid_json") from e
    _depth(value, depth)
    if _unpaired(value):
        raise InputProblem("unpaired_surrogate")
    return value


def canonical_bytes(value) -> bytes:
    """Sorted keys, ASCII, no spaces, one line feed at the end."""
    return json.dumps(value, sort_keys=True, ensure_ascii=True, separators=(",", ":"), allow_nan=False).encode() + b"\n"


def digest(value) -> str:
    return hashlib.sha256(canonical_bytes(value)).hexdigest()


def fingerprint(tag: str, value) -> str:
    """A digest within a domain; number spellings count."""
    return hashlib.sha256(tag.encode() + b"\0" + canonical_bytes(value)).hexdigest()


@F.pandas_udf(T.StringType())
def json_problem(lines: pd.Series) -> pd.Series:
    """Why a line is not strict JSON, or null."""

    def one(x):
        try:
            parse_strict(x if isinstance(x, bytes) else (x or "").encode("utf-8", "surrogatepass"))
            return None
        except InputProblem as e:
            return str(e)

    return lines.map(one)


@F.pandas_udf(T.StringType())
def json_digest(lines: pd.Series) -> pd.Series:
    """Digest of the canonical form of JSON text; null if it is not strict."""

    def one(x):
        try:
            return digest(parse_strict((x or "").encode()))
        except InputProblem:
            return None

    return lines.map(one)
