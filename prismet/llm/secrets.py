"""Secret scans with corpus-wide ownership frequency.

``scan`` finds candidate spans in whole texts. ``ownership`` counts, for the hash of each candidate value, the distinct
repositories and owners that hold it. ``verdicts`` then tells values that many owners or very many repositories have
copied (examples from documentation, test fixtures) from values that belong to few of both and look alive. The fixed kinds (assign, access,
hex) are always reported; the further kinds only where the value is live.

Defined cases. A null text is empty; a null owner or repository counts as one owner or repository of its own name.
Repeated rows do not raise the counts of distinct owners. An empty table gives an empty result. Very long texts are
scanned whole. Ties: spans of one start are ordered by kind. Columns beside id, text, owner and repository do not matter;
``redacted`` passes them on, whatever their names. Values are hashed in the scan and never leave it in the clear.

A value in a third of all texts is no hot key: counts sum on the map side, and spans meet their counts under one of
``SALTS`` salts.
"""

from __future__ import annotations

import re
from hashlib import md5, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismet.llm._sieve import Sieve
from prismet.llm._stage import map_arrow, stage
from prismet.llm._text import Words, slices, utf8


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN = re.compile("(" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key") + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{16,}")
_HEX_BYTES = np.zeros(256, bool)
_HEX_BYTES[list(b"0123456789abcdef")] = True
#: Kinds the method adds: name, bytes that any match holds, pattern (group 1: the value).
FURTHER = [
    ("bearer", b"earer ", re.compile(r"\b[Bb]earer\x20+([A-Za-z0-9+/_.=~-]{20,})")),
    ("forge", b"gh", re.compile(r"\b(gh[pousr]_[A-Za-z0-9]{36,})")),
    ("chat", b"xox", re.compile(r"\b(xox[abprs]-[A-Za-z0-9-]{10,})")),
    ("cloud", b"AIza", re.compile(r"\b(AIza[0-9A-Za-z_-]{35})")),
    # A run is looked through from its first character only, and only if two more follow it behind dots.
    ("jwt", b"eyJ", re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]++\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8})[A-Za-z0-9_-]*?\b(?P<whole>eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)")),
    ("pem", b"PRIVATE KEY-----", re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----([A-Za-z0-9+/=\s]{40,}?)-----END")),
    ("login", b"://", re.compile(r"://[A-Za-z0-9._-]{1,64}:([^\s:@/]{8,128})@")),
]
KINDS = ["assign", "access", "hex", *[name for name, _, _ in FURTHER]]
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_DUMMY = re.compile(r"(?i)example|sample|dummy|changeme|placeholder|your[_-]|xxxx|(.)\1{7}|0123456789|abcdefgh")


def looks_alive(value: str) -> bool:
    """Not a placeholder: no dummy word, and enough different characters."""
    return len(set(value)) >= 6 and not _DUMMY.search(value)


def find(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind index, value) of all candidates of a text, by start, then kind."""
    out = [(m.start(), m.end(), 0, m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), m.end(), 1, m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), m.end(), 2, m[0]) for m in _HEX.finditer(text)]
    raw = text.encode("utf-8", "surrogatepass")
    for k, (_, gate, pattern) in enumerate(FURTHER, 3):
        if gate in raw:
            place = "whole" if pattern.groupindex else 0
            out += [(m.start(place), m.end(place), k, m[1]) for m in pattern.finditer(text)]
    return sorted(out, key=lambda x: (x[0], x[2], x[1]))


#: Spans of one value are dealt over so many keys before they are joined with the value's counts.
SALTS = 32

_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value_hash", pa.string()), ("alive", pa.bool_())]))
SCHEMA = "doc_id long, owner string, repo string, text_key string, spans array<struct<kind:string,start:int,end:int,value_hash:string,alive:boolean>>"


def _scan(batches):
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        keys, spans = [], []
        for i, j in slices(offsets):
            d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            runs = Words(d, o, _HEX_BYTES)
            long = np.flatnonzero(runs.ends - runs.starts >= 16)
            hexed = set((np.searchsorted(o, runs.starts[long], "right") - 1).tolist())
            raw = d.tobytes()
            low = raw.lower()
            for r, (a, b) in enumerate(zip(o[:-1].tolist(), o[1:].tolist(), strict=True)):
                if r in hexed or any(low.find(x, a, b) >= 0 for x in _WORDS) or raw.find(b"AKIA", a, b) >= 0 or any(raw.find(g, a, b) >= 0 for _, g, _ in FURTHER):
                    got = find(raw[a:b].decode())
                    keys.append(md5(raw[a:b]).hexdigest() if got else "")
                    spans.append([{"kind": KINDS[k], "start": s, "end": e, "value_hash": sha256(v.encode()).hexdigest(), "alive": looks_alive(v)} for s, e, k, v in got])
                else:
                    keys.append("")
                    spans.append([])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(keys, pa.string()), pa.array(spans, _SPAN)], ["doc_id", "owner", "repo", "text_key", "spans"])


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """Candidates of each row. ``repo_col`` defaults to the document itself. No shuffle."""
    repo = F.col(repo_col or id_col).cast("string")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), F.coalesce(repo, F.lit("")).alias("repo"))
    return map_arrow(src, _scan, SCHEMA)


def ownership(scanned: DataFrame) -> DataFrame:
    """value_hash, n_owners, n_repos: three aggregations with map-side sums, so a value in a third of all rows is no hot key."""
    each = scanned.select("owner", "repo", F.explode("spans").alias("s")).select(F.col("s.value_hash").alias("value_hash"), "owner", "repo")
    each = each.groupBy("value_hash", "owner", "repo").agg(F.lit(1).alias("_one"))
    return each.groupBy("value_hash", "owner").agg(F.count("*").alias("_repos")).groupBy("value_hash").agg(F.count("*").alias("n_owners"), F.sum("_repos").alias("n_repos"))


def verdicts(scanned: DataFrame, *, max_owners: int = 3, max_repos: int = 100) -> DataFrame:
    """doc_id, text_key, live array<span>: the spans of each text with candidates whose value is alive and has at most ``max_owners`` owners and ``max_repos`` repositories.

    One row for each (doc_id, text_key); rows without candidates are absent.
    """
    held = ownership(scanned).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = scanned.where(F.size("spans") > 0).select("doc_id", "text_key", "spans").dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", F.explode("spans").alias("s")).withColumns({"value_hash": F.col("s.value_hash"), "_salt": F.pmod(F.hash("doc_id", "text_key"), F.lit(SALTS))})
    each = each.join(held, ["value_hash", "_salt"]).withColumn("live", F.col("s.alive") & (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos))
    return each.groupBy("doc_id", "text_key").agg(F.collect_list(F.when(F.col("live"), F.col("s"))).alias("live"), F.max("n_owners").alias("max_owners"), F.max("n_repos").alias("max_repos"), F.sum(F.col("live").cast("int")).alias("n_live"))


def report(scanned: DataFrame, *, max_owners: int = 3, max_repos: int = 100) -> DataFrame:
    """scanned with ``live`` spans (empty where none), ``n_live``, ``max_owners`` and ``max_repos``."""
    v = verdicts(scanned, max_owners=max_owners, max_repos=max_repos).withColumnRenamed("doc_id", "_id").withColumnRenamed("text_key", "_key")
    out = scanned.join(v, scanned["doc_id"].eqNullSafe(v["_id"]) & (scanned["text_key"] == v["_key"]), "left").drop("_id", "_key")
    empty = F.array().cast(dict(scanned.dtypes)["spans"])
    return out.withColumns({"live": F.coalesce("live", empty), "n_live": F.coalesce("n_live", F.lit(0)), "max_owners": F.coalesce("max_owners", F.lit(0)), "max_repos": F.coalesce("max_repos", F.lit(0))})


def joined(spans) -> F.Column:
    """kind:start:end of spans by start, then kind, comma-joined."""
    order = F.array(*[F.lit(k) for k in KINDS])
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), F.array_position(order, s["kind"]).alias("k"), s["end"].alias("e"), s["kind"].alias("n"))))
    return F.array_join(F.transform(ranked, lambda s: F.concat_ws(":", s["n"], s["a"], s["e"])), ",")


def redact(text, live, mask: str = "[REDACTED]"):
    """The text with its live spans replaced; overlapping spans become one."""
    spans = F.array_sort(F.transform(live, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("e"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        fresh = s["a"] >= acc["at"]
        cut = F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(s["a"] - acc["at"], F.lit(0))), F.lit(mask))
        return F.struct(F.greatest(acc["at"], s["e"]).alias("at"), F.when(fresh, cut).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, start, step)
    return F.when(F.size(live) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def redacted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", max_owners: int = 3, max_repos: int = 100) -> DataFrame:
    """``docs``, all columns, with live values cut out of the text."""
    found = stage(scan(docs, id_col=id_col, text_col=text_col, owner_col=owner_col).where(F.size("spans") > 0), "candidates")
    # Written first, so that the join with the texts knows its true size and moves no text where it is small.
    live = stage(verdicts(found, max_owners=max_owners, max_repos=max_repos).where("n_live > 0").select(F.col("doc_id").alias("_found"), "text_key", "live"), "live")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    likely, free = Sieve(live, ["_found", "text_key"]).split(rows, [F.col("_id"), F.md5("_text")])
    out = likely.join(live, F.col("_id").eqNullSafe(F.col("_found")) & (F.md5("_text") == F.col("text_key")), "left")
    new = F.when(F.col("live").isNull(), F.col("_text")).otherwise(redact(F.col("_text"), F.col("live")))
    whole = lambda text: [text.alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in docs.columns]
    return free.select(*whole(F.col("_text"))).unionByName(out.select(*whole(new)))
