"""Quality rules: document statistics and learned decision lists.

``text_statistics`` measures each whole text. ``learn_rules`` is sequential covering in the manner of IREP/RIPPER: it
grows a conjunction of thresholds on one part of the labelled rows, prunes it on the other, keeps it if it is precise
enough, removes what it covers and goes on. ``rules_column`` turns the ordered list into one Spark conditional
expression, so that applying it is a projection without Python.

Nulls: a null text has no words and fails the base rule. Empty tables give empty results. Repeated rows are judged each.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismet.llm._stage import map_arrow
from prismet.llm._text import SPACED, Words, grams, mix, slices, sums, utf8

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_CONT = (np.arange(256) & 0xC0) == 0x80
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, dtype=np.int64)
_DIGIT[48:58] = 1
_BANG = np.zeros(256, dtype=np.int64)
_BANG[list(b"!?")] = 1
_STOP = np.zeros(256, dtype=np.int64)
_STOP[list(b".,;:")] = 1

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_bang", "n_stops", "n_distinct_words"]
#: What rules may test: name -> SQL over the counts. Nothing here depends on labels, language, source or id.
FEATURES = {
    "words": "n_words",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "bangs": "n_bang / greatest(n_words, 1)",
    "stops": "n_stops / greatest(n_words, 1)",
    "distinct": "n_distinct_words / greatest(n_words, 1)",
}


def _statistics(batches):
    """Batches of (anything, text) become (anything, counts)."""
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        parts: list[list[np.ndarray]] = [[] for _ in COUNTS]
        for i, j in slices(offsets):
            d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            w = Words(d, o, SPACED)
            h = w.hashes()
            row = np.repeat(np.arange(j - i), w.counts)
            salt = mix(row.astype(np.uint64) + np.uint64(77))
            inside = np.zeros(len(h), bool)
            if len(h) >= 3:
                g = grams(h, 3) ^ salt[:-2]
                valid = row[:-2] == row[2:]
                at = np.flatnonzero(valid)
                order = at[np.argsort(g[at], kind="stable")]
                same = g[order[1:]] == g[order[:-1]]
                twice = np.zeros(len(order), bool)
                twice[1:] |= same
                twice[:-1] |= same
                hit = order[twice]
                for k in range(3):
                    inside[hit + k] = True
            hs = np.sort(h ^ salt) if len(h) else h
            new = np.ones(len(hs), bool)
            new[1:] = hs[1:] != hs[:-1]
            # Sorting loses the row of a word; distinct words by row are counted from row-salted first places.
            first = np.zeros(len(h), np.int64)
            if len(h):
                first[np.argsort(h ^ salt, kind="stable")[new]] = 1
            raw = d.tobytes()
            dup, lines = [], []
            for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True):
                own = [x for x in raw[a:b].split(b"\n") if x.strip()]
                lines.append(len(own))
                dup.append(len(own) - len(set(own)))
            cols = [w.counts, sums(w.inside & ~_CONT[d], o), sums(_SYMBOL[d], o), np.array(dup), sums(inside, w.rows), np.array(lines), sums(_UPPER[d], o), sums(_DIGIT[d], o), sums(_BANG[d], o), sums(_STOP[d], o), sums(first, w.rows)]
            for p, c in zip(parts, cols, strict=True):
                p.append(np.asarray(c, np.int64))
        arrays = [pa.array(np.concatenate(p) if p else np.zeros(0, np.int64)) for p in parts]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [batch.schema.names[0], *COUNTS])


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts (``COUNTS``) for each row of ``docs``; no shuffle."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(src, _statistics, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    """The fixed rule: too short, or more than half of its words in repeated 3-word windows."""
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


@dataclass(frozen=True)
class Rule:
    """All of ``tests`` (feature, '<=' or '>', threshold) hold: the document is rejected, with the precision seen when pruned."""

    tests: tuple[tuple[str, str, float], ...]
    precision: float

    def column(self) -> Column:
        return F.expr(" AND ".join(f"({FEATURES[f]}) {op} {t!r}D" for f, op, t in self.tests))

    def __str__(self) -> str:
        return " and ".join(f"{f} {op} {t:.6g}" for f, op, t in self.tests)


def _covered(x: dict[str, np.ndarray], tests) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for f, op, t in tests:
        out &= x[f] <= t if op == "<=" else x[f] > t
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> list[tuple[str, str, float]]:
    """Add the test of largest information gain until no good row is covered."""
    tests: list[tuple[str, str, float]] = []
    inside = np.ones(len(bad), bool)
    while len(tests) < most and inside.any() and not bad[inside].all():
        p, n = bad[inside].sum(), inside.sum()
        if not p:
            break
        best = (1e-9, None)
        for f, v in x.items():
            own, y = v[inside], bad[inside]
            order = np.argsort(own, kind="stable")
            s, cum = own[order], np.cumsum(y[order])
            cut = np.flatnonzero(s[1:] > s[:-1])
            for op, pos, cnt in (("<=", cum[cut], cut + 1), (">", p - cum[cut], n - cut - 1)):
                gain = pos * (np.log2((pos + 1e-9) / cnt) - np.log2(p / n))
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (float(gain[k]), (f, op, float((s[cut[k]] + s[cut[k] + 1]) / 2)))
        if best[1] is None:
            break
        tests.append(best[1])
        inside = _covered(x, tests)
    return tests


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, *, max_rules: int = 12, max_tests: int = 4, min_precision: float = 0.9, min_cover: int = 5, seed: int = 5) -> list[Rule]:
    """An ordered list of rules that find the rows marked ``bad``.

    Two thirds of the remaining rows grow a rule, the others prune it (the worth of a rule is (p - n) / (p + n)). A rule
    counts only if it covers ``min_cover`` rows of all and keeps ``min_precision`` on growing and pruning rows alike.
    """
    part = np.random.default_rng(seed).random(len(bad)) < 2 / 3
    left, rules, misses = np.ones(len(bad), bool), [], 0
    while len(rules) < max_rules and misses < 4 and bad[left].any():
        grow, prune = left & part, left & ~part
        tests = _grow({f: v[grow] for f, v in x.items()}, bad[grow], max_tests)
        if not tests:
            break
        worth = []
        for k in range(1, len(tests) + 1):
            c = prune & _covered(x, tests[:k])
            worth.append((bad[c].sum() - (~bad[c]).sum()) / max(c.sum(), 1))
        tests = tests[: int(np.argmax(worth)) + 1]
        c = left & _covered(x, tests)
        precise = [bad[c & s].mean() if (c & s).any() else 0.0 for s in (part, ~part)]
        if c.sum() >= min_cover and min(precise) >= min_precision:
            rules.append(Rule(tuple(tests), float(bad[c].mean())))
            left &= ~c
        else:
            misses += 1
            left &= ~(c & part)  # other rows seed the next attempt
    return rules


def chosen_labels(labels: DataFrame, bound: int) -> DataFrame:
    """doc_id, quality of at most ``bound`` labelled documents, those of the least hash of their id."""
    own = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    return own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def labelled_features(stats: DataFrame, labels: DataFrame, *, bound: int = 20000) -> DataFrame:
    """Different features of at most ``bound`` labelled rows that pass the fixed rule; labels join on ids alone.

    Rows of one id may be many: equal ones count once, and of the rest those of the least hash are taken.
    """
    rows = stats.where(~base_failed()).join(chosen_labels(labels, bound), "doc_id").select("quality", *[F.expr(e).cast("double").alias(f) for f, e in FEATURES.items()]).distinct()
    return rows.orderBy(F.xxhash64(*rows.columns), *rows.columns).limit(bound)


def fit_rules(stats: DataFrame, labels: DataFrame, *, bound: int = 20000, **options) -> list[Rule]:
    """Learn rejecting rules from a bounded sample (``bound`` rows) of labelled statistics; no labels, no rules."""
    rows = labelled_features(stats, labels, bound=bound).toPandas()
    rows = rows.sort_values(list(rows.columns)).drop_duplicates()
    if rows.empty:
        return []
    return learn_rules({f: rows[f].to_numpy() for f in FEATURES}, rows["quality"].to_numpy() == 0, **options)


def rules_column(rules: list[Rule]) -> Column:
    """The number (from 1) of the first rule that holds, null if none does."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule.column(), F.lit(k)).otherwise(out)
    return out


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Statistics with ``base_failed``, ``rule`` (which one rejected) and ``kept``."""
    return stats.withColumns({"base_failed": base_failed(), "rule": rules_column(rules)}).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_good(docs: DataFrame, labels: DataFrame, *, bound: int = 20000, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that the fixed rule and the learned rules keep.

    The labelled sample is measured on its own (its ids, at most ``bound``, are broadcast); then one pass without a
    shuffle measures and judges every row, so that no text moves.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sample = own.join(F.broadcast(chosen_labels(labels, bound).select("doc_id")), "doc_id")
    rules = fit_rules(text_statistics(sample), labels, bound=bound, **options)
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["row"].dataType.simpleString()
    stats = map_arrow(src, _statistics, f"row {kind}, " + ", ".join(f"{c} long" for c in COUNTS))
    return judge(stats, rules).where("kept").select("row.*")


def rules_json(rules: list[Rule]) -> str:
    return json.dumps([{"tests": r.tests, "precision": r.precision} for r in rules])
