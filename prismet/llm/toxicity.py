"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the hashes of lower-cased words, of neighbouring pairs and of pairs with one word between, each once a text.
FTRL-proximal keeps a learning rate for each coordinate and sets weights inside the L1 ball to exactly zero, so the model
is a short table of hashes and weights whatever the vocabulary. It is fitted in one task, on at most ``bound`` labelled
rows (of both labels; those with the least hash of their id) of at most ``bound_bytes`` together; every whole text is
scored.

Nulls and empty texts have no features and get the score of the intercept. Rows with a null label or id teach nothing;
without labelled rows of both kinds every score is 0.0. Repeated rows are scored each.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismet.llm._stage import map_arrow, stage
from prismet.llm._text import ALNUM, LOWER, Words, grams, mix, slices, utf8

_U = np.uint64
_FILTER = 1 << 20


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, feature hash) of unigrams, bigrams and skip-grams of a slice of texts, in reading order."""
    w = Words(LOWER[data], offsets, ALNUM)
    h = w.hashes()
    row = np.repeat(np.arange(len(offsets) - 1), w.counts)
    out = [(row, h)]
    if len(h) > 1:
        ok = row[1:] == row[:-1]
        out.append((row[1:][ok], grams(h, 2)[ok]))
    if len(h) > 2:
        ok = row[2:] == row[:-2]
        out.append((row[2:][ok], mix((h[:-2] * _U(0xD6E8FEB86659FD93)) ^ (h[2:] + _U(0xA0761D6478BD642F)))[ok]))
    return out


@dataclass(frozen=True)
class Model:
    """Hashes in ascending order, their weights, and the intercept."""

    keys: np.ndarray
    weights: np.ndarray
    intercept: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        total = np.full(n, self.intercept)
        if len(self.keys):
            near = np.zeros(_FILTER, bool)
            near[(self.keys & _U(_FILTER - 1)).astype(np.int64)] = True
            for row, h in features(data, offsets):
                at = np.flatnonzero(near[(h & _U(_FILTER - 1)).astype(np.int64)])
                place = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
                hit = self.keys[place] == h[at]
                pairs = np.unique(np.stack([row[at[hit]], place[hit]]), axis=1)
                np.add.at(total, pairs[0], self.weights[pairs[1]])
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(rows: list[np.ndarray], y: np.ndarray, *, alpha: float = 5.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.0, epochs: int = 20, min_rows: int = 3) -> Model:
    """FTRL-proximal on the distinct feature hashes of each row. Features in fewer than ``min_rows`` rows are left out."""
    flat = np.concatenate(rows) if rows else np.zeros(0, _U)
    keys, count = np.unique(flat, return_counts=True)
    keys = keys[count >= min_rows]
    own = []
    for r in rows:
        at = np.searchsorted(keys, r)
        at = at[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == r)] if len(keys) else at[:0]
        own.append(np.append(at, len(keys)))  # the last coordinate is the intercept
    z, n = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)
    shrink = np.full(len(keys) + 1, l1)
    shrink[-1] = 0.0

    def weight(at):
        pull = z[at] - np.sign(z[at]) * shrink[at]
        return np.where(np.abs(z[at]) <= shrink[at], 0.0, -pull / ((beta + np.sqrt(n[at])) / alpha + l2))

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for k in rng.permutation(len(own)).tolist():
            at = own[k]
            w = weight(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y[k]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weight(np.arange(len(keys) + 1))
    used = np.flatnonzero(w[:-1])
    return Model(keys[used], w[used], float(w[-1]))


def _learner(options: dict):
    def run(batches):
        rows, labels, ids = [], [], []
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            labels += batch.column(2).to_pylist()
            ids += batch.column(0).to_pylist()
            for i, j in slices(offsets):
                found = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                row, h = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(row, kind="stable")
                cuts = np.searchsorted(row[order], np.arange(1, j - i))
                rows += [np.unique(x) for x in np.split(h[order], cuts)]
        order = np.lexsort((labels, ids))  # the order of arrival does not change the model
        y = np.array(labels, float)[order]
        if len(set(labels)) == 2:
            m = fit([rows[k] for k in order.tolist()], y, **options)
            held = io.BytesIO()
            np.savez(held, keys=m.keys, weights=m.weights, intercept=m.intercept)
            yield pa.RecordBatch.from_arrays([pa.array([held.getvalue()], pa.binary())], ["model"])

    return run


def train(docs: DataFrame, labels: DataFrame, *, allowed: Column | None = None, bound: int = 9000, bound_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> Model | None:
    """Fit on at most ``bound`` labelled rows, up to a third of them of label 1; ``allowed`` restricts the labels' rows.

    Whole texts, in the order of the hash of their ids, up to ``bound_bytes`` in all; a text that would fill more than a
    64th of that alone is left out of the sample, so that no single one displaces the others.
    """
    own = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id IS NOT NULL AND _y IN (0, 1)")
    if allowed is not None:
        own = own.where(allowed)
    own = own.groupBy("_id").agg(F.max("_y").alias("_y"))
    few = bound // 3
    pick = lambda y, n: own.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(n)
    chosen = pick(1, few).union(pick(0, bound - few))
    # At most ``bound`` ids and labels are broadcast.
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(chosen), "_id")
    # Sizes are summed over rows of numbers, at most ``bound`` of them, before any text of the sample moves; equal rows of
    # one id count once. The sample alone, bounded in rows and bytes, goes to the one task that learns.
    key, size = F.xxhash64("_text"), F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long")
    order = [F.xxhash64("_id"), F.col("_id"), F.col("_key")]
    sizes = texts.select("_id", key.alias("_key"), size.alias("_size")).where(F.col("_size") * 64 <= bound_bytes).distinct().orderBy(*order).limit(bound)
    within = stage(sizes.withColumn("_sum", F.sum("_size").over(Window.orderBy(*order))).where(F.col("_sum") <= bound_bytes).select("_id", "_key"), "sample")
    sample = texts.withColumn("_key", key).join(F.broadcast(within), ["_id", "_key"]).dropDuplicates(["_id", "_key"])
    got = map_arrow(sample.select("_id", "_text", "_y").coalesce(1), _learner(options), "model binary").collect()
    if not got:
        return None
    with np.load(io.BytesIO(bytes(got[0]["model"]))) as m:
        return Model(m["keys"], m["weights"], float(m["intercept"]))


def scored(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every whole text. No shuffle; the model travels in the closure (a few kilobytes)."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            parts = [np.zeros(j - i) if model is None else model.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0))], ["doc_id", "score"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(src, run, "doc_id long, score double")
