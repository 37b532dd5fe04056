"""Personal data by candidate gradient boosting, in DataFrame functions only.

Four fixed kinds have exact checks and are always reported. Beside them, generators of high recall propose spans, which
overlap each other and the fixed ones: addresses with any sign or word for "at", groups of digits with any marks between,
and long numbers. Boosted trees weigh the format of a proposal and the words and characters around it. They learn from the
tables themselves: a proposal that covers verified data of a fixed kind is a positive, any other a negative, and nothing
that a fixed kind is defined by alone (the plus of a phone number, the sign of an address) is a feature. So the score of a
proposal beyond the fixed kinds says how much it looks like verified data. Each generator has a threshold, the least score
above which ``precision`` of the proposals of a held-out fold cover verified data; without one it adds nothing.

Learning sees all proposals of all rows, as counts of distinct feature vectors that stay in a table: for each level of a
tree Spark sums gradients by open node, feature and value, and these sums, a few hundred whatever the rows, are what the
driver cuts by; held-out proposals reach it as counts by generator and step of the score. Positions come from the pieces between matches, and sums over them in blocks, so work
grows with the text's length and the matches' number to the power 1.5 at most; patterns never scan a run of characters
from each of its characters again.

Defined cases. A null text is empty. Repeated rows are scanned each. An empty table has no rows and no model. Texts are
scanned whole, whatever their length. Ties: spans of one kind never overlap; proposals of one start are ordered by end.
Columns beside id and text do not matter, whatever their names; ``redacted`` passes them on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismet.llm._ranges import let
from prismet.llm._stage import stage
from prismet.session import TASK_ROWS

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Kinds with exact checks: what a text with a match holds, and the pattern. Runs are entered at their first character or
#: where the last match has ended.
BASE = {
    "email": (lambda t: F.contains(t, F.lit("@")), rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++"),
    "ip": (lambda t: t.rlike(r"[0-9]\.[0-9]"), r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (lambda t: t.rlike("[0-9][ -]?[0-9]"), "[0-9](?:[ -]?[0-9])++"),
    "phone": (lambda t: F.contains(t, F.lit("+")), r"\+[0-9][ ().0-9-]+[0-9]"),
}
_AT = r"(?:@|\x20?\(at\)\x20?|\x20?\[at\]\x20?|\x20at\x20)"
_DOT = r"(?:\.|\x20?\(dot\)\x20?|\x20?\[dot\]\x20?|\x20dot\x20)"
#: Generators of proposals.
PROPOSED = {
    "address": (lambda t: t.rlike("@|[( \\[]at[) \\]]"), rf"(?<!{_LOCAL})[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++)*+{_AT}{_HOST}++(?:{_DOT}{_HOST}++)++"),
    "number": (lambda t: t.rlike("[0-9]"), r"(?<![0-9A-Za-z])\(?[0-9]++(?:[ ()./-]{1,2}[0-9]++)++"),
    "account": (lambda t: t.rlike("[0-9]{4}"), r"(?<![0-9A-Za-z])[0-9]{4}(?:[ -]?[0-9])++(?![0-9A-Za-z])"),
}
KINDS = [*BASE, *PROPOSED]
#: Characters of context before and after a proposal that features read.
BEFORE, AFTER = 32, 16
_CONTACT = r"(?i)\b(mail|e-?mail|contact|phone|tel|call|fax|mobile|card|visa|account|iban|host|server|address|ip)\b"
_MACHINE = r"(?i)(token|secret|key|passw|hash|sha|uuid|version|build|id|ref|isbn|order|invoice|no\.)[\"']?\s*[:=#]?\s*[\"']?$"

#: Features of a proposal, small whole numbers: expressions over its text ``s``, what stands before (``b``) and after (``a``).
FEATURES = {
    "digits": lambda s, b, a: F.least(F.length(F.regexp_replace(s, "[^0-9]", "")), F.lit(24)),
    "length": lambda s, b, a: F.least(F.length(s), F.lit(60)),
    "groups": lambda s, b, a: F.least(F.size(F.split(s, "[^0-9]+")), F.lit(9)),
    "last": lambda s, b, a: F.least(F.length(F.regexp_extract(s, "([A-Za-z0-9]*)$", 1)), F.lit(20)),
    "letters_last": lambda s, b, a: s.rlike("[A-Za-z]{2,}$").cast("int"),
    "dots": lambda s, b, a: F.least(F.length(F.regexp_replace(s, "[^.]", "")), F.lit(6)),
    "marks": lambda s, b, a: F.contains(s, F.lit("(")).cast("int") + 2 * F.contains(s, F.lit("-")).cast("int") + 4 * F.contains(s, F.lit(" ")).cast("int") + 8 * F.contains(s, F.lit("/")).cast("int"),
    "checksum": lambda s, b, a: luhn(F.regexp_replace(s, "[^0-9]", "")).cast("int"),
    "edge_before": lambda s, b, a: _edge(F.right(F.regexp_replace(b, r"\+$", ""), F.lit(1))),
    "edge_after": lambda s, b, a: _edge(F.left(a, F.lit(1))),
    "contact": lambda s, b, a: b.rlike(_CONTACT).cast("int"),
    "machine": lambda s, b, a: b.rlike(_MACHINE).cast("int"),
}


def _edge(c: Column) -> Column:
    """What kind of character stands at the edge: none or space, letter, digit, quote or assignment, other mark."""
    return F.when(c.rlike(r"^\s*$"), 0).when(c.rlike(r"^\p{L}"), 1).when(c.rlike("^[0-9]"), 2).when(c.rlike("^[\"'=:<>]"), 3).otherwise(4)


def luhn(digits: Column) -> Column:
    """Whether a string of 12 to 19 digits passes the checksum; others do not."""
    doubled = lambda v, k: F.when(k % 2 == 0, v).when(v > 4, 2 * v - 9).otherwise(2 * v)
    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), lambda c, k: doubled(c.cast("int"), k)), F.lit(0), lambda t, v: t + v)
    return F.when(F.length(digits).between(12, 19), total % 10 == 0).otherwise(F.lit(False))


def running(values: Column, merge, zero: Column) -> Column:
    """Inclusive running values of an array under an associative ``merge``, by blocks of about the root of its size."""
    kind = "array<bigint>"

    def plain(items):
        start = F.struct(zero.cast("bigint").alias("t"), F.array().cast(kind).alias("o"))
        grow = lambda acc, x: let(merge(acc["t"], x), lambda t: F.struct(t.alias("t"), F.concat(acc["o"], F.array(t)).alias("o")))
        return F.aggregate(items, start, grow)["o"]

    def blocked(v):
        k = F.ceil(F.sqrt(F.size(v))).cast("int")
        cut = lambda size: F.transform(F.sequence(F.lit(1), F.size(v), size), lambda s: F.slice(v, s, size))
        whole = lambda blocks: F.transform(blocks, lambda b: F.aggregate(b, zero.cast("bigint"), lambda x, y: merge(x, y)))
        joined = lambda blocks, upto: F.flatten(F.transform(blocks, lambda b, i: F.transform(plain(b), lambda x: F.when(i > 0, merge(F.get(upto, i - 1), x)).otherwise(x))))
        return let(k, lambda size: let(cut(size), lambda blocks: let(plain(whole(blocks)), lambda upto: joined(blocks, upto))))

    return F.when(F.size(values) == 0, F.array().cast(kind)).otherwise(let(values, blocked))


_MATCH = "array<struct<start:bigint,end:bigint,text:string,before:string,after:string>>"


def matches(text: Column, gate: Column, pattern: str) -> Column:
    """All leftmost matches with their places (code points, end exclusive) and surroundings back to the match before.

    The pieces between the matches give the places: each is read once.
    """

    def placed(pieces, found):
        ends = running(F.transform(found, lambda m, i: (F.length(m) + F.length(F.get(pieces, i))).cast("bigint")), lambda x, y: x + y, F.lit(0))
        one = lambda m, i, e: F.struct((F.get(e, i) - F.length(m)).alias("start"), F.get(e, i).alias("end"), m.alias("text"), F.right(F.get(pieces, i), F.lit(BEFORE)).alias("before"), F.left(F.get(pieces, i + 1), F.lit(AFTER)).alias("after"))
        return let(ends, lambda e: F.transform(found, lambda m, i: one(m, i, e)))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    out = let(F.split(text, pattern, -1), lambda pieces: let(found, lambda m: placed(pieces, m)))
    return F.when(gate, out).otherwise(F.array().cast(_MATCH))


def holds(kind: str, found: Column) -> Column:
    """The exact check of a fixed kind on the text of a match."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return found.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(digits)
    return F.length(digits).between(8, 15) if kind == "phone" else F.lit(True)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, base spans by kind, and ``proposed``: spans with features and whether they cover base spans. No shuffle."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_text"))
    place = lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))
    t = F.col("_text")
    checked = lambda k, found: F.transform(F.filter(found, lambda m: holds(k, m["text"])), place)
    base = {k: checked(k, matches(t, gate(t), pattern)) for k, (gate, pattern) in BASE.items()}
    fields = lambda m: {f: e(m["text"], m["before"], m["after"]) for f, e in FEATURES.items()}
    vector = lambda n, m: F.struct(*[F.coalesce(v.cast("int"), F.lit(0)).alias(f) for f, v in fields(m).items()], F.lit(n).alias("generator"))
    size = lambda m: F.length(F.regexp_replace(m["text"], "[^0-9]", ""))
    wide = {k: matches(t, gate(t), pattern) for k, (gate, pattern) in PROPOSED.items()}
    wide = {k: m if k == "address" else F.filter(m, lambda x: size(x).between(7, 24)) for k, m in wide.items()}
    propose = lambda n, found: F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), vector(n, m).alias("x")))
    proposed = [propose(n, m) for n, m in enumerate(wide.values())]
    out = rows.select("doc_id", F.xxhash64("_text").alias("text_key"), *[v.alias(k) for k, v in base.items()], F.concat(*proposed).alias("_wide"))
    return out.select("doc_id", "text_key", *BASE, _covering(F.concat(*[F.col(k) for k in BASE]), F.col("_wide")).alias("proposed"))


def _covering(base: Column, wide: Column) -> Column:
    """Proposals by start with ``covers``: whether they overlap a base span, by running maxima of ends and, from behind, minima of starts."""
    none = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(None).alias("x")))
    far = F.lit((1 << 62) - 1)

    def marked(spans):
        ends = running(F.transform(spans, lambda s: F.when(s["x"].isNull(), s["end"]).otherwise(F.lit(0).cast("bigint"))), F.greatest, F.lit(0))
        starts = F.reverse(running(F.reverse(F.transform(spans, lambda s: F.when(s["x"].isNull(), s["start"]).otherwise(far))), F.least, far))
        told = lambda s, i, e, b: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["x"].alias("x"), ((F.get(e, i) > s["start"]) | (F.get(b, i) < s["end"])).alias("covers"))
        return let(ends, lambda e: let(starts, lambda b: F.filter(F.transform(spans, lambda s, i: told(s, i, e, b)), lambda s: s["x"].isNotNull())))

    return let(F.array_sort(F.concat(wide, none)), marked)


#: Scores are compared in steps, this many to a unit of log-odds, from minus to plus the largest: a bounded number of them.
STEPS, LARGEST = 256, 16


def _step(score: Column) -> Column:
    return F.greatest(F.least(F.floor(score * STEPS + 0.5), F.lit(LARGEST * STEPS).cast("long")), F.lit(-LARGEST * STEPS).cast("long"))


@dataclass(frozen=True)
class Model:
    """Boosted trees, nested (feature, threshold, low side, high side) or leaf values, the bias, and a step for each generator."""

    trees: tuple
    bias: float
    thresholds: dict[str, float]

    def score(self, x: Column) -> Column:
        """The log-odds of a feature struct, as one expression."""

        def node(tree):
            if isinstance(tree, float):
                return F.lit(tree)
            feature, at, low, high = tree
            return F.when(x[feature] <= at, node(low)).otherwise(node(high))

        out = F.lit(self.bias)
        for tree in self.trees:
            out = out + node(tree)
        return out

    def step(self, x: Column) -> Column:
        """The score in whole steps, in which thresholds are given."""
        return _step(self.score(x))


def _cut(sums: dict[str, tuple[np.ndarray, np.ndarray]], ridge: float):
    """(feature, at, sums of the low side, of the high side) of the best cut by second-order gains, or None; and the sums of the node."""
    total_g, total_h = (v.sum() for v in next(iter(sums.values())))
    best = (1e-6, None)
    for name, (sum_g, sum_h) in sums.items():
        left_g, left_h = np.cumsum(sum_g)[:-1], np.cumsum(sum_h)[:-1]
        gain = left_g**2 / (left_h + ridge) + (total_g - left_g) ** 2 / (total_h - left_h + ridge) - total_g**2 / (total_h + ridge)
        gain[(left_h < 1) | (total_h - left_h < 1)] = 0
        if len(gain) and gain.max() > best[0]:
            at = int(gain.argmax())
            best = (float(gain.max()), (name, at, (left_g[at], left_h[at]), (total_g - left_g[at], total_h - left_h[at])))
    return best[1], (total_g, total_h)


def _replaced(tree, change):
    """The tree with every leaf, a value or the number of an open node, replaced."""
    return (*tree[:2], _replaced(tree[2], change), _replaced(tree[3], change)) if isinstance(tree, tuple) else change(tree)


def _grow(sums, depth: int, rate: float, ridge: float):
    """One tree, level by level; ``sums(tree)`` gives, by open node of the tree, the gradients' sums by feature and value."""
    leaf = lambda g, h: float(-rate * g / (h + ridge))
    tree, last = 0, 0
    for level in range(1, max(depth, 1) + 1):
        found = {node: _cut(by, ridge) for node, by in sums(_replaced(tree, lambda v: -1 if isinstance(v, float) else v)).items()}

        def side(g, h, deep=level):
            nonlocal last
            last += 1
            return leaf(g, h) if deep == depth else last

        def grown(v):
            if isinstance(v, float):
                return v
            best, total = found[v]
            return leaf(*total) if best is None or not depth else (*best[:2], side(*best[2]), side(*best[3]))

        tree = _replaced(tree, grown)
        if not any(isinstance(v, int) for v in _leaves(tree)):
            break
    return tree


def _leaves(tree) -> list:
    return [*_leaves(tree[2]), *_leaves(tree[3])] if isinstance(tree, tuple) else [tree]


def _sql(tree) -> str:
    """A tree as SQL over columns named as the features."""
    return f"CASE WHEN `{tree[0]}` <= {tree[1]} THEN {_sql(tree[2])} ELSE {_sql(tree[3])} END" if isinstance(tree, tuple) else f"{tree!r}D" if isinstance(tree, float) else str(tree)


def _value(tree, x: dict[str, np.ndarray]) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(next(iter(x.values()))), tree)
    return np.where(x[tree[0]] <= tree[1], _value(tree[2], x), _value(tree[3], x))


def _bias(positive: float, total: float) -> float:
    share = min(max(positive / total, 1e-4), 1 - 1e-4)
    return float(np.log(share / (1 - share)))


#: Gradients are summed in whole parts of this many to one, so no order of rows changes a sum, and no sum a tree.
UNIT = 1 << 20


def boost(x: dict[str, np.ndarray], positive: np.ndarray, weight: np.ndarray, *, rounds: int = 30, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> tuple[tuple, float]:
    """(trees, bias): Newton boosting of the log loss on weighted feature vectors."""
    bias = _bias((positive * weight).sum(), weight.sum())
    score, trees = np.full(len(weight), bias), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (np.floor(p * UNIT + 0.5) - positive * UNIT) / UNIT, weight * np.floor(p * (1 - p) * UNIT + 0.5) / UNIT

        def sums(tree, g=g, h=h):
            node = _value(tree, x)
            return {k: {f: (np.bincount(v[m], g[m]), np.bincount(v[m], h[m])) for f, v in x.items()} for k in np.unique(node[node >= 0]).tolist() for m in [node == k]}

        trees.append(_grow(sums, depth, rate, ridge))
        score = score + _value(trees[-1], x)
    return tuple(trees), bias


def boost_rows(rows: DataFrame, names: list[str], *, rounds: int = 30, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> tuple[tuple, float]:
    """``boost`` over a written table of ``names``, covers and n (how often): the same trees from sums that Spark makes.

    Features are small whole numbers, so the sums of a level have at most a row for each open node and value of a feature.
    Tasks are as many as the rows need: where one does, nothing is shuffled.
    """
    n, right, vectors = rows.agg(F.sum("n"), F.sum(F.col("covers").cast("long") * F.col("n")), F.count(F.lit(1))).first()
    rows = rows.coalesce(-(-vectors // TASK_ROWS))
    bias = _bias(float(right), float(n))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(f"`{f}`").alias("v")) for k, f in enumerate(names)])).alias("e")
    trees = []

    def sums(tree):
        p = F.expr(f"1 / (1 + exp(-({_score_sql(trees, bias)})))")
        known = rows.select(*[f"`{f}`" for f in names], "covers", "n", F.expr(_sql(tree)).alias("_node"), p.alias("_p")).where("_node >= 0")
        unit = lambda c: F.floor(c * UNIT + 0.5)
        g, h = F.col("n") * (unit(F.col("_p")) - F.col("covers").cast("long") * UNIT), F.col("n") * unit(F.col("_p") * (1 - F.col("_p")))
        out: dict = {}
        for r in known.select("_node", each, g.alias("g"), h.alias("h")).groupBy("_node", "e.f", "e.v").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            out.setdefault(r["_node"], {}).setdefault(r["f"], []).append((r["v"], r["g"] / UNIT, r["h"] / UNIT))
        dense = lambda cells: tuple(np.bincount([c[0] for c in cells], [c[k] for c in cells]) for k in (1, 2))
        return {node: {f: dense(by[k]) for k, f in enumerate(names)} for node, by in out.items()}

    for _ in range(rounds):
        trees.append(_grow(sums, depth, rate, ridge))
    return tuple(trees), bias


def _score_sql(trees, bias: float) -> str:
    return " + ".join([_sql(bias), *map(_sql, trees)])


def threshold(score: np.ndarray, positive: np.ndarray, weight: np.ndarray, precision: float, least: int) -> float | None:
    """The least score from which on ``precision`` of the weight is positive, with ``least`` positives or more."""
    order = np.lexsort((score,))[::-1]
    s, right, all_ = score[order], np.cumsum((positive * weight)[order]), np.cumsum(weight[order])
    ends = np.append(s[1:] != s[:-1], True) if len(s) else np.zeros(0, bool)
    good = ends & (right >= precision * all_) & (right >= least)
    return float(s[np.flatnonzero(good)[-1]]) if good.any() else None


def train(scanned: DataFrame, *, precision: float = 0.98, least: int = 10, **options) -> Model | None:
    """A model of all proposals in ``scanned`` (a written table), or None where none covers verified data.

    A fifth of the rows, by hash, is held out for the thresholds, which are steps of the score (see ``Model.step``).
    """
    names = [*FEATURES, "generator"]
    each = scanned.select((F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(5)) == 0).alias("held"), F.explode("proposed").alias("p")).select("held", "p.covers", "p.x.*")
    counts = stage(each.groupBy("held", "covers", *names).agg(F.count(F.lit(1)).alias("n")), "vectors")
    fit = counts.where("NOT held")
    if not fit.where("covers").take(1):
        return None
    trees, bias = boost_rows(fit, names, **options)
    steps = counts.where("held").select("generator", "covers", "n", _step(F.expr(_score_sql(trees, bias))).alias("step")).groupBy("generator", "covers", "step").agg(F.sum("n").alias("n")).collect()
    found = {}
    for k, name in enumerate(PROPOSED):
        own = [(r["step"], float(r["covers"]), float(r["n"])) for r in steps if r["generator"] == k]
        t = threshold(*np.array(own).reshape(-1, 3).T, precision, least)
        if t is not None:
            found[name] = t
    return Model(trees, bias, found)


def selected(scanned: DataFrame, model: Model | None) -> DataFrame:
    """scanned with ``added``: proposals above their generator's threshold that cover no fixed span."""
    kinds = F.array(*[F.lit(k) for k in PROPOSED])
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    if model is None or not model.thresholds:
        return scanned.withColumn("added", empty)
    limit = F.array(*[F.lit(float(model.thresholds.get(k, float("inf")))) for k in PROPOSED])
    # Sums are made in the same order as in training, so a score has the same step.
    kept = F.filter("proposed", lambda p: ~p["covers"] & (model.step(p["x"]) >= F.get(limit, p["x"]["generator"])))
    return scanned.withColumn("added", F.transform(kept, lambda p: F.struct(F.get(kinds, p["x"]["generator"]).alias("kind"), p["start"].alias("start"), p["end"].alias("end"))))


def _named(kind: Column, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", kind, s["start"].cast("string"), s["end"].cast("string")))


def joined_base() -> Column:
    """kind:start:end of the base spans by kind, then start, comma-joined."""
    return F.array_join(F.concat(*[_named(F.lit(k), F.col(k)) for k in BASE]), ",")


def joined_all() -> Column:
    """The same of all spans; kinds of generators follow the fixed ones."""
    added = lambda k: _named(F.lit(k), F.filter("added", lambda s: s["kind"] == k))
    return F.array_join(F.concat(*[_named(F.lit(k), F.col(k)) for k in BASE], *[added(k) for k in PROPOSED]), ",")


def redacted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mask: str = "[PII]", **options) -> DataFrame:
    """``docs``, all columns, with all found spans replaced; overlapping ones become one. Null texts stay null."""
    found = stage(scan(docs, id_col=id_col, text_col=text_col), "spans")
    spans = F.concat(*[F.col(k) for k in BASE], F.transform("added", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    hits = selected(found, train(found, **options)).select("doc_id", "text_key", F.array_sort(spans).alias("spans")).where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_key"])
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    text = F.col(text_col).cast("string")
    rows = docs.select(row, F.col(id_col).cast("long").alias("_id"), text.alias("_text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_key"))
    out = rows.join(hits, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_key")), "left")
    new = F.when(F.col("spans").isNull(), F.col("_text")).otherwise(_masked(F.col("_text"), F.col("spans"), mask))
    return out.select(*[new.alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in docs.columns])


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """The text between the spans, and the mask where a span begins that none before reaches. Chunks of 4096 are cut from once each."""
    size = 4096

    def cut(chunks, ordered, ends):
        reach = F.transform(ordered, lambda s, i: F.struct(s["start"].alias("start"), F.get(ends, i).alias("end"), F.when(i > 0, F.get(ends, i - 1) <= s["start"]).otherwise(F.lit(True)).alias("fresh")))

        def one(chunk, c):
            first = c * size
            own = F.filter(reach, lambda s: (s["end"] > first) & (s["start"] < first + size))
            start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

            def step(acc, s):
                a = F.greatest(s["start"] - first, acc["at"].cast("bigint")).cast("int")
                text_before = F.substring(chunk, acc["at"] + 1, a - acc["at"])
                here = s["fresh"] & (s["start"] >= first)
                return F.struct(F.greatest(acc["at"], F.least(s["end"] - first, F.lit(size)).cast("int")).alias("at"), F.concat(acc["out"], text_before, F.when(here, F.lit(mask)).otherwise(F.lit(""))).alias("out"))

            done = F.aggregate(own, start, step)
            return F.concat(done["out"], F.substring(chunk, done["at"] + 1, F.lit(size)))

        return F.array_join(F.transform(chunks, one), "")

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return let(chunks, lambda c: let(running(F.transform(spans, lambda s: s["end"]), F.greatest, F.lit(0)), lambda e: cut(c, spans, e)))
