"""Extraction of five numbered candidate sections from responses [X17], in SQL functions.

A response is read as bytes: its ISO-8859-1 view has one character for each byte, so that all places are byte offsets
whatever the text holds. One fold over its lines keeps the open fence and collects headings and fenced blocks; sections,
positions and leftovers follow from those two lists.

Headings (up to three spaces, one to six ``#``, a blank or the end) outside fences end a section. ``### Candidate n`` with
n from 1 to 5 opens that of a position; other numbers open one that nobody asked for; any other heading whose first word
is "candidate" makes the positions it names doubtful, or all five. A fence that never closes makes the positions doubtful
that headings within it name, and its own. A doubtful or repeated position is withheld, one without heading is missing.

Defined cases: a null response is empty (five missing positions); bytes that are no UTF-8, or a byte order mark, withhold
all five; of the ends of a line one carriage return before the line feed is dropped, others belong to the line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACES = 5
_HEAD = "struct<start:int,end:int,number:int,doubt:array<int>,title:string,reason:string>"
_BLOCK = "struct<open:int,start:int,end:int,after:int,python:boolean,closed:boolean,info:string>"
_FENCE = "struct<mark:string,width:int,open:int,start:int,python:boolean,info:string>"


def _five() -> Column:
    return F.array(*[F.lit(k) for k in range(1, PLACES + 1)])


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def _blank(x: Column) -> Column:
    return x.rlike(r"^[ \t\r\n]*\z")


def _marked(line: Column) -> Column:
    """A line with all that its text alone decides: what fence it may open or close, what heading it is."""
    text = line["text"]
    exact = F.regexp_extract(text, r"^ {0,3}### Candidate ([0-9]+)[ \t]*\z", 1)
    run = F.regexp_extract(text, "^ {0,3}(`{3,}|~{3,})", 1)
    named = F.filter(F.transform(F.filter(F.regexp_extract_all(text, F.lit("([0-9]+)"), 1), lambda d: F.length(d) <= 2), lambda d: d.cast("int")), lambda k: k.between(1, PLACES))
    return F.struct(
        text.alias("text"),
        line["size"].alias("size"),
        F.substring(run, 1, 1).alias("mark"),
        F.length(run).alias("width"),
        text.rlike("^ {0,3}(`{3,}[^`\\r]*|~{3,}[^\\r]*)\\z").alias("opens"),
        text.rlike("^ {0,3}(`{3,}|~{3,})[ \\t]*\\z").alias("closes"),
        F.lower(F.regexp_extract(text, "^ {0,3}(?:`{3,}|~{3,})[ \\t]*([^\\r]*?)[ \\t]*\\z", 1)).eqNullSafe("python").alias("python"),
        text.rlike("^ {0,3}#{1,6}([ \\t]|\\z)").alias("heads"),
        text.rlike(r"(?i)^ {0,3}#{1,6}[ \t]+candidate(?![0-9A-Za-z_])").alias("mentions"),
        F.when(exact.rlike("^[1-5]\\z"), exact.cast("int")).alias("number"),
        exact.rlike("^(0|[1-9][0-9]*)\\z").alias("plain"),
        F.array_distinct(named).alias("named"),
    )


def _meant(line: Column) -> Column:
    """A marked line with the positions its heading makes doubtful, and why it is not a position's own."""
    doubt = F.when(line["mentions"] & ~line["plain"], F.when(F.size(line["named"]) > 0, line["named"]).otherwise(_five())).otherwise(_none("array<int>"))
    reason = F.when(line["number"].isNotNull(), F.lit(None).cast("string")).when(line["plain"], "unrequested_candidate_heading").when(line["mentions"], "ambiguous_candidate_heading").otherwise("unexpected_heading")
    return F.struct(*[line[c].alias(c) for c in ("text", "size", "mark", "width", "opens", "closes", "python", "heads", "mentions", "number")], doubt.alias("doubt"), reason.alias("reason"))


def _step(acc: Column, line: Column) -> Column:
    start, end, fence = acc["at"], acc["at"] + line["size"], acc["fence"]
    inside = fence["width"] > 0
    opens, heads, heard = ~inside & line["opens"], ~inside & line["heads"], inside & line["mentions"]
    closes = inside & line["closes"] & (line["mark"] == fence["mark"]) & (line["width"] >= fence["width"])
    head = F.struct(start.alias("start"), end.alias("end"), *[line[c].alias(d) for c, d in (("number", "number"), ("doubt", "doubt"), ("text", "title"), ("reason", "reason"))])
    opened = F.struct(line["mark"].alias("mark"), line["width"].alias("width"), start.alias("open"), end.alias("start"), line["python"].alias("python"), line["text"].alias("info"))
    block = F.struct(fence["open"].alias("open"), fence["start"].alias("start"), start.alias("end"), end.alias("after"), fence["python"].alias("python"), F.lit(True).alias("closed"), fence["info"].alias("info"))
    said = F.array_union(acc["named"], F.array_union(line["doubt"], F.array_compact(F.array(line["number"]))))
    return F.struct(
        end.alias("at"),
        F.when(opens, opened).when(closes, _no_fence()).otherwise(fence).alias("fence"),
        F.when(heads, F.concat(acc["heads"], F.array(head))).otherwise(acc["heads"]).alias("heads"),
        F.when(closes, F.concat(acc["blocks"], F.array(block))).otherwise(acc["blocks"]).alias("blocks"),
        F.when(opens | closes, _none("array<int>")).when(heard, said).otherwise(acc["named"]).alias("named"),
        (~opens & ~closes & (acc["heard"] | heard)).alias("heard"),
    ).cast(_STATE)


_STATE = f"struct<at:int,fence:{_FENCE},heads:array<{_HEAD}>,blocks:array<{_BLOCK}>,named:array<int>,heard:boolean>"


def _no_fence() -> Column:
    return F.struct(F.lit("").alias("mark"), F.lit(0).alias("width"), F.lit(0).alias("open"), F.lit(0).alias("start"), F.lit(False).alias("python"), F.lit("").alias("info"))


def _folded(lines: Column, start: Column) -> Column:
    """``_step`` over all lines, in stretches of about the root of their number: each appends to lists of its own, so that
    no list is copied for every line."""
    other = ("at", "fence", "named", "heard")

    def stretch(acc: Column, own: Column) -> Column:
        begin = F.struct(*[acc[c].alias(c) if c in other else _none(kind).alias(c) for c, kind in (("at", ""), ("fence", ""), ("heads", f"array<{_HEAD}>"), ("blocks", f"array<{_BLOCK}>"), ("named", ""), ("heard", ""))]).cast(_STATE)
        joined = lambda x: F.struct(*[(x[c] if c in other else F.concat(acc[c], x[c])).alias(c) for c in ("at", "fence", "heads", "blocks", "named", "heard")]).cast(_STATE)
        return _let(F.aggregate(own, begin, _step), joined)

    size = F.greatest(F.ceil(F.sqrt(F.size(lines))), F.lit(1)).cast("int")
    stretches = lambda n: F.transform(F.sequence(F.lit(1), F.size(lines), n), lambda k: F.slice(lines, k, n))
    return F.aggregate(_let(size, stretches), start, stretch)


def _utf8(x: Column) -> Column:
    return F.decode(F.encode(x, "ISO-8859-1"), "UTF-8")


def _sections(raw: Column, read: Column) -> Column:
    """The preamble and the section of each heading, with its blocks; a fence left open ends with the response."""
    total = F.length(raw)
    left = read["fence"]["width"] > 0
    last = F.struct(read["fence"]["open"].alias("open"), read["fence"]["start"].alias("start"), total.alias("end"), total.alias("after"), read["fence"]["python"].alias("python"), F.lit(False).alias("closed"), read["fence"]["info"].alias("info"))
    blocks = F.when(left, F.concat(read["blocks"], F.array(last))).otherwise(read["blocks"]).cast(f"array<{_BLOCK}>")
    preamble = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(None).cast("int").alias("number"), _none("array<int>").alias("doubt"), F.lit(None).cast("string").alias("title"), F.lit("response_preamble").alias("reason"))
    heads = F.concat(F.array(preamble).cast(f"array<{_HEAD}>"), read["heads"])

    def section(head: Column, k: Column, heads: Column, blocks: Column, opens: Column) -> Column:
        final = k == F.size(read["heads"])
        end = F.when(final, total).otherwise(F.get(heads, k + 1)["start"])
        unsure = final & left & read["heard"]
        doubt = F.when(unsure, F.array_union(F.array_union(head["doubt"], read["named"]), F.array_compact(F.array(head["number"])))).otherwise(head["doubt"])
        first = _before(opens, head["end"])
        # Whether there are none, one or several is all that is asked of them.
        own = F.slice(blocks, first + 1, F.least(_before(opens, end) - first, F.lit(2)))
        return F.struct(head["end"].alias("start"), end.alias("end"), head["number"].alias("number"), doubt.alias("doubt"), head["title"].alias("title"), head["reason"].alias("reason"), unsure.alias("unsure"), own.alias("blocks"))

    with_opens = lambda h, b: _let(F.transform(b, lambda x: x["open"]), lambda o: F.transform(h, lambda head, k: section(head, k, h, b, o)))
    return _let(heads, lambda h: _let(blocks, lambda b: with_opens(h, b)))


def _before(opens: Column, place: Column) -> Column:
    """How many of the ascending numbers are below a place, by bisection."""
    steps = F.array(*[F.lit(1 << k) for k in range(24, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= F.size(opens)) & (F.get(opens, at + step - 1) < place), at + step).otherwise(at))


_POSITION = "struct<position:int,selection:string,heading:string,fence:string,start:int,end:int,status:string,limitations:array<string>>"


def _part(raw: Column, start: Column, end: Column) -> Column:
    return F.substring(raw, start + 1, end - start)


def _read_section(raw: Column, s: Column) -> Column:
    """A section with what it would give its position: the one Python block, or all of it."""
    b = F.get(s["blocks"], F.lit(0))
    single = F.size(s["blocks"]) == 1
    chosen = single & b["python"]
    prose = ~_blank(_part(raw, s["start"], b["open"])) | ~_blank(_part(raw, b["after"], s["end"]))
    return F.struct(
        *[s[c].alias(c) for c in ("start", "end", "number", "doubt", "title", "reason", "unsure")],
        F.when(chosen, b["start"]).otherwise(s["start"]).alias("from"),
        F.when(chosen, b["end"]).otherwise(s["end"]).alias("to"),
        F.when(single, b["info"]).alias("fence"),
        F.when(chosen, F.when(b["closed"], "complete").otherwise("truncated")).otherwise("failed").alias("status"),
        F.array(
            F.when(F.size(s["blocks"]) == 0, "missing_code_fence").when(~single, "multiple_code_fences").when(~b["python"], "non_python_code_fence"),
            F.when(chosen & ~b["closed"], "unclosed_final_code_fence"),
            F.when(chosen & prose, "prose_outside_code_fence"),
        ).alias("limits"),
    )


def _position(raw: Column, sections: Column, doubtful: Column, k: Column) -> Column:
    own = F.filter(sections, lambda s: s["number"] == k)
    no, nothing = F.lit(None).cast("int"), F.lit(None).cast("string")
    row = lambda *x: F.struct(k, *x).cast(_POSITION)
    empty = lambda s: F.when(_hollow(_part(raw, s["from"], s["to"])), "empty_candidate_body")
    found = F.transform(own, lambda s: row(F.lit("selected"), _utf8(s["title"]), _utf8(s["fence"]), s["from"], s["to"], s["status"], F.array_compact(F.concat(s["limits"], F.array(empty(s))))))
    return (
        F.when(F.array_contains(doubtful, k), row(F.lit("withheld"), nothing, nothing, no, no, F.lit("unknown"), F.array(F.lit("ambiguous_position"))))
        .otherwise(F.coalesce(F.get(found, F.lit(0)), row(F.lit("missing"), nothing, nothing, no, no, F.lit("unknown"), F.array(F.lit("candidate_not_emitted")))))
    )


def _hollow(x: Column) -> Column:
    return x.rlike("^[ \\t\\r\\n\\x0B\\f]*\\z")


def _let(value: Column, body) -> Column:
    """``body(v)`` with ``v`` computed once for each row: a lambda's variable, which the optimiser cannot copy into its uses."""
    return F.transform(F.array(value), body)[0]


def receipts(responses: DataFrame, text: str = "text") -> DataFrame:
    """The other columns beside ``positions`` (five), ``extras`` (material of no position), ``order_established`` and ``group_complete``."""
    keep = [F.col(f"`{c}`") for c in responses.columns if c != text]
    string = F.coalesce(F.col(text).cast("string"), F.lit(""))
    raw = F.col("_raw")
    rows = responses.select(*keep, F.when(~F.is_valid_utf8(string), "invalid_utf8").when(string.startswith("\ufeff"), "utf8_bom_not_supported").alias("_problem"), F.decode(string.cast("binary"), "ISO-8859-1").alias("_raw"))
    problem = F.col("_problem")

    def marked(pieces: Column) -> Column:
        final = F.size(pieces) - 1
        lines = F.transform(pieces, lambda x, k: F.when(k < final, F.struct(F.regexp_replace(x, "\\r\\z", "").alias("text"), (F.length(x) + 1).alias("size"))).otherwise(F.struct(x.alias("text"), F.length(x).alias("size"))))
        return F.transform(F.transform(lines, _marked), _meant)

    start = F.struct(F.lit(0).alias("at"), _no_fence().alias("fence"), _none(f"array<{_HEAD}>").alias("heads"), _none(f"array<{_BLOCK}>").alias("blocks"), _none("array<int>").alias("named"), F.lit(False).alias("heard")).cast(_STATE)

    def told(sections: Column, numbers: Column, doubtful: Column) -> Column:
        withheld = F.transform(_five(), lambda k: F.struct(k, F.lit("withheld"), F.lit(None), F.lit(None), F.lit(None), F.lit(None), F.lit("unknown"), F.array(problem)).cast(_POSITION))
        positions = F.when(problem.isNotNull(), withheld).otherwise(F.transform(_five(), lambda k: _position(raw, sections, doubtful, k)))
        empty = lambda s: s["title"].isNull() & _hollow(_part(raw, s["start"], s["end"]))
        reason = lambda s: F.when(s["unsure"], "unclosed_fence_heading_ambiguity").when(F.array_contains(doubtful, s["number"]), "ambiguous_position_occurrence").otherwise(s["reason"])
        left = F.filter(sections, lambda s: reason(s).isNotNull() & ~empty(s))
        extras = F.transform(left, lambda s: F.struct(_utf8(s["title"]).alias("heading"), s["start"].alias("start"), s["end"].alias("end"), reason(s).alias("reason")))
        fine = problem.isNull()
        ordered = fine & (F.size(doubtful) == 0) & (numbers == F.array_sort(F.array_distinct(numbers)))

        def out(places: Column, more: Column) -> Column:
            clean = F.forall(places, lambda p: (p["status"] == "complete") & (F.size(p["limitations"]) == 0)) & (F.size(more) == 0)
            return F.struct(places.alias("positions"), F.when(fine, more).otherwise(F.slice(more, 1, 0)).alias("extras"), ordered.alias("order_established"), (ordered & clean).alias("group_complete"))

        return _let(positions, lambda places: _let(extras, lambda more: out(places, more)))

    def judged(sections: Column, numbers: Column) -> Column:
        times = lambda k: F.size(F.filter(numbers, lambda n: n == k))
        repeated = F.array_compact(F.array(*[F.when(times(k) > 1, k) for k in range(1, PLACES + 1)]))
        return _let(F.array_distinct(F.concat(F.flatten(F.transform(sections, lambda s: s["doubt"])), repeated)), lambda doubtful: told(sections, numbers, doubtful))

    def read(state: Column) -> Column:
        sections = F.transform(_sections(raw, state), lambda s: _read_section(raw, s))
        return _let(sections, lambda x: _let(F.array_compact(F.transform(x, lambda s: s["number"])), lambda numbers: judged(x, numbers)))

    whole = _let(F.split(raw, "\n", -1), lambda pieces: _let(marked(pieces), lambda lines: _let(_folded(lines, start), read)))
    return rows.withColumn("_told", whole).select(*keep, *[F.col(f"_told.{c}").alias(c) for c in ("positions", "extras", "order_established", "group_complete")])


def extract_responses(responses: DataFrame, text: str = "text") -> DataFrame:
    """Five rows for each response: the other columns beside position, selection, byte range, status, limitations."""
    keep = [F.col(f"`{c}`") for c in responses.columns if c != text]
    return receipts(responses, text).select(*keep, F.inline("positions")).select(*keep, "position", "selection", "start", "end", "status", "limitations")
