"""Suffix-array dedup: bytes covered by a ``LENGTH``-byte string that also starts in an earlier document are removed.

Earlier matches come from longest-previous-factor arrays: over suffixes in suffix order, the previous and the next
smaller position (by document) give the longest factor that an earlier document has as well. One suffix array of a
corpus cannot be built in one place, so suffixes first meet by content:

1. Winnowing. Every ``LENGTH``-byte window has an anchor, the least hash among its 16-byte grams, which depends on the
   window alone. Windows in a row with one anchor form a run. Equal windows have equal anchors, so they meet when runs
   are dealt by anchor. Runs travel as packed blobs of numbers (under 6 % of the positions), not as rows.
2. Factors. Within an anchor, equal runs collapse to the one of the least document; in all later ones each window has
   an earlier factor. The map side does so first, so a passage in a third of all documents sends one run a batch. A
   window holds the 17 bytes before its anchor's gram or the 17 bytes after it, so of the collapsed runs only those are
   compared that share the hash of either with another document. Their bytes are fetched, their windows sorted into
   suffix order, and the LPF array over the common prefixes decides each window.
3. Removal. Spans return to their rows and are cut out.

Scale: runs are dealt over one part for each ``_PART`` bytes of text, so a group in memory does not grow with the corpus.
Texts move in joins only and pass through Python in batches. Where many different runs share one anchor (a passage that
many documents embed in surroundings of their own), the anchor would be one group; anchors seen in ``_HOT`` rows of a
1/``_SAMPLE`` sample of the rows, by the hash of their text, are dealt by the whole window instead. The sample decides where
windows meet, never whether they are equal.

Everything is exact: no cap; hashes only decide which runs are compared or equal (80 bits or more).

Defined cases. A null text is empty; texts below ``LENGTH`` bytes are never cut, very long ones are read in overlapping
segments. Rows with a null id are neither earlier nor later than others and stay whole. Rows of one id, equal or not, do
not shorten each other, and each is cut by its own spans (rows are told apart by id and text). An empty table gives an
empty result. ids must be integers; other columns, whatever their names, pass through ``remove_repeats``.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from prismet.llm._sieve import Sieve
from prismet.llm._stage import default_parts, map_arrow, release, ship, stage
from prismet.llm._text import mix, randoms, slices, utf8

LENGTH = 50
GRAM = 16
SPAN = LENGTH - GRAM + 1
#: Bytes on either side of the gram of which every window holds one side.
SIDE = (LENGTH - GRAM) // 2
WIDTH = LENGTH + SPAN - 1
_SEGMENT = (1 << 18) - 64
#: Windows sorted at once, bytes of text read at once, and bytes of text for each part that runs are dealt to.
_STRETCH, _READ, _PART = 1 << 16, 1 << 22, 1 << 22
#: An anchor with different runs in so many rows of the sample is dealt by window; at most so many anchors are.
_HOT, _HOTTEST, _SAMPLE = 64, 1 << 16, 64
_U = np.uint64
_BYTE = randoms(301, 256)
_powers: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, one for each place of a segment."""
    if not _powers:
        base = int(randoms(303, 1)[0])
        for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            table = np.ones(1 << 18, _U)
            for k in range(18):
                n = 1 << k
                table[n : 2 * n] = table[:n] * _U(pow(b, n, 1 << 64))
            _powers[name] = table
    return _powers["up"], _powers["down"]


def _pack(*columns: tuple[np.ndarray, int]) -> bytes:
    """Columns of integers as planes of bytes, low bytes first, so that equal high bytes compress away."""
    out = [np.uint32(len(columns[0][0])).tobytes()]
    for values, width in columns:
        out.append(np.ascontiguousarray(values.astype("<i8" if values.dtype.kind == "i" else "<u8").view(np.uint8).reshape(-1, 8).T[:width]).tobytes())
    return b"".join(out)


def _unpack(blobs: list[bytes], *widths: int) -> list[np.ndarray]:
    """The columns of several blobs; width 8 is signed."""
    parts: list[list[np.ndarray]] = [[] for _ in widths]
    for blob in blobs:
        n, at = int(np.frombuffer(blob, np.uint32, 1)[0]), 4
        for part, width in zip(parts, widths, strict=True):
            planes = np.zeros((n, 8), np.uint8)
            planes[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n).T
            part.append(planes.view(np.int64 if width == 8 else _U).reshape(-1))
            at += n * width
    return [np.concatenate(p) if p else np.zeros(0, np.int64 if w == 8 else _U) for p, w in zip(parts, widths, strict=True)]


#: A run that its row holds several times is sent once, with this bit in its number of windows.
_MANY = 0x80
_RUN = (4, 6, 8, 5, 4, 1, 1, 1)  # anchor, run, document, its text, start, windows less one, sides
_SPANS = (8, 5, 4, 4)  # document, its text, start, end
_ASKED = (8, 5, 4, 1, 4)  # document, its text, start, windows less one, part of the anchor


def _segments(offsets: np.ndarray):
    """(row range, start, end) of stretches of at most ``_SEGMENT`` bytes: whole rows, or parts of a long one that overlap."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + _SEGMENT, "right")) - 1
        if j > i:
            yield i, j, int(offsets[i]), int(offsets[j])
            i = j
            continue
        start, end = int(offsets[i]), int(offsets[i + 1])
        while True:
            stop = min(start + _SEGMENT, end)
            yield i, i + 1, start, stop
            if stop == end:
                break
            start = stop - (LENGTH - 1)
        i += 1


def runs_of(data: np.ndarray, offsets: np.ndarray, hot: np.ndarray | None = None):
    """Row, start (from the row's own), windows less one, anchor, run hash and sides of every run of a batch.

    The runs of ``hot`` anchors (sorted) are single windows, and the window's hash is their anchor.
    """
    up, down = _tables()
    out = []
    for i, j, start, end in _segments(offsets):
        d = data[start:end]
        if len(d) < LENGTH:
            continue
        padded = np.zeros(len(d) + 16, np.uint8)
        padded[: len(d)] = d
        word = np.empty(len(d) + 8, _U)
        for s in range(8):
            part = padded[s : s + (len(padded) - s) // 8 * 8].view(_U)[: len(word[s::8])]
            word[s::8][: len(part)] = part
        n = len(d) - GRAM + 1
        gram = mix(word[:n] * _U(0x9E3779B97F4A7C15) ^ (word[8 : 8 + n] * _U(0xC2B2AE3D27D4EB4F) + _U(0x165667B19E3779F9)))
        low = (gram & ~_U(0xFFFFF)) | np.arange(n, dtype=_U)
        for step in (1, 2, 4, 8, 16):
            low = np.minimum(low[:-step], low[step:])
        low = np.minimum(low[: -(SPAN - 32)], low[SPAN - 32 :])
        place = (low & _U(0xFFFFF)).astype(np.int64)
        inner = offsets[i : j + 1] - start
        inner = np.clip(inner, 0, len(d))
        row = np.repeat(np.arange(i, j), np.diff(inner))[: len(place)]
        left = np.repeat(inner[1:], np.diff(inner))[: len(place)] - np.arange(len(place))
        ok = left >= LENGTH
        change = np.ones(len(place), bool)
        change[1:] = (place[1:] != place[:-1]) | ~ok[:-1]
        first = np.flatnonzero(change & ok)
        if not len(first):
            continue
        stops = np.flatnonzero(ok & np.concatenate([change[1:] | ~ok[1:], [True]]))
        at = place[first]
        anchor = gram[at]
        if hot is not None and len(hot):
            lone = hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor
            size = np.where(lone, stops - first + 1, 1)
            origin = np.repeat(np.arange(len(first)), size)
            shift = np.arange(len(origin)) - np.repeat(np.cumsum(size) - size, size)
            lone = lone[origin]
            first, stops, at, anchor = first[origin] + shift, np.where(lone, first[origin] + shift, stops[origin]), at[origin], anchor[origin]
        total = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[d] * up[: len(d)], dtype=_U)])
        run = mix((total[stops + LENGTH] - total[first]) * down[first] + (stops - first).astype(_U))
        if hot is not None and len(hot):
            anchor = np.where(lone, mix(run ^ _U(0xA0761D6478BD642F)), anchor)

        def side(begin, held, total=total):
            begin = np.where(held, begin, 0)
            return np.where(held, mix((total[begin + SIDE] - total[begin]) * down[begin]) % _U(255) + _U(1), _U(0))

        before, after = side(at - SIDE, at - first >= SIDE), side(at + GRAM, at - stops <= SIDE)
        out.append((row[first], first - (offsets[row[first]] - start), stops - first, anchor, run, before, after))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else None


def _spread(kind: int, where: np.ndarray, columns: list[np.ndarray], widths: tuple[int, ...]):
    """Rows (kind, part, blob) of columns dealt by ``where``."""
    if not len(where):
        return
    order = np.argsort(where, kind="stable")
    parts, starts = np.unique(where[order], return_index=True)
    for p, a, b in zip(parts.tolist(), starts.tolist(), [*starts[1:].tolist(), len(where)], strict=True):
        own = order[a:b]
        yield kind, p, _pack(*((c[own], w) for c, w in zip(columns, widths, strict=True)))


def _merged(doc: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Spans of each row joined where they touch."""
    order = np.lexsort((start, text, doc))
    doc, text, start, end = doc[order], text[order], start[order], end[order]
    if not len(doc):
        return [doc, text, start, end]
    # Running maximum of the ends within a row: ends are lifted by the row's rank.
    other = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])
    rank = np.cumsum(np.concatenate([[0], other]))
    lift = rank * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift) - lift
    new = np.ones(len(doc), bool)
    new[1:] = other | (start[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return [doc[first], text[first], start[first], np.maximum.reduceat(reach, first)]


def _batch(rows) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["kind", "part", "blob"])


_ROWS = "kind int, part long, blob binary"
#: Runs; spans to cut; spans to cut wherever their row holds the same bytes; runs whose bytes are asked for.
_SEND, _CUT, _ALL, _ASK = 0, 1, 2, 3


def _home(doc: np.ndarray, text: np.ndarray, parts: int) -> np.ndarray:
    """The part where spans and requests of a row come together."""
    return (mix(doc.astype(np.int64).view(_U) * _U(0x9E3779B97F4A7C15) + text.astype(_U)) % _U(parts)).astype(np.int64)


def _collapse(anchor, run, doc, text, start, more):
    """Equal runs: those of the least document, one for each of its rows, how often the row holds it, and all others.

    The windows of the others have earlier factors.
    """
    order = np.lexsort((start, text, doc, run, anchor))
    a, r, d, t = anchor[order], run[order], doc[order], text[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
    least = d[np.flatnonzero(new)][np.cumsum(new) - 1] if len(a) else d
    own = order[d == least]
    fresh = (new | np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])])[: len(d)])[d == least]
    first = np.flatnonzero(fresh)
    return own[first], np.diff([*first, len(own)]), order[d > least]


def _cuts(spans: list[np.ndarray], parts: int, many: np.ndarray | None = None):
    """Spans dealt by row: merged, but for those that concern ``many`` places."""
    spans = [x.astype(np.int64) for x in spans]
    if many is not None and many.any():
        again = np.unique(np.stack([x[many] for x in spans]), axis=1)
        yield from _spread(_ALL, _home(again[0], again[1], parts), list(again), _SPANS)
        spans = [x[~many] for x in spans]
    spans = _merged(*spans)
    yield from _spread(_CUT, _home(spans[0], spans[1], parts), spans, _SPANS)


def _windows(more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows less one of runs as sent, and whether the row holds several."""
    more = more.astype(np.int64)
    return more & (_MANY - 1), more >= _MANY


def _read(batch: pa.RecordBatch):
    """Bytes, offsets, id and text number of each slice of rows that have an id."""
    if batch.column(0).null_count:
        batch = batch.filter(batch.column(0).is_valid())
    if batch.num_rows:
        data, offsets = utf8(batch.column(1))
        ids, texts = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 2))
        for i, j in slices(offsets, _READ):
            yield data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ids[i:j], texts[i:j]


def _mapper(parts: int, hot: np.ndarray):
    def run(batches):
        for batch in batches:
            for data, offsets, ids, texts in _read(batch):
                found = runs_of(data, offsets, hot)
                if found is None:
                    continue
                row, start, more, anchor, run_hash, before, after = found
                doc, text = ids[row], texts[row]
                part = (anchor % _U(parts)).astype(np.int64)
                anchor = anchor >> _U(32)
                run_hash = run_hash & _U(0xFFFFFFFFFFFF)
                kept, often, late = _collapse(anchor ^ (part.astype(_U) << _U(32)), run_hash, doc, text, start, more)
                end = start + more + LENGTH
                rows = list(_cuts([x[late] for x in (doc, text, start, end)], parts))
                more[kept] += _MANY * (often > 1)
                kept.sort()
                rows += _spread(_SEND, part[kept], [x[kept] for x in (anchor, run_hash, doc, text, start, more, before, after)], _RUN)
                yield _batch(rows)

    return run


def _shared(anchor: np.ndarray, side: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether another document has the same anchor and side; a side of 0 is none."""
    order = np.lexsort((side, anchor))
    a, s, d = anchor[order], side[order], doc[order]
    out = np.zeros(len(a), bool)
    if len(a):
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (s[1:] != s[:-1])]))
        several = np.minimum.reduceat(d, first) < np.maximum.reduceat(d, first)
        out[order] = np.repeat(several, np.diff([*first, len(a)])) & (s > 0)
    return out


def _reducer(parts: int):
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
        columns = _unpack([b for k, b in zip(kinds, blobs, strict=True) if k == _SEND], *_RUN)
        anchor, run_hash, doc, text, start, more, before, after = columns
        more, many = _windows(more)
        start = start.astype(np.int64)
        kept, _, late = _collapse(anchor, run_hash, doc, text, start, more)
        passed = _unpack([b for k, b in zip(kinds, blobs, strict=True) if k == _CUT], *_SPANS)
        cut = (doc[late], text[late], start[late], start[late] + more[late] + LENGTH)
        rows = list(_cuts([np.concatenate([a.astype(np.int64), b.astype(np.int64)]) for a, b in zip(passed, cut, strict=True)], parts, np.concatenate([np.zeros(len(passed[0]), bool), many[late]])))
        ask = kept[_shared(anchor[kept], before[kept], doc[kept]) | _shared(anchor[kept], after[kept], doc[kept])]
        home = np.full(len(ask), part, np.int64)
        rows += _spread(_ASK, _home(doc[ask], text[ask], parts), [doc[ask], text[ask], start[ask], more[ask] + _MANY * many[ask], home], _ASKED)
        del columns, anchor, run_hash, doc, text, start, more, many, before, after, kept, late, cut, passed
        release()
        return pa.Table.from_batches([_batch(rows)])

    return run


def _lines(columns: list[np.ndarray]) -> pa.Table:
    """One line for each row of the corpus: id, text number, and the numbers that concern it, as 64-bit integers."""
    order = np.lexsort((columns[1], columns[0]))
    doc, text, *numbers = (x[order] for x in columns)
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])])[: len(doc)])
    numbers = np.stack(numbers, 1)
    blobs = [numbers[a:b].tobytes() for a, b in zip(first.tolist(), [*first[1:].tolist(), len(doc)], strict=True)] if len(doc) else []
    return pa.table({"_doc": pa.array(doc[first]), "_of": pa.array(text[first]), "_numbers": pa.array(blobs, pa.binary())})


def _spans_by_row(table: pa.Table) -> pa.Table:
    """(start, end) of each row's spans; those that concern all places of their bytes have their ends negated."""
    held = [[x.astype(np.int64) for x in _unpack(table.filter(pc.equal(table.column("kind"), k)).column("blob").to_pylist(), *_SPANS)] for k in (_CUT, _ALL)]
    held[0] = _merged(*held[0])
    held[1][3] = -held[1][3]
    return _lines([np.concatenate(x) for x in zip(*held, strict=True)])


def _asks_by_row(table: pa.Table) -> pa.Table:
    return _lines([x.astype(np.int64) for x in _unpack(table.column("blob").to_pylist(), *_ASKED)])


_BY_ROW = "_doc long, _of long, _numbers binary"


def _numbers(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a batch of lines, and the line of each; null holds none."""
    blobs = [b"" if b is None else b for b in column.to_pylist()]
    of = np.repeat(np.arange(len(blobs)), [len(b) // (8 * width) for b in blobs])
    return np.frombuffer(b"".join(blobs), np.int64).reshape(-1, width), of


def _fetch(batches):
    """The bytes of the runs asked for, dealt by anchor."""
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        numbers, of = _numbers(batch.column(3), 3)
        doc, text = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 2))
        for at in range(0, len(of), _STRETCH):
            start, more, home = numbers[at : at + _STRETCH].T
            own = of[at : at + _STRETCH]
            place = (offsets[own] + start)[:, None] + np.arange(WIDTH)
            held = data[np.minimum(place, len(data) - 1)]
            held[np.arange(WIDTH) >= (_windows(more)[0] + LENGTH)[:, None]] = 0
            order = np.argsort(home, kind="stable")
            parts, starts = np.unique(home[order], return_index=True)
            rows = []
            for p, a, b in zip(parts.tolist(), starts.tolist(), [*starts[1:].tolist(), len(home)], strict=True):
                k = order[a:b]
                rows.append((_ASK, p, _pack((doc[own[k]], 8), (text[own[k]], 5), (start[k], 4), (more[k], 1)) + held[k].tobytes()))
            yield _batch(rows)


def longest_previous(order_doc: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """LPF in suffix order: the longest common prefix with a suffix of a smaller document.

    ``lcp[i]`` is the common prefix of suffixes i - 1 and i. The previous smaller value of i is found by jumps over
    entries that are not smaller, taking along the least common prefix on the way; the next one in the mirrored order.
    """
    out = np.zeros(len(order_doc), np.int64)
    for flip in (False, True):
        doc = order_doc[::-1] if flip else order_doc
        back = np.concatenate([[0], lcp[1:][::-1]]) if flip else np.concatenate([[0], lcp[1:]])
        to, best = np.arange(len(doc)) - 1, back.astype(np.int64)
        active = np.flatnonzero((to >= 0) & (best > 0))
        while len(active):
            smaller = doc[to[active]] < doc[active]
            active = active[~smaller]
            nxt = to[active]
            best[active] = np.minimum(best[active], best[nxt])
            to[active] = to[nxt]
            ended = (to[active] < 0) | (best[active] <= 0)
            best[active[ended]] = 0
            active = active[~ended]
        best[to < 0] = 0
        out = np.maximum(out, best[::-1] if flip else best)
    return out


def _factors(parts: int):
    def run(table: pa.Table) -> pa.Table:
        doc, text, start, more, held = [], [], [], [], []
        for blob in table.column("blob").to_pylist():
            n = int(np.frombuffer(blob, np.uint32, 1)[0])
            head = 4 + n * 18
            for out, x in zip((doc, text, start, more), _unpack([blob[:head]], 8, 5, 4, 1), strict=True):
                out.append(x.astype(np.int64))
            held.append(np.frombuffer(blob, np.uint8, n * WIDTH, head).reshape(n, WIDTH))
        doc, text, start, more, held = (np.concatenate(x) for x in (doc, text, start, more, held))
        more, many = _windows(more)
        which = np.repeat(np.arange(len(doc)), more + 1)
        shift = np.arange(len(which)) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
        view = np.lib.stride_tricks.sliding_window_view(held, LENGTH, axis=1)
        head = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(held, 8, axis=1)[which, shift]).view(">u8").reshape(-1).astype(_U)
        order = np.argsort(head, kind="stable")
        which, shift, head = which[order], shift[order], head[order]
        # Stretches of the suffix order, cut where the first eight bytes change: their arrays bound the memory of a task.
        cuts, at = [0], 0
        while at < len(head):
            at = min(at + _STRETCH, len(head))
            at = int(np.searchsorted(head, head[at - 1], "right"))
            cuts.append(at)
        found = [_removed(view, which[a:b], shift[a:b], doc, start) for a, b in zip(cuts, cuts[1:], strict=False)]
        row, begin = (np.concatenate(x) for x in zip(*found, strict=True))
        rows = list(_cuts([doc[row], text[row], begin, begin + LENGTH], parts, many[row]))
        del held, view, which, shift, head, order, found
        release()
        return pa.Table.from_batches([_batch(rows)])

    return run


def _removed(view: np.ndarray, which: np.ndarray, shift: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run and start of the windows of a stretch whose longest previous factor has full length."""
    # The windows' bytes as seven big-endian words: their order is the order of the suffixes up to LENGTH bytes.
    window = np.zeros((len(which), 56), np.uint8)
    window[:, :LENGTH] = view[which, shift]
    words = window.view(">u8").astype(_U)
    owner = doc[which]
    order = np.lexsort((owner, *(words[:, k] for k in range(6, -1, -1))))
    words = words[order]
    differ = words[1:] != words[:-1]
    at = differ.argmax(1)
    x = words[1:][np.arange(len(at)), at] ^ words[:-1][np.arange(len(at)), at]
    # Leading equal bytes of the first differing word.
    lead = np.zeros(len(x), np.int64)
    for k in range(1, 8):
        lead += x < (_U(1) << _U(64 - 8 * k))
    lcp = np.concatenate([[0], np.where(~differ.any(1), LENGTH, np.minimum(at * 8 + lead, LENGTH))])
    hit = order[longest_previous(owner[order], lcp) >= LENGTH]
    return which[hit], start[which[hit]] + shift[hit]


def _everywhere(text: bytes, spans: np.ndarray) -> np.ndarray:
    """Spans joined, those with a negated end at all places of their bytes."""
    found = [spans[spans[:, 1] > 0]]
    for a, b in {text[a:-b]: (a, -b) for a, b in spans[spans[:, 1] < 0].tolist()}.values():
        at, part, places = text.find(text[a:b]), text[a:b], []
        while at >= 0:
            places.append(at)
            at = text.find(part, at + 1)
        found.append(np.stack([np.array(places), np.array(places) + (b - a)], 1))
    start, end = np.concatenate(found).T
    none = np.zeros(len(start), np.int64)
    return np.stack(_merged(none, none, start, end)[2:], 1)


def _cut(text: bytes, spans: np.ndarray) -> tuple[bytes, int]:
    kept, at, gone = [], 0, 0
    for a, b in spans.tolist():
        kept.append(text[at:a])
        gone += b - a
        at = b
    return b"".join([*kept, text[at:]]), gone


def _cut_batch(batch: pa.RecordBatch):
    """(kept bytes, bytes removed, spans) of each line of a batch (row or id, text, numbers)."""
    data, offsets = utf8(batch.column(1))
    spans, of = _numbers(batch.column(2), 2)
    ends = np.searchsorted(of, np.arange(batch.num_rows + 1)).tolist()
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        own, text = spans[ends[k] : ends[k + 1]], data[a:b].tobytes()
        if len(own) and own[:, 1].min() < 0:
            own = _everywhere(text, own)
        yield *_cut(text, own), len(own)


def _digested(batches):
    for batch in batches:
        _, offsets = utf8(batch.column(1))
        found = [(sha256(kept).hexdigest(), gone, n) for kept, gone, n in _cut_batch(batch)]
        sha, gone, n = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(gone, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _shortened(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([kept.decode("utf-8", "ignore") for kept, _, _ in _cut_batch(batch)], pa.string())], ["_row", "_kept"])


def _hot_anchors(source: DataFrame) -> np.ndarray:
    """Anchors that have different runs in ``_HOT`` rows or more of the sample; at most ``_HOTTEST``, sorted."""

    def seen(batches):
        for batch in batches:
            for data, offsets, _, _ in _read(batch):
                found = runs_of(data, offsets)
                if found is not None:
                    each = np.unique(np.stack([found[3], found[4]]), axis=1).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(each[0]), pa.array(each[1])], ["anchor", "run"])

    sample = source.where(F.col("_of") % _SAMPLE == 0)
    counted = map_arrow(sample, seen, "anchor long, run long").distinct().groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= _HOT)
    return np.sort(np.array([r["anchor"] for r in counted.orderBy(F.desc("n"), "anchor").limit(_HOTTEST).collect()], np.int64).view(_U))


def _grouped(df: DataFrame, function, schema: str, parts: int) -> DataFrame:
    """Groups of a part each, four to a task or so: the input of a task does not grow with the corpus."""
    tasks = max(default_parts(df.sparkSession), parts // 4)
    return df.repartition(tasks, "part").groupBy("part").applyInArrow(function, schema)


def cut_spans(source: DataFrame) -> DataFrame:
    """_doc, _of, _numbers: the spans to remove from each row of ``source`` (_id, _text, _of) that has any."""
    ship(source.sparkSession)
    size = source.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    parts = 7 + size // _PART
    sent = map_arrow(source, _mapper(parts, _hot_anchors(source)), _ROWS)
    first = stage(_grouped(sent, _reducer(parts), _ROWS, parts), "factors")
    asked = _grouped(first.where(F.col("kind") == _ASK), _asks_by_row, _BY_ROW, parts)
    fetched = map_arrow(source.join(asked, (F.col("_id") == F.col("_doc")) & (source["_of"] == asked["_of"])).select("_id", "_text", source["_of"], "_numbers"), _fetch, _ROWS)
    second = stage(_grouped(fetched, _factors(parts), _ROWS, parts), "suffixes")
    return _grouped(first.where(F.col("kind") != _ASK).union(second), _spans_by_row, _BY_ROW, parts)


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ident, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return docs.select(whole, ident.alias("_id"), text.alias("_text"), F.xxhash64(text).bitwiseAND(F.lit((1 << 40) - 1)).alias("_of"))


def _with_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    source = _prepared(docs, id_col, text_col)
    cuts = stage(cut_spans(source.select("_id", "_text", "_of")).withColumnRenamed("_of", "_text_of"), "cuts")
    likely, free = Sieve(cuts, ["_doc", "_text_of"]).split(source, [F.col("_id"), F.col("_of")])
    joined = likely.join(cuts, (F.col("_id") == F.col("_doc")) & (F.col("_of") == F.col("_text_of")), "left")
    return joined.unionByName(free, allowMissingColumns=True)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    rows = _with_spans(docs, id_col, text_col).select("_id", "_text", "_numbers")
    return map_arrow(rows, _digested, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with later copies cut out of the text. A character of which only some bytes are cut goes whole."""
    rows = _with_spans(docs, id_col, text_col).select("_row", "_text", "_numbers")
    out = map_arrow(rows, _shortened, StructType([rows.schema["_row"]]).add("_kept", "string"))
    return out.select(*[F.col("_kept").alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in docs.columns])
