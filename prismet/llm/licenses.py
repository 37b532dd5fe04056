"""License scans by ordered signature rules.

Rules are regular expressions over the words of a text (lower-cased, joined by single spaces). A rule is tried only
where one of its keywords occurs; every text that its pattern matches holds one. Each has a priority; a detection whose
interval lies within that of a kept detection of the same or higher priority is suppressed. Three fixed phrases are
counted at all their places, whatever the rules find.

Defined cases. Nulls and empty texts have no words and no detections; an empty table gives an empty result. Repeated
rows are scanned each. Very long texts are scanned whole, in time n log n of the words and detections. Ties: of
detections with one interval and priority the first label by name stays. Only the id and the text are read, so other
columns, whatever their names, do not matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismet.llm._stage import map_arrow
from prismet.llm._text import ALNUM, LOWER, Words, slices, utf8

#: Fixed phrases and their labels.
PHRASES = [(b"under the mit license", "mit"), (b"apache license version 2", "apache-2"), (b"cc by nc", "cc-by-nc")]

#: label, keywords (one word each, "|" between them), how the license is named: patterns over lower-cased words joined by spaces.
NAMES = [
    ("mit", "mit", r"mit(?: x11| expat)?"),
    ("apache-2", "apache", r"apache(?: software)?(?: license)?(?: version)? 2(?: 0)?"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)?(?: version)? 1 1"),
    ("bsd-2", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    ("bsd-3", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)"),
    ("bsd-4", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("bsd", "bsd", r"bsd"),
    ("gpl-2", "general", r"(?:gnu )?general public license(?: gpl)?(?: as published by the free software foundation)?(?: either)? (?:version|v) 2(?: 0)?"),
    ("gpl-3", "general", r"(?:gnu )?general public license(?: gpl)?(?: as published by the free software foundation)?(?: either)? (?:version|v) 3(?: 0)?"),
    ("gpl-2", "gpl", r"gpl ?v? ?2(?: 0)?"),
    ("gpl-3", "gpl", r"gpl ?v? ?3(?: 0)?"),
    ("gpl", "general", r"gnu general public"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public license(?: version)? 2 1"),
    ("lgpl-3", "lesser", r"(?:gnu )?lesser general public license(?: version)? 3(?: 0)?"),
    ("lgpl-2.1", "lgpl", r"lgpl ?v? ?2 1"),
    ("lgpl-3", "lgpl", r"lgpl ?v? ?3(?: 0)?"),
    ("agpl-3", "affero", r"(?:gnu )?affero general public license(?: version)? 3(?: 0)?"),
    ("agpl-3", "agpl", r"agpl ?v? ?3(?: 0)?"),
    ("mpl-2", "mozilla", r"mozilla public license(?: version)?(?: v)? ?2(?: 0)?"),
    ("mpl-1.1", "mozilla", r"mozilla public license(?: version)?(?: v)? ?1 1"),
    ("epl-2", "eclipse", r"eclipse public license(?: version)?(?: v)? ?2(?: 0)?"),
    ("epl-1", "eclipse", r"eclipse public license(?: version)?(?: v)? ?1(?: 0)?"),
    ("cddl", "cddl|development", r"(?:common development and distribution|cddl)"),
    ("isc", "isc", r"isc"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl|fuck", r"(?:do what the fuck you want to public|wtfpl)"),
    ("boost", "boost", r"boost software"),
    ("artistic-2", "artistic", r"artistic(?: license)?(?: version)? 2(?: 0)?"),
    ("ofl", "open", r"(?:sil )?open font"),
    ("psf", "python", r"python software foundation"),
    ("postgresql", "postgresql", r"postgresql"),
    ("eupl", "european", r"european union public"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by", "cc", r"cc by(?: [1-4] [05])?"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-nc", "cc", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by", "creative", r"creative commons attribution(?: [1-4] [05])?"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike(?: [1-4] [05])?"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "creative", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "creative", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?"),
    ("gfdl", "documentation", r"gnu free documentation"),
    ("odbl", "database", r"open (?:data commons open )?database"),
]
#: priority, wording around a name: from an explicit statement down to a bare mention.
WORDINGS = [
    (95, r"spdx license identifier {}"),
    (90, r"(?:is|are) (?:free software )?(?:re ?)?(?:licensed|released|distributed|made available|provided) under (?:the )?(?:terms of )?(?:the )?{}(?: licen[cs]e)?"),
    (85, r"(?:licensed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?{}(?: licen[cs]e)?"),
    (80, r"(?:subject to|governed by|covered by) (?:the )?(?:terms of )?(?:the )?{}(?: licen[cs]e)?"),
    (75, r"under (?:the )?(?:terms of )?(?:the )?{} licen[cs]e"),
    (60, r"licen[cs]e {}"),
    (50, r"{} licen[cs]e"),
]
#: Sentences of license texts: label, keywords, priority, pattern.
SENTENCES = [
    ("mit", "permission", 88, r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "permission", 88, r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution", 86, r"redistributions? (?:and use )?(?:in|of) source (?:and binary forms|code must retain)"),
    ("proprietary", "reserved", 40, r"all rights reserved"),
    ("proprietary", "proprietary", 55, r"(?:confidential and )?proprietary (?:software|information|licen[cs]e)"),
    ("public-domain", "public", 70, r"(?:released into|dedicated to|in) the public domain"),
]
#: Lead-in and end of a notice; a notice takes them in, so that it suppresses the plainer wordings within it.
_UNDER = r"(?:free software you can redistribute it and or modify it )?(?:(?:(?:is|are) )?(?:free software )?(?:(?:licensed|released|distributed|published|provided|(?:made )?available) )?under )?(?:the terms of )?(?:the )?"
_FSF = r" as published by the free software foundation(?: inc)?(?: either)? version "
_LATER = r"(?: of the licen[cs]e)?(?: only)?(?: or(?: at your option)? any later version)?"
_UNDER_A = r"licensed under an? creative commons attribution"
_DEED = r"(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: public)? licen[cs]e"
#: Hand-written signatures of common license headers and texts: label, keywords, priority, pattern.
NOTICES = [
    # GPL family: headers of files
    ("gpl-2", "general", 92, _UNDER + r"gnu general public license(?: gpl)?" + _FSF + r"2(?: 0)?" + _LATER),
    ("gpl-3", "general", 92, _UNDER + r"gnu general public license(?: gpl)?" + _FSF + r"3(?: 0)?" + _LATER),
    ("gpl-2", "general", 92, _UNDER + r"gnu general public license(?: gpl)? (?:version |v ?)2(?: 0)?(?: only)? as published by the free software foundation"),
    ("gpl-3", "general", 92, _UNDER + r"gnu general public license(?: gpl)? (?:version |v ?)3(?: 0)?(?: only)? as published by the free software foundation"),
    ("gpl-2", "general", 92, _UNDER + r"version 2(?: 0)? of the gnu general public license"),
    ("gpl-3", "general", 92, _UNDER + r"version 3(?: 0)? of the gnu general public license"),
    ("gpl", "general", 91, r"free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "general", 65, r"you should have received a copy of the gnu general public license"),
    ("gpl", "general", 65, r"see the gnu general public license for more details"),
    ("lgpl-2.1", "lesser", 92, _UNDER + r"gnu lesser general public license(?: lgpl)?" + _FSF + r"2 1" + _LATER),
    ("lgpl-3", "lesser", 92, _UNDER + r"gnu lesser general public license(?: lgpl)?" + _FSF + r"3(?: 0)?" + _LATER),
    ("lgpl-2", "library", 92, _UNDER + r"gnu library general public license(?: lgpl)?" + _FSF + r"2(?: 0)?" + _LATER),
    ("lgpl-2.1", "lesser", 92, _UNDER + r"version 2 1 of the gnu lesser general public license"),
    ("lgpl-3", "lesser", 92, _UNDER + r"version 3(?: 0)? of the gnu lesser general public license"),
    ("lgpl", "lesser", 91, r"free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl", "lesser", 65, r"you should have received a copy of the gnu lesser general public license"),
    ("lgpl", "lesser", 65, r"see the gnu lesser general public license for more details"),
    ("agpl-3", "affero", 92, _UNDER + r"gnu affero general public license(?: agpl)?" + _FSF + r"3(?: 0)?" + _LATER),
    ("agpl-3", "affero", 92, _UNDER + r"version 3(?: 0)? of the gnu affero general public license"),
    ("agpl", "affero", 65, r"you should have received a copy of the gnu affero general public license"),
    ("agpl", "affero", 65, r"see the gnu affero general public license for more details"),
    # GPL family: texts
    ("gpl-2", "general", 90, r"gnu general public license version 2 june 1991"),
    ("gpl-3", "general", 90, r"gnu general public license version 3 29 june 2007"),
    ("gpl-2", "guarantee", 88, r"by contrast the gnu general public license is intended to guarantee your freedom to share and change free software"),
    ("gpl-3", "guarantee", 88, r"by contrast the gnu general public license is intended to guarantee your freedom to share and change all versions of a program"),
    ("gpl-3", "copyleft", 88, r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("lgpl-2.1", "lesser", 90, r"gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3", "lesser", 90, r"gnu lesser general public license version 3 29 june 2007"),
    ("lgpl-2.1", "lesser", 88, r"this is the first released version of the lesser gpl"),
    ("lgpl-3", "lesser", 93, r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("agpl-3", "affero", 90, r"gnu affero general public license version 3 19 november 2007"),
    ("agpl-3", "affero", 88, r"the gnu affero general public license is a free copyleft license for software and other kinds of works"),
    ("gfdl", "documentation", 94, r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    # Apache
    ("apache-2", "apache", 92, _UNDER + r"apache license version 2(?: 0)? the license(?: you may not use this (?:file|software) except in compliance with the license)?"),
    ("apache-2", "asf", 92, r"the asf licenses this file to you under the apache license version 2 0(?: the license)?"),
    ("apache-2", "apache", 70, r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2", "apache", 78, r"apache org licenses license 2 0"),
    ("apache-2", "apache", 90, r"apache license version 2 0 january 2004"),
    ("apache-2", "irrevocable", 82, r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|except as stated in this section patent) license"),
    ("apache-1.1", "apache", 90, r"the apache software license version 1 1"),
    ("apache-1.1", "apache", 80, r"this product includes software developed by the apache software foundation"),
    # MPL, EPL, CDDL, EUPL
    ("mpl-2", "mozilla", 94, r"this source code form is subject to the terms of the mozilla public license (?:version |v ?)2 0(?: if a copy of the mpl was not distributed with this file you can obtain one at)?"),
    ("mpl-2", "mozilla", 93, r"this source code form is incompatible with secondary licenses as defined by the mozilla public license (?:version |v ?)2 0"),
    ("mpl-2", "mozilla", 90, r"mozilla public license version 2 0 1 definitions"),
    ("mpl-2", "mozilla", 78, r"mozilla org (?:en us )?mpl 2 0"),
    ("mpl-1.1", "mozilla", 94, r"the contents of this file are subject to the mozilla public license version 1 1(?: the license you may not use this file except in compliance with the license)?"),
    ("mpl-1.0", "mozilla", 94, r"the contents of this file are subject to the mozilla public license version 1 0(?: the license you may not use this file except in compliance with the license)?"),
    ("mpl-1.1", "mozilla", 78, r"mozilla org mpl mpl 1 1"),
    ("epl-1", "eclipse", 94, r"the accompanying materials are made available under the terms of the eclipse public license (?:version |v ?)?1 0(?: which accompanies this distribution)?"),
    ("epl-2", "eclipse", 94, r"the accompanying materials are made available under the terms of the eclipse public license (?:version |v ?)?2 0(?: which accompanies this distribution)?"),
    ("epl-1", "eclipse", 78, r"eclipse org legal epl (?:v10|1 0)"),
    ("epl-2", "eclipse", 78, r"eclipse org legal epl (?:v20|2 0)"),
    ("epl", "eclipse", 88, r"the accompanying program is provided under the terms of this eclipse public license"),
    ("cddl", "development", 94, r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl", "development", 90, r"common development and distribution license cddl version 1 [01]"),
    ("eupl", "eupl", 92, r"licensed under the eupl(?: version| v)? ?1 [0-2]"),
    # Permissive texts
    ("mit", "permission", 87, r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsd", "redistribution", 86, r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3", "endorse", 89, r"neither the names? of (?:[^ ]+ ){1,16}?may be used to endorse or promote products derived from this software"),
    ("bsd-3", "endorse", 89, r"the names? of (?:the )?(?:authors?|copyright holders?|contributors?) may not be used to endorse or promote products derived from this software"),
    ("bsd-4", "advertising", 90, r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("isc", "permission", 88, r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("postgresql", "permission", 89, r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("hpnd", "permission", 89, r"permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee"),
    ("zlib", "misrepresented", 88, r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered", 87, r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("boost", "boost", 90, r"boost software license version 1 0"),
    ("boost", "permission", 89, r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("artistic-2", "artistic", 90, r"the artistic license 2 0 copyright c 2000 2006 the perl foundation"),
    ("perl", "perl", 82, r"under the same terms as perl itself"),
    ("psf", "python", 88, r"python software foundation license version 2"),
    ("ofl", "font", 94, r"this font software is licensed under the sil open font license version 1 [01]"),
    # Public domain
    ("unlicense", "unencumbered", 92, r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "compile", 88, r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "fuck", 88, r"you just do what the fuck you want to"),
    ("cc0", "neighboring", 92, r"waived all copyright and related or neighboring rights"),
    ("cc0", "creativecommons", 90, r"creativecommons org publicdomain zero 1 0"),
    # Creative Commons and data
    ("cc-by", "creative", 90, _UNDER_A + _DEED),
    ("cc-by-sa", "creative", 90, _UNDER_A + r" share ?alike" + _DEED),
    ("cc-by-nd", "creative", 90, _UNDER_A + r" no ?deriv(?:ative)?s" + _DEED),
    ("cc-by-nc", "creative", 90, _UNDER_A + r" non ?commercial" + _DEED),
    ("cc-by-nc-sa", "creative", 90, _UNDER_A + r" non ?commercial share ?alike" + _DEED),
    ("cc-by-nc-nd", "creative", 90, _UNDER_A + r" non ?commercial no ?deriv(?:ative)?s" + _DEED),
    ("cc-by", "creativecommons", 88, r"creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", "creativecommons", 88, r"creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nd", "creativecommons", 88, r"creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc", "creativecommons", 88, r"creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nc-sa", "creativecommons", 88, r"creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "creativecommons", 88, r"creativecommons org licenses by nc nd [1-4] [05]"),
    ("odbl", "database", 92, r"(?:is|are) made available under the open database license"),
    ("odbl", "opendatacommons", 88, r"opendatacommons org licenses odbl"),
    # SPDX identifiers that abbreviate a name
    ("mpl-2", "spdx", 95, r"spdx license identifier mpl 2 0"),
    ("mpl-1.1", "spdx", 95, r"spdx license identifier mpl 1 1"),
    ("epl-1", "spdx", 95, r"spdx license identifier epl 1 0"),
    ("epl-2", "spdx", 95, r"spdx license identifier epl 2 0"),
    ("boost", "spdx", 95, r"spdx license identifier bsl 1 0"),
    ("ofl", "spdx", 95, r"spdx license identifier ofl 1 [01]"),
    ("eupl", "spdx", 95, r"spdx license identifier eupl 1 [0-2]"),
    ("psf", "spdx", 95, r"spdx license identifier (?:psf|python) 2 0"),
    ("odbl", "spdx", 95, r"spdx license identifier odbl 1 0"),
    ("gfdl", "spdx", 95, r"spdx license identifier gfdl 1 [1-3]"),
]


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: frozenset[bytes]
    priority: int
    pattern: re.Pattern


def _rule(label: str, keys: str, priority: int, pattern: str) -> Rule:
    return Rule(label, frozenset(keys.encode().split(b"|")), priority, re.compile(r"(?<![^ ])" + pattern + r"(?![^ ])"))


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, by falling priority; more specific names stand before those they extend."""
    out = [_rule(label, keys, p, wording.format(f"(?:{name})")) for p, wording in WORDINGS for label, keys, name in NAMES]
    out += [_rule(label, keys, p, pattern) for label, keys, p, pattern in SENTENCES + NOTICES]
    return tuple(sorted(out, key=lambda r: -r.priority))


_KEYS = sorted(frozenset().union(*(r.keywords for r in rules())))


class _Reach:
    """Furthest end of the intervals added so far that start at or before a place: prefix maxima in a binary indexed tree."""

    def __init__(self, starts: list[int]):
        self.rank = {s: k for k, s in enumerate(sorted(set(starts)), 1)}
        self.ends = [-1] * (len(self.rank) + 1)

    def until(self, start: int) -> int:
        k, best = self.rank[start], -1
        while k:
            best = max(best, self.ends[k])
            k &= k - 1
        return best

    def add(self, start: int, end: int) -> None:
        k = self.rank[start]
        while k < len(self.ends):
            self.ends[k] = max(self.ends[k], end)
            k += k & -k


def detect(words: str, present: set[bytes]) -> list[tuple[int, int, str, int]]:
    """(start, end, label, priority) of kept detections, in characters of the joined words; n log n in the detections."""
    found = [(m.start(), m.end(), r.label, r.priority) for r in rules() if not r.keywords.isdisjoint(present) for m in r.pattern.finditer(words)]
    kept: list[tuple[int, int, str, int]] = []
    reach = _Reach([s for s, *_ in found])
    for s, e, label, p in sorted(found, key=lambda x: (-x[3], x[0] - x[1], x[0], x[2])):
        # Of equal priority the longer interval comes first, so a name suppresses the shorter name that it extends.
        if reach.until(s) < e:
            kept.append((s, e, label, p))
            reach.add(s, e)
    return sorted(kept)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, detections array<struct<label:string,priority:int,first_word:int,last_word:int>>"
_HITS = pa.list_(pa.struct([("label", pa.string()), ("priority", pa.int32()), ("first_word", pa.int32()), ("last_word", pa.int32())]))


def _places(words: bytes, spaces: np.ndarray, phrase: bytes):
    """Numbers of the words at which a phrase starts; ``words`` has a space on either end, ``spaces`` are their places."""
    at = words.find(b" " + phrase + b" ")
    while at >= 0:
        yield int(np.searchsorted(spaces, at))
        at = words.find(b" " + phrase + b" ", at + 1)


def _scan(batches):
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "detections"]
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        rows = []
        for i, j in slices(offsets):
            d, o = LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
            w = Words(d, o, ALNUM)
            raw = d.tobytes()
            near = {k for k in _KEYS if k in raw}
            for r, (a, b) in enumerate(zip(o[:-1].tolist(), o[1:].tolist(), strict=True)):
                present = {k for k in near if raw.find(k, a, b) >= 0}
                n = int(w.counts[r])
                if not present:
                    rows.append((n, 0, None, None, [], []))
                    continue
                x, y = w.rows[r], w.rows[r + 1]
                text = b" ".join(raw[s:e] for s, e in zip(w.starts[x:y].tolist(), w.ends[x:y].tolist(), strict=True))
                padded = b" " + text + b" "
                spaces = np.flatnonzero(np.frombuffer(padded, np.uint8) == 0x20)
                at = [(k, label) for phrase, label in PHRASES for k in _places(padded, spaces, phrase)]
                words = text.decode()
                ends = np.cumsum([len(x) + 1 for x in words.split(" ")])
                hits = [{"label": label, "priority": p, "first_word": int(np.searchsorted(ends, s, "right")), "last_word": int(np.searchsorted(ends, e, "right"))} for s, e, label, p in detect(words, present)]
                rows.append((n, len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), sorted({label for _, label in at}), hits))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [*[pa.int64()] * 4, pa.list_(pa.string()), _HITS]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Word counts, base places and kept detections (word positions, end inclusive) of each row. No shuffle."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(src, _scan, SCHEMA)


def labelled(scanned: DataFrame) -> DataFrame:
    """scanned with ``labels`` (base and kept detections, distinct, sorted) and ``score``, the confidence of the best evidence."""
    own = F.transform("detections", lambda x: x["label"])
    best = F.array_max(F.transform("detections", lambda x: x["priority"]))
    return scanned.withColumns({
        "labels": F.array_sort(F.array_distinct(F.concat("base_labels", own))),
        "score": F.greatest(F.coalesce(best / 100.0, F.lit(0.0)), F.when(F.col("n_base") > 0, 0.75).otherwise(0.0)),
    })
