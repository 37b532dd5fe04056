"""Plain versions of the operators' contracts, for small fixtures."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

SPACED = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def suffix(rows, n=50):
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256) of unique ids."""
    texts = {i: (t or "").encode() for i, t in rows}
    first = {}
    for i in sorted(texts):
        for p in range(len(texts[i]) - n + 1):
            first.setdefault(texts[i][p : p + n], i)
    out = {}
    for i, b in texts.items():
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if first[b[p : p + n]] < i:
                gone[p : p + n] = b"\1" * n
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingles(text):
    w = SPACED.findall(lower(text))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def near(rows):
    """doc_id -> (n_shingles, component_id)."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    posts = defaultdict(list)
    for i in sets:
        for s in sets[i]:
            posts[s].append(i)
    seen = set()
    for ids in posts.values():
        for a in ids:
            for b in ids:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    k = len(sets[a] & sets[b])
                    if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                        x, y = sorted((find(a), find(b)))
                        up[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    w = SPACED.findall(text)
    tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    inside = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def secrets(text):
    """Base spans (start, kind rank, kind, end)."""
    text = text or ""
    assign = re.compile("((?:p|P)(?:a|A)(?:s|S)(?:s|S)(?:w|W)(?:o|O)(?:r|R)(?:d|D)|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    out = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]


def licenses(text):
    """(n_words, places, labels)."""
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
    at = [(k, label) for p, label in PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    return len(w), sorted(k for k, _ in at), sorted({x for _, x in at})


def jump(key, n):
    """The published algorithm, unsigned."""
    key %= 1 << 64
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def crc(text):
    return zlib.crc32((text or "").encode())
