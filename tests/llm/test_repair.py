"""Repair of conversations against a plain program over edit strings, and long conversations in small blocks."""

import hashlib
import random
import re
import zlib

import pytest

from prismet.llm import queries, repair

SPACED = re.compile("[^\x20\x09-\x0d]")
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def faults(rows):
    """The first fault of each row (role, text)."""
    out, seen = [], set()
    for role, text in rows:
        found = SPACED.findall(text)
        out.append("blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, lines): all edits of each row and any run of inserts, strings compared as they are."""
    best = {"": (0, "", [])}

    def inserted(best):
        best = dict(best)
        for _ in range(4):
            for s, (cost, audit, lines) in list(best.items()):
                new = NEXT[s]
                found = (cost + 5, audit + "I", [*lines, {"u": "user:", "a": "assistant:"}[new]])
                if new not in best or found[:2] < best[new][:2]:
                    best[new] = found
        return best

    for (role, text), fault in zip(rows, faults(rows), strict=True):
        new = {}

        def offer(state, found):
            if state not in new or found[:2] < new[state][:2]:
                new[state] = found

        for s, (cost, audit, lines) in inserted(best).items():
            offer(s, (cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault else 0
            i = role[:1]
            if i == NEXT[s] or (s == "" and i == "s"):
                offer(i, (cost + more, audit + "K", [*lines, f"{role}:{text}"]))
            offer(NEXT[s], (cost + 1 + more, audit + "R", [*lines, {"u": "user:", "a": "assistant:"}[NEXT[s]] + text]))
        best = new
    best = inserted(best)
    return min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])


def report(rows):
    """(blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of ordered rows (role, text)."""
    found = faults(rows)
    cost, audit, lines = cheapest(rows)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))  # noqa: B905
    return (*[found.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def invented(rng, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", "sys"]
    texts = ["Yes.", "No!", "", " \t", "and then", "Why?  ", "é.", "so", "ok.\n"]
    return [(rng.choice(roles), rng.choice(texts) if rng.random() < 0.7 else f"t{rng.random()}" + rng.choice(".?!x")) for _ in range(n)]


def test_faults_match_their_definition(spark):
    from pyspark.sql import functions as F

    texts = ["", " ", "\t\n\x0b\x0c\r ", "a", "a.", "a. \n", ". a", "\xa0", "a!\x0b", "　.", "😀", "?😀 "]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(repair.fault(F.col("t"))).collect()]
    want = [{"blank": repair.GONE, "truncated": repair.TRUNCATED, "": repair.CLEAN}[f] for f in faults([(str(k), t) for k, t in enumerate(texts)])]
    assert got == want


@pytest.mark.parametrize("sizes", [{}, {"most_rows": 3, "fan": 1, "piece": 7}, {"most_rows": 2, "most_bytes": 40, "fan": 2, "piece": 30}])
def test_repairs(spark, sizes):
    """Conversations of 1 to 40 rows, and one of 300, whole in a block and cut into many; ties, equal rows, odd roles."""
    rng = random.Random(5)
    talks = {k: invented(rng, rng.choice([1, 2, 3, 5, 8, 40])) for k in range(60)} | {None: invented(rng, 300), 99: [("user", "x.")] * 50}
    rows = [(c, None if t == 0 else t, *row, "x") for c, talk in talks.items() for t, row in enumerate(talk)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string").repartition(3)
    got = {r["conv"]: tuple(r)[1:] for r in repair.repaired(df, **sizes).collect()}
    want = {"-" if c is None else f":{c}": report(talk) for c, talk in talks.items()}
    assert got == want


def test_query_on_hostile_rows(spark, tmp_path):
    rng = random.Random(3)
    rows = [(c, t, r, x, 1) for c in range(40) for t, (r, x) in enumerate(invented(rng, rng.randint(1, 9)))]
    rows += [(None, None, None, None, 1), (None, 3, "user", None, 1), (50, None, None, "a.", 1), (51, 10**9, "user", "b " * 300_000 + ".", 1), (51, 5, "system", "c.", 1), (3, 0, "user", "again.", 1)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv long").repartition(2).write.parquet(f"{tmp_path}/conversations.parquet")
    after = {}
    for c, t, role, text, _ in rows:
        own = after.setdefault(c, [])
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    want = {}
    for c, own in after.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2].encode()))
        turns = {t for t, _, _ in own if t is not None}
        want[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *report([r[1:] for r in own]))
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op11_turn_repair(spark, str(tmp_path)).collect()}
    assert got == want


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op11_turn_repair(spark, str(tmp_path)).collect() == []
