"""Texts of a megabyte through every registered query on documents: whole results, in bounded time."""

import hashlib
import random
import time

import pytest

from prismet.llm import queries
from tests.llm import brute


def texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeioustrnlkdm") for _ in range(rng.randint(2, 9)))
    prose = " ".join(word() for _ in range(150_000))
    return [
        prose, prose[:500_000] + " " + " ".join(word() for _ in range(70_000)), "a" * 1_000_000, "x y " * 250_000, "line of words\n" * 70_000, "eyJaaaaaaaa-" * 80_000, "1." * 400_000, "+1 (234) 555-0100 a@b.c 4111 1111 1111 1111 " * 20_000,
        "licensed under the mit license " * 30_000, "\U0001f600é" * 150_000, " " * 1_000_000, "token = abcdefghijklmnop " * 40_000, "short text of a few words", None,
    ]


TEXTS = texts()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("long")
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, k % 2) for k in range(len(TEXTS))], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


CHECKS = {
    "op2_secret_ownership": lambda r, t: (r["n_assign"], r["n_hex"]) == tuple(sum(kind == k for _, _, kind, _ in brute.secrets(t)) for k in ("assign", "hex")),
    "op3_license_signatures": lambda r, t: (r["n_words"], r["n_base"]) == (brute.licenses(t)[0], len(brute.licenses(t)[1])),
    "op4_jump_sharding": lambda r, t: (r["size"], r["text_crc32"]) == (len((t or "").encode()) + 1, brute.crc(t)),
    "op5_suffix_array": lambda r, t: r["n_bytes"] == len((t or "").encode()),
    "op6_byte_bpe": lambda r, t: r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest(),
    "op7_scaled_sketch": lambda r, t: r["n_chars"] == len(t or ""),
    "op8_minhash_join": lambda r, t: r["n_shingles"] == len(brute.shingles(t)),
    "op10_decision_list": lambda r, t: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute.quality(t),
    "op12_candidate_boosting": lambda r, t: r["n_email"] == (20_000 if t and "@" in t else 0),
    "op13_merkle_pregel": lambda r, t: len(r["leaf"]) == 64,
}


@pytest.mark.parametrize("name", CHECKS)
def test_long_texts(spark, folder, name):
    began = time.time()
    rows = {r["doc_id"]: r for r in queries.queries()[name](spark, folder).collect()}
    assert time.time() - began < 150 and sorted(rows) == list(range(len(TEXTS)))
    assert [k for k, t in enumerate(TEXTS) if not CHECKS[name](rows[k], t)] == []
    if name == "op5_suffix_array":
        assert rows[1]["n_removed"] >= 499_000 and rows[0]["n_removed"] == 0


def test_long_texts_are_packed_whole(spark, folder):
    rows = queries.op9_shortest_pack(spark, folder).collect()
    held = {}
    for r in rows:
        held[r["doc_id"]] = held.get(r["doc_id"], 0) + r["length"]
        assert r["length"] <= 4096
    assert sorted(held) == list(range(len(TEXTS))) and all(r["doc_tokens"] == held[r["doc_id"]] for r in rows)
