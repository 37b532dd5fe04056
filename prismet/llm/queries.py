"""The registered queries of the training-data operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismet.llm import bpe, fingerprint, licenses, merkle, minhash, packing, pii, quality, repair, secrets, sharding, suffix_dedup, toxicity
from prismet.llm._stage import stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, part = table(spark, sf_dir, "documents"), lambda c: F.crc32(F.col(c).cast("string")) % 3
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), allowed=part("_id") != 1)
    out = toxicity.scored(docs, model)
    return out.select("doc_id", F.coalesce(part("doc_id") == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = stage(secrets.scan(table(spark, sf_dir, "documents")), "secrets")
    out = secrets.report(scanned)
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.KINDS[:3]))
    added = F.filter("live", lambda s: ~s["kind"].isin(*secrets.KINDS[:3]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return out.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(F.concat(base, added)).alias("spans"),
        F.col("n_live").cast("long").alias("n_live"),
        F.col("max_owners").cast("long").alias("max_owners"),
    )


def op3_license_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.labelled(licenses.scan(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score", F.size("detections").cast("long").alias("n_detections"))


def op4_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    keep = [F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")]
    out = sharding.assign_shards(table(spark, sf_dir, "documents"), "doc_id", shards=16, keep=keep)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


def op7_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprint.with_next(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.as_string(F.col("sketch")).alias("fingerprint"),
        fingerprint.as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprint.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprint.likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        fingerprint.containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_in_edited"),
    )


def op8_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_shortest_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stage(quality.text_statistics(table(spark, sf_dir, "documents")), "statistics")
    rules = quality.fit_rules(stats, table(spark, sf_dir, "labels"))
    return quality.judge(stats, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    damaged = stage(repair.damaged(rows), "damaged")
    every = rows.select("conv_id", repair.conversation(F.col("conv_id")).alias("conv")).distinct()
    out = every.join(repair.repaired(damaged), "conv", "left").join(repair.gaps(damaged), "conv", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select("conv_id", *[count(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_candidate_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = stage(pii.scan(table(spark, sf_dir, "documents")), "spans")
    out = pii.selected(scanned, pii.train(scanned))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return out.select("doc_id", *counts, F.sha2(pii.joined_base(), 256).alias("base_sha256"), pii.joined_all().alias("spans"), F.size("added").cast("long").alias("n_added"))


def op13_merkle_pregel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    digest = lambda text: merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    leaf = digest(F.col("text"))
    claim = F.when(tampered, digest(F.translate("text", "\n", ""))).otherwise(leaf)
    return merkle.verified(docs.select("doc_id", "source", leaf.alias("leaf"), claim.alias("claim")))


def queries():
    return {f.__name__: f for f in (op1_toxicity_ftrl, op2_secret_ownership, op3_license_signatures, op4_jump_sharding, op5_suffix_array, op6_byte_bpe, op7_scaled_sketch, op8_minhash_join, op9_shortest_pack, op10_decision_list, op11_turn_repair, op12_candidate_boosting, op13_merkle_pregel)}


_NEAR_SQL = """WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(list_transform(range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - 3, 2) END), lambda i: array_to_string(w[i:i + 4], ' ')))) g FROM w),
n AS (SELECT w.doc_id, count(s.g) n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
r AS (SELECT doc_id a, doc_id b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN (SELECT a doc_id, min(b) component_id FROM r GROUP BY 1) c USING (doc_id)"""


_JUMP_SQL = """WITH RECURSIVE t AS (
  SELECT list(c ORDER BY b) t FROM (
    SELECT b, list_reduce(range(0, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) c FROM (SELECT unnest(range(0, 256)) b))),
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) bytes FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(bytes, lambda a, b: xor(t.t[(xor(a, b) & 255) + 1], a >> 8), 4294967295), 4294967295) text_crc32 FROM d, t),
j AS (
  SELECT doc_id, ((doc_id::HUGEINT + 18446744073709551616) % 18446744073709551616) k, 0::BIGINT j FROM documents
  UNION ALL
  SELECT doc_id, n, floor((j + 1)::DOUBLE * (2147483648::DOUBLE / ((n >> 33) + 1)::DOUBLE))::BIGINT FROM (
    SELECT doc_id, j, (((k % 4294967296) * 2862933555777941757) % 18446744073709551616 + (((k >> 32) * (2862933555777941757 % 4294967296)) % 4294967296) * 4294967296 + 1) % 18446744073709551616 n FROM j WHERE j <= 16)),
s AS (SELECT doc_id, max(CASE WHEN j < 16 THEN j END)::INTEGER shard, max(CASE WHEN j <= 16 THEN j END)::INTEGER grown_shard FROM j GROUP BY 1)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard FROM c JOIN s USING (doc_id)"""


_REPEATS_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) h, strlen(coalesce(text, '')) n_bytes FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) g FROM (SELECT doc_id, h, unnest(range(0, n_bytes - 49)) p FROM d WHERE n_bytes >= 50)),
f AS (SELECT g, min(doc_id) AS first_id FROM w GROUP BY 1),
r AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER o + 50 THEN 0 ELSE 1 END fresh FROM w JOIN f USING (g) WHERE first_id < doc_id WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
i AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) k FROM r),
s AS (SELECT doc_id, k, min(p) a, max(p) + 50 b FROM i GROUP BY 1, 2),
q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) since FROM s),
t AS (SELECT q.doc_id, sum(b - a) n_removed, count(*) n_spans, max(b) AS rest, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS head FROM q JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(coalesce(t.head, '') || substr(h, 2 * coalesce(t.rest, 0) + 1))) kept_sha256 FROM d LEFT JOIN t USING (doc_id)"""


_REPAIR_SQL = """WITH RECURSIVE t AS (
  SELECT list(c ORDER BY b) t FROM (
    SELECT b, list_reduce(range(0, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) c FROM (SELECT unnest(range(0, 256)) b))),
k AS (
  SELECT coalesce(':' || conv_id, '-') cv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda h: ('0x' || h)::BIGINT), lambda a, b: xor(t.t[(xor(a, b) & 255) + 1], a >> 8), 4294967295), 4294967295) % 20 n FROM conversations, t),
r AS (
  SELECT cv, turn, CASE WHEN n = 4 THEN 'user' ELSE role END AS role, CASE n WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(0, CASE n WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM k)),
o AS (SELECT *, row_number() OVER (PARTITION BY cv ORDER BY turn NULLS FIRST, role, text) i, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') z FROM r),
f AS (
  SELECT *, substr(role, 1, 1) b, lag(substr(role, 1, 1)) OVER (PARTITION BY cv ORDER BY i) pb,
    CASE WHEN z = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY cv, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(z, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END fault FROM o),
m AS (SELECT repeat('I', j) || e code, j, e FROM (SELECT unnest([0, 1, 2]) j), (SELECT unnest(['K', 'R', 'D']) e)),
w AS (
  SELECT cv, 0::BIGINT i, '' st, {'c': 0::BIGINT, 'a': '', 't': ''} v FROM (SELECT DISTINCT cv FROM f)
  UNION ALL
  SELECT cv, i, st, min(v) FROM (
    SELECT cv, i, CASE e WHEN 'D' THEN q WHEN 'K' THEN b ELSE nx END st,
      {'c': v.c + 5 * j + CASE e WHEN 'D' THEN 2 ELSE CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END + CASE e WHEN 'R' THEN 1 ELSE 0 END END, 'a': v.a || code,
       't': v.t || CASE WHEN j > 0 THEN chr(10) || CASE n1 WHEN 'u' THEN 'user:' ELSE 'assistant:' END ELSE '' END || CASE WHEN j > 1 THEN chr(10) || CASE q WHEN 'u' THEN 'user:' ELSE 'assistant:' END ELSE '' END
         || CASE e WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text ELSE chr(10) || CASE nx WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text END} v
    FROM (
      SELECT *, CASE q WHEN 'u' THEN 'a' ELSE 'u' END nx FROM (
        SELECT f.cv, f.i, f.role, f.text, f.b, f.fault, m.code, m.j, m.e, w.v, CASE w.st WHEN 'u' THEN 'a' ELSE 'u' END n1,
          CASE WHEN j = 0 THEN w.st WHEN j = 1 THEN CASE w.st WHEN 'u' THEN 'a' ELSE 'u' END ELSE CASE CASE w.st WHEN 'u' THEN 'a' ELSE 'u' END WHEN 'u' THEN 'a' ELSE 'u' END END q
        FROM w JOIN f ON f.cv = w.cv AND f.i = w.i + 1, m))
    WHERE e = 'D' OR fault NOT IN ('blank', 'duplicate') AND (e = 'R' OR b = nx OR b = 's' AND q = ''))
  GROUP BY cv, i, st),
e AS (
  SELECT w.cv, min({'c': v.c + CASE st WHEN 'u' THEN 5 WHEN 's' THEN 10 ELSE 0 END, 'a': v.a || CASE st WHEN 'u' THEN 'I' WHEN 's' THEN 'II' ELSE '' END, 't': v.t || CASE st WHEN 'u' THEN chr(10) || 'assistant:' WHEN 's' THEN chr(10) || 'user:' || chr(10) || 'assistant:' ELSE '' END}) v
  FROM w JOIN (SELECT cv, max(i) n FROM f GROUP BY 1) x ON x.cv = w.cv AND x.n = w.i GROUP BY 1),
g AS (
  SELECT cv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) gaps, count(CASE WHEN fault = 'blank' THEN 1 END) blank, count(CASE WHEN fault = 'duplicate' THEN 1 END) AS duplicate, count(CASE WHEN fault = 'truncated' THEN 1 END) truncated,
    count(CASE WHEN pb IS NOT NULL AND pb || b NOT IN ('su', 'ua', 'au') THEN 1 END) illegal FROM f GROUP BY 1)
SELECT conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal, coalesce(e.v.c, 0) cost, coalesce(e.v.a, '') audit, sha256(coalesce(substr(e.v.t, 2), '')) repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(':' || conv_id, '-') cv FROM conversations) c LEFT JOIN g USING (cv) LEFT JOIN e USING (cv)"""


_MERKLE_SQL = """WITH RECURSIVE t AS (
  SELECT list(c ORDER BY b) t FROM (
    SELECT b, list_reduce(range(0, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) c FROM (SELECT unnest(range(0, 256)) b))),
d AS (
  SELECT doc_id, source, text, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT), lambda a, b: xor(t.t[(xor(a, b) & 255) + 1], a >> 8), 4294967295), 4294967295) c FROM documents, t),
l AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) leaf, CASE WHEN c % 2 = 0 THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END damaged FROM d),
g AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 grp, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 pos, count(*) OVER (PARTITION BY source) n FROM l),
u AS (
  SELECT grp, 0 lvl, pos, n, leaf h FROM g
  UNION ALL SELECT grp, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY grp, lvl, pos // 3, n),
s AS (SELECT grp, lvl height, h subroot FROM u WHERE n = 1),
v AS (
  SELECT 0 lvl, grp pos, (SELECT count(*) FROM s) n, subroot h FROM s
  UNION ALL SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM v WHERE n > 1 GROUP BY lvl, pos // 3, n),
nodes AS (SELECT grp, lvl, pos, h FROM u WHERE n > 1 UNION ALL SELECT -1, lvl, pos, h FROM v WHERE n > 1),
steps AS (
  SELECT a.grp, a.lvl, a.pos, coalesce(string_agg(CASE WHEN b.pos < a.pos THEN b.h END, '' ORDER BY b.pos), '') AS before, coalesce(string_agg(CASE WHEN b.pos > a.pos THEN b.h END, '' ORDER BY b.pos), '') AS after
  FROM nodes a JOIN nodes b ON a.grp = b.grp AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 GROUP BY 1, 2, 3),
f AS (
  SELECT doc_id, grp, leaf, 0 k, height, grp tree, 0 lvl, pos, '' proof, coalesce(damaged, leaf) h FROM g JOIN s USING (grp)
  UNION ALL
  SELECT f.doc_id, f.grp, f.leaf, k + 1, height, CASE WHEN k >= height THEN -1 ELSE f.grp END, CASE WHEN k >= height THEN k - height ELSE k END + 1, f.pos // 3, proof || x.before || x.after, sha256(x.before || f.h || x.after)
  FROM (SELECT doc_id, grp, leaf, k, height, CASE WHEN k >= height THEN -1 ELSE grp END tree, CASE WHEN k >= height THEN k - height ELSE k END lvl, CASE WHEN k = height THEN grp ELSE pos END pos, proof, h FROM f) f
  JOIN steps x ON x.grp = f.tree AND x.lvl = f.lvl AND x.pos = f.pos)
SELECT doc_id, leaf, subroot, (SELECT h FROM v WHERE n = 1) AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = (SELECT h FROM v WHERE n = 1) AS verified
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, leaf ORDER BY k DESC) top FROM f) JOIN s USING (grp) WHERE top = 1"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query; the others are tested against plain versions."""
    return {"op4_jump_sharding": _JUMP_SQL, "op5_suffix_array": _REPEATS_SQL, "op8_minhash_join": _NEAR_SQL, "op11_turn_repair": _REPAIR_SQL, "op13_merkle_pregel": _MERKLE_SQL}
