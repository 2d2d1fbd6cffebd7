"""The registered queries of the training-data operators, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, embed_dedup, filter_audit, lm, minhash, mixing, packing, pii, quality, toxicity, whitening
from .common import Scratch, crc_mod, table

QueryFn = Callable[[SparkSession, str], DataFrame]


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = "'</s>[INST] ok [/INST]'"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', {planted}), (-1L, 1L, 'assistant', {planted}) AS t(conv_id, turn, role, text)")
    return chat.read_back(chat.format_chats(turns.unionByName(extra)))


OP1_SQL = r"""
WITH src AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), made AS (
  SELECT *,
    regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '(<|\[)(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') AS head,
    regexp_replace(text, '(<|\[)(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') AS body
  FROM src
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('<s>[INST]') + length(head) + 1 + length(body) + length('[/INST]</s>') + 1)::BIGINT AS formatted_chars,
  true AS round_trip
FROM made GROUP BY conv_id
"""


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_from_tables(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model, keep=["doc_id"])
    return scored.select(
        "doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("toxicity_score").alias("score"),
        F.when(F.col("toxicity_score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_from_tables(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs, model, keep=["doc_id"])
    return scored.select(
        "doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("quality_score").alias("score"),
        F.when(F.col("quality_score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan_mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source
), c AS (
  SELECT *, 3 * source_size AS cap FROM s
), l AS (
  SELECT *, row_number() OVER w AS place,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS left_size,
    (sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS left_weight
  FROM c WINDOW w AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST)
), f AS (
  SELECT min(place) AS first_free, arg_min(left_size, place) AS ls, arg_min(left_weight, place) AS lw FROM l WHERE cap * left_weight > left_size * weight
), t AS (
  SELECT l.source, l.source_size,
    CASE WHEN f.first_free IS NULL OR l.place < f.first_free THEN l.cap::DOUBLE ELSE f.ls::DOUBLE * l.weight / f.lw END AS target
  FROM l, f
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS coin
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (floor(rate)::INT + CASE WHEN coin < rate - floor(rate)::INT THEN 1 ELSE 0 END) AS copies,
  size * (floor(rate)::INT + CASE WHEN coin < rate - floor(rate)::INT THEN 1 ELSE 0 END) AS taken
FROM r
"""


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = Scratch(spark).write(pii.candidates(docs).drop("text"), "candidates")
    spans = pii.accepted_spans(found, pii.fit(found))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint").alias(f"n_{kind}")
    return spans.select(
        "doc_id", *(count(k) for k in pii.BASE_KINDS),
        F.sha2(pii.span_text(base).cast("binary"), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), m AS (
  SELECT doc_id, part,
    CASE WHEN len(words) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask FROM d
), l AS (
  SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), c AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask
), f AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS f(letter, bit)
), o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), s AS (
  SELECT filter_order, step::INT AS step, bits[step] AS own, list_sum(bits[1:step - 1]) AS before_ FROM o, range(1, 6) AS r(step)
), p AS (
  SELECT DISTINCT part FROM c
), r AS (
  SELECT p.part, filter_order, step, own, coalesce(before_, 0)::INT AS gone FROM p, s
), x AS (
  SELECT r.part, filter_order, step,
    coalesce(sum(n) FILTER (WHERE mask & (own | gone) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & gone = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & gone <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE mask = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & own <> 0 AND mask & gone = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE mask & own <> 0 AND mask & gone = 0), 0)::BIGINT AS toxic_lost
  FROM r JOIN c ON r.part = c.part GROUP BY r.part, filter_order, step
)
SELECT x.*, (sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)))::BIGINT AS shapley FROM x
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark, table(spark, sf_dir, "embeddings"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), decoded=True)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


def queries() -> dict[str, QueryFn]:
    return {"op1_chat_format": op1_chat_format, "op2_pack": op2_pack, "op3_embed_dedup": op3_embed_dedup, "op4_toxicity": op4_toxicity, "op6_ann": op6_ann, "op5_mix": op5_mix, "op7_minhash_dedup": op7_minhash_dedup, "op8_pii": op8_pii, "op9_quality": op9_quality, "op10_lm_score": op10_lm_score, "op11_filter_audit": op11_filter_audit, "op12_whitening": op12_whitening, "op13_bpe": op13_bpe}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1_SQL, "op5_mix": OP5_SQL, "op11_filter_audit": OP11_SQL}
