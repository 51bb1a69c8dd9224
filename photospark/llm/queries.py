"""Queries of the training-data operators: thin digests over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}


def load() -> tuple[dict, dict]:
    """(queries, SQL twins), the pipeline included."""
    import corpus_pipeline

    sql = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {**QUERIES, "pipeline": corpus_pipeline.run}, {**ORACLES, **sql}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op7_personal_data")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    from photospark.llm import pii

    found = pii.find(table(spark, sf, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["kind"].isin([k.name for k in pii.BASE]))

    def count(kind):
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k.name) for k in pii.KINDS], F.sha2(pii.listed(base), 256).alias("base_sha256"),
        pii.listed(F.col("pii")).alias("spans"), F.round(F.array_max(F.transform("pii", lambda s: s["score"])), 6).alias("top_score"),
    )


@query("op8_quality_rules")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    from photospark.llm.quality import quality

    return quality(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("distance2", 4).alias("distance2"))


@query("op2_best_fit_packing")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    from photospark.llm.bestfit import pack

    return pack(table(spark, sf, "documents"))


@query("op3_sentencepiece")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    from photospark.llm.sentence import digests

    return digests(table(spark, sf, "documents"))


@query("op5_packed_binary")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    from photospark.llm.binary import write_packed
    from photospark.llm.scratch import scratch_path

    rows = write_packed(table(spark, sf, "documents"), scratch_path(spark, "packed-ids"))
    listed = F.transform(F.arrays_zip("segment_docs", "segment_pieces"), lambda s: F.concat_ws(":", s["segment_docs"], s["segment_pieces"]))
    return rows.select(
        "sequence_id", F.col("n_tokens").cast("bigint").alias("n_tokens"), F.size("segment_docs").cast("bigint").alias("n_segments"),
        F.crc32("input_ids").alias("row_crc32"), F.array_join("cu_seqlens", ",").alias("cu_seqlens"),
        F.array_join("position_resets", ",").alias("position_resets"), F.array_join(listed, ",").alias("segments"))


@query("op4_substring_dedup")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    from photospark.llm.substrings import dedup

    return dedup(table(spark, sf, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_suffix_dedup")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    from photospark.llm.suffixes import dedup

    return dedup(table(spark, sf, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_ngram_jaccard_join")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    from photospark.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf, "documents"))


@query("op1_nearest_neighbours", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    from photospark.llm.neighbours import search

    vectors = table(spark, sf, "embeddings")
    return search(vectors.filter(F.col("vec_id") % 100 == 0), vectors)


@query("op10_language_model")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    from photospark.llm.language import score

    return score(table(spark, sf, "documents"))


@query("op11_embedding_whitening")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    from photospark.llm.whitening import whiten

    return whiten(table(spark, sf, "embeddings"))


@query("op12_warc_archives", """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM p LEFT JOIN f USING (payload_digest)
""")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    from photospark.llm.warc import round_trip

    return round_trip(table(spark, sf, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


@query("op13_token_alignment")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    from photospark.llm.alignment import align

    return align(table(spark, sf, "documents"))
