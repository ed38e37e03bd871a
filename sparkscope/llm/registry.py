"""Queries over the driver's tables, one for each operator. Each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscope.llm import chat, filter_audit, merkle, metric_join, near_duplicates, oracles, packing, phrase_index, quality, repeats, secrets, token_counts, unigram, warc
from sparkscope.llm.common import fresh_path, table
from sparkscope.llm.vocabulary import default_path, public_path


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), table(spark, sf_dir, "labels"), keep_text=False)
    return scored.select("doc_id", "_quality.*")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), default_path())


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    log = chat.events_of(rows.unionByName(chat.probe(spark, rows)))
    return chat.digests(chat.format_chats(log))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.range_join(table(spark, sf_dir, "embeddings"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = fresh_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), target)
    return warc.read(spark, target).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.round_trip(table(spark, sf_dir, "documents"), default_path())


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_index.report(phrase_index.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = fresh_path(spark, "packed")
    packing.pack(table(spark, sf_dir, "documents"), target, public_path("byte_bpe_50k.json"))
    return packing.digests(packing.read(spark, target)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = ("doc_id", "source", "lang", "n_chars")
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    changed = F.when(tampered, merkle.leaf(*fields, F.replace("text", F.lit("\n"), F.lit("")))).otherwise(F.lit(None))
    leaves = docs.select("doc_id", "source", merkle.leaf(*fields, "text").alias("leaf"), changed.alias("changed"))
    found = merkle.proofs(leaves).withColumn("folded_root", merkle.folded(F.coalesce("changed", "leaf"), F.col("proof")))
    proof = F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup,
        op2_secret_scans,
        op3_quality_classifier,
        op4_token_counts,
        op5_chat_formatting,
        op6_minhash_near_dedup,
        op7_embedding_near_dedup,
        op8_warc,
        op9_sentencepiece,
        op10_benchmark_decontamination,
        op11_packing,
        op12_merkle_manifest,
        op13_filter_audit,
    )
}

ORACLES: dict[str, str] = oracles.ORACLES | {
    "op5_chat_formatting": """
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) r(t)
        ), sized AS (
            SELECT *, length(replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), chr(10), '\\' || chr(10)))
                    + length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|')) + 24 AS piece FROM rows
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(piece) AS BIGINT) AS formatted_chars
        FROM sized GROUP BY conv_id
    """,
    "op7_embedding_near_dedup": """
        WITH RECURSIVE sound AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), near AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95
        ), reach AS (
            SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b
        ), links AS (SELECT a, count(*) AS n FROM near GROUP BY a), low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
        SELECT e.vec_id, coalesce(l.n, 0) AS n_links, least(e.vec_id, coalesce(w.b, e.vec_id)) AS component_id, e.vec_id <= coalesce(w.b, e.vec_id) AS kept
        FROM embeddings e LEFT JOIN links l ON l.a = e.vec_id LEFT JOIN low w ON w.a = e.vec_id
    """,
}
