"""The registered queries of this subpackage and their SQL, where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_layout, lmscore, media, mixing, neardup, quality, tokenbin, tokencount, warc
from .storage import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op1_media_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as the samples of a WAV file whose declared type is wrong for half of them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    stored = materialize(
        _table(spark, sf_dir, "documents").select(
            "doc_id",
            F.octet_length(text).cast("long").alias("n_bytes"),
            F.when(F.crc32(text.cast("binary")) % 2 == 0, F.lit("audio/wav")).otherwise(F.lit("image/png")).alias("declared"),
            media.wav_of(media.padded(text)).alias("media"),
        ),
        "media",
    )
    seen = stored.withColumn("report", media.sniff(F.col("media"), F.col("declared")))
    body = F.substring(F.col("media"), F.col("report.body_offset").cast("int") + 1, F.col("report.body_length").cast("int"))
    found = F.transform("report.embedded", lambda e: F.concat_ws(":", e["type"], e["offset"], e["length"]))
    return seen.select(
        "doc_id",
        "n_bytes",
        F.octet_length(body).cast("long").alias("payload_bytes"),
        F.sha2(body, 256).alias("payload_sha256"),
        F.crc32(F.substring(body, -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            ";",
            F.concat(F.lit("type="), F.col("report.type")),
            F.concat(F.lit("declared="), F.col("declared")),
            F.concat(F.lit("corrected="), F.col("report.corrected").cast("string")),
            F.concat(F.lit("length="), F.col("report.length").cast("string")),
            F.concat(F.lit("embedded="), F.concat_ws(",", found)),
        ).alias("feature"),
    )


def op2_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_layout.render(F.col("html"))
    pages = _table(spark, sf_dir, "pages").select("page_id", text.alias("text"))
    return pages.select("page_id", "text", F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).alias("n_lines"))


def op3_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits of each text: ten characters go at a quarter, three words come in the middle, a sentence is put for the last five characters."""
    docs = _table(spark, sf_dir, "documents")
    n = F.char_length(F.coalesce("text", F.lit("")))
    kind = "array<struct<start:bigint,delete:bigint,insert:string>>"
    edits = [(n / 4, 10, ""), (n / 2, 0, " one more thing"), (n - 5, 5, ". The end.")]
    todo = F.array(*[F.struct(F.floor(at).cast("long").alias("start"), F.lit(cut).cast("long").alias("delete"), F.lit(new).alias("insert")) for at, cut, new in edits])
    trees = materialize(tokencount.build_trees(docs.withColumn("edits", todo.cast(kind)), keep={"edits": kind}), "token-trees")
    return tokencount.edit_trees(trees, full=False).select("doc_id", "n_before", "n_tokens", "n_edits", "text_bytes", "encoded_bytes")


def op4_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenbin.write_tokens(_table(spark, sf_dir, "documents"))
    return tokenbin.read_tokens(manifest, full=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_captures(_table(spark, sf_dir, "pages"))
    captures = warc.assemble(warc.read_records(files, keep_block=False))
    return captures.select(
        "page_id",
        "payload_bytes",
        F.col("payload_sha256").alias("payload_digest"),
        "record_type",
        F.col("original.page_id").alias("refers_to"),
    )


def op7_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score_documents(_table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_quality_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit_on_labels(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text", "n_chars"), model, meta_cols=("n_chars",))
    return scored.select(
        "doc_id",
        (quality.fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


WARC_SQL = """
WITH sized AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), digests AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM sized
), firsts AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM digests
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM firsts
"""

MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
    CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, list_extract([5, 2, 1], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT) AS weight,
    3 * source_size AS cap
  FROM sources
), filled AS (
  SELECT *, cap::DOUBLE / weight AS fill FROM ranked
), levels AS (
  SELECT *,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE
      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM filled
  WINDOW before AS (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), water AS (
  SELECT coalesce(max(level) FILTER (WHERE level <= fill), 0.0) AS water FROM levels
), targets AS (
  SELECT source, source_size, least(cap::DOUBLE, water * weight) AS target FROM levels, water
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS base FROM targets
), groups AS (
  SELECT source, h, sum(size)::BIGINT AS words FROM sized GROUP BY source, h
), walked AS (
  SELECT source, h, words,
    sum(words) OVER (PARTITION BY source ORDER BY h ROWS UNBOUNDED PRECEDING) - words AS before
  FROM groups
)
SELECT s.doc_id, s.size, b.source_size, b.target,
  (s.size * (b.base + CASE WHEN 2 * w.before + w.words <= 2 * (b.target - b.base * b.source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s
JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
JOIN walked w ON s.source IS NOT DISTINCT FROM w.source AND s.h = w.h
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_sniff": op1_media_sniff,
    "op2_html_layout": op2_html_layout,
    "op3_edit_counts": op3_edit_counts,
    "op4_token_frames": op4_token_frames,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_warc_transactions": op6_warc_transactions,
    "op7_recurrent_lm": op7_recurrent_lm,
    "op8_decontaminate": op8_decontaminate,
    "op9_mix_sources": op9_mix_sources,
    "op10_quality_machine": op10_quality_machine,
}

ORACLE: dict[str, str] = {
    "op6_warc_transactions": WARC_SQL,
    "op9_mix_sources": MIX_SQL,
}
