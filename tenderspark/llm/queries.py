"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderspark.llm import decontamination, fill_middle, filter_audit, html_text, language, licenses, media, near_dedup, personal_data, secrets, sentencepiece_lattice, token_ids, web_archive


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_table(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.train(docs))
    return found.select("doc_id", F.coalesce(language.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secrets.scan_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    def joined(column):
        return F.concat_ws(",", F.transform(column, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))))

    base = F.filter("spans", lambda s: s.kind.isin(secrets.BASE_KINDS))
    return spans.select("doc_id", *map(count, secrets.BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web_archive.read_archives(web_archive.write_archives(table(spark, sf_dir, "pages")), payloads=False)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_lattice.encode_summary(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.read_ids(token_ids.write_ids(table(spark, sf_dir, "documents")))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = personal_data.scan_personal(table(spark, sf_dir, "documents"), personal_data.train(personal_data.labelled_table(spark)))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    def joined(column):
        return F.concat_ws(",", F.transform(column, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))))

    base = F.filter("spans", lambda s: s.kind.isin(personal_data.BASE_KINDS))
    return spans.select("doc_id", *map(count, personal_data.BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    again = fill_middle.restored(F.col("output"), F.col("form"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256")]
    return made.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), *digests)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_columns": op1_media_columns,
    "op2_language_id": op2_language_id,
    "op3_license_scans": op3_license_scans,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_secret_scans": op5_secret_scans,
    "op6_html_extraction": op6_html_extraction,
    "op7_warc": op7_warc,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_token_ids": op10_token_ids,
    "op11_personal_data": op11_personal_data,
    "op12_filter_audit": op12_filter_audit,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLES: dict[str, str] = {
    "op4_minhash_near_dedup": near_dedup.ORACLE,
    "op9_benchmark_decontamination": decontamination.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
    "op13_fill_in_middle": fill_middle.ORACLE,
    "op7_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, p.payload_digest,
               CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id > first_id THEN first_id END AS refers_to
        FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100""",
}
