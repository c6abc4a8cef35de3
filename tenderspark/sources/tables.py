"""Sources and sinks: model tables, uploads, logs, matrices, CSV and Markdown exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderspark.functions import text
from tenderspark.functions.drafts import ATTEMPTS
from tenderspark.operators.matrix import SUMMARY
from tenderspark.sources import matrix_csv, versions

# Fixed values.
SUFFIXES = [".pdf", ".docx", ".txt"]
MAX_UPLOAD = 50 * 1024 * 1024

SCHEMAS = {
    "documents": f"rfp_id string, uploaded_by string, file_name string, s3_storage_key string, processing_status string, failure_reason string, solicitation_summary {SUMMARY}, uploaded_at timestamp, updated_at timestamp",
    "requirements": "requirement_id string, rfp_id string, section_number string, raw_text_content string, category string, compliance_status string, search_keywords array<string>, extraction_order int, created_at timestamp",
    "chunks": "chunk_id string, tenant string, proposal_id string, source_name string, content string, embedding array<float>, industry string, document_type string, outcome string, created_at timestamp",
    "proposals": "proposal_id string, tenant string, rfp_id string, title string, solicitation_number string, agency string, due_date string, status string, target_profit_margin double, page_limit int, drafting_status string, drafting_failure_reason string, created_at timestamp, updated_at timestamp",
    "sections": "section_id string, proposal_id string, requirement_id string, section_title string, content string, status string, review_notes string, ai_confidence_score float, reference_tags array<string>, sort_order int, generated_run_id string, user_modified boolean, created_at timestamp, updated_at timestamp",
    "trajectories": f"run_id string, proposal_id string, section_id string, section_title string, outline_index int, attempts {ATTEMPTS}, final_status string, stalled boolean, attempt_count int, created_at timestamp",
    "runs": "run_id string, proposal_id string, status string, snapshot string, outline array<string>",
    "staged": "run_id string, outline_index int, section_id string, section_title string, requirement_id string, content string",
    "profiles": "tenant string, legal_name string, cage_code string, uei_number string, duns_number string, naics_code string, naics_description string, socio_economic_status array<string>, cmmc_level string, certifications array<string>, security_clearance string, capabilities_overview string, past_performance array<struct<id:string,contract_number:string,agency:string,value:double,scope:string,period:string>>",
    "companies": "company_id string, name string",
    "tokens": "token_id string, user_id string, replaced_by string, created_at timestamp, revoked_at timestamp, expires_at timestamp, session_id string, session_expires_at timestamp",
}
LOG_SCHEMA = "timestamp timestamp, level string, logger string, message string, request_id string, method string, path string, status int, duration_ms double, llm_model string, tokens_in long, tokens_out long, latency_ms double, ok boolean, error struct<type:string,message:string>"


def read_tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    """S-01: the model's tables with their fixed schemas."""
    return {n: spark.read.schema(SCHEMAS[n]).parquet(f"{folder}/{n}.parquet") for n in names or SCHEMAS}


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """S-02: name, size, content; a narrow projection reads no content. Spark's source skips files of no bytes, so empty
    uploads must come from a manifest of names and sizes to be reported by upload_problem."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), "content")


def upload_problem(name: Column, size: Column) -> Column:
    """S-03: unsupported (415), empty (400) or too_large (413), checked in this order; null for a good upload."""
    suffix = F.regexp_extract(F.lower(name), r"\.[^.]+$", 0)
    return F.when(~suffix.isin(SUFFIXES), "unsupported").when(size == 0, "empty").when(size > MAX_UPLOAD, "too_large")


def sniff_pdf(content: Column) -> Column:
    """S-04."""
    return F.instr(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), "%PDF-") > 0


def content_digest(content: Column) -> Column:
    """S-05: of bytes."""
    return F.sha2(content, 256)


def payload_digest(**fields: Column) -> Column:
    """S-05: of a payload, whatever the order of its fields."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields)))), 256)


def read_json_logs(spark: SparkSession, path: str) -> DataFrame:
    """S-06: the columns of LOG_SCHEMA, `damaged`: the line where it is not a record of that schema (its other columns are
    null then), and `fields`: all that a whole line holds, so fields that the schema does not know are kept."""
    names = [f.name for f in spark.createDataFrame([], LOG_SCHEMA).schema]
    read = F.from_json("value", f"{LOG_SCHEMA}, _damaged string", {"columnNameOfCorruptRecord": "_damaged", "mode": "PERMISSIVE"})
    lines = spark.read.text(path).where("trim(value) <> ''").select("value", read.alias("r"))
    whole = F.col("r._damaged").isNull() & F.col("r").isNotNull()
    return lines.select(*(F.when(whole, F.col(f"r.{n}")).alias(n) for n in names), F.when(~whole, F.col("value")).alias("damaged"), F.when(whole, F.try_parse_json("value")).alias("fields"))


def replace_requirements(new: DataFrame, touched: DataFrame, path: str, batch: tuple[str, int] | None = None, bucket_bytes: int = versions.BUCKET_BYTES) -> bool:
    """S-07, D-13: the touched documents' rows become those of `new`, also where it has none, in one step for readers; a
    repeated batch (source, number) changes nothing."""
    return versions.replace(new, touched, path, "rfp_id", batch, bucket_bytes)


def read_requirements(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table that `replace_requirements` keeps."""
    return versions.read(spark, path)


def write_matrix_csv(requirements: DataFrame, path: str) -> None:
    """S-08: proposal_id, number, section, status, text -> a CSV file in a folder a proposal, by number."""
    matrix_csv.write(requirements, path)


def read_matrix_csv(spark: SparkSession, path: str) -> DataFrame:
    """What `write_matrix_csv` wrote, texts with line breaks, quotes and white space around them included."""
    return matrix_csv.read(spark, path)


def proposal_markdown(proposals: DataFrame, sections: DataFrame) -> DataFrame:
    """S-09: proposal_id, markdown."""
    body = F.coalesce(F.nullif("content", F.lit("")), F.lit("(no content)"))
    part = F.concat(F.lit("## "), F.coalesce("section_title", F.lit("Untitled section")), F.lit("\n\n"), body, F.lit("\n"))
    own = sections.groupBy("proposal_id").agg(F.array_sort(F.collect_list(F.struct("sort_order", "section_id", part.alias("part")))).alias("s"))
    head = F.concat(F.lit("# "), F.col("title"), F.lit("\n"))
    sub = F.when(F.coalesce("subtitle", F.lit("")) != "", F.concat(F.lit("_"), F.col("subtitle"), F.lit("_\n")))
    return proposals.join(own, "proposal_id", "left").select("proposal_id", F.concat_ws("\n", head, sub, F.array_join(F.transform("s", lambda x: x.part), "\n")).alias("markdown"))


def write_proposal_markdown(markdown: DataFrame, path: str) -> None:
    """S-09: one text file a proposal."""
    markdown.repartition("proposal_id").write.mode("overwrite").partitionBy("proposal_id").option("lineSep", "\n").text(path)


def delete_source(chunks: DataFrame, keys: DataFrame) -> DataFrame:
    """S-10: chunks without those of the given (tenant, source_name, proposal_id); a null proposal is the library."""
    k = keys.select(*(F.col(c).alias(f"_{c}") for c in ("tenant", "source_name", "proposal_id"))).distinct()
    same = (F.col("tenant") == F.col("_tenant")) & (F.col("source_name") == F.col("_source_name")) & F.col("proposal_id").eqNullSafe(F.col("_proposal_id"))
    return chunks.join(k, same, "left_anti")


def cascade_delete(children: DataFrame, deleted: DataFrame) -> DataFrame:
    """S-11: rows of deleted proposals go; rows without a proposal stay."""
    return children.join(deleted.select("proposal_id").distinct(), "proposal_id", "left_anti")


def assemble_pages(pages: DataFrame) -> DataFrame:
    """F-08: doc_id, page, text -> doc_id, text: pages that are not blank, in order."""
    kept = pages.where(text.strip(F.coalesce("text", F.lit(""))) != "")
    return kept.groupBy("doc_id").agg(F.concat_ws("\n\n", F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p.text)).alias("text"))
