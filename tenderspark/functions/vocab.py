"""Vocabularies of statuses, categories and pipeline steps, and the columns that map stored values onto them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
FRONT_STATUSES = ["addressed", "partial", "missing", "na"]
STORED_STATUSES = {"pending": "missing", "compliant": "addressed", "exception": "partial"}
CATEGORIES = [
    "scope", "technical", "testing", "quality_assurance", "packaging", "marking", "financial", "legal", "compliance",
    "personnel", "reporting", "security", "service_level", "admin",
]
LEGACY_CATEGORIES = {
    "technical": "technical",
    "security": "security",
    "past performance": "compliance",
    "instruction": "admin",
    "evaluation criteria": "compliance",
}
ANSWERABLE = ["Technical", "Security", "Past Performance"]
EXTRACTED_CATEGORIES = ["Technical", "Security", "Past Performance", "Instruction", "Evaluation Criteria"]
STEPS = [
    ("upload", "Upload"),
    ("parse", "Parse"),
    ("extract", "Extract requirements"),
    ("classify", "Classify"),
    ("ready", "Ready"),
]
STEPS_DONE = {"pending": 1, "parsing": 1, "extracting": 2, "completed": 5, "failed": 2}
OPEN_PROPOSALS = ["in_progress", "review_needed", "incomplete"]


def lookup(key: Column, table: dict, default) -> Column:
    """A chain of comparisons: constant-folded and code-generated, unlike a map literal."""
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def map_status(raw: Column) -> Column:
    """Known statuses pass as they are (case counts), stored ones are translated, all else is missing."""
    return F.when(raw.isin(FRONT_STATUSES), raw).otherwise(lookup(F.lower(raw), STORED_STATUSES, "missing"))


def map_category(raw: Column) -> Column:
    low = F.lower(raw)
    return F.when(low.isin(CATEGORIES), low).otherwise(lookup(low, LEGACY_CATEGORIES, "technical"))


def remap_drafting_status(status: Column) -> Column:
    """Documents no longer carry drafting states: these count as completed."""
    return F.when(status.isin("drafting", "drafted", "draft_failed"), F.lit("completed")).otherwise(status)


def remap_failure_reason(status: Column, reason: Column) -> Column:
    """The reason of a failed draft leaves the document, other reasons stay."""
    return F.when(F.coalesce(status, F.lit("")) != "draft_failed", reason)


def pipeline_view(status: Column) -> Column:
    """struct<done, failed, progress, run_status, message, steps: array<struct<id, state>>> of a document status."""
    done = lookup(status, STEPS_DONE, 0)
    failed = F.coalesce(status == "failed", F.lit(False))
    n = len(STEPS)
    labels = F.array(*(F.lit(label) for _, label in STEPS))
    state = lambda i: (
        F.when(failed & (done == i), "failed").when(done > i, "completed").when(done == i, "running").otherwise("pending")
    )
    message = F.when(failed, "Processing failed.").when(done >= n, "Processing complete.").otherwise(F.concat(F.lit("Running: "), F.get(labels, done)))
    return F.struct(
        done.alias("done"),
        failed.alias("failed"),
        F.bround(F.least(done, F.lit(n)) * 100.0 / n, 0).cast("int").alias("progress"),
        F.when(failed, "failed").when(done >= n, "completed").otherwise("running").alias("run_status"),
        message.alias("message"),
        F.array(*(F.struct(F.lit(name).alias("id"), state(i).alias("state")) for i, (name, _) in enumerate(STEPS))).alias("steps"),
    )
