"""Joins between requirements, documents, proposals and sections: ownership, audits and migrations' backfills."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenderspark.functions import text

from tenderspark.sources.shared import written


def requirement_owner(requirements: DataFrame, documents: DataFrame) -> DataFrame:
    """J-03: requirement_id, rfp_id, owner."""
    return requirements.select("requirement_id", "rfp_id").join(documents.select("rfp_id", F.col("uploaded_by").alias("owner")), "rfp_id")


def _linked(sections: DataFrame, requirements: DataFrame, documents: DataFrame, proposals: DataFrame) -> DataFrame:
    reqs = requirements.select("requirement_id", F.col("rfp_id").alias("req_rfp"), "raw_text_content")
    docs = documents.select(F.col("rfp_id").alias("req_rfp"), F.col("uploaded_by").alias("req_owner"))
    own = proposals.select("proposal_id", F.col("rfp_id").alias("own_rfp"), F.col("tenant").alias("own_tenant"))
    return sections.join(reqs, "requirement_id", "left").join(docs, "req_rfp", "left").join(own, "proposal_id")


def section_requirement_text(sections: DataFrame, requirements: DataFrame, documents: DataFrame, proposals: DataFrame) -> DataFrame:
    """J-04: section_id, text; the requirement's text where it belongs to the proposal's own document and tenant."""
    x = _linked(sections, requirements, documents, proposals)
    own = (F.col("req_rfp") == F.col("own_rfp")) & (F.col("req_owner") == F.col("own_tenant"))
    kept = x.where(F.col("requirement_id").isNull() | F.coalesce(own, F.lit(False)))
    return kept.select("section_id", F.coalesce(F.nullif("raw_text_content", F.lit("")), "section_title").alias("text"))


def cross_tenant_links(sections: DataFrame, requirements: DataFrame, documents: DataFrame, proposals: DataFrame) -> DataFrame:
    """J-05: sections linked to a requirement of another document or tenant."""
    x = _linked(sections, requirements, documents, proposals).where("req_rfp IS NOT NULL")
    own = (F.col("req_rfp") == F.col("own_rfp")) & (F.col("req_owner") == F.col("own_tenant"))
    return x.where(~F.coalesce(own, F.lit(False))).select("section_id", "proposal_id", "requirement_id")


def sections_without_proposal(sections: DataFrame, proposals: DataFrame) -> DataFrame:
    """J-06."""
    return sections.join(proposals.select("proposal_id"), "proposal_id", "left_anti")


def mark_drafted(proposals: DataFrame, sections: DataFrame) -> DataFrame:
    """J-07: proposals that have a section."""
    return proposals.join(sections.select("proposal_id"), "proposal_id", "left_semi")


def carry_unambiguous_failure(proposals: DataFrame, documents: DataFrame) -> DataFrame:
    """J-08: a failed document's reason moves to its proposal if it has only one."""
    only = proposals.groupBy("rfp_id").agg(F.count("*").alias("n"), F.min("proposal_id").alias("proposal_id")).where("n = 1")
    failed = documents.where("processing_status = 'draft_failed'").select("rfp_id", "failure_reason")
    return only.join(failed, "rfp_id").select("proposal_id", "failure_reason")


def session_origin(tokens: DataFrame) -> DataFrame:
    """J-09: token_id -> when its chain of replacements began, by pointer doubling.

    Each round doubles how far back a token sees, so the rounds are logarithmic in the longest chain; the table is
    written between rounds. created_at never falls along a chain, so the earliest is that of the root.
    """
    back = tokens.where("replaced_by IS NOT NULL").select(F.col("replaced_by").alias("token_id"), F.col("token_id").alias("prev"))
    at = tokens.select("token_id", "created_at").join(back, "token_id", "left").selectExpr("token_id", "created_at origin", "prev")
    at = written(at, "sessions")
    while at.where("prev IS NOT NULL").limit(1).count():
        far = at.select(F.col("token_id").alias("prev"), F.col("origin").alias("far_origin"), F.col("prev").alias("far_prev"))
        at = written(at.join(far, "prev", "left").selectExpr("token_id", "least(origin, far_origin) origin", "far_prev prev"), "sessions")
    return at.select("token_id", "origin")


def proposals_for_documents(proposals: DataFrame, changed: DataFrame) -> DataFrame:
    """J-13."""
    return proposals.join(changed.select("rfp_id"), "rfp_id", "left_semi")


def backfill_rfp(sections: DataFrame, proposals: DataFrame) -> DataFrame:
    """J-14: a section without document takes its proposal's."""
    from_proposal = proposals.select("proposal_id", F.col("rfp_id").alias("_rfp"))
    return sections.join(from_proposal, "proposal_id", "left").withColumn("rfp_id", F.coalesce("rfp_id", "_rfp")).drop("_rfp")


def first_proposal_per_rfp(proposals: DataFrame) -> DataFrame:
    """W-08: the oldest proposal of each document."""
    first = F.min(F.struct("created_at", "proposal_id")).alias("f")
    return proposals.where("rfp_id IS NOT NULL").groupBy("rfp_id").agg(first).select("rfp_id", "f.proposal_id")


def latest_run(trajectories: DataFrame) -> DataFrame:
    """W-09: sections of each proposal's most recent run; ties to the larger run_id."""
    newest = trajectories.groupBy("proposal_id").agg(F.max(F.struct("created_at", "run_id")).alias("r")).select("proposal_id", "r.run_id")
    return trajectories.join(newest, ["proposal_id", "run_id"])


def section_append_order(sections: DataFrame, new: DataFrame) -> DataFrame:
    """A-16: sort_order of new sections behind the existing ones."""
    last = sections.groupBy("proposal_id").agg(F.max("sort_order").alias("_last"))
    place = F.row_number().over(W.partitionBy("proposal_id").orderBy("section_id"))
    return new.join(last, "proposal_id", "left").withColumn("sort_order", F.coalesce("_last", F.lit(-1)) + place).drop("_last")


def resolve_companies(names: DataFrame, companies: DataFrame) -> DataFrame:
    """D-10: name -> company; a new name is created once, under its first spelling."""
    clean = names.select(F.col("user_id"), text.strip(F.col("name")).alias("name"), "created_at").where("name <> ''")
    created = clean.groupBy(F.lower("name").alias("key")).agg(F.min(F.struct("created_at", "name")).alias("f")).select("key", F.col("f.name").alias("fresh"))
    known = companies.select(F.lower("name").alias("key"), "company_id", F.col("name").alias("known"))
    table = created.join(known, "key", "left").select("key", "company_id", F.coalesce("known", "fresh").alias("company"), F.col("known").isNull().alias("is_new"))
    return clean.withColumn("key", F.lower("name")).join(table, "key").select("user_id", "company_id", "company", "is_new")
