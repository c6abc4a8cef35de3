"""Counts, scores and checklists over requirements, proposals and sections.

Every roll-up aggregates the large side first (Spark combines before the shuffle) and joins the small result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenderspark.functions import numbers, text, vocab

COUNTS = ["all", "addressed", "partial", "missing", "na"]


def compliance_counts(requirements: DataFrame) -> DataFrame:
    """A-01: rfp_id, all, addressed, partial, missing, na."""
    status = requirements.select("rfp_id", vocab.map_status(F.col("compliance_status")).alias("s"))
    return status.groupBy("rfp_id").agg(F.count("*").alias("all"), *(F.count_if(F.col("s") == s).alias(s) for s in COUNTS[1:]))


def with_score(counts: DataFrame) -> DataFrame:
    """A-02: the server's score beside the counts."""
    c = F.col
    return counts.withColumn("score", numbers.compliance_score(c("addressed"), c("partial"), c("all"), c("na")))


def proposal_summaries(proposals: DataFrame, requirements: DataFrame) -> DataFrame:
    """A-03: every proposal with the counts and score of its document; zeros where there is none."""
    scored = with_score(compliance_counts(requirements))
    joined = proposals.join(scored, "rfp_id", "left")
    return joined.withColumns({k: F.coalesce(F.col(k), F.lit(0)) for k in [*COUNTS, "score"]})


def mandatory_score(requirements: DataFrame) -> DataFrame:
    """A-04: the client's score over mandatory requirements; na counts, halves round up."""
    s = vocab.map_status(F.col("compliance_status"))
    points = F.when(s == "addressed", 1.0).when(s == "partial", 0.5).otherwise(0.0)
    kept = requirements.withColumn("points", F.when(F.col("type") == "mandatory", points))
    share = F.try_divide(F.sum("points"), F.count("points")) * 100
    return kept.groupBy("rfp_id").agg(F.coalesce(numbers.half_up(share), F.lit(0)).cast("int").alias("score"))


ITEMS = ["extracted", "addressed", "drafted", "approved", "score"]


def integrity_checklist(proposals: DataFrame, requirements: DataFrame, sections: DataFrame) -> DataFrame:
    """A-05: five rows a proposal (proposal_id, item, status)."""
    counts = with_score(compliance_counts(requirements))
    blank = text.strip(F.coalesce("content", F.lit(""))) == ""
    drafts = sections.groupBy("proposal_id").agg(
        F.count("*").alias("n"), F.bool_or(blank).alias("blank"), F.every(F.coalesce(F.col("status") == "approved", F.lit(False))).alias("approved")
    )
    x = proposals.select("proposal_id", "rfp_id").join(counts, "rfp_id", "left").join(drafts, "proposal_id", "left")
    c, linked, every, n = F.col, F.col("rfp_id").isNotNull(), F.coalesce("all", F.lit(0)), F.coalesce("n", F.lit(0))
    state = {
        "extracted": F.when(every > 0, "verified").otherwise("missing"),
        "addressed": F.when((every == 0) | (c("missing") > 0), "missing").when(c("partial") > 0, "review_required").otherwise("verified"),
        "drafted": F.when(n == 0, "missing").when(c("blank"), "review_required").otherwise("verified"),
        "approved": F.when(n == 0, "missing").when(c("approved"), "verified").otherwise("review_required"),
        "score": F.when(c("score") >= 90, "verified").when(c("score") >= 70, "review_required").otherwise("missing"),
    }
    items = F.array(*(F.struct(F.lit(k).alias("item"), F.when(linked, v).otherwise("missing").alias("status")) for k, v in state.items()))
    return x.select("proposal_id", F.explode(items).alias("i")).select("proposal_id", "i.*")


def integrity_progress(checklist: DataFrame) -> DataFrame:
    """A-06: open issues and percent verified."""
    verified = F.count_if(F.col("status") == "verified")
    return checklist.groupBy("proposal_id").agg((F.count("*") - verified).alias("open_issues"), numbers.half_up(verified * 100.0 / F.count("*")).cast("int").alias("percent"))


def dashboard_kpis(summaries: DataFrame) -> DataFrame:
    """A-07: totals and mean score for each tenant."""
    return summaries.groupBy("tenant").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status").isin(vocab.OPEN_PROPOSALS)).alias("in_progress"),
        F.count_if(F.col("status") == "submitted").alias("submitted"),
        F.coalesce(numbers.half_up(F.avg("score")), F.lit(0)).cast("int").alias("avg_compliance"),
    )


def list_sources(chunks: DataFrame) -> DataFrame:
    """A-08: each source of a tenant's pool (a null pool is the library) with its size, age and tags."""
    return chunks.groupBy("tenant", "proposal_id", "source_name").agg(
        F.count("*").alias("n_chunks"), F.max("created_at").alias("created_at"), *(F.max(k).alias(k) for k in ("industry", "document_type", "outcome"))
    )


def history_count(chunks: DataFrame) -> DataFrame:
    """A-09: embedded chunks a tenant, and whether that grounds anything."""
    n = F.count("embedding")
    return chunks.groupBy("tenant").agg(n.alias("n"), (n > 0).alias("grounded"))


def requirement_counts(documents: DataFrame, requirements: DataFrame) -> DataFrame:
    """A-10: requirements of each document, zero included."""
    n = requirements.groupBy("rfp_id").agg(F.count("*").alias("n"))
    return documents.select("rfp_id").join(n, "rfp_id", "left").select("rfp_id", F.coalesce("n", F.lit(0)).alias("n"))


def group_by_section_prefix(requirements: DataFrame) -> DataFrame:
    """A-11: requirement ids of a document by their section up to the first dot, in order."""
    prefix = F.split_part("section_number", F.lit("."), F.lit(1))
    ordered = F.array_sort(F.collect_list(F.struct("extraction_order", "requirement_id")))
    return requirements.groupBy("rfp_id", prefix.alias("prefix")).agg(F.transform(ordered, lambda s: s.requirement_id).alias("requirement_ids"))


def last_extracted(requirements: DataFrame) -> DataFrame:
    """A-12."""
    return requirements.groupBy("rfp_id").agg(F.max("created_at").alias("last_extracted"))


def text_quality_metrics(docs: DataFrame) -> DataFrame:
    """A-17: words, share of distinct words (lower case, no punctuation), words a page, share of other characters."""
    words = text.word_list(F.col("text"))
    bare = F.filter(F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))), lambda w: w != "")
    x = docs.select("*", words.alias("_w"), bare.alias("_b"))
    n, other = F.size("_w"), F.length(F.regexp_replace("text", r"(?U)[\p{L}\s]", ""))
    ratio = lambda a, b: F.coalesce(F.bround(F.try_divide(a, b), 4), F.lit(0.0))
    return x.select("doc_id", n.alias("words"), ratio(F.size(F.array_distinct("_b")), F.size("_b")).alias("unique_ratio"), ratio(n, F.col("pages")).alias("words_per_page"), ratio(other, F.length("text")).alias("noise_ratio"))


def review_summary(proposals: DataFrame, requirements: DataFrame, profiles: DataFrame, sections: DataFrame) -> DataFrame:
    """A-22: mandatory requirements, past-performance entries and drafted sections of each proposal."""
    reqs = requirements.where("type = 'mandatory'").groupBy("rfp_id").agg(F.count("*").alias("mandatory"))
    past = profiles.select("tenant", F.greatest(F.size(F.coalesce("past_performance", F.array())), F.lit(0)).alias("past_performance"))
    done = sections.where(text.strip(F.coalesce("content", F.lit(""))) != "").groupBy("proposal_id").agg(F.count("*").alias("drafted"))
    x = proposals.select("proposal_id", "rfp_id", "tenant").join(reqs, "rfp_id", "left").join(past, "tenant", "left").join(done, "proposal_id", "left")
    return x.select("proposal_id", *(F.coalesce(k, F.lit(0)).alias(k) for k in ("mandatory", "past_performance", "drafted")))


def number_requirements(requirements: DataFrame) -> DataFrame:
    """W-01: 1-based position within the document."""
    return requirements.withColumn("number", F.row_number().over(W.partitionBy("rfp_id").orderBy("extraction_order", "requirement_id")))


def answerable(requirements: DataFrame) -> DataFrame:
    """P-06: requirements a proposal answers; all of a document's where it has none of those."""
    flag = F.coalesce(F.col("category").isin(vocab.ANSWERABLE), F.lit(False))
    any_flag = F.max(F.col("_own")).over(W.partitionBy("rfp_id"))
    return requirements.withColumn("_own", flag).withColumn("_any", any_flag).where("_own OR NOT _any").drop("_own", "_any")


def tenant_scope(df: DataFrame, owners: DataFrame) -> DataFrame:
    """P-03: rows whose (id, owner) pair is owned; a missing owner is not."""
    return df.join(owners, ["id", "owner"], "left_semi")


def search_proposals(df: DataFrame, term: str) -> DataFrame:
    """P-07."""
    key = F.lower(F.lit(term))
    return df.where(F.lower("title").contains(key) | F.lower("solicitation_number").contains(key) | F.lower("agency").contains(key))


def filter_requirements(df: DataFrame, status: str = "all", term: str = "") -> DataFrame:
    """P-08: over projected requirements (text, section, compliance_status)."""
    key = F.lower(F.lit(term))
    own = F.lit(True) if status == "all" else F.col("compliance_status") == status
    return df.where(own & (F.lower("text").contains(key) | F.lower("section").contains(key)))


def project_requirement(numbered: DataFrame) -> DataFrame:
    """P-09: the contract's row of a numbered requirement."""
    return numbered.select(
        F.col("requirement_id").alias("id"),
        F.col("rfp_id").alias("document_id"),
        "number",
        F.coalesce("section_number", F.lit("")).alias("section"),
        F.col("raw_text_content").alias("text"),
        vocab.map_category(F.col("category")).alias("category"),
        F.lit("mandatory").alias("type"),
        vocab.map_status(F.col("compliance_status")).alias("compliance_status"),
        F.coalesce(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")).alias("created_at"),
    )


def project_section(sections: DataFrame) -> DataFrame:
    """P-10: the contract's row of a section."""
    content = F.coalesce("content", F.lit(""))
    return sections.select(
        F.col("section_id").alias("id"),
        "proposal_id",
        F.col("section_title").alias("title"),
        F.coalesce(F.when(F.col("status") != "", F.col("status")), F.when(content == "", "empty").otherwise("draft")).alias("status"),
        text.word_count(content).alias("word_count"),
        F.coalesce(F.col("ai_confidence_score").cast("double"), F.lit(0.0)).alias("confidence"),
        F.when(F.col("requirement_id").isNotNull(), F.array("requirement_id")).otherwise(F.array().cast("array<bigint>")).alias("mapped_requirement_ids"),
        F.coalesce("reference_tags", F.array().cast("array<string>")).alias("reference_tags"),
    )


def active_sessions(tokens: DataFrame, now: Column, current: Column) -> DataFrame:
    """P-11: sessions that are neither revoked nor expired, newest first, the caller's own marked."""
    alive = F.col("revoked_at").isNull() & (F.col("expires_at") > now) & (F.col("session_expires_at") > now)
    return tokens.where(alive).withColumn("current", F.coalesce(F.col("session_id") == current, F.lit(False))).orderBy(F.desc("created_at"), "token_id")


def archived(proposals: DataFrame) -> DataFrame:
    """P-12."""
    return proposals.where("status = 'submitted'")


def sections_in_order(sections: DataFrame) -> DataFrame:
    """O-01."""
    return sections.orderBy("proposal_id", "sort_order", "created_at", "section_id")


def proposals_newest(proposals: DataFrame) -> DataFrame:
    """O-02."""
    return proposals.orderBy("tenant", F.desc("updated_at"), "proposal_id")


def sort_requirements(df: DataFrame, key: str, ascending: bool = True) -> DataFrame:
    """O-03: strings without regard to case, ties by number."""
    c = F.lower(key) if dict(df.dtypes)[key] == "string" else F.col(key)
    return df.orderBy(c.asc() if ascending else c.desc(), "number")


def due_jobs(jobs: DataFrame, now: Column, limit: int = 20) -> DataFrame:
    """O-04: the earliest due jobs; Spark takes the top rows of each partition first."""
    return jobs.where(F.col("status").isin("queued", "running") & (F.col("next_dispatch_at") <= now)).orderBy("next_dispatch_at", "job_id").limit(limit)
