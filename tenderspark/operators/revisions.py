"""Critic records, upserts, published revisions, idempotent requests and tickets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenderspark.functions import drafts, text

KEY_CHARS, TICKET_SECONDS = 128, 30


def critic_stall(attempts: DataFrame) -> DataFrame:
    """W-11: attempts (run_id, outline_index, attempt, critic) with `passes` and `stalled`.

    A failing round stalls if its non-empty findings equal those of the failing round before it.
    """
    c = F.col("critic")
    none = F.array().cast("array<string>")
    findings = F.array_sort(F.array_distinct(F.concat(F.coalesce(c.unsupported_claims, none), F.coalesce(c.filler_found, none))))
    x = attempts.withColumn("passes", drafts.critic_passes(c)).withColumn("findings", F.when(c.isNotNull() & ~F.col("passes"), findings))
    before = F.last("findings", ignorenulls=True).over(W.partitionBy("run_id", "outline_index").orderBy("attempt").rowsBetween(W.unboundedPreceding, -1))
    return x.withColumn("stalled", F.coalesce((F.size("findings") > 0) & (F.col("findings") == before), F.lit(False))).drop("findings")


def revise_or_save(stalls: DataFrame) -> DataFrame:
    """W-12: what follows each attempt."""
    again = ~F.col("passes") & F.col("critic").isNotNull() & (F.col("attempt") < drafts.MAX_ATTEMPTS)
    return stalls.withColumn("next", F.when(F.col("stalled"), "save").when(again, "revise").otherwise("save"))


def final_status_rollup(trajectories: DataFrame) -> DataFrame:
    """A-21."""
    return trajectories.groupBy("final_status").agg(
        F.count("*").alias("sections"), F.bround(F.avg("attempt_count"), 4).alias("mean_attempts"), F.bround(F.avg(F.col("stalled").cast("double")), 4).alias("stalled_share")
    )


def upsert_trajectories(old: DataFrame, new: DataFrame) -> DataFrame:
    """D-06: new attempts, status, stall and count win; ids and title of an existing row stay."""
    key, moving = ["run_id", "outline_index"], ["attempts", "final_status", "stalled", "attempt_count"]
    fresh = new.select(*key, F.struct(*(c for c in new.columns if c not in key)).alias("_n"))
    kept = old.select(*key, F.struct(*(c for c in old.columns if c not in key)).alias("_o"))
    x = kept.join(fresh, key, "full_outer")
    has_new = F.col("_n").isNotNull()
    pick = lambda c: (F.when(has_new, F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}")) if c in moving else F.when(F.col("_o").isNotNull(), F.col(f"_o.{c}")).otherwise(F.col(f"_n.{c}"))).alias(c)
    return x.select(*(F.col(c) if c in key else pick(c) for c in old.columns))


def upsert_profiles(current: DataFrame, patches: DataFrame, defaults: dict) -> DataFrame:
    """D-07: non-null patch fields win, then the current ones, then defaults."""
    fields = [c for c in current.columns if c != "tenant"]
    p = patches.select("tenant", *(F.col(c).alias(f"_p_{c}") for c in fields if c in patches.columns))
    x = current.join(p, "tenant", "full_outer")
    value = lambda c: F.coalesce(*([F.col(f"_p_{c}")] if c in patches.columns else []), F.col(c), F.lit(defaults.get(c)).cast(current.schema[c].dataType)).alias(c)
    return x.select("tenant", *map(value, fields))


def proposal_snapshot(proposals: DataFrame, sections: DataFrame, requirements: DataFrame) -> DataFrame:
    """D-09: proposal_id, snapshot: a digest of what a draft was based on, whatever the order of rows.

    Sections and requirements become multiset digests of fixed width before they are joined, so no text leaves its row.
    """
    own = sections.groupBy("proposal_id").agg(multiset_digest("section_id", "updated_at").alias("s"))
    req = requirements.groupBy("rfp_id").agg(multiset_digest("requirement_id", "raw_text_content").alias("r"))
    x = proposals.select("proposal_id", "rfp_id").join(own, "proposal_id", "left").join(req, "rfp_id", "left")
    return x.select("proposal_id", F.sha2(F.to_json(F.struct("rfp_id", "s", "r"), {"ignoreNullFields": "false"}), 256).alias("snapshot"))


def multiset_digest(*columns: str) -> Column:
    """An aggregate: the number of rows and four sums of 60 bits each of the rows' SHA-256, as text. Sums commute, so rows
    combine in any order and before the shuffle; repeated rows count."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    sums = [F.sum(F.conv(F.substring(row, 15 * i + 1, 15), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)]
    return F.concat_ws(":", F.count("*").cast("string"), *sums)


def run_verdicts(runs: DataFrame, staged: DataFrame, now: DataFrame) -> DataFrame:
    """D-08a: runs (run_id, proposal_id, status, outline_size, snapshot) with `verdict`:
    replay, inactive, conflict, incomplete or publish. now: proposal_id, snapshot."""
    n = staged.groupBy("run_id").agg(F.count("*").alias("_n"))
    x = runs.join(n, "run_id", "left").join(now.withColumnRenamed("snapshot", "_now"), "proposal_id", "left")
    size = F.coalesce("outline_size", F.lit(0))
    verdict = (
        F.when(F.col("status") == "completed", "replay")
        .when(~F.col("status").isin("queued", "running"), "inactive")
        .when(~F.col("_now").eqNullSafe(F.col("snapshot")), "conflict")
        .when((size == 0) | (F.coalesce("_n", F.lit(0)) != size), "incomplete")
        .otherwise("publish")
    )
    return x.withColumn("verdict", verdict).drop("_n", "_now")


def publish_revision(runs: DataFrame, staged: DataFrame, sections: DataFrame, now: DataFrame) -> DataFrame:
    """D-08: the sections after all publishable runs.

    Generated sections that nobody edited or approved go; staged sections come unless a remaining section of the
    proposal answers the same requirement or carries the same title. That `or` is two equi anti-joins. A proposal
    publishes one run at a time. Titles compare without the white space around them and in folded case.
    """
    live = run_verdicts(runs, staged, now).where("verdict = 'publish'").select("run_id", "proposal_id")
    mine = sections.join(live.select("proposal_id").distinct().withColumn("_live", F.lit(True)), "proposal_id", "left")
    retired = F.col("_live").isNotNull() & F.col("generated_run_id").isNotNull() & ~F.coalesce("user_modified", F.lit(False)) & F.coalesce(F.col("status") != "approved", F.lit(False))
    left = mine.where(~retired).drop("_live")
    title = lambda c: F.upper(text.strip(F.col(c)))  # noqa: E731  upper, not lower: some letters fold into two
    coming = staged.join(live, "run_id").withColumn("_title", title("section_title"))
    by_req = left.select("proposal_id", "requirement_id").where("requirement_id IS NOT NULL")
    by_title = left.select("proposal_id", title("section_title").alias("_title")).where("_title IS NOT NULL")
    coming = coming.join(by_req, ["proposal_id", "requirement_id"], "left_anti").join(by_title, ["proposal_id", "_title"], "left_anti")
    given = {"generated_run_id": F.col("run_id"), "user_modified": F.lit(False), "status": F.when(F.coalesce("content", F.lit("")) != "", "needs_review").otherwise("empty"), "sort_order": F.col("outline_index")}
    values = [given[c] if c in given else F.col(c) if c in coming.columns else F.lit(None) for c in left.columns]
    return left.unionByName(coming.select(*(v.cast(left.schema[c].dataType).alias(c) for c, v in zip(left.columns, values, strict=True))))


def idempotent_requests(log: DataFrame) -> DataFrame:
    """D-11: outcome of each request: new, replay, conflict or invalid. Ties in time go to the smaller request_id."""
    key = F.col("idempotency_key")
    bad = key.isNotNull() & ((text.strip(key) == "") | (F.length(key) > KEY_CHARS))
    w = W.partitionBy("user_id", "operation", "idempotency_key").orderBy("ts", "request_id")
    x = log.withColumn("_bad", bad)
    # Requests without a key never repeat each other; they keep out of the keyed groups, which they would make hot.
    keyed = x.where(key.isNotNull() & ~F.col("_bad")).withColumn("_first", F.first("request_hash").over(w)).withColumn("_n", F.row_number().over(w))
    outcome = F.when(F.col("_n") == 1, "new").when(F.col("request_hash") == F.col("_first"), "replay").otherwise("conflict")
    rest = x.where(key.isNull() | F.col("_bad")).withColumn("outcome", F.when(F.col("_bad"), "invalid").otherwise("new"))
    return keyed.withColumn("outcome", outcome).drop("_first", "_n", "_bad").unionByName(rest.drop("_bad"))


def single_use_tickets(issued: DataFrame, redeemed: DataFrame, ttl: int = TICKET_SECONDS) -> DataFrame:
    """D-12: outcome of each redemption. The first within the time to live consumes the ticket, even for the wrong proposal."""
    x = redeemed.join(issued.select("ticket", F.col("proposal_id").alias("_for"), F.col("ts").alias("_at")), "ticket", "left")
    alive = F.coalesce((F.col("ts") >= F.col("_at")) & (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_at").cast("timestamp")) < ttl * 1_000_000), F.lit(False))
    first = F.row_number().over(W.partitionBy("ticket", alive).orderBy("ts", "redemption_id")) == 1
    outcome = F.when(~alive, "unknown_or_expired").when(~F.col("_first"), "already_used").when(F.col("_for").eqNullSafe(F.col("proposal_id")), "ok").otherwise("wrong_proposal")
    return x.withColumn("_first", first).withColumn("outcome", outcome).drop("_for", "_at", "_first")


def evidence_of(hits: DataFrame) -> DataFrame:
    """section_id, evidence: a section's context rows in order, as blocks for the prompt (F-28)."""
    rows = F.array_sort(F.collect_list(F.struct("place", "source_name", "score", "content")))
    return hits.groupBy("section_id").agg(drafts.evidence_blocks(rows).alias("evidence"))

