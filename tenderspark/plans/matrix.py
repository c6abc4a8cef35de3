"""Queries over requirements, proposals, documents and sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenderspark.functions import drafts, numbers, vocab
from tenderspark.operators import backfill, matrix, revisions, rollups
from tenderspark.plans.registry_tools import Registry
from tenderspark.sources import tables
from tenderspark.sources.shared import new_path

R = Registry()

STATUS = "CASE WHEN compliance_status IN ('addressed','partial','missing','na') THEN compliance_status WHEN lower(compliance_status) = 'compliant' THEN 'addressed' WHEN lower(compliance_status) = 'exception' THEN 'partial' ELSE 'missing' END"
CATEGORY = "CASE lower(category) WHEN 'security' THEN 'security' WHEN 'past performance' THEN 'compliance' WHEN 'instruction' THEN 'admin' WHEN 'evaluation criteria' THEN 'compliance' ELSE 'technical' END"
COUNTS = f"""SELECT rfp_id, count(*) AS "all", count(*) FILTER (WHERE s = 'addressed') AS addressed, count(*) FILTER (WHERE s = 'partial') AS partial,
    count(*) FILTER (WHERE s = 'missing') AS missing, count(*) FILTER (WHERE s = 'na') AS na FROM (SELECT rfp_id, {STATUS} AS s FROM requirements) q GROUP BY rfp_id"""
SCORE = 'CASE WHEN "all" - na > 0 THEN CAST(round_even((addressed + partial * 0.5::DOUBLE) * 100.0::DOUBLE / ("all" - na), 0) AS INT) ELSE 0 END'
CHECKLIST = f"""
    WITH c AS (SELECT *, {SCORE} AS score FROM ({COUNTS})),
    d AS (SELECT proposal_id, count(*) AS n, bool_or(trim(coalesce(content, '')) = '') AS blank, bool_and(coalesce(status = 'approved', false)) AS approved FROM sections GROUP BY proposal_id),
    x AS (SELECT p.proposal_id, p.rfp_id, coalesce("all", 0) AS "all", missing, partial, score, coalesce(n, 0) AS n, blank, approved FROM proposals p LEFT JOIN c ON c.rfp_id = p.rfp_id LEFT JOIN d ON d.proposal_id = p.proposal_id),
    i AS (SELECT proposal_id, rfp_id, 'extracted' AS item, CASE WHEN "all" > 0 THEN 'verified' ELSE 'missing' END AS status FROM x
    UNION ALL SELECT proposal_id, rfp_id, 'addressed', CASE WHEN "all" = 0 OR missing > 0 THEN 'missing' WHEN partial > 0 THEN 'review_required' ELSE 'verified' END FROM x
    UNION ALL SELECT proposal_id, rfp_id, 'drafted', CASE WHEN n = 0 THEN 'missing' WHEN blank THEN 'review_required' ELSE 'verified' END FROM x
    UNION ALL SELECT proposal_id, rfp_id, 'approved', CASE WHEN n = 0 THEN 'missing' WHEN approved THEN 'verified' ELSE 'review_required' END FROM x
    UNION ALL SELECT proposal_id, rfp_id, 'score', CASE WHEN score >= 90 THEN 'verified' WHEN score >= 70 THEN 'review_required' ELSE 'missing' END FROM x),
    checklist AS (SELECT proposal_id, item, CASE WHEN rfp_id IS NULL THEN 'missing' ELSE status END AS status FROM i)"""
NUMBERED = "SELECT *, row_number() OVER (PARTITION BY rfp_id ORDER BY extraction_order, requirement_id) AS number FROM requirements"
SUMMARIES = f"""SELECT p.*, coalesce("all", 0) AS "all", coalesce(addressed, 0) AS addressed, coalesce(partial, 0) AS partial, coalesce(missing, 0) AS missing, coalesce(na, 0) AS na,
    coalesce({SCORE}, 0) AS score FROM proposals p LEFT JOIN ({COUNTS}) c ON c.rfp_id = p.rfp_id"""

R.add("a01_compliance_counts", ["requirements"], rollups.compliance_counts, COUNTS)
R.add("a02_compliance_score", ["requirements"], lambda r: rollups.with_score(rollups.compliance_counts(r)), f"SELECT *, {SCORE} AS score FROM ({COUNTS}) c")
R.add("a03_proposal_summaries", ["proposals", "requirements"], rollups.proposal_summaries, SUMMARIES)
R.add(
    "a04_mandatory_score", ["requirements"], rollups.mandatory_score,
    f"""SELECT rfp_id, CAST(coalesce(floor(sum(CASE s WHEN 'addressed' THEN 1.0::DOUBLE WHEN 'partial' THEN 0.5 ELSE 0 END) FILTER (WHERE type = 'mandatory')
        / nullif(count(*) FILTER (WHERE type = 'mandatory'), 0) * 100 + 0.5), 0) AS INT) AS score FROM (SELECT rfp_id, type, {STATUS} AS s FROM requirements) q GROUP BY rfp_id""",
)
R.add("a05_integrity_checklist", ["proposals", "requirements", "sections"], rollups.integrity_checklist, CHECKLIST + " SELECT * FROM checklist")
R.add(
    "a06_integrity_progress", ["proposals", "requirements", "sections"], lambda *t: rollups.integrity_progress(rollups.integrity_checklist(*t)),
    CHECKLIST + """ SELECT proposal_id, count(*) - count(*) FILTER (WHERE status = 'verified') AS open_issues,
        CAST(floor(count(*) FILTER (WHERE status = 'verified') * 100.0 / count(*) + 0.5) AS INT) AS percent FROM checklist GROUP BY proposal_id""",
)
R.add(
    "a07_dashboard_kpis", ["proposals", "requirements"], lambda p, r: rollups.dashboard_kpis(rollups.proposal_summaries(p, r)),
    f"""SELECT tenant, count(*) AS total, count(*) FILTER (WHERE status IN ('in_progress','review_needed','incomplete')) AS in_progress, count(*) FILTER (WHERE status = 'submitted') AS submitted,
        CAST(floor(avg(score) + 0.5) AS INT) AS avg_compliance FROM ({SUMMARIES}) s GROUP BY tenant""",
)
R.add("a10_requirement_counts", ["rfps", "requirements"], rollups.requirement_counts, "SELECT d.rfp_id, count(r.requirement_id) AS n FROM rfps d LEFT JOIN requirements r ON r.rfp_id = d.rfp_id GROUP BY d.rfp_id")
R.add(
    "a11_group_by_section_prefix", ["requirements"], rollups.group_by_section_prefix,
    "SELECT rfp_id, split_part(section_number, '.', 1) AS prefix, list(requirement_id ORDER BY extraction_order, requirement_id) AS requirement_ids FROM requirements GROUP BY 1, 2",
)
R.add("a12_last_extracted", ["requirements"], rollups.last_extracted, "SELECT rfp_id, max(created_at) AS last_extracted FROM requirements GROUP BY rfp_id")
R.add(
    "a22_review_summary", ["proposals", "requirements", "sections"],
    lambda p, r, s: rollups.review_summary(p, r, p.groupBy("tenant").agg(F.array_sort(F.collect_set("solicitation_number")).alias("past_performance")), s),
    """WITH m AS (SELECT rfp_id, count(*) AS n FROM requirements WHERE type = 'mandatory' GROUP BY rfp_id), t AS (SELECT tenant, count(DISTINCT solicitation_number) AS n FROM proposals GROUP BY tenant),
        d AS (SELECT proposal_id, count(*) AS n FROM sections WHERE trim(content) <> '' GROUP BY proposal_id)
        SELECT p.proposal_id, coalesce(m.n, 0) AS mandatory, coalesce(t.n, 0) AS past_performance, coalesce(d.n, 0) AS drafted FROM proposals p LEFT JOIN m ON m.rfp_id = p.rfp_id LEFT JOIN t ON t.tenant = p.tenant LEFT JOIN d ON d.proposal_id = p.proposal_id""",
)
R.add("w01_number_requirements", ["requirements"], rollups.number_requirements, NUMBERED)
R.add("p03_tenant_scope", ["rfps", "proposals"], lambda d, p: rollups.tenant_scope(d.select(F.col("rfp_id").alias("id"), F.col("uploaded_by").alias("owner")), p.select(F.col("rfp_id").alias("id"), F.col("tenant").alias("owner"))), "SELECT rfp_id AS id, uploaded_by AS owner FROM rfps d WHERE EXISTS (SELECT 1 FROM proposals p WHERE p.rfp_id = d.rfp_id AND p.tenant = d.uploaded_by)")
R.add("p06_answerable", ["requirements"], rollups.answerable, "SELECT * FROM requirements QUALIFY category IN ('Technical','Security','Past Performance') OR NOT bool_or(category IN ('Technical','Security','Past Performance')) OVER (PARTITION BY rfp_id)")
R.add("p07_search_proposals", ["proposals"], lambda p: rollups.search_proposals(p, "auTO"), "SELECT * FROM proposals WHERE lower(title) LIKE '%auto%' OR lower(agency) LIKE '%auto%' OR lower(solicitation_number) LIKE '%auto%'")
PROJECTED = f"""SELECT requirement_id AS id, rfp_id AS document_id, number, coalesce(section_number, '') AS section, raw_text_content AS text, {CATEGORY} AS category, 'mandatory' AS type, {STATUS} AS compliance_status,
    coalesce(strftime(created_at, '%Y-%m-%dT%H:%M:%S'), '') AS created_at FROM ({NUMBERED}) n"""
R.add("p09_project_requirement", ["requirements"], lambda r: rollups.project_requirement(rollups.number_requirements(r)), PROJECTED)
R.add("p08_filter_requirements", ["requirements"], lambda r: rollups.filter_requirements(rollups.project_requirement(rollups.number_requirements(r)), "partial", "URGENT"), f"SELECT * FROM ({PROJECTED}) p WHERE compliance_status = 'partial' AND (lower(text) LIKE '%urgent%' OR lower(section) LIKE '%urgent%')")
R.add("o03_sort_requirements", ["requirements"], lambda r: rollups.sort_requirements(rollups.project_requirement(rollups.number_requirements(r)), "text"), PROJECTED)
R.add(
    "p10_project_section", ["sections"], lambda s: rollups.project_section(s.withColumn("reference_tags", F.lit(None).cast("array<string>"))),
    """SELECT section_id AS id, proposal_id, section_title AS title, coalesce(status, CASE WHEN content = '' THEN 'empty' ELSE 'draft' END) AS status, CAST(len(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '')) AS INT) AS word_count,
        coalesce(ai_confidence_score, 0.0) AS confidence, CASE WHEN requirement_id IS NULL THEN []::BIGINT[] ELSE [requirement_id] END AS mapped_requirement_ids, []::VARCHAR[] AS reference_tags FROM sections""",
)
R.add("p12_archived", ["proposals"], rollups.archived, "SELECT * FROM proposals WHERE status = 'submitted'")
R.add("o01_sections_in_order", ["sections"], rollups.sections_in_order, "SELECT * FROM sections")
R.add("o02_proposals_newest", ["proposals"], rollups.proposals_newest, "SELECT * FROM proposals")
R.add("j03_requirement_owner", ["requirements", "rfps"], backfill.requirement_owner, "SELECT requirement_id, rfp_id, uploaded_by AS owner FROM requirements JOIN rfps USING (rfp_id)")
LINKED = """SELECT s.*, r.rfp_id AS req_rfp, r.raw_text_content, d.uploaded_by AS req_owner, p.rfp_id AS own_rfp, p.tenant AS own_tenant FROM sections s LEFT JOIN requirements r ON r.requirement_id = s.requirement_id
    LEFT JOIN rfps d ON d.rfp_id = r.rfp_id JOIN proposals p ON p.proposal_id = s.proposal_id"""
FOUR = ["sections", "requirements", "rfps", "proposals"]
R.add("j04_section_requirement_text", FOUR, backfill.section_requirement_text, f"SELECT section_id, coalesce(nullif(raw_text_content, ''), section_title) AS text FROM ({LINKED}) x WHERE requirement_id IS NULL OR (req_rfp = own_rfp AND req_owner = own_tenant)")
R.add("j05_cross_tenant_links", FOUR, backfill.cross_tenant_links, f"SELECT section_id, proposal_id, requirement_id FROM ({LINKED}) x WHERE req_rfp IS NOT NULL AND NOT coalesce(req_rfp = own_rfp AND req_owner = own_tenant, false)")
R.add("j06_sections_without_proposal", ["sections", "proposals"], backfill.sections_without_proposal, "SELECT * FROM sections s WHERE NOT EXISTS (SELECT 1 FROM proposals p WHERE p.proposal_id = s.proposal_id)")
R.add("j07_mark_drafted", ["proposals", "sections"], backfill.mark_drafted, "SELECT * FROM proposals p WHERE EXISTS (SELECT 1 FROM sections s WHERE p.proposal_id = s.proposal_id)")
R.add("j08_carry_unambiguous_failure", ["proposals", "rfps"], backfill.carry_unambiguous_failure, "SELECT min(p.proposal_id) AS proposal_id, min(d.failure_reason) AS failure_reason FROM proposals p JOIN rfps d ON d.rfp_id = p.rfp_id AND d.processing_status = 'draft_failed' GROUP BY p.rfp_id HAVING count(*) = 1")
R.add("j13_proposals_for_documents", ["proposals", "rfps"], lambda p, d: backfill.proposals_for_documents(p, d.where("processing_status = 'failed'")), "SELECT * FROM proposals WHERE rfp_id IN (SELECT rfp_id FROM rfps WHERE processing_status = 'failed')")
R.add(
    "j14_backfill_rfp", ["sections", "proposals"], lambda s, p: backfill.backfill_rfp(s.select("section_id", "proposal_id", F.when(F.col("sort_order") == 1, F.lit(-1)).cast("bigint").alias("rfp_id")), p),
    "SELECT section_id, s.proposal_id, coalesce(CASE WHEN sort_order = 1 THEN -1 END, p.rfp_id) AS rfp_id FROM sections s LEFT JOIN proposals p ON p.proposal_id = s.proposal_id",
)
R.add("w08_first_proposal_per_rfp", ["proposals"], backfill.first_proposal_per_rfp, "SELECT rfp_id, proposal_id FROM proposals WHERE rfp_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rfp_id ORDER BY created_at, proposal_id) = 1")
R.add("w09_latest_run", ["trajectories"], backfill.latest_run, "SELECT * FROM trajectories QUALIFY rank() OVER (PARTITION BY proposal_id ORDER BY created_at DESC, run_id DESC) = 1")
R.add("a21_final_status_rollup", ["trajectories"], revisions.final_status_rollup, "SELECT final_status, count(*) AS sections, round_even(avg(attempt_count), 4) AS mean_attempts, round_even(avg(CAST(stalled AS DOUBLE)), 4) AS stalled_share FROM trajectories GROUP BY 1")
R.add(
    "a16_section_append_order", ["sections"], lambda s: backfill.section_append_order(s.where("sort_order < 5"), s.where("sort_order >= 5").select("section_id", F.col("proposal_id"))),
    "SELECT section_id, n.proposal_id, coalesce(m, -1) + row_number() OVER (PARTITION BY n.proposal_id ORDER BY section_id) AS sort_order FROM sections n LEFT JOIN (SELECT proposal_id, max(sort_order) AS m FROM sections WHERE sort_order < 5 GROUP BY 1) o ON o.proposal_id = n.proposal_id WHERE n.sort_order >= 5",
)
CLEAN = """SELECT * REPLACE (trim(raw_text_content) AS raw_text_content, CASE WHEN trim(coalesce(section_number, '')) = '' THEN 'N/A' ELSE trim(section_number) END AS section_number) FROM requirements
    WHERE length(trim(raw_text_content)) >= 5 QUALIFY row_number() OVER (PARTITION BY rfp_id, lower(trim(raw_text_content)) ORDER BY o2) = 1"""
R.add(
    "d01_sanitize_matrix", ["requirements"], lambda r: matrix.sanitize_matrix(r.withColumn("extraction_order", F.col("requirement_id"))),
    CLEAN.replace("SELECT * REPLACE (", "SELECT * REPLACE (requirement_id AS extraction_order, ").replace("ORDER BY o2", "ORDER BY requirement_id"),
)
R.add(
    "d01_rejected_counts", ["requirements"], lambda r: matrix.rejected_counts(r, matrix.sanitize_matrix(r.withColumn("extraction_order", F.col("requirement_id")))),
    "SELECT rfp_id, count(*) - count(DISTINCT lower(trim(raw_text_content))) FILTER (WHERE length(trim(raw_text_content)) >= 5) AS rejected FROM requirements GROUP BY rfp_id",
)
R.add(
    "d02_concat_chunk_requirements", ["requirements"],
    lambda r: matrix.concat_chunk_requirements(r.groupBy("rfp_id", F.col("extraction_order").alias("chunk_idx")).agg(F.array_sort(F.collect_list(F.struct("requirement_id", "raw_text_content"))).alias("requirements"))),
    "SELECT rfp_id, row_number() OVER (PARTITION BY rfp_id ORDER BY extraction_order, requirement_id) - 1 AS extraction_order, requirement_id, raw_text_content FROM requirements",
)
R.add(
    "d10_resolve_companies", ["proposals"],
    lambda p: backfill.resolve_companies(
        p.select(F.col("proposal_id").alias("user_id"), F.concat(F.lit("\t"), F.when(F.col("proposal_id") % 2 == 0, F.lower("agency")).otherwise(F.col("agency")), F.lit(" \n")).alias("name"), "created_at"),
        p.where("agency LIKE 'A%'").groupBy("agency").agg(F.min("proposal_id").alias("company_id")).select("company_id", F.col("agency").alias("name")),
    ),
    """WITH n AS (SELECT proposal_id AS user_id, CASE WHEN proposal_id % 2 = 0 THEN lower(agency) ELSE agency END AS name, created_at FROM proposals), k AS (SELECT agency AS name, min(proposal_id) AS company_id FROM proposals WHERE agency LIKE 'A%' GROUP BY 1),
        f AS (SELECT lower(name) AS key, arg_min(name, (created_at, name)) AS fresh FROM n GROUP BY 1)
        SELECT user_id, company_id, coalesce(k.name, fresh) AS company, k.name IS NULL AS is_new FROM n JOIN f ON f.key = lower(n.name) LEFT JOIN k ON lower(k.name) = f.key""",
)
R.add(
    "d08_publish_revision", ["sections", "proposals"],
    lambda s, p: revisions.publish_revision(
        p.select((F.col("proposal_id") + 1_000_000).alias("run_id"), "proposal_id", F.when(F.col("status") == "draft", "failed").otherwise("running").alias("status"), F.lit(2).alias("outline_size"), F.lit("s").alias("snapshot")),
        p.select((F.col("proposal_id") + 1_000_000).alias("run_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("outline_index")).selectExpr("run_id", "outline_index", "run_id * 10 + outline_index section_id", "concat(chr(9), ' SECTION ', cast(outline_index * 3 as string), chr(10)) section_title", "CASE WHEN outline_index = 2 THEN run_id END requirement_id", "'new' content"),
        s.selectExpr("section_id", "proposal_id", "CASE WHEN sort_order = 6 THEN concat(chr(12), section_title, ' ') ELSE section_title END section_title", "requirement_id", "content", "status", "CASE WHEN sort_order <> 3 THEN 1 END generated_run_id", "sort_order = 2 user_modified"),
        p.select("proposal_id", F.when(F.col("proposal_id") % 5 == 0, "changed").otherwise("s").alias("snapshot")),
    ),
    """WITH live AS (SELECT proposal_id, proposal_id + 1000000 AS run_id FROM proposals WHERE status <> 'draft' AND proposal_id % 5 <> 0),
        old AS (SELECT section_id, proposal_id, CASE WHEN sort_order = 6 THEN concat(chr(12), section_title, ' ') ELSE section_title END AS section_title, requirement_id, content, status, CASE WHEN sort_order <> 3 THEN 1 END AS generated_run_id, sort_order = 2 AS user_modified FROM sections),
        kept AS (SELECT * FROM old WHERE NOT (proposal_id IN (SELECT proposal_id FROM live) AND generated_run_id IS NOT NULL AND NOT user_modified AND coalesce(status <> 'approved', false))),
        new AS (SELECT run_id * 10 + i AS section_id, proposal_id, concat(chr(9), ' SECTION ', i * 3, chr(10)) AS section_title, CASE WHEN i = 2 THEN run_id END AS requirement_id, 'new' AS content, 'needs_review' AS status, run_id AS generated_run_id, false AS user_modified FROM live, (SELECT unnest([1, 2]) AS i))
        SELECT * FROM kept UNION ALL SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.proposal_id = n.proposal_id AND (k.requirement_id = n.requirement_id OR lower(regexp_replace(k.section_title, '^\\s+|\\s+$', '', 'g')) = lower(regexp_replace(n.section_title, '^\\s+|\\s+$', '', 'g'))))""",
)
R.add(
    "d06_upsert_trajectories", ["trajectories"],
    lambda t: revisions.upsert_trajectories(
        t.where("run_id % 3 <> 0").selectExpr("run_id", "outline_index", "proposal_id", "'old' section_title", "final_status", "stalled", "attempt_count", "attempt_count attempts"),
        t.where("run_id % 2 = 0").selectExpr("run_id", "outline_index", "proposal_id", "'new' section_title", "'saved' final_status", "false stalled", "9 attempt_count", "9 attempts"),
    ),
    """SELECT run_id, outline_index, proposal_id, CASE WHEN run_id % 3 <> 0 THEN 'old' ELSE 'new' END AS section_title, CASE WHEN run_id % 2 = 0 THEN 'saved' ELSE final_status END AS final_status,
        CASE WHEN run_id % 2 = 0 THEN false ELSE stalled END AS stalled, CASE WHEN run_id % 2 = 0 THEN 9 ELSE attempt_count END AS attempt_count, CASE WHEN run_id % 2 = 0 THEN 9 ELSE attempt_count END AS attempts FROM trajectories WHERE run_id % 3 <> 0 OR run_id % 2 = 0""",
)
R.add(
    "d07_upsert_profiles", ["proposals"],
    lambda p: revisions.upsert_profiles(
        p.where("proposal_id % 3 <> 0").selectExpr("proposal_id tenant", "title legal_name", "CAST(NULL AS string) cage_code"), p.where("proposal_id % 2 = 0").selectExpr("proposal_id tenant", "CASE WHEN proposal_id % 4 = 0 THEN agency END legal_name"), {"legal_name": "unnamed", "cage_code": "-"}
    ),
    """SELECT proposal_id AS tenant, coalesce(CASE WHEN proposal_id % 4 = 0 THEN agency END, CASE WHEN proposal_id % 3 <> 0 THEN title END, 'unnamed') AS legal_name, '-' AS cage_code FROM proposals WHERE proposal_id % 3 <> 0 OR proposal_id % 2 = 0""",
)
MULTISET = "concat_ws(':', count(*), " + ", ".join(f"sum(CAST(concat('0x', substring(sha256(CAST(to_json({{0}}) AS VARCHAR)), {15 * i + 1}, 15)) AS HUGEINT))" for i in range(4)) + ")"
R.add(
    "d09_proposal_snapshot", ["proposals", "sections", "requirements"], lambda p, s, r: revisions.proposal_snapshot(p, s.withColumn("updated_at", F.date_format("created_at", "yyyy-MM-dd")), r),
    f"""WITH s AS (SELECT proposal_id, {MULTISET.format("{'section_id': section_id, 'updated_at': strftime(created_at, '%Y-%m-%d')}")} AS s FROM sections GROUP BY 1),
        r AS (SELECT rfp_id, {MULTISET.format("{'requirement_id': requirement_id, 'raw_text_content': raw_text_content}")} AS r FROM requirements GROUP BY 1)
        SELECT p.proposal_id, sha256(CAST(to_json({{'rfp_id': p.rfp_id, 's': s, 'r': r}}) AS VARCHAR)) AS snapshot FROM proposals p LEFT JOIN s ON s.proposal_id = p.proposal_id LEFT JOIN r ON r.rfp_id = p.rfp_id""",
)
R.add(
    "p01_map_status", ["requirements"], lambda r: r.select("requirement_id", vocab.map_status(F.col("compliance_status")).alias("status"), vocab.map_category(F.col("category")).alias("category")),
    f"SELECT requirement_id, {STATUS} AS status, {CATEGORY} AS category FROM requirements",
)
R.add("f34_pipeline_view", ["rfps"], lambda d: d.select("rfp_id", vocab.pipeline_view(F.col("processing_status")).alias("v")).select("rfp_id", "v.done", "v.failed", "v.progress", "v.run_status", "v.message"),
    """SELECT rfp_id, d AS done, processing_status = 'failed' AS failed, d * 20 AS progress, CASE WHEN processing_status = 'failed' THEN 'failed' WHEN d = 5 THEN 'completed' ELSE 'running' END AS run_status,
        CASE WHEN processing_status = 'failed' THEN 'Processing failed.' WHEN d = 5 THEN 'Processing complete.' ELSE concat('Running: ', ['Upload', 'Parse', 'Extract requirements'][d + 1]) END AS message
        FROM (SELECT *, CASE processing_status WHEN 'pending' THEN 1 WHEN 'extracting' THEN 2 WHEN 'completed' THEN 5 WHEN 'failed' THEN 2 ELSE 0 END AS d FROM rfps) q""")  # fmt: skip
R.add("f41_remap_status", ["rfps"], lambda d: d.select("rfp_id", vocab.remap_drafting_status(F.col("processing_status")).alias("status"), vocab.remap_failure_reason(F.col("processing_status"), F.col("failure_reason")).alias("reason")),
    "SELECT rfp_id, CASE WHEN processing_status = 'draft_failed' THEN 'completed' ELSE processing_status END AS status, CASE WHEN processing_status <> 'draft_failed' THEN failure_reason END AS reason FROM rfps")
R.add("f39_format_currency", ["proposals"], lambda p: p.select("proposal_id", numbers.format_currency(F.col("updated_at")).alias("plain"), numbers.format_currency(F.col("updated_at") * 1000, True).alias("compact")),
    r"""WITH v AS (SELECT proposal_id, CAST(updated_at AS DOUBLE) AS a, CAST(updated_at AS DOUBLE) * 1000 AS b FROM proposals),
        d AS (SELECT *, [concat(CASE WHEN x < 0 THEN '-$' ELSE '$' END, regexp_replace(regexp_replace(format('{:,.2f}', abs(x)), '(\.\d*?)0+$', '\1'), '\.$', '')) FOR x IN [a, b]] AS s FROM v)
        SELECT proposal_id, s[1] AS plain, CASE WHEN b >= 1e6 THEN concat('$', format('{:.1f}', round(b / 1e6, 1)), 'M') WHEN b >= 1e3 THEN concat('$', CAST(CAST(round(b / 1e3) AS BIGINT) AS VARCHAR), 'K') ELSE s[2] END AS compact FROM d""")  # fmt: skip
R.add(
    "w10_top_past_performance", ["sections"],
    lambda s: s.groupBy("proposal_id").agg(F.array_sort(F.collect_list(F.struct("section_id", F.col("section_title").alias("name"), (F.col("sort_order") * 1.0).alias("value"), "content"))).alias("entries"))
    .select("proposal_id", drafts.top_past_performance(F.col("entries")).alias("t")).select("proposal_id", F.transform("t.shown", lambda e: e.section_id).alias("shown"), "t.omitted"),
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY sort_order DESC, section_id, section_title, content) AS i FROM sections)
        SELECT proposal_id, list(section_id ORDER BY i) FILTER (WHERE i <= 8) AS shown, CAST(greatest(count(*) - 8, 0) AS INT) AS omitted FROM n GROUP BY proposal_id""",
)
R.add(
    "j10_resolve_outline_refs", ["proposals", "requirements"],
    lambda p, r: matrix.resolve_outline_refs(p.where("rfp_id IS NOT NULL").select("rfp_id", F.col("proposal_id").alias("outline_index"), "title", F.array(F.lit(2), (F.col("proposal_id") % 3).cast("int"), F.lit(99), F.lit(-1)).alias("refs"), F.when(F.col("proposal_id") % 4 == 0, 0).otherwise(250).alias("target_words")), r),
    """WITH n AS (SELECT rfp_id, requirement_id, row_number() OVER (PARTITION BY rfp_id ORDER BY extraction_order, requirement_id) - 1 AS ref FROM requirements),
        p AS (SELECT rfp_id, proposal_id AS outline_index, title, [2, proposal_id % 3, 99, -1] AS refs, CASE WHEN proposal_id % 4 = 0 THEN NULL ELSE 250 END AS target_words FROM proposals WHERE rfp_id IS NOT NULL),
        a AS (SELECT rfp_id, outline_index, unnest(refs) AS ref, generate_subscripts(refs, 1) AS pos FROM p), f AS (SELECT rfp_id, outline_index, list(requirement_id ORDER BY pos) AS ids FROM a JOIN n USING (rfp_id, ref) GROUP BY ALL)
        SELECT p.rfp_id, p.outline_index, title, coalesce(ids, []) AS requirement_ids, target_words FROM p LEFT JOIN f ON f.rfp_id = p.rfp_id AND f.outline_index = p.outline_index""",
)
R.add(
    "d03_evaluation_criteria", ["requirements", "proposals"],
    lambda r, p: matrix.evaluation_criteria(r.withColumn("extraction_order", F.col("requirement_id").cast("int")), p.groupBy("rfp_id").agg(F.min(F.struct("proposal_id", "agency", "title", "status")).alias("m")).where("rfp_id IS NOT NULL").select(
        "rfp_id", F.struct(F.array(F.struct(F.col("m.agency").alias("factor"), F.col("m.title").alias("description"), F.lit("").alias("importance")), F.struct(F.lit("Price").alias("factor"), F.lit(None).cast("string").alias("description"), F.col("m.status").alias("importance")), F.struct(F.lit("").alias("factor"), F.lit("d").alias("description"), F.lit("i").alias("importance"))).alias("evaluation_factors")).alias("summary"))),
    """WITH m AS (SELECT rfp_id, arg_min(agency, proposal_id) AS agency, arg_min(title, proposal_id) AS title, arg_min(status, proposal_id) AS status FROM proposals WHERE rfp_id IS NOT NULL GROUP BY rfp_id),
        u AS (SELECT rfp_id, 0 AS part, requirement_id AS pos, raw_text_content AS criterion FROM requirements WHERE category = 'Evaluation Criteria' UNION ALL SELECT rfp_id, 1, 0, concat(agency, ': ', title) FROM m UNION ALL SELECT rfp_id, 1, 1, concat('Price (importance: ', status, ')') FROM m)
        SELECT rfp_id, row_number() OVER (PARTITION BY rfp_id ORDER BY part, pos) - 1 AS pos, criterion FROM u""",
)


def replaced(r):
    """The matrix of all documents, in which every third document is then replaced by its first requirements."""
    path = new_path(r.sparkSession, "requirements")
    tables.replace_requirements(r, r.select("rfp_id"), path)
    third = r.where("rfp_id % 3 = 0")
    tables.replace_requirements(third.where("extraction_order < 5"), third.select("rfp_id"), path)
    return tables.read_requirements(r.sparkSession, path).select("requirement_id", "rfp_id", "raw_text_content")


R.add("s07_replace_requirements", ["requirements"], replaced, "SELECT requirement_id, rfp_id, raw_text_content FROM requirements WHERE rfp_id % 3 <> 0 OR extraction_order < 5")
R.add("f40_section_title_default", ["requirements"], lambda r: r.select("requirement_id", drafts.section_title_default(F.col("section_number")).alias("title")), "SELECT requirement_id, concat('Response to ', coalesce(nullif(section_number, ''), 'requirement')) AS title FROM requirements")
