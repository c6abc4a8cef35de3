"""The small cases of the inventory: each operator on a few rows with the expected answer written out."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tenderspark.functions import drafts, numbers, text, vocab
from tenderspark.operators import backfill, chunking, matrix, ops, retrieval, revisions, rollups, seams
from tenderspark.sources import tables
from tests import plain_chunks


def one(spark, column, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first().v


REQS = "rfp_id string, requirement_id string, section_number string, raw_text_content string, category string, compliance_status string, extraction_order int, type string"


def reqs(spark, rows):
    return spark.createDataFrame([("r", str(i), s, t, c, st, i, "mandatory") for i, (s, t, c, st) in enumerate(rows)], REQS)


def test_status_roll_up(spark):
    df = reqs(spark, [("C.1", "SHALL overhaul the pump.", "Technical", "compliant"), ("C.2", "SHALL provide test reports.", "Testing", "exception"), ("C.3", "SHALL mark all parts.", "Marking", "pending")])
    row = rollups.with_score(rollups.compliance_counts(df)).first()
    assert (row["all"], row.addressed, row.partial, row.missing, row.na, row.score) == (3, 1, 1, 1, 0, 50)
    assert rollups.with_score(rollups.compliance_counts(reqs(spark, [("", "x", None, "na")]))).first().score == 0
    five = reqs(spark, [("", "x", None, "addressed")] * 5 + [("", "x", None, None), ("", "x", None, "ADDRESSED"), ("", "x", None, "missing")])
    assert rollups.with_score(rollups.compliance_counts(five)).first().score == 62
    assert rollups.mandatory_score(five).first().score == 63


def test_checklist(spark):
    proposals = spark.createDataFrame([("a", "r"), ("b", None), ("c", "r")], "proposal_id string, rfp_id string")
    r = reqs(spark, [("", "x", None, "addressed")])
    sections = spark.createDataFrame([("a", " ", "approved"), ("c", "x", "approved")], "proposal_id string, content string, status string")
    got = {(x.proposal_id, x.item): x.status for x in rollups.integrity_checklist(proposals, r, sections).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "a"} == {"extracted": "verified", "addressed": "verified", "drafted": "review_required", "approved": "verified", "score": "verified"}
    assert {v for k, v in got.items() if k[0] == "b"} == {"missing"} and got["c", "drafted"] == "verified"


def test_sanitize_matrix(spark):
    s = "The contractor shall do it."
    df = reqs(spark, [("L", s, "a", None), ("", "   ", "a", None), ("", "x", "a", None), ("", s.upper(), "a", None), ("  ", "  MFA is REQUIRED.  ", "a", None), ("", "A" * 9000, "a", None)])
    clean = matrix.sanitize_matrix(df).orderBy("extraction_order").collect()
    assert [(r.section_number, r.raw_text_content) for r in clean] == [("L", s), ("N/A", "MFA is REQUIRED."), ("N/A", "A" * 4000)]
    assert matrix.rejected_counts(df, matrix.sanitize_matrix(df)).first().rejected == 3


@pytest.mark.parametrize("line,yes", [("## Scope", True), ("SECTION L", True), ("attachment 3", True), ("C.3.1 Scope of Work", True), ("INSTRUCTIONS TO OFFERORS", True), ("The contractor shall work.", False), ("A" * 121, False), ("", False)])
def test_headings(spark, line, yes):
    assert plain_chunks.heading_line(line) is yes
    assert one(spark, text.is_heading(F.lit(line))) is yes


def chunks(spark, *calls):
    """The chunks of (text, target, most, overlap) by the columns, which must be those of the plain walk."""
    out = []
    for doc, *how in calls:
        got = one(spark, chunking.semantic_chunks(F.col("t"), *how), "t string", (doc,))
        assert got == plain_chunks.chunk(doc, *how)
        out.append(got)
    return out


def test_chunker(spark):
    assert chunks(spark, ("", 10, 10), (None, 10, 10), ("  \n ", 10, 10), (" short ", 10, 10)) == [[], [], [], ["short"]]
    clauses = "\n\n".join(f"C.{i} Clause i\nThe contractor shall perform task number {i} with all the due care. " + "x" * 150 for i in range(30))
    words = " ".join(f"w{i:05d}" for i in range(2000))
    parts, cut, uncut, two = chunks(spark, (clauses, 3000, 4000), (words, 1000, 1000, 100), (words, 1000, 1000), ("SECTION A\n" + "a" * 300 + "\nSECTION B\n" + "b" * 300, 50, 400, 50))
    assert len(parts) > 1 and max(map(len, parts)) <= 4000
    assert all(sum(f"C.{i} Clause" in p and f"number {i} " in p for p in parts) == 1 for i in range(30))
    assert cut[0][-100:] == cut[1][:100] and uncut[0][-100:] != uncut[1][:100] and len(two) == 2


def test_chunker_keeps_everything(spark):
    r = random.Random(1)
    docs = []
    for _ in range(300):
        lines = [r.choice(["SECTION 1", "", " ", "C.1 Scope of Work", "x" * r.randint(1, 300), "plain words here"]) for _ in range(r.randint(0, 30))]
        docs.append(r.choice(["\n", "\r\n", "\n\n", "\u2028"]).join(lines))
    for most in (20, 75, 200):
        for overlap in (0, 7):
            df = spark.createDataFrame([(d,) for d in docs], "t string")
            for doc, parts in df.select("t", chunking.semantic_chunks(F.col("t"), most // 2, most, overlap)).collect():
                assert parts == plain_chunks.chunk(doc, most // 2, most, overlap)
                assert all(len(p) <= most for p in parts)
                assert overlap or "".join("".join(parts).split()) == "".join(doc.split())
    plan = df.select(chunking.extraction_chunks(F.col("t"), 40))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_text_columns(spark):
    t = lambda c: one(spark, c)
    assert t(text.text_quality_ok(F.lit("A clean sentence of prose."))) and not t(text.text_quality_ok(F.lit("§§§¶¶¶•••¤¤¤ a"))) and not t(text.text_quality_ok(F.lit("short")))
    assert t(text.markdown_table(F.expr("array(array('a','b|c'), array('d\ne'), array(null,'f'))"))) == "| a | b\\|c |\n| --- | --- |\n| d e |  |\n|  | f |"
    assert t(text.markdown_table(F.expr("cast(array() as array<array<string>>)"))) == ""
    assert t(text.strip_requirement_tags(F.lit("a [Req 1] b [Req 1, 2] c [req 1, Req 2, 3]."))) == "a b c."
    assert t(text.choose_page_text(F.lit(" x "), F.lit("A much longer text by OCR"))) == "A much longer text by OCR" and t(text.choose_page_text(F.lit("x" * 30), F.lit("y" * 90))) == "x" * 30
    assert t(text.failure_reason(F.lit("E"), F.lit(" "))) == "E" and len(t(text.failure_reason(F.lit("E"), F.lit("m" * 900)))) == 501
    assert t(text.truncate(F.lit("abc  def"), 5)) == "abc …[truncated]"
    assert t(text.strip(F.lit("  a　"))) == "a"
    assert t(text.quote_grounded(F.lit("short"), F.lit(""))) and not t(text.quote_grounded(F.lit("x" * 50), F.lit("y")))
    assert t(vocab.map_status(F.lit("ADDRESSED"))) == "missing" and t(vocab.map_status(F.lit("Exception"))) == "partial" and t(vocab.map_category(F.lit("Instruction"))) == "admin"
    assert t(numbers.format_currency(F.lit(49907.88))) == "$49,907.88" and t(numbers.format_currency(F.lit(1500000.0), True)) == "$1.5M" and t(numbers.format_currency(F.lit(-12.5))) == "-$12.5"
    assert t(numbers.unit_vector(F.expr("array(0.0, 0.0)"))) == [0.0, 0.0] and t(numbers.unit_vector(F.expr("array(3.0, 4.0)"))) == [0.6, 0.8]


def test_draft_rules(spark):
    def rule(content, n=0, headings=False, tags=False, context=None):
        row = (content, n, headings, tags, context)
        c = drafts.draft_rejection(F.col("content"), F.col("n"), F.col("h"), F.col("t"), F.col("c"))
        return one(spark, c, "content string, n int, h boolean, t boolean, c string", row)

    good = "We have done this work for the agency. " * 3
    assert rule(good) is None and rule("too short") == rule("  ") == rule(None) == "too_short" and rule(good, 6) == "too_short_for_requirements"
    assert rule(good + "[INSERT name]") == rule(good + " TBD ") == rule(good + " XXX") == "placeholders"
    assert rule(good + "world-class seamless unparalleled trusted partner") == "filler_heavy" and rule(good + "seamless") is None
    assert rule(good, headings=True) == "no_required_heading" and rule("## technical approach\n" + good, headings=True) is None
    assert rule(good * 3 + "[Req 1]", 2, tags=True) == "missing_requirement_tags" and rule(good, 0, tags=True) is None
    assert rule(good + "W91QUZ-19-C-0042", context="x") == "unverifiable_facts" and rule(good + "$4,200,000", context="for $4,200,000") is None and rule(good + "$4,200,000") is None
    assert one(spark, drafts.missing_req_tags(F.lit("[Req 1] [Req 2, Req 3]"), F.lit(3))) == [2, 3]


def test_critic(spark):
    def critic(addressed=True, aligned=True, benefit=True, claims=(), filler=(), feedback=None):
        return (addressed, aligned, benefit, list(claims), list(filler), [], feedback)

    rows = [("a", 0, 1, critic(claims=["x"])), ("a", 0, 2, critic(claims=["x"])), ("b", 0, 1, critic(claims=["x"])), ("b", 0, 2, critic(filler=["y"])), ("b", 0, 3, critic(aligned=False))]
    df = spark.createDataFrame(rows, f"run_id string, outline_index int, attempt int, critic {drafts.CRITIC}")
    out = {(r.run_id, r.attempt): (r.passes, r.stalled, r.next) for r in revisions.revise_or_save(revisions.critic_stall(df)).collect()}
    assert out == {("a", 1): (False, False, "revise"), ("a", 2): (False, True, "save"), ("b", 1): (False, False, "revise"), ("b", 2): (False, False, "revise"), ("b", 3): (False, False, "save")}
    notes = drafts.review_notes(F.lit("text"), F.lit(None).cast("string"), F.lit(True), F.lit(2), F.lit(1), F.lit(True), F.expr("array('a')"), F.expr("array('b','a')"))
    assert [n.split(" ")[0] for n in one(spark, notes).split("\n")] == ["Only", "Some", "Retrieved"]
    assert one(spark, drafts.combine_feedback(F.expr("array('x','y')"))) == "[Revision 1 feedback]\nx\n\n[Revision 2 feedback]\ny"
    status = lambda content, err: one(spark, drafts.final_status(F.lit(content), F.from_json(F.lit(f'[{{"guardrail_error": {err}}}]'), drafts.ATTEMPTS)))
    assert (status("x", "null"), status("", '"e"'), status(None, "null")) == ("saved", "guardrail_rejected", "draft_failed")


def summary(**scalars):
    c = lambda k: {"value": scalars.get(k), "source_quote": scalars.get(k + "_q")}
    admin = {k: c(k) for k in ("solicitation_number", "title_of_opportunity", "agency_or_organization", "naics_code", "set_aside_type")}
    dead = {k: c(k) for k in ("questions_due_date", "proposal_due_date", "period_of_performance")}
    factors = [{"factor": f, "description": None, "importance": None, "source_quote": q} for f, q in scalars.get("factors", [])]
    limits = [{"volume": v, "limit": n, "source_quote": None} for v, n in scalars.get("limits", [])]
    sub = {"submission_method": {"value": None, "description": None, "source_quote": None}, "page_limits": limits, "required_volumes_or_sections": []}
    return {"administrative": admin, "deadlines": dead, "submission_requirements": sub, "technical_core": {"primary_objective": c("primary_objective"), "key_deliverables": []}, "evaluation_factors": factors, "instructions_to_offerors": []}


def test_summaries(spark):
    a = summary(proposal_due_date="2026-08-15", factors=[("Technical Merit", None)], limits=[("Technical", "30"), ("Technical", "30")])
    b = summary(solicitation_number="W912-25-R-0001", proposal_due_date="2026-09-01", factors=[("Past Performance", None), ("Technical Merit", "q")], limits=[("Technical", "30"), ("Pricing", "10")])
    df = spark.createDataFrame([("r", 1, b), ("r", 0, a), ("s", 0, a)], f"rfp_id string, chunk_idx int, summary {matrix.SUMMARY}")
    out = {x.rfp_id: x.summary for x in matrix.merge_summaries(df).collect()}
    r = out["r"]
    assert r.administrative.solicitation_number.value == "W912-25-R-0001" and r.deadlines.proposal_due_date.value == "2026-08-15"
    assert [f.factor for f in r.evaluation_factors] == ["Technical Merit", "Past Performance"]
    assert [tuple(x)[:2] for x in r.submission_requirements.page_limits] == [("Technical", "30"), ("Pricing", "10")]
    assert len(out["s"].submission_requirements.page_limits) == 2
    source = "L.4 Format: Times New Roman 12pt.  M.2 Technical Merit is more important than price"
    c = summary(naics_code="1", naics_code_q="an invented quotation of more than forty characters", agency_or_organization="A", agency_or_organization_q="short", factors=[("T", "m.2 technical merit is more important than price"), ("U", "this quotation was invented by somebody, and it is long")])
    clean = matrix.sanitize_summary(spark.createDataFrame([("r", c)], f"rfp_id string, summary {matrix.SUMMARY}"), spark.createDataFrame([("r", source)], "rfp_id string, text string")).first()
    assert clean.removed == 2 and clean.summary.administrative.naics_code.value is None and clean.summary.administrative.agency_or_organization.value == "A"
    assert [f.factor for f in clean.summary.evaluation_factors] == ["T"]
    criteria = matrix.evaluation_criteria(reqs(spark, [("", "own", "Evaluation Criteria", None)]), spark.createDataFrame([("r", a)], f"rfp_id string, summary {matrix.SUMMARY}"))
    assert [x.criterion for x in criteria.orderBy("pos").collect()] == ["own", "Technical Merit"]
    block = one(spark, drafts.solicitation_block(F.col("s")), f"s {matrix.SUMMARY}", (b,))
    assert block.split("\n") == ["- Solicitation #: W912-25-R-0001", "- Proposal due: 2026-09-01", "- Page limits:", "    * Technical: 30", "    * Pricing: 10"]
    assert one(spark, drafts.solicitation_block(F.col("s")), f"s {matrix.SUMMARY}", (summary(),)) is None


def test_company_block(spark):
    past = [{"id": str(i), "contract_number": f"N{i}", "agency": "A", "value": float(i) if i else None, "scope": "s", "period": "p"} for i in range(10)]
    p = spark.createDataFrame([("t", "Acme", None, None, None, None, None, [], None, ["ISO"], None, None, past), ("u", *[None] * 6, [], None, [], None, None, [])], tables.SCHEMAS["profiles"])
    out = {r.tenant: r.b for r in p.select("tenant", drafts.company_block(F.struct("*")).alias("b")).collect()}
    assert out["t"].split("\n")[:4] == ["- Legal name: Acme", "- Certifications: ISO", "- Past performance (top 8 by value):", "    * N9 — A, $9, p: s"] and out["u"] is None


def test_fusion_and_diversity(spark):
    s = "query_id string, origin string, chunk_id string, score double, rank int"
    fused = retrieval.rrf_fuse(spark.createDataFrame([("q", "library", "both", 0.6, 2), ("q", "library", "dense", 0.9, 1)], s), spark.createDataFrame([("q", "library", "both", 0.6, 1), ("q", "library", "word", 0.5, 2)], s))
    rows = fused.orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ["both", "dense", "word"] and rows[2].score == 0.5
    hits = spark.createDataFrame([("s", "dominant.pdf", 0.9 - i / 100, i) for i in range(5)] + [("s", "other.pdf", 0.5, 9)] + [("one", "d", 0.9 - i / 10, i) for i in range(4)], "section_id string, source_name string, score double, order int")
    out = retrieval.diversify(hits, 3).collect()
    assert sorted(r.source_name for r in out if r.section_id == "s") == ["dominant.pdf", "dominant.pdf", "other.pdf"] and sum(r.section_id == "one" for r in out) == 3
    ctx = spark.createDataFrame([("s", "past_bid", 0.4, 1), ("s", "capability", 0.8, 2), ("s", "past_bid", 0.6, 3), ("s", " ", 0.9, 4)], "section_id string, source_name string, score double, place int")
    assert retrieval.reference_tags(ctx).first().reference_tags == ["capability", "past_bid"]
    sections = spark.createDataFrame([("s",), ("t",)], "section_id string")
    assert {r.section_id: r.confidence for r in retrieval.grounding_confidence(sections, spark.createDataFrame([("s", 0.9), ("s", 0.5), ("s", None)], "section_id string, score double")).collect()} == {"s": 0.7, "t": 0.0}


def greedy(hits, k, cap=2):
    kept, over, seen = [], [], {}
    for h in sorted(hits, key=lambda h: (-h[1], h[2])):
        if len(kept) == k:
            break
        if seen.get(h[0], 0) < cap:
            kept.append(h)
            seen[h[0]] = seen.get(h[0], 0) + 1
        else:
            over.append(h)
    return (kept + over)[:k]


def test_diversify_equals_the_greedy_loop(spark):
    r = random.Random(2)
    groups = {s: [(r.choice("abcd"), round(r.random(), 1), i) for i in range(r.randint(1, 12))] for s in range(40)}
    df = spark.createDataFrame([(s, *h) for s, hs in groups.items() for h in hs], "section_id int, source_name string, score double, order int")
    out = {}
    for x in retrieval.diversify(df, 5).orderBy("place").collect():
        out.setdefault(x.section_id, []).append((x.source_name, x.score, x.order))
    assert out == {s: greedy(hs, 5) for s, hs in groups.items()}


def library(spark, n=400):
    r = random.Random(3)
    rows = [(i, "t" if r.random() < 0.8 else "u", None if i % 3 else 1, f"s{i % 5}", r.choice(["pump repair", "pump overhaul work", "audit of books"]), [r.gauss(0, 1) for _ in range(8)], "i", "d", "won") for i in range(n)]
    return spark.createDataFrame(rows, "chunk_id long, tenant string, proposal_id long, source_name string, content string, embedding array<float>, industry string, document_type string, outcome string")


def test_search_plans_and_recall(spark, monkeypatch):
    chunks = library(spark)
    queries = chunks.where("chunk_id % 20 = 0").selectExpr("chunk_id query_id", "tenant", "CAST(1 AS long) proposal_id", "'the pump' text", "embedding", "CAST(NULL AS string) industry", "CAST(NULL AS string) document_type", "CAST(NULL AS string) outcome")
    exact = retrieval.knn_join(queries, chunks, 5)
    monkeypatch.setattr(retrieval, "BLOCK", 16)  # many blocks: the same answer
    same = retrieval.knn_join(queries, chunks, 5)
    key = lambda df: {(r.query_id, r.origin, r.chunk_id, r.rank) for r in df.collect()}
    assert key(exact) == key(same)
    near = retrieval.ann_candidates(queries, chunks, 5, share=0.3)
    drop = lambda k: {x[:3] for x in k}
    assert len(drop(key(near)) & drop(key(exact))) >= 0.9 * len(key(exact))
    found = retrieval.search(queries, chunks, 4, -1.0)
    by = {}
    for r in found.orderBy("pos").collect():
        by.setdefault(r.query_id, []).append(r.origin)
    assert all(o == sorted(o) and len(o) <= 4 for o in by.values())
    assert retrieval.search(queries.withColumn("text", F.lit("  ")), chunks).count() == 0
    for df in (exact, retrieval.keyword_join(queries, chunks, 5)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_pools(spark):
    chunks = spark.createDataFrame([("t", None, "doc"), ("t", 1, "doc"), ("t", 2, "other")], "tenant string, proposal_id int, source_name string")
    keys = spark.createDataFrame([("t", "doc", 1)], "tenant string, source_name string, proposal_id int")
    left = {(r.proposal_id, r.source_name) for r in tables.delete_source(chunks, keys).collect()}
    assert left == {(None, "doc"), (2, "other")}
    assert {(r.proposal_id) for r in tables.cascade_delete(chunks, keys.select("proposal_id")).collect()} == {None, 2}
    assert retrieval.pool_filter(chunks, None).count() == 1


def test_publish(spark):
    cols = "section_id string, proposal_id string, section_title string, requirement_id string, content string, status string, generated_run_id string, user_modified boolean"
    old = spark.createDataFrame([("1", "p", "Intro", None, "x", "needs_review", "r0", False), ("2", "p", " PLAN ", None, "x", "approved", "r0", False), ("3", "p", "Mine", "q9", "x", "draft", None, None)], cols)
    staged = spark.createDataFrame([("r1", i, f"n{i}", t, q, "new") for i, (t, q) in enumerate([("Intro", None), ("plan", None), ("Other", "q9"), ("Fresh", "q1")])], "run_id string, outline_index int, section_id string, section_title string, requirement_id string, content string")
    now = spark.createDataFrame([("p", "s")], "proposal_id string, snapshot string")
    run = lambda status="running", size=4, snap="s": spark.createDataFrame([("r1", "p", status, size, snap)], "run_id string, proposal_id string, status string, outline_size int, snapshot string")
    done = revisions.publish_revision(run(), staged, old, now)
    assert {r.section_id for r in done.collect()} == {"2", "3", "n0", "n3"}
    for r, verdict in ((run("completed"), "replay"), (run("failed"), "inactive"), (run(size=5), "incomplete"), (run(snap="z"), "conflict")):
        assert revisions.run_verdicts(r, staged, now).first().verdict == verdict
        assert {x.section_id for x in revisions.publish_revision(r, staged, old, now).collect()} == {"1", "2", "3"}
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


T0 = dt.datetime(2024, 1, 1)


def sec(n):
    return T0 + dt.timedelta(seconds=n)


def test_requests_tickets_sessions(spark):
    log = spark.createDataFrame([(1, "u", "op", "k", "h1", sec(0)), (2, "u", "op", "k", "h1", sec(1)), (3, "u", "op", "k", "h2", sec(2)), (4, "u", "op", None, "h", sec(3)), (5, "u", "op", None, "h", sec(4)), (6, "u", "op", " ", "h", sec(5))], "request_id int, user_id string, operation string, idempotency_key string, request_hash string, ts timestamp")
    assert {r.request_id: r.outcome for r in revisions.idempotent_requests(log).collect()} == {1: "new", 2: "replay", 3: "conflict", 4: "new", 5: "new", 6: "invalid"}
    issued = spark.createDataFrame([("a", "p", sec(0)), ("b", "p", sec(0))], "ticket string, proposal_id string, ts timestamp")
    redeemed = spark.createDataFrame([(1, "a", "p", sec(5)), (2, "a", "p", sec(6)), (3, "b", "x", sec(5)), (4, "b", "p", sec(6)), (5, "b", "p", sec(31)), (6, "z", "p", sec(1))], "redemption_id int, ticket string, proposal_id string, ts timestamp")
    assert {r.redemption_id: r.outcome for r in revisions.single_use_tickets(issued, redeemed).collect()} == {1: "ok", 2: "already_used", 3: "wrong_proposal", 4: "already_used", 5: "unknown_or_expired", 6: "unknown_or_expired"}
    chain = [(i, i + 1 if i not in (0, 2, 7) else None, sec(i)) for i in range(8)]
    got = {r.token_id: r.origin for r in backfill.session_origin(spark.createDataFrame(chain, "token_id int, replaced_by int, created_at timestamp")).collect()}
    assert got == {0: sec(0), 1: sec(1), 2: sec(1), **{i: sec(3) for i in range(3, 8)}}


def walk(times, seconds):
    out = []
    for t in times:
        if not out or t >= out[-1][0] + seconds:
            out.append([t, 0])
        out[-1][1] += 1
    return [tuple(w) for w in out]


def test_windows_equal_the_loop(spark):
    r = random.Random(5)
    times = {k: sorted(r.randint(0, 900) for _ in range(r.randint(1, 60))) for k in range(12)}
    df = spark.createDataFrame([(k, i, sec(t)) for k, ts in times.items() for i, t in enumerate(ts)], "key int, event_id int, ts timestamp")
    got = {}
    for x in ops.anchored_windows(df, 60, 3).orderBy("window_start").collect():
        got.setdefault(x.key, []).append((int((x.window_start - T0).total_seconds()), x.n))
        assert x.over_limit == (x.n > 3)
    assert got == {k: walk(ts, 60) for k, ts in times.items()}
    warned = {}
    for x in ops.suppressed_warnings(df, 60).orderBy("ts").collect():
        warned.setdefault(x.key, []).append(x.suppressed)
    assert warned == {k: [0] + [n - 1 for _, n in walk(ts, 60)[:-1]] for k, ts in times.items()}
    resets = spark.createDataFrame([(1, 1, sec(0), False), (1, 2, sec(1), True), (1, 3, sec(2), False)], "key int, event_id int, ts timestamp, reset boolean")
    assert sorted(x.n for x in ops.anchored_windows(resets, 60, 3).collect()) == [1, 1]


def test_usage(spark):
    calls = spark.createDataFrame([("gemini-2.0-flash", 1_000_000, 500_000, 10.0, True), ("gemini-2.0-flash", 0, 0, 0.0, False), ("text-embedding-004", 5, 5, 1.0, True), ("unheard-of", 5, 5, 1.0, True)], "model string, tokens_in long, tokens_out long, latency_ms double, ok boolean")
    out = {r.model: r for r in ops.llm_usage_rollup(calls, ops.price_table(spark)).collect()}
    m = out["gemini-2.0-flash"]
    assert (m.calls, m.errors, m.est_cost, m.priced) == (2, 1, 0.3, True)
    assert (out["text-embedding-004"].est_cost, out["text-embedding-004"].priced, out["unheard-of"].priced) == (0.0, True, False) and out[None].calls == 4


def test_markdown():
    blocks = chunking.markdown_blocks("# A **b** c\ntext one\ntext two\n\nTechnical Approach\n- item\n* **x**\nprose\nManagement Plan\n#no\n")
    assert [(b["kind"], b["level"], "".join(r["text"] for r in b["runs"])) for b in blocks] == [
        ("heading", 1, "A b c"), ("paragraph", 0, "text one text two"), ("heading", 2, "Technical Approach"), ("bullet", 0, "item"), ("bullet", 0, "x"), ("paragraph", 0, "prose Management Plan #no"),
    ]
    assert [r["bold"] for r in blocks[0]["runs"]] == [False, True, False]


def test_seams(spark):
    docs = spark.createDataFrame([("t", None, "src", "i", "d", "won", "word " * 600), ("t", 1, "b", None, None, None, " ")], "tenant string, proposal_id int, source_name string, industry string, document_type string, outcome string, text string")
    lib = seams.build_library(docs, lambda xs: [[len(x), 1.0, 0.0] for x in xs], 3)
    assert lib.count() == 3 and all(abs(sum(v * v for v in r.embedding) - 1) < 1e-5 for r in lib.collect())
    with pytest.raises(Exception, match="embedding of shape"):
        seams.build_library(docs, lambda xs: [[1.0] for _ in xs], 3)

    def hyde(xs):
        if any("bad" in x for x in xs):
            raise RuntimeError
        return [x.upper() for x in xs]

    pairs = spark.createDataFrame([("t", "good"), ("t", "good"), ("t", "bad")], "title string, requirement string")
    out = seams.distinct_before_inference(pairs, hyde).collect()
    assert sorted(r.query for r in out) == ["T\nGOOD", "T\nGOOD", "t\nbad"] and len({r.hyde_key for r in out}) == 2
    chunks = spark.createDataFrame([("r", 0, "a"), ("r", 1, "b")], "rfp_id string, chunk_idx int, chunk string")
    extract = lambda xs: [[{"section_number": "", "raw_text_content": f"shall do {x}", "category": "Technical", "search_keywords": [x]}, {"section_number": "", "raw_text_content": "same text", "category": "Technical", "search_keywords": []}] for x in xs]
    assert [r.raw_text_content for r in seams.extract_requirements(chunks, extract, vocab.EXTRACTED_CATEGORIES).orderBy("extraction_order").collect()] == ["shall do a", "same text", "shall do b"]

    def summarise(xs):
        if "b" in xs:
            raise RuntimeError
        return [summary(naics_code="1") for _ in xs]

    docs2 = chunks.union(spark.createDataFrame([("z", 0, "b")], chunks.schema))
    got = {r.rfp_id: r.summary for r in seams.extract_summaries(docs2, summarise, spark.createDataFrame([("r", "x")], "rfp_id string, text string")).collect()}
    assert got["r"].administrative.naics_code.value == "1" and got["z"] is None
    sections = spark.createDataFrame([("1", "p", 0, False, False, None), ("2", "bad", 0, False, False, None), ("3", "s", 0, False, False, None)], "section_id string, prompt string, requirement_count int, require_headings boolean, require_tags boolean, source_context string")
    status = {r.section_id: r.final_status for r in seams.score_drafts(sections, lambda xs: [hyde([x])[0] * (30 if x == "p" else 1) for x in xs]).collect()}
    assert status == {"1": "saved", "2": "draft_failed", "3": "guardrail_rejected"}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "up").mkdir()
    (tmp_path / "up/a.PDF").write_bytes(b"x%PDF-1.7")
    (tmp_path / "up/b.exe").write_bytes(b"x")
    up = tables.read_uploads(spark, f"{tmp_path}/up").select("name", tables.upload_problem(F.col("name"), F.col("size")).alias("p"), tables.sniff_pdf(F.col("content")).alias("pdf"))
    assert {r.name: (r.p, r.pdf) for r in up.collect()} == {"a.PDF": (None, True), "b.exe": ("unsupported", False)}
    problem = lambda name, size: one(spark, tables.upload_problem(F.lit(name), F.lit(size)))
    assert (problem("a.txt", 0), problem("a.exe", 0), problem("a.docx", 60_000_000), problem("noname", 5)) == ("empty", "unsupported", "too_large", "unsupported")
    rows = lambda *x: spark.createDataFrame(list(x), "rfp_id string, raw_text_content string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "rfp_id string")
    path = f"{tmp_path}/matrix"
    state = lambda: sorted((r.rfp_id, r.raw_text_content) for r in tables.read_requirements(spark, path).collect())
    tables.replace_requirements(rows(("a", "1"), ("b", "2")), ids("a", "b"), path)
    for _ in range(2):  # a repeated replacement changes nothing
        tables.replace_requirements(rows(("a", "9")), ids("a", "c"), path)
        assert state() == [("a", "9"), ("b", "2")]
    tables.replace_requirements(rows(("x", "x")).limit(0), ids("a"), path)
    assert state() == [("b", "2")]
    m = spark.createDataFrame([("p", 2, "s", "na", 'a "q", b'), ("p", 1, "s", "na", "x")], "proposal_id string, number int, section string, status string, text string")
    tables.write_matrix_csv(m, f"{tmp_path}/csv")
    assert [r.number for r in spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv").collect()] == ["1", "2"]
    p = spark.createDataFrame([("p", "T", "sub")], "proposal_id string, title string, subtitle string")
    s = spark.createDataFrame([("p", 1, "b", "B", ""), ("p", 0, "a", "A", "body")], "proposal_id string, sort_order int, section_id string, section_title string, content string")
    md = tables.proposal_markdown(p, s)
    assert md.first().markdown == "# T\n\n_sub_\n\n## A\n\nbody\n\n## B\n\n(no content)\n"
    tables.write_proposal_markdown(md, f"{tmp_path}/md")
    (tmp_path / "log.json").write_text('{"timestamp":"2024-01-01T00:00:00Z","request_id":"r","status":500,"error":{"type":"E"}}\n')
    log = tables.read_json_logs(spark, f"{tmp_path}/log.json")
    assert ops.trace(log, "r").first().error.type == "E" and ops.http_status_rollup(log).first().level == "ERROR"
    assert tables.assemble_pages(spark.createDataFrame([("d", 2, "b"), ("d", 1, "a"), ("d", 3, " ")], "doc_id string, page int, text string")).first().text == "a\n\nb"


def test_outline_refs(spark):
    r = reqs(spark, [("", "a", None, None), ("", "b", None, None)])
    plans = spark.createDataFrame([("r", 0, "T", [1, 7, 0], 0), ("r", 1, "U", [9], 5)], "rfp_id string, outline_index int, title string, refs array<int>, target_words int")
    got = {x.outline_index: (x.requirement_ids, x.target_words) for x in matrix.resolve_outline_refs(plans, r).collect()}
    assert got == {0: (["1", "0"], None), 1: ([], 5)}


def test_prompt(spark):
    hits = F.expr("array(named_struct('source_name', 's', 'score', 0.5D, 'content', repeat('x', 2000)))")
    none = F.lit(None).cast("string")
    p = one(spark, drafts.section_prompt(F.lit("T"), F.expr("array('a','b')"), hits, F.lit("fb"), F.lit("sol"), none, F.expr("array('c')"), F.expr("array('w')"), F.lit(100)))
    assert p.prompt.startswith("SOLICITATION CONTEXT:\nsol\n\nPAST-PERFORMANCE CONTEXT:\n[s — relevance 0.50]\n") and "…[truncated]" in p.prompt
    assert p.prompt.endswith("specifically:\nfb\n\n\nWrite the section draft now.") and not p.over_ceiling
    order = [p.prompt.index(x) for x in ("WIN THEMES", "PROPOSAL SECTION: T", "EVALUATION CRITERIA", "REQUIREMENTS THIS", "  2. b", "Target length: approximately 100")]
    assert order == sorted(order)
