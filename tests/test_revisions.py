"""Titles of published revisions and snapshots."""

import random

import pytest
from pyspark.sql import functions as F

from tenderspark.operators import revisions

SECTIONS = "section_id int, proposal_id int, section_title string, requirement_id int, content string, status string, generated_run_id int, user_modified boolean, sort_order int"


@pytest.mark.parametrize(
    "kept,staged,rows", [("\tTechnical Approach\n", "Technical Approach", 1), (" straße ", "STRASSE", 1), ("Technical  Approach", "Technical Approach", 2), (None, None, 2), ("ΛΌΓΟΣ", "λόγος", 1)]
)
def test_titles_compare_stripped_and_folded(spark, kept, staged, rows):
    runs = spark.createDataFrame([(7, 1, "running", 1, "s")], "run_id int, proposal_id int, status string, outline_size int, snapshot string")
    coming = spark.createDataFrame([(7, 1, 20, staged, None, "new")], "run_id int, outline_index int, section_id int, section_title string, requirement_id int, content string")
    sections = spark.createDataFrame([(10, 1, kept, None, "own", "approved", None, True, 0)], SECTIONS)
    now = spark.createDataFrame([(1, "s")], "proposal_id int, snapshot string")
    assert revisions.publish_revision(runs, coming, sections, now).count() == rows


def test_snapshot_is_the_same_in_any_order_and_counts_repeats(spark):
    r = random.Random(2)
    proposals = spark.createDataFrame([(1, 5), (2, 5), (3, None)], "proposal_id int, rfp_id int")
    sections = [(i, 1 + i % 2, f"t{i}") for i in range(40)]
    needs = [(i, 5, r.choice(["a", "b", None, ""])) for i in range(40)]

    def snapshots(s, n):
        made = spark.createDataFrame(s, "section_id int, proposal_id int, updated_at string"), spark.createDataFrame(n, "requirement_id int, rfp_id int, raw_text_content string")
        return {x.proposal_id: x.snapshot for x in revisions.proposal_snapshot(proposals, made[0].repartition(3), made[1].repartition(2)).collect()}

    first = snapshots(sections, needs)
    assert snapshots(sections[::-1], r.sample(needs, len(needs))) == first and len(set(first.values())) == 3
    twice = snapshots(sections + sections[:1], needs)
    assert twice[1] != first[1] and twice[2] == first[2]
    changed = snapshots(sections, [(i, f, "x" if i == 0 else t) for i, f, t in needs])
    assert changed[1] != first[1] and changed[3] == first[3]


def test_snapshot_plan_aggregates_before_joins(spark):
    p = spark.range(5).select(F.col("id").alias("proposal_id"), F.col("id").alias("rfp_id"))
    s = spark.range(5).select(F.col("id").alias("proposal_id"), F.col("id").alias("section_id"), F.lit("t").alias("updated_at"))
    n = spark.range(5).select(F.col("id").alias("rfp_id"), F.col("id").alias("requirement_id"), F.lit("x").alias("raw_text_content"))
    plan = revisions.proposal_snapshot(p, s, n)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "partial_sum" in plan
