"""Registered queries do the whole job: compared with brute force, or with their SQL, which has no cuts."""

import random
import re

import duckdb
import pytest

from tenderspark.operators import retrieval
from tenderspark.plans import registry, search

SF = "/root/testdata/sf0.01"

NORM = lambda t: re.sub(r"\s+", " ", t or "").strip(" ").lower()


def run(spark, folder, name, **tables):
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    return registry.QUERIES[name](spark, str(folder))


def agrees(spark, name, tables):
    """The query's rows equal those of its SQL."""
    sql, con = registry.ORACLES[name], duckdb.connect()
    assert "substring(text" not in sql or name in ("f10_text_columns", "f27_section_prompt")  # there the prefixes are the feature
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    cursor = con.execute(sql)
    at = [[c[0] for c in cursor.description].index(c) for c in df.columns]
    plain = lambda v: tuple(v) if isinstance(v, list) else round(float(v), 5) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    expected = sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)
    assert expected and sorted((tuple(map(plain, r)) for r in df.collect()), key=repr) == expected


def test_quotes_are_sought_in_all_documents(spark, tmp_path):
    r = random.Random(5)
    text = [" ".join(r.choice(["alpha", "beta", "gamma", "Delta  ", "epsilon\n", "x"]) for _ in range(60)) for _ in range(120)]
    items = [(k, text[k][3 : 3 + r.randint(60, 200)]) for k in range(0, 40, 2)] + [(k, "nowhere to be found in any document at all " + str(k)) for k in range(40, 44)]
    items += [(50, "short quote"), (51, None), (52, "q" * 45), (53, "z" * 22 + " " + "y" * 21), (54, "t" * 10 + " middle " + "h" * 30), (55, "a" * 41)]
    text += ["x" + "q" * 50, "a zz" + "z" * 21 + " " + "y" * 25, "p" + "t" * 10 + " middle " + "h" * 31, "", None]
    docs = [(i, t) for i, t in enumerate(text)] + [(7, text[7])]
    expected = set()
    for k, quote in items:
        q = NORM(quote)
        found = {i for i, t in docs if q in NORM(t)} if len(q) >= 40 else set()
        expected |= {(i, k, True) for i in found} or {(None, k, len(q) < 40)}
    quotes, sources = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    rows = [tuple(x) for x in run(spark, tmp_path, "f11_quote_grounded", benchmark=quotes, documents=sources).collect()]
    assert len(rows) == len(expected) and set(rows) == expected
    assert {tuple(x) for x in retrieval.grounded_quotes(quotes, sources, 0).collect()} == expected
    assert retrieval.grounded_quotes(quotes.limit(0), sources).count() == 0
    assert {x.grounded for x in retrieval.grounded_quotes(quotes, sources.limit(0)).collect()} == {False, True}


def test_query_texts_are_whole(spark):
    e, d = (spark.read.parquet(f"{SF}/{t}.parquet") for t in search.BOTH)
    known = {r.doc_id: r.text for r in d.where("doc_id % 50 = 0").collect()}
    assert {r.query_id: r.text for r in search.bound(e, d)[0].collect()} == {r.vec_id: known[r.vec_id] for r in e.where("vec_id % 50 = 0").collect() if r.vec_id in known}


def test_keyword_leg_takes_whole_texts(spark):
    agrees(spark, "j02_keyword_join", search.BOTH)


def test_sections_grow_with_the_table(spark):
    agrees(spark, "w05_section_grounding", search.BOTH)
    grown = spark.range(0, 4000, 50).toDF("query_id").selectExpr(search.SECTION).distinct()
    assert grown.count() == 20


def test_draft_rules_read_whole_texts(spark):
    agrees(spark, "f18_draft_rules", ["documents"])


def test_pages_are_chosen_from_whole_texts(spark):
    agrees(spark, "f07_choose_page_text", ["pages", "documents"])


@pytest.mark.parametrize("name", ["w11_critic_stall", "w12_revise_or_save", "f30_critic_feedback"])
def test_claims_are_whole(spark, name):
    agrees(spark, name, ["conversations"])


def test_feedback_of_all_turns(spark):
    agrees(spark, "f31_combine_feedback", ["conversations"])


def test_columns_of_whole_texts(spark):
    agrees(spark, "f10_text_columns", ["documents"])


def test_table_cells_are_whole(spark, tmp_path):
    rows = [(1, 0, "user", "a long cell | with a bar, " + "and more words " * 20 + "end"), (1, 1, "user", "x"), (1, 2, "model", "second cell that is long")]
    got = run(spark, tmp_path, "f09_markdown_table", conversations=spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).first().table
    assert rows[0][3].replace("|", "\\|") in got and rows[2][3] in got


@pytest.mark.parametrize("name,tables", [
    ("a18_merge_summaries", ["conversations"]), ("f12_sanitize_summary", ["conversations"]), ("f26_solicitation_block", ["conversations"]), ("f25_company_block", ["customer", "lineitem"]),
    ("f27_section_prompt", ["conversations"]), ("f32_review_notes", ["conversations"]), ("d05_distinct_inference", ["orders"]), ("i01_embed_chunks", ["documents"]), ("i02_extract_requirements", ["conversations"]),
    ("d09_proposal_snapshot", ["customer", "lineitem", "orders"]), ("f20_markdown_blocks", ["documents"]),
])
def test_prompts_and_extractions(spark, name, tables):
    agrees(spark, name, tables)


@pytest.mark.parametrize("name", ["t01_usage_windows", "t02_attempt_windows", "t03_progress", "t04_idempotent", "t06_suppressed_warnings"])
def test_streams_of_the_tables(spark, name):
    agrees(spark, name, ["events"])


def test_stream_replaces(spark):
    agrees(spark, "t05_stream_requirements", ["orders"])
