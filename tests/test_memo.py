"""The memo of model calls: what a run has kept the next one does not call for."""

import time

import pytest
from pyspark.sql import functions as F

from tenderspark.operators import seams
from tenderspark.operators.memo import Memo


@pytest.fixture
def memo(tmp_path):
    return Memo(f"{tmp_path}/memo", "m", "1", "string", round_rows=5)


def texts(spark, *xs):
    return spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "id int, text string")


def calling(log, fail=()):
    def fn(xs):
        with open(log, "a") as f:
            f.writelines(f"{x}\n" for x in xs)
        if any(x in fail for x in xs):
            raise RuntimeError("no answer")
        return [x.upper() for x in xs]

    return fn


def answers(df, fn, memo, isolate=True):
    out = memo.apply(df, "text", "made", lambda rows: seams.call_batches(rows, fn, "text", "value", "string", isolate))
    return {r.id: r.made for r in out.collect()}


def test_a_second_run_makes_no_call(spark, memo, tmp_path):
    df = texts(spark, *"abcabca", None, "")
    log = tmp_path / "log"
    wanted = {i: x.upper() for i, x in enumerate("abcabca")} | {7: "", 8: ""}
    assert answers(df, calling(log), memo) == wanted
    assert sorted(log.read_text().split("\n")) == ["", "", "a", "b", "c"]
    assert answers(df, calling(log, fail="abc"), memo) == wanted
    assert len(log.read_text().split("\n")) == 5
    other = Memo(memo.path, "m", "2", "string")
    assert memo.fill(texts(spark, "a", "new"), "text", lambda rows: rows.withColumn("value", F.lit("v"))) == 1
    assert other.fill(texts(spark, "a", "new"), "text", lambda rows: rows.withColumn("value", F.lit("w"))) == 2
    assert answers(texts(spark, "a"), calling(log), other) == {0: "w"} and answers(texts(spark, "a"), calling(log), memo) == {0: "A"}


def test_failed_calls_are_tried_again(spark, memo, tmp_path):
    df = texts(spark, "good", "bad")
    assert answers(df, calling(tmp_path / "one", fail=("bad",)), memo) == {0: "GOOD", 1: None}
    assert answers(df, calling(tmp_path / "two"), memo) == {0: "GOOD", 1: "BAD"}
    assert (tmp_path / "two").read_text().split() == ["bad"]


def test_a_run_that_dies_keeps_its_rounds(spark, memo, tmp_path):
    df = texts(spark, *(f"t{i}" for i in range(40)))
    calls = []

    def call(rows):
        calls.append(1)
        if len(calls) == 4:
            raise KeyboardInterrupt
        return rows.withColumn("value", F.upper("text"))

    with pytest.raises(KeyboardInterrupt):
        memo.fill(df, "text", call)
    kept = memo.known(spark).count()
    assert 0 < kept < 40
    assert memo.fill(df, "text", lambda rows: rows.withColumn("value", F.upper("text"))) == 40 - kept
    assert memo.known(spark).count() == 40 and memo.fill(df, "text", call) == 0


def test_seams_share_a_memo(spark, tmp_path):
    memo = Memo(f"{tmp_path}/drafts", "m", "1", "string")
    log = tmp_path / "log"
    sections = spark.createDataFrame([("1", "p" * 30, 0, False, False, None), ("2", "p" * 30, 0, False, False, None), ("3", "s", 0, False, False, None)], "section_id string, prompt string, requirement_count int, require_headings boolean, require_tags boolean, source_context string")
    for _ in range(2):
        assert {r.section_id: r.final_status for r in seams.score_drafts(sections, calling(log), memo).collect()} == {"1": "saved", "2": "saved", "3": "guardrail_rejected"}
    assert len(log.read_text().split()) == 2
    vectors = Memo(f"{tmp_path}/vectors", "m", "1", "array<float>")
    docs = spark.createDataFrame([("t", None, "src", "word " * 600), ("t", 1, "b", "word " * 600)], "tenant string, proposal_id int, source_name string, text string")
    counted = lambda xs: calling(tmp_path / "embedded")(xs) and [[len(x), 1.0] for x in xs]
    first = seams.build_library(docs, counted, 2, vectors)
    assert first.count() == 6 and len((tmp_path / "embedded").read_text().splitlines()) == 2  # three chunks a document, two of them the same text
    assert seams.build_library(docs, counted, 2, vectors).exceptAll(first).count() == 0 and len((tmp_path / "embedded").read_text().splitlines()) == 2  # three chunks a document, two of them the same text


def test_jobs_take_several_rounds_and_read_their_own_rows(spark, memo, tmp_path):
    df = texts(spark, *(f"t{i}" for i in range(400)))
    read = []

    def call(rows):
        read.append(set(rows.inputFiles()))
        return rows.withColumn("value", F.upper("text"))

    assert memo.fill(df, "text", call) == 400 and memo.known(spark).count() == 400
    assert 4 <= len(read) <= 8 and not any(a & b for i, a in enumerate(read) for b in read[:i])


def test_a_job_that_dies_keeps_its_finished_tasks(spark, memo, tmp_path):
    df = texts(spark, *(f"t{i}" for i in range(400)))
    sizes = []

    def fn(xs):
        if "t7" in xs:
            time.sleep(6)  # the others end meanwhile
            raise RuntimeError("no answer")
        return [x.upper() for x in xs]

    def call(rows):
        sizes.append(rows.count())
        return seams.call_batches(rows, fn, "text", "value", "string")

    with pytest.raises(Exception, match="no answer"):
        memo.fill(df, "text", call)
    assert sum(sizes[:-1]) < memo.known(spark).count() < sum(sizes)
