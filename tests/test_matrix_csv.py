"""Matrices as CSV: a file a proposal, whatever their number and their texts."""

from tenderspark.sources import tables

SCHEMA = "proposal_id string, number long, section string, status string, text string"


def test_many_proposals(spark, tmp_path):
    """A file each, but the reader's plan holds the list of them only."""
    m = spark.range(1500).selectExpr("cast(id % 700 as string) proposal_id", "id number", "'s' section", "'na' status", "concat('t', id) text")
    tables.write_matrix_csv(m, f"{tmp_path}/csv")
    got = tables.read_matrix_csv(spark, f"{tmp_path}/csv")
    assert len(got.inputFiles()) <= 8
    assert len(list(tmp_path.glob("csv/proposal_id=*/*.csv"))) == 700
    assert got.select(m.columns).exceptAll(m).count() == 0 and got.count() == 1500
    assert (tmp_path / "csv/proposal_id=3/matrix.csv").read_text().split("\n") == ["number,section,status,text", '3,"s","na","t3"', '703,"s","na","t703"', '1403,"s","na","t1403"', ""]


def test_odd_values_and_what_a_dead_task_left(spark, tmp_path):
    rows = [
        ("a/b=c %é", 1, None, "", ' "q", ""\r\n,\n'), ("a/b=c %é", 2, "", None, "\r"), ("a/b=c %é", 3, "x", "y", None), (None, 4, "s", "na", "\\"), ("9", None, " ", "\t", "\x00'"),
        ("9", 5, "s", "s", "long " * 50_000),
    ]
    m = spark.createDataFrame(rows, SCHEMA)
    for _ in range(2):  # written again, nothing is doubled
        tables.write_matrix_csv(m, f"{tmp_path}/csv")
    (tmp_path / "csv/proposal_id=gone").mkdir()
    (tmp_path / "csv/proposal_id=gone/matrix.csv").write_text("number,section,status,text\n1,,,\n")
    got = tables.read_matrix_csv(spark, f"{tmp_path}/csv").select(m.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, m.collect()))
    tables.write_matrix_csv(m.limit(0), f"{tmp_path}/csv")
    assert tables.read_matrix_csv(spark, f"{tmp_path}/csv").count() == 0 and not list(tmp_path.glob("csv/proposal_id=*"))


def test_a_proposal_of_many_rows(spark, tmp_path):
    """More rows than a batch, from several batches of the writer."""
    m = spark.range(25_000).selectExpr("'p' proposal_id", "id number", "'s' section", "'na' status", "concat('t', id) text")
    tables.write_matrix_csv(m, f"{tmp_path}/csv")
    assert tables.read_matrix_csv(spark, f"{tmp_path}/csv").select(m.columns).exceptAll(m).count() == 0
    assert [line.split(",")[0] for line in (tmp_path / "csv/proposal_id=p/matrix.csv").read_text().split("\n")[1:-1]] == [str(i) for i in range(25_000)]
