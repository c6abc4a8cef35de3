"""Replacing rows by key: atomic for readers, idempotent by batch, bounded buckets."""

import pytest
from pyspark.sql import functions as F

from tenderspark.sources import versions

SCHEMA = "rfp_id string, raw_text_content string"


@pytest.fixture
def table(spark, tmp_path):
    class Table:
        path = f"{tmp_path}/t"

        def put(self, rows, touched, **more):
            df = spark.createDataFrame(rows, SCHEMA)
            return versions.replace(df, spark.createDataFrame([(k,) for k in touched], "rfp_id string"), self.path, **more)

        def rows(self):
            return sorted(map(tuple, versions.read(spark, self.path).collect()))

    return Table()


OLD, NEW = [("a", "1"), ("b", "2"), ("b", "3")], [("b", "8"), ("c", "9")]


def test_replaces_whole_documents(spark, table):
    with pytest.raises(FileNotFoundError):
        table.rows()
    assert table.put([*OLD, ("untouched", "x"), (None, "n")], ["a", "b", None])
    assert table.rows() == OLD
    table.put(NEW, ["b", "c", "gone"])
    assert table.rows() == [("a", "1"), *NEW]
    table.put([], ["a", "c"])
    assert table.rows() == [("b", "8")]
    table.put([], ["b"])
    assert table.rows() == []
    table.put(OLD, ["a", "b"])
    assert table.rows() == OLD


def test_repeated_batches_change_nothing(table):
    assert table.put(OLD, ["a", "b"], batch=("s", 4))
    assert not table.put([], ["a", "b"], batch=("s", 4)) and not table.put([], ["a", "b"], batch=("s", 3))
    assert table.rows() == OLD
    assert table.put(NEW, ["b", "c"], batch=("other", 0)) and table.put([], ["a"], batch=("s", 5))
    assert table.rows() == NEW


class Killed(Exception):
    pass


def test_a_killed_job_leaves_old_or_new_rows(spark, table, monkeypatch):
    table.put(OLD, ["a", "b"])

    def kill(*_):
        raise Killed

    whole = versions.publish
    for step in ("before", "after"):
        with monkeypatch.context() as m:
            m.setattr(versions, "publish", kill if step == "before" else lambda files, x: (whole(files, x), kill()))
            with pytest.raises(Killed):
                table.put(NEW, ["b", "c"], batch=("s", 0))
        assert table.rows() == (OLD if step == "before" else [("a", "1"), *NEW])
    assert not table.put([], ["a", "b", "c"], batch=("s", 0))  # the batch whose manifest was written
    assert table.rows() == [("a", "1"), *NEW]


def test_a_failing_task_leaves_the_old_rows(spark, table):
    table.put(OLD, ["a", "b"])
    bad = spark.createDataFrame(NEW, SCHEMA).withColumn("raw_text_content", F.when(F.col("rfp_id") == "c", F.raise_error(F.lit("killed")).cast("string")).otherwise(F.col("raw_text_content")))
    with pytest.raises(Exception, match="killed"):
        versions.replace(bad, bad.select("rfp_id"), table.path)
    assert table.rows() == OLD


def test_one_of_two_writers_wins(spark, table):
    table.put(OLD, ["a", "b"])
    files = versions.Files(spark, table.path)
    late = versions.manifest(files)
    table.put(NEW, ["b", "c"])
    with pytest.raises(Exception, match="(?i)exist"):
        versions.publish(files, late | {"number": late["number"] + 1})
    assert table.rows() == [("a", "1"), *NEW]


def test_readers_keep_what_they_began_with(spark, table):
    table.put(OLD, ["a", "b"])
    before = versions.read(spark, table.path)
    table.put([], ["a", "b"])
    assert sorted(map(tuple, before.collect())) == OLD and table.rows() == []
    table.put(NEW, ["b", "c"])
    versions.vacuum(spark, table.path, keep=1)
    assert table.rows() == NEW and len(versions.Files(spark, table.path).names("manifests")) == 1


def test_buckets_follow_the_bytes(spark, table):
    rows = spark.range(20_000).selectExpr("cast(id % 500 as string) AS rfp_id", "sha2(cast(id as string), 512) AS raw_text_content")
    versions.replace(rows, rows.select("rfp_id"), table.path, bucket_bytes=200_000)
    files = versions.Files(spark, table.path)
    first = versions.manifest(files)["buckets"]
    assert first >= 8 and versions.read(spark, table.path).exceptAll(rows).count() == 0
    more = rows.withColumn("rfp_id", F.concat(F.lit("x"), "rfp_id"))
    versions.replace(more, more.select("rfp_id"), table.path, bucket_bytes=200_000)
    table.put([], ["none"], bucket_bytes=200_000)  # the next replacement deals the rows anew
    m = versions.manifest(files)
    assert m["buckets"] == 2 * first and versions.read(spark, table.path).exceptAll(rows.union(more)).count() == 0
    assert versions.read(spark, table.path).count() == 40_000
    table.put([("7", "only")], ["7"], bucket_bytes=200_000)
    after = versions.manifest(files)
    assert sum(after["versions"][b] != m["versions"][b] for b in m["versions"]) == 1  # one bucket was written
    assert versions.read(spark, table.path).where("rfp_id = '7'").collect()[0].raw_text_content == "only"
