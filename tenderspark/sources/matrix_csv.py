"""Matrices as CSV, a file a proposal, for any number of proposals.

    proposal_id=<id>/matrix.csv   number, section, status and text of a proposal, by number; quotes doubled, null empty
    _proposals/*.parquet          each proposal and its file, written last: what is not listed there is not read

Executors write and read the files by `pyarrow.fs`, as they do shard files. Spark's CSV writer and reader took 8 ms a
file of a small proposal, and the reader holds all files in the driver. A file comes into place whole, by a rename, and a
retried task writes the same bytes again. Other readers find the folders as partitions.
"""

from __future__ import annotations

import csv
import io
import re
import sys
import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderspark.sources.shared import file_system
from tenderspark.sources.versions import Files

HEADER = "number,section,status,text\n"
LISTED = "proposal_id string, file string"
FILES_A_TASK = 5_000
BATCH_ROWS = 10_000
SPECIAL = re.compile(r"[\x00-\x1f\"#%'*/:=?\\\x7f{}\[\]^]")  # what Spark escapes in the names of partitions
NO_ID = "__HIVE_DEFAULT_PARTITION__"


def _quoted(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit('"'), F.replace(c.cast("string"), F.lit('"'), F.lit('""')), F.lit('"')), F.lit(""))


def _root(spark: SparkSession, path: str) -> str:
    files = Files(spark, path)
    return files.fs.makeQualified(files.root).toString()


def write(rows: DataFrame, path: str) -> None:
    """proposal_id, number, section, status, text; what was at `path` goes. An empty proposal_id counts as null."""
    spark = rows.sparkSession
    root = _root(spark, path)
    Files(spark, path).remove("_proposals")  # first, so that half an old folder is not read
    Files(spark, path).remove(".")
    line = F.concat(F.coalesce(F.col("number").cast("string"), F.lit("")), *(x for c in ("section", "status", "text") for x in (F.lit(","), _quoted(F.col(c)))), F.lit("\n"))
    lines = rows.select(F.nullif(F.col("proposal_id").cast("string"), F.lit("")).alias("proposal_id"), "number", line.alias("line"))
    lines = lines.repartition("proposal_id").sortWithinPartitions("proposal_id", "number", "line").select("proposal_id", "line")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = file_system(root)
        open_, out, draft, made = (), None, "", []

        def close() -> None:
            out.close()
            name = "proposal_id=" + (NO_ID if open_[0] is None else SPECIAL.sub(lambda m: f"%{ord(m[0]):02X}", open_[0]))
            store.create_dir(f"{top}/{name}")
            try:
                store.move(draft, f"{top}/{name}/matrix.csv")
            except OSError:  # where a rename replaces nothing, and an earlier attempt has put the same bytes
                if store.get_file_info(f"{top}/{name}/matrix.csv").type.name == "NotFound":
                    raise
                store.delete_file(draft)
            made.append((open_[0], f"{name}/matrix.csv"))

        def listed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], pa.string()) for i in (0, 1)], ["proposal_id", "file"])

        drafts = f"{top}/_drafts"
        store.create_dir(drafts)
        for batch in batches:
            at, texts = 0, batch.column(1).to_pylist()
            for proposal, same in groupby(batch.column(0).to_pylist()):
                n = sum(1 for _ in same)
                if open_ != (proposal,):
                    if open_:
                        close()
                    open_, draft = (proposal,), f"{drafts}/{uuid.uuid4().hex}"
                    out = store.open_output_stream(draft)
                    out.write(HEADER.encode())
                out.write("".join(texts[at : at + n]).encode())
                at += n
            if made:
                yield listed()
                made.clear()
        if open_:
            close()
            yield listed()

    lines.mapInArrow(save, LISTED).write.parquet(f"{path}/_proposals")


def read(spark: SparkSession, path: str) -> DataFrame:
    """number, section, status, text, proposal_id of all files that are listed."""
    root, listed = _root(spark, path), spark.read.schema(LISTED).parquet(f"{path}/_proposals")
    tasks = max(spark.sparkContext.defaultParallelism, -(-listed.count() // FILES_A_TASK))
    kinds = pa.schema([("number", pa.int64()), *((c, pa.string()) for c in ("section", "status", "text", "proposal_id"))])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = file_system(root)
        csv.field_size_limit(sys.maxsize)
        rows: list = []

        def batch() -> pa.RecordBatch:
            number, *rest = zip(*rows, strict=True)
            columns = [pa.array([None if n is None else int(n) for n in number], pa.int64()), *(pa.array(c, pa.string()) for c in rest)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, schema=kinds)

        for part in batches:
            for proposal, file in zip(*(c.to_pylist() for c in part.columns), strict=True):
                with io.TextIOWrapper(store.open_input_stream(f"{top}/{file}"), "utf-8", newline="") as text:
                    found = csv.reader(text, quoting=csv.QUOTE_NOTNULL)
                    next(found)
                    for r in found:
                        rows.append((*r, proposal))
                        if len(rows) >= BATCH_ROWS:
                            yield batch()
        if rows:
            yield batch()

    return listed.repartition(tasks).mapInArrow(load, "number long, section string, status string, text string, proposal_id string")
