"""Tables whose rows are replaced by key, in one step for every reader.

A table is a folder of immutable versions and of numbered manifests:

    versions/<version>/rfp_bucket=<b>/*.parquet     rows of hash bucket b, never changed once written
    manifests/<number>.json                         which version each bucket has, and what was applied

A replacement writes new versions of the buckets that it touches and then one manifest, by a rename that fails if another
writer was faster. Until that rename readers see the old rows, after it the new ones; a job that dies in between leaves
only files that no manifest names. Batches carry the name of their source and a number, so a repeated one changes nothing.

The folder needs a file system whose rename is atomic. The number of buckets is a power of two that follows the bytes, so
a bucket stays of a size that tasks can rewrite; rows of one hot key are dealt over tasks.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tenderspark.sources.shared import new_path

BUCKET_BYTES = 128 << 20
BUCKET = "rfp_bucket"


class Files:
    """The few operations on files of a table's folder, through Spark's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.root, self.conf = self.jvm.org.apache.hadoop.fs.Path(path), spark._jsc.hadoopConfiguration()
        self.fs = self.root.getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.at(name))] if self.fs.exists(self.at(name)) else []

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self.at(name)).getLength() if self.fs.exists(self.at(name)) else 0

    def text(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """The whole file or none; an existing one is an error."""
        draft, final = self.at(f"{name}.{uuid.uuid4().hex}.tmp"), self.at(name)
        stream = self.fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        none = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.fs.makeQualified(draft), self.fs.makeQualified(final), none)

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def manifest(files: Files, number: int | None = None) -> dict:
    """The newest manifest, or that of a number; an empty one for a table that is not there yet."""
    numbers = [int(n[:-5]) for n in files.names("manifests") if n.endswith(".json")]
    if not numbers:
        return {"number": 0, "buckets": 0, "versions": {}, "bytes": {}, "applied": {}, "schema": None}
    return json.loads(files.text(f"manifests/{max(numbers) if number is None else number:010}.json"))


def _rows(spark: SparkSession, path: str, m: dict, buckets: list[str] | None = None) -> DataFrame:
    folders = [f"{path}/versions/{v}/{BUCKET}={b}" for b, v in sorted(m["versions"].items()) if buckets is None or b in buckets]
    schema = StructType.fromJson(m["schema"])
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The rows as of now, or of an earlier manifest that is still kept. What a reader has begun is not changed later."""
    m = manifest(Files(spark, path), number)
    if m["schema"] is None:
        raise FileNotFoundError(path)
    return _rows(spark, path, m)


def replace(new: DataFrame, touched: DataFrame, path: str, key: str = "rfp_id", batch: tuple[str, int] | None = None, bucket_bytes: int = BUCKET_BYTES) -> bool:
    """The touched keys' rows become those of `new`, also where it has none; False if `batch` (source, number) or a later
    one of its source was applied before. Rows of `new` whose key is not touched are left out; a null key is none."""
    spark, files = new.sparkSession, Files(new.sparkSession, path)
    m = manifest(files)
    if batch and m["applied"].get(batch[0], -1) >= batch[1]:
        return False
    ids = touched.select(key).distinct()
    fresh = new.join(ids, key, "left_semi").select(new.columns)
    count, version = m["buckets"], uuid.uuid4().hex
    wanted = sum(m["bytes"].values())
    if not count:
        first = new_path(spark, "first")
        fresh.write.parquet(first)
        fresh, wanted = spark.read.schema(fresh.schema).parquet(first), Files(spark, first).size(".")
    grown = max(count, 1)
    while grown * bucket_bytes < wanted:
        grown *= 2
    split, count = grown != m["buckets"], grown
    bucket = F.pmod(F.xxhash64(key), F.lit(count)).cast("int")
    if split:
        hit, before = [], None
    else:
        hit = [str(r[0]) for r in ids.where(F.col(key).isNotNull()).select(bucket).distinct().collect()]  # at most the buckets
        before = hit
    out = fresh
    if m["schema"] is not None:
        out = _rows(spark, path, m, before).join(ids, key, "left_anti").select(new.columns).unionByName(fresh)
    out.withColumn(BUCKET, bucket).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/versions/{version}")
    made = [n.split("=")[1] for n in files.names(f"versions/{version}") if n.startswith(f"{BUCKET}=")]
    kept = {} if split else {b: v for b, v in m["versions"].items() if b not in hit}
    sizes = {b: n for b, n in m["bytes"].items() if b in kept} | {b: files.size(f"versions/{version}/{BUCKET}={b}") for b in made}
    applied = m["applied"] | ({batch[0]: batch[1]} if batch else {})
    publish(files, {"number": m["number"] + 1, "buckets": count, "versions": kept | dict.fromkeys(made, version), "bytes": sizes, "applied": applied, "schema": new.schema.jsonValue()})
    return True


def publish(files: Files, m: dict) -> None:
    """The one step that readers see."""
    files.put(f"manifests/{m['number']:010}.json", json.dumps(m))


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Remove older manifests than the last `keep`, and versions that none of the kept ones names. Readers and writers that
    began before those must have ended."""
    files = Files(spark, path)
    numbers = sorted(int(n[:-5]) for n in files.names("manifests") if n.endswith(".json"))
    alive = {v for n in numbers[-keep:] for v in manifest(files, n)["versions"].values()}
    for n in numbers[:-keep]:
        files.remove(f"manifests/{n:010}.json")
    for v in files.names("versions"):
        if v not in alive:
            files.remove(f"versions/{v}")
