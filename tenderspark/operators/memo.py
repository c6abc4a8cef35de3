"""A memo of model calls that outlives a run: results by the digest of their input, model and prompt version.

A run looks its inputs up, calls the model for the missing ones only, and appends what comes back in rounds of bounded
size, so a run that dies has kept its finished rounds and the next one resumes behind them. A round is one or more tasks,
and what a task brings is kept when it ends, whether or not its job does; so a job takes several rounds, and reads their
rows only. Results are never changed: another model or version has other digests. Failed calls are not kept and so are
tried again by the next run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderspark.sources.shared import new_path, written
from tenderspark.sources.versions import Files

ROUND_ROWS = 50_000
TASK_ROWS = 500
JOB_ROUNDS = 64
EACH_TASK = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}  # a task's file comes into place when the task ends


@dataclass(frozen=True)
class Memo:
    """`path` is a folder of this kind of result; `kind` the type of a result."""

    path: str
    model: str
    version: str
    kind: str
    round_rows: int = ROUND_ROWS

    def digest(self, text: Column) -> Column:
        return F.sha2(F.to_json(F.struct(F.lit(self.model).alias("model"), F.lit(self.version).alias("version"), F.coalesce(text, F.lit("")).alias("input"))), 256)

    def known(self, spark: SparkSession) -> DataFrame:
        """digest, value: one row for each result."""
        schema = f"digest string, value {self.kind}"
        spark.createDataFrame([], schema).write.mode("append").parquet(self.path)  # the folder, if this is the first run
        return spark.read.schema(schema).parquet(self.path).dropDuplicates(["digest"])

    def fill(self, inputs: DataFrame, column: str, call: Callable[[DataFrame], DataFrame]) -> int:
        """Call the model for the distinct inputs that have no result yet; how many there were. `call` takes rows with
        `column` and adds `value`; null stands for a failed call. It is asked once for each job, of which a run of several
        rounds has four at least."""
        spark = inputs.sparkSession
        asked = inputs.select(self.digest(F.col(column)).alias("digest"), F.coalesce(column, F.lit("")).alias(column)).dropDuplicates(["digest"])
        missing = written(asked.join(self.known(spark).select("digest"), "digest", "left_anti"), "missing")
        n = missing.count()
        rounds = -(-n // self.round_rows)
        if not rounds:
            return 0
        jobs = -(-rounds // min(JOB_ROUNDS, max(1, rounds // 4)))
        tasks = -(-n // (jobs * min(self.round_rows, TASK_ROWS)))
        place = new_path(spark, "rounds")
        dealt = missing.withColumn("_job", F.pmod(F.xxhash64("digest"), F.lit(jobs)))
        dealt.repartition("_job").write.partitionBy("_job").parquet(place)
        for name in sorted(x for x in Files(spark, place).names(".") if x.startswith("_job=")):
            part = spark.read.schema(missing.schema).parquet(f"{place}/{name}").repartition(tasks, "digest")
            call(part).where("value IS NOT NULL").select("digest", F.col("value").cast(self.kind)).write.mode("append").options(**EACH_TASK).parquet(self.path)
        return n

    def apply(self, df: DataFrame, column: str, out: str, call: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """`df` with `out`, the result of its input, or null where the call failed."""
        df = written(df, "asked")  # it is read twice
        self.fill(df, column, call)
        results = self.known(df.sparkSession).withColumnsRenamed({"digest": "_digest", "value": out})
        return df.withColumn("_digest", self.digest(F.col(column))).join(results, "_digest", "left").drop("_digest")
