"""A written inverted index over chunks, and the searches that read it.

Postings (tenant, pool, term, chunk_id, tf) lie in hash partitions of their term, sorted, with a table of how many chunks
of a pool hold each term. Texts are tokenised once, when the index is built; a search reads the postings of its terms.

A search intersects from the rarest term: chunks that hold it are the candidates, those that lack one of the next few are
pruned, and only what is left meets all terms of its query. Each step's small side is counted and sent to the postings, or,
beyond MAX_BROADCAST_ROWS, shuffled with them by term and chunk, so a frequent term is no hot key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenderspark.sources.shared import new_path, written

STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
MAX_BROADCAST_ROWS = 100_000
PRUNE = 4  # terms behind the rarest that prune the candidates
HELD = ["tenant", "pool", "term"]


@dataclass(frozen=True)
class KeywordIndex:
    postings: DataFrame  # part, tenant, pool, term, chunk_id, tf
    terms: DataFrame  # tenant, pool, term, often
    parts: int


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)
    return F.filter(found, lambda w: ~w.isin(STOP_WORDS))


def pool_of(c: Column) -> Column:
    """Pools as a plain join key: the library, whose proposal is null, is the empty string."""
    return F.coalesce(c.cast("string"), F.lit(""))


def part_of(term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def build(chunks: DataFrame, path: str | None = None, parts: int | None = None) -> KeywordIndex:
    """Write the index of `chunks` below `path` (a new one in the shared folder) in `parts` hash partitions."""
    spark = chunks.sparkSession
    path, parts = path or new_path(spark, "index"), parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tokens = chunks.select("chunk_id", "tenant", pool_of(F.col("proposal_id")).alias("pool"), F.explode(terms(F.col("content"))).alias("term"))
    postings = tokens.groupBy(*HELD, "chunk_id").agg(F.count("*").alias("tf")).withColumn("part", part_of(F.col("term"), parts))
    postings.hint("rebalance", "part").sortWithinPartitions("part", *HELD, "chunk_id").write.partitionBy("part").parquet(f"{path}/parts={parts}/postings")
    postings.limit(0).write.parquet(f"{path}/parts={parts}/layout")  # an index without postings has no file that tells its columns
    made = spark.read.schema(postings.schema).parquet(f"{path}/parts={parts}/postings")
    made.groupBy(*HELD).agg(F.count("*").alias("often")).write.parquet(f"{path}/parts={parts}/terms")
    return load(spark, path, parts)


def load(spark: SparkSession, path: str, parts: int) -> KeywordIndex:
    """An index that was written before, in so many parts."""
    at = f"{path}/parts={parts}"
    postings = spark.read.schema(spark.read.parquet(f"{at}/layout").schema).parquet(f"{at}/postings")
    return KeywordIndex(postings.select("part", *HELD, "chunk_id", "tf"), spark.read.parquet(f"{at}/terms"), parts)


def _sent(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.count() <= MAX_BROADCAST_ROWS else small


def matches(asks: DataFrame, index: KeywordIndex) -> DataFrame:
    """asks: ask, tenant, pool, terms (distinct) -> ask, chunk_id, weight: the chunks that hold all terms, with the sum of
    ln(1 + frequency)."""
    wanted = asks.select("ask", "tenant", "pool", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    known = wanted.join(index.terms, HELD)
    # An ask with a term that its pool lacks finds nothing; the others' terms are numbered from the rarest.
    place = F.row_number().over(W.partitionBy("ask").orderBy("often", "term"))
    there = F.count("*").over(W.partitionBy("ask"))
    ordered = written(known.withColumns({"place": place, "there": there}).where("there = n").select("ask", *HELD, "n", "place", part_of(F.col("term"), index.parts).alias("part")), "terms")
    on, hit = ["part", *HELD], ["ask", "n", "tenant", "pool", "chunk_id"]
    found = written(index.postings.join(_sent(ordered.where("place = 1").select("ask", "n", *on)), on).select(*hit), "found")
    few = ordered.where(F.col("place").between(2, PRUNE + 1)).select("ask", *on)
    some = index.postings.join(_sent(found.join(few, ["ask", "tenant", "pool"])), [*on, "chunk_id"]).groupBy(*hit).agg(F.count("*").alias("met"))
    left = found.join(some, hit, "left").where(F.coalesce("met", F.lit(0)) == F.least(F.col("n") - 1, F.lit(PRUNE))).select(*hit)
    sought = written(left.join(ordered.select("ask", *on), ["ask", "tenant", "pool"]), "sought")
    every = index.postings.join(_sent(sought), [*on, "chunk_id"])
    return every.groupBy("ask", "chunk_id", "n").agg(F.count("*").alias("met"), F.sum(F.log1p("tf")).alias("weight")).where("met = n").select("ask", "chunk_id", "weight")
