"""Filter interaction audit: what each filter removes, repeats and costs at every place of every order of the filters.

Documents shrink to cells (part, mask of the filters they fail) before anything is enumerated. A recursive common table
expression then extends prefixes of filters by each unused letter, meets the cells of the part and carries the bits that
are applied already; every level emits the figures of its step.

Filters are letters with a condition under which a text fails; DUPLICATE stands for a text that a smaller doc_id has too,
anywhere in the table. Words are what lies between spaces, tabs and line ends, case-sensitive.

Defined results: a null text is empty, a null part is the empty string; a null doc_id has no smaller one, so its row is
never a duplicate, and no label; repeated rows count each; a document with several rows in `labels` is good or toxic if any row says
so, one with none is neither; an empty table gives no rows; other columns are ignored. Equal SHA-256 digests stand for
equal texts. No text is shuffled: narrow rows (id, part, bits, digest) are written once, copies meet as one minimum a
digest, and those minima meet the rows by digest and id, so a text that a third of all rows share lands nowhere
together. A task holds the words of one text. The recursion has at most 2^k cells and sum of k!/(k-i)! rows a part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderspark.llm.shared import written

Rule = Callable[[Column, Column], Column]  # (text, words) -> fails
DUPLICATE = "duplicate"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3  # words; percent of the words; percent of the code points
FILTERS: dict[str, Rule | str] = {
    "A": lambda text, words: F.size(words) < LEAST_WORDS,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
    "C": lambda text, words: 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > MOST_CAPITALS * F.length(text),
    "D": lambda text, words: F.rlike(text, F.lit("[#$%&*|]")),
    "E": DUPLICATE,
}


def failing(docs: DataFrame, filters: dict[str, Rule | str], part: str) -> DataFrame:
    """doc_id, part, mask of the filters that the text alone fails, digest of the text."""
    own = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("words", F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0))
    mask = F.lit(0)
    for i, rule in enumerate(filters.values()):
        if rule != DUPLICATE:
            mask = mask + F.when(rule(F.col("text"), F.col("words")), 1 << i).otherwise(0)
    return own.select("doc_id", "part", mask.alias("mask"), F.sha2("text", 256).alias("digest"))


def mask_cells(docs: DataFrame, labels: DataFrame, filters: dict[str, Rule | str] = FILTERS, part: str = "lang") -> DataFrame:
    """part, mask, docs, good, toxic: a row for each mask that occurs in a part."""
    rows = written(failing(docs, filters, part), "audit-rows")
    if DUPLICATE in filters.values():
        bit = sum(1 << i for i, rule in enumerate(filters.values()) if rule == DUPLICATE)
        firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
        copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
        rows = rows.join(firsts, ["digest", "doc_id"], "left").withColumn("mask", F.col("mask") + F.when(copy, bit).otherwise(0))
    flags = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    return (
        rows.select("doc_id", "part", "mask")
        .join(flags, "doc_id", "left")
        .groupBy("part", "mask")
        .agg(F.count("*").alias("docs"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    )


WALK = """
    WITH RECURSIVE walk(part, filter_order, applied, step, figures) AS (
        SELECT part, '', 0, 0, CAST(array() AS array<struct<step:int,kept:bigint,removed:bigint,redundant:bigint,unique_fails:bigint,good_lost:bigint,toxic_lost:bigint>>)
        FROM {packed}
        UNION ALL
        SELECT part, concat(filter_order, letter), applied | bit, step + 1, array_append(figures, named_struct(
            'step', step + 1,
            'kept', aggregate(filter(cells, c -> c.mask & (applied | bit) = 0), 0L, (n, c) -> n + c.docs),
            'removed', aggregate(filter(cells, c -> c.mask & applied = 0 AND c.mask & bit <> 0), 0L, (n, c) -> n + c.docs),
            'redundant', aggregate(filter(cells, c -> c.mask & applied <> 0 AND c.mask & bit <> 0), 0L, (n, c) -> n + c.docs),
            'unique_fails', aggregate(filter(cells, c -> c.mask = bit), 0L, (n, c) -> n + c.docs),
            'good_lost', aggregate(filter(cells, c -> c.mask & applied = 0 AND c.mask & bit <> 0), 0L, (n, c) -> n + c.good),
            'toxic_lost', aggregate(filter(cells, c -> c.mask & applied = 0 AND c.mask & bit <> 0), 0L, (n, c) -> n + c.toxic)))
        FROM (SELECT x.*, shiftleft(1, place) AS bit
              FROM (SELECT w.*, p.cells, posexplode(split({letters}, '')) AS (place, letter) FROM walk w JOIN {packed} p ON w.part = p.part) x)
        WHERE applied & bit = 0
    )
    SELECT part, filter_order, inline(figures) FROM walk WHERE step = {steps}"""


def audit(cells: DataFrame, letters: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each
    part, order of the letters and step; bit i of a mask belongs to letter i."""
    spark = cells.sparkSession
    packed = written(cells.groupBy("part").agg(F.collect_list(F.struct("mask", "docs", "good", "toxic")).alias("cells")), "audit-cells")
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # the rows are bounded by the parts; the guard against endless recursion is the level
    try:
        steps = written(spark.sql(WALK, packed=packed, letters=letters, steps=len(letters)), "audit-steps")
    finally:
        spark.conf.set(limit, before)
    letter = F.substr("filter_order", "step", F.lit(1))
    shapley = steps.groupBy("part", letter.alias("letter")).agg(F.sum("removed").alias("shapley"))
    return steps.withColumn("letter", letter).join(shapley, ["part", "letter"]).drop("letter")


def filter_audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Rule | str] = FILTERS, part: str = "lang") -> DataFrame:
    """The audit of `filters` over each value of the column `part`."""
    return audit(mask_cells(docs, labels, filters, part), "".join(filters))


ORACLE = r"""
    WITH RECURSIVE t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    m AS (SELECT doc_id, part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
                 + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS INT) + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT)
                 + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS INT) AS mask FROM t),
    f AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
    cells AS (SELECT part, mask, count(*) AS docs, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN f USING (doc_id) GROUP BY part, mask),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
    orders AS (SELECT '' AS filter_order, 0 AS applied UNION ALL SELECT concat(filter_order, letter), applied | bit FROM orders, letters WHERE applied & bit = 0),
    steps AS (SELECT filter_order, CAST(step AS INT) AS step, bit, (SELECT sum(l.bit) FROM letters l WHERE instr(filter_order, l.letter) < step) AS applied
              FROM (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders WHERE length(filter_order) = 5) o, letters x WHERE x.letter = substring(filter_order, step, 1)),
    figures AS (SELECT part, filter_order, step, bit, CAST(sum(docs) FILTER (mask & (coalesce(applied, 0) | bit) = 0) AS BIGINT) AS kept,
                CAST(sum(docs) FILTER (mask & coalesce(applied, 0) = 0 AND mask & bit <> 0) AS BIGINT) AS removed,
                CAST(sum(docs) FILTER (mask & coalesce(applied, 0) <> 0 AND mask & bit <> 0) AS BIGINT) AS redundant,
                CAST(sum(docs) FILTER (mask = bit) AS BIGINT) AS unique_fails,
                CAST(sum(good) FILTER (mask & coalesce(applied, 0) = 0 AND mask & bit <> 0) AS BIGINT) AS good_lost,
                CAST(sum(toxic) FILTER (mask & coalesce(applied, 0) = 0 AND mask & bit <> 0) AS BIGINT) AS toxic_lost
                FROM cells, steps GROUP BY part, filter_order, step, bit)
    SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails,
           coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
    FROM figures"""
