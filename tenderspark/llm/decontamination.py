"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A mask picks WEIGHT of SPAN neighbouring words and ignores the others, so a seed still meets its twin when a word at an
ignored place was substituted. Every place of every document and of every benchmark item is hashed under each mask and
the hashes are joined. A hit fixes how the item lies over the document; along it the words are compared, and the item
leaks if some WINDOW neighbouring item words hold at least LEAST equal ones. The two masks are chosen so that any
window with up to WINDOW - LEAST substitutions holds a seed of one of them that avoids all substitutions, so no such
window is missed.

Words are runs of letters and digits, lower-cased. An item shorter than WINDOW is its own window: of 8 to 12 words one
may be substituted where the masks still find it (SHORT), of 5 to 7 words none, and these meet by a hash of the whole
item. Items of fewer than 5 words are never reported: they say too little. Seeds of the items are broadcast only while
their number, which is counted first, is at most `max_broadcast_seeds`; beyond it both sides are shuffled by the hash.

Defined results: null or empty texts hold no words and leak nothing; rows without doc_id are searched but not reported;
repeated rows of a doc_id give one row an item; ties go to the leftmost place; empty tables give an empty table; other
columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderspark.functions.columns import let
from tenderspark.llm.shared import unused, written

MASKS = ((0, 1, 3, 5, 6, 7), (0, 1, 2, 3, 6, 7))
SPAN, WEIGHT = 8, 6
WINDOW, LEAST = 13, 11
SHORTEST = 5
MAX_BROADCAST_SEEDS = 1_000_000
MAX_BROADCAST_IDS = 1_000_000


def covered(n: int) -> bool:
    """Whether any one substitution in `n` words leaves a seed of some mask intact."""
    return all(any(wrong - at not in mask for mask in MASKS for at in range(n - SPAN + 1)) for wrong in range(n))


#: Equal words that an item of fewer than WINDOW words must show.
SHORT = {n: n - 1 if n >= SPAN and covered(n) else n for n in range(SHORTEST, WINDOW)}


def words(text: Column) -> Column:
    """Array of words; a text that begins or ends with other characters keeps an empty word there."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")


def _seeds(hashes: Column, masks: list[tuple[int, ...]]) -> Column:
    """array<long>: all masks of all places, place by place (so index / len(masks) is the place); null where a mask
    reaches behind the end."""

    def seed(mask: tuple[int, ...], place: Column) -> Column:
        own = F.xxhash64(F.lit(sum(1 << o for o in mask)), *(F.get(hashes, place + o) for o in mask))
        return F.when(place + mask[-1] < F.size(hashes), own)

    places = F.sequence(F.lit(0), F.size(hashes) - 1)
    return F.flatten(F.transform(places, lambda place: F.array(*(seed(mask, place) for mask in masks))))


def _hashed(df: DataFrame, key: str, masks: list[tuple[int, ...]]) -> DataFrame:
    """key, at, seed: the words are hashed once, the seeds combine those hashes."""
    seeds = df.select(key, let(F.transform(words(F.col("text")), lambda w: F.xxhash64(w)), lambda h: _seeds(h, masks)).alias("seeds"))
    places = seeds.select(key, F.posexplode("seeds").alias("p", "seed")).where("seed IS NOT NULL")
    return places.select(key, F.floor(F.col("p") / len(masks)).cast("int").alias("at"), "seed")


def find_hits(docs: DataFrame, items: DataFrame, max_broadcast_seeds: int = MAX_BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, item_id, shift): places where a seed of an item meets one of a document; word i of the item lies over
    word i + shift of the document."""
    n = F.size(words(F.col("text")))
    short = [r[0] for r in items.select(n).where(n.between(SHORTEST, SPAN - 1)).distinct().collect()]  # 5, 6, 7 at most
    whole = {k: tuple(range(k)) for k in sorted(short)}
    spaced = _hashed(items.where(n >= SPAN), "item_id", list(MASKS))
    found = functools.reduce(DataFrame.union, [spaced, *(_hashed(items.where(n == k), "item_id", [mask]) for k, mask in whole.items())])
    found = found.withColumnRenamed("at", "item_at")
    if found.count() <= max_broadcast_seeds:
        found = F.broadcast(found)
    met = _hashed(docs, "doc_id", [*MASKS, *whole.values()]).join(found, "seed")
    return met.select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()


def texts_of(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) whose doc_id is in `hits`. Their ids are counted first, and few ids are sent to the texts
    instead of moving all texts to the ids."""
    ids = hits.select("doc_id").distinct()
    return docs.join(F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids, "doc_id", "left_semi")


def leaks(docs: DataFrame, benchmark: DataFrame, max_broadcast_seeds: int = MAX_BROADCAST_SEEDS) -> DataFrame:
    """One row for each document and item that it leaks: doc_id, item_id, item_words, best_window, equal_words, shift."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    items = benchmark.select(F.col("item_id").cast("long"), F.array_join(F.filter(words(F.col("text")), lambda w: w != ""), " ").alias("text"))
    items = items.where("item_id IS NOT NULL").where(F.size(words(F.col("text"))) >= SHORTEST).distinct()
    hits = written(find_hits(docs, items, max_broadcast_seeds), "hits")
    # The words of the documents that were hit, once each, meet the hits again by doc_id.
    laid = hits.join(texts_of(hits, docs), "doc_id").join(items.select("item_id", F.split("text", " ").alias("item")), "item_id")

    def compared(doc: Column) -> Column:
        place = lambda i: i + F.col("shift")
        return F.transform("item", lambda w, i: F.when(place(i) >= 0, F.coalesce(F.get(doc, place(i)) == w, F.lit(False))).otherwise(False))

    def judged(same: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(same) - (WINDOW - 1)))
        best = F.array_max(F.transform(starts, lambda s: F.size(F.filter(F.slice(same, s, WINDOW), lambda x: x))))
        return F.struct(best.alias("best_window"), F.size(F.filter(same, lambda x: x)).alias("equal_words"), F.size(same).alias("item_words"))

    scored = laid.select("doc_id", "item_id", "shift", let(words(F.col("text")), lambda doc: let(compared(doc), judged)).alias("j")).select("doc_id", "item_id", "shift", "j.*")
    top = F.max(F.struct("best_window", "equal_words", (-F.col("shift")).alias("back"), "item_words")).alias("top")
    least = functools.reduce(lambda c, n: c.when(F.col("item_words") == n, SHORT[n]), SHORT, F.when(F.lit(False), 0)).otherwise(LEAST)
    return (
        scored.where(F.col("best_window") >= least)
        .groupBy("doc_id", "item_id")
        .agg(top)
        .selectExpr("doc_id", "item_id", "top.item_words item_words", "top.best_window best_window", "top.equal_words equal_words", "-top.back shift")
    )


def drop_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All columns, of any names, of the documents that leak no item; rows without doc_id stay."""
    name = unused("leaking", docs)
    bad = leaks(docs.select("doc_id", "text"), benchmark).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, F.col("doc_id").cast("long") == F.col(name), "left_anti")


LEAST_SQL = "CASE item_words " + " ".join(f"WHEN {n} THEN {k}" for n, k in SHORT.items()) + f" ELSE {LEAST} END"
ORACLE = rf"""
WITH d AS (SELECT doc_id, string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark),
bt AS (SELECT item_id, len(w) AS item_words, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM b WHERE len(w) >= {SHORTEST}),
dt AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
m AS (SELECT doc_id, item_id, item_words, i - j AS shift, j FROM dt JOIN bt USING (word)),
many AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, shift) AS equal_words FROM m),
win AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS in_window FROM many WHERE equal_words >= {LEAST_SQL}),
s AS (SELECT doc_id, item_id, item_words, shift, equal_words, max(in_window) AS best_window FROM win GROUP BY ALL HAVING max(in_window) >= {LEAST_SQL})
SELECT doc_id, item_id, item_words, best_window, equal_words, shift FROM s
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY best_window DESC, equal_words DESC, shift) = 1
"""
