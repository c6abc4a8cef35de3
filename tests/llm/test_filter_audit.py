import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tenderspark.llm import filter_audit as fa

LABELS = "doc_id long, quality int, toxic int"


def fails(rows):
    """Failed letters of each (doc_id, text)."""
    out = []
    for doc_id, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = set()
        if len(words) < 200:
            bad.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            bad.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text):
            bad.add("C")
        if any(c in "#$%&*|" for c in text):
            bad.add("D")
        if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t in rows):
            bad.add("E")
        out.append(bad)
    return out


def brute(rows, labels, letters="ABCDE"):
    """rows: (doc_id, text, part); filters applied one after the other."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    bad = fails([r[:2] for r in rows])
    out, total = {}, {}
    for part in {r[2] or "" for r in rows}:
        docs = [(r[0], b) for r, b in zip(rows, bad, strict=True) if (r[2] or "") == part]
        for order in itertools.permutations(letters):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                every = [d for d in docs if f in d[1]]
                total[part, f] = total.get((part, f), 0) + len(gone)
                out[part, "".join(order), step] = (
                    len(left), len(gone), len(every) - len(gone), sum(d[1] == {f} for d in docs), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone),
                )
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def result(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(out) == len(rows)
    return out


def corpus():
    r = random.Random(12)
    long = " ".join(f"w{i}" for i in range(220))
    texts = [None, "", " \t\n", "short", "SHOUT", "a # b", long, long + " $", long.upper(), "a " * 230, "A " * 230, long, "x\x0by\x0cz\x1cq", "é" * 99 + "ABC", "é" * 97 + "ABC", long + " end"]
    rows = [(i, r.choice(texts), r.choice(["en", "de", None, ""])) for i in range(120)]
    return rows + [(5, *rows[5][1:]), (None, "short", "en"), (None, "short", "en")]


def test_against_brute_force(spark):
    rows = corpus()
    labels = [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(0, 110)] + [(3, 1, None), (3, 0, 0), (None, 1, 1), (9999, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"mask": F.lit("x"), "digest": F.lit(1), "part": F.lit("y")}).repartition(3)
    assert result(fa.filter_audit(docs, spark.createDataFrame(labels, LABELS))) == brute(rows, labels)


def test_own_filters_and_parts(spark):
    rows = [(1, "a b", "s"), (2, "b", "s"), (3, "a b", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    filters = {"X": lambda text, words: F.array_contains(words, "a"), "D": fa.DUPLICATE}
    got = result(fa.filter_audit(docs, spark.createDataFrame([], LABELS), filters, "source"))
    assert got == {
        ("s", "XD", 1): (1, 1, 0, 1, 0, 0, 2), ("s", "XD", 2): (1, 0, 0, 0, 0, 0, 0), ("s", "DX", 1): (2, 0, 0, 0, 0, 0, 0), ("s", "DX", 2): (1, 1, 0, 1, 0, 0, 2),
        ("t", "XD", 1): (0, 1, 0, 0, 0, 0, 1), ("t", "XD", 2): (0, 0, 1, 0, 0, 0, 1), ("t", "DX", 1): (0, 1, 0, 0, 0, 0, 1), ("t", "DX", 2): (0, 0, 1, 0, 0, 0, 1),
    }


def test_empty_table_and_session(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    assert fa.filter_audit(docs, spark.createDataFrame([], LABELS)).count() == 0
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before


@pytest.mark.parametrize("copies", [3000])
def test_more_rows_than_the_recursion_guard(spark, copies):
    """One part a document: a million rows in the recursion would be 3,068 parts of five filters."""
    cells = spark.range(copies).select(F.col("id").cast("string").alias("part"), F.lit(1).alias("mask"), F.lit(1).alias("docs"), F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    cells = cells.select("part", "mask", *(F.col(c).cast("long") for c in ("docs", "good", "toxic")))
    spark.conf.set("spark.sql.cteRecursionRowLimit", "1000")
    try:
        assert fa.audit(cells, "AB").count() == 4 * copies
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
