"""Product-quantised search against the exact one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderspark.operators import retrieval as rt
from tenderspark.operators import vector_index as vi

SIDE = "tenant string, proposal_id int, embedding array<float>, industry string, document_type string, outcome string"


def vectors(spark, name, n, seed, width=20):
    r = np.random.default_rng(seed)
    rows = [(i, "t", None if i % 3 else 1, [float(x) for x in r.normal(size=width)] if i % 17 else None, "a" if i % 2 else "b", None, None) for i in range(n)]
    return spark.createDataFrame(rows, f"{name}_id int, {SIDE}")


def test_recall_and_what_is_read(spark):
    chunks, queries = vectors(spark, "chunk", 3000, 1), vectors(spark, "query", 60, 2).withColumn("text", F.lit("x")).withColumn("industry", F.when(F.col("query_id") % 5 == 0, "a"))
    r = rt.ann_recall(queries, chunks, 10, 0.2).first()
    exact = rt.knn_join(queries, chunks, 10).count()
    assert r.hits == exact and r.found >= 0.9 * r.hits and r.read <= 0.25 * r.reach
    whole = rt.ann_candidates(queries, chunks, 10, share=1.0)
    assert whole.exceptAll(rt.knn_join(queries, chunks, 10)).count() == 0 and whole.count() == exact


def test_a_kept_index_gives_the_same(spark, tmp_path):
    chunks, queries = vectors(spark, "chunk", 500, 3), vectors(spark, "query", 20, 4).withColumn("text", F.lit("x"))
    book = vi.fit(chunks, parts=7, centroids=32)
    coded = vi.build(chunks.drop("text"), book, f"{tmp_path}/codes")
    assert "embedding" not in coded.columns and {len(x.code) for x in coded.collect()} == {7}
    a, b = (sorted(map(tuple, rt.ann_candidates(queries, chunks, 5, codebook=book, coded=c).collect())) for c in (coded, coded.repartition(5)))
    assert a == b and a


def test_codes_are_nearest_points(spark):
    book = vi.fit(vectors(spark, "chunk", 400, 5), parts=4, centroids=16)
    import pandas as pd

    x = pd.Series([np.random.default_rng(6).normal(size=20) for _ in range(9)])
    codes, pieces, tables = book.encode(x), book.pieces(x), book.tables(x)
    for i in range(9):
        for j in range(4):
            far = ((book.points[j] - pieces[i, j]) ** 2).sum(1)
            assert far[codes[i, j]] == pytest.approx(far.min())
            assert tables[i, j] == pytest.approx(book.points[j] @ pieces[i, j])


def test_odd_sides(spark):
    chunks, queries = vectors(spark, "chunk", 30, 7), vectors(spark, "query", 5, 8).withColumn("text", F.lit("x"))
    assert rt.ann_candidates(queries, chunks.limit(0), 5).count() == 0 and rt.ann_candidates(queries.limit(0), chunks, 5).count() == 0
    same = chunks.withColumn("embedding", F.array(*[F.lit(1.0).cast("float")] * 20))
    ties = rt.ann_candidates(queries, same, 3, share=1.0).where("origin = 'library'").collect()
    assert {r.chunk_id for r in ties} == {1, 5, 7, 2, 4, 8}  # the three smallest of each tag
