"""The written inverted index against a plain search."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tenderspark.operators import keyword_index as ki
from tenderspark.operators import retrieval as rt

CHUNKS = "chunk_id int, tenant string, proposal_id int, content string, embedding array<double>, industry string, document_type string, outcome string"
QUERIES = "query_id int, tenant string, proposal_id int, text string, embedding array<double>, industry string, document_type string, outcome string"


def words(text):
    return [w for w in re.findall(r"[^\W_]+", (text or "").lower()) if w not in ki.STOP_WORDS]


def plain(queries, chunks, k):
    out = set()
    for q in queries:
        for origin in ["library"] + (["bid"] if q[2] is not None else []):
            found = []
            for c in chunks:
                if c[1] != q[1] or c[2] != (q[2] if origin == "bid" else None) or any(w is not None and w != h for w, h in zip(q[5:], c[5:], strict=True)):
                    continue
                asked, held = set(words(q[3])), words(c[3])
                if asked and asked <= set(held):
                    found.append((-round(sum(math.log(1 + held.count(w)) for w in asked), 6), c[0]))
            out |= {(q[0], origin, c, n) for n, (_, c) in enumerate(sorted(found)[:k], 1)}
    return out


def corpus(seed=1, n=80):
    r = random.Random(seed)
    vocabulary = ["alpha", "beta", "gamma", "delta", "Épsilon", "zeta", "x1", "the", "of"]
    text = lambda most: r.choice([None, "", "the of"]) if r.random() < 0.05 else " - ".join(r.choice(vocabulary) for _ in range(r.randint(1, most)))
    tag = lambda p: [r.choice("ab") if r.random() < p else None for _ in range(3)]
    chunks = [(i, r.choice("st"), r.choice([None, None, 1, 2]), text(14), [1.0, float(i)], *tag(0.9)) for i in range(n)]
    queries = [(i, r.choice("st"), r.choice([None, 1, 2]), text(8), [1.0, 0.5], *tag(0.2)) for i in range(60)]
    return chunks, queries


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_against_a_plain_search(spark, monkeypatch, broadcast):
    monkeypatch.setattr(ki, "MAX_BROADCAST_ROWS", broadcast)
    chunks, queries = corpus()
    found = rt.keyword_join(spark.createDataFrame(queries, QUERIES), spark.createDataFrame(chunks, CHUNKS), 5).collect()
    assert len(found) > 20 and {(r.query_id, r.origin, r.chunk_id, r["rank"]) for r in found} == plain(queries, chunks, 5)


def test_a_kept_index_is_read_again(spark, tmp_path):
    chunks, queries = corpus(4)
    c, q = spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(queries, QUERIES)
    ki.build(c, f"{tmp_path}/index", 3)
    index = ki.load(spark, f"{tmp_path}/index", 3)
    assert {x.part for x in index.postings.select("part").distinct().collect()} <= {0, 1, 2}
    without_texts = c.withColumn("content", F.raise_error(F.lit("a text was read")).cast("string"))
    found = rt.keyword_join(q, without_texts, 5, index).collect()
    assert {(r.query_id, r.origin, r.chunk_id, r["rank"]) for r in found} == plain(queries, chunks, 5)


def test_only_the_partitions_of_the_terms_are_read(spark, tmp_path):
    chunks, _ = corpus(5)
    index = ki.build(spark.createDataFrame(chunks, CHUNKS), f"{tmp_path}/index", 16)
    one = index.postings.where((F.col("part") == ki.part_of(F.lit("alpha"), 16)) & (F.col("term") == "alpha"))
    assert len(one.inputFiles()) >= 1 and "PartitionFilters: [isnotnull(part" in one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == sum("alpha" in words(c[3]) for c in chunks)


def test_empty_sides(spark):
    chunks, queries = corpus()
    c, q = spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(queries, QUERIES)
    assert rt.keyword_join(q.limit(0), c, 5).count() == 0 and rt.keyword_join(q, c.limit(0), 5).count() == 0


def test_a_term_of_every_chunk(spark):
    """A frequent term weighs in without being where a search starts."""
    chunks = [(i, "s", None, f"common common rare{i % 50}", [1.0], None, None, None) for i in range(2000)]
    queries = [(i, "s", None, f"common rare{i}", [1.0], None, None, None) for i in range(50)]
    found = rt.keyword_join(spark.createDataFrame(queries, QUERIES), spark.createDataFrame(chunks, CHUNKS), 100).groupBy("query_id").count().collect()
    assert {(r.query_id, r["count"]) for r in found} == {(i, 40) for i in range(50)}
