import random

import numpy as np

from tenderspark.llm import components
from tenderspark.llm import near_dedup as nd
from tenderspark.llm.components import connected_components, merged
from tenderspark.llm.shingles import shingle_sets


def shingles(text, width):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(docs, width, percent=80):
    """{doc_id: (shingles, smallest reachable)} by comparing all pairs."""
    sets = [(i, shingles(t, width)) for i, t in docs if i is not None]
    head = {i: i for i, _ in sets}

    def top(i):
        while head[i] != i:
            i = head[i]
        return i

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((top(i), top(j)))
                head[high] = low
    return {(i, len(x), top(i)) for i, x in sets}


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    docs, base = [], []
    for i in range(n):
        kind = r.random()
        if base and kind < 0.6:
            t = r.choice(base).split(" ")
            for _ in range(r.choice([0, 1, 2, 4, 8])):
                t[r.randrange(len(t))] = r.choice(words)
            t = " ".join(t)
        else:
            t = " ".join(r.choice(words) for _ in range(r.choice([0, 1, 2, 5, 60, 200])))
        base.append(t)
        docs.append((i * 7 % n + n, t))
    return docs


def test_shingle_sets_match_python_sets():
    r = random.Random(1)
    texts = ["", "a", " a b ", "A b a B a b", "x\n\ty\x0b z", "é É  é\x1f"] + [" ".join(r.choice("abcde") for _ in range(r.randint(0, 30))) for _ in range(200)]
    for width in (1, 2, 5):
        hashes, counts = shingle_sets([t.encode() for t in texts], width)
        assert counts.tolist() == [len(shingles(t, width)) for t in texts]
        per = np.split(hashes, np.cumsum(counts)[:-1])
        for i in range(0, len(texts), 5):
            for j in range(0, len(texts), 7):
                assert len(np.intersect1d(per[i], per[j])) == len(shingles(texts[i], width) & shingles(texts[j], width))


def test_signature_agreement_estimates_similarity():
    a, b = " ".join(f"x{k}" for k in range(1000)), " ".join(f"x{k}" for k in range(250, 1250))
    hashes, counts = shingle_sets([a.encode(), b.encode()], 1)
    s = nd.signatures(hashes, counts, nd.permutations())
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.1


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, k) for k in range(200, 260)] + [(7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {k: 100 for k in [100, *range(200, 260)]}
    assert connected_components(edges.limit(0)).count() == 0


def _writes(monkeypatch):
    """Names of the tables that the component steps and near_dedup write from now on."""
    seen = []
    for module in (components, nd):
        monkeypatch.setattr(module, "written", lambda df, name, real=module.written: seen.append(name) or real(df, name))
    return seen


def test_finished_components_take_no_step(spark, monkeypatch):
    """Each step costs the driver a task for every partition of a dozen shuffles."""
    seen = _writes(monkeypatch)
    stars = spark.createDataFrame([(1, 5), (5, 1), (1, 7), (3, 4), (9, 9)], "a long, b long")
    assert {tuple(r) for r in connected_components(stars).collect()} == {(1, 1), (5, 1), (7, 1), (3, 3), (4, 3)}
    assert seen == ["edges"]
    seen.clear()
    pair = spark.createDataFrame([(2, 5), (5, 6)], "a long, b long")
    assert {tuple(r) for r in connected_components(pair).collect()} == {(2, 2), (5, 2), (6, 2)}
    assert seen == ["edges", "edges"]


def test_hubs_meet_all_their_places(spark):
    """A hub with leaves in every place, below and above it."""
    edges = [(5_000, n) for n in range(4_000, 6_000) if n != 5_000] + [(4_321, 7), (9_001, 9_000), (-3, 9_000), (-3, -9)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: 7 for n in [7, *range(4_000, 6_000)]} | {n: -9 for n in (-9, -3, 9_000, 9_001)}


def test_components_are_found_once_without_strays(spark, monkeypatch):
    seen = _writes(monkeypatch)
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text), (2, text), (3, text.replace("w30", "x")), (4, "b"), (5, None)], "doc_id long, text string")
    assert {tuple(r)[::2] for r in nd.near_duplicates(docs).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)}
    assert "more" not in seen and seen.count("edges") <= 2


def test_merged(spark):
    nodes = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 3, "c"), (4, 3, "d"), (5, 5, "e"), (6, 6, "f"), (None, None, "g"), (4, 3, "d")], "node long, component long, x string")
    links = spark.createDataFrame([(3, 5), (1, 5), (5, 3)], "a long, b long")
    got = sorted(map(tuple, merged(nodes, links).collect()), key=str)
    assert got == sorted([(1, 1, "a"), (2, 1, "b"), (3, 1, "c"), (4, 1, "d"), (5, 1, "e"), (6, 6, "f"), (None, None, "g"), (4, 1, "d")], key=str)


def test_against_all_pairs(spark):
    docs = corpus(3, 300) + [(None, "w1 w2 w3"), (1, None), (2, " \n"), (3, "one"), (4, "ONE"), (5, "w1 " * 30_000), (5, "w1 " * 30_000)]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in docs], "doc_id long, text string, component long, member long")
    for width in (2, 5):
        rows = nd.near_duplicates(df, width).collect()
        assert len(rows) == len(docs)
        assert {tuple(r)[:3] for r in rows if r.doc_id is not None} == brute(docs, width)
        assert all(r.kept == (r.doc_id == r.component_id) for r in rows if r.doc_id is not None)
        assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert nd.near_duplicates(df.limit(0)).count() == 0


def test_links_that_no_pivot_sees(spark):
    """A band of texts each similar to its neighbours only, so that components need more than one pivot."""
    words = [f"v{k}" for k in range(600)]
    docs = [(i, " ".join(words[i * 3 : i * 3 + 60])) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {tuple(r)[:3] for r in nd.near_duplicates(df, 2).collect()}
    assert got == brute(docs, 2)


def test_small_parts_and_blocks_give_the_same(spark, monkeypatch):
    docs = corpus(8, 200) + [(5000 + i, "same text of every copy here") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for name, value in (("PAIRS", 2), ("BLOCK", 3), ("BLOCK_BYTES", 500), ("PLACES", 4)):
        monkeypatch.setattr(nd, name, value)
    assert {tuple(r)[:3] for r in nd.near_duplicates(df, 2).collect()} == brute(docs, 2)


def test_stage_with_clashing_names(spark):
    docs = [(3, "a b c d e f"), (1, "a b c d e f"), (2, "other words than those"), (None, "x"), (2, "other words than those")]
    df = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "doc_id long, text string, copy int, _copy int, component_id int")
    kept = nd.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0 for r in kept.collect())) == [0, 1, 2, 2]
