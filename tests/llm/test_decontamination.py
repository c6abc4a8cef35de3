import itertools
import random
import re

from tenderspark.llm import decontamination as dc


def brute(docs, items):
    out = {}
    cut = lambda t: re.split(r"[^\w]+", (t or "").lower().replace("_", " "))
    for d, text in docs:
        if d is None:
            continue
        w = cut(text)
        for k, item in items:
            x = [v for v in cut(item) if v]
            if len(x) < 5:
                continue
            least = dc.SHORT.get(len(x), 11)
            for shift in range(-len(x), len(w)):
                same = [0 <= i + shift < len(w) and w[i + shift] == v for i, v in enumerate(x)]
                best = max(sum(same[i : i + 13]) for i in range(max(1, len(x) - 12)))
                if best >= least:
                    row = (best, sum(same), -shift, len(x))
                    out[d, k] = max(out.get((d, k), row), row)
    return {(d, k, n, best, same, -back) for (d, k), (best, same, back, n) in out.items()}


def test_masks_cover_every_window_with_two_substitutions():
    for wrong in itertools.combinations(range(dc.WINDOW), dc.WINDOW - dc.LEAST):
        assert any(not {o + p for p in m} & set(wrong) for m in dc.MASKS for o in range(dc.WINDOW - dc.SPAN + 1))


def test_against_brute_force(spark):
    r = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(r.choice(words) for _ in range(r.choice([4, 5, 6, 7, 9, 10, 11, 12, 13, 20, 30])))) for k in range(24)] + [(50, None), (51, "")]
    docs = []
    for i in range(240):
        w = [r.choice(words) for _ in range(r.choice([0, 3, 40]))]
        if r.random() < 0.7:
            x = r.choice(items[:24])[1].split()
            for _ in range(r.choice([0, 1, 2, 3, 5])):
                x[r.randrange(len(x))] = r.choice(words)
            if r.random() < 0.3:
                x = x[r.randrange(4) :]
            at = r.randint(0, len(w))
            w[at:at] = x
        docs.append((i, r.choice(["", "--"]) + (", " if i % 3 else " ").join(w).title()))
    docs += [(500, None), (501, ""), (None, items[3][1]), (502, items[3][1]), (502, items[3][1]), (503, "w1 " * 20_000 + items[5][1])]
    df = spark.createDataFrame([(*d, 0, "s") for d in docs], "doc_id long, text string, item_id int, seed string")
    bench = spark.createDataFrame([(*b, 0) for b in items], "item_id long, text string, doc_id int")
    expected = brute(docs, items)
    assert expected
    for limit in (10**6, 0):
        rows = dc.leaks(df, bench, limit).collect()
        assert len(rows) == len(expected)
        assert {(r.doc_id, r.item_id, r.item_words, r.best_window, r.equal_words, r.shift) for r in rows} == expected
    kept = dc.drop_leaking(df, bench)
    assert kept.columns == df.columns
    bad = {e[0] for e in expected}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, _ in docs if d not in bad), key=str)
    assert dc.leaks(df.limit(0), bench).count() == 0 and dc.leaks(df, bench.limit(0)).count() == 0


def test_short_items_with_one_substitution_hold_a_seed():
    for n, least in dc.SHORT.items():
        for wrong in range(n) if least < n else []:
            assert any(wrong not in {o + p for p in m} for m in dc.MASKS for o in range(n - dc.SPAN + 1))


def test_stage_with_clashing_names(spark):
    item = " ".join(f"w{k}" for k in range(20))
    df = spark.createDataFrame([(1, item, 0, 0, 0), (2, "clean", 0, 0, 0), (None, item, 0, 0, 0)], "doc_id long, text string, leaking int, _leaking int, shift int")
    kept = dc.drop_leaking(df, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2]


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    plan = dc.leaks(df, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
