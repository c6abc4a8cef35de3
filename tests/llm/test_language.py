import random
import zlib

from tenderspark.llm import language

SYLLABLES = {"aa": ["ka", "tu", "mi", "ro"], "bb": ["sch", "ein", "und", "keit"], "cc": ["eau", "oi", "é", "tion"]}


def corpus(n=400):
    r = random.Random(2)
    out = []
    for i in range(n):
        lang = r.choice(list(SYLLABLES))
        words = ["".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 40))]
        out.append((i, " ".join(words).capitalize() + ".", lang))
    return out


def test_held_out_accuracy(spark):
    docs = corpus()
    df = spark.createDataFrame([(*d, "x", 0.5) for d in docs], "doc_id long, text string, lang string, source string, score double")
    model = language.train(df)
    assert model.langs == sorted(SYLLABLES)
    rows = {r.doc_id: r for r in language.predict(df, model).collect()}
    held = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 3 == 1]
    assert sum(rows[i].lang_pred == lang for i, _, lang in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert {r.doc_id for r in df.where(language.held_out(df.doc_id)).collect()} == {d[0] for d in held}


def test_held_out_rows_are_not_learned(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 3 == 1)
    used = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 3 != 1)
    df = spark.createDataFrame([(held, "zz zz zz", "zz"), (used, "yy yy yy", "yy"), (used, None, "qq"), (used, "pp pp", None)], "doc_id long, text string, lang string")
    assert language.train(df).langs == ["yy"]


def test_odd_rows(spark):
    df = spark.createDataFrame(corpus(60), "doc_id long, text string, lang string")
    model = language.train(df)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 __ !"), (5, "\u00bd \u00b2 \u2167"), (6, "eau\u00b2eau"), (None, "einund keit"), (4, "eau " * 50_000), (4, "eau")], "doc_id long, text string")
    rows = sorted(((r.doc_id or 0, r.lang_pred) for r in language.predict(odd, model).collect()))
    assert rows == [(0, "bb"), (1, "und"), (2, "und"), (3, "und"), (4, "cc"), (4, "cc"), (5, "und"), (6, "cc")]
    assert sorted(r.doc_id or 0 for r in language.keep_identified(odd, model).collect()) == [0, 4, 4, 6]
    nothing = language.train(df.limit(0))
    assert {r.lang_pred for r in language.predict(odd, nothing).collect()} == {"und"}
    assert language.predict(odd.limit(0), model).count() == 0


def test_backoff_uses_the_longest_known_ngram():
    import numpy as np

    model = language.Model(["a", "b"], ["cat"], np.array([[1.0, -1.0]], np.float32), ["x", "xy"], np.array([[-1.0, 1.0], [3.0, -3.0]], np.float32))
    scorer = language.Scorer(model)
    assert scorer.text("cat")[0] == "a" and scorer.text("xy")[0] == "a" and scorer.text("xz")[0] == "b"


def test_texts_with_letters_stay_when_nothing_can_be_learned(spark):
    docs = spark.createDataFrame([(1, "plain words", None), (2, "12 34 !!", None), (3, None, None), (4, "\u00e9", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in language.keep_identified(docs, language.train(docs)).collect()) == [1, 4]


def plain_scores(text, docs):
    """The method once more, word by word, without tables, arrays or memory."""
    from collections import Counter
    from math import log

    langs = sorted({lang for _, _, lang in docs})
    counts = {k: {lang: Counter() for lang in langs} for k in range(language.MAX_ORDER + 1)}
    split = lambda t: "".join(c if c.isalpha() else " " for c in t.lower()).split()
    for _, body, lang in docs:
        for w in split(body):
            counts[0][lang][w] += 1
            for k in range(1, language.MAX_ORDER + 1):
                counts[k][lang].update(f" {w} "[i : i + k] for i in range(len(w) + 3 - k))
    vocabulary = {k: set().union(*c.values()) for k, c in counts.items()}

    def row(k, gram):
        x = [log((counts[k][lang][gram] + language.SMOOTH) / (sum(counts[k][lang].values()) + language.SMOOTH * len(vocabulary[k]))) for lang in langs]
        return [v - sum(x) / len(x) for v in x]

    total = [0.0] * len(langs)
    for w in split(text):
        if w in vocabulary[0]:
            rows, weight = [row(0, w)], 1.0
        else:
            rows, edged = [], f" {w} "
            weight = 2 / len(edged)
            for i in range(len(edged)):
                k = next((k for k in range(language.MAX_ORDER, 0, -1) if len(edged[i : i + k]) == k and edged[i : i + k] in vocabulary[k]), 0)
                rows += [row(k, edged[i : i + k])] if k else []
        total = [t + weight * sum(r[j] for r in rows) for j, t in enumerate(total)]
    return dict(zip(langs, total, strict=True)), len(split(text))


def test_scores_equal_a_plain_version(spark):
    from math import exp, sqrt

    import pytest

    docs = corpus(60)
    model = language.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    learned = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 3 != 1]
    scorer = language.Scorer(model)
    for text in [d[1] for d in docs[:20]] + ["kasch eintu zz", "unknown words here", "\u00e9tion keit keit", "a1b2 mi-ro"]:
        want, words = plain_scores(text, learned)
        lang, score = scorer.text(text)
        best = max(want.values())
        assert want[lang] == pytest.approx(best, abs=1e-3)
        assert score == pytest.approx(1 / sum(exp((v - best) / sqrt(words)) for v in want.values()), rel=1e-3)


def test_training_keeps_no_python_row_for_each_gram(spark):
    """The driver may hold a few hundred bytes for each word and n-gram of the sample; a Python row of each takes over 800."""
    import tracemalloc

    r = random.Random(4)
    docs = [(i, " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(100)), r.choice("xyz")) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    tracemalloc.start()
    try:
        model = language.train(df)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    grams = len(model.words) + len(model.ngrams)
    assert grams > 50_000
    assert peak < 400 * grams
