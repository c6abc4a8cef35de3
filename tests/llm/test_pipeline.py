import random

import corpus_pipeline
import public_tokenizers
import sentencepiece

from tenderspark.llm import language, secrets
from tests.llm.test_decontamination import brute as brute_leaks
from tests.llm.test_near_dedup import brute as brute_groups


def corpus():
    r = random.Random(12)
    words = [f"{a}{b}" for a in ("ka", "tu", "mi", "ro", "se") for b in ("ta", "lo", "ne", "ri", "ba", "do", "fi", "gu")]
    items = [(k, " ".join(r.choice(words) for _ in range(25))) for k in range(4)]
    docs = []
    for i in range(80):
        kind = i % 8
        text = " ".join(r.choice(words) for _ in range(60))
        if kind == 1 and docs:
            text = docs[r.randrange(len(docs))][1] or text
        elif kind == 2 and docs:
            text = (docs[r.randrange(len(docs))][1] or text) + " tail"
        elif kind == 3:
            text += " " + items[i % 4][1] + " end"
        elif kind == 4:
            text += " token=abcdef123456"
        elif kind == 5:
            text = ["", None, "12 34 !!", "  "][i // 8 % 4]
        docs.append((i, text, r.choice(["xx", "yy", None]), "s", len(text or "")))
    return docs, items


def test_pipeline_against_brute_force(spark, tmp_path):
    docs, items = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    table = spark.createDataFrame(docs, schema)
    table.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    scorer = language.Scorer(language.train(table))
    left = [d for d in docs if scorer.text(d[1])[0] != "und"]
    groups = {i: c for i, _, c in brute_groups([d[:2] for d in left], 5)}
    left = [d for d in left if groups[d[0]] == d[0]]
    bad = {row[0] for row in brute_leaks([d[:2] for d in left], items)}
    left = [d for d in left if d[0] not in bad]
    clean = {d[0]: secrets.masked(d[1], s) for d, s in zip(left, secrets.find_secrets([d[1] for d in left]), strict=True)}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert bad and 20 < len(clean) < 70
    assert got == {i: library.encode(t) for i, t in clean.items()}


def test_stages_keep_the_columns(spark, tmp_path):
    docs, items = corpus()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.createDataFrame(docs[:12], "doc_id long, text string, lang string, source string, n_chars long").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, str(tmp_path))
        assert out.columns == table.columns and out.count() == 0, name
