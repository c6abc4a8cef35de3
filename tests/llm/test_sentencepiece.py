import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tenderspark.llm import sentencepiece_lattice as sl

TEXTS = [None, "", " ", "   two  spaces ", "Hello world\n\nnew line", "É ñ 漢字 \U0001f600 ½", "x" * 200, "a" * 33 + " " + "b" * 32, "ab" * 5000, "tab\tand\rreturn", "the the the", "w " * 20_000]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def random_texts(n):
    r = random.Random(9)
    bits = ["th", "er", "on", "eau", "é", "ß", " ", "  ", "the", "ing", "\n", "0", "12", "_", "-", "漢", "A", "ation", "'s", "."]
    return ["".join(r.choice(bits) for _ in range(r.randint(1, 80))) for _ in range(n)]


def test_merges_equal_the_library(library):
    pieces = sl.load_pieces()
    for t in [*TEXTS, *random_texts(300)]:
        ids = [i for w in sl.cut(t, pieces) for i in sl.piece_ids(sl.merge_word(w, pieces.scores), pieces)]
        assert ids == library.encode(t or "")
        assert sl.decode_ids(ids, pieces) == (t or "")


def test_tables(spark, library, tmp_path):
    texts = [*TEXTS, *random_texts(60)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "the", 2), (4, "again", 2)], "doc_id long, text string, word int")
    df.repartition(3).write.parquet(f"{tmp_path}/d")
    for source in (df, spark.read.parquet(f"{tmp_path}/d"), df.distinct()):
        encoded = sl.encode(source)
        rows = encoded.collect()
        assert len(rows) == len(texts) + 2
        assert sorted((str(r.doc_id), list(r.ids)) for r in rows) == sorted((str(i), library.encode(t or "")) for i, t in [*enumerate(texts), (None, "the"), (4, "again")])
    every = {str(i): t or "" for i, t in [*enumerate(texts), (None, "the")]}
    for r in sl.encode_summary(df.where("doc_id IS NULL OR word = 1")).collect():
        ids = library.encode(every[str(r.doc_id)])
        assert (r.n_pieces, r.ids_crc32, r.text_sha256) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256(every[str(r.doc_id)].encode()).hexdigest())
    back = sorted((str(r.doc_id), r.text) for r in sl.decode(encoded).collect())
    assert back == sorted((str(i), t or "") for i, t in [*enumerate(texts), (None, "the"), (4, "again")])
    assert sl.encode(df.limit(0)).count() == 0


def test_viterbi_fold_equals_brute_force(spark):
    r = random.Random(6)
    scores = {"a": -3.0, "b": -3.5, "ab": -4.0, "ba": -5.25, "aba": -6.5, "bb": -7.5, "abab": -9.0, "c": -2.0}
    pieces = sl.Pieces(scores, {p: i for i, p in enumerate(scores)}, [], 99, False, False)
    words = list({"".join(r.choice("abcd") for _ in range(r.randint(1, 9))) for _ in range(60)})

    def paths(w):
        if not w:
            yield 0.0, []
        for k in range(1, min(4, len(w)) + 1):
            s = scores.get(w[:k], sl.UNKNOWN if k == 1 else None)
            if s is not None:
                for total, rest in paths(w[k:]):
                    yield s + total, [w[:k], *rest]

    got = {x.word: [x.word[b:e] for b, e in zip(x.bounds, x.bounds[1:])] for x in sl.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), pieces).collect()}
    for w in words:
        assert sum(scores.get(p, sl.UNKNOWN) for p in got[w]) == max(s for s, _ in paths(w))
        assert got[w] == sl.best_path(w, scores, 4)
