import functools
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tenderspark.llm import token_ids
from tenderspark.llm.perfect_hash import PerfectHash, fingerprints

TEXTS = [None, "", "It's  a test,\n\n isn't it?  ", "É 12 ½ 漢字   x\t\ty", "a" * 5000, " ".join(f"word{k}" for k in range(9000)), "<|endoftext|>", "'S 's 've  've", "a  b 　 c", "It's  a test,\n\n isn't it?  "]


@functools.cache
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def whole(text):
    t = tokenizer()
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


def test_parts_give_the_ids_of_whole_texts():
    encoder = token_ids.PartEncoder(token_ids.tokenizer_json())
    assert [[*np.frombuffer(ids, "<u4").tolist(), 2] for ids in encoder.encode([t or "" for t in TEXTS])] == [whole(t) for t in TEXTS]


def test_random_texts():
    r = random.Random(1)
    bits = ["\u2167", "\u0661", "_", "\x85", "\u2028", "\u200b", " the", " er", "on", " é", "ß", " ", "  ", "\n", "\t", "0", " 12", "_", "-", "漢", " A", "'s", "'ll", ".", "\x1c", "½", "\u0301", "\xa0", " word", "ing"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 200))) for _ in range(200)]
    encoder = token_ids.PartEncoder(token_ids.tokenizer_json())
    assert [[*np.frombuffer(ids, "<u4").tolist(), 2] for ids in encoder.encode(texts)] == [whole(t) for t in texts]


def test_perfect_hash():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 1000, 30_000):
        keys = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        h = PerfectHash.load(PerfectHash.build(keys).dump())
        assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    other = rng.integers(-(1 << 62), 1 << 62, 1000)
    slot = h.slots(other)
    known = np.zeros(len(keys), np.uint32)
    known[h.slots(keys)] = fingerprints(keys.view(np.uint64))
    assert ((slot >= 0) & (known[np.maximum(slot, 0)] == fingerprints(other.view(np.uint64)))).sum() == 0


def test_table(spark):
    docs = [(i * 7 % 10, t, 1) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([*docs, (3, "again", 1), (None, "x", 1)], "doc_id long, text string, start int")
    written = token_ids.write_ids(df, partitions=3)
    rows = sorted((tuple(r) for r in token_ids.read_ids(written).collect()), key=lambda r: r[1])
    expected, start = [], 0
    for i, t in sorted([*((i, t) for i, t, _ in docs), (3, "again"), (None, "x")], key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = whole(t)
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [r[:4] for r in rows] == expected
    assert sum(r[4] is None for r in rows) == 1 and sum(r[4] is False for r in rows) == 1
    place = written.where("doc_id = 7").first()
    shards = sorted(tuple(r) for r in token_ids.manifest(written).collect())
    assert len(shards) == 3
    text = dict((i, t) for i, t, _ in docs)[7]
    assert token_ids.lookup(place.folder, shards, place.kind, 7).tolist() == whole(text)
    assert token_ids.lookup(place.folder, shards, place.kind, 12345) is None
    assert token_ids.read_ids(token_ids.write_ids(df.limit(0))).count() == 0


def test_added_tokens_as_an_unmodified_tokenizer_has_them(spark):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["foo <|endoftext|> bar", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n b", "<|endoftext>", "no token  here"]
    expected = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert expected[0] == [21943, 220, 50256, 2318]
    encoder = token_ids.PartEncoder(token_ids.tokenizer_json())
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(texts)] == expected
    rows = token_ids.read_ids(token_ids.write_ids(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), partitions=2)).orderBy("doc_id").collect()
    start = 0
    for row, ids in zip(rows, expected, strict=True):
        assert (row.start, row.n_tokens, row.ids_crc32, row.keyed) == (start, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes()), True)
        start += len(ids) + 1


def test_documents_are_read_where_the_hash_leads(spark):
    written = token_ids.write_ids(spark.createDataFrame([(1, "one"), (2, "two words"), (2, "two words again")], "doc_id long, text string"), partitions=1)
    moved = written.withColumn("shard_start", token_ids.F.when(written.has_key, 0).otherwise(written.shard_start))
    expected = [(r.doc_id, r.start, r.ids_crc32) for r in token_ids.read_ids(written).orderBy("start").collect()]
    assert [(r.doc_id, r.start, r.ids_crc32) for r in token_ids.read_ids(moved).orderBy("start").collect()] == expected
