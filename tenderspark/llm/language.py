"""Language identification by words first, then shorter and shorter character n-grams.

A word that training has seen counts by its log frequency in each language. A word it has not seen is scored over its
characters: at each place by the longest known n-gram that begins there, from MAX_ORDER characters down to one. A text's
score is the sum over its words; the language with the highest sum wins, ties go to the first in alphabetical order.

The classifier is fitted on a bounded sample: about `max_training_docs` labelled documents, drawn over all of them by a
hash of id and text. It keeps every word and n-gram of that sample, so the sample bounds the model that is sent to the
tasks. Prediction reads every whole text. Letters are those of the Unicode categories L*.

Defined results: a null text or one without letters is `und` with score 0, and so is every text if there is nothing to
learn from; repeated rows give equal rows; other columns are ignored by prediction.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
MAX_ORDER = 4
MAX_TRAINING_DOCS = 2_000
SMOOTH = 0.5
CACHE = 300_000

ROWS = 500  # texts held at a time
_runs = re.compile(r"[^\W\d_]+").findall  # letters, and numerics that are no decimal digits


def _words(text: str) -> list[str]:
    """Runs of letters."""
    found = _runs(text)
    if not found or "".join(found).isalpha():
        return found
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


@dataclass(frozen=True)
class Model:
    """Rows of the tables are log frequencies in each language, less their mean over the languages."""

    langs: list[str]
    words: list[str]
    word_scores: np.ndarray  # float32[words, langs]
    ngrams: list[str]  # of all orders
    ngram_scores: np.ndarray


def held_out(doc_id):
    """The third of the documents that training never sees."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _ngrams(word: str, order: int) -> list[str]:
    edged = f" {word} "
    return [edged[i : i + order] for i in range(len(edged) - order + 1)]


def train(docs: DataFrame, max_training_docs: int = MAX_TRAINING_DOCS) -> Model:
    """Learn from text and lang of the documents that are not held out."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    total = usable.count()
    buckets = 1 << 20
    share = min(buckets, max_training_docs * buckets // max(1, total))
    sample = usable.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)) < share).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables: dict[tuple[str, int], Counter] = {}
            by_lang: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, Counter()).update(_words(text.lower()))
            for lang, words in by_lang.items():
                tables[lang, 0] = words
                for order in range(1, MAX_ORDER + 1):
                    grams = tables[lang, order] = Counter()
                    for word, n in words.items():
                        for g in _ngrams(word, order):
                            grams[g] += n
            for (lang, order), c in tables.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(c)), pa.array([order] * len(c), pa.int32()), pa.array(list(c)), pa.array(list(c.values()), pa.int64())], ["lang", "ord", "gram", "n"]
                )

    counts = sample.mapInArrow(count, "lang string, ord int, gram string, n long").groupBy("ord", "gram", "lang").agg(F.sum("n").alias("n"))
    # As many as the sample holds. They reach the driver as Arrow columns, since a Python row for each gram takes many times the room.
    found = counts.toArrow().combine_chunks().sort_by([("ord", "ascending"), ("gram", "ascending")])
    langs = sorted(found["lang"].unique().to_pylist())

    def table(order: int) -> tuple[list[str], np.ndarray]:
        """(grams, log frequencies in each language, less their mean over the languages)"""
        own = found.filter(pc.equal(found["ord"], order))
        grams = own["gram"].combine_chunks().dictionary_encode()
        n = np.full((len(grams.dictionary), len(langs)), SMOOTH)
        n[grams.indices.to_numpy(), pc.index_in(own["lang"], pa.array(langs, pa.string())).to_numpy()] += own["n"].to_numpy()
        if langs:
            n = np.log(n / n.sum(axis=0))
            n -= n.mean(axis=1, keepdims=True)
        return grams.dictionary.to_pylist(), n.astype(np.float32)

    words, *ngrams = map(table, range(MAX_ORDER + 1))
    return Model(langs, *words, [g for grams, _ in ngrams for g in grams], np.concatenate([scores for _, scores in ngrams]))


class Scorer:
    """Scores texts; words met for the first time get a row of their own, so each is backed off once."""

    def __init__(self, model: Model):
        self.model = model
        self.grams = {g: i for i, g in enumerate(model.ngrams)}
        self._forget()

    def _forget(self) -> None:
        self.index = {w: i for i, w in enumerate(self.model.words)}
        self.scores = self.model.word_scores

    def _learn(self, words: list[str]) -> None:
        """Rows of unseen words: at each place the longest known n-gram that begins there, averaged over the places."""
        grams, flat, sizes, places = self.grams, [], [], []
        for word in words:
            edged, before = f" {word} ", len(flat)
            for at in range(len(edged)):
                for stop in range(at + MAX_ORDER, at, -1):
                    row = grams.get(edged[at:stop])
                    if row is not None:
                        flat.append(row)
                        break
            sizes.append(len(flat) - before)
            places.append(len(edged))
        rows = np.zeros((len(words), len(self.model.langs)), np.float32)
        if flat:
            n = np.array(sizes)
            full = np.flatnonzero(n)
            starts = (np.cumsum(n) - n)[full]
            rows[full] = np.add.reduceat(self.model.ngram_scores[flat], starts, axis=0)
        rows *= (2 / np.array(places, np.float32))[:, None]  # about what one known word says
        self.index.update(zip(words, range(len(self.scores), len(self.scores) + len(words)), strict=True))
        self.scores = np.concatenate([self.scores, rows])

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        counts = [Counter(_words((t or "").lower())) for t in texts]
        if not self.model.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        if len(self.index) > len(self.model.words) + CACHE:
            self._forget()
        index = self.index
        if fresh := list({w for c in counts for w in c if w not in index}):
            self._learn(fresh)
        out = []
        for c in counts:
            if not c:
                out.append((UNKNOWN, 0.0))
                continue
            n = np.fromiter(c.values(), np.float64, len(c))
            total = n @ self.scores[np.fromiter(map(index.__getitem__, c), np.int64, len(c))]
            p = np.exp((total - total.max()) / np.sqrt(n.sum()))
            out.append((self.model.langs[int(total.argmax())], float(p.max() / p.sum())))
        return out

    def text(self, text: str | None) -> tuple[str, float]:
        return self.texts([text])[0]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text -> doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the words and n-grams of the bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part in _slices(batches):
            rows = scorer.texts(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of the documents whose language is identified; `und` documents go.

    Those are the texts without letters. If there was nothing to learn from, texts with letters stay all the same. The
    language itself is not passed on, since the stages of a pipeline keep the columns that they were given.
    """
    shared, columns = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part in _slices(batches):
            texts = part.column(columns.index("text")).to_pylist()
            keep = [r[0] != UNKNOWN for r in scorer.texts(texts)] if scorer.model.langs else [bool(_words(t or "")) for t in texts]
            yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
