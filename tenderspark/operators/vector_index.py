"""Product-quantised vectors: short codes for every chunk, exact ranking of a short list (J-12).

Unit vectors are cut into `parts` pieces and each piece becomes the number of its nearest of `centroids` points, fitted on
a bounded sample. A search scores all codes of a pool by table look-ups, one table a query, and ranks the best `share` of
them by their true vectors; only those are read. Codes are a few bytes where a vector has hundreds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderspark.sources.shared import new_path

SAMPLE, ROUNDS = 20_000, 8


@dataclass(frozen=True)
class Codebook:
    """Points of each piece: parts x centroids x width; vectors are padded with zeros to parts * width."""

    points: np.ndarray
    size: int

    def pieces(self, vectors: pd.Series) -> np.ndarray:
        """rows x parts x width, of unit length as a whole."""
        parts, _, width = self.points.shape
        x = np.zeros((len(vectors), parts * width))
        if len(vectors):
            x[:, : self.size] = np.stack(vectors.to_numpy())
        return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).reshape(len(x), parts, width)

    def encode(self, vectors: pd.Series) -> np.ndarray:
        x = self.pieces(vectors)
        return np.stack([nearest(x[:, j], self.points[j]) for j in range(len(self.points))], axis=1).astype(np.uint8)

    def tables(self, vectors: pd.Series) -> np.ndarray:
        """queries x parts x centroids: what a code adds to the score."""
        return np.einsum("njw,jcw->njc", self.pieces(vectors), self.points)


def nearest(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return ((points**2).sum(1)[None, :] - 2 * x @ points.T).argmin(1)


def fit(chunks: DataFrame, parts: int = 16, centroids: int = 128, sample: int = SAMPLE, seed: int = 1) -> Codebook:
    """k-means of each piece over about `sample` vectors of `chunks`, which bounds what the driver gets."""
    vectors = chunks.where("embedding IS NOT NULL").select("chunk_id", "embedding")
    n = vectors.count()
    some = vectors.where(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 20)) < max(1, (sample << 20) // max(n, sample))).select("embedding").limit(2 * sample).toPandas()["embedding"]
    size = len(some.iloc[0]) if len(some) else 1
    width = -(-size // parts)
    x = Codebook(np.zeros((parts, 1, width)), size).pieces(some)
    rng, points = np.random.default_rng(seed), np.zeros((parts, max(1, min(centroids, len(x), 256)), width))
    for j in range(parts):
        if not len(x):
            break
        points[j] = x[rng.permutation(len(x))[: points.shape[1]], j]
        for _ in range(ROUNDS):
            own = nearest(x[:, j], points[j])
            count = np.bincount(own, minlength=points.shape[1])
            sums = np.stack([np.bincount(own, x[:, j, w], points.shape[1]) for w in range(width)], axis=1)
            points[j] = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], points[j])
    return Codebook(points, size)


def build(chunks: DataFrame, codebook: Codebook, path: str | None = None) -> DataFrame:
    """The columns of `chunks` but its vectors, with the `code` of each, written below `path`; chunks without a vector have none."""

    @F.pandas_udf("binary")
    def encoded(vectors: pd.Series) -> pd.Series:
        return pd.Series([row.tobytes() for row in codebook.encode(vectors)], dtype=object)

    path = path or new_path(chunks.sparkSession, "codes")
    coded = chunks.where("embedding IS NOT NULL").withColumn("code", encoded("embedding")).drop("embedding")
    coded.write.parquet(path)
    return chunks.sparkSession.read.schema(coded.schema).parquet(path)


def best_codes(tables: np.ndarray, codes: pd.Series, allowed: np.ndarray, share: float, least: int) -> list[np.ndarray]:
    """For each query the places of the best `share` of the codes that it may see, at least `least`."""
    c = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1).astype(np.int64)
    out = []
    for i in range(len(tables)):
        at = np.flatnonzero(allowed[i])
        if len(at) > (most := max(least, int(np.ceil(share * len(at))))):
            scores = tables[i][np.arange(c.shape[1])[:, None], c[at].T].sum(0)
            at = at[np.argpartition(-scores, most - 1)[:most]]
        out.append(at)
    return out
