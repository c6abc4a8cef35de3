"""Linear-chain conditional random field in numpy: fitted by gradient descent, decoded by Viterbi over padded batches.

A sequence is a list of tokens, a token a list of feature names. Features that training has not seen weigh nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

NEVER = -1e9  # score of what may not occur
MIN_COUNT, L2, STEPS, RATE = 2, 0.02, 80, 0.2
PAD_TOKENS = 1 << 16  # padded tokens decoded at once


@dataclass(frozen=True)
class Chain:
    labels: list[str]
    features: dict[str, int]
    emit: np.ndarray  # features x labels
    step: np.ndarray  # label before x label
    first: np.ndarray  # score of a label at the start


def bio(kinds: list[str]) -> list[str]:
    return ["O"] + [f"{p}-{k}" for k in kinds for p in "BI"]


def allowed(labels: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(label before x label, label at the start): 0, or NEVER where I-k does not continue a k."""
    step = np.array([[NEVER if b[0] == "I" and a[1:] != b[1:] else 0.0 for b in labels] for a in labels])
    return step, np.array([NEVER if b[0] == "I" else 0.0 for b in labels])


def emissions(chain: Chain, tokens: list[list[str]]) -> np.ndarray:
    """tokens x labels."""
    known = [[i for f in t if (i := chain.features.get(f)) is not None] for t in tokens]
    sizes = np.fromiter(map(len, known), np.int64, len(known))
    flat = np.fromiter((i for t in known for i in t), np.int64, int(sizes.sum()))
    sums = np.concatenate([np.zeros((1, len(chain.labels))), np.cumsum(chain.emit[flat], axis=0)])
    ends = np.cumsum(sizes)
    return sums[ends] - sums[ends - sizes]


def viterbi(chain: Chain, scores: list[np.ndarray]) -> list[np.ndarray]:
    """The best label of each token, for each sequence of emission scores (tokens x labels); sequences of like length are
    decoded together."""
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(scores)
    order = sorted((i for i in range(len(scores)) if len(scores[i])), key=lambda i: len(scores[i]))
    while order:
        size = max(1, PAD_TOKENS // len(scores[order[-1]]))
        batch, order = order[-size:], order[:-size]
        for i, path in zip(batch, _decode(chain, [scores[i] for i in batch]), strict=True):
            out[i] = path
    return out


def _decode(chain: Chain, scores: list[np.ndarray]) -> list[np.ndarray]:
    sizes = np.array([len(s) for s in scores])
    n, t = len(scores), int(sizes.max())
    padded = np.zeros((t, n, len(chain.labels)))
    for i, s in enumerate(scores):
        padded[: len(s), i] = s
    best, back = padded[0] + chain.first, np.zeros((t, n, len(chain.labels)), np.int8)
    for k in range(1, t):
        moves = best[:, :, None] + chain.step
        back[k] = moves.argmax(1)
        best = np.where((k < sizes)[:, None], moves.max(1) + padded[k], best)
    path = np.zeros((t, n), np.int64)
    label, rows = best.argmax(1), np.arange(n)
    for k in range(t - 1, -1, -1):
        path[k] = label
        label = np.where(k < sizes, back[k, rows, label], label) if k else label
    return [path[: sizes[i], i] for i in range(n)]


def posteriors(emit: np.ndarray, step: np.ndarray, first: np.ndarray, mask: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(sum of log Z, label posteriors tokens x sequences x labels, summed transition posteriors) of padded emissions.

    Forward and backward sums are scaled to one at each token.
    """
    t, n, k = emit.shape
    top = emit.max(2, keepdims=True)
    local, move = np.exp(emit - top), np.exp(step)
    forward, backward, scale = np.zeros((t, n, k)), np.ones((t, n, k)), np.ones((t, n))
    for i in range(t):
        new = (forward[i - 1] @ move if i else np.exp(first)) * local[i]
        scale[i] = np.where(mask[i], new.sum(1), 1.0)
        forward[i] = np.where(mask[i][:, None], new / scale[i][:, None], forward[i - 1])
    moves = np.zeros((k, k))
    for i in range(t - 2, -1, -1):
        ahead = np.where(mask[i + 1][:, None], backward[i + 1] * local[i + 1] / scale[i + 1][:, None], 0.0)
        backward[i] = np.where(mask[i + 1][:, None], ahead @ move.T, 1.0)
        moves += forward[i].T @ ahead * move
    z = np.log(scale).sum() + (top[:, :, 0] * mask).sum()
    return float(z), forward * backward * mask[:, :, None], moves


def fit(sequences: list[tuple[list[list[str]], list[str]]], labels: list[str]) -> Chain:
    """Maximum likelihood with an L2 penalty, by full-batch Adam; the same rows give the same model."""
    counts: dict[str, int] = {}
    for tokens, _ in sequences:
        for t in tokens:
            for f in t:
                counts[f] = counts.get(f, 0) + 1
    features = {f: i for i, f in enumerate(sorted(f for f, c in counts.items() if c >= MIN_COUNT))}
    sequences = [s for s in sequences if s[0]]
    step_mask, first_mask = allowed(labels)
    k, n, t = len(labels), len(sequences), max((len(s[0]) for s in sequences), default=0)
    if not n:
        return Chain(labels, {}, np.zeros((0, k)), step_mask, first_mask)
    index = {x: i for i, x in enumerate(labels)}
    mask = np.array([[i < len(s[0]) for s in sequences] for i in range(t)])
    at = [(i, j, features[f]) for j, (tokens, _) in enumerate(sequences) for i, fs in enumerate(tokens) for f in fs if f in features]
    ti, sj, fi = (np.array(x) for x in zip(*at, strict=True))
    gold = np.zeros((t, n, k))
    gold_step, gold_first = np.zeros((k, k)), np.zeros(k)
    for j, (_, ys) in enumerate(sequences):
        ids = [index[y] for y in ys]
        gold[np.arange(len(ids)), j, ids] = 1
        gold_first[ids[0]] += 1
        for a, b in zip(ids, ids[1:], strict=False):
            gold_step[a, b] += 1
    cell = ti * n + sj
    order = np.argsort(cell, kind="stable")
    cells, begins = np.unique(cell[order], return_index=True)
    by_feature = np.argsort(fi, kind="stable")
    feature_ids, feature_begins = np.unique(fi[by_feature], return_index=True)
    weights = [np.zeros((len(features), k)), np.zeros((k, k)), np.zeros(k)]
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for now in range(1, STEPS + 1):
        emit = np.zeros((t * n, k))
        emit[cells] = np.add.reduceat(weights[0][fi[order]], begins, axis=0)
        _, own, moves = posteriors(emit.reshape(t, n, k), weights[1] + step_mask, weights[2] + first_mask, mask)
        over = (own - gold).reshape(t * n, k)
        grads = [np.zeros_like(weights[0]), moves - gold_step, own[0].sum(0) - gold_first]
        grads[0][feature_ids] = np.add.reduceat(over[cell[by_feature]], feature_begins, axis=0)
        for i, w in enumerate(weights):
            g = grads[i] + L2 * w
            mean[i] = 0.9 * mean[i] + 0.1 * g
            square[i] = 0.99 * square[i] + 0.01 * g * g
            w -= RATE * (1 - now / (STEPS + 1)) * (mean[i] / (1 - 0.9**now)) / (np.sqrt(square[i] / (1 - 0.99**now)) + 1e-8)
    return Chain(labels, features, weights[0], weights[1] + step_mask, weights[2] + first_mask)
