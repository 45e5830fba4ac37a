"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

A text's features are its hashed byte n-grams in lower case, each with the number of times that it occurs, up to
MOST: beyond that, more of the same says nothing new. Feature j gets the ratio r_j = log of its smoothed share among the
n-grams of toxic texts over that among the others'; logistic regression is then trained on the scaled features r_j * x_j.
Both steps use a bounded sample of labelled texts; scoring adds r_j * w_j * x_j over the n-grams of a whole text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from hostsieve.llm.common import lowered, mixed, ngrams, slices
from hostsieve.llm.linear import fold, labelled_sample, score_texts, sigmoid

BITS, GRAMS, MOST = 20, (4, 6, 8), 8


def features(raw: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, row and count of each distinct feature, in order of texts; `wanted` says of each row whether it is asked for.

    N-grams of different lengths share the table. None crosses texts.
    """
    low, shift, keys = lowered(raw), np.uint64(64 - BITS), []
    for n in GRAMS:
        rows = (mixed(ngrams(low, n) + np.uint64(n)) >> shift).astype(np.int64)
        text = np.searchsorted(offsets, np.arange(len(rows)), "right") - 1
        inside = np.arange(len(rows)) + n <= offsets[text + 1]
        if wanted is not None:
            inside &= wanted[rows]
        keys.append((text[inside] << BITS) | rows[inside])
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), np.minimum(count, MOST)


class LogRatios:
    """The fitted model: one weight for each row, and a bias."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias, self.wanted = weight, bias, weight != 0

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        text, row, count = features(raw, offsets, self.wanted)
        return sigmoid(np.bincount(text, self.weight[row] * count, len(offsets) - 1) + self.bias)


def fit(
    raw: np.ndarray,
    offsets: np.ndarray,
    label: np.ndarray,
    smooth: float = 1.0,
    least: float = 0.5,
    epochs: int = 10,
    rate: float = 0.02,
    decay: float = 2e-4,
    gain: float = 1.5,
    seed: int = 7,
) -> LogRatios:
    """Trains on the given texts. gain: how much more a step towards a toxic text counts, as these are rarer."""
    size = 1 << BITS
    if not len(label) or len(set(label)) < 2:
        return LogRatios(np.zeros(size, np.float32), 0.0)
    texts = []
    for i, j in slices(offsets, 1 << 18):
        text, row, count = features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        cut = np.searchsorted(text, np.arange(j - i + 1))
        texts += [(row[a:b].astype(np.int32), count[a:b].astype(np.uint8)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    counts, seen = np.full((2, size), smooth), np.zeros(size, np.int64)
    for (row, x), y in zip(texts, label.astype(int), strict=True):
        counts[y, row] += x
        seen[row] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratio[(seen < 3) | (np.abs(ratio) <= least)] = 0  # rows of one or two texts tell nothing about others
    texts = [(row[some], (ratio[row] * x)[some]) for row, x in texts for some in (ratio[row] != 0,)]
    rng, weight, bias, step, steps = np.random.default_rng(seed), np.zeros(size), 0.0, 0, epochs * len(texts)
    for _ in range(epochs):
        for t in rng.permutation(len(texts)):
            row, x = texts[t]
            norm = max(1.0, float(x @ x)) ** 0.5
            p = 1 / (1 + np.exp(-np.clip(x @ weight[row] + bias, -40, 40)))
            eta = rate * (1 - step / steps)
            g = (p - label[t]) * (gain if label[t] else 1.0)
            weight[row] -= eta * (g * x * 4 / norm + decay * weight[row])
            bias -= eta * g
            step += 1
    return LogRatios((weight * ratio).astype(np.float32), float(bias))


def score_toxicity(
    documents: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 3, held_out_fold: int = 1, sample: int = 4000, sample_bytes: int = 12 << 20
) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted for each row of documents.

    Reads only doc_id and text of documents, and doc_id and toxic of labels; other columns, whatever their names, do not
    matter. Learns from rows that are not held out: crc32(doc_id) mod `folds` differs from `held_out_fold`. `sample`
    bounds the number of labelled texts, half of each label where there are enough, and `sample_bytes` their bytes
    together; every text is scored whole. Null and empty texts, and texts under four bytes, have no features and get the
    bias's score. Repeated rows give repeated results. With no usable label the score is 0.5 for all. An empty table
    gives an empty result.
    """
    usable = lambda i: fold(i, folds) != held_out_fold
    model = fit(*labelled_sample(documents, labels, "toxic", usable, sample, sample_bytes))
    return score_texts(documents, model, lambda i: fold(i, folds) == held_out_fold, threshold)
