"""Quality classifier: supervised subword embeddings.

Each word, each character trigram and each character 4-gram of a text is hashed to a row of a table of learned vectors.
A document is the mean of its rows; a softmax layer over two classes gives the score. Vectors and layer are trained
together by stochastic gradient descent in numpy on a bounded sample of labelled texts. As the layer is linear in the
mean, scoring needs one number per hashed row: the row's dot product with the difference of the two class vectors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostsieve.llm.common import mixed, ngrams, slices, span_hashes, words
from hostsieve.llm.linear import fold, keep_texts, labelled_sample, score_texts, sigmoid

BITS, GRAMS = 16, (3, 4)


def features(raw: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per kind of feature: the hashed rows in text order, and the range of each text among them."""
    out, shift = [], np.uint64(64 - bits)
    start, end, at = words(raw, offsets)
    out.append(((span_hashes(raw, start, end) >> shift).astype(np.int64), at[:-1], at[1:]))
    for n in GRAMS:
        rows = (mixed(ngrams(raw, n)) >> shift).astype(np.int64)
        first = np.minimum(offsets[:-1], len(rows))
        out.append((rows, first, np.maximum(first, np.minimum(offsets[1:] - n + 1, len(rows)))))
    return out


class Embeddings:
    """The fitted model, as the numbers that scoring needs."""

    def __init__(self, gain: np.ndarray, bias: float):
        self.gain, self.bias = gain, bias

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
        for rows, first, last in features(raw, offsets):
            sums = np.concatenate(([0.0], np.cumsum(self.gain[rows], dtype=float)))
            total += sums[last] - sums[first]
            count += last - first
        return sigmoid(total / np.maximum(count, 1) + self.bias)


def fit(
    raw: np.ndarray, offsets: np.ndarray, label: np.ndarray, prior: float, dim: int = 8, epochs: int = 4, rate: float = 1.0, seed: int = 7
) -> Embeddings:
    """Trains on the given texts. prior: the share of label 1 that an empty text gets as its score."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim))
    layer, bias = np.zeros((dim, 2)), np.zeros(2)
    if len(label) and len(set(label)) == 2:
        texts = []
        for i, j in slices(offsets):
            kinds = features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            for k in range(j - i):
                rows, counts = np.unique(np.concatenate([r[a[k] : b[k]] for r, a, b in kinds]), return_counts=True)
                texts.append((rows.astype(np.int32), counts.astype(np.min_scalar_type(counts.max(initial=0)))))  # five bytes each, mostly
        step, steps = 0, epochs * len(texts)
        for _ in range(epochs):
            for t in rng.permutation(len(texts)):
                rows, counts = texts[t]
                weight = (counts / max(1, counts.sum()))[:, None]
                mean = (table[rows] * weight).sum(0)
                z = mean @ layer + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[int(label[t])] -= 1  # the gradient at the softmax's input
                eta = rate * (1 - step / steps)
                table[rows] -= (eta * 20) * weight * (layer @ p)
                layer -= eta * np.outer(mean, p)
                bias -= 0.1 * eta * p
                step += 1
    shift = np.log(max(prior, 1e-3) / max(1 - prior, 1e-3)) if 0 < prior < 1 else 0.0
    return Embeddings((table @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0] + 0.5 * shift))


def score_quality(
    documents: DataFrame,
    labels: DataFrame,
    threshold: float = 0.3,
    folds: int = 5,
    held_out_fold: int = 0,
    sample: int = 3000,
    sample_bytes: int = 12 << 20,
) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted for each row of documents.

    Reads only doc_id and text of documents, and doc_id and quality of labels; other columns, whatever their names, do
    not matter. Learns from rows that are not held out: crc32(doc_id) mod `folds` differs from `held_out_fold`. `sample`
    bounds the number of labelled texts and `sample_bytes` their bytes together; every text is scored whole. Null and empty texts have no
    features and get the model's bias as their score. Repeated rows give repeated results. With no usable label the
    score is 0.5 for all. An empty table gives an empty result.
    """
    model = train(documents, labels, folds, held_out_fold, sample, sample_bytes)
    return score_texts(documents, model, lambda i: fold(i, folds) == held_out_fold, threshold)


def train(documents: DataFrame, labels: DataFrame, folds: int = 5, held_out_fold: int = 0, sample: int = 3000, sample_bytes: int = 12 << 20) -> Embeddings:
    usable = lambda i: fold(i, folds) != held_out_fold
    raw, offsets, label = labelled_sample(documents, labels, "quality", usable, sample, sample_bytes)
    known = labels.where(usable(F.col("doc_id")) & F.col("quality").isin(0, 1)).agg(F.avg("quality")).first()[0]
    return fit(raw, offsets, label, 0.5 if known is None else float(known))


def keep_quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of documents, all columns as they are, that score_quality predicts as 1.

    Null and empty texts stay or go by the score of the model's bias; repeated rows stay or go alike; an empty table
    gives an empty one. Without usable labels every score is 0.5, and all rows stay.
    """
    return keep_texts(documents, train(documents, labels), threshold)
