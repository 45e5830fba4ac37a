"""Embedding whitening by shifted CholeskyQR.

The centred rows are made orthonormal by passes over the data: each takes the rows through triangular solves with the
factors so far, sums their Gram matrix over all partitions, and adds its Cholesky factor. The first Gram matrix gets a
shift, so that it has a factor even where the data are badly conditioned; later passes repair what the shift left. The
product of the factors is the R of the centred rows, and its SVD gives components and variances.

Every entry c becomes the integer floor(scale * c) + offset, so sums are exact and centring loses nothing: a centred entry
is (n * x - S) / n with an exact numerator. Matrices are as wide as a vector is long, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partial sums that one task adds up.
FAN_IN = 64
#: Rows that are solved together.
BLOCK = 1024
RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
NAMES = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def usable(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and x (array of double) of the rows whose vector is neither null nor holds null or non-finite entries."""
    entry = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    return rows.where(F.col("x").isNotNull() & ~F.exists("x", entry))


def blocks(batches: Iterator[pa.RecordBatch], d: int, scale: int, offset: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of at most BLOCK rows with their integers, a row each."""
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(at, BLOCK)
            c = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)
            yield batch, np.floor(scale * c).astype(np.int64) + offset


def total(rows: DataFrame, of: Callable[[Iterator[pa.RecordBatch]], np.ndarray], kind=np.float64) -> np.ndarray:
    """The sum over all partitions of what `of` makes of a partition's batches, FAN_IN partial sums a task."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([of(batches).astype(kind).tobytes()], pa.binary())], ["part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for part in batch["part"]:
                own = np.frombuffer(part.as_py(), kind)
                out = own.copy() if out is None else out + own
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["part"])

    parts, sums = rows.rdd.getNumPartitions(), rows.mapInArrow(first, "part binary")
    while parts > 1:
        parts = math.ceil(parts / FAN_IN)
        sums = sums.repartition(parts).mapInArrow(add, "part binary")
    got = sums.collect()  # one row, as large as one matrix
    return np.frombuffer(got[0].part, kind) if got else np.zeros(0, kind)


def solved(y: np.ndarray, r: np.ndarray) -> np.ndarray:
    """In place: the columns of y by the triangular solve r' z = y, so that rows come out as rows times the inverse of r."""
    for j in range(len(r)):
        if j:
            y[j] -= r[:j, j] @ y[:j]
        y[j] /= r[j, j]
    return y


def cholesky(gram: np.ndarray) -> np.ndarray | None:
    """The upper factor, None where there is none in double precision."""
    try:
        return np.linalg.cholesky(gram).T
    except np.linalg.LinAlgError:
        return None


@dataclass
class Whitening:
    """What whitens a row: the number of rows, exact sums, components (a column each) with variances, all rows' variance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float
    passes: int = 0
    scale: int = 64
    offset: int = 1_000_000

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        return self.n * x - self.sums

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (self.numerators(x) / self.n) @ (self.components / np.sqrt(self.variances))


def squares(x: np.ndarray) -> pa.Array:
    """The exact sum of squares of each row of integers, as decimal(38, 0); a sum with more digits is an error.

    Sums wrap modulo 2^64, so one below 2^63 is right even where a part of it wrapped; the others are made of Python's integers.
    """
    wrapped = (x**2).sum(1)
    beyond = ((x.astype(float) ** 2).sum(1) > 1.5 * 2.0**63) | (wrapped < 0)
    kind = pa.decimal128(38, 0)
    if not beyond.any():
        return pa.array(wrapped).cast(kind)
    out = wrapped.astype(object)
    out[beyond] = (x[beyond].astype(object) ** 2).sum(1)
    return pa.array([Decimal(v) for v in out], kind)


def fit(rows: DataFrame, components: int = 32, scale: int = 64, offset: int = 1_000_000, most_passes: int = 8, close: float = 1e-12) -> Whitening | None:
    """Fits on all rows (vec_id, x: arrays of one length); None for an empty table.

    Components with no variance beyond rounding, of which whitening can't be told, are left out.
    """
    d = rows.select(F.size("x").alias("d")).limit(1).collect()
    if not d or not d[0].d:
        return None
    d = d[0].d

    def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(d + 1, np.int64)
        for _, x in blocks(batches, d, scale, offset):
            out[:d] += x.sum(0)
            out[d] += len(x)
        return out

    got = total(rows, sums, np.int64)
    n, s = int(got[d]), got[:d]
    factors: list[np.ndarray] = []

    def gram(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((d, d))
        for _, x in blocks(batches, d, scale, offset):
            y = np.ascontiguousarray(((n * x - s) / n).T)
            for r in factors:
                y = solved(y, r)
            out += y @ y.T
        return out.ravel()

    product, g = np.eye(d), np.eye(d)
    for k in range(most_passes):
        g = total(rows, gram).reshape(d, d)
        g = (g + g.T) / 2
        if k and np.abs(g - np.eye(d)).max() < close * math.sqrt(d):
            break
        shift = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps * max(float(np.linalg.norm(g, 2)), np.finfo(float).tiny)
        r = cholesky(g + min(shift, float(np.trace(g)) / d) * np.eye(d)) if not k else cholesky(g)
        while r is None or not np.isfinite(r).all() or np.diag(r).min() <= 0:  # dependent columns stay so: shifted again
            r, shift = cholesky(g + shift * np.eye(d)), shift * 10
        factors.append(r)
        product = r @ product
    else:  # columns that depend on others have no length; what is left of it stands in the last Gram matrix
        g = total(rows, gram).reshape(d, d)
    values, turn = np.linalg.eigh((g + g.T) / 2)
    root = np.sqrt(np.maximum(values, 0))[:, None] * turn.T  # near the identity where all columns are independent
    _, sigma, vt = np.linalg.svd(root @ product)
    keep = sigma > sigma[0] * d * 10 * np.finfo(float).eps if sigma[0] > 0 else np.zeros(d, bool)
    keep &= np.arange(d) < components
    variances = sigma**2 / n
    return Whitening(n, s, vt[keep].T.copy(), variances[keep], float(variances.sum()), len(factors) + 1, scale, offset)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity, measured over all rows."""
    d, k = model.components.shape

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((k + 1, k))
        for _, x in blocks(batches, d, model.scale, model.offset):
            w = model(x)
            out[:k] += w.T @ w
            out[k] += w.sum(0)
        return out.ravel()

    if not k:
        return 0.0
    got = total(rows, moments).reshape(k + 1, k) / model.n
    return float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())


def same_length(rows: DataFrame) -> DataFrame:
    """The rows of the commonest length, of the longer one in a tie; others can't stand in one matrix."""
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("x") == (length[0].d if length else 0))


def whiten(embeddings: DataFrame, vector: str = "embedding", components: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each usable row and component.

    Rows whose vector is null or holds null or non-finite entries take no part, nor do those whose length isn't the
    commonest one. Repeated rows count as often as they occur and give repeated results; a null vec_id is kept. Components
    are in falling order of variance, at most `components`, and only those with variance: equal rows, a single row and an
    empty table give no rows at all. deviation, the sum of (n * x - S)^2 over dimensions, is exact also beyond a long. Reads only vec_id and the vector, so other columns don't matter.
    """
    rows = same_length(usable(embeddings, vector))
    model = fit(rows, components)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], RESULT)
    error, (d, k) = identity_error(rows, model), model.components.shape
    explained = model.variances / model.trace if model.trace else model.variances

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in blocks(batches, d, model.scale, model.offset):
            m = len(x)
            each = np.repeat(np.arange(m), k)
            deviation = squares(model.numerators(x))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["vec_id"].take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)),
                    deviation.take(pa.array(each)),
                    pa.array(model(x).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                NAMES,
            )

    return rows.mapInArrow(run, RESULT)
