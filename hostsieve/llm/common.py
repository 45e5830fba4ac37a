"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostsieve.sources.shared import shared_dir, stored

__all__ = ["shared_dir", "stored"]

#: Rows of one Arrow batch: a batch of whole texts must fit beside the model in a Python worker.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder; Spark opens it, so that any store will do."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one text after another, and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def lowered(raw: np.ndarray) -> np.ndarray:
    """A copy with A-Z in lower case."""
    out = raw.copy()
    out[(raw >= 65) & (raw <= 90)] |= 32
    return out


def slices(offsets: np.ndarray, most: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together, a longer text alone: numpy work stays in cache and memory is bounded."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


# A multiplier for polynomial hashes modulo 2^64, odd so that it has an inverse.
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def ngrams(raw: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit polynomial hash of each run of n bytes, by doubling: about 2 log n passes."""
    if len(raw) < n:
        return np.zeros(0, np.uint64)
    power, done, width, out = raw.astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD) + np.uint64(1), 0, 1, None
    while True:
        if n & width:
            if out is None:
                out, done = power, width
            else:  # out covers `done` bytes, followed by `width` more
                m = len(raw) - done - width + 1
                out = out[:m] * np.uint64(pow(_BASE, width, 1 << 64)) + power[done : done + m]
                done += width
        if done == n:
            return out
        m = len(power) - width
        power = power[:m] * np.uint64(pow(_BASE, width, 1 << 64)) + power[width : width + m]
        width *= 2


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads hash values over all bits; works in place."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


_powers: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse."""
    if len(_powers[0]) < n:
        m = max(n, 1 << 20)
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(m, np.uint64(b & _MASK))
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each raw[start:end], the same wherever these bytes stand."""
    up, down = _tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD) * up[:-1], out=sums[1:])
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def white(raw: np.ndarray) -> np.ndarray:
    """Where the six white-space bytes 09-0D and 20 are."""
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words between white space, and the n + 1 word counts before each text; no word crosses texts."""
    ink = np.zeros(len(raw) + 2, bool)
    ink[1:-1] = ~white(raw)
    first = ink[1:] & ~ink[:-1]
    last = ink[:-1] & ~ink[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    if len(inner):
        first[inner] = ink[1:][inner]
        last[inner] = ink[:-1][inner]
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    return start, end, np.searchsorted(start, offsets)


def sample_ids(ids: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows, the same for the same rows wherever they are stored: those with the smallest hashes."""
    return ids.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(most)
