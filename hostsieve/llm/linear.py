"""What the two trained document classifiers share: the labelled sample and the scoring pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostsieve.llm.common import sample_ids, slices, stored, utf8

SCORED = "doc_id long, held_out boolean, score double, predicted int"


def fold(doc_id, folds: int):
    """crc32 of the id as text, modulo `folds`; null counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, usable, most: int, most_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and labels of at most `most` labelled texts of at most `most_bytes` bytes together, from rows that `usable` allows.

    Only the sample is bounded, never the rows that are scored. Half of it goes to each label as far as there are
    enough rows, those with the smallest hashes of doc_id first; of their texts, texts_of() takes what fits into the bytes.
    A document with several label rows counts once, with the largest label, and one with several texts with the
    smallest; null labels and ids are left out.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("__label"))
        .where(F.col("doc_id").isNotNull() & F.col("__label").isin(0, 1) & usable(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("__label").alias("__label"))
    )
    halves = [sample_ids(known.where(F.col("__label") == k), "doc_id", most // 2) for k in (0, 1)]
    got = texts_of(documents, halves[0].unionByName(halves[1]), most_bytes)
    if not got.num_rows:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0)
    raw, offsets = utf8(got["text"])
    return raw, offsets, got["__label"].to_numpy().astype(float)


def chosen_sizes(sizes: list[tuple[int, int, int]], most_bytes: int, long: int) -> list[int]:
    """Which of the texts (id, hash, bytes) of one label fit into the bytes: those of at most `long` bytes in order of
    hash, then the longer ones, shortest first. One that does not fit is passed over, and the first is always taken."""
    out, left = [], most_bytes
    for key, _, n in sorted(sizes, key=lambda x: (x[2] > long, x[2] if x[2] > long else 0, x[1])):
        if n <= left or not out:
            out.append(key)
            left -= n
    return out


def texts_of(documents: DataFrame, chosen: DataFrame, most_bytes: int) -> pa.Table:
    """doc_id, __label and text of chosen documents (doc_id, __label; few rows) of at most `most_bytes` bytes together.

    Each label has an equal share of the bytes, and chosen_sizes() fills it; texts beyond a sixteenth of a share come
    last, so no single text keeps others out. Of a document with several texts, the smallest counts.
    """
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = stored(texts.groupBy("doc_id", "__label").agg(F.min("text").alias("text")))
    by: dict[int, list[tuple[int, int, int]]] = {}
    for r in texts.select("doc_id", "__label", F.xxhash64("doc_id").alias("h"), F.octet_length("text").alias("n")).collect():
        by.setdefault(r["__label"], []).append((r.doc_id, r.h, r.n))
    share = most_bytes // max(1, len(by))
    keys = [key for own in by.values() for key in chosen_sizes(own, share, share // 16)]
    some = documents.sparkSession.createDataFrame([(k,) for k in keys], texts.select("doc_id").schema)
    return texts.join(F.broadcast(some), "doc_id").select("doc_id", "__label", "text").toArrow().sort_by("doc_id")


def score_texts(
    documents: DataFrame,
    scorer: Callable[[np.ndarray, np.ndarray], np.ndarray],
    held_out,
    threshold: float,
) -> DataFrame:
    """doc_id, held_out, score and predicted for each row; scorer maps the bytes and offsets of some texts to their scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch["text"])
            score = np.zeros(batch.num_rows)
            for i, j in slices(offsets):
                score[i:j] = scorer(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            predicted = (score >= threshold).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(score), pa.array(predicted)], ["doc_id", "held_out", "score", "predicted"]
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(run, SCORED)


def keep_texts(documents: DataFrame, scorer: Callable[[np.ndarray, np.ndarray], np.ndarray], least: float) -> DataFrame:
    """The rows of documents, all columns as they are, whose text scores at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch["text"])
            score = np.zeros(batch.num_rows)
            for i, j in slices(offsets):
                score[i:j] = scorer(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield batch.filter(pa.array(score >= least))

    return documents.mapInArrow(run, documents.schema)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
