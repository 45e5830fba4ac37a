"""Packing of whole documents into training sequences: bounded-space online best fit.

Each partition keeps a fixed number of open windows. A document's tokens beyond whole windows go to the open window that
they fill best; when none has room and no more may be opened, the fullest is filled with the head of the piece and
emitted. Windows left at a partition's end are merged, and so are the last partial windows of groups of partitions.
What a group leaves is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostsieve.llm.common import stored
from hostsieve.llm.tokens import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [c.split()[0] for c in PIECES.split(", ")]
#: Partitions whose last windows are merged together.
MERGED = 256

Piece = tuple[int | None, int, bytes, int]  # document, tokens of it before, ids, tokens of it in all


class Packer:
    """Places pieces into windows of `size` tokens, at most `most` of them open; `emitted` holds the rows of full ones."""

    def __init__(self, size: int, most: int, first: int):
        self.size, self.most, self.next = size, most, first
        self.open: list[tuple[int, list[Piece]]] = []
        self.emitted: list[tuple] = []

    def emit(self, pieces: list[Piece]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.emitted.append((doc, start, n, zlib.crc32(ids), total, self.next, at))
            at += n
        self.next += 1

    def place(self, piece: Piece) -> None:
        doc, start, ids, total = piece
        while len(ids) // 4 >= self.size:
            self.emit([(doc, start, ids[: 4 * self.size], total)])
            start, ids = start + self.size, ids[4 * self.size :]
        while ids:
            n = len(ids) // 4
            room = [(self.size - used, k) for k, (used, _) in enumerate(self.open) if self.size - used >= n]
            if room:
                _, k = min(room)
            elif len(self.open) < self.most:
                self.open.append((0, []))
                k = len(self.open) - 1
            else:
                k = max(range(len(self.open)), key=lambda i: self.open[i][0])
                n = self.size - self.open[k][0]  # cut to fill the fullest
            used, pieces = self.open[k]
            pieces.append((doc, start, ids[: 4 * n], total))
            start, ids = start + n, ids[4 * n :]
            if used + n == self.size:
                self.emit(pieces)
                self.open[k] = self.open[-1]
                self.open.pop()
            else:
                self.open[k] = (used + n, pieces)

    def merge(self) -> list[Piece]:
        """Fills windows one after another with what is open; the pieces of the last, partial one are returned."""
        left = [p for _, pieces in sorted(self.open, key=lambda w: -w[0]) for p in pieces]
        self.open, self.most = [], 1
        for p in left:
            self.place(p)
        return [p for _, pieces in self.open for p in pieces]

    def finish(self, pieces: list[Piece]) -> None:
        """Emits the last pieces in sequences whose lengths are powers of two, the longest first."""
        left = sum(len(p[2]) // 4 for p in pieces)
        for power in reversed(range(left.bit_length())):
            want, now = left & (1 << power), []
            while want:
                doc, start, ids, total = pieces.pop(0)
                n = min(want, len(ids) // 4)
                now.append((doc, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    pieces.insert(0, (doc, start + n, ids[4 * n :], total))
                want -= n
            if now:
                self.emit(now)


def pack(documents: DataFrame, tokenizer: str, end: int = 1, size: int = 2048, open_windows: int = 32, plain: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer: path of the vocabulary file on every machine. plain: added tokens of the vocabulary, such as its end mark,
    are ordinary text where a document holds them. `end` follows each document's ids. Reads only doc_id and
    text, so extra columns and their names do not matter. Null and empty texts are one piece, the id `end`. A null
    doc_id stays null; repeated rows are packed each for itself, as separate documents with equal ids. Very long texts
    are cut into whole windows. An empty table gives an empty result. The only padding that the result asks for is none:
    sequences hold `size` tokens or a power of two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode, packer = encoder(tokenizer, plain), Packer(size, open_windows, part << 32)
        for batch in batches:
            for doc, ids in zip(batch["doc_id"].to_pylist(), encode.many(batch["text"].to_pylist(), end), strict=True):
                packer.place((doc, 0, ids, len(ids) // 4))
                if len(packer.emitted) >= 5000:
                    yield rows(packer.emitted, part)
                    packer.emitted = []
        left = packer.merge()
        yield rows(packer.emitted, part)
        yield rows([(d, s, len(i) // 4, 0, t, None, k) for k, (d, s, i, t) in enumerate(left)], part, [i for _, _, i, _ in left])

    def rows(out: list[tuple], part: int, ids: list[bytes] | None = None) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * len(NAMES)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns] + [pa.array([part] * len(out), pa.int64()), pa.array(ids or [None] * len(out), pa.binary())],
            [*NAMES, "part", "ids"],
        )

    def merged(key: tuple, rest: pd.DataFrame) -> pd.DataFrame:
        packer = Packer(size, 1, (1 << 61) + (int(key[0]) << 32))
        for r in rest.sort_values(["part", "offset"]).itertuples():
            packer.place((None if pd.isna(r.doc_id) else int(r.doc_id), int(r.start), r.ids, int(r.doc_tokens)))
        packer.finish(packer.merge())
        out = pd.DataFrame(packer.emitted, columns=NAMES)
        return out.astype({c: "Int64" for c in NAMES})

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    placed = stored(texts.mapInArrow(run, f"{PIECES}, part long, ids binary"))
    last = placed.where(F.col("sequence_id").isNull())  # less than a window from each partition
    last = last.groupBy(F.floor(F.col("part") / MERGED).alias("group")).applyInPandas(merged, PIECES)
    return placed.where(F.col("sequence_id").isNotNull()).select(*NAMES).unionByName(last)
