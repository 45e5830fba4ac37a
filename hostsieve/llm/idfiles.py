"""Token ids in binary files: fixed-width bit packing.

A file holds the ids of consecutive documents. Each id takes the fewest bits that the vocabulary needs. Ids stand in
blocks of a fixed number, each block starting at a byte whose offset the file's tail lists, so that any block can be
unpacked alone, by numpy. Layout, all numbers little-endian:

    blocks | doc_id int64 x docs | id known uint8 x docs | tokens int64 x docs | block offset int64 x blocks |
    docs int64, blocks int64, ids int64, ids per block int64, bits int64, b"IDPACK01"
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hostsieve.llm.common import shared_dir, stored
from hostsieve.llm.tokens import encoder

MAGIC, BLOCK, TAIL = b"IDPACK01", 8192, "<5q8s"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold the ids 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """The ids in `bits` bits each, the highest bit first, without gaps; the last byte is filled with zeros.

    An id that needs more bits is an error.
    """
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {ids.max()} needs more than {bits} bits")
    if bits == 16:
        return ids.astype(">u2").tobytes()
    wide = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(wide[:, 32 - bits :]).tobytes()


def unpack_bits(raw: bytes, bits: int, count: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(raw, ">u2", count).astype("<u4")
    flat = np.unpackbits(np.frombuffer(raw, np.uint8), count=bits * count).reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, 32 - bits :] = flat
    return np.packbits(wide, axis=1).view(">u4").ravel().astype("<u4")


class IdFile:
    """Reads one file: documents in order, or single ones at random."""

    def __init__(self, path: str):
        fs, name = FileSystem.from_uri(path)
        self.file = fs.open_input_file(name)
        size = self.file.size()
        docs, blocks, self.ids, self.block, self.bits, magic = struct.unpack(TAIL, self.file.read_at(48, size - 48))
        if magic != MAGIC:
            raise ValueError(f"{path} is no file of packed ids")
        at = size - 48 - 17 * docs - 8 * blocks
        tail = self.file.read_at(size - 48 - at, at)
        known = np.frombuffer(tail, np.uint8, docs, 8 * docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(np.frombuffer(tail, "<i8", docs), known, strict=True)]
        self.tokens = np.frombuffer(tail, "<i8", docs, 9 * docs)
        self.offsets = np.append(np.frombuffer(tail, "<i8", blocks, 17 * docs), at)
        self.starts = np.concatenate(([0], np.cumsum(self.tokens)))

    def read(self, start: int, count: int) -> np.ndarray:
        """`count` ids from the given place of the file; only the blocks that hold them are read."""
        if not count:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (start + count - 1) // self.block
        a, b = int(self.offsets[first]), int(self.offsets[last + 1])
        raw, out = self.file.read_at(b - a, a), []
        for k in range(first, last + 1):
            n = min(self.block, self.ids - k * self.block)
            out.append(unpack_bits(raw[int(self.offsets[k]) - a : int(self.offsets[k + 1]) - a], self.bits, n))
        return np.concatenate(out)[start - first * self.block :][:count]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.starts[k]), int(self.tokens[k]))


def write_ids(documents: DataFrame, tokenizer: str, vocabulary: int, end: int = 2, rows_per_file: int = 4000, plain: bool = False) -> DataFrame:
    """Encodes every whole text, with the id `end` after it, into files in ascending doc_id order; returns their list.

    The list, itself a written table, has a row for each file: part, file, docs, ids. A task writes a file of a name of
    its own and only the files of successful tasks are listed, so that a task that runs twice does no harm. Null texts
    count as empty; null doc_ids come first; rows with equal doc_id follow each other by a hash of their text, and may
    go to several files. plain: added tokens of the vocabulary, such as its end mark, are ordinary text in a document.
    """
    folder, bits = shared_dir(documents.sparkSession), bits_for(vocabulary)
    files = max(1, -(-documents.count() // rows_per_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), encoder(tokenizer, plain)
        path = f"{folder}/{part:06d}-{uuid.uuid4().hex}.ids"
        fs, name = FileSystem.from_uri(path)
        fs.create_dir(name.rpartition("/")[0], recursive=True)
        ids_of, lengths, offsets, rest, total, at = [], [], [], b"", 0, 0
        with fs.open_output_stream(name) as out:
            for batch in batches:
                ids_of += batch["doc_id"].to_pylist()
                held = [rest]
                for ids in encode.many(batch["text"].to_pylist(), end):
                    held.append(ids)
                    lengths.append(len(ids) // 4)
                rest = b"".join(held)
                whole = len(rest) // (4 * BLOCK) * 4 * BLOCK
                for k in range(0, whole, 4 * BLOCK):
                    offsets.append(at)
                    at += out.write(pack_bits(np.frombuffer(rest, "<u4", BLOCK, k), bits))
                rest, total = rest[whole:], total + whole // 4
            if rest:
                offsets.append(at)
                out.write(pack_bits(np.frombuffer(rest, "<u4"), bits))
                total += len(rest) // 4
            if ids_of:
                out.write(np.array([d or 0 for d in ids_of], "<i8").tobytes())
                out.write(np.array([d is not None for d in ids_of], np.uint8).tobytes())
                out.write(np.array(lengths, "<i8").tobytes() + np.array(offsets, "<i8").tobytes())
                out.write(struct.pack(TAIL, len(ids_of), len(offsets), total, BLOCK, bits, MAGIC))
        if ids_of:
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [path], "docs": [len(ids_of)], "ids": [total]})

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    place = ["doc_id", F.xxhash64("text")]
    ordered = texts.repartitionByRange(files, *place).sortWithinPartitions(*place, "text")
    return stored(ordered.mapInArrow(run, "part long, file string, docs long, ids long"))


def read_ids(listed: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 for each document of the listed files, as read back from them.

    start counts the ids of all documents before it: a running sum over the list, which has a row for each file, by groups
    of files and within them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch["file"].to_pylist(), batch["before"].to_pylist(), strict=True):
                source = IdFile(path)
                for i in range(0, len(source.doc_ids), 500):
                    j = min(i + 500, len(source.doc_ids))
                    ids = source.read(int(source.starts[i]), int(source.starts[j] - source.starts[i])).tobytes()
                    cut = (source.starts[i : j + 1] - source.starts[i]) * 4
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(source.doc_ids[i:j], pa.int64()),
                            pa.array(source.starts[i:j] + before),
                            pa.array(source.tokens[i:j]),
                            pa.array([zlib.crc32(ids[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    group, inside = F.floor(F.col("part") / 1000), W.partitionBy("group").orderBy("part")
    files = listed.withColumn("group", group)
    sums = files.groupBy("group").agg(F.sum("ids").alias("all"))  # a row for each thousand files
    sums = sums.select("group", F.coalesce(F.sum("all").over(W.orderBy("group").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    own = F.coalesce(F.sum("ids").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = files.join(sums, "group").select("part", "file", (F.col("first") + own).alias("before"))
    tasks = max(1, min(listed.count(), listed.sparkSession.sparkContext.defaultParallelism * 4))
    return starts.repartition(tasks, "part").mapInArrow(run, ROWS)
