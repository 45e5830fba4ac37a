"""Similarity self-join of documents on their sets of word n-grams, by Jaccard similarity; exact.

Signature trees join groups of candidates; the candidates come of a prefix filter, as one tree over all documents would be
one task. That is a departure from trees alone, without loss.

1. Each document's set is hashed to sorted 64-bit numbers; documents with equal sets are one node from there on.
2. Candidates by rare n-grams: fixed counters tell roughly which n-grams many documents hold and how frequent words are,
   which puts all n-grams in one order. Similar sets share an n-gram among the rarest of both, at a place that bounds the
   other's size. Any order is exact; a passage of many documents comes late in it and alone brings no candidates. The more
   text, the more counters of n-grams, up to a bound, as what rare ones together put on a counter hides frequent ones;
   words need no more, as a word's share of the text does not depend on how much text there is.
   Of an n-gram with few sets, each pair within reach is held against bitmaps of both sets, so that a passage which two
   documents share doesn't tie them together. Those of a frequent one are chained, first in each map task, so that it
   sends little.
3. Groups of candidates, the components of these chains, are joined with signature trees: a node holds the OR of its
   documents' token bitmaps, the fewest bits among them, and their range of sizes. A dual traversal drops a pair of nodes
   if the largest overlap that bits and sizes allow is too small, or all its documents are linked already; pairs of
   documents that are left are compared exactly.
4. A large group is cut into blocks, each joined alone with a few documents of the whole group. If links do not connect
   all of it, the documents outside its largest class are cut into blocks of their own, which meet each other and the
   blocks of that class; two blocks of the class need not meet, as all of it is linked already.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostsieve.llm.common import lowered, mixed, slices, span_hashes, stored, utf8, words
from hostsieve.llm.components import components

#: Sets of an n-gram whose pairs are looked at one by one; more are chained.
FEW = 32
#: Parts of a bucket's n-grams that are looked at one after another.
PARTS = 8
#: Documents of a block, shared documents of a large group's blocks, and entries that a map task holds.
BLOCK, PIVOTS, HELD = 1000, 8, 1 << 19
BITMAP_WORDS, LEAF, FANOUT = 32, 16, 8
#: Counters of words and the least and most of n-grams, as powers of two, bytes of text for a counter of n-grams, and the
#: rows that the counters of either are sent in.
WORD_BITS, GRAM_BITS, CELL_TEXT, CELL_ROWS = 20, (20, 24), 384, 64
_STEP = np.uint64(0x9E3779B97F4A7C15)


def slices_of(raw: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For some texts at a time: hashes of the words and of each n words in a row, and the word counts before each text."""
    for i, j in slices(offsets, 1 << 18):
        low, off = lowered(raw[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i]
        start, end, at = words(low, off)
        word = span_hashes(low, start, end)
        grams = np.zeros(max(0, len(word) - n + 1), np.uint64)
        for k in range(n):
            grams = grams * _STEP + word[k : k + len(grams)]
        yield word, mixed(grams), at


def sets_of(word: np.ndarray, grams: np.ndarray, at: np.ndarray, n: int, common: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Each text's set, and with levels of words the sum of its words' levels for each n-gram."""
    if common is not None:
        total = np.concatenate(([0], np.cumsum(common[cells(word, WORD_BITS)], dtype=np.int64)))
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= n and common is not None:
            own, first = np.unique(grams[a : b - n + 1], return_index=True)
            yield own, (total[a + n : b + 1] - total[a : b - n + 1])[first]
        elif b - a >= n:
            yield np.unique(grams[a : b - n + 1]), None
        elif b > a:
            short = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                short = short * _STEP + word[k : k + 1]
            yield mixed(short), np.zeros(1, np.int64)
        else:
            yield np.zeros(0, np.uint64), np.zeros(0, np.int64)


def ngram_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Each text's distinct n-grams of words as sorted hashes; fewer words count as one n-gram, none as the empty set."""
    for part in slices_of(raw, offsets, n):
        for grams, _ in sets_of(*part, n):
            yield grams


def gram_bits(text: int) -> int:
    """The power of two of the counters of n-grams for so many bytes of text."""
    return min(max((text // CELL_TEXT).bit_length(), GRAM_BITS[0]), GRAM_BITS[1])


def cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The counter of each n-gram or word; a set is sorted, and so are its counters."""
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def gram_levels(count: np.ndarray) -> np.ndarray:
    """Rough logarithms of how many documents hold the n-grams of a counter, and 0 where that can't be told.

    Most n-grams are rare, so the median is what rare ones together put on a counter; what doesn't stand out from it is rare.
    """
    rare = np.median(count)
    over = count - rare
    return np.where(over > 3 * np.sqrt(rare), 2 * np.log2(np.maximum(over, 1)), 0).astype(np.uint8)


def word_levels(count: np.ndarray) -> np.ndarray:
    """Rough logarithms of how often the words of a counter stand in the texts."""
    return (4 * np.log2(np.maximum(count, 1))).astype(np.uint8)


def squeezed(count: np.ndarray) -> bytes:
    """Counts as bytes, the lowest of each first."""
    return zlib.compress(count.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unsqueezed(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def prefix(grams: np.ndarray, rank: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The rarest n-grams of a set that a similar set may share first, and the largest size of such a set for each.

    A rank belongs to an n-gram wherever it stands; of equal ranks the smaller n-gram is first. If the first common n-gram
    of two sets has p rarer ones before it in a set of size x, they share at most x - p; so it can be that of a similar set
    of size y only if 100 + percent times x - p reaches percent * (x + y).
    """
    x = len(grams)
    p = np.arange(x - (percent * x + 99) // 100 + 1)
    return grams[np.argsort(rank, kind="stable")[: len(p)]], (100 + percent) * (x - p) // percent - x


def segments(gram: np.ndarray, low: np.ndarray, high: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unites entries of an n-gram while the least size of the next is within reach of those before.

    Gives gram, low, high and the smallest key of each segment, and pairs of the smallest key with others. Entries within
    each other's reach are chained by these pairs, also where they come in parts whose segments a later call unites.
    """
    if not len(gram):
        return gram, low, high, key, np.zeros((0, 2), np.int64)
    order = np.lexsort((low, gram))
    gram, low, high, key = gram[order], low[order], high[order], key[order]
    fresh = np.concatenate(([True], gram[1:] != gram[:-1]))
    lift = np.cumsum(fresh) << 34
    reach = np.maximum.accumulate(high + lift)
    fresh[1:] |= low[1:] + lift[1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    least = np.minimum.reduceat(key, at)
    root = np.repeat(least, np.diff(np.append(at, len(key))))
    some = root != key
    pairs = np.unique(np.stack([root[some], key[some]], 1), axis=0)
    return gram[at], low[at], np.maximum.reduceat(high, at), least, pairs


def pairs_of_few(gram: np.ndarray, low: np.ndarray, high: np.ndarray, key: np.ndarray) -> np.ndarray:
    """All pairs of keys, the smaller first, whose entries of an n-gram are within reach of each other."""
    order = np.lexsort((low, gram))
    gram, low, high, key = gram[order], low[order], high[order], key[order]
    found = [np.zeros((0, 2), np.int64)]
    for d in range(1, len(gram)):
        same = gram[d:] == gram[:-d]
        if not same.any():
            break
        same &= (low[d:] <= high[:-d]) & (low[:-d] <= high[d:]) & (key[d:] != key[:-d])
        found.append(np.stack([np.minimum(key[:-d][same], key[d:][same]), np.maximum(key[:-d][same], key[d:][same])], 1))
    return np.unique(np.concatenate(found), axis=0)


def several(gram: np.ndarray, low: np.ndarray, high: np.ndarray, key: np.ndarray, merged: np.ndarray) -> tuple[np.ndarray, ...]:
    """Without the entries of n-grams that have one, and those of copies of a set that other tasks sent."""
    _, at, count = np.unique(gram, return_inverse=True, return_counts=True)
    gram, low, high, key, merged = (x[count[at] > 1] for x in (gram, low, high, key, merged))
    order = np.lexsort((merged, key, gram))
    gram, low, high, key, merged = (x[order] for x in (gram, low.astype(np.int64), high.astype(np.int64), key, merged))
    fresh = np.ones(len(gram), bool)
    fresh[1:] = (gram[1:] != gram[:-1]) | (key[1:] != key[:-1]) | (merged[1:] > 0)
    return tuple(x[fresh] for x in (gram, low, high, key, merged))


def frequent(gram: np.ndarray, merged: np.ndarray, few: int) -> np.ndarray:
    """Which entries belong to an n-gram with more than so few entries, or with one that is merged already."""
    _, at, count = np.unique(gram, return_inverse=True, return_counts=True)
    return ((count > few) | (np.bincount(at, merged, len(count)) > 0))[at]


def bitmap(grams: np.ndarray) -> bytes:
    """A bit for each n-gram, in two to four times as many."""
    bits = np.zeros(max(64, 2 << int(len(grams) - 1).bit_length()), np.uint8)
    bits[(grams & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def may_link(x: int, map_x: bytes, y: int, map_y: bytes, percent: int) -> bool:
    """Whether the largest overlap that the bitmaps of sets of x and y n-grams allow is enough for a link."""
    a, b = np.frombuffer(map_x, np.uint64), np.frombuffer(map_y, np.uint64)
    m = min(len(a), len(b))
    a, b = (np.bitwise_or.reduce(k.reshape(-1, m)) for k in (a, b))
    shared = int(np.bitwise_count(a & b).sum())
    most = min(x - max(0, int(np.bitwise_count(a).sum()) - shared), y - max(0, int(np.bitwise_count(b).sum()) - shared))
    return (100 + percent) * most >= percent * (x + y)


def set_key(grams: np.ndarray) -> tuple[int, int]:
    """Two 64-bit numbers that stand for a whole set."""
    a = mixed(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    b = mixed(grams + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


class Tree:
    """A signature tree over some sets. Arrays hold the nodes of each height, the leaves' documents first."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        first = np.array([int(s[0]) if len(s) else 0 for s in sets], np.uint64)
        self.order = np.lexsort((first, self.size))
        bits = np.zeros((len(sets), BITMAP_WORDS * 64), np.uint8)
        for k, i in enumerate(self.order):
            bits[k, (sets[i] & np.uint64(BITMAP_WORDS * 64 - 1)).astype(np.int64)] = 1
        maps = np.packbits(bits, axis=1).view(np.uint64)
        size = self.size[self.order]
        self.heights = [(maps, np.bitwise_count(maps).sum(1).astype(np.int64), size, size)]  # OR, fewest bits, sizes
        step = LEAF
        while len(self.heights[-1][0]) > 1:
            m, few, low, high = self.heights[-1]
            at = np.arange(0, len(m), step)
            self.heights.append((np.bitwise_or.reduceat(m, at), np.minimum.reduceat(few, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))
            step = FANOUT

    def possible(self, height: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs of nodes may hold a similar pair: the largest overlap reaches what the smallest sizes need."""
        m, few, low, high = self.heights[height]
        shared = np.bitwise_count(m[a] & m[b]).sum(1).astype(np.int64)
        most = np.minimum(high[a] - np.maximum(0, few[a] - shared), high[b] - np.maximum(0, few[b] - shared))
        most = np.minimum(most, np.minimum(high[a], high[b]))
        return (100 + percent) * most >= percent * (low[a] + low[b])


def find(root: list[int], i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def links(sets: list[np.ndarray], labels: list[int], percent: int) -> list[int]:
    """The root of each set after all similar pairs are linked; equal labels are linked beforehand."""
    root, seen = list(range(len(sets))), {}
    for i, x in enumerate(labels):
        root[i] = seen.setdefault(x, i)
    if len(sets) < 2:
        return root
    tree = Tree(sets)
    order = tree.order

    def join(height: int, a: int, b: int) -> None:
        """Links what is similar below the nodes a <= b of a height."""
        step = LEAF if height == 1 else FANOUT
        n = len(tree.heights[height - 1][0])
        i, j = np.arange(a * step, min(n, (a + 1) * step)), np.arange(b * step, min(n, (b + 1) * step))
        i, j = np.repeat(i, len(j)), np.tile(j, len(i))
        keep = i < j if height == 1 else i <= j
        i, j = i[keep], j[keep]
        some = tree.possible(height - 1, i, j, percent)
        for x, y in zip(i[some].tolist(), j[some].tolist(), strict=True):
            if height > 1:
                if not linked(height - 1, x, y):
                    join(height - 1, x, y)
                continue
            p, q = int(order[x]), int(order[y])
            if find(root, p) != find(root, q):
                both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
                if 100 * both >= percent * (len(sets[p]) + len(sets[q]) - both):
                    p, q = find(root, p), find(root, q)
                    root[max(p, q)] = min(p, q)

    def linked(height: int, a: int, b: int) -> bool:
        width = LEAF * FANOUT ** (height - 1)
        below = [*order[a * width : (a + 1) * width], *order[b * width : (b + 1) * width]]
        one = find(root, int(below[0]))
        return all(find(root, int(k)) == one for k in below[1:])

    join(len(tree.heights) - 1, 0, 0)
    return [find(root, i) for i in range(len(sets))]


def similar_components(documents: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of documents.

    Words are what stands between the white-space bytes 09-0D and 20, with A-Z in lower case. Two documents link when
    100 * |intersection| >= percent * |union| of their sets of n-grams; component_id is the smallest doc_id reachable by
    links. Null, empty and blank texts have the empty set and link with nothing. Rows with equal doc_id count as one
    document for links, also where their texts differ. A null doc_id takes no part and has no component. Only doc_id and text are read. An empty table
    gives an empty result. Very long texts are sets like others; nothing is cut.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, bits = max(8, -(-total // (16 << 20))), gram_bits(total)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many documents of a task fall on each counter of n-grams (first rows), and how many words on each of the others."""
        count, spoken = np.zeros(1 << bits, np.uint32), np.zeros(1 << WORD_BITS, np.uint32)
        for batch in batches:
            own = [np.zeros(0, np.int64)]
            for part in slices_of(*utf8(batch["text"]), n):
                own.append(cells(part[0], WORD_BITS))
                for grams, _ in sets_of(*part, n):
                    count[cells(grams, bits)] += 1
            spoken += np.bincount(np.concatenate(own), minlength=len(spoken)).astype(np.uint32)
        for first, x in ((0, count), (CELL_ROWS, spoken)):
            for k, part in enumerate(np.split(x, CELL_ROWS)):
                yield counter(first + k, squeezed(part))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The levels of each row of counters."""
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, data in zip(batch["row"].to_pylist(), batch["data"].to_pylist(), strict=True):
                total[row] = unsqueezed(data) + total.get(row, np.int64(0))
        for row, x in total.items():
            yield counter(row, zlib.compress((gram_levels if row < CELL_ROWS else word_levels)(x).tobytes(), 1))

    def counter(row: int, data: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([data], pa.binary())], ["row", "data"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of documents (bucket -1) with the sets' bitmaps, chained pairs of this task (-2), and packed entries for each bucket."""
        (often, spoken), held, many, seen = level.value, [], 0, set()
        for batch in batches:
            found, maps = [], []
            for part in slices_of(*utf8(batch["text"]), n):
                for grams, weight in sets_of(*part, n, spoken):
                    key = set_key(grams)
                    found.append((len(grams), *key))
                    maps.append(None)
                    if len(grams) and key[0] not in seen:  # equal sets have equal entries
                        seen.add(key[0])
                        maps[-1] = bitmap(grams)
                        first, most = prefix(grams, (often[cells(grams, bits)].astype(np.int64) << 32) + weight, percent)
                        held.append((first, np.full(len(first), len(grams)), most, np.full(len(first), key[0])))
                        many += len(first)
            size, k1, k2 = zip(*found, strict=True) if found else ((), (), ())
            yield packed([-1] * batch.num_rows, batch["doc_id"], size, k1, k2, maps)
            if many > HELD:
                yield from dealt(held)
                held, many, seen = [], 0, set()
        if held:
            yield from dealt(held)

    def dealt(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Entries of a task: as they are, or merged (k1 is 1) if the n-gram is frequent."""
        entries = tuple(np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        often = frequent(entries[0], np.zeros(len(entries[0])), FEW)
        *merged, pairs = segments(*(x[often] for x in entries))
        m = len(pairs)
        yield packed([-2] * m, pa.nulls(m, pa.int64()), [0] * m, pairs[:, 0], pairs[:, 1], [None] * m)
        entries = tuple(x[~often] for x in entries)
        for k, (gram, low, high, key) in enumerate([entries, merged]):
            to = (mixed(gram.copy()) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cut = np.searchsorted(to[order], np.arange(buckets + 1))
            for b in range(buckets):
                own = order[cut[b] : cut[b + 1]]
                if len(own):
                    data = gram[own].astype("<u8").tobytes() + key[own].astype("<i8").tobytes() + low[own].astype("<u4").tobytes() + high[own].astype("<u4").tobytes()
                    yield packed([b], [None], [0], [k], [0], [data])

    def packed(bucket, doc_id, size, k1, k2, data) -> pa.RecordBatch:
        columns = [pa.array(bucket, pa.int64()), doc_id if isinstance(doc_id, pa.Array) else pa.array(doc_id, pa.int64())]
        columns += [pa.array(x, pa.int64()) for x in (size, k1, k2)] + [pa.array(data, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "doc_id", "n_shingles", "k1", "k2", "data"])

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the buckets of one task: chained pairs, and pairs (few) that their bitmaps are to confirm."""
        parts: dict[int, list[tuple]] = {}
        for batch in batches:
            for b, k, data in zip(*(batch[c].to_pylist() for c in ("bucket", "k1", "data")), strict=True):
                parts.setdefault(b, []).append((k, data))
        for b in list(parts):
            rows = [(k, len(data) // 24, data) for k, data in parts.pop(b)]
            for part in range(PARTS):  # of the n-grams, for less memory
                columns, flags = [[], [], [], []], []
                for k, m, data in rows:
                    own = np.frombuffer(data, "<u8", m) % np.uint64(PARTS) == part
                    for column, (kind, at) in zip(columns, (("<u8", 0), ("<u4", 16 * m), ("<u4", 20 * m), ("<i8", 8 * m)), strict=True):
                        column.append(np.frombuffer(data, kind, m, at)[own])
                    flags.append(np.full(len(columns[0][-1]), k))
                *entries, merged = several(*map(np.concatenate, (*columns, flags)))
                often = frequent(entries[0], merged, FEW)
                for few, pairs in ((False, segments(*(x[often] for x in entries))[-1]), (True, pairs_of_few(*(x[~often] for x in entries)))):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array([few] * len(pairs), pa.bool_())], ["a", "b", "few"])

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(*(batch[c].to_pylist() for c in ("x", "map_x", "y", "map_y")), strict=True)
            own = pa.array([may_link(*row, percent) for row in both], pa.bool_())
            yield batch.select(["a", "b"]).filter(own)

    counted = docs.select("text").mapInArrow(tally, "row long, data binary").repartition(8, "row").mapInArrow(summed, "row long, data binary")
    got = counted.toArrow()  # 2 * CELL_ROWS rows of at most 2 ** GRAM_BITS[1] // CELL_ROWS bytes, whatever the input
    row = dict(zip(got["row"].to_pylist(), got["data"].to_pylist(), strict=True))
    level = [[zlib.decompress(row[k]) for k in range(a, a + CELL_ROWS) if k in row] for a in (0, CELL_ROWS)]
    level = documents.sparkSession.sparkContext.broadcast(tuple(np.frombuffer(b"".join(x), np.uint8) for x in level))
    scanned = stored(docs.mapInArrow(scan, "bucket long, doc_id long, n_shingles long, k1 long, k2 long, data binary"))
    rows = scanned.where("bucket = -1").select("doc_id", "n_shingles", "k1", "k2")
    sent = scanned.where("bucket >= 0").select("bucket", "k1", "data").repartition(buckets, "bucket")
    near = scanned.where("bucket = -2").select(F.col("k1").alias("a"), F.col("k2").alias("b"))
    pairs = stored(sent.mapInArrow(chains, "a long, b long, few boolean").distinct())
    few = pairs.where("few").select("a", "b")
    ends = few.select(F.explode(F.array("a", "b")).alias("k1")).distinct()
    maps = scanned.where("bucket = -1 and data is not null").select("k1", "k2", "n_shingles", "data")
    maps = stored(maps.join(ends, "k1", "left_semi").dropDuplicates(["k1", "k2"]))
    for end, x in (("a", "x"), ("b", "y")):
        few = few.join(maps.select(F.col("k1").alias(end), F.col("n_shingles").alias(x), F.col("data").alias(f"map_{x}")), end)
    few = few.mapInArrow(confirmed, "a long, b long")
    groups = components(pairs.where("not few").select("a", "b").unionByName(near).unionByName(few))  # of keys k1
    same = rows.where("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("node"))
    nodes = stored(same.join(groups.withColumnRenamed("node", "k1"), "k1").select("node", "k1", "k2", F.col("component").alias("grp")))
    pivots = F.array_compact(F.array([F.min(F.when(F.pmod(F.xxhash64("k1"), F.lit(PIVOTS)) == k, F.col("k1"))) for k in range(PIVOTS)]))
    sizes = nodes.groupBy("grp").agg(F.count("*").alias("n"), pivots.alias("pivots"))
    sizes = sizes.where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("long"))
    placed = nodes.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("k1"), F.col("blocks")))
    placed = stored(placed.withColumn("pivot", F.array_contains("pivots", F.col("k1"))).drop("pivots", "n"))

    def joined(tasks: DataFrame) -> DataFrame:
        """a, b: each node with its root, in each task (grp, i, j; node, label, grams)."""
        return (
            tasks.select("grp", "i", "j", "node", "k1", "label", "grams")
            .repartition(max(8, buckets), "grp", "i", "j")
            .sortWithinPartitions("grp", "i", "j", "node", "k1")
            .mapInArrow(joins, "a long, b long")
        )

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(ngram_sets(*utf8(batch["text"]), n))
            wanted = zip(batch["k1"].to_pylist(), batch["k2"].to_pylist(), strict=True)
            own = pa.array([set_key(grams) == key for grams, key in zip(found, wanted, strict=True)], pa.bool_())  # not another text of the doc_id
            rows_ = pa.RecordBatch.from_arrays([*(batch[c] for c in place), pa.array([grams.tobytes() for grams in found], pa.binary())], [*place, "grams"])
            yield rows_.filter(own)

    def joins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, []
        for batch in batches:
            for g, i, j, node, label, data in zip(*(batch[c].to_pylist() for c in ("grp", "i", "j", "node", "label", "grams")), strict=True):
                if (g, i, j) != task:
                    if held:
                        yield ended(held)
                    task, held = (g, i, j), []
                held.append((node, label, data))
        if held:
            yield ended(held)

    def ended(held: list[tuple]) -> pa.RecordBatch:
        root = links([np.frombuffer(d, np.uint64) for _, _, d in held], [x for _, x, _ in held], percent)
        a = [held[k][0] for k in root]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array([h[0] for h in held], pa.int64())], ["a", "b"])

    # texts are dealt by doc_id at every size, once; both rounds of joins read the sets that come of them
    place = ["node", "k1", "k2", "grp", "block", "blocks", "pivot"]
    texts = docs.join(placed.hint("merge"), F.col("doc_id") == F.col("node")).select(*place, "text")
    sets = stored(texts.mapInArrow(to_sets, "node long, k1 long, k2 long, grp long, block long, blocks long, pivot boolean, grams binary"))
    to = F.when(F.col("pivot"), F.expr("sequence(0L, blocks - 1)")).otherwise(F.array("block"))
    first = sets.select("grp", F.explode(to).alias("i"), "node", "k1", F.col("node").alias("label"), "grams")
    edges = stored(joined(first.withColumn("j", F.col("i"))))
    found = stored(components(edges))
    apart = placed.where("blocks > 1").join(found, "node", "left").select("grp", "node", "k1", "k2", F.coalesce("component", "node").alias("label"))
    classes = apart.groupBy("grp", "label").agg(F.count("*").alias("n"))
    largest = classes.groupBy("grp").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n"))
    cut = lambda m: F.ceil(m / BLOCK).cast("long")
    largest = largest.select("grp", F.col("most.label").alias("main"), cut(F.col("most.n")).alias("x"), cut(F.col("n") - F.col("most.n")).alias("y"))
    open_ = stored(largest.where("y > 0"))
    if open_.limit(1).count():
        inside = F.col("label") == F.col("main")
        at = F.when(inside, F.pmod(F.xxhash64("k1"), F.col("x"))).otherwise(F.col("x") + F.pmod(F.xxhash64("k1"), F.col("y")))
        other = F.explode(F.sequence(F.when(inside, F.col("x")).otherwise(F.lit(0).cast("long")), F.col("x") + F.col("y") - 1))
        again = apart.join(open_, "grp").select("node", "k1", "k2", "label", "main", "x", "y", at.alias("at"))
        again = again.join(sets.where("blocks > 1").select("grp", "node", "k1", "k2", "grams").hint("merge"), ["node", "k1", "k2"])
        again = again.select("grp", "node", "k1", "label", "grams", "at", other.alias("o"))
        edges = stored(edges.unionByName(joined(again.withColumn("i", F.least("at", "o")).withColumn("j", F.greatest("at", "o")))))
        found = stored(components(edges))
    twice = stored(rows.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1"))
    if twice.limit(1).count():  # rows of one doc_id whose sets differ are one document: its sets' smallest doc_ids are linked
        own = rows.join(twice, "doc_id", "left_semi").join(same, ["k1", "k2"]).groupBy("doc_id").agg(F.min("node").alias("a"), F.collect_set("node").alias("all"))
        found = components(edges.unionByName(own.where(F.size("all") > 1).select("a", F.explode("all").alias("b"))))
    rows = rows.join(same, ["k1", "k2"], "left").join(found, "node", "left")
    return rows.select(
        "doc_id",
        "n_shingles",
        F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "node")).otherwise(F.col("doc_id")).alias("component_id"),
    )
