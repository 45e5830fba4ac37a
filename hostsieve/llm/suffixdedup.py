"""Removal of passages that repeat across documents, by a collection suffix array built column by column.

1. Every window of `length` bytes belongs to its minimiser, the smallest hash of the short runs inside it; equal windows
   have equal minimisers. Windows in a row with one minimiser form a segment. Packed lists of minimisers meet in
   buckets, which answer for each whether more than one text has it, and whether very many segments do. A pack sends a
   minimiser once, with the smallest and the largest doc_id and the number of its segments.
2. Segments whose minimiser repeats go to the minimiser's bucket, equal ones of a task once with the smallest doc_id.
   Segments of very frequent minimisers go window by window, dealt by the window, so that no bucket is hot.
3. A bucket builds the Burrows-Wheeler transform of its distinct segments in rounds: each round inserts one symbol of each
   segment, from the last to the first, into the transform of all suffixes so far, and updates the common prefixes of
   neighbours, up to `length` bytes, from those of the round before. Neighbours that agree in `length` bytes form the
   classes of equal windows, and a class's smallest doc_id says who keeps the window. A segment that is alone with its
   minimiser, or whose windows all have hashes of their own, shares no window and needs no rounds; windows of very frequent minimisers take part in none either, as
   equal ones meet as equal strings.
4. The answers return to the texts: for each distinct segment its smallest doc_id, and the windows that an even smaller
   document holds.

A bucket's transform and prefixes are streams in memory, each round read and written from front to back: a bucket has a
bounded share of the text, and files of its own would lie on one machine's disk. Hashes choose minimisers and bring equal
segments together; that they are equal is told by their bytes.

Texts are dealt into packs once; both passes over them use the same written table, so that places stay valid when tasks
run again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostsieve.llm.common import mixed, ngrams, span_hashes, stored, utf8

#: Bytes of the runs that minimisers are chosen from, of the text of one pack, and segments of a frequent minimiser.
RUN, PACK, FREQUENT = 20, 2 << 20, 2000
#: Tasks that buckets are dealt to at most; one that has several takes them one after another.
MOST_TASKS = 20_000
_TOP = np.iinfo(np.int64).max


def segments(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window, number of windows and text of each segment of some texts. A segment has at most as many
    windows as a window has runs, so that repetitive texts give bounded ones."""
    most = length - RUN + 1
    minimum = mixed(ngrams(raw, RUN))
    width = 1
    while width * 2 <= most:
        minimum = np.minimum(minimum[: len(minimum) - width], minimum[width:])
        width *= 2
    if width < most:
        minimum = np.minimum(minimum[: len(minimum) - (most - width)], minimum[most - width :])
    n = np.maximum(np.diff(offsets) - length + 1, 0)  # windows of each text
    if not n.sum():
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    change = np.ones(len(minimum) + 1, bool)
    change[1:-1] = minimum[1:] != minimum[:-1]
    change[offsets[:-1][n > 0]] = True
    change[(offsets[:-1] + n)[n > 0]] = True
    at = np.flatnonzero(change)
    size = np.diff(at)
    text = np.searchsorted(offsets, at[:-1], "right") - 1
    inside = at[:-1] < (offsets[:-1] + n)[text]
    at, size, text = at[:-1][inside], size[inside], text[inside]
    if (size > most).any():
        pieces = -(-size // most)
        k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at, size, text = (np.repeat(x, pieces) for x in (at, size, text))
        at, size = at + k * most, np.minimum(most, size - k * most)
    return minimum[at], at, size, text


def distinct(m: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct minimisers of a pack, by bucket and then by first segment: bucket, 32 bits, first segment, number of
    segments; and the place among them of each segment's minimiser. What a pack repeats, it sends once."""
    to = ((m >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    low = (m >> np.uint64(8)).astype(np.uint32)
    by = np.lexsort((low, to))
    change = np.ones(len(m), bool)
    change[1:] = (to[by][1:] != to[by][:-1]) | (low[by][1:] != low[by][:-1])
    at = np.flatnonzero(change)
    times = np.diff(np.append(at, len(m)))
    first = by[at]  # lexsort is stable
    order = np.lexsort((first, to[first]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    place = np.empty(len(m), np.int64)
    place[by] = np.repeat(rank, times)
    return to[first][order], low[first][order], first[order], times[order], place


def bwt_rounds(rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of the given strings in order, as places of the symbols before them in the flattened rows, and each
    one's common prefix with its predecessor, up to `length`.

    rows: one string a row, right-aligned, with at least one 255, which UTF-8 never has, to its left. Round k inserts the
    suffix of length k of each string that has one: the suffix order of round k - 1, read in sequence and dealt by the
    symbols before the suffixes (the transform so far), is the order of the suffixes that begin with these symbols. Two
    neighbours that begin with one symbol agree in it and in what all suffixes between those that they come from agree
    in. Only an inserted suffix and its successor have new common prefixes. A string leaves the rounds when it ends.
    """
    flat, width, m = rows.ravel(), rows.shape[1], len(rows)
    empty = np.arange(1, m + 1) * width - 1
    at, common, fresh = empty, np.zeros(m, np.uint8), np.ones(m, bool)
    for _ in range(width - 1):
        before = flat[at]
        more = np.flatnonzero(before != 255)
        symbol = before[more]
        by = np.argsort(symbol, kind="stable")
        order = more[by]
        fresh = np.concatenate((np.zeros(m, bool), fresh[order]))  # what comes of the suffixes that the last round inserted
        now = np.empty(len(fresh), np.uint8)
        now[~fresh] = common
        new = np.flatnonzero(fresh) - m
        after = new[new + 1 < len(order)] + 1
        touched = np.concatenate((new, after[~fresh[after + m]]))
        now[touched + m] = 0
        touched = touched[touched > 0]
        touched = touched[symbol[by[touched]] == symbol[by[touched - 1]]]
        low, high = order[touched - 1] + 1, order[touched] + 1
        least = common[low]
        far = np.flatnonzero((high > low + 1) & (least > 0))  # others come of neighbours, or of such as agree in nothing
        far = far[np.argsort(low[far])]
        if len(far):
            pairs = np.stack([low[far], high[far]], 1).ravel()
            least[far] = np.minimum.reduceat(np.append(common, np.uint8(0)), pairs)[::2]
        now[touched + m] = np.minimum(least, length - 1) + 1
        at, common = np.concatenate((empty, at[order] - 1)), now
    return at, common


def hold_equal_hashes(strings: list[bytes], length: int, most: int = 4096) -> np.ndarray:
    """Which strings hold a window whose hash, 32 bits, occurs more than once. The others share no window: equal ones hash
    alike. Strings are hashed `most` at a time, so that no more than the hashes are held of all."""
    codes, counts = [], []
    for k in range(0, len(strings), most):
        sizes = np.array([len(s) for s in strings[k : k + most]])
        windows = sizes - length + 1
        shift = np.cumsum(sizes) - sizes - (np.cumsum(windows) - windows)
        at = np.repeat(shift, windows) + np.arange(windows.sum())
        codes.append((ngrams(np.frombuffer(b"".join(strings[k : k + most]), np.uint8), length)[at] >> np.uint64(32)).astype(np.uint32))
        counts.append(windows)
    ordered = np.sort(np.concatenate(codes))
    twice = np.append(np.unique(ordered[1:][ordered[1:] == ordered[:-1]]), np.uint32(0xFFFFFFFF))
    held = [twice[np.searchsorted(twice, c)] == c for c in codes]
    return np.concatenate([np.logical_or.reduceat(h, np.cumsum(n) - n) for h, n in zip(held, counts, strict=True)])


def class_minima(strings: list[bytes], docs: np.ndarray, groups: np.ndarray, length: int) -> list[np.ndarray]:
    """For each string, of its windows the smallest document that holds an equal one; docs: each string's smallest.

    Equal windows stand in strings of one group (minimiser); a string that is alone in its group needs no rounds.
    """
    out = [np.full(len(s) - length + 1, d) for s, d in zip(strings, docs.tolist(), strict=True)]
    _, group, times = np.unique(groups, return_inverse=True, return_counts=True)
    chosen = np.flatnonzero(times[group] > 1)
    if not len(chosen):
        return out
    chosen = chosen[hold_equal_hashes([strings[i] for i in chosen], length)]
    if not len(chosen):
        return out
    sizes = np.array([len(strings[i]) for i in chosen])
    width = int(sizes.max()) + 1
    rows = np.full((len(chosen), width), 255, np.uint8)
    flat = np.frombuffer(b"".join([strings[i] for i in chosen]), np.uint8)
    start = np.cumsum(sizes) - sizes
    for n in np.unique(sizes):
        some = np.flatnonzero(sizes == n)
        rows[some, width - n :] = flat[start[some, None] + np.arange(n)]
    at, common = bwt_rounds(rows, length)
    at, classes = at + 1, np.cumsum(common < length)
    owner = (at - 1) // width
    keep = (owner + 1) * width - at >= length
    owner, at, classes = owner[keep], at[keep], classes[keep]
    first = np.flatnonzero(np.concatenate(([True], classes[1:] != classes[:-1])))
    least = np.repeat(np.minimum.reduceat(docs[chosen][owner], first), np.diff(np.append(first, len(owner))))
    windows = sizes - length + 1
    base = np.cumsum(windows) - windows
    found = np.empty(windows.sum(), np.int64)
    found[base[owner] + at - ((owner + 1) * width - sizes[owner])] = least
    for i, x in zip(chosen.tolist(), np.split(found, base[1:]), strict=True):
        out[i] = x
    return out


def _pack_flags(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def equal_runs(whole: bytes, at: np.ndarray, end: np.ndarray, to: np.ndarray, code: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of segments by bucket in which equal ones stand together, the smallest document's first, and where runs
    of equal ones begin. Hashes give the order; segments with equal hashes but other bytes are told apart."""
    order = np.lexsort((doc, code, to))
    to, code = to[order], code[order]
    first = np.ones(len(order), bool)
    first[1:] = (to[1:] != to[:-1]) | (code[1:] != code[:-1])
    head = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    again = np.flatnonzero(~first)
    i, j = order[again], order[head[again]]
    differ = [k for k, a, z, b, y in zip(again.tolist(), at[i].tolist(), end[i].tolist(), at[j].tolist(), end[j].tolist(), strict=True) if whole[a:z] != whole[b:y]]
    for k in sorted({int(head[k]) for k in differ}):
        last = k + 1
        while last < len(order) and not first[last]:
            last += 1
        run = sorted(order[k:last].tolist(), key=lambda x: (whole[at[x] : end[x]], doc[x]))
        order[k:last] = run
        first[k + 1 : last] = [whole[at[x] : end[x]] != whole[at[y] : end[y]] for x, y in zip(run[1:], run[:-1], strict=True)]
    return order, first


def by_bucket(batches: Iterator[pa.RecordBatch], column: str, in_order: bool) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """Each bucket with its packs' messages. Where rows come in order of buckets one at a time is held, else a task's few."""
    now, held = None, {}
    for batch in batches:
        for name, b, data in zip(*(batch[c].to_pylist() for c in ("pack", "bucket", column)), strict=True):
            if in_order and b != now and held:
                yield now, held.pop(now)
            now = b
            held.setdefault(b, []).append((name, data))
    for b in list(held):
        yield b, held.pop(b)


def remove_repeats(documents: DataFrame, length: int = 50, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of documents (and kept, the remaining bytes, on demand).

    Removes each byte covered by a `length`-byte string that also starts in a text with a smaller doc_id, judged on the
    input. Texts are UTF-8 bytes; null counts as empty, and what is shorter than `length` keeps all. Matches never cross
    texts. Rows with equal doc_id never remove each other's bytes; a null doc_id counts as smaller than all others.
    Only doc_id and text are read. An empty table gives an empty result. Texts of any length are read whole.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total, rows = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    total = total or 0
    buckets, tasks = max(8, -(-total // (3 << 20))), max(8, -(-total // (24 << 20)))

    in_order = buckets > MOST_TASKS

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each pack of texts: ids, whether known, lengths, and the bytes, compressed."""
        press = zstandard.ZstdCompressor(level=1)
        ids, texts, size = [], [], 0
        names = count(TaskContext.get().partitionId() << 32)

        def out():
            known = np.array([i is not None for i in ids], np.uint8)
            lengths = np.array([len(t) for t in texts], "<i8")
            head = np.array([i or 0 for i in ids], "<i8").tobytes() + known.tobytes() + lengths.tobytes()
            data = press.compress(head + b"".join(texts))
            return pa.RecordBatch.from_pydict({"pack": pa.array([next(names)]), "n": pa.array([len(ids)]), "data": pa.array([data], pa.binary())})

        for batch in batches:
            raw, offsets = utf8(batch["text"])
            raw = raw.tobytes()
            for k, i in enumerate(batch["doc_id"].to_pylist()):
                ids.append(i)
                texts.append(raw[offsets[k] : offsets[k + 1]])
                size += len(texts[-1])
                if size >= PACK:
                    yield out()
                    ids, texts, size = [], [], 0
        if ids:
            yield out()

    def opened(n: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """doc_id for comparison, whether known, bytes and offsets."""
        data = zstandard.ZstdDecompressor().decompress(data)
        ids, known = np.frombuffer(data, "<i8", n), np.frombuffer(data, np.uint8, n, 8 * n)
        offsets = np.concatenate(([0], np.cumsum(np.frombuffer(data, "<i8", n, 9 * n))))
        return np.where(known == 1, ids, -_TOP), known, np.frombuffer(data, np.uint8, -1, 17 * n), offsets

    def minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each pack and bucket: the minimisers in order of segments, 32 bits each, with their doc_ids' places."""
        for batch in batches:
            for name, n, data in zip(*(batch[c].to_pylist() for c in ("pack", "n", "data")), strict=True):
                ids, _, raw, offsets = opened(n, data)
                m, _, _, text = segments(raw, offsets, length)
                to, low, first, times, place = distinct(m, buckets)
                own = ids[text]
                by = np.argsort(place, kind="stable")
                least, most = (f.reduceat(own[by], np.cumsum(times) - times) if len(m) else own for f in (np.minimum, np.maximum))
                doc, again = own[first], times > 1
                names, cut = np.unique(to, return_index=True)
                sent = []
                for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(to)], strict=True):
                    who, long = runs(doc[a:z])
                    head = np.array([len(who), z - a], "<i8").tobytes() + who.tobytes() + long.astype("<u4").tobytes()
                    some = again[a:z]
                    count_ = np.minimum(times[a:z], FREQUENT + 1).astype("<u2")
                    sent.append(head + low[a:z].tobytes() + count_.tobytes() + least[a:z][some].tobytes() + most[a:z][some].tobytes())
                k = len(names)
                yield pa.RecordBatch.from_arrays([pa.array([name] * k, pa.int64()), pa.array(names.tolist(), pa.int64()), pa.array(sent, pa.binary())], ["pack", "bucket", "sent"])

    def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
        return x[first], np.diff(np.append(first, len(x)))

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each pack and bucket: 2 bits a minimiser, whether it has several documents, and very many segments."""
        for b, messages in by_bucket(batches, "sent", in_order):
            names, parts = [], []
            for name, sent in messages:
                k, n = np.frombuffer(sent, "<i8", 2).tolist()
                at = 16 + 12 * k
                low, times = np.frombuffer(sent, "<u4", n, at), np.frombuffer(sent, "<u2", n, at + 4 * n)
                least = np.repeat(np.frombuffer(sent, "<i8", k, 16), np.frombuffer(sent, "<u4", k, 16 + 8 * k))
                most, some = least.copy(), times > 1
                ends = np.frombuffer(sent, "<i8", -1, at + 6 * n)
                least[some], most[some] = ends[: len(ends) // 2], ends[len(ends) // 2 :]
                names.append(name)
                parts.append((low, least, most, times))
            low, least, most, times = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(low, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], np.diff(low[order]) != 0)))
            several = np.minimum.reduceat(least[order], first) != np.maximum.reduceat(most[order], first)
            frequent = np.add.reduceat(times[order].astype(np.int64), first) > FREQUENT
            state = np.zeros(len(low), np.uint8)
            state[order] = np.repeat(several.astype(np.uint8) + (several & frequent), np.diff(np.append(first, len(low))))
            at = np.cumsum([len(x[0]) for x in parts])[:-1]
            for name, part in zip(names, np.split(state, at), strict=True):
                bits = _pack_flags(part > 0) + _pack_flags(part > 1) if part.any() else b""
                yield pa.RecordBatch.from_pydict({"pack": pa.array([name]), "bucket": pa.array([b]), "bits": pa.array([bits], pa.binary())})

    def shared(n: int, data: bytes, bits: dict[int, bytes]):
        """The segments of a pack that may repeat: ids, bytes, first window, windows, text, bucket, a hash and a group of each.

        Segments of frequent minimisers come as single windows. In text order, the same each time it is called.
        """
        ids, known, raw, offsets = opened(n, data)
        m, at, size, text = segments(raw, offsets, length)
        dealt, _, _, _, place = distinct(m, buckets)
        held = np.zeros(len(dealt), np.uint8)
        for b, x in bits.items():
            if x:
                a, z = np.searchsorted(dealt, [b, b + 1])
                held[a:z] = np.unpackbits(np.frombuffer(x, np.uint8).reshape(2, -1), axis=1)[:, : z - a].sum(0)
        state, to = held[place], dealt[place]
        before = state > 0
        repeat = np.where(state > 1, size, 1)[before]
        k = np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat)
        at, size, text, to, state = (np.repeat(x[before], repeat) for x in (at, size, text, to, state))
        at, size = np.where(state > 1, at + k, at), np.where(state > 1, 1, size)
        code = span_hashes(raw, at, at + size + length - 1) if len(at) else np.zeros(0, np.uint64)
        group = np.where(state > 1, code, np.repeat(m[before], repeat)) >> np.uint64(8)  # single windows equal no others
        to = np.where(state > 1, (code % np.uint64(buckets)).astype(np.int64), to)
        return ids, known, raw, offsets, at, size, text, to, code, group.astype(np.uint32)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each pack and bucket: distinct segments with their smallest doc_id, and for each segment which it is."""
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for name, n, data, bits in zip(*(batch[c].to_pylist() for c in ("pack", "n", "data", "bits")), strict=True):
                ids, _, raw, _, at, size, text, to, code, group = shared(n, data, {x["bucket"]: x["bits"] for x in bits})
                whole = raw.tobytes()
                order, first = equal_runs(whole, at, at + size + length - 1, to, code, ids[text])
                heads, names, sent = order[first], [], []
                used = np.unique(to)
                cut = np.append(np.searchsorted(to[heads], used), len(heads))
                for k, b in enumerate(used.tolist()):
                    own = heads[cut[k] : cut[k + 1]]
                    body = b"".join([whole[a : a + s] for a, s in zip(at[own].tolist(), (size[own] + length - 1).tolist(), strict=True)])
                    sent.append(np.array([len(own)], "<i8").tobytes() + ids[text[own]].tobytes() + group[own].tobytes() + size[own].astype(np.uint8).tobytes() + press.compress(body))
                    names.append(b)
                k = len(names)
                yield pa.RecordBatch.from_arrays([pa.array([name] * k, pa.int64()), pa.array(names, pa.int64()), pa.array(sent, pa.binary())], ["pack", "bucket", "sent"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each pack and bucket: of each distinct segment sent, which windows the pack's smallest holder must give up.

        Of a segment that a smaller document outside the pack holds whole, all windows; then every holder gives up all.
        """
        open_ = zstandard.ZstdDecompressor()
        for b, messages in by_bucket(batches, "sent", in_order):
            place: dict[bytes, int] = {}
            docs_, groups, parts = [], [], []
            for name, sent in messages:
                k = int(np.frombuffer(sent, "<i8", 1)[0])
                doc, group = np.frombuffer(sent, "<i8", k, 8), np.frombuffer(sent, "<u4", k, 8 + 8 * k)
                size = np.frombuffer(sent, np.uint8, k, 8 + 12 * k).astype(np.int64)
                body, end = open_.decompress(sent[8 + 13 * k :]), np.cumsum(size + length - 1)
                index = np.empty(k, np.int64)
                for i, (a, z, d, g) in enumerate(zip((end - size - length + 1).tolist(), end.tolist(), doc.tolist(), group.tolist(), strict=True)):
                    s = body[a:z]
                    at = place.setdefault(s, len(docs_))
                    if at == len(docs_):
                        docs_.append(d)
                        groups.append(g)
                    elif d < docs_[at]:
                        docs_[at] = d
                    index[i] = at
                parts.append((name, doc, size, index))
            minima = class_minima(list(place), np.array(docs_, np.int64), np.array(groups), length)
            windows = np.array([len(x) for x in minima])
            base, flat = np.cumsum(windows) - windows, np.concatenate(minima)
            for name, doc, size, index in parts:
                w = np.repeat(base[index] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                lost = flat[w] < np.repeat(doc, size)
                yield pa.RecordBatch.from_pydict({"pack": pa.array([name]), "bucket": pa.array([b]), "lost": pa.array([_pack_flags(lost)], pa.binary())})

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, data, bits, lost in zip(*(batch[c].to_pylist() for c in ("n", "data", "bits", "lost")), strict=True):
                ids, known, raw, offsets, at, size, text, to, code, _ = shared(n, data, {x["bucket"]: x["bits"] for x in bits or []})
                gone = np.zeros(len(raw) + 1, np.int32)
                order, firsts = equal_runs(raw.tobytes(), at, at + size + length - 1, to, code, ids[text])
                dealt = to[order]
                for x in lost or []:
                    mine = slice(*np.searchsorted(dealt, [x["bucket"], x["bucket"] + 1]))
                    own, first = order[mine], firsts[mine]
                    which = np.cumsum(first) - 1
                    s = size[own]
                    flags = np.unpackbits(np.frombuffer(x["lost"], np.uint8))
                    head = own[first]
                    base = np.cumsum(size[head]) - size[head]
                    w = np.repeat(base[which] - (np.cumsum(s) - s), s) + np.arange(s.sum())
                    lose = flags[w] == 1
                    lose |= np.repeat(ids[text[own]] > ids[text[head]][which], s)  # the pack's own smallest holder keeps it
                    where = np.repeat(at[own] - (np.cumsum(s) - s), s) + np.arange(s.sum())
                    where = where[lose]
                    np.add.at(gone, where, 1)
                    np.add.at(gone, where + length, -1)
                covered = np.cumsum(gone[:-1]) > 0
                kept = raw[~covered]
                before = np.concatenate(([0], np.cumsum(~covered)))
                start = covered.copy()
                start[1:] &= ~covered[:-1]
                inner = offsets[:-1][np.diff(offsets) > 0]
                start[inner] = covered[inner]
                spans = np.concatenate(([0], np.cumsum(start)))
                body = kept.tobytes()
                a, z = before[offsets[:-1]], before[offsets[1:]]
                texts = [body[i:j] for i, j in zip(a.tolist(), z.tolist(), strict=True)]
                columns = [
                    pa.array(np.where(known == 1, ids, 0), mask=known == 0),
                    pa.array(np.diff(offsets)),
                    pa.array(np.diff(offsets) - (z - a)),
                    pa.array(spans[offsets[1:]] - spans[offsets[:-1]]),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                ]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if keep_text:
                    columns, names = [*columns, pa.array(texts, pa.binary())], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(columns, names)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    packs = stored(docs.mapInArrow(pack, "pack long, n long, data binary"))
    small = packs.repartition(max(8, min(rows or 1, tasks)), "pack")
    meet = lambda df: df.repartition(min(buckets, MOST_TASKS), "bucket")
    if in_order:
        meet = lambda df: df.repartition(MOST_TASKS, "bucket").sortWithinPartitions("bucket")
    bits = meet(small.mapInArrow(minimisers, "pack long, bucket long, sent binary")).mapInArrow(answers, "pack long, bucket long, bits binary")
    bits = stored(bits.where(F.octet_length("bits") > 0).groupBy("pack").agg(F.collect_list(F.struct("bucket", "bits")).alias("bits")))
    sent = packs.join(bits, "pack").mapInArrow(send, "pack long, bucket long, sent binary")
    lost = meet(sent).mapInArrow(judge, "pack long, bucket long, lost binary")
    lost = lost.groupBy("pack").agg(F.collect_list(F.struct("bucket", "lost")).alias("lost"))
    all_ = packs.join(bits, "pack", "left").join(stored(lost), "pack", "left")
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return all_.mapInArrow(finish, kind + (", kept binary" if keep_text else ""))
