"""Secret scans: three kinds of base patterns, and spans that two character Markov models tell apart.

The models give the chance of each character after the one before it: one learned from random strings, one from ordinary
identifiers and words. A token is reported when its log-likelihood ratio is high enough for its length. Both models are
trained on labelled samples. Random: what base patterns find in a bounded sample of documents, and strings drawn from the
usual alphabets of keys. Ordinary: the sample's other words, and identifiers, paths and addresses made of these.
"""

from __future__ import annotations

import random as rng
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostsieve.llm.common import sample_ids
from hostsieve.llm.linear import texts_of

#: The base patterns, the least length of what they find, and a span's kinds in order.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")
#: Tokens that the models judge: LEAST or more characters, with two or more of lower case, capitals and digits.
LEAST = 12
TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
TWO = (re.compile("[a-z]"), re.compile("[A-Z]"), re.compile("[0-9]"))
#: Alphabets of keys, and parts of paths and addresses that ordinary strings have beside a corpus' words.
KEYS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_")
PARTS = "usr local lib python3 dist packages site share bin etc var log home user src main java com org net http https www index html php config settings test tests data json xml yaml version release linux x86_64 amd64 docs images static assets api v1 v2 node modules module import export class function method value name file path string number list array object request response server client error message update delete create insert select table column default public private type".split()
SPANS = "array<struct<kind:string,start:long,end:long>>"
ALPHABET = {c: i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-.")}
OTHER = len(ALPHABET)


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the base matches, sorted; positions are code points."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


class Markov:
    """Log-likelihood ratio of a string under two first-order character models over one alphabet."""

    def __init__(self, random: Iterable[str], ordinary: Iterable[str], weight: float = 0.5):
        self.ratio = self._model(random, weight) - self._model(ordinary, weight)

    @staticmethod
    def codes(s: str) -> list[int]:
        return [OTHER, *(ALPHABET.get(c, OTHER) for c in s)]

    def _model(self, strings: Iterable[str], weight: float) -> np.ndarray:
        n = OTHER + 1
        count = np.full((n, n), weight)  # with few samples, near a uniform model
        for s, times in Counter(strings).items():
            c = self.codes(s)
            np.add.at(count, (c[:-1], c[1:]), times)
        return np.log(count / count.sum(1, keepdims=True))

    def __call__(self, s: str) -> float:
        """The ratio of the whole string, in nats."""
        c = self.codes(s)
        return float(self.ratio[c[:-1], c[1:]].sum())


def compounds(words: list[str], n: int, seed: int = 7) -> list[str]:
    """Identifiers, paths and addresses of the given words and of the usual parts, as programs write them."""
    draw, words = rng.Random(seed), [*PARTS, *words]
    out = []
    for _ in range(n):
        parts = [draw.choice(PARTS if draw.random() < 0.4 else words) for _ in range(draw.randint(2, 5))]
        if draw.random() < 0.25:
            parts.append(str(draw.choice((1, 2, 3, 10, 16, 64, 128, 2023, 2024))))
        kind = draw.randrange(6)
        if kind == 0:
            out.append(parts[0].lower() + "".join(p.capitalize() for p in parts[1:]))
        elif kind == 1:
            out.append("_".join(parts).upper())
        else:
            out.append(("", "", "_", "-", "/", ".")[kind].join(p.lower() for p in parts))
            out[-1] = "/" + out[-1] if kind == 4 else out[-1]
    return out


def keys(n: int, seed: int = 7) -> list[str]:
    """Random strings of the usual alphabets."""
    draw = rng.Random(seed)
    return ["".join(draw.choices(draw.choice(KEYS), k=draw.randint(16, 48))) for _ in range(n)]


def train(documents: DataFrame, sample: int = 3000, sample_bytes: int = 12 << 20, made: int = 5000) -> Markov:
    """Fits both models on at most `sample` documents of at most `sample_bytes` bytes together, those with the smallest
    hashes of doc_id, and on `made` strings of each class that are labelled by the way they are made."""
    ids = documents.select("doc_id").where(F.col("doc_id").isNotNull())
    chosen = sample_ids(ids, "doc_id", sample).distinct().withColumn("__label", F.lit(0))
    random, ordinary = keys(made), Counter()  # the words as often as they occur
    for text in texts_of(documents, chosen, sample_bytes)["text"].to_pylist():
        at = 0
        for _, _, end, value in base_spans(text):
            if value >= at and end - value >= 16:
                random.append(text[value:end])
            ordinary.update(re.findall(r"[A-Za-z0-9_-]{3,}", text[at:value]) if value > at else [])
            at = max(at, end)
        ordinary.update(re.findall(r"[A-Za-z0-9_-]{3,}", text[at:]))
    words = sorted(w for w in ordinary if w.isalpha() and len(w) < 12)
    return Markov(random, ordinary + Counter(compounds(words, made)))


def spans(text: str, model: Markov, threshold: float, fixed: float = 8.0) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches and of random tokens, or parts of tokens, outside them.

    A token of n characters is random from a ratio of threshold * n + fixed nats on, so a shorter one has to be the more
    unlike ordinary ones.
    """
    base = base_spans(text)
    out = [(s, k, e) for s, k, e, _ in base]
    free, at = [], 0
    for s, _, e, _ in base:
        if s > at:
            free.append((at, s))
        at = max(at, e)
    for a, b in [*free, (at, len(text))]:
        for m in TOKEN.finditer(text, a, b):
            token = m[0]
            if sum(bool(c.search(token)) for c in TWO) > 1 and model(token) >= threshold * len(token) + fixed:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def find_secrets(documents: DataFrame, threshold: float = 0.5, redact: str | None = None, sample: int = 3000) -> DataFrame:
    """documents with an added column `secret_spans` (kind, start, end; code points, end exclusive) for every whole text.

    Kinds: assign, access and hex by pattern, random by the models; random spans never touch base spans. A token of one
    class of characters alone (only small letters, only capitals, or only digits) is never judged by the models. Spans are in
    order of start, then kind. With `redact`, each span's text is replaced by it, overlapping spans by one, and n_chars, if
    there, is set anew. Null texts have no spans and stay null; empty texts have none. Every row gives one row, repeated
    or not; other columns stay as they are, and a column named secret_spans is replaced.
    """
    model = train(documents, sample)
    documents = documents.drop("secret_spans")
    kept = documents.columns
    counted = redact is not None and "n_chars" in kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            found = [spans(t, model, threshold) if t else [] for t in texts]
            columns = {c: batch[c] for c in kept}
            if redact is not None:
                texts = [t if not f else replaced(t, f, redact) for t, f in zip(texts, found, strict=True)]
                columns["text"] = pa.array(texts, pa.string())
                if counted:
                    columns["n_chars"] = pc.if_else(
                        pa.array([bool(f) for f in found]), pc.utf8_length(columns["text"]).cast(batch["n_chars"].type), batch["n_chars"]
                    )
            made = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in f] for f in found]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(made, kind)], [*columns, "secret_spans"])

    schema = documents.select("*", F.lit(None).cast(SPANS).alias("secret_spans")).schema
    return documents.mapInArrow(run, schema)


def replaced(text: str, found: list[tuple[int, int, int]], by: str) -> str:
    out, at = [], 0
    for start, _, end in found:
        if start >= at:
            out += [text[at:start], by]
        at = max(at, end)
    return "".join([*out, text[at:]])


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of find_secrets' rows: counts of the base kinds, their hash, and all spans as text."""
    base = F.filter("secret_spans", lambda s: s["kind"] != "random")
    of = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secret_spans")).alias("spans"),
        of("random").alias("n_random"),
    )
