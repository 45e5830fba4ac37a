"""What the operators' methods promise, against plain Python: models' scores, pushed predicates, rounds, matches, cutoffs."""

import hashlib
import io
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostsieve.llm import decontaminate, quality, secrets, suffixdedup, topk, toxicity, warc
from hostsieve.llm.common import lowered, mixed, ngrams, span_hashes, utf8

SF = "/root/testdata/sf0.1"


def packed(texts):
    import pyarrow as pa

    return utf8(pa.array(texts))


# Toxicity and quality


def test_toxicity_scores_follow_from_the_weights():
    texts = ["you IDIOT scum " * 3, "a calm and kind remark", "", "idiot", "kind words for all of you", "scum of the earth, idiot"] * 4
    model = toxicity.fit(*packed(texts), np.array([1.0, 0, 0, 1, 0, 1] * 4))
    assert (model.weight != 0).any()
    for text in (*texts[:6], "IDIOT " * 30):
        low, total = lowered(np.frombuffer(text.encode(), np.uint8)), 0.0
        rows = {}
        for n in toxicity.GRAMS:
            for k in range(len(low) - n + 1):
                row = int(mixed(ngrams(low[k : k + n], n) + np.uint64(n))[0]) >> (64 - toxicity.BITS)
                rows[row] = rows.get(row, 0) + 1
        total = sum(float(model.weight[r]) * min(c, toxicity.MOST) for r, c in rows.items()) + model.bias
        assert model(*packed([text]))[0] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-6)


def test_quality_scores_follow_from_the_gains():
    texts = ["plain and good words here", "@@ ## $$ 00 11", "more good words", "@@ @@ 0 0"] * 5
    model = quality.fit(*packed(texts), np.array([1.0, 0, 1, 0] * 5), 0.5)
    for text in (*texts[:4], "", "é good"):
        raw = np.frombuffer(text.encode(), np.uint8)
        rows = [int(span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) >> (64 - quality.BITS) for w in text.encode().split()]
        for n in quality.GRAMS:
            rows += [int(mixed(ngrams(raw[k : k + n], n))[0]) >> (64 - quality.BITS) for k in range(len(raw) - n + 1)]
        mean = sum(float(model.gain[r]) for r in rows) / max(1, len(rows))
        assert model(*packed([text]))[0] == pytest.approx(1 / (1 + math.exp(-mean - model.bias)), abs=1e-6)


def test_held_out_accuracy(spark):
    """On a table of ten thousand documents: of what is labelled and held out, toxic ones found, good ones kept."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    for score, label, least in ((toxicity.score_toxicity, "toxic", 0.8), (quality.score_quality, "quality", 0.95)):
        rows = score(docs, labels).where("held_out").join(labels.where(F.col(label).isNotNull()), "doc_id").groupBy(label, "predicted").count().collect()
        n = {(r[label], r.predicted): r["count"] for r in rows}
        assert n.get((1, 1), 0) >= least * (n.get((1, 1), 0) + n.get((1, 0), 0))
        assert n.get((0, 0), 0) >= (0.995 if label == "toxic" else 0.6) * (n.get((0, 0), 0) + n.get((0, 1), 0))


# WARC


class Told(io.BytesIO):
    """Counts the bytes of single reads, which are what is kept of a block."""

    largest = 0

    def read(self, n=-1):
        self.largest = max(self.largest, n)
        return super().read(n)


def record(kind, body):
    http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(body)
    return b"WARC/1.0\r\nWARC-Type: %s\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % (kind, len(http) + len(body)) + http + body + b"\r\n\r\n"


def test_unwanted_payloads_are_read_past():
    big = b"x" * (3 << 20)
    archive = record(b"response", big) + record(b"revisit", b"") + record(b"response", b"y")
    stream = Told(archive)
    assert [r[0] for r in warc.records(stream, [("record_type", {"revisit"})])] == ["revisit"]
    assert stream.largest <= 1 << 20
    stream = Told(archive)
    assert [(r[5], r[6]) for r in warc.records(stream, with_payload=False)] == [(len(big), None), (0, None), (1, None)]
    assert stream.largest <= 1 << 20
    assert [len(r[6] or b"") for r in warc.records(io.BytesIO(archive))] == [len(big), 0, 1]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(b"no archive\r\n")))


def test_predicates_are_pushed(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (3, "u", "b")], "page_id long, url string, html string")
    warc.write_warc(pages, f"file://{tmp_path}/w")
    some = warc.read_warc(spark, f"file://{tmp_path}/w").where((F.col("record_type") == "revisit") & F.col("record_id").isin("<urn:page:1>", "<urn:page:2>"))
    assert [r.record_id for r in some.collect()] == ["<urn:page:1>"]
    reader = warc.WarcReader({"path": "x"})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), In(("record_id",), ("a", "b")), GreaterThan(("http_length",), 3)]))
    assert reader.wanted == [("record_type", {"revisit"}), ("record_id", {"a", "b"})] and len(left) == 1


# Secrets


@pytest.fixture(scope="module")
def model(spark):
    return secrets.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_random_strings_are_found_and_ordinary_ones_are_not(model):
    draw = random.Random(42)
    for n, least in ((12, 0.95), (16, 0.97), (24, 0.99), (40, 0.99)):
        made = ["".join(draw.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=n)) for _ in range(300)]
        assert np.mean([secrets.spans(f"see {s}, then", model, 0.5) == [(4, 3, 4 + n)] for s in made]) >= least
    ordinary = "/usr/local/lib/python3/dist-packages getUserAccountSettingsFromDatabase MAX_RETRY_COUNT_PER_REQUEST com_google_protobuf_3_21_12 "
    ordinary += "org/apache/spark/sql/catalyst user_profile_picture_128x128 handle_http_response_404_error x86_64-unknown-linux-gnu mail8.example.com"
    assert secrets.spans(ordinary, model, 0.5) == []


def plain_spans(text):
    """Base matches by a scan of its own."""
    out = []
    for m in re.finditer("(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        out += [(m.start(), 0, m.end())] if len(m[2]) >= 6 else []
    for k, allowed, head, least in ((1, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "AKIA", 20), (2, "0123456789abcdef", "", 24)):
        i = 0
        while i < len(text):
            if text.startswith(head, i) and text[i] in allowed:
                j = i
                while j < len(text) and text[j] in allowed:
                    j += 1
                out += [(i, k, j)] if j - i >= least else []
                i = j
            else:
                i += 1
    return sorted(out)


def test_base_spans_equal_a_plain_scan():
    draw = random.Random(1)
    bits = ["password", "API_KEY", "apikey", "ſecret", "Token", "toKen", "=", ": ", '"', "'", " ", "AKIA", "AKIA" + "Q7" * 9, "0af" * 9, "é", "\n", "x.y-z", "=="]
    for _ in range(3000):
        text = "".join(draw.choice(bits) for _ in range(draw.randint(1, 14)))
        assert [(s, k, e) for s, k, e, _ in secrets.base_spans(text)] == plain_spans(text)


def test_redaction_and_the_rest_of_a_token(spark, model):
    key = "hT7qLw2ZpX9vRk4"
    text = f"{key}/{'0af1' * 6}/{key} and password=abcdef1 end"
    found = secrets.spans(text, model, 0.5)
    assert [k for _, k, _ in found] == [3, 2, 3, 0]
    assert secrets.replaced(text, found, "*") == "*".join(["", "", "", " and ", " end"])
    docs = spark.createDataFrame([(1, f"a {key}Yb8 b", 30), (2, None, None), (3, "calm", 4)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in secrets.find_secrets(docs, redact="[S]").collect()}
    assert got == {1: ("a [S] b", 7), 2: (None, None), 3: ("calm", 4)}


# Suffix rounds


def test_rounds_keep_order_and_common_prefixes():
    draw = random.Random(3)
    for _ in range(40):
        least = draw.randint(2, 6)
        strings = [bytes(draw.choice(b"ab") for _ in range(draw.randint(least, 14))) for _ in range(draw.randint(1, 12))]
        width = max(map(len, strings)) + 1
        rows = np.full((len(strings), width), 255, np.uint8)
        for i, s in enumerate(strings):
            rows[i, width - len(s) :] = np.frombuffer(s, np.uint8)
        at, common = suffixdedup.bwt_rounds(rows, least)
        flat = rows.ravel().tobytes()
        suffixes = [flat[p + 1 : (p // width + 1) * width] for p in at.tolist()]
        assert suffixes == sorted(suffixes) and len(suffixes) == len(strings) + sum(map(len, strings))
        for a, b, c in zip(suffixes, suffixes[1:], common[1:].tolist(), strict=False):
            k = 0
            while k < min(len(a), len(b), least) and a[k] == b[k]:
                k += 1
            assert k == c


def test_equal_hashes_of_other_bytes_are_told_apart():
    whole, at = b"aaaabbbbaaaacccc", np.array([0, 4, 8, 12])
    order, first = suffixdedup.equal_runs(whole, at, at + 4, np.zeros(4, int), np.zeros(4, np.uint64), np.array([5, 6, 1, 2]))
    assert [(whole[at[i] : at[i] + 4], bool(f)) for i, f in zip(order, first, strict=True)] == [(b"aaaa", True), (b"aaaa", False), (b"bbbb", True), (b"cccc", True)]
    assert order[0] == 2  # the smallest document of a run comes first


# Decontamination and top-k


def test_proximity(spark):
    texts = ["red x x green y blue", "red green", "blue red a b c d e f green", None, "green red BLUE", "red red blue green"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = decontaminate.build_index(decontaminate.keyed(docs), spark.createDataFrame([("red",), ("green",), ("blue",)], "term string"))
    for distance in (1, 2, 3, 5):
        got = {(r.doc_id, r.pos) for r in decontaminate.proximity_matches(index, ["green", "red", "blue"], distance).collect()}
        want = set()  # blue is the rarest term: it and green are in four texts, and blue comes first in order of text
        for i, t in enumerate(texts):
            w = (t or "").lower().split()
            for k, x in enumerate(w):
                near = w[max(0, k - distance) : k + distance + 1]
                if x == "blue" and "red" in near and "green" in near:
                    want.add((i, k))
        assert got == want
    assert decontaminate.proximity_matches(index, ["red", "none"], 9).count() == 0


def test_windows_of_any_length_and_other_letters(spark):
    docs = spark.createDataFrame([(1, "a b ÄB a b"), (2, "äb"), (3, "\u212a a"), (4, "one, TWO; three"), (5, "a")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b"), (2, "äb"), (3, "k"), (4, "one two three"), (5, "Äb a b")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.decontaminate(docs, items).collect()}
    code = lambda *x: hashlib.sha256(",".join(x).encode()).hexdigest()
    assert got == {1: (5, 5, 2, code("1", "5")), 2: (1, 1, 1, code("2")), 3: (2, 0, 0, code()), 4: (3, 3, 1, code("4")), 5: (1, 0, 0, code())}


def test_few_scores_are_resolved(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    n = vectors.count()
    found, collected = topk.search(vectors, F.col("vec_id") % 50 == 0, 5, 2, 256, 24)
    assert found.count() == 5 * (n // 50)
    assert collected.agg(F.sum(F.size("ids"))).first()[0] < 0.1 * n * (n // 50)


@pytest.mark.parametrize("kind", ["random", "path", "star", "none"])
def test_components(spark, kind):
    from hostsieve.llm.components import components

    draw = random.Random(9)
    edges = {"random": [(draw.randrange(90), draw.randrange(90)) for _ in range(60)], "path": [(k, k + 1) for k in range(40)], "star": [(7, k) for k in range(30)] * 2, "none": [(3, 3)]}[kind]
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in root)
