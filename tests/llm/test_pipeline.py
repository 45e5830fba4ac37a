"""Every stage of the corpus pipeline against plain Python, each on what the stage before kept."""

import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from hostsieve.llm import quality, secrets
from hostsieve.llm.common import table

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The given documents with some odd rows, and what each stage returns for them."""
    folder = str(tmp_path_factory.mktemp("stages"))
    docs = table(spark, SF, "documents")
    first = docs.where("text is not null").orderBy("doc_id").limit(3).collect()
    odd = [(first[0].doc_id, first[0].text), (10**9, first[1].text), (10**9 + 1, None), (10**9 + 2, ""), (None, first[2].text), (10**9 + 3, "password = hunter2hunter2 " + "calm words here " * 30)]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "odd", len(t or "")) for i, t in odd], docs.schema))
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return [x.collect() for x in out], [x.columns for x in out]


def test_columns(stages):
    rows, columns = stages
    assert all(c == columns[0] for c in columns[1:-1]) and columns[-1] != columns[0]


def test_quality(spark, stages):
    before, after = stages[0][0], stages[0][1]
    schema = table(spark, SF, "documents").schema
    model = quality.train(spark.createDataFrame(before, schema), table(spark, SF, "labels"))
    from hostsieve.llm.common import utf8
    import pyarrow as pa

    score = model(*utf8(pa.array([r.text for r in before], pa.string())))
    assert sorted(map(str, after)) == sorted(str(r) for r, s in zip(before, score, strict=True) if s >= 0.3)


def test_near_duplicates(stages):
    before, after = stages[0][1], stages[0][2]

    def shingles(text):
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = {}
    for r in before:
        if r.doc_id is not None:
            sets.setdefault(r.doc_id, set()).add(shingles(r.text))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and any(a and b and 100 * len(a & b) >= 80 * len(a | b) for a in sets[i] for b in sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    want = {(r.doc_id, r.text) for r in before if r.doc_id is not None and find(r.doc_id) == r.doc_id}
    kept = [(r.doc_id, r.text) for r in after if r.doc_id is not None]
    assert sorted(kept, key=str) == sorted(want, key=str)  # and each once
    assert sorted(str(r) for r in after if r.doc_id is None) == sorted(str(r) for r in before if r.doc_id is None)
    assert len(after) < len(before)


def test_decontamination(spark, stages):
    before, after = stages[0][2], stages[0][3]
    word = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW))
    windows = set()
    for r in table(spark, SF, "benchmark").collect():
        w = word(r.text)
        n = min(10, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    sizes = {len(x) for x in windows}

    def hit(text):
        w = word(text)
        return any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))

    gone = {r.doc_id for r in before if hit(r.text)} - {None}
    assert gone and sorted(map(str, after)) == sorted(str(r) for r in before if r.doc_id not in gone)


def test_secrets(stages):
    before, after = stages[0][3], stages[0][4]
    assert len(before) == len(after)
    texts = {}
    for r in after:
        texts.setdefault(str(r.doc_id), set()).add((r.text, r.n_chars))
    for r in before:
        found = [(s, k, e) for s, k, e, _ in secrets.base_spans(r.text)] if r.text else []
        want = secrets.replaced(r.text, found, "[SECRET]") if found else r.text
        assert (want, len(want) if found else r.n_chars) in texts[str(r.doc_id)]


def test_packing(stages):
    before, after = stages[0][4], stages[0][5]
    k = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    k.encode_special_tokens = True
    want = sorted((str(r.doc_id), len(k.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in before)
    assert sorted((str(r.doc_id), r.doc_tokens) for r in after if r.start == 0) == want
    used = {}
    for r in after:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert sum(used.values()) == sum(n for _, n in want) and all(n <= 2048 and (n == 2048 or n & (n - 1) == 0) for n in used.values())
