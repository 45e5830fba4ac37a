"""The labelled sample beside very long texts, and ids of texts that hold added tokens of a vocabulary."""

import json
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hostsieve.llm import idfiles, linear, packing, quality, toxicity
from hostsieve.llm.tokens import Encoder, pieces_of

SF = "/root/testdata/sf0.01"


def test_what_does_not_fit_is_passed_over():
    sizes = [(1, 10, 900), (2, 20, 100), (3, 30, 60), (4, 40, 950), (5, 50, 120)]
    assert linear.chosen_sizes(sizes, 1000, 200) == [2, 3, 5]  # the long ones don't fit any more
    assert linear.chosen_sizes(sizes, 1300, 200) == [2, 3, 5, 1]
    assert linear.chosen_sizes([(1, 1, 5000)], 1000, 200) == [1]  # a label is never empty
    assert linear.chosen_sizes([], 10, 1) == []


@pytest.fixture(scope="module")
def tables(spark):
    """The given documents and labels, and the same with a text of 7.5 MB of each label whose hash comes first."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rng = random.Random(2)
    ids = spark.range(10**6, 10**6 + 20_000).select(F.col("id"), F.xxhash64("id").alias("h"), linear.fold(F.col("id"), 3).alias("a"), linear.fold(F.col("id"), 5).alias("b"))
    first = [r.id for r in ids.where("a <> 1 and b <> 0").orderBy("h").limit(2).collect()]
    long = [" ".join(rng.choice(("alpha", "beta", "gamma", "delta")) for _ in range(1_300_000)) for _ in first]
    more = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in zip(first, long, strict=True)], docs.schema)
    marks = spark.createDataFrame([(first[0], 1, 1), (first[1], 0, 0)], "doc_id long, quality int, toxic int")
    return docs, labels, docs.unionByName(more), labels.select("doc_id", F.col("quality").cast("int"), F.col("toxic").cast("int")).unionByName(marks), first


@pytest.mark.parametrize(("score", "label"), [(quality.score_quality, "quality"), (toxicity.score_toxicity, "toxic")])
def test_a_long_labelled_text_leaves_the_model_as_it_is(spark, tables, score, label):
    docs, labels, more, marks, first = tables
    before = {r.doc_id: (r.score, r.predicted) for r in score(docs, labels).collect()}
    after = {r.doc_id: (r.score, r.predicted) for r in score(more, marks).collect()}
    assert len({s for s, _ in after.values()}) > 500
    changed = sum(before[i][1] != after[i][1] for i in before)
    assert changed <= 0.02 * len(before) and set(first) <= set(after)


def test_the_quality_stage_beside_a_long_text(spark, tables):
    _, _, more, marks, _ = tables
    kept = quality.keep_quality(more.drop("n_chars"), marks)
    good = marks.where("quality = 1").join(kept, "doc_id", "left_semi").count()
    assert good >= 0.95 * marks.where("quality = 1").join(more, "doc_id", "left_semi").count()
    bad = marks.where("quality = 0").join(more, "doc_id", "left_semi").count()
    assert marks.where("quality = 0").join(kept, "doc_id", "left_semi").count() <= 0.5 * bad


MARKED = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", "x<|startoftext|>y", "<|startoftext|> a <|endoftext|>", "<|ENDOFTEXT|> z", "< |endoftext|>", "plain text", "", "it's 12,345 <|endoftext|>'s"]


@pytest.mark.parametrize(("file", "end"), [("byte_bpe_50k.json", 2), ("word_bpe_49k.json", 1)])
def test_ids_of_added_tokens_are_the_librarys(file, end):
    path = public_tokenizers.path(file)
    library = Tokenizer.from_file(path)
    got = [np.frombuffer(ids, "<u4").tolist() for ids in Encoder(path).many(MARKED * 3, end)]
    assert got == [[*library.encode(t, add_special_tokens=False).ids, end] for t in MARKED * 3]
    library.encode_special_tokens = True
    got = [np.frombuffer(ids, "<u4").tolist() for ids in Encoder(path, plain=True).many(MARKED, end)]
    assert got == [[*library.encode(t, add_special_tokens=False).ids, end] for t in MARKED]


def test_queries_count_added_tokens_as_one(spark):
    df = spark.createDataFrame(list(enumerate(MARKED)), "doc_id long, text string")
    for rows, file, column in (
        (idfiles.read_ids(idfiles.write_ids(df, public_tokenizers.path("byte_bpe_50k.json"), 50_257)), "byte_bpe_50k.json", "n_tokens"),
        (packing.pack(df, public_tokenizers.path("word_bpe_49k.json")), "word_bpe_49k.json", "doc_tokens"),
    ):
        library = Tokenizer.from_file(public_tokenizers.path(file))
        assert {r.doc_id: r[column] for r in rows.collect()} == {k: len(library.encode(t, add_special_tokens=False).ids) + 1 for k, t in enumerate(MARKED)}


def test_the_file_and_not_its_name_says_how_it_splits(tmp_path):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    other = tmp_path / "word_bpe_49k.json"
    other.write_text(json.dumps(spec))
    assert pieces_of(Tokenizer.from_file(str(other))) == (None, False)
    assert all(pieces_of(Tokenizer.from_file(public_tokenizers.path(f)))[0] for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    library = Tokenizer.from_file(str(other))
    texts = ["two words", "  and more\n", "Ünïcode 12"]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in Encoder(str(other)).many(texts, 9)] == [[*library.encode(t, add_special_tokens=False).ids, 9] for t in texts]


def test_a_pack_sends_a_minimiser_once():
    from hostsieve.llm.suffixdedup import distinct

    rng = np.random.default_rng(3)
    m = rng.choice(rng.integers(0, 1 << 63, 40, dtype=np.uint64), 500)
    for buckets in (1, 8, 1000):
        to, low, first, times, place = distinct(m, buckets)
        want = {}
        for k, x in enumerate(m.tolist()):
            want.setdefault(((x >> 40) % buckets, x >> 8 & 0xFFFFFFFF), []).append(k)
        order = sorted(want, key=lambda key: (key[0], want[key][0]))
        assert list(zip(to.tolist(), low.tolist(), strict=True)) == order
        assert first.tolist() == [want[k][0] for k in order] and times.tolist() == [len(want[k]) for k in order]
        assert all(place[j] == i for i, k in enumerate(order) for j in want[k])
    assert all(len(x) == 0 for x in distinct(np.zeros(0, np.uint64), 8))


def test_a_passage_in_every_document(spark):
    """One line in all documents, some of them twice, and lines that a few share: the same bytes go as by brute force."""
    import hashlib

    from hostsieve.llm.suffixdedup import remove_repeats

    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    line, few = letters(180), [letters(120) for _ in range(10)]
    docs = [(k, f"{letters(60)}\n{line}\n{letters(40)}{rng.choice(few)}{letters(30)}" + (f"\n{line}" if k % 5 == 0 else "")) for k in range(120)]
    seen, want = set(), {}
    for k, text in docs:
        raw = text.encode()
        hit = np.zeros(len(raw), bool)
        windows = [raw[i : i + 50] for i in range(len(raw) - 49)]
        for i, w in enumerate(windows):
            if w in seen:
                hit[i : i + 50] = True
        seen.update(windows)
        want[k] = (int(hit.sum()), hashlib.sha256(np.frombuffer(raw, np.uint8)[~hit].tobytes()).hexdigest())
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in remove_repeats(df).collect()} == want
