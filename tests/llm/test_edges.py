"""Nulls in every column, empty and very long texts, repeated rows, empty tables and clashing columns, for each operator."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from hostsieve.llm import decontaminate, idfiles, ngramjoin, packing, quality, secrets, suffixdedup, topk, toxicity, warc
from hostsieve.llm.linear import fold

WORDS = ["alpha", "beta", "gamma", "delta", "Über", "naïve", "zeta", "eta"]
CLASH = "doc_id long, text string, secret_spans string, held_out string, component_id string, bucket long, label int, start long, term string"


def documents(spark):
    rng = random.Random(4)
    body = " ".join(rng.choice(WORDS) for _ in range(120))
    rows = [(1, body), (1, body), (2, body), (None, body), (3, None), (None, None), (4, ""), (5, "x" * 200_000), (6, body + " tail"), (1, "other words here " * 20), (7, " \n\t ")]
    return spark.createDataFrame([(i, t, "c", "c", "c", 1, 2, 3, "t") for i, t in rows], CLASH)


def labels(spark):
    return spark.createDataFrame([*((i, i % 2, i // 2 % 2) for i in range(8)), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")


def bench(spark):
    return spark.createDataFrame([(1, "alpha beta"), (2, None), (None, "tail"), (3, ""), (4, "zzz yyy xxx")], "item_id long, text string")


RUNS = {
    "op1": lambda spark, d: ngramjoin.similar_components(d, 4, 85),
    "op3": lambda spark, d: suffixdedup.remove_repeats(d),
    "op4": lambda spark, d: secrets.digest(secrets.find_secrets(d)),
    "op6": lambda spark, d: packing.pack(d, public_tokenizers.path("word_bpe_49k.json")),
    "op7": lambda spark, d: toxicity.score_toxicity(d, labels(spark)),
    "op8": lambda spark, d: decontaminate.decontaminate(d, bench(spark)),
    "op9": lambda spark, d: quality.score_quality(d, labels(spark)),
    "op10": lambda spark, d: idfiles.read_ids(idfiles.write_ids(d, public_tokenizers.path("byte_bpe_50k.json"), 50_257)),
}


@pytest.mark.parametrize("op", RUNS)
def test_odd_rows(spark, op):
    docs = documents(spark)
    got = RUNS[op](spark, docs).collect()
    ids = sorted(map(str, (r.doc_id for r in docs.collect())))
    if op == "op6":
        whole = [r for r in got if r.start == 0]
        assert sorted(str(r.doc_id) for r in whole) == ids  # one first piece for each row
        assert [r.doc_tokens for r in whole if r.doc_id in (3, 4)] == [1, 1]
        return
    assert sorted(str(r.doc_id) for r in got) == ids
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    if op == "op1":  # documents 1 (two texts), 2 and 6 are one group; what has no id or words has none
        assert {i: {r.component_id for r in rs} for i, rs in by.items()} == {1: {1}, 2: {1}, 6: {1}, None: {None}, 3: {3}, 4: {4}, 5: {5}, 7: {7}}
        assert [r.n_shingles for r in by[3] + by[4] + by[7]] == [0, 0, 0] and by[5][0].n_shingles == 1
    if op == "op3":
        assert {r.n_removed for r in by[1] + by[None] if r.n_bytes} >= {0} and by[2][0].n_removed == by[2][0].n_bytes
        assert by[5][0].n_removed == 0 and by[5][0].n_bytes == 200_000
    if op in ("op7", "op9"):
        assert all(0 <= r.score <= 1 for r in got) and len({r.score for r in by[3] + by[4]}) == 1
        assert op == "op7" or len({r.score for r in by[1]}) == 2  # two texts
    if op == "op8":
        assert by[3][0].n_words == by[4][0].n_words == by[7][0].n_words == 0 and by[6][0].contaminated
        assert {r.n_words for r in by[1]} == {120, 60}


@pytest.mark.parametrize("op", RUNS)
def test_empty_table(spark, op):
    assert RUNS[op](spark, documents(spark).limit(0)).count() == 0


def test_empty_labels_and_benchmark(spark):
    docs = documents(spark)
    assert {r.score for r in toxicity.score_toxicity(docs, labels(spark).limit(0)).collect()} == {0.5}
    assert {r.score for r in quality.score_quality(docs, labels(spark).limit(0)).collect()} == {0.5}
    assert not any(r.contaminated for r in decontaminate.decontaminate(docs, bench(spark).limit(0)).collect())


def test_odd_vectors(spark):
    kind = "vec_id long, embedding array<double>, score string, rank int"
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0]), (2, [1.0, 2.0]), (3, None), (None, [1.0, 1.0]), (4, []), (5, [float("inf"), 1.0])]
    vectors = spark.createDataFrame([(i, v, "s", 1) for i, v in rows], kind)
    got = [tuple(r) for r in topk.top_k(vectors, F.col("vec_id") % 50 == 0).collect()]
    big = 256 * 256
    assert sorted(got) == [(0, 1, 2, 5 * big), (0, 2, 1, big), (0, 3, 4, 0)]
    assert topk.top_k(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_odd_pages(spark):
    kind = "page_id long, url string, html string, record_type string, digest string"
    rows = [(1, "http://a", "x"), (2, "http://a\r\n", "x"), (2, None, "x"), (None, "u", "x"), (3, "u", None), (4, "u", "y" * 300_000), (5, "u", "y" * 300_000)]
    pages = spark.createDataFrame([(i, u, h, "c", "d") for i, u, h in rows], kind)
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=str)
    want = [(1, 1, "revisit", 2), (2, 1, "response", None), (2, 1, "response", None), (3, 0, "response", None), (4, 300_000, "revisit", 5), (5, 300_000, "response", None), (None, 1, "revisit", 2)]
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_held_out_rows_teach_nothing(spark):
    docs = spark.createDataFrame([(i, ("good words " if i % 2 else "bad stuff ") * 5 + str(i)) for i in range(60)], "doc_id long, text string")
    ids = [r.doc_id for r in docs.where(fold(F.col("doc_id"), 3) == 1).select("doc_id").collect()]
    base = docs.select("doc_id", F.lit(0).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))
    turned = base.withColumn("toxic", F.when(F.col("doc_id").isin(ids), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = ({r.doc_id: r.score for r in toxicity.score_toxicity(docs, x).collect()} for x in (base, turned))
    assert one == two
