"""A training corpus from raw documents, in five stages; each reads the written result of the one before.

Quality classifier, near-duplicate removal, benchmark decontamination, secret redaction, packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hostsieve.llm.common import shared_dir, stored, table
from hostsieve.llm.decontaminate import decontaminate
from hostsieve.llm.ngramjoin import similar_components
from hostsieve.llm.packing import pack
from hostsieve.llm.quality import keep_quality
from hostsieve.llm.secrets import find_secrets


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the quality classifier accepts.

    Null and empty texts get the score of the model's bias, which says alike of all of them whether they stay; repeated
    rows stay or go alike; an empty table stays empty. Without usable labels all rows stay.
    """
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near duplicates, and all without words or doc_id.

    Five-word shingles and a similarity of 0.8. Rows that repeat a doc_id count as one document, and of rows that repeat
    a doc_id and its text one stays. An empty table stays empty.
    """
    found = similar_components(docs, n=5, percent=80)
    gone = stored(found.where("component_id <> doc_id").select("doc_id").distinct())
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    twice = stored(kept.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not twice.limit(1).count():
        return kept
    again = kept.join(twice, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return kept.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(again)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or a shorter item whole.

    Null and empty texts have no words and stay; rows with equal doc_id go together; an empty benchmark drops nothing. A
    null doc_id has no key to go by, so such rows stay.
    """
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    gone = found.where("contaminated and doc_id is not null").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret by a mark; n_chars follows. All rows stay, null and empty texts as they are."""
    return find_secrets(docs, redact="[SECRET]").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 tokens; returns the pieces.

    Null and empty texts are one piece, the end id; repeated rows are packed each for itself; an empty table gives none.
    """
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end=1, size=2048)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("packing", packing),
]

#: SQL can express neither the trained stages nor the tokenizer; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents and returns the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = shared_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
