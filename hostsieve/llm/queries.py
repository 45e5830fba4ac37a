"""The registered query of each operator, with production parameters, over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostsieve.llm.common import table
from hostsieve.llm.oracles import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hostsieve.llm.ngramjoin import similar_components

    return similar_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hostsieve.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hostsieve.llm.suffixdedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), length=50)


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hostsieve.llm.secrets import digest, find_secrets

    return digest(find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hostsieve.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hostsieve.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=1, size=2048)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hostsieve.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hostsieve.llm.decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), length=10)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hostsieve.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hostsieve.llm.idfiles import read_ids, write_ids

    listed = write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), vocabulary=50_257, end=2)
    return read_ids(listed)


def op11_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hostsieve.llm.private import digest, find_private

    return digest(find_private(table(spark, sf_dir, "documents"))[0])


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hostsieve.llm.filteraudit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hostsieve.llm.whitening import whiten

    found = whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation as long)"))  # null where no long holds it


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_join,
        op2_warc,
        op3_suffix_dedup,
        op4_secret_scans,
        op5_top_k,
        op6_packing,
        op7_toxicity,
        op8_decontamination,
        op9_quality,
        op10_token_ids,
        op11_private,
        op12_filter_audit,
        op13_whitening,
    )
}
