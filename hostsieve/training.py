"""Training, testing and explaining the name classifier, as functions and as a script for spark-submit.

    spark-submit hostsieve/training.py train --dataset labelled-csv --path names.csv --label malicious --model-path models/a
    spark-submit hostsieve/training.py test --dataset parquet --path names.parquet --model-path models/a
    spark-submit hostsieve/training.py explain --dataset parquet --path names.parquet --model-path models/a
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostsieve.functions import features as ft
from hostsieve.operators import detect
from hostsieve.sources import tables
from hostsieve.sources.shared import stored

Reader = Callable[[SparkSession, str], DataFrame]


def readers(label: str | None = None, pattern: str = r"([^/_]+)\.csv$", max_rows: int | None = None) -> dict[str, Reader]:
    """The readers of the known kinds of datasets by name; each gives query and class."""
    return {
        "labelled-csv": lambda spark, path: tables.read_labelled_csv(spark, path, label),
        "named-csv": lambda spark, path: tables.read_named_csvs(spark, path, pattern, max_rows),
        "parquet": tables.read_parquet_names,
        "log": tables.read_spaced_log,
        "csv": lambda spark, path: tables.load_dataset(spark, path),
    }


def prepared(names: DataFrame) -> DataFrame:
    """Distinct names (query, class) with label and features; all classes but legit are 1."""
    rows = ft.preprocess(names).withColumn("domain_name", F.col("query"))
    return ft.feature_vector(rows.withColumn("label", F.when(F.col("class") == "legit", 0.0).otherwise(1.0)))


def train_model(names: DataFrame, path: str, kind="rf", tune: bool = False, fit_on: list[str] | None = None) -> str:
    """Fits a classifier on four fifths of each class and saves it at path; returns its checksum. Of united datasets
    (column dataset), fit_on chooses which are fitted; without it all are. Boosted trees (gbt) end at the round from which
    another tenth of each class gains nothing."""
    if fit_on is not None:
        names = names.where(F.col("dataset").isin(fit_on))
    rows = detect.stratified_split(prepared(names), "class", "query", {"train": 0.8, "valid": 0.1, "test": 0.1})
    rows = stored(rows.select("features", "label", "split"))
    fitted = rows.where("split = 'train'")
    if tune:
        model = detect.tune(fitted, kind=kind).bestModel
    elif kind == "gbt":
        seen = rows.where("split <> 'test'").withColumn("valid", F.col("split") == "valid")
        model = detect.train(seen, kind, validation="valid")
    else:
        model = detect.train(fitted, kind)
    return detect.save_model(names.sparkSession, model, path)


def test_model(names: DataFrame, path: str, cls=None, sha256: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The report of a saved classifier on a dataset, and the names that it gets wrong."""
    judged = detect.detect(_load(names.sparkSession, path, cls, sha256), prepared(names))
    judged = stored(judged.select("query", "class", F.col("label").cast("int").alias("label"), (F.col("p1") >= 0.5).cast("int").alias("prediction")))
    return detect.report(judged), judged.where("label <> prediction")


def explain_model(names: DataFrame, path: str, cls=None, sha256: str | None = None) -> DataFrame:
    """The rules of saved trees with their support and precision on a dataset."""
    model = _load(names.sparkSession, path, cls, sha256)
    return detect.rule_quality(prepared(names), detect.rules(model, list(ft.all_features())))


def _load(spark: SparkSession, path: str, cls, sha256: str | None):
    from pyspark.ml.classification import RandomForestClassificationModel

    return detect.load_model(spark, cls or RandomForestClassificationModel, path, sha256)


def main(args: list[str] | None = None) -> None:
    options = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    options.add_argument("command", choices=("train", "test", "explain"))
    options.add_argument("--dataset", required=True, choices=sorted(readers()))
    options.add_argument("--path", required=True)
    options.add_argument("--label")
    options.add_argument("--max-rows", type=int)
    options.add_argument("--model", default="rf", choices=("rf", "gbt"))
    options.add_argument("--model-path", required=True)
    o = options.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    names = tables.load_dataset(spark, o.path, readers(o.label, max_rows=o.max_rows)[o.dataset])
    cls = None
    if o.model == "gbt":
        from pyspark.ml.classification import GBTClassificationModel as cls
    if o.command == "train":
        print(train_model(names, o.model_path, o.model))
    elif o.command == "test":
        report, wrong = test_model(names, o.model_path, cls)
        report.show(truncate=False)
        wrong.show(truncate=False)
    else:
        explain_model(names, o.model_path, cls).show(truncate=False)


if __name__ == "__main__":
    main()
