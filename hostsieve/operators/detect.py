"""Warnings, alerts, status events, evaluation and training of the name classifier."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hostsieve.operators.numbering import numbered


def rule_probability() -> Column:
    """A rule in the place of a model: two labels and a high entropy."""
    hit = (F.col("label_length") == 2) & (F.col("fqdn_entropy") > 3.3)
    return F.when(hit, F.least(F.lit(1.0), F.col("fqdn_entropy") / 4)).otherwise(0.0)


def warnings(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows whose class 1 is likelier than class 0 and above the threshold."""
    return scored.where((F.col("p1") > 1 - F.col("p1")) & (F.col("p1") > threshold))


def alerts(found: DataFrame, model: str = "rule", sha256: str = "") -> DataFrame:
    """One alert for each suspicious batch with a warning: the median probability, distinct names and all warnings as JSON."""
    warning = F.struct(F.col("domain_name").alias("request"), F.round("p1", 6).alias("probability"), F.lit(model).alias("model"), F.lit(sha256).alias("sha256"))
    return found.groupBy("suspicious_batch_id", "batch_id", "client_ip").agg(
        F.median("p1").alias("overall_score"),
        F.array_sort(F.collect_set("domain_name")).alias("domain_names"),
        F.to_json(F.sort_array(F.collect_list(warning))).alias("result"),
        F.max("us").alias("alert_us"),
        F.count("*").alias("n_warnings"),
    )


def current_state(events: DataFrame) -> DataFrame:
    """The latest event of each key, by an aggregation that combines before it shuffles."""
    rest = [c for c in events.columns if c not in ("key", "us", "rank")]
    last = events.groupBy("key").agg(F.max_by(F.struct(*rest), F.struct("us", "rank")).alias("__last"))
    return last.select("key", "__last.*")


def stratified_split(df: DataFrame, label: str, key: str, shares: dict[str, float], seed: int = 108) -> DataFrame:
    """Adds split: within each class, rows in order of a seeded hash, cut exactly by the shares."""
    code = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    df = numbered(df.withColumn("__code", code), [label], F.substr("__code", F.lit(1), F.lit(3)), ["__code", key])
    out, at, column = list(shares), 0.0, None
    for name in out[:-1]:
        at += shares[name]
        test = F.col("__r") <= F.floor(F.col("__n") * at + 1e-9)
        column = F.when(test, name) if column is None else column.when(test, name)
    return df.withColumn("split", column.otherwise(out[-1])).drop("__r", "__n", "__code")


def label_codes(df: DataFrame, label: str = "class") -> DataFrame:
    """class and code: legit 0, others from 1 in order; binary is 1 for all but 0."""
    others = df.select(label).distinct()
    rank = F.row_number().over(W.partitionBy(F.col(label) == "legit").orderBy(label))
    code = F.when(F.col(label) == "legit", 0).otherwise(rank)
    return others.select(label, code.alias("code")).withColumn("binary", F.when(F.col("code") > 0, 1).otherwise(0))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))
    return counts.crossJoin(F.broadcast(total)).select(label, (F.col("total") / (F.col("classes") * F.col("n"))).alias("weight"))


def confusion(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn of the columns label and prediction."""
    cell = lambda y, p, n: F.count_if((F.col("label") == y) & (F.col("prediction") == p)).alias(n)
    return df.groupBy(*(by or [])).agg(cell(1, 1, "tp"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(0, 0, "tn"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def report(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1, and the share of false among reported and among true ones."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = {
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "fdr": ratio(fp, fp + tp),
        "fttar": ratio(fp, tp),
    }
    return confusion(df, by).withColumns({k: F.round(v, 6) for k, v in out.items()})


def classification_report(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class, their plain (macro) and weighted means, and the accuracy.

    All are expressions over the four cells of one confusion matrix, so the rows are read once; the accuracy stands in all
    three columns.
    """
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    every = tp + fp + fn + tn
    rates = lambda h, p, s: (ratio(h, p), ratio(h, s), ratio(2 * h, p + s))
    zero, one = rates(tn, tn + fn, tn + fp), rates(tp, tp + fp, tp + fn)
    s0, s1 = tn + fp, tp + fn
    rows = {
        "0": (zero, s0),
        "1": (one, s1),
        "accuracy": (rates(tp + tn, every, every), every),
        "macro": ([(a + b) / 2 for a, b in zip(zero, one, strict=True)], every),
        "weighted": ([ratio(a * s0 + b * s1, every) for a, b in zip(zero, one, strict=True)], every),
    }
    names = ("precision", "recall", "f1")
    made = [F.struct(F.lit(k).alias("class"), *(F.round(v, 6).alias(n) for n, v in zip(names, x, strict=True)), s.alias("support")) for k, (x, s) in rows.items()]
    return confusion(df).select(F.inline(F.array(*made)))


def scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns less their mean, in units of their sample standard deviation; constant ones become 0."""
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=columns, outputCol="__v", handleInvalid="keep").transform(df)
    model = StandardScaler(inputCol="__v", outputCol="__s", withMean=True).fit(rows)
    out = model.transform(rows).withColumn("__a", vector_to_array("__s"))
    return out.withColumns({c: F.get("__a", F.lit(i)) for i, c in enumerate(columns)}).drop("__v", "__s", "__a")


def clean_names(names: list[str]) -> list[str]:
    """Column names of letters, digits and underscores, told apart by a number where they would repeat."""
    out: list[str] = []
    for name in names:
        base = re.sub(r"\W+", "_", name.strip()).strip("_") or "column"
        made, k = base, 2
        while made in out:
            made, k = f"{base}_{k}", k + 1
        out.append(made)
    return out


def train(df: DataFrame, kind="rf", features: str = "features", label: str = "label", weight: str | None = None, validation: str | None = None, rounds: int | None = None):
    """A fitted forest (rf), boosted trees (gbt), or any estimator of the caller with features and label columns.

    validation: a boolean column; boosting ends when another round no longer lowers the loss of the rows where it is true,
    which are not fitted on. rounds: trees of a forest, or rounds of boosting at most.
    """
    from pyspark.ml import Estimator
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier

    if isinstance(kind, Estimator):
        make = kind.copy()
    elif kind == "rf":
        make = RandomForestClassifier(numTrees=rounds or 20, maxDepth=6, seed=108)
    elif kind == "gbt":
        make = GBTClassifier(maxIter=rounds or (100 if validation else 10), seed=108)
    else:
        raise ValueError(kind)
    if validation:
        if not make.hasParam("validationIndicatorCol"):
            raise ValueError(f"{kind} has no rounds that a validation column could end")
        make = make.setValidationIndicatorCol(validation)
    make = make.setFeaturesCol(features).setLabelCol(label)
    return (make.setWeightCol(weight) if weight else make).fit(df)


def tune(df: DataFrame, trials: int = 5, folds: int = 5, seed: int = 108, kind: str = "rf"):
    """Random search over forests (rf) or boosted trees (gbt) by cross validation, for the smallest share of false reports."""
    import random

    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator

    rng = random.Random(seed)
    if kind == "rf":
        model = RandomForestClassifier(seed=seed)
        draw = lambda: {model.numTrees: rng.choice((10, 20, 40)), model.maxDepth: rng.randint(3, 8)}
    elif kind == "gbt":
        model = GBTClassifier(seed=seed)
        draw = lambda: {model.maxIter: rng.choice((5, 10, 20)), model.maxDepth: rng.randint(2, 5), model.stepSize: rng.choice((0.05, 0.1, 0.3))}
    else:
        raise ValueError(kind)
    judge = MulticlassClassificationEvaluator(metricName="precisionByLabel", metricLabel=1.0)  # 1 - FDR
    return CrossValidator(estimator=model, estimatorParamMaps=[draw() for _ in range(trials)], evaluator=judge, numFolds=folds, parallelism=4, seed=seed).fit(df)


def detect(model, df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df)
    return out.withColumn("p1", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def leaves(model, names: list[str]) -> list[tuple[str, float]]:
    """The paths of the fitted trees as SQL predicates, with what their leaves add to the score: of boosted trees, the tree's
    weight times the leaf's value, so that a row's values together are half of its log odds; of forests, the class."""
    out, weights = [], model.treeWeights
    for tree, weight in zip(model.trees, weights, strict=True):
        stack = [(tree._call_java("rootNode"), [])]
        while stack:
            node, path = stack.pop()
            if node.getClass().getSimpleName() == "LeafNode":
                out.append((" AND ".join(path), weight * node.prediction()))
                continue
            split = node.split()
            test = f"`{names[split.featureIndex()]}`"
            stack += [(node.leftChild(), [*path, f"{test} <= {split.threshold()}"]), (node.rightChild(), [*path, f"{test} > {split.threshold()}"])]
    return out


def rules(model, names: list[str]) -> list[str]:
    """The predicates of the fitted trees' paths that speak for class 1, as SQL text."""
    return [path for path, value in leaves(model, names) if value > 0 and path]


def rule_quality(df: DataFrame, predicates: list[str], weight: str | None = None) -> DataFrame:
    """rule, support and precision of each predicate on a labelled table, in one pass; those that no row meets have 0.

    A row gives the numbers of the predicates that it meets, so the aggregate is as narrow for any number of them. weight:
    a column that says how many rows a row stands for; without it one.
    """
    met = F.filter(F.array(*(F.when(F.expr(p), F.lit(k)) for k, p in enumerate(predicates))).cast("array<int>"), lambda k: k.isNotNull())
    c = (F.col(weight) if weight else F.lit(1)).cast("long").alias("c")
    hits = df.select("label", c, F.explode(met).alias("k")).groupBy("k").agg(F.sum("c").alias("s"), F.sum(F.when(F.col("label") == 1, F.col("c")).otherwise(0)).alias("h"))
    rules = df.sparkSession.createDataFrame(list(enumerate(predicates)), "k int, rule string")
    s, h = (F.coalesce(c, F.lit(0)) for c in ("s", "h"))
    return rules.join(hits, "k", "left").select("rule", s.alias("support"), ratio(h, s).alias("precision"))


def checksum(spark, path: str) -> str:
    """SHA-256 over the relative names and hashes of a saved model's files; Spark reads them, so any store will do."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(~F.col("path").rlike(r"/[_.][^/]*$"))
    name = F.regexp_extract("path", r"/((?:metadata|data|treesMetadata|stages)/.*)$", 1)
    lines = files.select(F.concat_ws(" ", name, F.sha2("content", 256)).alias("line"))
    # a model's files are few, whatever it was fitted on
    return lines.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256)).first()[0]


def save_model(spark, model, path: str) -> str:
    """Writes the model to path/model and a manifest with its checksum to path/manifest; returns the checksum."""
    model.write().overwrite().save(f"{path}/model")
    code = checksum(spark, f"{path}/model")
    spark.createDataFrame([(code,)], "sha256 string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return code


def load_model(spark, cls, path: str, sha256: str | None = None):
    """The model at path, if its files still have the checksum of its manifest, and the wanted one if that is given."""
    code = spark.read.schema("sha256 string").json(f"{path}/manifest").first()[0]
    if checksum(spark, f"{path}/model") != code or sha256 not in (None, code):
        raise ValueError("the model's checksum differs")
    return cls.load(f"{path}/model")
