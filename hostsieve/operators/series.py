"""Dense time series of batches, anomaly scores, and verdicts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hostsieve.sources.shared import stored

MODES = ("univariate", "multivariate", "ensemble")
SCORERS = ("zscore", "mad", "knn", "pot", "loda", "custom")


def check_inspection(mode: str, models: list[str]) -> list[str]:
    """The models to use: the first, or all in ensemble mode."""
    if mode not in MODES:
        raise NotImplementedError(f"mode {mode}")
    if not models or any(m not in SCORERS for m in models):
        raise NotImplementedError(f"models {models}")
    return models if mode == "ensemble" else models[:1]


def axis(batches: DataFrame, step_us: int, chunk: int = 1 << 16) -> DataFrame:
    """batch_id, step: the steps 0 to n - 1 of each batch, n = ceil((end - begin + step) / step).

    Steps are made in chunks, so that no array grows with a batch's length.
    """
    n = F.ceil((F.col("end_us") - F.col("begin_us") + step_us) / step_us).cast("long")
    parts = batches.select("batch_id", "begin_us", "end_us", n.alias("n_steps"))
    parts = parts.withColumn("__from", F.explode(F.expr(f"sequence(0L, n_steps - 1, {chunk}L)")))
    return parts.withColumn("step", F.explode(F.expr(f"sequence(__from, least(__from + {chunk - 1}, n_steps - 1))"))).drop("__from")


def _steps(lines: DataFrame, step_us: int) -> DataFrame:
    return lines.where("us >= begin_us and us <= end_us").withColumn("step", F.floor((F.col("us") - F.col("begin_us")) / step_us).cast("long"))


def series(batches: DataFrame, lines: DataFrame, step_us: int, compat: str | None = None) -> DataFrame:
    """batch_id, step, n (lines) and size (mean), zero where a step has no line; lines off the axis are left out.

    compat="last_distinct": a step counts only the lines at its last distinct timestamp.
    """
    placed = _steps(lines, step_us)
    if compat == "last_distinct":
        last = F.max("us").over(W.partitionBy("batch_id", "step"))
        placed = placed.withColumn("__last", last).where("us = __last").drop("__last")
    per = placed.groupBy("batch_id", "step").agg(F.count("*").alias("n"), F.avg(F.replace("size", F.lit("b"), F.lit("")).cast("int")).alias("size"))
    out = axis(batches, step_us).join(per, ["batch_id", "step"], "left")
    return out.select("batch_id", "step", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("size", F.lit(0.0)).alias("size"))


def normalised(score: Column) -> Column:
    return 1 - F.exp(-score / 3)


def _before(window: int | None) -> W:
    w = W.partitionBy("batch_id").orderBy("step")
    return w.rowsBetween(W.unboundedPreceding if window is None else -window, -1)


def zscore(x: str, window: int | None = 24, warm_up: int = 5) -> Column:
    """Distance from the mean of the steps before in standard deviations; window None: of all before."""
    w = _before(window)
    std = F.stddev_pop(x).over(w)
    raw = F.abs(F.col(x) - F.avg(x).over(w)) / std
    return F.when((F.count(x).over(w) < warm_up) | (std == 0), 0.0).otherwise(F.coalesce(raw, F.lit(0.0)))


def mad(x: str, window: int = 24, warm_up: int = 5) -> Column:
    """Distance from the median in scaled median absolute deviations."""
    seen = F.sort_array(F.collect_list(x).over(_before(window)))
    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  # f of a value that is made once
    middle = lambda a: (F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.floor(F.size(a) / 2).cast("int"))) / 2

    def of(a: Column) -> Column:
        deviation = lambda m: F.struct(m.alias("m"), (bound(F.sort_array(F.transform(a, lambda v: F.abs(v - m))), middle) * 1.4826).alias("d"))
        return F.when(F.size(a) >= warm_up, bound(middle(a), deviation))

    score = bound(bound(seen, of), lambda s: F.when(s["d"] > 0, F.abs(F.col(x) - s["m"]) / s["d"]))
    return F.coalesce(score, F.lit(0.0))


def knn(x: str, k: int = 3, window: int = 24, warm_up: int = 5) -> Column:
    """Mean distance to the k nearest of the steps before."""
    seen = F.collect_list(x).over(_before(window))
    near = F.slice(F.array_sort(F.transform(seen, lambda v: F.abs(v - F.col(x)).cast("double"))), 1, k)
    return F.when(F.size(seen) < max(k, warm_up), 0.0).otherwise(F.aggregate(near, F.lit(0.0), lambda s, v: s + v) / k)


def pot(df: DataFrame, x: str, q: float = 0.9, risk: float = 0.01) -> DataFrame:
    """Peaks over threshold, static; adds score, what a step exceeds its series' limit by, in units of the tail's scale.

    The tail is what exceeds the series' q-quantile t; a generalised Pareto distribution is fitted to the excesses by
    their mean m and variance v: shape g = (1 - m^2 / v) / 2, scale s = m (m^2 / v + 1) / 2, or an exponential one where
    v is 0. The limit is what is exceeded with the given risk. A series without excesses has scores of 0. The series are
    written once; quantiles and tails come from the counts of their values, which combine before they shuffle.
    """
    df = stored(df)
    values = stored(df.groupBy("batch_id", F.col(x).alias("__x")).agg(F.count("*").alias("__c")))
    start = values.groupBy("batch_id").agg(F.percentile("__x", F.lit(q), F.col("__c")).alias("__t"), F.sum("__c").alias("__all"))
    over, c, t = values.join(start, "batch_id").where("__x > __t"), F.col("__c"), F.col("__t")
    excess = F.col("__x") - t
    over = over.groupBy("batch_id", "__t", "__all").agg(F.sum("__c").alias("__k"), F.sum(excess * c).alias("__e"), F.sum(excess * excess * c).alias("__q"))
    over = over.withColumn("__m", F.col("__e") / F.col("__k")).withColumn("__v", F.col("__q") / F.col("__k") - F.col("__m") * F.col("__m"))
    ratio = F.when(F.col("__v") > 1e-9, F.pow("__m", F.lit(2)) / F.col("__v")).otherwise(1.0)
    tail = over.select("batch_id", "__t", ((1 - ratio) / 2).alias("__g"), (F.col("__m") * (ratio + 1) / 2).alias("__s"), (F.lit(risk) * F.col("__all") / F.col("__k")).alias("__p"))
    g, s, p = (F.col(n) for n in ("__g", "__s", "__p"))
    limit = t + F.when(F.abs(g) < 1e-9, -s * F.ln(p)).otherwise(s / g * (F.pow(p, -g) - 1))
    tail = stored(tail.select("batch_id", F.greatest(limit, t).alias("__limit"), "__s"))
    beyond = F.greatest(F.col(x) - F.col("__limit"), F.lit(0.0)) / s
    return df.join(tail, "batch_id", "left").withColumn("score", F.coalesce(beyond, F.lit(0.0))).drop("__limit", "__s")


def projections(columns: list[str], n: int, seed: int) -> list[list[float]]:
    """The weights of n random projections, the same for the same seed."""
    import random

    rng = random.Random(seed)
    return [[rng.gauss(0, 1) for _ in columns] for _ in range(n)]


def loda(df: DataFrame, columns: list[str], n: int = 10, bins: int = 20, seed: int = 1) -> DataFrame:
    """Random projections of standardised columns with histograms over the table; adds score, the mean negative log density.

    The rows are written once with their bins. The histograms combine before they shuffle, and each is joined by itself, so
    a row never moves where Spark finds a histogram small enough to broadcast.
    """
    stats = df.agg(*(f(c).alias(f"{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))), F.count("*").alias("n")).first()
    parts = []
    for w in projections(columns, n, seed):
        parts.append(sum(((F.col(c) - F.lit(stats[f"m_{c}"])) / (stats[f"s_{c}"] or 1.0) * v for c, v in zip(columns, w, strict=True)), F.lit(0.0)))
    df = stored(df.withColumns({f"__b{k}": F.floor(p * bins / 6) for k, p in enumerate(parts)}))
    long = df.select(F.posexplode(F.array(*(f"__b{k}" for k in range(n)))).alias("p", "bin"))
    density = stored(long.groupBy("p", "bin").agg(F.count("*").alias("c")))
    for k in range(n):
        own = density.where(F.col("p") == k).select(F.col("bin").alias(f"__b{k}"), (-F.log(F.col("c") / stats["n"])).alias(f"__d{k}"))
        df = df.join(own, f"__b{k}")
    score = sum((F.col(f"__d{k}") for k in range(n)), F.lit(0.0)) / n
    return df.withColumn("score", score).drop(*(f"__{x}{k}" for x in "bd" for k in range(n)))


def custom(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], columns: str = "batch_id string, step long, n long, size double") -> DataFrame:
    """Scores each series by a function of its frame, ordered by step."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("step")
        return frame.assign(score=scorer(frame))

    return df.groupBy("batch_id").applyInPandas(run, f"{columns}, score double")


#: What each model adds to a series as the column score; further ones by custom().
MODELS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "zscore": lambda df: df.withColumn("score", normalised(zscore("n"))),
    "mad": lambda df: df.withColumn("score", normalised(mad("n"))),
    "knn": lambda df: df.withColumn("score", normalised(knn("n"))),
    "pot": lambda df: pot(df, "n").withColumn("score", normalised(F.col("score"))),
    "loda": lambda df: loda(df, ["n", "size"]).withColumn("score", normalised(F.col("score"))),
}
#: The models that see more than the number of lines.
MANY = ("loda",)


def scorer(mode: str, models: list[str], combine: str = "weight", threshold: float = 0.5, own: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame], DataFrame]:
    """The function that adds score to series (batch_id, step, n, size) by the named models.

    univariate and multivariate take the first model, which must be of that kind; ensemble takes all, as the mean of
    their scores (weight) or the share of those that reach the threshold (vote). own: what the model named custom does.
    """
    models = check_inspection(mode, models)
    if combine not in ("weight", "vote"):
        raise NotImplementedError(f"combine {combine}")
    if mode == "univariate" and models[0] in MANY or mode == "multivariate" and models[0] not in (*MANY, "custom"):
        raise NotImplementedError(f"{models[0]} is not {mode}")
    if "custom" in models and own is None:
        raise ValueError("the model custom needs a function")
    steps = [(m, own if m == "custom" else MODELS[m]) for m in models]

    def score(df: DataFrame) -> DataFrame:
        if len(steps) == 1:
            return steps[0][1](df)
        for name, step in steps:
            df = step(df).withColumnRenamed("score", f"__{name}")
        names = [f"__{name}" for name, _ in steps]
        column = weighted(dict.fromkeys(names, 1.0)) if combine == "weight" else vote(names, threshold)
        return df.withColumn("score", column).drop(*names)

    return score


def weighted(scores: dict[str, float]) -> Column:
    return sum((F.col(c) * w for c, w in scores.items()), F.lit(0.0)) / sum(scores.values())


def vote(scores: list[str], threshold: float) -> Column:
    return sum((F.when(F.col(c) >= threshold, 1.0).otherwise(0.0) for c in scores), F.lit(0.0)) / len(scores)


def suspicious(scored: DataFrame, score_threshold: float = 0.5, anomaly_threshold: float = 0.01) -> DataFrame:
    """batch_id and share for each batch whose share of anomalous steps is above the threshold."""
    share = scored.groupBy("batch_id").agg(F.avg(F.when(F.col("score") >= score_threshold, 1.0).otherwise(0.0)).alias("share"))
    return share.where(F.col("share") > anomaly_threshold)


def by_client(lines: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The lines of suspicious batches with suspicious_batch_id, one for each batch and client."""
    lines = lines.join(verdicts.select("batch_id"), "batch_id")
    return lines.withColumn("suspicious_batch_id", F.md5(F.concat_ws("|", "batch_id", "client_ip")))
