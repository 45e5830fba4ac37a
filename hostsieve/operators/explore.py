"""Numbers for exploring features, and the questions of the dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hostsieve.operators.numbering import running_sums
from hostsieve.sources.shared import stored


def cdfs(df: DataFrame, x: str, label: str = "label") -> DataFrame:
    """x, both classes' cumulative shares at each distinct value, the next value, and both classes' rows."""
    per = df.groupBy(F.col(x).alias("x")).agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"))
    share = lambda c: F.try_divide(F.col(c), F.col(f"all_{c}"))
    return running_sums(per.where("x is not null"), "x", ["n0", "n1"]).select("x", "next", share("n0").alias("cdf0"), share("n1").alias("cdf1"), "all_n0", "all_n1")


def ks(df: DataFrame, x: str) -> DataFrame:
    """The Kolmogorov-Smirnov statistic, the sample sizes and the asymptotic p-value."""
    d = cdfs(df, x).agg(F.max(F.abs(F.col("cdf0") - F.col("cdf1"))).alias("statistic"), F.max("all_n0").alias("n0"), F.max("all_n1").alias("n1"))
    p = 2 * F.exp(-2 * F.pow("statistic", F.lit(2)) * F.col("n0") * F.col("n1") / (F.col("n0") + F.col("n1")))
    return d.withColumn("p_value", F.least(F.lit(1.0), p))


def emd(df: DataFrame, x: str) -> DataFrame:
    """The earth mover's distance between the classes' values."""
    gap = F.col("next") - F.col("x")
    return cdfs(df, x).agg(F.sum(F.abs(F.col("cdf0") - F.col("cdf1")) * gap).alias("emd"))


def long_form(df: DataFrame, columns: list[str], label: str = "label", weight: str | None = None) -> DataFrame:
    """feature, x, label and c: a row for each column of each row; null values are left out.

    weight: a column that says how many rows a row stands for, which c repeats; without it c is 1.
    """
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns))).alias("__f")
    c = F.col(weight) if weight else F.lit(1)
    return df.select(F.col(label).alias("label"), c.cast("long").alias("c"), each).select("__f.feature", "__f.x", "label", "c").where("x is not null")


def distances(df: DataFrame, columns: list[str], weight: str | None = None) -> DataFrame:
    """For each column: the Kolmogorov-Smirnov statistic of the two classes, its asymptotic p-value, the sample sizes, and
    the earth mover's distance. weight: see long_form().

    Values are counted per column and class, which combines before it shuffles; what is dealt to ranges after that is the
    distinct values.
    """
    of = lambda k: F.sum(F.when(F.col("label") == k, F.col("c")).otherwise(0)).alias(f"n{k}")
    per = long_form(df, columns, weight=weight).groupBy("feature", "x").agg(of(0), of(1))
    sums = running_sums(per, "x", ["n0", "n1"], keys=["feature"])
    gap = F.abs(F.try_divide("n0", "all_n0") - F.try_divide("n1", "all_n1"))
    sums = sums.groupBy("feature").agg(F.max(gap).alias("statistic"), F.max("all_n0").alias("n0"), F.max("all_n1").alias("n1"), F.sum(gap * (F.col("next") - F.col("x"))).alias("emd"))
    p = 2 * F.exp(-2 * F.pow("statistic", F.lit(2)) * F.col("n0") * F.col("n1") / (F.col("n0") + F.col("n1")))
    return sums.withColumn("p_value", F.least(F.lit(1.0), p))


def histograms(df: DataFrame, columns: list[str], bins: int = 30, weight: str | None = None) -> DataFrame:
    """feature, label, bin and n: rows of each class in equal bins from each column's smallest to its largest value.
    weight: see long_form()."""
    per = stored(long_form(df, columns, weight=weight).groupBy("feature", "x", "label").agg(F.sum("c").alias("c")))
    ends = per.groupBy("feature").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    place = F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * bins) + 1
    column = F.when(F.col("high") == F.col("low"), 1).otherwise(F.least(place, F.lit(bins))).cast("long")
    return per.join(ends, "feature").groupBy("feature", "label", column.alias("bin")).agg(F.sum("c").alias("n"))


def explained(model) -> list[float]:
    """The share of the variance of each component of a fitted pca()."""
    return [float(v) for v in model.explainedVariance]


def histogram(df: DataFrame, x: str, low: float, high: float, bins: int = 30) -> DataFrame:
    return df.groupBy("label", F.width_bucket(F.col(x).cast("double"), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def clip_outliers(df: DataFrame, x: str, q: float = 0.99) -> DataFrame:
    """Drops values above the class's quantile; infinities count as null."""
    df = df.withColumn(x, F.when(F.abs(x) < float("inf"), F.col(x)))
    limit = df.groupBy("label").agg(F.percentile(x, F.lit(q)).alias("__limit"))
    return df.join(limit, "label").where(F.col(x) <= F.col("__limit")).drop("__limit")


def pca(df: DataFrame, features: str = "features", k: int = 2):
    """The fitted model, whose explainedVariance gives the components' shares, and df with its components."""
    from pyspark.ml.feature import PCA, StandardScaler

    centred = StandardScaler(inputCol=features, outputCol="__c", withMean=True, withStd=False).fit(df).transform(df)
    model = PCA(k=k, inputCol="__c", outputCol="components").fit(centred)
    return model, model.transform(centred).drop("__c")


def percentiles(df: DataFrame, key: str, x: str, *more: Column) -> DataFrame:
    """key, n, and the median, 95th and 99th percentile and maximum of x for each key."""
    at = lambda q, name: F.percentile_approx(x, q).alias(name)
    return df.groupBy(key).agg(F.count("*").alias("n"), *more, at(0.5, "p50"), at(0.95, "p95"), at(0.99, "p99"), F.max(x).alias("most"))


def date_of(us: Column) -> Column:
    """The day of a wall-clock time in microseconds."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(us / 86_400_000_000).cast("int"))


def month_of(us: Column) -> Column:
    """Months since the year 0."""
    return (F.year(date_of(us)) * 12 + F.month(date_of(us)) - 1).cast("long")


def granularity(seconds: Column) -> Column:
    return F.when(seconds <= 300, "second").when(seconds <= 21_600, "minute").when(seconds <= 259_200, "hour").otherwise("day")


def filled(ends: DataFrame, name: str, chunk: int = 1 << 16) -> DataFrame:
    """The numbers from a to b of each row, made in chunks, so that no array grows with their range."""
    parts = ends.withColumn("__from", F.explode(F.expr(f"sequence(a, b, {chunk})")))
    return parts.select(F.explode(F.expr(f"sequence(__from, least(__from + {chunk - 1}, b))")).alias(name))


def over_time(alerts: DataFrame, bucket_us: int) -> DataFrame:
    """Alerts per interval from the first to the last, intervals without any as 0."""
    per = alerts.groupBy(F.floor(F.col("alert_us") / bucket_us).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    ends = per.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).where("a is not null")
    every = filled(ends, "bucket")
    return every.join(per, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def heatmap(alerts: DataFrame, row: Column, column: Column, values: list[int], prefix: str) -> DataFrame:
    """Counts by row, one column for each value; rows between the first and the last are filled."""
    per = alerts.select(row.alias("r"), column.alias("c")).groupBy("r").agg(*(F.count_if(F.col("c") == v).alias(f"{prefix}{v}") for v in values))
    ends = per.agg(F.min("r").alias("a"), F.max("r").alias("b")).where("a is not null")
    every = filled(ends, "r")
    return every.join(per, "r", "left").na.fill(0)


def latest(alerts: DataFrame, n: int = 20) -> DataFrame:
    """The latest n distinct pairs of client and names."""
    names = F.array_join("domain_names", ", ")
    return alerts.groupBy("client_ip", names.alias("names")).agg(F.max("alert_us").alias("alert_us")).orderBy(F.desc("alert_us"), "client_ip", "names").limit(n)


def top_clients(lines: DataFrame, alerts: DataFrame, n: int = 5) -> DataFrame:
    """The alerting clients with most requests of any kind, ranked."""
    some = lines.join(alerts.select("client_ip").distinct(), "client_ip", "left_semi")
    best = some.groupBy("client_ip").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "client_ip").limit(n)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "client_ip")))


def principal_removed(df: DataFrame, x: list[str], component: list[float]) -> DataFrame:
    """Each row less its part along one unit vector."""
    dot = sum((F.col(c) * v for c, v in zip(x, component, strict=True)), F.lit(0.0))
    return df.withColumns({c: F.col(c) - dot * v for c, v in zip(x, component, strict=True)})
