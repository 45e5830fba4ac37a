"""Row numbers and running sums over large groups, in two steps: no task takes a whole group or table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hostsieve.sources.shared import stored


def numbered(df: DataFrame, keys: list[str], cell: Column, order: list[Column | str]) -> DataFrame:
    """Adds __r, a row's number from 1 within its keys in the order (cell, *order), and __n, the number of the keys' rows.

    cell cuts a group into ranges of its order, such as time intervals or leading digits of a hash. Rows are counted per
    cell, which combines before it shuffles; a running sum over the counts gives each cell's first number, and only the
    rows of one cell are sorted together. Null keys form a group of their own.
    """
    cells = df.withColumn("__cell", cell)
    counts = cells.groupBy(*keys, "__cell").agg(F.count("*").alias("__c"))
    sums = W.partitionBy(*keys).orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
    all_ = W.partitionBy(*keys)
    counts = counts.select(
        *(F.col(k).alias(f"__k{i}") for i, k in enumerate([*keys, "__cell"])),
        F.coalesce(F.sum("__c").over(sums), F.lit(0)).alias("__before"),
        F.sum("__c").over(all_).alias("__n"),
    )
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate([*keys, "__cell"])))
    within = W.partitionBy(*keys, "__cell").orderBy(*order)
    rows = cells.join(counts, same).withColumn("__r", F.col("__before") + F.row_number().over(within))
    return rows.drop("__cell", "__before", *(f"__k{i}" for i in range(len(keys) + 1)))


def running_sums(df: DataFrame, x: str, columns: list[str], parts: int | None = None, keys: list[str] = ()) -> DataFrame:
    """For distinct values x of each key in order: each column's sum up to it, its sum over all rows of the key as
    all_<column>, and the next x of the key as `next`; the keys come first.

    Rows are dealt to ranges of (keys, x) in one shuffle and written; a key's part of each range is summed by itself, and the
    ranges before it add their totals, of which there are as many as ranges and keys. Null keys are keys of their own.
    """
    keys = list(keys)
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(parts, *keys, x).withColumn("__part", F.spark_partition_id()))
    totals = dealt.groupBy("__part", *keys).agg(F.min(x).alias("__first"), *(F.sum(c).alias(f"__{c}") for c in columns))
    of_key = W.partitionBy(*(keys or [F.lit(0)]))  # a row for each range and key
    over = of_key.orderBy("__part")
    before, every = over.rowsBetween(W.unboundedPreceding, -1), of_key
    totals = totals.select(
        F.col("__part").alias("__p"),
        *(F.col(k).alias(f"__key_{k}") for k in keys),
        F.lead("__first").over(over).alias("__next"),
        *(F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__before_{c}") for c in columns),
        *(F.sum(f"__{c}").over(every).alias(f"all_{c}") for c in columns),
    )
    own = W.partitionBy("__part", *keys).orderBy(x)
    upto = own.rowsBetween(W.unboundedPreceding, 0)
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys), F.col("__part") == F.col("__p"))
    return dealt.join(totals, same).select(
        *keys,
        x,
        F.coalesce(F.lead(x).over(own), "__next").alias("next"),
        *((F.sum(c).over(upto) + F.col(f"__before_{c}")).alias(c) for c in columns),
        *(f"all_{c}" for c in columns),
    )
