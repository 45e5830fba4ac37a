"""What depends on a line's name alone, made once for each distinct name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostsieve.functions import features as ft
from hostsieve.sources.shared import stored
from hostsieve.sources.tables import spread


def vectors(lines: DataFrame, most: int) -> DataFrame:
    """domain_name, c (its lines) and the features as one vector, for each distinct name; written, as it is read several times.

    most: how many names there can be. Names are counted first, which combines before it shuffles, and dealt anew, as
    counts are so small that Spark would give them to few tasks: by a hash, for by the name itself they lie already.
    """
    names = lines.groupBy("domain_name").agg(F.count("*").alias("c"))
    return stored(ft.feature_vector(spread(names, F.xxhash64("domain_name"), most)).select("domain_name", "c", "features"))


def by_name(df: DataFrame, names: DataFrame, order: list[str] = (), share: int = 10_000) -> DataFrame:
    """df with the further columns of a table of distinct names (domain_name, c: how many rows have it).

    Names of at least one in `share` rows, which are no more than `share`, are broadcast, so that no task takes all rows of
    a frequent name; rows of the others meet theirs in a shuffle, and stand in the order within their task.
    """
    df = stored(df)  # read twice, made once
    total = names.agg(F.sum("c")).first()[0] or 0
    often = F.col("c") * share >= total
    hot, rest = F.broadcast(names.where(often).drop("c")), names.where(~often).drop("c")
    rare = df.join(hot.select("domain_name"), "domain_name", "left_anti").join(rest, "domain_name")
    return df.join(hot, "domain_name").unionByName(rare.sortWithinPartitions(*order) if order else rare)
