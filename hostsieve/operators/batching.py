"""Per-subnet batches of lines, by number or by time, each with its predecessor's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hostsieve.operators.numbering import numbered, running_sums

ARRIVAL = ("us", "logline_id")


def by_size(lines: DataFrame, n: int, cell_us: int = 10_000_000) -> DataFrame:
    """Adds b, the number of the batch within its subnet: n lines each, in order of arrival.

    cell_us: the intervals that a subnet's lines are counted and numbered in.
    """
    rows = numbered(lines, ["subnet_id"], F.floor(F.col("us") / cell_us), list(ARRIVAL))
    return rows.withColumn("b", F.floor((F.col("__r") - 1) / n).cast("long")).drop("__r", "__n")


def by_time(lines: DataFrame, us: int) -> DataFrame:
    """Adds b, the number of the tumbling interval of us microseconds."""
    return lines.withColumn("b", F.floor(F.col("us") / us).cast("long"))


def batch_id(b="b") -> Column:
    return F.concat_ws("#", "subnet_id", F.col(b).cast("string"))


def bounds(batched: DataFrame) -> DataFrame:
    """A row for each batch: subnet_id, b, batch_id, begin_us, end_us, own lines n, and lines n0 of the batch before.

    The batch numbered one less comes along, if it exists. begin_us is that batch's first line, or else the own first
    one; end_us is the own last line.
    """
    own = batched.groupBy("subnet_id", "b").agg(F.min("us").alias("own_begin"), F.max("us").alias("end_us"), F.count("*").alias("n"))
    w = W.partitionBy("subnet_id").orderBy("b")  # a row for each batch
    before = F.lag("b").over(w) == F.col("b") - 1
    return own.select(
        "subnet_id",
        "b",
        batch_id().alias("batch_id"),
        F.when(before, F.lag("own_begin").over(w)).otherwise(F.col("own_begin")).alias("begin_us"),
        "own_begin",
        "end_us",
        "n",
        F.when(before, F.lag("n").over(w)).otherwise(0).alias("n0"),
    )


def overlap(batched: DataFrame, of: DataFrame) -> DataFrame:
    """Own lines (part 1) and, as part 0, those of the batch before, with the bounds of the batch they are in."""
    to = F.explode(F.array(F.struct(F.col("b").alias("b"), F.lit(1).alias("part")), F.struct((F.col("b") + 1).alias("b"), F.lit(0).alias("part"))))
    parts = batched.withColumn("__to", to).drop("b").select("*", "__to.b", "__to.part").drop("__to")
    return parts.join(of.select("subnet_id", "b", "batch_id", "begin_us", "end_us"), ["subnet_id", "b"])


def ordered(lines: DataFrame) -> DataFrame:
    """Adds pos: the place within the batch, the predecessor's lines first, each part in order of arrival."""
    w = W.partitionBy("batch_id").orderBy("part", *ARRIVAL)
    return lines.withColumn("pos", F.row_number().over(w))


def waiting(batched: DataFrame) -> DataFrame:
    """Adds message_count: how many lines of its batch have arrived with each line."""
    w = W.partitionBy("subnet_id", "b").orderBy(*ARRIVAL)
    return batched.withColumn("message_count", F.row_number().over(w).cast("long"))


def fill_changes(batched: DataFrame, of: DataFrame, bucket_us: int, dropped: DataFrame | None = None) -> DataFrame:
    """bucket, entry_type and d: by how much the lines in batches and in buffers change within each interval.

    A line adds one to the batches; a batch's last line moves all of them to the subnet's buffer, where they take the
    place of the batch before: column held of the bounds, or else the lines of the subnet's batch before. dropped: us and d
    of further changes to the buffers.
    """
    bucket = lambda c: F.floor(F.col(c) / bucket_us).cast("long").alias("bucket")
    change = lambda df, at, kind, d: df.select(bucket(at), F.lit(kind).alias("entry_type"), d.alias("d"))
    inside, buffered = "total_loglines_in_batches", "total_loglines_in_buffer"
    rows = change(batched, "us", inside, F.lit(1).cast("long")).unionByName(change(of, "end_us", inside, -F.col("n")))
    if "held" not in of.columns:
        of = of.withColumn("held", F.coalesce(F.lag("n").over(W.partitionBy("subnet_id").orderBy("b")), F.lit(0)))
    rows = rows.unionByName(change(of, "end_us", buffered, F.col("n") - F.col("held")))
    if dropped is not None:
        rows = rows.unionByName(change(dropped, "us", buffered, F.col("d")))
    return rows.groupBy("entry_type", "bucket").agg(F.sum("d").alias("d"))


def levels(changes: DataFrame) -> DataFrame:
    """bucket, entry_type and entry_count: the running sums of the changes, by ranges of intervals."""
    per = changes.groupBy("entry_type", "bucket").agg(F.sum("d").alias("d"))
    sums = running_sums(per, "bucket", ["d"], keys=["entry_type"])
    return sums.select("bucket", "entry_type", F.col("d").cast("long").alias("entry_count"))


def fill_levels(batched: DataFrame, of: DataFrame, bucket_us: int) -> DataFrame:
    """bucket, entry_type and entry_count: lines in batches and in buffers at the end of each interval with a change."""
    return levels(fill_changes(batched, of, bucket_us))
