"""The pipeline under Structured Streaming: lines to per-subnet batches with state, then all stages per finished batch.

start() runs one query. Lines are split and tested once; valid ones gather in the state of their subnet, failed and late ones
pass it by. What a trigger finishes goes through the stages in foreachBatch, which writes every monitoring table to a folder
of the trigger's number and overwrites it if the trigger runs again, so a restart neither loses nor repeats anything.
Lines are archived with their batch. Nothing else is left in shared storage: intermediate results are persisted only.

    live.configure(spark)
    live.start(tables.tail_lines(spark, "/var/log/dns"), "/out", Options(batch_lines=10_000))
    live.read_results(spark, "/out", "alerts")
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from hostsieve.operators.explore import percentiles
from hostsieve.plans import flow
from hostsieve.plans.flow import Finished, Flow, Options
from hostsieve.sources import tables
from hostsieve.sources.jsonlines import JsonLines
from hostsieve.streaming.gather import APART, INPUT, OUTPUT, Gather

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The tables that a stage writes, in the order in which stages run.
STAGES = {
    flow.COLLECTOR: ("server_logs", "server_logs_timestamps", "failed_dns_loglines", "dns_loglines"),
    flow.BATCHES: ("batches", "logline_to_batches", "fill_changes"),
    flow.INSPECTOR: ("scored", "batch_timestamps"),
    flow.DETECTOR: ("suspicious_batches_to_batch", "suspicious_batch_timestamps", "warnings", "alerts", "logline_timestamps"),
}
TIMES = "stage string, trigger long, rows long, began_us long, ended_us long"


def configure(spark: SparkSession) -> None:
    """Sets the session option that state with lists and timers needs: RocksDB as the state store."""
    spark.conf.set(PROVIDER, ROCKS)


def arrivals(lines: DataFrame, options: Options) -> DataFrame:
    """subnet_id and the columns of gather.INPUT: valid lines by subnet, failed ones dealt to keys of their own.

    Lines of a tailed file have an id made of their place; others get one at random. Without a time of arrival it is the
    trigger's.
    """
    lines = tables.clean_lines(lines)
    place = F.sha2(F.concat_ws(":", "path", "offset"), 256) if {"path", "offset"} <= set(lines.columns) else F.expr("uuid()")
    lines = lines if "logline_id" in lines.columns else lines.withColumn("logline_id", place)
    lines = lines if "arrival_us" in lines.columns else lines.withColumn("arrival_us", F.unix_micros(F.current_timestamp()))
    rows = options.format.parse(lines.select("value", F.col("logline_id").cast("string").alias("logline_id"), "arrival_us"))
    good = F.size("invalid_fields") == 0
    clock = next(f for f in options.format.fields if f.name == "timestamp")
    apart = F.concat(F.lit(APART), F.pmod(F.xxhash64("logline_id"), F.lit(64)).cast("string"))
    return rows.select(
        F.when(good, flow.subnet_id(F.col("client_ip"), options.prefix4, options.prefix6)).otherwise(apart).alias("subnet_id"),
        F.when(good, "line").otherwise("failed").alias("kind"),
        F.coalesce(F.when(good, flow.micros(F.col("timestamp"), clock.arg)), F.lit(-1)).alias("us"),
        "logline_id",
        "value",
        F.coalesce("arrival_us", F.lit(-1)).alias("arrival_us"),
        F.when(~good, F.array_join("invalid_fields", ",")).alias("reason"),
    )


def drains(spark: SparkSession, path: str) -> DataFrame:
    """Drain rows as a stream: those that drain() writes below path."""
    folder = f"{path}/control"
    spark.createDataFrame([], "subnet_id string").write.mode("ignore").json(folder)
    rows = spark.readStream.schema("subnet_id string").json(folder)
    none = F.lit(None).cast("string")
    return rows.select("subnet_id", F.lit("drain").alias("kind"), F.lit(-1).cast("long").alias("us"), none.alias("logline_id"), none.alias("value"), F.lit(-1).cast("long").alias("arrival_us"), none.alias("reason"))


def batches(rows: DataFrame, options: Options, timeout_ms: int = 30_000, late_us: int | None = None) -> DataFrame:
    """Rows of finished batches, and failed, late and dropped ones, as Finished takes them."""
    gather = Gather(options.batch_lines or 10_000, timeout_ms, late_us)
    return rows.select("subnet_id", *INPUT).groupBy("subnet_id").transformWithStateInPandas(gather, OUTPUT, "Append", "ProcessingTime")


def write_trigger(rows: DataFrame, path: str, trigger: int, options: Options) -> None:
    """All tables of what a trigger finished, and how long each stage took; a second run overwrites the first."""
    spark, rows = rows.sparkSession, rows.persist()
    stages = Finished(rows, options)
    try:
        if rows.isEmpty():
            return
        made, times = flow.monitoring(stages) | {"batches": stages.batches.select("subnet_id", "b", "batch_id", "part", "us", "logline_id")}, []
        for stage, names in STAGES.items():
            began, n = time.time_ns() // 1000, 0
            for name in names:
                seen = Observation()
                made[name].observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/{name}/trigger={trigger}")
                n += seen.get["n"]
            times.append((stage, trigger, n, began, time.time_ns() // 1000))
        spark.dataSource.register(JsonLines)
        alerts = spark.read.parquet(f"{path}/alerts/trigger={trigger}")
        alerts.write.format("json_lines").mode("append").option("path", f"{path}/alert_lines").option("trigger", trigger).save()
        spark.createDataFrame(times, TIMES).coalesce(1).write.mode("overwrite").parquet(f"{path}/stage_times/trigger_={trigger}")
    finally:
        stages.release()
        rows.unpersist()


def read_results(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the stream; fill levels are summed over all triggers."""
    if name == "fill_levels":
        return flow.fill_table(read_results(spark, path, "fill_changes"))
    found = spark.read.parquet(f"{path}/{name}")
    return found.drop("trigger_" if name == "stage_times" else "trigger")


def stage_latency(spark: SparkSession, path: str) -> DataFrame:
    """stage, n, rows and percentiles of the microseconds that a stage took for a trigger, as measured."""
    times = read_results(spark, path, "stage_times").withColumn("us", F.col("ended_us") - F.col("began_us"))
    return percentiles(times, "stage", "us", F.sum("rows").alias("rows"))


def line_latency(spark: SparkSession, path: str) -> DataFrame:
    """stage, n, rows and percentiles of the microseconds between a line's arrival and the end of each stage on it."""
    ends = spark.read.parquet(f"{path}/stage_times").select("stage", F.col("trigger").alias("k"), "ended_us")
    lines = spark.read.parquet(f"{path}/server_logs").select(F.col("trigger").alias("k"), F.unix_micros(F.col("timestamp_in").cast("timestamp")).alias("in_us"))
    return percentiles(lines.join(F.broadcast(ends), "k").withColumn("us", F.col("ended_us") - F.col("in_us")), "stage", "us", F.count("*").alias("rows"))


def start(
    lines: DataFrame, path: str, options: Options = Options(batch_lines=10_000), timeout_ms: int = 30_000, trigger: dict | None = None, late_us: int | None = None
) -> StreamingQuery:
    """Starts the query on a stream of lines (value). State and places are kept below path/checkpoint; started again with the
    same path, it goes on from there. late_us: how much older than its subnet's newest line a line may come."""
    spark = lines.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKS:
        raise ValueError("the session has no state store with lists; call configure() first")
    rows = arrivals(lines, options).observe("lines", F.count(F.lit(1)).alias("rows"), F.count_if(F.col("kind") == "failed").alias("failed"))
    found = batches(rows.unionByName(drains(spark, path)), options, timeout_ms, late_us)
    out = found.writeStream.foreachBatch(lambda df, k: write_trigger(df, path, k, options)).option("checkpointLocation", f"{path}/checkpoint")
    return out.trigger(**(trigger or {"processingTime": "2 seconds"})).start()


def drain(lines: DataFrame, path: str, options: Options = Options(batch_lines=10_000), timeout_ms: int = 30_000, late_us: int | None = None) -> None:
    """Finishes, inside the stream, what a stopped one still holds: a drain row for each subnet goes in, and the query runs
    until all input is done. The state is empty then, so that a later start repeats nothing."""
    spark = lines.sparkSession
    state = spark.read.format("statestore").option("stateVarName", "meta").load(f"{path}/checkpoint")
    state.select("key.subnet_id").write.mode("append").json(f"{path}/control")
    query = start(lines, path, options, timeout_ms, {"availableNow": True}, late_us)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
