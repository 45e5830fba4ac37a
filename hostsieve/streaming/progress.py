"""What Spark measures of each trigger, as a table: durations of its steps, rows and observed metrics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

from hostsieve.operators.explore import percentiles

ROWS = "query string, trigger long, stage string, rows long, began_us long, took_us long"


class Progress(StreamingQueryListener):
    """Appends a row for each step of each trigger (addBatch, walCommit and so on) to path/progress, `every` triggers at a
    time and when a query ends; rows are the trigger's input rows, and for observed metrics their column `rows`."""

    def __init__(self, spark: SparkSession, path: str, every: int = 30):
        self.spark, self.path, self.every, self.rows, self.seen = spark, f"{path}/progress", every, [], 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        began = int(datetime.fromisoformat(p.timestamp.replace("Z", "+00:00")).timestamp() * 1_000_000)
        self.rows += [(str(p.id), p.batchId, step, p.numInputRows, began, int(ms) * 1000) for step, ms in p.durationMs.items()]
        for name, row in p.observedMetrics.items():
            took = int(p.durationMs.get("triggerExecution", 0)) * 1000
            self.rows.append((str(p.id), p.batchId, name, row.asDict().get("rows"), began, took))
        self.seen += 1
        if self.seen % self.every == 0:
            self.flush()

    def onQueryTerminated(self, event) -> None:
        self.flush()

    def flush(self) -> None:
        rows, self.rows = self.rows, []
        if rows:
            self.spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(self.path)


def step_latency(spark: SparkSession, path: str) -> DataFrame:
    """stage, n and percentiles of the microseconds that each step of the triggers took."""
    return percentiles(spark.read.schema(ROWS).parquet(f"{path}/progress"), "stage", "took_us")
