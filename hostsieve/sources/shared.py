"""Tables in the folder that driver and executors share, which end a plan's lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder name below spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a session on one machine gets a temporary folder; a cluster has none that all machines see, so
    there it is an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not (context.master or "").startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="shared-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder with what is in it, from any store that Spark can write; nothing happens where there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end every folder that shared_dir() and stored() have named inside: write results elsewhere before.

    with scratch(spark):
        run_batch(lines)["alerts"].write.parquet("/out/alerts")
    """
    made: list[str] = []
    before = _made.set(made)
    try:
        yield
    finally:
        _made.reset(before)
        for path in made:
            remove(spark, path)


def stored(df: DataFrame) -> DataFrame:
    """The rows of df as a written table in the shared folder: its lineage ends here, and lost executors lose nothing."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
