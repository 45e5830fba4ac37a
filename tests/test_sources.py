"""The tailed source, the sink with commits, caches by fingerprint, and a topic's options."""

import json
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from hostsieve.sources import tables
from hostsieve.sources.jsonlines import JsonLines, LinesWriter, Staged
from hostsieve.sources.tail import TailReader


def run(spark, source, out):
    """What a trigger gives, appended to a folder, from where the last run ended."""
    query = source.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return sorted((os.path.basename(r.path), r.offset, r.value) for r in spark.read.parquet(f"{out}/rows").collect())


def test_appended_lines_arrive_once_over_restarts(spark, tmp_path):
    log, out = tmp_path / "logs", tmp_path / "out"
    log.mkdir()
    (log / "a.log").write_bytes(b"one\ntwo\r\nthr")
    (log / "_hidden").write_bytes(b"no\n")
    assert run(spark, tables.tail_lines(spark, str(log), block=4), out) == [("a.log", 0, "one"), ("a.log", 4, "two")]
    with open(log / "a.log", "ab") as f:
        f.write("ee\n\nfünf\n".encode())
    (log / "b.log").write_bytes(b"x\n" * 5 + b"\xff\n")
    want = [("a.log", 0, "one"), ("a.log", 4, "two"), ("a.log", 9, "three"), ("a.log", 15, ""), ("a.log", 16, "fünf"), *(("b.log", 2 * k, "x") for k in range(5)), ("b.log", 10, "�")]
    assert run(spark, tables.tail_lines(spark, str(log), block=3), out) == want
    assert run(spark, tables.tail_lines(spark, str(log), block=3), out) == want


def test_blocks_hold_every_line_once(tmp_path):
    path = tmp_path / "log"
    rows = [b"x" * (k % 7) + b"\n" for k in range(60)]
    path.write_bytes(b"".join(rows))
    for block in (1, 2, 5, 1000):
        reader = TailReader({"path": str(path), "block": str(block)})
        parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
        got = [v for p in parts for batch in reader.read(p) for v in batch["value"].to_pylist()]
        assert got == [r[:-1].decode() for r in rows]


def test_start_at_the_end_and_a_file_that_was_replaced(tmp_path):
    path, marks = tmp_path / "log", tmp_path / "marks" / "at"
    path.write_bytes(b"old\nhalf")
    options = {"path": str(path), "start": "end", "marks": str(marks)}
    first = TailReader(options).initialOffset()
    with open(path, "ab") as f:
        f.write(b" and half\nnew\n")
    reader = TailReader(options)
    assert reader.initialOffset() == first  # also where the first trigger was never done
    read = lambda start: [v for p in reader.partitions(start, reader.latestOffset()) for b in reader.read(p) for v in b["value"].to_pylist()]
    assert read(first) == ["half and half", "new"]
    at = reader.latestOffset()
    path.write_bytes(b"z\n")
    assert read(at) == ["z"] and read(reader.latestOffset()) == []
    with pytest.raises(ValueError):
        TailReader({"path": "x", "start": "middle"})


def written(path):
    return sorted(json.loads(x)["id"] for p in path.glob("part-*.json") for x in p.read_text().splitlines())


def test_a_task_that_fails_and_runs_again_leaves_each_row_once(spark, tmp_path):
    """A write whose second partition always fails, then the same trigger again, twice."""
    spark.dataSource.register(JsonLines)
    out = tmp_path / "alerts"
    rows = spark.range(0, 300, 1, 3)
    save = lambda df, n: df.write.format("json_lines").mode("append").option("path", str(out)).option("trigger", n).option("rows", 7).save()
    bad = rows.select(F.expr("if(id = 150, raise_error('stop'), id)").alias("id"))
    with pytest.raises(Exception, match="stop"):
        save(bad, 5)
    assert written(out) == [] and not list((out / "_staging").iterdir())
    save(rows, 5)
    save(rows.repartition(2), 5)
    assert written(out) == list(range(300)) and not list((out / "_staging").iterdir())
    save(rows.where("id < 2"), 6)
    assert written(out) == sorted([0, 1, *range(300)])
    assert spark.read.json(str(out)).count() == 302


def test_an_unfinished_commit_is_done_again(tmp_path):
    writer = LinesWriter({"path": str(tmp_path), "trigger": "3"})
    staging = tmp_path / "_staging" / writer.job
    staging.mkdir(parents=True)
    for k in range(3):  # the last by a task whose place another took
        (staging / f"{k}.json").write_text(f'{{"id": {k}}}\n')
    (tmp_path / "part-0000000003-00009.json").write_text('{"id": 99}\n')  # what the commit before had moved
    (tmp_path / "part-0000000002-00000.json").write_text('{"id": 7}\n')
    writer.commit([Staged(f"{staging}/{k}.json", k, 1) for k in range(2)] + [None])
    assert written(tmp_path) == [0, 1, 7] and not staging.exists()


def test_the_sink_under_a_stream(spark, tmp_path):
    spark.dataSource.register(JsonLines)
    source, out = tmp_path / "in", tmp_path / "out"
    for n in (3, 5):
        spark.range(n).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("id long").parquet(str(source))
        query = stream.writeStream.format("json_lines").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    assert written(out) == sorted([*range(3), *range(5)])


def test_a_changed_option_or_plan_makes_a_new_cache(spark, tmp_path):
    source = str(tmp_path / "names")
    spark.range(10).write.parquet(source)
    rows, path = spark.read.parquet(source), str(tmp_path / "cache")
    made = lambda: len(list((tmp_path / "cache" / "dataset=a").iterdir()))
    assert tables.feature_cache(rows, path, "a", {"n": 1}).count() == 10
    spark.range(5).write.mode("append").parquet(source)
    again = spark.read.parquet(source)
    assert tables.fingerprint(again, {"n": 1}) == tables.fingerprint(rows, {"n": 1})
    assert tables.feature_cache(again, path, "a", {"n": 1}).count() == 10 and made() == 1  # read, not made again
    assert tables.feature_cache(again, path, "a", {"n": 2}).count() == 15 and made() == 2
    assert tables.feature_cache(again.where("id > 3"), path, "a", {"n": 1}).count() == 7 and made() == 3
    other = str(tmp_path / "others")
    spark.range(3).write.parquet(other)
    assert tables.feature_cache(spark.read.parquet(other), path, "a", {"n": 1}).count() == 3 and made() == 4


def test_a_topic(spark):
    options = tables.kafka_options("a:1,b:2", "lines", "g")
    assert options["subscribe"] == "lines" and options["startingOffsets"] == "earliest"
    with pytest.raises(AnalysisException, match="(?i)kafka"):  # the connector isn't among this machine's jars
        tables.read_topic(spark, "a:1", "lines", "g")
