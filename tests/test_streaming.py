import json
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hostsieve.plans.flow import Flow, Options, fill_table, monitoring
from hostsieve.sources import tables
from hostsieve.streaming import live
from hostsieve.streaming.gather import COLUMNS, INPUT, Gather
from hostsieve.streaming.progress import Progress, step_latency

OPTIONS = Options(batch_lines=20, step_us=60_000_000)


# The state of one subnet


class Cell:
    """A value or a list of a subnet's state."""

    def __init__(self):
        self.rows, self.appended = None, 0

    def exists(self):
        return self.rows is not None

    def get(self):
        return iter(self.rows) if isinstance(self.rows, list) else self.rows

    def put(self, rows):
        self.rows = list(rows)

    update = lambda self, value: setattr(self, "rows", value)

    def appendList(self, rows):
        self.rows, self.appended = [*(self.rows or []), *rows], self.appended + len(rows)

    def clear(self):
        self.rows = None


class Handle:
    """What Gather uses of Spark's handle, at a time that the test sets."""

    def __init__(self):
        self.cells, self.timers, self.now = {}, set(), 0

    def getListState(self, name, schema):
        return self.cells.setdefault(name, Cell())

    getValueState = getListState

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def listTimers(self):
        return iter(self.timers)

    def getCurrentProcessingTimeInMs(self):
        return self.now


def subnet(most=100, timeout=30_000, late=None):
    import pandas as pd

    handle, gather = Handle(), Gather(most, timeout, late)
    gather.init(handle)

    def put(*times, kind="line"):
        frame = pd.DataFrame([(kind, t, f"id{t}", f"v{t}", -1, None) for t in times], columns=list(INPUT))
        return [tuple(r) for f in gather.handleInputRows(("s",), iter([frame]), handle) for r in f[["kind", "us", "b", "part"]].itertuples(index=False)]

    def fire(now):
        handle.now = now
        due = [t for t in handle.timers if t <= now]
        handle.timers -= set(due)
        return [tuple(r) for t in due for f in gather.handleExpiredTimer(("s",), handle, None) for r in f[["kind", "us", "b", "part"]].itertuples(index=False)]

    return handle, put, fire


def test_a_trickle_is_flushed_in_time():
    handle, put, fire = subnet()
    out = []
    for k in range(8):
        handle.now = k * 10_000
        assert put(k) == [] and len(handle.timers) == 1
        out += [(handle.now, r) for r in fire(handle.now)]
    assert [(t, r) for t, r in out if t == 30_000] == [(30_000, ("line", k, 0, 1)) for k in range(4)]
    assert [r for t, r in out if t == 60_000] == [("line", k, 1, 0) for k in range(4)] + [("line", k, 1, 1) for k in range(4, 7)]
    assert handle.cells["held"].appended == 8 and handle.timers == {90_000}  # each line was written to the open batch once


def test_an_idle_subnet_drops_its_buffer_and_keeps_counting():
    handle, put, fire = subnet(most=3, timeout=1000)
    assert put(3, 1, 2) == [("line", 1, 0, 1), ("line", 2, 0, 1), ("line", 3, 0, 1)]
    assert fire(1000) == [("dropped", 3, None, 3)] and not handle.timers and not handle.cells["before"].exists()
    assert put(4, 5, 6) == [("line", k, 1, 1) for k in (4, 5, 6)]


def test_late_lines_go_beside_the_batches():
    _, put, _ = subnet(most=3, late=10)
    assert put(100, 50) == []  # nothing is late within a trigger
    assert put(89, 90) == [("line", 50, 0, 1), ("line", 90, 0, 1), ("line", 100, 0, 1), ("late", 89, None, None)]


def test_a_drain_row_empties_the_state():
    handle, put, _ = subnet(most=3, timeout=1000)
    put(1, 2, 3, 4)
    assert put(-1, kind="drain") == [("line", 1, 1, 0), ("line", 2, 1, 0), ("line", 3, 1, 0), ("line", 4, 1, 1), ("dropped", 4, None, 1)]
    assert not handle.cells["held"].exists() and not handle.cells["before"].exists() and not handle.timers
    assert put(-1, kind="drain") == [] and put(5) == [] and put(6, 7) == [("line", k, 2, 1) for k in (5, 6, 7)]


# The whole stream


@pytest.fixture(scope="module")
def one_partition(spark):
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    live.configure(spark)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", parts)


@pytest.fixture(scope="module")
def lines():
    """Lines of three subnets in order of time, some malformed, some repeated; one subnet has a burst of failing names."""
    draw, out = random.Random(8), []
    for k in range(260):
        minute, second = divmod(k * 13, 60)
        net = draw.choice((1, 1, 1, 2, 3))
        burst = net == 1 and 150 < k < 200
        name = f"{draw.getrandbits(64):016x}.com" if burst or draw.random() < 0.1 else "www.example.com"
        status = "NXDOMAIN" if burst or draw.random() < 0.3 else "NOERROR"
        ip = f"fd00:0:0:{net}::{k % 5}" if net == 3 else f"192.168.{net}.{k % 5 + 1}"
        out.append(f"2025-01-01T{minute // 60:02d}:{minute % 60:02d}:{second:02d}.{k:06d}Z {status} {ip} 10.0.0.1 {name} A 10.0.0.2 {k + 50}b")
        if k % 50 == 7:
            out.append(out[-1])
    return [*out, "not a line", "  "]


def folders(path):
    return sum(1 for p in Path(path).rglob("*") if p.is_dir())


def run(spark, source, out, **more):
    query = live.start(tables.tail_lines(spark, str(source)), str(out), OPTIONS, 3_600_000, {"availableNow": True}, **more)
    query.awaitTermination(240)
    assert query.exception() is None


def add(path, rows):
    with open(path, "a") as f:
        f.write("".join(r + "\n" for r in rows))


def test_every_table_equals_the_static_plan_over_a_restart(spark, one_partition, lines, tmp_path):
    """Half of the lines, a stop, the rest appended to the same file, then a drain; the restart and the end repeat nothing."""
    log, out, shared = tmp_path / "dns.log", tmp_path / "out", spark.conf.get("spark.checkpoint.dir")
    watch = Progress(spark, str(out), every=1)
    spark.streams.addListener(watch)
    add(log, lines[:130])
    left = folders(shared)
    run(spark, log, out)
    first = live.read_results(spark, str(out), "batches").count()
    add(log, [*lines[130:], "half of a line"])
    with open(log, "rb+") as f:
        f.truncate(log.stat().st_size - 1)  # a line that hasn't ended yet
    run(spark, log, out)
    assert live.read_results(spark, str(out), "batches").count() > first
    live.drain(tables.tail_lines(spark, str(log)), str(out), OPTIONS, 3_600_000)
    state = spark.read.format("statestore").option("stateVarName", "meta").load(f"{out}/checkpoint").select("value.n").collect()
    assert state and all(r.n == 0 for r in state)
    n = live.read_results(spark, str(out), "batches").count()
    run(spark, log, out)
    live.drain(tables.tail_lines(spark, str(log)), str(out), OPTIONS, 3_600_000)
    assert live.read_results(spark, str(out), "batches").count() == n
    assert folders(shared) == left  # triggers leave nothing in the shared folder
    spark.streams.removeListener(watch)

    good = [r for r in lines if r.strip()]
    static = Flow(spark.createDataFrame([(r, k) for k, r in enumerate(good)], "value string, arrival_us long"), OPTIONS)
    want = monitoring(static)
    want["fill_levels"] = fill_table(want.pop("fill_changes"))
    rows = lambda df, columns: Counter(map(tuple, df.select(*columns).collect()))
    apart = {  # ids are drawn at random and arrivals are the clock's; what they stand beside is compared
        "server_logs": ["message_text"],
        "server_logs_timestamps": ["event"],
        "failed_dns_loglines": ["message_text", "reason_for_failure"],
        "dns_loglines": ["subnet_id", "timestamp", "status_code", "client_ip", "record_type", "additional_fields"],
        "logline_to_batches": ["batch_id"],
        "logline_timestamps": ["stage", "status", "timestamp", "is_active"],
        "scored": ["batch_id", "step", "n", F.round("score", 9)],
        "alerts": ["client_ip", "alert_timestamp", "suspicious_batch_id", F.round("overall_score", 9), "domain_names", "result"],
        "warnings": ["suspicious_batch_id", "domain_name", "us"],
    }
    drained = {"fill_levels": lambda df: df.where("entry_type = 'total_loglines_in_batches'")}  # the drain empties the buffers as well
    for name, df in want.items():
        columns, some = apart.get(name, df.columns), drained.get(name, lambda df: df)
        got = rows(some(live.read_results(spark, str(out), name)), columns)
        assert got == rows(some(df), columns) and (got or name == "failed"), name
    ids = live.read_results(spark, str(out), "dns_loglines")
    assert ids.select("logline_id").distinct().count() == ids.count()  # equal lines are lines of their own
    buffers = live.read_results(spark, str(out), "fill_levels").where("entry_type = 'total_loglines_in_buffer'").orderBy(F.desc("timestamp")).first()
    assert buffers.entry_count == 0

    # the alert file, and times as they were measured
    written = [json.loads(x) for p in (out / "alert_lines").glob("part-*.json") for x in p.read_text().splitlines()]
    assert sorted(a["suspicious_batch_id"] for a in written) == sorted(r.suspicious_batch_id for r in live.read_results(spark, str(out), "alerts").collect())
    latency = {r.stage: r for r in live.stage_latency(spark, str(out)).collect()}
    assert set(latency) == set(live.STAGES) and all(0 < r.p50 <= r.p95 <= r.most and r.rows > 0 for r in latency.values())
    ends = {r.stage: r for r in live.line_latency(spark, str(out)).collect()}
    assert all(r.n == len(good) and r.p50 > 0 for r in ends.values())
    steps = {r.stage: r for r in step_latency(spark, str(out)).collect()}
    assert {"addBatch", "triggerExecution", "lines"} <= set(steps) and steps["triggerExecution"].p50 > 0
    progress = spark.read.parquet(f"{out}/progress").where("stage = 'lines'").agg(F.sum("rows")).first()[0]
    assert progress >= len(good)


def test_late_lines_are_failed_lines(spark, one_partition, tmp_path):
    row = lambda second, k: f"2025-01-01T00:00:{second:02d}.{k:06d}Z NOERROR 192.168.1.1 10.0.0.1 www.example.com A 10.0.0.2 {k}b"
    log, out = tmp_path / "dns.log", tmp_path / "out"
    add(log, [row(30, 1), row(10, 2)])
    run(spark, log, out, late_us=5_000_000)
    add(log, [row(24, 3), row(26, 4)])
    run(spark, log, out, late_us=5_000_000)
    live.drain(tables.tail_lines(spark, str(log)), str(out), OPTIONS, 3_600_000, 5_000_000)
    failed = live.read_results(spark, str(out), "failed_dns_loglines").collect()
    assert [(r.message_text, r.reason_for_failure) for r in failed] == [(row(24, 3), "late")]
    assert {r.timestamp.second for r in live.read_results(spark, str(out), "dns_loglines").collect()} == {10, 26, 30}
    assert live.read_results(spark, str(out), "server_logs").count() == 4


def test_a_trigger_that_runs_again_writes_the_same(spark, tmp_path):
    rows = [("line", "s", 1_000_000 * k, f"i{k}", f"2025-01-01T00:00:{k:02d}.000000Z NXDOMAIN 192.168.1.1 10.0.0.1 {k:016x}ab.com A 10.0.0.2 1b", k, 0, 1, None) for k in range(10)]
    df = spark.createDataFrame([*rows, ("failed", None, None, "x", "bad", 3, None, None, "field_count")], ", ".join(f"{c} {'int' if c == 'part' else 'long' if c in ('us', 'arrival_us', 'b') else 'string'}" for c in COLUMNS))
    for _ in range(2):
        live.write_trigger(df, str(tmp_path), 4, Options(step_us=1_000_000))
    assert live.read_results(spark, str(tmp_path), "dns_loglines").count() == 10
    assert live.read_results(spark, str(tmp_path), "failed_dns_loglines").count() == 1
    assert live.read_results(spark, str(tmp_path), "stage_times").count() == len(live.STAGES)


def test_the_state_store_must_be_configured(spark, tmp_path):
    before = spark.conf.get(live.PROVIDER)
    spark.conf.set(live.PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        with pytest.raises(ValueError, match="configure"):
            live.start(tables.tail_lines(spark, str(tmp_path)), str(tmp_path / "out"))
    finally:
        spark.conf.set(live.PROVIDER, before)
