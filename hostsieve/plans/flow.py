"""From log lines to alerts: the stages as DataFrames, and run_batch(), which gives every result and monitoring table.

Lines are split and tested once; what passes is written as a columnar table that the later stages read with their own
columns and predicates. Batches' bounds and verdicts are small tables of their own: a line never moves for them, unless
Spark finds them too large to broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostsieve.functions import features as ft
from hostsieve.functions.lines import DEFAULT, LineFormat, micros, subnet_id
from hostsieve.operators import batching, detect, series
from hostsieve.sources.shared import stored

#: Names of the stages, as the monitoring tables hold them.
COLLECTOR, BATCHES, PREFILTER = "log_collection.collector", "log_collection.batch_handler", "log_filtering.prefilter"
INSPECTOR, DETECTOR = "data_inspection.inspector", "data_analysis.detector"
#: The interval that fill levels are told for, in microseconds.
FILL_US = 1_000_000


def rule_scores(df: DataFrame) -> DataFrame:
    """Adds p1 by a rule in the place of a model: two labels and a high entropy."""
    df = ft.with_levels(df).withColumns({"label_length": F.size("labels"), "fqdn_entropy": ft.entropy(F.col("fqdn"))})
    return df.withColumn("p1", detect.rule_probability())


@dataclass(frozen=True)
class Options:
    """batch_lines: lines of a batch; where it is None, batches are intervals of batch_us. mode, models and combine choose
    how series are scored (see series.scorer); score, a function that adds score to a series (batch_id, step, n, size),
    takes the place of the model named custom, or of all where no models are named. classify: adds p1 to lines
    (domain_name)."""

    format: LineFormat = DEFAULT
    prefix4: int = 24
    prefix6: int = 64
    batch_us: int = 30_000_000
    batch_lines: int | None = None
    step_us: int = 20_000
    mode: str = "univariate"
    models: tuple[str, ...] = ("zscore",)
    combine: str = "weight"
    score: Callable[[DataFrame], DataFrame] | None = None
    score_threshold: float = 0.5
    anomaly_threshold: float = 0.01
    classify: Callable[[DataFrame], DataFrame] = rule_scores
    threshold: float = 0.5
    model: str = "rule"
    sha256: str = ""

    @property
    def scorer(self) -> Callable[[DataFrame], DataFrame]:
        if not self.models and self.score:
            return self.score
        return series.scorer(self.mode, list(self.models), self.combine, self.score_threshold, self.score)

    def __post_init__(self):
        _ = self.scorer  # what can't be done is told at once


class Flow:
    """The stages for one table of lines: value, and if it has them logline_id, arrival_us and further columns.

    A missing logline_id is drawn at random for each line, and the lines with their ids are written once, so that equal
    lines are lines of their own and every stage sees the same ids. Each property is a lazy DataFrame; what kept() is
    applied to is written when it is first asked for.
    """

    def __init__(self, lines: DataFrame, options: Options = Options()):
        self.options, self.spark, self._given = options, lines.sparkSession, lines

    def kept(self, df: DataFrame) -> DataFrame:
        return stored(df)

    @cached_property
    def lines(self) -> DataFrame:
        lines = self._given
        if "arrival_us" not in lines.columns:
            lines = lines.withColumn("arrival_us", F.lit(None).cast("long"))
        return lines if "logline_id" in lines.columns else self.kept(lines.withColumn("logline_id", F.expr("uuid()")))

    @cached_property
    def valid(self) -> DataFrame:
        """The valid lines with their fields, us and subnet_id."""
        o = self.options
        clock = next(f for f in o.format.fields if f.name == "timestamp")
        rows = o.format.valid(self.lines).drop("value")
        v6 = any(f.name == "client_ip" and f.kind == "ip" for f in o.format.fields)
        return rows.withColumns({"us": micros(F.col("timestamp"), clock.arg), "subnet_id": subnet_id(F.col("client_ip"), o.prefix4, o.prefix6, v6)})

    @cached_property
    def failed(self) -> DataFrame:
        """The other lines with the reason: field_count, or the fields that fail."""
        bad = self.options.format.failed(self.lines)
        return bad.select("logline_id", F.col("value").alias("message_text"), "arrival_us", F.array_join("invalid_fields", ",").alias("reason_for_failure"))

    @cached_property
    def table(self) -> DataFrame:
        return self.kept(self.valid)

    @cached_property
    def batched(self) -> DataFrame:
        """The valid lines with the number b of their batch."""
        o = self.options
        return self.kept(batching.by_size(self.table, o.batch_lines)) if o.batch_lines else batching.by_time(self.table, o.batch_us)

    @cached_property
    def bounds(self) -> DataFrame:
        return self.kept(batching.bounds(self.batched))

    @property
    def batches(self) -> DataFrame:
        """All lines of all batches, those of the batch before included."""
        return batching.overlap(self.batched, self.bounds)

    @property
    def relevant(self) -> DataFrame:
        """The relevant lines of all batches. Bounds are taken before this filter."""
        return batching.overlap(self.batched.where(self.options.format.relevant()), self.bounds)

    def series(self, compat: str | None = None) -> DataFrame:
        return series.series(self.bounds, self.relevant, self.options.step_us, compat)

    @property
    def scored(self) -> DataFrame:
        return self.options.scorer(self.series())

    @cached_property
    def verdicts(self) -> DataFrame:
        """batch_id, share: the suspicious batches with their share of anomalous steps."""
        return self.kept(series.suspicious(self.scored, self.options.score_threshold, self.options.anomaly_threshold))

    @property
    def by_client(self) -> DataFrame:
        """The relevant lines of suspicious batches, with suspicious_batch_id, one for each batch and client."""
        return series.by_client(self.relevant, self.verdicts)

    @property
    def warnings(self) -> DataFrame:
        return detect.warnings(self.options.classify(self.by_client), self.options.threshold)

    @property
    def alerts(self) -> DataFrame:
        return detect.alerts(self.warnings, self.options.model, self.options.sha256)

    # Events. Event time stands in for the clock: a line's own time, or its batch's end.

    @cached_property
    def outcomes(self) -> DataFrame:
        """batch_id, client_ip, suspicious_batch_id, m (relevant lines), us and found (whether there is a warning) of each
        suspicious batch: a small table, from one aggregation that combines before it shuffles."""
        p1 = F.col("p1")
        warned = (p1 > 1 - p1) & (p1 > self.options.threshold)
        rows = self.options.classify(self.by_client).groupBy("batch_id", "client_ip", "suspicious_batch_id")
        return self.kept(rows.agg(F.count("*").alias("m"), F.max("end_us").alias("us"), F.max(F.coalesce(warned, F.lit(False))).alias("found")))

    @property
    def line_events(self) -> DataFrame:
        """key (logline_id), stage, status, is_active, us, rank of every stage; from the inspector on, one for each batch."""
        return self._line_events(False)

    @property
    def last_line_events(self) -> DataFrame:
        """line_events without those that the same line's next one follows at the same time: what its state can be."""
        return self._line_events(True)

    def _line_events(self, last: bool) -> DataFrame:
        event = lambda stage, status, active, rank: F.struct(F.lit(stage).alias("stage"), F.lit(status).alias("status"), F.lit(active).alias("is_active"), F.lit(rank).alias("rank"))
        early = [event(COLLECTOR, "in_process", True, 1), event(COLLECTOR, "finished", True, 2), event(BATCHES, "in_process", True, 3), event(BATCHES, "batched", True, 4)]
        gone = [*early, event(PREFILTER, "filtered_out", False, 5)]
        some = lambda events: F.array(*(events[-1:] if last else events))
        of_line = F.when(self.options.format.relevant(), some(early)).otherwise(some(gone))
        first = self.table.select(F.col("logline_id").alias("key"), "us", F.inline(of_line))
        ends = self.relevant.join(self.outcomes.select("batch_id", "client_ip", "found"), ["batch_id", "client_ip"], "left")
        bad = F.col("found").isNotNull()
        later = ends.select(
            F.col("logline_id").alias("key"),
            F.col("end_us").alias("us"),
            F.when(bad, DETECTOR).otherwise(INSPECTOR).alias("stage"),
            F.when(F.col("found"), "detected").otherwise("filtered_out").alias("status"),
            F.lit(False).alias("is_active"),
            F.when(bad, 7).otherwise(6).alias("rank"),
        )
        return first.unionByName(later)

    @cached_property
    def batch_counts(self) -> DataFrame:
        """The bounds with m, the relevant lines of a batch, and bad, whether it is suspicious."""
        per = self.relevant.groupBy("batch_id").agg(F.count("*").alias("m"))
        bad = self.verdicts.select("batch_id", F.lit(True).alias("bad"))
        rows = self.bounds.join(per, "batch_id", "left").join(bad, "batch_id", "left")
        return self.kept(rows.withColumns({"m": F.coalesce("m", F.lit(0)), "bad": F.coalesce("bad", F.lit(False))}))

    @property
    def batch_events(self) -> DataFrame:
        """key (batch_id), stage, status, is_active, us, message_count, rank. A batch without relevant lines ends in the prefilter."""
        event = lambda stage, status, active, n, rank: F.struct(F.lit(stage).alias("stage"), status.alias("status"), active.alias("is_active"), n.cast("long").alias("message_count"), F.lit(rank).alias("rank"))
        some, m = F.col("m") > 0, F.col("m")
        on, off, lit = F.lit(True), F.lit(False), F.lit
        made = [
            event(BATCHES, lit("completed"), on, F.col("n"), 2),
            event(PREFILTER, lit("in_process"), on, F.col("n") + F.col("n0"), 3),
            event(PREFILTER, F.when(some, "finished").otherwise("filtered_out"), some, m, 4),
            F.when(some, event(INSPECTOR, lit("in_process"), on, m, 5)),
            F.when(some & ~F.col("bad"), event(INSPECTOR, lit("filtered_out"), off, m, 6)),
        ]
        later = self.batch_counts.select(F.col("batch_id").alias("key"), F.col("end_us").alias("us"), F.inline(F.array_compact(F.array(*made))))
        each = batching.waiting(self.batched).select(batching.batch_id().alias("key"), "us", "message_count")
        each = each.withColumns({"stage": lit(BATCHES), "status": lit("waiting"), "is_active": on, "rank": lit(1)})
        return later.unionByName(each)

    @property
    def suspicious_events(self) -> DataFrame:
        """key (suspicious_batch_id), client_ip, stage, status, is_active, us, message_count, rank."""
        event = lambda stage, status, active, rank: F.struct(F.lit(stage).alias("stage"), status.alias("status"), F.lit(active).alias("is_active"), F.lit(rank).alias("rank"))
        made = [event(INSPECTOR, F.lit("finished"), True, 1), event(DETECTOR, F.lit("in_process"), True, 2), event(DETECTOR, F.when(F.col("found"), "finished").otherwise("filtered_out"), False, 3)]
        return self.outcomes.select(F.col("suspicious_batch_id").alias("key"), "client_ip", "us", F.col("m").alias("message_count"), F.inline(F.array(*made)))


    @property
    def fill_changes(self) -> DataFrame:
        return batching.fill_changes(self.batched, self.bounds, FILL_US)

    @property
    def failed_us(self) -> Column:
        """When a line failed: its arrival, as event time stands in for the clock."""
        return F.col("arrival_us")


class Finished(Flow):
    """The stages from what a trigger of the stream finishes on. Rows have a kind: "line" for the lines of finished batches,
    with the number b of the batch that they are in, and part 0 for those of the batch before; "failed" and "late" for
    lines that no batch takes, with the reason; "dropped" for batches that leave their subnet's buffer unused, with their
    number of lines as part. `rows` should be persisted; intermediate results are persisted and never written, and release()
    lets go of them.
    """

    def __init__(self, rows: DataFrame, options: Options = Options()):
        super().__init__(rows, options)
        self.rows, self._kept = rows, []

    def kept(self, df: DataFrame) -> DataFrame:
        self._kept.append(df.persist())
        return self._kept[-1]

    def release(self) -> None:
        for df in self._kept:
            df.unpersist()

    @property
    def lines(self) -> DataFrame:
        some = "kind in ('failed', 'late') or kind = 'line' and part = 1"
        return self.rows.where(some).select("logline_id", "value", F.nullif("arrival_us", F.lit(-1)).alias("arrival_us"))

    @property
    def failed(self) -> DataFrame:
        some = self.rows.where("kind in ('failed', 'late')")
        return some.select("logline_id", F.col("value").alias("message_text"), F.nullif("arrival_us", F.lit(-1)).alias("arrival_us"), F.col("reason").alias("reason_for_failure"))

    @property
    def failed_us(self) -> Column:
        return F.unix_micros(F.current_timestamp())

    @cached_property
    def placed(self) -> DataFrame:
        """The lines of finished batches with their fields; their tests were passed before they got here."""
        some = self.rows.where("kind = 'line'").drop("kind", "reason")
        return self.kept(self.options.format.split(some).drop("value", "n_fields"))

    @property
    def table(self) -> DataFrame:
        return self.placed.where("part = 1").drop("b", "part")

    @property
    def batched(self) -> DataFrame:
        return self.placed.where("part = 1").drop("part")

    @cached_property
    def bounds(self) -> DataFrame:
        of = lambda f, column, part: f(F.when(F.col("part") == part, F.col(column)))
        ends = self.placed.groupBy("subnet_id", "b").agg(
            of(F.min, "us", 0).alias("before"), of(F.min, "us", 1).alias("own_begin"), of(F.max, "us", 1).alias("end_us"), of(F.count, "us", 1).alias("n"), of(F.count, "us", 0).alias("n0")
        )
        return self.kept(ends.select("subnet_id", "b", batching.batch_id().alias("batch_id"), F.coalesce("before", "own_begin").alias("begin_us"), "own_begin", "end_us", "n", "n0"))

    def _bounded(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.bounds.select("subnet_id", "b", "batch_id", "begin_us", "end_us"), ["subnet_id", "b"])

    @property
    def batches(self) -> DataFrame:
        return self._bounded(self.placed)

    @property
    def relevant(self) -> DataFrame:
        return self._bounded(self.placed.where(self.options.format.relevant()))

    @property
    def fill_changes(self) -> DataFrame:
        """Of what finished batches add to the buffer, those that they replace go; dropped ones go by themselves."""
        dropped = self.rows.where("kind = 'dropped'").select("us", (-F.col("part")).cast("long").alias("d"))
        return batching.fill_changes(self.batched, self.bounds.withColumn("held", F.col("n0")), FILL_US, dropped)


def wall(us: str) -> Column:
    """Microseconds since 1970 as a wall-clock time."""
    return F.expr(f"timestampadd(MICROSECOND, {us}, timestamp_ntz'1970-01-01 00:00:00')")


def additional_fields(fmt: LineFormat) -> Column:
    """All fields of a line beside the four that the table of lines has as columns, as JSON."""
    rest = [f.name for f in fmt.fields if f.name not in ("timestamp", "status_code", "client_ip", "record_type")]
    return F.to_json(F.struct(*rest))


def monitoring(f: Flow) -> dict[str, DataFrame]:
    """The monitoring tables of the stages, by name; schemas are those of sources.tables, but fill_changes has the changes
    that levels() of operators.batching sums."""
    at = wall("us")
    text = lambda c: F.col(c).cast("string")
    line = f.line_events.select(text("key").alias("logline_id"), "stage", "status", at.alias("timestamp"), "is_active")
    batch = f.batch_events.select(F.col("key").alias("batch_id"), "stage", "status", at.alias("timestamp"), "message_count", "is_active")
    suspicious = f.suspicious_events.select(F.col("key").alias("suspicious_batch_id"), "client_ip", "stage", "status", at.alias("timestamp"), "message_count", "is_active")
    raw = f.lines.select(text("logline_id").alias("message_id"), wall("arrival_us").alias("timestamp_in"), F.col("value").alias("message_text"))
    moves = F.explode(F.array(F.lit("timestamp_in"), F.lit("timestamp_out"))).alias("event")
    failed = f.failed.withColumn("failed_us", f.failed_us)
    return {
        "server_logs": raw,
        "server_logs_timestamps": raw.select("message_id", moves, F.col("timestamp_in").alias("event_timestamp")),
        "failed_dns_loglines": failed.select("message_text", wall("arrival_us").alias("timestamp_in"), wall("failed_us").alias("timestamp_failed"), "reason_for_failure"),
        "dns_loglines": f.table.select(text("logline_id").alias("logline_id"), "subnet_id", at.alias("timestamp"), "status_code", "client_ip", "record_type", additional_fields(f.options.format).alias("additional_fields")),
        "logline_to_batches": f.batched.select(text("logline_id").alias("logline_id"), batching.batch_id().alias("batch_id")),
        "fill_changes": f.fill_changes,
        "batch_timestamps": batch,
        "scored": f.scored,
        "suspicious_batches_to_batch": f.outcomes.select("suspicious_batch_id", "batch_id"),
        "suspicious_batch_timestamps": suspicious,
        "warnings": f.warnings,
        "alerts": f.alerts.select("client_ip", wall("alert_us").alias("alert_timestamp"), "suspicious_batch_id", "overall_score", F.to_json("domain_names").alias("domain_names"), "result"),
        "logline_timestamps": line,
    }


def fill_table(changes: DataFrame) -> DataFrame:
    """The table of fill levels from their changes."""
    return batching.levels(changes).select(wall(f"bucket * {FILL_US}").alias("timestamp"), F.lit(BATCHES).alias("stage"), "entry_type", "entry_count")


def run_batch(lines: DataFrame, options: Options = Options()) -> dict[str, DataFrame]:
    """The monitoring tables of a run over `lines` (value: a raw line), by name; schemas are those of sources.tables.

    Also valid (parsed lines), scored (series with scores) and warnings. Everything is lazy but the tables that Flow
    writes. Null and blank lines fail with the reason field_count. An empty table of lines gives empty tables.
    """
    f = Flow(lines, options)
    out = monitoring(f)
    return out | {"fill_levels": fill_table(out.pop("fill_changes")), "valid": f.table}
