"""Every registered query of the log analytics, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostsieve.functions import features as ft
from hostsieve.functions.lines import DEFAULT, is_ip, is_timestamp, matches, network
from hostsieve.operators import batching, detect, explore, series
from hostsieve.operators.names import by_name, vectors
from hostsieve.plans import flow
from hostsieve.plans.flow import DETECTOR, Flow, Options
from hostsieve.plans.steps import DAY, HOUR, SIZE, STEPS, sql_entropy
from hostsieve.sources import tables
from hostsieve.sources.shared import shared_dir, stored

Made = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Made] = {}
ORACLE_SQL: dict[str, str] = {}
#: Days as batches and hours as steps: the given tables hold a month of lines.
OPTIONS = Options(batch_us=DAY, step_us=HOUR)


class Given(Flow):
    """The stages over the log lines of a folder of tables; `given` has the lines' fields as they were made."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.given = tables.log_lines(spark, sf_dir)
        self.events = spark.read.parquet(f"{sf_dir}/events.parquet")
        super().__init__(self.given.select("logline_id", "arrival_us", "class", "value"), OPTIONS)

    @property
    def by_size(self) -> DataFrame:
        return batching.by_size(self.table, SIZE)

    @property
    def features(self) -> DataFrame:
        return ft.with_levels(self.valid)

    @cached_property
    def names(self) -> DataFrame:
        """The distinct names of the valid lines with their vectors; there are no more of them than events."""
        return vectors(self.table, self.events.count())

    @property
    def judged(self) -> DataFrame:
        """label and prediction of each valid line by the rule."""
        label, prediction = F.when(F.col("class") == "legit", 0).otherwise(1), F.when(F.col("p1") > 0.5, 1).otherwise(0)
        return flow.rule_scores(self.valid).select("logline_id", "subnet_id", "domain_name", "class", "record_type", "fqdn_entropy", label.alias("label"), prediction.alias("prediction"))


def query(name: str, sql: str | None = None):
    """Registers a function of the stages under a name, with the SQL that gives the same rows."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(Given(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = f"WITH {STEPS} {sql}"
        return f

    return put


r6 = lambda c: F.round(c, 6)

# Sources and parsing
query("source_clean_lines", "SELECT trim(value) AS value FROM lines WHERE trim(value) <> ''")(lambda f: tables.clean_lines(f.given.select("value")))
query("server_logs", "SELECT md5(cast(logline_id AS varchar)) message_id, us, value message_text FROM lines")(
    lambda f: f.given.select(F.md5(F.col("logline_id").cast("string")).alias("message_id"), F.col("arrival_us").alias("us"), F.col("value").alias("message_text"))
)
query("server_log_events", "SELECT md5(cast(logline_id AS varchar)) message_id, unnest(['timestamp_in','timestamp_out']) event, us FROM lines")(
    lambda f: f.given.select(F.md5(F.col("logline_id").cast("string")).alias("message_id"), F.explode(F.array(F.lit("timestamp_in"), F.lit("timestamp_out"))).alias("event"), F.col("arrival_us").alias("us"))
)
_PARSED = ("timestamp", "status_code", "client_ip", "domain_name", "record_type", "response_ip", "size")
query("parse_lines", "SELECT logline_id, " + ", ".join(f'CASE WHEN n_fields = 8 THEN "{c}" END "{c}"' for c in _PARSED) + ", n_fields FROM tests")(
    lambda f: DEFAULT.split(f.lines).select("logline_id", *_PARSED, "n_fields")
)
query("validate_timestamp", """SELECT logline_id, ok_ts ok, try_strptime("timestamp",'%Y-%m-%d') IS NOT NULL ok_date FROM tests""")(
    lambda f: f.given.select("logline_id", is_timestamp(F.col("timestamp"), "%Y-%m-%dT%H:%M:%S.%fZ").alias("ok"), is_timestamp(F.col("timestamp"), "%Y-%m-%d").alias("ok_date"))
)
query("validate_domain", "SELECT logline_id, ok_domain ok FROM tests")(lambda f: f.given.select("logline_id", matches(F.col("domain_name"), DEFAULT.fields[4].arg).alias("ok")))
query("validate_ip", "SELECT logline_id, ok_ip ok FROM tests")(lambda f: f.given.select("logline_id", is_ip(F.col("response_ip")).alias("ok")))
query("validate_list", "SELECT logline_id, ok_type ok FROM tests")(lambda f: f.given.select("logline_id", DEFAULT.fields[5].valid(F.col("record_type")).alias("ok")))
_BAD = "CASE WHEN n_fields <> 8 THEN 'field_count' ELSE array_to_string(list_filter([CASE WHEN NOT ok_ts THEN 'timestamp' END, CASE WHEN NOT ok_domain THEN 'domain_name' END, CASE WHEN NOT ok_type THEN 'record_type' END, CASE WHEN NOT ok_ip THEN 'response_ip' END, CASE WHEN NOT ok_size THEN 'size' END], lambda x: x IS NOT NULL), ',') END"
query("invalid_fields", f"SELECT logline_id, {_BAD} invalid FROM tests")(
    lambda f: DEFAULT.parse(f.lines).select("logline_id", F.array_join("invalid_fields", ",").alias("invalid"))
)
query("failed_loglines", f"SELECT * FROM (SELECT logline_id, us, value message_text, {_BAD} reason_for_failure FROM tests) WHERE reason_for_failure <> ''")(
    lambda f: f.failed.select("logline_id", F.col("arrival_us").alias("us"), "message_text", "reason_for_failure")
)
query("dns_loglines", """SELECT logline_id, subnet_id, us, status_code, client_ip, record_type, '{"dns_server_ip":"' || dns_server_ip || '","domain_name":"' || domain_name || '","response_ip":"' || response_ip || '","size":"' || size || '"}' additional_fields FROM valid""")(
    lambda f: f.valid.select("logline_id", "subnet_id", "us", "status_code", "client_ip", "record_type", F.to_json(F.struct("dns_server_ip", "domain_name", "response_ip", "size")).alias("additional_fields"))
)
query("subnet_id", "SELECT logline_id, subnet_id, CASE WHEN contains(client_ip,':') THEN regexp_replace(client_ip,'::.*$','::') ELSE '192.160.0.0' END net12, CASE WHEN contains(client_ip,':') THEN 'fd00::' ELSE '192.168.' || (cast(split_part(client_ip,'.',3) AS int) // 2 * 2) || '.0' END net23 FROM valid")(
    lambda f: f.valid.select("logline_id", "subnet_id", network(F.col("client_ip"), 12).alias("net12"), network(F.col("client_ip"), 23, 48).alias("net23"))
)
query("prefilter", "SELECT logline_id, domain_name FROM valid WHERE status_code='NXDOMAIN'")(lambda f: f.valid.where(DEFAULT.relevant()).select("logline_id", "domain_name"))
query("prefilter_events", "SELECT logline_id, CASE WHEN status_code='NXDOMAIN' THEN 'finished' ELSE 'filtered_out' END status, status_code='NXDOMAIN' is_active FROM valid")(
    lambda f: f.valid.select("logline_id", F.when(DEFAULT.relevant(), "finished").otherwise("filtered_out").alias("status"), DEFAULT.relevant().alias("is_active"))
)
query("verify_rows", "SELECT logline_id, logline_id % 3 <> 0 AND logline_id % 5 <> 0 ok FROM lines")(
    lambda f: tables.verify_rows(
        f.given.select("logline_id", F.expr("""concat('{"n":', case when logline_id % 5 = 0 then '"none"' when logline_id % 3 = 0 then 'null' else cast(logline_id as string) end, ',"client_ip":"', client_ip, '"}')""").alias("value")), "n long, client_ip string"
    ).select("logline_id", "ok")
)


def _routed(f: Given) -> dict[str, DataFrame]:
    """Messages for two tables in one stream, as they come apart again."""
    message = lambda df, table, *columns: df.select(F.lit(table).alias("table"), F.to_json(F.struct(*columns)).alias("value"))
    one = message(f.batched, "logline_to_batches", F.col("logline_id").cast("string").alias("logline_id"), batching.batch_id().alias("batch_id"))
    two = message(f.lines, "server_logs", F.col("logline_id").cast("string").alias("message_id"), F.col("value").alias("message_text"))
    return tables.route(one.unionByName(two), ["logline_to_batches", "server_logs"])


query("route_tables", "SELECT b.batch_id, count(*) n FROM (SELECT subnet_id || '#' || b batch_id FROM by_time) b GROUP BY 1")(
    lambda f: _routed(f)["logline_to_batches"].groupBy("batch_id").agg(F.count("*").alias("n"))
)
query("union_datasets", "SELECT dataset, class, count(*) n FROM (SELECT 'a' dataset, class FROM valid UNION ALL SELECT 'b', class FROM lines) GROUP BY ALL")(
    lambda f: tables.union_datasets({"a": f.valid.select("class"), "b": f.given.select("class", "record_type")}).groupBy("dataset", "class").agg(F.count("*").alias("n"))
)
query("route_server_logs", "SELECT cast(logline_id AS varchar) message_id, value message_text FROM lines")(lambda f: _routed(f)["server_logs"].select("message_id", "message_text"))


def _previewed(f: Given) -> DataFrame:
    """The first ten rows of a monitoring table of a run."""
    path = shared_dir(f.spark)
    tables.append(flow.monitoring(f)["dns_loglines"], path, "dns_loglines")
    return tables.preview(f.spark, path, "dns_loglines", order="logline_id").select("logline_id", "subnet_id", "client_ip", "additional_fields")


_FIELDS_JSON = """'{"dns_server_ip":"' || dns_server_ip || '","domain_name":"' || domain_name || '","response_ip":"' || response_ip || '","size":"' || size || '"}'"""
query("table_preview", f"SELECT cast(logline_id AS varchar) logline_id, subnet_id, client_ip, {_FIELDS_JSON} additional_fields FROM valid ORDER BY cast(logline_id AS varchar) LIMIT 10")(_previewed)
query("batch_envelope", "SELECT subnet_id AS key, batch_id, count(*) n FROM batches GROUP BY ALL")(
    lambda f: tables.envelope(f.batches).select("key", F.get_json_object("value", "$.batch_id").alias("batch_id"), F.size(F.from_json("value", "data array<struct<us bigint>>")["data"]).cast("long").alias("n"))
)
query("decode_envelope", "SELECT batch_id, part, us, logline_id, client_ip, domain_name, status_code FROM batches")(lambda f: tables.decode_envelope(tables.envelope(f.batches)))
query("decode_text_envelope", "SELECT batch_id, part, us, logline_id, client_ip, domain_name, status_code FROM batches")(
    lambda f: tables.decode_envelope(tables.envelope(f.batches, as_text=True).withColumn("value", F.regexp_replace("value", r'\\"', "'")), as_text=True)
)

# Batches
query("batch_by_size", "SELECT logline_id, subnet_id, b FROM by_size")(lambda f: f.by_size.select("logline_id", "subnet_id", "b"))
query("batch_by_time", "SELECT logline_id, subnet_id, b FROM by_time")(lambda f: f.batched.select("logline_id", "subnet_id", "b"))
query("batch_overlap", "SELECT logline_id, subnet_id, b, 1 part FROM by_size UNION ALL SELECT s.logline_id, s.subnet_id, s.b + 1, 0 FROM by_size s JOIN (SELECT DISTINCT subnet_id, b FROM by_size) x ON x.subnet_id = s.subnet_id AND x.b = s.b + 1")(
    lambda f: (lambda rows: batching.overlap(rows, batching.bounds(rows)).select("logline_id", "subnet_id", "b", "part"))(stored(f.by_size))
)
query("batch_overlap_gap", "SELECT logline_id, batch_id, part FROM batches")(lambda f: f.batches.select("logline_id", "batch_id", "part"))
query("batch_sorted", "SELECT batch_id, logline_id, row_number() OVER (PARTITION BY batch_id ORDER BY part, us, logline_id) pos FROM batches")(lambda f: batching.ordered(f.batches).select("batch_id", "logline_id", "pos"))
query("batch_bounds", "SELECT batch_id, begin_us, end_us FROM bnd")(lambda f: f.bounds.select("batch_id", "begin_us", "end_us"))
query("batch_counts", "SELECT batch_id, part, count(*) n FROM batches GROUP BY GROUPING SETS ((batch_id, part), (part), ())")(
    lambda f: f.batches.groupingSets([["batch_id", "part"], ["part"], []], "batch_id", "part").agg(F.count("*").alias("n"))
)
query("stored_keys", "SELECT DISTINCT subnet_id, part FROM batches")(lambda f: f.batches.select("subnet_id", "part").distinct())
query("logline_to_batches", "SELECT logline_id, subnet_id || '#' || b batch_id FROM by_time")(lambda f: f.batched.select("logline_id", batching.batch_id().alias("batch_id")))
query("batch_timestamps", "SELECT key AS batch_id, status, is_active, us, message_count FROM bev WHERE status IN ('completed', 'waiting')")(
    lambda f: f.batch_events.where("status in ('completed', 'waiting')").select(F.col("key").alias("batch_id"), "status", "is_active", "us", "message_count")
)
_INSIDE, _BUFFER = "'total_loglines_in_batches'", "'total_loglines_in_buffer'"
query("fill_levels", f"SELECT bucket, entry_type, cast(sum(sum(d)) OVER (PARTITION BY entry_type ORDER BY bucket) AS bigint) entry_count FROM (SELECT {_INSIDE} entry_type, us // {HOUR} bucket, 1 d FROM by_time UNION ALL SELECT {_INSIDE}, end_us // {HOUR}, -n FROM own UNION ALL SELECT {_BUFFER}, end_us // {HOUR}, n - coalesce(lag(n) OVER (PARTITION BY subnet_id ORDER BY b), 0) FROM own) GROUP BY entry_type, bucket")(
    lambda f: batching.fill_levels(f.batched, f.bounds, HOUR)
)

# Series and scores
query("step_axis", "SELECT batch_id, step FROM axis")(lambda f: series.axis(f.bounds, HOUR).select("batch_id", "step"))
query("count_per_step", "SELECT batch_id, step, n FROM series")(lambda f: f.series().select("batch_id", "step", "n"))
query("count_per_step_compat", "SELECT a.batch_id, a.step, coalesce(n,0) n FROM axis a LEFT JOIN (SELECT batch_id, step, count(*) n FROM (SELECT *, max(us) OVER (PARTITION BY batch_id, step) l FROM placed) WHERE us = l GROUP BY ALL) p ON p.batch_id = a.batch_id AND p.step = a.step")(
    lambda f: f.series("last_distinct").select("batch_id", "step", "n")
)
query("out_of_range", "SELECT batch_id, count(*) FILTER (us < begin_us OR us > end_us) n_out FROM relevant GROUP BY 1")(
    lambda f: f.relevant.groupBy("batch_id").agg(F.count_if((F.col("us") < F.col("begin_us")) | (F.col("us") > F.col("end_us"))).alias("n_out"))
)
query("mean_size_per_step", "SELECT batch_id, step, round(size,6) size FROM series")(lambda f: f.series().select("batch_id", "step", r6(F.col("size")).alias("size")))
query("series_multivariate", "SELECT batch_id, step, n, round(size,6) size FROM series")(lambda f: f.series().select("batch_id", "step", "n", r6(F.col("size")).alias("size")))
query("score_zscore", "SELECT batch_id, step, round(score,6) score FROM scored")(lambda f: f.scored.select("batch_id", "step", r6(F.col("score")).alias("score")))
_ALL = "SELECT batch_id, step, CASE WHEN count(n) OVER w < 5 OR stddev_pop(n) OVER w = 0 THEN 0.0 ELSE coalesce(abs(n - avg(n) OVER w) / stddev_pop(n) OVER w, 0.0) END s FROM series WINDOW w AS (PARTITION BY batch_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
query("score_zscore_global", f"SELECT batch_id, step, round(1 - exp(-s / 3),6) score FROM ({_ALL})")(lambda f: f.series().select("batch_id", "step", r6(series.normalised(series.zscore("n", None))).alias("score")))
_SEEN = "SELECT batch_id, step, n, coalesce(list(n) OVER (PARTITION BY batch_id ORDER BY step ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), []) h FROM series"
query("score_mad", f"SELECT batch_id, step, round(CASE WHEN len(h) < 5 OR d = 0 THEN 0.0 ELSE abs(n - m) / (1.4826 * d) END, 6) score FROM (SELECT *, list_aggregate(list_transform(h, lambda v: abs(v - m)), 'median') d FROM (SELECT *, list_aggregate(h, 'median') m FROM ({_SEEN})))")(
    lambda f: f.series().select("batch_id", "step", r6(series.mad("n")).alias("score"))
)
query("score_knn", f"SELECT batch_id, step, round(CASE WHEN len(h) < 5 THEN 0.0 ELSE list_sum(list_sort(list_transform(h, lambda v: abs(v - n)))[1:3]) / 3 END, 6) score FROM ({_SEEN})")(
    lambda f: f.series().select("batch_id", "step", r6(series.knn("n")).alias("score"))
)
_POT = """
t AS (SELECT batch_id, quantile_cont(n, 0.9) t, count(*) c FROM series GROUP BY 1),
o AS (SELECT s.batch_id, count(*) k, avg(n - t) m, var_pop(n - t) v FROM series s JOIN t ON t.batch_id = s.batch_id WHERE n > t GROUP BY 1),
f AS (SELECT t.batch_id, t, m, CASE WHEN v > 1e-9 THEN m * m / v ELSE 1.0 END r, 0.01 * c / k p FROM t JOIN o ON o.batch_id = t.batch_id),
l AS (SELECT batch_id, m * (r + 1) / 2 s, greatest(t, t + CASE WHEN abs((1 - r) / 2) < 1e-9 THEN -(m * (r + 1) / 2) * ln(p) ELSE m * (r + 1) / (1 - r) * (pow(p, (r - 1) / 2) - 1) END) z FROM f)"""
QUERIES["score_pot"] = lambda spark, sf_dir: series.pot(Given(spark, sf_dir).series(), "n").select("batch_id", "step", r6(F.col("score")).alias("score"))
ORACLE_SQL["score_pot"] = f"WITH {STEPS}, {_POT} SELECT a.batch_id, a.step, round(coalesce(greatest(n - z, 0.0) / s, 0.0), 6) score FROM series a LEFT JOIN l ON l.batch_id = a.batch_id"
_LODA = ", ".join(f"floor((0.0 + (n - mn) / sn * {a!r} + (size - ms) / ss * {b!r}) * 20 / 6)" for a, b in series.projections(["n", "size"], 10, 1))
_LODA = f"""
k AS (SELECT avg(n) mn, stddev_pop(n) sn, avg(size) ms, stddev_pop(size) ss, count(*) c FROM series),
b AS (SELECT batch_id, step, c, unnest([{_LODA}]) bin, unnest(range(10)) p FROM series, k),
d AS (SELECT p, bin, count(*) h FROM b GROUP BY ALL)"""
QUERIES["score_loda"] = lambda spark, sf_dir: series.loda(Given(spark, sf_dir).series(), ["n", "size"]).select("batch_id", "step", r6(F.col("score")).alias("score"))
ORACLE_SQL["score_loda"] = f"WITH {STEPS}, {_LODA} SELECT batch_id, step, round(avg(-ln(h / c)), 6) score FROM b JOIN d ON d.p = b.p AND d.bin = b.bin GROUP BY ALL"
query("score_custom")(lambda f: series.custom(f.series(), lambda x: (x["n"] - x["n"].mean()).abs()).select("batch_id", "step", r6(F.col("score")).alias("score")))
_TWO = f"SELECT a.batch_id, a.step, a.score z, 1 - exp(-g.s / 3) g FROM scored a JOIN ({_ALL}) g ON g.batch_id = a.batch_id AND g.step = a.step"
_two = lambda f: f.series().select("batch_id", "step", series.normalised(series.zscore("n")).alias("z"), series.normalised(series.zscore("n", None)).alias("g"))
query("score_weight", f"SELECT batch_id, step, round((z * 2 + g) / 3, 6) score FROM ({_TWO})")(lambda f: _two(f).select("batch_id", "step", r6(series.weighted({"z": 2.0, "g": 1.0})).alias("score")))
query("score_vote", f"SELECT batch_id, step, (CASE WHEN z >= 0.5 THEN 1.0 ELSE 0.0 END + CASE WHEN g >= 0.5 THEN 1.0 ELSE 0.0 END) / 2 score FROM ({_TWO})")(lambda f: _two(f).select("batch_id", "step", series.vote(["z", "g"], 0.5).alias("score")))
_ENSEMBLE = f"""
z AS (SELECT batch_id, step, score z FROM scored), g AS (SELECT batch_id, step, 1 - exp(-CASE WHEN len(h) < 5 THEN 0.0 ELSE list_sum(list_sort(list_transform(h, lambda v: abs(v - n)))[1:3]) / 3 END / 3) g FROM ({_SEEN}))"""
QUERIES["score_ensemble"] = lambda spark, sf_dir: series.scorer("ensemble", ["zscore", "knn"])(Given(spark, sf_dir).series()).select("batch_id", "step", r6(F.col("score")).alias("score"))
ORACLE_SQL["score_ensemble"] = f"WITH {STEPS}, {_ENSEMBLE} SELECT z.batch_id, z.step, round((z + g) / 2, 6) score FROM z JOIN g ON g.batch_id = z.batch_id AND g.step = z.step"
query("suspicious_batches", "SELECT batch_id, round(share,6) share FROM suspicious")(lambda f: f.verdicts.select("batch_id", r6(F.col("share")).alias("share")))
query("suspicious_by_client", "SELECT DISTINCT suspicious_batch_id, batch_id, client_ip FROM clients")(lambda f: f.by_client.select("suspicious_batch_id", "batch_id", "client_ip").distinct())
query("inspector_filtered", "SELECT DISTINCT logline_id, batch_id FROM relevant WHERE batch_id NOT IN (SELECT batch_id FROM suspicious)")(
    lambda f: f.relevant.join(f.verdicts.select("batch_id"), "batch_id", "left_anti").select("logline_id", "batch_id").distinct()
)

# Features
query("domain_labels", "SELECT logline_id, array_to_string(labels,'|') labels FROM levels")(lambda f: f.features.select("logline_id", F.array_join("labels", "|").alias("labels")))
query("domain_levels", "SELECT logline_id, fqdn, secondleveldomain, thirdleveldomain FROM levels")(lambda f: f.features.select("logline_id", "fqdn", "secondleveldomain", "thirdleveldomain"))
query("features_basic", "SELECT logline_id, len(labels) label_length, length(list_max(labels)) label_max, length(fqdn) label_average FROM levels")(
    lambda f: f.features.select("logline_id", *(c.cast("long").alias(n) for n, c in ft.basic().items()))
)
_q = ", ".join(f"round((length(fqdn) - length(replace(lower(fqdn),'{c}',''))) / length(fqdn), 6) freq_{c}" for c in ft.LETTERS)
query("features_letters", f"SELECT logline_id, {_q} FROM levels")(lambda f: ft.with_letters(f.features).select("logline_id", *(r6(F.col(n)).alias(n) for n in ft.letters())))
_kinds = (("alpha", "[^A-Za-z]"), ("numeric", "[^0-9]"), ("special", "[A-Za-z0-9]"))
_q = ", ".join(f"CASE WHEN length({v}) > 0 THEN 1.0 ELSE 0.0 END {v}_full, " + ", ".join(f"CASE WHEN length({v}) > 0 THEN round(length(regexp_replace({v},'{p}','','g')) / length({v}), 6) ELSE 0.0 END {v}_{k}" for k, p in _kinds) for v in ft.LEVELS)
query("features_ratios", f"SELECT logline_id, {_q} FROM levels")(lambda f: f.features.select("logline_id", *(r6(c).alias(n) for n, c in ft.ratios().items())))
_q = ", ".join(f"round({sql_entropy(v)}, 5) {v}_entropy" for v in ft.LEVELS)
query("features_entropy", f"SELECT logline_id, {_q} FROM levels")(lambda f: f.features.select("logline_id", *(F.round(c, 5).alias(n) for n, c in ft.entropies().items())))
_q = ", ".join(
    [
        "len(labels) + 0.0 label_length, length(list_max(labels)) + 0.0 label_max, length(fqdn) + 0.0 label_average",
        *(f"round((length(fqdn) - length(replace(lower(fqdn),'{c}',''))) / length(fqdn), 5) freq_{c}" for c in ft.LETTERS),
        *(f"CASE WHEN length({v}) > 0 THEN 1.0 ELSE 0.0 END {v}_full" for v in ft.LEVELS),
        *(f"CASE WHEN length({v}) > 0 THEN round(length(regexp_replace({v},'{p}','','g')) / length({v}), 5) ELSE 0.0 END {v}_{k}" for v in ft.LEVELS for k, p in _kinds),
        *(f"round({sql_entropy(v)}, 5) {v}_entropy" for v in ft.LEVELS),
    ]
)
_q_all = _q
query("features_all", f"SELECT logline_id, {_q} FROM levels")(lambda f: ft.with_features(f.valid).select("logline_id", *(F.round(F.col(n).cast("double"), 5).alias(n) for n in ft.all_features())))
query("preprocess_domains", "SELECT domain_name AS query, min(class) class, any_value(labels[-1]) tld, any_value(secondleveldomain) secondleveldomain FROM (SELECT * FROM levels WHERE len(labels) > 1) GROUP BY 1")(
    lambda f: ft.preprocess(f.valid.select(F.col("domain_name").alias("query"), "class")).select("query", "class", "tld", "secondleveldomain")
)

# Detection and events
query("warnings_rule", "SELECT suspicious_batch_id, logline_id, domain_name, round(p1,6) probability FROM warned")(lambda f: f.warnings.select("suspicious_batch_id", "logline_id", "domain_name", r6(F.col("p1")).alias("probability")))
query("alert_score", "SELECT suspicious_batch_id, round(overall_score,6) overall_score FROM alerts")(lambda f: f.alerts.select("suspicious_batch_id", r6(F.col("overall_score")).alias("overall_score")))
query("alerts", "SELECT suspicious_batch_id, batch_id, client_ip, round(overall_score,6) overall_score, array_to_string(domain_names, ',') domain_names, result, alert_us, n_warnings FROM alerts")(
    lambda f: f.alerts.select("suspicious_batch_id", "batch_id", "client_ip", r6(F.col("overall_score")).alias("overall_score"), F.array_join("domain_names", ",").alias("domain_names"), "result", "alert_us", "n_warnings")
)
query("detector_events", f"SELECT key AS suspicious_batch_id, status FROM sev WHERE stage = '{DETECTOR}' AND NOT is_active")(
    lambda f: f.suspicious_events.where(f"stage = '{DETECTOR}' and not is_active").select(F.col("key").alias("suspicious_batch_id"), "status")
)
query("suspicious_events", "SELECT key AS suspicious_batch_id, client_ip, stage, status, is_active, us, message_count FROM sev")(
    lambda f: f.suspicious_events.select(F.col("key").alias("suspicious_batch_id"), "client_ip", "stage", "status", "is_active", "us", "message_count")
)
query("batch_events", "SELECT key, stage, status, is_active, us, message_count FROM bev")(lambda f: f.batch_events.select("key", "stage", "status", "is_active", "us", "message_count"))
_LAST = "QUALIFY row_number() OVER (PARTITION BY key ORDER BY us DESC, rank DESC) = 1"
query("current_state", f"SELECT key, stage, status, is_active FROM bev {_LAST}")(lambda f: detect.current_state(f.batch_events).select("key", "stage", "status", "is_active"))
_CLOSED = "status IN ('completed', 'finished', 'filtered_out')"
query("log_volume", f"SELECT stage, us // {DAY} bucket, cast(sum(message_count) AS bigint) n FROM bev WHERE {_CLOSED} GROUP BY ALL")(
    lambda f: f.batch_events.where(_CLOSED).groupBy("stage", F.floor(F.col("us") / DAY).alias("bucket")).agg(F.sum("message_count").alias("n"))
)
_OPEN = "status IN ('waiting', 'in_process')"
query("stage_latency", f"SELECT stage, round(median(d),3) latency_us FROM (SELECT key, stage, max(us) FILTER ({_CLOSED}) - min(us) FILTER ({_OPEN}) d FROM bev GROUP BY ALL) WHERE d IS NOT NULL GROUP BY 1")(
    lambda f: f.batch_events.groupBy("key", "stage").agg((F.max(F.expr(f"case when {_CLOSED} then us end")) - F.min(F.expr(f"case when {_OPEN} then us end"))).alias("d")).where("d is not null").groupBy("stage").agg(F.round(F.median("d"), 3).alias("latency_us"))
)
query("logline_events", "SELECT key AS logline_id, stage, status, is_active, us FROM lev")(lambda f: f.line_events.select(F.col("key").alias("logline_id"), "stage", "status", "is_active", "us"))
query("logline_state", f"SELECT logline_id, min(status) status, bool_or(is_active) is_active FROM (SELECT key logline_id, status, is_active FROM lev QUALIFY rank() OVER (PARTITION BY key ORDER BY us DESC, rank DESC) = 1) GROUP BY 1")(
    lambda f: _line_state(f)
)


def _line_state(f: Given) -> DataFrame:
    """Each line's latest status; of a line in two batches that end alike, detected before filtered_out."""
    events = f.last_line_events.withColumn("rank", F.struct("rank", (F.col("status") == "detected").alias("found")))
    return detect.current_state(events).select(F.col("key").alias("logline_id"), "status", "is_active")


query("alert_lineage", "SELECT a.suspicious_batch_id, a.batch_id, b.logline_id, b.part FROM alerts a JOIN batches b ON b.batch_id = a.batch_id AND b.client_ip = a.client_ip")(
    lambda f: f.alerts.select("suspicious_batch_id", "batch_id", "client_ip").join(f.batches.select("batch_id", "client_ip", "logline_id", "part"), ["batch_id", "client_ip"]).select("suspicious_batch_id", "batch_id", "logline_id", "part")
)


def _repeated(f: Given) -> DataFrame:
    """Rows and line ids in the tables of a run over lines without ids, of which every fifth occurs twice."""
    again = f.given.where("logline_id % 5 = 0")
    out = None
    for name, df in flow.monitoring(Flow(f.given.select("value").unionByName(again.select("value")), f.options)).items():
        if name in ("server_logs", "failed_dns_loglines", "dns_loglines", "logline_to_batches", "logline_timestamps"):
            key = next((c for c in ("logline_id", "message_id") if c in df.columns), None)
            ids = F.countDistinct(key) if key else F.lit(0)
            row = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), ids.cast("long").alias("ids"))
            out = row if out is None else out.unionByName(row)
    return out


_TWICE = "(SELECT * FROM {0} UNION ALL SELECT * FROM {0} WHERE logline_id % 5 = 0)"
_GONE = "(SELECT * FROM lines WHERE logline_id NOT IN (SELECT logline_id FROM valid))"
query(
    "repeated_lines",
    " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) n, count(*) ids FROM {_TWICE.format(rows)}" for name, rows in (("server_logs", "lines"), ("dns_loglines", "valid"), ("logline_to_batches", "valid")))
    + f" UNION ALL SELECT 'failed_dns_loglines', count(*), 0 FROM {_TWICE.format(_GONE)}",
)(lambda f: _repeated(f).where("name <> 'logline_timestamps'"))

# Dashboards
query("granularity", "SELECT subnet_id, CASE WHEN s <= 300 THEN 'second' WHEN s <= 21600 THEN 'minute' WHEN s <= 259200 THEN 'hour' ELSE 'day' END granularity FROM (SELECT subnet_id, (max(us) - min(us)) / 1e6 s FROM valid GROUP BY 1)")(
    lambda f: f.valid.groupBy("subnet_id").agg(((F.max("us") - F.min("us")) / 1e6).alias("s")).select("subnet_id", explore.granularity(F.col("s")).alias("granularity"))
)
query("alerts_over_time", f"SELECT e.bucket, coalesce(n,0) n FROM (SELECT unnest(range(min(alert_us // {HOUR}), max(alert_us // {HOUR}) + 1)) bucket FROM alerts) e LEFT JOIN (SELECT alert_us // {HOUR} bucket, count(*) n FROM alerts GROUP BY 1) p ON p.bucket = e.bucket")(
    lambda f: explore.over_time(f.alerts, HOUR)
)
query("alerting_clients", "SELECT count(DISTINCT client_ip) n FROM alerts")(lambda f: f.alerts.agg(F.countDistinct("client_ip").alias("n")))


def _heat(name: str, row: str, column: str, values: range, prefix: str) -> None:
    cells = ", ".join(f"count(*) FILTER (c = {v}) {prefix}{v}" for v in values)
    zero = ", ".join(f"coalesce({prefix}{v}, 0) {prefix}{v}" for v in values)
    sql = f"SELECT e.r, {zero} FROM (SELECT unnest(range(min({row}), max({row}) + 1)) r FROM alerts) e LEFT JOIN (SELECT r, {cells} FROM (SELECT {row} r, {column} c FROM alerts) GROUP BY 1) p ON p.r = e.r"
    of = lambda x: F.expr(x.replace("//", "div"))
    query(name, sql)(lambda f: explore.heatmap(f.alerts, of(row), of(column), list(values), prefix))


_AT = "make_timestamp(cast(alert_us AS bigint))"
query("heatmap_day", f"SELECT e.r, {', '.join(f'coalesce(d{v}, 0) d{v}' for v in range(1, 32))} FROM (SELECT unnest(range(min({{m}}), max({{m}}) + 1)) r FROM alerts) e LEFT JOIN (SELECT {{m}} r, {', '.join(f'count(*) FILTER (day({_AT}) = {v}) d{v}' for v in range(1, 32))} FROM alerts GROUP BY 1) p ON p.r = e.r".format(m=f"(year({_AT}) * 12 + month({_AT}) - 1)"))(
    lambda f: explore.heatmap(f.alerts, explore.month_of(F.col("alert_us")), F.day(explore.date_of(F.col("alert_us"))), list(range(1, 32)), "d")
)
_heat("heatmap_hour", f"(alert_us // {DAY})", f"((alert_us // {HOUR}) % 24)", range(24), "h")
_heat("heatmap_quarter", f"((alert_us // {HOUR}) % 24)", f"((alert_us // {HOUR // 4}) % 4)", range(4), "q")
query("latest_alerts", "SELECT client_ip, array_to_string(domain_names, ', ') AS names, max(alert_us) alert_us FROM alerts GROUP BY 1, 2 ORDER BY alert_us DESC, client_ip, names LIMIT 20")(lambda f: explore.latest(f.alerts))
query("top_clients", "SELECT client_ip, n, row_number() OVER (ORDER BY n DESC, client_ip) AS rank FROM (SELECT client_ip, count(*) n FROM valid WHERE client_ip IN (SELECT client_ip FROM alerts) GROUP BY 1 ORDER BY n DESC, client_ip LIMIT 5)")(
    lambda f: explore.top_clients(f.valid, f.alerts)
)

# Evaluation and training
query("label_codes", "SELECT class, CASE WHEN class='legit' THEN 0 ELSE row_number() OVER (PARTITION BY class='legit' ORDER BY class) END code, CASE WHEN class='legit' THEN 0 ELSE 1 END AS binary FROM (SELECT DISTINCT CASE WHEN class='legit' THEN class ELSE class || '_' || record_type END class FROM valid)")(
    lambda f: detect.label_codes(f.valid.select(F.when(F.col("class") == "legit", F.col("class")).otherwise(F.concat_ws("_", "class", "record_type")).alias("class")))
)
query("class_weights", "SELECT class, round(sum(n) OVER () / (count(*) OVER () * n), 6) weight FROM (SELECT class, count(*) n FROM valid GROUP BY 1)")(lambda f: detect.class_weights(f.valid, "class").select("class", r6(F.col("weight")).alias("weight")))
_SPLIT = "SELECT logline_id, class, row_number() OVER (PARTITION BY class ORDER BY md5('108|' || logline_id), logline_id) r, count(*) OVER (PARTITION BY class) n FROM valid"
query("stratified_split", f"SELECT logline_id, CASE WHEN r <= floor(n * 0.8 + 1e-9) THEN 'train' WHEN r <= floor(n * 0.9 + 1e-9) THEN 'valid' ELSE 'test' END split FROM ({_SPLIT})")(
    lambda f: detect.stratified_split(f.table, "class", "logline_id", {"train": 0.8, "valid": 0.1, "test": 0.1}).select("logline_id", "split")
)
query("stratified_sample", f"SELECT logline_id FROM ({_SPLIT}) WHERE r <= floor(n * 0.25 + 1e-9)")(
    lambda f: detect.stratified_split(f.table, "class", "logline_id", {"in": 0.25, "out": 0.75}).where("split = 'in'").select("logline_id")
)
query("confusion_matrix", "SELECT * FROM conf")(lambda f: detect.confusion(f.judged))
query("fdr_fttar", "SELECT CASE WHEN fp+tp=0 THEN 0 ELSE round(fp/(fp+tp),6) END fdr, CASE WHEN tp=0 THEN 0 ELSE round(fp/tp,6) END fttar FROM conf")(lambda f: detect.report(f.judged).select("fdr", "fttar"))
_RATES = """base AS (SELECT '0' AS class, tn h, tn + fn p, tn + fp s FROM conf UNION ALL SELECT '1', tp, tp + fp, tp + fn FROM conf UNION ALL SELECT 'accuracy', tp + tn, tp + fp + fn + tn, tp + fp + fn + tn FROM conf),
rates AS (SELECT class, CASE WHEN p = 0 THEN 0.0 ELSE h / p END AS "precision", CASE WHEN s = 0 THEN 0.0 ELSE h / s END recall, CASE WHEN p + s = 0 THEN 0.0 ELSE 2 * h / (p + s) END f1, s support FROM base),
report AS (SELECT * FROM rates UNION ALL SELECT 'macro', avg("precision"), avg(recall), avg(f1), cast(sum(support) AS bigint) FROM rates WHERE class <> 'accuracy'
 UNION ALL SELECT 'weighted', sum("precision" * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), cast(sum(support) AS bigint) FROM rates WHERE class <> 'accuracy')"""
QUERIES["classification_report"] = lambda spark, sf_dir: detect.classification_report(Given(spark, sf_dir).judged)
ORACLE_SQL["classification_report"] = f'WITH {STEPS}, {_RATES} SELECT class, round("precision", 6) AS "precision", round(recall, 6) recall, round(f1, 6) f1, support FROM report'
query("dataset_confusion", "SELECT record_type dataset, count(*) FILTER (label=1 AND prediction=1) tp, count(*) FILTER (label=0 AND prediction=1) fp, count(*) FILTER (label=1 AND prediction=0) fn, count(*) FILTER (label=0 AND prediction=0) tn FROM judged GROUP BY 1")(
    lambda f: detect.confusion(f.judged.withColumnRenamed("record_type", "dataset"), ["dataset"])
)
_NUMBERS = ("label_length", "label_average", "fqdn_numeric")
query("scale_features", "SELECT logline_id, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 5) {c}" for c in _NUMBERS) + " FROM (SELECT logline_id, len(labels) label_length, length(fqdn) label_average, length(regexp_replace(fqdn,'[^0-9]','','g')) / length(fqdn) fqdn_numeric FROM levels)")(
    lambda f: detect.scaled(f.features.withColumns({c: x for c, x in ft.all_features().items() if c in _NUMBERS}).select("logline_id", *_NUMBERS), list(_NUMBERS)).select("logline_id", *(F.round(c, 5).alias(c) for c in _NUMBERS))
)
query("report_by_dataset", "SELECT subnet_id, count(*) FILTER (label=1 AND prediction=1) tp, count(*) FILTER (label=0 AND prediction=1) fp, round(avg(CASE WHEN label=prediction THEN 1.0 ELSE 0.0 END),6) accuracy FROM judged GROUP BY 1")(
    lambda f: detect.report(f.judged, ["subnet_id"]).select("subnet_id", "tp", "fp", "accuracy")
)
query("mispredictions", "SELECT logline_id, domain_name, label, prediction FROM judged WHERE label <> prediction")(lambda f: f.judged.where("label <> prediction").select("logline_id", "domain_name", "label", "prediction"))
query("misprediction_classes", "SELECT DISTINCT class FROM judged WHERE label <> prediction")(lambda f: f.judged.where("label <> prediction").select("class").distinct())


def _halves(f: Given) -> tuple[DataFrame, DataFrame]:
    """The training and the held-out half of each class of the valid lines, with the features as columns too."""
    return _parts(ft.feature_columns(_split(f)))


def _split(f: Given) -> DataFrame:
    """The valid lines with their vectors and their half, written once."""
    rows = detect.stratified_split(f.table.select("logline_id", "domain_name", "class"), "class", "logline_id", {"train": 0.5, "test": 0.5})
    rows = rows.select("logline_id", "domain_name", "split", F.when(F.col("class") == "legit", 0.0).otherwise(1.0).alias("label"))
    return stored(by_name(rows, f.names, ["domain_name", "logline_id"]))


def _parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where("split = 'train'"), rows.where("split = 'test'")


def _held_out(f: Given, kind: str) -> DataFrame:
    """The scores of the held-out half alone, to evaluate a model by."""
    fitted, held = _parts(_split(f))
    return detect.detect(detect.train(fitted, kind), held).select("logline_id", "domain_name", r6(F.col("p1")).alias("p1"))


def _scores(f: Given, lines: DataFrame | None = None) -> DataFrame:
    """The given lines with p1, by a forest of the training half; without them all valid lines, whose vectors are there.

    The names of given lines are scored and not the lines, as p1 depends on the name alone.
    """
    rows = _split(f)
    model = detect.train(_parts(rows)[0])
    if lines is None:
        return detect.detect(model, rows)
    return by_name(lines, stored(detect.detect(model, f.names).select("domain_name", "c", "p1")))


query("train_rf")(partial(_held_out, kind="rf"))
query("train_gbt")(partial(_held_out, kind="gbt"))
query("detect_scores")(lambda f: _scores(f).select("logline_id", "domain_name", r6(F.col("p1")).alias("p1")))
query("warnings")(lambda f: detect.warnings(_scores(f, f.by_client.select("suspicious_batch_id", "batch_id", "client_ip", "logline_id", "domain_name"))).select("suspicious_batch_id", "batch_id", "client_ip", "logline_id", "domain_name", r6(F.col("p1")).alias("p1")))


def _rules(f: Given) -> DataFrame:
    """All rules of a forest of the training half, with their quality on the held-out half, whose equal names are counted
    and judged once."""
    fitted, held = _parts(_split(f))
    rules = detect.rules(detect.train(fitted), list(ft.all_features()))
    held = held.groupBy("domain_name", "label").agg(F.count("*").alias("c")).join(f.names.drop("c"), "domain_name")
    return detect.rule_quality(ft.feature_columns(held), rules, "c")


def _tuned(f: Given) -> DataFrame:
    """The held-out half's scores by the best of a few forests, which cross validation on the training half chooses."""
    fitted, held = _parts(_split(f))
    model = detect.tune(fitted.select("features", "label"), trials=3, folds=3)
    return detect.detect(model.bestModel, held).select("logline_id", r6(F.col("p1")).alias("p1"))


query("rules")(_rules)
query("tune_model")(_tuned)

# Datasets in files: written from the given lines, and read back

_NAMES = "SELECT domain_name AS query, class FROM valid"


def _labelled_csv(f: Given) -> DataFrame:
    path = shared_dir(f.spark)
    f.valid.select(F.col("domain_name").alias("Domain"), F.col("class").alias("DGA_family"), F.lit("x").alias("Type")).write.option("header", True).csv(path)
    return tables.read_labelled_csv(f.spark, path, "malicious")


def _named_csvs(f: Given, most: int | None = None) -> DataFrame:
    """A folder of CSVs for each class, whose name ends in the class."""
    path = shared_dir(f.spark)
    kind = F.when(F.col("class") == "legit", "benign").otherwise(F.col("class"))
    rows = f.valid.select("domain_name", "logline_id", kind.alias("names"))
    rows = rows if most is None else rows.repartition("names")  # the cap is for each file: one for each class
    rows.write.partitionBy("names").csv(path)
    return tables.read_named_csvs(f.spark, path, "names=([a-z]+)/", most)


def _latin_names(f: Given) -> DataFrame:
    path = shared_dir(f.spark)
    f.valid.select(F.encode("domain_name", "ISO-8859-1").alias("domain"), "class").write.parquet(path)
    return tables.read_parquet_names(f.spark, path)


def _spaced_log(f: Given) -> DataFrame:
    path = shared_dir(f.spark)
    f.valid.select(F.concat_ws(" ", "timestamp", "status_code", "client_ip", "dns_server_ip", "domain_name", "record_type", "response_ip", "size")).write.text(path)
    return tables.read_spaced_log(f.spark, path)


def _json_names(f: Given) -> DataFrame:
    path = shared_dir(f.spark)
    tables.export_json(f.valid.select(F.col("domain_name").alias("query"), "class"), path)
    return tables.load_json(f.spark, path, "query string, class string")


def _catalog(f: Given) -> DataFrame:
    """Every monitoring table of a run, written by append and read back: its name and number of rows."""
    path = shared_dir(f.spark)
    tables.create_tables(f.spark, path)
    out, lines = None, stored(f.lines)  # read for several tables, made once
    for name, rows in flow.run_batch(lines, f.options).items():
        if name in tables.TABLES:
            tables.append(rows, path, name)
            n = tables.read_table(f.spark, path, name).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
            out = n if out is None else out.unionByName(n)
    return out


def _cached_features(f: Given) -> DataFrame:
    """Basic features from a cache, which is asked for twice and made once."""
    path, options = shared_dir(f.spark), {"features": list(ft.basic())}
    rows = f.features.select("logline_id", "class", *(c.cast("long").alias(n) for n, c in ft.basic().items()))
    tables.feature_cache(rows, path, "lines", options)
    return tables.feature_cache(rows, path, "lines", options).select("logline_id", "class", "label_length", "label_max", "label_average", "dataset")


query("load_labelled_csv", "SELECT domain_name AS query, 'malicious' AS class FROM valid")(_labelled_csv)
query("load_named_csvs", _NAMES)(_named_csvs)
query("load_capped_csvs", "SELECT class, least(count(*), 50) n FROM valid GROUP BY 1")(lambda f: _named_csvs(f, 50).groupBy("class").agg(F.count("*").alias("n")))
query("load_parquet_names", _NAMES)(_latin_names)
query("load_spaced_log", "SELECT domain_name AS query, 'legit' AS class FROM valid")(_spaced_log)
query("load_json", _NAMES)(_json_names)
query("load_dataset", "SELECT class, count(*) n FROM valid GROUP BY 1")(
    lambda f: tables.load_dataset(f.spark, "", lambda spark, path: f.valid.select("domain_name", "class")).groupBy("class").agg(F.count("*").alias("n"))
)
query("feature_cache", "SELECT logline_id, class, len(labels) label_length, length(list_max(labels)) label_max, length(fqdn) label_average, 'lines' dataset FROM levels")(_cached_features)
_ROWS = {
    "server_logs": "lines",
    "server_logs_timestamps": "(SELECT unnest([1, 2]) FROM lines)",
    "failed_dns_loglines": "(SELECT * FROM lines WHERE logline_id NOT IN (SELECT logline_id FROM valid))",
    "dns_loglines": "valid",
    "logline_timestamps": "lev",
    "logline_to_batches": "by_time",
    "batch_timestamps": "bev",
    "suspicious_batches_to_batch": "(SELECT DISTINCT suspicious_batch_id FROM clients)",
    "suspicious_batch_timestamps": "sev",
    "alerts": "alerts",
    "fill_levels": "(SELECT us // 1000000 FROM (SELECT 1 k, us FROM by_time UNION ALL SELECT 1, end_us FROM own UNION ALL SELECT 2, end_us FROM own) GROUP BY k, us // 1000000)",
}
query("table_catalog", " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) n FROM {rows}" for name, rows in _ROWS.items()))(_catalog)

# Exploration
query("label_distribution", "SELECT class, count(*) n FROM valid GROUP BY 1")(lambda f: f.valid.groupBy("class").agg(F.count("*").alias("n")))
_CDF = "SELECT x, sum(n0) OVER w / sum(n0) OVER () c0, sum(n1) OVER w / sum(n1) OVER () c1 FROM (SELECT length(domain_name) x, count(*) FILTER (label=0) n0, count(*) FILTER (label=1) n1 FROM judged GROUP BY 1) WINDOW w AS (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_len = lambda f: f.judged.withColumn("x", F.length("domain_name"))
query("ks_statistic", f"SELECT round(max(abs(c0 - c1)),6) statistic, any_value(n0) n0, any_value(n1) n1, round(least(1.0, 2 * exp(-2 * pow(max(abs(c0 - c1)), 2) * any_value(n0) * any_value(n1) / (any_value(n0) + any_value(n1)))), 6) p_value FROM ({_CDF}), (SELECT count(*) FILTER (label=0) n0, count(*) FILTER (label=1) n1 FROM judged)")(
    lambda f: explore.ks(_len(f), "x").select(r6(F.col("statistic")).alias("statistic"), "n0", "n1", r6(F.col("p_value")).alias("p_value"))
)
query("emd", f"SELECT round(sum(abs(c0 - c1) * g),6) emd FROM (SELECT *, lead(x) OVER (ORDER BY x) - x g FROM ({_CDF}))")(lambda f: explore.emd(_len(f), "x").select(r6(F.col("emd")).alias("emd")))
query("histogram", "SELECT label, CASE WHEN x < 0 THEN 0 WHEN x >= 60 THEN 31 ELSE cast(floor(x / 2) AS bigint) + 1 END bin, count(*) n FROM (SELECT label, length(domain_name) x FROM judged) GROUP BY ALL")(lambda f: explore.histogram(_len(f), "x", 0, 60))
query("clip_outliers", "SELECT logline_id FROM judged j JOIN (SELECT label, quantile_cont(length(domain_name), 0.99) q FROM judged GROUP BY 1) k ON k.label = j.label WHERE length(domain_name) <= q")(lambda f: explore.clip_outliers(_len(f), "x").select("logline_id"))

_X = f"SELECT label, feature, cast(x AS double) x FROM (UNPIVOT (SELECT label, {_q_all} FROM levels JOIN (SELECT logline_id id, label FROM judged) ON id = logline_id) ON COLUMNS(* EXCLUDE (label)) INTO NAME feature VALUE x)"
_CDFS = """n AS (SELECT feature, x, count(*) FILTER (label = 0) n0, count(*) FILTER (label = 1) n1 FROM xs GROUP BY ALL),
c AS (SELECT feature, x, sum(n0) OVER w / sum(n0) OVER v c0, sum(n1) OVER w / sum(n1) OVER v c1, lead(x) OVER (PARTITION BY feature ORDER BY x) - x g, cast(sum(n0) OVER v AS bigint) m0, cast(sum(n1) OVER v AS bigint) m1
 FROM n WINDOW w AS (PARTITION BY feature ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY feature)),
k AS (SELECT feature, max(abs(c0 - c1)) d, any_value(m0) n0, any_value(m1) n1, coalesce(sum(abs(c0 - c1) * g), 0.0) emd FROM c GROUP BY 1)"""


def _features(f: Given) -> DataFrame:
    """label, c and the 44 features of each distinct name and label, with c for how many valid lines have them.

    Names repeat, so they are counted first, which combines before it shuffles, and each one's features are made once; they
    are dealt anew, as counts are so small that Spark would give them to few tasks.
    """
    label = F.when(F.col("class") == "legit", 0).otherwise(1)
    names = f.valid.groupBy("domain_name", label.alias("label")).agg(F.count("*").alias("c"))
    names = tables.spread(names, "domain_name", f.events.count())
    return ft.with_features(names).select("label", "c", *(F.round(F.col(n).cast("double"), 5).alias(n) for n in ft.all_features()))


query("ks_all", f"SELECT feature, round(d, 6) statistic, n0, n1, round(least(1.0, 2 * exp(-2 * d * d * n0 * n1 / (n0 + n1))), 6) p_value, round(emd, 5) emd FROM k")(
    lambda f: explore.distances(_features(f), list(ft.all_features()), "c").select("feature", r6(F.col("statistic")).alias("statistic"), "n0", "n1", r6(F.col("p_value")).alias("p_value"), F.round(F.coalesce("emd", F.lit(0.0)), 5).alias("emd"))
)
ORACLE_SQL["ks_all"] = ORACLE_SQL["ks_all"].replace(" SELECT feature, round(d", f", xs AS ({_X}), {_CDFS} SELECT feature, round(d")
_BIN = "CASE WHEN high = low THEN 1 ELSE least(cast(floor((x - low) / (high - low) * 30) AS bigint) + 1, 30) END"
QUERIES["histogram_all"] = lambda spark, sf_dir: explore.histograms(_features(Given(spark, sf_dir)), list(ft.all_features()), weight="c")
ORACLE_SQL["histogram_all"] = f"WITH {STEPS}, xs AS ({_X}), e AS (SELECT feature, min(x) low, max(x) high FROM xs GROUP BY 1) SELECT xs.feature, label, {_BIN} bin, count(*) n FROM xs JOIN e ON e.feature = xs.feature GROUP BY ALL"


def _components(f: Given) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    rows = stored(by_name(f.table.select("logline_id", "domain_name"), f.names).select("logline_id", "features"))  # read several times, made once
    out = explore.pca(rows)[1].withColumn("c", vector_to_array("components"))
    return out.select("logline_id", F.col("c")[0].alias("pc1"), F.col("c")[1].alias("pc2"))


query("pca")(_components)
