"""Sources and sinks: log lines, labelled name lists, monitoring tables, message envelopes."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostsieve.operators.numbering import numbered
from hostsieve.sources.shared import remove

#: Schemas of the monitoring tables.
TABLES = {
    "server_logs": "message_id string, timestamp_in timestamp_ntz, message_text string",
    "server_logs_timestamps": "message_id string, event string, event_timestamp timestamp_ntz",
    "failed_dns_loglines": "message_text string, timestamp_in timestamp_ntz, timestamp_failed timestamp_ntz, reason_for_failure string",
    "dns_loglines": "logline_id string, subnet_id string, timestamp timestamp_ntz, status_code string, client_ip string, record_type string, additional_fields string",
    "logline_timestamps": "logline_id string, stage string, status string, timestamp timestamp_ntz, is_active boolean",
    "logline_to_batches": "logline_id string, batch_id string",
    "batch_timestamps": "batch_id string, stage string, status string, timestamp timestamp_ntz, message_count bigint, is_active boolean",
    "suspicious_batches_to_batch": "suspicious_batch_id string, batch_id string",
    "suspicious_batch_timestamps": "suspicious_batch_id string, client_ip string, stage string, status string, timestamp timestamp_ntz, message_count bigint, is_active boolean",
    "alerts": "client_ip string, alert_timestamp timestamp_ntz, suspicious_batch_id string, overall_score double, domain_names string, result string",
    "fill_levels": "timestamp timestamp_ntz, stage string, entry_type string, entry_count bigint",
    "dgta_dataset": "query string, class string, labels array<string>, tld string, fqdn string, secondleveldomain string, thirdleveldomain string",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema(name))


def append(df: DataFrame, path: str, name: str) -> None:
    """Appends rows to a monitoring table; columns are checked and cast by its schema."""
    want = schema(name)
    if missing := set(want.names) - set(df.columns):
        raise ValueError(f"{name} lacks {sorted(missing)}")
    df.select(*(F.col(f.name).cast(f.dataType) for f in want)).write.mode("append").parquet(f"{path}/{name}")


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(schema(name)).parquet(f"{path}/{name}")


def create_tables(spark: SparkSession, path: str) -> None:
    """Writes every monitoring table without rows, where it isn't there yet."""
    for name in TABLES:
        empty_table(spark, name).write.mode("ignore").parquet(f"{path}/{name}")


def drop_table(spark: SparkSession, path: str, name: str) -> None:
    """Removes a monitoring table with its files; create_tables() makes it anew."""
    schema(name)  # an unknown name is an error
    remove(spark, f"{path}/{name}")


def preview(spark: SparkSession, path: str, name: str, n: int = 10, order: str | None = None) -> DataFrame:
    """n rows of a monitoring table, those that come first by a column if one is named."""
    rows = read_table(spark, path, name)
    return (rows.orderBy(order) if order else rows).limit(n)


def kafka_options(brokers: str, topic: str, group: str) -> dict[str, str]:
    """Options of Spark's Kafka source that read a topic from its beginning."""
    return {"kafka.bootstrap.servers": brokers, "subscribe": topic, "startingOffsets": "earliest", "groupIdPrefix": group}


def read_topic(spark: SparkSession, brokers: str, topic: str, group: str) -> DataFrame:
    """The lines of a topic as a stream (value, with the message's time as arrival_us); needs Spark's Kafka connector."""
    source = spark.readStream.format("kafka").options(**kafka_options(brokers, topic, group)).load()
    return source.select(F.col("value").cast("string").alias("value"), F.unix_micros("timestamp").alias("arrival_us"))


def tail_lines(spark: SparkSession, path: str, start: str = "beginning", marks: str | None = None, block: int = 64 << 20) -> DataFrame:
    """The lines that are appended to a file, or to the files of a folder, as a stream (value, path, offset)."""
    from hostsieve.sources.tail import TailedLines

    spark.dataSource.register(TailedLines)
    source = spark.readStream.format("tailed_lines").option("path", path).option("start", start).option("block", block)
    return (source.option("marks", marks) if marks else source).load()


def clean_lines(lines: DataFrame) -> DataFrame:
    """Stripped, non-empty lines; other columns stay."""
    return lines.withColumn("value", F.trim("value")).where("value <> ''")


def read_labelled_csv(spark: SparkSession, path, label: str | None = None, query: str = "Domain", drop=("DGA_family", "Type")) -> DataFrame:
    """A CSV with a header: the name column becomes query; with `label`, a constant class."""
    df = spark.read.csv(path, header=True).withColumnRenamed(query, "query").drop(*drop)
    return df.withColumn("class", F.lit(label)) if label else df


def read_named_csvs(spark: SparkSession, paths, pattern: str, most: int | None = None) -> DataFrame:
    """CSVs without a header, the first column the name; the class is what pattern captures in a file's path.

    benign becomes legit. most: rows of each file at most, the smallest by hash; None or less than 0: all.
    """
    df = spark.read.csv(paths, header=False)
    path = F.col("_metadata.file_path")
    name = F.regexp_extract(path, pattern, 1)
    df = df.select(F.col("_c0").alias("query"), F.when(name == "benign", "legit").otherwise(name).alias("class"), path.alias("__file"))
    if most is not None and most >= 0:
        code = F.hex(F.xxhash64("query"))
        df = numbered(df.withColumn("__code", code), ["__file"], F.substr("__code", F.lit(1), F.lit(2)), ["__code", "query"])
        df = df.where(F.col("__r") <= most)
    return df.select("query", "class")


def read_parquet_names(spark: SparkSession, path) -> DataFrame:
    """domain as latin-1 bytes, and class."""
    return spark.read.parquet(path).select(F.decode("domain", "ISO-8859-1").alias("query"), "class")


def read_spaced_log(spark: SparkSession, path) -> DataFrame:
    names = ("timestamp", "return_code", "client_ip", "dns_server", "query", "type", "answer", "size")
    df = spark.read.csv(path, sep=" ", schema=", ".join(f"`{n}` string" for n in names))
    return df.select("query", F.lit("legit").alias("class"))


def union_datasets(sets: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in sets.items():
        df = df.withColumn("dataset", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def export_json(df: DataFrame, path: str) -> None:
    """Line JSON, gzipped."""
    df.write.mode("overwrite").json(path, compression="gzip")


def load_json(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).json(path)


def load_dataset(spark: SparkSession, source, reader: Callable[[SparkSession, str], DataFrame] | None = None) -> DataFrame:
    """A dataset from a DataFrame as it is, or from a path by a reader of the caller, or else as a CSV with a header."""
    if isinstance(source, DataFrame):
        return source
    return reader(spark, source) if reader else spark.read.csv(source, header=True)


def fingerprint(df: DataFrame, options: dict | None = None) -> str:
    """SHA-256 of what rows are made of: the canonical plan, the folders that it reads, and options."""
    plan = df._jdf.queryExecution().analyzed()
    leaves, places = plan.collectLeaves(), []
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            places.append(leaf.relation().location().rootPaths().mkString(","))
    text = json.dumps([plan.canonicalized().toString(), sorted(places), options or {}], sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()


def feature_cache(df: DataFrame, path: str, dataset: str, options: dict | None = None) -> DataFrame:
    """The rows of df as a table at path, partitioned by dataset and by the fingerprint of df's plan and of the options.

    Rows that are there are read and not made again; another plan, another source or a changed option makes a table of its
    own. Contents of files that change under the same name are not seen: name what tells them apart as an option.
    """
    spark, place = df.sparkSession, f"{path}/dataset={dataset}/made_of={fingerprint(df, options)}"
    try:
        known = spark.read.parquet(place)
    except AnalysisException:
        df.write.parquet(place)
        known = spark.read.parquet(place)
    return known.withColumn("dataset", F.lit(dataset))


def verify_rows(messages: DataFrame, ddl: str, nullable=()) -> DataFrame:
    """Parses JSON messages (value) by a schema; ok is false where a column that must not be null is."""
    want = T.StructType.fromDDL(ddl)
    row = messages.withColumn("row", F.from_json("value", want))
    good = F.lit(True)
    for f in want:
        if f.name not in nullable:
            good = good & F.col(f"row.{f.name}").isNotNull()
    return row.withColumn("ok", F.coalesce(good, F.lit(False)))


def route(messages: DataFrame, names) -> dict[str, DataFrame]:
    """Messages (table, value) split by table and parsed by its schema."""
    return {n: messages.where(F.col("table") == n).select(F.from_json("value", schema(n)).alias("r")).select("r.*") for n in names}


_LINE = "part int, us bigint, logline_id bigint, client_ip string, domain_name string, status_code string"


def envelope(lines: DataFrame, key: str = "subnet_id", as_text: bool = False) -> DataFrame:
    """One JSON message for each batch: key, value with id, bounds and its lines in order; as_text: each line as JSON text."""
    line = F.struct("part", "us", "logline_id", "client_ip", "domain_name", "status_code")
    data = F.sort_array(F.collect_list(line))
    rows = lines.groupBy(key, "batch_id").agg(data.alias("data"), F.max("begin_us").alias("begin_us"), F.max("end_us").alias("end_us"))
    if as_text:
        rows = rows.withColumn("data", F.transform("data", lambda x: F.to_json(x)))
    return rows.select(F.col(key).alias("key"), F.to_json(F.struct("batch_id", "begin_us", "end_us", "data")).alias("value"))


def decode_envelope(messages: DataFrame, as_text: bool = False) -> DataFrame:
    """batch_id and the lines of each message; as_text: lines are texts, in which single quotes will do as well."""
    kind = "string" if as_text else f"struct<{_LINE}>"
    row = F.from_json("value", f"batch_id string, begin_us bigint, end_us bigint, data array<{kind}>")
    lines = messages.select(row.alias("m")).select("m.batch_id", F.explode("m.data").alias("l"))
    return lines.select("batch_id", (F.from_json("l", _LINE) if as_text else F.col("l")).alias("l")).select("batch_id", "l.*")


def spread(df: DataFrame, key: Column | str, rows: int, most: int = 200_000) -> DataFrame:
    """df, of which `rows` is the number of rows, dealt by a key to all cores, and to tasks of about `most` rows each.

    What files give isn't asked: a file of few row groups has partitions without rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-rows // most)), key)


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines from the tables events and pages: a row for each event, with the raw line and its class.

    Some lines are malformed: a name that is too long, a record type or an address that is not allowed, a date without a
    time, a field too few, nothing but blanks. Some clients have IPv6 addresses.
    """
    events, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "pages"))
    hosts = pages.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("host"))
    pages_ = F.broadcast(pages.agg(F.count("*").alias("__pages")))  # one row
    e = events.select("event_id", "ts", "user_id", "event_type", "value").crossJoin(pages_)
    e = e.join(hosts, F.expr("event_id % __pages") == F.col("page_id")).drop("page_id", "__pages")
    e = spread(e, "event_id", events.count())  # a table's number of rows stands in its files' footers
    dga, ts = F.col("event_id") % 4 == 0, F.col("ts").cast("timestamp_ntz")
    name = "case when event_id % 173 = 11 then concat(repeat('abcdefghi.', 26), 'com') when event_id % 4 = 0 then concat(substr(md5(cast(event_id as string)), 1, 16), '.com') else host end"
    row = {
        "logline_id": F.col("event_id"),
        "arrival_us": F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts),
        "timestamp": F.when(F.col("event_id") % 89 == 7, F.date_format(ts, "yyyy-MM-dd")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")),
        "status_code": F.when(F.col("event_type") == "error", "NXDOMAIN").otherwise("NOERROR"),
        "client_ip": F.expr("case when user_id % 29 = 3 then concat('fd00:0:0:', user_id % 7 + 1, '::', user_id % 251 + 1) else concat('192.168.', user_id % 7, '.', user_id % 251 + 1) end"),
        "dns_server_ip": F.expr("concat('10.10.0.', event_id % 10 + 1)"),
        "domain_name": F.expr(name),
        "record_type": F.expr("case when event_id % 11 = 0 then 'CNAME' when event_id % 2 = 0 then 'A' else 'AAAA' end"),
        "response_ip": F.expr("case when event_id % 101 = 0 then '10.0.0.300' else concat('10.0.0.', event_id % 250 + 1) end"),
        "size": F.concat(F.floor("value").cast("int").cast("string"), F.lit("b")),
        "class": F.when(dga, "dga").otherwise("legit"),
    }
    e = e.select(*(c.alias(n) for n, c in row.items()))
    names = ("timestamp", "status_code", "client_ip", "dns_server_ip", "domain_name", "record_type", "response_ip", "size")
    short, blank = F.col("logline_id") % 97 == 5, F.col("logline_id") % 211 == 1
    return e.withColumn("value", F.when(blank, "  ").when(short, F.concat_ws(" ", *names[:-1])).otherwise(F.concat_ws(" ", *names)))
