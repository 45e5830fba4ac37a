"""WARC archives: a Python data source that reads them, and a writer that is plain Spark.

The reader plans its partitions by file and size, takes predicates on record headers from the optimiser, parses a
record's headers first and passes over the block of a record that no predicate lets through, or whose payload isn't asked
for. The writer makes each record one string and lets the text sink write them, with the blank lines that end a record
as the line separator; so executors need no other file access than Spark's own.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from hostsieve.llm.common import shared_dir

SCHEMA = "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, http_length long, payload binary"
#: Header of each column.
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}
#: The digits of base 32, and those of Spark's conv().
BASE32, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"


@dataclass
class Files(InputPartition):
    names: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.with_payload = options["path"], options.get("payload", "true").lower() == "true"
        self.split = int(options.get("splitBytes", 32 << 20))
        self.wanted: list[tuple[str, set]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") else None
            if column in HEADERS and isinstance(f, EqualTo | In):
                self.wanted.append((column, {f.value} if isinstance(f, EqualTo) else set(f.value)))
            elif not (column in HEADERS and isinstance(f, IsNotNull) and any(c == column for c, _ in self.wanted)):
                yield f

    def partitions(self) -> list[Files]:
        fs, path = FileSystem.from_uri(self.path)
        found = fs.get_file_info(FileSelector(path, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == FileType.File and (".warc" in f.path or f.path.endswith((".txt.gz", ".txt"))))
        files = [f for f in files if not f[0].rpartition("/")[2].startswith(("_", "."))]
        out, size = [Files([])], 0
        for name, n in files:
            if out[-1].names and size + n > self.split:
                out.append(Files([]))
                size = 0
            out[-1].names.append(name)
            size += n
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = FileSystem.from_uri(self.path)
        rows, size = [], 0
        for name in partition.names:
            with fs.open_input_file(name) as file:
                stream = gzip.GzipFile(fileobj=file) if name.endswith(".gz") else file
                for row in records(io.BufferedReader(stream, 1 << 20), self.wanted, self.with_payload):
                    rows.append(row)
                    size += len(row[-1] or b"")
                    if len(rows) >= 1000 or size > 8 << 20:
                        yield batch(rows)
                        rows, size = [], 0
        yield batch(rows)


def records(stream, wanted: list[tuple[str, set]] = (), with_payload: bool = True) -> Iterator[tuple]:
    """The rows of one archive. Only blocks of wanted records are kept; the others are read past."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        head = headers(stream)
        values = {c: head.get(h) for c, h in HEADERS.items()}
        left = int(head.get("content-length", 0))
        if not all(values[c] in allowed for c, allowed in wanted):
            skip(stream, left)
            continue
        length, http = None, head.get("content-type", "").startswith("application/http")
        if http:
            raw = [stream.readline()]
            while raw[-1].strip():
                raw.append(stream.readline())
            left -= sum(map(len, raw))
            length = headers(io.BytesIO(b"".join(raw[1:]))).get("content-length")
        payload = None
        if with_payload and (values["record_type"] == "response" or not http):
            payload = stream.read(left)
        else:
            skip(stream, left)
        yield (*values.values(), None if length is None else int(length), payload)


def skip(stream, n: int) -> None:
    """Reads past n bytes without keeping them."""
    while n and (got := len(stream.read(min(n, 1 << 20)))):
        n -= got


def headers(stream) -> dict[str, str]:
    out = {}
    while (line := stream.readline()).strip():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])


class WarcSource(DataSource):
    """spark.read.format("warc").load(path). Options: payload (false: headers only), splitBytes (bytes of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def sha1_base32(payload: Column) -> Column:
    """Upper-case base 32 of the SHA-1, which is taken once: each ten hex digits of it are eight digits of five bits."""
    eight = lambda code, k: F.translate(F.lpad(F.conv(F.substr(code, F.lit(k), F.lit(10)), 16, 32), 8, "0"), DIGITS, BASE32)
    return F.transform(F.array(F.sha1(payload)), lambda code: F.concat(*(eight(code, k) for k in (1, 11, 21, 31))))[0]


def write_warc(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes one record for each row of pages (page_id, url, html) into gzipped archives under path.

    Of rows with equal payloads, that with the largest page_id is a response and the others are revisits that refer to
    it and hold HTTP headers alone. Null html is an empty payload, and empty payloads are equal like others. Rows that
    repeat the largest page_id are all responses. Null page_ids count as smaller than others and have an empty id.
    Control characters and blanks of a url are percent-encoded, so that no header line breaks.
    """
    id_of = F.coalesce(F.col("page_id").cast("long"), F.lit(-(1 << 63)))
    rows = pages.select(
        id_of.alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html")
    ).withColumn("digest", sha1_base32(F.col("html").cast("binary")))
    known = rows.select("page_id", "digest").distinct()
    last = known.groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = known.join(last, "digest").where("page_id < original")
    rows = rows.join(revisits, ["page_id", "digest"], "left")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.when(c == F.lit(-(1 << 63)), "").otherwise(c.cast("string")), F.lit(">"))
    again, size = F.col("original").isNotNull(), F.octet_length("html").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(again, "").otherwise(F.col("html")))
    url = F.regexp_replace(F.regexp_replace("url", r"[\r\n]", "%0A"), r"[\x00-\x20\x7f]", "%20")
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("original")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    records_ = rows.select(F.concat(head, F.lit("\r\n\r\n"), block).alias("value"))
    records_.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages as archives and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Two scans, each with its predicate on the record type pushed into the source: responses with their payload, which
    size and digest are taken from, and revisits by their headers alone. An empty table gives an empty result, and
    columns other than page_id, url and html are not read.
    """
    spark = pages.sparkSession
    path = shared_dir(spark)
    write_warc(pages, path)
    id_of = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(.*)>$", 1), F.lit("")).cast("long")

    def rows(kind: str, size: Column, digest: Column) -> DataFrame:
        return (
            read_warc(spark, path, payload=kind == "response")
            .where(F.col("record_type") == kind)
            .select(id_of("record_id").alias("page_id"), size.cast("long").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", id_of("refers_to").alias("refers_to"))
        )

    payload = F.col("payload")
    return rows("response", F.octet_length(payload), sha1_base32(payload)).unionByName(
        rows("revisit", F.col("http_length"), F.regexp_replace("payload_digest", "^sha1:", ""))
    )
