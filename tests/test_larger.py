"""What grows with the tables: rows for each task, and how often something is made."""

import pytest
from pyspark.sql import functions as F

from hostsieve.functions import features as ft
from hostsieve.plans import registry
from hostsieve.sources import tables

SF = "/root/testdata/sf0.001"


def read_by(df) -> set[str]:
    """The columns that a plan reads from files."""
    leaves, out = df._jdf.queryExecution().optimizedPlan().collectLeaves(), set()
    for k in range(leaves.size()):
        out |= set(leaves.apply(k).output().mkString(",").replace("#", ",").split(","))
    return out


def test_a_file_of_one_row_group_is_dealt_to_all_cores(spark, tmp_path):
    for name in ("events", "pages"):
        spark.read.parquet(f"{SF}/{name}.parquet").coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # more splits than cores, and rows in one of them
    try:
        lines = tables.log_lines(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert max(r["count"] for r in lines) < sum(r["count"] for r in lines) / 2


def test_tasks_grow_in_number_and_not_in_rows(spark):
    rows = spark.range(1000).toDF("k")
    dealt = tables.spread(rows, "k", 1000, most=50)
    assert dealt.rdd.getNumPartitions() == 20 and dealt.count() == 1000


def test_features_are_made_once_for_each_name(spark):
    f = registry.Given(spark, SF)
    got, want = registry._features(f), f.valid
    assert got.count() == want.select("domain_name", "class").distinct().count() < want.count()
    assert got.agg(F.sum("c")).first()[0] == want.count()


def test_columns_of_features_are_as_defined(spark):
    names = ["zz.aaaa.com.", "", None, "a", "ÄÖ.Straße-7.example", "{|}~.zZ", "x" * 250, "..", "İ.I"]
    df = spark.createDataFrame([(n,) for n in names], "domain_name string")
    want = ft.with_levels(df).select(*(c.cast("double").alias(n) for n, c in ft.all_features().items())).collect()
    got = ft.with_features(df).select(*(F.col(n).cast("double") for n in ft.all_features())).collect()
    assert [tuple(r) for r in got] == [pytest.approx(tuple(r)) if None not in tuple(r) else tuple(r) for r in want]


@pytest.mark.parametrize("query", ["pca", "detect_scores"])
def test_vectors_are_written_and_not_made_again(spark, query):
    columns = read_by(registry.QUERIES[query](spark, SF))
    assert "features" in columns and not columns & {"value", "url", "client_ip", "class"}


def test_a_line_has_one_event_before_the_inspector_for_its_state(spark):
    from hostsieve.operators import detect

    f = registry.Given(spark, SF)
    assert f.last_line_events.where("rank < 6").count() == f.table.count()
    state = lambda events: sorted(detect.current_state(events.withColumn("rank", F.struct("rank", (F.col("status") == "detected").alias("found")))).select("key", "stage", "status", "is_active").collect())
    assert state(f.last_line_events) == state(f.line_events)


def test_warnings_score_names_and_not_lines(spark):
    columns = read_by(registry.QUERIES["warnings"](spark, SF))
    assert "p1" in columns and not columns & {"features", "value", "url"}


def test_vectors_of_lines_are_made_once_for_each_name(spark):
    from pyspark.ml.functions import vector_to_array

    f = registry.Given(spark, SF)
    texts = lambda rows: sorted(str(tuple(r)) for r in rows.select("logline_id", vector_to_array("features")).collect())
    assert f.names.count() == f.table.select("domain_name").distinct().count() < f.table.count()
    assert texts(registry._split(f)) == texts(ft.feature_vector(f.table))


@pytest.mark.parametrize("share", [1, 3, 100])
def test_frequent_and_rare_names_meet_their_rows(spark, share):
    from hostsieve.operators.names import by_name

    of = ["a"] * 50 + ["b"] * 30 + ["c", "d", "d"]
    rows = spark.createDataFrame(list(enumerate(of)), "k long, domain_name string")
    names = rows.groupBy("domain_name").agg(F.count("*").alias("c")).withColumn("x", F.upper("domain_name"))
    for order in ([], ["domain_name", "k"]):
        got = by_name(rows, names, order, share).select("k", "x").collect()
        assert sorted(map(tuple, got)) == [(k, n.upper()) for k, n in enumerate(of)]
    assert by_name(rows.where("false"), names.where("false")).count() == 0


def test_lines_are_made_once_for_all_monitoring_tables(spark, monkeypatch):
    seen, run = [], registry.flow.run_batch
    monkeypatch.setattr(registry.flow, "run_batch", lambda lines, options: seen.append(read_by(lines)) or run(lines, options))
    got = {r.name: r.n for r in registry.QUERIES["table_catalog"](spark, SF).collect()}
    assert len(seen) == 1 and "value" in seen[0] and not seen[0] & {"event_id", "user_id", "url"}
    assert got["server_logs"] == spark.read.parquet(f"{SF}/events.parquet").count()


def test_rules_are_judged_by_weight(spark):
    from hostsieve.operators import detect

    rows = spark.createDataFrame([(1, 1.0, 3), (1, 0.0, 2), (5, 1.0, 4)], "x int, label double, c int")
    each = rows.select("x", "label", F.explode(F.expr("array_repeat(0, c)")))
    got, want = (sorted(map(tuple, detect.rule_quality(df, ["x <= 2", "x > 9"], w).collect())) for df, w in ((rows, "c"), (each, None)))
    assert got == want == [("x <= 2", 5, 0.6), ("x > 9", 0, 0.0)]
