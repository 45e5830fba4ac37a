"""The static stages on small tables: batches, series, numbering, run_batch, training files."""

import random

import pytest
from pyspark.sql import functions as F

from hostsieve import training
from hostsieve.functions.lines import is_ip, network
from hostsieve.operators import batching, detect, explore, numbering, series
from hostsieve.plans.flow import Options, run_batch
from hostsieve.sources import tables

BATCHED = "subnet_id string, us long, logline_id long, b long"


def test_overlap_and_bounds(spark):
    """Two batches of one subnet, the second with the first; a third after a gap stands alone."""
    rows = spark.createDataFrame([("s", 119, 1, 0), ("s", 249, 2, 0), ("s", 319, 3, 1), ("s", 749, 4, 1), ("s", 990, 5, 3)], BATCHED)
    bounds = batching.bounds(rows)
    assert sorted((r.b, r.begin_us, r.end_us, r.n, r.n0) for r in bounds.collect()) == [(0, 119, 249, 2, 0), (1, 119, 749, 2, 2), (3, 990, 990, 1, 0)]
    pos = sorted((r.b, r.pos, r.logline_id, r.part) for r in batching.ordered(batching.overlap(rows, bounds)).collect())
    assert pos == [(0, 1, 1, 1), (0, 2, 2, 1), (1, 1, 1, 0), (1, 2, 2, 0), (1, 3, 3, 1), (1, 4, 4, 1), (3, 1, 5, 1)]
    levels = sorted((r.entry_type[-7:], r.bucket, r.entry_count) for r in batching.fill_levels(rows, bounds, 100).collect())
    assert [x for x in levels if x[0] == "batches"][-1][2] == 0 and [x for x in levels if x[0] == "_buffer"] == [("_buffer", 2, 2), ("_buffer", 7, 2), ("_buffer", 9, 1)]


def test_numbers_in_two_steps(spark):
    draw = random.Random(2)
    rows = [(draw.choice(("a", "b", None)), draw.randrange(40), k) for k in range(300)]
    df = spark.createDataFrame(rows, "k string, x long, id long")
    got = {r.id: (r["__r"], r["__n"]) for r in numbering.numbered(df, ["k"], F.floor(F.col("x") / 7), ["x", "id"]).collect()}
    for key in ("a", "b", None):
        own = sorted((x, i) for k, x, i in rows if k == key)
        assert [got[i] for _, i in own] == [(n + 1, len(own)) for n in range(len(own))]


def test_running_sums_over_ranges(spark):
    df = spark.createDataFrame([(x, x % 3, 1) for x in range(50)], "x long, n0 long, n1 long").where("x % 7 <> 0")
    got = sorted(map(tuple, numbering.running_sums(df, "x", ["n0", "n1"], parts=5).collect()))
    xs, a = [x for x in range(50) if x % 7], 0
    for (x, nxt, n0, n1, all0, all1), k in zip(got, range(len(xs)), strict=True):
        a += xs[k] % 3
        assert (x, nxt, n0, n1, all0, all1) == (xs[k], xs[k + 1] if k + 1 < len(xs) else None, a, k + 1, sum(v % 3 for v in xs), len(xs))


@pytest.mark.parametrize(("span", "steps"), [(0, 1), (20_000, 2), (20_001, 3)])
def test_steps(spark, span, steps):
    one = spark.createDataFrame([("x", 5, 5 + span)], "batch_id string, begin_us long, end_us long")
    for chunk in (1 << 16, 2):
        assert sorted(r.step for r in series.axis(one, 20_000, chunk).collect()) == list(range(steps))


def test_counts_per_step(spark):
    batch = spark.createDataFrame([("x", 0, 2000)], "batch_id string, begin_us long, end_us long")
    lines = spark.createDataFrame([("x", 0, 2000, 1000, "100b"), ("x", 0, 2000, 10_000, "7b"), ("x", 0, 2000, 1500, "50b")], "batch_id string, begin_us long, end_us long, us long, size string")
    assert sorted((r.step, r.n, r.size) for r in series.series(batch, lines, 1000).collect()) == [(0, 0, 0.0), (1, 2, 75.0), (2, 0, 0.0)]
    assert sorted((r.step, r.n) for r in series.series(batch, lines, 1000, "last_distinct").collect()) == [(0, 0), (1, 1), (2, 0)]
    assert series.check_inspection("univariate", ["zscore", "mad"]) == ["zscore"]
    assert series.check_inspection("ensemble", ["zscore", "mad"]) == ["zscore", "mad"]
    for mode, models in (("other", ["zscore"]), ("univariate", ["other"]), ("univariate", [])):
        with pytest.raises(NotImplementedError):
            series.check_inspection(mode, models)


def test_addresses(spark):
    import ipaddress

    some = ["1.2.3.4", "256.1.1.1", "01.1.1.1", "::", "::1", "1::", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8:9", "::ffff:1.2.3.4", "fe80::1%eth0", "fe80::1%", "12345::", "g::", "1::2::3", "0:AB:0:0:1:0:0:0", "", "1:2"]

    def ok(x):
        try:
            return bool(ipaddress.ip_address(x))
        except ValueError:
            return False

    df = spark.createDataFrame([(x,) for x in some], "x string")
    assert {r.x: r.ok for r in df.select("x", is_ip(F.col("x")).alias("ok")).collect()} == {x: ok(x) for x in some}
    good = df.where(F.col("x").isin([x for x in some if ok(x) and "%" not in x]))
    for prefix in (0, 48, 63, 64, 100, 128):
        for r in good.select("x", network(F.col("x"), 12, prefix).alias("n")).collect():
            assert r.n == str(ipaddress.ip_network((r.x, 12 if ":" not in r.x else prefix), strict=False).network_address)


def test_run_batch_fills_every_table(spark, tmp_path):
    draw, rows = random.Random(5), ["", None, "a b c"]
    for k in range(150):
        name = f"{draw.getrandbits(64):016x}.com" if 90 < k < 120 else "www.example.com"
        status = "NXDOMAIN" if 90 < k < 120 or k % 3 == 0 else "NOERROR"
        rows.append(f"2025-01-01T00:{k // 60:02d}:{k % 60:02d}.000000Z {status} 192.168.1.{k % 3 + 1} 10.0.0.1 {name} A 10.0.0.2 {k}b")
    out = run_batch(spark.createDataFrame([(r,) for r in rows], "value string"), Options(batch_us=30_000_000, step_us=1_000_000))
    tables.create_tables(spark, str(tmp_path))
    counts = {}
    for name in tables.TABLES:
        if name in out:
            tables.append(out[name], str(tmp_path), name)
        counts[name] = tables.read_table(spark, str(tmp_path), name).count()
    assert counts["server_logs"] == 153 and counts["failed_dns_loglines"] == 3 and counts["dns_loglines"] == counts["logline_to_batches"] == 150
    assert counts["alerts"] > 0 and counts["dgta_dataset"] == 0 and tables.preview(spark, str(tmp_path), "dns_loglines").count() == 10
    states = {r.status for r in tables.read_table(spark, str(tmp_path), "logline_timestamps").select("status").distinct().collect()}
    assert states == {"in_process", "finished", "batched", "filtered_out", "detected"}
    tables.drop_table(spark, str(tmp_path), "alerts")
    assert not (tmp_path / "alerts").exists()
    tables.create_tables(spark, str(tmp_path))
    assert tables.read_table(spark, str(tmp_path), "alerts").count() == 0 and counts["dns_loglines"] == tables.read_table(spark, str(tmp_path), "dns_loglines").count()
    with pytest.raises(ValueError):
        tables.append(spark.range(1), str(tmp_path), "alerts")
    with pytest.raises(ValueError):
        Options().format.__class__(())


def test_equal_lines_are_lines_of_their_own(spark):
    row = "2025-01-01T00:00:01.000000Z NXDOMAIN 192.168.1.3 10.0.0.1 aaaa.com A 10.0.0.2 5b"
    lines = spark.createDataFrame([(row,), (row,), (row.replace("aaaa", "bbbb"),), ("bad",), ("bad",)], "value string")
    out = run_batch(lines, Options(batch_us=30_000_000, step_us=1_000_000))
    ids = [r.logline_id for r in out["dns_loglines"].collect()]
    assert len(ids) == len(set(ids)) == 3 and out["failed_dns_loglines"].count() == 2
    assert sorted(r.logline_id for r in out["logline_to_batches"].collect()) == sorted(ids)
    ends = out["logline_timestamps"].where("stage like 'data_%'").collect()
    assert sorted(r.logline_id for r in ends) == sorted(ids)
    assert {r.message_count for r in out["batch_timestamps"].where("status = 'completed'").collect()} == {3}


def test_scratch_folders_go(spark, tmp_path):
    from pathlib import Path

    from hostsieve.sources.shared import scratch

    there = lambda: set(Path(spark.conf.get("spark.checkpoint.dir")).iterdir())
    before = there()
    lines = spark.createDataFrame([("2025-01-01T00:00:01.000000Z NXDOMAIN 192.168.1.3 10.0.0.1 aaaa.com A 10.0.0.2 5b",)], "value string")
    with scratch(spark):
        run_batch(lines)["logline_timestamps"].write.parquet(str(tmp_path / "out"))
        assert there() - before
    assert there() == before and spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_modes_by_options(spark):
    rows = [("x", k, (50 if k == 40 else k % 3), float(k % 5)) for k in range(60)]
    df = spark.createDataFrame(rows, "batch_id string, step long, n long, size double")
    one = {r.step: r.score for r in Options().scorer(df).collect()}
    assert max(one, key=one.get) == 40
    own = lambda df: df.withColumn("score", F.lit(1.0))
    both = {r.step: r.score for r in Options(mode="ensemble", models=("zscore", "custom"), score=own).scorer(df).collect()}
    assert all(both[k] == pytest.approx((one[k] + 1) / 2) for k in one)
    votes = Options(mode="ensemble", models=("zscore", "mad", "knn", "pot"), combine="vote").scorer(df)
    assert set(votes.columns) == {"batch_id", "step", "n", "size", "score"} and {r.step for r in votes.where("score > 0.5").collect()} >= {40}
    assert Options(mode="multivariate", models=("loda",)).scorer(df).where("score between 0 and 1").count() == 60
    assert Options(models=(), score=own).scorer(df).where("score = 1").count() == 60
    for bad in ({"mode": "univariate", "models": ("loda",)}, {"mode": "multivariate", "models": ("zscore",)}, {"models": ("other",)}, {"combine": "product"}):
        with pytest.raises(NotImplementedError):
            Options(**bad)
    with pytest.raises(ValueError):
        Options(models=("custom",))


def test_distances_of_all_columns(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    a, b, label = rng.integers(0, 9, 200), rng.normal(size=200).round(2), rng.integers(0, 2, 200)
    df = spark.createDataFrame([(int(x), float(y), 3.0, int(z)) for x, y, z in zip(a, b, label, strict=True)], "a long, b double, c double, label int")
    got = {r.feature: r for r in explore.distances(df, ["a", "b", "c"]).collect()}
    for name, x in (("a", a), ("b", b)):
        xs = np.unique(x)
        cdf = [np.array([(x[label == k] <= v).mean() for v in xs]) for k in (0, 1)]
        gap = np.abs(cdf[0] - cdf[1])
        assert got[name].statistic == pytest.approx(gap.max()) and got[name].emd == pytest.approx((gap[:-1] * np.diff(xs)).sum())
        assert (got[name].n0, got[name].n1) == ((label == 0).sum(), (label == 1).sum())
    assert got["c"].statistic == 0 and got["c"].p_value == 1
    bins = {(r.label, r.bin): r.n for r in explore.histograms(df, ["b"], 5).collect()}
    for k in (0, 1):
        want = np.histogram(b[label == k], 5, (b.min(), b.max()))[0]
        assert [bins.get((k, j + 1), 0) for j in range(5)] == pytest.approx(want, abs=1)
    assert {r.bin for r in explore.histograms(df, ["c"]).collect()} == {1}


def test_explained_variance(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    x = np.random.default_rng(2).normal(size=(80, 3)) * [3, 2, 1]
    model, rows = explore.pca(spark.createDataFrame([(Vectors.dense(r),) for r in x.tolist()], ["features"]), k=2)
    e = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert explore.explained(model) == pytest.approx(list(e[:2] / e.sum())) and rows.count() == 80


def test_names_and_components(spark):
    assert detect.clean_names(["a b", "a-b", " x ", "", "a_b"]) == ["a_b", "a_b_2", "x", "column", "a_b_3"]
    df = spark.createDataFrame([(3.0, 4.0)], "x double, y double")
    assert tuple(explore.principal_removed(df, ["x", "y"], [1.0, 0.0]).first()) == (0.0, 4.0)


def test_training_files(spark, tmp_path):
    draw = random.Random(6)
    made = [(f"{draw.getrandbits(60):015x}.com", "dga") for _ in range(60)] + [(f"{a}{b}.org", "benign") for a in ("mail", "shop", "news", "blog") for b in ("house", "garden", "music", "travel", "sport")]
    for kind in ("dga", "benign"):
        (tmp_path / f"set_{kind}.csv").write_text("".join(f"{q},x\n" for q, c in made if c == kind))
    names = training.readers()["named-csv"](spark, str(tmp_path))
    assert {(r["class"], r.n) for r in names.groupBy("class").agg(F.count("*").alias("n")).collect()} == {("dga", 60), ("legit", 20)}
    capped = training.readers(max_rows=7)["named-csv"](spark, str(tmp_path))
    assert {(r["class"], r.n) for r in capped.groupBy("class").agg(F.count("*").alias("n")).collect()} == {("dga", 7), ("legit", 7)}
    code = training.train_model(names, str(tmp_path / "model"))
    report, wrong = training.test_model(names, str(tmp_path / "model"), sha256=code)
    row = report.first()
    assert row.tp + row.fp + row.fn + row.tn == 80 and row.accuracy > 0.9 and wrong.count() == row.fp + row.fn
    assert training.explain_model(names, str(tmp_path / "model")).where("precision > 0.9").count() > 0
    with pytest.raises(ValueError):
        training.test_model(names, str(tmp_path / "model"), sha256="0")
    from pyspark.ml.classification import GBTClassificationModel

    training.train_model(names, str(tmp_path / "boosted"), "gbt")
    report, _ = training.test_model(names, str(tmp_path / "boosted"), GBTClassificationModel)
    assert report.first().accuracy > 0.9 and training.explain_model(names, str(tmp_path / "boosted"), GBTClassificationModel).where("support > 0").count() > 0
