import random

import pytest

from hostsieve.functions import features as ft
from hostsieve.operators import detect
from hostsieve.plans import registry

SF = "/root/testdata/sf0.001"


def noisy(spark, n):
    """Lines whose class has little to do with the name, so that trees grow deep."""
    rng = random.Random(3)
    name = lambda: "".join(rng.choice("abcdefghij0123456789") for _ in range(rng.randint(3, 18)))
    rows = [(k, f"{name()}.{name()}.com", rng.choice(("legit", "dga"))) for k in range(n)]
    return spark.createDataFrame(rows, "logline_id long, domain_name string, class string").repartition(2).checkpoint()


def test_every_valid_line_is_scored(spark, monkeypatch):
    lines = noisy(spark, 300)
    monkeypatch.setattr(registry.Given, "table", lines)
    scores = {r.logline_id: r.p1 for r in registry.QUERIES["detect_scores"](spark, SF).collect()}
    held = {r.logline_id: r.p1 for r in registry.QUERIES["train_rf"](spark, SF).collect()}
    assert sorted(scores) == list(range(300))
    assert 149 <= len(held) <= 151 and all(scores[k] == p for k, p in held.items())


def test_warnings_are_all_likely_lines_of_suspicious_batches(spark):
    p1 = {r.logline_id: r.p1 for r in registry.QUERIES["detect_scores"](spark, SF).collect()}
    lines = registry.Given(spark, SF).by_client.select("suspicious_batch_id", "logline_id").collect()
    want = sorted((r.suspicious_batch_id, r.logline_id) for r in lines if p1[r.logline_id] > 0.5)
    got = registry.QUERIES["warnings"](spark, SF).collect()
    assert want and sorted((r.suspicious_batch_id, r.logline_id) for r in got) == want


def test_all_rules_are_judged_on_held_out_lines(spark, monkeypatch):
    lines = noisy(spark, 600)
    monkeypatch.setattr(registry.Given, "table", lines)
    fitted, held = registry._halves(registry.Given(spark, SF))
    rules = detect.rules(detect.train(fitted), list(ft.all_features()))
    rows = held.drop("features").toPandas()
    want = []
    for rule in rules:
        hit = rows.query(rule.replace("AND", "and")).label
        want.append((rule, len(hit), float(hit.mean()) if len(hit) else 0.0))
    got = registry.QUERIES["rules"](spark, SF).collect()
    assert len(want) > 100
    assert sorted((r.rule, r.support) for r in got) == sorted(w[:2] for w in want)
    assert [r.precision for r in sorted(got)] == pytest.approx([w[2] for w in sorted(want)])


def test_no_rules(spark):
    assert detect.rule_quality(spark.createDataFrame([(1.0,)], "label double"), []).count() == 0


def separable(spark, n=400):
    """Vectors of two numbers, of which the first tells the label but for every seventh row; every fourth validates."""
    from pyspark.ml.linalg import Vectors

    rng = random.Random(9)
    rows = []
    for k in range(n):
        x, y = rng.random(), rng.random()
        rows.append((k, x, y, Vectors.dense([x, y]), float((x > 0.5) != (k % 7 == 0)), k % 4 == 0))
    return spark.createDataFrame(rows, ["id", "x", "y", "features", "label", "valid"]).repartition(2)


def test_boosting_stops_early_on_held_out_rows(spark):
    df = separable(spark)
    stopped = detect.train(df, "gbt", validation="valid", rounds=60)
    assert 1 <= stopped.getNumTrees < 60
    with pytest.raises(ValueError):
        detect.train(df, "rf", validation="valid")
    with pytest.raises(ValueError):
        detect.train(df, "other")


def test_rules_of_boosted_trees_add_up_to_the_model(spark):
    df = separable(spark)
    model = detect.train(df, "gbt", rounds=4)
    leaves = detect.leaves(model, ["x", "y"])
    rows = df.select("id", "x", "y").toPandas().sort_values("id")
    margin = 0.0
    for path, value in leaves:
        margin = margin + value * (rows.eval(path.replace("AND", "and").replace("`", "")).astype(float) if path else 1.0)
    got = [float(r.rawPrediction[1]) for r in model.transform(df).select("id", "rawPrediction").orderBy("id").collect()]
    assert list(margin) == pytest.approx(got)
    quality = {r.rule: r for r in detect.rule_quality(df, detect.rules(model, ["x", "y"])).collect()}
    assert quality and max(r.precision for r in quality.values() if r.support > 50) > 0.8


def test_an_estimator_of_the_caller_and_a_search_over_boosted_trees(spark):
    from pyspark.ml.classification import LogisticRegression

    df = separable(spark, 200)
    model = detect.train(df, LogisticRegression(maxIter=5))
    assert detect.detect(model, df).where("p1 between 0 and 1").count() == 200
    best = detect.tune(df, trials=2, folds=2, kind="gbt").bestModel
    assert best.getNumTrees in (5, 10, 20)
    with pytest.raises(ValueError):
        detect.tune(df, kind="other")
