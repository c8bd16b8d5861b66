"""The classifier's gate, its figures against plain ones, and its scores."""

import random

from pyspark.sql import functions as F

from duskwatch.plans import classifier


def alerts(spark, n, leak=False, noise=0.15, seed=3):
    rng, rows = random.Random(seed), []
    for k in range(n):
        a, b, c = rng.random(), rng.random(), rng.random()
        y = int((a > 0.5) != (b > 0.5)) if rng.random() > noise else rng.randrange(2)
        rows.append((k, a, None if k % 50 == 0 else b, float(y) + c * 0.4 if leak else c, y))
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int")


def balanced(pairs):
    shares = [sum(p == y for y, p in pairs if y == c) / sum(y == c for y, _ in pairs) for c in {y for y, _ in pairs}]
    return sum(shares) / len(shares)


def test_a_good_model_is_accepted_and_calibrated(spark, monkeypatch):
    monkeypatch.setattr(classifier, "TREES", 12)
    rows = alerts(spark, 1500)
    got = classifier.train(rows, ["a", "b", "c"], "y", ["id"])
    assert got.gate.reasons == [] and 0.75 < got.gate.accuracy <= 1.0 and got.gate.separation < 0.7
    scored = got.scored(rows, F.lit(0.5)).collect()
    assert len(scored) == 1500 and all(0 <= r["probability"] <= 1 and r["by"] == "model" for r in scored)
    fresh = got.scored(alerts(spark, 400, seed=8), F.lit(0.5)).collect()
    assert balanced([(r["y"], int(r["probability"] > 0.5)) for r in fresh]) > 0.75
    # the held-out accuracy equals a plain count over the same rows
    held = classifier._split(rows, "y", ["id"]).where("held_out")
    judged = got.model.transform(classifier._filled(held, ["a", "b", "c"])).select("y", "prediction").collect()
    assert abs(got.gate.accuracy - balanced([(r["y"], int(r["prediction"])) for r in judged])) < 1e-12


def test_a_leaking_feature_and_too_few_rows_are_refused(spark, monkeypatch):
    monkeypatch.setattr(classifier, "TREES", 2)
    leaking = classifier.train(alerts(spark, 600, leak=True), ["a", "b", "c"], "y", ["id"])
    assert leaking.gate.best_feature == "c" and leaking.gate.separation == 1.0 and "leaked" in leaking.gate.reasons[-1]
    few = classifier.train(alerts(spark, 100), ["a", "b"], "y", ["id"])
    assert few.model is None and "held-out" in few.gate.reasons[0]
    assert {(r["probability"], r["by"]) for r in few.scored(alerts(spark, 5), F.lit(0.25)).collect()} == {(0.25, "fallback")}
    one = classifier.train(alerts(spark, 600).withColumn("y", F.lit(1)), ["a", "b"], "y", ["id"])
    assert one.gate.reasons and classifier.train(alerts(spark, 600).limit(0), ["a"], "y", ["id"]).gate.held_out == 0


def test_chance_is_refused(spark, monkeypatch):
    monkeypatch.setattr(classifier, "TREES", 2)
    assert "balanced accuracy" in classifier.train(alerts(spark, 800, noise=1.0), ["a", "b", "c"], "y", ["id"]).gate.reasons[0]


def test_single_feature_thresholds_equal_all_cuts(spark):
    rows = classifier._filled(alerts(spark, 180, noise=0.5), ["a", "c"]).withColumn("y", F.col("y").cast("double"))
    data = rows.select("y", "__a", "__c").collect()
    best = {}
    for f in ("a", "c"):
        for cut in {r[f"__{f}"] for r in data}:
            acc = balanced([(r["y"], float(r[f"__{f}"] > cut)) for r in data])
            best[f] = max(best.get(f, 0), acc, 1 - acc)
    name, separation = classifier.best_single_feature(rows, ["a", "c"], "y")
    assert name == max(best, key=best.get) and abs(separation - max(best.values())) < 1e-9
