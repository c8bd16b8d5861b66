"""Forests by device: warm-up, retraining, rows kept out after threats, and planted outliers."""

import numpy as np

from duskwatch.streaming import anomaly


def test_turns_by_hand(spark):
    rows = [(1, k, k == 3) for k in range(20)] + [(2, k, False) for k in range(8)]
    got = {(r["g"], r["t"]): (r["accepted"], r["model"]) for r in anomaly.turns(spark.createDataFrame(rows, "g long, t int, threat boolean"), "g", ["t"], "threat").collect()}
    assert [t for t in range(20) if not got[1, t][0]] == [3, 4, 5]
    assert all(got[2, t] == (True, None) for t in range(8))
    # rows 0-2 and 6-10 are the first eight that are accepted: model 0 stands from row 11, the next one four rows later
    assert [got[1, t][1] for t in range(20)] == [None] * 11 + [0, 0, 0, 0, 1, 1, 1, 1, 2]


def test_models_know_only_the_newest_rows_before_them(spark, monkeypatch):
    monkeypatch.setattr(anomaly, "TRAIN", 10)
    rows = anomaly.turns(spark.createDataFrame([(1, k, float(k), False) for k in range(30)], "g long, t int, x double, threat boolean"), "g", ["t"], "threat")
    got = {r["model"]: (r["trained_on"], np.frombuffer(r["forest"]).tolist()) for r in anomaly.models(rows, "g", ["x"], ["t"], lambda x: x.ravel().copy()).collect()}
    assert got == {m: (min(10, 8 + 4 * m), [float(k) for k in range(max(0, 8 + 4 * m - 10), 8 + 4 * m)]) for m in range(6)}


def test_planted_outliers_rank_first_and_models_split(spark, monkeypatch):
    monkeypatch.setattr(anomaly, "SCORED", 40)
    rng = np.random.default_rng(2)
    rows = [(g, k, float(g * 50 + rng.normal()), float(rng.normal()), k == 100) for g in (1, 2, 3) for k in range(220)] + [(g, 500, float(g * 50 + 9), -9.0, False) for g in (1, 2, 3)] + [(1, 501, None, 0.0, False), (None, 1, 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "g long, t int, x double, y double, threat boolean").repartition(5)
    got = anomaly.anomalies(df, "g", ["x", "y"], ["t"], "threat")
    scores = {(r["g"], r["t"]): r for r in got.collect()}
    assert len(scores) == len(rows) and scores[1, 501]["score"] is None and scores[None, 1]["model"] is None
    for g in (1, 2, 3):
        ranked = sorted((r["score"], t) for (h, t), r in scores.items() if h == g and r["score"] is not None and r["trained_on"] > 60)
        assert sum(s >= scores[g, 500]["score"] for s, _ in ranked) <= 4 and scores[g, 500]["score"] > anomaly.ANOMALY and all(0 < s < 1 for s, _ in ranked) and scores[g, 5]["score"] is None
    again = {(r["g"], r["t"]): r["score"] for r in anomaly.anomalies(df.repartition(2), "g", ["x", "y"], ["t"], "threat").collect()}
    assert again == {k: r["score"] for k, r in scores.items()}
