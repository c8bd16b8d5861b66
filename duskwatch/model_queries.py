"""Queries of fitted models: scores that no SQL expresses, and their gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .cycle_queries import PROB, STOPS, VECTOR, decisions, judged
from .operators.stored import written
from .plans import classifier
from .plans import cycles as C
from .queries import query
from .streaming import anomaly


def reviewed(s, d):
    """Alerts with the classifier's eleven inputs; ``label`` is 1 where an alert was muted by trust and no hard stop forbids that, else 0."""
    stopped = F.greatest(*[F.expr(C.doubles(e)).cast("int") for e in STOPS.values()])
    muted = F.coalesce("cached", F.lit(False)) & (stopped == 0)
    return judged(s, d).select("user_id", "week", *VECTOR, muted.cast("int").alias("label"), F.expr(C.doubles(PROB)).alias("fallback"))


@query()
def fp_classifier(s, d):
    """Probability of every alert to be a false positive, of the boosted trees if the gate accepts them, else of the rule, beside the gate's figures."""
    rows = written(reviewed(s, d))  # read by training and again by scoring
    model = classifier.train(rows, VECTOR, "label", ["user_id", "week"])
    gate = F.struct(F.lit(model.gate.held_out).alias("held_out"), F.lit(model.gate.accuracy).cast("double").alias("accuracy"), F.lit(model.gate.separation).cast("double").alias("separation"), F.lit("; ".join(model.gate.reasons)).alias("reasons"))
    return model.scored(rows, F.col("fallback")).select("user_id", "week", F.round("probability", 6).alias("probability"), "by", gate.alias("gate"))


@query()
def ml_anomaly(s, d):
    """Cycles scored by their device's newest forest of earlier, threat-free cycles; ``fires`` where the score counts as evidence."""
    rows = decisions(s, d).select("user_id", "week", *[F.col(c).cast("double").alias(c) for c in VECTOR], F.col("state").isin("CRITICAL", "HIGH").alias("threat"))
    found = anomaly.anomalies(rows, "user_id", VECTOR, ["week"], "threat")
    return found.withColumn("fires", F.coalesce(F.col("score") > anomaly.ANOMALY, F.lit(False)))
