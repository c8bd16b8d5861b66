"""A gradient-boosted classifier of false positives with an acceptance gate and a calibration on held-out rows.

Training, scoring and every figure of the gate are Spark jobs; the driver sees class counts, tallies of at most CUTS buckets a feature, and the trees.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.stored import written

#: One row in so many of each class is held out.
HELD_OUT_EVERY = 4
#: The gate: least held-out rows, least balanced accuracy there, and the balanced accuracy at which a single feature counts as a leaked label.
LEAST_HELD_OUT, LEAST_ACCURACY, MOST_SEPARATION = 40, 0.65, 0.98
#: Cut points tried for a single feature, and trees and their depth.
CUTS, TREES, DEPTH = 200, 50, 3


@dataclass
class Gate:
    """Figures of a fitted model on held-out rows, and why it is refused; no reason means that it is accepted."""

    held_out: int = 0
    accuracy: float | None = None
    best_feature: str | None = None
    separation: float | None = None
    reasons: list[str] = field(default_factory=list)


@dataclass
class Classifier:
    features: list[str]
    gate: Gate
    model: PipelineModel | None = None
    calibration: IsotonicRegressionModel | None = None

    def scored(self, rows: DataFrame, fallback) -> DataFrame:
        """``rows`` with ``probability`` that an alert is a false positive and ``by`` (model or fallback): ``fallback`` (a Column) where the gate refused the model."""
        if self.model is None or self.gate.reasons:
            return rows.withColumn("probability", fallback.cast("double")).withColumn("by", F.lit("fallback"))
        out = self.model.transform(_filled(rows, self.features)).withColumn("raw", vector_to_array("probability")[1])
        if self.calibration:
            out = self.calibration.transform(out.drop("features", "prediction"))
            out = out.withColumn("raw", F.col("prediction"))
        return out.select(*rows.columns, F.col("raw").alias("probability"), F.lit("model").alias("by"))


def _filled(rows: DataFrame, features: list[str]) -> DataFrame:
    """Features as doubles under names of their own; null and not-a-number count as 0."""
    return rows.select("*", *[F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"__{f}") for f in features])


def _split(rows: DataFrame, label: str, key: list[str]) -> DataFrame:
    """``rows`` with ``held_out``: in each class every HELD_OUT_EVERY-th of the buckets of a hash of the key, so that reruns and added rows keep their side."""
    return rows.where(F.col(label).isin(0, 1)).withColumn("held_out", F.pmod(F.xxhash64(*key, F.lit("held out")), F.lit(HELD_OUT_EVERY)) == 0)


def balanced_accuracy(rows: DataFrame, label: str, predicted: str) -> float | None:
    """Mean over the classes present of the share that is named rightly."""
    right = rows.groupBy(label).agg(F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("share")).collect()  # two classes
    return sum(r["share"] for r in right) / len(right) if right else None


def best_single_feature(rows: DataFrame, features: list[str], label: str) -> tuple[str | None, float]:
    """The feature whose best threshold alone, in either direction, has the highest balanced accuracy.

    Each feature is cut at up to CUTS quantiles; values are counted by bucket and class, and running sums over the buckets give every cut's accuracy."""
    at = [k / CUTS for k in range(CUTS + 1)]
    long = rows.select(F.col(label).alias("y"), F.posexplode(F.array(*[F.col(f"__{f}") for f in features])).alias("feature", "x"))
    cuts = long.groupBy("feature").agg(F.array_distinct(F.percentile_approx("x", F.array(*map(F.lit, at)), 10_000)).alias("cuts"))
    below = F.size(F.filter("cuts", lambda c: c < F.col("x")))
    tally = long.join(F.broadcast(cuts), "feature").groupBy("feature", below.alias("bucket")).agg(F.sum("y").alias("ones"), F.count("*").alias("n"))  # one row of cuts for each feature
    w, whole = W.partitionBy("feature").orderBy("bucket"), W.partitionBy("feature")
    ones, n = F.sum("ones").over(w), F.sum("n").over(w)
    all_ones, all_n = F.sum("ones").over(whole), F.sum("n").over(whole)
    accuracy = (ones / all_ones + 1 - (n - ones) / (all_n - all_ones)) / 2  # of calling everything up to the cut a 1
    rated = tally.withColumn("accuracy", F.greatest(accuracy, 1 - accuracy)).where("accuracy IS NOT NULL")
    best = rated.orderBy(F.desc("accuracy"), "feature").limit(1).collect()
    return (features[best[0]["feature"]], float(best[0]["accuracy"])) if best else (None, 0.0)


def train(rows: DataFrame, features: list[str], label: str, key: list[str]) -> Classifier:
    """A classifier of ``label`` (1 false positive, 0 threat; other rows are left out) from ``features``, judged by rows held out by ``key``.

    Classes weigh the same in training. The gate refuses a model with fewer than LEAST_HELD_OUT held-out rows, with one class only, with a balanced accuracy under
    LEAST_ACCURACY there, and one whose label a single feature gives away. An accepted model's probabilities are calibrated by isotonic regression on the held-out rows.
    """
    data = _split(_filled(rows, features), label, key)
    data = written(data.select(*[f"__{f}" for f in features], F.col(label).cast("double").alias("label"), "held_out"))
    counts = {(r["label"], r["held_out"]): r["count"] for r in data.groupBy("label", "held_out").count().collect()}  # at most four rows
    held = data.where("held_out")
    gate = Gate(held_out=sum(n for (_, out), n in counts.items() if out))
    if gate.held_out < LEAST_HELD_OUT or any((c, out) not in counts for c in (0.0, 1.0) for out in (True, False)):
        gate.reasons.append(f"{gate.held_out} held-out rows; {LEAST_HELD_OUT} are needed, and both classes on either side")
        return Classifier(features, gate)
    total = counts[0.0, False] + counts[1.0, False]
    weight = F.when(F.col("label") == 1, total / (2 * counts[1.0, False])).otherwise(total / (2 * counts[0.0, False]))
    stages = [
        VectorAssembler(inputCols=[f"__{f}" for f in features], outputCol="joined"),
        StandardScaler(inputCol="joined", outputCol="features", withMean=True),
        GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.1, seed=42, weightCol="weight", cacheNodeIds=False),
    ]
    model = Pipeline(stages=stages).fit(data.where("NOT held_out").withColumn("weight", weight))
    judged = written(model.transform(held).select(*[f"__{f}" for f in features], "label", "prediction", vector_to_array("probability")[1].alias("features")))
    gate.accuracy = balanced_accuracy(judged, "label", "prediction")
    gate.best_feature, gate.separation = best_single_feature(judged, features, "label")
    if gate.accuracy < LEAST_ACCURACY:
        gate.reasons.append(f"balanced accuracy {gate.accuracy:.3f} on held-out rows, less than {LEAST_ACCURACY}")
    if gate.separation >= MOST_SEPARATION:
        gate.reasons.append(f"{gate.best_feature} alone separates the classes ({gate.separation:.3f}): a leaked label")
    calibration = None if gate.reasons else IsotonicRegression(featuresCol="raw").fit(judged.select("label", F.col("features").alias("raw")))
    return Classifier(features, gate, model, calibration)
