"""Candidate parameters held against pinned decisions, circuit breakers, and the life of a proposed change."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cycles

#: States from harmless to grave.
ORDER = ["BENIGN", "ANOMALOUS", "SUSPICIOUS", "HIGH", "CRITICAL"]
#: Seconds between two proposals of a scope, of a canary, and between two nightly runs.
COOLDOWN, CANARY, NIGHT = 3600.0, 6 * 3600.0, 86_400.0
#: Bounds of a value, its default, the largest step, and how many steps above its parent's value a scope may stand.
LOW, HIGH, DEFAULT, STEP, RADIUS = 0.1, 0.9, 0.5, 0.05, 2.0


def rank(state: str):
    return F.array_position(F.array(*map(F.lit, ORDER)), F.col(state))


def guard(cases: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row for each candidate: cases, missed, over, flipped, blocked.

    ``cases`` are evidence rows with bounds ``at_least`` and ``at_most`` (states, null for none) and a ``pinned`` path (null for none), ``candidates`` rows of parameters as
    :func:`cycles.decided` takes them. All candidates are decided in one pass over the cases. A case below its lower bound is missed, one above its upper bound over-escalated, and one whose
    path is not the pinned one flipped; any of them blocks the candidate.
    """
    found = cycles.decided(cases, candidates)
    missed, over = F.coalesce(rank("state") < rank("at_least"), F.lit(False)), F.coalesce(rank("state") > rank("at_most"), F.lit(False))
    flipped = F.coalesce(F.col("decision_path") != F.col("pinned"), F.lit(False))
    out = found.groupBy("candidate").agg(F.count("*").alias("cases"), *[F.sum(c.cast("long")).alias(k) for k, c in (("missed", missed), ("over", over), ("flipped", flipped))])
    return out.withColumn("blocked", F.col("missed") + F.col("over") + F.col("flipped") > 0)


def confirmed_misses(scopes: DataFrame, evidence: DataFrame, confirmed: DataFrame, within: float) -> DataFrame:
    """Loosened scopes (change_id, user_id, parent, value) to be rolled back at once: (change_id, misses).

    A miss is evidence (user_id, t, confidence) that the parent's bar would have taken and the scope's did not (parent <= confidence < value), with a confirmed threat
    (user_id, t) of the same device within ``within`` seconds. Threats are met by buckets of that length, so a busy device's rows don't meet all its threats.
    """
    near = evidence.join(scopes.where("value > parent"), "user_id").where("confidence >= parent AND confidence < value")
    bucket = F.floor(F.col("t") / within)
    threats = confirmed.select("user_id", F.col("t").alias("at")).distinct().select("user_id", "at", F.explode(F.array(*[F.floor(F.col("at") / within) + k for k in (-1, 0, 1)])).alias("bucket"))
    hit = near.withColumn("bucket", bucket).join(threats, ["user_id", "bucket"]).where(F.abs(F.col("t") - F.col("at")) <= within)
    return hit.groupBy("change_id", "user_id", "t", "confidence").agg(F.lit(1).alias("one")).groupBy("change_id").agg(F.count("*").alias("misses"))


def fold_proposals(rows: pd.DataFrame) -> pd.DataFrame:
    """The proposals of one scope in order of time, each with its outcome; see :func:`proposal_states`."""
    active, pending, last, out = DEFAULT, None, -math.inf, []
    rows = rows.sort_values(["t", "proposal_id"])
    for i, t, wanted, backtest, night in zip(rows["proposal_id"], rows["t"], rows["wanted"], rows["backtest"], rows["night_passes"]):
        if pending and pending["confirm"] <= t:
            active, pending = pending["value"] if pending["passes"] else active, None
        value = max(LOW, min(HIGH, active + max(-STEP, min(STEP, wanted - active))))
        if t - last < COOLDOWN:
            outcome = "cooldown"
        elif pending:
            outcome = "pending"
        elif not backtest:
            outcome = "no_backtest"
        elif value > active and value - DEFAULT > RADIUS * STEP + 1e-9:
            outcome = "radius"
        else:
            confirm = math.ceil((t + CANARY) / NIGHT) * NIGHT
            pending, last, outcome = {"value": value, "confirm": confirm, "passes": night}, t, "promoted" if night else "rolled_back"
        out.append((i, t, active, value, outcome))
    scope = [rows["parameter"].iloc[0], rows["scope"].iloc[0]]
    return pd.DataFrame([(*scope, *r) for r in out], columns=["parameter", "scope", "proposal_id", "t", "active", "value", "outcome"])


def proposal_states(proposals: DataFrame) -> DataFrame:
    """(parameter, scope, proposal_id, t, active, value, outcome) of proposals (proposal_id, parameter, scope, t, wanted, backtest, night_passes).

    A proposal is refused within COOLDOWN of the scope's last accepted one, while one is pending, without a passed backtest, and where it would loosen the value by more than
    RADIUS steps beyond its parent's. Else its value, clamped to one STEP from the active one and to the bounds, is a canary until the first nightly run that starts after its CANARY
    hours; that run promotes it or rolls it back (``night_passes`` says which). ``active`` is the value in force when the proposal came. Of equal times the smaller id comes first.
    """
    fields = "parameter string, scope long, proposal_id long, t double, active double, value double, outcome string"
    return proposals.groupBy("parameter", "scope").applyInPandas(fold_proposals, fields)
