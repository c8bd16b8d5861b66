"""Isolation forests of each device as a table of models: warm-up, retraining, rows kept out after a threat, and scores by a join of models."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.stored import written

#: Accepted rows before the first model, accepted rows between two, and rows that a model is trained on at most: the newest ones.
WARM_UP, RETRAIN, TRAIN = 8, 4, 512
#: Rows after a threat, counted in the order of time, that no model learns from.
REJECT = 2
TREES, SAMPLE = 60, 64
#: Rows of one model that are scored in one task.
SCORED = 20_000
#: Score above which a row counts as an anomaly.
ANOMALY = 0.6


def _average_path(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grown(x: np.ndarray, rng: np.random.Generator) -> list[tuple[int, float, int, int, float]]:
    """An isolation tree as rows (feature, cut, left, right, path length at a leaf): random features and cuts until one value or the depth's end."""
    nodes: list[tuple[int, float, int, int, float]] = []

    def grow(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, -1, -1, depth + _average_path(len(rows))))
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(0), np.zeros(0))
        live = np.flatnonzero(high > low)
        if len(rows) > 1 and len(live) and depth < int(np.ceil(np.log2(SAMPLE))):
            f = int(rng.choice(live))
            cut = float(rng.uniform(low[f], high[f]))
            nodes[at] = (f, cut, grow(rows[rows[:, f] < cut], depth + 1), grow(rows[rows[:, f] >= cut], depth + 1), 0.0)
        return at

    grow(x, 0)
    return nodes


def turns(rows: DataFrame, key: str, order: list[str], threat: str) -> DataFrame:
    """``rows`` with ``accepted`` (whether models learn from it) and ``model``: the number of the newest model trained before it, null in the warm-up.

    A row is rejected if it or one of the REJECT rows before it is a threat. Model m stands from the time that WARM_UP + m * RETRAIN rows of the key are accepted."""
    w = W.partitionBy(key).orderBy(*order)
    hit = F.max(F.coalesce(F.col(threat), F.lit(False)).cast("int")).over(w.rowsBetween(-REJECT, 0))
    seen = F.sum((hit == 0).cast("int")).over(w)
    out = rows.withColumn("accepted", hit == 0).withColumn("taken", seen)
    earlier = F.col("taken") - F.col("accepted").cast("int")
    return out.withColumn("model", F.when((earlier >= WARM_UP) & F.col(key).isNotNull(), F.floor((earlier - WARM_UP) / RETRAIN).cast("int")))


def models(rows: DataFrame, key: str, columns: list[str], order: list[str], fit: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(key, model, trained_on, forest) of every model of :func:`turns`: trained on the newest TRAIN accepted rows that it may know.

    An accepted row goes to the models that stand from it on, as long as it is among their newest TRAIN: at most TRAIN / RETRAIN of them, whatever the key's number of rows."""
    last = rows.where("model IS NOT NULL").groupBy(key).agg(F.max("model").alias("last"))
    first = F.greatest(F.lit(0), F.ceil((F.col("taken") - WARM_UP) / RETRAIN)).cast("int")
    upto = F.least("last", F.floor((F.col("taken") - 1 + TRAIN - WARM_UP) / RETRAIN)).cast("int")
    known = rows.where("accepted").join(last, key).where(first <= upto).withColumn("m", F.explode(F.sequence(first, upto)))
    kind = dict(rows.dtypes)[key]

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("taken")[columns].to_numpy(float)
        forest = fit(x[~np.isnan(x).any(axis=1)])
        return pd.DataFrame([(pdf[key].iloc[0], int(pdf["m"].iloc[0]), len(x), forest.tobytes())], columns=[key, "model", "trained_on", "forest"])

    return known.groupBy(key, "m").applyInPandas(train, f"{key} {kind}, model int, trained_on int, forest binary")


def forest_of(x: np.ndarray, seed: int = 7) -> np.ndarray:
    """TREES isolation trees over samples of the rows, end to end as (feature, cut, left, right, path length), each beginning with its root; children count from the tree's root."""
    rng = np.random.default_rng(seed)
    trees = [np.array(grown(x[rng.permutation(len(x))[:SAMPLE]], rng), float) for _ in range(TREES)]
    starts = np.cumsum([0, *(len(t) for t in trees)])
    head = np.zeros((1, 5))
    return np.vstack([head + len(trees), *(np.column_stack([t[:, :2], t[:, 2:4] + s, t[:, 4:]]) for t, s in zip(trees, starts)), np.column_stack([starts[:-1], np.zeros((len(trees), 4))])])


def depth_scores(forest: np.ndarray, x: np.ndarray, trained: int) -> np.ndarray:
    """Scores from 0 to 1, higher where rows stand more apart; not a number where a feature is null."""
    count = int(forest[0, 0])
    nodes, roots = forest[1:-count], forest[-count:, 0].astype(int)
    ok = ~np.isnan(x).any(axis=1)
    total = np.zeros(int(ok.sum()))
    for root in roots:
        at = np.full(len(total), root)
        while (live := nodes[at, 0] >= 0).any():
            f = np.maximum(nodes[at, 0].astype(int), 0)
            side = x[ok, f] < nodes[at, 1]
            at = np.where(live, np.where(side, nodes[at, 2], nodes[at, 3]).astype(int), at)
        total += nodes[at, 4]
    out = np.full(len(x), np.nan)
    out[ok] = 2 ** (-total / count / max(_average_path(min(trained, SAMPLE)), 1e-9))
    return out


def joined_scores(asked: DataFrame, trained: DataFrame, keys: list[str], columns: list[str], names: list[str]) -> DataFrame:
    """``names`` and ``keys`` of ``asked`` with trained_on and score by the model of their keys in ``trained`` (keys, trained_on, forest); keys are not null.

    Rows of one model are dealt to tasks of about SCORED rows, each of which gets the model once: a hot key has many tasks, and models never reach the driver."""
    spread = written(asked.groupBy(*keys).agg(F.ceil(F.count("*") / SCORED).cast("int").alias("parts")))
    asked = asked.join(spread, keys).withColumn("part", F.pmod(F.xxhash64(*names), F.col("parts")).cast("int")).drop("parts")
    dealt = trained.join(spread, keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    types, shown = dict(asked.dtypes), [*names, *[k for k in keys if k not in names]]

    def score(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        out = rows[shown].copy()
        out["trained_on"], out["score"] = 0, np.nan
        if len(model) and len(rows):
            forest, count = np.frombuffer(model["forest"].iloc[0]).reshape(-1, 5), int(model["trained_on"].iloc[0])
            out["trained_on"], out["score"] = count, np.round(depth_scores(forest, rows[columns].to_numpy(float), count), 6)
        return out

    schema = ", ".join(f"{c} {types[c]}" for c in shown) + ", trained_on int, score double"
    return asked.groupBy(*keys, "part").cogroup(dealt.groupBy(*keys, "part")).applyInPandas(score, schema)


def group_scores(rows: DataFrame, group: str, columns: list[str], keep: list[str]) -> DataFrame:
    """``keep`` and score of each row by one forest for each ``group``, grown on about TREES * SAMPLE rows of it at most, drawn by a hash of ``keep``.

    Rows with a null feature or group score null."""
    clean = rows.where(F.col(group).isNotNull()).dropna(subset=columns)
    share = F.least(F.lit(1.0), F.lit(float(SAMPLE * TREES)) / F.col("size"))
    drawn = clean.join(clean.groupBy(group).agg(F.count("*").alias("size")), group).where(F.pmod(F.xxhash64(*keep), F.lit(1_000_000)) < share * 1_000_000).select(group, *keep, *columns)
    kind = dict(rows.dtypes)[group]

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(keep)[columns].to_numpy(float)
        return pd.DataFrame([(pdf[group].iloc[0], len(x), forest_of(x).tobytes())], columns=[group, "trained_on", "forest"])

    trained = written(drawn.groupBy(group).applyInPandas(train, f"{group} {kind}, trained_on int, forest binary"))
    found = joined_scores(rows.where(F.col(group).isNotNull()).select(group, *keep, *columns), trained, [group], columns, keep).select(*keep, F.nanvl("score", F.lit(None).cast("double")).alias("score"))
    return found.unionByName(rows.where(F.col(group).isNull()).select(*keep, F.lit(None).cast("double").alias("score")))


def anomalies(rows: DataFrame, key: str, columns: list[str], order: list[str], threat: str) -> DataFrame:
    """``rows`` (key, order and columns) with model, trained_on and score of the newest model of their key that was trained before them; null in the warm-up.

    Models meet their rows by a join of (key, model), as in :func:`joined_scores`. Ties in ``order`` should be none. Rows with a null key have no model, those with a null feature no score."""
    marked = written(turns(rows.select(key, *order, *columns, threat), key, order, threat))
    trained = written(models(marked, key, columns, order, forest_of))  # the state table
    names = [key, *[o for o in order if o != key]]
    found = joined_scores(marked.where("model IS NOT NULL"), trained, [key, "model"], columns, names)
    quiet = marked.where("model IS NULL").select(*names, F.lit(None).cast("int").alias("model"), F.lit(None).cast("int").alias("trained_on"), F.lit(None).cast("double").alias("score"))
    return found.withColumn("score", F.nanvl("score", F.lit(None).cast("double"))).unionByName(quiet)
