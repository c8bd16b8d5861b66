"""Change points of a device's daily series by Bayesian online run lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Chance of a change a day, share below which a run length is dropped, most run lengths kept, and the mass of short runs that makes a change.
HAZARD, PRUNE, RUNS, MASS = 1 / 60, 1e-4, 40, 0.5


def run_lengths(x: np.ndarray) -> list[tuple[int, float, float]]:
    """(index, mass of runs shorter than three, surprise) for each value: published recursion with a normal-inverse-gamma prior on unit scale.

    Each run length keeps the sufficient statistics of its own values; the predictive is Student's t."""
    from math import lgamma, log, pi

    mean, kappa, alpha, beta = np.zeros(1), np.ones(1), np.ones(1), np.ones(1)
    mass, length, out = np.ones(1), np.zeros(1, int), []
    for i, v in enumerate(x):
        scale = beta * (kappa + 1) / (alpha * kappa)
        gap = (v - mean) ** 2 / scale
        logp = np.array([lgamma(a + 0.5) - lgamma(a) - 0.5 * log(2 * a * pi * s) - (a + 0.5) * log(1 + g / (2 * a)) for a, s, g in zip(alpha, scale, gap, strict=True)])
        p = mass * np.exp(logp)
        surprise = -log(max(p.sum(), 1e-300))
        grown, cut = p * (1 - HAZARD), (p * HAZARD).sum()
        mass = np.concatenate([[cut], grown]) / max(p.sum(), 1e-300)
        beta = np.concatenate([[1.0], beta + kappa * (v - mean) ** 2 / (2 * (kappa + 1))])
        mean, kappa, alpha = np.concatenate([[0.0], (kappa * mean + v) / (kappa + 1)]), np.concatenate([[1.0], kappa + 1]), np.concatenate([[1.0], alpha + 0.5])
        length = np.concatenate([[0], length + 1])
        keep = np.flatnonzero(mass >= PRUNE)
        keep = keep[np.argsort(-mass[keep], kind="stable")][:RUNS]
        mass, mean, kappa, alpha, beta, length = mass[keep] / mass[keep].sum(), mean[keep], kappa[keep], alpha[keep], beta[keep], length[keep]
        out.append((i, float(mass[length < 3].sum()), surprise))
    return out


def change_points(daily: DataFrame) -> DataFrame:
    """(user_id, day, mass, surprise) where a new regime of ``total`` begins; one device's days are one group, a row a day, scaled by the first ten."""

    def fold(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        x = pdf["total"].to_numpy(float)
        first = x[:10]
        z = (x - first.mean()) / max(first.std(), 1.0)
        hit = [(key[0], int(pdf["day"].iloc[i]), round(m, 6), round(s, 6)) for i, m, s in run_lengths(z) if i >= 5 and m >= MASS]
        return pd.DataFrame(hit, columns=["user_id", "day", "mass", "surprise"])

    return daily.select("user_id", "day", "total").where("total IS NOT NULL").groupBy("user_id").applyInPandas(fold, "user_id long, day long, mass double, surprise double")
