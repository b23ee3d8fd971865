"""Fitting maintenance cost from timings: summaries, least squares, acceptance."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timing_summary(timings: DataFrame, key: str, value: str) -> DataFrame:
    v = F.col(value)
    mean = F.avg(v)
    return timings.groupBy(key).agg(
        F.count("*").alias("runs"), mean.alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.stddev_samp(v).alias("sd"),
        (F.stddev_samp(v) / mean).alias("cv"), F.min(v).alias("min"), F.max(v).alias("max"),
    )


def subset_variation(timings: DataFrame, group: str, subset: str, value: str) -> DataFrame:
    """group, cv: variation of the subsets' means among groups of the same make-up."""
    means = timings.groupBy(group, subset).agg(F.avg(value).alias("m"))
    return means.groupBy(group).agg((F.stddev_samp("m") / F.avg("m")).alias("cv"))


def line_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def cross_products(df: DataFrame, x1: str, x2: str, y: str) -> DataFrame:
    """All sums that a fit of y on (1, x1, x2) needs, in one aggregate."""
    a, b, c = F.col(x1).cast("double"), F.col(x2).cast("double"), F.col(y).cast("double")
    terms = {"n": F.lit(1.0), "s1": a, "s2": b, "sy": c, "s11": a * a, "s12": a * b, "s22": b * b, "s1y": a * c, "s2y": b * c, "syy": c * c}
    return df.agg(*[F.sum(t).alias(k) for k, t in terms.items()])


def plane_fit(df: DataFrame, x1: str, x2: str, y: str) -> dict[str, float]:
    """Least squares of y on (1, x1, x2): coefficients, standard errors, r2, rmse."""
    s = cross_products(df, x1, x2, y).first()
    normal = np.array([[s["n"], s["s1"], s["s2"]], [s["s1"], s["s11"], s["s12"]], [s["s2"], s["s12"], s["s22"]]])
    right = np.array([s["sy"], s["s1y"], s["s2y"]])
    inverse = np.linalg.inv(normal)
    beta = inverse @ right
    sse = max(0.0, s["syy"] - float(beta @ right))
    spread = s["syy"] - s["sy"] ** 2 / s["n"]
    free = max(1.0, s["n"] - 3)
    errors = np.sqrt(np.maximum(np.diag(inverse) * sse / free, 0))
    out = {"intercept": beta[0], "per_mcv": beta[1], "per_fd": beta[2], "r2": 1 - sse / spread if spread else 1.0, "rmse": (sse / s["n"]) ** 0.5}
    for name, b, e in zip(("intercept", "per_mcv", "per_fd"), beta, errors, strict=True):
        out |= {f"{name}_se": e, f"{name}_low": b - 1.96 * e, f"{name}_high": b + 1.96 * e}
    return {k: float(v) for k, v in out.items()}


def predictions(summary: DataFrame, fit: dict[str, float]) -> DataFrame:
    """Held-out configurations (n_mcv, n_fd, mean) with what the fit gives them and how far off."""
    guess = F.lit(fit["intercept"]) + F.lit(fit["per_mcv"]) * F.col("n_mcv") + F.lit(fit["per_fd"]) * F.col("n_fd")
    return summary.withColumn("predicted", guess).withColumn("relative_error", F.abs(guess - F.col("mean")) / F.col("mean"))


def accepted(fit: dict[str, float], held_out: DataFrame, worst_cv: float, min_r2=0.95, max_error=0.1, max_cv=0.1) -> dict[str, bool]:
    """The gates that a fit must pass before it prices designs."""
    worst = held_out.agg(F.max("relative_error")).first()[0]
    return {
        "r2": fit["r2"] >= min_r2,
        "positive_mcv": fit["per_mcv"] > 0,
        "positive_fd": fit["per_fd"] > 0,
        "held_out": worst is not None and worst <= max_error,
        "repeatable": worst_cv <= max_cv,
    }
