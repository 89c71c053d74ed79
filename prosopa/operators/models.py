"""Penalised logistic and baseline-category models: sums over the rows in Spark, p x p steps on the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def design(df: DataFrame, features: Sequence[str], outcome: str, intercept: str = "intercept") -> DataFrame:
    """(x array<double> with a leading 1, y int) of the rows with an outcome; null features count as 0."""
    x = F.array(F.lit(1.0), *(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features))
    return df.where(F.col(outcome).isNotNull()).select(x.alias("x"), F.col(outcome).cast("int").alias("y"))


def _sums(rows: DataFrame, width: int, step) -> np.ndarray:
    """The sum of `step(X, y)` over all rows: one vector from each partition, added up in Spark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(width)
        for batch in batches:
            if len(batch):
                total += step(np.vstack(batch["x"].to_numpy()), batch["y"].to_numpy())
        yield pd.DataFrame({"i": np.arange(width), "v": total})

    parts = rows.mapInPandas(run, "i int, v double")
    told = parts.groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")
    return told["v"].to_numpy()


def logit(rows: DataFrame, penalty: float, scale: str = "sum", iterations: int = 50, tolerance: float = 1e-9) -> dict:
    """Newton steps with halving for an L2-penalised logit of (x, y); the first coefficient is free.

    scale says what `penalty` multiplies: `sum` for half the squared norm beside the summed loss,
    `mean` beside the mean loss, `inverse` for 1 / penalty beside the summed loss. Returns the coefficients,
    log-likelihood, rows, ones, iterations and whether it converged. One class only or no rows: None
    as coefficients.
    """
    told = rows.agg(F.count(F.lit(1)), F.sum("y"), F.max(F.size("x"))).first()
    n, ones, p = told[0], told[1] or 0, told[2] or 0
    out = {"coefficients": None, "log_likelihood": None, "n": n, "ones": ones, "iterations": 0, "converged": False}
    if n == 0 or ones in (0, n):
        return out
    l2 = 1 / penalty if scale == "inverse" else {"sum": penalty, "mean": penalty * n}[scale]
    ridge = np.full(p, l2)
    ridge[0] = 0.0

    def parts(beta: np.ndarray):
        def step(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            eta = np.clip(x @ beta, -35, 35)
            mu = 1 / (1 + np.exp(-eta))
            ll = np.sum(y * np.log(mu) + (1 - y) * np.log1p(-mu))
            return np.concatenate([[ll, np.sum((mu >= 0.5) == (y == 1))], x.T @ (y - mu), ((x * (mu * (1 - mu))[:, None]).T @ x).ravel()])

        v = _sums(rows, 2 + p + p * p, step)
        return v[0] - 0.5 * np.sum(ridge * beta**2), v[0], v[1], v[2 : 2 + p] - ridge * beta, v[2 + p :].reshape(p, p) + np.diag(ridge)

    beta = np.zeros(p)
    goal, ll, right, slope, curve = parts(beta)
    for done in range(1, iterations + 1):
        move = np.linalg.pinv(curve) @ slope
        for _ in range(20):
            new = parts(beta + move)
            if new[0] >= goal - 1e-12:
                break
            move = move / 2
        beta, gain = beta + move, new[0] - goal
        goal, ll, right, slope, curve = new
        out |= {"iterations": done}
        if np.max(np.abs(move)) < tolerance or abs(gain) < tolerance:
            out["converged"] = True
            break
    return out | {"coefficients": beta, "log_likelihood": float(ll), "accuracy": float(right) / n}


def multinomial(rows: DataFrame, categories: int, l2: float, iterations: int = 200, tolerance: float = 1e-9) -> dict:
    """Baseline-category softmax with mean loss and L2 on all but the intercepts, by Newton steps.
    y is 0 for the baseline and 1 .. categories - 1 for the others."""
    told = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    n, p, k = told[0], told[1] or 0, categories - 1
    out = {"coefficients": None, "log_likelihood": None, "n": n, "iterations": 0, "converged": False}
    if n == 0:
        return out
    ridge = np.tile(np.concatenate([[0.0], np.full(p - 1, l2 * n)]), k)

    def parts(beta: np.ndarray):
        b = beta.reshape(k, p)

        def step(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            eta = np.column_stack([np.zeros(len(x)), x @ b.T])
            eta -= eta.max(axis=1, keepdims=True)
            prob = np.exp(eta) / np.exp(eta).sum(axis=1, keepdims=True)
            hit = np.eye(k + 1)[y]
            ll = np.sum(np.log(np.maximum((prob * hit).sum(axis=1), 1e-300)))
            slope = ((hit - prob)[:, 1:].T @ x).ravel()
            q = prob[:, 1:]
            curve = np.zeros((k * p, k * p))
            for a in range(k):
                for c in range(k):
                    w = q[:, a] * ((a == c) - q[:, c])
                    curve[a * p : (a + 1) * p, c * p : (c + 1) * p] = (x * w[:, None]).T @ x
            return np.concatenate([[ll, np.sum(prob.argmax(axis=1) == y)], slope, curve.ravel()])

        m = k * p
        v = _sums(rows, 2 + m + m * m, step)
        return v[0] - 0.5 * np.sum(ridge * beta**2), v[0], v[1], v[2 : 2 + m] - ridge * beta, v[2 + m :].reshape(m, m) + np.diag(ridge)

    beta = np.zeros(k * p)
    goal, ll, right, slope, curve = parts(beta)
    for done in range(1, iterations + 1):
        move = np.linalg.pinv(curve) @ slope
        for _ in range(20):
            new = parts(beta + move)
            if new[0] >= goal - 1e-12:
                break
            move = move / 2
        beta, gain = beta + move, new[0] - goal
        goal, ll, right, slope, curve = new
        out |= {"iterations": done}
        if np.max(np.abs(move)) < tolerance or abs(gain) < tolerance:
            out["converged"] = True
            break
    return out | {"coefficients": beta.reshape(k, p), "log_likelihood": float(ll), "accuracy": float(right) / n}


def coefficient_rows(names: Sequence[str], coefficients: Sequence[float], limit: float = 700) -> list[tuple[str, float, float | None]]:
    """(term, coefficient, odds ratio); the ratio is None where the coefficient's size reaches the limit."""
    return [(n, float(c), math.exp(c) if abs(c) < limit else None) for n, c in zip(names, coefficients, strict=True)]


def fit_measures(fit: dict, parameters: int) -> dict[str, float]:
    """n, log-likelihood, mean loss, AIC and BIC of a fit."""
    n, ll = fit["n"], fit["log_likelihood"]
    return {"n": n, "log_likelihood": ll, "mean_nll": -ll / n, "aic": 2 * parameters - 2 * ll, "bic": math.log(n) * parameters - 2 * ll, "accuracy": fit["accuracy"]}
