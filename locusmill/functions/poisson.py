"""Poisson upper tail in decimal logarithms, for whole columns."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

LN10 = math.log(10)


def _log_factorial(k: np.ndarray) -> np.ndarray:
    """ln k!, taken once per distinct k."""
    found, at = np.unique(k, return_inverse=True)
    return np.array([math.lgamma(x + 1.0) for x in found.tolist()])[at]


def log_tails(k: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """ln P(X >= k); 0 for k <= 0 and for rates that are not positive and finite.  The series of terms
    that fall off - above k for k > lam, below k otherwise - runs until it changes no sum any more."""
    k, lam = np.asarray(k, np.int64), np.asarray(lam, np.float64)
    out = np.zeros(len(k))
    usable = (k > 0) & (lam > 0) & np.isfinite(lam)
    for upper in (True, False):
        at = np.flatnonzero(usable & ((k > lam) if upper else (k <= lam)))
        if not len(at):
            continue
        n, rate = k[at].astype(np.float64), lam[at]
        total, term, live, i = np.ones(len(at)), np.ones(len(at)), np.arange(len(at)), 0
        while len(live) and i < 100_000:
            step = rate[live] / (n[live] + i + 1) if upper else (n[live] - 1 - i) / rate[live]
            term[live] *= np.maximum(step, 0)
            total[live] += term[live]
            live = live[term[live] > total[live] * 1e-17]
            i += 1
        if upper:
            out[at] = np.minimum(0, -rate + n * np.log(rate) - _log_factorial(k[at]) + np.log(total))
        else:
            below = np.exp(-rate + (n - 1) * np.log(rate) - _log_factorial(k[at] - 1) + np.log(total))
            out[at] = np.where(below < 1, np.log1p(-np.minimum(below, 1 - 1e-16)), 0)
    return out


def log_tail(k: int, lam: float) -> float:
    return float(log_tails(np.array([k]), np.array([lam]))[0])


def scores(k: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """-log10 P(X >= k), worked out once per distinct pair."""
    pair = np.empty(len(k), [("k", np.int64), ("lam", np.float64)])
    pair["k"], pair["lam"] = k, lam
    found, at = np.unique(pair, return_inverse=True)
    return (-log_tails(found["k"], found["lam"]) / LN10 + 0.0)[at]


def bounds(k: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """-log10 P(X = k): no smaller than the score, and far cheaper."""
    k = np.asarray(k, np.int64)
    with np.errstate(divide="ignore", invalid="ignore"):
        return (lam - k * np.log(lam) + _log_factorial(k)) / LN10


def _numbers(column: pa.Array, missing: float) -> np.ndarray:
    return column.fill_null(missing).to_numpy(zero_copy_only=False)


@F.arrow_udf(DoubleType())
def _score(k: pa.Array, lam: pa.Array) -> pa.Array:
    return pa.array(scores(_numbers(k, 0), _numbers(lam, 0.0)))


@F.arrow_udf(DoubleType())
def _bound(k: pa.Array, lam: pa.Array) -> pa.Array:
    return pa.array(bounds(_numbers(k, 0), _numbers(lam, 0.0)))


def score(k: Column, lam: Column) -> Column:
    return _score(k.cast("long"), lam.cast("double"))


def pmf_bound(k: Column, lam: Column) -> Column:
    """Upper bound of the score, for k > 0."""
    return _bound(k.cast("long"), lam.cast("double"))
