"""Quality classifier: a sparse rule ensemble.

1. Text statistics are Spark expressions over the whole text; ids, sources, languages and labels are
   no inputs.
2. Boosted shallow trees, each grown on a random part of the labelled sample, supply rules: every
   path from the root to a node is a conjunction of threshold conditions.
3. A logistic regression with an L1 penalty (accelerated proximal gradient, penalty chosen on a
   validation part) keeps a few rules and weights them.
4. The kept rules compile into one column expression that scores every document in the scan.

The fit uses at most MAX_LABELLED labelled rows, the ones with the smallest hashes of their ids, so
it does not depend on partitioning; this bound is a parameter.

Edge cases: null and empty texts have zero statistics and a score like any text; without labelled
rows, or with one label only, the score is the smoothed share of label 1; repeated rows get equal
scores; an empty table gives an empty result; null doc_ids are never held out nor trained on; extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import train_trees
from .common import WORD_BREAK, remainder

MAX_LABELLED = 20_000
TREES, DEPTH, SHARE = 32, 3, 0.5
PENALTIES = (0.03, 0.01, 0.003, 0.001, 0.0003)
STEPS = 300


def statistics(text: Column) -> dict[str, Column]:
    """Numeric statistics of a text; `words` and `lines` are array columns of it."""
    words, lines = F.col("words"), F.col("lines")
    chars = F.char_length(text)
    n_words, n_lines = F.size(words), F.size(lines)
    per = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    count = lambda c: F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))
    symbols = sum((count(c) for c in "#*$%&<>"), F.lit(0))
    full = F.filter(lines, lambda x: F.char_length(F.trim(x)) > 0)
    return {
        "log_words": F.log(n_words + 1.0),
        "word_length": per(F.char_length(F.array_join(words, "")), n_words),
        "distinct_words": per(F.size(F.array_distinct(words)), n_words),
        "symbols": per(symbols, chars),
        "bars": per(count("|"), n_words),
        "shouts": per(count("!"), n_words),
        "stops": per(count("."), n_words),
        "commas": per(count(","), n_words),
        "capitals": per(F.char_length(F.regexp_replace(text, r"[^\p{Lu}]+", "")), chars),
        "digits": per(F.char_length(F.regexp_replace(text, "[^0-9]+", "")), chars),
        "lines": F.log(n_lines + 1.0),
        "line_words": per(n_words, n_lines),
        "repeated_lines": per(F.size(full) - F.size(F.array_distinct(full)), F.size(full)),
        "closed_lines": per(F.size(F.filter(full, lambda x: F.rtrim(x).endswith("."))), F.size(full)),
    }


def with_statistics(docs: DataFrame, *keep: str) -> tuple[DataFrame, list[str]]:
    d = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("words", F.array_remove(F.split("text", WORD_BREAK), "")).withColumn("lines", F.split("text", "\n"))
    made = statistics(F.col("text"))
    return d.select(*keep, *(c.cast("double").alias(f"s_{k}") for k, c in made.items())), [f"s_{k}" for k in made]


# ----------------------------------------------------------------------------- rules

Rule = tuple[tuple[int, bool, float], ...]  # (statistic, is it <= ?, threshold), all must hold


def tree_rules(tree, path: Rule = ()) -> list[Rule]:
    """The conjunctions of all paths from the root."""
    found = [path] if path else []
    if isinstance(tree, tuple):
        j, c, low, high = tree
        found += tree_rules(low, (*path, (j, True, c))) + tree_rules(high, (*path, (j, False, c)))
    return found


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, low, c in rule:
        out &= (x[:, j] <= c) if low else (x[:, j] > c)
    return out


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient for the L1-penalised logistic loss on standardised columns;
    the intercept is not penalised.  Returns intercept and weights of the raw columns."""
    mean, scale = r.mean(0), r.std(0) + 1e-9
    z = ((r - mean) / scale).astype(np.float32)
    gram, top = z.T @ z / len(y), np.ones(z.shape[1], np.float32)
    for _ in range(60):  # the largest eigenvalue by power iteration
        top = gram @ top
        top /= np.sqrt((top * top).sum()) + 1e-12
    rate = 4.0 / (1.05 * float(top @ (gram @ top)) + 1.0)
    w, b, v, u, t = np.zeros(z.shape[1]), 0.0, np.zeros(z.shape[1]), 0.0, 1.0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-(z @ v.astype(np.float32) + u))) - y
        step = v - rate * (z.T @ g.astype(np.float32)) / len(y)
        w2, b2 = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0), u - rate * g.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, u = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    raw = w / scale
    return float(b - (raw * mean).sum()), raw


@dataclass
class RuleEnsemble:
    intercept: float
    rules: list[tuple[Rule, float]]

    def expression(self, columns: list[str]) -> Column:
        """Probability of label 1."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            test = F.lit(True)
            for j, low, c in rule:
                test = test & ((F.col(columns[j]) <= c) if low else (F.col(columns[j]) > c))
            total = total + F.when(test, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
    if len(y) < 40 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return RuleEnsemble(float(np.log(p / (1 - p))), [])
    _, trees = train_trees(x, y, TREES, DEPTH, 0.2, SHARE)
    seen, rules, columns = set(), [], []
    for tree in trees:
        for rule in tree_rules(tree):
            v = holds(rule, x)
            key = v.tobytes()
            if key not in seen and v.any() and not v.all() and (~v).tobytes() not in seen:
                seen.add(key)
                rules.append(rule)
                columns.append(v)
    r = np.array(columns, np.float32).T
    check = np.arange(len(y)) % 5 == 4

    def loss(b: float, w: np.ndarray) -> float:
        p = np.clip(1 / (1 + np.exp(-(r[check] @ w + b))), 1e-6, 1 - 1e-6)
        return float(-(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p)).mean())

    penalty = min(PENALTIES, key=lambda c: loss(*lasso_logistic(r[~check], y[~check], c)))
    b, w = lasso_logistic(r, y, penalty)
    return RuleEnsemble(b, [(rule, float(k)) for rule, k in zip(rules, w, strict=True) if abs(k) > 1e-6])


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted per row of docs(doc_id, text)."""
    known = labels.select("doc_id", F.col("quality").cast("double").alias("y")).filter(F.col("y").isNotNull() & (remainder("doc_id", modulus) != held))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most max_labelled ids
    rows, columns = with_statistics(sample, "doc_id", "y")
    table = rows.toPandas().sort_values(["doc_id", *columns])
    model = fit(table[columns].to_numpy(float), table["y"].to_numpy(float))
    scored, columns = with_statistics(docs, "doc_id")
    scored = scored.select("doc_id", F.coalesce(remainder("doc_id", modulus) == held, F.lit(False)).alias("held_out"), model.expression(columns).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
