"""Quality score of a sparse rule ensemble, compiled into Spark column expressions.

Small decision trees are grown on bootstrap samples of labelled rows, each on the
residuals of the ones before.  Every path from a root to a node is a rule: a
conjunction of bounds on text statistics.  A logistic model with an L1 penalty
over all rules and the scaled statistics keeps few of them; the penalty is chosen on
rows that the trees did not see.  The kept rules become ``CASE WHEN`` expressions,
so scoring is one projection over the statistics.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textstats

#: Bound of the labelled rows that the model is fitted on.
MAX_TRAINING_ROWS = 20_000
TREES = 40
DEPTH = 3
BINS = 32
PENALTIES = (0.03, 0.01, 0.003, 0.001, 0.0003)
SEED = 20240229

#: Statistics, by name; the order is that of the training matrix.
FEATURES = textstats.SHARES

Condition = tuple[int, bool, float]
"""Statistic, whether it must exceed the bound (else: be at most the bound), bound."""
Rule = tuple[Condition, ...]


@dataclass
class Model:
    bias: float
    rules: list[tuple[Rule, float]]
    #: Statistic, lower and upper clip, weight of the clipped value scaled to 0..1.
    linear: list[tuple[int, float, float, float]]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for rule, w in self.rules:
            out += w * holds(rule, x)
        for k, low, high, w in self.linear:
            out += w * scaled(x[:, k], low, high)
        return out

    def expression(self, columns: dict[str, Column]) -> Column:
        """The score as one column expression."""
        own = [columns[name] for name in FEATURES]
        out = F.lit(self.bias)
        for rule, w in self.rules:
            out = out + F.when(reduce(Column.__and__, [own[k] > t if above else own[k] <= t for k, above, t in rule]), F.lit(w)).otherwise(F.lit(0.0))
        for k, low, high, w in self.linear:
            out = out + F.lit(w) * (F.least(F.greatest(own[k], F.lit(low)), F.lit(high)) - F.lit(low)) / F.lit(high - low)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-out))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, t in rule:
        out &= (x[:, k] > t) if above else (x[:, k] <= t)
    return out


def scaled(v: np.ndarray, low: float, high: float) -> np.ndarray:
    return (np.clip(v, low, high) - low) / (high - low)


def bounds_of(x: np.ndarray) -> list[np.ndarray]:
    """Candidate bounds of each statistic: middles between neighbouring quantiles."""
    out = []
    for k in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)))
        out.append((q[1:] + q[:-1]) / 2)
    return out


def grow(x: np.ndarray, target: np.ndarray, bounds: list[np.ndarray], rng: np.random.Generator, depth: int = DEPTH) -> tuple[list[Rule], list[tuple[Rule, float]]]:
    """A regression tree: the paths to all its nodes, and its leaves with their means."""
    paths: list[Rule] = []
    leaves: list[tuple[Rule, float]] = []

    def split(rows: np.ndarray, path: Rule) -> None:
        t = target[rows]
        best, chosen = 1e-9, None
        if len(path) < depth and len(rows) >= 20:
            total, n = t.sum(), len(rows)
            for k in rng.permutation(x.shape[1])[: max(3, x.shape[1] // 2)]:
                b = bounds[k]
                if not len(b):
                    continue
                at = np.searchsorted(b, x[rows, k], side="left")  # x <= b[at]
                sums, counts = np.bincount(at, t, len(b) + 1).cumsum()[:-1], np.bincount(at, minlength=len(b) + 1).cumsum()[:-1]
                ok = (counts >= 5) & (n - counts >= 5)
                if ok.any():
                    c, s = counts[ok], sums[ok]
                    gain = s * s / c + (total - s) ** 2 / (n - c) - total * total / n
                    j = int(gain.argmax())
                    if gain[j] > best:
                        best, chosen = gain[j], (int(k), float(b[ok][j]))
        if chosen is None:
            leaves.append((path, float(t.mean()) if len(t) else 0.0))
            return
        k, bound = chosen
        above = x[rows, k] > bound
        for side in (False, True):
            own = (*path, (k, side, bound))
            paths.append(own)
            split(rows[above == side], own)

    split(np.arange(len(x)), ())
    return paths, leaves


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray, steps: int = 300) -> np.ndarray:
    """Logistic regression with an L1 penalty on all but the first column, by accelerated proximal steps."""
    n = len(y)
    v = np.ones(a.shape[1]) / math.sqrt(a.shape[1])
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v) or 1.0
    rate = 4 * n / max(float(v @ (a.T @ (a @ v))), 1e-9) / 1.02
    w, z, t = start.copy(), start.copy(), 1.0
    cut = np.full(len(w), rate * penalty)
    cut[0] = 0
    for _ in range(steps):
        g = a.T @ (1 / (1 + np.exp(-np.clip(a @ z, -40, 40))) - y) / n
        u = z - rate * g
        new = np.sign(u) * np.maximum(np.abs(u) - cut, 0)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - w)
        moved = np.abs(new - w).max()
        w, t = new, t2
        if moved < 1e-6:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, *, seed: int = SEED) -> Model:
    """Fit the ensemble; a constant model where labels are of one kind or none."""
    n = len(y)
    prior = (float(y.sum()) + 0.5) / (n + 1)
    constant = Model(math.log(prior / (1 - prior)), [], [])
    if n < 40 or min(y.sum(), n - y.sum()) < 5:
        return constant
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    held, own = order[: n // 5], order[n // 5 :]
    bounds = bounds_of(x[own])
    rules: dict[Rule, None] = {}
    margin = np.full(n, constant.bias)
    for _ in range(TREES):
        sample = rng.choice(own, min(len(own), 4000), replace=len(own) < 4000)
        residual = y - 1 / (1 + np.exp(-margin))
        paths, leaves = grow(x[sample], residual[sample], bounds, rng)
        rules |= dict.fromkeys(tuple(sorted(p)) for p in paths)
        for path, mean in leaves:
            margin += 1.0 * mean * holds(path, x)
    names = list(rules)
    kept, columns, seen = [], [], set()
    for r in names:
        c = holds(r, x)
        key = c[own].tobytes()
        if 0 < c[own].sum() < len(own) and key not in seen:
            seen.add(key)
            kept.append(r)
            columns.append(c.astype(float))
    lines = []
    for k in range(x.shape[1]):
        low, high = (float(q) for q in np.quantile(x[own, k], (0.025, 0.975)))
        if high > low:
            lines.append((k, low, high))
            columns.append(scaled(x[:, k], low, high))
    a = np.column_stack([np.ones(n), *columns])
    w = np.zeros(a.shape[1])
    w[0] = constant.bias
    best = (math.inf, w)
    for penalty in PENALTIES:
        w = lasso(a[own], y[own], penalty, w)
        m = np.clip(a[held] @ w, -40, 40)
        loss = float(np.mean(np.log1p(np.exp(-m)) + (1 - y[held]) * m))
        if loss < best[0] - 1e-4:
            best = (loss, w)
    w = best[1]
    return Model(float(w[0]), [(r, float(v)) for r, v in zip(kept, w[1:]) if v], [(*r, float(v)) for r, v in zip(lines, w[1 + len(kept) :]) if v])


def score(docs: DataFrame, labels: DataFrame, *, fold: int = 3, held_fold: int = 1, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    ``docs`` has doc_id and text, ``labels`` doc_id and quality.  Learns only from
    labels of documents with crc32(doc_id as text) mod ``fold`` other than
    ``held_fold``, at most ``max_rows`` of them.

    Null or empty text: scored by its zero counts.  Null doc_id: scored, not held
    out, never labelled.  Repeated rows: each is scored.  Several labels of one
    document: the lowest counts.  No labels: every score is 0.5.  Empty table: no
    rows.  Other columns are ignored.
    """
    columns = textstats.shares()
    stats = common.materialize(textstats.statistics(docs, "doc_id"), "statistics")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(fold)) == held_fold, F.lit(False))
    own = common.only(labels, "doc_id", "quality").filter(~held & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = common.sample_by_hash(stats.join(own, "doc_id").select("doc_id", "quality", *[c.alias(f"_{n}") for n, c in columns.items()]), "doc_id", max_rows).collect()
    x = np.array([[float(v) for v in r[2:]] for r in rows]).reshape(len(rows), len(FEATURES))
    model = fit(x, np.array([float(r.quality == 1) for r in rows]))
    scored = stats.select("doc_id", held.alias("held_out"), model.expression(columns).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
