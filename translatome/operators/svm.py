"""A support vector classifier with a radial kernel: fitted on a bounded sample, scored on all rows.

The dual is solved by pairs of coordinates (the pair that violates optimality most, with second-order choice of the second). Examples whose
multiplier ends at its bound can't be told apart with the margin wanted: they are removed, and the rest is solved again until none is left there.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of each class that a classifier is fitted on, at most: those with the least hashes. The kernel of both takes 32 * MOST^2 bytes.
MOST = 2000


@dataclass
class Model:
    """score(x) = sum of weights * exp(-gamma |x - vector|^2) + bias."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: float
    gamma: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The exponents of a few rows are one product of longer vectors, and all is done in place, within a core's cache."""
        if not len(self.vectors):
            return np.full(len(x), float(self.bias))
        part = max(1, (1 << 16) // len(self.vectors))
        left = np.column_stack([2 * self.gamma * x, -self.gamma * (x * x).sum(axis=1), np.ones(len(x))])
        right = np.vstack([self.vectors.T, np.ones(len(self.vectors)), -self.gamma * (self.vectors * self.vectors).sum(axis=1)])
        out, held = np.empty(len(x)), np.empty((part, len(self.vectors)))
        for at in range(0, len(x), part):
            own = held[: len(x) - at]
            np.matmul(left[at : at + part], right, out=own)
            np.exp(np.minimum(own, 0, out=own), out=own)
            out[at : at + part] = own @ self.weights + self.bias
        return out


def kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(squares, 0))


def solved(k: np.ndarray, y: np.ndarray, cost: np.ndarray, tolerance: float = 1e-3, most: int = 1_000_000) -> tuple[np.ndarray, float]:
    """Multipliers 0 .. cost and the bias, for a kernel matrix and labels -1 and 1."""
    a, slope = np.zeros(len(y)), -np.ones(len(y))
    for _ in range(most):
        up = np.where(y > 0, a < cost, a > 0)
        down = np.where(y > 0, a > 0, a < cost)
        value = -y * slope
        i = int(np.argmax(np.where(up, value, -np.inf)))
        worst = value[i] - value
        curve = np.maximum(k[i, i] + np.diagonal(k) - 2 * k[i], 1e-12)
        gain = np.where(down & (worst > 0), worst * worst / curve, -np.inf)
        j = int(np.argmax(gain))
        if not np.isfinite(gain[j]) or worst[down].max() < tolerance:
            break
        step = worst[j] / curve[j]
        step = min(step, cost[i] - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else cost[j] - a[j])
        a[i] += y[i] * step
        a[j] -= y[j] * step
        slope += y * step * (k[i] - k[j])
    # multipliers within rounding of a bound are there
    a = np.where(a < 1e-9 * cost, 0.0, np.where(a > cost * (1 - 1e-9), cost, a))
    up, down = np.where(y > 0, a < cost, a > 0), np.where(y > 0, a > 0, a < cost)
    value = -y * slope
    ends = [value[up].max() if up.any() else 0.0, value[down].min() if down.any() else 0.0]
    return a, float(sum(ends) / 2)


def fitted(x: np.ndarray, y: np.ndarray, gamma: float, cost: float, positive_weight: float, remove: bool) -> tuple[Model, np.ndarray]:
    """The model, and which examples were removed."""
    bounds = np.where(y > 0, cost * positive_weight, cost)
    whole, left = kernel(x, x, gamma), np.ones(len(y), bool)
    while True:
        own = np.nonzero(left)[0]
        a, bias = solved(whole[np.ix_(own, own)], y[own], bounds[own])
        used = own[a > 0]
        model = Model(x[used], (a * y[own])[a > 0], bias, gamma)
        stuck = own[a >= bounds[own]]
        rest = left.copy()
        rest[stuck] = False
        if not remove or not len(stuck) or len(np.unique(y[rest])) < 2:
            return model, ~left
        left = rest


def train(examples: DataFrame, gamma: float = 2.4, cost: float = 2.0, positive_weight: float = 4.0, remove: bool = True, most: int = MOST) -> Model:
    """A model of rows with features (an array; null is left out) and label (positive or not), of `most` rows of each class at most.

    Without rows of both classes it scores everything with their sign.
    """
    known = examples.filter("features IS NOT NULL").select("features", (F.col("label") > 0).alias("yes"))
    chosen = [known.filter(c).orderBy(F.xxhash64("features"), "features").limit(most) for c in (F.col("yes"), ~F.col("yes"))]

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = np.array(rows["features"].tolist(), float), np.where(rows["yes"], 1.0, -1.0)
        order = np.lexsort([*x.T, y])  # tasks may bring rows in any order
        x, y = x[order], y[order]
        model, _ = fitted(x, y, gamma, cost, positive_weight, remove) if len(np.unique(y)) > 1 else (Model(x[:0], y[:0], y[0], gamma), None)
        rows = [(v.tolist(), w) for v, w in zip(model.vectors, model.weights, strict=True)]
        return pd.DataFrame([*rows, ([], model.bias)], columns=["vector", "weight"])

    rows = chosen[0].unionByName(chosen[1]).withColumn("one", F.lit(0)).groupBy("one").applyInPandas(fit, "vector array<double>, weight double").collect()
    return _model(rows, gamma)


def _model(rows: list, gamma: float) -> Model:
    """From rows of vectors and weights, at most 2 * MOST; the one without a vector has the bias."""
    own = sorted((tuple(r.vector), r.weight) for r in rows if r.vector)
    bias = next((r.weight for r in rows if not r.vector), 0.0)
    return Model(np.array([v for v, _ in own], float), np.array([w for _, w in own], float), bias, gamma)


def scored(model: Model, rows: DataFrame) -> DataFrame:
    """rows with score: null without features."""

    @F.pandas_udf("double")
    def score(features: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=features.index)
        known = features.notna()
        if known.any():
            x = np.array(features[known].tolist(), float)
            out[known] = model.scores(x)
        return out

    value: Column = score(F.col("features"))
    return rows.withColumn("score", F.when(F.col("features").isNotNull(), value))


def write(model: Model, config: dict, path: str) -> None:
    """The model's vectors as Parquet, and one line of JSON."""
    spark = SparkSession.active()
    rows = [(v.tolist(), float(w)) for v, w in zip(model.vectors, model.weights, strict=True)]
    spark.createDataFrame([*rows, ([], float(model.bias))], "vector array<double>, weight double").write.mode("overwrite").parquet(f"{path}/model")
    spark.createDataFrame([(json.dumps(config | {"gamma": model.gamma}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def read(spark: SparkSession, path: str) -> tuple[Model, dict]:
    config = json.loads(spark.read.text(f"{path}/config").first().value)
    return _model(spark.read.parquet(f"{path}/model").collect(), config.pop("gamma")), config
