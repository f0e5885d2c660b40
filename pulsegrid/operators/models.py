"""Linear models from Gram matrices: the rows are reduced by one aggregate, the small matrices solved with NumPy."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F


def gram(rows: DataFrame, xs: Sequence[str], ys: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """X'X, X'Y, Y'Y and the number of rows, in one pass of sums; columns x columns numbers reach the driver."""
    cols = [*xs, *ys]
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"s_{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    r = rows.dropna(subset=cols).agg(F.count(F.lit(1)).alias("n"), *sums).first()
    m = np.zeros((len(cols), len(cols)))
    for i in range(len(cols)):
        for j in range(i, len(cols)):
            m[i, j] = m[j, i] = r[f"s_{i}_{j}"] or 0.0
    k = len(xs)
    return m[:k, :k], m[:k, k:], m[k:, k:], r["n"]


@dataclass
class Linear:
    """Coefficients (x by y) of a linear map without intercept."""

    xs: list[str]
    ys: list[str]
    weights: np.ndarray

    def predict(self, rows: DataFrame, prefix: str = "pred_") -> DataFrame:
        for j, y in enumerate(self.ys):
            rows = rows.withColumn(prefix + y, sum((F.col(x) * float(self.weights[i, j]) for i, x in enumerate(self.xs)), F.lit(0.0)))
        return rows

    def score(self, rows: DataFrame) -> float:
        """Correlation-free share of squared error: 1 - |Y - XW|^2 / |Y|^2."""
        xx, xy, yy, _ = gram(rows, self.xs, self.ys)
        w = self.weights
        return float(1 - np.trace(yy - 2 * w.T @ xy + w.T @ xx @ w) / np.trace(yy))


def ridge(rows: DataFrame, xs: Sequence[str], ys: Sequence[str], reg: float = 0.0) -> Linear:
    xx, xy, _, _ = gram(rows, xs, ys)
    return Linear(list(xs), list(ys), np.linalg.pinv(xx + reg * np.eye(len(xx))) @ xy)


def reduced_rank(rows: DataFrame, xs: Sequence[str], ys: Sequence[str], rank: int, reg: float = 0.0) -> Linear:
    """Ridge solution projected on the leading directions of its fitted values."""
    xx, xy, _, _ = gram(rows, xs, ys)
    full = np.linalg.pinv(xx + reg * np.eye(len(xx))) @ xy
    _, _, v = np.linalg.svd(xy.T @ full)
    return Linear(list(xs), list(ys), full @ v[:rank].T @ v[:rank])


@dataclass
class KernelReducedRank:
    """Kernel ridge of a reduced rank; the kernel is linear, so the Gram matrices of all rows give its solution."""

    xs: list[str]
    ys: list[str]
    rank: int
    reg: float = 1.0

    def fit(self, rows: DataFrame) -> "KernelReducedRank":
        xx, xy, _, _ = gram(rows, self.xs, self.ys)
        full = np.linalg.solve(xx + self.reg * np.eye(len(xx)), xy)
        # right singular vectors of the fitted values, from their own Gram matrix
        _, v = np.linalg.eigh(full.T @ xx @ full)
        v = v[:, ::-1][:, : self.rank]
        self.model = Linear(self.xs, self.ys, full @ v @ v.T)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.model.predict(rows)

    def score(self, rows: DataFrame) -> float:
        return self.model.score(rows)


def identify_system(rows: DataFrame, inputs: Sequence[str], outputs: Sequence[str], order: str, states: int, lags: int = 4, keys: Sequence[str] = ("session",)) -> tuple[np.ndarray, np.ndarray]:
    """(A, C) of a linear system by subspaces: future outputs regressed on past inputs and outputs, lags by windows, the rest from Gram matrices."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order)
    x, past, future = rows, [], []
    for c in (*inputs, *outputs):
        for k in range(1, lags + 1):
            x = x.withColumn(f"p_{c}_{k}", F.lag(c, k).over(w))
            past.append(f"p_{c}_{k}")
    for k in range(lags):
        for c in outputs:
            x = x.withColumn(f"f_{c}_{k}", F.lead(c, k).over(w))
            future.append(f"f_{c}_{k}")
    xx, xy, _, _ = gram(x, past, future)
    fitted = np.linalg.pinv(xx) @ xy
    u, s, _ = np.linalg.svd(xy.T @ fitted)
    observability = u[:, :states] * np.sqrt(s[:states])
    m = len(outputs)
    return np.linalg.pinv(observability[:-m]) @ observability[m:], observability[:m]


def classifier(rows: DataFrame, features: Sequence[str], label: str, hidden: Sequence[int] = (32,), seed: int = 0):
    """A feed-forward classifier fitted by ``pyspark.ml``; the label is an index from 0."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import VectorAssembler

    n = int(rows.agg(F.max(label)).first()[0]) + 1
    net = MultilayerPerceptronClassifier(layers=[len(features), *hidden, n], labelCol=label, featuresCol="_features", seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features"), net]).fit(rows)


def label_index(rows: DataFrame, label: str, out: str = "index") -> DataFrame:
    """Labels as 0 .. n-1 in their order; the list of labels is small by nature, and Spark decides how to join it."""
    from pyspark.sql import Window

    ls = rows.select(label).distinct().withColumn(out, F.row_number().over(Window.orderBy(label)) - 1)
    return rows.join(ls, label)


def cross_validated(rows: DataFrame, xs: Sequence[str], ys: Sequence[str], fold: str, k: int, reg: float = 1.0) -> DataFrame:
    """(fold, r2) of ridge regressions tested on each fold in turn."""
    out = []
    for f in range(k):
        m = ridge(rows.where(F.col(fold) != f), xs, ys, reg)
        out.append((f, m.score(rows.where(F.col(fold) == f))))
    return rows.sparkSession.createDataFrame(out, "fold int, r2 double")
