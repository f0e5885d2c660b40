"""Recurrent decoders trained data-parallel: long short-term memory over windows of samples.

A step of training is one Spark job over one minibatch, a folder of the staged
windows: every task runs its windows forward and back through time and sends
the sum of their gradients, those sums are added in two levels, and the driver
holds the weights alone and moves them (AdamW, one cycle of the rate).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.batch import staged

#: Windows that go through the network together in a task.
TOGETHER = 256


def windows(rows: DataFrame, features: Sequence[str], targets: Sequence[str], length: int, order: str, keys: Sequence[str] = ("session",), many: bool = False) -> DataFrame:
    """(keys, order, x, y): of each sample the features of the last ``length`` samples and its targets; with ``many``, stretches of that length and the targets of each of their samples.

    Samples with fewer before them, and stretches that a key's end cuts short, give no row.
    """
    xs, ys = (F.array(*[F.col(c).cast("double") for c in cs]) for cs in (features, targets))
    w = Window.partitionBy(*keys).orderBy(order)
    if not many:
        seen = F.collect_list(xs).over(w.rowsBetween(1 - length, 0))
        return rows.select(*keys, order, seen.alias("x"), ys.alias("y")).where(F.size("x") == length)
    nth = rows.withColumn("_part", F.floor((F.row_number().over(w) - 1) / length))
    both = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), xs.alias("x"), ys.alias("y"))))
    got = nth.groupBy(*keys, "_part").agg(F.min(order).alias(order), both.alias("_s")).where(F.size("_s") == length)
    return got.select(*keys, order, F.col("_s.x").alias("x"), F.col("_s.y").alias("y"))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Network:
    """LSTM layers and a linear one: ``many`` reads forward and tells something at each sample, otherwise both ways and at the last sample alone."""

    n_in: int
    n_out: int
    hidden: int = 32
    layers: int = 1
    many: bool = False
    classes: bool = False
    seed: int = 0
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        if self.weights:
            return
        rng, h = np.random.default_rng(self.seed), self.hidden
        for layer in range(self.layers):
            n = self.n_in if layer == 0 else h * len(self.ways)
            for way in self.ways:
                self.weights |= {f"{layer}{way}{k}": rng.uniform(-1, 1, shape) / math.sqrt(h) for k, shape in (("x", (n, 4 * h)), ("h", (h, 4 * h)), ("b", (4 * h,)))}
        n = h * len(self.ways)
        self.weights["out"] = rng.uniform(-1, 1, (n, self.n_out)) * math.sqrt(6 / n)
        self.weights["bias"] = rng.uniform(-1, 1, self.n_out) / math.sqrt(n)

    @property
    def ways(self) -> str:
        return ">" if self.many else "><"

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights.values()])

    def moved(self, flat: np.ndarray) -> Network:
        """The same network with other weights."""
        new, at = {}, 0
        for k, w in self.weights.items():
            new[k] = flat[at : at + w.size].reshape(w.shape)
            at += w.size
        return Network(self.n_in, self.n_out, self.hidden, self.layers, self.many, self.classes, self.seed, new)

    def _way(self, x: np.ndarray, key: str) -> tuple[np.ndarray, list]:
        """States of one layer in one direction, and what the way back needs."""
        wx, wh, b = (self.weights[key + k] for k in "xhb")
        n, length, _ = x.shape
        h, c, out, kept = np.zeros((n, self.hidden)), np.zeros((n, self.hidden)), np.empty((n, length, self.hidden)), []
        for t in range(length) if key.endswith(">") else reversed(range(length)):
            i, f, g, o = np.split(x[:, t] @ wx + h @ wh + b, 4, axis=1)
            i, f, g, o = _sigmoid(i), _sigmoid(f), np.tanh(g), _sigmoid(o)
            new = f * c + i * g
            kept.append((t, i, f, g, o, c, np.tanh(new), h))
            c, h = new, o * np.tanh(new)
            out[:, t] = h
        return out, kept

    def _back(self, x: np.ndarray, key: str, kept: list, d_out: np.ndarray, grads: dict) -> np.ndarray:
        """Gradients through time: adds those of the weights, returns those of the inputs."""
        wx, wh = self.weights[key + "x"], self.weights[key + "h"]
        dx, dh, dc = np.zeros_like(x), np.zeros((len(x), self.hidden)), np.zeros((len(x), self.hidden))
        for t, i, f, g, o, c, tc, h in reversed(kept):
            dh = dh + d_out[:, t]
            dc = dc + dh * o * (1 - tc * tc)
            gate = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dc * i * (1 - g * g), dh * tc * o * (1 - o)], axis=1)
            grads[key + "x"] += x[:, t].T @ gate
            grads[key + "h"] += h.T @ gate
            grads[key + "b"] += gate.sum(0)
            dx[:, t] = gate @ wx.T
            dh, dc = gate @ wh.T, dc * f
        return dx

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, list, np.ndarray]:
        kept, now = [], x
        for layer in range(self.layers):
            got = [self._way(now, f"{layer}{w}") for w in self.ways]
            kept.append((now, [k for _, k in got]))
            now = np.concatenate([o for o, _ in got], axis=2)
        last = now if self.many else now[:, -1]
        out = last @ self.weights["out"] + self.weights["bias"]
        if self.classes:
            out = out - out.max(-1, keepdims=True)
            out = out - np.log(np.exp(out).sum(-1, keepdims=True))
        return out, kept, now

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x)[0]

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Summed loss of windows and the sum of its gradients: squared errors, or minus the log share of the class (one of ``y``'s columns is 1)."""
        out, kept, top = self._forward(x)
        if self.classes:
            loss, d = float(-(out * y).sum()), np.exp(out) * y.sum(-1, keepdims=True) - y
        else:
            loss, d = float(((out - y) ** 2).sum()), 2 * (out - y)
        grads = {k: np.zeros_like(w) for k, w in self.weights.items()}
        last = top if self.many else top[:, -1]
        grads["out"] += last.reshape(-1, last.shape[-1]).T @ d.reshape(-1, self.n_out)
        grads["bias"] += d.reshape(-1, self.n_out).sum(0)
        d_top = np.zeros_like(top)
        if self.many:
            d_top += d @ self.weights["out"].T
        else:
            d_top[:, -1] = d @ self.weights["out"].T
        for layer in reversed(range(self.layers)):
            x_in, states = kept[layer]
            d_in = np.zeros_like(x_in)
            for k, w in enumerate(self.ways):
                d_in += self._back(x_in, f"{layer}{w}", states[k], d_top[:, :, k * self.hidden : (k + 1) * self.hidden], grads)
            d_top = d_in
        return loss, np.concatenate([g.ravel() for g in grads.values()])


def _arrays(b: pa.RecordBatch, name: str, depth: int) -> np.ndarray:
    """A column of nested arrays of one shape as an array."""
    v, shape = b.column(b.schema.get_field_index(name)), [b.num_rows]
    for _ in range(depth):
        flat = v.flatten()
        shape.append(len(flat) // max(1, len(v)))
        v = flat
    return v.to_numpy(zero_copy_only=False).reshape(shape)


def gradient_of(rows: DataFrame, net: Network) -> tuple[float, int, np.ndarray]:
    """Summed loss, number of windows and summed gradient over a table of windows."""
    deep = 2 if net.many else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, n, total = 0.0, 0, 0.0
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                some = b.slice(at, TOGETHER)
                l, g = net.gradient(_arrays(some, "x", 2), _arrays(some, "y", deep))
                loss, n, total = loss + l, n + some.num_rows, total + g
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([n]), pa.array([total.tobytes()], pa.binary())], ["loss", "n", "g"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, n, total = 0.0, 0, 0.0
        for b in batches:
            for l, k, g in zip(*(c.to_pylist() for c in b.columns), strict=True):
                loss, n, total = loss + l, n + k, total + np.frombuffer(g)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([n]), pa.array([total.tobytes()], pa.binary())], ["loss", "n", "g"])

    ddl = "loss double, n long, g binary"
    each = rows.select("x", "y").mapInArrow(run, ddl)
    loss, n, total = 0.0, 0, np.zeros(net.flat().size)
    for r in each.repartition(4).mapInArrow(add, ddl).collect():  # at most four sums of the weights' size
        loss, n, total = loss + r["loss"], n + r["n"], total + np.frombuffer(r["g"])
    return loss, n, total


class Adam:
    """AdamW with a rate that rises over the first three tenths of the steps and falls after."""

    def __init__(self, size: int, steps: int, rate: float, decay: float = 0.01):
        self.m, self.v, self.t, self.steps, self.rate, self.decay = np.zeros(size), np.zeros(size), 0, steps, rate, decay

    def rate_at(self, t: int) -> float:
        up = max(1.0, 0.3 * self.steps - 1)
        low, end = self.rate / 25, self.rate / 25e4
        if t <= up:
            return low + (self.rate - low) * (1 - math.cos(math.pi * t / up)) / 2
        return end + (self.rate - end) * (1 + math.cos(math.pi * (t - up) / max(1.0, self.steps - 1 - up))) / 2

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        rate = self.rate_at(self.t)
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        w = w * (1 - rate * self.decay)
        return w - rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def fit(rows: DataFrame, net: Network, epochs: int = 5, batches: int = 4, rate: float = 0.01, decay: float = 0.01, by: Column | None = None) -> tuple[Network, list[float]]:
    """The trained network and the mean loss of each step.

    Windows belong to one of ``batches`` minibatches by a hash (``by``, of x
    unless given), and are staged so that a step reads its own alone.
    """
    named = staged(rows.select("x", "y", F.pmod(F.xxhash64("x") if by is None else by, F.lit(batches)).cast("int").alias("_batch")).repartition("_batch", F.rand(1)), "windows")
    w, adam, losses = net.flat(), Adam(net.flat().size, epochs * batches, rate, decay), []
    for _ in range(epochs):
        for b in range(batches):
            loss, n, g = gradient_of(named.where(F.col("_batch") == b), net.moved(w))
            if n:
                losses.append(loss / n)
                w = adam.step(w, g / n)
    return net.moved(w), losses


def predict(rows: DataFrame, net: Network) -> DataFrame:
    """Windows with ``told``: the network's output (log shares of the classes), for each sample of a stretch with ``many``."""
    kind = "array<array<double>>" if net.many else "array<double>"
    ddl = ", ".join([f"`{n}` {t}" for n, t in rows.dtypes] + [f"told {kind}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                some = b.slice(at, TOGETHER)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(net.predict(_arrays(some, "x", 2)).tolist(), pa.list_(pa.list_(pa.float64())) if net.many else pa.list_(pa.float64()))], [*some.schema.names, "told"])

    return rows.mapInArrow(run, ddl)


def folds(rows: DataFrame, net: Network, fold: Column, k: int, **how) -> DataFrame:
    """(fold, loss, n): of networks trained on the other folds, the mean loss on each."""
    x = rows.withColumn("_fold", fold)
    out = []
    for f in range(k):
        trained, _ = fit(x.where(F.col("_fold") != f), net, **how)
        loss, n, _ = gradient_of(x.where(F.col("_fold") == f), trained)
        out.append((f, loss / max(1, n), n))
    return rows.sparkSession.createDataFrame(pd.DataFrame(out, columns=["fold", "loss", "n"]), "fold int, loss double, n long")
