"""Learners on feature tables: gradient-boosted trees and logistic regression of Spark, and an MLP in numpy, listwise or pointwise.

Training sets come from labelled lists. The MLP is fitted on a bounded sample of lists (a parameter) in one process; its weights are a few
thousand numbers, sent to the tasks that score. A scorer is anything with `score(frame) -> DataFrame` that adds a column."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import one_of, positive_int
from ..sources.state import load_weights, save_weights
from .order import sample_hashed


def _vectors(df: DataFrame, names: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(df)


def balanced(df: DataFrame) -> DataFrame:
    """Add weight: rows of both labels weigh the same in sum."""
    n, p = df.agg(F.count("*"), F.count_if("label")).head()
    p = max(p, 1)
    return df.withColumn("weight", F.when(F.col("label"), n / (2.0 * p)).otherwise(n / (2.0 * max(n - p, 1)))).withColumn("y", F.col("label").cast("double"))


@dataclass
class SparkScorer:
    """A fitted model of pyspark.ml."""

    model: object
    names: list[str]

    def score(self, df: DataFrame, out: str = "model") -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        rows = self.model.transform(_vectors(df, self.names))
        return rows.withColumn(out, vector_to_array("probability")[1]).select(*df.columns, out)


def logistic(df: DataFrame, names: list[str], iterations: int = 50) -> SparkScorer:
    from pyspark.ml.classification import LogisticRegression

    model = LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight", maxIter=iterations, regParam=1e-4).fit(_vectors(balanced(df), names))
    return SparkScorer(model, names)


def boosted(df: DataFrame, names: list[str], trees: int = 20, depth: int = 4) -> SparkScorer:
    from pyspark.ml.classification import GBTClassifier

    model = GBTClassifier(featuresCol="features", labelCol="y", weightCol="weight", maxIter=trees, maxDepth=depth, seed=7).fit(_vectors(balanced(df), names))
    return SparkScorer(model, names)


@dataclass
class MLP:
    """features -> hidden layers -> 1 with a linear skip, by Adam. objective: `listwise`, softmax cross-entropy over a query's list plus a
    margin, or `pointwise`, cross-entropy of each row with positives weighted to the sum of the others. With `residual`, every hidden layer
    after the first adds to its input. Fitted on at most `max_lists` lists, chosen by hash."""

    names: list[str]
    hidden: int = 32
    layers: int = 2
    residual: bool = False
    objective: str = "listwise"
    skip: float = 0.15
    margin: float = 0.05
    epochs: int = 30
    rate: float = 3e-3
    batch: int = 256
    seed: int = 42
    max_lists: int = 20_000
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        one_of(self.objective, ["listwise", "pointwise"], "objective")
        positive_int(self.layers, "layers")

    def forward(self, x: np.ndarray, w: dict[str, np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Scores, and of each hidden layer its input and what it activates."""
        inputs, active, h = [], [], x
        for k in range(self.layers):
            a = np.maximum(h @ w[f"w{k}"] + w[f"b{k}"], 0)
            inputs.append(h)
            active.append(a)
            h = h + a if self.residual and k else a
        return (h @ w["out"] + self.skip * (x @ w["line"]))[..., 0], [*inputs, h], active

    def gradient(self, x: np.ndarray, slope: np.ndarray, w: dict[str, np.ndarray], inputs: list[np.ndarray], active: list[np.ndarray]) -> dict[str, np.ndarray]:
        """Of all weights, from the slope of the loss in each score."""
        g = slope[:, None]
        out = {"out": inputs[-1].T @ g, "line": self.skip * (x.T @ g)}
        d = g @ w["out"].T
        for k in reversed(range(self.layers)):
            own = d * (active[k] > 0)
            out |= {f"w{k}": inputs[k].T @ own, f"b{k}": own.sum(0)}
            below = own @ w[f"w{k}"].T
            d = d + below if self.residual and k else below
        return out

    def slope(self, s: np.ndarray, y: np.ndarray, size: np.ndarray, weight: float) -> np.ndarray:
        """Of the mean loss in each score; size: rows of each list."""
        if self.objective == "pointwise":
            return (1 / (1 + np.exp(-np.clip(s, -35, 35))) - y) * np.where(y > 0, weight, 1.0) / len(s)
        first = np.cumsum(size) - size
        spread = lambda v: np.repeat(v, size)
        e = np.exp(s - spread(np.maximum.reduceat(s, first)))
        p = e / spread(np.add.reduceat(e, first))
        other = spread(np.maximum.reduceat(np.where(y > 0, -np.inf, s), first))
        short = (spread(np.add.reduceat(s * y, first)) - other < 1.0).astype(float)
        return ((p - y) + self.margin * short * ((s == other) * (1 - y) - y)) / len(size)

    def loss(self, s: np.ndarray, y: np.ndarray, size: np.ndarray, weight: float) -> float:
        if self.objective == "pointwise":
            return float(np.mean((np.logaddexp(0, s) - y * s) * np.where(y > 0, weight, 1.0)))
        first = np.cumsum(size) - size
        total = np.log(np.add.reduceat(np.exp(s), first)) - np.add.reduceat(s * y, first)
        other = np.maximum.reduceat(np.where(y > 0, -np.inf, s), first)
        return float(np.mean(total + self.margin * np.maximum(1.0 - (np.add.reduceat(s * y, first) - other), 0)))

    def fresh(self, rng: np.random.Generator) -> dict[str, np.ndarray]:
        f, h, w = len(self.names), self.hidden, {}
        for k in range(self.layers):
            n = h if k else f
            w |= {f"w{k}": rng.normal(0, (2 / n) ** 0.5, (n, h)), f"b{k}": np.zeros(h)}
        return w | {"out": rng.normal(0, h**-0.5, (h, 1)), "line": np.zeros((f, 1))}

    def fit(self, df: DataFrame) -> "MLP":
        """df: qid, label and the features; a list is used if it has one positive and others."""
        lists = df.select("qid").distinct()
        if lists.count() > self.max_lists:
            df = df.join(sample_hashed(lists, self.max_lists, self.seed, "qid"), "qid", "left_semi")
        rows = df.select("qid", "label", *self.names).orderBy("qid").toPandas()
        values = rows[self.names].to_numpy(float)
        mean, std = values.mean(0), values.std(0)
        std[std < 1e-6] = 1.0
        values = (values - mean) / std
        starts = np.flatnonzero(np.r_[True, rows.qid.to_numpy()[1:] != rows.qid.to_numpy()[:-1]])
        ends, label = np.r_[starts[1:], len(rows)], rows.label.to_numpy(bool)
        groups = [(a, b) for a, b in zip(starts, ends, strict=True) if label[a:b].sum() == 1 and b - a > 1]
        rng = np.random.default_rng(self.seed)
        w = self.fresh(rng)
        m, v, t = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
        for _ in range(self.epochs):
            order = rng.permutation(len(groups))
            for k in range(0, len(order), self.batch):
                some = [groups[i] for i in order[k : k + self.batch]]
                at, size = np.concatenate([np.arange(a, b) for a, b in some]), np.array([b - a for a, b in some])
                x, y = values[at], label[at].astype(float)
                s, inputs, active = self.forward(x, w)
                grad = self.gradient(x, self.slope(s, y, size, (len(y) - y.sum()) / max(y.sum(), 1)), w, inputs, active)
                t += 1
                for n in w:
                    m[n] = 0.9 * m[n] + 0.1 * grad[n]
                    v[n] = 0.999 * v[n] + 0.001 * grad[n] ** 2
                    w[n] -= self.rate * (m[n] / (1 - 0.9**t)) / (np.sqrt(v[n] / (1 - 0.999**t)) + 1e-8)
        self.weights = w | {"mean": mean, "std": std}
        return self

    def score(self, df: DataFrame, out: str = "model") -> DataFrame:
        w, forward = self.weights, self.forward

        @F.pandas_udf("double")
        def apply(*columns: pd.Series) -> pd.Series:
            x = (np.column_stack([c.to_numpy(float) for c in columns]) - w["mean"]) / w["std"]
            return pd.Series(forward(x, w)[0])

        return df.withColumn(out, apply(*[F.col(n) for n in self.names]))

    def save(self, spark: SparkSession, path: str) -> None:
        about = {k: v for k, v in asdict(self).items() if k != "weights"}
        save_weights(spark, path, self.weights, about)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "MLP":
        weights, about = load_weights(spark, path)
        return cls(**about, weights=weights)


class ListwiseMLP(MLP):
    """Two hidden layers over lists."""
