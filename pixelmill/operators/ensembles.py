"""Classifiers that Spark ML hasn't got: boosting by reweighted trees, and a kernel machine over random features."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier, LinearSVC, OneVsRest, OneVsRestModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.operators.ml import vectors
from pixelmill.session import checkpoint_folder

#: Machines that are fitted at a time.
PARALLEL = 5


@dataclass
class Boosted:
    """Trees and their weights; ``errors``: each tree's weighted share of wrong rows when it was fitted."""

    trees: list[DecisionTreeClassificationModel]
    weights: list[float]
    errors: list[float]
    classes: list[int]


def boost(rows: DataFrame, rounds: int = 5, depth: int = 1, seed: int = 1) -> Boosted:
    """Boosting of several classes (SAMME) for ``rows(features, label)``, labels whole numbers from 0.

    In each round a tree is fitted to weighted rows; the weights of rows that it gets wrong rise by the odds of its error, times classes less one. Rounds end when a tree makes
    no error, or is no better than chance. A row stays a row; its weight is a column.
    """
    checkpoint_folder(rows.sparkSession)
    data = vectors(rows.select("features", F.col("label").cast("double").alias("label"))).where("label is not null").withColumn("w", F.lit(1.0)).checkpoint()
    classes = sorted(int(r[0]) for r in data.select("label").distinct().collect())
    out = Boosted([], [], [], classes)
    for k in range(rounds):
        tree = DecisionTreeClassifier(featuresCol="raw", weightCol="w", maxDepth=depth, seed=seed + k).fit(data)
        made = tree.transform(data).withColumn("wrong", (F.col("prediction") != F.col("label")).cast("double")).select("features", "label", "raw", "w", "wrong").checkpoint()
        sums = made.agg(F.sum(F.col("w") * F.col("wrong")).alias("e"), F.sum("w").alias("w"), F.count("*").alias("n")).first()
        error = (sums["e"] or 0.0) / sums["w"] if sums["w"] else 0.0
        if error >= 1 - 1 / max(2, len(classes)):
            if not out.trees:
                out = Boosted([tree], [1.0], [error], classes)
            break
        weight = math.log((1 - error) / max(error, 1e-10)) + math.log(max(1, len(classes) - 1))
        out.trees.append(tree)
        out.weights.append(weight)
        out.errors.append(error)
        if not error:
            break
        # to mean weight 1, so that they neither vanish nor overflow
        scale = sums["n"] / (sums["w"] - sums["e"] + sums["e"] * math.exp(weight))
        data = made.select("features", "label", "raw", (F.col("w") * F.exp(F.col("wrong") * weight) * scale).alias("w"))
    return out


def boosted_predictions(model: Boosted, rows: DataFrame) -> DataFrame:
    """``rows`` with ``prediction`` (the class with most weight of trees, the smallest of equals) and ``margin``, its share less that of the next."""
    made = vectors(rows)
    votes = F.array(*[F.lit(0.0) for _ in model.classes])
    for tree, weight in zip(model.trees, model.weights):
        made = tree.setPredictionCol("_p").transform(made).drop("rawPrediction", "probability")
        hit = F.array(*[F.when(F.col("_p") == c, weight).otherwise(0.0) for c in model.classes])
        made = made.withColumn("_v", F.zip_with(F.col("_v") if "_v" in made.columns else votes, hit, lambda a, b: a + b)).drop("_p")
    best = F.array_position("_v", F.array_max("_v")).cast("int")
    total = sum(model.weights)
    order = F.sort_array("_v", asc=False)
    margin = (order[0] - (order[1] if len(model.classes) > 1 else 0.0)) / total
    return made.withColumn("prediction", F.array(*map(F.lit, model.classes))[best - 1]).withColumn("margin", margin).drop("raw", "_v")


@dataclass
class Features:
    """Random directions and phases whose cosines have the Gaussian kernel exp(-gamma |x - y|^2) as mean product; centre and scale of the entries before."""

    mean: np.ndarray
    std: np.ndarray
    directions: np.ndarray
    phases: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        return math.sqrt(2 / len(self.phases)) * np.cos((x - self.mean) / self.std @ self.directions + self.phases)


def random_features(rows: DataFrame, gamma: float | None = None, size: int = 256, seed: int = 1) -> Features:
    """Random Fourier features for ``rows(features)`` scaled to unit deviation; ``gamma`` is 1 / dimension unless given.

    The product of two rows' features is off the kernel by more than e with a chance of at most 2 exp(-size e^2 / 4), since it is a mean of
    ``size`` independent terms within -2 and 2 (plus one of mean 0).
    """
    d = len(rows.where("features is not null").first()["features"])
    row = rows.agg(*[g(F.col("features")[k]).alias(f"{n}{k}") for k in range(d) for n, g in (("m", F.avg), ("s", F.stddev_pop))]).first()
    std = np.array([row[f"s{k}"] or 1.0 for k in range(d)])
    rng = np.random.default_rng(seed)
    return Features(np.array([row[f"m{k}"] for k in range(d)]), std, rng.normal(size=(d, size)) * math.sqrt(2 * (gamma or 1 / d)), rng.uniform(0, 2 * math.pi, size))


def mapped(rows: DataFrame, by: Features) -> DataFrame:
    """``rows`` with ``raw``, the vector of random features."""
    @F.pandas_udf("array<double>")
    def run(v):
        import pandas as pd

        return pd.Series(list(by.of(np.stack(v.to_numpy()).astype(float)))) if len(v) else pd.Series([], dtype=object)

    return rows.withColumn("raw", array_to_vector(run(F.transform("features", lambda x: x.cast("double")))))


def kernel_machine(rows: DataFrame, gamma: float | None = None, size: int = 256, penalty: float = 1e-3, seed: int = 1) -> tuple[Features, OneVsRestModel]:
    """A support vector machine with a Gaussian kernel for ``rows(features, label)``: linear machines over random features, one a class against the rest.

    Machines don't depend on each other, and ``PARALLEL`` of them are fitted at a time, each on its own blocks of the rows: a step of one is a short job, most of whose time is waiting.
    """
    by = random_features(rows, gamma, size, seed)
    data = mapped(rows.select("features", F.col("label").cast("double").alias("label")).where("label is not null and features is not null"), by)
    return by, OneVsRest(classifier=LinearSVC(featuresCol="raw", regParam=penalty, maxIter=50), featuresCol="raw", parallelism=PARALLEL).fit(data)


def kernel_predictions(model: tuple[Features, OneVsRestModel], rows: DataFrame) -> DataFrame:
    """``rows`` with ``prediction``."""
    by, machine = model
    return machine.transform(mapped(rows, by)).drop("raw", "rawPrediction").withColumn("prediction", F.col("prediction").cast("int"))
