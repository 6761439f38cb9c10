"""Class models and their evaluation with Spark ML, thresholds and shape priors."""

from __future__ import annotations

import json
import math
import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.operators import datasets

CLASSIFIERS = {
    "random forest": lambda: RandomForestClassifier(featuresCol="input", numTrees=20, seed=1),
    "decision tree": lambda: DecisionTreeClassifier(featuresCol="input", seed=1),
    "logistic regression": lambda: LogisticRegression(featuresCol="input", maxIter=50),
    "perceptron": lambda: MultilayerPerceptronClassifier(featuresCol="input", layers=[1, 1], seed=1),
    "naive Bayes": lambda: NaiveBayes(featuresCol="input", modelType="gaussian"),
}


def vectors(rows: DataFrame, features: str = "features") -> DataFrame:
    return rows.withColumn("raw", array_to_vector(features))


def _stages(pca: int | None, scale: bool) -> tuple[list, str]:
    stages, at = [], "raw"
    if scale:
        stages.append(StandardScaler(inputCol=at, outputCol="scaled", withMean=True))
        at = "scaled"
    if pca:
        stages.append(PCA(k=pca, inputCol=at, outputCol="reduced"))
        at = "reduced"
    return stages, at


def class_model(rows: DataFrame, classes: int, pca: int | None = None, scale: bool = True, kind: str = "mixture", seed: int = 1, iterations: int = 99) -> PipelineModel:
    """An unsupervised model of classes: scaler, optional PCA, then a Gaussian mixture or k-means."""
    stages, at = _stages(pca, scale)
    last = GaussianMixture(featuresCol=at, k=classes, seed=seed, maxIter=iterations) if kind == "mixture" else KMeans(featuresCol=at, k=classes, seed=seed)
    return Pipeline(stages=[*stages, last]).fit(vectors(rows))


def probabilities(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows with ``prediction`` and, for mixtures and classifiers, ``proba`` as an array."""
    out = model.transform(vectors(rows))
    if "probability" in out.columns:
        out = out.withColumn("proba", vector_to_array("probability"))
    return out.drop("raw", "scaled", "reduced", "input", "probability", "rawPrediction")


def classifier(name: str, pca: int | None = None) -> Pipeline:
    """Scaler, optional PCA and a classifier of ``CLASSIFIERS`` on column ``raw`` and label ``label``."""
    stages, at = _stages(pca, True)
    last = CLASSIFIERS[name]()
    return Pipeline(stages=[*stages, last.setFeaturesCol(at)])


def train(rows: DataFrame, name: str, pca: int | None = None) -> PipelineModel:
    return classifier(name, pca).fit(vectors(rows))


def search(rows: DataFrame, name: str, grid: dict[str, list], fold: str | None = None, folds: int = 3, metric: str = "f1") -> CrossValidatorModel:
    """Cross-validated search over a grid of the classifier's parameters; ``fold`` names a column of fold numbers."""
    pipe = classifier(name)
    builder, last = ParamGridBuilder(), pipe.getStages()[-1]
    for key, values in grid.items():
        builder = builder.addGrid(last.getParam(key), values)
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=builder.build(), evaluator=MulticlassClassificationEvaluator(metricName=metric), numFolds=folds, seed=1, parallelism=2)
    return (cv.setFoldCol(fold) if fold else cv).fit(vectors(rows))


def draw_params(space: dict[str, list | tuple], draws: int, seed: int = 0) -> list[dict]:
    """Different random draws from ``space``: a list is drawn from alike; (low, high) evenly, in whole numbers (both included) if both ends are; (low, high, "log") evenly in logarithm.

    A rerun draws the same. A space of few values may have fewer draws than asked for.
    """
    rng, out = random.Random(seed), {}
    for _ in range(20 * draws):
        one = {}
        for key, values in sorted(space.items()):
            if isinstance(values, list):
                one[key] = rng.choice(values)
            elif len(values) == 3:
                one[key] = math.exp(rng.uniform(math.log(values[0]), math.log(values[1])))
            elif all(isinstance(v, int) for v in values):
                one[key] = rng.randint(*values)
            else:
                one[key] = rng.uniform(*values)
        out.setdefault(repr(one), one)
        if len(out) == draws:
            break
    return list(out.values())


def random_search(rows: DataFrame, name: str, space: dict[str, list | tuple], draws: int = 16, fold: str | None = None, folds: int = 3, metric: str = "f1", keep: int = 4, seed: int = 0) -> DataFrame:
    """Random draws of a classifier's parameters by successive halving: (draw, round, share, params, score), best of the last round first.

    In each round draws are cross-validated, all folds and draws in one search; a ``keep``-th of them, rounded up, goes on with ``keep`` times as many rows, until all rows are used by
    at most ``keep`` draws. Rows of a smaller round are those with the smallest hashes of their features, so that a rerun uses the same. ``params`` is JSON.
    """
    spark = rows.sparkSession
    cells = 1 << 20
    rows = rows.withColumn("_cell", F.pmod(F.xxhash64("features", "label", F.lit(seed)), F.lit(cells)))
    left, out = dict(enumerate(draw_params(space, draws, seed))), []
    rounds = 0
    while keep**rounds < len(left):
        rounds += 1
    for k in range(max(1, rounds)):
        share = float(keep) ** (k + 1 - max(1, rounds))
        part = rows.where(F.col("_cell") < math.ceil(share * cells)).drop("_cell")
        pipe = classifier(name)
        last = pipe.getStages()[-1]
        maps = [{last.getParam(p): v for p, v in one.items()} for one in left.values()]
        cv = CrossValidator(estimator=pipe, estimatorParamMaps=maps, evaluator=MulticlassClassificationEvaluator(metricName=metric), numFolds=folds, seed=1, parallelism=4)
        scores = (cv.setFoldCol(fold) if fold else cv).fit(vectors(part)).avgMetrics
        order = sorted(zip(left, scores), key=lambda x: (-x[1], x[0]))
        out += [(d, k, share, json.dumps(left[d], sort_keys=True), float(x)) for d, x in order]
        left = {d: left[d] for d, _ in order[: -(-len(order) // keep)]}
    return spark.createDataFrame(out, "draw int, round int, share double, params string, score double").orderBy(F.desc("round"), F.desc("score"), "draw")


def cross_scores(rows: DataFrame, name: str, fold: str, metrics: tuple[str, ...] = ("accuracy", "f1", "weightedPrecision", "weightedRecall")) -> DataFrame:
    """Rows (fold, metric, score): each fold is predicted by a model of the others."""
    spark, out = rows.sparkSession, []
    for (k,) in rows.select(fold).distinct().orderBy(fold).collect():
        made = train(rows.where(F.col(fold) != k), name).transform(vectors(rows.where(F.col(fold) == k)))
        made = made.cache()
        out += [(int(k), m, float(MulticlassClassificationEvaluator(metricName=m).evaluate(made))) for m in metrics]
        made.unpersist()
    return spark.createDataFrame(out, "fold int, metric string, score double")


def feature_scores(rows: DataFrame, label: str, features: str = "features") -> DataFrame:
    """Rows (feature, variance, f_score): variance, and the ANOVA F of each feature's means between labels."""
    each = rows.select(label, F.posexplode(features).alias("feature", "v"))
    g = each.groupBy("feature", label).agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    t = g.groupBy("feature").agg(F.sum("n").alias("_all"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("_mean"), F.sum(F.col("n") * F.col("s")).alias("within"))
    j = g.join(t, "feature").groupBy("feature", "_all", "k", "within").agg(F.sum(F.col("n") * (F.col("m") - F.col("_mean")) * (F.col("m") - F.col("_mean"))).alias("between"))
    return j.select("feature", ((F.col("between") + F.col("within")) / F.col("_all")).alias("variance"), ((F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("_all") - F.col("k")))).alias("f_score"))


def best_features(rows: DataFrame, label: str, n: int, features: str = "features") -> DataFrame:
    """Rows with the n features of the largest F only, in their order; the numbers of features are few and go through the driver."""
    scores = feature_scores(rows, label, features).select("feature", "f_score").collect()
    keep = sorted(r["feature"] for r in sorted(scores, key=lambda r: (-(r["f_score"] or 0.0), r["feature"]))[:n])
    return rows.withColumn(features, F.array(*[F.col(features)[k] for k in keep]))


def search_results(found: CrossValidatorModel, params: list[dict]) -> list[dict]:
    """The parameters that were tried, with their mean scores, best first."""
    rows = [{**{p.name: v for p, v in grid.items()}, "score": s} for grid, s in zip(params, found.avgMetrics, strict=True)]
    return sorted(rows, key=lambda r: -r["score"])


def save_model(model: PipelineModel, path: str) -> None:
    """Keep a fitted model in a folder that executors share; an older one there is replaced."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def leave_groups_out(rows: DataFrame, group: str, name: str, hold_out: int = 1, pca: int | None = None) -> DataFrame:
    """Rows with the prediction of a model that was trained on other groups: leave one (or ``hold_out``) out.

    Groups make the folds; each fold is a job of its own, as models are fitted one after the other.
    """
    folds, out = datasets.group_folds(rows, group, hold_out).cache(), None
    for (k,) in folds.select("fold").distinct().orderBy("fold").collect():
        made = probabilities(train(folds.where(F.col("fold") != k), name, pca), folds.where(F.col("fold") == k))
        out = made if out is None else out.unionByName(made)
    return out


def otsu(rows: DataFrame, keys: list[str], value: str, bins: int = 256) -> DataFrame:
    """Otsu's threshold of each group: (keys, threshold), the centre of the histogram bin that parts values best, the first of equals.

    Values are counted in bins, then only bins are compared; a flat group has its value as threshold.
    """
    ends = rows.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    b = F.least(F.floor((F.col(value) - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo"))), F.lit(bins - 1))
    h = rows.join(ends, keys).groupBy(*keys, "_lo", "_hi", F.when(F.col("_hi") > F.col("_lo"), b).otherwise(0).cast("long").alias("_b")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    up = w.orderBy("_b")
    run = h.select(
        "*", F.sum("_n").over(up).alias("_c"), F.sum(F.col("_n") * F.col("_b")).over(up).alias("_s"),
        F.sum("_n").over(w).alias("_t"), F.sum(F.col("_n") * F.col("_b")).over(w).alias("_u"))
    apart = F.col("_s") * F.col("_t") - F.col("_u") * F.col("_c")
    score = F.when(F.col("_c") < F.col("_t"), apart.cast("double") * apart.cast("double") / (F.col("_c") * (F.col("_t") - F.col("_c"))).cast("double")).otherwise(-1.0)
    best = run.groupBy(*keys, "_lo", "_hi").agg(F.max_by("_b", F.struct(score, -F.col("_b"))).alias("_b"))
    return best.select(*keys, (F.col("_lo") + (F.col("_b") + 0.5) * (F.col("_hi") - F.col("_lo")) / bins).alias("threshold"))


def ray_histogram(rays: DataFrame, bins: int = 10) -> DataFrame:
    """From rays (id, angle, dist): for each angle and bin, the share of rays that reach beyond it: (angle, bin, beyond)."""
    ends = rays.groupBy("angle").agg(F.min("dist").alias("_lo"), F.max("dist").alias("_hi"), F.count("*").alias("_t"))
    b = F.least(F.floor((F.col("dist") - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo"))), F.lit(bins - 1))
    n = rays.join(ends, "angle").groupBy("angle", "_t", F.when(F.col("_hi") > F.col("_lo"), b).otherwise(0).cast("int").alias("bin")).agg(F.count("*").alias("_n"))
    grid = ends.select("angle", "_t", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = grid.join(n.drop("_t"), ["angle", "bin"], "left").fillna(0, ["_n"])
    up = F.sum("_n").over(Window.partitionBy("angle").orderBy("bin"))
    return full.select("angle", "bin", ((F.col("_t") - up) / F.col("_t")).alias("beyond"))


def prior_cells(table: DataFrame, angles: int, reach: int) -> DataFrame:
    """Cells (a, d, p0 to p3) of a table (a, d, p): each with the next ones by distance, by angle and by both, the last cell standing for those beyond."""
    cells = table.select("a", "d", F.col("p").alias("p0"))
    for k, (i, j) in enumerate(((0, 1), (1, 0), (1, 1)), 1):
        cell = table.select(F.col("a").alias("_i"), F.col("d").alias("_j"), F.col("p").alias(f"p{k}"))
        cells = cells.join(cell, (F.pmod(F.col("a") + i, F.lit(angles)) == F.col("_i")) & (F.least(F.col("d") + j, F.lit(reach - 1)) == F.col("_j"))).drop("_i", "_j")
    return cells


def shape_prior(points: DataFrame, table: DataFrame, angles: int, reach: int) -> DataFrame:
    """Adds ``prior`` to points (…, dx, dy): the table (a, d, p) of ``angles`` x ``reach`` cells, or its ``prior_cells``, looked up in polar form, bilinear within and the last cell beyond."""
    dist = F.sqrt((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).cast("double"))
    angle = F.pmod(F.lit(810.0) - F.degrees(F.atan2(F.col("dy").cast("double"), F.col("dx").cast("double"))), F.lit(360.0)) / (360.0 / angles)
    beyond = F.col("_dist") >= reach - 1
    p = points.withColumns({"_dist": dist, "_ang": angle}).withColumns({"_a": F.when(beyond, F.bround("_ang")).otherwise(F.floor("_ang")).cast("int"), "_d": F.when(beyond, reach - 1).otherwise(F.floor("_dist")).cast("int")})
    cells = table if "p3" in table.columns else prior_cells(table, angles, reach)
    cells = cells.select(F.col("a").alias("_i"), F.col("d").alias("_j"), *[F.col(f"p{k}").alias(f"_p{k}") for k in range(4)])
    # of a table angles times reach cells, whatever the points' number
    p = p.join(F.broadcast(cells), (F.pmod(F.col("_a"), F.lit(angles)) == F.col("_i")) & (F.col("_d") == F.col("_j"))).drop("_i", "_j")
    s, t = F.col("_ang") - F.col("_a"), F.col("_dist") - F.col("_d")
    inside = (1 - s) * ((1 - t) * F.col("_p0") + t * F.col("_p1")) + s * ((1 - t) * F.col("_p2") + t * F.col("_p3"))
    return p.withColumn("prior", F.when(beyond, F.col("_p0")).otherwise(inside)).drop("_dist", "_ang", "_a", "_d", "_p0", "_p1", "_p2", "_p3")
