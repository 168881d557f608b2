"""Learners: MLlib estimators, plus an isolation forest built in parallel tasks."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import HashingTF, IDF, Normalizer, PCA, RobustScaler, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder, TrainValidationSplit
from pyspark.sql import Column, DataFrame, functions as F

from factorwise.functions.vectors import dot, sigmoid
from factorwise.operators.sampling import folds, uniform
from factorwise.plans.materialise import cut_lineage

PCA_VARIANCE = 0.95


# -------------------------------------------------------------- preparation


def assemble(df: DataFrame, cols: Sequence[str], *, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)


def robust_scaler(train: DataFrame, cols: Sequence[str]) -> PipelineModel:
    """Median and 5-95 % range of the training rows."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(cols), outputCol="raw"),
            RobustScaler(inputCol="raw", outputCol="scaled", lower=0.05, upper=0.95, withCentering=True),
        ]
    ).fit(train)


def preprocessing(train: DataFrame, cols: Sequence[str], *, variance: float = PCA_VARIANCE) -> PipelineModel:
    """Standard scaling and the leading components that hold ``variance`` of the total.

    All components are fitted once; the last stage keeps the leading ones.
    """
    fitted = Pipeline(
        stages=[
            VectorAssembler(inputCols=list(cols), outputCol="raw"),
            StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True),
            PCA(k=len(cols), inputCol="scaled", outputCol="all_components"),
        ]
    ).fit(train)
    share = np.cumsum(fitted.stages[-1].explainedVariance.toArray())
    k = min(int(np.searchsorted(share, variance - 1e-12) + 1), len(cols))
    return PipelineModel(stages=[*fitted.stages, VectorSlicer(inputCol="all_components", outputCol="components", indices=list(range(k)))])


def explained_variance(model: PipelineModel, spark) -> DataFrame:
    pca, kept = model.stages[-2:]
    ratios = [float(x) for x in pca.explainedVariance.toArray()][: len(kept.getIndices())]
    rows = [(i + 1, r, s) for i, (r, s) in enumerate(zip(ratios, np.cumsum(ratios).tolist()))]
    return spark.createDataFrame(rows, "component int, ratio double, cumulative double")


def apply_preprocessing(model: PipelineModel, df: DataFrame, *, key: str, column: str = "components") -> DataFrame:
    return model.transform(df).select(key, vector_to_array(column).alias("vector"))


def text_vectors(texts: DataFrame, *, key: str = "invoice_id", text: str = "text", dim: int = 384, model: PipelineModel | None = None):
    """(key, embedding) unit vectors of hashed TF-IDF words, and the fitted weights."""
    tokens = texts.withColumn("_words", F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b[\w\-]+\b"), F.lit(0)))
    if model is None:
        counts = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dim)
        weights = IDF(inputCol="_tf", outputCol="_tfidf").fit(counts.transform(tokens.select("_words")))
        model = PipelineModel(stages=[counts, weights, Normalizer(inputCol="_tfidf", outputCol="_unit", p=2.0)])
    keep = [c for c in texts.columns if c != text or c == key]
    return model.transform(tokens).select(*keep, vector_to_array("_unit", "float32").alias("embedding")), model


# --------------------------------------------------------- isolation forest


def _leaf_length(n: np.ndarray | float):
    """Mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=np.float64)
    h = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * h - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (node, feature, cut, left, right, length) of one tree, breadth first."""
    nodes, todo = [], [(0, np.arange(len(x)), 0)]
    free = 1
    while todo:
        node, rows, depth = todo.pop(0)
        lo, hi = (x[rows].min(0), x[rows].max(0)) if len(rows) else (None, None)
        usable = np.flatnonzero(hi > lo) if len(rows) > 1 else []
        if depth >= limit or len(usable) == 0:
            nodes.append((node, -1, 0.0, -1, -1, float(depth + _leaf_length(len(rows)))))
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(lo[f], hi[f]))
        left = x[rows, f] < cut
        nodes.append((node, f, cut, free, free + 1, 0.0))
        todo += [(free, rows[left], depth + 1), (free + 1, rows[~left], depth + 1)]
        free += 2
    return nodes


def isolation_trees(train: DataFrame, *, key: str = "id", trees: int = 200, sample: int = 256, seed: int = 42) -> DataFrame:
    """Tree table of an isolation forest: tree, node, feature, cut, left, right, length.

    train: key, vector. A hash picks a pool of about trees x sample rows and a
    second hash deals them to trees, so a tree gets about ``sample`` rows
    wherever they lie; each tree is grown in its own task.
    """
    n = train.count()
    pool = min(1.0, trees * sample / max(n, 1))
    chance = min(1.0, sample / max(n * pool, 1.0))
    picked = train.where(uniform(key, F.lit(seed)) < pool)
    dealt = picked.withColumn(
        "tree",
        F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: uniform(F.col(key), t, F.lit(seed + 1)) < chance)),
    ).select("tree", key, "vector")
    limit = max(1, math.ceil(math.log2(max(sample, 2))))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        x = np.stack(rows.sort_values(key)["vector"].to_numpy()).astype(np.float64)
        out = pd.DataFrame(_grow(x, np.random.default_rng([seed, tree]), limit), columns=["node", "feature", "cut", "left", "right", "length"])
        out.insert(0, "tree", tree)
        return out

    return dealt.groupBy("tree").applyInPandas(build, "tree int, node int, feature int, cut double, left int, right int, length double")


def isolation_scores(forest: DataFrame, rows: DataFrame, *, key: str = "id", sample: int = 256) -> DataFrame:
    """key, anomaly_prob: sigmoid(10 x (score - 1/2)) of the path-length score.

    The forest has at most trees x 2 x sample nodes whatever the data size.
    """
    nodes = forest.toPandas().sort_values(["tree", "node"])
    tables = [g[["feature", "cut", "left", "right", "length"]].to_numpy() for _, g in nodes.groupby("tree")]
    shared = rows.sparkSession.sparkContext.broadcast(tables)
    scale = float(_leaf_length(float(sample)))

    @F.pandas_udf("double")
    def probability(vectors: pd.Series) -> pd.Series:
        x = np.stack(vectors.to_numpy()).astype(np.float64)
        total = np.zeros(len(x))
        for t in shared.value:
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                inner = np.flatnonzero(t[at, 0] >= 0)
                if not len(inner):
                    break
                here = t[at[inner]]
                goes_left = x[inner, here[:, 0].astype(np.int64)] < here[:, 1]
                at[inner] = np.where(goes_left, here[:, 2], here[:, 3]).astype(np.int64)
            total += t[at, 4]
        score = np.power(2.0, -(total / len(shared.value)) / scale)
        return pd.Series(1.0 / (1.0 + np.exp(-10.0 * (score - 0.5))))

    return rows.select(key, probability("vector").alias("anomaly_prob"))


def isolation_forest(train: DataFrame, score: DataFrame, *, key: str = "id", trees: int = 200, sample: int = 256, seed: int = 42) -> DataFrame:
    return isolation_scores(isolation_trees(train, key=key, trees=trees, sample=sample, seed=seed), score, key=key, sample=sample)


# --------------------------------------------------------------- classifiers


def probability(model, df: DataFrame, *, key: str, keep: Sequence[str] = ()) -> DataFrame:
    return model.transform(df).select(key, *keep, vector_to_array("probability")[1].alias("probability"))


def with_class_weight(df: DataFrame, *, label: str = "label") -> DataFrame:
    """Column ``weight``: positives count neg/pos times."""
    n = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    ratio = n.get(0, 0) / max(n.get(1, 0), 1)
    return df.withColumn("weight", F.when(F.col(label) == 1, float(ratio)).otherwise(1.0))


def boosted_trees(*, rounds: int = 20, depth: int = 5, seed: int = 42) -> GBTClassifier:
    return GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=seed)


def train_ensemble(train: DataFrame, cols: Sequence[str], *, rounds: int = 20, depth: int = 5, seed: int = 42) -> PipelineModel:
    """Boosted trees on the meta features, positives weighted up."""
    stages = [VectorAssembler(inputCols=list(cols), outputCol="features"), boosted_trees(rounds=rounds, depth=depth, seed=seed)]
    return Pipeline(stages=stages).fit(with_class_weight(train))


def feature_importance(model: PipelineModel, cols: Sequence[str], spark) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray().tolist()
    ranked = sorted(zip(cols, values), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame([(i + 1, c, float(x)) for i, (c, x) in enumerate(ranked)], "rank int, feature string, importance double")


def platt_calibrate(validation: DataFrame) -> PipelineModel:
    """Logistic fit of the label on a raw ``probability`` column."""
    stages = [VectorAssembler(inputCols=["probability"], outputCol="_raw"), LogisticRegression(featuresCol="_raw", labelCol="label", probabilityCol="_calibrated", predictionCol="_p", rawPredictionCol="_r")]
    return Pipeline(stages=stages).fit(validation)


def calibrated(model: PipelineModel, df: DataFrame, *, key: str) -> DataFrame:
    out = model.transform(df)
    return out.select(key, F.col("probability").alias("raw_probability"), vector_to_array("_calibrated")[1].alias("probability"))


def train_dense_classifier(rows: DataFrame, *, hidden: Sequence[int] = (32, 16), seed: int = 42, rounds: int = 60):
    """Feed-forward classifier on a ``vector`` array column."""
    width = len(rows.select("vector").first()["vector"])
    net = MultilayerPerceptronClassifier(labelCol="label", featuresCol="features", layers=[width, *hidden, 2], seed=seed, maxIter=rounds)
    return net.fit(rows.withColumn("features", array_to_vector("vector")))


def pair_features(pairs: DataFrame) -> DataFrame:
    """Cosine and absolute difference of the two vectors of a pair."""
    a, b = F.col("vec_a"), F.col("vec_b")
    cos = F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))
    gap = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return pairs.withColumn("features", array_to_vector(F.concat(F.array(cos), gap)))


def pair_similarity_model(pairs: DataFrame):
    return LogisticRegression(labelCol="label", featuresCol="features", maxIter=50, regParam=0.001).fit(pair_features(pairs))


def reconstruction_score(seqs: DataFrame, *, held_out: Column, components: int = 6, class_prob: str | None = None) -> DataFrame:
    """end_id, score: 0.7 x class probability + 0.3 x sigmoid of the standardised reconstruction error.

    Scaling, components, classifier and the error's mean and deviation are learned from rows that are not ``held_out``;
    only held-out rows are scored.
    Windows are flattened and projected on their leading components. With
    orthonormal components the error is |x|^2 - |projection|^2: no inverse
    transform is materialised.
    """
    flat = cut_lineage(seqs.withColumns({"features": array_to_vector(F.flatten("seq")), "_held": held_out}))
    learn = ~F.col("_held")
    prepared = StandardScaler(inputCol="features", outputCol="std", withMean=True, withStd=True).fit(flat.where(learn)).transform(flat)
    projected = PCA(k=components, inputCol="std", outputCol="proj").fit(prepared.where(learn)).transform(prepared)
    x, p = vector_to_array("std"), vector_to_array("proj")
    errors = projected.withColumns({"_x": x, "_p": p}).withColumn("error", (dot(F.col("_x"), F.col("_x")) - dot(F.col("_p"), F.col("_p"))) / F.size("_x"))
    fitted = errors.where(learn).agg(F.avg("error").alias("m"), F.stddev_samp("error").alias("s")).first()
    if class_prob is None:
        lr = LogisticRegression(labelCol="label", featuresCol="std", probabilityCol="_cp", rawPredictionCol="_cr", predictionCol="_cpred", maxIter=30).fit(prepared.where(learn))
        errors = lr.transform(errors).withColumn("_class", vector_to_array("_cp")[1])
    else:
        errors = errors.withColumn("_class", F.col(class_prob))
    recon = sigmoid((F.col("error") - F.lit(fitted["m"])) / F.lit((fitted["s"] or 0.0) + 1e-8))
    return errors.where("_held").select("supplier_id", "end_id", "error", (F.col("_class") * 0.7 + recon * 0.3).alias("score"))


#: 3 x 3 x 3 x 2 settings of the boosted trees.
GRID = {"maxDepth": [2, 3, 5], "stepSize": [0.05, 0.1, 0.3], "subsamplingRate": [0.6, 0.8, 1.0], "minInstancesPerNode": [1, 10]}
#: Share of the training rows and boosting rounds of each rung; a third of the settings goes on.
RUNGS = ((1 / 9, 2), (1 / 3, 6), (1.0, 20))


def hyperparameter_search(
    train: DataFrame, cols: Sequence[str], *, key: str, grid: Mapping[str, Sequence] = GRID, rungs: Sequence[tuple[float, int]] = RUNGS, seed: int = 42, parallelism: int = 8
):
    """Successive halving over the whole grid, by the area under precision-recall: (best settings, results).

    Every setting is tried on a hash sample of the rows with few boosting rounds; the best third goes on to more rows
    and rounds, until the last rung has all rows and all rounds. Samples are nested, so a rung only adds rows. Results have a
    row per setting and rung: rung, rows, rounds, params, auc_pr, kept.
    """
    gbt = boosted_trees(seed=seed)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(gbt.getParam(name), list(values))
    maps, results = builder.build(), []
    evaluator = BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderPR")
    rows = cut_lineage(assemble(with_class_weight(train), cols).select(key, "features", "label", "weight"))
    place = uniform(key, F.lit("rung"), F.lit(seed))
    for rung, (share, rounds) in enumerate(rungs):
        part = rows if share >= 1 else cut_lineage(rows.where((place < share) | ((F.col("label") == 1) & (place < 3 * share))))
        search = TrainValidationSplit(
            estimator=gbt.copy({gbt.maxIter: rounds}), estimatorParamMaps=maps, evaluator=evaluator, trainRatio=0.8, parallelism=parallelism, seed=seed
        )
        scores = search.fit(part).validationMetrics
        ranked = sorted(range(len(maps)), key=lambda i: (-scores[i], i))
        going = set(ranked[: 1 if rung + 1 == len(rungs) else max(1, -(-len(maps) // 3))])
        n = part.count()
        for i in ranked:
            text = ", ".join(f"{p.name}={x}" for p, x in sorted(maps[i].items(), key=lambda e: e[0].name))
            results.append((rung, n, rounds, text, float(scores[i]), i in going))
        maps = [maps[i] for i in ranked if i in going]
    best = {p.name: x for p, x in maps[0].items()}
    return best, train.sparkSession.createDataFrame(results, "rung int, rows long, rounds int, params string, auc_pr double, kept boolean")


def train_with(train: DataFrame, cols: Sequence[str], settings: Mapping[str, float], *, rounds: int = 20, seed: int = 42) -> PipelineModel:
    """``train_ensemble`` with the settings a search found."""
    gbt = boosted_trees(rounds=rounds, seed=seed)
    gbt = gbt.copy({gbt.getParam(name): value for name, value in settings.items()})
    return Pipeline(stages=[VectorAssembler(inputCols=list(cols), outputCol="features"), gbt]).fit(with_class_weight(train))


def cross_validate(df: DataFrame, cols: Sequence[str], *, key: str, n: int = 5, rounds: int = 20, seed: int = 42) -> DataFrame:
    """Mean and deviation of the ensemble's area under ROC over stratified folds: folds, mean_auc, sd_auc."""
    dealt = assemble(with_class_weight(folds(df, key=key, n=n, seed=seed)), cols)
    dealt = cut_lineage(dealt.select("features", "label", "weight", "fold"))
    gbt = boosted_trees(rounds=rounds, seed=seed)
    cv = CrossValidator(
        estimator=gbt, estimatorParamMaps=ParamGridBuilder().build(),
        evaluator=BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC"), numFolds=n, foldCol="fold", parallelism=n, seed=seed,
    ).fit(dealt)
    return df.sparkSession.createDataFrame([(n, float(cv.avgMetrics[0]), float(cv.stdMetrics[0]))], "folds int, mean_auc double, sd_auc double")
