"""Learned queries: fitted on the training split, reported on all rows."""

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from factorwise.operators import evaluation, model_store, models, sampling
from factorwise.plans import views as v
from factorwise.plans.catalog import Catalog
from factorwise.plans.catalog.features import NUMERIC, feature_frame, training_rows, vector_sequences
from factorwise.plans.catalog.scoring import with_graph
from factorwise.operators import scoring
from factorwise.plans.materialise import stage_table

catalog = Catalog()
META = ["dnn", "isolation_forest", "siamese", "graph_carousel", "graph_cascade", "duplicate_risk_score", "match_gap"]


def _train(rows):
    return rows.where("split = 'train'")


def meta_rows(spark, sf):
    """Seven meta features of every invoice, from the real duplicate, match and graph results.

    The label is the planted re-submission, which no feature is drawn from.
    """

    def build():
        scored = with_graph(spark, sf)
        signals = scoring.signals(scored)
        resubmitted = F.col("invoice_id").endswith("-R") | F.col("invoice_id").endswith("-N")
        rows = scored.select(
            "invoice_id", *[signals[n].alias(n) for n in META[:5]], "duplicate_risk_score",
            (F.lit(1.0) - F.col("match_score")).alias("match_gap"), resubmitted.cast("int").alias("label"),
        )
        return sampling.stratified_split(rows, key="invoice_id", fractions={"train": 0.70, "val": 0.15, "test": 0.15})

    return stage_table(spark, "meta_rows", sf, build)


ROUNDS = 20


def ensemble(spark, sf):
    """The one boosted model that scores, is calibrated and is reported on: model, model_id."""
    train = _train(meta_rows(spark, sf))
    return model_store.stored_model(
        "ensemble", train, ["invoice_id", "label", *META], lambda rows: models.train_ensemble(rows, META, rounds=ROUNDS), settings={"rounds": ROUNDS, "depth": 5}
    )


def raw_scores(spark, sf):
    return models.probability(ensemble(spark, sf)[0], meta_rows(spark, sf), key="invoice_id", keep=["label", "split"])


def calibrator(spark, sf):
    """Fitted on the validation rows' scores by the stored ensemble."""
    raw = raw_scores(spark, sf).where("split = 'val'")
    return model_store.stored_model("calibrator", raw, ["invoice_id", "label", "probability"], models.platt_calibrate, settings={"of": ensemble(spark, sf)[1]})


def preparation(spark, sf):
    train = _train(training_rows(spark, sf))
    return model_store.stored_model("preparation", train, ["row_id", *NUMERIC], lambda rows: models.preprocessing(rows, NUMERIC), settings={"variance": models.PCA_VARIANCE})[0]


@catalog.add("robust_scale")
def _(spark, sf):
    rows = training_rows(spark, sf)
    model = models.robust_scaler(_train(rows), NUMERIC)
    return models.apply_preprocessing(model, rows, key="row_id", column="scaled")


@catalog.add("pca_95")
def _(spark, sf):
    return models.explained_variance(preparation(spark, sf), spark)


def components(spark, sf):
    rows = training_rows(spark, sf)
    return models.apply_preprocessing(preparation(spark, sf), rows, key="row_id").join(rows.select("row_id", "label", "split"), "row_id")


@catalog.add("apply_preprocessing")
def _(spark, sf):
    return models.apply_preprocessing(preparation(spark, sf), training_rows(spark, sf), key="row_id")


@catalog.add("isolation_forest")
def _(spark, sf):
    frame = feature_frame(spark, sf)
    inputs = ["amount_log", "match_score", "anomaly_count", "carousel_ring_count", "cascade_depth", "amount_vs_supplier_avg", "invoices_last_7d", "invoices_last_30d"]
    vectors = frame.select(F.col("invoice_id").alias("id"), F.array(*inputs).alias("vector"), "is_exact_duplicate")
    return models.isolation_forest(vectors.where("is_exact_duplicate = 0").select("id", "vector"), vectors.select("id", "vector"), trees=100)


@catalog.add("train_ensemble")
def _(spark, sf):
    return raw_scores(spark, sf)


@catalog.add("platt_calibrate")
def _(spark, sf):
    return models.calibrated(calibrator(spark, sf)[0], raw_scores(spark, sf), key="invoice_id")


@catalog.add("feature_importance")
def _(spark, sf):
    model, model_id = ensemble(spark, sf)
    return models.feature_importance(model, META, spark).withColumn("model_id", F.lit(model_id))


@catalog.add("ensemble_metrics")
def _(spark, sf):
    """Cards of the stored ensemble, of its calibrated scores, and of the untrained rule, on the same test rows."""
    model_id, calibrated_id = ensemble(spark, sf)[1], calibrator(spark, sf)[1]
    raw = raw_scores(spark, sf).where("split = 'test'")
    better = models.calibrated(calibrator(spark, sf)[0], raw, key="invoice_id").join(raw.select("invoice_id", "label"), "invoice_id")
    rule = meta_rows(spark, sf).where("split = 'test'").select("invoice_id", F.col("dnn").alias("probability"), "label")
    cards = [
        evaluation.model_card(scored.select("invoice_id", F.col("probability").alias("score"), "label"), model=name)
        for name, scored in ((model_id, raw), (calibrated_id, better), ("heuristic", rule))
    ]
    return reduce(DataFrame.unionByName, cards)


@catalog.add("model_registry")
def _(spark, sf):
    """Versions this application's models come from."""
    used = [ensemble(spark, sf)[1], calibrator(spark, sf)[1]]
    return model_store.models(spark).where(F.col("model_id").isin(used))


@catalog.add("train_dense_classifier")
def _(spark, sf):
    rows = components(spark, sf)
    model = models.train_dense_classifier(_train(rows))
    prepared = rows.withColumn("features", models.array_to_vector("vector"))
    return models.probability(model, prepared, key="row_id", keep=["label", "split"])


@catalog.add("pair_similarity_model")
def _(spark, sf):
    rows = training_rows(spark, sf)
    pairs = lambda split: sampling.training_pairs(rows.where(F.col("split") == split), key="row_id", features=NUMERIC)
    model = models.pair_similarity_model(stage_table(spark, "pairs", sf, lambda: pairs("train")))
    scored = model.transform(models.pair_features(pairs("test")))  # rows the model never saw
    return scored.select("pair_id", "label", vector_to_array("probability")[1].alias("probability"))


@catalog.add("reconstruction_score")
def _(spark, sf):
    suppliers = F.pmod(F.xxhash64("supplier_id"), F.lit(10))
    return models.reconstruction_score(vector_sequences(spark, sf), held_out=suppliers < 3)


@catalog.add("hyperparameter_search")
def _(spark, sf):
    train = _train(meta_rows(spark, sf))
    best, results = models.hyperparameter_search(train, META, key="invoice_id")
    _, winner = model_store.stored_model(
        "ensemble-searched", train, ["invoice_id", "label", *META], lambda rows: models.train_with(rows, META, best, rounds=ROUNDS), settings={**best, "rounds": ROUNDS}
    )
    return results.withColumn("winner", F.when((F.col("rung") == len(models.RUNGS) - 1) & F.col("kept"), F.lit(winner)))


@catalog.add("cross_validate")
def _(spark, sf):
    return models.cross_validate(meta_rows(spark, sf), META, key="invoice_id", rounds=ROUNDS)
