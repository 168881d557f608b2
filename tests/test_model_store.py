"""Stored models: fitted once, reloaded alike, renewed with their rows; and the search over settings."""

import pytest
from pyspark.sql import functions as F

from factorwise.operators import model_store, models

COLS = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    u = lambda i: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000.0
    df = spark.range(600).select("id", u(1).alias("a"), u(2).alias("b"))
    return df.withColumn("label", (F.col("a") + F.col("b") > 1.3).cast("int"))


def test_reloaded_model_is_the_same(spark, rows, tmp_path):
    fits = []

    def fit(train):
        fits.append(1)
        return models.train_ensemble(train, COLS, rounds=3)

    store = lambda r, rounds=3: model_store.stored_model("m", r, ["id", "label", *COLS], fit, settings={"rounds": rounds}, root=str(tmp_path))
    model, model_id = store(rows)
    again, same_id = store(rows.repartition(5).select("b", "label", "id", "a"))
    assert model_id == same_id and len(fits) == 1
    scores = lambda m: {r.id: r.probability for r in models.probability(m, rows, key="id").collect()}
    assert scores(model) == scores(again) == scores(models.train_ensemble(rows, COLS, rounds=3))
    other = {store(rows.where("id > 0"))[1], store(rows, 4)[1], store(rows.withColumn("a", F.col("a") + (F.col("id") == 5).cast("int")))[1]}
    assert len(other | {model_id}) == 4 and len(fits) == 4
    kept = {r.model_id: (r.name, r.rows) for r in model_store.models(spark, root=str(tmp_path)).collect()}
    assert set(kept) == other | {model_id} and kept[model_id] == ("m", 600)


def test_unfinished_save_is_done_again(spark, rows, tmp_path):
    fit = lambda r: models.preprocessing(r, COLS)
    tag, _ = model_store.content_tag(rows, ["id", *COLS], {"model": "p"})
    (tmp_path / "p" / tag / "model").mkdir(parents=True)
    model, model_id = model_store.stored_model("p", rows, ["id", *COLS], fit, root=str(tmp_path))
    assert model_id == f"p-{tag}" and model_store.models(spark, root=str(tmp_path)).count() == 1
    assert models.explained_variance(model, spark).count() == len(models.apply_preprocessing(model, rows, key="id").first()["vector"])


def test_successive_halving(spark, rows):
    grid = {"maxDepth": [1, 3], "stepSize": [0.05, 0.3], "minInstancesPerNode": [1, 300]}
    best, results = models.hyperparameter_search(rows, COLS, key="id", grid=grid, rungs=((0.3, 1), (1.0, 3)))
    got = results.collect()
    assert [sum(r.rung == k for r in got) for k in (0, 1)] == [8, 3] and [sum(r.kept for r in got if r.rung == k) for k in (0, 1)] == [3, 1]
    last = [r for r in got if r.rung == 1]
    assert max(last, key=lambda r: r.auc_pr).kept and {r.rows for r in last} == {600} and {r.params for r in last} == {r.params for r in got if r.rung == 0 and r.kept}
    assert best["minInstancesPerNode"] == 1  # no leaf of 300 rows can part 600 well
    assert models.train_with(rows, COLS, best, rounds=2).stages[-1].getNumTrees == 2
