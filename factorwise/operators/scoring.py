"""Scores, decisions and attribution. All plain column arithmetic."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from factorwise.functions.vectors import cosine

# Weights, cuts and names of the signals.
HEURISTIC_WEIGHTS = {"duplicate": 0.5, "mismatch": 0.3, "exact": 0.4}
ENSEMBLE_WEIGHTS = {
    "dnn": 0.3,
    "isolation_forest": 0.15,
    "siamese": 0.2,
    "graph_carousel": 0.15,
    "graph_cascade": 0.1,
    "match_anomaly": 0.1,
}
ENSEMBLE_WEIGHTS_5 = {
    "dnn": 0.35,
    "isolation_forest": 0.20,
    "siamese": 0.20,
    "graph_carousel": 0.15,
    "graph_cascade": 0.10,
}
REVIEW_CUT, HOLD_CUT = 0.70, 0.85
SEVERITIES = (("critical", 0.9), ("high", 0.75), ("medium", 0.5))
LOWEST_SEVERITY = "low"
VELOCITY_PATTERN = "velocity_anomaly"
VELOCITY_CUT = 0.7
DIGITS = 6


def heuristic(duplicate: Column, match: Column, exact: Column) -> Column:
    """A missing match score counts as 1; a score of 0 stays 0."""
    w = HEURISTIC_WEIGHTS
    raw = (
        F.coalesce(duplicate, F.lit(0.0)) * w["duplicate"]
        + (F.lit(1.0) - F.coalesce(match, F.lit(1.0))) * w["mismatch"]
        + F.when(exact, F.lit(w["exact"])).otherwise(F.lit(0.0))
    )
    return F.round(F.least(raw, F.lit(1.0)), DIGITS)


def decision(score: Column, *, review: float = REVIEW_CUT, hold: float = HOLD_CUT) -> Column:
    return F.when(score >= hold, "HOLD").when(score >= review, "REVIEW").otherwise("PASS")


def severity_of(score: Column) -> Column:
    out = F.lit(LOWEST_SEVERITY)
    for name, cut in reversed(SEVERITIES):
        out = F.when(score >= cut, F.lit(name)).otherwise(out)
    return out


def heuristic_score(inv: DataFrame) -> DataFrame:
    value = heuristic(F.col("duplicate_risk_score"), F.col("match_score"), F.col("is_exact_duplicate"))
    return inv.select("invoice_id", value.alias("value"))


def signals(inv: DataFrame) -> dict[str, Column]:
    """The six signals of an invoice; model scores replace the stand-ins when present."""
    duplicate = F.coalesce("duplicate_risk_score", F.lit(0.0))

    def given(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in inv.columns else default

    return {
        "dnn": given("dnn_prob", heuristic(duplicate, F.col("match_score"), F.col("is_exact_duplicate"))),
        "isolation_forest": given("anomaly_prob", duplicate * 0.5),
        "siamese": given("semantic_similarity", F.lit(0.0)),
        "graph_carousel": F.when(given("has_carousel", F.lit(False)), 0.9).otherwise(0.0),
        "graph_cascade": F.least(given("cascade_depth", F.lit(0)) / F.lit(5.0), F.lit(1.0)),
        "match_anomaly": F.least(F.coalesce("anomaly_count", F.lit(0)) / F.lit(5.0), F.lit(1.0)),
    }


def signal_scores(inv: DataFrame) -> DataFrame:
    """One column per signal, keyed by invoice."""
    return inv.select("invoice_id", *[F.round(c, DIGITS).alias(n) for n, c in signals(inv).items()])


def weighted(scores: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    total = reduce(lambda s, n: s + scores[n] * weights[n], weights, F.lit(0.0))
    return F.round(F.least(total, F.lit(1.0)), 9)


def ensemble_score(scores: DataFrame, *, weights: Mapping[str, float] = ENSEMBLE_WEIGHTS) -> DataFrame:
    return scores.select("invoice_id", weighted({n: F.col(n) for n in weights}, weights).alias("value"))


def fraud_decision(scored: DataFrame, *, review: float = REVIEW_CUT, hold: float = HOLD_CUT) -> DataFrame:
    return scored.select("invoice_id", decision(F.col("value"), review=review, hold=hold).alias("value"))


def severity(scored: DataFrame) -> DataFrame:
    return scored.select("invoice_id", severity_of(F.col("value")).alias("value"))


def contributions(scores: DataFrame, *, weights: Mapping[str, float] = ENSEMBLE_WEIGHTS) -> DataFrame:
    """invoice_id, feature, contribution: weight x (signal - mean signal), exact for a weighted sum."""
    means = scores.agg(F.struct(*[F.avg(n).alias(n) for n in weights]).alias("m")).scalar()
    parts = [
        F.struct(F.lit(n).alias("feature"), ((F.col(n) - means[n]) * w).alias("contribution"))
        for n, w in weights.items()
    ]
    return scores.select("invoice_id", F.explode(F.array(*parts)).alias("p")).select("invoice_id", "p.*")


def top_attributions(scores: DataFrame, *, weights: Mapping[str, float] = ENSEMBLE_WEIGHTS, n: int = 5) -> DataFrame:
    """The n largest contributions by absolute value, ties by name.

    A row has few signals, so they are ranked inside the row: no shuffle.
    """
    means = scores.agg(F.struct(*[F.avg(c).alias(c) for c in weights]).alias("m")).scalar()
    parts = [
        F.struct(
            (-F.abs(F.round((F.col(c) - means[c]) * w, DIGITS))).alias("key"),
            F.lit(c).alias("feature"),
            F.round((F.col(c) - means[c]) * w, DIGITS).alias("contribution"),
        )
        for c, w in weights.items()
    ]
    ranked = scores.select("invoice_id", F.posexplode(F.slice(F.sort_array(F.array(*parts)), 1, n)).alias("pos", "p"))
    return ranked.select("invoice_id", "p.feature", "p.contribution", (F.col("pos") + 1).alias("rank"))


def mean_abs_attribution(attributions: DataFrame) -> DataFrame:
    return attributions.groupBy("feature").agg(F.round(F.avg(F.abs("contribution")), DIGITS).alias("mean_abs"))


def velocity_flag(scores: DataFrame, *, cut: float = VELOCITY_CUT) -> DataFrame:
    return scores.where(F.col("isolation_forest") > cut).select("invoice_id", F.lit(VELOCITY_PATTERN).alias("pattern"))


def reference_similarity(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Cosine of each vector to the mean vector of a reference set (id, vector)."""
    mean = (
        reference.select(F.posexplode("vector").alias("i", "x"))
        .groupBy("i")
        .agg(F.avg(F.col("x").cast("double")).alias("m"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("mean"))
    )  # one value per dimension
    placed = df.select("id", "vector", mean.scalar().alias("_mean"))
    return placed.select("id", F.round(cosine(F.col("vector"), F.col("_mean")), DIGITS).alias("similarity"))
