"""Evaluation queries."""

from pyspark.sql import functions as F

from factorwise.operators import evaluation as ev
from factorwise.plans import views as v
from factorwise.plans.catalog import Catalog

catalog = Catalog()

_SWEEP = """
with cut as (select t, t / 100.0::double as threshold from range(5, 95) r(t)),
counted as (select round(threshold, 2) as threshold, count(*) filter (where round(score * 1000) >= t * 10 and label = 1) as tp,
  count(*) filter (where round(score * 1000) >= t * 10 and label = 0) as fp, count(*) filter (where round(score * 1000) < t * 10 and label = 1) as fn
  from cut, sl group by 1)"""
_F1 = "round(coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0), 6)"


@catalog.add("threshold_sweep", _SWEEP + f" select threshold, tp, fp, fn, {_F1} as f1 from counted")
def _(spark, sf):
    return ev.threshold_sweep(v.scored_labels(spark, sf))


@catalog.add("best_threshold", _SWEEP + f" select threshold, {_F1} as f1 from counted order by f1 desc, threshold limit 1")
def _(spark, sf):
    return ev.best_threshold(ev.threshold_sweep(v.scored_labels(spark, sf)))


_C = """select count(*) filter (where score >= 0.5::double and label = 1) as tp, count(*) filter (where score >= 0.5::double and label = 0) as fp,
  count(*) filter (where score < 0.5::double and label = 1) as fn, count(*) filter (where score < 0.5::double and label = 0) as tn,
  avg((score - label) * (score - label)) as b from sl"""


@catalog.add(
    "classification_metrics",
    f"""select round(tp / (tp + fp)::double, 6) as precision, round(tp / (tp + fn)::double, 6) as recall, {_F1} as f1, round(b, 6) as brier,
  round((tp + tn) / (tp + tn + fp + fn)::double, 6) as accuracy, round(tn / (tn + fp)::double, 6) as accuracy_clean,
  round(tp / (tp + fn)::double, 6) as accuracy_fraud from ({_C})""",
)
def _(spark, sf):
    return ev.classification_metrics(v.scored_labels(spark, sf))


@catalog.add(
    "auc_roc",
    """with ranked as (select label, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0::double as r from sl)
select round((sum(r) filter (where label = 1) - sum(label) * (sum(label) + 1) / 2.0::double) / (sum(label) * sum(1 - label))::double, 6) as auc_roc from ranked""",
)
def _(spark, sf):
    return ev.auc_roc(v.scored_labels(spark, sf))


@catalog.add(
    "auc_pr",
    """with s as (select score, sum(label) as pos, count(*) as n from sl group by 1),
c as (select pos, sum(pos) over (order by score desc) / (sum(n) over (order by score desc))::double as p from s)
select round(sum(pos * p) / sum(pos), 6) as auc_pr from c""",
)
def _(spark, sf):
    return ev.auc_pr(v.scored_labels(spark, sf))


@catalog.add("confusion_matrix", "select label, (score >= 0.5::double)::int as predicted, count(*) as n from sl group by 1, 2")
def _(spark, sf):
    return ev.confusion_matrix(v.scored_labels(spark, sf))


@catalog.add(
    "calibration_curve",
    """select least(floor(score * 10 + 1e-9::double), 9)::bigint as bin, round(avg(score), 6) as mean_predicted,
  round(avg(label), 6) as fraction_positive, count(*) as n from sl group by 1""",
)
def _(spark, sf):
    return ev.calibration_curve(v.scored_labels(spark, sf))


@catalog.add(
    "tier_metrics",
    f"""select threshold, {_F1} as f1, round(coalesce(tp / nullif(tp + fn, 0)::double, 0), 6) as recall,
  round(coalesce(tp / nullif(tp + fp, 0)::double, 0), 6) as precision
from (select t as threshold, count(*) filter (where score >= t and label = 1) as tp, count(*) filter (where score >= t and label = 0) as fp,
  count(*) filter (where score < t and label = 1) as fn from sl, (select unnest([0.3::double, 0.7::double, 0.85::double]) as t) group by 1)""",
)
def _(spark, sf):
    return ev.tier_metrics(v.scored_labels(spark, sf))


@catalog.add(
    "signal_correlation",
    """select 'score' as feature, round(corr(score, label), 6) as correlation from sl
union all select 'quality', round(corr(quality, label), 6) from sl union all select 'n_chars', round(corr(n_chars, label), 6) from sl""",
)
def _(spark, sf):
    return ev.signal_correlation(v.scored_labels(spark, sf), ["score", "quality", "n_chars"])


@catalog.add(
    "latency_percentiles",
    """select event_type, count(*) as n, round(avg(value), 4) as mean, round(quantile_cont(value, 0.5), 4) as p50, round(quantile_cont(value, 0.9), 4) as p90,
  round(quantile_cont(value, 0.99), 4) as p99, round(sum(value), 2) as total, quantile_cont(value, 0.99) < 3000 as within_sla from events group by 1""",
)
def _(spark, sf):
    return ev.latency_percentiles(v.table(spark, sf, "events"), value="value", group=["event_type"])


@catalog.add("model_card")
def _(spark, sf):
    return ev.model_card(v.scored_labels(spark, sf), model="length_score")
