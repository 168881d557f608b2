"""Scoring and attribution queries over scored invoices with their graph findings."""

from pyspark.sql import functions as F

from factorwise.operators import scoring
from factorwise.plans import views as v
from factorwise.plans.catalog import Catalog
from factorwise.plans.catalog.graph import findings

catalog = Catalog()


def with_graph(spark, sf):
    return v.scored_invoices(spark, sf).join(findings(spark, sf), "invoice_id", "left")


def invoice_signals(spark, sf):
    """Signals of the stored invoices with their graph findings."""
    return scoring.signal_scores(with_graph(spark, sf))


_GRAPH = """with
found as (select s.*, m.company is not null as has_carousel, coalesce(c.cascade_depth, 0) as depth, coalesce(c.exposure, 0) as exposure
  from scored s join rooted r on r.invoice_id = s.invoice_id left join ring_day m on m.day = r.invoice_date and m.company = r.company
  left join cascade c on c.invoice_id = s.invoice_id)"""
_SIGNALS = """
signal as (select invoice_id, fraud_score as dnn, round(duplicate_risk_score * 0.5e0, 6) as isolation_forest, 0e0 as siamese,
  case when has_carousel then 0.9e0 else 0e0 end as graph_carousel, round(least(depth / 5e0, 1e0), 6) as graph_cascade,
  round(least(anomaly_count / 5e0, 1e0), 6) as match_anomaly from found),
ens as (select *, round(least(0e0 + dnn * 0.3e0 + isolation_forest * 0.15e0 + siamese * 0.2e0 + graph_carousel * 0.15e0 + graph_cascade * 0.1e0
  + match_anomaly * 0.1e0, 1e0), 9) as value from signal)"""
W = _GRAPH + ",\n" + _SIGNALS.strip()


@catalog.add("heuristic_score", "select invoice_id, fraud_score as value from scored")
def _(spark, sf):
    return scoring.heuristic_score(v.scored_invoices(spark, sf))


@catalog.add("signal_scores", W + " select * from signal")
def _(spark, sf):
    return invoice_signals(spark, sf)


@catalog.add("ensemble_score", W + " select invoice_id, value from ens")
def _(spark, sf):
    return scoring.ensemble_score(invoice_signals(spark, sf))


@catalog.add(
    "ensemble_score_5",
    W + """ select invoice_id, round(least(0e0 + dnn * 0.35e0 + isolation_forest * 0.2e0 + siamese * 0.2e0 + graph_carousel * 0.15e0
  + graph_cascade * 0.1e0, 1e0), 9) as value from signal""",
)
def _(spark, sf):
    return scoring.ensemble_score(invoice_signals(spark, sf), weights=scoring.ENSEMBLE_WEIGHTS_5)


@catalog.add(
    "fraud_decision",
    "select invoice_id, case when fraud_score >= 0.85 then 'HOLD' when fraud_score >= 0.7 then 'REVIEW' else 'PASS' end as value from scored",
)
def _(spark, sf):
    return scoring.fraud_decision(scoring.heuristic_score(v.scored_invoices(spark, sf)))


@catalog.add("severity", "select invoice_id, severity as value from scored")
def _(spark, sf):
    return scoring.severity(scoring.heuristic_score(v.scored_invoices(spark, sf)))


_PHI = """
phi as (select invoice_id, feature, round((x - avg(x) over (partition by feature)) * w, 6) as contribution from (
  select invoice_id, 'dnn' as feature, dnn as x, 0.3e0 as w from signal union all select invoice_id, 'isolation_forest', isolation_forest, 0.15e0 from signal
  union all select invoice_id, 'siamese', siamese, 0.2e0 from signal union all select invoice_id, 'graph_carousel', graph_carousel, 0.15e0 from signal
  union all select invoice_id, 'graph_cascade', graph_cascade, 0.1e0 from signal union all select invoice_id, 'match_anomaly', match_anomaly, 0.1e0 from signal))"""


@catalog.add(
    "top_attributions",
    W + ",\n" + _PHI.strip() + """ select invoice_id, feature, contribution, rank from (
  select *, row_number() over (partition by invoice_id order by abs(contribution) desc, feature) as rank from phi) where rank <= 5""",
)
def _(spark, sf):
    return scoring.top_attributions(invoice_signals(spark, sf))


@catalog.add("mean_abs_attribution", W + ",\n" + _PHI.strip() + " select feature, round(avg(abs(contribution)), 6) as mean_abs from phi group by 1")
def _(spark, sf):
    signals = invoice_signals(spark, sf)
    every = scoring.contributions(signals).withColumn("contribution", F.round("contribution", 6))
    return scoring.mean_abs_attribution(every)


@catalog.add("velocity_flag", W + " select invoice_id, 'velocity_anomaly' as pattern from signal where isolation_forest > 0.45")
def _(spark, sf):
    return scoring.velocity_flag(invoice_signals(spark, sf), cut=0.45)


@catalog.add(
    "reference_similarity",
    """with m as (select i, avg(x) as m from (select unnest(vector::double[]) as x, unnest(range(len(vector))) as i from vec where label = 0) group by 1),
mean as (select list(m order by i) as mean from m)
select id, round(list_cosine_similarity(vector::double[], mean), 6) as similarity from vec, mean""",
)
def _(spark, sf):
    vectors = v.vectors(spark, sf)
    return scoring.reference_similarity(vectors, vectors.where(F.col("label") == 0))
