"""Case pipeline and reporting queries."""

from pyspark.sql import functions as F

from factorwise.operators import cases, retrieval
from factorwise.plans import investigate as inv_plan, views as v
from factorwise.plans.catalog import Catalog
from factorwise.plans.catalog.ingest import typed
from factorwise.plans.catalog.retrieval import _SEARCH, _search
from factorwise.plans.catalog.scoring import _GRAPH, _PHI, _SIGNALS, invoice_signals, with_graph

catalog = Catalog()

@catalog.add(
    "investigate",
    _GRAPH + """,
sig as (select *, round(duplicate_risk_score * 0.5e0, 6) as iso, case when has_carousel then 0.9e0 else 0e0 end as car, round(least(depth / 5e0, 1e0), 6) as cas,
  round(least(anomaly_count / 5e0, 1e0), 6) as ano from found),
tot as (select *, round(least(0e0 + fraud_score * 0.3e0 + iso * 0.15e0 + 0e0 * 0.2e0 + car * 0.15e0 + cas * 0.1e0 + ano * 0.1e0, 1e0), 9) as score from sig)
select invoice_id, round(score, 6) as fraud_score, case when score >= 0.7 then 'HOLD' when score >= 0.3 then 'REVIEW' else 'PASS' end as fraud_decision,
  case when score >= 0.9 then 'critical' when score >= 0.75 then 'high' when score >= 0.5 then 'medium' else 'low' end as severity,
  array_to_string(list_concat(fraud_patterns, list_filter([case when has_carousel then 'carousel_trade' end, case when depth > 0 then 'cascade_amplification' end],
    lambda x: x is not null)), ',') as fraud_patterns, depth as cascade_depth, exposure as cascade_exposure from tot""",
)
def _(spark, sf):
    out = inv_plan.investigate(with_graph(spark, sf), review=0.30, hold=0.70, narrative=False)
    return out.select(
        "invoice_id", F.round("fraud_score", 6).alias("fraud_score"), "fraud_decision", "severity",
        F.array_join("fraud_patterns", ",").alias("fraud_patterns"), "cascade_depth", "cascade_exposure",
    )


@catalog.add("merge_patterns", """select invoice_id, array_to_string(list_concat(fraud_patterns, case when fraud_score >= 0.5 then ['late_stage'] else [] end), ',') as fraud_patterns from scored""")
def _(spark, sf):
    late = F.when(F.col("fraud_score") >= 0.5, F.array(F.lit("late_stage"))).otherwise(F.array().cast("array<string>"))
    stages = v.scored_invoices(spark, sf).select("invoice_id", F.col("fraud_patterns").alias("a"), F.col("fraud_patterns").alias("b"), late.alias("c"))
    return cases.merge_patterns(stages, "a", "b", "c").withColumn("fraud_patterns", F.array_join("fraud_patterns", ","))


@catalog.add(
    "dedupe_citations",
    "with " + _SEARCH.format(where="") + """
select query_id as id, lang as title, source, 'regulation' as category, min(rank) as rank from hit join documents on cast(doc_id as varchar) = id
where rank <= 5 group by 1, 2, 3""",
)
def _(spark, sf):
    docs = v.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("title"), "source", F.lit("regulation").alias("category")
    )
    hits = _search(spark, sf).join(docs, "id").drop("id").withColumnRenamed("query_id", "id")
    return cases.dedupe_citations(hits)


@catalog.add("stage_errors", "select feed_id, array_to_string(reasons, ',') as processing_errors from rejects")
def _(spark, sf):
    checks = {
        "buyer_name": F.col("buyer_name") == "",
        "amount": F.col("amount").isNull() | (F.col("amount") <= 0),
        "invoice_date": F.col("invoice_date").isNull(),
    }
    out = cases.stage_errors(typed(spark, sf).drop("reasons"), checks)
    return out.select("feed_id", F.array_join("processing_errors", ",").alias("processing_errors"))


def _stored_cases(spark, sf):
    """Cases as an earlier run left them: another severity, analyst fields set."""
    old = v.fraud_cases(spark, sf).where(F.col("created_at") < "1999-01-01")
    return old.withColumns(
        {"severity": F.lit("low"), "analyst_decision": F.lit("confirmed"), "analyst_notes": F.concat(F.lit("seen "), "invoice_id")}
    )


@catalog.add(
    "upsert_cases",
    """select case_id, case_number, invoice_id, decision, severity, fraud_score, case when created_at < timestamp '1999-01-01' then 'confirmed' end as analyst_decision,
  case when created_at < timestamp '1999-01-01' then 'seen ' || invoice_id end as analyst_notes from cases""",
)
def _(spark, sf):
    merged = cases.upsert_cases(_stored_cases(spark, sf), v.fraud_cases(spark, sf))
    return merged.select("case_id", "case_number", "invoice_id", "decision", "severity", "fraud_score", "analyst_decision", "analyst_notes")


@catalog.add("case_numbers", "select case_id, case_number from cases")
def _(spark, sf):
    return cases.case_numbers(v.fraud_cases(spark, sf).drop("case_number")).select("case_id", "case_number")


@catalog.add(
    "format_alerts",
    """select invoice_id, severity, case severity when 'low' then 'bg-green-100 text-green-800' when 'medium' then 'bg-yellow-100 text-yellow-800'
  when 'high' then 'bg-orange-100 text-orange-800' else 'bg-red-100 text-red-800' end as badge_color, fraud_decision as decision_label,
  cast(round(cast(fraud_score as decimal(18,6)) * 100, 1) as decimal(18,1)) || '%' as score_display, coalesce(fraud_patterns[1], 'UNKNOWN') as primary_signal,
  '' as cascade_warning, '' as top_regulations, case fraud_decision when 'HOLD' then 'HOLD financing pending review'
  when 'REVIEW' then 'REVIEW evidence and request additional documentation' else 'No action required' end as recommended_action from scored""",
)
def _(spark, sf):
    return cases.format_alerts(v.scored_invoices(spark, sf)).withColumn("top_regulations", F.array_join("top_regulations", ","))


def evidence(spark, sf):
    """Flagged invoices with graph findings and signal names."""
    named = inv_plan.top_signal_names(invoice_signals(spark, sf))
    flagged = with_graph(spark, sf).where(F.col("fraud_decision") != "PASS")
    return flagged.join(named, "invoice_id").withColumn("semantic_similarity", F.lit(0.0))


_EVIDENCE = _GRAPH + ",\n" + _SIGNALS.strip() + ",\n" + _PHI.strip() + """,
tops as (select invoice_id, string_agg(feature, ', ' order by rank) as top_signals from (
  select *, row_number() over (partition by invoice_id order by abs(contribution) desc, feature) as rank from phi) where rank <= 3 group by 1),
ev as (select * from found join tops using (invoice_id) where fraud_decision <> 'PASS')"""
_PCT = "cast(round(cast({} as decimal(18,6)) * 100, 2) as decimal(18,2)) || '%'"


@catalog.add(
    "signal_summary",
    _EVIDENCE + f"""
select invoice_id, concat('Invoice: ', invoice_number, ' | Amount: INR ', format('{{:,.2f}}', amount::double), chr(10), 'Supplier: ', supplier_name, ' -> Buyer: ', buyer_name, chr(10),
  'Fraud Score: ', {_PCT.format('fraud_score')}, ' | Decision: ', fraud_decision, chr(10), 'Top Signals: ', top_signals, chr(10), 'Duplicate Risk: 0.00%', chr(10),
  'Graph: Carousel=', case when has_carousel then 'YES' else 'NO' end, ' | Cascade Depth=', depth, chr(10), 'Cascade Exposure: INR ', format('{{:,.2f}}', exposure), chr(10),
  'Match Score: ', {_PCT.format('match_score')}) as summary from ev""",
)
def _(spark, sf):
    return cases.signal_summary(evidence(spark, sf))


@catalog.add(
    "fallback_narrative",
    _EVIDENCE + """
select invoice_id, concat('Invoice `', invoice_number, '` for INR ', format('{:,.2f}', amount::double), ' was flagged for ', fraud_decision, '. The strongest signals were: ', top_signals, '.',
  chr(10), chr(10), 'Duplicate similarity reached 0.00%, and the graph analysis found carousel=', case when has_carousel then 'True' else 'False' end,
  ' with cascade depth=', depth, '.', chr(10), chr(10), 'No regulatory citation is attached: the narrative was generated from the score evidence alone.') as narrative from ev""",
)
def _(spark, sf):
    return cases.fallback_narrative(evidence(spark, sf))


_LIST = "'[' || array_to_string(list_transform(fraud_patterns, lambda p: '''' || p || ''''), ', ') || ']'"


@catalog.add(
    "sar_draft",
    f"""select case_id, concat('Suspicious Activity Report (draft)', chr(10), '- Case: ', case_number, chr(10), '- Invoice: ', invoice_id, chr(10), '- Decision: ', decision, chr(10),
  '- Severity: ', severity, chr(10), '- Detected patterns: ', {_LIST}, chr(10), chr(10), 'Summary narrative:', chr(10), alert_narrative, chr(10), chr(10), 'Recommended action: ',
  case decision when 'HOLD' then 'HOLD financing pending enhanced due diligence' else 'REVIEW evidence and request supporting documents' end, chr(10)) as sar_draft from cases""",
)
def _(spark, sf):
    return cases.sar_draft(v.fraud_cases(spark, sf))


def _updates(spark, sf):
    """A decision for every held invoice; the passed invoices' ids do not exist as cases."""
    scored = v.scored_invoices(spark, sf).where(F.col("fraud_decision") != "REVIEW")
    return scored.select(
        F.sha2(F.concat(F.lit("case|"), "invoice_id"), 256).alias("case_id"), F.lit("confirmed_fraud").alias("decision"),
        F.when(F.col("severity") != "critical", "checked").alias("notes"),
    )


@catalog.add(
    "analyst_updates",
    """select case_id, case when decision = 'HOLD' then 'confirmed_fraud' when created_at < timestamp '1999-01-01' then 'confirmed' end as analyst_decision,
  case when decision = 'HOLD' and severity <> 'critical' then 'checked' when created_at < timestamp '1999-01-01' then 'seen ' || invoice_id end as analyst_notes from cases""",
)
def _(spark, sf):
    merged = cases.upsert_cases(_stored_cases(spark, sf), v.fraud_cases(spark, sf))
    return cases.analyst_updates(merged, _updates(spark, sf))[0].select("case_id", "analyst_decision", "analyst_notes")


@catalog.add("analyst_updates_unknown", "select sha256('case|' || invoice_id) as case_id from scored where fraud_decision = 'PASS'")
def _(spark, sf):
    return cases.analyst_updates(v.fraud_cases(spark, sf), _updates(spark, sf))[1]


@catalog.add(
    "audit_log",
    """select 'fraud_case_created' as event_type, case_id, invoice_id, 'system' as actor, decision from cases where created_at >= timestamp '1999-01-01'
union all select 'fraud_case_updated', case_id, invoice_id, 'system', decision from cases where created_at < timestamp '1999-01-01' and severity <> 'low'
union all select 'analyst_decision_updated', case_id, invoice_id, 'analyst', 'confirmed_fraud' from cases where decision = 'HOLD'""",
)
def _(spark, sf):
    old = _stored_cases(spark, sf)
    new, _ = cases.analyst_updates(cases.upsert_cases(old, v.fraud_cases(spark, sf)), _updates(spark, sf))
    return cases.audit_log(old, new)


@catalog.add(
    "case_documents",
    f"""select case_id as id, 'Fraud Case ' || case_number as title, 'fraud_case:' || case_id as source, 'fraud_case' as category,
  concat('Case Number: ', case_number, chr(10), 'Invoice ID: ', invoice_id, chr(10), 'Decision: ', decision, chr(10), 'Severity: ', severity, chr(10),
  'Fraud Score: ', printf('%.6f', fraud_score), chr(10), 'Primary Signal: ', primary_signal, chr(10), 'Fraud Patterns: ', {_LIST}, chr(10), 'Alert Narrative: ', chr(10),
  'Analyst Decision: ', chr(10), 'Analyst Notes: ', chr(10)) as content from cases""",
)
def _(spark, sf):
    return cases.case_documents(v.fraud_cases(spark, sf))


@catalog.add("index_cases")
def _(spark, sf):
    docs = cases.case_documents(v.fraud_cases(spark, sf)).select(F.col("id").alias("doc_id"), F.col("content").alias("text"))
    return retrieval.chunk_index(retrieval.chunk_documents(docs), namespace="fraud_cases")


_NUMBERED = """numbered as (select *, 'CASE-' || upper(invoice_number) || case when pos > 1 then '-' || pos else '' end as case_number from (
  select *, row_number() over (partition by invoice_number order by substr(md5(invoice_id), 1, 3), invoice_id) as pos from {source}))"""


@catalog.add(
    "backfill_cases",
    "with todo as (select * from flagged where fraud_decision <> 'HOLD'),\n" + _NUMBERED.format(source="todo") + f"""
select invoice_id, case_number, fraud_decision as decision, fraud_score, 'medium' as severity, coalesce(fraud_patterns[1], 'velocity_anomaly') as primary_signal,
  round(fraud_score * 0.95e0, 3) as score_xgboost, round(fraud_score * 0.88e0, 3) as score_isolation_forest, round(fraud_score * 0.72e0, 3) as score_siamese,
  round(fraud_score * 0.65e0, 3) as score_lsh, array_to_string(list_transform(fraud_patterns, lambda p: p || '=' || cast(round(fraud_score / greatest(len(fraud_patterns), 1), 3) as varchar)), ',') as attribution,
  concat('Invoice ', invoice_number, ' for INR ', format('{{:,.2f}}', amount::double), ' was flagged with decision ', fraud_decision, '. Primary signal: ',
  coalesce(fraud_patterns[1], 'velocity_anomaly'), '. Fraud score: ', {_PCT.format('fraud_score')}, '. Patterns detected: ',
  case when len(fraud_patterns) > 0 then array_to_string(fraud_patterns, ', ') else 'anomaly' end, '.') as alert_narrative, false as is_confirmed_fraud from numbered""",
)
def _(spark, sf):
    scored = v.scored_invoices(spark, sf)
    held = v.fraud_cases(spark, sf).where(F.col("decision") == "HOLD")
    out = cases.backfill_cases(scored.where(F.col("fraud_decision") != "PASS"), held)
    return out.withColumn("attribution", F.array_join("attribution", ","))


@catalog.add("dedupe_case_numbers", "with " + _NUMBERED.format(source="flagged") + " select invoice_id, case_number from numbered")
def _(spark, sf):
    return cases.dedupe_case_numbers(v.scored_invoices(spark, sf).where(F.col("fraud_decision") != "PASS"))
