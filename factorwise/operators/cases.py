"""Fraud cases: creation, numbering, alerts, reports, analyst updates, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factorwise.functions.text import money_text, percent
from factorwise.operators.scoring import severity_of
from factorwise.plans.ordered import hash_slice, number_rows

# Display texts and score tables by decision, severity or pattern.
CASE_ACTIONS = {
    "HOLD": "HOLD financing pending enhanced due diligence",
    "REVIEW": "REVIEW evidence and request supporting documents",
    "PASS": "PASS financing request without additional action",
}
CASE_ACTION_OTHER = "REVIEW evidence"
ALERT_ACTIONS = {
    "HOLD": "HOLD financing pending review",
    "REVIEW": "REVIEW evidence and request additional documentation",
    "PASS": "No action required",
}
ALERT_ACTION_OTHER = "REVIEW"
BADGES = {
    "low": "bg-green-100 text-green-800",
    "medium": "bg-yellow-100 text-yellow-800",
    "high": "bg-orange-100 text-orange-800",
    "critical": "bg-red-100 text-red-800",
}
BADGE_OTHER = "bg-gray-100 text-gray-800"
DECISION_SEVERITY = {"HOLD": "critical", "REVIEW": "medium", "PASS": "low"}
PATTERN_SCORES = {
    "duplicate_financing": 0.91,
    "phantom_invoice": 0.88,
    "carousel_trade": 0.93,
    "cascade_amplification": 0.85,
    "velocity_anomaly": 0.82,
}
PATTERN_SCORE_OTHER = 0.75
DERIVED_SCORES = {"xgboost": 0.95, "isolation_forest": 0.88, "siamese": 0.72, "lsh": 0.65}
CASCADE_WARNING = "Cascade risk detected"
UNKNOWN_SIGNAL = "UNKNOWN"


def mapped(key: Column, table: dict, other) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def primary_signal(patterns: Column) -> Column:
    return F.coalesce(F.get(patterns, F.lit(0)), F.lit(UNKNOWN_SIGNAL))


def case_numbers(cases: DataFrame, *, stored: DataFrame | None = None) -> DataFrame:
    """``SCF-<year>-<6 digits>``, numbered per year by creation date, after the highest number ``stored`` has for the year.

    A year is far too large for one window partition: numbers are counted per
    day and key slice and then offset.
    """
    keyed = cases.withColumns(
        {"_year": F.year("created_at"), "_day": F.to_date("created_at"), "_hash": hash_slice("invoice_id")}
    )
    numbered = number_rows(keyed, group=["_year"], split=["_day", "_hash"], order=["invoice_id"])
    taken = F.lit(0)
    if stored is not None:
        parts = F.split("case_number", "-")
        highest = stored.select(parts[1].cast("int").alias("_year"), parts[2].cast("long").alias("_n")).groupBy("_year").agg(F.max("_n").alias("_taken"))
        numbered, taken = numbered.join(highest, "_year", "left"), F.coalesce("_taken", F.lit(0))
    return numbered.withColumn(
        "case_number", F.format_string("SCF-%d-%06d", F.col("_year"), F.col("position") + taken)
    ).drop("_year", "_day", "_hash", "position", "_taken")


def open_cases(scored: DataFrame, *, narrative: Column | None = None, stored: DataFrame | None = None) -> DataFrame:
    """Case rows of scored invoices; one per invoice, numbered after ``stored`` cases."""
    rows = scored.select(
        F.sha2(F.concat(F.lit("case|"), "invoice_id"), 256).alias("case_id"),
        "invoice_id",
        "invoice_number",
        "amount",
        "lender_id",
        "fraud_patterns",
        "fraud_score",
        F.col("fraud_decision").alias("decision"),
        severity_of(F.col("fraud_score")).alias("severity"),
        primary_signal(F.col("fraud_patterns")).alias("primary_signal"),
        (narrative if narrative is not None else F.lit("")).alias("alert_narrative"),
        F.col("invoice_date").cast("timestamp_ntz").alias("created_at"),
        F.lit(None).cast("string").alias("analyst_decision"),
        F.lit(None).cast("string").alias("analyst_notes"),
    )
    return case_numbers(rows, stored=stored)


def upsert_cases(existing: DataFrame, new: DataFrame) -> DataFrame:
    """One case per invoice: new results win, id, number and analyst fields of a known case stay.

    Invoices without a case yet are numbered after the highest stored number of their year.
    """
    unseen = case_numbers(new.drop("case_number").join(existing.select("invoice_id"), "invoice_id", "left_anti"), stored=existing)
    new = new.drop("case_number").join(unseen.select("invoice_id", "case_number"), "invoice_id", "left")
    kept = ["case_id", "case_number", "created_at"]
    analyst = ["analyst_decision", "analyst_notes"]
    old = existing.select("invoice_id", *[F.col(c).alias(f"_old_{c}") for c in existing.columns if c != "invoice_id"])
    joined = new.join(old, "invoice_id", "full")
    fresh = F.col("case_id").isNotNull()
    out = []
    for c in existing.columns:
        if c == "invoice_id":
            out.append(F.col(c))
        elif c in kept:
            out.append(F.coalesce(f"_old_{c}", c).alias(c))
        elif c in analyst:
            out.append(F.coalesce(c, f"_old_{c}").alias(c))
        else:
            out.append(F.when(fresh, F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c))
    return joined.select(*out)


def analyst_updates(cases: DataFrame, updates: DataFrame, *, at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(updated cases, unknown case ids). updates: case_id, decision, notes; null notes keep the old ones.

    Of several updates of a case the latest by column ``at`` counts; without it, or among equals, the last in order
    of (decision, notes).
    """
    order = F.struct(*([at] if at else []), "decision", "notes")
    latest = updates.groupBy("case_id").agg(F.max(order).alias("_u"))
    u = latest.select("case_id", F.col("_u.decision").alias("_d"), F.col("_u.notes").alias("_n"))
    updated = (
        cases.join(u, "case_id", "left")
        .withColumns(
            {
                "analyst_decision": F.coalesce("_d", "analyst_decision"),
                "analyst_notes": F.coalesce("_n", "analyst_notes"),
            }
        )
        .drop("_d", "_n")
    )
    return updated, updates.join(cases.select("case_id"), "case_id", "left_anti").select("case_id")


def audit_log(old: DataFrame, new: DataFrame) -> DataFrame:
    """Events between two states of the case table."""
    watched = ("fraud_score", "decision", "severity", "primary_signal", "alert_narrative")
    o = old.select("case_id", F.lit(True).alias("_known"), F.col("analyst_decision").alias("_analyst"),
                   *[F.col(c).alias(f"_{c}") for c in watched])
    joined = new.join(o, "case_id", "left")
    changed = F.lit(False)
    for c in watched:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    system = F.when(F.col("_known").isNull(), "fraud_case_created").when(changed, "fraud_case_updated")
    decided = F.col("analyst_decision").isNotNull() & ~F.col("analyst_decision").eqNullSafe(F.col("_analyst"))
    events = F.array_compact(
        F.array(
            F.when(system.isNotNull(), F.struct(system.alias("event_type"), F.lit("system").alias("actor"))),
            F.when(decided, F.struct(F.lit("analyst_decision_updated").alias("event_type"), F.lit("analyst").alias("actor"))),
        )
    )
    return joined.select("case_id", "invoice_id", "analyst_decision", "decision", F.explode(events).alias("e")).select(
        "e.event_type", "case_id", "invoice_id", "e.actor",
        F.when(F.col("e.actor") == "analyst", F.col("analyst_decision")).otherwise(F.col("decision")).alias("decision"),
    )


def format_alerts(scored: DataFrame) -> DataFrame:
    """Alert payload; ``citations`` (array) and ``has_cascade`` are used when present."""
    sev = severity_of(F.col("fraud_score"))
    cascade = F.col("has_cascade") if "has_cascade" in scored.columns else F.lit(False)
    citations = F.col("citations") if "citations" in scored.columns else F.array().cast("array<string>")
    return scored.select(
        "invoice_id",
        sev.alias("severity"),
        mapped(sev, BADGES, BADGE_OTHER).alias("badge_color"),
        F.col("fraud_decision").alias("decision_label"),
        percent(F.col("fraud_score"), 1).alias("score_display"),
        primary_signal(F.col("fraud_patterns")).alias("primary_signal"),
        F.when(cascade, F.lit(CASCADE_WARNING)).otherwise("").alias("cascade_warning"),
        F.slice(citations, 1, 3).alias("top_regulations"),
        mapped(F.col("fraud_decision"), ALERT_ACTIONS, ALERT_ACTION_OTHER).alias("recommended_action"),
    )


def pattern_list(patterns: Column) -> Column:
    """['a', 'b'] text of a pattern array."""
    quoted = F.transform(patterns, lambda p: F.concat(F.lit("'"), p, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def signal_summary(inv: DataFrame) -> DataFrame:
    """Evidence text per invoice: invoice columns plus top_signals, semantic_similarity, has_carousel,
    cascade_depth, cascade_exposure."""
    yes = F.when(F.col("has_carousel"), "YES").otherwise("NO")
    lines = [
        F.concat(F.lit("Invoice: "), "invoice_number", F.lit(" | Amount: "), "currency", F.lit(" "), money_text(F.col("amount"))),
        F.concat(F.lit("Supplier: "), "supplier_name", F.lit(" -> Buyer: "), "buyer_name"),
        F.concat(F.lit("Fraud Score: "), percent(F.col("fraud_score"), 2), F.lit(" | Decision: "), "fraud_decision"),
        F.concat(F.lit("Top Signals: "), "top_signals"),
        F.concat(F.lit("Duplicate Risk: "), percent(F.col("semantic_similarity"), 2)),
        F.concat(F.lit("Graph: Carousel="), yes, F.lit(" | Cascade Depth="), F.col("cascade_depth").cast("string")),
        F.concat(F.lit("Cascade Exposure: INR "), money_text(F.col("cascade_exposure"))),
        F.concat(F.lit("Match Score: "), percent(F.col("match_score"), 2)),
    ]
    return inv.select("invoice_id", F.concat_ws("\n", *lines).alias("summary"))


def narrative_text() -> Column:
    """Deterministic narrative over the signal-summary columns."""
    flagged = F.concat(
        F.lit("Invoice `"), "invoice_number", F.lit("` for "), "currency", F.lit(" "), money_text(F.col("amount")),
        F.lit(" was flagged for "), "fraud_decision", F.lit(". The strongest signals were: "),
        F.when(F.col("top_signals") == "", "duplicate and graph anomalies").otherwise(F.col("top_signals")), F.lit("."),
    )
    graph = F.concat(
        F.lit("Duplicate similarity reached "), percent(F.col("semantic_similarity"), 2),
        F.lit(", and the graph analysis found carousel="), F.initcap(F.col("has_carousel").cast("string")),
        F.lit(" with cascade depth="), F.col("cascade_depth").cast("string"), F.lit("."),
    )
    closing = F.lit("No regulatory citation is attached: the narrative was generated from the score evidence alone.")
    return F.concat_ws("\n\n", flagged, graph, closing)


def fallback_narrative(inv: DataFrame) -> DataFrame:
    return inv.select("invoice_id", narrative_text().alias("narrative"))


def sar_draft(cases: DataFrame) -> DataFrame:
    """Templated suspicious-activity report per case."""
    head = F.concat_ws(
        "\n",
        F.lit("Suspicious Activity Report (draft)"),
        F.concat(F.lit("- Case: "), "case_number"),
        F.concat(F.lit("- Invoice: "), "invoice_id"),
        F.concat(F.lit("- Decision: "), "decision"),
        F.concat(F.lit("- Severity: "), "severity"),
        F.concat(F.lit("- Detected patterns: "), pattern_list(F.col("fraud_patterns"))),
    )
    body = F.concat(F.lit("Summary narrative:\n"), F.coalesce("alert_narrative", F.lit("")))
    action = F.concat(F.lit("Recommended action: "), mapped(F.col("decision"), CASE_ACTIONS, CASE_ACTION_OTHER), F.lit("\n"))
    return cases.select("case_id", F.concat_ws("\n\n", head, body, action).alias("sar_draft"))


def case_documents(cases: DataFrame) -> DataFrame:
    """Cases rendered as text documents for the search index."""
    fields = [
        ("Case Number", F.col("case_number")),
        ("Invoice ID", F.col("invoice_id")),
        ("Decision", F.col("decision")),
        ("Severity", F.col("severity")),
        ("Fraud Score", F.format_string("%.6f", "fraud_score")),
        ("Primary Signal", F.col("primary_signal")),
        ("Fraud Patterns", pattern_list(F.col("fraud_patterns"))),
        ("Alert Narrative", F.coalesce("alert_narrative", F.lit(""))),
        ("Analyst Decision", F.coalesce("analyst_decision", F.lit(""))),
        ("Analyst Notes", F.coalesce("analyst_notes", F.lit(""))),
    ]
    content = F.concat(F.concat_ws("\n", *[F.concat(F.lit(f"{n}: "), c) for n, c in fields]), F.lit("\n"))
    return cases.select(
        F.col("case_id").alias("id"),
        F.concat(F.lit("Fraud Case "), "case_number").alias("title"),
        F.concat(F.lit("fraud_case:"), "case_id").alias("source"),
        F.lit("fraud_case").alias("category"),
        content.alias("content"),
    )


def dedupe_case_numbers(cases: DataFrame, *, stored: DataFrame | None = None) -> DataFrame:
    """``CASE-<INVOICE>``; further cases of the same invoice number get ``-2``, ``-3``, ...

    ``stored``: invoice_number, case_number of earlier runs, whose numbers are not given again.
    """
    base = cases.withColumns(
        {"_base": F.concat(F.lit("CASE-"), F.upper("invoice_number")), "_hash": hash_slice("invoice_id")}
    )
    numbered = number_rows(base, group=["_base"], split=["_hash"], order=["invoice_id"])
    if stored is not None:
        named = stored.select(F.concat(F.lit("CASE-"), F.upper("invoice_number")).alias("_base"), "case_number")
        suffix = F.coalesce(F.expr("try_cast(substr(case_number, length(_base) + 2) as bigint)"), F.lit(1))
        highest = named.groupBy("_base").agg(F.max(suffix).alias("_taken"))
        numbered = numbered.join(highest, "_base", "left").withColumn("position", F.col("position") + F.coalesce("_taken", F.lit(0)))
    number = F.when(F.col("position") > 1, F.concat_ws("-", "_base", "position")).otherwise(F.col("_base"))
    return numbered.select("invoice_id", number.alias("case_number"))


def backfill_cases(flagged: DataFrame, existing: DataFrame) -> DataFrame:
    """Cases for flagged invoices that have none, from stored columns only."""
    todo = flagged.join(existing.select("invoice_id"), "invoice_id", "left_anti")
    patterns = F.coalesce("fraud_patterns", F.array().cast("array<string>"))
    primary = F.coalesce(F.get(patterns, F.lit(0)), F.lit("velocity_anomaly"))
    stored = F.when(F.col("fraud_score") != 0, F.col("fraud_score"))
    score = F.coalesce(stored, mapped(primary, PATTERN_SCORES, PATTERN_SCORE_OTHER))
    listed = F.when(F.size(patterns) > 0, F.array_join(patterns, ", ")).otherwise("anomaly")
    narrative = F.concat(
        F.lit("Invoice "), "invoice_number", F.lit(" for INR "), money_text(F.col("amount")),
        F.lit(" was flagged with decision "), "fraud_decision", F.lit(". Primary signal: "), primary,
        F.lit(". Fraud score: "), percent(score, 2), F.lit(". Patterns detected: "), listed, F.lit("."),
    )
    share = F.round(score / F.greatest(F.size(patterns), F.lit(1)), 3)
    numbers = dedupe_case_numbers(todo)
    return todo.join(numbers, "invoice_id").select(
        "invoice_id",
        "case_number",
        F.col("fraud_decision").alias("decision"),
        score.alias("fraud_score"),
        mapped(F.col("fraud_decision"), DECISION_SEVERITY, "medium").alias("severity"),
        primary.alias("primary_signal"),
        *[F.round(score * f, 3).alias(f"score_{n}") for n, f in DERIVED_SCORES.items()],
        F.transform(patterns, lambda p: F.concat(p, F.lit("="), share.cast("string"))).alias("attribution"),
        narrative.alias("alert_narrative"),
        (F.col("fraud_decision") == "HOLD").alias("is_confirmed_fraud"),
    )


def merge_patterns(stages: DataFrame, *columns: str) -> DataFrame:
    """Stage pattern lists concatenated, first occurrence kept."""
    return stages.select("invoice_id", F.array_distinct(F.concat(*columns)).alias("fraud_patterns"))


def dedupe_citations(citations: DataFrame) -> DataFrame:
    """First citation (lowest rank) of each (title, source, category) per owner."""
    key = [F.coalesce(c, F.lit("")).alias(c) for c in ("title", "source", "category")]
    return citations.groupBy("id", *key).agg(F.min("rank").alias("rank"))


def stage_errors(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Row-level failures as texts; the row itself continues with neutral defaults."""
    reasons = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]))
    return rows.withColumn("processing_errors", reasons)
