"""Filters, look-ups and top-k reports over invoices and cases."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

FLAGGED = ("REVIEW", "HOLD")


def is_flagged(decision: Column | None = None) -> Column:
    return (decision if decision is not None else F.col("fraud_decision")).isin(*FLAGGED)


def _names(ent: DataFrame, role: str) -> DataFrame:
    return ent.select(F.col("entity_id").alias(f"{role}_id"), F.col("name").alias(f"{role}_name"))


def enrich_names(inv: DataFrame, ent: DataFrame) -> DataFrame:
    """Party names by id: unknown supplier or buyer is '', unknown lender null.

    No broadcast hint: company tables can be large, the planner picks by size.
    """
    out = inv.drop("supplier_name", "buyer_name", "lender_name")
    for role in ("supplier", "buyer", "lender"):
        out = out.join(_names(ent, role), f"{role}_id", "left")
    return out.withColumns({f"{r}_name": F.coalesce(f"{r}_name", F.lit("")) for r in ("supplier", "buyer")})


def list_invoices(
    inv: DataFrame, ent: DataFrame, *, status: str | None = None, decision: str | None = None, lender: str | None = None,
    date_from: dt.date | None = None, date_to: dt.date | None = None, after: str | None = None, limit: int | None = None,
) -> DataFrame:
    """Invoices under optional filters, in id order; names are joined to the page only.

    ``limit`` makes it a page; ``after``, the last id of a page, starts the next one.
    """
    rows = inv if after is None else inv.where(F.col("invoice_id") > after)
    for column, value in (("status", status), ("fraud_decision", decision), ("lender_id", lender)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if date_from is not None:
        rows = rows.where(F.col("invoice_date") >= F.lit(date_from))
    if date_to is not None:
        rows = rows.where(F.col("invoice_date") <= F.lit(date_to))
    page = rows.select(
        "invoice_id", "invoice_number", "supplier_id", "buyer_id", "lender_id", "amount", "invoice_date", "status",
        "fraud_score", "fraud_decision",
    )
    if limit is not None:
        page = page.orderBy("invoice_id").limit(limit)
    return enrich_names(page, ent).select(
        F.col("invoice_id").alias("id"), "invoice_number", "supplier_name", "buyer_name", "amount", "invoice_date", "status",
        "fraud_score", "fraud_decision",
    )


def list_cases(
    cases: DataFrame, *, decision: str | None = None, severity: str | None = None,
    date_from: dt.date | None = None, date_to: dt.date | None = None, after: tuple[dt.datetime, str] | None = None, limit: int | None = None,
) -> DataFrame:
    """Newest cases under optional filters; the last day counts in full.

    ``limit`` makes it a page; ``after``, (created_at, case_id) of a page's last row, starts the next one.
    """
    rows = cases
    if after is not None:
        when, last = F.lit(after[0]).cast("timestamp_ntz"), F.lit(after[1])
        rows = rows.where((F.col("created_at") < when) | ((F.col("created_at") == when) & (F.col("case_id") > last)))
    for column, value in (("decision", decision), ("severity", severity)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if date_from is not None:
        rows = rows.where(F.col("created_at") >= F.lit(date_from))
    if date_to is not None:
        rows = rows.where(F.col("created_at") < F.lit(date_to + dt.timedelta(days=1)))
    ordered = rows.orderBy(F.desc("created_at"), "case_id")
    return ordered if limit is None else ordered.limit(limit)


def cases_by_lender(cases: DataFrame, inv: DataFrame, *, lender_id: str) -> DataFrame:
    financed = inv.where(F.col("lender_id") == lender_id).select("invoice_id")
    return cases.join(financed, "invoice_id", "left_semi")


def point_lookup(df: DataFrame, *, key: str, value) -> DataFrame:
    return df.where(F.col(key) == value)


def case_with_invoice(cases: DataFrame, inv: DataFrame, ent: DataFrame) -> DataFrame:
    """Case, invoice and party names; ``cascade_path`` length when present."""
    depth = F.size("cascade_path") if "cascade_path" in cases.columns else F.lit(0)
    own = cases.select("case_id", "invoice_id", "decision", "fraud_score", depth.cast("long").alias("cascade_depth"))
    facts = inv.select("invoice_id", "invoice_number", "supplier_id", "buyer_id", "lender_id", "amount")
    return enrich_names(own.join(facts, "invoice_id", "left"), ent).select(
        "case_id", "invoice_number", "supplier_name", "buyer_name", "lender_name", "amount", "fraud_score", "decision", "cascade_depth"
    )


def top_risks(inv: DataFrame, *, n: int = 10) -> DataFrame:
    return inv.orderBy(F.desc("fraud_score"), "invoice_id").limit(n)


def recent_alerts(cases: DataFrame, *, n: int = 20) -> DataFrame:
    return cases.orderBy(F.desc("created_at"), "case_id").limit(n)


def flagged_filter(inv: DataFrame) -> DataFrame:
    return inv.where(is_flagged())


def entities_for_flagged(inv: DataFrame, ent: DataFrame) -> DataFrame:
    ids = flagged_filter(inv).select(F.col("supplier_id").alias("entity_id"))
    return ent.join(ids, "entity_id", "left_semi")


def soft_delete(inv: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(invoices with listed ids rejected, ids that do not exist)."""
    marks = ids.select("invoice_id").distinct().withColumn("_gone", F.lit(True))
    out = inv.join(marks, "invoice_id", "left").withColumn(
        "status", F.when(F.col("_gone"), F.lit("rejected")).otherwise(F.col("status"))
    )
    return out.drop("_gone"), ids.join(inv.select("invoice_id"), "invoice_id", "left_anti")


def network_tier_filter(nodes: DataFrame, edges: DataFrame, *, tier: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of a tier and the edges with both ends kept."""
    kept = nodes.where(F.col("tier") == tier)
    ids = kept.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_semi"
    )
    return kept, inside
