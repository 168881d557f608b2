"""Feature engineering over invoices and order rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from factorwise.functions.text import present
from factorwise.functions.vectors import clip
from factorwise.operators.lookup import is_flagged
from factorwise.plans.materialise import cut_lineage
from factorwise.plans.ordered import exact_quantiles, number_rows, with_halo

# Order of the feature vector, renamed source columns, fraud states.
FEATURE_COLUMNS = (
    "amount", "amount_log", "has_po", "has_grn", "currency_inr",
    "duplicate_risk_score", "is_exact_duplicate", "lsh_candidate_count", "max_semantic_similarity",
    "match_score", "po_match_score", "grn_match_score", "anomaly_count",
    "has_carousel", "carousel_ring_count", "cascade_depth", "cascade_exposure",
    "supplier_degree", "supplier_age_days", "supplier_avg_amount", "supplier_fraud_rate", "amount_vs_supplier_avg",
    "invoices_last_7d", "invoices_last_30d", "amount_last_7d",
)
SOURCE_COLUMNS = {
    "Sales per customer": "amount",
    "Order Item Total": "order_item_total",
    "Order Profit Per Order": "profit",
    "Order Item Discount Rate": "discount_rate",
    "Order Item Quantity": "quantity",
    "Product Price": "unit_price",
    "Days for shipment (scheduled)": "scheduled_ship_days",
    "Days for shipping (real)": "actual_ship_days",
    "Benefit per order": "benefit_per_order",
    "Customer Segment": "customer_segment",
    "Order Region": "order_region",
    "Market": "market",
    "Department Name": "department",
    "Category Name": "category",
    "Shipping Mode": "shipping_mode",
    "Type": "payment_type",
}
FRAUD_STATES = ("SUSPECTED_FRAUD", "FRAUD", "CANCELLED")
DEFAULT_AGE_DAYS = 365.0
LABEL_CUT = 0.7
SMALL_AMOUNT, HIGH_DISCOUNT = 9900, 0.15


# ------------------------------------------------------------------ invoices


def supplier_history(inv: DataFrame) -> DataFrame:
    """Invoice count, mean amount and flagged share per supplier."""
    return inv.groupBy("supplier_id").agg(
        F.count(F.lit(1)).alias("invoice_count"),
        (F.sum("amount").cast("double") / F.count("amount")).alias("avg_amount"),
        F.avg(F.coalesce(is_flagged(), F.lit(False)).cast("double")).alias("fraud_rate"),
    )


def supplier_velocity(inv: DataFrame, *, asof: dt.date) -> DataFrame:
    """Invoices in the last 7 and 30 days (both ends included) and 7-day amount at a date."""
    day = F.lit(asof)
    recent = inv.where(F.col("invoice_date").between(F.date_sub(day, 30), day))
    week = F.col("invoice_date") >= F.date_sub(day, 7)
    return recent.groupBy("supplier_id").agg(
        F.count_if(week).alias("n_7d"),
        F.count(F.lit(1)).alias("n_30d"),
        F.coalesce(F.sum(F.when(week, F.col("amount"))).cast("double"), F.lit(0.0)).alias("amount_7d"),
    )


def velocity_points(inv: DataFrame) -> DataFrame:
    """supplier_id, invoice_date, n_7d, n_30d, amount_7d for every supplier day.

    All invoices of a supplier day share the window, so the range frame runs
    over daily sums: a supplier's partition is at most one row per calendar day.
    """
    daily = inv.groupBy("supplier_id", "invoice_date").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("amount").cast("decimal(38,2)")).alias("_a")
    )
    span = W.partitionBy("supplier_id").orderBy(F.unix_date("invoice_date"))
    return daily.select(
        "supplier_id",
        "invoice_date",
        F.sum("_n").over(span.rangeBetween(-7, 0)).alias("n_7d"),
        F.sum("_n").over(span.rangeBetween(-30, 0)).alias("n_30d"),
        F.sum("_a").over(span.rangeBetween(-7, 0)).cast("double").alias("amount_7d"),
    )


def feature_vector(scored: DataFrame, graph: DataFrame, history: DataFrame, velocity: DataFrame) -> DataFrame:
    """invoice_id and the 25 model inputs.

    scored: invoices with duplicate and match results; graph: findings by
    invoice; history by supplier; velocity by supplier and day.
    """
    amount = F.coalesce(F.col("amount").cast("double"), F.lit(0.0))
    average = F.coalesce("avg_amount", F.lit(0.0))

    def number(name: str, default: float = 0.0) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(default))

    columns = {
        "amount": amount,
        "amount_log": F.log1p(F.greatest(amount, F.lit(0.0))),
        "has_po": present(F.col("po_number")).isNotNull().cast("double"),
        "has_grn": present(F.col("grn_number")).isNotNull().cast("double"),
        "currency_inr": (F.upper(F.coalesce("currency", F.lit("INR"))) == "INR").cast("double"),
        "duplicate_risk_score": number("duplicate_risk_score"),
        "is_exact_duplicate": number("is_exact_duplicate"),
        "lsh_candidate_count": number("candidate_count"),
        "max_semantic_similarity": number("semantic_similarity") if "semantic_similarity" in scored.columns else F.lit(0.0),
        "match_score": number("match_score"),
        "po_match_score": number("po_match_score"),
        "grn_match_score": number("grn_match_score"),
        "anomaly_count": number("anomaly_count"),
        "has_carousel": number("has_carousel"),
        "carousel_ring_count": number("ring_count"),
        "cascade_depth": number("cascade_depth"),
        "cascade_exposure": number("cascade_exposure"),
        "supplier_degree": number("invoice_count"),
        "supplier_age_days": F.lit(DEFAULT_AGE_DAYS),
        "supplier_avg_amount": average,
        "supplier_fraud_rate": number("fraud_rate"),
        "amount_vs_supplier_avg": F.when(average > 0, F.try_divide(amount, average)).otherwise(0.0),
        "invoices_last_7d": number("n_7d"),
        "invoices_last_30d": number("n_30d"),
        "amount_last_7d": number("amount_7d"),
    }
    joined = (
        scored.join(graph, "invoice_id", "left")
        .join(history, "supplier_id", "left")
        .join(velocity, ["supplier_id", "invoice_date"], "left")
    )
    return joined.select("invoice_id", *[columns[c].alias(c) for c in FEATURE_COLUMNS])


def infer_label(inv: DataFrame) -> DataFrame:
    """Label from metadata.is_fraud, else the decision, else the score."""
    flag = F.get_json_object("metadata", "$.is_fraud")
    decision = F.upper(F.coalesce("fraud_decision", F.lit("")))
    label = (
        F.when(flag.isNotNull(), (~F.lower(flag).isin("false", "0", "0.0", "", "null")).cast("int"))
        .when(decision == "HOLD", 1)
        .when(decision.isin("PASS", ""), 0)
        .otherwise((F.coalesce("fraud_score", F.lit(0.0)) >= LABEL_CUT).cast("int"))
    )
    return inv.select("invoice_id", label.alias("label"))


def features_from_metadata(inv: DataFrame) -> DataFrame:
    """The 25 inputs from stored columns and the metadata document, with defaults."""

    def meta(name: str, default: float = 0.0) -> Column:
        return F.coalesce(F.get_json_object("metadata", f"$.{name}").try_cast("double"), F.lit(default))

    amount = F.coalesce(F.col("amount").cast("double"), F.lit(0.0))
    average = meta("supplier_avg_amount")
    age = meta("supplier_age_days", DEFAULT_AGE_DAYS)
    exact = F.lower(F.coalesce(F.get_json_object("metadata", "$.is_exact_duplicate"), F.lit("false")))
    own = {
        "amount": amount,
        "amount_log": F.log1p(F.greatest(amount, F.lit(0.0))),
        "has_po": (F.coalesce("po_number", F.lit("")) != "").cast("double"),
        "has_grn": (F.coalesce("grn_number", F.lit("")) != "").cast("double"),
        "currency_inr": (F.upper(F.coalesce("currency", F.lit("INR"))) == "INR").cast("double"),
        "is_exact_duplicate": (~exact.isin("false", "0", "")).cast("double"),
        "has_carousel": F.coalesce(F.array_contains("fraud_patterns", "carousel_trade"), F.lit(False)).cast("double"),
        "supplier_degree": meta("supplier_invoice_count"),
        "supplier_age_days": F.when(age == 0, DEFAULT_AGE_DAYS).otherwise(age),
        "amount_vs_supplier_avg": F.when(average > 0, F.try_divide(amount, average)).otherwise(0.0),
    }
    return inv.select("invoice_id", *[own.get(c, meta(c)).alias(c) for c in FEATURE_COLUMNS])


def invoice_sequences(inv: DataFrame, *, length: int = 8, stride: int = 1, label_tail: int = 3) -> DataFrame:
    """Sliding windows of ``length`` invoices per supplier: supplier_id, end_id, seq, label.

    inv: supplier_id, invoice_id, invoice_date, item (any type), label. Invoices
    are numbered per supplier and day, then windows run in blocks that carry
    ``length - 1`` rows of context, so one supplier fills many tasks.
    """
    numbered = number_rows(inv, group=["supplier_id"], split=["invoice_date"], order=["invoice_id"])
    blocks = with_halo(numbered, position="position", before=length - 1)
    w = W.partitionBy("supplier_id", "_slice").orderBy("position")
    windows = blocks.withColumns(
        {
            "seq": F.collect_list("item").over(w.rowsBetween(-(length - 1), 0)),
            "_tail": F.max("label").over(w.rowsBetween(-(label_tail - 1), 0)),
        }
    )
    keep = F.col("_own") & (F.col("position") >= length) & ((F.col("position") - length) % stride == 0)
    return windows.where(keep).select(
        "supplier_id", F.col("invoice_id").alias("end_id"), "seq", F.col("_tail").cast("int").alias("label")
    )


def mask_sequences(seqs: DataFrame, *, p: float = 0.15, seed: int = 42) -> DataFrame:
    """Zero about ``p`` of the positions (vectors) of each sequence; keep the original and the mask."""
    cut = int(p * 10000)
    indexed = F.transform("seq", lambda x, i: F.pmod(F.xxhash64(F.col("end_id"), i, F.lit(seed)), F.lit(10000)) < cut)
    masked = seqs.withColumn("mask", indexed).withColumn(
        "masked", F.zip_with("seq", "mask", lambda x, m: F.when(m, F.transform(x, lambda _: F.lit(0.0))).otherwise(x))
    )
    return masked.select("supplier_id", "end_id", F.col("seq").alias("original"), "masked", "mask", "label")


# ---------------------------------------------------------------- order rows


def rename_columns(df: DataFrame, mapping: Mapping[str, str] = SOURCE_COLUMNS) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def median_impute(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Numbers or the column's exact median."""
    numeric = df.withColumns({c: F.col(c).try_cast("double") for c in cols})
    long = numeric.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cols])).alias("e")).select("e.*")
    medians = exact_quantiles(long, value="value", probs=[0.5], group=["column"])
    fitted = {r["column"]: r["q0"] for r in medians.collect()}  # one row per column
    return numeric.withColumns({c: F.coalesce(F.col(c), F.lit(fitted.get(c)).cast("double")) for c in cols})


#: Codes of a column that are broadcast to its rows; beyond it the join shuffles.
BROADCAST_CODES = 100_000


def code_dictionary(df: DataFrame, cols: Sequence[str], *, slices: int | None = None) -> DataFrame:
    """column (its number in ``cols``), value, slice, code: rank of each text among its column's distinct texts, from 0.

    Distinct texts of all columns are cut into ranges of about equal size, sorted range by range and numbered after the sizes
    of the ranges before, so neither many texts nor a common beginning puts them into one task. ``slices`` is
    the number of ranges (default: the session's shuffle partitions). Null is the text UNKNOWN.
    """
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = [F.struct(F.lit(i).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN")).alias("value")) for i, c in enumerate(cols)]
    distinct = df.select(F.explode(F.array(*texts)).alias("e")).select("e.*").distinct()
    # written once: the number of a range must not change between its two uses
    ranged = cut_lineage(distinct.repartitionByRange(n, "column", "value").withColumn("slice", F.spark_partition_id()))
    numbered = number_rows(ranged, group=["column"], split=["slice"], order=["value"])
    return numbered.select("column", "value", "slice", (F.col("position") - 1).cast("long").alias("code"))


def label_encode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``<col>_enc``: rank of the text among the column's distinct texts, from 0; null is the text UNKNOWN.

    One dictionary serves all columns; a column with up to BROADCAST_CODES texts adds no shuffle of the rows.
    """
    codes = cut_lineage(code_dictionary(df, cols))
    sizes = {r["column"]: r["n"] for r in codes.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per column
    out = df
    for i, c in enumerate(cols):
        own = codes.where(F.col("column") == i).select(F.col("value").alias("_v"), F.col("code").alias(f"{c}_enc"))
        own = F.broadcast(own) if sizes.get(i, 0) <= BROADCAST_CODES else own
        out = out.withColumn("_v", F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN"))).join(own, "_v").drop("_v")
    return out


def clean_nonfinite(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NaN, infinite and missing numbers become 0."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf")) | F.col(c).isNull()
    return df.withColumns({c: F.when(bad(c), 0.0).otherwise(F.col(c)) for c in cols})


def target_label(df: DataFrame, *, status: str = "order_status", fallback: str = "late_delivery_risk") -> DataFrame:
    if status in df.columns:
        label = F.upper(F.trim(F.coalesce(F.col(status), F.lit("")))).isin(*FRAUD_STATES).cast("int")
    else:
        label = F.coalesce(F.col(fallback).cast("int"), F.lit(0))
    return df.withColumn("fraud_label", label)


def order_features(rows: DataFrame) -> DataFrame:
    """Eight derived columns per order row."""
    total = F.col("quantity") * F.col("unit_price")
    delay = clip(F.col("actual_ship_days") - F.col("scheduled_ship_days"), -10, 30)
    return rows.withColumns(
        {
            "shipment_delay": delay,
            "is_late": (delay > 0).cast("int"),
            "amount_log": F.log1p(F.greatest(F.col("amount"), F.lit(0.0))),
            "amount_bin_below_threshold": (F.col("amount") < SMALL_AMOUNT).cast("int"),
            "profit_margin": clip(F.when(F.col("amount") > 0, F.try_divide("profit", "amount")).otherwise(0.0), -5, 5),
            "high_discount": (F.col("discount_rate") > HIGH_DISCOUNT).cast("int"),
            "computed_total": total,
            "amount_vs_computed": clip(F.when(total > 0, F.try_divide(F.col("amount"), total)).otherwise(1.0), 0, 5),
        }
    )


def order_risk_proxies(rows: DataFrame) -> DataFrame:
    """Risk columns of order rows with features; history columns come from the supplier's own rows."""
    widest = rows.agg(F.max(F.abs("shipment_delay"))).scalar()
    signals = (F.col("shipment_delay") > 2).cast("int") + F.col("high_discount") + F.col("amount_bin_below_threshold")
    base = rows.withColumns(
        {
            "duplicate_risk_score": clip(F.abs("shipment_delay") / (widest + F.lit(1e-6)), 0, 1),
            "match_score": clip(F.lit(1.0) - F.abs(F.col("amount_vs_computed") - 1), 0, 1),
            "anomaly_count": signals,
            "has_carousel": (signals >= 2).cast("int"),
            "cascade_depth": F.least(signals, F.lit(3)),
        }
    ).withColumns(
        {
            "cascade_exposure": F.col("amount") * (F.col("cascade_depth") + 1),
            "supplier_fraud_rate": clip(
                F.col("high_discount") * 0.3 + F.col("duplicate_risk_score") * 0.4 + (F.lit(1.0) - F.col("match_score")) * 0.3, 0, 1
            ),
        }
    )
    asinv = base.select(F.col("supplier_key").alias("supplier_id"), F.col("ship_date").alias("invoice_date"), "amount")
    points = velocity_points(asinv).select(
        F.col("supplier_id").alias("supplier_key"), F.col("invoice_date").alias("ship_date"),
        F.col("n_7d").alias("invoices_last_7d"), F.col("n_30d").alias("invoices_last_30d"),
    )
    counts = base.groupBy("supplier_key").agg(F.count(F.lit(1)).alias("supplier_invoice_count"))
    return base.join(points, ["supplier_key", "ship_date"]).join(counts, "supplier_key")


def class_weights(df: DataFrame, *, label: str = "label") -> DataFrame:
    """label, n, weight = total / (classes x n), pos_weight = others / n."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = W.partitionBy(F.lit(1))  # one row per class
    total, classes = F.sum("n").over(every), F.count(F.lit(1)).over(every)
    return counts.select(
        label, "n", F.round(total / (classes * F.col("n")), 6).alias("weight"), F.round((total - F.col("n")) / F.col("n"), 6).alias("pos_weight")
    )


def vector(cols: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in cols])


def standard_scale(train: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / sample deviation with the statistics of ``train``; constant columns become 0."""
    fitted = train.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()

    def scaled(c: str) -> Column:
        mean, spread = fitted[f"m_{c}"], fitted[f"s_{c}"]
        return (F.col(c) - F.lit(mean)) / F.lit(spread) if spread else F.lit(0.0)

    return df.withColumns({c: scaled(c) for c in cols})
