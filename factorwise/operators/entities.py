"""Company records: cleaning, get-or-create, registration match, company resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factorwise.functions.text import clean, present

ROLES = ("supplier", "buyer", "lender")


def clean_name(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a trimmed name, rows rejected for an empty name)."""
    cleaned = df.withColumn("name", present(F.col("name")))
    return cleaned.where(F.col("name").isNotNull()), cleaned.where(F.col("name").isNull())


def entity_key(entity_type: Column, name: Column) -> Column:
    return F.sha2(F.concat_ws("|", entity_type, name), 256)


def get_or_create_entities(existing: DataFrame, inv: DataFrame) -> DataFrame:
    """Entity of every (type, trimmed name) the invoices mention: known id or a derived new one."""
    roles = F.array(*[F.struct(F.lit(r).alias("entity_type"), present(F.col(f"{r}_name")).alias("name")) for r in ROLES])
    wanted = (
        inv.select(F.explode(roles).alias("e")).select("e.*").where(F.col("name").isNotNull()).distinct()
    )
    known = existing.groupBy("entity_type", F.trim("name").alias("name")).agg(F.min("entity_id").alias("_known"))
    return wanted.join(known, ["entity_type", "name"], "left").select(
        F.coalesce("_known", entity_key(F.col("entity_type"), F.col("name"))).alias("entity_id"),
        "entity_type",
        "name",
        F.col("_known").isNull().alias("is_new"),
    )


def registration_match(ent: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing entity with the same type and name and, where given, the same GST / PAN number."""
    e = ent.select("entity_id", "entity_type", "name", F.col("gst").alias("_gst"), F.col("pan").alias("_pan"))
    i = incoming.select("incoming_id", "entity_type", present(F.col("name")).alias("name"), "gst", "pan")
    agrees = (F.col("gst").isNull() | (F.col("gst") == F.col("_gst"))) & (F.col("pan").isNull() | (F.col("pan") == F.col("_pan")))
    hits = i.join(e, ["entity_type", "name"]).where(agrees).groupBy("incoming_id").agg(F.min("entity_id").alias("entity_id"))
    return i.select("incoming_id").join(hits, "incoming_id", "left")


def resolve_companies(ent: DataFrame) -> DataFrame:
    """One company id per normalised name across roles."""
    named = ent.select("entity_id", clean(F.col("name")).alias("_name"))
    company = named.groupBy("_name").agg(F.min("entity_id").alias("company_id"))
    return named.join(company, "_name").select("entity_id", "company_id")
