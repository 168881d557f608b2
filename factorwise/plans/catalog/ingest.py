"""Ingestion queries over the raw feed."""

import uuid

from pyspark.sql import functions as F, types as T

from factorwise.functions import parse
from factorwise.plans import views as v
from factorwise.plans.catalog import Catalog
from factorwise.session import shared_dir
from factorwise.sources import files, normalise, tables

catalog = Catalog()
KEEP = ["feed_id", "source_file"]
#: Invoices of a text file at most; up to 8 such files, rows are dealt over 8.
TEXT_ROWS = 100_000


def folder(spark, name):
    """A fresh folder the executors share, for file round trips."""
    return f"{shared_dir(spark).rstrip('/')}/factorwise-{name}-{uuid.uuid4().hex}"


def typed(spark, sf):
    return normalise.normalise(v.raw_feed(spark, sf), keep=KEEP)


def _aliased(spark, sf):
    raw = v.raw_feed(spark, sf)
    return normalise.resolve_aliases(normalise.normalise_headers(raw), keep=KEEP)


# the files hold every feed row; the CSV reader strips blanks around values
_HEADS = {
    "invoice_no": "Invoice No", "vendor_name": "Vendor Name", "customer": "Customer", "total_amount": "Total Amount", "order_date": "Order Date",
    "po_no": "PO No", "grn_no": "GRN No", "currency_code": "Currency Code", "financier_name": "Financier Name", "payment_type": "Payment Type",
}


@catalog.add("ingest_csv", "select feed_id, " + ", ".join(f"""nullif(trim({c}), '') as "{h}\"""" for c, h in _HEADS.items()) + ", null::varchar as _line_error from feed")
def _(spark, sf):
    path = folder(spark, "csv")
    v.raw_feed(spark, sf).drop("source_file").write.option("header", True).csv(path)
    return files.ingest_csv(spark, path).drop("source_file")


_JSON = T.StructType([T.StructField(n, T.StringType()) for n in ("feed_id", "Invoice No", "Vendor Name", "Customer", "Total Amount", "Order Date")])


@catalog.add("ingest_json", "select feed_id, " + ", ".join(f"""{c} as "{h}\"""" for c, h in list(_HEADS.items())[:5]) + ", null::varchar as _line_error from feed")
def _(spark, sf):
    path = folder(spark, "json")
    v.raw_feed(spark, sf).drop("source_file").write.json(path)
    return files.ingest_json(spark, path, _JSON, lines=True).drop("source_file")


@catalog.add("ingest_dispatch")
def _(spark, sf):
    path = folder(spark, "mixed")
    v.raw_feed(spark, sf).drop("source_file").write.option("header", True).csv(f"{path}/a")
    texts = v.invoice_documents(spark, sf).select("text")
    pieces = max(8, -(-v.table(spark, sf, "lineitem").count() // TEXT_ROWS))  # a text file is read whole, by one task
    texts.repartition(pieces).write.text(f"{path}/b", lineSep="\n\n")
    rows = files.ingest_dispatch(spark, path, _JSON)
    return rows.groupBy("source_format").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("source_file").alias("files"))


@catalog.add("ingest_text_dir")
def _(spark, sf):
    path = folder(spark, "texts")
    v.table(spark, sf, "documents").select("source", "text").repartition("source").write.partitionBy("source").text(path)
    docs = files.ingest_text_dir(spark, path)
    return docs.select("id", "title", "category", F.length("content").alias("chars"))


_RAW = "invoice_no, vendor_name, customer, total_amount, order_date, po_no, grn_no, currency_code, financier_name, payment_type"


@catalog.add("drop_blank_rows", f"select feed_id, {_RAW} from feed where not blank")
def _(spark, sf):
    raw = normalise.normalise_headers(v.raw_feed(spark, sf).drop("source_file"))
    return normalise.drop_blank_rows(raw, columns=[c for c in raw.columns if c != "feed_id"])


@catalog.add(
    "extract_invoice_fields",
    """select invoice_id as id, invoice_number, po_number, null::varchar as grn_number, cast(amount as varchar) as amount,
  cast(invoice_date as varchar) as invoice_date, null::varchar as due_date, supplier_name, buyer_name from base""",
)
def _(spark, sf):
    return normalise.extract_invoice_fields(v.invoice_documents(spark, sf))


@catalog.add("normalise_headers", f"select feed_id, source_file, {_RAW} from feed")
def _(spark, sf):
    return normalise.normalise_headers(v.raw_feed(spark, sf))


@catalog.add(
    "resolve_aliases",
    """select feed_id, source_file, invoice_no as invoice_number, vendor_name as supplier_name, nullif(trim(customer), '') as buyer_name,
  total_amount as amount, order_date as invoice_date, po_no as po_number, grn_no as grn_number, null::varchar as due_date,
  currency_code as currency, financier_name as lender_name, null::varchar as line_items, null::varchar as payment_method from feed""",
)
def _(spark, sf):
    return _aliased(spark, sf)


@catalog.add(
    "parse_amount",
    """select feed_id, case when total_amount is null then 0 else
  try_cast(regexp_replace(total_amount, '[^0-9.\\-]', '', 'g') as decimal(18,2)) end::double as amount,
  total_amount = 'n/a' and total_amount is not null as amount_error from feed""",
)
def _(spark, sf):
    raw = F.col("amount")
    return _aliased(spark, sf).select(
        "feed_id", parse.amount(raw).cast("double").alias("amount"), parse.amount_failed(raw).alias("amount_error")
    )


@catalog.add(
    "parse_dates",
    """select feed_id, i.invoice_date as date, coalesce(order_date = '31/31/2000', false) as date_error
from feed left join ingested i using (feed_id)""",
)
def _(spark, sf):
    raw = F.col("invoice_date")
    return _aliased(spark, sf).select(
        "feed_id", parse.date(raw).alias("date"), F.coalesce(parse.date_failed(raw), F.lit(False)).alias("date_error")
    )


@catalog.add("parse_line_items")
def _(spark, sf):
    items = v.invoices(spark, sf, items=True).select(
        F.col("invoice_id").alias("id"), F.to_json("line_items").alias("json"), F.col("line_items")[0]["description"].alias("plain")
    )
    mixed = F.when(F.length("id") % 2 == 0, F.col("json")).otherwise(F.col("plain"))
    return items.select("id", parse.line_items(mixed).alias("line_items"))


@catalog.add(
    "apply_defaults",
    """select feed_id, upper(coalesce(currency_code, 'INR')) as currency, coalesce(financier_name, 'House Bank') as lender_name,
  po_no as po_number, grn_no as grn_number, null::varchar as payment_method from feed""",
)
def _(spark, sf):
    out = normalise.apply_defaults(_aliased(spark, sf), default_lender="House Bank")
    return out.select("feed_id", "currency", "lender_name", "po_number", "grn_number", "payment_method")


@catalog.add(
    "validate_invoices",
    """select i.feed_id, array_to_string(r.reasons, ',') as reasons, i.invoice_number, i.supplier_name, i.buyer_name,
  coalesce(i.amount, case when r.feed_id is null then 0 end)::double as amount, i.invoice_date, i.currency from ingested i join rejects r using (feed_id)""",
)
def _(spark, sf):
    rows = typed(spark, sf)
    return rows.select(
        "feed_id", F.array_join("reasons", ",").alias("reasons"), "invoice_number", "supplier_name", "buyer_name",
        F.col("amount").cast("double").alias("amount"), "invoice_date", "currency",
    )


@catalog.add(
    "ingest_summary",
    """select source_file, count(*) filter (where len(reasons) = 0) as accepted_count, count(*) filter (where len(reasons) > 0) as rejected_count,
  0::bigint as bad_invoice_number, 0::bigint as bad_supplier_name, count(*) filter (where list_contains(reasons, 'buyer_name')) as bad_buyer_name,
  count(*) filter (where list_contains(reasons, 'amount')) as bad_amount, count(*) filter (where list_contains(reasons, 'invoice_date')) as bad_invoice_date
from rejects group by 1""",
)
def _(spark, sf):
    return normalise.ingest_summary(typed(spark, sf))


@catalog.add(
    "assign_ids",
    """select feed_id, sha256(concat_ws('|', invoice_number, supplier_name, coalesce(cast(invoice_date as varchar), ''))) as id from ingested""",
)
def _(spark, sf):
    return normalise.assign_ids(typed(spark, sf), keys=["invoice_number", "supplier_name", "invoice_date"]).select("feed_id", "id")


@catalog.add(
    "table_sink",
    """select invoice_id, case when fraud_decision <> 'PASS' then 'flagged' else status end as status, fraud_score from scored""",
)
def _(spark, sf):
    scored = v.scored_invoices(spark, sf)
    stored = v.invoices(spark, sf).select("invoice_id", "status", F.lit(0.0).alias("fraud_score"))
    flagged = F.when(F.col("fraud_decision") != "PASS", "flagged").otherwise(F.col("status"))
    analysed = scored.select("invoice_id", flagged.alias("status"), "fraud_score")
    path = tables.write_version(tables.merge_by_key(stored, analysed, key="invoice_id"), folder(spark, "invoices"), 1)
    return tables.scan_table(spark, path).select("invoice_id", "status", "fraud_score")


@catalog.add("paged_scan", "select o_orderkey, o_custkey, o_totalprice from orders")
def _(spark, sf):
    return tables.scan_table(spark, f"{sf}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
