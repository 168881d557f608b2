"""Look-up, list and entity queries."""

import datetime as dt

from pyspark.sql import functions as F

from factorwise.operators import entities, graph, lookup
from factorwise.plans import views as v
from factorwise.plans.catalog import Catalog

catalog = Catalog()
FROM, TO = dt.date(1997, 1, 1), dt.date(1999, 12, 31)


def _double(df, *cols):
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


@catalog.add(
    "list_invoices",
    """
select s.invoice_id as id, invoice_number, e.name as supplier_name, b.name as buyer_name, amount::double as amount, invoice_date, status,
  fraud_score, fraud_decision
from scored s left join ent e on e.entity_id = supplier_id left join ent b on b.entity_id = buyer_id
where status = 'pending' and fraud_decision = 'REVIEW' and lender_id = 'L-3' and invoice_date between date '1997-01-01' and date '1999-12-31'
order by s.invoice_id limit 200""",
)
def _(spark, sf):
    page = lookup.list_invoices(
        v.scored_invoices(spark, sf), v.entities(spark, sf), status="pending", decision="REVIEW", lender="L-3", date_from=FROM, date_to=TO, limit=200
    )
    return _double(page, "amount")


_CASE = "case_id, case_number, invoice_id, decision, severity, fraud_score, primary_signal, created_at"
_CASE_COLS = _CASE.split(", ")


@catalog.add(
    "list_cases",
    f"""select {_CASE} from cases where decision = 'HOLD' and severity = 'critical' and created_at >= timestamp '1997-01-01'
    and created_at < timestamp '2000-01-01' order by created_at desc, case_id limit 200""",
)
def _(spark, sf):
    return lookup.list_cases(
        v.fraud_cases(spark, sf), decision="HOLD", severity="critical", date_from=FROM, date_to=TO, limit=200
    ).select(*_CASE_COLS)


@catalog.add("cases_by_lender", f"select {_CASE} from cases where lender_id = 'L-3'")
def _(spark, sf):
    return lookup.cases_by_lender(v.fraud_cases(spark, sf), v.scored_invoices(spark, sf), lender_id="L-3").select(*_CASE_COLS)


@catalog.add("point_lookup", "select invoice_id, invoice_number, amount::double as amount, fraud_decision from scored where invoice_number = 'INV-50'")
def _(spark, sf):
    hit = lookup.point_lookup(v.scored_invoices(spark, sf), key="invoice_number", value="INV-50")
    return _double(hit.select("invoice_id", "invoice_number", "amount", "fraud_decision"), "amount")


@catalog.add(
    "enrich_names",
    """select invoice_id, coalesce(s.name, '') as supplier_name, coalesce(b.name, '') as buyer_name, l.name as lender_name
from inv left join ent s on s.entity_id = supplier_id left join ent b on b.entity_id = buyer_id left join ent l on l.entity_id = lender_id""",
)
def _(spark, sf):
    return lookup.enrich_names(v.invoices(spark, sf), v.entities(spark, sf)).select(
        "invoice_id", "supplier_name", "buyer_name", "lender_name"
    )


@catalog.add(
    "case_with_invoice",
    """select case_id, i.invoice_number, coalesce(s.name, '') as supplier_name, coalesce(b.name, '') as buyer_name, l.name as lender_name,
  i.amount::double as amount, fraud_score, decision, 0 as cascade_depth
from cases c left join inv i using (invoice_id) left join ent s on s.entity_id = i.supplier_id
left join ent b on b.entity_id = i.buyer_id left join ent l on l.entity_id = i.lender_id""",
)
def _(spark, sf):
    out = lookup.case_with_invoice(v.fraud_cases(spark, sf), v.invoices(spark, sf), v.entities(spark, sf))
    return _double(out, "amount")


@catalog.add("top_risks", "select invoice_id, invoice_number, amount::double as amount, fraud_score from scored order by fraud_score desc, invoice_id limit 10")
def _(spark, sf):
    out = lookup.top_risks(v.scored_invoices(spark, sf).select("invoice_id", "invoice_number", "amount", "fraud_score"))
    return _double(out, "amount")


@catalog.add("recent_alerts", f"select {_CASE} from cases order by created_at desc, case_id limit 20")
def _(spark, sf):
    return lookup.recent_alerts(v.fraud_cases(spark, sf).select(*_CASE_COLS))


@catalog.add("flagged_filter", "select invoice_id, fraud_decision, fraud_score from scored where fraud_decision in ('REVIEW', 'HOLD')")
def _(spark, sf):
    return lookup.flagged_filter(v.scored_invoices(spark, sf).select("invoice_id", "fraud_decision", "fraud_score"))


@catalog.add(
    "entities_for_flagged",
    "select entity_id, name, tier, sector from ent where entity_id in (select supplier_id from scored where fraud_decision in ('REVIEW', 'HOLD'))",
)
def _(spark, sf):
    return lookup.entities_for_flagged(v.scored_invoices(spark, sf), v.entities(spark, sf)).select("entity_id", "name", "tier", "sector")


@catalog.add(
    "soft_delete",
    "select invoice_id, case when fraud_decision = 'HOLD' then 'rejected' else status end as status from scored",
)
def _(spark, sf):
    scored = v.scored_invoices(spark, sf)
    held = scored.where(F.col("fraud_decision") == "HOLD").select("invoice_id")
    return lookup.soft_delete(scored.select("invoice_id", "status"), held)[0]


@catalog.add(
    "network_tier_filter",
    """select distinct 'S-' || supplier_key as src, 'B-' || buyer_key as dst from inv
  join ent s on s.entity_id = supplier_id and s.tier = 2 join ent b on b.entity_id = buyer_id and b.tier = 2""",
)
def _(spark, sf):
    inv, ent = v.invoices(spark, sf), v.entities(spark, sf)
    nodes = ent.select(F.col("entity_id").alias("id"), "tier")
    edges = graph.graph_edges(inv).where(F.col("rel_type") == graph.SUPPLIES).select("src", "dst")
    return lookup.network_tier_filter(nodes, edges, tier=2)[1]


@catalog.add("clean_name", "select entity_id, trim(name) as name from ent where trim(name) <> ''")
def _(spark, sf):
    return entities.clean_name(v.entities(spark, sf).select("entity_id", "name"))[0]


@catalog.add(
    "get_or_create_entities",
    """
select coalesce(known, sha256(entity_type || '|' || name)) as entity_id, entity_type, name, known is null as is_new from (
  select distinct entity_type, trim(name) as name from (
    select 'supplier' as entity_type, supplier_name as name from inv union all select 'buyer', buyer_name from inv
    union all select 'lender', n_name from inv join nation on lender_id = concat('L-', n_nationkey)))
left join (select entity_type, name, min(entity_id) as known from ent where entity_type <> 'lender' group by 1, 2) using (entity_type, name)""",
)
def _(spark, sf):
    known = v.entities(spark, sf).where(F.col("entity_type") != "lender")
    inv = lookup.enrich_names(v.invoices(spark, sf), v.entities(spark, sf)).select("invoice_id", "lender_name")
    named = v.invoices(spark, sf).join(inv, "invoice_id")
    return entities.get_or_create_entities(known, named)


@catalog.add(
    "registration_match",
    """
select s_suppkey as incoming_id, e.entity_id from supplier left join ent e on e.entity_type = 'supplier' and e.name = s_name
  and (s_nationkey < 10 or (s_nationkey < 20 and e.gst = 'GST-S-' || s_suppkey))""",
)
def _(spark, sf):
    s = v.table(spark, sf, "supplier")
    ref = F.concat(F.lit("S-"), "s_suppkey")
    incoming = s.select(
        F.col("s_suppkey").alias("incoming_id"),
        F.lit("supplier").alias("entity_type"),
        F.concat(F.lit(" "), "s_name").alias("name"),
        F.when(F.col("s_nationkey") >= 10, F.concat(F.lit("GST-"), ref)).alias("gst"),
        F.when(F.col("s_nationkey") >= 20, F.concat(F.lit("PAN-OTHER-"), ref)).alias("pan"),
    )
    return entities.registration_match(v.entities(spark, sf), incoming)


@catalog.add(
    "resolve_companies",
    """
with people as (select concat('S-', s_suppkey) as entity_id, 'Company ' || s_suppkey as name from supplier
  union all select concat('B-', c_custkey), ' COMPANY  ' || (c_custkey % (select count(*) from supplier)) from customer)
select entity_id, min(entity_id) over (partition by lower(regexp_replace(trim(name), '\\s+', ' ', 'g'))) as company_id from people""",
)
def _(spark, sf):
    suppliers, customers = v.table(spark, sf, "supplier"), v.table(spark, sf, "customer")
    n = suppliers.agg(F.count(F.lit(1))).scalar()
    people = suppliers.select(
        F.concat(F.lit("S-"), "s_suppkey").alias("entity_id"), F.concat(F.lit("Company "), F.col("s_suppkey").cast("string")).alias("name")
    ).unionByName(
        customers.select(
            F.concat(F.lit("B-"), "c_custkey").alias("entity_id"),
            F.concat(F.lit(" COMPANY  "), (F.col("c_custkey") % n).cast("string")).alias("name"),
        )
    )
    return entities.resolve_companies(people)
