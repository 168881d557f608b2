"""DuckDB text of the derived views, written independently of the Spark plans.

``q(body)`` puts the common table expressions a query mentions in front of it.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}

VIEWS["grp"] = """
select l.l_orderkey as order_id, l.l_suppkey as supplier_key, max(o.o_custkey) as buyer_key,
       max(l_linestatus) as mx, min(l_linestatus) as mn,
       cast(min(l_shipdate) as date) as invoice_date, cast(max(l_shipdate) as date) as delivery_date,
       cast(sum(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(5,2)))
            * (1 + cast(l_tax as decimal(5,2)))) as decimal(18,2)) as amount,
       cast(sum(cast(l_extendedprice as decimal(18,2))) as decimal(18,2)) as gross,
       sum(l_quantity) as quantity,
       sum(case when l_returnflag <> 'R' then l_quantity end) as kept_quantity
from lineitem l join orders o on l.l_orderkey = o.o_orderkey
group by 1, 2"""

VIEWS["items"] = """
select l_orderkey as order_id, l_suppkey as supplier_key, string_agg(p_name, ' ' order by l_linenumber, l_partkey, l_quantity) as names
from lineitem join part on l_partkey = p_partkey group by 1, 2"""

VIEWS["named"] = """
select g.*, s_name as supplier_name, c_name as buyer_name, s_nationkey as lender_key,
       concat(g.order_id, '-', g.supplier_key) as pair
from grp g join supplier on s_suppkey = g.supplier_key join customer on c_custkey = g.buyer_key"""

VIEWS["base"] = """
select pair as invoice_id, concat('INV-', order_id) as invoice_number, order_id, supplier_key, buyer_key,
       concat('S-', supplier_key) as supplier_id, supplier_name, concat('B-', buyer_key) as buyer_id, buyer_name,
       lender_key, concat('PO-', pair) as po_number,
       case when mx = 'O' and mn = 'O' then null else concat('GRN-', pair) end as grn_number,
       invoice_date, amount, quantity
from named"""

VIEWS["inv"] = """
select * exclude (lender_key), concat('L-', lender_key) as lender_id,
       cast(invoice_date + interval 30 day as date) as due_date, 'INR' as currency, 'pending' as status
from (
  select * from base
  union all by name
  select * replace (concat(invoice_id, '-R') as invoice_id, concat('  ', upper(supplier_name)) as supplier_name,
                    (lender_key + 1) % 25 as lender_key) from base where order_id % 50 = 0
  union all by name
  select * replace (concat(invoice_id, '-N') as invoice_id, (lender_key + 1) % 25 as lender_key,
                    cast(amount * cast(1.01 as decimal(5,2)) as decimal(18,2)) as amount,
                    cast(invoice_date + interval 1 day as date) as invoice_date) from base where order_id % 70 = 0
)"""

VIEWS["po"] = """
select concat('PO-', pair) as po_number, gross as amount, quantity, buyer_name,
       case when order_id % 7 = 0 then concat(supplier_name, ' Ltd')
            when order_id % 3 = 0 then lower(supplier_name) else supplier_name end as supplier_name
from named where order_id % 9 <> 0"""

VIEWS["grn"] = """
select concat('GRN-', pair) as grn_number, delivery_date, kept_quantity as quantity, supplier_name, buyer_name from named"""

VIEWS["ent"] = """
select concat(p, '-', k) as entity_id, entity_type, name, concat('GST-', p, '-', k) as gst, concat('PAN-', p, '-', k) as pan,
       case when k % 17 <> 0 then cast(k % 3 + 1 as integer) end as tier, sector, 0.0::double as risk_score, false as is_flagged
from (
  select 'supplier' as entity_type, 'S' as p, s_suppkey as k, s_name as name, case when s_suppkey % 13 <> 0 then r_name end as sector
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  union all select 'buyer', 'B', c_custkey, c_name, c_mktsegment from customer
  union all select 'lender', 'L', n_nationkey, n_name, null from nation
)"""

VIEWS["fp"] = """
select invoice_id, invoice_date, sha256('{"amount":"' || cast(amount as varchar) || '","buyer_name":"' || lower(trim(buyer_name))
  || '","invoice_date":"' || cast(invoice_date as varchar) || '","invoice_number":"' || lower(invoice_number)
  || '","po_number":"' || lower(po_number) || '","supplier_name":"' || lower(trim(supplier_name)) || '"}') as sha256
from inv"""

VIEWS["exact"] = """
select invoice_id, sha256, row_number() over w > 1 as is_exact_duplicate, first_value(invoice_id) over w as first_invoice_id
from fp window w as (partition by sha256 order by invoice_date, invoice_id)"""

VIEWS["bins"] = """
select invoice_id, case when amount <= 1000 then 'amount_bin_1000' when amount <= 5000 then 'amount_bin_5000'
  when amount <= 10000 then 'amount_bin_10000' when amount <= 50000 then 'amount_bin_50000'
  when amount <= 100000 then 'amount_bin_100000' when amount <= 500000 then 'amount_bin_500000'
  when amount <= 1000000 then 'amount_bin_1000000' else 'amount_bin_gt_1000000' end as amount_bin
from inv"""

VIEWS["tok"] = r"""
select invoice_id, list_sort(list_distinct(regexp_extract_all(lower(concat_ws(' ', invoice_number, supplier_name, buyer_name,
  amount_bin, cast(invoice_date as varchar), po_number, names)), '\b[\w\-]+\b'))) as tokens
from inv join bins using (invoice_id) join items using (order_id, supplier_key)"""

VIEWS["member"] = """
select invoice_id, md5(array_to_string(tokens, chr(31))) as set_id, tokens from tok"""

VIEWS["sets"] = """
select set_id, any_value(tokens) as tokens, count(*) as members, len(any_value(tokens)) as n from member group by 1"""

VIEWS["tok_ids"] = """
select token, row_number() over (order by df, token) as tid
from (select token, count(*) as df from (select unnest(tokens) as token from sets) group by 1)"""

VIEWS["int_sets"] = """
select set_id, any_value(members) as members, any_value(n) as n, list_sort(list(tid)) as ids
from (select set_id, members, n, unnest(tokens) as token from sets) join tok_ids using (token) group by 1"""

VIEWS["probes"] = """
select set_id, n, unnest(ids[1:k]) as tid, unnest(range(1, k + 1)) as pos
from (select *, cast(n - ceil(0.7 * n - 1e-9) + 1 as bigint) as k from int_sets)"""

# rarest tokens first: the smaller set's first tokens meet the larger set's, where the rest of both can still hold the overlap
VIEWS["pairs"] = """
select set_a, set_b, jaccard, members_a, members_b from (
  select c.set_a, c.set_b, a.members as members_a, b.members as members_b, len(list_intersect(a.ids, b.ids)) as o,
    o / (a.n + b.n - o)::double as jaccard
  from (select distinct least(p.set_id, r.set_id) as set_a, greatest(p.set_id, r.set_id) as set_b
        from probes p join probes r on p.tid = r.tid and p.set_id <> r.set_id and p.n <= r.n and p.n >= 0.7 * r.n - 1e-9
          and p.pos <= p.n - ceil(1.4 / 1.7 * p.n - 1e-9) + 1
          and least(p.n - p.pos, r.n - r.pos) + 1 >= ceil(0.7 / 1.7 * (p.n + r.n) - 1e-9)) c
  join int_sets a on a.set_id = c.set_a join int_sets b on b.set_id = c.set_b
) where jaccard >= 0.7"""

VIEWS["nearrank"] = """
select invoice_id, match_id, similarity, row_number() over (partition by invoice_id order by similarity desc, match_id) as r
from (
  select x.invoice_id, y.invoice_id as match_id, s.jaccard as similarity
  from (select set_a, set_b, jaccard from pairs union all select set_b, set_a, jaccard from pairs
        union all select set_id, set_id, 1.0 from sets where members > 1) s
  join member x on x.set_id = s.set_a join inv xi on xi.invoice_id = x.invoice_id
  join member y on y.set_id = s.set_b join inv yi on yi.invoice_id = y.invoice_id
  where yi.invoice_date < xi.invoice_date or (yi.invoice_date = xi.invoice_date and y.invoice_id < x.invoice_id)
)"""

VIEWS["near"] = """
select invoice_id, max(similarity) as similarity, string_agg(match_id, ',' order by r) filter (where r <= 5) as matches
from nearrank group by 1"""

VIEWS["counts"] = """
select invoice_id, sum(others) as candidate_count from member join (
  select set_id, members - 1 as others from sets
  union all select set_a, members_b from pairs union all select set_b, members_a from pairs) using (set_id) group by 1"""

VIEWS["risk"] = """
select invoice_id, is_exact_duplicate,
  case when is_exact_duplicate then 1.0 else coalesce(similarity, 0) end::double as duplicate_risk_score,
  case when is_exact_duplicate then 'sha256' when similarity is not null then 'lsh' else 'none' end as method,
  coalesce(matches, '') as matches
from exact left join near using (invoice_id)"""

VIEWS["docs3"] = """
select i.*, p.po_number as po_ref, p.amount as po_amount, p.quantity as po_quantity, lower(trim(p.supplier_name)) as po_supplier,
  g.grn_number as grn_ref, g.delivery_date, g.quantity as grn_quantity, p.po_number is not null as has_po, g.grn_number is not null as has_grn,
  lower(trim(i.supplier_name)) as own_supplier,
  abs(i.amount::double - p.amount::double) / greatest(abs(p.amount::double), 1.0::double) as amount_gap,
  abs(i.quantity - p.quantity) / greatest(abs(p.quantity), 1.0::double) as po_qty_gap,
  abs(i.quantity - g.quantity) / greatest(abs(g.quantity), 1.0::double) as grn_qty_gap,
  i.invoice_date - g.delivery_date as days_diff
from inv i left join po p on lower(i.po_number) = lower(p.po_number) left join grn g on lower(i.grn_number) = lower(g.grn_number)"""

VIEWS["checks"] = """
select *,
  case when has_po then amount_gap <= 0.02e0 end as ok_amount,
  case when has_po then (case when own_supplier = po_supplier then 1.0 when starts_with(po_supplier, own_supplier)
      then 2.0 * length(own_supplier) / (length(own_supplier) + length(po_supplier)) else 0 end) >= 0.8 end as ok_supplier,
  case when has_po then po_qty_gap <= 0.05e0 end as ok_po_qty,
  case when has_grn then coalesce(days_diff between -3 and 30, false) end as ok_days,
  case when has_grn and grn_quantity is not null then grn_qty_gap <= 0.05e0 end as ok_grn_qty
from docs3"""

VIEWS["fields"] = """
select invoice_id, grn_number, has_po, has_grn,
  case when has_po then round((3 + ok_amount::int + ok_supplier::int + coalesce(ok_po_qty::int, 0)) / (5.0 + (ok_po_qty is not null)::int)::double, 4) end as po_score,
  case when has_grn then round((3 + ok_days::int + coalesce(ok_grn_qty::int, 0)) / (4.0 + (ok_grn_qty is not null)::int)::double, 4) end as grn_score,
  list_filter([
    case when not has_po then 'NO_PO_FOUND: Invoice references a PO that does not exist' end,
    case when not has_grn then 'NO_GRN_FOUND: No goods receipt note found for this invoice' end,
    case when not ok_amount then 'PO_AMOUNT_MISMATCH' end,
    case when not ok_supplier then 'PO_SUPPLIER_MISMATCH' end,
    case when not ok_po_qty then 'PO_LINE_ITEM_QUANTITY_MISMATCH' end,
    case when not ok_days then 'GRN_DELIVERY_BEFORE_INVOICE_MISMATCH' end,
    case when not ok_grn_qty then 'GRN_LINE_ITEM_QUANTITY_MISMATCH' end], lambda x: x is not null) as anomalies
from checks"""

VIEWS["match"] = """
select *, len(anomalies) as anomaly_count, overall >= 0.8 and len(anomalies) = 0 as passed from (
  select *, coalesce(round((coalesce(po_score, 0) + coalesce(grn_score, 0)) / nullif((po_score is not null)::int + (grn_score is not null)::int, 0), 4), 0)::double as overall
  from fields)"""

VIEWS["scored"] = """
select *, case when fraud_score >= 0.7 then 'HOLD' when fraud_score >= 0.3 then 'REVIEW' else 'PASS' end as fraud_decision,
  case when fraud_score >= 0.9 then 'critical' when fraud_score >= 0.75 then 'high' when fraud_score >= 0.5 then 'medium' else 'low' end as severity
from (
  select inv.*, sha256, r.is_exact_duplicate, duplicate_risk_score, method as duplicate_method, matches, candidate_count,
    po_score as po_match_score, grn_score as grn_match_score, overall as match_score, anomalies, anomaly_count, passed,
    list_filter([case when r.is_exact_duplicate or duplicate_risk_score >= 0.85 then 'duplicate_financing' end,
                 case when not passed and m.grn_number is null then 'phantom_invoice' end], lambda x: x is not null) as fraud_patterns,
    round(least(duplicate_risk_score * 0.5e0 + (1e0 - overall) * 0.3e0 + case when r.is_exact_duplicate then 0.4e0 else 0e0 end, 1e0), 6) as fraud_score
  from inv join exact e using (invoice_id) join risk r using (invoice_id) join counts using (invoice_id) join match m using (invoice_id)
)"""

VIEWS["flagged"] = """select * from scored where fraud_decision <> 'PASS'"""

VIEWS["cases"] = """
select *, 'SCF-' || year(created_at) || '-' || lpad(cast(position as varchar), 6, '0') as case_number
from (
  select sha256('case|' || invoice_id) as case_id, invoice_id, invoice_number, amount, lender_id, fraud_patterns, fraud_score,
    fraud_decision as decision, severity, coalesce(fraud_patterns[1], 'UNKNOWN') as primary_signal,
    cast(invoice_date as timestamp) as created_at, '' as alert_narrative,
    row_number() over (partition by year(invoice_date) order by invoice_date, substr(md5(invoice_id), 1, 3), invoice_id) as position
  from flagged)"""

VIEWS["edges"] = """
select cast(date_trunc('week', invoice_date) as date) as week, supplier_key as src, buyer_key % (select count(*) from supplier) as dst,
  count(*) as invoice_count, sum(amount) as amount, min(invoice_date) as since
from inv where supplier_key <> buyer_key % (select count(*) from supplier) group by 1, 2, 3"""

VIEWS["trades"] = """
select invoice_date as day, supplier_key as src, buyer_key % (select count(*) from supplier) as dst, count(*) as invoice_count
from inv where supplier_key <> buyer_key % (select count(*) from supplier) group by 1, 2, 3"""

VIEWS["hops7"] = """
select distinct cast(day - k::int as date) as window_start, src, dst from trades, range(7) r(k)"""

# every walk from a window's first trades, from the end of the trade on
VIEWS["ring"] = """
select distinct window_start, list_concat(members[pos:], members[1:pos - 1]) as members, len(members) as ring_length from (
  select window_start, members, list_position(members, list_min(members)) as pos from (
    with recursive walk(window_start, u, node, path) as (
      select day, src, dst, [src, dst] from trades
      union all
      select w.window_start, w.u, h.dst, list_append(w.path, h.dst) from walk w join hops7 h on h.window_start = w.window_start and h.src = w.node
      where len(w.path) < 6 and not list_contains(w.path, h.dst))
    select w.window_start, w.path as members from walk w join hops7 h on h.window_start = w.window_start and h.src = w.node and h.dst = w.u))"""

VIEWS["ring_day"] = """
select company, day, count(*) as ring_count from (
  select day, unnest(members) as company from (select distinct cast(window_start + k::int as date) as day, members from ring, range(7) r(k))) group by 1, 2"""

VIEWS["rooted"] = """
select invoice_id, supplier_key as company, invoice_date, amount from inv"""

VIEWS["hops5"] = """
select distinct cast(day + k::int as date) as root_date, src, dst from trades, range(-3, 2) r(k)"""

VIEWS["reach"] = """
select root_date, source, node from (
  with recursive r(root_date, source, node) as (
    select h.root_date, h.src, h.dst from hops5 h semi join rooted o on o.invoice_date = h.root_date and o.company = h.src
    union select r.root_date, r.source, h.dst from r join hops5 h on h.root_date = r.root_date and h.src = r.node)
  select * from r)"""

VIEWS["offered"] = """
select d.root_date, company as node, count(*) as n, sum(amount) as total
from rooted join (select distinct invoice_date as root_date from rooted) d on invoice_date between d.root_date - 1 and d.root_date + 3 group by 1, 2"""

VIEWS["cascade"] = """
select o.invoice_id, n - own::int as cascade_depth, (total - case when own then o.amount else 0 end)::double as exposure
from rooted o join (
  select root_date, source, sum(n) as n, sum(total) as total, bool_or(source = node) as own from reach join offered using (root_date, node) group by 1, 2) k
  on k.root_date = o.invoice_date and k.source = o.company where n > own::int"""

VIEWS["feed"] = """
select invoice_id as feed_id, order_id, concat('feed-', supplier_key % 10, '.csv') as source_file, order_id % 101 = 0 as blank,
  case when order_id % 101 <> 0 then invoice_number end as invoice_no,
  case when order_id % 101 <> 0 then concat(' ', supplier_name, ' ') end as vendor_name,
  case when order_id % 101 = 0 then null when order_id % 89 = 0 then '  ' else buyer_name end as customer,
  case when order_id % 101 = 0 then null when order_id % 97 = 0 then 'n/a' else 'INR ' || format('{:,.2f}', amount::double) end as total_amount,
  case when order_id % 101 = 0 then null when order_id % 83 = 0 then '31/31/2000'
       when order_id % 5 = 0 then strftime(invoice_date, '%Y-%m-%d') when order_id % 5 = 1 then strftime(invoice_date, '%d/%m/%Y')
       when order_id % 5 = 2 then strftime(invoice_date, '%d-%m-%Y') when order_id % 5 = 3 then strftime(invoice_date, '%d-%b-%Y')
       else strftime(invoice_date, '%d/%m/%y') end as order_date,
  case when order_id % 101 <> 0 then po_number end as po_no,
  case when order_id % 101 <> 0 then grn_number end as grn_no,
  case when order_id % 101 <> 0 and order_id % 4 = 0 then 'inr' end as currency_code,
  case when order_id % 101 <> 0 and order_id % 3 = 0 then concat('L-', lender_key) end as financier_name,
  case when order_id % 101 <> 0 then '  ' end as payment_type
from base"""

VIEWS["ingested"] = """
select feed_id, source_file, invoice_no as invoice_number, trim(vendor_name) as supplier_name, coalesce(trim(customer), '') as buyer_name,
  try_cast(regexp_replace(total_amount, '[^0-9.\\-]', '', 'g') as decimal(18,2)) as amount,
  case when order_date like '____-__-__' then try_strptime(order_date, '%Y-%m-%d')
       when order_date like '__/__/____' then try_strptime(order_date, '%d/%m/%Y')
       when order_date like '__-__-____' then try_strptime(order_date, '%d-%m-%Y')
       when order_date like '__-___-____' then try_strptime(order_date, '%d-%b-%Y')
       else try_strptime(order_date, '%d/%m/%y') end::date as invoice_date,
  po_no as po_number, grn_no as grn_number, upper(coalesce(currency_code, 'INR')) as currency, coalesce(financier_name, '') as lender_name
from feed where not blank"""

VIEWS["rejects"] = """
select feed_id, source_file, list_filter([
  case when coalesce(buyer_name, '') = '' then 'buyer_name' end,
  case when amount is null or amount <= 0 then 'amount' end,
  case when invoice_date is null then 'invoice_date' end], lambda x: x is not null) as reasons
from ingested"""

VIEWS["rows_"] = """
select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as row_id, l_suppkey as supplier_key, cast(l_shipdate as date) as ship_date,
  l_extendedprice * (1.0::double - l_discount) as amount, l_extendedprice as order_item_total,
  case when l_orderkey % 37 <> 0 then l_extendedprice * (1.0::double - l_discount) - 0.8::double * p_retailprice * l_quantity end as profit,
  l_discount as discount_rate, l_quantity as quantity, p_retailprice as unit_price, (l_linenumber + 1)::double as scheduled_ship_days,
  (cast(l_shipdate as date) - cast(o_orderdate as date))::double as actual_ship_days,
  c_mktsegment as customer_segment, r_name as order_region, n_name as market, p_brand as department, p_type as category,
  o_orderpriority as shipping_mode, l_linestatus as payment_type,
  case when l_returnflag = 'R' then 'CANCELLED' else 'COMPLETE' end as order_status,
  (l_discount > 0.06::double and l_quantity > 40)::int as label
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join part on l_partkey = p_partkey
join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""

VIEWS["orderf"] = """
select *, case when amount > 0 then least(greatest(profit / amount, -5), 5) else 0 end as profit_margin,
  case when computed_total > 0 then least(greatest(amount / computed_total, 0), 5) else 1 end as amount_vs_computed
from (select *, least(greatest(actual_ship_days - scheduled_ship_days, -10), 30) as shipment_delay,
  quantity * unit_price as computed_total from rows_)"""

VIEWS["sl"] = """
select d.doc_id as id, round((n_chars % 1000) / 1000.0::double, 3) as score, toxic::int as label, quality::int as quality, n_chars
from documents d join labels using (doc_id)"""

VIEWS["vec"] = """
select cast(vec_id as varchar) as id, embedding as vector, concat('ns', label % 3) as namespace, label from embeddings"""


def q(body: str) -> str:
    """Query text with the views it uses, in dependency order."""
    needed: list[str] = []

    def visit(text: str, own: str | None = None) -> None:
        for name in VIEWS:
            if name != own and name not in needed and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name], name)
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    ctes = ",\n".join(f"{n} as materialized ({VIEWS[n].strip()})" for n in needed)  # one plan for a view, whatever reads it
    body = body.strip()
    own = re.match(r"with( recursive)?\s+", body)
    if own:  # the query brings common table expressions of its own
        return f"with{own.group(1) or ''} {ctes},\n{body[own.end():]}"
    return f"with {ctes}\n{body}"
