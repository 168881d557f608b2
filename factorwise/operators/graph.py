"""Trade graph: nodes, edges, rings, cascades, neighbourhoods, concentration.

Edges are (src, dst, ...) rows. Path algorithms take ``slices``: columns that
cut the edges into independent graphs (a trading week, say). All joins carry
them, so a long history costs its length and not its square.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from factorwise.plans.materialise import cut_lineage, written

SUPPLIES, ISSUED, FINANCED = "SUPPLIES_TO", "ISSUED", "FINANCED_BY"
DEFAULT_DATE = "2024-01-01"
CAROUSEL_PATTERN, CASCADE_PATTERN = "carousel_trade", "cascade_amplification"


def graph_nodes(ent: DataFrame, inv: DataFrame) -> DataFrame:
    """Company and invoice nodes in one table."""
    companies = ent.select(
        F.col("entity_id").alias("id"), F.col("entity_type").alias("node_type"), "name", "risk_score", "is_flagged", "tier", "sector"
    )
    invoices = inv.select(
        F.col("invoice_id").alias("id"),
        F.lit("invoice").alias("node_type"),
        F.col("invoice_number").alias("name"),
        F.coalesce(F.col("fraud_score"), F.lit(0.0)).alias("risk_score") if "fraud_score" in inv.columns else F.lit(0.0).alias("risk_score"),
        F.col("amount").cast("double").alias("amount"),
        F.coalesce("invoice_date", F.lit(DEFAULT_DATE).cast("date")).alias("date"),
        "status",
    )
    return companies.unionByName(invoices, allowMissingColumns=True)


def graph_edges(inv: DataFrame) -> DataFrame:
    """Aggregated supply edges plus one issue edge and one finance edge per invoice."""
    both = inv.where(F.col("supplier_id").isNotNull() & F.col("buyer_id").isNotNull())
    amount = F.sum(F.col("amount").cast("decimal(38,2)")).cast("double").alias("amount")
    supplies = both.groupBy(F.col("supplier_id").alias("src"), F.col("buyer_id").alias("dst")).agg(
        F.count(F.lit(1)).alias("invoice_count"), amount, F.min("invoice_date").alias("since")
    ).withColumn("rel_type", F.lit(SUPPLIES))

    def single(frame: DataFrame, src: str, dst: str, rel: str) -> DataFrame:
        return frame.select(
            F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(1).cast("long").alias("invoice_count"),
            F.col("amount").cast("double").alias("amount"), F.col("invoice_date").alias("since"), F.lit(rel).alias("rel_type"),
        )

    issued = single(both, "supplier_id", "invoice_id", ISSUED)
    financed = single(inv.where(F.col("lender_id").isNotNull()), "invoice_id", "lender_id", FINANCED)
    return supplies.unionByName(issued).unionByName(financed)


def graph_upsert(
    nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Merge a batch: known risk scores survive, edge counts and amounts add up."""
    attrs = [c for c in nodes.columns if c != "id"]
    tagged = nodes.withColumn("_v", F.lit(0)).unionByName(new_nodes.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_v"))).alias(c) for c in attrs if c != "risk_score"]
    risk = F.max_by("risk_score", F.when(F.col("risk_score") > 0, F.col("_v") + 1).otherwise(0)).alias("risk_score")
    merged = tagged.groupBy("id").agg(*newest, risk).select(*nodes.columns)
    all_edges = edges.unionByName(new_edges.select(*edges.columns))
    linked = all_edges.groupBy("src", "dst", "rel_type").agg(
        F.sum("invoice_count").alias("invoice_count"), F.sum("amount").alias("amount"), F.min("since").alias("since")
    )
    return merged, linked.select(*edges.columns)


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts by node type and edge type, with a total each."""

    def counts(df: DataFrame, kind: str, column: str) -> DataFrame:
        return df.rollup(column).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(kind).alias("kind"), F.coalesce(column, F.lit("all")).alias("type"), "n"
        )

    return counts(nodes, "node", "node_type").unionByName(counts(edges, "edge", "rel_type"))


# --------------------------------------------------------------------- rings


def _prune(edges: DataFrame, slices: list[str], rounds: int = 2) -> DataFrame:
    """Drop edges whose start nobody supplies or whose end supplies nobody."""
    for _ in range(rounds):
        heads = edges.select(*slices, F.col("dst").alias("src")).distinct()
        edges = edges.join(heads, [*slices, "src"], "left_semi")
        tails = edges.select(*slices, F.col("src").alias("dst")).distinct()
        edges = edges.join(tails, [*slices, "dst"], "left_semi")
    return edges


def carousel_rings(edges: DataFrame, *, max_len: int = 6, slices: Sequence[str] = ()) -> DataFrame:
    """All simple directed rings of 2..max_len companies, each once: [slices], members, ring_length.

    A ring is written from its smallest member. Instead of walking whole rings,
    forward half-paths and backward half-paths from that member are built (at
    most max_len/2 hops each) and joined at the node where they meet: the
    intermediate results grow with the cube, not the fifth power, of the degree.
    """
    slices = list(slices)
    plain = edges.where(F.col("src") != F.col("dst")).select(*slices, "src", "dst").distinct()
    plain = cut_lineage(_prune(plain, slices))
    step = plain.select(*slices, F.col("src").alias("mid"), F.col("dst").alias("next"))
    back = plain.select(*slices, F.col("dst").alias("mid"), F.col("src").alias("next"))

    def extend(paths: DataFrame, hop: DataFrame) -> DataFrame:
        fits = (F.col("next") > F.col("start")) & ~F.array_contains("path", F.col("next"))
        return paths.join(hop, [*slices, "mid"]).where(fits).select(
            *slices, "start", F.col("next").alias("mid"), F.concat("path", F.array("next")).alias("path")
        )

    def halves(first: DataFrame, hop: DataFrame, depth: int) -> list[DataFrame]:
        out = [first]
        for _ in range(depth - 1):
            out.append(cut_lineage(extend(out[-1], hop)))
        return out

    longest = (max_len + 1) // 2
    forward = halves(
        plain.where(F.col("dst") > F.col("src")).select(*slices, F.col("src").alias("start"), F.col("dst").alias("mid"), F.array("dst").alias("path")),
        step, longest,
    )
    backward = halves(
        plain.where(F.col("src") > F.col("dst")).select(*slices, F.col("dst").alias("start"), F.col("src").alias("mid"), F.array("src").alias("path")),
        back, max_len // 2,
    )
    rings = []
    for length in range(2, max_len + 1):
        a = forward[(length + 1) // 2 - 1]
        b = backward[length // 2 - 1].select(*slices, "start", "mid", F.col("path").alias("tail"))
        # Both halves end in ``mid``; the tail's inner nodes are everything before it.
        inner = F.reverse(F.slice("tail", 1, length // 2 - 1))
        met = a.join(b, [*slices, "start", "mid"]).withColumn("_inner", inner)
        met = met.where(~F.arrays_overlap("path", "_inner"))
        rings.append(
            met.select(*slices, F.concat(F.array("start"), "path", "_inner").alias("members"), F.lit(length).alias("ring_length"))
        )
    return reduce(DataFrame.unionByName, rings)


def ring_membership(rings: DataFrame, *, slices: Sequence[str] = ()) -> DataFrame:
    """[slices], company, ring_count of every company that is in a ring."""
    return rings.select(*slices, F.explode("members").alias("company")).groupBy(*slices, "company").agg(
        F.count(F.lit(1)).alias("ring_count")
    )


# -------------------------------------------------------------- reachability


def reachability(
    edges: DataFrame, *, sources: DataFrame | None = None, max_hops: int | None = None, slices: Sequence[str] = ()
) -> DataFrame:
    """Nodes reachable in 1..max_hops hops (None: any number) with the fewest hops: [slices], source, node, hops.

    Semi-naive: only pairs new in the last round are extended. ``sources``
    ([slices], source) limits the starting nodes.
    """
    slices = list(slices)
    plain = edges.select(*slices, "src", "dst").distinct()
    first = plain.select(*slices, F.col("src").alias("source"), F.col("dst").alias("node"))
    if sources is not None:
        first = first.join(sources.select(*slices, "source").distinct(), [*slices, "source"], "left_semi")
    keys = [*slices, "source", "node"]
    visited = frontier = cut_lineage(first.withColumn("hops", F.lit(1)))
    hop = plain.select(*slices, F.col("src").alias("node"), F.col("dst").alias("next"))
    depth = 1
    while max_hops is None or depth < max_hops:
        depth += 1
        reached = (
            frontier.join(hop, [*slices, "node"])
            .select(*slices, "source", F.col("next").alias("node"))
            .distinct()
            .join(visited.select(*keys), keys, "left_anti")
        )
        frontier = cut_lineage(reached.withColumn("hops", F.lit(depth)))
        if max_hops is None and frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def cascade_trace(
    roots: DataFrame, inv: DataFrame, edges: DataFrame, *, hours: int = 72, max_hops: int | None = None, slice_col: str = "week"
) -> DataFrame:
    """Number and summed amount of the invoices downstream of each root: invoice_id, cascade_depth, exposure.

    roots and inv: invoice_id, company, invoice_date, amount, <slice_col> (a date,
    the Monday of the trading week). Downstream invoices are issued by companies
    reachable from the root's company in the root's slice and dated one day
    before to ``hours`` after the root; the root itself does not count.

    Counts and sums per company and day are all that travels: roots of one
    company and day share their answer, and no list of invoices is ever built.
    """
    days = hours // 24
    daily = inv.groupBy("company", "invoice_date").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("decimal(38,2)").alias("amount"))
    # A day serves roots dated from day - days to day + 1, so all slices between those.
    monday = lambda d: F.date_trunc("week", F.date_add("invoice_date", d)).cast("date")
    served = F.sequence(monday(-days), monday(1), F.expr("interval 7 days"))
    offered = daily.withColumn(slice_col, F.explode(served)).withColumnRenamed("company", "node")
    sources = roots.select(slice_col, F.col("company").alias("source")).distinct()
    reach = cut_lineage(reachability(edges, sources=sources, max_hops=max_hops, slices=[slice_col]).select(slice_col, "source", "node"))
    totals = lambda: (F.sum("n").alias("n"), F.sum("amount").cast("decimal(38,2)").alias("total"))
    by_day = reach.join(offered, [slice_col, "node"]).groupBy(slice_col, "source", "invoice_date").agg(*totals()).withColumnRenamed("total", "amount")
    # A source has at most seven root days in a slice, and as many days as the window serves them.
    root_days = roots.select(slice_col, F.col("company").alias("source"), F.col("invoice_date").alias("root_date")).distinct()
    keys = [slice_col, "source", "root_date"]
    in_window = F.col("invoice_date").between(F.date_sub("root_date", 1), F.date_add("root_date", days))
    found = by_day.join(root_days, [slice_col, "source"]).where(in_window).groupBy(*keys).agg(*totals())
    circular = reach.where("source = node").select(slice_col, "source", F.lit(True).alias("own"))
    joined = (
        roots.select("invoice_id", "amount", slice_col, F.col("company").alias("source"), F.col("invoice_date").alias("root_date"))
        .join(found, keys, "left")
        .join(circular, [slice_col, "source"], "left")
    )
    own = F.coalesce("own", F.lit(False))
    return joined.select(
        "invoice_id",
        (F.coalesce("n", F.lit(0)) - F.when(own, 1).otherwise(0)).cast("long").alias("cascade_depth"),
        (F.coalesce("total", F.lit(0)) - F.when(own, F.col("amount")).otherwise(0)).cast("double").alias("exposure"),
    )


def ego_network(
    edges: DataFrame, *, depth: int = 2, centers: DataFrame | None = None, slices: Sequence[str] = ()
) -> DataFrame:
    """Members of each centre's undirected neighbourhood: [slices], center_id, node_id, hop (0 = centre).

    A round adds what one more hop reaches and keeps the fewest hops of each pair: one join and one aggregation.
    """
    slices = list(slices)
    if depth < 1:
        raise ValueError("depth must be at least 1")
    both = edges.select(*slices, "src", "dst").unionByName(edges.select(*slices, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    starts = both.select(*slices, F.col("src").alias("source")).distinct()
    near = both.select(*slices, F.col("src").alias("source"), F.col("dst").alias("node"), F.lit(1).alias("hops"))
    if centers is not None:
        wanted = centers.select(*slices, "source").distinct()
        starts, near = (rows.join(wanted, [*slices, "source"], "left_semi") for rows in (starts, near))
    step = both.select(*slices, F.col("src").alias("node"), F.col("dst").alias("next"))
    for d in range(2, depth + 1):
        last = near if d == 2 else near.where(F.col("hops") == d - 1)
        farther = last.join(step, [*slices, "node"]).select(*slices, "source", F.col("next").alias("node"), F.lit(d).alias("hops"))
        near = near.unionByName(farther).groupBy(*slices, "source", "node").agg(F.min("hops").alias("hops"))
        near = written(near) if d < depth else near
    own = starts.select(*slices, "source", F.col("source").alias("node"), F.lit(0).alias("hops"))
    return near.where(F.col("source") != F.col("node")).unionByName(own).select(
        *slices, F.col("source").alias("center_id"), F.col("node").alias("node_id"), F.col("hops").alias("hop")
    )


def ego_edges(members: DataFrame, edges: DataFrame, *, slices: Sequence[str] = ()) -> DataFrame:
    """Edges with both ends inside the same neighbourhood: [slices], center_id, src, dst, weight."""
    slices = list(slices)
    inside = members.select(*slices, "center_id", "node_id")
    return (
        edges.select(*slices, "src", "dst", F.col("invoice_count").alias("weight"))
        .join(inside.withColumnRenamed("node_id", "src"), [*slices, "src"])
        .join(inside.withColumnRenamed("node_id", "dst"), [*slices, "center_id", "dst"], "left_semi")
        .select(*slices, "center_id", "src", "dst", "weight")
    )


def lender_concentration(inv: DataFrame, *, n: int = 20) -> DataFrame:
    """Largest suppliers by financed amount for every lender."""
    totals = inv.where(F.col("lender_id").isNotNull()).groupBy("lender_id", "supplier_id").agg(
        F.sum("amount").alias("total_financed"), F.count(F.lit(1)).alias("invoice_count")
    )
    order = W.partitionBy("lender_id").orderBy(F.desc("total_financed"), "supplier_id")
    return totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def neighbour_mean_features(edges: DataFrame, feats: DataFrame, names: Sequence[str], *, rounds: int = 2) -> DataFrame:
    """Own features joined with ``rounds`` of mean neighbour features, L2-normalised: id, f_0, f_1, ...

    Messages run along src -> dst. Each round is one aggregation with map-side
    combine, so a hub with a third of all edges is pre-averaged before the shuffle.
    """
    links = edges.select("src", "dst").distinct()
    layer, out, columns = feats.select("id", *names), feats.select("id", *names), list(names)
    for r in range(1, rounds + 1):
        mean = (
            links.join(layer.withColumnRenamed("id", "src"), "src")
            .groupBy(F.col("dst").alias("id"))
            .agg(*[F.avg(c).alias(c) for c in names])
        )
        layer = feats.select("id").join(mean, "id", "left").select("id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names])
        columns += [f"{c}_{r}" for c in names]
        out = out.join(layer.select("id", *[F.col(c).alias(f"{c}_{r}") for c in names]), "id")
    length = F.sqrt(reduce(Column.__add__, [F.col(c) * F.col(c) for c in columns]))
    return out.select(
        "id", *[F.coalesce(F.try_divide(F.col(c), length), F.lit(0.0)).alias(f"f_{i}") for i, c in enumerate(columns)]
    )


def graph_flags(findings: DataFrame) -> DataFrame:
    """findings: invoice_id, has_carousel, has_cascade."""
    patterns = F.array_compact(
        F.array(F.when(F.col("has_carousel"), CAROUSEL_PATTERN), F.when(F.col("has_cascade"), CASCADE_PATTERN))
    )
    return findings.select("invoice_id", F.explode(patterns).alias("pattern"))
