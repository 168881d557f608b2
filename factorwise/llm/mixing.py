"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). In the flow network every pattern
offers its words once per epoch, each epoch dearer than the one before, and may send them to any of its sources, whose
quotas limit what they take. The cheapest flow that fills the quotas says how many words each pattern sends to each
source; seeded selection then turns words into documents.

The network is small: one node per pattern and per source, at most ``MAX_PATTERNS`` (checked). Documents never leave the
executors: positions in the seeded order come from hash-slice totals. The tables that are broadcast have a row per pattern
or source, so the same bound holds for them.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, functions as F

from factorwise.llm.common import attach, cut, fresh, offsets, table, with_content, word_count

#: Most patterns and sources the driver solves for; more is an error, not a cut.
MAX_PATTERNS = 200_000
WEIGHTS = (1, 2, 3)


class Network:
    """Min-cost flow by successive shortest paths with potentials; costs are not negative."""

    def __init__(self, n: int) -> None:
        self.arcs: list[list[int]] = []  # to, capacity left, cost; arc i ^ 1 is the reverse of arc i
        self.out: list[list[int]] = [[] for _ in range(n)]

    def add(self, a: int, b: int, capacity: int, cost: int) -> int:
        self.out[a].append(len(self.arcs))
        self.out[b].append(len(self.arcs) + 1)
        self.arcs += [[b, capacity, cost], [a, 0, -cost]]
        return len(self.arcs) - 2

    def run(self, s: int, t: int) -> int:
        sent, height = 0, [0] * len(self.out)
        while True:
            dist, via = {s: 0}, {}
            queue, done = [(0, s)], set()
            while queue:
                d, a = heapq.heappop(queue)
                if a in done:
                    continue
                done.add(a)
                if a == t:
                    break
                for i in self.out[a]:
                    b, left, cost = self.arcs[i]
                    near = d + cost + height[a] - height[b]
                    if left > 0 and near < dist.get(b, near + 1):
                        dist[b], via[b] = near, i
                        heapq.heappush(queue, (near, b))
            if t not in done:
                return sent
            for a in range(len(height)):
                height[a] += min(dist.get(a, dist[t]), dist[t])
            path, b = [], t
            while b != s:
                path.append(via[b])
                b = self.arcs[via[b] ^ 1][0]
            push = min(self.arcs[i][1] for i in path)
            for i in path:
                self.arcs[i][1] -= push
                self.arcs[i ^ 1][1] += push
            sent += push


def route(patterns: dict[str, tuple[int, list[str]]], quotas: dict[str, int], max_repeats: int = 3) -> dict[str, list[tuple[str, int]]]:
    """Words per (pattern, source). ``patterns``: id -> (words, sources); the e-th epoch of a word costs e * e."""
    names, sources = sorted(patterns), sorted(quotas)
    at = {s: 2 + len(names) + i for i, s in enumerate(sources)}
    net = Network(2 + len(names) + len(sources))
    arcs = {}
    for i, p in enumerate(names, 2):
        words, members = patterns[p]
        for epoch in range(max_repeats):
            net.add(0, i, words, epoch * epoch)
        for s in members:
            arcs[p, s] = net.add(i, at[s], words * max_repeats, 0)
    for s in sources:
        net.add(at[s], 1, quotas[s], 0)
    net.run(0, 1)
    return {p: [(s, net.arcs[arcs[p, s] ^ 1][1]) for s in patterns[p][1] if net.arcs[arcs[p, s] ^ 1][1]] for p in names}


def source_key(source: Column) -> Column:
    """Text that tells a null source from every name."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def targets(sizes: dict[str, int], weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3) -> dict[str, float]:
    """Words per source key: shares of the total by weight, none above max_repeats times its size."""
    order = sorted(sizes, key=lambda s: (s == "", s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, found = float(sum(sizes.values())), set(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > max_repeats * sizes[s]}
        if not full:
            return found | {s: unit * weight[s] for s in open_}
        for s in full:
            found[s] = float(max_repeats * sizes[s])
            left -= found[s]
        open_ -= full
    return found


def mix(rows: DataFrame, quotas: dict[str, int], *, size: str, members: str, key: str, max_repeats: int = 3, seed: int = 29, corrections: int = 4) -> DataFrame:
    """``rows`` with ``served``: the source keys that take a copy of the row, one entry per copy, at most max_repeats.

    ``members``: array of source keys per row. Rows of a pattern stand in seeded order on an axis of words, epoch after
    epoch; each source owns a stretch as long as the flow it gets, and takes the copies whose middle lies in it. A
    source then differs from its quota by half a document at most; ``corrections`` times the one document whose words are
    closest to the difference is added or left out. Rows without words are never taken. No rows in, no rows out.
    """
    n = rows.count()
    pid, h = fresh(rows, "pattern"), fresh(rows, "h")
    rows = rows.withColumn(pid, F.to_json(F.array_sort(F.array_distinct(members)))).withColumn(h, F.xxhash64(F.lit(seed), F.col(key)))
    sums = rows.groupBy(pid).agg(F.sum(size).alias("words"), F.first(members).alias("members"))
    found = sums.limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns; use coarser sources")
    flows = route({r[pid]: (r.words, sorted(set(r.members))) for r in found}, quotas, max_repeats)
    stretches = []
    for p, sent in flows.items():
        end = 0
        parts = []
        for s, words in sent:
            parts.append((s, float(end), float(end + words)))
            end += words
        stretches.append((p, parts))
    spark = rows.sparkSession
    owned = spark.createDataFrame(stretches, f"`{pid}` string, parts array<struct<s: string, a: double, b: double>>")
    placed, before, total = offsets(rows, pid, h, F.col(size), n, [key, size])
    middle = lambda e: e * F.col(total) + F.col(before) + F.col(size) / 2
    taker = lambda e: F.get(F.filter("parts", lambda x: (middle(e) >= x["a"]) & (middle(e) < x["b"])), 0)["s"]
    copies = F.filter(F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), taker), lambda s: s.isNotNull())
    none = F.array().cast("array<string>")
    rows = cut(placed.join(F.broadcast(owned), pid, "left").withColumn("served", F.when(F.col(size) > 0, F.coalesce(copies, none)).otherwise(none)).drop("parts", total))

    for _ in range(corrections):
        have = {r.s: r.words for r in rows.select(F.explode("served").alias("s"), size).groupBy("s").agg(F.sum(size).alias("words")).collect()}
        short = [(s, q - have.get(s, 0)) for s, q in quotas.items() if q != have.get(s, 0)]
        if not short:
            break
        gaps = spark.createDataFrame(short, "s string, gap long")
        spare = (F.size("served") + F.size(F.array_distinct(members)) <= max_repeats) | (
            (F.size("served") < max_repeats) & (F.size(F.array_distinct(members)) == 1)
        )
        offered = rows.filter(F.col(size) > 0).select(
            pid, before, size, h, F.size("served").alias("copies"), spare.alias("spare"), F.explode(F.array_distinct(members)).alias("s"), "served"
        )
        able = offered.join(F.broadcast(gaps), "s").filter(F.when(F.col("gap") > 0, F.col("spare")).otherwise(F.array_contains("served", F.col("s"))))
        off = F.abs(F.abs("gap") - F.col(size))
        best = able.groupBy("s", "gap").agg(F.min(F.struct(off.alias("off"), "copies", h, pid, before)).alias("x"))
        chosen = {}
        for r in best.filter(F.col("x.off") < F.abs("gap")).orderBy("s").collect():
            chosen.setdefault((r.x[pid], r.x[before]), (r.s, r.gap > 0))
        if not chosen:
            break
        change = spark.createDataFrame([(*k, *v) for k, v in chosen.items()], f"`{pid}` string, `{before}` long, s string, more boolean")
        at = F.array_position("served", F.col("s")).cast("int")
        fewer = F.concat(F.slice("served", F.lit(1), at - 1), F.slice("served", at + 1, F.size("served")))
        changed = F.when(F.col("s").isNull() | (F.col(size) == 0), F.col("served")).when(F.col("more"), F.concat("served", F.array("s"))).otherwise(fewer)
        rows = cut(rows.join(F.broadcast(change), [pid, before], "left").withColumn("served", changed).drop("s", "more"))
    return rows.drop(pid, h, before)


def mix_to_weights(rows: DataFrame, *, key: str = "doc_id", source: str = "source", size: str = "size", max_repeats: int = 3, seed: int = 29) -> DataFrame:
    """``rows`` with source_size, target, taken and copies, for one source per row and weights 1, 2, 3, repeating by name.

    A null source is one of its own and comes last. Existing columns of these names are replaced.
    """
    rows = rows.drop("source_size", "target", "taken", "copies", "served")
    name, members = fresh(rows, "name"), fresh(rows, "members")
    kept = rows.columns
    rows = cut(rows.withColumn(name, source_key(F.col(source))).withColumn(members, F.array(name)))
    found = rows.groupBy(name).agg(F.sum(size).alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sources")
    sizes = {r[name]: r.words for r in found}
    goal = targets(sizes, max_repeats=max_repeats)
    mixed = mix(rows, {s: round(t) for s, t in goal.items()}, size=size, members=members, key=key, max_repeats=max_repeats, seed=seed)
    facts = rows.sparkSession.createDataFrame([(s, sizes[s], goal[s]) for s in sizes], f"`{name}` string, source_size long, target double")
    return mixed.join(F.broadcast(facts), name).select(
        *kept, "source_size", "target", (F.size("served") * F.col(size)).alias("taken"), F.size("served").alias("copies")
    )


def mixed_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", max_repeats: int = 3, seed: int = 29) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken (not at all, or up to max_repeats times), columns unchanged.

    Rows without a word have no size, so no quota can ask for them; they are left out.
    """
    docs, content = with_content(docs)
    size, copies, each = (fresh(docs, x) for x in ("size", "copies", "each"))
    narrow = docs.select(key, source, content, word_count(F.col(text)).alias(size))
    plan = mix_to_weights(narrow, key=key, source=source, size=size, max_repeats=max_repeats, seed=seed)
    plan = plan.select(key, content, F.col("copies").alias(copies)).filter(f"`{copies}` >= 0")
    whole = attach(docs, plan, key, content, [copies])
    return whole.filter(f"`{copies}` > 0").withColumn(each, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(copies, each)


def op2_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix_to_weights(rows).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")
