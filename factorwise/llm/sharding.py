"""Sharding by proportional stratified interleaving.

Rows of a source are shuffled by a seeded hash and ranked; the row of rank r among n stands at (2r - 1) / 2n.
Sorting all rows by that fraction spreads every source evenly over the order, so equal cuts of it hold the mixture.

Scale: neither the rank inside a source nor the position in the whole order is found in one task. Hash range and
fraction range are cut into 4 * sqrt(rows) slices each; slice totals give the offsets, and only the rows of one
slice are sorted together. Both the table of totals and the largest sort grow with the square root of the input.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from factorwise.llm.common import attach, cut, fresh, offsets, table, with_content


def assign_shards(rows: DataFrame, *, key: str = "doc_id", source: str = "source", n_shards: int = 16, seed: int = 17) -> DataFrame:
    """``rows`` with ``shard`` (0 to n_shards - 1), ``slot`` (gapless from 0 in each shard) added.

    Shard sizes differ by one row at most, and every source's rows in a shard differ from its share by at most
    about one row. A null source is a source of its own; null keys are allowed. Equal rows keep separate slots.
    Existing columns named shard or slot are replaced. No rows in, no rows out. All columns travel through two
    sorts, so pass narrow rows (see ``shard_documents``).
    """
    rows = rows.drop("shard", "slot")
    kept = rows.columns
    n = rows.count()
    if n == 0:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    slices = 4 * math.isqrt(n) + 4
    h, rank, part, frac, start, cell = (fresh(rows, x) for x in ("h", "rank", "part", "frac", "start", "slice"))
    hashed = rows.withColumn(h, F.xxhash64(F.lit(seed), F.col(key)))
    placed, before, total = offsets(hashed, source, h, F.lit(1).cast("long"), n, kept)
    twice = 2 * F.col(before) + 1  # 2 * rank - 1
    ranked = cut(
        placed.withColumns({rank: F.col(before), frac: twice / (2 * F.col(total))})
        .withColumn(part, F.floor(twice * slices / (2 * F.col(total))).cast("long"))
        .drop(before, total)
    )
    sizes = ranked.groupBy(part).agg(F.count(F.lit(1)).alias(start))
    starts = sizes.select(F.col(part).alias(cell), (F.sum(start).over(W.orderBy(part)) - F.col(start)).alias(start))
    position = F.row_number().over(W.partitionBy(part).orderBy(frac, source, rank)) - 1 + F.col(start)
    return (
        ranked.join(starts, F.col(part) == F.col(cell))
        .withColumn(start, position)
        .withColumn("shard", F.expr(f"cast(`{start}` * {n_shards} div {n} as int)"))
        .select(*kept, "shard", F.expr(f"`{start}` - (shard * {n}L + {n_shards - 1}) div {n_shards}").alias("slot"))
    )


def shard_documents(docs: DataFrame, *, key: str = "doc_id", source: str = "source", n_shards: int = 16, seed: int = 17) -> DataFrame:
    """``assign_shards`` for wide rows: only key, source and a content hash are sorted; texts move once, in the join back.

    Rows that agree in every column are interchangeable; they are numbered and take their slots in that order.
    """
    docs, content = with_content(docs.drop("shard", "slot"))
    plan = assign_shards(docs.select(key, source, content), key=key, source=source, n_shards=n_shards, seed=seed).drop(source)
    return attach(docs, plan, key, content, ["shard", "slot"])


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    return assign_shards(rows, n_shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )
