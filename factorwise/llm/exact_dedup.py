"""Exact dedup over an extendible-hash index kept on shared files.

The index maps a 64-bit hash of the text to its bucket. A directory of depth g has 2**g slots, one per hash prefix;
an overfull bucket is split by one more bit, and the directory doubles when a bucket needs more bits than it has.
Equal hashes cannot be split: they chain. Owner tasks hold ranges of (hash, id), so a chain of copies that is longer
than a task spreads over several owners. Bytes are compared only inside chains.

Everything is DataFrame work: splitting reads per-prefix totals of distinct hashes (copies are counted once, so a
group of copies never overfills a bucket), and texts leave their task only for hashes that several rows share.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, functions as F

from factorwise.llm.common import cut, table
from factorwise.session import shared_dir

#: Distinct hashes of up to this many chains are broadcast (16 bytes each); beyond it the chains are joined by shuffle.
BROADCAST_CHAINS = 1_000_000


def prefix(h: Column, depth: int) -> Column:
    return F.lit(0).cast("long") if depth == 0 else F.shiftrightunsigned(h, 64 - depth)


def directory(hashes: DataFrame, *, capacity: int = 4096) -> tuple[DataFrame, int]:
    """(slot, bucket_depth, bucket) for every used slot, and the directory's depth.

    ``hashes`` has one row per distinct ``h``. Doubling starts at a depth where a mean bucket is well below
    ``capacity`` and goes on, four doublings at a time, while some slot is overfull. A bucket's own depth is the
    smallest at which it fits, so several slots may point to one bucket.
    """
    n = hashes.count()
    depth = min(64, max(0, math.ceil(math.log2(max(1, n / capacity)))) + 4)
    while True:
        slots = cut(hashes.groupBy(prefix(F.col("h"), depth).alias("slot")).agg(F.count(F.lit(1)).alias("n")))
        if depth == 64 or slots.filter(F.col("n") > capacity).isEmpty():
            break
        depth = min(64, depth + 4)
    levels = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d")).withColumn(
        "p", F.expr(f"case when d = 0 then 0L else shiftrightunsigned(slot, {depth} - d) end")
    )
    fits = levels.groupBy("d", "p").agg(F.sum("n").alias("total")).filter((F.col("total") <= capacity) | (F.col("d") == depth))
    found = levels.join(fits, ["d", "p"]).groupBy("slot").agg(F.min(F.struct("d", "p")).alias("b"))
    return found.select("slot", F.col("b.d").alias("bucket_depth"), F.col("b.p").alias("bucket")), depth


def build_index(docs: DataFrame, *, key: str = "doc_id", text: str = "text", capacity: int = 4096, hash_of=F.xxhash64) -> DataFrame:
    """Write the index below the shared folder and read it: key, h, sha (of the text's bytes), bucket_depth, bucket.

    A null text counts as empty. Rows are dealt to owners by ranges of (h, key) and sorted inside each owner's file.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), hash_of(body).cast("long").alias("h"), F.unhex(F.sha2(body, 256)).alias("sha"))
    path = f"{shared_dir(spark).rstrip('/')}/extendible-{uuid.uuid4().hex}"
    rows.repartitionByRange("h", "key").sortWithinPartitions("h", "key").write.parquet(f"{path}/entries")
    entries = spark.read.parquet(f"{path}/entries")
    slots, depth = directory(entries.select("h").distinct(), capacity=capacity)
    slots.write.parquet(f"{path}/directory")
    return entries.withColumn("slot", prefix(F.col("h"), depth)).join(spark.read.parquet(f"{path}/directory"), "slot").drop("slot")


def exact_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", capacity: int = 4096, hash_of=F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256.

    Rows with identical texts (null = empty) form a group; the largest key stays. Null keys lose to any other key.
    Rows that repeat both key and text are counted in group_size and share ``kept``. Empty in, empty out. Only key
    and text are read, so other columns cannot clash. ``hash_of`` can be replaced to force collisions.
    """
    index = build_index(docs, key=key, text=text, capacity=capacity, hash_of=hash_of)
    chains = cut(index.groupBy("bucket_depth", "bucket", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"))
    small = chains.count() <= BROADCAST_CHAINS
    chained = F.broadcast(chains) if small else chains
    body = F.coalesce(F.col(text), F.lit(""))
    members = docs.select(F.col(key).alias("key"), body.alias("body")).withColumn("h", hash_of(F.col("body")).cast("long")).join(chained, "h")
    texts = members.groupBy("h", "body").agg(F.max("key").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    lengths = texts.groupBy("h").agg(
        F.count(F.lit(1)).alias("links"), F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size")
    )
    lengths = cut(lengths)
    alone = lengths.filter("links = 1").drop("links")
    colliding = lengths.filter("links > 1").select("h")
    if colliding.isEmpty():
        groups = index.join(alone, "h", "left")
    else:
        exact = members.join(colliding, "h", "left_semi").join(texts, ["h", "body"]).select(
            "key", "h", F.unhex(F.sha2("body", 256)).alias("sha"), "keep_id", "group_size"
        )
        groups = (
            index.join(colliding, "h", "left_anti").join(alone, "h", "left").select("key", "h", "sha", "keep_id", "group_size").unionByName(exact)
        )
    several = F.col("group_size").isNotNull()
    return groups.select(
        F.col("key").alias(key),
        F.when(several, F.col("keep_id")).otherwise(F.col("key")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (~several | F.col("key").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
       doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))
"""
