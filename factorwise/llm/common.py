"""Shared pieces of the corpus operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from factorwise.plans.materialise import cut_lineage

# Fixed value: a word is a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: later reads survive lost executors."""
    return cut_lineage(df)


def word_count(text: Column) -> Column:
    """Number of words; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name in taken:
        name = f"_{name}"
    return name


def unit_slice(h: Column, n: int) -> Column:
    """Which of ``n`` equal slices of the hash range holds ``h``; n at most 2**31."""
    return F.shiftright(F.shiftrightunsigned(h, 32) * F.lit(n), 32)


def null_safe(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    cond = F.lit(True)
    for c in names:
        cond = cond & left[c].eqNullSafe(right[c])
    return cond


def with_content(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a hash over all columns, and that column's name."""
    content = fresh(docs, "content")
    return docs.withColumn(content, F.xxhash64(*docs.columns)), content


def attach(docs: DataFrame, plan: DataFrame, key: str, content: str, order: list[str]) -> DataFrame:
    """Join ``plan`` (key, content, new columns; a row per row of ``docs``) to its document.

    ``docs`` comes from ``with_content``. Rows that agree in every column are interchangeable: both sides number them,
    so the join is one to one. Only here do texts move, once.
    """
    number = fresh(docs, "number")
    new = [c for c in plan.columns if c not in (key, content)]
    same = W.partitionBy(key, content)
    left = docs.withColumn(number, F.row_number().over(same.orderBy(F.lit(0))))
    right = plan.withColumn(number, F.row_number().over(same.orderBy(*order)))
    joined = left.join(right, null_safe(left, right, [key, content, number]))
    return joined.select(*(left[c] for c in docs.columns if c != content), *(right[c] for c in new))


def offsets(rows: DataFrame, group: str, h: str, amount: Column, n: int, order: list[str]) -> tuple[DataFrame, str, str]:
    """``rows`` with the running amount before each row and the group's total, rows of a group in order of ``h``.

    Hash slices (4 * sqrt(n) per group) are summed first; only one slice's rows are sorted together.
    """
    slices = 4 * math.isqrt(n) + 4
    cell, own, before, total = (fresh(rows, x) for x in ("cell", "own", "before", "total"))
    cut_up = rows.withColumn(cell, unit_slice(F.col(h), slices)).withColumn(own, amount)
    by_group = W.partitionBy(group)
    sums = (
        cut_up.groupBy(group, cell)
        .agg(F.sum(own).alias(before))
        .withColumn(total, F.sum(before).over(by_group))
        .withColumn(before, F.sum(before).over(by_group.orderBy(cell)) - F.col(before))
    )
    joined = cut_up.join(sums, null_safe(cut_up, sums, [group, cell])).drop(sums[group]).drop(sums[cell])
    inside = F.sum(own).over(W.partitionBy(group, cell).orderBy(h, *order).rowsBetween(W.unboundedPreceding, 0)) - F.col(own)
    return joined.withColumn(before, F.col(before) + inside).drop(cell, own), before, total
