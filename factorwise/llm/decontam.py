"""Benchmark decontamination by template windows.

Tokens are runs of letters and digits. A token with a digit becomes the placeholder of a number, a unit word after a
number that of a unit, a capitalised word that of a name; the rest stays as it is, lower-cased. Windows are joined by the hash
of their own lower-cased words, so case does not matter, and by that of their template, so a question whose numbers and
names were exchanged still meets its item. Windows that agree word for word always count. Of the others slot consistency decides: along one alignment, every value
of the item must stand for one value of the document; two of its values may stand for the same.

A window with fewer literal words than placeholders is joined by its own words only, on both sides, since bare placeholders
would meet anything. Items shorter than the window are windows of their own length.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factorwise.llm.common import cut, fresh, table
from factorwise.llm.rolling import Ranges, mixed, runs

WIDTH = 8
#: Distinct benchmark windows (8 bytes each) that travel with the tasks as a filter; beyond it the join shuffles.
FILTER_WINDOWS = 1_000_000
# Unit words.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros cent cents percent degree degrees watt watts volt volts mph kph"
).split()
NUMBER, UNIT, NAME = np.uint64(0x4E554D), np.uint64(0x554E4954), np.uint64(0x4E414D45)
@functools.cache
def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: in a token, a digit, a capital letter."""
    n = sys.maxunicode + 1
    letter, digit, capital = (np.fromiter((test(chr(c)) for c in range(n)), bool, n) for test in (str.isalpha, str.isdigit, str.isupper))
    return letter | digit, digit, capital


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each range; equal ranges of values get equal hashes."""
    return Ranges(mixed(values.astype(np.uint64))).hash(start, end)


@functools.cache
def _unit_hashes() -> np.ndarray:
    codes = [np.frombuffer(u.encode("utf-32-le"), np.uint32).astype(np.uint64) for u in UNITS]
    return np.sort(np.array([range_hashes(c, np.array([0]), np.array([len(c)]))[0] for c in codes]))


class Template:
    """Tokens of a text: own hash, template hash, where they stand, and which are placeholders."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""
        codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside, digit, capital = (c[codes] for c in _classes())
        self.start, self.end = runs(inside)
        self.n = len(self.start)
        if not self.n:
            self.own = self.template = np.zeros(0, np.uint64)
            self.slot = np.zeros(0, bool)
            return
        low, start, end = np.frombuffer(self.text.casefold().encode("utf-32-le", "surrogatepass"), np.uint32), self.start, self.end
        if len(low) != len(codes):  # a sharp s becomes two letters
            start, end = runs(_classes()[0][low])
            if len(start) != self.n:
                low, start, end = codes, self.start, self.end
        self.own = range_hashes(low.astype(np.uint64), start, end)
        number = np.zeros(self.n, bool)
        number[np.searchsorted(self.start, np.flatnonzero(digit), "right") - 1] = True
        after = np.concatenate(([False], number[:-1]))
        unit = after & ~number & np.isin(self.own, _unit_hashes())
        name = capital[self.start] & ~number & ~unit
        self.template = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, self.own)))
        self.slot = number | unit | name

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Template hash (own hash if most are placeholders) and own hash of every window of ``width`` tokens."""
        at = np.arange(max(0, self.n - width + 1))
        own = range_hashes(self.own, at, at + width)
        slots = np.concatenate(([0], np.cumsum(self.slot)))
        bare = 2 * (slots[at + width] - slots[at]) > width
        return np.where(bare, own, range_hashes(self.template, at, at + width)), own

    def slots(self, at: int, width: int) -> list[str]:
        """Values of the window's placeholders, each after its type."""
        kinds = {int(NUMBER): "#", int(UNIT): "u", int(NAME): "n"}
        return [
            kinds[int(self.template[i])] + self.text[self.start[i] : self.end[i]].casefold() for i in range(at, at + width) if self.slot[i]
        ]


_WINDOWS = "pos int, width int, h long, own long, slots array<string>, tokens int"


def windows(rows: DataFrame, *, key: str, text: str, widths: list[int] | None = None, wanted: np.ndarray | None = None) -> DataFrame:
    """(key, pos, width, h, own, slots, tokens) for every window of the given widths and each of its hashes h: own and template.

    Without ``widths`` one width per row: ``WIDTH``, or the row's own length if shorter. With ``wanted`` (sorted) only
    windows whose joining hash is among them.
    """
    src = rows.select(F.col(key).alias("key"), F.col(text).cast("string").alias("body"))
    schema = f"key {dict(src.dtypes)['key']}, {_WINDOWS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = np.zeros(1 << 20, bool)  # by the first 20 bits, which rule out most
        if wanted is not None:
            maybe[wanted >> np.uint64(44)] = True
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for i, text in enumerate(b.column(1)):
                t = Template(text.as_py())
                for width in widths or [max(1, min(WIDTH, t.n))]:
                    template, own = t.windows(width)
                    at = np.flatnonzero(template != own)
                    h, at = np.concatenate((own, template[at])), np.concatenate((np.arange(len(own)), at))
                    if wanted is not None:
                        some = np.flatnonzero(maybe[h >> np.uint64(44)])
                        near = np.minimum(np.searchsorted(wanted, h[some]), len(wanted) - 1)
                        some = some[wanted[near] == h[some]] if len(wanted) else some[:0]
                        h, at = h[some], at[some]
                    out[0] += [i] * len(at)
                    out[1] += at.tolist()
                    out[2] += [width] * len(at)
                    out[3] += h.view(np.int64).tolist()
                    out[4] += own[at].view(np.int64).tolist()
                    out[5] += [t.slots(j, width) for j in at.tolist()]
                    out[6] += [t.n] * len(at)
                if len(out[0]) >= 50_000:
                    yield _batch(b, out)
                    out = [[] for _ in range(7)]
            yield _batch(b, out)

    return src.mapInArrow(run, schema)


def _batch(b: pa.RecordBatch, out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int32())
    return pa.RecordBatch.from_arrays(
        [b.column(0).take(pa.array(out[0], pa.int64())), *[pa.array(x, k) for x, k in zip(out[1:], kinds)]],
        names=["key", "pos", "width", "h", "own", "slots", "tokens"],
    )


def leaks(
    docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", share: float = 0.5
) -> DataFrame:
    """(key, item, item_tokens, matched_tokens, share, verbatim) for each document that holds an item.

    A document holds an item if verbatim windows and those of consistent alignments cover at least ``share`` of the
    item's tokens; ``verbatim`` says that all of them agree word for word, whatever their case. Null and token-less texts hold nothing and are held by
    nothing. Rows that repeat a key count as one document. Other columns are not read. Either table may be empty.
    """
    wanted = cut(windows(items, key=item, text=item_text).withColumnRenamed("key", "item"))
    widths = sorted(r.width for r in wanted.select("width").distinct().collect())  # at most WIDTH values
    distinct = wanted.select("h").distinct()
    known = None
    if distinct.count() <= FILTER_WINDOWS:
        known = np.sort(distinct.toPandas()["h"].to_numpy(np.int64).view(np.uint64))
    found = windows(docs, key=key, text=text, widths=widths or [WIDTH], wanted=known).drop("tokens")
    theirs = wanted.select("item", "width", "h", F.col("pos").alias("item_pos"), F.col("own").alias("item_own"), F.col("slots").alias("item_slots"), "tokens")
    met = found.join(theirs, ["width", "h"])
    same, places = F.col("own") == F.col("item_own"), F.sequence("item_pos", F.col("item_pos") + F.col("width") - 1)
    # the same words in another case may have other slots
    paired = F.arrays_zip(F.col("item_slots").alias("a"), F.when(same, F.col("item_slots")).otherwise(F.col("slots")).alias("b"))
    aligned = met.groupBy("key", "item", "tokens", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(
        F.array_distinct(F.flatten(F.collect_list(paired))).alias("pairs"),
        F.array_distinct(F.flatten(F.collect_list(places))).alias("all"),
        F.array_distinct(F.flatten(F.collect_list(F.when(same, places)))).alias("agreed"),
        F.min(same).alias("verbatim"),
    )
    consistent = F.size(F.array_distinct("pairs.a")) == F.size("pairs")
    return (
        aligned.withColumn("covered", F.when(consistent, F.col("all")).otherwise(F.col("agreed")))
        .withColumn("verbatim", ~consistent | F.col("verbatim"))
        .filter(F.size("covered") > 0)
        .groupBy("key", "item", "tokens")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("matched_tokens"), F.min("verbatim").alias("verbatim"))
        .withColumn("share", F.col("matched_tokens") / F.col("tokens"))
        .filter(F.col("share") >= share)
        .select(F.col("key").alias(key), F.col("item").alias(item), F.col("tokens").alias("item_tokens"), "matched_tokens", "share", "verbatim")
    )


def drop_leaks(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """Rows of ``docs`` that hold no item, all columns unchanged; rows that share a key go together."""
    gone = fresh(docs, "gone")
    held = leaks(docs, items, key=key, **options).select(F.col(key).alias(gone)).distinct()
    return docs.join(held, docs[key].eqNullSafe(held[gone]), "left_anti")


def op7_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
