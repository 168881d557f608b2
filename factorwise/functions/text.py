"""Text expressions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from factorwise.functions.blocks import similarity

WHITESPACE = " \t\n\r\f\v"


def strip(col: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.trim(col, F.lit(WHITESPACE))


def present(col: Column) -> Column:
    """Stripped text, null when nothing is left."""
    return F.nullif(strip(col), F.lit(""))


def clean(col: Column) -> Column:
    """Lower case, stripped, inner white space collapsed; null becomes empty."""
    return strip(F.regexp_replace(F.lower(F.coalesce(col.cast("string"), F.lit(""))), r"\s+", " "))


def words(col: Column) -> Column:
    """Distinct lower-case word tokens (Unicode letters, digits, _ and inner -)."""
    return F.array_distinct(F.regexp_extract_all(F.lower(col), F.lit(r"(?U)\b[\w\-]+\b"), F.lit(0)))


def header_key(name: str) -> str:
    """Column header as a snake-case key."""
    lowered = "".join(c if c.isascii() and c.isalnum() else " " for c in name.strip().lower())
    return "_".join(lowered.split())


FIELD, PAIR = "\x1f", "\x1e"
#: Pairs of names a task remembers with their ratio.
KNOWN_PAIRS = 1 << 17


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _packed_ratios(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Ratios of the pairs packed into each text; a task works every distinct pair once."""
    known: dict[str, float | None] = {"": None}
    for batch in batches:
        rows = [None if t is None else t.split(PAIR) for t in batch.to_pylist()]
        new = list({p for r in rows if r for p in r} - known.keys())
        if len(known) > KNOWN_PAIRS:
            known, new = {"": None}, list({p for r in rows if r for p in r} - {""})
        halves = [p.split(FIELD) for p in new]
        known.update(zip(new, similarity([h[0] for h in halves], [h[1] for h in halves]).tolist()))
        yield pa.array([None if r is None else [known[p] for p in r] for r in rows], pa.list_(pa.float64()))


def name_ratios(pairs: Sequence[tuple[Column, Column]], *, cut: float = 0.0) -> list[Column]:
    """Ratcliff-Obershelp similarity of pairs of names after cleaning, 0 when one is empty.

    Equal names and names where one contains the other have a closed form and
    stay in the JVM. What is left of a row's pairs goes to Python as one packed
    text, which is null for nearly all rows; there the distinct pairs of a batch
    are matched together in arrays (``blocks``). (From 200 characters on very
    frequent characters start no block, so the closed form ends there.) Where only
    "at least ``cut``" matters, pairs whose lengths alone rule that out get that
    upper bound as their value and stay in the JVM too.
    """
    parts, closed_forms, hard_flags = [], [], []
    for a, b in pairs:
        left, right = clean(a), clean(b)
        n, m = F.length(left), F.length(right)
        closed = (left == right) | ((m < 200) & (n < 200) & (F.contains(left, right) | F.contains(right, left)))
        bound = F.least(n, m) * 2.0 / F.greatest(n + m, F.lit(1))
        beyond = bound < cut
        hard = (n > 0) & (m > 0) & ~closed & ~beyond
        hard_flags.append(hard)
        parts.append(F.when(hard, F.concat(left, F.lit(FIELD), right)).otherwise(F.lit("")))
        closed_forms.append(F.when((n == 0) | (m == 0), F.lit(0.0)).when(closed | beyond, bound))
    packed = F.when(reduce(Column.__or__, hard_flags), F.concat_ws(PAIR, *parts))
    worked = _packed_ratios(packed)
    return [F.coalesce(c, F.get(worked, F.lit(i))) for i, c in enumerate(closed_forms)]


def name_ratio(a: Column, b: Column) -> Column:
    return name_ratios([(a, b)])[0]


def levenshtein_similarity(a: Column, b: Column) -> Column:
    left, right = clean(a), clean(b)
    longest = F.greatest(F.length(left), F.length(right), F.lit(1))
    return F.lit(1.0) - F.levenshtein(left, right) / longest


def percent(col: Column, digits: int) -> Column:
    """``12.3%`` style text, rounded half-up in decimal."""
    scaled = F.round(col.cast("decimal(18,6)") * F.lit(100), digits)
    return F.concat(scaled.cast(f"decimal(20,{digits})").cast("string"), F.lit("%"))


def money_text(col: Column) -> Column:
    """``1,234.50`` style text."""
    return F.format_number(col.cast("decimal(20,2)"), 2)
