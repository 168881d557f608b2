"""Spelling variants: words one edit apart, by pivotal grams.

Bigrams are ordered by how many words have them, rare first. A word's prefix is its three first bigrams in that order (and
all that tie with the third); of these three, dynamic programming over their positions chooses the two pivots: disjoint, with
the least total frequency. One edit cannot hit both. So of two words one edit apart, the one whose prefix ends earlier in
the order has a pivot that stands unharmed in the other's prefix.

Position limits: an edit behind the first pivot leaves the word up to that pivot as it is, one before it leaves the word from
the second pivot on. The index therefore holds two entries per word and length of the other word (one less, equal, one more):
the first pivot with all to its left and the second with all to its right. A prefix gram probes with each of its sides and
its word's length; the shift by the edit is in the side's length. A bigram that a third of all words share thus falls apart
into as many keys as it has different surroundings.

Verification: letters by bit mask, then the edit distance with a limit of one, all inside the join. A pair is found
once: an entry of the second kind only counts where the first kind could not have met.

Scale: occurrences are counted with map-side partials before anything is shuffled. The order of bigrams needs 65,536 counts
(of hashes; equal counts of different bigrams do no harm), so its size does not grow. Words move, texts never do. Forms at
least double in count at each step, so roots are found by at most six rounds of pointer doubling.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factorwise.llm.common import table
from factorwise.session import shared_dir

# Fixed value: letters of a word.
LETTERS = "A-Za-zÀ-ÿ"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CELLS = 1 << 16
#: Shortest word that surely has two disjoint bigrams among three.
SHORTEST = 4


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def damaged(word: Column, key: Column, every: int = 97) -> Column:
    """``word`` without one code point where ``every`` divides the crc32 of ``<key>:<word>``; that number says which one."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), word))
    at = (h % F.length(word)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def lexicon(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_length: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n) of all words of at least ``min_length`` code points that occur ``min_count`` times or more.

    Words are maximal runs of Latin letters, lower-cased in A-Z only, each occurrence after ``damaged``. A null text has no
    words, a null key reads as nothing, repeated rows count as often as they occur. Words of one text are held together once.
    """
    low = F.translate(F.col(text), _UPPER, _LOWER)
    runs = docs.select(F.col(key).alias("k"), F.explode(F.regexp_extract_all(low, F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))).alias("w"))
    words = runs.select(damaged(F.col("w"), F.col("k")).alias("word")).filter(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word number, position and code of every bigram."""
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    return owner[inner], at[inner], code[inner] << 21 | code[inner + 1]


def _cell(gram: np.ndarray) -> np.ndarray:
    return (gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64)


def gram_counts(words: DataFrame, word: str = "word") -> np.ndarray:
    """How many words have a bigram of each hash cell."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_CELLS, np.int64)
        for b in batches:
            owner, _, gram = _grams(b.column(0).to_pylist())
            total += np.bincount(np.unique(owner << 16 | _cell(gram)) & _CELLS - 1, minlength=_CELLS)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(cells), "n": pa.array(total[cells])})

    out = np.zeros(_CELLS, np.int64)
    for r in words.select(word).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    return out


def choose(owner: np.ndarray, at: np.ndarray, gram: np.ndarray, counts: np.ndarray):
    """Probing prefix (a mask over the grams, which come back sorted), pivots' positions, and the order of the prefix's end.

    All words have three bigrams or more. Rows of the result's first arrays are bigrams in order of word, rarity, position.
    """
    weight = counts[_cell(gram)]
    rarity = (np.log2(weight + 1.0) * (1 << 14)).astype(np.int64) << 42 | gram  # one order of bigrams for all words
    order = np.lexsort((at, rarity, owner))
    owner, at, rarity, weight = owner[order], at[order], rarity[order], weight[order]
    start = np.flatnonzero(np.diff(owner, prepend=-1))
    last = rarity[start + 2]
    size = np.diff(np.append(start, len(owner)))
    prefix = rarity <= np.repeat(last, size)
    three = start[:, None] + np.arange(3)
    turn = np.argsort(at[three], axis=1)
    pos, cost = (np.take_along_axis(a[three], turn, 1) for a in (at, weight.astype(np.float64)))
    # Best pair that ends at each position: the cheapest bigram that ends before it begins.
    best, first, second = np.full(len(start), np.inf), np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    for j in range(1, 3):
        cheapest, where = np.full(len(start), np.inf), np.zeros(len(start), np.int64)
        for i in range(j):
            better = (pos[:, j] - pos[:, i] >= 2) & (cost[:, i] < cheapest)
            cheapest[better], where[better] = cost[better, i], pos[better, i]
        better = cheapest + cost[:, j] < best
        best[better], first[better], second[better] = (cheapest + cost[:, j])[better], where[better], pos[better, j]
    return owner, at, prefix, first, second, last


def _signatures(word: Column, counts: np.ndarray) -> Column:
    """Per word: positions of the probing grams, the two pivots, where the prefix ends in the order, letters as bits."""
    schema = "struct<probe:array<int>,first:int,second:int,last:long,letters:long>"

    @F.arrow_udf(schema)
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            words = batch.to_pylist()
            if not words:
                yield pa.array([], pa.struct([("probe", pa.list_(pa.int32())), *((x, pa.int32()) for x in ("first", "second")), *((x, pa.int64()) for x in ("last", "letters"))]))
                continue
            owner, at, prefix, first, second, last = choose(*_grams(words), counts)
            ends = np.concatenate(([0], np.cumsum(np.bincount(owner[prefix], minlength=len(words)))))
            code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
            begin = np.concatenate(([0], np.cumsum([len(w) for w in words])[:-1]))
            bits = np.bitwise_or.reduceat(np.uint64(1) << (code & 63).astype(np.uint64), begin).view(np.int64)
            probe = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(at[prefix].astype(np.int32)))
            arrays = [probe, pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32)), pa.array(last), pa.array(bits)]
            yield pa.StructArray.from_arrays(arrays, ["probe", "first", "second", "last", "letters"])

    return sign(word)


def links(words: DataFrame, counts: np.ndarray) -> DataFrame:
    """(a, an, b, bn): each pair of words exactly one edit apart, once. ``words`` holds distinct (word, n) of 4 code points or more."""
    signed = words.withColumn("s", _signatures(F.col("word"), counts)).select("word", "n", "s.*")

    def sides(word: Column, first: Column, second: Column, size: Column) -> Column:
        """What stands up to a gram and what stands from one on, each with the length of the word it may be found in."""
        left, right = F.substring(word, F.lit(1), first + 2), F.substring(word, second + 1, F.length(word))
        keys = ((False, F.xxhash64(left, size)), (True, F.xxhash64(F.lit(""), right, size)))
        return F.array(*(F.struct(F.lit(tail).alias("tail"), h.alias("h")) for tail, h in keys))

    index = signed.select(
        F.col("word").alias("a"), F.col("n").alias("an"), F.col("first").alias("cut"), F.col("last").alias("al"), F.col("letters").alias("am"), "second",
        F.explode(F.sequence(F.length("word") - 1, F.length("word") + 1)).alias("size"),
    )
    index = index.select("a", "an", "cut", "al", "am", F.inline(sides(F.col("a"), F.col("cut"), F.col("second"), F.col("size"))))
    probes = signed.select(F.col("word").alias("b"), F.col("n").alias("bn"), F.col("last").alias("bl"), F.col("letters").alias("bm"), F.explode("probe").alias("at"))
    probes = probes.select("b", "bn", "bl", "bm", F.inline(sides(F.col("b"), F.col("at"), F.col("at"), F.length("b"))))
    later = (F.col("bl") > F.col("al")) | ((F.col("bl") == F.col("al")) & (F.col("b") > F.col("a")))
    letters = F.bit_count(F.col("am").bitwiseXOR(F.col("bm"))) <= 2
    head = F.col("cut") + 2
    once = ~F.col("tail") | (F.substring("a", F.lit(1), head) != F.substring("b", F.lit(1), head))
    found = index.join(probes, ["tail", "h"]).filter(later & letters & once)
    return found.filter(F.levenshtein("a", "b", 1) == 1).select("a", "an", "b", "bn")


def _roots(forms: DataFrame, path: str) -> DataFrame:
    """(word, root): the end of each word's chain of forms, by pointer doubling. ``forms`` holds (word, form), no cycles."""
    turn = 0
    jumps = _written(forms.select("word", F.col("form").alias("root")), f"{path}/{turn}")
    while True:
        ahead = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if jumps.join(ahead, "root", "left_semi").isEmpty():
            return jumps
        turn += 1
        jumps = _written(jumps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), f"{path}/{turn}")


def spelling_groups(words: DataFrame, *, word: str = "word", n: str = "n", ratio: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n, root per distinct word of ``words``.

    Near words differ by exactly one inserted, deleted or replaced code point. The form is the near word of largest n (ties:
    first in code-point order) if that is at least ``ratio`` (2 or more) times the word's own n, else null; the root is where
    the chain of forms ends. Counts of repeated words are added up; null words and counts that are null or
    below 1 are left out; words under 4 code
    points are no one's near words; an empty table gives no rows. Other columns are not read.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    spark = words.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/spelling-{uuid.uuid4().hex}"
    given = words.select(F.col(word).alias("word"), F.col(n).cast("long").alias("n")).filter("n > 0 and word is not null").groupBy("word").agg(F.sum("n").alias("n"))
    given = _written(given, f"{base}/words")
    long = given.filter(F.length("word") >= SHORTEST)
    pairs = links(long, gram_counts(long))
    both = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("bn").alias("m")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("an").alias("m")),
    )
    near = pairs.select(F.inline(both)).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best")
    )
    joined = given.join(near, "word", "left")
    form = F.when(-F.col("best.m") >= ratio * F.col("n"), F.col("best.near"))
    formed = _written(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"), F.when(form.isNotNull(), -F.col("best.m")).alias("form_n")),
        f"{base}/forms",
    )
    roots = _roots(formed.filter("form is not null"), f"{base}/roots")
    return formed.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(lexicon(table(spark, sf_dir, "documents"))).select("word", "form", "root", "n", "n_near", "form_n")


OP12_SQL = """
with recursive crc_table as (
  select list(list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t
  from range(256) r(i)),
runs as (
  select doc_id, w, count(*) as n
  from (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as w from documents)
  where length(w) >= 5 group by all),
hashed as (
  select w, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten([
      case when unicode(c) < 128 then [unicode(c)::bigint] else [192 + (unicode(c) >> 6)::bigint, 128 + (unicode(c) & 63)::bigint] end
      for c in string_split(coalesce(doc_id::varchar, '') || ':' || w, '')])),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) as h
  from runs, crc_table),
counted as materialized (
  select word, sum(n)::bigint as n
  from (select n, case when h % 97 = 0 then substr(w, 1, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end as word from hashed)
  where length(word) >= 5 group by word having sum(n) >= 3),
holes as (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as gap from counted, range(length(word)) r(i)),
near as materialized (
  select distinct a.word, b.word as near, b.n as m from holes a join holes b on a.gap = b.gap and a.i = b.i and a.word <> b.word and length(a.word) = length(b.word)
  union select a.word, b.word, b.n from holes a join counted b on a.gap = b.word
  union select b.word, a.word, a.n from holes a join counted b on a.gap = b.word),
best as (select word, count(*) as n_near, min(struct_pack(m := -m, near := near)) as best from near group by word),
formed as materialized (
  select word, c.n, coalesce(n_near, 0) as n_near, case when -best.m >= 2 * c.n then best.near end as form, case when -best.m >= 2 * c.n then -best.m end as form_n
  from counted c left join best using (word)),
steps as (
  select word, word as at, form as next from formed
  union all select s.word, s.next, f.form from steps s join formed f on f.word = s.next)
select f.word, f.form, s.at as root, f.n, f.n_near, f.form_n from formed f join steps s on s.word = f.word and s.next is null"""
