"""Language identification by nearest centroid.

A text becomes a vector of hashed character n-grams (one to three letters, words bounded by a blank), weighted by
sublinear term frequency times inverse document frequency and scaled to length one. Every language has several
centroids from spherical k-means; a text takes the language of the centroid with the largest cosine. A text whose
cosine is far below what rightly identified texts of its length show is rejected.

Document frequencies and rejection limits use all labelled rows; only the clustering uses a bounded sample
(``per_lang`` distinct texts of each language, chosen by hash). The model is (languages x clusters x buckets) floats, at most
``MODEL_BYTES``; it travels with the tasks.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from factorwise.llm.common import cut, fresh, table

BUCKETS = 8192
MODEL_BYTES = 256 << 20
_HASH = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def gram_counts(text: str | None) -> np.ndarray | None:
    """Occurrences per n-gram bucket of the whole text; None if it has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each word
    c = np.concatenate(([np.uint32(32)], np.where(letter, codes, np.uint32(32))[keep], [np.uint32(32)])).astype(np.uint32)
    one = c * _HASH[0]
    two = one[:-1] ^ c[1:] * _HASH[1]
    three = two[:-1] ^ c[2:] * _HASH[2]
    return np.bincount(np.concatenate((one, two * _HASH[2], three * _HASH[1])) >> np.uint32(19), minlength=BUCKETS)


def vectors(counts: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    m = np.asarray(counts, np.float32).reshape(-1, BUCKETS)
    seen = m > 0
    m[seen] = 1 + np.log(m[seen])
    m *= idf
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)


def cluster(v: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means; starts from the mean's nearest row, then rows farthest from those chosen."""
    first = v @ v.mean(axis=0)
    chosen = [int(first.argmax())]
    near = v @ v[chosen[0]]
    while len(chosen) < min(k, len(v)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, v @ v[chosen[-1]])
    centres = v[chosen]
    for _ in range(rounds):
        own = (v @ centres.T).argmax(axis=1)
        for j in range(len(centres)):
            if (own == j).any():
                mean = v[own == j].mean(axis=0)
                centres[j] = mean / max(np.linalg.norm(mean), 1e-9)
    return centres


@dataclass
class Model:
    langs: list[str]  # language of each centroid
    centroids: np.ndarray
    idf: np.ndarray


def fit(train: DataFrame, *, text: str = "text", lang: str = "lang", per_lang: int = 300, clusters: int = 4, seed: int = 5) -> Model | None:
    """Centroids from rows with a language and a letter; None if there are none.

    ``per_lang`` bounds the distinct texts of a language that are clustered, so a language of few texts that repeat often
    keeps them all; frequencies are counted over all rows.
    """
    rows = train.select(F.col(lang).alias("lang"), F.col(text).alias("body")).filter("lang is not null and body is not null")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, seen = 0, np.zeros(BUCKETS, np.int64)
        for b in batches:
            for t in b.column(1):
                counts = gram_counts(t.as_py())
                if counts is not None:
                    docs += 1
                    seen += counts > 0
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], docs))], names=["bucket", "n"])

    seen = {r.bucket: r.n for r in rows.mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    docs = seen.pop(-1, 0)
    if not docs:
        return None
    freq = np.zeros(BUCKETS)
    freq[list(seen)] = list(seen.values())
    idf = (np.log((1 + docs) / (1 + freq)) + 1).astype(np.float32)

    most = MODEL_BYTES // (clusters * BUCKETS * 4)
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "body"), 11) / float(1 << 53)
    lettered = rows.filter(F.col("body").rlike(r"\p{L}")).withColumn("h", unit)
    sizes = lettered.select("lang", "h").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(most + 1).collect()
    if len(sizes) > most:
        raise ValueError("more languages than the model's bound allows; lower clusters or raise MODEL_BYTES")
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, 2.0 * per_lang / r.n)])
    drawn = lettered.filter(F.col("h") < F.try_element_at(share, "lang")).distinct()
    sample = drawn.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h", "body"))).filter(F.col("r") <= per_lang)

    def centres(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = [c for c in map(gram_counts, pdf["body"].sort_values()) if c is not None]
        found = cluster(vectors(counts, idf), clusters) if counts else np.zeros((0, BUCKETS), np.float32)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centre": [c.tobytes() for c in found]})

    found = sorted((r.lang, bytes(r.centre)) for r in sample.select("lang", "body").groupBy("lang").applyInPandas(centres, "lang string, centre binary").collect())
    if not found:
        return None
    return Model([x[0] for x in found], np.stack([np.frombuffer(x[1], np.float32) for x in found]), idf)


def nearest(docs: DataFrame, model: Model | None, *, key: str, text: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """(key, lang_pred, score, grams, extra...): nearest centroid's language and cosine; ``und`` and 0 without a letter."""
    extra = extra or {}
    rows = docs.select(F.col(text).alias("body"), F.col(key).alias("key"), *[c.alias(n) for n, c in extra.items()])
    names = ["key", *extra, "lang_pred", "score", "grams"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                b = batch.slice(s, 256)
                counts = [gram_counts(t.as_py()) for t in b.column(0)]
                has = [i for i, c in enumerate(counts) if c is not None and model]
                lang, score, grams = ["und"] * b.num_rows, np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
                if has:
                    cosine = vectors([counts[i] for i in has], model.idf) @ model.centroids.T
                    for i, j in zip(has, cosine.argmax(axis=1)):
                        lang[i], grams[i] = model.langs[j], counts[i].sum()
                    score[has] = np.clip(cosine.max(axis=1), 0, 1)
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(lang, pa.string()), pa.array(score), pa.array(grams)], names=names)

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{n}` {kinds[n]}" for n in ["key", *extra]) + ", lang_pred string, score double, grams long")


def identify(
    docs: DataFrame, *, train: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", part: float = 0.4, floor: float = 0.2, **fitted
) -> DataFrame:
    """One row per row of ``docs``: key, lang_pred, score (cosine), rejected.

    Learns from rows where ``train`` holds and ``lang`` is not null; language, source and key are no inputs of a
    prediction. A null text, one without a letter, or no training row at all gives ``und``, 0 and rejected. Otherwise
    a row is rejected if its cosine is below ``floor`` or below ``part`` of the median of the labelled rows that are
    predicted right and have about as many n-grams (bands by powers of two). A band of fewer than 50 such rows takes the
    limit of the nearest shorter band that has them, as cosines rise with length; without one it takes ``floor``.
    Ties between centroids go to the first language in order. Repeated rows stay; other columns are not read.
    """
    model = fit(docs.filter(train), text=text, lang=lang, **fitted)
    right = F.coalesce(train, F.lit(False)) & F.col(lang).isNotNull()
    extra = {"labelled": right, "lang": F.col(lang)}
    rows = cut(nearest(docs, model, key=key, text=text, extra=extra).withColumn("band", F.floor(F.log2(F.col("grams") + 1)).cast("int")))
    # medians to a thousandth, from at most 64 bands of 1001 counts
    counts = rows.filter("labelled and lang_pred = lang and grams > 0").groupBy("band", F.round(F.col("score") * 1000).cast("int").alias("score")).count()
    least = F.lit(floor)
    for band, scores in sorted(counts.toPandas().sort_values("score").groupby("band")):
        n = scores["count"].cumsum()
        if n.iloc[-1] >= 50:
            median = scores["score"].iloc[int(np.searchsorted(n, n.iloc[-1] / 2))] / 1000
            least = F.when(F.col("band") >= int(band), F.lit(max(part * float(median), floor))).otherwise(least)
    return rows.select(F.col("key").alias(key), "lang_pred", "score", ((F.col("lang_pred") == "und") | (F.col("score") < least)).alias("rejected"))


def held_out(key: str = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the key's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def keep_identified(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows of ``docs`` whose language is recognised, all columns unchanged. Keys are ids: rows that share one go together."""
    gone = fresh(docs, "gone")
    bad = identify(docs, train=~held_out(key), key=key, text=text, lang=lang).filter("rejected").select(F.col(key).alias(gone)).distinct()
    return docs.join(bad, docs[key].eqNullSafe(bad[gone]), "left_anti")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train=~held_out()).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
