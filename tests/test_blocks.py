"""Matching blocks against the standard library's matcher."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from factorwise.functions import blocks, text


def check(pairs):
    got = blocks.similarity([a for a, _ in pairs], [b for _, b in pairs])
    want = [SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    assert got.tolist() == want


@pytest.mark.parametrize("letters, longest", [("ab", 12), ("abc ", 40), ("abcdefghij klmnop", 30), ("aé日\U0001f600", 20)])
def test_short_texts(letters, longest):
    rng = random.Random(letters)
    word = lambda: "".join(rng.choices(letters, k=rng.randrange(longest)))
    check([(word(), word()) for _ in range(800)])


def test_edited_names():
    rng, pairs = random.Random(1), []
    for _ in range(500):
        a = " ".join(rng.sample(["acme", "global", "trading", "metal", "works", "ltd", "private", "limited", "& sons"], 4))
        b = list(a)
        for _ in range(rng.randrange(5)):
            b[rng.randrange(len(b))] = rng.choice(["", "x", " ", "qq"])
        pairs += [(a, "".join(b)), ("".join(b), a)]
    check(pairs)


def test_long_texts_and_frequent_characters():
    rng = random.Random(2)
    common, rare = "ab ", "".join(map(chr, range(0x400, 0x4F0)))
    long = lambda n: "".join(rng.choice(common if rng.random() < 0.7 else rare) for _ in range(n))
    pairs = [(long(rng.randrange(150, 400)), long(rng.randrange(190, 320))) for _ in range(40)]
    base = long(260)
    pairs += [(base, base[:100] + "ab ab" + base[90:]), ("a" * 250, "a" * 260), ("a" * 250, "b" + "a" * 260), ("ab" * 150, "ba" * 140), (base, base)]
    check(pairs)


def test_empty_and_chunks(monkeypatch):
    monkeypatch.setattr(blocks, "CELLS", 50)
    rng = random.Random(3)
    check([("", ""), ("", "a"), ("a", ""), *(("".join(rng.choices("abcd", k=k)), "".join(rng.choices("abcd", k=k + 3))) for k in range(60))])
    assert blocks.similarity([], []).tolist() == []


def test_column(spark, monkeypatch):
    monkeypatch.setattr(text, "KNOWN_PAIRS", 10)
    names = ["Acme Traders Ltd", "ACME  traders", "Traders Acme", None, "", " Zenith ", "x" * 300, "x" * 150 + "y" * 150, "日本 商事", "日本の商事"]
    df = spark.createDataFrame([(a, b) for a in names for b in names] * 3, "a string, b string")
    for r in df.withColumn("r", text.name_ratio(F.col("a"), F.col("b"))).collect():
        a, b = (" ".join((x or "").lower().split()) for x in r[:2])
        assert r.r == (SequenceMatcher(None, a, b).ratio() if a and b else 0.0), r
