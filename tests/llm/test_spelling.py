"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from factorwise.llm import spelling

SF = "/root/testdata/sf0.001"


def plain_lexicon(rows):
    found = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            found[w] += len(w) >= 5
    return {w: n for w, n in found.items() if n >= 3}


def plain_near(words):
    """By words with one code point taken out or blanked."""
    near, holes = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i] + "\0" + w[i + 1 :]].add(w)
            if (short := w[:i] + w[i + 1 :]) in words:
                near[w].add(short)
                near[short].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    return near


def plain_groups(counts, ratio=2):
    near, form, out = plain_near(counts), {}, {}
    for w, n in counts.items():
        best = min(((-counts[x], x) for x in near[w]), default=(0, None))
        form[w] = (best[1], -best[0]) if best[1] is not None and -best[0] >= ratio * n else (None, None)
    for w, n in counts.items():
        root = w
        while form[root][0] is not None:
            root = form[root][0]
        out[w] = (n, len(near[w]), *form[w], root)
    return out


def groups(df, **names):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.spelling_groups(df, **names).collect()}


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain_groups(plain_lexicon([(r.doc_id, r.text) for r in docs.collect()]))
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.op12_spelling_variants(spark, SF).collect()}
    assert got == want and sum(v[2] is not None for v in want.values()) > 100


@pytest.mark.parametrize("letters, longest", [("ab", 9), ("abc", 7), ("abcdefgh", 5), ("aé日\U0001f600", 6)])
def test_every_pair_is_found(spark, letters, longest):
    rng = random.Random(letters)
    counts = {"".join(rng.choices(letters, k=rng.randrange(4, longest + 1))): rng.choice([3, 3, 5, 6, 10, 40]) for _ in range(700)}
    counts |= {letters[0] * k: 4 for k in range(4, 12)}  # one bigram only
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert groups(df) == plain_groups(counts)


def test_links_come_once(spark):
    rng = random.Random(2)
    words = {"".join(rng.choices("abc", k=rng.randrange(4, 8))) for _ in range(400)}
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = [frozenset((r.a, r.b)) for r in spelling.links(df, spelling.gram_counts(df)).collect()]
    near = plain_near(words)
    assert len(got) == len(set(got)) and set(got) == {frozenset((a, b)) for a in words for b in near[a]}


def test_pivots_are_disjoint_and_cheapest():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcd", k=rng.randrange(4, 12))) for _ in range(300)]
    owner, at, gram = spelling._grams(words)
    counts = np.bincount(spelling._cell(gram), minlength=1 << 16)
    owner, at, prefix, first, second, last = spelling.choose(owner, at, gram, counts)
    cost = {g: counts[spelling._cell(np.array([g]))[0]] for g in set(gram.tolist())}
    for i, w in enumerate(words):
        p = sorted(at[(owner == i)][:3].tolist())
        price = lambda x: cost[ord(w[x]) << 21 | ord(w[x + 1])]
        best = min(price(a) + price(b) for a in p for b in p if b - a >= 2)
        assert second[i] - first[i] >= 2 and price(first[i]) + price(second[i]) == best


def test_common_bigram_and_long_words(spark):
    words = {f"zqx{a}{b}{c}end": 3 + (a == b) * 9 for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"}
    words |= {"y" * 5000: 3, "y" * 4999 + "x": 7, "y" * 5001: 20}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert groups(df) == plain_groups(words)


def test_chain_of_forms(spark):
    counts = {"aaaaa" + "b" * i: 3 * 2**i for i in range(20)}
    got = groups(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert got == plain_groups(counts) and {v[4] for v in got.values()} == {"aaaaa" + "b" * 19}


def test_odd_rows(spark):
    rows = [("house", 3, "x"), ("house", 4, "y"), ("hause", 14, None), (None, 9, "x"), ("horse", None, "x"), ("mouse", 0, "x"), ("", 5, "x"), ("ab", 5, "x"), ("abc", 99, "x")]
    df = spark.createDataFrame(rows, "w string, c long, n string").selectExpr("*", "'q' as form", "'q' as root", "'q' as word")
    want = {"house": (7, 1, "hause", 14, "hause"), "hause": (14, 1, None, None, "hause")}
    want |= {w: (n, 0, None, None, w) for w, n in (("", 5), ("ab", 5), ("abc", 99))}
    assert groups(df, word="w", n="c") == want
    assert groups(df.limit(0), word="w", n="c") == {}
    with pytest.raises(ValueError):
        spelling.spelling_groups(df, word="w", n="c", ratio=1)


def test_lexicon_odd_texts(spark):
    long = " ".join(f"wort{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(30_000))
    rows = [(1, None), (2, ""), (None, "Straße STRASSE strasse strasse Étés Étés Étés abcd"), (3, long), (3, long), (4, "can't xıstanbulİstanbul")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as word", "5 as n", "'q' as k")
    assert {r.word: r.n for r in spelling.lexicon(df).collect()} == plain_lexicon(rows)
    assert spelling.lexicon(df.limit(0)).count() == 0
