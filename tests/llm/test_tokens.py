"""Token counts against the tokenizer library itself."""

import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from factorwise.llm import tokens

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def counter():
    return tokens.Counter(tokens.Vocabulary(PATH))


ODD = [
    None, "", " ", "a", "  \n\t x y", "don't we'll I'M", "日本語テキスト" * 50, "é \U0001f44d\U0001f3fd‍!", "\x00\x85﻿\U0010ffff",
    "<|endoftext|>", "x<|endoftext|> y  <|endoftext|><|endoftext|>z", "<|endof", "aaaa" * 99, "ab" * 77, "=" * 5000,
]


def test_whole_table(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = tokens.op11_token_counts(spark, SF).collect()
    want = dict(zip(texts, library(texts.values())))
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(texts)
    assert all(r.n_bytes == len((texts[r.doc_id] or "").encode()) and r.over_limit == (want[r.doc_id] > 512) for r in got)


def test_odd_texts(counter, library):
    assert counter(ODD).tolist() == library(ODD)


@pytest.mark.parametrize("letters", ["abcdefghij eE01\n'.<|é日", "ab", "the inaer", "一二三四 ", "\U0001f600\U0001f680a "])
def test_random_texts(counter, library, letters):
    rng = random.Random(letters)
    texts = ["".join(rng.choices(letters, k=rng.randrange(1, 300))) for _ in range(500)]
    assert counter(texts).tolist() == library(texts)


def test_any_code_points(counter, library):
    rng = random.Random(5)
    spans = [(32, 127), (0x80, 0x2000), (0x3040, 0x9FFF), (0x1F300, 0x1F700), (0, 0xD800)]
    texts = ["".join(chr(rng.randrange(*rng.choice(spans))) for _ in range(60)) for _ in range(1500)]
    assert counter(texts).tolist() == library(texts)


def test_long_text_in_pieces(counter, library, monkeypatch):
    rng = random.Random(1)
    run = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=50_000))
    text = " ".join("".join(rng.choices("aeinrst", k=rng.randrange(1, 9))) for _ in range(40_000))
    want = library([run, text, text + "<|endoftext|>" + run])
    assert counter([run, text, text + "<|endoftext|>" + run]).tolist() == want
    monkeypatch.setattr(tokens, "CHUNK", 1000)
    monkeypatch.setattr(tokens, "KNOWN", 100)  # forgets between chunks
    fresh = tokens.Counter(counter.vocab)
    assert fresh([run, text, text + "<|endoftext|>" + run]).tolist() == want and len(fresh.known) < 20_000


def test_odd_rows(spark, library):
    rows = [(i, t, "x", 7) for i, t in enumerate([*ODD, *ODD[:4]])] + [(None, "a b", None, None)]
    df = spark.createDataFrame(rows, "id long, body string, n_tokens string, size long")
    got = tokens.count_tokens(df, PATH, text="body", limit=3)
    assert got.columns == ["id", "body", "size", "n_bytes", "n_tokens", "over_limit"]
    have = sorted((r.id is None, r.id, r.n_tokens, r.over_limit, r.n_bytes) for r in got.collect())
    want = [(r[0] is None, r[0], n, n > 3, len((r[1] or "").encode())) for r, n in zip(rows, library([r[1] for r in rows]))]
    assert have == sorted(want)
    assert tokens.count_tokens(df.limit(0), PATH, text="body").count() == 0


def test_other_files_are_refused(tmp_path):
    with pytest.raises(ValueError):
        tokens.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    spec = json.loads(open(PATH, encoding="utf-8").read())
    spec["model"]["merges"].reverse()
    (tmp_path / "late.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="before its merge"):
        tokens.Vocabulary(str(tmp_path / "late.json"))
