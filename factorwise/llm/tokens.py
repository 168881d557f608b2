"""Token counts by rank-synchronous merging of arrays.

A text is split by the tokenizer's pattern into pre-tokens. The distinct pre-tokens of a batch lie side by side in one array
of symbols (ragged: an owner per symbol). In each round every pre-token finds the lowest merge rank among its neighbouring
pairs, and all places of that pair in all pre-tokens are merged at once; a pre-token without a known pair is done, and its
surviving symbols are its tokens. Rounds grow with the longest pre-token, not with their number.

Before the first round a pre-token is cut between two bytes that no vocabulary entry can hold together with what stands
around them: no merge ever crosses such a cut, so a run of a million letters becomes many short pieces.

Scale: a scalar Arrow function; no shuffle, texts never leave their row. Memory per task: one Arrow batch, the pieces of at most
``CHUNK`` characters, and a cache of at most ``KNOWN`` pre-tokens of 64 characters or less. The compiled vocabulary (under
10 MB whatever the data) travels once per executor.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factorwise.llm.common import table

# Fixed value: the split pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose pre-tokens are merged together.
CHUNK = 1 << 20
#: Pre-tokens a task remembers with their counts.
KNOWN = 1 << 18
_NONE = np.int32(2**31 - 1)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else the next from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = itertools.count(256)
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Merge table of a byte-level BPE tokenizer file, ready for arrays."""

    def __init__(self, path: str) -> None:
        spec = json.loads(Path(path).read_text("utf-8"))
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        added = spec["added_tokens"]
        plain = not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        byte_level = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        if model["type"] != "BPE" or not plain or not byte_level or spec["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added):
            raise ValueError(f"{path} has added tokens that match with their surroundings")
        letters, vocab = _byte_letters(), model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, made = (np.array([vocab[x] for x in ids], np.int64) for ids in (*zip(*pairs), ["".join(p) for p in pairs]))
        born = np.full(len(vocab), -1, np.int64)
        born[made] = np.arange(len(pairs))
        if len(np.unique(made)) < len(made) or (np.maximum(born[left], born[right]) >= np.arange(len(pairs))).any():
            raise ValueError(f"{path} uses a symbol before its merge")  # then merging all places at once is not the same
        self.width = len(vocab)
        key = left * self.width + right
        order = np.argsort(key)
        self.keys, self.ranks, self.made = key[order], order.astype(np.int32), made.astype(np.int32)
        self.first = np.array([vocab[c] for c in letters], np.int32)
        byte = {c: b for b, c in enumerate(letters)}
        tokens = [bytes(map(byte.__getitem__, t)) for t in vocab if all(c in byte for c in t)]
        self.whole = np.zeros(1 << 16, bool)
        threes = np.zeros(1 << 24, bool)
        for t in tokens:
            if len(t) == 2:
                self.whole[t[0] << 8 | t[1]] = True
            for a, b, c in zip(t, t[1:], t[2:]):
                threes[a << 16 | b << 8 | c] = True
        self.threes = np.packbits(threes)
        self.added = sorted((a["content"] for a in added), key=len, reverse=True)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def cuts(self, raw: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where a piece starts: at each ``first``, and between bytes that no entry spans."""
        two = raw[:-1].astype(np.int32) << 8 | raw[1:]
        three = two[:-1] << 8 | raw[2:]
        seen = (self.threes[three >> 3] >> (7 - (three & 7)).astype(np.uint8) & 1).astype(bool)
        starts = first.copy()
        # An entry over the bytes i, i + 1 is those two alone or holds a third on one side, unless the pre-token ends there.
        spans = self.whole[two]
        spans[1:] |= seen & ~first[1:-1]
        spans[:-1] |= seen & ~first[2:]
        starts[1:] |= ~spans
        return starts


def count_symbols(words: list[bytes], vocab: Vocabulary) -> np.ndarray:
    """Tokens of each pre-token, by merging all of them side by side."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    counts = np.zeros(len(words), np.int64)
    raw = np.frombuffer(b"".join(words), np.uint8)
    if not len(raw):
        return counts
    first = np.zeros(len(raw), bool)
    full = lengths > 0
    first[np.cumsum(lengths)[full] - lengths[full]] = True
    word = np.repeat(np.arange(len(words)), lengths)
    starts = vocab.cuts(raw, first) if len(raw) > 2 else first
    symbol, piece = vocab.first[raw], np.cumsum(starts) - 1
    of_word = word[starts]
    rank = np.full(len(raw), _NONE, np.int32)
    inner = np.flatnonzero(piece[1:] == piece[:-1])
    rank[inner] = vocab.rank(symbol[inner], symbol[inner + 1])
    while len(symbol):
        begin = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
        size = np.diff(np.append(begin, len(piece)))
        least = np.minimum.reduceat(rank, begin)
        done = least == _NONE
        if done.any():
            np.add.at(counts, of_word[piece[begin[done]]], size[done])
            left = np.repeat(~done, size)
            symbol, piece, rank = symbol[left], piece[left], rank[left]
            least, size = least[~done], size[~done]
            if not len(symbol):
                break
        hit = rank == np.repeat(least, size)
        # Neighbouring places of one pair overlap (aaa): every other one counts, from the left.
        at = np.flatnonzero(hit)
        run = np.concatenate(([True], np.diff(at) > 1))
        into = np.arange(len(at))
        at = at[(into - np.maximum.accumulate(np.where(run, into, 0))) % 2 == 0]
        symbol = symbol.copy()
        symbol[at] = vocab.made[rank[at]]
        stay = np.ones(len(symbol), bool)
        stay[at + 1] = False
        symbol, piece, rank = symbol[stay], piece[stay], rank[stay]
        at = at - np.arange(len(at))  # one symbol went for every place before
        touched = np.zeros(len(symbol), bool)
        touched[at] = True
        touched[at[at > 0] - 1] = True
        near = np.flatnonzero(touched)
        rank[near] = _NONE
        near = near[near + 1 < len(symbol)]
        near = near[piece[near] == piece[near + 1]]
        rank[near] = vocab.rank(symbol[near], symbol[near + 1])
    return counts


class Counter:
    """Token counts of texts; remembers frequent pre-tokens between batches."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.known: dict[str, int] = {}
        self.split = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, vocab.added))) if vocab.added else None

    def _pieces(self, text: str) -> Iterator[list[str]]:
        if len(text) < CHUNK:
            yield self.split.findall(text)
        else:
            for words in itertools.batched(self.split.finditer(text), CHUNK // 16):
                yield [w.group() for w in words]

    def _learn(self, words: set[str]) -> list[str]:
        """Add ``words`` to the known counts; gives back those too long to stay."""
        if len(self.known) > KNOWN:
            self.known.clear()
        new = list(words - self.known.keys())
        self.known.update(zip(new, count_symbols([w.encode() for w in new], self.vocab).tolist()))
        return [w for w in new if len(w) > 64]

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        total = np.zeros(len(texts), np.int64)
        held: list[tuple[int, list[str]]] = []
        size = 0

        def settle() -> None:
            long = self._learn(set().union(*(words for _, words in held)))
            for row, words in held:
                total[row] += sum(map(self.known.__getitem__, words))
            for w in long:
                del self.known[w]
            held.clear()

        for row, text in enumerate(texts):
            if not text:
                continue
            parts = self.special.split(text) if self.special else [text]
            total[row] += len(parts) - 1
            for words in itertools.chain.from_iterable(map(self._pieces, parts)):
                held.append((row, words))
                size += sum(map(len, words))
                if size >= CHUNK:
                    settle()
                    size = 0
        settle()
        return total


def token_count(spark: SparkSession, text: Column, tokenizer: str) -> Column:
    """Tokens of ``text`` under the byte-level BPE file ``tokenizer``; 0 for null and empty texts.

    Counts equal the library's without begin, end or added special tokens; strings of the file's special tokens inside a text
    count as one token each, its default. Any length of text, nothing is truncated. A file of another kind raises ValueError.
    """
    vocab = spark.sparkContext.broadcast(Vocabulary(tokenizer))

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(vocab.value)
        for batch in batches:
            yield pa.concat_arrays(
                [pa.array(counter(batch.slice(i, 256).to_pylist())) for i in range(0, len(batch), 256)] or [pa.array([], pa.int64())]
            )

    return count(text)


def count_tokens(docs: DataFrame, tokenizer: str, *, text: str = "text", limit: int = 512) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more tokens than ``limit``) added.

    One row per row, repeated ones too, and none for an empty table; a null text counts 0 bytes and 0 tokens. All other columns
    pass through; existing columns of the three names are replaced (``text`` may not be one of them).
    """
    body = F.col(text)
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    return docs.withColumn("n_tokens", token_count(docs.sparkSession, body, tokenizer)).select(
        *docs.columns,
        F.coalesce(F.octet_length(body), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")
