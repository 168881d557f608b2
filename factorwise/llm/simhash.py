"""SimHash near-duplicates, compared with bit-sliced counters.

Candidates: 64 bits are cut into radius + agree blocks. Two fingerprints within the radius agree on at least ``agree``
blocks, so each choice of ``agree`` blocks is a table of buckets, and no pair is lost. Distinct fingerprints only:
copies never meet.

Comparison: the fingerprints of a bucket are stored vertically, one bit plane per bit position and 64 lanes per word.
The XOR of planes gives the differing bits of 64 pairs at once; carry-save adders sum them into bitwise counters, and a
block of lanes is abandoned as soon as all its counters exceed the radius. Each task emits a spanning forest of the
links it found, not the links.

Hot buckets are cut into blocks by hash, and each pair of blocks is a tile of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from factorwise.llm.common import cut, fresh, table
from factorwise.llm.components import components

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Rows of a bucket that one block holds; a tile compares two blocks.
BLOCK = 2048
#: Buckets below this size are compared by shifting lanes, larger ones row by row against all lanes.
SHIFTED = 64
WIDE_SHIFTED = 256
#: Buckets over BLOCK rows (some 50 bytes each) that are broadcast; more are joined by shuffle.
BROADCAST_BUCKETS = 500_000
#: 64-bit words of a wide fingerprint that distances are counted over; further words only give bucket keys.
COMPARED = 8
#: Bytes of shingle sets in one block of a candidate group; a task compares two blocks.
SET_BLOCK = 8 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BYTE_AT = np.arange(8, dtype=np.intp) * 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str | None, width: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle of the lower-cased text's words, repeats included; of all words if they are fewer."""
    words = (text or "").encode().translate(_LOWER).split()
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if n <= width:
        pieces = [joined]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        pieces = [joined[s:e] for s, e in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist())]
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(seed)), np.uint64, len(pieces))


def majority(h: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    octets = h.view(np.uint8).astype(np.intp).reshape(-1, 8) + _BYTE_AT
    ones = (np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the text's word shingles; 0 if it has no word."""
    h = shingle_hashes(text, width, seed)
    return majority(h) if len(h) else 0


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(key, fp) with fp as a signed long. Repeated shingles count each time; null and blank texts get 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), width, seed) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["key", "fp"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("body"))
    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, fp long")


def tables(radius: int = 4, agree: int = 2) -> list[int]:
    """Masks, one per choice of ``agree`` among radius + agree blocks of the 64 bits."""
    n = radius + agree
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(blocks, agree)]


def _bits(fps: np.ndarray) -> np.ndarray:
    """(rows, bits) of fingerprints of one or several 64-bit words."""
    return np.unpackbits(np.ascontiguousarray(fps).reshape(len(fps), -1).view(np.uint8), axis=1, bitorder="little")


def bit_planes(fps: np.ndarray, spare: int = 1) -> np.ndarray:
    """(bits, words + spare): bit p of fingerprint i is bit i % 64 of word i // 64 of plane p; spare words are empty."""
    bits = _bits(fps)
    lanes = np.zeros((bits.shape[1], (len(fps) // 64 + 1 + spare) * 64), np.uint8)
    lanes[:, : len(fps)] = bits.T
    return np.packbits(lanes, axis=1, bitorder="little").view(np.uint64)


def within(diffs: Iterator[np.ndarray], wanted: np.ndarray, radius: int) -> np.ndarray:
    """Lanes of ``wanted`` whose differing bits sum to at most ``radius``; stops once none can."""
    counters = [np.zeros_like(wanted) for _ in range(max(1, radius.bit_length()))]
    over = np.zeros_like(wanted)
    for step, x in enumerate(diffs):
        y = next(diffs, None)
        low = counters[0]
        if y is None:
            carry = low & x
            counters[0] = low ^ x
        else:  # carry-save adder: three inputs of weight 1, one sum, one carry
            half = x ^ y
            carry = (x & y) | (low & half)
            counters[0] = low ^ half
        for j in range(1, len(counters)):
            counters[j], carry = counters[j] ^ carry, counters[j] & carry
        over |= carry
        if step % 4 == 3 and not (wanted & ~_above(counters, over, radius)).any():
            return np.zeros_like(wanted)
    return wanted & ~_above(counters, over, radius)


def _above(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    more, same = over.copy(), ~over
    for j in reversed(range(len(counters))):
        if radius >> j & 1:
            same = same & counters[j]
        else:
            more |= same & counters[j]
            same = same & ~counters[j]
    return more


def _lanes(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def _shifted(fps: np.ndarray, group: np.ndarray, bits: list[int], radius: int, most: int = SHIFTED) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between rows of equal ``group`` (fewer than ``most`` each): row i against row i + d for all d at once."""
    planes, n = bit_planes(fps, 1 + most // 64), len(fps)
    for d in range(1, most):
        same = np.zeros((n // 64 + 1) * 64, np.uint8)
        same[: max(0, n - d)] = group[d:] == group[: n - d]
        wanted = np.packbits(same, bitorder="little").view(np.uint64)
        at = np.flatnonzero(wanted)
        if not len(at):
            return
        far, right = at + d // 64, np.uint64(d % 64)
        if d % 64:
            moved = lambda p: planes[p, far] >> right | planes[p, far + 1] << (np.uint64(64) - right)
        else:
            moved = lambda p: planes[p, far]
        found = _lanes(within((planes[p, at] ^ moved(p) for p in bits), wanted[at], radius))
        i = at[found // 64] * 64 + found % 64
        yield i, i + d


def _crossed(a: np.ndarray, b: np.ndarray, bits: list[int], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between rows of ``a`` and rows of ``b``, 64 rows of ``a`` at a time against all lanes of ``b``."""
    planes, words, ones = bit_planes(b), len(b) // 64 + 1, _bits(a).astype(bool)
    valid = np.packbits((np.arange(words * 64) < len(b)).astype(np.uint8), bitorder="little").view(np.uint64)
    for s in range(0, len(a), 64):
        q = ones[s : s + 64]
        ok = within(
            (planes[p, None, :words] ^ np.where(q[:, p, None], ALL, np.uint64(0)) for p in bits), np.broadcast_to(valid, (len(q), words)).copy(), radius
        )
        found = _lanes(ok.ravel())
        yield s + found // (64 * words), found % (64 * words)


class Forest:
    """Least linked row per row, over rows numbered from 0."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def _links(rows: pa.Table, masks: list[int], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links inside each (table, bucket, tile) of sorted rows: (fingerprint, linked fingerprint)."""
    t, bucket, tile, block = (rows.column(c).to_numpy() for c in ("t", "bucket", "tile", "block"))
    fps, row = np.unique(rows.column("fp").to_numpy().view(np.uint64), return_inverse=True)
    fresh = np.ones(len(t), bool)
    fresh[1:] = (t[1:] != t[:-1]) | (bucket[1:] != bucket[:-1]) | (tile[1:] != tile[:-1])
    start = np.flatnonzero(fresh)
    size = np.diff(np.append(start, len(t)))
    group = np.repeat(np.arange(len(start)), size)
    forest = Forest(len(fps))
    for one in np.unique(t):
        bits = [p for p in range(64) if not masks[one] >> p & 1]
        few = np.flatnonzero((t == one) & (size < SHIFTED)[group])
        for i, j in _shifted(fps[row[few]], group[few], bits, radius):
            forest.link(row[few[i]], row[few[j]])
        for g in np.flatnonzero((size >= SHIFTED) & (t[start] == one)):
            own = np.arange(start[g], start[g] + size[g])
            first = own[block[own] == block[own[0]]]
            rest = own[block[own] != block[own[0]]]
            other = rest if len(rest) else first
            for i, j in _crossed(fps[row[first]], fps[row[other]], bits, radius):
                forest.link(row[first[i]], row[other[j]])
    child = np.flatnonzero(forest.root != np.arange(len(fps)))
    return fps[child].view(np.int64), fps[forest.root[child]].view(np.int64)


def links(fps: DataFrame, *, radius: int = 4, agree: int = 2, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) that connect exactly the fingerprints which chains of links within ``radius`` bits connect.

    ``fps``: distinct ``fp`` longs. ``agree`` sets how selective the buckets are (2: 15 tables of 21-bit keys for
    radius 4; raise it where fingerprints outnumber 10**9); the result does not depend on it.
    """
    masks = tables(radius, agree)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("bucket")) for i, m in enumerate(signed)])
    rows = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.bucket")
    sizes = rows.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    tiled = (
        rows.join(sizes, ["t", "bucket"])
        .withColumn("m", F.ceil(F.col("n") / block).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        .select("t", "bucket", "fp", "block", (F.least("block", "other") * F.col("m").cast("long") + F.greatest("block", "other")).alias("tile"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(piece: pa.Table):
            u, v = _links(piece, masks, radius)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for piece in whole_buckets(batches, 65536):
            yield found(piece)

    dealt = tiled.repartition("t", "bucket", "tile").sortWithinPartitions("t", "bucket", "tile", "block")
    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 4, seed: int = 42, radius: int = 4, agree: int = 2
) -> DataFrame:
    """One row per row of ``docs``: key, fingerprint (16 hex digits), component_id.

    Texts are lower-cased (A-Z), words are runs of non-blanks, shingles have ``width`` words. Texts whose fingerprints
    differ in at most ``radius`` bits are linked; component_id is the least key reachable. Null and blank texts have
    fingerprint zero and are linked like any other. Null keys take part but give no id unless the whole component has
    none. Repeated rows stay repeated. Only key and text are read. Empty in, empty out.
    """
    rows = cut(fingerprints(docs, key=key, text=text, width=width, seed=seed))
    distinct = rows.groupBy("fp").agg(F.min("key").alias("least"))
    roots = components(links(distinct.select("fp"), radius=radius, agree=agree))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    member = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return rows.join(member, "fp").select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# -- groups by similarity -------------------------------------------------------------------------------------------


def _multiples(h: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """``words`` further 64-bit hashes of each hash."""
    for i in range(words):
        x = h * np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        yield x ^ x >> np.uint64(31)


def differing(similarity: float) -> float:
    """Expected share of differing SimHash bits of two shingle sets of one size with this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def plan(n: int, similarity: float, bits: int = 64 * COMPARED) -> tuple[int, int, int, int]:
    """(hex digits of a bucket's key, tables, 64-bit words, radius) for n fingerprints.

    Only keys depend on n: they grow with its logarithm, so buckets keep their size, and there are as many tables (and
    words to cut them from) as find a pair at the similarity with probability 0.999. Distances are those of the first
    ``bits`` bits at any n. The radius lies 6 standard deviations above the expected distance, so pairs at the similarity
    are candidates; whether they are linked is for their shingle sets to say.
    """
    p = differing(similarity)
    digits = min(8, max(3, math.ceil(math.log2(max(1, n) / 64) / 4)))
    rows = math.ceil(math.log(0.001) / math.log(1 - (1 - p) ** (4 * digits)))
    words = max(bits // 64, math.ceil(4 * digits * rows / 64))
    return digits, rows, words, int(bits * p + 6 * math.sqrt(bits * p * (1 - p)))


def shingle_set(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(shingle_hashes(text, width, seed))


def wide_fingerprints(docs: DataFrame, words: int, *, key: str, text: str, width: int, seed: int = 42) -> DataFrame:
    """(key, fp, content): SimHash of the distinct shingles, 64 * words bits as bytes, and a 128-bit hash of their set; blank texts give zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, content = [], []
            for t in b.column(1):
                h = shingle_set(t.as_py(), width, seed)
                parts = [majority(x) for x in _multiples(h, words)] if len(h) else [0] * words
                out.append(np.array(parts, np.uint64).tobytes())
                content.append(xxhash.xxh3_128_digest(h.tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), pa.array(content, pa.binary())], names=["key", "fp", "content"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("body"))
    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, fp binary, content binary")


def similar_links(nodes: DataFrame, digits: int, rows: int, radius: int, *, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) between nodes (node, fp) whose wide fingerprints share a bucket and differ in at most ``radius`` of the first ``COMPARED`` words' bits."""
    table_key = lambda t: F.struct(t.alias("t"), F.substring(F.hex("fp"), t * digits + 1, F.lit(digits)).alias("bucket"))
    entries = nodes.select("node", F.substring("fp", 1, 8 * COMPARED).alias("compared"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), table_key)).alias("k")).select("node", F.col("compared").alias("fp"), "k.t", "k.bucket")
    sizes = entries.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("n"))
    hot = cut(sizes.filter(F.col("n") > block).select("t", "bucket", F.ceil(F.col("n") / block).cast("int").alias("m")))
    few = F.broadcast(hot) if hot.count() <= BROADCAST_BUCKETS else hot
    tiled = (
        entries.join(few, ["t", "bucket"], "left")
        .withColumn("m", F.coalesce("m", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        .select("t", "bucket", "node", "fp", "block", (F.least("block", "other") * F.col("m").cast("long") + F.greatest("block", "other")).alias("tile"))
    )

    def found(piece: pa.Table) -> pa.RecordBatch:
        node, one, row = np.unique(piece.column("node").to_numpy(), return_index=True, return_inverse=True)
        fps = np.frombuffer(b"".join(piece.column("fp").take(pa.array(one)).to_pylist()), np.uint64).reshape(len(one), -1)
        group, block = _groups(piece), piece.column("block").to_numpy()
        size = np.bincount(group)
        start = np.cumsum(size) - size
        bits, forest = list(range(64 * fps.shape[1])), Forest(len(node))
        small = np.flatnonzero((size < WIDE_SHIFTED)[group])
        for i, j in _shifted(fps[row[small]], group[small], bits, radius, WIDE_SHIFTED) if len(small) else ():
            forest.link(row[small[i]], row[small[j]])
        for g in np.flatnonzero(size >= WIDE_SHIFTED):
            own = np.arange(start[g], start[g] + size[g])
            first = own[block[own] == block[own[0]]]
            rest = own[block[own] != block[own[0]]]
            other = rest if len(rest) else first
            for i, j in _crossed(fps[row[first]], fps[row[other]], bits, radius):
                forest.link(row[first[i]], row[other[j]])
        child = np.flatnonzero(forest.root != np.arange(len(node)))
        return pa.RecordBatch.from_arrays([pa.array(node[child]), pa.array(node[forest.root[child]])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in whole_buckets(batches, 32768):
            yield found(piece)

    return tiled.repartition("t", "bucket", "tile").sortWithinPartitions("t", "bucket", "tile", "block").mapInArrow(run, "u long, v long")


def _groups(piece: pa.Table) -> np.ndarray:
    """Number of each sorted row's (t, bucket, tile)."""
    fresh_row = np.zeros(piece.num_rows, bool)
    for c in ("t", "bucket", "tile"):
        v = piece.column(c).to_numpy(zero_copy_only=False)
        fresh_row[1:] |= v[1:] != v[:-1]
    return np.cumsum(fresh_row)


def whole_buckets(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Sorted rows in tables of at least ``least`` rows that end with a bucket's tile."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < least:
            continue
        rows = pa.Table.from_batches(held)
        group = _groups(rows)
        end = int(np.searchsorted(group, group[-1]))
        if end:
            yield rows.slice(0, end)
            held = rows.slice(end).to_batches()
    if held and sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; 1 if both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def linked_sets(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Least row of each row's group: sets joined by chains of Jaccard similarities of ``similarity`` or more.

    A search over rows in order of size: each set reached is compared once with the sets of fitting size not reached yet.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    order = np.argsort(size, kind="stable")
    size = size[order]
    end = np.cumsum(size)
    start = end - size
    _, codes = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    mark, waiting, root = np.zeros(len(codes) + 1, bool), np.ones(len(sets), bool), np.arange(len(sets))
    for first in range(len(sets)):
        reached, group = [first] if waiting[first] else [], []
        waiting[first] = False
        while reached:
            x = reached.pop()
            group.append(order[x])
            lo, hi = np.searchsorted(size, size[x] * similarity - 1e-6), np.searchsorted(size, size[x] / similarity + 1e-6, "right")
            rest = lo + np.flatnonzero(waiting[lo:hi])
            if not len(rest):
                continue
            lo, hi = rest[0], rest[-1] + 1
            own = codes[start[x] : end[x]]
            mark[own] = True
            hits = np.concatenate(([0], np.cumsum(mark[codes[start[lo] : end[hi - 1]]])))
            mark[own] = False
            both = hits[end[rest] - start[lo]] - hits[start[rest] - start[lo]]
            near = rest[both >= similarity * (size[x] + size[rest] - both) - 1e-9]
            waiting[near] = False
            reached += near.tolist()
        if group:
            root[group] = min(group)
    return root


def exact_links(docs: DataFrame, candidates: DataFrame, *, key: str, text: str, width: int, similarity: float, block: int = SET_BLOCK) -> DataFrame:
    """Edges (u, v) whose chains connect exactly the texts of a candidate group that chains of similar shingle sets connect.

    ``candidates``: (node, root) of the groups' members but their roots. All sets are compared with the root's; those
    near it are one group, so only pairs with a set that is not near it are left. These meet in tiles of two blocks.
    """
    rooted = cut(candidates.select("node", "root").union(candidates.select(F.col("root").alias("node"), "root").distinct()))
    few = F.broadcast(rooted) if rooted.count() <= BROADCAST_BUCKETS else rooted

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 512):
                b = whole.slice(s, 512)
                sets = [shingle_set(t.as_py(), width).tobytes() for t in b.column(2)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.binary())], names=["root", "node", "shingles"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 512):
                b = whole.slice(s, 512)
                pairs = zip(b.column(2), b.column(3))
                near = [jaccard(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) >= similarity - 1e-9 for x, y in pairs]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(near, pa.bool_())], names=["root", "node", "shingles", "near"])

    rows = docs.select(F.col(key).cast("long").alias("node"), F.col(text).cast("string").alias("body"))
    sets = cut(rows.join(few, "node").select("root", "node", "body").mapInArrow(hashed, "root long, node long, shingles binary"))
    roots = sets.filter("node = root").groupBy("root").agg(F.min("shingles").alias("pivot"))
    met = sets.join(roots, "root").select("root", "node", "shingles", "pivot")
    starred = cut(met.mapInArrow(compared, "root long, node long, shingles binary, near boolean"))
    size, far = F.octet_length("shingles") + 16, ~F.col("near")
    blocks = lambda rows: F.ceil(F.sum(F.when(rows, size)) / block).cast("int")
    open_groups = starred.groupBy("root").agg(blocks(far).alias("m"), blocks(F.col("near")).alias("k")).filter("m > 0")
    hash_of = F.xxhash64("node")
    tiled = (
        starred.join(open_groups, "root")
        .withColumn("all", F.col("m") + F.col("k"))
        .withColumn("block", F.when(far, F.pmod(hash_of, F.col("m"))).otherwise(F.col("m") + F.pmod(hash_of, F.col("k"))).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(far, F.col("all")).otherwise(F.col("m")) - 1)))
        .select(
            F.lit(0).alias("t"), F.col("root").alias("bucket"), "node", "shingles",
            (F.least("block", "other") * F.col("all").cast("long") + F.greatest("block", "other")).alias("tile"),
        )
    )

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in whole_buckets(batches, 1):
            group, node = _groups(piece), piece.column("node").to_numpy()
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in piece.column("shingles")]
            at = np.flatnonzero(np.diff(group, prepend=-1))
            for a, z in zip(at, np.append(at[1:], len(group))):
                root = linked_sets(sets[a:z], similarity)
                u, v = node[a:z], node[a:z][root]
                yield pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], names=["u", "v"])

    rest = tiled.repartition("bucket", "tile").sortWithinPartitions("bucket", "tile").mapInArrow(found, "u long, v long")
    return starred.filter("near and node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).union(rest)


def keep_first(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of similar texts, the one with the least key (a long); all columns unchanged.

    Texts are similar if their sets of distinct word shingles have a Jaccard similarity of ``similarity`` or more; groups
    are closed under that. Wide SimHash fingerprints only propose groups, the sets decide. Rows that repeat the kept key
    count as one. Blank texts are alike. Rows without a key cannot be named and stay.
    """
    first = fresh(docs, "first")
    named = docs.filter(F.col(key).isNotNull())
    digits, rows, words, radius = plan(docs.count(), similarity)
    prints = wide_fingerprints(named, words, key=key, text=text, width=width)
    nodes = cut(prints.groupBy("content").agg(F.min("key").cast("long").alias("node"), F.min("fp").alias("fp")))
    candidates = components(similar_links(nodes, digits, rows, radius))
    roots = components(exact_links(named, candidates, key=key, text=text, width=width, similarity=similarity))
    ids = nodes.select("node").distinct().join(roots, "node", "left_anti")
    kept = docs.join(ids, docs[key] == ids["node"], "left_semi")
    one = kept.withColumn(first, F.row_number().over(W.partitionBy(key).orderBy(F.xxhash64(*docs.columns))))
    return one.filter(f"`{first}` = 1").drop(first).union(docs.filter(F.col(key).isNull()))


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
