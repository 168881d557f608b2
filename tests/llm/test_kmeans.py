"""Exact clustering against brute force, and the geometry of the bounds."""

import hashlib
import math

import numpy as np
import pytest

from factorwise.llm import kmeans


def plain(vectors, centroids, rounds):
    x, c = np.array(vectors, np.int64), np.array(centroids, np.int64)
    for turn in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        a = d.argmin(1)
        if turn < rounds:
            c = np.array([[int(s) // int((a == i).sum()) for s in x[a == i].sum(0)] if (a == i).any() else c[i] for i in range(len(c))])
    return a, d[np.arange(len(x)), a], c


@pytest.mark.parametrize("dims, spread", [(2, 1.0), (3, 0.2), (64, 0.5)])
def test_gains_hold_in_the_sphere(dims, spread):
    rng = np.random.default_rng(dims)
    below = 0
    for _ in range(60):
        old = rng.normal(0, 10, (6, dims))
        new = old + rng.normal(0, spread, old.shape) * rng.integers(0, 2, (6, 1))
        radius = rng.uniform(0, 15, 6)
        g = kmeans.gains(old, new, radius)
        drift = np.linalg.norm(new - old, axis=1)
        way = rng.normal(0, 1, (300, dims))
        way /= np.linalg.norm(way, axis=1)[:, None]
        way = np.concatenate((way, (new - old)[drift > 0] / drift[drift > 0][:, None]))  # straight behind each move
        for i in range(6):
            x = old[i] + way * radius[i]
            x = np.concatenate((x, old[i] + way * radius[i] * rng.uniform(0, 1, (len(way), 1))))
            gain = np.linalg.norm(x[:, None] - old[None], axis=2) - np.linalg.norm(x[:, None] - new[None], axis=2)
            assert (gain <= g[i] + 1e-9).all()
        assert (g <= drift + 1e-9).all()
        below += (g < 0.9 * drift).sum()
    assert below > 100  # less than the full drift, often


def test_bounds_spare_scans_and_stay_exact():
    rng = np.random.default_rng(1)
    centres = rng.integers(-90, 90, (16, 64))
    x = centres[rng.integers(0, 16, 4000)] + rng.integers(-25, 26, (4000, 64))
    old = x[:16] + 0
    cluster, own, lower = kmeans.nearest(x, old)
    full = []
    for _ in range(4):
        new = np.array([x[cluster == i].sum(0) // max(1, (cluster == i).sum()) if (cluster == i).any() else old[i] for i in range(16)])
        radius = np.array([math.sqrt(own[cluster == i].max(initial=0)) for i in range(16)])
        loose = kmeans.loosening(old.astype(float), new.astype(float), radius)
        drift = np.linalg.norm(new - old, axis=1)
        other = np.array([np.delete(drift, i).max() for i in range(16)])
        assert (loose <= other * (1 + 1e-8)).all()
        near = np.sqrt(((x - new[cluster]) ** 2).sum(1))
        full.append((int((near >= lower - other[cluster]).sum()), int((near >= lower - loose[cluster]).sum())))
        cluster, own, lower, scanned = kmeans.move_on(x, cluster, lower, new, loose)
        d = ((x[:, None] - new[None]) ** 2).sum(2)
        assert (cluster == d.argmin(1)).all() and (own == d.min(1)).all()
        second = np.sort(d, 1)[:, 1]
        assert (lower <= np.sqrt(second)).all() and scanned < len(x)
        old = new
    assert sum(b for _, b in full) < sum(a for a, _ in full)


@pytest.mark.parametrize("size", [40, 1 << 24])
def test_rounds(spark, size):
    """With ties (few distinct values), repeated rows, an empty centroid, and components beyond exact doubles."""
    rng = np.random.default_rng(size)
    x = (rng.integers(-3, 4, (500, 5)) * (size // 4)).tolist()
    start = [*x[:5], [10 * size // 2] * 5, x[0]]
    df = spark.createDataFrame([(i, v, "q") for i, v in enumerate(x)], "id long, v array<int>, cluster string")
    got, centroids, totals = kmeans.cluster_vectors(df, "v", start, 3)
    a, d, c = plain(x, start, 3)
    rows = {r.id: (r.cluster, r.distance) for r in got.collect()}
    assert rows == {i: (int(p), int(q)) for i, (p, q) in enumerate(zip(a, d))} and centroids == c.tolist()
    assert {t["cluster"]: (t["rows"], t["distance"]) for t in totals} == {int(i): (int((a == i).sum()), int(d[a == i].sum())) for i in set(a)}
    assert [f.name for f in got.schema] == ["id", "v", "cluster", "distance"]


def test_odd_vectors(spark):
    good = [[float(np.float32(math.sin(i * j + 1))) for j in range(4)] for i in range(40)]
    rows = list(enumerate(good)) + [(None, good[3]), (7, good[7]), (7, good[8])]
    bad = [(90, None), (91, []), (92, good[0][:3]), (93, [*good[0], 1.0]), (94, [None, 1.0, 1.0, 1.0]), (95, [math.nan, 1.0, 1.0, 1.0]), (96, [1.0, -math.inf, 1.0, 1.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").selectExpr("*", "'q' as key", "'q' as v", "'q' as cluster", "1 as inertia")
    got = kmeans.cluster_embeddings(df, dims=4, k=5, rounds=3).collect()
    kept = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), [math.floor(64 * x) for x in v], i) for i, v in rows)
    a, d, c = plain([v for _, v, _ in kept], [v for _, v, _ in kept[:5]], 3)
    sha = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    want = [(-1 if i is None else i, int(p), int(q), int(d[a == p].sum()), int(d.sum()), sha[p]) for (_, _, i), p, q in zip(kept, a, d)]
    assert sorted((-1 if r.vec_id is None else r.vec_id, *r[1:]) for r in got) == sorted(want)
    few = kmeans.cluster_embeddings(df.filter("vec_id < 3"), dims=4, k=5).collect()
    assert sorted(r.cluster for r in few) == [0, 1, 2] and all(r.distance == 0 for r in few)
    none = kmeans.cluster_embeddings(df.filter("vec_id > 89"), dims=4)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_out_of_range_is_an_error(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="out of range"):
        kmeans.cluster_embeddings(df, dims=2, k=1).collect()
