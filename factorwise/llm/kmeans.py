"""Exact k-means over integer vectors with geometric drift tightening.

Every vector keeps its exact distance to its own centroid and a lower bound on the distance to any other. When centroids
move, the lower bound must loosen by as much as some other centroid can have come closer. The full drift of that centroid is
always enough, but the vectors of a cluster lie in a sphere, and within it a centroid that moves sideways or away comes
closer by less. Whatever the dimension, sphere centre, old and new place of the centroid span a plane, and there the gain of
a point seen from the middle of the move under an angle a to its direction is at most drift * cos(a); the sphere's least angle
is that of its centre less the half angle under which it appears. Vectors whose own distance stays below the loosened bound
keep their cluster; all others are compared with every centroid, in exact integers.

Scale: no row is shuffled or broadcast. A round reads the vectors once, writes them with their bounds to the shared folder
and sums them up per cluster with map-side partials; the driver holds k centroids and k * k bounds. A cluster with a third
of all rows is spread over all tasks.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factorwise.llm.common import fresh, table
from factorwise.session import shared_dir

#: Components are below this, so that squared distances of up to 64 components are longs.
LIMIT = 1 << 27
#: Below this, products of components are exact in doubles and BLAS multiplies them.
EXACT = 1 << 22


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of ``x`` to each row of ``c``."""
    if max(abs(x).max(initial=0), abs(c).max(initial=0)) < EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def gains(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Entry i, j: how much closer centroid j can have come to a point within ``radius[i]`` of the old centroid i.

    A millionth of the drift is added for rounding.
    """
    move = new - old
    drift = np.sqrt((move * move).sum(1))
    ahead = move / np.where(drift > 0, drift, 1)[:, None]
    from_middle = old[:, None, :] - ((old + new) / 2)[None, :, :]
    t = (from_middle * ahead[None, :, :]).sum(2)
    far2 = (from_middle * from_middle).sum(2)
    s = np.sqrt(np.maximum(far2 - t * t, 0))
    r = radius[:, None]
    half = np.sqrt(np.maximum(far2 - r * r, 0))
    # cos(angle of the centre - half angle of the sphere), from sines and cosines of the two
    cosine = (t * half + s * r) / np.where(far2 > 0, far2, 1)
    cosine = np.where((far2 <= r * r) | ((s <= r) & (t > 0)), 1.0, np.clip(cosine, 0, 1))
    return np.minimum(cosine + 1e-6, 1) * drift[None, :]


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """By how much the lower bound of each cluster's vectors shrinks."""
    g = gains(old, new, radius)
    np.fill_diagonal(g, 0)
    return g.max(1) * (1 + 1e-9)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number), its squared distance, and a lower bound on the distance to any other."""
    d = squared(x, c)
    best = d.argmin(1)
    rows = np.arange(len(x))
    own = d[rows, best]
    d[rows, best] = np.iinfo(np.int64).max
    other = d.min(1)
    return best, own, np.where(other == np.iinfo(np.int64).max, np.inf, np.sqrt(other.astype(np.float64)) * (1 - 1e-12))


def move_on(x: np.ndarray, cluster: np.ndarray, lower: np.ndarray, new: np.ndarray, loose: np.ndarray):
    """Cluster, squared distance and lower bound after the centroids moved to ``new``; how many rows were scanned."""
    cluster, lower = cluster.copy(), lower - loose[cluster]
    if max(abs(x).max(initial=0), abs(new).max(initial=0)) < EXACT:
        apart = x.astype(np.float64) - new[cluster]
    else:
        apart = x - new[cluster]
    own = (apart * apart).sum(1).astype(np.int64)
    scan = ~(np.sqrt(own.astype(np.float64)) * (1 + 1e-12) < lower)
    if scan.any():
        cluster[scan], own[scan], lower[scan] = nearest(x[scan], new)
    return cluster, own, lower, int(scan.sum())


def _matrix(vectors: pa.Array, n: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)


_STATE = "struct<cluster:int,distance:long,lower:double,scanned:boolean>"


def _struct(cluster, own, lower, scanned) -> pa.StructArray:
    arrays = [pa.array(cluster.astype(np.int32)), pa.array(own), pa.array(lower), pa.array(scanned)]
    return pa.StructArray.from_arrays(arrays, ["cluster", "distance", "lower", "scanned"])


def _first(vector: Column, centroids: np.ndarray) -> Column:
    @F.arrow_udf(_STATE)
    def assign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for v in batches:
            yield _struct(*nearest(_matrix(v, len(v)), centroids), np.ones(len(v), bool))

    return assign(vector)


def _next(vector: Column, state: Column, centroids: np.ndarray, loose: np.ndarray) -> Column:
    @F.arrow_udf(_STATE)
    def assign(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for v, s in batches:
            x = _matrix(v, len(v))
            old = s.field("cluster").to_numpy(zero_copy_only=False)
            cluster, own, lower, _ = move_on(x, old, s.field("lower").to_numpy(zero_copy_only=False), centroids, loose)
            yield _struct(cluster, own, lower, np.isin(np.arange(len(x)), np.flatnonzero(cluster != old)))

    return assign(vector, state)


def _totals(assigned: DataFrame) -> list[dict]:
    """Rows, distance and componentwise sums per cluster of (vector, cluster, distance): a row per cluster and task is shuffled."""

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x, c, d = _matrix(b.column(0), b.num_rows), b.column(1).to_numpy(), b.column(2).to_numpy()
            order = np.argsort(c, kind="stable")
            start = np.flatnonzero(np.diff(c[order], prepend=-1))
            rows = np.diff(np.append(start, len(c)))
            found = zip(c[order][start].tolist(), rows, *(f.reduceat(d[order], start) for f in (np.add, np.maximum)), np.add.reduceat(x[order], start))
            for i, n, total, far, sums in found:
                a = held.get(i, (0, 0, 0, 0))
                held[i] = (a[0] + n, a[1] + total, max(a[2], far), a[3] + sums)
        if held:
            yield pa.RecordBatch.from_pydict(
                {"cluster": pa.array(held, pa.int32())}
                | {name: pa.array([int(h[i]) for h in held.values()], pa.int64()) for i, name in enumerate(("rows", "distance", "far"))}
                | {"sums": pa.array([h[3].tolist() for h in held.values()], pa.list_(pa.int64()))}
            )

    parts = assigned.mapInArrow(partials, "cluster int, rows long, distance long, far long, sums array<long>")
    each = parts.select("cluster", "rows", "distance", "far", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i")
    each = each.agg(F.sum("rows").alias("rows"), F.sum("distance").alias("distance"), F.max("far").alias("far"), F.sum("x").alias("x"))
    out: dict[int, dict] = {}
    for r in sorted(each.collect()):  # clusters * components rows
        out.setdefault(r.cluster, {"cluster": r.cluster, "rows": r.rows, "distance": r.distance, "far": r.far, "sums": []})["sums"].append(r.x)
    return list(out.values())


def cluster_vectors(rows: DataFrame, vector: str, centroids: list[list[int]], rounds: int) -> tuple[DataFrame, list[list[int]], list[dict]]:
    """``rows`` with ``cluster`` and ``distance`` (squared, long), the final centroids, and totals per cluster.

    ``vector`` is an array<int> of one length, without nulls, components below 2**27 in size. Each of ``rounds`` rounds
    assigns every row to its nearest centroid (ties: the smaller number) and replaces every centroid that has rows by the
    componentwise floor of their mean; empty ones stay. Then rows are assigned once more. Repeated rows count as often as they
    occur. An empty table keeps its centroids; with no centroids the table must be empty. Totals hold cluster, rows,
    distance (sum), far (largest distance) and sums (per component). Other columns pass through each round's written table, so pass narrow rows; existing columns named
    cluster or distance are replaced.
    """
    spark = rows.sparkSession
    rows = rows.drop("cluster", "distance")
    if not centroids:
        return rows.limit(0).withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long")}), [], []
    state, dims = fresh(rows, "state"), len(centroids[0])
    base = f"{shared_dir(spark).rstrip('/')}/kmeans-{uuid.uuid4().hex}"
    now = np.array(centroids, np.int64).reshape(len(centroids), dims)
    assigned = rows.withColumn(state, _first(F.col(vector), now))
    for turn in range(rounds + 1):
        assigned.write.parquet(f"{base}/{turn}")
        assigned = spark.read.parquet(f"{base}/{turn}")
        s = F.col(state)
        totals = _totals(assigned.select(vector, s.cluster.alias("cluster"), s.distance.alias("distance")))
        if turn == rounds:
            break
        new, radius = now.copy(), np.zeros(len(now))
        for t in totals:
            radius[t["cluster"]] = math.sqrt(t["far"]) * (1 + 1e-12)
            new[t["cluster"]] = [x // t["rows"] for x in t["sums"]]
        loose = loosening(now.astype(np.float64), new.astype(np.float64), radius)
        assigned = assigned.withColumn(state, _next(F.col(vector), s, new, loose))
        now = new
    done = assigned.select(*rows.columns, F.col(state).cluster.alias("cluster"), F.col(state).distance.alias("distance"))
    return done, now.tolist(), totals


def scaled(embedding: Column, scale: int = 64) -> Column:
    """Components as integers floor(scale * x); a component of 2**27 or more is an error, as its distances are no longs."""

    def one(x: Column) -> Column:
        y = F.floor(F.lit(scale) * x.cast("double"))
        return F.when((y > -LIMIT) & (y < LIMIT), y.cast("int")).otherwise(F.raise_error(F.lit("component out of range")))

    return F.transform(embedding, one)


def usable(embedding: Column, dims: int) -> Column:
    """Exactly ``dims`` components, none null, NaN or infinite; false for a null array."""

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    return F.coalesce((F.size(embedding) == dims) & F.forall(embedding, lambda x: F.coalesce(finite(x), F.lit(False))), F.lit(False))


def cluster_embeddings(
    rows: DataFrame, *, key: str = "vec_id", embedding: str = "embedding", dims: int = 64, k: int = 16, rounds: int = 3, seed: int = 1
) -> DataFrame:
    """Per usable vector: ``key``, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Starts from the ``k`` vectors with the least sha256 of ``<seed>:<key>`` (a null key reads as nothing; equal hashes in order
    of the vector); fewer vectors make fewer clusters. Vectors that are null, of another length, or with a null or non-finite
    component are left out. Repeated rows stay repeated; no usable vector gives no rows; other columns are not read.
    """
    vec = (
        rows.select(F.col(key).alias("key"), F.col(embedding).alias("embedding"))
        .filter(usable(F.col("embedding"), dims))
        .select("key", scaled(F.col("embedding")).alias("v"))
    )
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    start = [list(r.v) for r in vec.select(order.alias("h"), "v").orderBy("h", "v").limit(k).collect()]
    done, centroids, totals = cluster_vectors(vec, "v", start, rounds)
    if not centroids:
        names = {"cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
        return done.select(F.col("key").alias(key), "cluster", "distance", *(F.lit(None).cast(t).alias(c) for c, t in names.items()))
    whole = sum(t["distance"] for t in totals)
    per = [(t["cluster"], t["distance"], whole, ",".join(map(str, centroids[t["cluster"]]))) for t in totals]
    model = rows.sparkSession.createDataFrame(per, "c int, cluster_inertia long, inertia long, centroid string")
    return done.join(F.broadcast(model), done.cluster == model.c).select(  # a row per cluster, k at most
        F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256")
    )


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_embeddings(table(spark, sf_dir, "embeddings"))


_KEPT = """
kept as (select vec_id, [floor(64 * x::double) for x in embedding]::double[] as v, sha256('1:' || coalesce(vec_id::varchar, '')) as h
  from embeddings
  where len(embedding) = 64 and len([x for x in embedding if x is not null and not isnan(x) and not isinf(x)]) = 64),
numbered as (select *, row_number() over () as row from kept),
c0 as materialized (select (row_number() over (order by h, v) - 1)::int as cluster, v from (select h, v from kept order by h, v limit 16))"""
# Distances are sums of products of integers, exact in doubles at this size.
_ASSIGN = """
a{i} as materialized (select row, any_value(vec_id) as vec_id, any_value(v) as v, min(struct_pack(d := d, c := cluster)) as best
  from (select x.row, x.vec_id, x.v, c.cluster, list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, c.v) + list_inner_product(c.v, c.v) as d
    from numbered x cross join c{i} c) group by row)"""
_MOVE = """
m{j} as (select best.c as cluster, i, floor(sum(v[i]) / count(*)) as y from a{i}, range(1, 65) r(i) group by best.c, i),
n{j} as (select cluster, list(y order by i) as v from m{j} group by cluster),
c{j} as materialized (select c.cluster, coalesce(n.v, c.v) as v from c{i} c left join n{j} n using (cluster))"""
OP13_SQL = (
    "with "
    + ",".join([_KEPT, *(_ASSIGN.format(i=i) + "," + _MOVE.format(i=i, j=i + 1) for i in range(3)), _ASSIGN.format(i=3)])
    + """
select vec_id, best.c as cluster, best.d::bigint as distance,
  (sum(best.d) over (partition by best.c))::bigint as cluster_inertia, (sum(best.d) over ())::bigint as inertia,
  sha256(array_to_string([y::bigint for y in c.v], ',')) as centroid_sha256
from a3 join c3 c on c.cluster = best.c"""
)
