"""Exact k-means over whole-number vectors by Shallot search (operator 12).

Components become integers (floor(scale * x)), so distances are exact and ties go to the smaller number. Between rounds a vector
remembers its centroid, a second one near it, and a lower bound of its distance to all but its own. In a round:

* own distance below the bound: the vector stays, nothing else is looked at;
* otherwise the search starts from the closer of the two remembered centroids and goes through the others in the order of their
  distance from it. One farther away than the start's distance plus the second-least distance found so far can
  be neither nearest nor second; since the neighbours are sorted, the search of a vector ends there, and the ball shrinks with each find.

Bounds are rounded outwards and only leave centroids out; what survives is compared in 64-bit integers. Vectors stay where they are:
a round is one pass over a table in the shared folder, and sums per centroid (combined where they are made) are all that is shuffled.
Only the centroids (k rows) are known to the driver and all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_columns, written

DIM, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1
MOST = 1 << 27  # of a component's absolute value: beyond it a squared distance of 64 components leaves 63 bits
ROWS = 4096  # vectors searched at once
WIDER, NARROWER = 1 + 1e-9, 1 - 1e-9


def whole_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(key, v, fits): the vectors of `dim` components, none null or non-finite, as whole numbers; `fits` is false where one is beyond MOST (v is null then)."""
    x = F.col(column)
    good = (F.size(x) == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != F.lit(float("inf"))))
    scaled = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    fits = F.forall(x, lambda c: F.abs(F.lit(float(scale)) * c.cast("double")) < F.lit(float(MOST)))
    kept = own_columns(vectors, key, column).where(F.coalesce(good, F.lit(False)))
    return kept.select(F.col(key).cast("long").alias(key), fits.alias("fits"), F.when(fits, scaled.cast("array<int>")).alias("v"))


def first_centroids(whole: DataFrame, key: str = "vec_id", k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The k vectors with the smallest sha256 of `seed:key`, in that order (rows without a key last, equal ones by components)."""
    named = whole.where("fits").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256).alias("h"), "v")
    return np.array([r.v for r in named.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()], np.int64).reshape(-1, DIM)


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


class Neighbours:
    """Centroids, their distances, and each one's others in the order of distance from it."""

    def __init__(self, centroids: np.ndarray):
        self.at = centroids
        self.apart = np.sqrt(_square(centroids[:, None], centroids[None]).astype(float))
        np.fill_diagonal(self.apart, -1)
        self.sorted = np.argsort(self.apart, axis=1, kind="stable")[:, 1:]
        np.fill_diagonal(self.apart, 0)


def shallot(v: np.ndarray, near: Neighbours, own: np.ndarray, second: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(nearest, second nearest, lower bound, squared distance, centroids looked at) of each row of `v`, given what it remembers.

    `own` and `second` differ if there are two centroids; `lower` bounds the distance to all but `own` from below.
    """
    best = _square(v, near.at[own])
    looked, k = len(v), len(near.at)
    own, second, lower = own.copy(), second.copy(), lower.copy()
    if k == 1:
        return own, second, np.full(len(v), np.inf), best, looked
    i = np.flatnonzero(np.sqrt(best.astype(float)) * WIDER >= lower)
    if not len(i):
        return own, second, lower, best, looked
    x, a, b = v[i], own[i], second[i]
    da, db = best[i], _square(x, near.at[b])
    looked += len(i)
    swap = (db < da) | ((db == da) & (b < a))
    a, b, da, db = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, db, da), np.where(swap, da, db)
    start, hint = a.copy(), b.copy()  # the ball's centre stays; what is found may be nearer than it
    radius = np.sqrt(da.astype(float)) * WIDER
    live = np.arange(len(i))
    for step in range(k - 1):
        c = near.sorted[start[live], step]
        inside = near.apart[start[live], c] * NARROWER <= radius[live] + np.sqrt(db[live].astype(float)) * WIDER
        live, c = live[inside], c[inside]  # neighbours are sorted, so what is outside stays outside
        if not len(live):
            break
        new = c != hint[live]
        r, c = live[new], c[new]
        d = _square(x[r], near.at[c])
        looked += len(r)
        first = (d < da[r]) | ((d == da[r]) & (c < a[r]))
        other = ~first & ((d < db[r]) | ((d == db[r]) & (c < b[r])))
        f, o = r[first], r[other]
        b[f], db[f] = a[f], da[f]
        a[f], da[f] = c[first], d[first]
        b[o], db[o] = c[other], d[other]
    own[i], second[i], best[i] = a, b, da
    lower[i] = np.sqrt(db.astype(float)) * NARROWER
    return own, second, lower, best, looked


STATE = "v array<int>, cluster int, second int, lower double, distance long"


def _rows_of(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64).reshape(-1, dim)


def _round(centroids: np.ndarray, moved: np.ndarray | None, key: str) -> Callable:
    """One pass: `moved` is how far each centroid went since the vectors' last search, None before the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Neighbours(centroids)
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                v = _rows_of(batch.column("v"), centroids.shape[1])
                if moved is None:
                    own, lower = np.zeros(len(v), np.int64), np.zeros(len(v))
                    second = np.full(len(v), min(1, len(centroids) - 1))
                else:
                    own, second = (np.asarray(batch.column(c)).astype(np.int64) for c in ("cluster", "second"))
                    others = np.array([np.delete(moved, j).max(initial=0) for j in range(len(moved))])
                    lower = np.maximum(0, np.asarray(batch.column("lower")) - others[own] * WIDER)
                own, second, lower, best, _ = shallot(v, near, own, second, lower)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key), batch.column("v"), pa.array(own, pa.int32()), pa.array(second, pa.int32()), pa.array(lower), pa.array(best, pa.int64())],
                    [key, "v", "cluster", "second", "lower", "distance"])

    return run


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the components' means of each cluster; empty ones stay."""
    dim = centroids.shape[1]
    sums = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.get("v", F.lit(i)).cast("long")) for i in range(dim)]).alias("s"))
    new = centroids.copy()
    for r in sums.collect():  # k rows
        new[r.cluster] = [x // r.n for x in r.s]
    return new


def kmeans(whole: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS, key: str = "vec_id") -> tuple[DataFrame, np.ndarray]:
    """(key, v, cluster, second, lower, distance) of the vectors that fit, after `rounds` rounds and a last search, and the final centroids.

    Each round is written to the shared folder, so a lost executor repeats its own part of one pass.
    """
    state, moved = whole.where("fits").select(key, "v"), None
    for last in [False] * rounds + [True]:
        state = written(state.mapInArrow(_round(centroids, moved, key), f"{key} long, {STATE}"))
        if last:
            return state, centroids
        new = _means(state, centroids)
        moved = np.sqrt(_square(new, centroids).astype(float)) * WIDER
        centroids = new
    raise AssertionError


def op12_centroids(vectors: DataFrame) -> DataFrame:
    """The digest of operator 12 over all vectors of 64 finite components; rows with other vectors are left out, repeated rows are kept.

    With fewer than 16 vectors each starts a centroid. Equal vectors make equal centroids, of which the smaller number wins.
    A vector with a component of 2^27 or more after scaling has no distance in 64 bits: it keeps a row with nulls beside its
    vec_id and inertia, and moves nothing. An empty table gives no row; a null vec_id keeps its row and is never a first centroid
    while others are left.
    """
    whole = whole_vectors(vectors)
    centroids = first_centroids(whole)
    own = "cast(null as int) as cluster", "cast(null as long) as distance", "cast(null as long) as cluster_inertia"
    if not len(centroids):
        return whole.selectExpr("vec_id", *own, "cast(0 as long) as inertia", "cast(null as string) as centroid_sha256")
    state, centroids = kmeans(whole, centroids)
    sums = {r.cluster: r.s for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    total, clusters = sum(sums.values()), range(len(centroids))
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    inertia = F.array(*[F.lit(sums.get(c, 0)).cast("long") for c in clusters])
    done = state.select("vec_id", "cluster", "distance", F.get(inertia, F.col("cluster")).alias("cluster_inertia"), F.lit(total).cast("long").alias("inertia"),
                        F.get(F.array(*[F.lit(n) for n in names]), F.col("cluster")).alias("centroid_sha256"))
    rest = whole.where("not fits").selectExpr("vec_id", *own, f"cast({total} as long) as inertia", "cast(null as string) as centroid_sha256")
    return done.unionByName(rest)


def _sql() -> str:
    """Exact k-means in SQL, one CTE a search and one a move of the centroids."""
    parts = [f"""kept as (select row_number() over (order by vec_id) as r, vec_id, embedding as e from embeddings
  where len(embedding) = {DIM} and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)""",
             f"x as (select r, unnest(range({DIM})) as i, unnest(list_transform(e, lambda c: cast(floor({SCALE} * cast(c as double)) as bigint))) as x from kept)",
             f"seeds as (select r, row_number() over (order by sha256('{SEED}:' || vec_id)) - 1 as c from kept order by sha256('{SEED}:' || vec_id) limit {CLUSTERS})",
             "c0 as (select c, i, x as y from seeds join x using (r))"]
    for n in range(ROUNDS + 1):
        parts.append(f"""d{n} as (select r, c, sum((x - y) * (x - y)) as d from x join c{n} using (i) group by r, c),
a{n} as (select r, c, d from d{n} qualify row_number() over (partition by r order by d, c) = 1)""")
        if n < ROUNDS:
            parts.append(f"""m{n} as (select c, i, sum(x)::bigint as s, count(*) as k from a{n} join x using (r) group by c, i),
c{n + 1} as (select c{n}.c, c{n}.i, coalesce(case when s >= 0 then s // k else -((-s + k - 1) // k) end, y) as y from c{n} left join m{n} using (c, i))""")
    return "with " + ",\n".join(parts) + f""",
names as (select c, sha256(string_agg(cast(y as varchar), ',' order by i)) as centroid_sha256 from c{ROUNDS} group by c)
select vec_id, cast(a.c as integer) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by a.c) as bigint) as cluster_inertia,
  cast(sum(d) over () as bigint) as inertia, centroid_sha256 from a{ROUNDS} a join kept using (r) join names on names.c = a.c"""


SQL = _sql()
