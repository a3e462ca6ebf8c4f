"""Operator 11: k-means over integer vectors with partial-distance search.

Components are floor(1024 * x), so distances, sums and means are exact and a run gives the same result on any cluster.  In every
round a task compares its vectors with the centroids chunk by chunk of dimensions, those of the highest variance first, and gives
a centroid up as soon as the sum so far is strictly above the best full distance; what is left is summed over all dimensions, so
that ties are seen and go to the smaller number.  A task sends a count, an inertia and the sums of each centroid; the means of a round,
CLUSTERS x dimensions integers, are all that the driver holds.  Vectors are written once as integers and never shuffled.

Vectors that are null, of another length, or with a null, NaN or infinite component take no part; a component beyond 2^17 raises,
since squared distances may not fit a long then.  Null ids are written as nothing in the hash that picks the first centroids and
come back as null; equal hashes (repeated ids) go by components.  With fewer vectors than clusters each of them is a centroid; an
empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .sparkutil import cut, prepare

SCALE, CLUSTERS, ROUNDS, DIMS, SEED = 1024, 8, 10, 64, 3
#: Dimensions that are added at a time, vectors that are compared at a time, the largest component that fits.
CHUNK, ROWS, LARGEST = 8, 8192, 1 << 17


class Nearest:
    """The nearest of some centroids by partial distances."""

    def __init__(self, centroids: list[list[int]], order: list[int]):
        self.order = np.array(order, np.int64)
        self.centroids = np.array(centroids, np.int64)[:, self.order]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of each row; ties go to the smaller number."""
        x = x[:, self.order]
        part = lambda rows, c, a, b: ((x[rows, a:b] - c[..., a:b]) ** 2).sum(axis=1)
        every = slice(None)
        begun = np.stack([part(every, c, 0, CHUNK) for c in self.centroids], axis=1)
        first = begun.argmin(axis=1)
        who, best = first.copy(), part(every, self.centroids[first], 0, x.shape[1])
        for k, c in enumerate(self.centroids):
            at = np.flatnonzero((first != k) & (begun[:, k] <= best))
            sums = begun[at, k]
            for a in range(CHUNK, x.shape[1], CHUNK):
                if not len(at):
                    break
                sums = sums + part(at, c, a, a + CHUNK)
                stay = sums <= best[at]
                at, sums = at[stay], sums[stay]
            won = (sums < best[at]) | (sums == best[at]) & (k < who[at])
            who[at[won]], best[at[won]] = k, sums[won]
        return who, best


def vectors(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """vec_id, v: the integer components of the vectors that take part."""
    e = F.col(vector).cast("array<double>")
    whole = (F.size(e) == DIMS) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    fits = lambda x: F.when(F.abs(x) <= LARGEST, F.floor(x * SCALE)).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST}")).cast("long"))
    return df.where(e.isNotNull() & whole).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(e, lambda x: fits(x).cast("int")).alias("v"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(map(len, held)) >= ROWS:
            yield _matrix(held)
            held = []
    if sum(map(len, held)):
        yield _matrix(held)


def _matrix(held: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray]:
    t = pa.Table.from_batches(held).combine_chunks()
    v = t.column("v").combine_chunks()
    v = pa.concat_arrays(v.chunks) if isinstance(v, pa.ChunkedArray) else v
    return t.column("vec_id"), v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, DIMS)


def _total(d: np.ndarray) -> int:
    return int(d.sum()) if not len(d) or int(d.max()) < (1 << 62) // len(d) else sum(map(int, d))


def _round(rows: DataFrame, near: Nearest) -> list[tuple[int, int, list[int]]]:
    """(count, inertia, sums) of every centroid's vectors."""
    k = len(near.centroids)

    def partial(batches):
        count, inertia, sums = [0] * k, [0] * k, np.zeros((k, DIMS), np.int64)
        for _, x in _blocks(batches):
            who, best = near.assign(x)
            for c in range(k):
                own = who == c
                count[c] += int(own.sum())
                inertia[c] += _total(best[own])
                sums[c] += x[own].sum(axis=0)
        value = [Decimal(x) for c in range(k) for x in (count[c], inertia[c], *sums[c].tolist())]
        at = np.indices((k, DIMS + 2), np.int32).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(value, pa.decimal128(38, 0))], names=["c", "j", "x"])

    out = [[0] * (DIMS + 2) for _ in range(k)]
    for r in rows.mapInArrow(partial, "c int, j int, x decimal(38,0)").groupBy("c", "j").agg(F.sum("x").alias("x")).collect():  # CLUSTERS x (DIMS + 2) rows
        out[r["c"]][r["j"]] = int(r["x"])
    return [(x[0], x[1], x[2:]) for x in out]


def _by_variance(rows: DataFrame) -> list[int]:
    """Dimensions by falling variance; any order gives the same clusters."""
    v = rows.agg(*[F.var_pop(F.col("v")[j]).alias(f"d{j}") for j in range(DIMS)]).first()
    return sorted(range(DIMS), key=lambda j: (-(v[f"d{j}"] or 0.0), j))


def kmeans(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row a vector that takes part."""
    prepare(df.sparkSession)
    rows = cut(vectors(df, id_col, vector))
    name = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = [list(r["v"]) for r in rows.orderBy(name, "v").limit(clusters).collect()]
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return df.sparkSession.createDataFrame([], schema)
    order = _by_variance(rows)
    for _ in range(rounds):
        centroids = [[s // n for s in sums] if n else old for old, (n, _, sums) in zip(centroids, _round(rows, Nearest(centroids, order)))]
    near = Nearest(centroids, order)
    inertia = [i for _, i, _ in _round(rows, near)]
    if sum(inertia) >= 1 << 63:
        raise OverflowError("the inertia doesn't fit a long")
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def final(batches):
        for ids, x in _blocks(batches):
            who, best = near.assign(x)
            own = np.array(inertia, np.int64)[who]
            out = [ids, pa.array(who.astype(np.int32)), pa.array(best), pa.array(own), pa.array(np.full(len(x), sum(inertia), np.int64)), pa.array(np.array(names, object)[who], pa.string())]
            yield from pa.table(out, names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]).to_batches()

    return rows.mapInArrow(final, schema)


def _oracle() -> str:
    """DuckDB SQL for the same rows: every round compares every vector with every centroid."""
    floored = "(s - ((s % n) + n) % n) // n"
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS i, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS k, v AS c FROM v QUALIFY k < {CLUSTERS})",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"""d{r} AS MATERIALIZED (SELECT i, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(d := d, k := k)) AS b
  FROM (SELECT i, vec_id, v, k, CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v CROSS JOIN c{r}) GROUP BY i)""")
        if r < ROUNDS:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT o.k, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN (SELECT k, list(CAST({floored} AS BIGINT) ORDER BY j) AS c
  FROM (SELECT b.k AS k, j, sum(CAST(v[j] AS HUGEINT)) AS s, CAST(count(*) AS HUGEINT) AS n FROM d{r}, range(1, {DIMS + 1}) t(j) GROUP BY b.k, j) GROUP BY k) m ON o.k = m.k)""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT d.vec_id, CAST(d.b.k AS INT) AS cluster, d.b.d AS distance, CAST(sum(d.b.d) OVER (PARTITION BY d.b.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d.b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM d{ROUNDS} d JOIN c{ROUNDS} c ON d.b.k = c.k"""


ORACLE_SQL = _oracle()
