"""Operator 7: exact top-k search over binary codes by incremental multi-index hashing.

Codes are the signs of embeddings, cut into segments of about log2(rows) bits.  Every code is a row for each of its segments,
keyed by (segment, value).  In round r every open query probes, in each segment, the values at distance r of its own; a joined
code counts where it is found for the first time (no segment before is within r, none after within r - 1).  After round r all
codes at Hamming distance up to segments * (r + 1) - 1 have been seen, so a query ends when its k-th best verified distance is no
more than that; only open queries go on, with their k best so far.  Rows, probes and candidates are joined by shuffle, and the
best k are cut down before and after it.

Where a round would take over PROBES values a query (few rows in many dimensions, or a query far from everything), the queries
still open are compared with all codes in blocks of fixed size, each with a multi-index of its own; the answer is the same.

Of equal codes only the k + 1 smallest ids can be in any answer, so groups of copies are reduced to these first.

Null ids or embeddings take no part.  A vector doesn't find itself (its id), but finds copies of itself.  Repeated ids count
once.  Embeddings of fewer dimensions are filled with zeros (bit 0); null elements too.  With fewer than k others all come.  Ties
go to the smaller id.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .sparkutil import prepare

SEGMENT = 16
DATA_BLOCK, QUERY_BLOCK = 1 << 17, 1 << 10
#: Values that a query may probe in one round.
PROBES = 1024


def masks(r: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in combinations(range(SEGMENT), r)], np.int64)


class Index:
    """Segment tables over one block of codes (array of uint16, one column a segment)."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.codes, self.ids = codes[order], ids[order]
        self.tables = []
        for s in range(codes.shape[1]):
            by = np.argsort(self.codes[:, s], kind="stable")
            self.tables.append((by, np.searchsorted(self.codes[by, s], np.arange((1 << SEGMENT) + 1))))

    def search(self, code: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, distances) of the k nearest by (distance, id), and the radius that it took."""
        seen = np.zeros(len(self.ids), bool)
        best_at, best_d = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for r in range(SEGMENT + 1):
            new = []
            for s, (by, start) in enumerate(self.tables):
                v = int(code[s]) ^ masks_of[r]
                a, b = start[v], start[v + 1]
                hit = b > a
                if hit.any():
                    a, b = a[hit], b[hit]
                    n = b - a
                    new.append(by[np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())])
            if new:
                at = np.unique(np.concatenate(new))
                at = at[~seen[at] & (self.ids[at] != own)]
                seen[at] = True
                d = np.bitwise_count(self.codes[at] ^ code).sum(axis=1).astype(np.int64)
                best_at, best_d = np.concatenate([best_at, at]), np.concatenate([best_d, d])
                top = np.lexsort((best_at, best_d))[:k]  # places follow ids
                best_at, best_d = best_at[top], best_d[top]
            if len(best_d) == k and best_d[-1] <= self.codes.shape[1] * (r + 1) - 1:
                break
        return self.ids[best_at], best_d, r


masks_of = [masks(r) for r in range(SEGMENT + 1)]


def codes(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id, code: the signs of a vector's elements, 8 to a byte, filled up to whole segments; built from SQL functions."""
    bits = F.transform(F.col(vector), lambda v: F.when(v > 0, F.lit("1")).otherwise(F.lit("0")))
    x = df.select(F.col(id_col).cast("long").alias("id"), F.array_join(bits, "").alias("bits")).where("id is not null and bits is not null")
    return x.groupBy("id").agg(F.min("bits").alias("bits"))


def top_k(data: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, distance; data and queries hold (id, bits)."""
    prepare(data.sparkSession)
    size = data.agg(F.count("*").alias("n"), F.max(F.length("bits")).alias("m")).first()
    width = max(1, -(-(size.m or 1) // SEGMENT)) * SEGMENT
    count = max(1, width // min(32, max(8, math.ceil(math.log2(max(2, size.n))))))
    ends = [width * j // count for j in range(count + 1)]
    packed = lambda d: d.select("id", F.rpad("bits", width, "0").alias("bits"))
    few = packed(data).withColumn("nth", F.row_number().over(Window.partitionBy("bits").orderBy("id"))).where(F.col("nth") <= k + 1).drop("nth").checkpoint()
    segs = F.array(*[F.conv(F.substring("bits", s + 1, e - s), 2, 10).cast("long") for s, e in zip(ends, ends[1:])])
    rows = few.select("id", segs.alias("segs")).select("id", "segs", F.posexplode("segs").alias("seg", "val"))
    open_ = packed(queries).select(F.col("id").alias("query_id"), segs.alias("own"), "bits").checkpoint()
    best = open_.select("query_id", F.lit(0).cast("long").alias("vec_id"), F.lit(0).alias("distance")).where("false")
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    top = lambda d: d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    r = 0
    while open_.limit(1).count():
        masks = [[sum(1 << b for b in c) for c in combinations(range(e - s), r)] if math.comb(e - s, r) <= PROBES else None for s, e in zip(ends, ends[1:])]
        if None in masks or sum(map(len, masks)) > PROBES:
            best = best.union(_scanned(few, open_.select(F.col("query_id").alias("id"), "bits"), k))
            break
        table = data.sparkSession.createDataFrame([(j, m) for j, ms in enumerate(masks) for m in ms], "seg int, mask long")
        at = open_.select("query_id", "own", F.posexplode("own").alias("seg", "value")).join(F.broadcast(table), "seg")  # PROBES rows at most
        at = at.select("query_id", "own", "seg", F.col("value").bitwiseXOR(F.col("mask")).alias("val"))
        far = F.zip_with("own", "segs", lambda a, b: F.bit_count(a.bitwiseXOR(b)))
        hit = at.join(rows, ["seg", "val"]).where("query_id <> id").withColumn("far", far)
        new = hit.where(~F.exists(F.transform("far", lambda d, j: F.when(j < F.col("seg"), d <= r).when(j > F.col("seg"), d < r).otherwise(F.lit(False))), lambda x: x))
        new = new.select("query_id", F.col("id").alias("vec_id"), F.aggregate("far", F.lit(0), lambda s, d: s + d).alias("distance"))
        best = top(best.union(top(new).drop("rank"))).drop("rank").checkpoint()
        ended = best.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("kth")).where((F.col("n") == k) & (F.col("kth") <= count * (r + 1) - 1))
        open_ = open_.join(ended, "query_id", "left_anti").checkpoint()
        r += 1
    return top(best).select("query_id", "rank", "vec_id", "distance")


def _scanned(few: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, distance of the k best of every query, by blocks of data and queries."""
    nq = max(1, -(-queries.count() // QUERY_BLOCK))
    nd = max(1, -(-few.count() // DATA_BLOCK))
    few = few.withColumn("db", F.pmod(F.xxhash64("id"), F.lit(nd)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    ask = queries.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(nq)).cast("int")).withColumn("db", F.explode(F.sequence(F.lit(0), F.lit(nd - 1))))

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if len(left) and len(right):
            unpack = lambda t: np.packbits(np.array([list(s.encode()) for s in t.column("bits").to_pylist()], np.uint8) - 48, axis=1).view(np.uint16)
            index = Index(unpack(left), left.column("id").to_numpy())
            for qid, code in zip(right.column("id").to_pylist(), unpack(right)):
                ids, dist, _ = index.search(code, k, qid)
                out[0] += [qid] * len(ids)
                out[1] += ids.tolist()
                out[2] += dist.tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "distance": pa.array(out[2], pa.int32())})

    near = few.groupBy("qb", "db").cogroup(ask.groupBy("qb", "db")).applyInArrow(block, "query_id long, vec_id long, distance int")
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return near.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k).drop("nth")


def oracle_sql(k: int, dims: int = 64) -> str:
    """DuckDB SQL for the same answer over the embeddings table, by comparing each query with every row."""
    return f"""
WITH c AS (SELECT vec_id, list_transform(embedding, lambda v: CASE WHEN v > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings),
p AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.bits, d.bits), lambda z: abs(z[1] - z[2]))) AS INT) AS distance
  FROM c q JOIN c d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INT) AS rank, vec_id, distance
FROM p QUALIFY rank <= {k}
"""
