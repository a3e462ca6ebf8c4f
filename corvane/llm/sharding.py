"""Operator 5 [native]: shards of at most LIMIT bytes by extendible hashing.

A document's key is 60 bits of a hash of its id and text; the directory is indexed by key prefixes.  A bucket that holds more
than the limit splits on its next bit, and only that one; a bucket stands when it fits or holds a single document.  Sizes are
pre-aggregated at a prefix a few bits longer than the number of shards asks for, and ancestors are sums of these; only the
documents of buckets that are still too large there are looked at again, with more bits.  Rows that agree in all 60 bits
(repeated rows) can't be split by hashing; those beyond the limit are numbered into parts that fit.

Null ids and texts hash as such.  Empty texts take 0 bytes.  A text over the limit gets a shard of its own.  An empty table
gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .sparkutil import prepare

LIMIT = 16 << 20
BITS = 60


def _key(doc_id: Column, text: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text.cast("string"), F.lit("")))))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def _bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _bytes(F.col("text")).alias("n_bytes"), _key(F.col("doc_id"), F.col("text")).alias("key"))


def _prefix(depth: int):
    return F.shiftright("key", BITS - depth)


def _directory(sums: DataFrame, base: int, depth: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Of sums (p, b, n) at depth: (p -> leaf with d, shard, b, n) for buckets that fit, and the p that must go deeper.
    Buckets at base are known to be too large (base 0: the whole table, which may fit)."""
    up = sums.withColumn("d", F.explode(F.sequence(F.lit(base), F.lit(depth)))).withColumn("q", F.expr(f"shiftright(p, {depth} - d)"))
    node = up.groupBy("d", "q").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
    node = node.withColumn("stands", (F.col("b") <= limit) | (F.col("n") == 1))
    x = up.select("p", "d", "q").join(node, ["d", "q"])
    first = x.groupBy("p").agg(F.min(F.when(F.col("stands"), F.struct("d", "q", "b", "n"))).alias("leaf"))
    found = first.where("leaf is not null").select("p", "leaf.*")
    return found, first.where("leaf is null").select("p")


def _placed(docs: DataFrame, limit: int) -> DataFrame:
    """doc_id, n_bytes, key, d, q (the bucket's depth and prefix), b, n (its bytes and documents) and part of each document."""
    prepare(docs.sparkSession)
    left = keyed(docs).checkpoint()
    total = left.agg(F.sum("n_bytes")).first()[0] or 0
    base, depth = 0, min(BITS, 4 + max(0, math.ceil(math.log2(max(1, total / limit)))))
    done = None
    while True:
        at = left.withColumn("p", _prefix(depth))
        sums = at.groupBy("p").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        found, deeper = _directory(sums.checkpoint(), base, depth, limit)
        found, deeper = found.checkpoint(), deeper.checkpoint()
        part = at.join(found, "p").select("doc_id", "n_bytes", "key", "d", "q", "b", "n", F.lit(None).cast("int").alias("part"))
        done = part if done is None else done.union(part)
        if not deeper.limit(1).count():
            break
        left = at.join(deeper, "p", "left_semi").drop("p").checkpoint()
        if depth == BITS:
            over = _parts(left, limit)
            by = over.groupBy("key", "part").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
            done = done.union(over.join(by, ["key", "part"]).select("doc_id", "n_bytes", "key", F.lit(BITS).alias("d"), F.col("key").alias("q"), "b", "n", "part"))
            break
        base, depth = depth, min(BITS, depth + 8)
    return done


def _parts(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of equal keys (equal texts) numbered into parts that fit: each partition numbers its own, then sums over partitions
    shift them, so a key with very many rows is no single task's.  rows must be checkpointed."""
    x = rows.withColumn("seq", F.monotonically_increasing_id()).withColumn("slice", F.shiftright("seq", 33))
    own = Window.partitionBy("key", "slice")
    x = x.withColumn("nth", F.row_number().over(own.orderBy("seq")) - 1)
    n = x.groupBy("key", "slice").agg(F.count("*").alias("rows"))
    n = n.withColumn("before", F.coalesce(F.sum("rows").over(Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.lit(1), F.col("n_bytes"))))
    return x.join(n.drop("rows"), ["key", "slice"]).withColumn("part", F.floor((F.col("nth") + F.col("before")) / each).cast("int")).drop("seq", "slice", "nth", "before")


def _name(d: str = "d", q: str = "q", part: str = "part"):
    bits = F.when(F.col(d) == 0, F.lit("")).otherwise(F.expr(f"lpad(bin({q}), {d}, '0')"))
    return F.concat(bits, F.when(F.col(part).isNull(), F.lit("")).otherwise(F.concat(F.lit("."), F.col(part).cast("string"))))


def assign(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, depth, shard (the bits of its prefix, and the part of an overflow), shard_bytes, shard_docs."""
    x = _placed(docs, limit)
    return x.select("doc_id", "n_bytes", F.col("d").cast("int").alias("depth"), _name().alias("shard"), F.col("b").alias("shard_bytes"), F.col("n").alias("shard_docs"))


def write(docs: DataFrame, path: str, limit: int = LIMIT) -> str:
    """The documents with all their columns as Parquet, a folder for each shard of assign; returns the folders' column (shard,
    or shard_ with underscores where the documents have such a column), whose values are b and the shard's bits, so that readers
    don't take them for numbers.  A document goes by the hash of its id and text, so
    rows without an id and other texts of an id find their own shard."""
    name = "shard"
    while name in docs.columns:
        name += "_"
    of = _placed(docs, limit).groupBy("key").agg(F.min("d").alias("own_d"), F.min("q").alias("own_q"), F.max("part").alias("own_part"))
    names = {c: f"own_col{k}" for k, c in enumerate(docs.columns)}
    x = docs.select(*[F.col(c).alias(n) for c, n in names.items()], _key(docs["doc_id"], docs["text"]).alias("key"), _bytes(docs["text"]).alias("n_bytes"))
    x = x.join(of, "key")
    over = _parts(x.where("own_part > 0").checkpoint(), limit)
    x = x.where("own_part is null or own_part = 0").withColumn("part", F.col("own_part")).unionByName(over)
    out = x.select(*[F.col(n).alias(c) for c, n in names.items()], F.concat(F.lit("b"), _name("own_d", "own_q")).alias(name))
    out.repartition(name).write.partitionBy(name).parquet(path)
    return name


ORACLE_SQL = f"""
WITH b AS (SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS k FROM documents),
n AS (SELECT d, k >> ({BITS} - d) AS q, CAST(sum(n_bytes) AS BIGINT) AS b, count(*) AS n FROM b, (SELECT CAST(range AS INT) AS d FROM range({BITS} + 1)) GROUP BY ALL),
leaf AS (SELECT x.* FROM n x LEFT JOIN n p ON p.d = x.d - 1 AND p.q = x.q >> 1
  WHERE (x.b <= {LIMIT} OR x.n = 1) AND (x.d = 0 OR (p.b > {LIMIT} AND p.n > 1)))
SELECT doc_id, n_bytes, d AS depth, CASE WHEN d = 0 THEN '' ELSE lpad(bin(q), d, '0') END AS shard, b AS shard_bytes, n AS shard_docs
FROM b JOIN leaf ON leaf.q = b.k >> ({BITS} - d)
"""
