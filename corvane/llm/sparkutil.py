"""Shared plan pieces: lineage cuts in the shared folder, bounded membership filters, connected components."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bits of a membership filter: 2,048 bitmaps of 32,768 bits, 8 MB, at any input size.
FILTER_BITS = 1 << 26
#: Keys that are broadcast, at most (8 MB as a hash table).
KEYS = 400_000


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches (long texts) unless the session says otherwise, and a checkpoint folder: the cluster's, or in a local
    session one of our own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # Spark's default
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="corvane-"))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def filter_of(keys: DataFrame, name: str) -> DataFrame:
    """(bucket, bits): a bitmap filter of the hashes of a column, of at most 8 MB."""
    h = keys.select(slot(F.col(name)).alias("h")).groupBy("h").agg(F.lit(1).alias("one"))
    return h.groupBy(F.expr("bitmap_bucket_number(h)").alias("flt_bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(h))").alias("flt_bits"))


def maybe_in(df: DataFrame, name: str, flt: DataFrame, hold: bool = True) -> DataFrame:
    """The rows whose key the filter may hold (a few others too); an exact join must follow.  hold=False: the rows that it surely doesn't."""
    x, bit = _looked_up(df, name, flt, "inner" if hold else "left")
    return x.where(bit == 1 if hold else F.coalesce(bit, F.lit(0)) == 0).select(*df.columns)


def _looked_up(df: DataFrame, name: str, flt: DataFrame, how: str) -> tuple[DataFrame, Column]:
    """The rows with their part of the filter, and the bit of each row's key."""
    x = df.withColumn("flt_h", slot(F.col(name)))
    x = x.join(F.broadcast(flt), F.expr("bitmap_bucket_number(flt_h)") == F.col("flt_bucket"), how)
    return x, F.expr("shiftright(cast(conv(hex(substring(flt_bits, cast(bitmap_bit_position(flt_h) div 8 as int) + 1, 1)), 16, 10) as int), cast(bitmap_bit_position(flt_h) % 8 as int)) & 1")


def bits_of(keys: DataFrame, name: str) -> np.ndarray:
    """The same kind of filter for Python workers, of a column of 64-bit hashes: bit (hash mod FILTER_BITS) of at most 8 MB."""
    h = keys.select((F.col(name).bitwiseAND(F.lit(FILTER_BITS - 1)) + 1).alias("h"))
    rows = h.groupBy(F.expr("bitmap_bucket_number(h)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(h))").alias("bits")).collect()
    out = np.zeros((FILTER_BITS >> 15, 4096), np.uint8)
    for r in rows:  # 2,048 rows at most, of 32,768 bits
        out[r["b"] - 1] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.reshape(-1)


def only_owners(src: DataFrame, spare: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The rows of src without those whose (did, dkey) spare lists (texts that another id stands for).

    known: the (did, dkey) of all rows of src.  It says which rows the filter of spare holds by chance; if these are few, src is
    read in one pass and no text is shuffled."""
    pair = F.xxhash64("did", "dkey")
    spare = spare.select(pair.alias("pair")).distinct().withColumn("gone", F.lit(1))
    x, flt = src.withColumn("pair", pair), filter_of(spare, "pair")
    if known is not None:
        flt = cut(flt)
        chance = cut(maybe_in(known.select(pair.alias("pair")).distinct(), "pair", flt).join(spare, "pair", "left").where("gone is null").select("pair"))
        if chance.count() <= KEYS:
            y, bit = _looked_up(x, "pair", flt, "left")
            y = y.join(F.broadcast(chance.withColumn("owner", F.lit(1))), "pair", "left")
            return y.where((F.coalesce(bit, F.lit(0)) == 0) | F.col("owner").isNotNull()).select(*src.columns)
    # an anti-join would be moved before the filter, with all texts
    rest = maybe_in(x, "pair", flt).join(spare, "pair", "left").where("gone is null")
    return maybe_in(x, "pair", flt, hold=False).union(rest.select(*x.columns)).drop("pair")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, comp): the smallest node reachable over the edges, by neighbour minima and pointer jumping.

    Each round is checkpointed; groups are pre-aggregated before each shuffle, so a node with many edges is no hot task."""
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    e = e.union(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).groupBy("x", "y").agg(F.lit(1).alias("one")).select("x", "y").checkpoint()
    lab = e.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("comp")).checkpoint()
    for _ in range(rounds):
        near = e.join(lab.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("comp").alias("m"))
        nxt = lab.join(near.withColumnRenamed("x", "node"), "node").select("node", "comp", F.least("comp", "m").alias("low"))
        # hook the root of a label as well, then jump
        hook = nxt.groupBy(F.col("comp").alias("node")).agg(F.min("low").alias("hook"))
        nxt = nxt.join(hook, "node", "left").select("node", "comp", F.least("low", F.coalesce("hook", "low")).alias("low"))
        jump = nxt.select(F.col("node").alias("low"), F.col("low").alias("far"))
        nxt = nxt.join(jump, "low", "left").select("node", F.least("low", F.coalesce("far", "low")).alias("comp"), F.col("comp").alias("was")).checkpoint()
        moved = nxt.where("comp <> was").limit(1).count()
        lab = nxt.select("node", "comp")
        if not moved:
            break
    else:
        raise RuntimeError("components did not settle")
    return lab


_written: list[tuple] = []


def cut(df: DataFrame) -> DataFrame:
    """The table, written as Parquet in the shared checkpoint folder and read again; deleted when the driver ends."""
    import atexit
    import uuid

    sc = df.sparkSession.sparkContext
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(_clean)
    _written.append((sc, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _clean() -> None:
    for sc, path in _written:
        try:
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended; its folder goes with the application
            return
