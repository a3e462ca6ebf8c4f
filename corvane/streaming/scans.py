"""Scan snapshots of a stream of findings: daily counts with a watermark, kept in a history that survives restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corvane.operators.snapshots import newest

SEVERITIES = ("error", "warning", "info")


def daily_counts(found: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Counts by day and severity of a stream (or table) with ts and severity; rows later than the watermark are left out,
    and a day is emitted once it can't change any more."""
    day = F.window("ts", "1 day")
    out = found.withWatermark("ts", lateness).groupBy(day.alias("w")).agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "total", *SEVERITIES)


def _states(spark, path: str) -> list[tuple[int, str]]:
    """The finished states of a history, oldest first."""
    name = spark._jvm.org.apache.hadoop.fs.Path
    top = name(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    found = [(s.getPath().getName(), s.getPath()) for s in fs.listStatus(top)]
    return sorted((int(n.split("=")[1]), p.toString()) for n, p in found if n.startswith("state=") and fs.exists(name(p, "_SUCCESS")))


def keep(counts: DataFrame, path: str, checkpoint: str, most: int = 20, order: str = "day", tie: str = "day", **trigger):
    """Keep the newest `most` scans of a stream.  A batch writes the whole kept list as a new state, made of the newest finished
    state before it; readers take the newest finished one, so a crash while writing leaves the old list in force, a batch that is
    run again writes the same, and older states go only after the new one stands."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = [p for n, p in _states(spark, path) if n < epoch]
        rows = batch.unionByName(spark.read.parquet(before[-1])) if before else batch
        rows.orderBy(F.desc(order), F.desc(tie)).limit(most).coalesce(1).write.mode("overwrite").parquet(f"{path}/state={epoch}")
        name = spark._jvm.org.apache.hadoop.fs.Path
        for old in before[:-1]:  # the last one stays, should this batch be run again
            name(old).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(name(old), True)

    return counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()


def history(spark, path: str, most: int = 20) -> DataFrame:
    """The newest days of a history."""
    return newest(spark.read.parquet(_states(spark, path)[-1][1]), "day", "day", most)
