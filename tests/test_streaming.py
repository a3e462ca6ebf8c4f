"""The stream of findings gives the same days as the table, once they are closed."""

from pyspark.sql import functions as F

from corvane.streaming import scans


def test_history(spark, tmp_path):
    rows = [(f"2024-01-{d:02d} 0{h}:00:00", s) for d in range(1, 6) for h, s in enumerate(["error", "info", "info", "warning"][: d if d < 5 else 1])]
    src = spark.createDataFrame(rows, "ts string, severity string").select(F.to_timestamp("ts").alias("ts"), "severity")
    src.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in")
    for _ in range(2):  # a second run finds nothing new
        q = scans.keep(scans.daily_counts(stream), f"{tmp_path}/out", f"{tmp_path}/state")
        q.awaitTermination(60)
    got = [(r.day, r.total, r.error, r.recency) for r in scans.history(spark, f"{tmp_path}/out").orderBy("recency").collect()]
    assert got == [("2024-01-03", 3, 1, 1), ("2024-01-02", 2, 1, 2), ("2024-01-01", 1, 1, 3)]
    table = {r.day: r.total for r in scans.daily_counts(src).collect()}
    assert table["2024-01-05"] == 1 and len(table) == 5
