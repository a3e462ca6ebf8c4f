"""Which statement holds a place: nested spans as an interval index, asked by equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Spans are filed by the power of two that is no less than their length, 2 ** LEAST at least.
LEAST = 6


def _level(length: Column) -> Column:
    return F.greatest(F.lit(LEAST), F.ceil(F.log2(F.greatest(length, F.lit(1)).cast("double")))).cast("int")


def offsets(files: DataFrame, places: DataFrame) -> DataFrame:
    """file_path, line, column, offset, size: places with their offset in the text.  Lines below 1 are left out, later ones are
    clamped to the file, columns to the line."""
    x = files.select("file_path", "text").join(places.where("line >= 1"), "file_path").withColumn("lines", F.split("text", "\n", -1))
    x = x.withColumn("at", F.least(F.col("line"), F.size("lines")))
    before = F.aggregate(F.slice("lines", F.lit(1), F.col("at") - 1), F.lit(0), lambda n, s: n + F.length(s) + 1)
    own = F.length(F.regexp_replace(F.element_at("lines", F.col("at")), "\r$", ""))
    column = F.least(F.greatest(F.coalesce("column", F.lit(1)), F.lit(1)) - 1, own)
    return x.select("file_path", "line", "column", (before + column).cast("int").alias("offset"), F.length("text").alias("size"))


def deepest(spans: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (file_path, offset, size, ...) with n and end of the deepest span (file_path, start, n, end, depth) around it, null
    where there is none.

    A span lies in at most two cells of its level; a place looks into one cell of each level that the size of its file allows, so
    both sides grow by a factor that the longest file bounds, and nothing is compared across files."""
    level = _level(F.col("end") - F.col("start"))
    filed = spans.where("end > start").withColumn("level", level)
    cell = lambda o: F.expr(f"shiftright({o}, level)")
    filed = filed.select("file_path", "level", "start", "n", "end", "depth", F.explode(F.sequence(cell("start"), cell("`end` - 1"))).alias("cell"))
    keyed = asked.withColumn("level", F.explode(F.sequence(F.lit(LEAST), _level(F.col("size"))))).withColumn("cell", cell("offset"))
    hit = keyed.join(filed, ["file_path", "level", "cell"]).where("start <= offset and offset < `end`")
    best = hit.groupBy("file_path", "offset").agg(F.max_by(F.struct("n", "end"), "depth").alias("s")).select("file_path", "offset", "s.n", "s.end")
    return asked.join(best, ["file_path", "offset"], "left")


def statements(files: DataFrame, facts: DataFrame, places: DataFrame) -> DataFrame:
    """file_path, line, column, statement: the text of the closest statement around each place (facts are those of
    `sources.typed`).  Between statements there is none (''); a place at the very end has the whole file."""
    at = offsets(files, places.select("file_path", "line", "column").distinct())
    found = deepest(facts.where("kind = 'stmt'").select("file_path", "start", "n", "end", "depth"), at)
    whole = facts.where("kind = 'file'").select("file_path", F.col("n").alias("first"))
    found = found.join(whole, "file_path", "left").withColumn("n", F.when(F.col("n").isNull() & (F.col("offset") >= F.col("size")), F.col("first")).otherwise(F.col("n"))).withColumn("end", F.coalesce("end", "size"))
    cut = F.regexp_replace(F.substring(F.col("text"), F.col("n") + 1, F.col("end") - F.col("n")), r"^[\s\x{FEFF}\x{A0}]+|[\s\x{FEFF}\x{A0}]+$", "")
    return found.join(files.select("file_path", "text"), "file_path").select("file_path", "line", "column", F.coalesce(cut, F.lit("")).alias("statement"))
