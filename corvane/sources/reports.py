"""Reports and histories as sources: tolerant and narrow parsing of JSON documents, in the JVM.

Types are checked, not cast: a number in a text field counts as missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.functions.scalars import SEVERITIES

REQUIRED = {"schemaVersion": "number", "generatedAt": "text", "workspaceRoot": "text", "angularJsonPath": "text", "projects": "array", "findings": "array"}


def kind(v: Column, path: str = "$") -> Column:
    """text, number, boolean, array, object or null of a field of a variant (null if it isn't there)."""
    s = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(s == "STRING", "text").when(s.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), "number").when(s == "BOOLEAN", "boolean").when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object").otherwise(F.lower(s))


def text(v: Column, path: str) -> Column:
    return F.when(kind(v, path) == "text", F.try_variant_get(v, path, "string"))


def number(v: Column, path: str) -> Column:
    return F.when(kind(v, path) == "number", F.try_variant_get(v, path, "double"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """name and document of JSON files, one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("name"), F.try_parse_json("value").alias("doc"))


def checked(docs: DataFrame) -> DataFrame:
    """Adds error: null for a report of the expected shape."""
    d = F.col("doc")
    missing = F.array_compact(F.array(*[F.when(F.coalesce(kind(d, f"$.{k}") != t, F.lit(True)) | ((F.coalesce(text(d, f"$.{k}"), F.lit("")) == "") if t == "text" else F.lit(False)), F.lit(k)) for k, t in REQUIRED.items()]))
    return docs.withColumn("error", F.when(d.isNull(), "invalid JSON").when(F.coalesce(kind(d), F.lit("")) != "object", "no object").when(F.size(missing) > 0, F.concat(F.lit("no report, missing "), F.array_join(missing, "/"))))


def findings(docs: DataFrame, narrow: bool = False) -> DataFrame:
    """The findings of reports.  Tolerant: fields of a wrong type take defaults, unknown severities count as info.  Narrow:
    rows without a known severity, a code, a message, a path or metadata are dropped."""
    d = docs.where(F.coalesce(kind(F.col("doc"), "$.findings") == "array", F.lit(False)))
    items = d.select("name", F.posexplode(F.try_variant_get("doc", "$.findings", "array<variant>")).alias("ord", "f")).where(F.coalesce(kind(F.col("f")) == "object", F.lit(False)))
    f = F.col("f")
    sev, conf = text(f, "$.severity"), text(f, "$.confidence")
    out = items.select(
        "name", "ord", F.when(sev.isin(*SEVERITIES), sev).alias("severity"), F.coalesce(text(f, "$.category"), F.lit("imports")).alias("category"), F.when(conf.isin("high", "medium", "low"), conf).otherwise("medium").alias("confidence"), text(f, "$.code").alias("code"), text(f, "$.message").alias("message"),
        F.coalesce(text(f, "$.whyItMatters"), F.lit("")).alias("why_it_matters"), text(f, "$.filePath").alias("file_path"), F.when(kind(f, "$.metadata") == "object", F.to_json(F.try_variant_get(f, "$.metadata", "variant"))).alias("metadata"),
    )
    if narrow:
        full = [F.length(F.trim(c)) > 0 for c in ("code", "file_path")]
        return out.where(F.col("severity").isNotNull() & full[0] & full[1] & F.col("message").isNotNull() & F.col("metadata").isNotNull())
    return out.fillna({"severity": "info", "code": "unknown", "message": "", "file_path": "", "metadata": "{}"})


def history(docs: DataFrame) -> DataFrame:
    """Snapshots of scan histories of version 1 that have an id and a time; others are dropped."""
    d = docs.where((number(F.col("doc"), "$.version") == 1) & (kind(F.col("doc"), "$.snapshots") == "array"))
    s = d.select("name", F.explode(F.try_variant_get("doc", "$.snapshots", "array<variant>")).alias("s"))
    out = s.select("name", text(F.col("s"), "$.id").alias("id"), text(F.col("s"), "$.createdAt").alias("created_at"), number(F.col("s"), "$.findingsTotal").cast("long").alias("findings_total"))
    return out.where("id is not null and created_at is not null")


def source_lines(files: DataFrame, wanted: DataFrame, context: int = 6) -> DataFrame:
    """The lines around places: wanted has file_path and line; lines are clamped to the file, context to 0..20."""
    n = max(0, min(20, context))
    x = files.join(wanted, "file_path").withColumn("lines", F.split("text", "\r?\n", -1)).where("line >= 1")
    x = x.withColumn("at", F.least(F.col("line"), F.size("lines"))).withColumn("first", F.greatest(F.lit(1), F.col("at") - n))
    part = F.posexplode(F.slice("lines", F.col("first"), F.least(F.size("lines"), F.col("at") + n) - F.col("first") + 1)).alias("k", "source")
    return x.select("file_path", "line", "at", "first", part).select("file_path", "line", F.col("at").alias("highlight"), (F.col("first") + F.col("k")).alias("number"), "source")
