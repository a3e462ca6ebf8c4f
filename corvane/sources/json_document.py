"""One large JSON document, written by executors.

A document is a table of lines: `key` says where a line stands (an array of (number, name) items, compared one by one, names in
locale order), `item` whether it is an element of a list, `text` is a piece of the document.  Lines are sorted by range, each task
writes its part and puts commas before items that don't follow an opening bracket, and the driver joins the parts byte by byte: it
holds no row, only the first and last byte of each part.  The parts are written by Spark's own commit protocol, and the joined
file takes its name by a rename, so a reader never sees half a document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corvane.operators.session import checkpointing


def at(number: int | Column, name: str | Column = "") -> Column:
    """An item of a key."""
    name = F.lit(name) if isinstance(name, str) else F.coalesce(name, F.lit(""))
    return F.struct((F.lit(number) if isinstance(number, int) else number).cast("int").alias("n"), F.collate(name, "UNICODE").alias("s"), name.alias("raw"))


def lines(df: DataFrame, key: list[Column] | Column, text: Column | str, item: bool = True) -> DataFrame:
    key = F.array(*key) if isinstance(key, list) else key
    return df.select(key.alias("key"), F.lit(item).alias("item"), (F.lit(text) if isinstance(text, str) else text).alias("text"))


def _commas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first item of a part always gets a comma; the driver takes it back where the part before ends with a bracket."""
    before = ""
    for b in batches:
        out = []
        for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            out.append("," + text if item and not before.endswith("[") else text)
            before = text
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


def write(document: DataFrame, path: str, partitions: int | None = None) -> None:
    """Writes the lines as one file."""
    spark = document.sparkSession
    checkpointing(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = document.checkpoint()  # the sort reads its input twice
    ordered = rows.repartitionByRange(n, "key").sortWithinPartitions("key").select("item", "text").mapInArrow(_commas, "value string")
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    name = jvm.org.apache.hadoop.fs.Path
    target = name(path)
    fs = target.getFileSystem(conf)
    target = target.makeQualified(fs.getUri(), fs.getWorkingDirectory())
    parts, joined = name(target.getParent(), f".parts-{uuid.uuid4().hex}"), name(target.getParent(), f".joined-{uuid.uuid4().hex}")
    try:
        ordered.write.option("lineSep", "\n").text(parts.toString())
        files = sorted((s.getPath().getName(), s.getPath(), s.getLen()) for s in fs.listStatus(parts) if s.getPath().getName().startswith("part-") and s.getLen() > 0)
        out, last = fs.create(joined, True), 0
        for _, part, size in files:
            src = fs.open(part)
            first = src.read()
            if first != ord(",") or last != ord("["):
                out.write(first)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(src, out, 1 << 20, False)
            if size > 1:
                src.seek(size - 2)  # the byte before the line's end
                last = src.read()
            src.close()
        out.close()
        fs.delete(target, False)
        if not fs.rename(joined, target):
            raise OSError(f"{joined.toString()} can't be renamed to {path}")
    finally:
        fs.delete(parts, True)
        fs.delete(joined, False)
