"""The facts of source files, from one pass over the files."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corvane.sources.typescript import SECTIONS, facts as facts_of

SCHEMA = "file_path string, kind string, ord int, cls string, method string, key string, value string, extra string, n long, n2 long, n3 long, n4 long, n5 long, line int, col int"
_ARROW = pa.schema([("file_path", pa.string()), ("kind", pa.string()), ("ord", pa.int32()), *[(c, pa.string()) for c in ("cls", "method", "key", "value", "extra")], *[(c, pa.int64()) for c in ("n", "n2", "n3", "n4", "n5")], ("line", pa.int32()), ("col", pa.int32())])


def analyzable(path) -> F.Column:
    return path.endswith(".ts") & ~path.endswith(".d.ts") & ~path.endswith(".spec.ts")


#: Rows that a task holds before it sends them, and texts that it holds.
ROWS, TEXTS = 4_000, 200


def rows_of(batches: Iterable[pa.RecordBatch], read: Callable[[str, str], list[dict]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """What read gives for each (file_path, text), some thousand rows at a time."""
    held: list[dict] = []
    send = lambda: pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in held], f.type) for f in schema], schema=schema)
    for whole in batches:
        for k in range(0, len(whole), TEXTS):
            b = whole.slice(k, TEXTS)
            for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for r in read(p, t or ""):
                    r["file_path"] = p
                    held.append(r)
                if len(held) >= ROWS:
                    yield send()
                    held = []
    yield send()


def sections_of(*kinds: str) -> set[str]:
    return {name for name, (of, _) in SECTIONS.items() if of & set(kinds)}


def extract(files: DataFrame, sections: Iterable[str] = SECTIONS) -> DataFrame:
    """The facts of every analyzable file, all or those of some sections.  Files are read once; all rules are plans over this table."""
    asked = frozenset(sections)

    def run(batches):
        return rows_of(batches, lambda p, t: facts_of(p, t, sections=asked), _ARROW)

    return files.where(analyzable(F.col("file_path")) & F.col("text").isNotNull()).select("file_path", "text").mapInArrow(run, SCHEMA)
