"""Queries over stand-in workspaces against their SQL, on documents that the given tables may lack."""

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from corvane.operators import types
from corvane.plans import standin
from corvane.sources import facts, typed, typescript
from tests import test_workspace as workspace


@pytest.fixture
def same(spark, tmp_path):
    """Whether a query over documents (doc_id, text) gives the rows of its SQL."""

    def check(docs, *names):
        folder = tmp_path / str(len(list(tmp_path.iterdir())))
        spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
        db = duckdb.connect()
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
        for name in names:
            want = db.execute(entry.oracle_sql()[name])
            columns = [c[0] for c in want.description]
            got = sorted((tuple(r) for r in entry.queries()[name](spark, str(folder)).select(*columns).collect()), key=repr)
            assert got == sorted(want.fetchall(), key=repr), name

    return check


def test_places_in_short_templates(same):
    # the second of two lines is shorter than the column that is asked for; a text holds what ends the template in a file;
    # of two rows of one document the smaller text counts once its returns are spaces
    same([(5, "one\nSu."), (12, "one\n"), (6, "a\nb"), (13, ""), (20, None), (27, "x `;\nimport y\nz\n\n"), (3, "a\rb"), (3, "a\x0eb")], "statement_spans")


def test_sections_hold_all_facts_of_their_kinds(spark, sf):
    rows = standin.files(spark, sf).collect()
    assert len({r.file_path for r in rows}) == len(rows)
    odd = [("a.routes.ts", "export * from './b';\nclass"), ("b.ts", "@Component\n({ template: `x` })\nexport class B { a = 1;\r" + "\r" * 12 + "}"), ("c.ts", ""), ("d.ts", workspace.PANEL), ("e.ts", workspace.FILES["src/app/other.ts"])]
    for path, text in [(r.file_path, r.text) for r in rows if r.file_path.endswith(".ts")][::3] + odd:
        bare = lambda facts: [{k: v for k, v in f.items() if k != "ord"} for f in facts]
        all_ = bare(typescript.facts(path, text))
        for name, (kinds, _) in typescript.SECTIONS.items():
            assert bare(typescript.facts(path, text, sections={name})) == [f for f in all_ if f["kind"] in kinds], (path, name)


def test_queries_parse_no_more_than_they_need(spark, sf, monkeypatch):
    monkeypatch.setattr(standin, "_audits", {})
    standin.ts_projects(spark, sf)
    standin.ts_fans(spark, sf)
    by = {a.sections: a for a in standin._audits.values()}
    assert "facts" not in vars(by[frozenset()]) and set(by) == {frozenset(), frozenset(["import"])}
    with pytest.raises(ValueError):
        by[frozenset(["import"])].of("class")


def test_rows_are_sent_in_parts():
    batch = pa.RecordBatch.from_pydict({"file_path": [f"{i}.ts" for i in range(3_000)], "text": ["x"] * 3_000})
    schema = pa.schema([("file_path", pa.string()), ("n", pa.int64())])
    sent = list(facts.rows_of([batch], lambda p, t: [{"n": k} for k in range(30)], schema))
    assert sum(map(len, sent)) == 90_000 and max(map(len, sent)) < facts.ROWS + 200 * 30


def test_accesses_are_found_without_other_rows(spark):
    files = spark.createDataFrame([("a.ts", workspace.PANEL + "export class Q { m() { this.m(); this.k(); } k = () => 1; }\n")], "file_path string, text string")
    every, some = typed.extract(files), typed.extract(files, kinds=typed.MEANING)
    assert {r.kind for r in some.collect()} <= typed.MEANING and some.count() < every.count()
    both = [sorted(map(tuple, types.references(x, files.select("file_path")).collect())) for x in (every, some)]
    assert both[0] == both[1] and any("#Q.m@" in r[0] for r in both[0])
