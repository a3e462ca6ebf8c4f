"""A stand-in workspace for what needs syntax trees and types, written from the documents: id and text of each document.

Document i gives a library file (three classes), one or two files that pass its class on under another name, a user of it whose
first statement is a template with the document's whole text, a function with a block that other documents repeat, and nested
classes.  Expected rows are SQL over ids and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.functions.scalars import fnv1a_py
from corvane.operators import blocks, duplicates, findings as R, graph, orders, spans, types
from corvane.operators.session import checkpointing
from corvane.plans import views
from corvane.sources import facts, typed
from corvane.sources.typescript import exact_block, raw_tokens


def _fmt(text: str, *cols: Column | str) -> Column:
    """i for each %d."""
    return F.format_string(text, *(cols or [F.col("i")] * text.count("%d")))


LIBRARY = "export class Base%d {\n  id() { return 'x'; }\n}\nexport class Svc%d extends Base%d {\n  child = new Kid%d();\n  load() { return this; }\n}\nexport class Kid%d {\n  run() {}\n}\n"
PASSED = "export { Svc%d as Alias%d } from './a%d';\n"
USER = """import { Alias%d } from '../lib/b';
export class Use%d {
  static one = new Alias%d();
  constructor(private readonly svc: Alias%d) {}
  go() {
    this.svc.load().child.run();
    const s = this.svc;
    for (const x of [s]) { x.load().id(); }
    return Use%d.one;
  }
}
new Use%d(null!).go().load();
"""
NESTED = """export const make = () => {
  class Inner%d { static s = 1; go(a: number) { return () => class { deep() { return a; } }; } }
  return new Inner%d();
};
type Pick<T> = T extends string ? A%d : B;
export const later = class Named%d { get it() { return make(); } };
"""


CALLED = "const table = [{ path: 'a%d' }, { path: 'b', children: [{ path: 'c%d' }] }];\nexport const app = RouterModule.forRoot(table);\nprovideRouter([{ path: 'p%d' }]);\nother([{ path: 'no' }]);\n"
BRANCHES = """export class B%d {
  m(a: number) {
    for (const x of [1]) {}
    for (let i = 0; i < 1; i++) {}
    while (a) {}
    do {} while (a);
    switch (a) { case 1: break; case 2: break; default: }
    try {} catch (e) {}
    return a ? 1 : 2;
  }
}
"""
FIELDS = """export class W%d {
  start() {
    this.sub = this.a$.subscribe();
    this.sub = this.b$.subscribe();
    this.kept = this.c$.subscribe();
    this.timer = setInterval(() => {}, 5);
    this.timer = setInterval(() => {}, 9);
  }
  ngOnDestroy() { this.kept.unsubscribe(); }
}
"""
STEMS = ("b", "B", "é", "e", "_x", "-x", "Z", "ä")
ORDERED = "import './%s';\nexport class K%d {\n" + "  // pad\n" * 6 + "  run() { return this.run(); }\n  run() { return this.run(); }\n  Run() { return 1; }\n}\n"


def block(c: int) -> str:
    return "{\n  let total = 0;\n" + "".join(f"  total = total + step(values[{k}], weight, offset, {c}) * scale;\n" for k in range(11)) + "  return total;\n}"


def stem(i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, STEMS)), (i % len(STEMS)).cast("int") + 1)


def files(spark: SparkSession, sf: str, *folders: str) -> DataFrame:
    """(file_path, text) of some folders: lib, use, blk, cls, shp, ord."""
    d = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id is not null").select(F.col("doc_id").cast("long").alias("i"), F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit(" ")).alias("t"))
    d = d.groupBy("i").agg(F.min("t").alias("t"))
    quoted = F.replace(F.replace(F.replace("t", F.lit("\\"), F.lit("\\\\")), F.lit("`"), F.lit("\\`")), F.lit("${"), F.lit("\\${"))
    body = F.element_at(F.array(*[F.lit(block(c)) for c in range(5)]), F.expr("cast(i % 5 as int)") + 1)
    kinds = [F.concat(_fmt("export function f%d(values, weight, offset, scale) "), body, F.lit("\n")), F.concat(_fmt("export const f%d = (values, weight, offset, scale) => "), body, F.lit(";\n"))]
    kinds += [F.concat(_fmt("export class F%d { get v() "), body, F.lit(" }\n")), F.concat(_fmt("export class F%d { constructor() "), body, F.lit(" }\n"))]
    one = lambda path, text, cond="true": F.when(F.expr(cond), F.struct(_fmt(path).alias("file_path"), text.alias("text")))
    rows = {
        "lib": [one("lib/a%d.ts", _fmt(LIBRARY)), one("lib/c%d.ts", _fmt(PASSED), "i % 2 = 1")],
        "use": [one("use/u%d.ts", F.concat(F.lit("const note = `"), quoted, F.lit("`;\n"), F.replace(_fmt(USER), F.lit("'../lib/b'"), F.concat(F.lit("'../lib/b"), F.expr("cast(i div 10 as string)"), F.lit("'")))))],
        "blk": [one("blk/f%d.ts", F.element_at(F.array(*kinds), F.expr("cast(i % 4 as int)") + 1))],
        "cls": [one("cls/k%d.ts", _fmt(NESTED))],
        "shp": [one("shp/r%d.routes.ts", _fmt(CALLED)), one("shp/b%d.ts", _fmt(BRANCHES)), one("shp/w%d.ts", _fmt(FIELDS))],
        "ord": [F.struct(F.format_string("ord/%s%d.ts", stem(F.col("i")), "i").alias("file_path"), F.format_string(ORDERED, F.concat(stem(F.col("i") + 3), (F.col("i") + 3).cast("string")), "i").alias("text"))],
    }
    out = d.select(F.explode(F.array_compact(F.array(*[r for f in folders for r in rows[f]]))).alias("f")).select("f.*")
    if "lib" in folders:
        line = F.when(F.expr("i % 2 = 1"), _fmt("export * from '../c%d';")).otherwise(_fmt("export { Svc%d as Alias%d } from '../a%d';"))
        index = d.select(F.expr("i div 10").alias("g"), line.alias("line")).groupBy("g").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("text"))  # ten lines at most
        out = out.union(index.select(F.format_string("lib/b%d/index.ts", "g"), "text"))
    return out.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file_path")  # parsing costs more than moving the texts, which come in few row groups


def typed_references(s: SparkSession, d: str) -> DataFrame:
    """Property accesses that mean methods: through injected fields, results, locals, items, statics, other names and barrels."""
    checkpointing(s)
    f = files(s, d, "lib", "use")
    return types.references(typed.extract(f).checkpoint(), f.select("file_path"))


def method_drilldown(s: SparkSession, d: str) -> DataFrame:
    """Each method with the places that use it and the repeated blocks in it."""
    checkpointing(s)
    f = files(s, d, "lib", "use", "blk")
    x = typed.extract(f).checkpoint()
    end = F.when(F.col("file_path").startswith("blk/"), F.lit(99)).otherwise(F.col("line"))
    m = x.where("kind = 'member' and other in ('method', 'get')").select(F.concat(F.lit("method:"), F.regexp_replace("cls", r"@\d+$", ""), F.lit("."), F.col("name"), F.lit("@"), F.col("line")).alias("id"), "file_path", F.col("line").alias("start_line"), end.alias("end_line"))
    b = blocks.of(x)
    out = views.drilldown(m, types.references(x, f.select("file_path")), duplicates.occurrences(b, blocks.repeated(b)))
    places = F.array_join(F.transform("references", lambda r: F.concat_ws(":", r["file_path"], r["line"].cast("string"), r["col"].cast("string"))), " ")
    return out.select("id", places.alias("places"), F.array_join("groups", " ").alias("groups"))


def block_groups(s: SparkSession, d: str) -> DataFrame:
    """Repeated blocks of functions, arrows, accessors and constructors."""
    found = blocks.repeated(blocks.of(typed.extract(files(s, d, "blk"))))
    return found.select("id", "kind", "hash", "occurrences", F.col("line_count").cast("long").alias("line_count"), F.col("token_count").cast("long").alias("token_count"), "first_file")


def statement_spans(s: SparkSession, d: str) -> DataFrame:
    """The statements around three places of each user: in its template, in its method, and past its end."""
    f = files(s, d, "use").checkpoint() if checkpointing(s) is None else None
    lines = F.split("text", "\n", -1)
    n = F.size(lines) - 1 - USER.count("\n")  # lines up to the template's end, whatever its text holds
    i = F.regexp_extract("file_path", r"(\d+)", 1).cast("long")
    middle = (n + 1 - F.ceil(n / 2)).cast("int")
    column = F.when(middle == n, F.least(i % 7 + 1, F.length(F.element_at(lines, middle)) - 1)).otherwise(i % 7 + 1)  # no further than the closing quote
    at = F.array(F.struct(middle.alias("line"), column.cast("int").alias("column")), F.struct((n + 6).cast("int").alias("line"), F.lit(9).alias("column")), F.struct(F.lit(1 << 30).alias("line"), F.lit(1 << 30).alias("column")))
    places = f.select("file_path", F.posexplode(at).alias("nth", "p")).select("file_path", "nth", "p.line", "p.column")
    found = spans.statements(f, typed.extract(f), places)
    return places.join(found, ["file_path", "line", "column"]).select("file_path", "nth", F.length("statement").alias("size"), F.md5("statement").alias("digest"))


def tree_members(s: SparkSession, d: str) -> DataFrame:
    """Members of classes inside functions, of class expressions and of named ones."""
    x = typed.extract(files(s, d, "cls")).where("kind in ('class', 'member')")
    names = x.where("kind = 'class'").select("cls", F.coalesce("name", F.lit("")).alias("class_name"))
    return x.where("kind = 'member'").drop("base", "of", "steps").join(names, "cls").select("file_path", "class_name", F.col("name").alias("member"), F.col("other").alias("member_kind"), F.col("static").alias("is_static"))


def locale_methods(s: SparkSession, d: str) -> DataFrame:
    """Methods by path, class, name and line as text: letters before case, 10 before 9."""
    m = typed.extract(files(s, d, "ord")).where("kind = 'member'").select("file_path", F.regexp_extract("cls", "#(.*)@", 1).alias("class_name"), "name", F.col("line").alias("start_line"))
    return R.number_rows(m, orders.methods(), "rank").select("rank", "file_path", "name", "start_line")


def locale_occurrences(s: SparkSession, d: str) -> DataFrame:
    """Places by path and line as text."""
    m = typed.extract(files(s, d, "ord")).where("kind = 'member'").select("file_path", F.col("line").alias("start_line"))
    return R.number_rows(m, orders.occurrences(), "rank").select("rank", "file_path", "start_line")


def locale_references(s: SparkSession, d: str) -> DataFrame:
    """Uses of methods by method, path, line and column as text."""
    checkpointing(s)
    f = files(s, d, "ord")
    refs = types.references(typed.extract(f).checkpoint(), f.select("file_path"))
    return R.number_rows(refs, orders.references(), "rank").select("rank", "method_id", "file_path", "line", "col")


def locale_findings(s: SparkSession, d: str) -> DataFrame:
    """Rows of files by path and code, ties in the order in which they were found."""
    x = typed.extract(files(s, d, "ord")).where("kind in ('member', 'ref')").select("file_path", F.col("kind").alias("code"), "ord", "name", "line")
    return R.number_rows(x, orders.findings(), "rank").select("rank", "file_path", "code", "name", "line")


def locale_edges(s: SparkSession, d: str) -> DataFrame:
    """Import edges by source and target."""
    f = files(s, d, "ord")
    specs = typed.extract(f).where("kind = 'import'").select("file_path", "spec")
    e = graph.resolve(specs, f.select("file_path"))
    return R.number_rows(e, orders.paths("src", "dst"), "rank").select("rank", "src", "dst")


def duplicate_candidates(s: SparkSession, d: str) -> DataFrame:
    """Groups of repeated blocks, greatest saving first."""
    return R.number_rows(blocks.repeated(blocks.of(typed.extract(files(s, d, "blk")))), orders.duplicate_candidates(), "rank").select("rank", "id", "occurrences")


def route_calls(s: SparkSession, d: str) -> DataFrame:
    """Routes of arrays that are passed to a router, by name or as they are."""
    x = facts.extract(files(s, d, "shp").where("file_path like '%.routes.ts'"))
    return x.where("kind = 'route'").select("file_path", F.col("key").alias("path"))


def branch_kinds(s: SparkSession, d: str) -> DataFrame:
    """Branches of loops, cases, catches and conditionals, of a method and of its file."""
    x = facts.extract(files(s, d, "shp").where("file_path like 'shp/b%'"))
    return x.where("kind in ('method', 'complexity')").select("file_path", "kind", F.when(F.col("kind") == "method", F.col("n3")).otherwise(F.col("n5")).alias("branches"))


def first_per_field(s: SparkSession, d: str) -> DataFrame:
    """A subscription field without its clean-up is reported once, at its first place; timers at each."""
    from corvane.plans import audit

    found = audit.lifecycle_findings(facts.extract(files(s, d, "shp").where("file_path like 'shp/w%'")))
    return found.select("file_path", "code", F.col("detail").alias("field"), "line")


_DOCS = "d AS (SELECT i, min(t) AS t FROM (SELECT doc_id AS i, replace(coalesce(text, ''), chr(13), ' ') AS t FROM documents WHERE doc_id IS NOT NULL) GROUP BY i)"
_NOTE = "'const note = `' || replace(replace(replace(t, '\\', '\\\\'), '`', '\\`'), '${', '\\${') || '`;'"
_TAIL = "chr(10) || replace(replace('" + USER.replace("'", "''") + "', '%d', CAST(i AS VARCHAR)), '../lib/b', '../lib/b' || (i // 10))"
_HASHES = " ".join(f"WHEN {c} THEN '{fnv1a_py(exact_block(block(c)))}'" for c in range(5))
_SHAPE = fnv1a_py(" ".join(raw_tokens(block(0))))
_LINES, _TOKENS = block(0).count("\n") + 1, len(raw_tokens(block(0)))
SQL = {
    "typed_references": f"""WITH {_DOCS}, n AS (SELECT i, 2 + length(t) - length(replace(t, chr(10), '')) AS b, length(CAST(i AS VARCHAR)) AS w FROM d)
SELECT 'method:' || replace(CASE WHEN m = 'Use' THEN 'use/u%d.ts#Use%d.go@' || (b + 4) ELSE 'lib/a%d.ts#' || m END, '%d', CAST(i AS VARCHAR)) AS method_id, 'use/u' || i || '.ts' AS file_path, CAST(b + l AS INT) AS line, CAST(c + v * w AS INT) AS col
FROM n, (VALUES ('Svc%d.load@6', 5, 14, 0), ('Kid%d.run@9', 5, 27, 0), ('Svc%d.load@6', 7, 30, 0), ('Base%d.id@2', 7, 37, 0), ('Use', 11, 16, 1), ('Svc%d.load@6', 11, 21, 1)) x(m, l, c, v)""",
    "block_groups": f"""WITH {_DOCS}, b AS (SELECT 'blk/f' || i || '.ts' AS f, unnest([['exact', CASE i % 5 {_HASHES} END], ['normalized', '{_SHAPE}']]) AS k FROM d)
SELECT 'dup:' || k[1] || ':' || k[2] AS id, k[1] AS kind, k[2] AS hash, count(*) AS occurrences, CAST({_LINES} AS BIGINT) AS line_count, CAST({_TOKENS} AS BIGINT) AS token_count, arg_min(f, icu_sort_key(f || chr(10) || '1', 'en')) AS first_file
FROM b GROUP BY k HAVING count(DISTINCT f) > 1""",
    "statement_spans": f"""WITH {_DOCS}, s AS (SELECT i, unnest([{_NOTE}, 'this.svc.load().child.run();', rtrim({_NOTE} || {_TAIL}, chr(10))]) AS x, unnest([0, 1, 2]) AS nth FROM d)
SELECT 'use/u' || i || '.ts' AS file_path, CAST(nth AS INT) AS nth, CAST(length(x) AS INT) AS size, md5(x) AS digest FROM s""",
    "tree_members": f"""WITH {_DOCS} SELECT 'cls/k' || i || '.ts' AS file_path, replace(c, '%d', CAST(i AS VARCHAR)) AS class_name, m AS member, k AS member_kind, s AS is_static
FROM d, (VALUES ('Inner%d', 's', 'field', true), ('Inner%d', 'go', 'method', false), ('', 'deep', 'method', false), ('Named%d', 'it', 'get', false)) x(c, m, k, s)""",
}
_STEM = "(" + str(list(STEMS)) + ")[%s %% " + str(len(STEMS)) + " + 1] || (%s)"
_FILE = f"'ord/' || {_STEM % ('i', 'i')} || '.ts'"
_KEY = "icu_sort_key(%s, 'en')"
_N = "row_number() OVER (ORDER BY %s) AS rank"
_LINES9 = "(VALUES ('run', 9), ('run', 10), ('Run', 11)) m(name, l)"
SQL |= {
    "locale_methods": f"WITH {_DOCS}, x AS (SELECT {_FILE} AS file_path, 'K' || i AS c, name, CAST(l AS INT) AS start_line FROM d, {_LINES9}) SELECT {_N % (_KEY % 'file_path || chr(10) || c || chr(10) || name || chr(10) || start_line')}, file_path, name, start_line FROM x",
    "locale_occurrences": f"WITH {_DOCS}, x AS (SELECT {_FILE} AS file_path, CAST(l AS INT) AS start_line FROM d, {_LINES9}) SELECT {_N % (_KEY % 'file_path || chr(10) || start_line')}, file_path, start_line FROM x",
    "locale_references": f"WITH {_DOCS}, x AS (SELECT {_FILE} AS file_path, i, CAST(l AS INT) AS line, 23 AS col FROM d, (VALUES (9), (10)) m(l)), y AS (SELECT *, 'method:' || file_path || '#K' || i || '.run@10' AS method_id FROM x) SELECT {_N % (_KEY % 'method_id || chr(10) || file_path || chr(10) || line || chr(10) || col')}, method_id, file_path, line, col FROM y",
    "locale_findings": f"WITH {_DOCS}, x AS (SELECT {_FILE} AS file_path, code, name, CAST(l AS INT) AS line, o FROM d, (VALUES ('member', 'run', 9, 0), ('member', 'run', 10, 1), ('member', 'Run', 11, 2), ('ref', 'run', 9, 3), ('ref', 'run', 10, 4)) m(code, name, l, o)) SELECT {_N % (_KEY % 'file_path || chr(10) || code' + ', o')}, file_path, code, name, line FROM x",
    "locale_edges": f"WITH {_DOCS}, f AS (SELECT {_FILE} AS src, 'ord/' || {_STEM % ('(i + 3)', 'i + 3')} || '.ts' AS dst FROM d), e AS (SELECT src, dst FROM f WHERE dst IN (SELECT src FROM f)) SELECT {_N % (_KEY % 'src' + ', ' + _KEY % 'dst')}, src, dst FROM e",
    "duplicate_candidates": "WITH g AS (" + SQL["block_groups"] + ") SELECT row_number() OVER (ORDER BY line_count * occurrences DESC, icu_sort_key(id, 'en')) AS rank, id, occurrences FROM g",
}
SQL |= {
    "route_calls": f"WITH {_DOCS} SELECT 'shp/r' || i || '.routes.ts' AS file_path, unnest(['a' || i, 'b', 'c' || i, 'p' || i]) AS path FROM d",
    "branch_kinds": f"WITH {_DOCS} SELECT 'shp/b' || i || '.ts' AS file_path, unnest(['method', 'complexity']) AS kind, CAST(9 AS BIGINT) AS branches FROM d",
    "first_per_field": f"WITH {_DOCS} SELECT 'shp/w' || i || '.ts' AS file_path, c AS code, f AS field, CAST(l AS INT) AS line FROM d, (VALUES ('lifecycle-subscription-field-not-unsubscribed', 'sub', 3), ('lifecycle-setInterval-no-clearInterval', 'timer', 6), ('lifecycle-setInterval-no-clearInterval', 'timer', 7)) x(c, f, l)",
}
SQL["method_drilldown"] = f"""WITH {_DOCS}, n AS (SELECT i, 2 + length(t) - length(replace(t, chr(10), '')) AS b FROM d),
m AS (SELECT 'method:lib/a' || i || '.ts#' || replace(m, '%d', CAST(i AS VARCHAR)) AS id, '' AS groups FROM d, (VALUES ('Base%d.id@2'), ('Svc%d.load@6'), ('Kid%d.run@9')) x(m)
  UNION ALL SELECT 'method:use/u' || i || '.ts#Use' || i || '.go@' || (b + 4), '' FROM n
  UNION ALL SELECT 'method:blk/f' || i || '.ts#F' || i || '.v@1', string_agg(g.id, ' ' ORDER BY g.id) FROM d JOIN ({SQL["block_groups"]}) g ON g.id IN ('dup:normalized:{_SHAPE}', 'dup:exact:' || CASE i % 5 {_HASHES} END) WHERE i % 4 = 2 GROUP BY i)
SELECT m.id, coalesce(string_agg(r.file_path || ':' || r.line || ':' || r.col, ' ' ORDER BY r.file_path, r.line, r.col), '') AS places, m.groups FROM m LEFT JOIN ({SQL["typed_references"]}) r ON r.method_id = m.id GROUP BY m.id, m.groups"""
NAMES = list(SQL)
QUERIES = {n: globals()[n] for n in NAMES}
