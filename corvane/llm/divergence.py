"""Operator 12: how far the sources of a language differ in their terms, from mergeable radix tries.

Terms are runs of the bytes A-Z (lowered), a-z and 0x80 up.  A task counts its documents into byte tries, one a language, with a
counter a source at each leaf and the number of documents: nodes branch by a byte until a container of CONTAINER leaves is left,
and containers are sent off, in UTF-8 order, when a task has LEAVES leaves or COUNTERS counters.  These subtrees are dealt out by ranges of prefixes
(language, term); a task merges those of its range (about ROWS leaves) in a radix trie and keeps the terms of MIN_DOCS documents.  Kept terms meet their language's sources in blocks of TERMS terms and two tiles of about
TILE sources: a block adds |p - q| for pairs of sources, and lists each source's TOP candidates in the order of terms, so that
ties stay in it.  A source in which no term of a block occurs has its constant share there, and a block counts differences from
that; so sources and terms are split at any number, and nothing is broadcast.

Shares are p = 1 + floor(10^9 (count + 5) / (N + 5 V)) by long division in 64-bit integers, exact for N + 5 V below 9 * 10^15
(beyond that it raises).  The two tables of an answer are as large as asked: each group has a row for every other source of its
language.  Null text, lang and source read as ''; a group without terms has counts of zero, and where V is 0 values are 0; a
source that is alone in its language has no pairs.  Repeated rows count each time; an empty table gives an empty result; other
columns are ignored; texts are counted whole.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .packing import pack, unpack
from .sparkutil import cut, prepare

MIN_DOCS, TOP, ADDED, UNIT = 30, 50, 5, 1_000_000_000
#: Leaves and counters that a task holds, leaves of a container and of a range, terms of a block, sources of a tile, subtrees that set
#: the ranges.
LEAVES, COUNTERS, CONTAINER, ROWS, TERMS, TILE, BOUNDS = 300_000, 1_500_000, 4096, 400_000, 2048, 256, 100_000
#: Bytes of terms stay, with A-Z lowered; all others part them.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Node:
    __slots__ = ("counts", "docs", "kids", "label")

    def __init__(self, label: bytes):
        self.label, self.kids, self.counts, self.docs = label, {}, None, 0


class Trie:
    """A radix trie of byte strings: an edge holds the bytes up to the next branch or leaf."""

    def __init__(self):
        self.root = Node(b"")

    def leaf(self, term: bytes) -> Node:
        """The leaf of a term, which is made where it is missing."""
        node, at = self.root, 0
        while at < len(term):
            kid = node.kids.get(term[at])
            if kid is None:
                kid = node.kids[term[at]] = Node(term[at:])
                at = len(term)
            elif term.startswith(kid.label, at):
                at += len(kid.label)
            else:
                same = 1
                while at + same < len(term) and kid.label[same] == term[at + same]:
                    same += 1
                top = node.kids[term[at]] = Node(kid.label[:same])
                kid.label = kid.label[same:]
                top.kids[kid.label[0]] = kid
                kid, at = top, at + same
            node = kid
        if node.counts is None:
            node.counts = {}
        return node

    def add(self, term: bytes, counts: dict[str, int], docs: int) -> None:
        node = self.leaf(term)
        node.docs += docs
        for source, n in counts.items():
            node.counts[source] = node.counts.get(source, 0) + n

    def walk(self) -> Iterator[tuple[bytes, Node]]:
        """(term, leaf) in UTF-8 order."""
        todo = [(b"", self.root)]
        while todo:
            before, node = todo.pop()
            term = before + node.label
            if node.counts is not None:
                yield term, node
            todo += [(term, node.kids[b]) for b in sorted(node.kids, reverse=True)]

    def merge(self, other: Trie) -> None:
        for term, node in other.walk():
            self.add(term, node.counts, node.docs)


_LEAVES = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_RUNS = pa.schema([("range", pa.int64()), ("lang", pa.string()), ("first", pa.binary()), ("last", pa.binary()), ("leaves", pa.int64()), ("sources", pa.list_(pa.string())), ("terms", pa.binary()), ("numbers", pa.binary())])
_LEAVES_DDL = "lang string, term binary, sources array<string>, counts array<long>"
_RUNS_DDL = "range long, lang string, first binary, last binary, leaves long, sources array<string>, terms binary, numbers binary"


def burst(terms: list[bytes], most: int) -> Iterator[list[bytes]]:
    """The containers of a burst trie in UTF-8 order: nodes branch by the next byte until at most so many terms are below one."""
    todo = [(terms, 0)]
    while todo:
        own, depth = todo.pop()
        if len(own) <= most:
            yield sorted(own)
            continue
        kids: dict[bytes, list[bytes]] = {}
        for t in own:
            kids.setdefault(t[depth : depth + 1], []).append(t)  # b"" is the term that ends here
        todo += [(kids[b], depth + 1) for b in sorted(kids, reverse=True)]


def _run(lang: str, terms: list[bytes], docs, fan, who, n, sources: list[str], nth: int = -1) -> dict:
    """A row: a subtree's leaves in UTF-8 order; for each its documents and its counters."""
    used, who = np.unique(who, return_inverse=True)
    lengths = np.fromiter(map(len, terms), np.int64, len(terms))
    return {"range": nth, "lang": lang, "first": terms[0], "last": terms[-1], "leaves": len(terms), "sources": [sources[k] for k in used.tolist()], "terms": b"".join(terms), "numbers": pack(lengths, docs, fan, who, n)}


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Subtrees of the tries of a task's documents (lang, source, text)."""
    groups: dict[tuple[str, str], Counter] = {}
    docs: dict[str, Counter] = {}
    leaves = counters = 0

    def sent() -> Iterator[pa.RecordBatch]:
        for lang, found in docs.items():
            runs = list(burst(list(found), CONTAINER)) if found else []
            terms = [t for r in runs for t in r]
            place = dict(zip(terms, range(len(terms))))
            sources = sorted(s for own, s in groups if own == lang)
            words = [groups[lang, s] for s in sources]
            at = np.concatenate([np.fromiter(map(place.__getitem__, w), np.int64, len(w)) for w in words])
            who = np.repeat(np.arange(len(words)), [len(w) for w in words])
            n = np.concatenate([np.fromiter(w.values(), np.int64, len(w)) for w in words])
            sort = np.argsort(at, kind="stable")
            fan, per_doc = np.bincount(at, minlength=len(terms)), np.fromiter(map(found.__getitem__, terms), np.int64, len(terms))
            ends, a = np.concatenate([[0], np.cumsum(fan)]), 0
            for r in runs:
                own, b = sort[ends[a] : ends[a + len(r)]], a + len(r)
                yield pa.RecordBatch.from_pylist([_run(lang, r, per_doc[a:b], fan[a:b], who[own], n[own], sources)], schema=_RUNS)
                a = b
        groups.clear()
        docs.clear()

    for b in batches:
        for lang, source, text in zip(*(b.column(k).to_pylist() for k in range(3))):
            words = text.translate(FOLD).split()
            own, every = groups.setdefault((lang, source), Counter()), docs.setdefault(lang, Counter())
            counters, leaves = counters - len(own), leaves - len(every)
            own.update(words)
            every.update(set(words))
            counters, leaves = counters + len(own), leaves + len(every)
            if leaves >= LEAVES or counters >= COUNTERS:
                yield from sent()
                leaves = counters = 0
    yield from sent()


def _terms(raw: bytes, lengths: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw)])


def ranged(bounds: list[tuple[bytes, bytes]]):
    """Gives every subtree its range of (language, term); those that reach over a bound are cut there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                lang = row["lang"].encode()
                lo, hi = (bisect_right(bounds, (lang, row[c])) for c in ("first", "last"))
                if lo == hi:
                    yield pa.RecordBatch.from_pylist([row | {"range": lo}], schema=_RUNS)
                    continue
                lengths, docs, fan, who, n = unpack(row["numbers"])
                terms = _terms(row["terms"], lengths).to_pylist()
                ends, a = np.concatenate([[0], np.cumsum(fan.astype(np.int64))]), 0
                for k in range(lo, hi + 1):
                    z = bisect_left(terms, bounds[k][1]) if k < hi else len(terms)
                    if z > a:
                        own = slice(ends[a], ends[z])
                        yield pa.RecordBatch.from_pylist([_run(row["lang"], terms[a:z], docs[a:z], fan[a:z], who[own], n[own], row["sources"], k)], schema=_RUNS)
                    a = z

    return run


def merged(min_docs: int):
    def run(t: pa.Table) -> pa.Table:
        """The tries of a range in one a language, without the terms of few documents."""
        out, by = [], {}
        for row in t.to_pylist():
            by.setdefault(row["lang"], []).append(row)
        for lang in sorted(by):
            numbers = [unpack(r["numbers"]) for r in by[lang]]
            sources = sorted({s for r in by[lang] for s in r["sources"]})
            place = {s: k for k, s in enumerate(sources)}
            whole = lambda k: np.concatenate([x[k].astype(np.int64) for x in numbers])
            code = _terms(b"".join(r["terms"] for r in by[lang]), whole(0)).dictionary_encode()
            term = code.indices.to_numpy().astype(np.int64)
            docs = np.bincount(term, whole(1), len(code.dictionary))
            fan = whole(2)
            own = np.repeat(term, fan)
            hold = np.repeat((docs >= min_docs)[term], fan)
            who = np.concatenate([np.array([place[s] for s in r["sources"]], np.int64)[x[3].astype(np.int64)] for r, x in zip(by[lang], numbers)])
            key, at = np.unique(own[hold] * len(sources) + who[hold], return_inverse=True)
            count = np.zeros(len(key), np.int64)
            np.add.at(count, at, whole(4)[hold])
            names = code.dictionary.take(pa.array(key // len(sources))).to_pylist()
            trie = Trie()
            for name, s, n, d in zip(names, (key % len(sources)).tolist(), count.tolist(), docs[key // len(sources)].tolist()):
                trie.add(name, {sources[s]: n}, int(d))
            out += [{"lang": lang, "term": term_, "sources": list(node.counts), "counts": list(node.counts.values())} for term_, node in trie.walk()]
        return pa.Table.from_pylist(out, schema=_LEAVES)

    return run


def _bounds(runs: DataFrame, leaves: int) -> list[tuple[bytes, bytes]]:
    """Bounds of ranges of about ROWS leaves, from the first terms of at most some BOUNDS subtrees; they only decide the balance."""
    step = max(1, runs.count() // BOUNDS)
    some = runs.where(F.pmod(F.xxhash64("lang", "first", "leaves"), F.lit(step)) == 0).select("lang", "first", "leaves").collect()
    some.sort(key=lambda r: (r.lang.encode(), bytes(r.first)))
    out, seen, each = [], 0, max(1, sum(r.leaves for r in some) / max(1, leaves / ROWS))
    for r in some:
        if seen >= each * (len(out) + 1):
            out.append((r.lang.encode(), bytes(r.first)))
        seen += r.leaves
    return sorted(set(out))


def share(count: np.ndarray, size: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + ADDED) / size), exactly."""
    if size.max(initial=0) >= (1 << 63) // 1000:
        raise OverflowError("too many terms for 64-bit shares")
    size = np.maximum(size, 1)
    whole, rest = np.divmod(count + ADDED, size)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, size)
        whole = whole * 1000 + more
    return whole + 1


def _block(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """The rows of a block: partial sums of pairs and candidates; block -1 has what pairs differ where neither source has a term."""
    lang, a, b, block = (k.as_py() for k in key)
    out: dict[str, list] = {"source": [], "part": [], "item": [], "value": []}

    def put(source: str, part: str, item: str, value: int) -> None:
        for k, v in zip(out, (source, part, item, value)):
            out[k].append(v)

    if len(right) and (block < 0 or len(left)):
        meta = sorted(right.select(["source", "tile", "size", "lang_size", "kinds"]).to_pylist(), key=lambda m: m["source"])
        size = np.array([m["size"] for m in meta], np.int64)
        none = share(np.zeros(len(meta), np.int64), size)
        kinds = meta[0]["kinds"]
        rows = sorted(zip(*(left.column(c).to_pylist() for c in ("term", "sources", "counts", "whole")))) if block >= 0 else []
        nth = {m["source"]: i for i, m in enumerate(meta)}
        count = np.zeros((len(rows), len(meta)), np.int64)
        for t, (_, sources, counts, _) in enumerate(rows):
            count[t, [nth[s] for s in sources]] = counts
        p = share(count, size[None, :])
        for i, m in enumerate(meta):
            if m["tile"] != a:
                continue
            far = np.abs(none - none[i])
            value = np.abs(p - p[:, i : i + 1]).sum(axis=0) - len(rows) * far if block >= 0 else kinds * far
            for j, o in enumerate(meta):
                if o["tile"] == b and i != j and (value[j] or block < 0):
                    put(m["source"], "pair", o["source"], int(value[j]))
                    if a != b:
                        put(o["source"], "pair", m["source"], int(value[j]))
        if a == b and rows:
            q = share(np.array([r[3] for r in rows], np.int64), np.full(len(rows), meta[0]["lang_size"], np.int64))
            for i, m in enumerate(meta):
                over = np.flatnonzero((count[:, i] > 0) & (p[:, i] > q))
                over = over[np.argsort(q[over] - p[over, i], kind="stable")[:TOP]]  # stable: ties stay in the order of terms
                for t in over.tolist():
                    put(m["source"], "term", rows[t][0].decode(), int(p[t, i] - q[t]))
    return pa.table({"lang": pa.array([lang] * len(out["part"]), pa.string()), **{c: pa.array(v, pa.int64() if c == "value" else pa.string()) for c, v in out.items()}})


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, sources, counts: the terms of at least min_docs documents of a language, with their counters."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    runs = cut(texts.mapInArrow(counted, _RUNS_DDL))
    bounds = _bounds(runs, runs.agg(F.sum("leaves")).first()[0] or 0)
    return cut(runs.mapInArrow(ranged(bounds), _RUNS_DDL).groupBy("range").applyInArrow(merged(min_docs), _LEAVES_DDL))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank."""
    if not 0 < top <= TOP:
        raise ValueError(f"top is 1 to {TOP}")
    prepare(docs.sparkSession)
    kept = kept_terms(docs, min_docs)
    groups = docs.groupBy(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).agg(F.lit(1).alias("one")).drop("one")
    each = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", F.col("x.sources").alias("source"), F.col("x.counts").alias("n"))
    sizes = each.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = groups.join(sizes, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    kinds = kept.groupBy("lang").agg(F.count("*").alias("kinds"))
    langs = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.ceil(F.count("*") / TILE).cast("int").alias("tiles")).join(kinds, "lang", "left")
    langs = langs.select("lang", "tiles", F.coalesce("kinds", F.lit(0)).alias("kinds"), (F.col("lang_n") + ADDED * F.coalesce("kinds", F.lit(0))).alias("lang_size"))
    tile = lambda s: F.pmod(F.xxhash64(s), F.col("tiles")).cast("int")
    meta = cut(groups.join(langs, "lang").select("lang", "source", "tiles", "kinds", "lang_size", (F.col("n") + ADDED * F.col("kinds")).alias("size"), tile(F.col("source")).alias("tile")))
    langs = meta.groupBy("lang").agg(F.first("tiles").alias("tiles"))

    blocks = max(1, -(-kept.count() // TERMS))
    met = lambda own: F.array_distinct(F.flatten(F.transform(own, lambda a: F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))))))
    terms = kept.join(langs, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int"))
    terms = terms.withColumn("at", F.explode(met(F.array_distinct(F.transform("sources", tile))))).withColumn("whole", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x))
    inside = F.filter(F.arrays_zip("sources", "counts"), lambda x: tile(x["sources"]).isin(F.col("at.a"), F.col("at.b")))
    terms = terms.select("lang", "at.a", "at.b", "block", "term", "whole", inside.alias("x")).select("lang", "a", "b", "block", "term", "whole", F.col("x.sources").alias("sources"), F.col("x.counts").alias("counts"))
    sides = meta.withColumn("at", F.explode(met(F.array("tile")))).withColumn("block", F.explode(F.sequence(F.lit(-1), F.lit(blocks - 1))))
    sides = sides.select("lang", "at.a", "at.b", "block", "source", "tile", "size", "lang_size", "kinds")
    key = ["lang", "a", "b", "block"]
    found = cut(terms.groupBy(*key).cogroup(sides.groupBy(*key)).applyInArrow(_block, "lang string, source string, part string, item string, value long"))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    w = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    best = found.where("part = 'term'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(w)).unionByName(best).select("lang", "source", "part", "item", "value", "rank")


ORACLE_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT i, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS MATERIALIZED (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= {MIN_DOCS}),
n AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS MATERIALIZED (SELECT g.lang, g.source, coalesce(any_value(v.v), 0) AS v, coalesce(sum(n.n), 0) + {ADDED} * coalesce(any_value(v.v), 0) AS size
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN n USING (lang, source) LEFT JOIN (SELECT lang, count(*) AS v FROM k GROUP BY lang) v ON g.lang = v.lang GROUP BY g.lang, g.source),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, 1 + (CAST({UNIT} AS HUGEINT) * (coalesce(n.n, 0) + {ADDED})) // CAST(g.size AS HUGEINT) AS p
  FROM g JOIN k ON g.lang = k.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
q AS MATERIALIZED (SELECT n.lang, n.term, 1 + (CAST({UNIT} AS HUGEINT) * (sum(n.n) + {ADDED})) // CAST(any_value(z.size) AS HUGEINT) AS q
  FROM n JOIN (SELECT lang, sum(size - {ADDED} * v) + {ADDED} * any_value(v) AS size FROM g GROUP BY lang) z ON n.lang = z.lang GROUP BY n.lang, n.term),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, CAST(p.p - q.q AS BIGINT) FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM f QUALIFY part = 'pair' OR rank <= {TOP}
"""
