"""Operator 3: n-gram Jaccard join with adaptive multi-match prefixes, down to link components.

1. One pass over the texts turns each batch into a block: sorted 48-bit shingle names with the number of the document in
   the block, cut into ranges of names.  A range gathers the blocks' parts, counts in how many sets each name occurs and
   answers only for names that occur twice or more.
2. A document whose shingles that occur once fill its shortest prefix can have no partner, whatever the order within
   equal counts.  The others send the rest of that prefix (rarest first); sharing one such shingle makes two documents
   candidates.  Candidates are tied to the smallest key of each shingle, so a shingle of m documents makes m rows.
3. Each group of candidates is verified over whole sets: rarest-first prefixes, lengthened to 1, 2, 4, ... matches where
   the estimated candidate cost falls, a pair being verified only if it shares as many prefix shingles as the smaller
   requirement.  A group beyond GROUP_SHINGLES is cut into parts and every pair of parts is one task, so none is lost.

Equal sets (copies) count once, as one class, before anything is compared.

Null, empty and wordless texts have no shingles, link with nothing and are components of their own.  Repeated rows give
repeated rows; ties don't matter; an empty table gives an empty one; other columns are ignored.  A row with a null doc_id
links like any other and is never the smallest of its component; a component of such rows alone has a null id.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .sparkutil import components, filter_of, maybe_in, prepare
from .textnum import chunks, set_key, shingle_sets, text_bytes

#: Shingles of one range of names that a task should count, and of one group that a task should verify.
RANGE_SHINGLES = 1_000_000
GROUP_SHINGLES = 1_000_000
#: Shingles a block gathers before it is sent, and bits of a name.
BLOCK_SHINGLES = 750_000
NAME_BITS = 48
_U = np.uint64


def prefix_len(n: np.ndarray | int, num: int, den: int):
    """The shortest prefix of a set of n that meets any set it is similar to: n - ceil(n * num / den) + 1."""
    return n - (n * num + den - 1) // den + 1


def _pack(values: np.ndarray, kind: str) -> bytes:
    return values.astype(kind).tobytes()


def _pack_names(names: np.ndarray) -> bytes:
    """Sorted names as the first one and 4-byte steps; 8-byte steps where one doesn't fit."""
    steps = np.diff(names)
    wide = len(steps) > 0 and int(steps.max()) >= 1 << 32
    return bytes([wide]) + _pack(names[:1], "<u8") + _pack(steps, "<u8" if wide else "<u4")


def _unpack_names(raw: bytes) -> np.ndarray:
    steps = np.frombuffer(raw, "<u8" if raw[0] else "<u4", offset=9)
    out = np.empty(len(steps) + 1, _U)
    out[0] = np.frombuffer(raw, "<u8", 1, 1)[0]
    np.cumsum(steps, out=out[1:], dtype=_U)
    out[1:] += out[0]
    return out


def _blocks(batches, width: int, ranges: int, most: int, bits: int):
    """Per batch of texts: a row for each document (rng spread by doc), then the block's parts by range of names."""
    # numbers that a task which runs again gives again
    blocks = itertools.count(TaskContext.get().partitionId() << 24)
    schema = pa.schema([("rng", pa.int32()), ("block", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("names", pa.binary()), ("at", pa.binary()), ("tkey", pa.int64())])
    bounds = (np.arange(1, ranges, dtype=np.uint64) * _U((1 << bits) // ranges))

    def flush(sets, keys, full):
        if not sets:
            return None
        block = next(blocks)
        names = np.concatenate(sets)
        at = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
        order = np.argsort(names)
        names, at = names[order], at[order]
        cut = np.concatenate([[0], np.searchsorted(names, bounds), [len(names)]])
        parts = [(r, a, b) for r, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if b > a]
        cols = [[r for r, _, _ in parts], [block] * len(parts), [None] * len(parts), [None] * len(parts), [None] * len(parts)]
        cols += [[_pack_names(names[a:b]) for _, a, b in parts], [_pack(at[a:b], "<u2") for _, a, b in parts]]
        sizes = np.array([full, [len(s) for s in sets]])
        head = [[-1], [block], [None], [None], [None], [_pack(np.array(keys), "<i8")], [_pack(sizes, "<u4")]]
        return [[*h, *c, *([None] * (len(cols[0]) + 1 - len(h) - len(c)))] for h, c in zip([*head, [None]], [*cols, []])]

    sets: list[np.ndarray] = []
    keys: list[int] = []
    full: list[int] = []  # sizes of the sets; two shingles of one may have the same 48-bit name
    seen: set[int] = set()
    held, sent = 0, TaskContext.get().partitionId() * 7919
    for b in batches:
        raw, off = text_bytes(b.column(1))
        ids = b.column(0).to_pylist()
        docs: list[tuple] = []
        for i, j in chunks(off):
            for doc, s in zip(ids[i:j], shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], width)):
                key = set_key(s)
                docs.append((doc, len(s), key))
                if len(s) and key not in seen:
                    seen.add(key)
                    keys.append(key)
                    sets.append(np.unique(s >> _U(64 - bits)))
                    full.append(len(s))
                    held += len(s)
        cols = [[(sent + i) % ranges for i in range(len(docs))], b.column(2), [d for d, _, _ in docs], [n for _, n, _ in docs], [k for _, _, k in docs], [None] * len(docs), [None] * len(docs), b.column(3)]
        sent += len(docs)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
        if held >= most or len(sets) > (1 << 15):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(flush(sets, keys, full), schema)], schema=schema)
            sets, keys, full, seen, held = [], [], [], set(), 0
    if (last := flush(sets, keys, full)) is not None:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(last, schema)], schema=schema)


def _count_range(table: pa.Table) -> pa.Table:
    """The parts of all blocks in one range of names: for each block, the names that two or more sets hold."""
    schema = pa.schema([("block", pa.int64()), ("names", pa.binary()), ("at", pa.binary()), ("df", pa.binary())])
    blocks, parts, at = table.column("block").to_pylist(), [_unpack_names(p) for p in table.column("names").to_pylist()], table.column("at").to_pylist()
    sizes = [len(p) for p in parts]
    names = np.concatenate(parts)
    del parts
    order = np.argsort(names, kind="stable")
    ordered = names[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    first = np.flatnonzero(new)
    df = np.zeros(len(names), np.uint32)
    df[order] = np.repeat(np.diff(np.append(first, len(ordered))), np.diff(np.append(first, len(ordered)))).astype(np.uint32)
    rows: list[tuple] = []
    lo = 0
    for block, n, place in zip(blocks, sizes, at):
        hold = np.flatnonzero(df[lo : lo + n] > 1)
        if len(hold):
            # the order among names that 65,535 sets or more hold is the order of the names
            rows.append((block, _pack_names(names[lo : lo + n][hold]), np.frombuffer(place, "<u2")[hold].tobytes(), _pack(np.minimum(df[lo : lo + n][hold], 65_535), "<u2")))
        lo += n
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _prefixes(table: pa.Table, num: int, den: int) -> pa.Table:
    """One block's answers and header: the prefix shingles with partners, of the documents that may have any."""
    schema = pa.schema([("cls", pa.int64()), ("n", pa.int64()), ("name", pa.int64())])
    head, names, at, df = None, [], [], []
    for kind, nm, a, d in zip(*(table.column(c).to_pylist() for c in ("kind", "names", "at", "df"))):
        if kind == 0:
            head = (np.frombuffer(nm, "<i8"), np.frombuffer(a, "<u4").astype(np.int64).reshape(2, -1))
        else:
            names.append(_unpack_names(nm))
            at.append(np.frombuffer(a, "<u2"))
            df.append(np.frombuffer(d, "<u2"))
    if not names:
        return pa.Table.from_arrays([pa.array([], f.type) for f in schema], schema=schema)
    keys, (n, n_names) = head
    names, at, df = np.concatenate(names), np.concatenate(at).astype(np.int64), np.concatenate(df)
    shared = np.bincount(at, minlength=len(n))
    room = prefix_len(n, num, den) - (n_names - shared)  # places of the prefix left after the shingles that occur once
    keep = room[at] > 0
    names, at, df = names[keep], at[keep], df[keep]
    order = np.lexsort((names, df, at))
    names, at = names[order], at[order]
    start = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
    nth = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
    hold = nth < room[at]
    return pa.Table.from_arrays([pa.array(keys[at[hold]]), pa.array(n[at[hold]]), pa.array(names[hold].astype(np.int64))], schema=schema)


def verify_group(keys: np.ndarray, sets: list[np.ndarray], num: int = 3, den: int = 4) -> list[tuple[int, int]]:
    """A spanning forest of the links within a group of sets (sorted distinct hashes), exact.

    The rarest-first prefix of a set is lengthened by as many matches as make its estimated cost least; a pair needs the
    smaller of its two requirements before its whole sets are compared.  Pairs that links already join are skipped."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    sets, keys, size = [sets[i] for i in order], keys[order], size[order]
    off = np.concatenate([[0], np.cumsum(size)])
    _, tok, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df))
    df_by_rank = np.sort(df, kind="stable")
    ranks = rank[tok]
    doc = np.repeat(np.arange(m), size)
    ranks = ranks[np.lexsort((ranks, doc))]
    # adaptive prefixes
    need, plen, cost_all = np.ones(m, np.int64), np.minimum(prefix_len(size, num, den), size), df_by_rank[ranks] - 1
    run = np.concatenate([[0], np.cumsum(cost_all)])
    best = np.full(m, np.inf)
    for k in (1, 2, 4, 8, 16, 32):
        p = np.minimum(prefix_len(size, num, den) + k - 1, size)
        scan = run[off[:-1] + p] - run[off[:-1]]
        cost = scan + np.minimum(scan / k, m) * size / 4  # postings read, then sets compared
        ok = (cost < best) & (prefix_len(size, num, den) + k - 1 <= size) | (k == 1)
        best, need, plen = np.where(ok, cost, best), np.where(ok, k, need), np.where(ok, p, plen)
    inside = (np.arange(len(ranks)) - off[doc]) < plen[doc]
    pr, pd = ranks[inside], doc[inside]
    by = np.lexsort((pd, pr))
    post, post_rank = pd[by], pr[by]
    start = np.searchsorted(post_rank, np.arange(len(df) + 1))
    poff = np.concatenate([[0], np.cumsum(plen)])
    flag = np.zeros(len(df), bool)
    links: list[tuple[int, int]] = []
    label = np.arange(m)
    members = {i: [i] for i in range(m)}
    for x in range(m):
        mine = pr[poff[x] : poff[x + 1]]
        mine = mine[(start[mine + 1] - start[mine]) > 1]
        if not len(mine):
            continue
        cand = np.concatenate([post[start[t] : start[t + 1]] for t in mine.tolist()])
        cand = cand[cand < x]
        if not len(cand):
            continue
        hits = np.bincount(cand, minlength=0)
        ys = np.flatnonzero(hits)
        ys = ys[(hits[ys] >= np.minimum(need[ys], need[x])) & (den * size[ys] >= num * size[x]) & (label[ys] != label[x])]
        if not len(ys):
            continue
        ys = ys[np.argsort(-hits[ys], kind="stable")]
        flag[ranks[off[x] : off[x + 1]]] = True
        step = 16
        while len(ys):
            part, ys = ys[:step], ys[step:]
            idx = np.concatenate([np.arange(off[y], off[y + 1]) for y in part.tolist()])
            cut = np.concatenate([[0], np.cumsum(size[part])[:-1]])
            both = np.add.reduceat(flag[ranks[idx]].astype(np.int64), cut)
            joined = den * both >= num * (size[part] + size[x] - both)
            for y in part[joined].tolist():
                a, b = int(label[x]), int(label[y])
                if a != b:
                    links.append((int(keys[x]), int(keys[y])))
                    a, b = (a, b) if len(members[a]) >= len(members[b]) else (b, a)
                    label[members[b]] = a
                    members[a] += members.pop(b)
            ys = ys[label[ys] != label[x]]
            step *= 4
        flag[ranks[off[x] : off[x + 1]]] = False
    return links


def _verify(table: pa.Table, num: int, den: int) -> pa.Table:
    keys = table.column("cls").to_numpy()
    sets = [np.frombuffer(b, "<u8") for b in table.column("hashes").to_pylist()]
    _, one = np.unique(keys, return_index=True)
    links = verify_group(keys[one], [sets[i] for i in one], num, den)
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def linked(docs: DataFrame, width: int = 5, num: int = 3, den: int = 4, block: int = BLOCK_SHINGLES, bits: int = NAME_BITS) -> DataFrame:
    """Of every row: doc_id (without one: its text's hash), nul (1: without an id), tkey (its text's hash), n (set size), and
    comp, the same for rows whose sets links join (with den * |both| >= num * |either|)."""
    spark = prepare(docs.sparkSession)
    src = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    # rows without an id are told apart by their text
    src = src.select(F.coalesce("doc_id", F.xxhash64("text")).alias("doc_id"), "text", F.col("doc_id").isNull().cast("long").alias("nul"), F.xxhash64("text").alias("tkey"))
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-total // (7 * RANGE_SHINGLES)), int(spark.conf.get("spark.sql.shuffle.partitions")))
    sent = src.mapInArrow(lambda it: _blocks(it, width, ranges, block, bits), "rng int, block long, doc_id long, n long, cls long, names binary, at binary, tkey long")
    meta_schema = "kind int, doc_id long, n long, cls long, block long, names binary, at binary, df binary, tkey long"

    def reduce(batches):
        """One partition: ranges of names, headers and document rows."""
        kinds: dict[int, list[pa.RecordBatch]] = {}
        out = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("block", pa.int64()), ("names", pa.binary()), ("at", pa.binary()), ("df", pa.binary()), ("tkey", pa.int64())])

        def give(kind, **cols):
            size = len(next(iter(cols.values())))
            arrays = [pa.array([kind] * size, pa.int32()) if f.name == "kind" else cols[f.name] if f.name in cols else pa.nulls(size, f.type) for f in out]
            return pa.RecordBatch.from_arrays([a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays], schema=out)

        for b in batches:
            t = pa.Table.from_batches([b])
            docs_ = t.filter(pc.is_null(t.column("names")))
            if len(docs_):
                yield give(2, doc_id=docs_.column("doc_id"), n=docs_.column("n"), cls=docs_.column("cls"), block=docs_.column("block"), tkey=docs_.column("tkey"))
            t = t.filter(pc.is_valid(t.column("names")))
            heads = t.filter(pc.less(t.column("rng"), 0))
            if len(heads):
                yield give(0, block=heads.column("block"), names=heads.column("names"), at=heads.column("at"))
            t = t.filter(pc.greater_equal(t.column("rng"), 0))
            for r in pc.unique(t.column("rng")).to_pylist():
                kinds.setdefault(r, []).append(t.filter(pc.equal(t.column("rng"), r)))
        for r in list(kinds):
            ans = _count_range(pa.concat_tables(kinds.pop(r)))
            if len(ans):
                yield give(1, block=ans.column("block"), names=ans.column("names"), at=ans.column("at"), df=ans.column("df"))

    spread = F.when(F.col("rng") >= 0, F.col("rng").cast("long")).otherwise(F.col("block"))
    told = sent.repartition(ranges, spread).mapInArrow(reduce, meta_schema).checkpoint()
    meta = told.where("kind = 2").select("doc_id", "n", "cls", F.col("block").alias("nul"), "tkey")
    pre = told.where("kind < 2").select("kind", "block", "names", "at", "df").groupBy("block").applyInArrow(lambda t: _prefixes(t, num, den), "cls long, n long, name long")
    pre = pre.groupBy("name", "cls").agg(F.max("n").alias("n")).checkpoint()
    rep = pre.groupBy("name").agg(F.min("cls").alias("b"), F.max("cls").alias("top")).where("b <> top").select("name", "b")
    near = components(pre.join(rep, "name").groupBy(F.col("cls").alias("a"), "b").agg(F.lit(1).alias("one")))
    # whole sets of one document of each class that has candidates
    owner = meta.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    group = near.select(F.col("node").alias("cls"), F.col("comp").alias("grp")).join(owner, "cls").checkpoint()
    parts = group.groupBy("grp").agg(F.sum("n").alias("mass")).select("grp", F.greatest(F.lit(1), F.ceil(F.col("mass") / F.lit(GROUP_SHINGLES / 2)) - 1).cast("int").alias("parts"))
    group = group.join(parts, "grp").select("doc_id", "cls", "grp", "parts")
    texts = maybe_in(src, "doc_id", filter_of(group, "doc_id")).join(group, "doc_id")

    def sets(batches):
        schema = pa.schema([("cls", pa.int64()), ("grp", pa.int64()), ("parts", pa.int32()), ("hashes", pa.binary())])
        for b in batches:
            raw, off = text_bytes(b.column(0))
            got = [s for i, j in chunks(off) for s in shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], width)]
            cls = b.column(1).to_pylist()
            ok = pa.array([set_key(s) == c for s, c in zip(got, cls)])  # another row of the same doc_id may hold another text
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(3), pa.array([s.astype("<u8").tobytes() for s in got], pa.binary())], schema=schema).filter(ok)

    whole = texts.select("text", "cls", "grp", "parts").mapInArrow(sets, "cls long, grp long, parts int, hashes binary")
    mine = F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")
    whole = whole.withColumn("part", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    whole = whole.select("cls", "grp", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "hashes")
    links = whole.groupBy("grp", "p", "q").applyInArrow(lambda t: _verify(t, num, den), "a long, b long").checkpoint()
    comp = components(links).withColumnRenamed("node", "cls")
    return meta.join(comp, "cls", "left").select("doc_id", "nul", "tkey", "n", F.coalesce("comp", "cls").alias("comp"))


def link_components(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    x = linked(docs, **how).withColumn("own", F.when(F.col("nul") == 0, F.col("doc_id")))
    # rows are combined by component before they meet; documents without shingles are no component's
    low = x.where("n > 0").groupBy("comp").agg(F.min("own").alias("low"))
    return x.join(low, "comp", "left").select(F.col("own").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("own")).otherwise(F.col("low")).alias("component_id"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The documents without near duplicates: of each component one row stays, that of the smallest doc_id (of several rows with
    this id the one of the smallest text hash; rows without an id come last).  Documents without shingles all stay; of a
    repeated row one stays."""
    x = linked(docs, **how).where("n > 0")
    best = x.groupBy("comp").agg(F.min("nul").alias("nul")).join(x, ["comp", "nul"]).groupBy("comp", "nul").agg(F.min("doc_id").alias("doc_id")).join(x, ["comp", "nul", "doc_id"])
    stay = best.groupBy("comp", "nul", "doc_id").agg(F.min("tkey").alias("tkey")).select(F.col("doc_id").alias("keep_id"), F.col("tkey").alias("keep_key"), F.col("nul").alias("keep_nul"))
    names = {c: f"own_{k}" for k, c in enumerate(docs.columns)}
    y = docs.select(*[F.col(c).alias(n) for c, n in names.items()])
    text, did = F.col(names["text"]).cast("string"), F.col(names["doc_id"]).cast("long")
    y = y.withColumns({"row_key": F.xxhash64(text), "row_nul": did.isNull().cast("long")}).withColumn("row_id", F.coalesce(did, "row_key"))
    bare = F.coalesce(F.translate(text, " \t\n\x0b\x0c\r", ""), F.lit("")) == ""
    kept = y.join(stay, (F.col("row_id") == F.col("keep_id")) & (F.col("row_key") == F.col("keep_key")) & (F.col("row_nul") == F.col("keep_nul")))
    # the rest of a repeated row is the same row, or one that differs in other columns: the smallest hash of all stays
    order = [F.xxhash64(*names.values()), *[F.col(n).cast("string") for n in names.values()]]
    one = kept.withColumn("nth", F.row_number().over(Window.partitionBy("row_id", "row_key", "row_nul").orderBy(*order))).where("nth = 1")
    out = one.select(*names.values()).unionByName(y.where(bare).select(*names.values()))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])


#: DuckDB SQL for link_components: shingle lists, shared shingles of all pairs, reachability.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d),
g AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, s FROM s),
t AS (SELECT doc_id, n, unnest(s) AS x FROM g),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM g UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT doc_id, n AS n_shingles, least(doc_id, (SELECT min(b) FROM reach WHERE a = doc_id)) AS component_id FROM g
"""
