"""Operator 1: exact substring dedup by distributed prefix doubling.

A string of LENGTH bytes is repeated if it starts at two places, in one document or two.  Spark ranks (position, name) pairs at
growing lengths and drops a position as soon as its name is its own; names are 64-bit names of the bytes, made by doubling (the
name of 2m bytes from the names of m bytes at i and i + m), so that a rank needs no global sort to be the same everywhere.

Exact pre-filter: ranking every byte position would shuffle over ten times the input.  The anchor of a window of LENGTH bytes
is its leftmost smallest 64-byte name, and equal windows have equal anchors at equal places in them; so only anchors, each with
the range of its windows, are ranked.

1. 64 bytes: the least and greatest place of each anchor name; names of one place drop out (a filter of at most 8 MB).
2. All bytes of all windows of an anchor (200 to 336): anchors with the same name there are repeated with all their windows.
   The others, and one of each repeated kind, go on with these bytes.
3. Rounds of 178, 197 and 200 bytes: a range of windows is cut into WIDTHS, each part is ranked by the bytes that all its
   windows share.  Parts with a name of their own drop out; parts whose bytes are wholly equal are repeated; the rest, and one
   of each repeated kind, go to the next round.  At 200 bytes every part is one window.

Every rank is an aggregate over (name) or (name, bytes), combined before its shuffle; no task takes a whole group of equal
names.  Copies of whole texts are found by their SHA-256; in steps 1 to 3 a text takes part once.

Null and empty texts have no bytes; nothing is removed.  Texts under LENGTH bytes lose nothing.  Repeated rows are copies
(both lose all).  An empty table gives an empty one; other columns are ignored, ties don't matter.  A null doc_id stays null.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .sparkutil import FILTER_BITS, bits_of, cut, filter_of, maybe_in, only_owners, prepare
from .textnum import _MUL, chunks, doubled, leftmost_minima, mix, text_bytes

LENGTH = 200
GRAM = 64
#: Windows of a part, round by round.
WIDTHS = (23, 4, 1)
#: Names that a task knows to be repeated and need not send again, at most.
KNOWN = 1_000_000
_U = np.uint64


def _extend(h: np.ndarray, step: int) -> np.ndarray:
    if len(h) <= step:
        return h[:0]
    out = h[: len(h) - step] * _MUL[3] + (h[step:] ^ (h[step:] >> _U(29))) * _MUL[4]
    out ^= out >> _U(32)
    return out


def names(x: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The names of the GRAM bytes and of the length bytes at each position."""
    gram = doubled(x, GRAM)
    h, m = gram, GRAM
    while m < length:
        step = min(m, length - m)
        h = _extend(h, step)
        m += step
    return gram, h


def anchors(raw: np.ndarray, off: np.ndarray, length: int = LENGTH):
    """(document, anchor name, name of all its windows, first window, windows - 1, anchor - first window), in order, for the
    documents of a chunk."""
    gram, full = names(raw, length)
    low = leftmost_minima(gram, length - GRAM + 1)
    count = np.maximum(np.diff(off) - length + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    if not len(doc):
        z = np.zeros(0, np.int64)
        return z, z.astype(_U), z.astype(_U), z, z, z
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + off[doc]
    a = low[at]
    first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    last = np.append(first[1:], len(a)) - 1
    lo, hi = at[first], at[last]
    u = mix(full[lo] * _MUL[0] + mix(full[hi]) * _MUL[1] + (a[first] - lo).astype(_U) * _MUL[2] + (hi - lo).astype(_U) * _MUL[5])
    d = doc[first]
    return d, gram[a[first]], u, lo - off[d], hi - lo, a[first] - lo


def _batches_of(batches, length: int):
    """(names, names of all windows, text keys, packed places) of the anchors of each chunk; of equal texts of a batch one."""
    for b in batches:
        raw, off = text_bytes(b.column(0))
        keys = b.column(1).to_numpy()
        fresh = np.zeros(len(keys), bool)
        fresh[np.unique(keys, return_index=True)[1]] = True
        for i, j in chunks(off):
            d, g, u, lo, more, to = anchors(raw[off[i] : off[j]], off[i : j + 1] - off[i], length)
            keep = fresh[i:j][d]
            yield g[keep], u[keep], keys[i:j][d[keep]], (lo[keep] * 256 + more[keep]) * 256 + to[keep]


def _gram_rows(batches, length: int):
    """(g, place) of each anchor."""
    schema = pa.schema([("g", pa.int64()), ("place", pa.int64())])
    for g, _, dkey, at in _batches_of(batches, length):
        place = mix(dkey.view(_U) * _MUL[0] + at.view(_U))
        yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(place.view(np.int64))], schema=schema)


def _anchor_rows(batches, length: int, held: np.ndarray):
    """(g, u, dkey, at, kind) of the anchors whose name the filter may hold.  Of anchors that share u a task sends two with
    their names; the others (kind 2) are known to be repeated and dealt out evenly."""
    schema = pa.schema([("g", pa.int64()), ("u", pa.int64()), ("dkey", pa.int64()), ("at", pa.int64()), ("kind", pa.int32())])
    known = np.zeros(0, _U)
    for g, u, dkey, at in _batches_of(batches, length):
        slot = g & _U(FILTER_BITS - 1)
        keep = np.flatnonzero((held[slot >> _U(3)] >> (slot & _U(7)).astype(np.uint8)) & 1)
        g, u, dkey, at = g[keep], u[keep], dkey[keep], at[keep]
        order = np.argsort(u, kind="stable")
        new = np.append(True, u[order][1:] != u[order][:-1])[: len(order)]
        start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else order
        nth = np.empty(len(order), np.int64)
        nth[order] = np.arange(len(order)) - start
        spread = nth > 1
        if len(known):
            spread |= known[np.minimum(np.searchsorted(known, u), len(known) - 1)] == u
        # the anchors of a chunk are places of their own, so two of them show that u is repeated
        known = np.union1d(known, u[nth == 1])
        known = known if len(known) <= KNOWN else known[:0]
        alone = mix(dkey.view(_U) * _MUL[0] + at.view(_U))
        g, u = np.where(spread, alone, g), np.where(spread, alone, u)
        cols = [g.view(np.int64), u.view(np.int64), dkey, at, np.where(spread, 2, 0)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _window_bytes(batches, length: int):
    """(dkey, lo, o1, o2, ctx) of each wanted anchor: ctx are the bytes of its windows, the first of which starts at lo and o2
    bytes before the anchor, the last one o1 bytes before it."""
    schema = pa.schema([("dkey", pa.int64()), ("lo", pa.int64()), ("o1", pa.int32()), ("o2", pa.int32()), ("ctx", pa.binary())])
    for b in batches:
        rows: list[tuple] = []
        for text, dkey, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            raw = text.encode()
            for at in want:
                lo, more, to = at >> 16, at >> 8 & 255, at & 255
                rows.append((dkey, lo, to - more, to, raw[lo : lo + more + length]))
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema)


def parts(open_: DataFrame, width: int, length: int) -> DataFrame:
    """The rows of open_ (dkey, lo, o1, o2, ctx) cut into parts of at most width windows, with kx, the name of the bytes that
    all windows of a part share, and (fx, fh), the name of all its bytes."""
    x = open_.withColumn("j", F.explode(F.sequence(F.floor(F.col("o1") / width).cast("int"), F.floor(F.col("o2") / width).cast("int"))))
    x = x.withColumn("c1", F.greatest(F.col("o1"), F.col("j") * width)).withColumn("c2", F.least(F.col("o2"), F.col("j") * width + width - 1))
    core = F.substring("ctx", F.col("o2") - F.col("j") * width + 1, F.lit(length - width + 1))
    own = F.substring("ctx", F.col("o2") - F.col("c2") + 1, F.col("c2") - F.col("c1") + length)
    x = x.select("dkey", (F.col("lo") + F.col("o2") - F.col("c2")).alias("lo"), F.col("c1").alias("o1"), F.col("c2").alias("o2"), F.xxhash64(core, "j").alias("kx"), own.alias("ctx"))
    return x.withColumn("fx", F.xxhash64("ctx", "o1", "o2")).withColumn("fh", F.hash("kx", "ctx")).withColumn("place", F.xxhash64("dkey", "lo"))


def doubling(open_: DataFrame, length: int = LENGTH) -> DataFrame:
    """(dkey, s, e): the stretches of open_ whose windows of `length` bytes start at two places of it or more, by rounds of
    ranking at growing lengths."""
    spans = None
    for k, width in enumerate(WIDTHS):
        x = cut(parts(open_, width, length))
        kind = cut(x.groupBy("kx", "fx", "fh").agg(F.min("place").alias("p0"), F.max("place").alias("p1")).withColumn("dup", F.col("p0") != F.col("p1")))
        twice = kind.where("dup").select("kx", "fx", "fh", "p0")
        hit = maybe_in(x.select("dkey", "lo", "o1", "o2", "kx", "fx", "fh"), "fx", filter_of(twice, "fx")).join(twice, ["kx", "fx", "fh"])
        hit = hit.select("dkey", F.col("lo").alias("s"), (F.col("lo") + F.col("o2") - F.col("o1") + length).alias("e"))
        spans = hit if spans is None else spans.union(hit)
        if width == 1:
            return spans
        # names of several kinds, of which some isn't known to be repeated; a few others that pass the filter do no harm
        going = kind.groupBy("kx").agg(F.min("fx").alias("a"), F.max("fx").alias("b"), F.min(F.col("dup").cast("int")).alias("all_dup")).where("a <> b and all_dup = 0")
        x = maybe_in(x, "kx", filter_of(going, "kx")).join(twice, ["kx", "fx", "fh"], "left")
        open_ = x.where("p0 is null or place = p0").select("dkey", "lo", "o1", "o2", "ctx")
    return spans


def merged(spans, n: int) -> list[tuple[int, int]]:
    """Disjoint, maximal spans."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], min(x["e"], n)) for x in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def repeats(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(meta, spans): meta has did, dkey, doc_id, n_bytes, sha, copies for each row; spans has dkey and the covered
    stretches (list of s, e) of each text that occurs once."""
    if not GRAM < length < 256:
        raise ValueError("a repeated string has 65 to 255 bytes")
    prepare(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    src = keyed(docs)
    meta = src.select("did", "dkey", "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("sha"))
    counts = meta.groupBy("sha").agg(F.count("*").alias("copies"), F.min("did").alias("own"))
    meta = cut(meta.join(counts, "sha"))
    one = only_owners(src.where(F.octet_length("text") >= length), meta.where("copies > 1 and did <> own"))
    texts = one.select("text", "dkey")
    # 64 bytes
    grams = texts.mapInArrow(lambda it: _gram_rows(it, length), "g long, place long")
    shared = grams.groupBy("g").agg(F.min("place").alias("p0"), F.max("place").alias("p1")).where("p0 <> p1")
    held = sc.broadcast(bits_of(shared, "g"))
    # all bytes of all windows
    rows = texts.mapInArrow(lambda it: _anchor_rows(it, length, held.value), "g long, u long, dkey long, at long, kind int")
    wu = Window.partitionBy("g", "u")
    x = rows.withColumns({"d0": F.min("dkey").over(wu), "d1": F.max("dkey").over(wu), "a0": F.min("at").over(wu), "a1": F.max("at").over(wu), "k1": F.max("kind").over(wu)})
    x = cut(x.select("g", "dkey", "at", ((F.col("d0") != F.col("d1")) | (F.col("a0") != F.col("a1")) | (F.col("k1") > 0)).alias("dup"), ((F.col("dkey") == F.col("d0")) & (F.col("k1") == 0)).alias("first")))
    held.destroy()  # x is written
    lo, more = F.shiftright("at", 16), F.shiftright("at", 8).bitwiseAND(255)
    known = x.where("dup").select("dkey", lo.alias("s"), (lo + more + length).alias("e"))
    alone = x.where("not dup")
    with_them = maybe_in(x.where("dup and first"), "g", filter_of(alone, "g"))
    todo = alone.select("dkey", "at").union(with_them.select("dkey", "at")).distinct().groupBy("dkey").agg(F.collect_list("at").alias("want"))
    todo = todo.join(meta.where("did = own").select("dkey", "did").distinct(), "dkey").select("did", F.col("dkey").alias("own_key"), "want").checkpoint()
    wanted = maybe_in(one, "did", filter_of(todo, "did")).join(todo, "did").where("dkey = own_key").select("text", "dkey", "want")
    open_ = wanted.mapInArrow(lambda it: _window_bytes(it, length), "dkey long, lo long, o1 int, o2 int, ctx binary")
    spans = known.union(doubling(open_, length))
    return meta, cut(spans.groupBy("dkey").agg(F.collect_set(F.struct("s", "e")).alias("spans")))


def keyed(docs: DataFrame) -> DataFrame:
    """did (a join key, never null), dkey (the text's hash), doc_id, text (never null)."""
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return x.withColumn("dkey", F.xxhash64("text", F.octet_length("text"))).withColumn("did", F.coalesce("doc_id", "dkey"))


def _apply(batches, length: int, schema: pa.Schema, give):
    for b in batches:
        rows = []
        for r in b.to_pylist():
            raw = r["text"].encode()
            cuts = merged(r["spans"], len(raw))
            keep, at = [], 0
            for s, e in cuts:
                keep.append(raw[at:s])
                at = e
            keep.append(raw[at:])
            rows.append(give(r, len(raw), sum(e - s for s, e in cuts), len(cuts), b"".join(keep)))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _touched(docs: DataFrame, meta: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with spans and their texts, keys of these rows)."""
    part = spans.join(meta.where("copies = 1"), "dkey").select("did", F.col("dkey").alias("own_key"), "spans").checkpoint()
    src = keyed(docs)
    return maybe_in(src, "did", filter_of(part, "did")).join(part, "did").where("dkey = own_key"), part


def removal(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""
    meta, spans = repeats(docs, length)
    hit, part = _touched(docs, meta, spans)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    give = lambda r, n, gone, k, kept: (r["doc_id"], n, gone, k, hashlib.sha256(kept).hexdigest())
    sql = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    some = hit.select("doc_id", "text", "spans").mapInArrow(lambda it: _apply(it, length, schema, give), sql)
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    rest = meta.join(part.select("did", F.col("own_key").alias("dkey")), ["did", "dkey"], "left_anti")
    zero, none = F.lit(0).cast("long"), F.lit(hashlib.sha256(b"").hexdigest())
    rest = rest.select("doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(zero).alias("n_removed"), F.when(whole, F.lit(1).cast("long")).otherwise(zero).alias("n_spans"), F.when(whole, none).otherwise(F.lower(F.hex("sha"))).alias("kept_sha256"))
    return some.union(rest)


def strip(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with the repeated bytes removed from their texts; characters that are cut in two go too, and n_chars,
    where there is one, follows.  Texts that are wholly repeated become empty; every row stays."""
    meta, spans = repeats(docs, length)
    hit, _ = _touched(docs, meta, spans)
    schema = pa.schema([("cut_did", pa.int64()), ("cut_key", pa.int64()), ("cut_text", pa.string())])
    give = lambda r, n, gone, k, kept: (r["did"], r["dkey"], kept.decode("utf-8", "ignore"))
    some = hit.select("did", "dkey", "text", "spans").mapInArrow(lambda it: _apply(it, length, schema, give), "cut_did long, cut_key long, cut_text string")
    full = meta.where((F.col("copies") > 1) & (F.col("n_bytes") >= length)).select("did", "dkey").distinct().select("did", "dkey", F.lit("").alias("cut_text"))
    new = some.union(full)
    names = {c: f"own_{k}" for k, c in enumerate(docs.columns)}
    text = F.coalesce(F.col(names["text"]).cast("string"), F.lit(""))
    x = docs.select(*[F.col(c).alias(n) for c, n in names.items()]).withColumn("own_key", F.xxhash64(text, F.octet_length(text)))
    x = x.withColumn("own_did", F.coalesce(F.col(names["doc_id"]).cast("long"), F.col("own_key")))
    x = x.join(new, (F.col("cut_did") == F.col("own_did")) & (F.col("cut_key") == F.col("own_key")), "left")
    x = x.withColumn(names["text"], F.coalesce("cut_text", names["text"]))
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        x = x.withColumn(names["n_chars"], F.when(F.col("cut_text").isNull(), F.col(names["n_chars"])).otherwise(F.char_length("cut_text")).cast(kind))
    return x.select(*[F.col(n).alias(c) for c, n in names.items()])


#: DuckDB SQL for removal: the MD5 of every string of 200 bytes, places of those that occur twice, their runs, what is left.
ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, p, md5(b[p:p + 199]) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) - 198)) AS p FROM d)),
twice AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
hit AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS q FROM w SEMI JOIN twice USING (h)),
run AS (SELECT r, p, sum(CASE WHEN q IS NULL OR p > q + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS k FROM hit),
span AS (SELECT r, k, min(p) AS s, max(p) + 200 AS e FROM run GROUP BY r, k),
gap AS (SELECT r, s, e, lag(e) OVER (PARTITION BY r ORDER BY s) AS f FROM span),
cut AS (SELECT r, sum(e - s) AS gone, count(*) AS n, string_agg(hex(b[coalesce(f, 1):s - 1]), '' ORDER BY s) || hex(any_value(b)[max(e):]) AS kept FROM gap JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(coalesce(unhex(kept), b)) AS kept_sha256 FROM d LEFT JOIN cut USING (r)
"""
