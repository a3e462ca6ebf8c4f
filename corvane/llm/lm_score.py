"""Operator 13: language-model scores of documents by a weighted backoff automaton, learned from all training documents.

Documents are dealt by hash into blocks of about BLOCK bytes.  A block names its words (96-bit hashes) and n-grams (48 bits), with
their counts in its training documents (0 for those of held-out ones), sorted and cut by hash range; the tasks of the ranges add
the counts of all blocks and give each block the totals of its own names.  Beyond FAN ranges names go through several rounds of
FAN ranges each, with blocks merged in between, so that the rows stay in proportion to the input and no task holds more than about
PART bytes of text's names.  Nothing is broadcast or collected but two sums.

With its totals a block builds the automaton of its own n-grams: states are contexts, arcs are words with interpolated
probabilities (c(hw) + m P(w | shorter h)) / (c(h) + m), and a failure arc with weight m / (c(h) + m) leads from a context to
the shorter one, down to the root with its add-one arcs, one of them for unknown words.  All documents are then read from left
to right at once, each with a state and a sum; long ones are cut into pieces of PIECE tokens that begin with the order - 1 tokens
before, after which the state is the same.  `order` is 2 unless asked otherwise: names of longer n-grams are nearly one a token.

Words are exact (a collision of 96 bits aside); two n-grams of one name share their counts (of 10^11 n-grams one in 3,000).  Null and empty texts are
one end token; null ids count as training; repeated rows count and come back each time; without training documents every token is
unknown and scores 0; an empty table gives an empty result; other columns are ignored; texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .packing import U, pack, unpack
from .sparkutil import cut, prepare

ORDER, MASS = 2, 100.0
#: Bytes of text of a block and of a range of names, ranges of a round, tokens of a piece.
BLOCK, PART, FAN, PIECE = 16 << 20, 8 << 20, 512, 512
#: The bits of an n-gram's name.
NAMED = np.uint64(0xFFFF_FFFF_FFFF_0000)
#: No word is a space: it names the end, and the beginning as a context.
END = b" "
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: shifts and odd factors."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


class Names:
    """Sorted names with counts: words by (a, b), n-grams by g."""

    def __init__(self, a, b, words, g, grams):
        self.a, self.b, self.words, self.g, self.grams = a, b, words, g, grams

    @classmethod
    def read(cls, raw: bytes) -> Names:
        a, b, words, g, grams = unpack(raw)
        return cls(np.cumsum(a, dtype=U), b, words, np.cumsum(g, dtype=U), grams)

    def parts(self, ranges: int) -> Iterator[tuple[int, bytes]]:
        """(range of hashes, packed names) of the ranges that hold any."""
        nth = lambda h: ((h >> U(32)) * U(ranges)) >> U(32)
        own_a, own_g = nth(self.a), nth(self.g)
        for p in np.union1d(own_a, own_g):
            i, j = (slice(*np.searchsorted(x, [p, p + U(1)])) for x in (own_a, own_g))
            rise = lambda h: np.diff(h, prepend=U(0))
            yield int(p), pack(rise(self.a[i]), self.b[i], self.words[i], rise(self.g[j]), self.grams[j])


def united(parts: list[Names]) -> tuple[Names, np.ndarray, np.ndarray]:
    """The names of all, with added counts, and for each of their words and n-grams in a row its place there."""

    def added(keys: list[np.ndarray], count: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
        keys = [k[order] for k in keys]
        fresh = np.ones(len(order), bool)
        fresh[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        starts, place = np.flatnonzero(fresh), np.empty(len(order), np.int64)
        place[order] = np.cumsum(fresh) - 1
        return [k[starts] for k in keys], np.add.reduceat(count[order], starts) if len(starts) else count, place

    row = lambda x: np.concatenate([getattr(p, x) for p in parts])
    (a, b), words, at = added([row("a"), row("b")], row("words"))
    (g,), grams, ag = added([row("g")], row("grams"))
    return Names(a, b, words, g, grams), at, ag


class Block:
    """The tokens of some documents, their distinct words and n-grams.  Documents stand in a row, an end before the first and after each."""

    def __init__(self, texts: list[bytes], train: list[bool], order: int):
        ids, self.ends, place = {END: 0}, np.zeros(len(texts) + 1, np.int64), 0
        rows = [np.zeros(1, np.int64)]
        for k, text in enumerate(texts):
            words = (text or b"").translate(FOLD).split()
            for w in words:
                if w not in ids:
                    ids[w] = len(ids)
            words.append(END)
            rows.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
            place += len(words)
            self.ends[k + 1] = place
        self.ids, self.order = np.concatenate(rows), order
        counted = np.concatenate([[0], np.repeat(np.array(train, np.int64), np.diff(self.ends))]).astype(np.int64)
        raw = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in ids), U).reshape(-1, 2)
        a, b = raw[:, 0], raw[:, 1] >> U(32)
        sort = np.lexsort((b, a))
        self.rank = np.empty(len(sort), np.int64)  # of each word's id among the sorted names
        self.rank[sort] = np.arange(len(sort))
        words = np.bincount(self.ids, counted, len(ids)).astype(U)
        # n-grams by their last place; only the first token of one may be the end of the document before
        self.at, self.of, self.key = [], [], []
        h, at = a[self.ids], np.arange(len(self.ids))
        for k in range(2, order + 1):
            at = at[at > 0]
            if k > 2:
                at = at[self.ids[at - (k - 2)] != 0]
            before = h
            h = np.zeros(len(self.ids), U)
            h[at] = _mixed(before[at - 1] * U(0x9E3779B97F4A7C15) + a[self.ids[at]] + U(k))
            key, of = np.unique(h[at] & NAMED, return_inverse=True)
            self.at.append(at)
            self.of.append(of)
            self.key.append((key, np.bincount(of, counted[at], len(key)).astype(U)))
        g = np.concatenate([k for k, _ in self.key]) if self.key else np.zeros(0, U)
        grams = np.concatenate([c for _, c in self.key]) if self.key else np.zeros(0, U)
        self.sort_g = np.argsort(g, kind="stable")
        self.names = Names(a[sort], b[sort], words[sort], g[self.sort_g], grams[self.sort_g])

    def scores(self, words: np.ndarray, grams: np.ndarray, tokens: int, kinds: int, mass: float) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, model score) of each document, from the totals of its sorted names."""
        count = words.astype(np.float64)[self.rank]
        flat = (count + 1) / (tokens + kinds + 1)
        seen = np.empty(len(grams), np.float64)
        seen[self.sort_g] = grams.astype(np.float64)
        auto = Automaton(self, count, np.log10(flat), seen, flat, mass)
        doc = np.repeat(np.arange(len(self.ends) - 1), np.diff(self.ends))
        per = lambda x: np.bincount(doc, x, len(self.ends) - 1)
        own = self.ids[1:]
        return np.diff(self.ends), per((count[own] > 0).astype(np.float64)).astype(np.int64), per(np.log10(flat)[own]), auto.read(self.ids, self.ends)


class Automaton:
    """States are the seen contexts (0: the empty one), arcs the seen continuations."""

    def __init__(self, block: Block, count: np.ndarray, root: np.ndarray, seen: np.ndarray, flat: np.ndarray, mass: float):
        n = len(block.ids)
        self.order, self.root = block.order, root
        # of k-grams by their last place: number, count and probability
        nth, total, prob, first = block.ids, count, flat, 1
        self.enter = np.where(count > 0, 1 + np.arange(len(count)), 0) if block.order > 1 else np.zeros(len(count), np.int64)
        fail, back = [np.zeros(1 + len(count), np.int64)], [np.zeros(1), np.log10(mass / (count + mass))]
        keys, weights, after, used = [], [], [], 0
        for k, (at, of) in enumerate(zip(block.at, block.of), 2):
            kinds = len(block.key[k - 2][0])
            own, used = seen[used : used + kinds], used + kinds
            last = np.zeros(kinds, np.int64)
            last[of] = at  # a place of each n-gram
            p = (own + mass * prob[nth[last]]) / (total[nth[last - 1]] + mass)
            here = np.zeros(n, np.int64)
            here[at] = of
            full = own > 0
            keys.append(((first + nth[last - 1]) << 32 | block.ids[last])[full])
            weights.append(np.log10(p[full]))
            top = k == block.order
            after.append((first + nth[last])[full] if top else (first + len(total) + np.arange(kinds))[full])
            if not top:
                fail.append(first + nth[last])
                back.append(np.log10(mass / (own + mass)))
            nth, total, prob, first = here, own, p, first + len(total)
        self.fail, self.back = np.concatenate(fail), np.concatenate(back)
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        sort = np.argsort(key)
        self.key, self.weight, self.after = key[sort], (np.concatenate(weights) if keys else key)[sort], (np.concatenate(after) if keys else key)[sort]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state, log-probability): failure arcs are taken until the word has an arc; the root has one for every word."""
        out, nxt, open_ = np.zeros(len(state)), np.zeros(len(state), np.int64), np.arange(len(state))
        while len(open_):
            s, w = state[open_], word[open_]
            key = s << 32 | w
            k = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
            hit = self.key[k] == key if len(self.key) else np.zeros(len(key), bool)
            hit &= s > 0
            ends = s == 0
            out[open_[hit]] += self.weight[k[hit]]
            nxt[open_[hit]] = self.after[k[hit]]
            out[open_[ends]] += self.root[w[ends]]
            nxt[open_[ends]] = self.enter[w[ends]]
            rest = ~hit & ~ends
            open_ = open_[rest]
            out[open_] += self.back[s[rest]]
            state = state.copy()
            state[open_] = self.fail[s[rest]]
        return nxt, out

    def read(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The log-probability of each document."""
        doc, begin, size, warm = [], [], [], []
        for d, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            for x in range(a, b, PIECE):
                w = min(self.order - 1, x - a)
                doc.append(d)
                begin.append(1 + x - w)
                size.append(min(PIECE, b - x) + w)
                warm.append(w)
        doc, begin, size, warm = (np.array(x, np.int64) for x in (doc, begin, size, warm))
        sort = np.argsort(-size, kind="stable")
        state = np.where(begin == 1 + ends[:-1][doc], self.enter[0], 0)[sort]
        sums, live = np.zeros(len(doc)), len(doc)
        for t in range(int(size.max(initial=0))):
            while size[sort[live - 1]] <= t:
                live -= 1
            own = sort[:live]
            state[:live], got = self.step(state[:live], ids[begin[own] + t])
            sums[own] += np.where(t < warm[own], 0.0, got)
        return np.bincount(doc, sums, len(ends) - 1)


_TOTALS = pa.schema([("owner", pa.int64()), ("part", pa.int64()), ("payload", pa.binary()), ("kinds", pa.int64()), ("tokens", pa.int64())])
_DDL = "owner long, part long, payload binary, kinds long, tokens long"


def _named(order: int, ranges: int):
    def run(t: pa.Table) -> pa.Table:
        """The names of a block."""
        block = Block(t.column("text").to_pylist(), [not h for h in t.column("held_out").to_pylist()], order)
        return pa.Table.from_pylist([{"owner": t.column("block")[0].as_py(), "part": p, "payload": raw} for p, raw in block.names.parts(ranges)], schema=_TOTALS)

    return run


def _split(ranges: int, groups: int):
    """The names of a group of blocks, united and cut into the ranges of the next round."""

    def run(t: pa.Table) -> pa.Table:
        part, grp = t.column("part")[0].as_py(), t.column("grp")[0].as_py()
        names, _, _ = united([Names.read(x) for x in t.column("payload").to_pylist()])
        rows = [{"owner": part * groups + grp, "part": p, "payload": raw} for p, raw in names.parts(ranges)]
        return pa.Table.from_pylist(rows, schema=_TOTALS)

    return run


def _given(parts: list[Names], rows: list[tuple[int, int]], at: np.ndarray, ag: np.ndarray, words: np.ndarray, grams: np.ndarray, sums: tuple[int, int]) -> pa.Table:
    """The totals of each owner's names, in their order."""
    out, i, j = [], 0, 0
    for k, (p, (owner, part)) in enumerate(zip(parts, rows)):
        i2, j2 = i + len(p.a), j + len(p.g)
        out.append({"owner": owner, "part": part, "payload": pack(words[at[i:i2]], grams[ag[j:j2]]), "kinds": sums[0] if k == 0 else 0, "tokens": sums[1] if k == 0 else 0})
        i, j = i2, j2
    return pa.Table.from_pylist(out, schema=_TOTALS)


def _added(t: pa.Table) -> pa.Table:
    parts = [Names.read(x) for x in t.column("payload").to_pylist()]
    names, at, ag = united(parts)
    return _given(parts, list(zip(t.column("owner").to_pylist(), t.column("part").to_pylist())), at, ag, names.words, names.grams, (int((names.words > 0).sum()), int(names.words.sum())))


def _back(left: pa.Table, right: pa.Table) -> pa.Table:
    """Totals of a group of blocks, dealt out to the blocks."""
    if not len(left):
        return _TOTALS.empty_table()
    parts = [Names.read(x) for x in left.column("payload").to_pylist()]
    _, at, ag = united(parts)
    got = right.sort_by("part")
    words, grams = _joined(got.column("payload").to_pylist())
    return _given(parts, list(zip(left.column("owner").to_pylist(), left.column("part").to_pylist())), at, ag, words, grams, (sum(got.column("kinds").to_pylist()), sum(got.column("tokens").to_pylist())))


def _joined(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate(x) for x in zip(*map(unpack, payloads)))


def totals(rows: DataFrame, fan: int, depth: int, rounds: int) -> DataFrame:
    """owner, part, payload, kinds, tokens for rows of (owner, part, payload): part is a range of fan ** depth, of fan ** rounds at the end."""
    if depth == rounds:
        return rows.select("owner", "part", "payload").groupBy("part").applyInArrow(_added, _DDL)
    groups = fan ** (rounds - depth)
    at = rows.select("owner", "part", "payload", F.pmod(F.xxhash64("owner"), F.lit(groups)).alias("grp"))
    more = cut(at.groupBy("part", "grp").applyInArrow(_split(fan ** (depth + 1), groups), _DDL))
    down = totals(more, fan, depth + 1, rounds)
    at = at.withColumn("group", F.col("part") * groups + F.col("grp"))
    return at.groupBy("group").cogroup(down.withColumnRenamed("owner", "group").groupBy("group")).applyInArrow(_back, _DDL)


def score(docs: DataFrame, order: int = ORDER, mass: float = MASS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row a row of docs."""
    prepare(docs.sparkSession)
    id_ = F.col("doc_id").cast("long")
    held = F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 7 == 2, F.lit(False))
    x = docs.select(id_.alias("doc_id"), held.alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    size = x.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    want = max(1, -(-size // PART))
    rounds = 1
    while FAN**rounds < want:
        rounds += 1
    fan = 1
    while fan**rounds < want:
        fan += 1
    blocks = max(1, -(-size // BLOCK))
    x = x.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    named = x.groupBy("block").applyInArrow(_named(order, fan), _DDL)
    got = cut(totals(named if rounds == 1 else cut(named), fan, 1, rounds))
    whole = got.agg(F.sum("kinds"), F.sum("tokens")).first()
    kinds, tokens = (int(v or 0) for v in whole)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        held_out = left.column("held_out").to_pylist()
        block = Block(left.column("text").to_pylist(), [not h for h in held_out], order)
        words, grams = _joined(right.sort_by("part").column("payload").to_pylist())
        n, known, base, model = block.scores(words, grams, tokens, kinds, mass)
        out = [left.column("doc_id"), left.column("held_out"), pa.array(n), pa.array(known), pa.array(np.full(len(n), tokens, np.int64)), pa.array(base), pa.array(model)]
        return pa.table(out, names=[c.split()[0] for c in schema.split(", ")])

    return x.groupBy("block").cogroup(got.select(F.col("owner").alias("block"), "part", "payload").groupBy("block")).applyInArrow(scored, schema)
