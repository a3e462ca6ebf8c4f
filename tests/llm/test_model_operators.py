"""Operators 11 to 13 against plain versions and SQL, on the small tables and on hard rows."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import clustering, divergence, lm_score, packing

from .test_operators import SCHEMA, docs, empty, hard, hard_texts, pairs  # noqa: F401


def by_duckdb(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return sorted(con.sql(sql).fetchall(), key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# -- 11 --


def test_nearest_is_exhaustive_search():
    rng = np.random.default_rng(3)
    for span in (2, 50, 5000):  # small spans have many ties
        x, c = rng.integers(-span, span, (500, 64)), rng.integers(-span, span, (9, 64))
        c[4] = c[2]
        d = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
        who, best = clustering.Nearest(c.tolist(), rng.permutation(64).tolist()).assign(x)
        assert (who == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_kmeans_is_sql(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert rows_of(clustering.kmeans(e)) == by_duckdb(clustering.ORACLE_SQL, embeddings=e)


def test_kmeans_hard_rows(spark):
    rng = random.Random(4)
    vec = lambda: [rng.uniform(-2, 2) for _ in range(64)]
    one = vec()
    rows = [(i, vec(), "x") for i in range(40)] + [(i, one, None) for i in range(40, 70)] + [(7, one, "y"), (None, one, "y"), (None, vec(), "")]
    rows += [(100, None, ""), (101, [], ""), (102, vec()[:63], ""), (103, [*vec()[:63], None], ""), (104, [*vec()[:63], float("nan")], ""), (105, [float("-inf"), *vec()[:63]], ""), (106, vec() + [1.0], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string")
    got = rows_of(clustering.kmeans(df))
    assert len(got) == 73 and got == by_duckdb(clustering.ORACLE_SQL, embeddings=df)
    assert clustering.kmeans(df.where("vec_id > 99")).count() == 0
    few = spark.createDataFrame([(1, one), (2, [x + 1 for x in one])], "vec_id long, embedding array<float>")
    assert [r.distance for r in clustering.kmeans(few).collect()] == [0, 0]  # fewer vectors than clusters
    with pytest.raises(Exception, match="beyond"):
        clustering.kmeans(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")).collect()


def test_kmeans_keeps_empty_clusters(spark):
    same = [0.5] * 64
    df = spark.createDataFrame([(i, same if i < 30 else [float(i)] * 64) for i in range(33)], "vec_id long, embedding array<double>")
    assert rows_of(clustering.kmeans(df)) == by_duckdb(clustering.ORACLE_SQL, embeddings=df)


# -- 12 --


def test_trie_is_a_dictionary():
    rng = random.Random(1)
    terms = ["".join(rng.choice("abé") for _ in range(rng.randrange(1, 7))).encode() for _ in range(400)] + [b"a" * 5000, b"a" * 4999]
    tries, want = [divergence.Trie(), divergence.Trie()], {}
    for t in terms:
        k, source, docs = rng.randrange(2), rng.choice("xyz"), rng.randrange(3)
        tries[k].add(t, {source: 2}, docs)
        c = want.setdefault(t, [Counter(), 0])
        c[0][source] += 2
        c[1] += docs
    tries[0].merge(tries[1])
    got = list(tries[0].walk())
    assert [t for t, _ in got] == sorted(want)
    assert all(n.counts == dict(want[t][0]) and n.docs == want[t][1] for t, n in got)


def test_containers_are_the_sorted_terms():
    rng = random.Random(9)
    terms = list({"".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))).encode() for _ in range(900)} | {b"a" * 300})
    got = list(divergence.burst(terms, 20))
    assert [t for c in got for t in c] == sorted(terms) and max(map(len, got)) <= 20


def test_subtrees_add_up(monkeypatch):
    """However often a task sends, the counters and documents of its subtrees are those of its documents."""
    rng = random.Random(3)
    rows = [(rng.choice(["en", ""]), rng.choice("stu"), " ".join(rng.choice(["ab", "Ab", "b1c", "é", "zz"]) for _ in range(rng.randrange(9)))) for _ in range(80)]
    want, in_docs = Counter(), Counter()
    for lang, source, text in rows:
        found = [w.lower() for w in re.findall("[A-Za-zé]+", text)]
        want.update((lang, source, w) for w in found)
        in_docs.update((lang, w) for w in set(found))
    for leaves, counters in ((10**6, 10**6), (3, 10**6), (10**6, 4)):
        monkeypatch.setattr(divergence, "LEAVES", leaves)
        monkeypatch.setattr(divergence, "COUNTERS", counters)
        got, docs_, n = Counter(), Counter(), 0
        batch = pa.RecordBatch.from_arrays([pa.array([r[k].encode() if k == 2 else r[k] for r in rows]) for k in range(3)], names=["lang", "source", "text"])
        for run in (r for b in divergence.counted(iter([batch])) for r in b.to_pylist()):
            lengths, docs_of, fan, who, count = (x.astype(int).tolist() for x in packing.unpack(run["numbers"]))
            terms = [t.decode() for t in divergence._terms(run["terms"], np.array(lengths)).to_pylist()]
            assert terms == sorted(terms, key=str.encode) and run["first"].decode() == terms[0] and run["last"].decode() == terms[-1]
            at, n = 0, n + 1
            for t, d, f in zip(terms, docs_of, fan):
                docs_[run["lang"], t] += d
                for k in range(at, at + f):
                    got[run["lang"], run["sources"][who[k]], t] += count[k]
                at += f
        assert got == want and docs_ == in_docs and (n > 10) == (min(leaves, counters) < 10)


def test_shares_are_exact():
    rng = random.Random(2)
    for size in (1, 7, 10**6, 9 * 10**15):
        c = [rng.randrange(size) for _ in range(50)]
        got = divergence.share(np.array(c, np.int64), np.full(50, size, np.int64))
        assert got.tolist() == [1 + 10**9 * (x + 5) // size for x in c]
    with pytest.raises(OverflowError):
        divergence.share(np.zeros(1, np.int64), np.array([10**16]))


def divergence_rows(spark):
    """Languages with many, one and no kept terms, sources without text, ties, nulls, other scripts."""
    rng = random.Random(6)
    vocab = [f"{a}{b}" for a in "abcdefghÄß日" for b in ("x", "yy", "é")]
    out = []
    for i in range(300):
        lang, source = rng.choice(["en", "en", "en", "de", None]), rng.choice(["s1", "s1", "s2", "s3", None, f"t{rng.randrange(9)}"])
        out.append((i, rng.choice([None, ""]) if i % 17 == 0 else ". ".join(rng.choice(vocab).upper() for _ in range(rng.randrange(40))), lang, source))
    out += [(400, "alone", "fr", "only"), (401, None, "fr", "none"), (402, "", "it", "one")] + out[:5]
    return spark.createDataFrame([(*r, "c", 1) for r in out], "doc_id long, text string, lang string, source string, term string, count int")


def test_divergence_is_sql(spark, sf, monkeypatch):
    d = docs(spark, sf)
    assert rows_of(divergence.audit(d)) == by_duckdb(divergence.ORACLE_SQL, documents=d)
    d = divergence_rows(spark)
    want = by_duckdb(divergence.ORACLE_SQL, documents=d)
    assert len(want) > 300 and rows_of(divergence.audit(d)) == want
    for name, size in (("ROWS", 20), ("TERMS", 5), ("TILE", 2)):  # many ranges, blocks and tiles; workers keep the other sizes
        monkeypatch.setattr(divergence, name, size)
    assert rows_of(divergence.audit(d)) == want


def test_divergence_hard_rows(spark, hard, empty):  # noqa: F811
    assert rows_of(divergence.audit(hard)) == by_duckdb(divergence.ORACLE_SQL, documents=hard)
    assert rows_of(divergence.audit(hard, min_docs=2)) == by_duckdb(divergence.ORACLE_SQL.replace("HAVING count(DISTINCT i) >= 30", "HAVING count(DISTINCT i) >= 2"), documents=hard)
    assert divergence.audit(empty).count() == 0


# -- 13 --


def plain_scores(rows, order, mass):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    docs_ = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), " "], i is not None and zlib.crc32(str(i).encode()) % 7 == 2) for i, t in rows]
    c = Counter()
    for _, t, held in docs_:
        if not held:
            s = [" ", *t]
            c.update((w,) for w in t)
            for n in range(2, order + 1):
                c.update(tuple(s[k - n + 1 : k + 1]) for k in range(n - 1, len(s)))
    total, kinds = sum(n for k, n in c.items() if len(k) == 1), sum(len(k) == 1 for k in c)

    def p(h, w):
        return (c[h + (w,)] + mass * p(h[1:], w)) / ((c[h] if h != (" ",) else c[(" ",)]) + mass) if h else (c[(w,)] + 1) / (total + kinds + 1)

    out = []
    for i, t, held in docs_:
        s = [" ", *t]
        base = math.fsum(math.log10((c[(w,)] + 1) / (total + kinds + 1)) for w in t)
        model = math.fsum(math.log10(p(tuple(s[max(0, k - order + 1) : k]), s[k])) for k in range(1, len(s)))
        out.append((i, held, len(t), sum(c[(w,)] > 0 for w in t), total, base, model))
    return out


def agree(df, rows, order=lm_score.ORDER, mass=lm_score.MASS):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got, want = sorted(map(tuple, lm_score.score(df, order, mass).collect()), key=key), sorted(plain_scores(rows, order, mass), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)
    return got


def test_scores_are_plain(spark, sf):
    got = agree(docs(spark, sf), pairs(docs(spark, sf)))
    held = [r for r in got if r[1]]
    assert held and sum(r[6] for r in held) > sum(r[5] for r in held)  # better than the base on held-out texts


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_in_rounds(spark, monkeypatch, order):
    """Several rounds of ranges, small blocks and pieces."""
    monkeypatch.setattr(lm_score, "PART", 200)
    monkeypatch.setattr(lm_score, "FAN", 3)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "D", "e", "Ü"]) for _ in range(rng.choice([0, 1, 3, 30, 1200])))) for i in range(40)]
    agree(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), rows, order, 2.5)


def test_scores_hard_rows(spark, hard, empty):  # noqa: F811
    agree(hard, pairs(hard))
    twice = hard.select("doc_id", "text").union(hard.select("doc_id", "text")).unionByName(spark.createDataFrame([(None, "one two"), (None, None)], "doc_id long, text string"))
    agree(twice, pairs(twice))
    none = spark.createDataFrame([(i, "held out words") for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in lm_score.score(none).collect()} == {(0, 0, 0.0, 0.0)}
    assert lm_score.score(empty).count() == 0


def test_names_survive_packing():
    rng = np.random.default_rng(1)
    a = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (0, 1, 1000)]
    assert all((x == y).all() and len(x) == len(y) for x, y in zip(a, packing.unpack(packing.pack(*a))))
