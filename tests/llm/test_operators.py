"""The training-data operators against plain versions, on the small table and on hard rows."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from corvane.llm import bpe, hamming, licenses, mixing, ngram_join, passages, quality, queries, sharding, sparkutil, suffix_dedup, toxicity
from corvane.llm.sparkutil import components, prepare

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, cls long, key string, g long"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]) + str(rng.randrange(400)) for _ in range(n))


def hard_texts():
    """Nulls, empty, white space, one word, copies, near copies, a very long text, a shared passage, other scripts."""
    rng = random.Random(5)
    base, passage = words(rng, 300), words(rng, 90)
    edited = base.split()
    for k in (20, 150, 151, 280):
        edited[k] = "changed"
    out = [None, "", " \n\t ", "one", "One", "three plain words", base, base, base.upper(), " ".join(edited), words(rng, 4000) + " " + passage]
    out += [words(rng, 40) + " " + passage + " " + words(rng, 30) for _ in range(3)]
    out += ["é" * 150 + "日本語" * 60, "x" + "é" * 150 + "日本語" * 60, "a" * 700, "\x00\x85  <|endoftext|> it's  'll\r\n\r\n"]
    out += ["line of licence\n" * 30, "Licensed under CC BY-NC 4.0.", "MIT-License apache license; Apache License"]
    return out


@pytest.fixture(scope="session")
def hard(spark):
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", None, None, None, None, None) for i, t in enumerate(hard_texts())]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_components(spark):
    prepare(spark)
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


@pytest.mark.parametrize("which", ["table", "hard"])
def test_near(spark, sf, hard, which):
    d = docs(spark, sf) if which == "table" else hard
    want = brute.near(pairs(d))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(d).collect()} == want
    kept = sorted(r.doc_id for r in ngram_join.keep_one(d).collect())
    assert kept == sorted(i for i, (n, c) in want.items() if i == c)


def test_near_in_small_pieces(spark, sf, monkeypatch):
    """Blocks, ranges and groups cut small, 48-bit names cut to 20 bits so that shingles share names."""
    monkeypatch.setattr(ngram_join, "GROUP_SHINGLES", 600)
    monkeypatch.setattr(ngram_join, "RANGE_SHINGLES", 3_000)
    d = docs(spark, sf)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(d, block=2_000, bits=20).collect()} == brute.near(pairs(d))


def test_keep_one_goes_by_row(spark):
    rng = random.Random(31)
    a, b = words(rng, 80), words(rng, 80)
    near = a.replace(a.split()[40], "other")
    # id 9 has two texts: a near copy of document 4, and one of its own
    d = spark.createDataFrame([(4, a, 1), (9, near, 1), (9, b, 1), (9, b, 2), (None, b, 1), (None, words(rng, 70), 1)], "doc_id long, text string, v int")
    got = sorted(((r.doc_id, r.text) for r in ngram_join.keep_one(d).collect()), key=str)
    assert len(got) == 3 and got[:2] == [(4, a), (9, b)] and got[2][0] is None


def test_verify_group_is_exact():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 80).astype(np.uint64)
    sets = []
    for _ in range(120):
        s = base.copy()
        k = rng.integers(0, 25)
        s[rng.choice(80, k, replace=False)] = rng.integers(0, 1 << 62, k).astype(np.uint64)
        sets.append(np.unique(s))
    links = ngram_join.verify_group(np.arange(120), sets)
    root = list(range(120))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    for i in range(120):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if 4 * n >= 3 * (len(sets[i]) + len(sets[j]) - n):
                assert find(i) == find(j)
    for a, b in links:
        n = len(np.intersect1d(sets[a], sets[b]))
        assert 4 * n >= 3 * (len(sets[a]) + len(sets[b]) - n)


@pytest.mark.parametrize("which", ["table", "hard"])
def test_suffix(spark, sf, hard, which):
    d = docs(spark, sf) if which == "table" else hard
    flags, text = brute.removed(pairs(d)), dict(pairs(d))
    want = {}
    for i, f in flags.items():
        kept = bytes(b for b, x in zip((text[i] or "").encode(), f) if not x)
        want[i] = (len(f), sum(f), len(re.findall(b"\1+", bytes(f))), hashlib.sha256(kept).hexdigest())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removal(d).collect()} == want
    for r in suffix_dedup.strip(d).collect():
        kept = bytes(b for b, x in zip((text[r.doc_id] or "").encode(), flags[r.doc_id]) if not x).decode("utf-8", "ignore")
        assert (r.text or "") == kept


@pytest.mark.parametrize("widths", [(23, 4, 1), (1,)])
def test_suffix_common_edges(spark, monkeypatch, widths):
    """A passage that many texts share, its edges open in each; texts in one partition and in several."""
    monkeypatch.setattr(suffix_dedup, "WIDTHS", widths)
    rng = random.Random(8)
    passage = words(rng, 45)
    rows = [(i, words(rng, 40) + " " + passage + " " + words(rng, 40)) for i in range(30)]
    rows += [(100 + i, words(rng, 9) + passage[k : k + 210 + 3 * i] + words(rng, 9)) for i, k in enumerate((0, 3, 7, 50, 51))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    flags = brute.removed(rows)
    want = {i: (sum(f), len(re.findall(b"\1+", bytes(f)))) for i, f in flags.items()}
    assert all(n >= 200 for n, _ in want.values())
    for parts in ([1, 7] if len(widths) == 3 else [3]):
        assert {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.removal(d.repartition(parts)).collect()} == want


@pytest.mark.parametrize("which", ["table", "hard"])
def test_bpe(spark, sf, hard, which):
    tokenizers = pytest.importorskip("tokenizers")
    d = docs(spark, sf) if which == "table" else hard
    t = tokenizers.Tokenizer.from_file(queries.vocabulary())
    t.no_truncation()
    t.no_padding()
    text = dict(pairs(d))
    coded = bpe.decode(bpe.encode(d, queries.vocabulary(), keep_ids=True), queries.vocabulary())
    for r in coded.collect():
        ids = t.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        back = t.decode(ids, skip_special_tokens=False)
        assert r.decoded == back and r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


@pytest.mark.parametrize("which", ["table", "hard"])
def test_licenses(spark, sf, hard, which):
    d = docs(spark, sf) if which == "table" else hard
    text = dict(pairs(d))
    for r in licenses.scanned(d).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.low(text[r.doc_id]))
        at = [(i, lab) for p, lab in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        base = {lab for _, lab in at}
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None)
        assert r.base_labels == ",".join(sorted(base)) and base <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        if (text[r.doc_id] or "").startswith("Licensed under CC BY-NC"):
            assert r.labels == "cc-by,cc-by-nc"


def plain_licenses(texts):
    """Labels and best share of each text, every template tried at every place."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.low(t))
    files = [cut(t) for t in texts]
    df = {w: sum(w in set(f) for f in files) for w in licenses.vocabulary()}
    idf = {w: np.log((len(files) + 1) / (n + 1)) + 1e-9 for w, n in df.items()}
    out = []
    for f in files:
        labels = {lab for p, lab in PHRASES.items() if any(f[i : i + len(p.split())] == p.split() for i in range(len(f)))}
        best = 1.0 if labels else 0.0
        for label, key, text in licenses.TEMPLATES:
            t, k = text.split(), key.split()
            s = next(i for i in range(len(t)) if t[i : i + len(k)] == k)
            own = [(i, w) for i, w in enumerate(t) if w not in licenses.COMMON]
            for o in range(-len(t), len(f)):
                if o + s >= 0 and f[o + s : o + s + len(k)] == k:
                    share = sum(idf[w] for i, w in own if 0 <= o + i < len(f) and f[o + i] == w) / sum(idf[w] for _, w in own)
                    best = max(best, min(1.0, share))
                    labels |= {label} if share >= licenses.MATCH else set()
        out.append((",".join(sorted(labels)), pytest.approx(best)))
    return out


def test_licenses_of_several_notices(spark):
    long = [t for _, _, t in licenses.TEMPLATES]
    rng = random.Random(3)
    more = " license conditions following provided modify files software documentation published foundation terms compliance subject international "
    texts = [long[7] + " . " + long[8], " ".join(long), more + long[7], long[8] + more + words(rng, 30) + more + long[1], " ".join(long[1].split()[4:])]
    texts += [words(rng, 20) for _ in range(60)] + ["the license of the software", "permission is hereby granted to none"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scanned(d).collect()}
    want = plain_licenses(texts)
    assert want[0][0] == "bsd,mit"
    assert [got[i] for i in range(len(texts))] == want


def test_licenses_count_and_match_texts_without_the_word_license(spark):
    for phrase in [*licenses.PHRASES, *(k for _, k, _ in licenses.TEMPLATES)]:
        assert re.search(licenses.TRIGGER.replace(r"\x{10FFFF}", "\U0010ffff"), phrase), phrase
    texts = ["This work: Creative Commons Attribution 4.0 International", "under a Creative-Commons, Attribution 4.0 International", "Permission is hereby granted, free of charge, to any person obtaining"]
    texts += [f"public work of general software {i}" for i in range(20)] + [f"a person works with source files and documentation {i}" for i in range(20)] + ["the license of the software"] * 5 + ["nothing"] * 20 + [None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weight = licenses.idf(d)
    assert weight["software"] == pytest.approx(np.log((len(texts) + 1) / 26)) and weight["source"] == pytest.approx(np.log((len(texts) + 1) / 21))
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scanned(d).collect()}
    want = plain_licenses(texts)
    assert want[0][0] == want[1][0] == "cc-by" and [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("which", ["table", "hard"])
def test_quality_base(spark, sf, hard, which):
    d = docs(spark, sf) if which == "table" else hard
    text = dict(pairs(d))
    for r in quality.measured(d).collect():
        t = text[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        win = {}
        for i in range(len(w) - 7):
            win.setdefault(tuple(w[i : i + 8]), []).append(i)
        rep = len({j for v in win.values() if len(v) > 1 for i in v for j in range(i, i + 8)})
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep, len(w) < 20 or 100 * rep > 30 * len(w))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want


def test_quality_bound():
    # the exact bound of 0 of n is 1 - delta^(1/n)
    assert quality.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    assert quality.upper_bound(100, 100, 0.05) == 1.0
    assert 0.05 < quality.upper_bound(5, 100, 0.05) < 0.12
    flat = {(m, lv): 0 for m in quality.METRICS for lv in quality.LEVELS[m]}
    assert quality.cutoffs({"few": (50, flat)}) == {}
    cuts = quality.cutoffs({"many": (100_000, flat | {("symbol_rate", 0.1): 2_000})})
    assert cuts["many"]["symbol_rate"] == 0.2 and cuts["many"]["long_word"] == 10.0


def test_quality_strata_beyond_the_bound_and_all_labels(spark, monkeypatch):
    monkeypatch.setattr(quality, "MAX_STRATA", 3)
    text = " ".join(f"w{k}" for k in range(30))
    bad = " ".join(f"w{k}###" for k in range(30))  # symbol_rate 3
    # a and b are small and come first by name, y and z are large, c to f have few documents each
    langs = ["a"] * 20 + ["b"] * 20 + [x for x in "cdef" for _ in range(700)] + ["y"] * 3000 + ["z"] * 3000
    rows = [(i, text, lang) for i, lang in enumerate(langs)]
    labels = [(i, 1) for i, _, _ in rows]
    extra = [(100_000 + k, bad, lang) for k, lang in enumerate([*"abcdef", "y", "z", None])]
    d = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judged(d, lab).collect()}
    assert len(got) == len(rows) + len(extra) and all(got[i].kept for i, _ in labels)
    # every one is rejected: y and z by cutoffs of their own, the others by the common one's, each needs about 2,300 labels
    assert [(got[i].base_failed, got[i].kept) for i, _, _ in extra] == [(False, False)] * len(extra)
    assert set(quality.calibrate(quality.pooled(quality.measured(d)), lab)) == {"=y", "=z", quality.REST}


def test_quality_many_strata_share_a_cutoff(spark):
    """250 strata, each too small for a cutoff, are judged together; bad documents go, the bound holds on labels held out."""
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(5000):
        marks = 12 if i % 10 == 9 else 0 if rng.random() > 0.004 else 12
        rows.append((i, " ".join(f"w{k}" + "#" * (k < marks) for k in range(30)), f"x{i % 250}"))
        if i < 3000 and i % 10 < 9:
            labels.append((i, 1))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judged(d, lab).collect()}
    assert quality.calibrate(quality.pooled(quality.measured(d)), lab)[quality.REST]["symbol_rate"] < 0.4
    bad = [got[i] for i in range(5000) if i % 10 == 9]
    assert not any(r.kept or r.base_failed for r in bad) and {r.reasons for r in bad} == {"symbol_rate"}
    fresh = [got[i].kept for i in range(3000, 5000) if i % 10 < 9]
    assert fresh.count(False) <= quality.ALPHA * len(fresh)


def test_quality_pools_small_strata(spark):
    good = " ".join(f"w{k}" for k in range(30))
    rows = [(i, good, "a" if i < 900 else f"s{i % 40}") for i in range(1500)]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(i, 1) for i in range(1500)], "doc_id long, quality int")
    cuts = quality.calibrate(quality.pooled(quality.measured(d)), lab)
    assert set(cuts) == {"=a", quality.REST} and all(len(c) == len(quality.METRICS) for c in cuts.values())
    n = quality.least_labels(41)
    assert quality.upper_bound(0, n, quality.DELTA / 41 / 4) <= quality.ALPHA / 4 < quality.upper_bound(0, n - 1, quality.DELTA / 41 / 4)


def test_quality_counts_a_label_once(spark):
    good = " ".join(f"w{k}" for k in range(30))
    d = spark.createDataFrame([(1, good, "a")] * 900 + [(i, good, "b") for i in range(2, 20)], "doc_id long, text string, lang string")
    lab = spark.createDataFrame([(i, 1) for i in range(1, 20)], "doc_id long, quality int")
    assert quality.calibrate(quality.pooled(quality.measured(d)), lab) == {quality.REST: {}}


def test_quality_verdicts(spark, sf):
    d, lab = docs(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.judged(d, lab).collect()
    assert len(got) == d.count() and all(not (r.base_failed and r.kept) for r in got)


def test_mixing(spark, sf):
    sizes = {"a": 1000, "b": 100, "c": 10}
    w, a, b = mixing.weights(sizes, mixing.Target(repeat=3.0))
    assert b == 1110 and all(w[s] * b <= 3.0 * n * (1 + 1e-9) for s, n in sizes.items()) and 0 < a < 1
    h = lambda w: -sum(x * np.log2(x) for x in w.values())
    w, _, _ = mixing.weights(sizes, mixing.Target(entropy=1.2, repeat=1e9))
    assert h(w) == pytest.approx(1.2, abs=1e-6)
    w, a, _ = mixing.weights({"a": 10, "b": 10, "c": 10, "d": 40}, mixing.Target(entropy=0.5))
    assert a > 1 and h(w) == pytest.approx(0.5, abs=1e-9)  # beyond the sources' own shares
    for sizes_, target in (({"a": 5, "b": 5}, mixing.Target(entropy=0.5)), (sizes, mixing.Target(repeat=2.0, budget=3.0)), ({"a": 10, "b": 11, "c": 10}, mixing.Target(entropy=0.01, repeat=1.5))):
        with pytest.raises(ValueError):
            mixing.weights(sizes_, target)
    d = docs(spark, sf)
    m = mixing.mixture(d, mixing.Target(repeat=2.0, budget=1.0)).cache()
    total = d.select(F.sum(mixing.tokens())).first()[0]
    longest = d.select(F.max(mixing.tokens())).first()[0]
    for r in m.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.first("weight").alias("w")).collect():
        assert r.w * total - 1 <= r.n <= r.w * total + longest
    assert m.groupBy("doc_id", "epoch").count().where("count > 1").count() == 0
    whole = mixing.mix(d, mixing.Target(repeat=1.5, budget=None))
    assert whole.columns == d.columns and whole.select("doc_id").distinct().count() == d.count()


@pytest.mark.parametrize("target", [mixing.Target(repeat=2.0, budget=1.3), mixing.Target(repeat=1.5, budget=None), mixing.Target(entropy=1.0, repeat=9.0, budget=0.4)])
@pytest.mark.parametrize("small", [True, False])
def test_mixing_is_the_plain_one(spark, sf, monkeypatch, target, small):
    """Against sorting every source as a whole; sources as a table give the same as sources on the driver."""
    if not small:
        monkeypatch.setattr(mixing, "PLAN_ROWS", 1)
    d = docs(spark, sf)
    rows = mixing._narrow(d)
    for e in range(7):
        rows = rows.withColumn(f"h{e}", mixing.order_key(target.seed, F.lit(e), F.col("key")))
    by = {}
    for r in rows.collect():
        by.setdefault(r.src, []).append(r)
    total = {s: sum(r.n_tokens for r in rs) for s, rs in by.items()}
    w, _, budget = mixing.weights(total, target)
    want = []
    for s, rs in by.items():
        epochs = int(w[s] * budget // total[s] + 1e-9)
        want += [(r.doc_id, e) for e in range(epochs) for r in rs]
        left = round(w[s] * budget - epochs * total[s])
        for r in sorted(rs, key=lambda r: r[f"h{epochs}"]):
            if left <= 0:
                break
            want.append((r.doc_id, epochs))
            left -= r.n_tokens
    got = mixing.mixture(d, target).select("doc_id", "epoch", "block", "place", "n_tokens").collect()
    assert sorted((r.doc_id, r.epoch) for r in got) == sorted(want)
    assert all(r.block == r.place >> 51 for r in got)


def test_tokens(hard):
    for r in hard.select("text", mixing.tokens().alias("n")).collect():
        assert r.n == max(1, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")))


def test_sharding(spark, hard):
    rows = [(i % 40, "x" * (i % 17) * 10) for i in range(600)] + [(7, "same" * 50)] * 30 + [(9999, "y" * 5000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.assign(d, 1000).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    for shard, rs in by.items():
        size = sum(r.n_bytes for r in rs)
        assert size == rs[0].shard_bytes and len(rs) == rs[0].shard_docs and (size <= 1000 or len(rs) == 1)
    assert len(sharding.assign(hard, 100).collect()) == len(hard_texts())


def test_sharding_writes_every_row_to_its_shard(spark, tmp_path):
    rng = random.Random(2)
    rows = [(None, words(rng, 20), i) for i in range(60)] + [(7, words(rng, 15), i) for i in range(20)] + [(8, "same text " * 8, i) for i in range(40)] + [(None, None, 1), (9, "", 2)]
    d = spark.createDataFrame(rows, "doc_id long, text string, shard int").withColumn("key", F.lit("k")).withColumn("part", F.lit(1)).repartition(3)
    name = sharding.write(d, str(tmp_path / "out"), 2_000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert name == "shard_" and sorted(map(repr, (tuple(r) for r in back.select("doc_id", "text", "shard", "key", "part").collect()))) == sorted(repr((*r, "k", 1)) for r in rows)
    sizes = {r[name]: r.n for r in back.groupBy(name).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n")).collect()}
    assert len(sizes) > 3 and max(sizes.values()) <= 2_000
    assert {r.shard for r in sharding.assign(d, 2_000).collect()} == {s[1:] for s in sizes}


@pytest.mark.parametrize("probes", [1024, 0])
def test_hamming(spark, monkeypatch, probes):
    """By rounds alone, by rounds and then blocks, by blocks alone; copies, an outlier, nulls, short vectors."""
    monkeypatch.setattr(hamming, "PROBES", probes)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 40))
    x[100:260] = x[3]
    x[400] = -x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0]), (5000, None), (300, x[300].tolist())]
    d = hamming.codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = {}
    for r in hamming.top_k(d, d.where("id % 100 = 0"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.distance, r.vec_id))
    bits = x > 0
    want = {q: sorted((int((bits[q] != bits[i]).sum()), i) for i in range(700) if i != q)[:5] for q in range(0, 700, 100)}
    assert got == want
    if not probes:
        few = d.where("id < 3")
        assert hamming.top_k(few, few.where("id = 0"), 5).count() == 2


def test_passages(hard):
    got = passages.repeated(hard).collect()
    by = {}
    for r in got:
        if r.kind == "passage":
            by.setdefault(r.passage, set()).add(r.doc_id)
    assert any({10, 11, 12, 13} <= ids for ids in by.values())
    assert {(r.doc_id, r.other_id) for r in got if r.kind == "copy"} == {(7, 6)}
    assert any({6, 9} <= ids for ids in by.values())
    assert not {0, 1, 2, 3, 4, 5} & {r.doc_id for r in got}


def edited(rng, ws, every):
    """ws with a word replaced, left out or put in at about every `every`-th place."""
    out = []
    for k, w in enumerate(ws):
        if k % every == every // 2:
            out += rng.choice([["edit" + str(rng.randrange(9999))], [], [w, "more" + str(rng.randrange(9999))]])
        else:
            out.append(w)
    return out


def plain_passages(docs):
    """{(i, j)} of texts that share a passage of 50 words at 75 %, by local alignment of all pairs (gains as in extended)."""
    ids = {}
    arr = {i: np.array([ids.setdefault(w, len(ids)) for w in re.findall(r"[^\x20\x09-\x0D]+", brute.low(t))], np.int64) for i, t in docs}
    out = set()
    names = sorted(arr)
    for a in names:
        for b in names:
            x, y = arr[a], arr[b]
            if a >= b or min(len(x), len(y)) < 50:
                continue
            slope = np.arange(len(y) + 1) * -1.5
            cell, start = np.zeros(len(y) + 1), np.zeros((2, len(y) + 1), np.int64)
            hits = np.zeros(len(y) + 1, np.int64)
            start[1] = np.arange(len(y) + 1)
            found = False
            for i in range(len(x)):
                same = y == x[i]
                best = np.zeros(len(y) + 1)
                st = np.stack([np.full(len(y) + 1, i + 1), np.arange(len(y) + 1)])
                hit = np.zeros(len(y) + 1, np.int64)
                for cand, s0, h0 in ((np.append(-9.0, cell[:-1] + np.where(same, 1.0, -2.0)), np.concatenate([start[:, :1], start[:, :-1]], axis=1), np.append(0, hits[:-1] + same)), (cell - 1.5, start, hits)):
                    up = cand > best
                    best = np.where(up, cand, best)
                    st, hit = np.where(up, s0, st), np.where(up, h0, hit)
                run = np.maximum.accumulate(best - slope)
                src = np.maximum.accumulate(np.where(best - slope >= run, np.arange(len(y) + 1), 0))
                cell, start, hits = run + slope, st[:, src], hit[src]
                lx, ly = i + 1 - start[0], np.arange(len(y) + 1) - start[1]
                if ((np.minimum(lx, ly) >= 50) & (hits >= 0.75 * np.maximum(lx, ly)) & (cell > 0)).any():
                    found = True
                    break
            if found:
                out.add((a, b))
    return out


def classes(rows):
    by = {}
    for r in rows:
        if r.kind == "passage":
            by.setdefault(r.passage, set()).add(r.doc_id)
    return list(by.values())


def test_passages_keep_every_member_of_a_fuzzy_passage(spark):
    rng = random.Random(21)
    base = words(rng, 80).split()
    rows = [(i, words(rng, 60) + " " + " ".join(edited(rng, base, 12)) + " " + words(rng, 60)) for i in range(8)]
    got = classes(passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [set(range(8))]


def test_passages_of_very_common_seeds(spark):
    """Two passages whose phrases stand in many other texts too, seeds beyond SMALL, pieces cut within a seed."""
    rng = random.Random(4)
    phrases = [words(rng, 12) for _ in range(8)]
    rows = []
    for i in range(120):
        t = " ".join(x for p in rng.sample(phrases, 5) for x in (p, words(rng, 25)))
        rows.append((i, t))
    hold = {k: " ".join(x for p in phrases[4 * k : 4 * k + 4] for x in (p, words(rng, 9))) for k in (0, 1)}
    rows += [(200 + i, words(rng, 40) + " " + " ".join(edited(rng, hold[i % 2].split(), 11)) + " " + words(rng, 30)) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [c & set(range(200, 240)) for c in classes(passages.repeated(d, small=2, piece=40).collect())]
    assert {i for i in range(200, 240, 2)} in got and {i for i in range(201, 240, 2)} in got


def test_passages_of_seeds_whose_first_places_differ(spark):
    """Two texts share a passage of which every seed also stands in many texts that agree no further: no first place is a partner."""
    rng = np.random.default_rng(31)
    words = lambda n: [f"w{k}" for k in rng.integers(0, 1_000_000, n)]
    passage = words(64)
    rows = [(k, " ".join([*words(20), *passage, *words(20)])) for k in (500, 501)]
    for k in range(60):  # each holds all seeds, two or three in a row, in 13 words that stand alone
        parts = [[*words(16), *passage[i : i + 13]] for i in range(k % 3, 52, 4)]
        rows.append((k, " ".join([w for p in rng.permutation(len(parts)) for w in parts[p]] + words(20))))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for sizes in ({"small": 2}, {"small": 2, "piece": 40}):
        assert {500, 501} in [c & {500, 501} for c in classes(passages.repeated(d, **sizes).collect())], sizes


def test_workers_hold_small_chunks():
    """The arrays over a batch of texts stay small beside the executor's heap (71 MB in chunks of 2 MB)."""
    rng = random.Random(35)
    batch = pa.RecordBatch.from_arrays([pa.array([words(rng, 800) for _ in range(256)]), pa.array(range(256), pa.int64())], names=["text", "dkey"])
    for rows in (suffix_dedup._gram_rows([batch], 200), passages._seed_keys([batch])):
        tracemalloc.start()
        assert sum(len(b) for b in rows)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 40_000_000, peak


def test_common_seeds_join_beyond_first_places():
    """Of twelve places of a seed with the same seeds beside, only the fifth and the tenth agree; so do places in two pieces."""
    rng = np.random.default_rng(34)
    ctx = rng.integers(1, 256, (12, 2 * passages.SIDE)).astype(np.uint8)
    ctx[9] = ctx[4]
    g, beside, dkey, at = np.full(12, 5), np.full(12, 3, np.int32), np.arange(1, 13), np.full(12, 30, np.int32)
    a, b = passages.joined(g, beside, beside, dkey, at, ctx, 8)[:2]
    assert (a.tolist(), b.tolist()) == ([4], [9])
    rows = pa.RecordBatch.from_arrays([pa.array(g), pa.array(beside), pa.array(beside), pa.array(dkey), pa.array(at), pa.array([c.tobytes() for c in ctx], pa.binary())], schema=passages._SEED)
    got = pa.Table.from_batches(list(passages._joined_rows([rows[:7]], 2, 100)) + list(passages._joined_rows([rows[7:]], 2, 100)))
    rim = got.filter(pa.compute.is_valid(got["g"])).select([*passages._SEED.names, "piece"])
    one, two = rim["piece"][0], rim["piece"][-1]
    rim = rim.append_column("one", pa.array([one.as_py()] * len(rim))).append_column("two", pa.array([two.as_py()] * len(rim)))
    assert one != two and [r for t in passages._crossed_rows(rim.combine_chunks().to_batches()) for r in t.to_pylist()] == [{"x": 5, "y": 10, "p": 30, "q": 30}]


def test_leaders_miss_no_partner():
    """Every row agrees with a leader that it is joined with, and no two leaders agree, in small groups and in large ones."""
    rng = np.random.default_rng(32)
    kinds = rng.integers(1, 40, (60, 2 * passages.SIDE)).astype(np.uint8)
    ctx = kinds[rng.integers(0, 60, 900)].copy()
    edit = rng.random(ctx.shape) < 0.25
    ctx[edit] = rng.integers(0, 256, edit.sum())
    group = np.sort(np.append(np.zeros(500, np.int64), rng.integers(1, 30, 400)))
    dkey, at = rng.integers(0, 300, 900), rng.integers(0, 400, 900).astype(np.int32)
    lead, a, b = passages.leaders(group, ctx, dkey, at)
    side = passages.SIDE
    half = lambda u, v: max(int(passages.in_order(u[None, k : k + side], v[None, k : k + side])[0]) for k in (0, side))
    want = {}
    heads: dict[int, list[int]] = {}
    for k in range(900):
        mine = heads.setdefault(int(group[k]), [])
        hit = [h for h in mine if (dkey[h] != dkey[k] or abs(int(at[h]) - int(at[k])) >= passages.MIN_WORDS) and half(ctx[h], ctx[k]) >= passages.AGREE]
        for h in hit:
            want.setdefault((int(dkey[h]), k), h)
        if not hit:
            mine.append(k)
    assert sorted(lead.tolist()) == sorted(h for m in heads.values() for h in m)
    assert sorted(zip(a.tolist(), b.tolist())) == sorted((h, k) for (_, k), h in want.items())


def test_places_of_one_text_try_further_ones():
    """The nearest place before in the same text disagrees, the one before that agrees."""
    rng = np.random.default_rng(33)
    ctx = rng.integers(1, 256, (3, 2 * passages.SIDE)).astype(np.uint8)
    ctx[2] = ctx[0]
    a, b = passages.within(np.array([True, False, False]), np.full(3, 7), np.array([0, 100, 200], np.int32), ctx)
    assert (a.tolist(), b.tolist()) == ([0], [2])


def test_passages_recall(spark):
    """Against local alignment of all pairs, at 0.75 to 0.95."""
    rng = random.Random(9)
    rows = []
    for i in range(24):
        base = words(rng, rng.choice([60, 80, 120])).split()
        for k in range(2):
            rows.append((2 * i + k, words(rng, 30) + " " + " ".join(edited(rng, base, [5, 6, 8, 10, 15, 20][i % 6]) if k else base) + " " + words(rng, 30)))
    want = plain_passages(rows)
    assert len(want) >= 18
    got = classes(passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    found = {(a, b) for a, b in want if any({a, b} <= c for c in got)}
    assert len(found) >= 0.9 * len(want)
    assert all(a // 2 == b // 2 for c in got for a in c for b in c)


def test_chain_and_align():
    a = np.array([0, 10, 20, 30, 12, 300])
    b = np.array([5, 15, 26, 36, 200, 1])
    best = passages.chain(a, b)[0]
    assert best == [0, 1, 2, 3]
    # two seeds far apart are two chains
    assert sorted(passages.chain(np.array([0, 5000]), np.array([0, 5000]))) == [[0], [1]]
    # what a chain has gained carries it over a gap, on one diagonal or not
    d = np.array([*range(0, 30, 5), 100, 105, 110])
    assert passages.chain(d, d + 7) == passages.chain(d, d + np.array([7] * 8 + [8])) == [list(range(9))]
    x = np.arange(100).astype("<u4")
    y = np.concatenate([x[10:50], np.array([900, 901], "<u4"), x[52:90]])
    s = np.array([12, 30, 60]), np.array([2, 20, 50])
    assert passages.align([(x, y, *s)]) == [(10, 90, 0, 80, 78, 0)]
    # one seed, edits on both sides of it
    z = x.copy()
    z[[8, 42, 88]] = 7000
    assert passages.align([(x, z, np.array([45]), np.array([45]))])[0][4] >= 90


def test_extended_says_where_it_still_gains():
    x = np.arange(300).astype("<u4")
    y = np.concatenate([x[:20], np.arange(900, 1100).astype("<u4")])
    got = passages.extended([x, y, x[:40], x], [x, x, x, np.delete(x, [30, 44])], 2).tolist()
    assert got == [[48, 48, 48, 1], [20, 20, 20, 0], [40, 40, 40, 0], [48, 46, 46, 1]]
    assert passages.extended([x], [np.delete(x, [30, 44])], 2, 4 * passages.REACH).tolist() == [[192, 190, 190, 1]]
    assert passages.apart([0, 1, 2, 3], np.array([0, 30, 60, 90]), np.array([60, 90, 120, 150])) == [[0, 1], [2, 3]]


def test_extended_counts_all_words_of_a_long_reach():
    x = np.arange(7000).astype("<u4")
    reach = 128 * passages.REACH
    assert passages.extended([x], [x], 2, reach).tolist() == [[reach, reach, reach, 1]]


def test_chains_are_aligned_together_whatever_the_batches_hold(monkeypatch):
    """All chains of a task go through one table, in batches of 10 rows or in one."""
    rng = np.random.default_rng(36)
    rows = []
    for c in range(300):
        x = rng.integers(0, 1 << 32, 120, dtype=np.uint64).astype("<u4")
        y = x.copy()
        y[rng.random(120) < 0.1] = 7
        y[50:55] = x[50:55]
        rows += [{"cid": c, "side": k, "key": 9 + k, "start": 3, "words": w.tobytes(), "at": np.array([53], "<i4").tobytes()} for k, w in enumerate((x, y))]
    t = pa.Table.from_pylist(rows, schema=pa.schema([("cid", pa.int64()), ("side", pa.int32()), ("key", pa.int64()), ("start", pa.int32()), ("words", pa.binary()), ("at", pa.binary())]))
    calls = []
    real = passages.align
    monkeypatch.setattr(passages, "align", lambda chained, reach: calls.append(len(chained)) or real(chained, reach))
    few, all_ = ([r for b in passages._aligned(t.to_batches(max_chunksize=n), passages.REACH) for r in b.to_pylist()] for n in (10, 600))
    assert few == all_ and len(few) > 200 and calls == [300, 300]


def test_only_owners_in_one_pass(spark, monkeypatch):
    """With the keys of all rows the same rows as without, and no text is shuffled; filters that hold some rows by chance."""
    monkeypatch.setattr(sparkutil, "FILTER_BITS", 64)
    sparkutil.prepare(spark)
    src = spark.range(300).select(F.col("id").alias("did"), (F.col("id") * 7).alias("dkey"), F.concat(F.lit("text "), "id").alias("text"))
    spare = src.where("did % 11 = 3").drop("text")
    want = sorted(r.did for r in src.where("did % 11 <> 3").collect())
    assert sorted(r.did for r in sparkutil.only_owners(src, spare).collect()) == want
    got = sparkutil.only_owners(src, spare, src)
    assert got.columns == src.columns and sorted(r.did for r in got.collect()) == want
    assert "hashpartitioning(pair" not in got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(sparkutil, "KEYS", 0)
    assert sorted(r.did for r in sparkutil.only_owners(src, spare, src).collect()) == want


def test_passages_within_a_text(spark):
    rng = random.Random(31)
    base, unit, line = words(rng, 80), words(rng, 60), words(rng, 9)
    fuzzy = " ".join(edited(rng, base.split(), 14))
    rows = [
        (1, " ".join([words(rng, 30), base, words(rng, 40), fuzzy, words(rng, 20)])),  # twice in one text
        (2, " ".join([words(rng, 30), *[unit] * 4, words(rng, 30)])),  # one after the other
        (3, " ".join([words(rng, 200)])),
        (4, " ".join([words(rng, 40), *[line] * 60])),  # a short line over and over
        (5, " ".join([words(rng, 40), line, words(rng, 50), line])),  # too short
    ]
    got = passages.repeated(spark.createDataFrame(rows + rows[:1], "doc_id long, text string")).collect()
    at = {i: sorted((r.start_word, r.end_word) for r in got if r.doc_id == i and r.passage) for i in range(1, 6)}
    assert len(at[1]) == 2 and abs(at[1][0][0] - 30) <= 2 and abs(at[1][0][1] - 110) <= 2 and abs(at[1][1][0] - 150) <= 2
    assert at[2][0][0] <= 32 and at[2][-1][1] >= 268 and all(a[1] <= b[0] for a, b in zip(at[2], at[2][1:]))
    assert not at[3] and not at[5]
    assert at[4][0][0] <= 42 and at[4][-1][1] >= 40 + 9 * 60 - 3
    assert {r.passage for r in got if r.doc_id == 1} != {r.passage for r in got if r.doc_id == 2}
    assert all(r.other_id == r.doc_id and r.kind == "passage" for r in got)


def test_passages_reach_as_far_as_they_gain(spark):
    """Long passages of which most seeds are edited away: the ends go on beyond REACH."""
    rng = random.Random(8)
    rows = []
    for i in range(6):
        base = words(rng, 400).split()
        thin = [w if k % 5 else "edit" + str(rng.randrange(10**6)) for k, w in enumerate(base)]
        thin[200:230] = base[200:230]  # the only words in a row
        rows += [(2 * i, words(rng, 60) + " " + " ".join(base)), (2 * i + 1, " ".join(thin) + " " + words(rng, 80))]
    got = passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    wide = [r for r in got if r.end_word - r.start_word >= 380]
    assert len({r.doc_id for r in wide}) >= 10 and all(r.other_id // 2 == r.doc_id // 2 for r in got)


def test_in_order():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 5, (50, 12)).astype(np.uint8), rng.integers(0, 5, (50, 12)).astype(np.uint8)

    def lcs(u, v):
        row = [0] * (len(v) + 1)
        for p in u:
            row = [0, *row[1:]]
            prev = row[:]
            for j, q in enumerate(v):
                row[j + 1] = max(prev[j + 1], row[j], prev[j] + (p == q and p > 0))
        return row[-1]

    assert passages.in_order(a, b).tolist() == [lcs(u, v) for u, v in zip(a.tolist(), b.tolist())]


def test_toxicity(spark):
    rng = random.Random(1)
    plain = lambda: " ".join(rng.choice(["house", "tree", "river", "stone", "cloud", "green", "bright"]) for _ in range(60))
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        t = plain() + (" you " + rng.choice(["blockhead", "numbskull", "nitwit"]) + " " + plain() if bad else "")
        rows.append((i, t, "en", "s", len(t)))
        labels.append((i, 1, int(bad)))
    rows += [(1000, "what a blokhead you are", "en", "s", 1), (1001, "she wrote of the \"blockhead\" and left", "en", "s", 1), (1002, None, "en", "s", 0), (None, "house", None, None, 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(d, lab).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    held = [(got[i].predicted, y) for i, _, y in labels if got[i].held_out]
    assert len(held) > 30 and sum(p == y for p, y in held) >= 0.98 * len(held)
    assert got[1002].predicted == 0
    assert toxicity.clean_only(d, lab).columns == d.columns
    none = lab.where("false")
    assert all(r.score < 0.01 for r in toxicity.scored(d, none).collect())


def test_automaton():
    lex = toxicity.Lexicon({"scum": 1.0, "worthless": 2.0}, {"idio": 1.5})
    assert lex.match("scum") == ("scum", 0) and lex.match("scam") is None
    for w in ("worthles", "worthlesss", "w0rthless", "vworthless", "worthlass"):
        assert lex.match(w) == ("worthless", 1)
    assert lex.match("worthlas") is None and lex.match("idiotic") == ("idio*", 0) and lex.match("idi") is None


def test_toxicity_words_in_disguise(spark):
    """Digits and signs in the place of letters: the tokeniser leaves the word whole, the automaton counts one edit."""
    lex = toxicity.Lexicon({"stupid": 2.0, "idiot": 2.0, "worthless": 2.0}, {})
    for w in ("st0pid", "stup1d", "idi0t", "w0rthless", "st*pid", "idi@t", "$tupid", "5tupid", "worthle$s"):
        assert lex.features(f"what a {w}, they are")[1] > 0, w
    assert lex.features("stupid")[0] > 0 and lex.features("stupid! idiot*")[0] == np.log1p(2)
    assert toxicity.WORD.findall("a1b 12 c_d e** f!g") == ["a1b", "c", "d", "e", "f!g"]
    rng = random.Random(3)
    plain = lambda: " ".join(rng.choice(["house", "tree", "river", "stone", "cloud"]) for _ in range(40))
    rows = [(i, plain() + (" you idiot " + plain() if i % 2 else "")) for i in range(200)] + [(900, "you idi0t " + plain()), (901, plain() + " 1d 2d"), (903, "tree " * 200_000)]
    labels = [(i, i % 2) for i in range(200)] + [(903, 0)]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.scored(d, lab).collect()}
    assert (got[900], got[901], got[903]) == (1, 0, 0)


def test_automaton_against_edit_distance():
    rng = random.Random(12)
    letters = "abcde"
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    terms = {make(rng.randrange(3, 9)): 1.0 + rng.random() for _ in range(40)}
    lex = toxicity.Lexicon(terms, {})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
        return row[-1]

    for _ in range(1500):
        w = make(rng.randrange(2, 10))
        near = [(d, -terms[t], t) for t in terms if (d := distance(w, t)) == 0 or d == 1 and len(t) >= toxicity.FUZZY_LEN]
        assert lex.match(w) == ((min(near)[2], min(near)[0]) if near else None), w


def test_toxicity_misspelled_beginnings(spark):
    rng = random.Random(1)
    plain = lambda: " ".join(rng.choice(["house", "tree", "river", "stone", "cloud", "green", "bright"]) for _ in range(60))
    bad = ["blockhead", "numbskull", "nitwit"]
    toxic, clean = [plain() + " you " + rng.choice(bad) + " " + plain() for _ in range(100)], [plain() for _ in range(300)]
    stated, stems = toxicity.learn_terms(toxic, clean)
    assert set(bad) <= set(stated) and stems
    lex = toxicity.Lexicon(stated, stems)
    for w, term in [("blokhead", "blockhead"), ("blxckhead", "blockhead"), ("lockhead", "blockhead"), ("nmbskull", "numbskull"), ("xitwit", "nitwit")]:
        assert lex.match(w) == (term, 1), w
    assert lex.match("blockheads")[1] == 0
    rows = [(i, t) for i, t in enumerate(toxic + clean)]
    labels = [(i, 1, int(i < 100)) for i, _ in rows]
    rows += [(1000, "what a blokhead you are"), (1001, plain() + " you xitwit " + plain()), (1002, plain())]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.scored(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert (got[1000].predicted, got[1001].predicted, got[1002].predicted) == (1, 1, 0)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name, tmp_path):
    empty.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline as c

    d = docs(spark, sf).select(*c.COLUMNS)
    near = brute.near(pairs(d))
    out = c.without_near_copies(spark, d, sf)
    assert out.columns == c.COLUMNS and {r.doc_id for r in out.collect()} == {i for i, (n, x) in near.items() if i == x}
    last = c.run(spark, sf)
    assert last.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() >= out.count() * 0.9


def test_null_ids_and_clashing_columns(spark):
    rng = random.Random(11)
    t = words(rng, 120)
    near = t.replace(t.split()[60], "other")
    rows = [(None, t, 1, "a", 2, 3), (4, near, 1, "a", 2, 3), (9, t, 1, "a", 2, 3), (9, t, 1, "a", 2, 3), (5, words(rng, 50), 1, "a", 2, 3), (None, None, 1, "a", 2, 3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, keep_id int, own_key string, cut_did int, score int").withColumn("n_chars", F.length("text")).withColumn("source", F.lit("s")).withColumn("lang", F.lit("en"))
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.link_components(d).collect()), key=str)
    assert got == sorted([(None, 4), (4, 4), (9, 4), (9, 4), (5, 5), (None, None)], key=str)
    kept = ngram_join.keep_one(d)
    assert kept.columns == d.columns and sorted(((r.doc_id, r.text is None) for r in kept.collect()), key=str) == [(4, False), (5, False), (None, True)]
    cut = suffix_dedup.strip(d)
    assert cut.columns == d.columns and cut.count() == len(rows) and all(r.score == 3 and r.own_key == "a" for r in cut.collect())
    assert mixing.mix(d, mixing.Target(repeat=1.5, budget=None)).columns == d.columns
    labels = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.clean_only(d, labels).columns == d.columns
    assert sharding.assign(d).count() == licenses.scanned(d).count() == quality.judged(d, labels).count() == len(rows)
    assert {r.kind for r in passages.repeated(d).collect()} <= {"copy", "passage"}


def test_chain_ids_differ():
    ids = {passages._chain_id(5, 9, a, b) for a in range(60) for b in range(60)}
    assert len(ids) == 3600


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_against_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == sorted(want.select(*cols).fetchall())


def test_bpe_refuses_other_vocabularies():
    import json

    with open(queries.vocabulary(), encoding="utf-8") as f:
        d = json.load(f)
    bpe.Codec(json.dumps(d))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"model": {**d["model"], "byte_fallback": True}}):
        with pytest.raises(ValueError):
            bpe.Codec(json.dumps({**d, **change}))


def test_common_seeds_join_whatever_has_joined():
    """Every place of a common seed joins all leaders that it agrees with, before it and after it, whatever it has joined besides,
    in one piece and in two."""
    rng = np.random.default_rng(36)
    half = lambda u, v: max(int(passages.in_order(u[None, k : k + passages.SIDE], v[None, k : k + passages.SIDE])[0]) for k in (0, passages.SIDE))
    for n, kinds, edits in ((40, 5, 0.3), (300, 90, 0.22)):
        ctx = rng.integers(1, 40, (kinds, 2 * passages.SIDE)).astype(np.uint8)[rng.integers(0, kinds, n)]
        edit = rng.random(ctx.shape) < edits
        ctx[edit] = rng.integers(1, 256, edit.sum())
        g, n1, p1, dkey, at = np.full(n, 5), rng.integers(1, 4, n).astype(np.int32), rng.integers(1, 4, n).astype(np.int32), np.arange(1, n + 1), np.full(n, 30, np.int32)
        agree = {(i, j) for j in range(n) for i in range(j) if half(ctx[i], ctx[j]) >= passages.AGREE}
        missing = lambda pairs, lead: [p for p in agree - {(min(p), max(p)) for p in pairs} if lead & set(p)]
        a, b, lead = passages.joined(g, n1, p1, dkey, at, ctx, 8)
        assert len(agree) > n / 4 and not missing(zip(a.tolist(), b.tolist()), set(lead.tolist()))
        assert len(set(zip(a.tolist(), b.tolist()))) == len(a)
        rows = pa.RecordBatch.from_arrays([pa.array(g), pa.array(n1), pa.array(p1), pa.array(dkey), pa.array(at), pa.array([c.tobytes() for c in ctx], pa.binary())], schema=passages._SEED)
        got = pa.Table.from_batches([r for part in (rows[: n // 3], rows[n // 3 :]) for r in passages._joined_rows([part], 8, 1000)])
        rim = got.filter(pa.compute.is_valid(got["g"])).select([*passages._SEED.names, "piece", "stands"])
        one, two = rim["piece"][0].as_py(), rim["piece"][-1].as_py()
        rim = rim.append_column("one", pa.array([one] * len(rim))).append_column("two", pa.array([two] * len(rim)))
        edges = [(r["x"] - 1, r["y"] - 1) for t in [got.filter(pa.compute.is_valid(got["x"])).select(passages._EDGE.names)] for r in t.to_pylist()]
        edges += [(r["x"] - 1, r["y"] - 1) for t in passages._crossed_rows(rim.combine_chunks().to_batches()) for r in t.to_pylist()]
        assert one != two and not missing(edges, {r["dkey"] - 1 for r in rim.to_pylist() if r["stands"]})


def test_pieces_hold_whole_seeds():
    """A seed of fewer places than a piece is never cut, and parts of others end pieces."""
    rng = np.random.default_rng(37)
    g, part = np.repeat([1, 2, 3, 3], [50, 30, 25, 25]), np.repeat([-1, -1, 0, 1], [50, 30, 25, 25]).astype(np.int32)
    ctx = rng.integers(1, 256, (len(g), 2 * passages.SIDE)).astype(np.uint8)
    cols = [pa.array(g), *[pa.array(np.zeros(len(g), np.int32))] * 2, pa.array(np.arange(len(g))), pa.array(np.full(len(g), 9, np.int32)), pa.array([c.tobytes() for c in ctx], pa.binary())]
    rows = pa.RecordBatch.from_arrays([*cols, pa.array(part)], schema=pa.schema([*passages._SEED, ("part", pa.int32())]))
    got = pa.Table.from_batches(list(passages._joined_rows([rows[i : i + 7] for i in range(0, len(g), 7)], 8, 40)))
    rim = got.filter(pa.compute.is_valid(got["g"]))
    assert set(rim["g"].to_pylist()) == {3} and sorted(rim.group_by("piece").aggregate([("g", "count")])["g_count"].to_pylist()) == [25, 25]
