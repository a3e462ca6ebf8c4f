"""Operator 2 [native]: mixing sources to target weights by temperature, as budgeted block permutations.

Token shares p of the sources become weights p^a / sum p^a.  The exponent a is found by bisection: the greatest mixture
(smallest a in 0..1, 16 candidates at a time) whose entropy is at most the target and whose repetition of any source (its tokens wanted over its
tokens) is at most the limit.  The weights times the budget are each source's tokens; a source is read in epochs, each a
permutation of its documents in blocks: a 64-bit hash of (seed, epoch, document) orders them, its high bits number the block.
Whole epochs take every document.  The last, partial epoch ends at the document that reaches the budget; the place is found
from sums of blocks, then of sub-blocks in one block, then of documents in one sub-block, so no source is ever sorted as a
whole and a source with a third of all rows is pre-aggregated like the others.

Tokens are words (runs of characters other than space and 0x09-0x0D), at least 1 for every document, so that empty and null
texts take part.  A null source is a source of its own.  Rows of the same doc_id and text are one document with that many
tokens each; all of them are taken together.  An empty table gives an empty one; clashing column names can't occur, as only
doc_id, source and text are read and all others pass unchanged in `mix`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .sparkutil import prepare

BLOCK_BITS = 12
SUB_BITS = 12
#: Rows of the plan (sources times epochs) that are broadcast at most; larger plans are joined by shuffle.
PLAN_ROWS = 10_000


@dataclass(frozen=True)
class Target:
    """entropy: most entropy of the weights, in bits (None: no bound); repeat: most passes over a source; budget: tokens, as a
    multiple of the corpus, or None for just enough that each document is taken once; seed: of the permutations."""

    entropy: float | None = None
    repeat: float = 4.0
    budget: float | None = 1.0
    seed: int = 17


def tokens(text: str = "text") -> Column:
    """Words of a text, at least 1: byte length of its runs of white space, each reduced to one mark."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    marks = F.regexp_replace(F.concat(F.lit(" "), t), r"[\x20\x09-\x0D]+(?=[^\x20\x09-\x0D])", "\u0001 ")
    gaps = F.length(marks) - F.length(F.replace(marks, F.lit("\u0001 "), F.lit("\u0001")))
    return F.greatest(F.lit(1), gaps).cast("long")


def fitted(sums, n_min: float, n_max: float, total: float, target: Target) -> tuple[float, float, float]:
    """(exponent, sum of (n / n_max)^exponent over the sources, budget in tokens): the least exponent that meets the target.
    sums(exponents) gives for each exponent a that sum and the sum of (n / n_max)^a * log2(n / n_max).

    Up to 1 the smallest source is repeated most, beyond it the greatest one; both are looked at, so nothing else of the sources is
    needed.  Entropy falls as the exponent grows, without end but for sources of equal size; repetition is least at 1.  A target
    that no exponent meets raises."""

    def budget(a: float, norm: float) -> float:
        return target.budget * total if target.budget is not None else max(n_max * norm, n_min * norm / max((n_min / n_max) ** a, 1e-300))

    def even(a: float, norm: float, logs: float) -> bool:
        return target.entropy is None or math.log2(norm) - a * logs / norm <= target.entropy + 1e-12

    def seldom(a: float, norm: float, _: float) -> bool:
        own = budget(a, norm) / norm / (target.repeat * (1 + 1e-12))
        return (n_min / n_max) ** a * own <= n_min and own <= n_max

    def least(lo: float, hi: float, held) -> float:
        """The least exponent that holds, where lo doesn't and hi does."""
        while hi - lo > 2.0**-52 * max(1.0, hi):  # 16 parts at a time
            exps = [lo + (hi - lo) * k / 16 for k in range(1, 16)]
            first = next((a for a, s in zip(exps, sums(exps)) if held(a, *s)), hi)
            lo, hi = max([lo, *[a for a in exps if a < first]]), first
            if lo >= hi:
                break
        return hi

    zero, one = sums([0.0, 1.0])
    if not seldom(1.0, *one):
        raise ValueError(f"no exponent keeps every source to {target.repeat} passes: the budget is {budget(1.0, one[0]) / total:.3g} times the corpus")
    both = lambda a, *s: even(a, *s) and seldom(a, *s)
    if even(1.0, *one):
        a = 0.0 if both(0.0, *zero) else least(0.0, 1.0, both)
    else:
        steps = [2.0**k for k in range(1, 13)]
        top = next((a for a, s in zip(steps, sums(steps)) if even(a, *s)), None)
        if top is None:
            raise ValueError(f"no exponent brings the entropy to {target.entropy} bits: several sources are the largest")
        a = least(top / 2, top, even)
        if not seldom(a, *sums([a])[0]):
            raise ValueError(f"an entropy of {target.entropy} bits needs more than {target.repeat} passes over a source")
    norm = sums([a])[0][0]
    return a, norm, budget(a, norm)


def weights(sizes: dict, target: Target) -> tuple[dict, float, float]:
    """(weight of each source, exponent, budget in tokens) for the sources' tokens."""
    if not sum(sizes.values()):
        return {}, 1.0, 0.0
    n = np.array(list(sizes.values()), float)
    a, norm, budget = fitted(local_sums(n), n.min(), n.max(), n.sum(), target)
    return {s: (v / n.max()) ** a / norm for s, v in sizes.items()}, a, budget


def local_sums(n: np.ndarray):
    r = n / n.max()
    return lambda exps: [(float((r**a).sum()), float((r**a * np.log2(r)).sum())) for a in exps]


def table_sums(sizes: DataFrame, n_max: float):
    """The same sums over a table of sources (src, n), whatever its length: one aggregate for all exponents."""
    r = F.col("n") / F.lit(float(n_max))

    def of(exps):
        row = sizes.agg(*[f(F.pow(r, F.lit(float(a)))) for a in exps for f in (F.sum, lambda x: F.sum(x * F.log2(r)))]).first()
        return list(zip(row[::2], row[1::2]))

    return of


def _source() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))


def order_key(seed: int, epoch: Column, key: Column) -> Column:
    """A document's place in an epoch's permutation: 63 bits, of which the first BLOCK_BITS number the block."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch, key), 1)


def _block(h: Column) -> Column:
    return F.shiftright(h, 63 - BLOCK_BITS)


def _sub(h: Column) -> Column:
    return F.shiftright(h, 63 - BLOCK_BITS - SUB_BITS)


def plan(docs: DataFrame, target: Target) -> tuple[DataFrame, dict]:
    """(src, epochs, cut, weight) for each source: epochs 0..epochs-1 in whole, the next one up to place `cut`; and the figures.
    Sources stay a table; the driver sees their number, their sums and, if they are PLAN_ROWS at most, their sizes."""
    base = _narrow(docs).checkpoint()
    sizes = base.groupBy("src").agg(F.sum("n_tokens").alias("n")).checkpoint()
    all_ = sizes.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.min("n").alias("lo"), F.max("n").alias("hi")).first()
    small = all_.k <= PLAN_ROWS
    if not all_.k:
        none = F.lit(0)
        return sizes.select("src", none.alias("epochs"), none.cast("long").alias("cut"), none.cast("double").alias("weight")), {"exponent": 1.0, "budget": 0.0, "small": True}
    sums = local_sums(np.array([r.n for r in sizes.select("n").orderBy("n").collect()], float)) if small else table_sums(sizes, all_.hi)
    a, norm, budget = fitted(sums, all_.lo, all_.hi, all_.n, target)
    weight = F.pow(F.col("n") / F.lit(float(all_.hi)), F.lit(a)) / F.lit(norm)
    goal = sizes.withColumn("weight", weight).withColumn("want", F.col("weight") * F.lit(budget))
    goal = goal.withColumn("epochs", F.floor(F.col("want") / F.col("n") + 1e-9).cast("int"))
    goal = goal.withColumn("left", F.greatest(F.lit(0), F.round(F.col("want") - F.col("epochs") * F.col("n"))).cast("long")).checkpoint()
    near = (lambda d: F.broadcast(d)) if small else (lambda d: d)
    x = base.join(near(goal.where("left > 0").select("src", "epochs", "left")), "src").withColumn("h", order_key(target.seed, F.col("epochs"), F.col("key")))

    def first_over(sums: DataFrame, part: str) -> DataFrame:
        run = Window.partitionBy("src").orderBy(part).rowsBetween(Window.unboundedPreceding, 0)
        s = sums.withColumn("run", F.sum("n").over(run))
        hit = s.where("run >= left").groupBy("src").agg(F.min_by(F.struct(part, "n", "run", "left"), part).alias("m"))
        return hit.select("src", F.col(f"m.{part}").alias("at"), (F.col("m.left") - F.col("m.run") + F.col("m.n")).alias("left"))

    b = first_over(x.groupBy("src", "left", _block(F.col("h")).alias("part")).agg(F.sum("n_tokens").alias("n")), "part")
    y = x.drop("left").join(near(b), "src").where(_block(F.col("h")) == F.col("at"))
    b = first_over(y.groupBy("src", "left", _sub(F.col("h")).alias("part")).agg(F.sum("n_tokens").alias("n")), "part")
    y = y.drop("left", "at").join(near(b), "src").where(_sub(F.col("h")) == F.col("at"))
    b = first_over(y.groupBy("src", "left", F.col("h").alias("part")).agg(F.sum("n_tokens").alias("n")), "part")
    p = goal.join(b.select("src", F.col("at").alias("cut")), "src", "left").select("src", "epochs", F.coalesce("cut", F.lit(-1)).alias("cut"), "weight").checkpoint()
    return p, {"exponent": a, "budget": budget, "small": small}


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", _source().alias("src"), tokens().alias("n_tokens"), _key().alias("key"))


def _key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def _taken(x: DataFrame, p: DataFrame, info: dict, seed: int) -> DataFrame:
    """x (with src and key) once for each epoch that takes it, with weight, epoch, block and place."""
    x = x.join(F.broadcast(p) if info["small"] else p, "src")
    last = order_key(seed, F.col("epochs"), F.col("key")) <= F.col("cut")
    x = x.withColumn("passes", F.col("epochs") + last.cast("int")).where("passes > 0")
    x = x.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    x = x.withColumn("place", order_key(seed, F.col("epoch"), F.col("key")))
    return x.withColumn("block", _block(F.col("place")).cast("int"))


def mixture(docs: DataFrame, target: Target = Target()) -> DataFrame:
    """doc_id, source, n_tokens, weight (of the source), exponent, epoch, block and place of each document taken, once per epoch.

    To read the mixture: epochs in turn, blocks of all sources in turn, by place within a block."""
    prepare(docs.sparkSession)
    p, info = plan(docs, target)
    x = _taken(_narrow(docs), p, info, target.seed).withColumn("exponent", F.lit(info["exponent"]))
    return x.select("doc_id", "source", "n_tokens", "weight", "exponent", "epoch", "block", "place")


def mix(docs: DataFrame, target: Target) -> DataFrame:
    """The documents of the mixture with all their columns, repeated as often as epochs take them."""
    prepare(docs.sparkSession)
    p, info = plan(docs, target)
    names = {c: f"own_{k}" for k, c in enumerate(docs.columns)}
    x = docs.select(_source().alias("src"), _key().alias("key"), *[F.col(c).alias(n) for c, n in names.items()])
    return _taken(x, p, info, target.seed).select(*[F.col(n).alias(c) for c, n in names.items()])
