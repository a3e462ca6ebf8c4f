"""Operator 6 [native]: quality rules with risk-controlled thresholds.

Base measures come from array functions within a row; nothing is exploded or shuffled.  A document fails the base rules with
under 20 words, or with over 30 % of its words in 8-word windows that the text has twice.

Each of METRICS is a measure whose great values speak against a text.  For every stratum (language) and metric a cutoff is
chosen on all labelled good documents (levels are fixed values, so nothing else is fitted): from the most lenient level on, a
level is accepted while the exact binomial (Clopper-Pearson) upper bound of its false rejections is at most ALPHA / metrics, at
confidence 1 - DELTA / (strata * metrics); the first level that fails ends the sequence, so levels need no further correction.
Over all metrics no more than ALPHA of the good documents of any stratum are rejected, with probability 1 - DELTA for all strata
at once.  Strata with fewer labelled good documents than a level without a single false rejection takes (`least_labels`) are
pooled into one, REST, which is counted and judged like any other; if REST is too small itself, it has no cutoff and keeps
what the base rules keep.  Where there are more than MAX_STRATA, those of most documents (ties by name) can stand alone.

Null and empty texts have no words and fail.  A null language is a stratum of its own.  Null labels or doc_ids take no part in
fitting.  Repeated rows give repeated rows; an empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .sparkutil import cut, prepare

ALPHA, DELTA = 0.05, 0.05
METRICS = ("symbol_rate", "dup_line_rate", "repeat_rate", "long_word")
#: Levels of every metric, from lenient to strict (shares; long_word: characters a word).
LEVELS = {
    "symbol_rate": [2.0, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05, 0.02],
    "dup_line_rate": [0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1],
    "repeat_rate": [0.29, 0.25, 0.2, 0.15, 0.1, 0.05],
    "long_word": [40.0, 25.0, 18.0, 14.0, 12.0, 10.0],
}
MAX_STRATA = 200
#: The common stratum (the others are "null" or begin with "=").
REST = "rest"
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that is computed once a row, however often it is used (a projection may be merged into its users)."""
    return df.withColumn(name, F.explode(F.array(value)))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the base measures."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("null")).alias("stratum"), text.alias("text"))
    x = x.withColumn("word_chars", F.char_length(F.translate("text", WHITE, "")).cast("long"))
    x = x.withColumn("n_symbols", (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("long"))
    x = once(x, "lines", F.filter(F.split("text", "\n", -1), lambda s: F.translate(s, WHITE, "") != ""))
    x = x.withColumn("n_lines", F.size("lines").cast("long")).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    x = once(x, "words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+", -1), "")).drop("text")
    x = x.withColumn("n_words", F.size("words").cast("long"))
    x = once(x, "wins", F.transform("words", lambda w: F.xxhash64(w))).drop("words")
    for step in (1, 2, 4):  # hashes of 2, 4 and 8 words, each of two hashes of half as many
        n = F.greatest(F.size("wins") - step, F.lit(0))
        x = once(x, "twin", F.zip_with(F.slice("wins", 1, n), F.slice("wins", step + 1, n), lambda a, b: F.xxhash64(a, b))).drop("wins").withColumnRenamed("twin", "wins")
    twice = F.size("wins") > F.size(F.array_distinct("wins"))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    x = once(x, "sorted", F.when(twice, F.sort_array(F.transform("wins", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none)).drop("wins")
    n = F.size("sorted")
    tail = F.when(n > 0, F.slice("sorted", 2, F.greatest(n - 1, F.lit(0)))).otherwise(none)
    head = F.when(n > 0, F.slice("sorted", 1, F.greatest(n - 1, F.lit(0)))).otherwise(none)
    pairs = F.zip_with(head, tail, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    x = once(x, "at", F.array_sort(F.array_distinct(F.flatten(pairs)))).drop("sorted")
    m = F.size("at")
    steps = F.zip_with(F.slice("at", 1, F.greatest(m - 1, F.lit(0))), F.slice("at", 2, F.greatest(m - 1, F.lit(0))), lambda a, b: F.least(F.lit(8), b - a))
    x = x.withColumn("n_repeat_words", F.when(m > 0, F.aggregate(steps, F.lit(0), lambda s, v: s + v) + 8).otherwise(0).cast("long")).drop("at")
    x = x.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    rate = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    x = x.withColumn("symbol_rate", rate("n_symbols", "n_words")).withColumn("dup_line_rate", rate("n_dup_lines", "n_lines"))
    return x.withColumn("repeat_rate", rate("n_repeat_words", "n_words")).withColumn("long_word", rate("word_chars", "n_words"))


def upper_bound(bad: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the greatest rate at which bad or fewer of n have probability delta."""
    if bad >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in range(bad + 1)]
    lo, hi = bad / n, 1.0
    for _ in range(50):
        p = (lo + hi) / 2
        terms = [c + k * math.log(p) + (n - k) * math.log1p(-p) for k, c in enumerate(logs)] if 0 < p < 1 else [0.0]
        top = max(terms)
        tail = math.exp(top) * sum(math.exp(t - top) for t in terms)
        lo, hi = (lo, p) if tail <= delta else (p, hi)
    return hi


def cutoffs(counts: dict[str, tuple[int, dict[tuple[str, float], int]]], alpha: float = ALPHA, delta: float = DELTA) -> dict[str, dict[str, float]]:
    """stratum -> metric -> cutoff, of (good documents, good documents above each level)."""
    share = delta / (max(1, len(counts)) * len(METRICS))
    out: dict[str, dict[str, float]] = {}
    for stratum, (n, above) in counts.items():
        for m in METRICS:
            for level in LEVELS[m]:
                if n == 0 or above[m, level] > alpha * n or upper_bound(above[m, level], n, share) > alpha / len(METRICS):
                    break
                out.setdefault(stratum, {})[m] = level
    return out


def pooled(measures: DataFrame) -> DataFrame:
    """The measured documents with at most MAX_STRATA strata: the smallest ones are REST."""
    sizes = measures.groupBy("stratum").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "stratum").limit(MAX_STRATA + 1).collect()
    if len(sizes) <= MAX_STRATA:
        return measures
    own = [r["stratum"] for r in sizes[: MAX_STRATA - 1]]
    return measures.withColumn("stratum", F.when(F.col("stratum").isin(own), F.col("stratum")).otherwise(REST))


def least_labels(strata: int, alpha: float = ALPHA, delta: float = DELTA) -> int:
    """The good documents that a stratum needs for a cutoff that rejects none of them."""
    share = delta / (max(1, strata) * len(METRICS))
    return math.ceil(math.log(share) / math.log1p(-alpha / len(METRICS)))


def calibrate(measures: DataFrame, labels: DataFrame) -> dict[str, dict[str, float]]:
    """The cutoffs for measured documents of at most MAX_STRATA strata, from counts over all labelled good documents.  A stratum
    that stands alone has an entry, be it empty; all others go by REST's."""
    lab = labels.select(F.col("doc_id").cast("long").alias("lid"), F.col("quality").cast("int").alias("quality")).where("lid is not null and quality is not null")
    lab = lab.groupBy("lid").agg(F.min("quality").alias("quality")).where("quality = 1").select("lid")
    x = measures.where("not base_failed").join(lab, F.col("lid") == measures["doc_id"], "left_semi")
    x = x.dropDuplicates(["doc_id", "stratum", *METRICS])  # a label is one trial, however often its row is repeated
    levels = [(m, level) for m in METRICS for level in LEVELS[m]]
    rows = x.groupBy("stratum").agg(F.count("*").alias("n"), *[F.count_if(F.col(m) > level).alias(f"{m}|{level}") for m, level in levels]).collect()
    least = least_labels(len(rows))
    counts: dict[str, tuple[int, dict[tuple[str, float], int]]] = {}
    for r in rows:
        name = r["stratum"] if r["n"] >= least else REST
        n, above = counts.get(name, (0, {}))
        counts[name] = (n + r["n"], {k: above.get(k, 0) + r[f"{k[0]}|{k[1]}"] for k in levels})
    found = cutoffs(counts)
    return {name: found.get(name, {}) for name in counts} | {REST: found.get(REST, {})}


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, the base measures, base_failed, kept, and the rules that spoke against a document."""
    prepare(docs.sparkSession)
    x = pooled(cut(measured(docs)))  # narrow, measured once
    cuts = calibrate(x, labels)
    own = [s for s in cuts if s != REST]
    here = lambda s: F.col("stratum") == s if s != REST else ~F.col("stratum").isin(own) if own else F.lit(True)
    reasons = [F.when(here(s) & (F.col(m) > level), F.lit(m)) for s, by in cuts.items() for m, level in by.items()]
    why = F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>")
    x = x.withColumn("reasons", why).withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0))
    return x.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("reasons", ",").alias("reasons"))
