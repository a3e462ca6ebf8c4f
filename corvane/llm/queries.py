"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib
import os

from pyspark.sql import DataFrame, SparkSession

from . import bpe, clustering, divergence, hamming, licenses, lm_score, mixing, ngram_join, passages, quality, sharding, suffix_dedup, toxicity
from .sparkutil import table


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The path of a public vocabulary file: CORVANE_TOKENIZERS names the folder, else the public_tokenizers package does."""
    folder = os.environ.get("CORVANE_TOKENIZERS")
    return os.path.join(folder, name) if folder else importlib.import_module("public_tokenizers").path(name)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal(table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus' worth of tokens, at most 4 passes over a source, and weights of at most 4 bits of entropy (20 equal sources have 4.3)."""
    return mixing.mixture(table(spark, sf_dir, "documents"), mixing.Target(entropy=4.0, repeat=4.0, budget=1.0))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every vector whose id is divisible by 100, against all rows."""
    data = hamming.codes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return hamming.top_k(data, data.where("id % 100 = 0"), 10)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary())


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.kmeans(table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup,
        op2_source_mixing,
        op3_ngram_jaccard_join,
        op4_license_scan,
        op5_sharding,
        op6_quality_rules,
        op7_hamming_top_k,
        op8_bpe,
        op9_repeated_passages,
        op10_toxicity,
        op11_centroid_clustering,
        op12_source_divergence,
        op13_lm_score,
    )
}
ORACLE_SQL: dict[str, str] = {"op1_suffix_array_dedup": suffix_dedup.ORACLE_SQL, "op3_ngram_jaccard_join": ngram_join.ORACLE_SQL, "op5_sharding": sharding.ORACLE_SQL, "op7_hamming_top_k": hamming.oracle_sql(10)}
ORACLE_SQL |= {"op11_centroid_clustering": clustering.ORACLE_SQL, "op12_source_divergence": divergence.ORACLE_SQL}
