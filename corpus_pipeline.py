"""The corpus pipeline: toxicity, near duplicates, repeated passages, source mixture, BPE tokens.

Each stage takes (spark, docs, sf_dir) and returns a table; run() writes none of them, the check tool and callers that want
restarts write each stage as Parquet and read it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import bpe, mixing, ngram_join, suffix_dedup, toxicity
from corvane.llm.queries import vocabulary
from corvane.llm.sparkutil import cut, prepare, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: No source is read more than 1.5 times; the budget is the least that keeps every document.
MIXTURE = mixing.Target(repeat=1.5, budget=None)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; the model is fitted on this stage's own documents and the labels table."""
    return toxicity.clean_only(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays."""
    return ngram_join.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur again anywhere are cut out of the texts; every document stays."""
    return suffix_dedup.strip(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed: every document is taken once, those of small sources up to 1.5 times on average."""
    return mixing.mix(docs, MIXTURE)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of ids, with the ids themselves."""
    return bpe.encode(docs, vocabulary(), keep_ids=True)


STAGES = [("toxicity", without_toxic), ("near_duplicates", without_near_copies), ("suffix_dedup", without_repeats), ("mixing", mixed), ("bpe", encoded)]
#: Automata, mixing and merge rounds are no SQL.  tests/llm hold near duplicates, repeats, mixing and tokens against plain versions
#: and SQL, the automaton against edit distance, the toxicity model on held-out rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
