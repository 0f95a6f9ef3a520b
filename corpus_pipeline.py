"""The training-text pipeline over ``documents``: quality rules, line dedup, near-dedup, mixing, tokens.

Each stage is a function of (spark, docs, sf_dir); its rows are written as Parquet to
the shared folder and read again as the next stage's ``docs``.  All stages but the last
return the columns of ``documents``; ``n_chars`` follows the text where that changes.

Each stage treats nulls in any column, empty and very long texts, ties, repeated rows,
empty tables and extra columns, whatever their names, as its operator's module says:
an empty table stays empty, extra columns pass by, a long text is worked on in slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm import bpe, linededup, mixing, qualityrules, simhash
from lakeloom.llm.common import dropped, few_files, read_table, written
from lakeloom.llm.queries import PATTERN, RANKS


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null and empty texts are rejected, having no words; repeated rows fare alike; null
    languages are one language.
    """
    return qualityrules.filtered(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines held by a smaller document go, and documents of which nothing is left.

    Rows that share a doc_id are one document; a null doc_id sorts before all others.
    """
    return linededup.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the least id; links by SimHash, then exactly.

    A null id counts as larger than any other; of rows equal in id and text one stays.
    """
    return simhash.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words are drawn to the sources' targets: a row for each pass over a document that takes words of it.

    Null sources are one source, the last; a document of which no word is taken goes.
    """
    return mixing.resampled(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's text is encoded and decoded: counts and digests; a null text is empty."""
    return few_files(bpe.digests(docs, RANKS, PATTERN))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mix), ("byte_bpe", tokens)]

#: No SQL: the stages from near-dedup on can't be expressed; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, one after the other."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name, "none")
        dropped(spark, before)  # a stage's input, once its output is written; the tables themselves stay
    return STAGES[-1][1](spark, docs, sf_dir)
