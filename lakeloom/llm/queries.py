"""The queries of this subpackage: one ``opN_<name>`` for each operator, and the pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, collocations, linededup, mixing, partenum, pst, quality, qualityrules, repeats, resample, simhash, sketch, toxicity
from .common import few_files, read_table
from .oracles import ORACLES

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(bpe.digests(read_table(spark, sf_dir, "documents"), RANKS, PATTERN))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.compared(read_table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(repeats.digests(read_table(spark, sf_dir, "documents")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(toxicity.judged(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = qualityrules.judged(read_table(spark, sf_dir, "documents"))
    return few_files(rows.select("doc_id", *qualityrules.COLUMNS, "base_failed", "kept"))


def op6_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(pst.scored(read_table(spark, sf_dir, "documents")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(linededup.digests(read_table(spark, sf_dir, "documents")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(simhash.digests(read_table(spark, sf_dir, "documents")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(quality.judged(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(mixing.report(read_table(spark, sf_dir, "documents")))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(partenum.joined(read_table(spark, sf_dir, "documents")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(resample.ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
