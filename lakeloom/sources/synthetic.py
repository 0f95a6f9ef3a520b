"""Synthetic sources, distributed and deterministic: everything follows from row number and seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import render, utf8_bytes

#: Document kinds, languages and the share of the first language (fixed values).
DOCUMENT_TYPES = ("contract", "legal_memo", "court_filing", "policy_document", "legal_opinion")
LANGUAGES = ("en", "es", "fr", "de", "it", "pt")
FIRST_LANGUAGE = 0.8

TEMPLATES = {
    "contract": "AGREEMENT\n\nThis agreement of {{date}} is between {{party_a}} and {{party_b}}.\n\nArticle 1: Scope\n{{party_a}} provides the services listed in annex {{number}}.\n",
    "legal_memo": "MEMORANDUM\n\nTo: {{party_a}}\nFrom: {{party_b}}\nDate: {{date}}\n\nThe question is whether matter {{number}} falls under the statute.\n",
    "court_filing": "FILING {{number}}\n\n{{party_a}}, plaintiff, against {{party_b}}, defendant.\n\nFiled on {{date}}; the plaintiff asks the court for relief.\n",
    "policy_document": "POLICY {{number}}\n\nIn force from {{date}}. Owner: {{party_a}}. Reviewer: {{party_b}}.\n\nSection 1: Purpose and scope of this policy.\n",
    "legal_opinion": "OPINION {{number}}\n\nRequested by {{party_a}}, given by {{party_b}} on {{date}}.\n\nIn conclusion, the claim is likely to succeed.\n",
}


def _pick(seed: int, salt: str, options: tuple[str, ...]) -> Column:
    at = F.pmod(F.xxhash64(F.col("id"), F.lit(f"{seed}{salt}")), F.lit(len(options))) + 1
    return F.element_at(F.array(*map(F.lit, options)), at.cast("int"))


def _unit(seed: int, salt: str) -> Column:
    return F.pmod(F.xxhash64(F.col("id"), F.lit(f"{seed}{salt}")), F.lit(1_000_000)) / 1_000_000.0


def skewed(spark: SparkSession, rows: int = 1_000_000, seed: int = 42) -> DataFrame:
    """key, value, category, timestamp: 80 % over keys 1-1000, 15 % over five keys, 5 % on one."""
    u = (F.col("id") + 0.5) / rows
    uniform = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)) + 1
    few = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(5)) + 1
    key = F.when(u < 0.80, uniform).when(u < 0.95, few).otherwise(F.lit(1)).cast("int")
    df = spark.range(rows).select(key.alias("key"), (F.pmod(F.xxhash64("id", F.lit(seed + 2)), F.lit(1000)) + 1).cast("int").alias("value"), F.col("id").alias("timestamp"))
    return df.select("key", "value", F.concat(F.lit("category_"), F.pmod("key", F.lit(10)).cast("string")).alias("category"), "timestamp")


def documents(spark: SparkSession, rows: int, only: str | None = None, seed: int = 42, as_of: str = "2024-01-01 00:00:00") -> DataFrame:
    """Rendered documents with metadata; texts that come out under 50 characters are left out."""
    kind = F.lit(only) if only else _pick(seed, "type", DOCUMENT_TYPES)
    digest = F.md5(F.concat_ws("-", F.lit(seed), F.col("id")))
    uuid = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    templates = F.create_map(*[F.lit(x) for pair in TEMPLATES.items() for x in pair])
    names = tuple(f"{a} {b}" for a in ("North", "Green", "Old", "Blue") for b in ("Harbor", "Mill", "Bridge"))
    values = F.create_map(
        F.lit("date"), F.date_format(F.lit(as_of).cast("timestamp"), "yyyy-MM-dd"),
        F.lit("party_a"), _pick(seed, "a", names), F.lit("party_b"), _pick(seed, "b", names), F.lit("number"), F.col("id").cast("string"),
    )
    made = spark.range(rows).select("id", uuid.alias("document_id"), kind.alias("document_type"), values.alias("v"))
    made = made.withColumn("content", render(F.element_at(templates, F.col("document_type")), F.col("v")))
    return metadata(made, seed, as_of).filter(F.length(F.trim("content")) >= 50).drop("id", "v")


def metadata(df: DataFrame, seed: int = 42, as_of: str = "2024-01-01 00:00:00", source: str = "document_generator") -> DataFrame:
    """Adds generated_at (UTC, ``...Z``), language (80 % the first), file_size (UTF-8 bytes), source and method to rows with id and content."""
    language = F.when(_unit(seed, "lang") < FIRST_LANGUAGE, F.lit(LANGUAGES[0])).otherwise(_pick(seed, "other", LANGUAGES[1:]))
    moment = F.timestamp_seconds(F.unix_timestamp(F.lit(as_of).cast("timestamp")) + F.col("id"))
    return df.withColumns(
        {
            "generated_at": F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
            "language": language,
            "file_size": utf8_bytes(F.col("content")).cast("long"),
            "source": F.lit(source),
            "method": F.lit("spark"),
        }
    )
