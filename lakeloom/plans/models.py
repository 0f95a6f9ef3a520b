"""Models over tables: full ones, and ones that replace a time range; audits follow each build."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chunking import embedding_rows
from ..functions.text import naive_words
from ..operators.audits import Audit
from ..sources.versions import VersionedTable


@dataclass(frozen=True)
class Model:
    """``build`` maps inputs to rows; with ``time_column`` a run replaces [start, end) of it, else everything."""

    name: str
    build: Callable[..., DataFrame]
    time_column: str | None = None
    audits: dict[str, Audit] = field(default_factory=dict)


def cleaned(df: DataFrame, id_col: str = "document_id", text_col: str = "raw_text", moment: str | None = "generated_at") -> DataFrame:
    """All columns, and content_length, word_count, data_quality_status."""
    text = F.col(text_col)
    valid = text.isNotNull() & (F.length(text) > 0) & F.col(id_col).isNotNull()
    if moment:
        valid = valid & F.col(moment).isNotNull()
    return df.withColumns(
        {
            "content_length": F.coalesce(F.length(text), F.lit(0)),
            "word_count": F.when(text.isNotNull(), naive_words(text)).otherwise(F.lit(0)),
            "data_quality_status": F.when(valid, "valid").otherwise("invalid"),
        }
    )


def chunked(df: DataFrame, start, end, moment: str = "generated_at", id_col: str = "document_id", text_col: str = "raw_text") -> DataFrame:
    """Embedding rows of the valid documents of a half-open time range."""
    rows = df.filter((F.col("data_quality_status") == "valid") & (F.col(moment) >= F.lit(start)) & (F.col(moment) < F.lit(end)))
    detail = rows.select(F.col(id_col).cast("string").alias("document_id"), moment, "document_type", "source", "language")
    return embedding_rows(rows, id_col, text_col).join(detail, "document_id")


def run(model: Model, table: VersionedTable, rows: DataFrame, start=None, end=None, branch: str = "staging", target: str = "main") -> dict[str, int]:
    """Build on ``branch``, begun anew from ``target``, audit, move ``target`` if nothing is found; returns violations by audit.

    A run over a time range rewrites only files that may hold rows of it, and audits that can see only those.
    """
    new = model.build(rows)
    table.reset_branch(branch, target)
    base = table.branches().get(target)
    made = table.replace_range(new, model.time_column, start, end, branch) if model.time_column else table.overwrite(new, branch)
    return table.settled(branch, target, table.violations(model.audits, base if model.time_column else None, made))
