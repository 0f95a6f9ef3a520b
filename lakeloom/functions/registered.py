"""Functions for SQL callers: the chunkers, a table function, and an aggregate, under names of their own.

Scalar ones are SQL functions, so Catalyst sees through them; the table function and the
aggregate run in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .chunking import TOKEN

#: SQL functions by signature.
SQL_FUNCTIONS = {
    "text_tokens(t STRING) RETURNS ARRAY<STRING>": f"regexp_extract_all(lower(t), r'{TOKEN}', 0)",
    "estimated_tokens(t STRING) RETURNS BIGINT": "cast(floor(length(t) / 4) as bigint)",
    "token_windows(t STRING, size INT, overlap INT) RETURNS ARRAY<STRING>": f"""CASE WHEN t IS NULL OR t = '' THEN cast(array() as array<string>)
        WHEN size <= 0 OR size(regexp_extract_all(lower(t), r'{TOKEN}', 0)) <= size THEN array(t)
        WHEN overlap < 0 OR overlap >= size THEN raise_error('0 <= overlap < size')
        ELSE transform(array(regexp_extract_all(lower(t), r'{TOKEN}', 0)), w -> transform(sequence(0, cast(ceil((size(w) - size) / (size - overlap)) as int)), k -> array_join(slice(w, k * (size - overlap) + 1, size), ' ')))[0] END""",
}


class CharChunks:
    """Table function: pieces of ``size`` characters, each beginning ``overlap`` before the end of the last."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
        if not 0 <= overlap < size:
            raise ValueError("0 <= overlap < size")
        at, k = 0, 0
        while text and (k == 0 or at + overlap < len(text)):
            yield k, text[at : at + size]
            at, k = at + size - overlap, k + 1


def register(spark: SparkSession) -> list[str]:
    """All of them in a session; their names."""
    names = []
    for signature, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
        names.append(signature.split("(")[0])

    @F.pandas_udf("double")
    def middle(values: pd.Series) -> float:
        """Median, null for none."""
        return values.median()

    spark.udf.register("middle", middle)
    spark.udtf.register("char_chunks", F.udtf(CharChunks, returnType="chunk_index int, chunk_text string"))
    return [*names, "middle", "char_chunks"]
