"""What a plan that has to run anywhere, a Connect server included, can't hold is refused with a clear error.

Python functions over rows, RDDs and their relatives need code and data in the driver's
own process; column expressions, SQL, and registered functions say the same and can be
optimized.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

#: Members that leave the DataFrame world (fixed names).
REFUSED = ("rdd", "foreach", "foreachPartition", "map", "flatMap", "toLocalIterator", "toJSON")


def where(df: DataFrame, *conditions: Column | str) -> DataFrame:
    """Rows that meet all conditions; a Python function instead of a column is a TypeError."""
    for condition in conditions:
        if not isinstance(condition, (Column, str)):
            raise TypeError(f"a condition is a column or SQL, not {type(condition).__name__}: say it with pyspark.sql.functions")
        df = df.filter(condition)
    return df


class Declared:
    """A DataFrame without its imperative members; transformations give such a frame again."""

    def __init__(self, df: DataFrame):
        self._df = df

    def __getattr__(self, name: str):
        if name in REFUSED:
            raise NotImplementedError(f"{name} runs Python over rows; use a column expression, SQL or a registered function")
        member = getattr(self._df, name)
        if not callable(member):
            return member

        def call(*args, **options):
            if name in ("filter", "where"):
                return Declared(where(self._df, *args))
            out = member(*[a._df if isinstance(a, Declared) else a for a in args], **options)
            return Declared(out) if isinstance(out, DataFrame) else out

        return call
