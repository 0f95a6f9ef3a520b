"""JSON-Schema contracts compiled to Spark: a StructType, and a column with the errors of each row.

Supported: required, type, enum, pattern, minLength, minimum, maximum, minItems,
additionalProperties (for maps), integer-valued maps.  ``format`` isn't enforced.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types of JSON Schema, and fields whose names decide (fixed values).
TYPES = {
    "string": T.StringType(),
    "integer": T.IntegerType(),
    "boolean": T.BooleanType(),
    "array": T.ArrayType(T.StringType()),
    "object": T.MapType(T.StringType(), T.StringType()),
    "number": T.DoubleType(),
}
TIMESTAMPS = ("generated_at", "load_timestamp", "pickup_datetime", "dropoff_datetime", "generation_date")
INTEGERS = ("content_length", "passenger_count", "rate_code_id", "trip_type", "word_count")
LONGS = ("file_size", "document_length")
DOUBLES = (
    "trip_distance", "fare_amount", "extra", "mta_tax", "tip_amount", "tolls_amount", "improvement_surcharge", "total_amount",
    "ehail_fee", "congestion_surcharge", "airport_fee", "pickup_longitude", "pickup_latitude", "dropoff_longitude", "dropoff_latitude",
)
BY_NAME = (
    dict.fromkeys(TIMESTAMPS, T.TimestampType()) | dict.fromkeys(INTEGERS, T.IntegerType()) | dict.fromkeys(LONGS, T.LongType()) | dict.fromkeys(DOUBLES, T.DoubleType())
    | {"keywords": T.ArrayType(T.StringType()), "metadata": T.MapType(T.StringType(), T.StringType())}
)

#: The contract of a document's metadata (fixed values).
DOCUMENT_METADATA = {
    "schema_version": "v1",
    "type": "object",
    "properties": {
        "document_id": {"type": "string", "minLength": 1},
        "document_type": {"type": "string", "enum": ["contract", "legal_memo", "court_filing", "policy_document", "legal_opinion"]},
        "generated_at": {"type": "string", "pattern": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{3})?Z$"},
        "source": {"type": "string"},
        "language": {"type": "string", "enum": ["en", "es", "fr", "de", "it", "pt"]},
        "file_size": {"type": "integer", "minimum": 0},
        "file_path": {"type": "string"},
        "method": {"type": "string", "enum": ["sequential", "spark", "local", "parallel_batch", "distributed"]},
    },
    "required": ["document_id", "document_type", "generated_at", "source", "language", "file_size", "file_path", "method"],
    "additionalProperties": False,
}
#: Known error codes (fixed values).
ERROR_CODES = (
    "E001", "E002", "E003", "E004", "E005", "E006", "E011", "E012", "E013", "E014", "E015",
    "E021", "E022", "E023", "E024", "E031", "E032", "E033", "E041", "E042", "E043", "E999",
)


def struct_type(schema: dict) -> T.StructType:
    """All fields nullable; a schema without properties is empty."""
    return T.StructType([T.StructField(n, BY_NAME.get(n) or TYPES.get(spec.get("type"), T.StringType()), True) for n, spec in schema.get("properties", {}).items()])


def field_errors(name: str, spec: dict, value: Column, required: bool) -> list[Column]:
    """An error text, or null, for each rule of a field."""
    text = value.cast("string")
    rules: list[tuple[Column, str]] = []
    if spec.get("type") in ("integer", "number"):
        rules.append((text.try_cast("bigint" if spec["type"] == "integer" else "double").isNull(), f"is no {spec['type']}"))
    if "enum" in spec:
        rules.append((~text.isin([str(x) for x in spec["enum"]]), "is not allowed"))
    if "pattern" in spec:
        rules.append((~text.rlike(spec["pattern"]), "has another form"))
    if "minLength" in spec:
        rules.append((F.length(text) < spec["minLength"], "is too short"))
    if "minimum" in spec:
        rules.append((text.try_cast("double") < spec["minimum"], "is too small"))
    if "maximum" in spec:
        rules.append((text.try_cast("double") > spec["maximum"], "is too large"))
    if "minItems" in spec:
        rules.append((F.size(value) < spec["minItems"], "has too few items"))
    out = [F.when(value.isNotNull() & rule, F.lit(f"{name} {what}")) for rule, what in rules]
    return ([F.when(value.isNull(), F.lit(f"{name} is required"))] if required else []) + out


def errors(schema: dict, columns: list[str], extra: Column | None = None) -> Column:
    """array<string> of what is wrong with a row; empty if it holds.  A column that isn't there is null."""
    found: list[Column] = []
    for name, spec in schema.get("properties", {}).items():
        value = F.col(name) if name in columns else F.lit(None).cast("string")
        found += field_errors(name, spec, value, name in schema.get("required", []))
    if schema.get("additionalProperties") is False:
        found += [F.lit(f"{c} is not expected") for c in columns if c not in schema["properties"]]
    if extra is not None:
        found.append(extra)
    return F.filter(F.array(*found), lambda e: e.isNotNull()) if found else F.array().cast("array<string>")


def validated(df: DataFrame, schema: dict, columns: list[str] | None = None) -> DataFrame:
    """Adds ``errors`` and ``is_valid``; ``columns`` limits what counts as the record (default: all)."""
    return df.withColumn("errors", errors(schema, columns or df.columns)).withColumn("is_valid", F.size("errors") == 0)


def valid_document(content: Column, kind: Column, least: int = 50) -> Column:
    """A generated document's own rule: a known type and enough text."""
    allowed = DOCUMENT_METADATA["properties"]["document_type"]["enum"]
    return F.coalesce(kind.isin(allowed) & (F.length(F.trim(content)) >= least), F.lit(False))


def known_error(code: Column) -> Column:
    return F.coalesce(code.isin(list(ERROR_CODES)), F.lit(False))


@dataclass(frozen=True)
class External:
    """A table that others fill, declared by name and DDL columns; what it lacks, or has of another type, is an error."""

    name: str
    columns: str

    def schema(self) -> T.StructType:
        """Needs an active session, as parsing DDL does."""
        return T.StructType.fromDDL(self.columns)

    def problems(self, df: DataFrame) -> list[str]:
        has = {f.name: f.dataType for f in df.schema}
        return [
            f"{f.name} is missing" if f.name not in has else f"{f.name} is {has[f.name].simpleString()}, not {f.dataType.simpleString()}"
            for f in self.schema()
            if has.get(f.name) != f.dataType
        ]

    def checked(self, df: DataFrame) -> DataFrame:
        """The declared columns, in order; others are left out."""
        if found := self.problems(df):
            raise ValueError(f"{self.name}: {'; '.join(found)}")
        return df.select(*[F.col(f"`{f.name}`") for f in self.schema()])

    def read(self, spark: SparkSession) -> DataFrame:
        return self.checked(spark.table(self.name))


class Contracts:
    """All ``*.json`` schemas of a folder by name; data files (``*_data.json``) are kept apart."""

    def __init__(self, folder: str):
        files = sorted(Path(folder).glob("*.json"))
        self.folder = folder
        self.schemas = {p.stem: json.loads(p.read_text()) for p in files if not p.stem.endswith("_data")}

    def names(self) -> list[str]:
        return list(self.schemas)

    def required(self, name: str) -> list[str]:
        return self.schemas[name].get("required", [])

    def info(self, spark: SparkSession) -> DataFrame:
        rows = [(n, s.get("schema_version") or s.get("version") or "1.0.0", len(s.get("properties", {})), len(s.get("required", []))) for n, s in self.schemas.items()]
        return spark.createDataFrame(rows, "name string, version string, n_properties int, n_required int")

    def struct_type(self, name: str) -> T.StructType:
        return struct_type(self.schemas[name])

    def validate(self, df: DataFrame, name: str) -> DataFrame:
        return validated(df, self.schemas[name])

    def data(self, spark: SparkSession, name: str) -> DataFrame:
        """The records of ``<name>_data.json``, checked against the contract of the items."""
        df = spark.read.json(f"{self.folder}/{name}_data.json", multiLine=True)
        schema = self.schemas.get(name, {})
        return validated(df, schema.get("items", schema))
