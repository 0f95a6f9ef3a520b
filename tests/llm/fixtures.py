"""Documents with nulls, empty and very long texts, ties, repeats, and clashing column names."""

import random

from pyspark.sql import types as T

NAMES = ["_id", "_text", "_key", "fp", "size", "s"]  # also names that operators use inside
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in NAMES]
)


def texts(seed: int = 5) -> list:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéßü") for _ in range(rng.randint(1, 8))) for _ in range(120)]

    def prose(n):
        out = []
        for i in range(n):
            out.append(rng.choice(words).capitalize() if rng.random() < 0.1 else rng.choice(words))
            out.append("\n" if rng.random() < 0.08 else rng.choice([" ", "  ", "\t"]) if rng.random() < 0.1 else " ")
        return "".join(out)

    passage = prose(60).replace("\n", " ")
    line = "This Line Is Shared By Many Documents"
    base = [prose(rng.randint(3, 200)) for _ in range(40)]
    near = [b + " changed" for b in base[:6]] + [base[0].replace(base[0].split()[1], "zz", 1)]
    planted = [prose(20) + passage + prose(20) for _ in range(4)] + [prose(10) + "\n" + line.upper() + " \n" + prose(5) + "\n" + line for _ in range(5)]
    odd = [None, "", " ", "\n\n", "a", "x" * 30_000, "ab " * 4000, prose(3000), "ünï cödé     𝒳 日本語", "word", base[3], base[3], base[3].upper()]
    return base + near + planted + odd


def documents(spark, rows=None):
    made = texts() if rows is None else rows
    sources = ["web", "books", None, "", "é"]
    data = [(i * 3, t, "en", sources[0] if i % 3 else sources[i % 5], len(t or ""), *["clash"] * len(NAMES)) for i, t in enumerate(made)]
    if rows is None:
        data += [data[2], data[2], (None, "no id at all, but a text of some length", None, None, None, *[None] * len(NAMES))]
    return spark.createDataFrame(data, SCHEMA).repartition(5)


def plain(df) -> list:
    return [(r.doc_id, r.text or "", r.source) for r in df.select("doc_id", "text", "source").collect()]
