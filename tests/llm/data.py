"""Small document tables with the awkward cases, and plain Python versions of the operators."""

from __future__ import annotations

import random
import re

from pyspark.sql.types import LongType, StringType, StructField, StructType

WORD = re.compile(r"[^\x20\x09-\x0D]+")

DOCS = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
    ]
)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows, odd separators and letters."""
    base, other = prose(1, 120), prose(2, 90)
    near = base.split()
    near[60] = "changed"
    shared = prose(3, 40)
    long = prose(4, 30_000, 5000)
    texts = [
        base, base, " ".join(near), base.upper(), other, f"{prose(5, 30)} {shared} {prose(6, 30)}", f"{prose(7, 25)} {shared}",
        "", None, " \t\n ", "one", "one", "two words", "Größe ist\x0bnicht über", long, f"{long} {prose(8, 50)}",
        "la la la " * 40, f"{shared} {shared}",
    ]
    rows = [(i * 3 + 1, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], rows[7]]  # repeated rows
    rows += [(None, base, None, None, None), (None, other, "en", None, 3), (500, "three words here", None, None, None), (501, None, None, None, None)]
    return rows


def docs(spark, rows: list[tuple] | None = None):
    return spark.createDataFrame(awkward() if rows is None else rows, DOCS)


def clashing(df, *names: str):
    """With more columns, named like those that an operator adds or works with."""
    from pyspark.sql import functions as F

    for name in names:
        df = df.withColumn(name, F.lit("clash"))
    return df
