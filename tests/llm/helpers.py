"""Shared by the tests of the corpus operators."""

from __future__ import annotations

from pathlib import Path

SMALL = Path("/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that clash with names the operators use inside.
CLASH = ("key", "h", "g", "n", "rep", "class", "spans", "media", "ids", "length", "piece", "_b", "_doc", "line", "host", "template", "head", "payload")


def documents(spark, texts, langs=None):
    rows = [(i, t, langs[i] if langs else "en", f"s{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in CLASH})


def words(seed: int, n: int) -> list[str]:
    import random

    rng = random.Random(seed)
    return ["".join(rng.choice("aeiourstlnm") for _ in range(rng.randint(3, 8))) for _ in range(n)]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)
