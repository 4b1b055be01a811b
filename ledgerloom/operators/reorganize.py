"""Stable reordering, renumbering and splitting of string tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import number, slug_piece, strip
from .ranks import numbered


def smart_value(name: str) -> Column:
    """STRUCT that sorts numbers and truth values first, then text without regard to case, then blanks."""
    own = strip(name)
    low = F.lower(own)
    num = F.when(low.isin("true", "false"), (low == "true").cast("double")).otherwise(number(name))
    rank = F.when(own == "", 2).when(num.isNotNull(), 0).otherwise(1)
    return F.struct(rank.alias("rank"), F.coalesce(num, F.lit(0.0)).alias("num"), F.when(rank == 1, low).otherwise("").alias("text"))


def reorder(df: DataFrame, group_by: list[str], sort_by: list[str], descending: list[str] = (), ordinal: str = "_row", number_as: str | None = None, start: int = 1) -> DataFrame:
    """Rows by several keys, stable by ``ordinal``; a descending key turns the ranks round too. ``number_as`` takes consecutive numbers."""
    keys = [*group_by, *sort_by]
    if missing := [k for k in keys if k not in df.columns]:
        raise ValueError(f"unknown columns: {', '.join(missing)}; there are {', '.join(df.columns)}")
    order = [smart_value(k).desc() if k in descending else smart_value(k).asc() for k in keys] + [F.col(ordinal).asc()]
    return numbered(df, order, number_as, start) if number_as else df.orderBy(*order)


def file_names(df: DataFrame, group_by: list[str]) -> DataFrame:
    """Adds ``_name``, the file of each row's group, and is the manifest's source."""
    return df.withColumn("_name", F.concat(F.concat_ws("__", *[F.concat(F.lit(f"{k}-"), slug_piece(k)) for k in group_by]), F.lit(".csv")))


def manifest(df: DataFrame, group_by: list[str]) -> DataFrame:
    """(file, group columns, rows) of each group."""
    return file_names(df, group_by).groupBy(F.col("_name").alias("file"), *group_by).agg(F.count("*").alias("n_rows"))
