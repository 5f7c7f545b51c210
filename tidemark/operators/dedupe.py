"""Keyed deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list, order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; null keys are a key of their own."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") == 1).drop("__rank")


def keep_last(df: DataFrame, keys: list[str], by: list[str] | None = None, file_column: str | None = None, tiebreak: list[str] | None = None) -> DataFrame:
    """The newest row of each key by the columns ``by``; rows without a value there lose.

    Ties, and all rows without ``by``, are settled by ``tiebreak`` (the place in the file,
    say) and then by every other column in name order, largest first: the result doesn't
    depend on how rows are partitioned. With ``file_column`` keys are distinct within a
    file only.
    """
    rest = sorted(set(df.columns) - set(keys) - set(by or []) - set(tiebreak or []))
    order = [F.col(c).desc_nulls_last() for c in [*(by or []), *(tiebreak or []), *rest]]
    return keep_first(df, [*keys, *([file_column] if file_column else [])], order or [F.lit(1)])
