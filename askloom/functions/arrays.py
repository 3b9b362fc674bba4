"""Turning computed arrays into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows_of(df: DataFrame, items: Column | str, *keep: Column | str, pos: str = "pos", item: str = "item") -> DataFrame:
    """One row per array item with its position.

    An inner explode makes the optimizer add filters that repeat the array expression; the outer form
    evaluates a costly array once, and rows of empty arrays are dropped afterwards.
    """
    return df.select(*keep, F.posexplode_outer(items).alias(pos, item)).filter(F.col(pos).isNotNull())
