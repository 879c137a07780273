"""A rank over a whole table without one task that sorts it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.ordered import Ordered


def global_rank(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """``df`` with the position (from 1) of each row in ``order``, which should be unique to be stable. Only one count
    per range of the order is gathered; an empty table gives an empty result."""
    return Ordered(df, order).position(rank).done()
