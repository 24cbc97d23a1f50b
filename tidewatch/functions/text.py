"""Accounting of the size of free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def tokens(text: Column) -> Column:
    """A token for each four characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4))


def cap_state(rows: DataFrame, budget: int, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """The newest rows of each key that fit the token budget together."""
    from pyspark.sql import Window

    newest = Window.partitionBy(key).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(key, order, tokens(F.col(text)).alias("tokens")).withColumn("upto", F.sum("tokens").over(newest)).where(F.col("upto") <= budget)
