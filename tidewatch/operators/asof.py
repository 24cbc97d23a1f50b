"""Reads of the past: what was known of a key just before, or at, a point in time; and counts that run on over all of a key's time.

A key's rows are dealt by buckets of time. Within a bucket a window carries the last
value on; what a bucket starts with comes from the last values of the buckets before,
of which there is one row each. So a key that holds a third of all rows is many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


def asof(left: DataFrame, right: DataFrame, key: str = "key", inclusive: bool = True, span_us: int = DAY) -> DataFrame:
    """left with `found`: the columns of right's last row of the same key up to left's (at_us, seq), as a struct; null if there is none.

    Both have key, at_us and seq. inclusive: right's row of equal at_us and seq counts. Of right's
    rows equal in key, at_us and seq the greatest counts, column by column. Rows of right without
    key or at_us are not found, rows of left without them find none; a null seq comes first.
    """
    values = F.struct(*[F.col(f"`{c}`") for c in right.columns])
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    place = [F.col(f"`{key}`").cast("string").alias("key"), F.col("at_us").alias("at"), F.col("seq").alias("nth"), F.floor(F.col("at_us") / span_us).alias("bucket")]
    known = right.where(F.col(f"`{key}`").isNotNull() & F.col("at_us").isNotNull())
    none = lambda df, e: F.lit(None).cast(df.select(e.alias("x")).schema["x"].dataType)
    asks = left.select(*place, F.lit(1 if inclusive else 0).alias("turn"), none(right, values).alias("value"), row.alias("row"))
    says = known.select(*place, F.lit(0 if inclusive else 1).alias("turn"), values.alias("value"), none(left, row).alias("row"))
    order = [F.col("at").asc(), F.col("nth").asc_nulls_first(), F.col("turn").asc(), F.col("value").asc_nulls_first()]
    inside = Window.partitionBy("key", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    carried = asks.unionByName(says).withColumn("here", F.last("value", ignorenulls=True).over(inside))
    newest = says.groupBy("key", "bucket").agg(F.max_by("value", F.struct("at", "nth", "turn", "value")).alias("last"))
    # what each bucket of left starts with: the last value of any bucket before
    needs = asks.select("key", "bucket").distinct().withColumn("last", none(right, values))
    before = Window.partitionBy("key").orderBy("bucket", F.col("asked").desc()).rowsBetween(Window.unboundedPreceding, 0)
    starts = needs.withColumn("asked", F.lit(True)).unionByName(newest.withColumn("asked", F.lit(False))).withColumn("start", F.last("last", ignorenulls=True).over(before)).where("asked").select("key", "bucket", "start")
    rows = carried.where("row is not null").join(starts, ["key", "bucket"], "left")
    return rows.select("row.*", F.coalesce("here", "start").alias("found"))


def running(rows: DataFrame, key: str = "key", span_us: int = DAY) -> DataFrame:
    """rows with `nth`: their place, from 1, among all of the key in order of at_us and seq."""
    bucketed = rows.withColumn("bucket", F.floor(F.col("at_us") / span_us))
    sizes = bucketed.groupBy(key, "bucket").agg(F.count("*").alias("size"))
    before = sizes.select(key, "bucket", F.coalesce(F.sum("size").over(Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(key, "bucket").orderBy("at_us", "seq"))
    return bucketed.withColumn("inside", inside).join(before, [key, "bucket"]).withColumn("nth", F.col("before") + F.col("inside")).drop("bucket", "inside", "before")
