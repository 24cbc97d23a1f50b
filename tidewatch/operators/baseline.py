"""An estate's storm baseline watched: a ring of daily samples, the guard against slow growth, and the bootstrap of a cold start.

Ticks are folded to a row a day first (partial aggregates), so what is ordered by
estate is its days, 365 a year, whatever its traffic. Medians are upper ones: of n
sorted values the one at n // 2. Null estates or times take no part; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Samples in the ring, growth that needs two people's word, microseconds of a day; a bootstrap's samples at least, and the storm floor.
RING, GROWTH, DAY = 40, 3.0, 86_400_000_000
LEAST_SAMPLES, FLOOR = 5, 20


def upper_median(values: Column) -> Column:
    """Of an array; null if it is empty."""
    kept = F.array_sort(F.array_compact(values))
    return F.get(kept, F.floor(F.size(kept) / 2).cast("int"))


def upper_median_of(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """by and the upper median of a value, over a histogram of it: a busy day is as many rows as it has different values."""
    cells = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    upto = Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = cells.withColumns({"upto": F.sum("c").over(upto), "n": F.sum("c").over(Window.partitionBy(*by))})
    return ranked.where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy(*by).agg(F.min("v").alias(name))


def growth(ticks: DataFrame, attested: DataFrame | None = None) -> DataFrame:
    """The guard at the end of each day with ticks: estate, day, baseline, median (of the ring), velocity (median of the day's ticks), ratio, and since (first day of the run of days in which the ratio is beyond GROWTH; null if it is not).

    ticks: estate, at_us, seq, w (distinct alerts a tick), b (baseline then). attested: estate, day, baseline that
    two people have signed, counted from that day on. The reference is the ring's median or the last attested
    baseline, whichever is greater; without any, ratios are 0.
    """
    rows = ticks.where("estate is not null and at_us is not null").withColumn("day", F.floor(F.col("at_us") / DAY))
    last = rows.groupBy("estate", "day").agg(F.max_by(F.col("b").cast("double"), F.struct("at_us", "seq")).alias("baseline"))
    days = last.join(upper_median_of(rows, ["estate", "day"], "w", "velocity"), ["estate", "day"], "left")
    order = Window.partitionBy("estate").orderBy("day")
    days = days.withColumn("median", upper_median(F.collect_list("baseline").over(order.rowsBetween(1 - RING, 0))))
    if attested is None:
        days = days.withColumn("signed", F.lit(None).cast("double"))
    else:
        # the last word up to each day: a bounded number of signatures and days, as one ordered list
        words = attested.groupBy("estate", "day").agg(F.max(F.col("baseline").cast("double")).alias("word"))
        both = days.withColumn("word", F.lit(None).cast("double")).unionByName(words.select("estate", "day", "word"), allowMissingColumns=True)
        told = Window.partitionBy("estate").orderBy("day", F.col("word").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
        days = both.withColumn("signed", F.last("word", ignorenulls=True).over(told)).where("median is not null").drop("word")
    ref = F.greatest("median", "signed")
    part = lambda c: F.when(ref > 0, F.coalesce(F.col(c), F.lit(0.0)) / ref).otherwise(0.0)
    days = days.withColumn("ratio", F.greatest(part("baseline"), part("velocity")))
    over = F.col("ratio") > GROWTH
    # the run of a flagged day begins after the last day that was not flagged
    calm = F.max(F.when(~over, F.col("day"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    run = Window.partitionBy("estate", "calm").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("calm", F.coalesce(calm, F.lit(-1).cast("long")))
    return days.withColumn("since", F.when(over, F.min(F.when(over, F.col("day"))).over(run))).select("estate", "day", "baseline", "median", "velocity", "ratio", "since")


def bootstrap(velocities: DataFrame, floor: int = FLOOR) -> DataFrame:
    """estate, n, outcome and baseline of a cold start, from the velocities (estate, at_us, seq, w) of its window.

    `few` samples teach nothing; a window whose first two thirds are below the floor while the last is not is
    `refused`, as that is an incident and not a busy estate; a median below the floor is `quiet`; else the median is
    `learned`. Samples count as spread evenly over the window. A window is bounded, so it is one list.
    """
    listed = velocities.where("estate is not null and at_us is not null and w is not null").groupBy("estate").agg(F.transform(F.array_sort(F.collect_list(F.struct("at_us", "seq", "w"))), lambda x: x.w).alias("all"))
    n = F.size("all")
    third = lambda i: F.least(F.lit(2), F.floor((i + 0.5) * 3 / n).cast("int"))
    early, late = F.filter("all", lambda _, i: third(i) < 2), F.filter("all", lambda _, i: third(i) == 2)
    outcome = (
        F.when(n < LEAST_SAMPLES, "few")
        .when((upper_median(early) < floor) & (upper_median(late) >= floor), "refused")
        .when(upper_median(F.col("all")) < floor, "quiet")
        .otherwise("learned")
    )
    return listed.select("estate", n.cast("long").alias("n"), outcome.alias("outcome"), F.when(outcome == "learned", upper_median(F.col("all"))).cast("double").alias("baseline"))
