"""Trailing windows, novelty, level shifts and interval joins, partitioned so that no task gets a whole stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SECOND, HOUR = 1_000_000, 3_600_000_000


def trailing_distinct(rows: DataFrame, seconds: int = 60) -> DataFrame:
    """w: distinct fingerprints of the estate in the last seconds, ends included.

    Each row goes to its own time bucket and the next one, so windows run over
    (estate, bucket), not over all of an estate's time.
    """
    span = seconds * SECOND
    own = F.floor(F.col("at_us") / span)
    spread = rows.select("estate", "alert_id", "at_us", "fingerprint", F.explode(F.array(F.lit(0), F.lit(1))).alias("late")).withColumn("bucket", own + F.col("late"))
    w = Window.partitionBy("estate", "bucket").orderBy("at_us").rangeBetween(-span, 0)
    return spread.withColumn("w", F.size(F.collect_set("fingerprint").over(w)).cast("long")).where("late = 0").select("estate", "alert_id", "w")


def novelty(rows: DataFrame, hours: int = 72) -> DataFrame:
    """novel: the fingerprint was not seen in the hours before. The previous sighting decides, so rows are only sorted."""
    last = F.max("at_us").over(Window.partitionBy("fingerprint").orderBy("at_us").rangeBetween(Window.unboundedPreceding, -1))
    return rows.select("alert_id", "fingerprint", (F.coalesce(F.col("at_us") - last > hours * HOUR, F.lit(True))).alias("novel"))


def level_shift(rows: DataFrame) -> DataFrame:
    """z of each hour's count against the counted hours among the 24 before it; fewer than 3 give 0; held to 50."""
    hourly = rows.groupBy("service", F.floor(F.col("at_us") / HOUR).alias("hour")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("service").orderBy("hour").rangeBetween(-24, -1)
    seen, mean, sd = F.count("n").over(w), F.avg("n").over(w), F.stddev_pop("n").over(w)
    z = F.when((seen < 3) | (sd == 0), 0.0).otherwise(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), (F.col("n") - mean) / sd)))
    return hourly.select("service", "hour", "n", F.round(z, 4).alias("z"))


def trailing_rate(d: DataFrame, seconds: int = 900, least: int = 30, cap: float = 0.5) -> DataFrame:
    """Share of suppressions by service in the last seconds; tripped above cap if there are enough rows."""
    w = Window.partitionBy("service").orderBy("at_us").rangeBetween(-seconds * SECOND, 0)
    n, k = F.count("*").over(w), F.sum(F.when(F.col("action") == "suppress", 1).otherwise(0)).over(w)
    return d.select("alert_id", "service", n.alias("n"), k.alias("k")).withColumn("tripped", (F.col("n") >= least) & (F.col("k") > cap * F.col("n")))


def episodes(rows: DataFrame, hours: int = 1) -> DataFrame:
    """Runs of a fingerprint's alerts without a gap of more than hours."""
    w = Window.partitionBy("fingerprint").orderBy("at_us", "alert_id")
    new = F.when(F.col("at_us") - F.lag("at_us").over(w) <= hours * HOUR, 0).otherwise(1)
    runs = rows.withColumn("new", new).withColumn("episode", F.sum("new").over(w))
    return runs.groupBy("fingerprint", "episode").agg(F.count("*").alias("n"), F.min("alert_id").alias("first_id"), (F.max("at_us") - F.min("at_us")).alias("length_us"))


def in_change_window(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Alerts inside a window (service, begin_us, end_us; ends included; service `*` fits all). Hour buckets make the interval join an equi-join; critical, high, p1 and p2 alerts are exempt, in any case; an alert without severity is not."""
    spread = windows.withColumn("hour", F.explode(F.sequence(F.floor(F.col("begin_us") / HOUR), F.floor(F.col("end_us") / HOUR)))).withColumnRenamed("service", "for_service")
    asked = rows.where(~F.lower(F.trim(F.coalesce("severity_in", F.lit("")))).isin("critical", "high", "p1", "p2")).withColumn("own", F.floor(F.col("at_us") / HOUR)).withColumn("name", F.explode(F.array("service", F.lit("*"))))
    fits = (F.col("own") == F.col("hour")) & (F.col("name") == F.col("for_service")) & F.col("at_us").between(F.col("begin_us"), F.col("end_us"))
    return asked.join(spread, fits, "left_semi").select("alert_id", "service").distinct()


def arrival_peak(rows: DataFrame) -> DataFrame:
    by = rows.groupBy("estate", F.floor(F.col("at_us") / (60 * SECOND)).alias("minute")).agg(F.count("*").alias("n"))
    return by.groupBy("estate").agg(F.max("n").alias("peak"), F.count("*").alias("minutes"))
