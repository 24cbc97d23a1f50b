"""Weekly report of a shadow run: what people did against what would have been done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.stats import wilson
from tidewatch.operators.asof import DAY, running

WOULD_PAGE = ["page_now", "page_business_hours", "passthrough"]
SEVERE = ["critical", "high"]


def evaluated(episodes: DataFrame, observations: DataFrame) -> DataFrame:
    """Episodes with their last evaluated observation, by order of arrival; a partial aggregate before the join."""
    last = observations.where(F.col("would").isin([*WOULD_PAGE, "suppress"])).groupBy("episode").agg(F.max_by(F.struct("would", "at_us", "alert_id"), "arrival").alias("o")).select("episode", "o.*")
    return episodes.join(last, "episode")


def divergences(rows: DataFrame) -> DataFrame:
    """Both directions; a page the gate would suppress, and a page it would send where nobody was paged."""
    direction = F.when(F.col("human_paged") & (F.col("would") == "suppress"), "suppress-vs-page").when(~F.col("human_paged") & (F.col("would") == "page_now"), "page-vs-suppress")
    return rows.withColumn("direction", direction).where("direction is not null")


def header(rows: DataFrame) -> DataFrame:
    paged, page, quiet = F.col("human_paged"), F.col("would").isin(WOULD_PAGE), F.col("would") == "suppress"
    n = F.count(F.lit(1))
    bad = F.count_if(paged & quiet & F.col("severity").isin(SEVERE))
    return rows.agg(
        n.alias("episodes"), F.count_if(paged).alias("human_paged"), F.count_if(page).alias("would_page"), F.count_if(quiet).alias("would_suppress"),
        F.round(F.coalesce(F.try_divide(100 * F.count_if((paged & page) | (~paged & quiet)), n), F.lit(100.0)), 4).alias("agreement_pct"),
        F.count_if(paged & quiet).alias("suppress_vs_page"), F.count_if(~paged & (F.col("would") == "page_now")).alias("page_vs_suppress"), bad.alias("severe_misses"), (bad == 0).alias("zero_bar"),
    )


#: Bands of confidence in hundredths, rows a band needs to say anything, and percentage points beyond which it holds the stage.
BANDS, LEAST, HOLD_POINTS = [(95, 100), (90, 94), (85, 89), (70, 84), (50, 69)], 30, 5.0


def calibration(rows: DataFrame) -> DataFrame:
    """Per band of conf_h that has rows: how often people were paged against the band's middle; `hold` where a band with enough rows is off by too much."""
    band = F.coalesce(*[F.when(F.col("conf_h").between(a, b), F.struct(F.lit(a).alias("low_h"), F.lit(b).alias("high_h"))) for a, b in BANDS])
    by = rows.withColumn("band", band).where("band is not null").groupBy("band.low_h", "band.high_h").agg(F.count("*").alias("n"), F.count_if("human_paged").alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    off = F.round(F.abs((F.col("low_h") + F.col("high_h")) / 2 - 100 * F.col("k") / F.col("n")), 1)
    thin = F.col("n") < LEAST
    return by.select("low_h", "high_h", "n", "k", thin.alias("thin"), F.when(~thin, off).alias("off_points"), F.round(low, 3).alias("low"), F.round(high, 3).alias("high"), (~thin & (off > HOLD_POINTS)).alias("hold"))


def report(episodes: DataFrame, observations: DataFrame) -> DataFrame:
    """The whole header, one row. episodes: episode, severity, human_disposition (paged, unpaged, else unknown); observations as in evaluated, with latency_ms and conf_h."""
    last = observations.where(F.col("would").isin([*WOULD_PAGE, "suppress"])).groupBy("episode").agg(F.max_by(F.struct("would", "at_us", "alert_id", "latency_ms", "conf_h"), "arrival").alias("o")).select("episode", "o.*")
    rows = episodes.withColumn("human_paged", F.coalesce(F.col("human_disposition") == "paged", F.lit(False))).join(last, "episode")
    # latencies to a tenth: what the percentile's aggregate holds is a count for each
    tenth = F.round("latency_ms", 1)
    more = rows.withColumn("tenth", tenth).agg(F.count_if(F.col("human_disposition") == "unpaged").alias("human_unpaged_resolved"), F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY tenth)").alias("p99_latency_ms"), F.round(F.coalesce(F.try_divide(100 * F.count_if(F.col("would") == "suppress"), F.count(F.lit(1))), F.lit(0.0)), 1).alias("noise_reduction_pct"))
    held = calibration(rows).agg(F.coalesce(F.bool_or("hold"), F.lit(False)).alias("calibration_hold"))
    seen = episodes.agg(F.count("*").alias("alerts_observed"))
    # four tables of one row each
    one = lambda df: df.withColumn("one", F.lit(1))
    return one(header(rows)).join(one(more), "one").join(one(held), "one").join(one(seen), "one").drop("one")


def numbered(rows: DataFrame, span_us: int = DAY) -> DataFrame:
    """Divergences with their id, D-001 and so on in order of at_us and alert_id; counted by buckets of time, so no task sees all of them."""
    placed = running(divergences(rows).withColumns({"all": F.lit(0), "seq": F.col("alert_id")}), "all", span_us)
    return placed.withColumn("id", F.concat(F.lit("D-"), F.when(F.col("nth") < 100, F.lpad(F.col("nth").cast("string"), 3, "0")).otherwise(F.col("nth").cast("string")))).drop("all", "seq", "nth")
