"""The shadow report and the suppression band at their edges."""

from pyspark.sql import functions as F
from tidewatch.operators import shadow, watch


def test_an_empty_week(spark):
    found = spark.createDataFrame([("a", "high", "paged")], "episode string, severity string, human_disposition string")
    looked = spark.createDataFrame([], "episode string, would string, at_us long, alert_id long, arrival long, latency_ms double, conf_h int")
    row = shadow.report(found, looked).first()
    assert (row["alerts_observed"], row["episodes"], row["agreement_pct"], row["noise_reduction_pct"], row["zero_bar"], row["p99_latency_ms"], row["calibration_hold"]) == (1, 0, 100.0, 0.0, True, None, False)


def test_the_last_evaluated_observation_counts(spark):
    found = spark.createDataFrame([("a", "critical", "paged"), ("b", "low", None), ("c", "low", "unpaged")], "episode string, severity string, human_disposition string")
    looked = spark.createDataFrame([("a", "page_now", 1, 1, 1, 5.0, 99), ("a", "suppress", 2, 2, 2, None, None), ("a", "not_evaluated", 3, 3, 3, 900.0, 99), ("b", "page_now", 4, 4, 4, 7.04, 97), ("c", "passthrough", 5, 5, 5, 3.0, 80)], "episode string, would string, at_us long, alert_id long, arrival long, latency_ms double, conf_h int")
    row = shadow.report(found, looked).first()
    assert (row["episodes"], row["suppress_vs_page"], row["page_vs_suppress"], row["severe_misses"], row["zero_bar"], row["human_unpaged_resolved"], row["p99_latency_ms"]) == (3, 1, 1, 1, False, 1, 7.0)


def test_a_band_holds_from_thirty_rows_on(spark):
    rows = spark.range(30).select(F.lit(97).alias("conf_h"), (F.col("id") < 27).alias("human_paged"))
    band = shadow.calibration(rows).first()
    assert (band["n"], band["off_points"], band["hold"]) == (30, 7.5, True)
    band = shadow.calibration(rows.limit(29)).first()
    assert (band["thin"], band["off_points"], band["hold"]) == (True, None, False)


def test_divergences_are_numbered_in_order_of_time(spark):
    rows = spark.range(1_200).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("episode"), F.lit("high").alias("severity"), F.lit(True).alias("human_paged"), F.lit("suppress").alias("would"), (F.col("id") * 7 % 1_200).alias("at_us"), F.col("id").alias("alert_id"))
    ids = [r["id"] for r in shadow.numbered(rows, 100).orderBy("at_us").collect()]
    assert ids == [f"D-{i:03d}" for i in range(1, 1_201)]


def test_a_baseline_needs_two_signers(spark):
    decided = spark.range(40).select(F.explode(F.array(F.lit("p"), F.lit("q"), F.lit("none"))).alias("policy_id"), F.col("id").alias("seq"), F.col("id").alias("at_us"), F.lit("suppress").alias("action"))
    base = spark.createDataFrame([("p", 10**6, 0.1, 0.1, ["a", "b"], None), ("q", 10**6, 0.1, 0.1, ["a", "a", None], False)], "policy_id string, window_us long, expected double, sigma double, signed_by array<string>, review_due boolean")
    got = {(r["policy_id"], r["seq"]): r["trip"] for r in watch.trips(decided, base, [10**6]).collect()}
    assert {k[0] for k in got} == {"p"}
    assert got["p", 28] is None and got["p", 29] == "absolute_guardrail"
