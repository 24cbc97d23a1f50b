"""Alerts, decisions and outcomes from event tables and vendor payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.kernel import kernel_action, kernel_reason

#: Vendor payload of the second event format, as Spark reads it.
PAGER_EVENT = "routing_key string, event_action string, payload struct<summary:string, source:string, severity:string, component:string, `group`:string, class:string, custom_details:map<string,string>>"
GENERIC_EVENT = "service string, check string, severity string, title string, labels map<string,string>, metric struct<value:string, threshold:string>"


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def alerts(events: DataFrame) -> DataFrame:
    """The alert view of the events table: one narrow projection, no shuffle."""
    user = F.col("user_id")
    k0 = F.get_json_object("props", "$.k").cast("int")
    base = events.select(
        F.col("event_id").alias("alert_id"),
        micros(F.col("ts")).alias("at_us"),
        F.concat(F.lit("e"), (user % 4).cast("string")).alias("estate"),
        F.concat(F.lit("svc-"), (user % 10).cast("string")).alias("service"),
        F.concat(F.lit("team-"), (user % 7).cast("string")).alias("team"),
        F.col("event_type").alias("check_name"),
        F.when(F.col("value") >= 120, "critical").when(F.col("value") >= 60, "high").when(F.col("value") >= 20, "warning").otherwise("info").alias("severity_in"),
        F.concat(F.lit("r"), (user % 3).cast("string")).alias("region"),
        F.concat(F.lit("c"), (user % 2).cast("string")).alias("cluster"),
        F.when(user % 5 == 0, "staging").otherwise("prod").alias("env"),
        F.col("value").alias("metric_value"),
        F.when(user % 10 < 4, k0 % 40).otherwise(k0).cast("long").alias("k"),
        F.col("user_id"),
    )
    return base.withColumn("fingerprint", fingerprint("service", "check_name", "severity_in", "region", "env", "cluster"))


def fingerprint(*columns: str) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *columns), 256), 1, 16)


def answers(alert_rows: DataFrame) -> DataFrame:
    """Alerts with the model's answers in hundredths, and the outcome label (null: none)."""
    k = F.col("k")
    step = lambda a, b, c, d: F.when(k < 40, a).when(k < 70, b).when(k < 90, c).otherwise(d)
    sev = F.when(F.col("alert_id") % 7 == 0, None).when((k >= 70) & (F.col("alert_id") % 3 != 0), 1).when((k >= 40) & (F.col("alert_id") % 50 == 0), 1).otherwise(0)
    return alert_rows.select(
        "*",
        step(0, 1, 10, 60).alias("p1_h"),
        step(1, 8, 30, 30).alias("p2_h"),
        step(4, 71, 40, 5).alias("p3_h"),
        step(5, 10, 10, 3).alias("p4_h"),
        step(90, 10, 10, 2).alias("noise_h"),
        (40 + (F.col("alert_id") * 37 + F.col("user_id") * 11) % 60).cast("int").alias("conf_h"),
        sev.alias("became_sev12"),
        F.when(F.col("alert_id") % 101 == 0, "cannot_determine").otherwise("choice").alias("q3_choice"),
    )


def fingerprint_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("fingerprint").agg(F.count("*").alias("n"), F.coalesce(F.sum("became_sev12"), F.lit(0)).alias("sev12"), F.sum("noise_h").alias("noise_sum"))


def candidate_allowlist(rows: DataFrame, min_samples: int = 5, min_noise_h: int = 60) -> DataFrame:
    return fingerprint_stats(rows).where((F.col("n") >= min_samples) & (F.col("sev12") == 0) & (F.col("noise_sum") >= min_noise_h * F.col("n")))


def decisions(events: DataFrame) -> DataFrame:
    """answers with `allowed`, `action` and `reason`. Spark chooses how the allowlist is joined from its size."""
    rows = answers(alerts(events))
    allow = candidate_allowlist(rows).select(F.col("fingerprint").alias("allow_fp"))
    both = rows.join(allow, F.col("fingerprint") == F.col("allow_fp"), "left").withColumn("allowed", F.col("allow_fp").isNotNull()).drop("allow_fp")
    return both.withColumn("action", kernel_action()).withColumn("reason", kernel_reason())


def from_pager(raw: DataFrame, column: str = "body") -> DataFrame:
    """Vendor events: JSON text to alert columns; `problem` names what is missing, and such rows are for quarantine."""
    rows = raw.withColumn("e", F.from_json(F.col(column), PAGER_EVENT))
    p = F.col("e.payload")
    missing = F.array_compact(F.array(*[F.when(c.isNull() | (c == ""), name) for name, c in (("routing_key", F.col("e.routing_key")), ("summary", p["summary"]), ("source", p["source"]), ("severity", p["severity"]))]))
    return rows.select(
        *raw.columns,
        F.coalesce(p["component"], p["group"], p["source"]).alias("service"),
        F.coalesce(p["class"], F.lit("default")).alias("check_name"),
        p["severity"].alias("severity_in"),
        p["summary"].alias("title"),
        F.transform_values(F.coalesce(p["custom_details"], F.create_map().cast("map<string,string>")), lambda _, v: F.coalesce(v, F.lit(""))).alias("labels"),
        F.col("e.event_action").alias("event_action"),
        F.array_join(missing, ",").alias("problem"),
    )


def from_generic(raw: DataFrame, column: str = "body") -> DataFrame:
    rows = raw.withColumn("e", F.from_json(F.col(column), GENERIC_EVENT))
    return rows.select(
        *raw.columns,
        F.col("e.service").alias("service"),
        F.coalesce("e.check", F.lit("default")).alias("check_name"),
        F.col("e.severity").alias("severity_in"),
        F.col("e.title").alias("title"),
        F.expr("try_cast(e.metric.value AS double)").alias("metric_value"),
        F.expr("try_cast(e.metric.threshold AS double)").alias("metric_threshold"),
        F.when(F.col("e.service").isNull(), "service").otherwise("").alias("problem"),
    )
