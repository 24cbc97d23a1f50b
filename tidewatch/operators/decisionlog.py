"""Decisions as rows of an append-only log with JSON bodies: building, validation, projection and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIONS = ["suppress", "page_now", "page_business_hours", "passthrough", "folded"]
CHOICES = ["p1_critical", "p2_high", "p3_medium", "p4_low", "known_noise", "cannot_determine"]
BODY = "disposition string, budget_outcome string, mode string, outbox_id string, q1_choice string, q1_confidence double, reason string, team string, fingerprint string, attestor string"
#: Required keys of a body by type.
REQUIRED = {"decision_requested": ["fingerprint"], "decision_made": ["disposition", "budget_outcome"], "mute_applied": ["fingerprint", "attestor"]}


def clamp(value: Column, options: list[str], default: str = "cannot_determine") -> Column:
    return F.when(value.isin(options), value).otherwise(default)


def budget_outcome(reason: Column, model: Column) -> Column:
    return F.when(reason.startswith("error:"), "error_passthrough").when(model.isNotNull(), "answered_in_time").otherwise("structural_passthrough")


def reason_fallback(budget: Column, disposition: Column) -> Column:
    return F.when(budget.contains("error"), F.concat(F.lit("error:"), budget)).when(budget == "reaper_redrive", "error:reaper_redrive").when(disposition == "passthrough", "uncertain-default").otherwise("unknown")


def validate(log: DataFrame) -> DataFrame:
    """log (seq, type, actor, body) with `problem`: the first rule that a row breaks, null if it may be appended."""
    b = F.from_json("body", BODY)
    absent = {t: F.coalesce(*[F.when(F.get_json_object("body", f"$.{k}").isNull(), F.lit(f"missing {k}")) for k in keys]) for t, keys in REQUIRED.items()}
    low = F.lower(F.trim(b["attestor"]))
    problem = (
        F.when(~F.col("type").isin(list(REQUIRED)), "unknown type")
        .when(~F.col("actor").isin("gate", "operator", "reaper"), "unknown actor")
        .when(F.try_parse_json("body").isNull() | b.isNull(), "no object")
        .when(F.col("type") == "decision_requested", absent["decision_requested"])
        .when((F.col("type") == "decision_made") & absent["decision_made"].isNotNull(), absent["decision_made"])
        .when((F.col("type") == "decision_made") & ~b["disposition"].isin(ACTIONS), "bad disposition")
        .when((F.col("type") == "decision_made") & (F.coalesce(b["mode"], F.lit("live")).isin("live", "shadow") == F.lit(False)), "bad mode")
        .when((F.col("type") == "mute_applied") & absent["mute_applied"].isNotNull(), absent["mute_applied"])
        .when((F.col("type") == "mute_applied") & ((low == "") | low.contains("auto") | low.isin("system", "bot")), "attestor is no human")
    )
    return log.withColumn("problem", problem)


def project(log: DataFrame) -> DataFrame:
    """Flat decisions of a log: one narrow projection; answers are clamped and missing reasons derived."""
    b = F.from_json("body", BODY)
    q1 = clamp(b["q1_choice"], CHOICES)
    conf = F.coalesce(b["q1_confidence"], F.lit(0.0))
    rest = F.greatest(F.lit(0.0), 1 - conf) / (len(CHOICES) - 1)
    return log.where("type = 'decision_made'").select(
        "seq", "alert_id", "at_us", b["fingerprint"].alias("fingerprint"), b["team"].alias("team"), b["disposition"].alias("action"),
        F.coalesce(b["reason"], reason_fallback(F.coalesce(b["budget_outcome"], F.lit("")), b["disposition"])).alias("reason"),
        q1.alias("q1_choice"), F.round(F.when(q1 == "p1_critical", conf).otherwise(rest), 6).alias("p1_reconstructed"),
    )


def page(rows: DataFrame, limit: int, before: int | None = None, order: str = "seq", **equal: str) -> DataFrame:
    """The newest rows before a cursor that meet all given equalities, and whether there are older ones. TakeOrdered: only `limit` rows a task."""
    for c, v in equal.items():
        rows = rows.where(F.col(c) == v)
    rows = rows if before is None else rows.where(F.col(order) < before)
    # one row more than the page tells whether there are older ones; the windows are over these rows only
    found, whole = rows.orderBy(F.col(order).desc()).limit(limit + 1), Window.partitionBy(F.lit(1))
    placed = found.withColumns({"__nth": F.row_number().over(whole.orderBy(F.col(order).desc())), "has_older": F.count(F.lit(1)).over(whole) > limit})
    return placed.where(F.col("__nth") <= limit).drop("__nth")


def tail(rows: DataFrame, limit: int, after: int, order: str = "seq") -> DataFrame:
    """The oldest rows after a cursor."""
    return rows.where(F.col(order) > after).orderBy(order).limit(limit)
