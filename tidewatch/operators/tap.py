"""A read-only tap on vendors' lifecycle events: episodes, what is known of an episode at each event, verdicts told again to duplicates, and the tap's health.

An episode's state is made of parts that can be merged: whether it was paged,
acknowledged and resolved are disjunctions, its severity is the last one set. So an
episode's events are dealt by buckets of time, a window runs within a bucket, and what a
bucket starts with comes from one row for each bucket before: an episode that holds a
third of all events is many tasks.

Events have episode, at_us, seq, event_type, estate_severity, and are in order of at_us and
seq, which no two events of an episode share. Null event types are events that change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.asof import DAY, asof
from tidewatch.sources import vendors

#: Event types by what they say of people's work; fixed values.
PAGED = ["incident.triggered", "Create", "create", "firing", "incident.escalated"]
ACKNOWLEDGED = ["incident.acknowledged", "Acknowledge", "acknowledge"]
RESOLVED = ["incident.resolved", "Close", "close", "resolved"]
PAGER_TYPES = ["incident.triggered", "incident.acknowledged", "incident.resolved", "incident.escalated", "incident.priority_updated"]


def episode_of() -> Column:
    return F.concat(vendors.by_vendor(vendors.EPISODES), F.lit("/"), F.col("incident_id"))


def is_one_of(types: list[str]) -> Column:
    return F.coalesce(F.col("event_type").isin(types), F.lit(False))


def flagged(events: DataFrame) -> DataFrame:
    moves = F.coalesce(F.lower("event_type").contains("priority"), F.lit(False))
    return events.withColumns({"paged": is_one_of(PAGED + ACKNOWLEDGED), "acked": is_one_of(ACKNOWLEDGED), "closed": is_one_of(RESOLVED), "moved_to": F.when(moves, F.col("estate_severity")), "place": F.struct("at_us", "seq")})


def merged() -> list[Column]:
    """What is kept of some events of an episode."""
    return [F.bool_or("paged").alias("paged"), F.bool_or("acked").alias("acked"), F.bool_or("closed").alias("closed"), F.max_by("moved_to", F.when(F.col("moved_to").isNotNull(), F.col("place"))).alias("moved_to")]


def disposition(paged: Column, acked: Column, closed: Column) -> Column:
    """What people did, as far as it is known."""
    return F.when(paged, "paged").when(acked | closed, "unpaged").otherwise("unknown")


def followed(events: DataFrame, span_us: int = DAY) -> DataFrame:
    """events with human_disposition and severity of their episode as of each, it included; was_severity before it; and first, whether it opened the episode."""
    e = flagged(events).withColumn("bucket", F.floor(F.col("at_us") / span_us))
    parts = e.groupBy("episode", "bucket").agg(*merged(), F.min_by(F.struct("estate_severity", "place"), "place").alias("first"))
    earlier = Window.partitionBy("episode").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        "episode", "bucket", *[F.coalesce(F.bool_or(c).over(earlier), F.lit(False)).alias(f"{c}0") for c in ("paged", "acked", "closed")], F.last("moved_to", ignorenulls=True).over(earlier).alias("moved0"),
        F.first("first").over(Window.partitionBy("episode").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("opening"),
    )
    order = Window.partitionBy("episode", "bucket").orderBy("at_us", "seq")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    inside = e.withColumns({**{f"{c}1": F.bool_or(c).over(upto) for c in ("paged", "acked", "closed")}, "now1": F.last("moved_to", ignorenulls=True).over(upto), "was1": F.last("moved_to", ignorenulls=True).over(before)})
    rows = inside.join(starts, ["episode", "bucket"])
    known = {c: F.col(f"{c}0") | F.col(f"{c}1") for c in ("paged", "acked", "closed")}
    opened = F.col("opening.estate_severity")
    return rows.select(
        *[F.col(f"`{c}`") for c in events.columns], disposition(known["paged"], known["acked"], known["closed"]).alias("human_disposition"), F.coalesce("now1", "moved0", opened).alias("severity"), F.coalesce("was1", "moved0", opened).alias("was_severity"),
        (F.col("opening.place") == F.col("place")).alias("first"),
    )


def severity_changes(rows: DataFrame) -> DataFrame:
    """Of followed events, those that moved their episode's severity, and from what to what."""
    return rows.where("not severity <=> was_severity").select("episode", "at_us", "seq", "was_severity", "severity")


def episodes(events: DataFrame) -> DataFrame:
    """A row for each episode: one partial aggregate, whatever the size of an episode."""
    e = flagged(events)
    opening = F.min_by(F.struct("estate_severity", "service", "title", "at_us", "vendor"), "place").alias("o")
    # the url that comes first, if any does
    url = F.min_by("incident_url", F.when(F.col("incident_url").isNotNull() & (F.col("incident_url") != ""), F.col("place"))).alias("incident_url")
    found = e.groupBy("episode").agg(*merged(), opening, url, F.count("*").alias("events"), F.max("at_us").alias("last_us"))
    return found.select(
        "episode", F.col("o.vendor").alias("vendor"), F.col("o.service").alias("service"), F.col("o.title").alias("title"), F.col("o.at_us").alias("opened_us"), "last_us", "events", "incident_url",
        F.col("o.estate_severity").alias("estate_severity"), F.coalesce("moved_to", "o.estate_severity").alias("final_severity"), disposition(F.col("paged"), F.col("acked"), F.col("closed")).alias("human_disposition"),
    )


def evaluable(events: DataFrame) -> DataFrame:
    """events with `evaluate`: whether the gate is asked (an unknown type of a vendor that lists its types, and what is no trigger, are recorded only), and unknown_type."""
    unknown = (F.col("vendor") == "pagerduty") & ~is_one_of(PAGER_TYPES)
    return events.withColumns({"unknown_type": unknown, "evaluate": F.col("gate_relevant") & ~unknown})


def told_again(rows: DataFrame, answers: list[str], span_us: int = DAY) -> DataFrame:
    """rows whose duplicates have the answers of their fingerprint's last evaluation before them (null: none was), and from_cache.

    rows have fingerprint, at_us, seq, duplicate (null: no) and the columns answers; a duplicate is not
    evaluated, so its own answers are not read. Rows without fingerprint keep theirs.
    """
    own = ~F.coalesce("duplicate", F.lit(False)) | F.col("fingerprint").isNull()
    asked = rows.where(own).withColumn("from_cache", F.lit(False))
    said = rows.where(own & F.col("fingerprint").isNotNull()).select(F.col("fingerprint").alias("key"), "at_us", "seq", *answers)
    again = asof(rows.where(~own).withColumn("key", F.col("fingerprint")), said, inclusive=False, span_us=span_us)
    kept = [F.col(f"found.{c}").alias(c) if c in answers else F.col(c) for c in rows.columns]
    return asked.unionByName(again.select(*kept, F.lit(True).alias("from_cache")))


def health(deliveries: DataFrame) -> DataFrame:
    """One row: what came in, what was dropped and why, redeliveries, unknown types, and the share of payloads with details.

    deliveries have failure (why the signature was refused, null: it was not), problem (why the payload was), and
    the columns of evaluable events. A key's redeliveries are counted by a partial aggregate first.
    """
    reason = F.when(F.col("failure").startswith("bad_mac"), "bad_signature").when(F.col("failure").isNotNull(), "unauthenticated").when(F.col("problem").isNotNull(), "unparseable")
    keyed = deliveries.withColumn("reason", reason).groupBy("reason", F.when(reason.isNull(), F.col("idempotency_key")).alias("key")).agg(F.count("*").alias("n"), F.min_by(F.struct("has_details", "unknown_type"), "seq").alias("f"))
    taken = F.col("reason").isNull()
    dropped = lambda r: F.coalesce(F.sum(F.when(F.col("reason") == r, F.col("n"))), F.lit(0)).alias(f"dropped_{r}")
    total, full = F.count_if(taken), F.count_if(taken & F.col("f.has_details"))
    return keyed.agg(
        total.alias("ingested"), *[dropped(r) for r in ("bad_signature", "unauthenticated", "unparseable")], F.coalesce(F.sum(F.when(taken, F.col("n") - 1)), F.lit(0)).alias("duplicate_collapsed"),
        F.count_if(taken & F.col("f.unknown_type")).alias("unknown_event_type"), F.round(F.coalesce(F.try_divide(100 * full, total), F.lit(100.0)), 4).alias("payload_completeness_pct"),
    )
