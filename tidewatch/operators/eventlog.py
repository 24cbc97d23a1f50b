"""Folds and checks over an append-only log: river status, orphans, chains, mutes."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHAIN = "segment long, alert_id long, body string, prev_hash string, row_hash string"


def river(log: DataFrame, now_us: Column | int, sla_us: int = 60_000_000) -> DataFrame:
    """Status of each alert of a log (alert_id, seq, type, disposition, outbox_id, at_us) by the river rule.

    The latest decision_made counts; it is confirmed by a forward_confirmed of its outbox_id.
    A page without one is PAGED_ANOMALY once it is older than sla_us.
    """
    last = log.groupBy("alert_id").agg(
        F.max("seq").alias("seq"),
        F.max_by(F.struct("disposition", F.when(F.col("outbox_id") != "", F.col("outbox_id")).alias("outbox_id"), "at_us"), F.when(F.col("type") == "decision_made", F.col("seq"))).alias("d"),
        F.count_if(F.col("type") == "decision_requested").alias("n_requested"),
        F.count_if(F.col("type") == "decision_made").alias("n_decisions"),
    )
    confirmed = log.where((F.col("type") == "forward_confirmed") & F.col("outbox_id").isNotNull()).select(F.col("alert_id").alias("a_"), F.col("outbox_id").alias("o_")).distinct()
    rows = last.join(confirmed, (F.col("alert_id") == F.col("a_")) & (F.col("d.outbox_id") == F.col("o_")), "left")
    has, disposition, sure = F.col("n_decisions") > 0, F.col("d.disposition"), F.col("o_").isNotNull()
    paging = has & disposition.isin("page_now", "page_business_hours")
    now = F.lit(now_us) if isinstance(now_us, int) else now_us
    status = (
        F.when(has & (disposition == "suppress"), "suppressed")
        .when(paging & sure, "paged")
        .when(paging & (now - F.col("d.at_us") > sla_us), "PAGED_ANOMALY")
        .when(paging, "decided_unconfirmed")
        .when(has & (disposition == "passthrough") & F.col("d.outbox_id").isNotNull() & ~sure, "passthrough_unconfirmed")
        .when(has & (disposition == "passthrough"), "passthrough_decided")
        .when(has & (disposition == "folded"), "folded_into_aggregate")
        .when(~has & (F.col("n_requested") > 0), "requested")
        .otherwise("unknown")
    )
    return rows.select("alert_id", "seq", F.col("d.outbox_id").alias("outbox_id"), status.alias("status"), "n_requested", "n_decisions")


def orphans(requests: DataFrame, answered: DataFrame, now_us: Column, age_us: int) -> DataFrame:
    """Requests older than age_us without an answer."""
    return requests.where(now_us - F.col("at_us") > age_us).join(answered.select("alert_id"), "alert_id", "left_anti")


def body_of(*columns: str) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def chain(rows: DataFrame) -> DataFrame:
    """Hash chains of rows (segment, alert_id, body), one a segment; a segment is a bounded unit of the log, such as an hour of an estate."""

    def link(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("alert_id", kind="stable").reset_index(drop=True)
        prev, prevs, hashes = "0" * 64, [], []
        for body in part["body"]:
            prevs.append(prev)
            prev = hashlib.sha256(f"{body}|{prev}".encode()).hexdigest()
            hashes.append(prev)
        return part.assign(prev_hash=prevs, row_hash=hashes)

    return rows.select("segment", "alert_id", "body").groupBy("segment").applyInPandas(link, CHAIN)


def verify(chained: DataFrame) -> DataFrame:
    """Per segment: rows, broken links and wrong hashes. Needs no recursion, so it runs in parallel inside the JVM."""
    before = F.coalesce(F.lag("row_hash").over(Window.partitionBy("segment").orderBy("alert_id")), F.lit("0" * 64))
    checked = chained.select("segment", (F.col("prev_hash") != before).alias("broken"), (F.sha2(F.concat_ws("|", "body", "prev_hash"), 256) != F.col("row_hash")).alias("wrong"))
    return checked.groupBy("segment").agg(F.count("*").alias("n"), F.count_if("broken").alias("broken"), F.count_if("wrong").alias("wrong"))


def active_mutes(log: DataFrame, now_us: int) -> DataFrame:
    """log: fingerprint, seq, type (applied, appealed, lifted, expired), until_us. The last transition decides."""
    last = log.groupBy("fingerprint").agg(F.max_by(F.struct("type", "until_us"), "seq").alias("last"))
    return last.where((F.col("last.type") == "applied") & (F.col("last.until_us") > now_us)).select("fingerprint", F.col("last.until_us").alias("until_us"))


def allowlist_edit(base: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    """(base or add) without remove, distinct."""
    return base.union(add).distinct().join(remove, base.columns[0], "left_anti")


def retention_plan(rows: DataFrame, now_us: int, hot_days: int = 10, warm_days: int = 20) -> DataFrame:
    """Tier of each day's segment with its rows and size."""
    day = F.floor(F.col("at_us") / 86_400_000_000)
    by = rows.groupBy(day.alias("day")).agg(F.count("*").alias("n"), F.sum(F.octet_length(body_of("alert_id", "fingerprint", "check_name"))).alias("bytes"))
    age = F.lit(now_us // 86_400_000_000) - F.col("day")
    return by.withColumn("tier", F.when(age <= hot_days, "hot").when(age <= warm_days, "warm").otherwise("cold"))
