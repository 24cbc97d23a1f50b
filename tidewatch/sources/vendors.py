"""Lifecycle webhooks of three vendors as one event table, with the key under which a redelivery is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ["vendor", "event_type", "event_id", "incident_id", "occurred_at", "service", "title", "severity_raw", "estate_severity", "gate_relevant", "idempotency_key", "incident_url", "region", "has_details", "problem"]
#: Check name under which a vendor's incidents are alerts, and prefix of its episodes.
CHECKS = {"pagerduty": "pagerduty.incident", "opsgenie": "opsgenie.alert", "alertmanager": "alertmanager.alert"}
EPISODES = {"pagerduty": "pd:inc", "opsgenie": "og:alert", "alertmanager": "am:fp"}
PAGER = "event struct<id:string, event_type:string, occurred_at:string, data:struct<id:string, title:string, summary:string, urgency:string, html_url:string, service:struct<summary:string>, priority:struct<summary:string>>>"
GENIE_ALERT = {"alertId": "string", "action": "string", "message": "string", "priority": "string", "createdAt": "string", "description": "string", "details": "map<string,string>", "teams": "array<struct<name:string>>"}
GENIE = ", ".join(f"{k} {t}" for k, t in GENIE_ALERT.items()) + ", actionTimestamp string, alert struct<" + ", ".join(f"{k}:{t}" for k, t in GENIE_ALERT.items()) + ">"
MANAGER = "status string, alerts array<struct<status:string, fingerprint:string, startsAt:string, labels:map<string,string>, annotations:map<string,string>>>"


def severity(raw: Column, table: dict[str, str]) -> Column:
    """By the text as it is, else in lower case; null if neither is in the table."""
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.trim(raw)), F.try_element_at(known, F.lower(F.trim(raw))))


def filled(c: Column) -> Column:
    return F.when(c != "", c)


def parsed(raw: DataFrame, e: Column) -> DataFrame:
    """raw with e, worked out once a row: a filter on what was parsed goes no further down than an explode, else it would parse again for each field it reads."""
    return raw.select(*[F.col(f"`{c}`") for c in raw.columns], F.explode(F.array(e)).alias("e"))


def from_pager_v3(raw: DataFrame, table: dict[str, str], column: str = "body", subscription: str = "subscription") -> DataFrame:
    rows = parsed(raw, F.from_json(column, PAGER)["event"])
    e, p = F.col("e"), F.col("e.data")
    said = F.coalesce(filled(p["priority"]["summary"]), filled(p["urgency"]))
    return rows.select(
        *raw.columns, F.lit("pagerduty").alias("vendor"), e["event_type"].alias("event_type"), e["id"].alias("event_id"), F.coalesce(filled(p["id"]), e["id"]).alias("incident_id"), e["occurred_at"].alias("occurred_at"),
        F.coalesce(filled(p["service"]["summary"]), F.lit("unknown")).alias("service"), F.coalesce(filled(p["title"]), filled(p["summary"]), filled(p["id"]), e["id"]).alias("title"), said.alias("severity_raw"), severity(said, table).alias("estate_severity"),
        F.coalesce(e["event_type"].isin("incident.triggered", "incident.priority_updated"), F.lit(False)).alias("gate_relevant"), F.concat(F.lit("pd:"), F.coalesce(F.col(subscription), F.lit("")), F.lit(":"), e["id"]).alias("idempotency_key"),
        p["html_url"].alias("incident_url"), F.lit("").alias("region"), F.lit(True).alias("has_details"), F.when(filled(e["event_type"]).isNull() | filled(e["id"]).isNull(), "needs event_type and id").alias("problem"),
    )


def from_genie(raw: DataFrame, table: dict[str, str], column: str = "body") -> DataFrame:
    """A payload without an `alert` object is the alert itself."""
    rows = parsed(raw, F.from_json(column, GENIE))
    e = F.col("e")
    a = F.when(e["alert"].isNotNull(), e["alert"]).otherwise(F.struct(*[e[k].alias(k) for k in GENIE_ALERT]))
    key, action = F.coalesce(filled(a["alertId"]), e["alertId"]), F.coalesce(filled(e["action"]), filled(a["action"]), F.lit("Create"))
    at = F.coalesce(filled(e["actionTimestamp"]), filled(a["createdAt"]))
    return rows.select(
        *raw.columns, F.lit("opsgenie").alias("vendor"), action.alias("event_type"), key.alias("event_id"), key.alias("incident_id"), at.alias("occurred_at"),
        F.coalesce(filled(F.get(a["teams"], F.lit(0))["name"]), F.lit("opsgenie")).alias("service"), F.coalesce(filled(a["message"]), key).alias("title"), filled(a["priority"]).alias("severity_raw"), severity(filled(a["priority"]), table).alias("estate_severity"),
        ((F.lower(action) == "create") | F.lower(action).contains("priority")).alias("gate_relevant"), F.concat(F.lit("og:"), key, F.lit(":"), action, F.lit(":"), F.coalesce(at, F.lit(""))).alias("idempotency_key"),
        F.lit(None).cast("string").alias("incident_url"), F.coalesce(a["details"]["region"], F.lit("")).alias("region"), (filled(a["description"]).isNotNull() | F.coalesce(F.size(a["details"]) > 0, F.lit(False))).alias("has_details"),
        F.when(filled(key).isNull(), "needs alertId").alias("problem"),
    )


def from_manager(raw: DataFrame, table: dict[str, str], column: str = "body") -> DataFrame:
    """A row for each alert of a batch."""
    rows = raw.withColumn("e", F.from_json(column, MANAGER)).select(*raw.columns, F.col("e.status").alias("whole"), F.explode("e.alerts").alias("a"))
    a, labels = F.col("a"), F.col("a.labels")
    service, check = F.coalesce(filled(labels["service"]), filled(labels["job"]), F.lit("alertmanager")), F.coalesce(filled(labels["alertname"]), F.lit("alert"))
    status, start, fp = F.coalesce(filled(a["status"]), F.col("whole"), F.lit("")), F.coalesce(a["startsAt"], F.lit("")), filled(a["fingerprint"])
    incident = F.coalesce(fp, F.concat_ws(":", service, check))
    return rows.select(
        *raw.columns, F.lit("alertmanager").alias("vendor"), status.alias("event_type"), F.coalesce(fp, F.concat_ws(":", service, check, start)).alias("event_id"), incident.alias("incident_id"), start.alias("occurred_at"),
        service.alias("service"), F.coalesce(filled(a["annotations"]["summary"]), check).alias("title"), filled(labels["severity"]).alias("severity_raw"), severity(filled(labels["severity"]), table).alias("estate_severity"),
        (status == "firing").alias("gate_relevant"), F.concat(F.lit("am:"), incident, F.lit(":"), status, F.lit(":"), start).alias("idempotency_key"),
        F.lit(None).cast("string").alias("incident_url"), F.coalesce(labels["region"], F.lit("")).alias("region"), F.coalesce(F.size(a["annotations"]) > 0, F.lit(False)).alias("has_details"), F.lit(None).cast("string").alias("problem"),
    )


def first_of_each(events: DataFrame, order: str) -> DataFrame:
    """Vendors deliver at least once: the first row of each idempotency key. Rows without order come last. Each task first keeps one row of a key, and only columns that are read later are shuffled."""
    nth = F.row_number().over(Window.partitionBy("idempotency_key").orderBy(F.col(order).asc_nulls_last()))
    return events.withColumn("__nth", nth).where("__nth = 1").select("idempotency_key", *[F.col(f"`{c}`") for c in events.columns if c != "idempotency_key"])


def by_vendor(table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.col("vendor"))


def alerts_of(events: DataFrame) -> DataFrame:
    """Vendor events as alerts, other columns kept. Vendors tell no env and no cluster: both are empty in the fingerprint, which is a namespace of its own."""
    check, said = by_vendor(CHECKS), F.coalesce("severity_raw", F.lit("unknown"))
    labels = F.create_map(F.lit("region"), F.col("region"), F.lit("estate_severity"), F.coalesce("estate_severity", F.lit("")), F.lit("vendor_event_type"), F.col("event_type"))
    return events.withColumns({
        "alert_id": F.concat("vendor", F.lit(":"), "incident_id"), "check_name": check, "severity_in": said, "source": F.col("vendor"), "labels": labels,
        "fingerprint": F.substring(F.sha2(F.concat_ws("|", "service", check, said, "region", F.lit(""), F.lit("")), 256), 1, 16),
    })
