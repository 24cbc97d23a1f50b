"""Queries over vendors' webhooks as a tap sees them; SQL runs over an episode's rows one after the other, where the operator works by buckets of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import shadow, tap, watch
from tidewatch.operators.tables import stored
from tidewatch.plans.catalog import ALERTS, add, over_decisions, read, wilson_sql
from tidewatch.plans.legs import SEVERITIES
from tidewatch.sources import alerts as src
from tidewatch.sources import vendors

HOUR = 3_600_000_000

#: An alert as a webhook of one of three vendors: what each field holds, as SQL that both engines read; `div` is the whole quotient.
_FIELDS = {
    "vendor": "CASE WHEN user_id % 10 < 5 THEN 'pagerduty' WHEN user_id % 10 < 8 THEN 'opsgenie' ELSE 'alertmanager' END",
    "incident": "concat('I', user_id % 40, '-', at_us div 604800000000)",
    "pd_type": "CASE alert_id % 7 WHEN 0 THEN 'incident.triggered' WHEN 1 THEN 'incident.acknowledged' WHEN 2 THEN 'incident.resolved' WHEN 3 THEN 'incident.escalated' WHEN 4 THEN 'incident.priority_updated' WHEN 5 THEN 'pagey.ping' ELSE 'incident.priority_updated' END",
    "og_type": "CASE alert_id % 5 WHEN 0 THEN 'Create' WHEN 1 THEN 'acknowledge' WHEN 2 THEN 'Close' WHEN 3 THEN 'UpdatePriority' ELSE 'AddNote' END",
    "am_type": "CASE WHEN alert_id % 3 = 0 THEN 'resolved' ELSE 'firing' END",
    "level": "CASE k % 6 WHEN 0 THEN 'P1' WHEN 1 THEN 'P2' WHEN 2 THEN ' High ' WHEN 3 THEN 'warning' WHEN 4 THEN 'odd' ELSE '' END",
    "at_text": "concat('t', at_us)",
    "delivery": "CASE WHEN alert_id % 23 = 0 THEN alert_id - 1 ELSE alert_id END",
}


def hooks(a: DataFrame) -> DataFrame:
    """Alerts as webhooks, some redelivered, some without an id, some refused; one column more for each field of theirs."""
    text = lambda c: F.col(c).cast("string")
    f = a.select("alert_id", "at_us", "service", "check_name", "region", "k", "user_id", *[F.expr(e).alias(n) for n, e in _FIELDS.items()])
    url = F.when(F.col("alert_id") % 9 == 0, F.concat(F.lit("https://pd/"), "incident"))
    data = F.struct(F.col("incident").alias("id"), F.col("check_name").alias("title"), F.lit("high").alias("urgency"), url.alias("html_url"), F.struct(F.col("service").alias("summary")).alias("service"), F.struct(F.col("level").alias("summary")).alias("priority"))
    pd = F.to_json(F.struct(F.struct(F.when(F.col("alert_id") % 31 > 0, text("delivery")).alias("id"), F.col("pd_type").alias("event_type"), F.col("at_text").alias("occurred_at"), data.alias("data")).alias("event")))
    alert = [F.col("incident").alias("alertId"), F.col("og_type").alias("action"), F.col("check_name").alias("message"), F.col("level").alias("priority"), F.col("at_text").alias("createdAt"), F.when(F.col("k") % 4 == 0, F.create_map(F.lit("region"), F.col("region"))).alias("details"), F.array(F.struct(F.col("service").alias("name"))).alias("teams")]
    og = F.when(F.col("alert_id") % 2 == 0, F.to_json(F.struct(F.struct(*alert).alias("alert")))).otherwise(F.to_json(F.struct(*alert)))
    labels = F.create_map(F.lit("service"), F.col("service"), F.lit("alertname"), F.col("check_name"), F.lit("severity"), F.col("level"), F.lit("region"), F.col("region"))
    am = F.to_json(F.struct(F.array(F.struct(F.col("am_type").alias("status"), F.col("incident").alias("fingerprint"), F.col("at_text").alias("startsAt"), labels.alias("labels"), F.when(F.col("k") % 3 == 0, F.create_map(F.lit("summary"), F.lit("sum"))).alias("annotations"))).alias("alerts")))
    refused = F.when(F.col("alert_id") % 37 == 0, "bad_mac").when(F.col("alert_id") % 41 == 0, "missing_signature")
    return f.select(F.col("alert_id").alias("seq"), "at_us", F.lit("s").alias("subscription"), F.col("vendor").alias("of"), refused.alias("failure"), F.when(F.col("of") == "pagerduty", pd).when(F.col("of") == "opsgenie", og).otherwise(am).alias("body"))


def received(a: DataFrame) -> DataFrame:
    """Vendor events of all webhooks, refused ones too."""
    rows = hooks(a)
    of = lambda v: rows.where(F.col("of") == v)
    return vendors.from_pager_v3(of("pagerduty"), SEVERITIES).unionByName(vendors.from_genie(of("opsgenie"), SEVERITIES)).unionByName(vendors.from_manager(of("alertmanager"), SEVERITIES))


def taken(a: DataFrame) -> DataFrame:
    """Events that were let in, each once, with their episode."""
    events = received(a).where("failure is null and problem is null")
    return vendors.first_of_each(events, "seq").withColumn("episode", tap.episode_of())


def followed(a: DataFrame, span_us: int) -> DataFrame:
    """Following reads events twice, so payloads are parsed once and their events written."""
    return tap.followed(stored(taken(a), "tap"), span_us)


def add_query(name: str, f, sql: str) -> None:
    add(name, f"{ALERTS}{_SQL} {sql}")(lambda s, d: f(src.alerts(read(s, d, "events"))))


_SQL = ", f AS (SELECT *, " + ", ".join(f"{e.replace(' div ', ' // ')} AS {n}" for n, e in _FIELDS.items()) + f""" FROM a),
e AS (SELECT alert_id AS seq, at_us, vendor, service, CASE WHEN vendor = 'alertmanager' AND k % 3 = 0 THEN 'sum' ELSE check_name END AS title, k, CASE WHEN alert_id % 37 = 0 THEN 'bad_mac' WHEN alert_id % 41 = 0 THEN 'missing_signature' END AS failure, CASE WHEN vendor = 'pagerduty' AND alert_id % 31 = 0 THEN 'no id' END AS problem, incident AS incident_id,
 CASE vendor WHEN 'pagerduty' THEN pd_type WHEN 'opsgenie' THEN og_type ELSE am_type END AS event_type, CASE vendor WHEN 'pagerduty' THEN concat('pd:s:', delivery) WHEN 'opsgenie' THEN concat('og:', incident, ':', og_type, ':', at_text) ELSE concat('am:', incident, ':', am_type, ':', at_text) END AS idempotency_key,
 CASE WHEN level <> '' THEN level WHEN vendor = 'pagerduty' THEN 'high' END AS raw, CASE vendor WHEN 'pagerduty' THEN '' WHEN 'opsgenie' THEN CASE WHEN k % 4 = 0 THEN region ELSE '' END ELSE region END AS region,
 CASE vendor WHEN 'pagerduty' THEN true WHEN 'opsgenie' THEN k % 4 = 0 ELSE k % 3 = 0 END AS has_details, CASE WHEN vendor = 'pagerduty' AND alert_id % 9 = 0 THEN concat('https://pd/', incident) END AS url FROM f),
t AS (SELECT *, CASE trim(raw) WHEN 'P1' THEN 'SEV1' WHEN 'P2' THEN 'SEV2' WHEN 'High' THEN 'SEV2' WHEN 'high' THEN 'SEV2' WHEN 'warning' THEN 'SEV3' END AS sev, concat(CASE vendor WHEN 'pagerduty' THEN 'pd:inc/' WHEN 'opsgenie' THEN 'og:alert/' ELSE 'am:fp/' END, incident_id) AS episode,
 event_type IN ('incident.triggered', 'incident.acknowledged', 'incident.escalated', 'Create', 'acknowledge', 'firing') AS pg, event_type IN ('incident.acknowledged', 'incident.resolved', 'acknowledge', 'Close', 'resolved') AS dn, event_type IN ('incident.priority_updated', 'UpdatePriority') AS mv,
 event_type IN ('incident.triggered', 'incident.priority_updated', 'Create', 'UpdatePriority', 'firing') AS gate, event_type = 'pagey.ping' AS odd FROM e WHERE failure IS NULL AND problem IS NULL QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY seq) = 1),
s AS (SELECT *, CASE WHEN bool_or(pg) OVER w THEN 'paged' WHEN bool_or(dn) OVER w THEN 'unpaged' ELSE 'unknown' END AS human_disposition, coalesce(last_value(CASE WHEN mv THEN sev END IGNORE NULLS) OVER w, first_value(sev) OVER w) AS severity, row_number() OVER w = 1 AS first
 FROM t WINDOW w AS (PARTITION BY episode ORDER BY at_us, seq ROWS UNBOUNDED PRECEDING)),
h AS (SELECT *, CASE WHEN first THEN severity ELSE lag(severity) OVER (PARTITION BY episode ORDER BY at_us, seq) END AS was_severity FROM s)"""

add_query("vendor_alerts", lambda a: vendors.alerts_of(taken(a)).select("seq", "alert_id", "fingerprint", "service", "check_name", "severity_in", "title", "source", F.to_json("labels").alias("labels")), """SELECT seq, concat(vendor, ':', incident_id) AS alert_id, substr(sha256(concat(service, '|', vendor, CASE vendor WHEN 'pagerduty' THEN '.incident' ELSE '.alert' END, '|', coalesce(raw, 'unknown'), '|', region, '||')), 1, 16) AS fingerprint, service, concat(vendor, CASE vendor WHEN 'pagerduty' THEN '.incident' ELSE '.alert' END) AS check_name, coalesce(raw, 'unknown') AS severity_in, title, vendor AS source,
 concat('{"region":"', region, '","estate_severity":"', coalesce(sev, ''), '","vendor_event_type":"', event_type, '"}') AS labels FROM t""")
add_query("tap_observations", lambda a: tap.evaluable(followed(a, 6 * HOUR)).select("episode", "seq", "event_type", "human_disposition", "severity", "was_severity", "first", "evaluate", "unknown_type"), "SELECT episode, seq, event_type, human_disposition, severity, was_severity, first, gate AS evaluate, odd AS unknown_type FROM h")
add_query("tap_severity_changes", lambda a: tap.severity_changes(followed(a, 24 * HOUR)), "SELECT episode, at_us, seq, was_severity, severity FROM h WHERE was_severity IS DISTINCT FROM severity")
add_query("tap_episodes", lambda a: tap.episodes(taken(a)), """SELECT episode, any_value(vendor) AS vendor, arg_min(service, (at_us, seq)) AS service, arg_min(title, (at_us, seq)) AS title, min(at_us) AS opened_us, max(at_us) AS last_us, count(*) AS events, arg_min(url, (at_us, seq)) FILTER (url IS NOT NULL) AS incident_url,
 max(severity) FILTER (first) AS estate_severity, max(severity) FILTER (last) AS final_severity, max(human_disposition) FILTER (last) AS human_disposition FROM (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY at_us DESC, seq DESC) = 1 AS last FROM h) GROUP BY episode""")
add_query("tap_health", lambda a: tap.health(tap.evaluable(received(a))), """SELECT (SELECT count(*) FROM t) AS ingested, count(*) FILTER (failure = 'bad_mac') AS dropped_bad_signature, count(*) FILTER (failure = 'missing_signature') AS dropped_unauthenticated, count(*) FILTER (failure IS NULL AND problem IS NOT NULL) AS dropped_unparseable,
 count(*) FILTER (failure IS NULL AND problem IS NULL) - (SELECT count(*) FROM t) AS duplicate_collapsed, (SELECT count(*) FROM t WHERE odd) AS unknown_event_type, (SELECT round(100.0::DOUBLE * count(*) FILTER (has_details) / count(*), 4) FROM t) AS payload_completeness_pct FROM e""")


def asked(d: DataFrame) -> DataFrame:
    return d.select("alert_id", "fingerprint", "at_us", F.col("alert_id").alias("seq"), (F.col("alert_id") % 3 > 0).alias("duplicate"), "action", "conf_h")


over_decisions("verdicts_told_again", lambda d: tap.told_again(asked(d), ["action", "conf_h"]).select("alert_id", "action", "conf_h", "from_cache"), """, y AS (SELECT alert_id, alert_id % 3 > 0 AS dup, fingerprint, at_us, max(CASE WHEN alert_id % 3 = 0 THEN {'at': at_us, 'seq': alert_id, 'action': action, 'conf_h': conf_h} END) OVER (PARTITION BY fingerprint ORDER BY at_us, alert_id ROWS UNBOUNDED PRECEDING) AS last FROM d)
 SELECT alert_id, last.action AS action, last.conf_h AS conf_h, dup AS from_cache FROM y""")


DAY = 24 * HOUR
_SIDE = {
    "human_disposition": "CASE WHEN severe = 1 THEN 'paged' WHEN days % 3 = 0 THEN 'unknown' ELSE 'unpaged' END",
    "latency_ms": "alert_id % 977 + k / 64.0",
}


def week(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Episodes are a fingerprint's days; people were paged where one became grave. One in eight has no evaluated observation."""
    seen = d.withColumn("days", F.floor(F.col("at_us") / DAY)).withColumn("episode", F.concat_ws("|", "fingerprint", F.col("days").cast("string")))
    found = seen.groupBy("episode", "days").agg(F.coalesce(F.max("became_sev12"), F.lit(0)).alias("severe"), F.min_by("severity_in", "alert_id").alias("severity"))
    looked = seen.where("days % 8 > 0").select("episode", F.col("action").alias("would"), "at_us", "alert_id", F.col("alert_id").alias("arrival"), F.expr(f"cast({_SIDE['latency_ms']} as double)").alias("latency_ms"), "conf_h")
    return found.select("episode", "severity", F.expr(_SIDE["human_disposition"]).alias("human_disposition")), looked


def judged(d: DataFrame) -> DataFrame:
    found, looked = week(d)
    return shadow.evaluated(found.withColumn("human_paged", F.col("human_disposition") == "paged"), looked.drop("latency_ms", "conf_h"))


_WEEK = f""", x AS (SELECT *, at_us // {DAY} AS days, concat(fingerprint, '|', at_us // {DAY}) AS episode, CAST({_SIDE['latency_ms']} AS DOUBLE) AS latency_ms FROM d), g AS (SELECT episode, any_value(days) AS days, coalesce(max(became_sev12), 0) AS severe, arg_min(severity_in, alert_id) AS severity FROM x GROUP BY 1),
 p AS (SELECT *, {_SIDE['human_disposition']} AS people FROM g), z AS (SELECT p.*, people = 'paged' AS paged, x.action AS would, x.latency_ms, x.conf_h, x.at_us, x.alert_id FROM p JOIN x USING (episode) WHERE p.days % 8 > 0 QUALIFY row_number() OVER (PARTITION BY episode ORDER BY x.alert_id DESC) = 1),
 b AS (SELECT low_h, high_h, count(*) AS n, count(*) FILTER (paged) AS k FROM z JOIN (VALUES (95, 100), (90, 94), (85, 89), (70, 84), (50, 69)) t(low_h, high_h) ON conf_h BETWEEN low_h AND high_h GROUP BY 1, 2), c AS (SELECT *, n < 30 AS thin, round(abs((low_h + high_h) / 2.0::DOUBLE - 100.0::DOUBLE * k / n), 1) AS off FROM b)"""
over_decisions("shadow_report", lambda d: shadow.report(*week(d)), _WEEK + """ SELECT (SELECT count(*) FROM p) AS alerts_observed, count(*) AS episodes, count(*) FILTER (paged) AS human_paged, count(*) FILTER (people = 'unpaged') AS human_unpaged_resolved, count(*) FILTER (would <> 'suppress') AS would_page, count(*) FILTER (would = 'suppress') AS would_suppress,
 round(100.0::DOUBLE * count(*) FILTER (paged = (would <> 'suppress')) / count(*), 4) AS agreement_pct, round(100.0::DOUBLE * count(*) FILTER (would = 'suppress') / count(*), 1) AS noise_reduction_pct, count(*) FILTER (paged AND would = 'suppress') AS suppress_vs_page, count(*) FILTER (NOT paged AND would = 'page_now') AS page_vs_suppress,
 count(*) FILTER (paged AND would = 'suppress' AND severity IN ('critical', 'high')) AS severe_misses, count(*) FILTER (paged AND would = 'suppress' AND severity IN ('critical', 'high')) = 0 AS zero_bar, (SELECT round(latency_ms, 1) FROM z ORDER BY latency_ms LIMIT 1 OFFSET (SELECT CAST(ceil(0.99 * count(*)) AS BIGINT) - 1 FROM z)) AS p99_latency_ms, (SELECT bool_or(NOT thin AND off > 5) FROM c) AS calibration_hold FROM z""")
over_decisions("shadow_calibration", lambda d: shadow.calibration(judged_with(d)), _WEEK + f" SELECT low_h, high_h, n, k, thin, CASE WHEN NOT thin THEN off END AS off_points, round({wilson_sql('k', 'n', 1.96, '-')}, 3) AS low, round({wilson_sql('k', 'n', 1.96, '+')}, 3) AS high, NOT thin AND off > 5 AS hold FROM c")
over_decisions("divergence_ids", lambda d: shadow.numbered(judged(d)).select("id", "episode", "would", "direction"), _WEEK + " SELECT printf('D-%03d', row_number() OVER (ORDER BY at_us, alert_id)) AS id, episode, would, CASE WHEN paged THEN 'suppress-vs-page' ELSE 'page-vs-suppress' END AS direction FROM z WHERE (paged AND would = 'suppress') OR (NOT paged AND would = 'page_now')")


def judged_with(d: DataFrame) -> DataFrame:
    found, looked = week(d)
    last = looked.groupBy("episode").agg(F.max_by("conf_h", "arrival").alias("conf_h"))
    return found.withColumn("human_paged", F.col("human_disposition") == "paged").join(last, "episode")


def signed(d: DataFrame) -> DataFrame:
    """Baselines of teams, one of them signed by one person twice."""
    team = F.col("policy_id")
    return d.select(F.col("team").alias("policy_id")).distinct().select("policy_id", F.when(team < "team-4", 2 * DAY).otherwise(4 * DAY).alias("window_us"), F.when(team < "team-2", 0.3).otherwise(0.1).alias("expected"), F.when(team == "team-6", 0.0).otherwise(0.02).alias("sigma"), F.array(F.lit("ana"), F.when(team == "team-3", "ana").otherwise("bo")).alias("signed_by"), (team == "team-1").alias("review_due"), F.when(team == "team-2", 0.15).alias("most"))


over_decisions("suppression_trips", lambda d: watch.trips(d.select(F.col("team").alias("policy_id"), F.col("alert_id").alias("seq"), "at_us", "action"), signed(d), [2 * DAY, 4 * DAY]).drop("at_us"), f""", r2 AS (SELECT team AS policy_id, alert_id AS seq, CASE WHEN team < 'team-4' THEN count(*) OVER a ELSE count(*) OVER b END AS n, CASE WHEN team < 'team-4' THEN count(*) FILTER (action = 'suppress') OVER a ELSE count(*) FILTER (action = 'suppress') OVER b END AS k
 FROM d WHERE team <> 'team-3' WINDOW a AS (PARTITION BY team ORDER BY at_us RANGE BETWEEN {2 * DAY} PRECEDING AND CURRENT ROW), b AS (PARTITION BY team ORDER BY at_us RANGE BETWEEN {4 * DAY} PRECEDING AND CURRENT ROW))
 SELECT policy_id, seq, n, k, CASE WHEN n < 30 THEN NULL WHEN k / n::DOUBLE > CASE policy_id WHEN 'team-2' THEN 0.15::DOUBLE ELSE 0.5 END THEN 'absolute_guardrail' WHEN abs(k / n::DOUBLE - CASE WHEN policy_id < 'team-2' THEN 0.3::DOUBLE ELSE 0.1 END) / CASE policy_id WHEN 'team-6' THEN 1e-9 ELSE 0.02::DOUBLE END > CASE policy_id WHEN 'team-1' THEN 2 ELSE 3 END THEN CASE policy_id WHEN 'team-1' THEN 'review_due_drift' ELSE 'slo_band' END END AS trip FROM r2""")
