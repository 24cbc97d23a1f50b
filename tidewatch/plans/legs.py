"""Queries over the log, the vendors' webhooks, the decision's other legs, the shadow report and the monitors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import decisionlog, policy, shadow, watch
from tidewatch.plans.catalog import add, over_alerts, over_decisions, read
from tidewatch.sources import vendors

DAY = 86_400_000_000
SEVERITIES = {"P1": "SEV1", "P2": "SEV2", "high": "SEV2", "critical": "SEV1", "warning": "SEV3"}
_SEV = "CASE {0} WHEN 'P1' THEN 'SEV1' WHEN 'P2' THEN 'SEV2' WHEN 'high' THEN 'SEV2' WHEN 'critical' THEN 'SEV1' WHEN 'warning' THEN 'SEV3' END"


def log_of(d: DataFrame) -> DataFrame:
    """Decisions as log rows with JSON bodies, some of them broken."""
    body = F.to_json(F.struct(
        F.when(F.col("alert_id") % 29 > 0, F.when(F.col("alert_id") % 31 == 0, "shrug").otherwise(F.col("action"))).alias("disposition"),
        F.when(F.col("alert_id") % 37 > 0, F.when(F.col("k") % 9 == 0, "error_timeout").otherwise("answered_in_time")).alias("budget_outcome"),
        F.when(F.col("alert_id") % 41 == 0, "dream").when(F.col("alert_id") % 3 == 0, "shadow").alias("mode"),
        F.when(F.col("k") < 40, "p4_low").when(F.col("k") < 90, "p1_critical").otherwise("odd").alias("q1_choice"), (F.col("conf_h") / 100.0).alias("q1_confidence"),
        F.when(F.col("k") % 2 == 0, F.col("reason")).alias("reason"), F.col("team"), F.when(F.col("alert_id") % 43 > 0, F.col("fingerprint")).alias("fingerprint"),
        F.when(F.col("k") % 5 == 0, "Auto-mute").when(F.col("k") % 5 < 4, "ana").alias("attestor"),
    ))
    kind = F.when(F.col("alert_id") % 4 == 0, "decision_requested").when(F.col("alert_id") % 53 == 0, "rumour").when(F.col("alert_id") % 10 == 1, "mute_applied").otherwise("decision_made")
    return d.select(F.col("alert_id").alias("seq"), "alert_id", "at_us", kind.alias("type"), F.when(F.col("alert_id") % 47 == 0, "nobody").otherwise("gate").alias("actor"), F.when(F.col("alert_id") % 59 == 0, "{").otherwise(body).alias("body"))


_LOG = """, l AS (SELECT *, CASE WHEN alert_id % 4 = 0 THEN 'decision_requested' WHEN alert_id % 53 = 0 THEN 'rumour' WHEN alert_id % 10 = 1 THEN 'mute_applied' ELSE 'decision_made' END AS type,
 CASE WHEN alert_id % 29 > 0 THEN CASE WHEN alert_id % 31 = 0 THEN 'shrug' ELSE action END END AS disposition, CASE WHEN alert_id % 37 > 0 THEN CASE WHEN k % 9 = 0 THEN 'error_timeout' ELSE 'answered_in_time' END END AS budget,
 CASE WHEN alert_id % 41 = 0 THEN 'dream' WHEN alert_id % 3 = 0 THEN 'shadow' END AS mode, CASE WHEN alert_id % 43 > 0 THEN fingerprint END AS fp, CASE WHEN k % 5 = 0 THEN 'Auto-mute' WHEN k % 5 < 4 THEN 'ana' END AS attestor FROM d)"""
over_decisions("log_validation", lambda d: decisionlog.validate(log_of(d)).select("seq", "type", "problem"), _LOG + """ SELECT alert_id AS seq, type, CASE WHEN type = 'rumour' THEN 'unknown type' WHEN alert_id % 47 = 0 THEN 'unknown actor' WHEN alert_id % 59 = 0 THEN 'no object'
 WHEN type = 'decision_requested' THEN CASE WHEN fp IS NULL THEN 'missing fingerprint' END
 WHEN type = 'decision_made' THEN CASE WHEN disposition IS NULL THEN 'missing disposition' WHEN budget IS NULL THEN 'missing budget_outcome' WHEN disposition = 'shrug' THEN 'bad disposition' WHEN mode = 'dream' THEN 'bad mode' END
 ELSE CASE WHEN fp IS NULL THEN 'missing fingerprint' WHEN attestor IS NULL THEN 'missing attestor' WHEN attestor = 'Auto-mute' THEN 'attestor is no human' END END AS problem FROM l""")
over_decisions("decisions_projection", lambda d: decisionlog.project(log_of(d).where("alert_id % 59 > 0")), _LOG + """, q AS (SELECT *, CASE WHEN k < 40 THEN 'p4_low' WHEN k < 90 THEN 'p1_critical' ELSE 'cannot_determine' END AS q1 FROM l WHERE type = 'decision_made' AND alert_id % 59 > 0)
 SELECT alert_id AS seq, alert_id, at_us, fp AS fingerprint, team, disposition AS action, coalesce(CASE WHEN k % 2 = 0 THEN reason END, CASE WHEN contains(coalesce(budget, ''), 'error') THEN concat('error:', budget) WHEN disposition = 'passthrough' THEN 'uncertain-default' ELSE 'unknown' END) AS reason,
 q1 AS q1_choice, round(CASE WHEN q1 = 'p1_critical' THEN conf_h / 100.0::DOUBLE ELSE (1 - conf_h / 100.0::DOUBLE) / 5 END, 6) AS p1_reconstructed FROM q""")
over_decisions("explorer_page", lambda d: decisionlog.page(d.select("alert_id", "team", "action", "fingerprint"), 25, before=900, order="alert_id", team="team-3", action="page_now"), ", q AS (SELECT * FROM d WHERE team = 'team-3' AND action = 'page_now' AND alert_id < 900), p AS (SELECT * FROM q ORDER BY alert_id DESC LIMIT 25) SELECT alert_id, team, action, fingerprint, (SELECT min(alert_id) FROM p) > (SELECT min(alert_id) FROM q) AS has_older FROM p")
over_decisions("log_tail", lambda d: decisionlog.tail(d.select("alert_id", "action"), 40, 500, "alert_id"), "SELECT alert_id, action FROM d WHERE alert_id > 500 ORDER BY alert_id LIMIT 40")
over_decisions("log_head", lambda d: d.agg(F.max("alert_id").alias("head"), F.count("*").alias("n")), "SELECT max(alert_id) AS head, count(*) AS n FROM d")
over_decisions("decisions_by_fingerprint", lambda d: d.groupBy("fingerprint").agg(F.max("alert_id").alias("newest"), F.max_by("action", "alert_id").alias("action")), "SELECT fingerprint, max(alert_id) AS newest, arg_max(action, alert_id) AS action FROM d GROUP BY 1")
over_decisions("decision_outcomes", lambda d: d.select("alert_id", "action").join(d.where("became_sev12 is not null").select("alert_id", "became_sev12"), "alert_id", "left"), "SELECT alert_id, action, became_sev12 FROM d")
over_decisions("accuracy_triple", lambda d: d.where("became_sev12 is not null").agg(F.count("*").alias("n"), F.round(F.avg(((F.col("p1_h") >= 10) == (F.col("became_sev12") == 1)).cast("double")), 6).alias("severity"), F.round(F.avg((F.col("action") == F.when(F.col("became_sev12") == 1, "page_now").otherwise("suppress")).cast("double")), 6).alias("disposition")), "SELECT count(*) AS n, round(avg(CASE WHEN (p1_h >= 10) = (became_sev12 = 1) THEN 1.0::DOUBLE ELSE 0 END), 6) AS severity, round(avg(CASE WHEN action = CASE WHEN became_sev12 = 1 THEN 'page_now' ELSE 'suppress' END THEN 1.0::DOUBLE ELSE 0 END), 6) AS disposition FROM d WHERE became_sev12 IS NOT NULL")


def stale_legs(now: int = 0) -> Column:
    return policy.freshness({"fit": F.col("k") % 10 > 0, "thresholds": F.when(F.col("k") % 7 > 0, F.col("alert_id") % 19 > 0), "allowlist": F.col("user_id") % 23 > 0})


def with_legs(d: DataFrame) -> DataFrame:
    return d.withColumns({
        "answered": F.col("alert_id") % 97 > 0, "kind": F.when(F.col("alert_id") % 61 == 0, "change_window").when(F.col("alert_id") % 15 == 0, "duplicate").when(F.col("alert_id") % 15 == 1, "storm").otherwise("new"),
        "prior": F.when(F.col("k") < 50, "suppress").when(F.col("k") < 80, "page_now"), "screened": F.col("alert_id") % 67 == 0, "detectors": F.lit("fake_resolve"),
        "step": F.when(F.col("alert_id") % 71 == 0, 1).when(F.col("alert_id") % 73 == 0, 2).when(F.col("alert_id") % 79 == 0, 3).otherwise(0), "admitted": F.col("user_id") % 2 == 0, "severity_in": F.when(F.col("k") % 3 == 0, F.concat(F.lit(" "), F.initcap("severity_in"))).otherwise(F.col("severity_in")),
        "stale": stale_legs(), "lifecycle": F.when(F.col("user_id") % 12 == 0, "expired").otherwise("ok"), "witnesses": F.col("user_id") % 3, "floor": F.lit(1),
    })


_LEGS = """, g AS (SELECT *, alert_id % 97 > 0 AS answered, CASE WHEN alert_id % 61 = 0 THEN 'change_window' WHEN alert_id % 15 = 0 THEN 'duplicate' WHEN alert_id % 15 = 1 THEN 'storm' ELSE 'new' END AS kind, CASE WHEN k < 50 THEN 'suppress' WHEN k < 80 THEN 'page_now' END AS prior,
 CASE WHEN alert_id % 71 = 0 THEN 1 WHEN alert_id % 73 = 0 THEN 2 WHEN alert_id % 79 = 0 THEN 3 ELSE 0 END AS step,
 concat_ws('|', CASE WHEN k % 10 = 0 THEN 'fit' END, CASE WHEN k % 7 = 0 OR alert_id % 19 = 0 THEN 'thresholds' END, CASE WHEN user_id % 23 = 0 THEN 'allowlist' END) AS stale, user_id % 12 = 0 AS dead, user_id % 3 AS witnesses FROM d)"""
#: Structural bars, in order, then the screen, the ladder's steps, the answer, and for a suppression freshness, lifecycle and corroboration.
over_decisions("composition", lambda d: policy.compose(with_legs(d)).select("alert_id", "path", "final", "why"), _LEGS + """, s AS (SELECT *, CASE WHEN kind = 'change_window' THEN 1 WHEN kind = 'duplicate' AND prior IS NOT NULL THEN 2 WHEN kind = 'storm' THEN 3 WHEN alert_id % 67 = 0 THEN 4 WHEN step > 0 THEN 4 + step WHEN NOT answered THEN 8 WHEN action <> 'suppress' THEN 12 WHEN stale <> '' THEN 9 WHEN dead THEN 10 WHEN witnesses < 1 THEN 11 ELSE 12 END AS way FROM g)
 SELECT alert_id, CASE WHEN way <= 3 THEN 'structural' WHEN way = 4 THEN 'screen' WHEN way <= 7 THEN 'degraded' ELSE 'table' END AS path,
 CASE way WHEN 1 THEN 'page_business_hours' WHEN 2 THEN prior WHEN 3 THEN 'folded' WHEN 4 THEN 'page_now' WHEN 5 THEN CASE severity_in WHEN 'critical' THEN 'page_now' WHEN 'high' THEN 'page_business_hours' ELSE 'passthrough' END WHEN 6 THEN CASE WHEN severity_in = 'critical' THEN 'page_now' ELSE 'folded' END WHEN 7 THEN CASE WHEN user_id % 2 = 0 THEN 'page_now' ELSE 'folded' END WHEN 8 THEN 'passthrough' WHEN 9 THEN 'page_now' WHEN 10 THEN 'passthrough' WHEN 11 THEN 'page_now' ELSE action END AS final,
 CASE way WHEN 1 THEN 'change_window' WHEN 2 THEN 'dedup' WHEN 3 THEN 'storm' WHEN 4 THEN 'firewall_flagged:fake_resolve' WHEN 5 THEN 'failopen_step1' WHEN 6 THEN CASE WHEN severity_in = 'critical' THEN 'failopen_step2' ELSE 'failopen_step2_digest' END WHEN 7 THEN CASE WHEN user_id % 2 = 0 THEN 'failopen_step3' ELSE 'failopen_step3_digest' END WHEN 8 THEN 'error:missing_answer' WHEN 9 THEN concat('freshness:', stale) WHEN 10 THEN 'policy_blocked:expired' WHEN 11 THEN 'uncorroborated' ELSE reason END AS why FROM s""")
over_decisions("freshness_transitions", lambda d: d.groupBy("fingerprint").agg(F.min_by(F.struct((F.size(stale_legs()) == 0).alias("f")), "alert_id").alias("a"), F.max_by(F.struct((F.size(stale_legs()) == 0).alias("f")), "alert_id").alias("b")).where("a.f and not b.f").select("fingerprint"), _LEGS + " SELECT fingerprint FROM g GROUP BY 1 HAVING arg_min(stale, alert_id) = '' AND arg_max(stale, alert_id) <> ''")
over_alerts("security_ban", lambda a: a.select("alert_id", policy.security_ban(F.when(F.col("k") % 6 == 0, "edge/WAF-block").when(F.col("k") % 6 == 1, "cve.scan").when(F.col("k") % 6 == 2, "waffle").otherwise(F.col("check_name")), F.when(F.col("user_id") % 9 == 0, "eu-SecOps").otherwise(F.col("team"))).alias("ban")), " SELECT alert_id, CASE WHEN k % 6 = 0 THEN 'security detection/response platform check' WHEN k % 6 = 1 THEN 'vulnerability-management check' WHEN user_id % 9 = 0 THEN 'security owning team' END AS ban FROM a")
_LABEL = "CASE WHEN k % 11 = 0 THEN 'Fatal' WHEN k % 13 = 0 THEN 'EMERGENCY' WHEN severity_in = 'high' THEN 'notice' ELSE severity_in END"
over_alerts("volume_guard", lambda a: a.select("alert_id", F.expr(_LABEL).alias("label"), F.concat("fingerprint", (F.col("alert_id") % 50).cast("string")).alias("fp")).where(policy.advised(F.col("label"), F.col("fp"))).select("alert_id"), f"SELECT alert_id FROM a WHERE lower({_LABEL}) IN ('critical', 'high', 'p1', 'p2', 'emergency', 'fatal') OR list_reduce(list_prepend(0, list_transform(range(1, 65), lambda i: strpos('0123456789abcdef', sha256(concat(fingerprint, alert_id % 50))[i]) - 1)), lambda x, y: (x * 16 + y) % 100) = 0")
over_alerts("window_texts", lambda a: a.select(F.concat((F.col("k") % 40).cast("string"), F.element_at(F.array(*[F.lit(u) for u in ("s", "m", "h", "d", "w")]), (F.col("k") % 5 + 1).cast("int"))).alias("w")).distinct().select("w", policy.window_seconds(F.col("w")).alias("seconds")), ", t AS (SELECT DISTINCT k % 40 AS n, ['s', 'm', 'h', 'd', 'w'][k % 5 + 1] AS u FROM a) SELECT concat(n, u) AS w, CAST(n * CASE u WHEN 's' THEN 1 WHEN 'm' THEN 60 WHEN 'h' THEN 3600 WHEN 'd' THEN 86400 END AS BIGINT) AS seconds FROM t")
over_alerts("quantised", lambda a: a.select(F.concat(F.lit("0."), (F.col("k") * 7 % 1000).cast("string")).alias("p")).distinct().select("p", policy.hundredths(F.col("p")).alias("h")), ", t AS (SELECT DISTINCT concat('0.', k * 7 % 1000) AS p FROM a) SELECT p, CASE WHEN CAST(p AS DECIMAL(12,10)) * 100 = floor(CAST(p AS DECIMAL(12,10)) * 100) THEN CAST(CAST(p AS DECIMAL(12,10)) * 100 AS INT) END AS h FROM t")
_NOW = 1_706_000_000_000_000
_FIT = {"reference_class": "CASE WHEN k % 17 = 5 THEN 'R(C,W,r=0.05)' ELSE 'R(C,W,r=0.00)' END", "formula": "CASE WHEN k % 19 = 7 THEN 'adr013-v0' ELSE 'adr013-v1' END", "payload": "concat('{\"n\":', alert_id, '}')"}
over_alerts("fit_validity", lambda a: a.select("alert_id", policy.fit_reason(F.struct(F.when(F.col("k") % 23 > 0, F.sha2(F.expr(_FIT["payload"]), 256)).otherwise("").alias("fit_id"), *[F.expr(e).alias(c) for c, e in _FIT.items()], F.when(F.col("k") == 3, 1.96).otherwise(1.6449).alias("z"), (F.col("at_us") + 30 * DAY).alias("valid_until_us"), F.when(F.col("k") % 8 == 0, "m1").otherwise("m2").alias("model"), F.when(F.col("k") % 9 == 0, "SHIFT").otherwise("OK").alias("shift"), F.col("at_us").alias("window_end_us"), (F.col("k") / 20_000.0).alias("upper")), F.lit(_NOW), "m2").alias("reason")), f" SELECT alert_id, CASE WHEN k % 23 = 0 THEN 'binding' WHEN k % 17 = 5 THEN 'class' WHEN k % 19 = 7 THEN 'formula' WHEN k = 3 THEN 'z' WHEN at_us + {30 * DAY} <= {_NOW} THEN 'elapsed' WHEN k % 8 = 0 THEN 'model' WHEN k % 9 = 0 THEN 'shift' WHEN at_us < {_NOW - 7 * DAY} THEN 'window' WHEN k >= 40 THEN 'bar' ELSE 'ok' END AS reason FROM a")
over_alerts("dual_attestation", lambda a: a.select("alert_id", policy.attested(F.array(*[F.struct(F.concat(F.lit("u"), (F.col(c) % 4).cast("string")).alias("by"), F.col("at_us").alias("at_us"), F.when(F.col("k") % 6 == 0, "see #ops").otherwise("run-1").alias("ref"), (F.col("k") % 40).alias("ttl_days")) for c in ("user_id", "k")]), F.lit("u1"), F.lit(_NOW)).alias("ok")), f" SELECT alert_id, user_id % 4 <> k % 4 AND user_id % 4 <> 1 AND k % 4 <> 1 AND k % 6 > 0 AND k % 40 BETWEEN 1 AND 30 AND at_us <= {_NOW} AND {_NOW} < at_us + (k % 40) * {DAY} AS ok FROM a")
over_alerts("corroboration", lambda a: policy.corroborate(a.where("k < 30"), a.where("k >= 30").select("fingerprint", "at_us", F.col("check_name").alias("kind"), (F.col("user_id") % 5).alias("witness"), (F.col("k") % 4 > 0).alias("valid")), 6 * 3_600_000_000), " SELECT x.alert_id, count(DISTINCT CASE WHEN y.alert_id IS NOT NULL THEN concat(y.check_name, '|', y.user_id % 5) END) AS witnesses FROM a x LEFT JOIN a y ON y.k >= 30 AND y.k % 4 > 0 AND x.fingerprint = y.fingerprint AND y.at_us BETWEEN x.at_us - 21600000000 AND x.at_us + 300000000 WHERE x.k < 30 GROUP BY 1")


def policies(a: DataFrame) -> DataFrame:
    return a.select(F.col("fingerprint").alias("policy_id"), F.col("alert_id").alias("version"), F.when(F.col("k") % 3 == 0, "live").when(F.col("k") % 3 == 1, "review_due").otherwise("draft").alias("state"), F.when(F.col("k") % 10 == 0, F.col("at_us")).alias("override_until_us"), (F.col("at_us") + DAY).alias("review_at_us"), (F.col("at_us") + 9 * DAY).alias("grace_until_us"))


_POL = ", p AS (SELECT *, CASE k % 3 WHEN 0 THEN 'live' WHEN 1 THEN 'review_due' ELSE 'draft' END AS state FROM a)"
over_alerts("lifecycle_tick", lambda a: policy.lifecycle_tick(policies(a), _NOW), _POL + f", q AS (SELECT *, CASE WHEN state = 'live' AND k % 10 = 0 AND at_us <= {_NOW} THEN 1 WHEN state = 'live' AND at_us + {DAY} <= {_NOW} THEN 2 WHEN state = 'review_due' AND at_us + {9 * DAY} <= {_NOW} THEN 3 END AS way FROM p) SELECT fingerprint AS policy_id, alert_id AS version, state, CASE WHEN way = 2 THEN 'review_due' WHEN way IS NOT NULL THEN 'expired' ELSE state END AS new_state, CASE way WHEN 1 THEN 'policy_override_reverted' WHEN 2 THEN 'policy_review_due' WHEN 3 THEN 'policy_expired' END AS event FROM q")
over_alerts("effective_versions", lambda a: policy.effective_versions(policies(a)), _POL + " SELECT fingerprint AS policy_id, max(alert_id) AS version FROM p WHERE state <> 'draft' GROUP BY 1")
over_alerts("policies_without_baseline", lambda a: policy.without_baseline(policies(a), policies(a).where("version % 2 = 0").select("policy_id", "version", F.array(F.lit("a"), F.when(F.col("version") % 3 == 0, "a").otherwise("b")).alias("signed_by"))), _POL + ", e AS (SELECT fingerprint AS policy_id, max(alert_id) AS version FROM p WHERE state <> 'draft' GROUP BY 1) SELECT * FROM e WHERE NOT (version % 2 = 0 AND version % 3 > 0)")


def pager_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    data = F.struct(F.concat(F.lit("I"), (F.col("event_id") % 500).cast("string")).alias("id"), F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("title"), F.when(F.col("event_id") % 5 > 0, "high").alias("urgency"), F.struct(F.when(F.col("user_id") % 7 > 0, F.concat(F.lit("svc-"), (F.col("user_id") % 10).cast("string"))).alias("summary")).alias("service"), F.when(F.col("event_id") % 4 == 0, F.struct(F.lit("P1 ").alias("summary"))).alias("priority"))
    hook = F.to_json(F.struct(F.struct(F.when(F.col("event_id") % 13 > 0, (F.col("event_id") % 700).cast("string")).alias("id"), F.when(F.col("event_id") % 2 == 0, "incident.triggered").otherwise("incident.resolved").alias("event_type"), data.alias("data")).alias("event")))
    return e.select(F.col("event_id").alias("seq"), F.lit("sub").alias("subscription"), hook.alias("body"))


@add("pager_lifecycle", f"""WITH t AS (SELECT event_id AS seq, CASE WHEN event_id % 13 > 0 THEN CAST(event_id % 700 AS VARCHAR) END AS id, event_id % 2 = 0 AS gate_relevant, concat('I', event_id % 500) AS incident_id, CASE WHEN event_id % 3 > 0 THEN event_type ELSE concat('I', event_id % 500) END AS title, CASE WHEN user_id % 7 > 0 THEN concat('svc-', user_id % 10) ELSE 'unknown' END AS service, CASE WHEN event_id % 4 = 0 THEN 'P1 ' WHEN event_id % 5 > 0 THEN 'high' END AS raw FROM events)
 SELECT seq, id AS event_id, incident_id, service, title, gate_relevant, {_SEV.format('trim(raw)')} AS estate_severity, concat('pd:sub:', id) AS idempotency_key FROM t WHERE id IS NOT NULL AND seq = (SELECT min(u.seq) FROM t u WHERE u.id = t.id)""")
def pager_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = vendors.from_pager_v3(pager_hooks(spark, sf_dir), SEVERITIES).where("problem is null")
    return vendors.first_of_each(events, "seq").select("seq", "event_id", "incident_id", "service", "title", "gate_relevant", "estate_severity", "idempotency_key")


@add("genie_lifecycle", f"SELECT event_id AS seq, CAST(event_id AS VARCHAR) AS incident_id, CASE event_id % 3 WHEN 0 THEN 'Create' WHEN 1 THEN 'UpdatePriority' ELSE 'Close' END AS event_type, CASE WHEN user_id % 4 > 0 THEN concat('team-', user_id % 7) ELSE 'opsgenie' END AS service, event_id % 3 < 2 AS gate_relevant, {_SEV.format('''concat('P', event_id % 5)''')} AS estate_severity, concat('og:', event_id, ':', CASE event_id % 3 WHEN 0 THEN 'Create' WHEN 1 THEN 'UpdatePriority' ELSE 'Close' END, ':t', user_id) AS idempotency_key FROM events")
def genie_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    alert = F.struct(F.col("event_id").cast("string").alias("alertId"), F.col("event_type").alias("message"), F.concat(F.lit("P"), (F.col("event_id") % 5).cast("string")).alias("priority"), F.when(F.col("user_id") % 4 > 0, F.array(F.struct(F.concat(F.lit("team-"), (F.col("user_id") % 7).cast("string")).alias("name")))).alias("teams"))
    hook = F.to_json(F.struct(F.when(F.col("event_id") % 3 == 1, "UpdatePriority").when(F.col("event_id") % 3 == 2, "Close").alias("action"), F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("actionTimestamp"), alert.alias("alert")))
    return vendors.from_genie(e.select(F.col("event_id").alias("seq"), hook.alias("body")), SEVERITIES).select("seq", "incident_id", "event_type", "service", "gate_relevant", "estate_severity", "idempotency_key")


@add("manager_lifecycle", f"WITH t AS (SELECT event_id, user_id, event_type, unnest([0, 1]) AS i FROM events) SELECT event_id AS seq, CASE WHEN i = 0 THEN concat('fp', event_id) ELSE concat('svc-', user_id % 10, ':', event_type) END AS incident_id, CASE WHEN i = 0 THEN 'resolved' ELSE 'firing' END AS event_type, concat('svc-', user_id % 10) AS service, i = 1 AS gate_relevant, {_SEV.format('''CASE WHEN i = 1 THEN 'warning' END''')} AS estate_severity, concat('am:', CASE WHEN i = 0 THEN concat('fp', event_id, ':resolved:') ELSE concat('svc-', user_id % 10, ':', event_type, ':firing:') END, 's', i) AS idempotency_key FROM t")
def manager_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    service = F.concat(F.lit("svc-"), (F.col("user_id") % 10).cast("string"))
    one = F.struct(F.lit("resolved").alias("status"), F.concat(F.lit("fp"), F.col("event_id").cast("string")).alias("fingerprint"), F.lit("s0").alias("startsAt"), F.create_map(F.lit("service"), service).alias("labels"))
    two = F.struct(F.lit("").alias("status"), F.lit("").alias("fingerprint"), F.lit("s1").alias("startsAt"), F.create_map(F.lit("job"), service, F.lit("alertname"), F.col("event_type"), F.lit("severity"), F.lit("Warning")).alias("labels"))
    hook = F.concat(F.lit('{"status":"firing","alerts":['), F.to_json(one), F.lit(","), F.to_json(two), F.lit("]}"))
    return vendors.from_manager(e.select(F.col("event_id").alias("seq"), hook.alias("body")), SEVERITIES).select("seq", "incident_id", "event_type", "service", "gate_relevant", "estate_severity", "idempotency_key")


def shadow_rows(d: DataFrame) -> DataFrame:
    day = F.concat_ws("|", "fingerprint", F.floor(F.col("at_us") / DAY).cast("string"))
    seen = d.withColumn("episode", day)
    episodes = seen.groupBy("episode").agg(F.max((F.col("became_sev12") == 1).cast("int")).alias("s"), F.min_by("severity_in", "alert_id").alias("severity")).select("episode", "severity", (F.coalesce("s", F.lit(0)) == 1).alias("human_paged"))
    return shadow.evaluated(episodes, seen.select("episode", F.col("action").alias("would"), "at_us", "alert_id", F.col("alert_id").alias("arrival")))


_SHADOW = f", v AS (SELECT concat(fingerprint, '|', at_us // {DAY}) AS episode, coalesce(max(became_sev12), 0) = 1 AS paged, arg_min(severity_in, alert_id) AS severity, arg_max(action, alert_id) AS would FROM d GROUP BY 1)"
over_decisions("shadow_header", lambda d: shadow.header(shadow_rows(d)), _SHADOW + " SELECT count(*) AS episodes, count(*) FILTER (paged) AS human_paged, count(*) FILTER (would <> 'suppress') AS would_page, count(*) FILTER (would = 'suppress') AS would_suppress, round(100.0::DOUBLE * count(*) FILTER (paged = (would <> 'suppress')) / count(*), 4) AS agreement_pct, count(*) FILTER (paged AND would = 'suppress') AS suppress_vs_page, count(*) FILTER (NOT paged AND would = 'page_now') AS page_vs_suppress, count(*) FILTER (paged AND would = 'suppress' AND severity IN ('critical', 'high')) AS severe_misses, count(*) FILTER (paged AND would = 'suppress' AND severity IN ('critical', 'high')) = 0 AS zero_bar FROM v")
over_decisions("shadow_divergences", lambda d: shadow.divergences(shadow_rows(d)).select("episode", "severity", "would", "direction"), _SHADOW + " SELECT episode, severity, would, CASE WHEN paged THEN 'suppress-vs-page' ELSE 'page-vs-suppress' END AS direction FROM v WHERE (paged AND would = 'suppress') OR (NOT paged AND would = 'page_now')")


def baselines(d: DataFrame) -> DataFrame:
    return d.select(F.col("team").alias("policy_id")).distinct().select("policy_id", F.lit(0.1).alias("expected"), F.lit(0.01).alias("sigma"), (F.col("policy_id") == "team-1").alias("review_due"))


over_decisions("band_trips", lambda d: watch.band_trips(d.withColumn("policy_id", F.col("team")), baselines(d), 7 * DAY), f", t AS (SELECT team AS policy_id, at_us // {7 * DAY} AS \"window\", count(*) AS n, count(*) FILTER (action = 'suppress') AS k FROM d GROUP BY 1, 2), u AS (SELECT *, k / n::DOUBLE AS r FROM t) SELECT policy_id, \"window\", n, k, round(r, 6) AS rate, CASE WHEN n < 30 THEN NULL WHEN r > 0.5 THEN 'absolute_guardrail' WHEN policy_id = 'team-1' THEN CASE WHEN abs(r - 0.1) / 0.01 > 2 THEN 'review_due_drift' END WHEN abs(r - 0.1) / 0.01 > 3 THEN 'slo_band' END AS trip FROM u")
over_decisions("outbox_due", lambda d: watch.due(d.where("action = 'page_now'").select("alert_id", F.when(F.col("alert_id") % 5 > 0, "queued").otherwise("delivered").alias("status"), F.col("at_us").alias("next_us"), F.when(F.col("alert_id") % 3 == 0, F.lit(_NOW + 1)).alias("lease_us"), F.when(F.col("severity_in") == "critical", 2).otherwise(1).alias("priority")), _NOW, 50).select("alert_id", "priority", "next_us"), f"SELECT alert_id, CASE WHEN severity_in = 'critical' THEN 2 ELSE 1 END AS priority, at_us AS next_us FROM d WHERE action = 'page_now' AND alert_id % 5 > 0 AND at_us <= {_NOW} AND alert_id % 3 > 0 ORDER BY priority DESC, next_us, alert_id LIMIT 50")
over_alerts("retry_schedule", lambda a: a.select("alert_id", watch.retry_delay(F.col("k") % 12, F.when(F.col("k") % 4 == 0, "rate_limited").otherwise("timeout"), F.when(F.col("k") % 8 == 0, F.lit(100))).alias("delay_s")), ", t AS (SELECT alert_id, k, [5, 15, 45, 120, 300, 900, 1800, 1800][least(greatest(k % 12 - 1, 0), 7) + 1] AS b FROM a) SELECT alert_id, CASE WHEN k % 4 = 0 THEN greatest(b, 60, CASE WHEN k % 8 = 0 THEN 100 ELSE 0 END) ELSE b END AS delay_s FROM t")
over_alerts("expired_mutes", lambda a: watch.expired_mutes(a.select(F.col("alert_id").alias("seq"), "fingerprint", F.when(F.col("k") < 60, "applied").otherwise("expired").alias("type"), (F.col("at_us") + 5 * DAY).alias("until_us"), F.when(F.col("k") >= 60, F.col("alert_id") - 1).alias("applied_seq")), _NOW), f"SELECT alert_id AS seq, fingerprint FROM a WHERE k < 60 AND at_us + {5 * DAY} <= {_NOW} AND alert_id NOT IN (SELECT alert_id - 1 FROM a WHERE k >= 60)")
