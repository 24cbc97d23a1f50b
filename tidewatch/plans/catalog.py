"""The engine's own queries over the driver's tables, each beside an independent SQL form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import kernel, text
from tidewatch.operators import analytics, correlator, eventlog, windows
from tidewatch.sources import alerts as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Alerts and decisions of the events table, as common table expressions.
ALERTS = """WITH base AS (SELECT event_id AS alert_id, epoch_us(ts) AS at_us, concat('e', user_id % 4) AS estate, concat('svc-', user_id % 10) AS service,
 concat('team-', user_id % 7) AS team, event_type AS check_name,
 CASE WHEN value >= 120 THEN 'critical' WHEN value >= 60 THEN 'high' WHEN value >= 20 THEN 'warning' ELSE 'info' END AS severity_in,
 concat('r', user_id % 3) AS region, concat('c', user_id % 2) AS cluster, CASE WHEN user_id % 5 = 0 THEN 'staging' ELSE 'prod' END AS env, value AS metric_value,
 CAST(CASE WHEN user_id % 10 < 4 THEN CAST(json_extract_string(props, '$.k') AS INT) % 40 ELSE CAST(json_extract_string(props, '$.k') AS INT) END AS BIGINT) AS k, user_id FROM events),
a AS (SELECT *, substr(sha256(concat_ws('|', service, check_name, severity_in, region, env, cluster)), 1, 16) AS fingerprint FROM base)"""
DECISIONS = (
    ALERTS
    + """, r AS (SELECT *, CASE WHEN k<40 THEN 0 WHEN k<70 THEN 1 WHEN k<90 THEN 10 ELSE 60 END AS p1_h, CASE WHEN k<40 THEN 1 WHEN k<70 THEN 8 WHEN k<90 THEN 30 ELSE 30 END AS p2_h,
 CASE WHEN k<40 THEN 4 WHEN k<70 THEN 71 WHEN k<90 THEN 40 ELSE 5 END AS p3_h, CASE WHEN k<40 THEN 5 WHEN k<70 THEN 10 WHEN k<90 THEN 10 ELSE 3 END AS p4_h,
 CASE WHEN k<40 THEN 90 WHEN k<70 THEN 10 WHEN k<90 THEN 10 ELSE 2 END AS noise_h, CAST(40 + (alert_id * 37 + user_id * 11) % 60 AS INT) AS conf_h,
 CASE WHEN alert_id % 7 = 0 THEN NULL WHEN k >= 70 AND alert_id % 3 <> 0 THEN 1 WHEN k >= 40 AND alert_id % 50 = 0 THEN 1 ELSE 0 END AS became_sev12,
 CASE WHEN alert_id % 101 = 0 THEN 'cannot_determine' ELSE 'choice' END AS q3_choice FROM a),
fs AS (SELECT fingerprint, count(*) AS n, CAST(coalesce(sum(became_sev12), 0) AS BIGINT) AS sev12, CAST(sum(noise_h) AS BIGINT) AS noise_sum FROM r GROUP BY 1),
al AS (SELECT * FROM fs WHERE n >= 5 AND sev12 = 0 AND noise_sum >= 60 * n),
w AS (SELECT r.*, r.fingerprint IN (SELECT fingerprint FROM al) AS allowed FROM r),
d0 AS (SELECT *, CASE WHEN q3_choice = 'cannot_determine' THEN 'passthrough' WHEN p1_h = 0 AND conf_h >= 90 AND allowed THEN 'suppress' WHEN p1_h + p2_h > 30 OR conf_h < 50 THEN 'page_now'
 WHEN p3_h + p4_h >= 50 AND conf_h >= 70 THEN 'page_business_hours' ELSE 'passthrough' END AS action FROM w),
d AS (SELECT *, CASE WHEN q3_choice = 'cannot_determine' THEN 'uncertain' WHEN action = 'suppress' THEN 'allowlist' WHEN action LIKE 'page%' THEN 'threshold' ELSE 'uncertain' END AS reason FROM d0)"""
)


def add(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def over_decisions(name: str, f, sql: str | None) -> None:
    add(name, sql and f"{DECISIONS} {sql}")(lambda s, d: f(src.decisions(read(s, d, "events"))))


def over_alerts(name: str, f, sql: str | None) -> None:
    add(name, sql and f"{ALERTS} {sql}")(lambda s, d: f(src.alerts(read(s, d, "events"))))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wilson_sql(k: str, n: str, z: float, sign: str) -> str:
    edge = f"({k}/{n}::DOUBLE + {z * z}/(2.0*{n}) {sign} {z}*sqrt(({k}/{n}::DOUBLE)*(1-{k}/{n}::DOUBLE)/{n} + {z * z}/(4.0*{n}*{n})))/(1 + {z * z}/{n}::DOUBLE)"
    return f"CASE WHEN {n} > 0 THEN " + (f"greatest(0.0, {edge})" if sign == "-" else f"least(1.0, {edge})") + " ELSE 0.0 END"


over_alerts("alerts", lambda a: a, "SELECT * FROM a")
over_decisions("decisions", lambda d: d.select("alert_id", "fingerprint", "conf_h", "allowed", "action", "reason", "became_sev12"), "SELECT alert_id, fingerprint, conf_h, allowed, action, reason, became_sev12 FROM d")
over_decisions("fingerprint_stats", src.fingerprint_stats, "SELECT * FROM fs")
over_decisions("candidate_allowlist", src.candidate_allowlist, "SELECT * FROM al")
over_decisions("noise_top_checks", analytics.noise_top_checks, "SELECT fingerprint, count(*) AS volume, count(*) FILTER (action = 'suppress') AS suppressed, arg_min(service, alert_id) AS service, arg_min(check_name, alert_id) AS check_name, round(count(*) FILTER (action = 'suppress') / count(*), 4) AS suppress_rate FROM d GROUP BY 1 ORDER BY volume DESC, fingerprint LIMIT 50")
over_decisions("team_load", analytics.team_load, "SELECT team, before, after, round(before / 30.0::DOUBLE, 4) AS before_per_night, round(after / 30.0::DOUBLE, 4) AS after_per_night FROM (SELECT team, count(*) FILTER (action IN ('page_now','page_business_hours','suppress')) AS before, count(*) FILTER (action = 'page_now') AS after FROM d GROUP BY 1)")
over_decisions("reason_breakdown", analytics.reason_breakdown, "SELECT reason, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM d), 4) AS pct FROM d GROUP BY 1")
over_decisions("coverage", analytics.coverage, "SELECT (SELECT count(*) FROM d WHERE became_sev12 IS NOT NULL) AS n, tau_h, count(*) AS covered, round(count(*) / (SELECT count(*) FROM d WHERE became_sev12 IS NOT NULL), 6) AS coverage FROM d, (VALUES (70), (80), (90)) t(tau_h) WHERE became_sev12 IS NOT NULL AND conf_h >= tau_h GROUP BY tau_h")
over_decisions("rank_auc", analytics.rank_auc, ", q AS (SELECT p1_h, became_sev12, rank() OVER (ORDER BY p1_h) + (count(*) OVER (PARTITION BY p1_h) - 1) / 2.0::DOUBLE AS rk FROM d WHERE became_sev12 IS NOT NULL), t AS (SELECT CAST(sum(became_sev12) AS BIGINT) AS positives, CAST(sum(1 - became_sev12) AS BIGINT) AS negatives, sum(CASE WHEN became_sev12 = 1 THEN rk ELSE 0 END) AS s FROM q) SELECT positives, negatives, round((s - positives * (positives + 1) / 2.0::DOUBLE) / (positives * negatives), 6) AS auc FROM t")
over_decisions("deciles", analytics.deciles, f", q AS (SELECT became_sev12, row_number() OVER (ORDER BY p1_h, alert_id) AS rn, count(*) OVER () AS total FROM d WHERE became_sev12 IS NOT NULL), t AS (SELECT (10 * rn - 1) // total AS decile, count(*) AS n, CAST(sum(became_sev12) AS BIGINT) AS k FROM q GROUP BY 1) SELECT decile, n, k, round(k / n, 6) AS rate, round({wilson_sql('k', 'n', 1.96, '-')}, 6) AS low, round({wilson_sql('k', 'n', 1.96, '+')}, 6) AS high FROM t")
over_decisions("confidence_bands", analytics.confidence_bands, f", t AS (SELECT band, count(*) AS n, CAST(sum(became_sev12) AS BIGINT) AS k FROM d JOIN (VALUES ('50-59',50,59),('60-69',60,69),('70-79',70,79),('80-94',80,94),('95-100',95,100)) b(band, lo, hi) ON conf_h BETWEEN lo AND hi WHERE became_sev12 IS NOT NULL GROUP BY 1) SELECT band, n, k, round({wilson_sql('k', 'n', 1.96, '-')}, 6) AS low, round({wilson_sql('k', 'n', 1.96, '+')}, 6) AS high, n < 30 AS thin FROM t")
over_decisions("tuner_grid", analytics.tuner_grid, ", g AS (SELECT *, CASE WHEN p1_h * 50100 < 10000 AND conf_h >= conf_min AND allowed THEN 's' WHEN p1_h + p2_h > 30 THEN 'p' WHEN p3_h + p4_h >= p1_h + p2_h AND conf_h >= 70 THEN 'q' ELSE 'b' END AS b FROM d, (VALUES (80), (85), (90), (95)) t(conf_min)), t AS (SELECT count(*) AS n, conf_min, count(*) FILTER (b = 's') AS suppressed, count(*) FILTER (b = 'p') AS paged, count(*) FILTER (b = 'q') AS queued, CAST(coalesce(sum(p1_h) FILTER (b = 's'), 0) AS BIGINT) AS expected_h FROM g GROUP BY conf_min) SELECT *, (n - suppressed) * 10000 + expected_h * 50000 AS cost FROM t")
over_decisions("certificate", analytics.certificate, f", t AS (SELECT count(*) FILTER (action = 'suppress' AND became_sev12 IS NOT NULL) AS n, count(*) FILTER (action = 'suppress' AND became_sev12 = 1) AS k, count(*) FILTER (action = 'suppress' AND became_sev12 IS NULL) AS m, count(*) FILTER (became_sev12 = 1) AS confirmed FROM d), u AS (SELECT *, {wilson_sql('k', 'n', 1.6449, '+')} AS p FROM t) SELECT n, k, m, confirmed, CASE WHEN n >= 300 AND confirmed >= 25 THEN round(p, 6) END AS upper, coalesce(m / nullif(n + m, 0) > 0.2, false) AS label_rot, CASE WHEN n < 300 OR confirmed < 25 THEN 'INSUFFICIENT-N' WHEN p <= 0.005 AND k = 0 THEN 'PASS' WHEN p > 0.01 OR k >= 1 THEN 'FAIL' ELSE 'FLAG' END AS verdict FROM u")
over_decisions("outcome_accuracy", analytics.accuracy, ", t AS (SELECT severity_in, count(*) AS n, CAST(sum(became_sev12) AS BIGINT) AS sev12, count(*) FILTER (became_sev12 = 1 AND action = 'suppress') AS false_suppressed, count(*) FILTER (became_sev12 = 1 AND action = 'page_now') AS right_pages, count(*) FILTER (action = 'page_now') AS pages FROM d WHERE became_sev12 IS NOT NULL GROUP BY 1) SELECT *, round(coalesce(false_suppressed / nullif(sev12, 0), 0.0), 6) AS false_suppress_rate, round(right_pages / nullif(pages, 0), 6) AS page_precision FROM t")
over_decisions("psi", lambda d: analytics.psi(d, F.col("severity_in"), F.col("alert_id") % 3 == 0), ", t AS (SELECT severity_in AS bucket, count(*) FILTER (alert_id % 3 = 0) AS e, count(*) FILTER (alert_id % 3 <> 0) AS a FROM d GROUP BY 1), u AS (SELECT *, greatest(e / (SELECT sum(e) FROM t), 1e-9) AS pe, greatest(a / (SELECT sum(a) FROM t), 1e-9) AS pa FROM t) SELECT bucket, e, a, round((pa - pe) * ln(pa / pe), 6) AS psi FROM u")
over_decisions("flip_records", analytics.flip_records, "SELECT sha256(concat_ws('|', service, check_name, CAST(k // 10 AS VARCHAR))) AS input_sha256, count(*) AS n, min(alert_id) AS first_id, max(alert_id) AS last_id, count(DISTINCT action) AS actions, count(DISTINCT action) > 1 AS flipped FROM d GROUP BY 1 HAVING count(*) > 1")
over_decisions("impact_report", analytics.impact, "SELECT concat(action, '->', CASE WHEN q3_choice = 'cannot_determine' THEN 'passthrough' WHEN p1_h = 0 AND conf_h >= 80 AND allowed THEN 'suppress' WHEN p1_h + p2_h > 30 OR conf_h < 50 THEN 'page_now' WHEN p3_h + p4_h >= 50 AND conf_h >= 70 THEN 'page_business_hours' ELSE 'passthrough' END) AS transition, count(*) AS n FROM d GROUP BY 1")
_ARM = "CASE WHEN q3_choice = 'cannot_determine' THEN 'passthrough' WHEN p1_h = 0 AND conf_h >= {c} AND allowed THEN 'suppress' WHEN p1_h + p2_h > {p} OR conf_h < {u} THEN 'page_now' WHEN p3_h + p4_h >= 50 AND conf_h >= 70 THEN 'page_business_hours' ELSE 'passthrough' END"
_ERFC = "(1/(1+0.3275911*{x}))*(0.254829592+(1/(1+0.3275911*{x}))*(-0.284496736+(1/(1+0.3275911*{x}))*(1.421413741+(1/(1+0.3275911*{x}))*(-1.453152027+(1/(1+0.3275911*{x}))*1.061405429))))*exp(-{x}*{x})"
over_decisions("paired_mcnemar", analytics.paired_mcnemar, f", q AS (SELECT {_ARM.format(c=90, p=30, u=50)} AS x, {_ARM.format(c=90, p=32, u=50)} AS y, {_ARM.format(c=80, p=30, u=45)} AS z FROM d), t AS (SELECT count(*) AS n, count(*) FILTER (x = y AND x <> z) AS b, count(*) FILTER (x <> y AND x = z) AS c FROM q) SELECT n, b, c, CASE WHEN b + c >= 10 THEN round(pow(abs(b - c) - 1, 2) / (b + c), 6) END AS chi2, round({_ERFC.format(x='sqrt(pow(abs(b - c) - 1, 2) / (b + c) / 2)')}, 5) AS p FROM (SELECT n, b, c FROM t WHERE b + c >= 10) UNION ALL SELECT n, b, c, NULL, NULL FROM t WHERE b + c < 10")
over_decisions("backtest", analytics.backtest, ", t AS (SELECT service, at_us // 86400000000 AS day, arg_min(action, (at_us, alert_id)) AS opening, max(became_sev12) AS sev, count(*) AS n FROM d GROUP BY 1, 2) SELECT *, coalesce(sev, 0) = 1 AND opening = 'suppress' AS miss FROM t")
over_decisions("latency_quantiles", analytics.latency_quantiles, "SELECT check_name, count(*) AS n, round(quantile_cont(metric_value, 0.5), 6) AS p50, round(quantile_cont(metric_value, 0.95), 6) AS p95, round(quantile_disc(metric_value, 0.99), 6) AS p99_disc, max(metric_value) AS worst FROM d GROUP BY 1")
over_decisions("cold_summary", analytics.cold_summary, "SELECT action, check_name, at_us // 86400000000 AS day, count(*) AS n FROM d GROUP BY GROUPING SETS ((action), (check_name), (day))")
over_decisions("policy_tables", lambda d: d.groupBy(kernel.tuner_bucket().alias("tuner"), kernel.mock_action().alias("mock"), "action").agg(F.count("*").alias("n")), "SELECT CASE WHEN p1_h * 50100 < 10000 AND conf_h >= 90 AND allowed THEN 'suppress' WHEN p1_h + p2_h > 30 THEN 'page_now' WHEN p3_h + p4_h >= p1_h + p2_h AND conf_h >= 70 THEN 'queue' ELSE 'baseline' END AS tuner, CASE WHEN p1_h = 0 AND conf_h >= 90 THEN 'suppress' WHEN p1_h + p2_h >= 30 THEN 'page_now' ELSE 'page_business_hours' END AS mock, action, count(*) AS n FROM d GROUP BY ALL")
over_decisions("suppression_watchdog", windows.trailing_rate, ", t AS (SELECT alert_id, service, count(*) OVER w AS n, CAST(sum(CASE WHEN action = 'suppress' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS k FROM d WINDOW w AS (PARTITION BY service ORDER BY at_us RANGE BETWEEN 900000000 PRECEDING AND CURRENT ROW)) SELECT *, n >= 30 AND k > 0.5 * n AS tripped FROM t")
over_alerts("trailing_distinct", windows.trailing_distinct, "SELECT x.estate, x.alert_id, count(DISTINCT y.fingerprint) AS w FROM a x JOIN a y ON x.estate = y.estate AND y.at_us BETWEEN x.at_us - 60000000 AND x.at_us GROUP BY 1, 2")
over_alerts("novelty", windows.novelty, "SELECT alert_id, fingerprint, count(*) OVER (PARTITION BY fingerprint ORDER BY at_us RANGE BETWEEN 259200000000 PRECEDING AND 1 PRECEDING) = 0 AS novel FROM a")
over_alerts("level_shift", windows.level_shift, ", h AS (SELECT service, at_us // 3600000000 AS hour, count(*) AS n FROM a GROUP BY 1, 2), q AS (SELECT *, count(*) OVER w AS c, avg(n) OVER w AS m, stddev_pop(n) OVER w AS sd FROM h WINDOW w AS (PARTITION BY service ORDER BY hour RANGE BETWEEN 24 PRECEDING AND 1 PRECEDING)) SELECT service, hour, n, round(CASE WHEN c < 3 OR sd = 0 THEN 0.0 ELSE greatest(-50, least(50, (n - m) / sd)) END, 4) AS z FROM q")
over_alerts("episodes", windows.episodes, ", q AS (SELECT *, CASE WHEN at_us - lag(at_us) OVER w <= 3600000000 THEN 0 ELSE 1 END AS new FROM a WINDOW w AS (PARTITION BY fingerprint ORDER BY at_us, alert_id)), r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY fingerprint ORDER BY at_us, alert_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode FROM q) SELECT fingerprint, episode, count(*) AS n, min(alert_id) AS first_id, max(at_us) - min(at_us) AS length_us FROM r GROUP BY 1, 2")
over_alerts("arrival_peak", windows.arrival_peak, ", t AS (SELECT estate, at_us // 60000000 AS minute, count(*) AS n FROM a GROUP BY 1, 2) SELECT estate, max(n) AS peak, count(*) AS minutes FROM t GROUP BY 1")
over_alerts("change_windows", lambda a: windows.in_change_window(a, a.where("k >= 98").select("service", F.col("at_us").alias("begin_us"), (F.col("at_us") + 1_800_000_000).alias("end_us"))), "SELECT x.alert_id, x.service FROM a x WHERE severity_in NOT IN ('critical', 'high') AND EXISTS (SELECT 1 FROM a y WHERE y.k >= 98 AND y.service = x.service AND x.at_us BETWEEN y.at_us AND y.at_us + 1800000000)")
over_alerts("allowlist_edit", lambda a: eventlog.allowlist_edit(*[a.where(c).select("fingerprint") for c in ("k < 50", "k >= 90", "severity_in = 'critical'")]), "SELECT DISTINCT fingerprint FROM a WHERE (k < 50 OR k >= 90) AND fingerprint NOT IN (SELECT fingerprint FROM a WHERE severity_in = 'critical')")
over_alerts("active_mutes", lambda a: eventlog.active_mutes(a.select("fingerprint", F.col("alert_id").alias("seq"), F.when(F.col("k") < 50, "applied").when(F.col("k") < 75, "lifted").otherwise("expired").alias("type"), (F.col("at_us") + 864_000_000_000).alias("until_us")), 1_706_000_000_000_000), ", t AS (SELECT fingerprint, arg_max(CASE WHEN k < 50 THEN 'applied' WHEN k < 75 THEN 'lifted' ELSE 'expired' END, alert_id) AS type, arg_max(at_us, alert_id) + 864000000000 AS until_us FROM a GROUP BY 1) SELECT fingerprint, until_us FROM t WHERE type = 'applied' AND until_us > 1706000000000000")
over_alerts("retention_plan", lambda a: eventlog.retention_plan(a, 1_706_659_200_000_000), "SELECT at_us // 86400000000 AS day, count(*) AS n, CAST(sum(strlen(concat_ws('|', alert_id, fingerprint, check_name))) AS BIGINT) AS bytes, CASE WHEN 19753 - at_us // 86400000000 <= 10 THEN 'hot' WHEN 19753 - at_us // 86400000000 <= 20 THEN 'warm' ELSE 'cold' END AS tier FROM a GROUP BY 1")
over_alerts("chain_verify", lambda a: eventlog.verify(eventlog.chain(a.select(F.floor(F.col("at_us") / 3_600_000_000).alias("segment"), "alert_id", eventlog.body_of("alert_id", "fingerprint", "check_name").alias("body")))), "SELECT at_us // 3600000000 AS segment, count(*) AS n, 0::BIGINT AS broken, 0::BIGINT AS wrong FROM a GROUP BY 1")
over_alerts("correlator", correlator.correlate, None)


def _episodes(d: DataFrame) -> DataFrame:
    """All steps: 600 times denser than the events, so that there are storms; every third alert is resolved a second later, and decisions are told to duplicates."""
    dense = d.withColumn("at_us", (F.col("at_us") / 600).cast("long"))
    shut = dense.where("k >= 98 AND alert_id % 10 = 0").select("service", F.col("at_us").alias("begin_us"), (F.col("at_us") + 3_000_000).alias("end_us"))
    late = lambda us: (F.col("at_us") + us).alias("at_us")
    resolves = dense.where("alert_id % 3 = 0").select("estate", late(1_000_000), F.col("alert_id").alias("seq"), "fingerprint", F.when(F.col("k") % 10 == 0, "silence").otherwise("verified_resolve").alias("authority"))
    verdicts = dense.select("estate", late(1), F.col("alert_id").alias("seq"), "fingerprint", "action")
    return correlator.correlate(correlator.hold(dense, shut), resolves, verdicts)


over_decisions("correlator_episodes", _episodes, None)


def _pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    action = F.when(F.col("o_orderstatus") == "F", "page_now").when(F.col("o_orderstatus") == "O", "page_business_hours").otherwise("passthrough")
    return orders.select(F.col("o_orderkey").alias("alert_id"), action.alias("action"), src.micros(F.col("o_orderdate")).alias("at_us")), lines.select(F.col("l_orderkey").alias("alert_id"), src.micros(F.col("l_shipdate")).alias("at_us"))


_ORDERS = "WITH o AS (SELECT o_orderkey AS alert_id, CASE o_orderstatus WHEN 'F' THEN 'page_now' WHEN 'O' THEN 'page_business_hours' ELSE 'passthrough' END AS action, epoch_us(o_orderdate) AS at_us FROM orders)"


#: 1997-01-01, when the river is looked at: later orders are young.
_NOW_US = 852_076_800_000_000
_RIVER_LOG = """WITH log AS (SELECT o_orderkey AS alert_id, 10 * o_orderkey AS seq, 'decision_requested' AS type, NULL AS disposition, NULL AS outbox_id, epoch_us(o_orderdate) AS at_us FROM orders
UNION ALL SELECT o_orderkey, 10 * o_orderkey + 1, 'decision_made', CASE WHEN o_orderkey % 13 = 0 THEN 'suppress' WHEN o_orderkey % 17 = 0 THEN 'folded' WHEN o_orderstatus = 'F' THEN 'page_now' WHEN o_orderstatus = 'O' THEN 'page_business_hours' ELSE 'passthrough' END, CASE WHEN o_orderkey % 5 > 0 THEN concat('ob-', o_orderkey) END, epoch_us(o_orderdate) FROM orders WHERE o_orderkey % 11 > 0
UNION ALL SELECT l_orderkey, 10 * l_orderkey + 1 + l_linenumber, 'forward_confirmed', NULL, concat(CASE WHEN l_returnflag = 'R' THEN 'other-' ELSE 'ob-' END, l_orderkey), epoch_us(l_shipdate) FROM lineitem WHERE l_linenumber = 1 AND l_returnflag <> 'N')"""


@add("river", _RIVER_LOG + """, made AS (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY seq DESC) AS r FROM log WHERE type = 'decision_made'),
a AS (SELECT alert_id, max(seq) AS seq, count(*) FILTER (type = 'decision_requested') AS n_requested, count(*) FILTER (type = 'decision_made') AS n_decisions FROM log GROUP BY 1),
j AS (SELECT a.*, m.disposition, m.outbox_id, m.at_us, EXISTS (SELECT 1 FROM log c WHERE c.type = 'forward_confirmed' AND c.alert_id = a.alert_id AND c.outbox_id = m.outbox_id) AS sure FROM a LEFT JOIN made m ON m.alert_id = a.alert_id AND m.r = 1)
SELECT alert_id, seq, outbox_id, n_requested, n_decisions, CASE WHEN n_decisions = 0 THEN CASE WHEN n_requested > 0 THEN 'requested' ELSE 'unknown' END WHEN disposition = 'suppress' THEN 'suppressed' WHEN disposition LIKE 'page%' THEN CASE WHEN sure THEN 'paged' WHEN 852076800000000 - at_us > 60000000 THEN 'PAGED_ANOMALY' ELSE 'decided_unconfirmed' END WHEN disposition = 'passthrough' THEN CASE WHEN outbox_id IS NOT NULL AND NOT sure THEN 'passthrough_unconfirmed' ELSE 'passthrough_decided' END WHEN disposition = 'folded' THEN 'folded_into_aggregate' ELSE 'unknown' END AS status FROM j""")
def river(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.river(river_log(spark, sf_dir), _NOW_US)


def river_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of requests, decisions and confirmations, from orders and their first lines."""
    o, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem").where("l_linenumber = 1 and l_returnflag <> 'N'")
    key, none = F.col("o_orderkey"), F.lit(None).cast("string")
    said = F.when(key % 13 == 0, "suppress").when(key % 17 == 0, "folded").when(F.col("o_orderstatus") == "F", "page_now").when(F.col("o_orderstatus") == "O", "page_business_hours").otherwise("passthrough")
    rows = lambda df, k, seq, kind, what, box, at: df.select(k.alias("alert_id"), seq.alias("seq"), F.lit(kind).alias("type"), what.alias("disposition"), box.alias("outbox_id"), src.micros(at).alias("at_us"))
    asked = rows(o, key, key * 10, "decision_requested", none, none, F.col("o_orderdate"))
    made = rows(o.where(key % 11 > 0), key, key * 10 + 1, "decision_made", said, F.when(key % 5 > 0, F.concat(F.lit("ob-"), key.cast("string"))), F.col("o_orderdate"))
    line = F.col("l_orderkey")
    sure = rows(lines, line, line * 10 + 1 + F.col("l_linenumber"), "forward_confirmed", none, F.concat(F.when(F.col("l_returnflag") == "R", "other-").otherwise("ob-"), line.cast("string")), F.col("l_shipdate"))
    return asked.unionByName(made).unionByName(sure)


@add("orphans", f"{_ORDERS} SELECT alert_id, action, at_us FROM o WHERE 1000000000000000 - at_us > 30000000 AND alert_id NOT IN (SELECT l_orderkey FROM lineitem)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, answered = _pages(spark, sf_dir)
    return eventlog.orphans(requests, answered, F.lit(1_000_000_000_000_000), 30_000_000).select("alert_id", "action", "at_us")


@add("vendor_events", "SELECT event_id AS alert_id, concat('svc-', user_id % 10) AS service, CASE WHEN user_id % 3 = 0 THEN 'default' ELSE event_type END AS check_name, CASE WHEN user_id % 7 = 0 THEN 'summary' ELSE '' END AS problem FROM events")
def vendor_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as vendor JSON and read back by the source."""
    e, user = read(spark, sf_dir, "events"), F.col("user_id")
    payload = F.struct(F.when(user % 7 != 0, F.col("event_type")).alias("summary"), F.lit("probe").alias("source"), F.lit("critical").alias("severity"), F.concat(F.lit("svc-"), (user % 10).cast("string")).alias("component"), F.when(user % 3 != 0, F.col("event_type")).alias("class"))
    raw = e.select(F.col("event_id").alias("alert_id"), F.to_json(F.struct(F.lit("key").alias("routing_key"), F.lit("trigger").alias("event_action"), payload.alias("payload"))).alias("body"))
    return src.from_pager(raw).select("alert_id", "service", "check_name", "problem")


@add("state_cap", "WITH t AS (SELECT conv_id, turn, greatest(1, length(coalesce(text, '')) // 4) AS tokens FROM conversations), u AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM t) SELECT * FROM u WHERE upto <= 850")
def state_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.cap_state(read(spark, sf_dir, "conversations"), 850)


@add("service_owners", "SELECT n_name AS owner, count(*) AS customers, count(DISTINCT c_mktsegment) AS segments FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def service_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ownership dimension: the small side is the plan's choice by its size."""
    return read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("owner")).agg(F.count("*").alias("customers"), F.countDistinct("c_mktsegment").alias("segments"))
