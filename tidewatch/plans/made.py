"""Queries that draw answers and arrivals for the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.plans.catalog import over_alerts, over_decisions
from tidewatch.sources import synthetic

HOUR = 3_600_000_000


def _u(purpose: str, *counter: str) -> str:
    return f"(CAST(concat('0x', substr(sha256(concat_ws(':', '7:{purpose}', {', '.join(counter)})), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE)"


_TRUE = "CASE WHEN became_sev12 = 1 THEN CASE WHEN k >= 90 THEN 'p1_critical' ELSE 'p2_high' END WHEN became_sev12 IS NULL THEN 'unseen' WHEN k < 40 THEN 'known_noise' WHEN k < 70 THEN 'p3_medium' ELSE 'p4_low' END"
_DISPOSED = "CASE WHEN k < 40 THEN 'suppress' ELSE 'page_now' END"


def answered(d: DataFrame) -> DataFrame:
    rows = d.select("alert_id", F.expr(_TRUE).alias("severity_true"), F.expr(_DISPOSED).alias("disposition_true"))
    return synthetic.answers(rows, 7, "alert_id", 0.1).select("alert_id", F.array_join("probs_h", ",").alias("probs_h"), "q1_choice", "q3_choice", "q3_conf_h")


_BASE = "CASE severity_true " + " ".join(f"WHEN '{k}' THEN {p}" for k, p in synthetic.TEMPLATES.items()) + " END"
_LISTED = str(synthetic.OPTIONS)
over_decisions("synthetic_answers", answered, f""", t AS (SELECT alert_id, {_TRUE} AS severity_true, {_DISPOSED} AS q3_choice FROM d), b AS (SELECT *, {_BASE} AS base, [{', '.join(_u(f'p{j}', 'alert_id') for j in range(6))}] AS us FROM t),
 m AS (SELECT *, list_transform(range(1, 7), lambda i: CAST(floor(base[i] * (0.9::DOUBLE + 0.2::DOUBLE * us[i]) / 100 + 0.5::DOUBLE) AS INT)) AS moved FROM b), p AS (SELECT *, list_position(moved, list_max(moved)) AS top, list_sum(moved) AS total FROM m)
 SELECT alert_id, CASE WHEN base IS NOT NULL THEN array_to_string(list_transform(range(1, 7), lambda i: moved[i] + CASE WHEN i = top THEN 100 - total ELSE 0 END), ',') END AS probs_h,
 CASE WHEN base IS NULL THEN NULL WHEN {_u('flip', 'alert_id')} < 0.1 THEN list_filter({_LISTED}, lambda o: o <> severity_true)[CAST(floor({_u('other', 'alert_id')} * 5) AS INT) + 1] ELSE {_LISTED}[top] END AS q1_choice, q3_choice,
 CASE WHEN q3_choice = 'suppress' THEN 90 + floor({_u('confidence', 'alert_id')} * 9) ELSE 80 + floor({_u('confidence', 'alert_id')} * 19) END::INT AS q3_conf_h FROM p""")


def load(a: DataFrame) -> DataFrame:
    """Arrivals of each service at the rates that its hours have in the table, critical ones threefold."""
    cells = a.groupBy("service", "severity_in", F.floor(F.col("at_us") / HOUR).alias("hour")).agg(F.count("*").alias("seen"))
    mean = F.col("seen") * F.when(F.col("severity_in") == "critical", 3.0).otherwise(1.0)
    cells = cells.select("service", "severity_in", "hour", (F.col("hour") * HOUR).alias("from_us"), F.lit(HOUR).alias("span_us"), mean.alias("mean"))
    return synthetic.arrivals(cells, 7, "service", "severity_in", "hour")


_KEY = ("service", "severity_in", "hour")
over_alerts("synthetic_load", load, f""", c AS (SELECT service, severity_in, at_us // {HOUR} AS hour, count(*) * CASE WHEN severity_in = 'critical' THEN 3.0::DOUBLE ELSE 1 END AS mean FROM a GROUP BY 1, 2, 3),
 q AS (SELECT c.*, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY service, severity_in, hour ORDER BY k) AS upto FROM c, range(0, 200) t(k)), n AS (SELECT service, severity_in, hour, count(*) FILTER (upto <= {_u('count', *_KEY)}) AS n FROM q GROUP BY 1, 2, 3), e AS (SELECT service, severity_in, hour, CAST(unnest(range(1, n + 1)) AS INT) AS nth FROM n)
 SELECT service, severity_in, hour, nth, hour * {HOUR} + CAST(floor({_u('at', *_KEY, 'nth')} * {HOUR}) AS BIGINT) AS at_us FROM e""")
