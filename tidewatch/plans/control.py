"""Queries over the ladder, its degraded steps, reads of the past and spend; SQL is written as a row-by-row account where the operator works by segments or buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import asof, baseline, freshness, ladder, watch
from tidewatch.plans.catalog import ORACLES, over_decisions

DAY, HOUR = 86_400_000_000, 3_600_000_000
#: The events are some hundred times sparser than the traffic the ladder's own bounds are for.
RULES = ladder.Rules(health_us=12 * HOUR, min_decisions=10, dwell_us=4 * HOUR, exit_hold_us=4 * HOUR, pages_per_minute=0.02, pressure_us=6 * HOUR, backlog=1_000)
SEGMENT_US = 24 * HOUR
#: Halfway through the events, when one estate's policy goes stale.
STALE_US = 1_705_300_000_000_000

_SEEN = {
    "vendor_outcome": f"CASE WHEN alert_id % 97 = 0 THEN 'structural' WHEN (at_us div {36 * HOUR}) % 3 = 0 AND k < 60 THEN 'timer_win' WHEN k >= 95 THEN 'unhealthy_error' ELSE 'answered' END",
    "backlog": f"CAST((at_us div {HOUR}) % 30 * 50 AS BIGINT)",
    "policy_until_us": f"CASE WHEN estate = 'e0' THEN {STALE_US} END",
}


def observed(d: DataFrame) -> DataFrame:
    """Decisions as the ladder sees them."""
    return d.select("estate", F.col("alert_id").alias("seq"), "at_us", "action", *[F.expr(e).alias(c) for c, e in _SEEN.items()])


_OBSERVED = ", o AS (SELECT estate, alert_id AS seq, at_us, action, " + ", ".join(f"{e.replace(' div ', ' // ')} AS {c}" for c, e in _SEEN.items()) + " FROM d)"
#: Trailing counts by comparing rows, then one row of an estate after the other.
_LADDER = (
    _OBSERVED
    + f""", h AS (SELECT x.estate, x.seq, count(*) FILTER (y.vendor_outcome IN ('timer_win', 'unhealthy_error', 'answered')) AS n, count(*) FILTER (y.vendor_outcome IN ('timer_win', 'unhealthy_error')) AS bad, count(*) FILTER (y.at_us >= x.at_us - {RULES.pressure_us} AND y.action IN ('page_now', 'page_business_hours', 'passthrough')) AS pages
 FROM o x JOIN o y ON x.estate = y.estate AND y.at_us BETWEEN x.at_us - {RULES.health_us} AND x.at_us AND (y.at_us, y.seq) <= (x.at_us, x.seq) GROUP BY 1, 2),
lw AS (SELECT o.*, row_number() OVER (PARTITION BY o.estate ORDER BY at_us, o.seq) AS rn, n >= {RULES.min_decisions} AND bad / n > 0.25 AS hot, n >= {RULES.min_decisions} AND bad / n < 0.125 AS well, pages / {RULES.pressure_us / ladder.MINUTE}::DOUBLE AS rate, {RULES.pages_per_minute}::DOUBLE AS budget, backlog >= {RULES.backlog} AS full_up, policy_until_us IS NULL OR at_us <= policy_until_us AS fresh FROM o JOIN h USING (estate, seq)),
m AS (SELECT estate, 0::BIGINT AS rn, 0::BIGINT AS at_us, 0::BIGINT AS seq, 0 AS was, 0 AS step, min(at_us) AS entered, NULL::BIGINT AS up, NULL::BIGINT AS down, '' AS cause FROM lw GROUP BY estate
 UNION ALL SELECT estate, rn, at_us, seq, step, coalesce(goes, step), CASE WHEN goes IS NULL THEN entered ELSE at_us END, CASE WHEN goes IS NULL THEN up END, CASE WHEN goes IS NULL THEN down END,
  CASE WHEN goes IS NULL THEN '' WHEN step = 0 THEN CASE WHEN hot THEN 'timer_win_rate' ELSE 'page_pressure' END WHEN step = 1 AND goes = 2 THEN CASE WHEN fresh THEN 'page_rate' ELSE 'policy_stale' END WHEN step = 1 THEN 'recovered' WHEN goes = 3 THEN 'sustained_pressure' ELSE 'pressure_over' END
 FROM (SELECT *, CASE step WHEN 0 THEN CASE WHEN dwelt AND hot THEN 1 WHEN dwelt AND rate > 3 * budget THEN 3 END
   WHEN 1 THEN CASE WHEN NOT fresh THEN 2 WHEN dwelt AND rate > budget THEN 2 WHEN dwelt AND at_us - down >= {RULES.exit_hold_us} THEN 0 END
   WHEN 2 THEN CASE WHEN dwelt AND at_us - up >= {RULES.pressure_us} THEN 3 WHEN dwelt AND fresh AND at_us - down >= {RULES.exit_hold_us} THEN 1 END
   WHEN 3 THEN CASE WHEN dwelt AND at_us - down >= {RULES.exit_hold_us} THEN 2 END END AS goes
  FROM (SELECT lw.*, m.step, m.entered, lw.at_us - m.entered >= {RULES.dwell_us} AS dwelt,
    CASE WHEN m.step = 2 AND lw.at_us - m.entered >= {RULES.dwell_us} THEN CASE WHEN rate > budget OR full_up THEN coalesce(m.up, lw.at_us) END ELSE m.up END AS up,
    CASE WHEN lw.at_us - m.entered < {RULES.dwell_us} OR m.step = 0 OR (m.step = 2 AND NOT fresh) THEN m.down WHEN rate <= budget AND (m.step > 1 OR well) THEN coalesce(m.down, lw.at_us) END AS down
   FROM m JOIN lw ON lw.estate = m.estate AND lw.rn = m.rn + 1))),
t AS (SELECT estate, at_us, seq, was AS from_step, step AS to_step, cause FROM m WHERE was <> step)"""
)


def over(name: str, f, sql: str) -> None:
    """A query whose SQL has a recursive clause, which the outermost WITH must announce."""
    over_decisions(name, f, sql)
    ORACLES[name] = ORACLES[name].replace("WITH base", "WITH RECURSIVE base", 1)


def changes(d: DataFrame) -> DataFrame:
    return ladder.transitions(observed(d), RULES, SEGMENT_US)


def stepped(d: DataFrame) -> DataFrame:
    """Observations with the step in force before them, and when that was entered (null at step 0 from the start)."""
    found = changes(d).select("estate", "at_us", "seq", "to_step")
    rows = asof.asof(observed(d).select("estate", "seq", "at_us"), found, "estate", inclusive=False, span_us=SEGMENT_US)
    return rows.select("estate", "seq", "at_us", F.coalesce("found.to_step", F.lit(0)).alias("step"), F.col("found.at_us").alias("activation"))


over("ladder", changes, _LADDER + " SELECT * FROM t")
over("ladder_intervals", lambda d: ladder.intervals(changes(d)), _LADDER + ", i AS (SELECT estate, to_step AS step, at_us AS from_us, lead(at_us) OVER w AS until_us, from_step, seq FROM t WINDOW w AS (PARTITION BY estate ORDER BY at_us, seq)) SELECT estate, step, from_us, until_us, from_us - (SELECT max(z.from_us) FROM i z WHERE z.estate = i.estate AND z.from_step = 0 AND z.from_us <= i.from_us) AS degraded_us FROM i")
#: Each tenth alert of a degraded estate probes the vendor; the step is that before the alert itself is observed.
over("canary", lambda d: watch.canary(stepped(d), 10).select("estate", "seq", "step", "nth"), _LADDER + ", s AS (SELECT lw.estate, lw.seq, lw.at_us, m.step FROM lw JOIN m ON m.estate = lw.estate AND m.rn = lw.rn - 1), c AS (SELECT estate, seq, step, row_number() OVER (PARTITION BY estate ORDER BY at_us, seq) AS nth FROM s WHERE step > 0) SELECT * FROM c WHERE nth % 10 = 0")


#: What was last decided of the same service before: a read of history up to a cutoff. Decisions of the cutoff's own microsecond are not before it, so what asks has no seq, which comes first.
_PAST = " SELECT x.alert_id, y.alert_id AS prior_id, y.action AS prior_action FROM d x ASOF LEFT JOIN (SELECT service, action, alert_id, at_us FROM d WHERE k < 30) y ON x.service = y.service AND x.at_us > y.at_us"
over_decisions("history_read", lambda d: asof.asof(d.select("service", "at_us", F.lit(None).cast("long").alias("seq"), "alert_id"), d.where("k < 30").select("service", "at_us", F.col("alert_id").alias("seq"), "alert_id", "action"), "service", inclusive=False).select("alert_id", F.col("found.alert_id").alias("prior_id"), F.col("found.action").alias("prior_action")), _PAST)
over_decisions("running_count", lambda d: asof.running(d.select("fingerprint", "at_us", F.col("alert_id").alias("seq")), "fingerprint").select("fingerprint", F.col("seq").alias("alert_id"), "nth"), "SELECT fingerprint, alert_id, row_number() OVER (PARTITION BY fingerprint ORDER BY at_us, alert_id) AS nth FROM d")
over_decisions("page_rate", lambda d: watch.page_rate(d, 0.02, 6 * HOUR), f"SELECT x.estate, x.alert_id, count(*) FILTER (y.action IN ('page_now', 'page_business_hours', 'passthrough')) AS pages, count(*) FILTER (y.action IN ('page_now', 'page_business_hours', 'passthrough')) / 360::DOUBLE > 0.02 AS over FROM d x JOIN d y ON x.estate = y.estate AND y.at_us BETWEEN x.at_us - {6 * HOUR} AND x.at_us AND (y.at_us, y.alert_id) <= (x.at_us, x.alert_id) GROUP BY 1, 2")
_Z = "CAST((alert_id * 7) % 13 - 6 AS DOUBLE)"
over_decisions("digest_rank", lambda d: watch.digest(d.where("action <> 'page_now'").withColumn("z", F.expr(_Z)), 20).select("estate", "rank", "fingerprint", "n", "severity_in", "z", "since_us", "alert_id"), f""", q AS (SELECT estate, fingerprint, count(*) AS n, arg_min(severity_in, (at_us, alert_id)) AS severity_in, arg_max({_Z}, (at_us, alert_id)) AS z, min(at_us) AS since_us, arg_max(alert_id, (at_us, alert_id)) AS alert_id FROM d WHERE action <> 'page_now' GROUP BY 1, 2),
 ranked AS (SELECT estate, row_number() OVER (PARTITION BY estate ORDER BY CASE severity_in WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 5 END, z DESC, since_us, fingerprint) AS rank, fingerprint, n, severity_in, z, since_us, alert_id FROM q) SELECT * FROM ranked WHERE rank <= 20""")
#: An activation of the third step is a day here; a minute's budget is 4.
over_decisions("rate_capped", lambda d: watch.rate_capped(d.select("estate", F.floor(F.col("at_us") / DAY).alias("activation"), "alert_id", (F.col("at_us") / 600).cast("long").alias("at_us"), "fingerprint", "severity_in", F.expr(_Z).alias("z")), 4), None)
over("daily_caps", lambda d: watch.daily_caps(d.withColumn("cost", F.col("k") + 1), 300), f""", q AS (SELECT estate, alert_id, (k + 1)::DOUBLE AS cost, at_us // {DAY} AS day, row_number() OVER (PARTITION BY estate, at_us // {DAY} ORDER BY at_us, alert_id) AS i FROM d),
 spend AS (SELECT estate, day, 0::BIGINT AS i, 0::BIGINT AS alert_id, false AS admitted, 0::DOUBLE AS spent FROM q GROUP BY estate, day UNION ALL SELECT q.estate, q.day, q.i, q.alert_id, s.spent + cost <= 300, CASE WHEN s.spent + cost <= 300 THEN s.spent + cost ELSE s.spent END FROM spend s JOIN q ON q.estate = s.estate AND q.day = s.day AND q.i = s.i + 1)
 SELECT estate, alert_id, admitted, spent FROM spend WHERE i > 0""")

#: An estate's ticks are its hours; the baseline of an hour grows with the month in two of the estates, one of which is signed for halfway.
_B = "CASE WHEN estate IN ('e0', 'e1') AND at_us >= 1705600000000000 THEN 40.0 ELSE 4.0 + hour % 3 END"


def ticks(d: DataFrame) -> DataFrame:
    hourly = d.groupBy("estate", F.floor(F.col("at_us") / HOUR).alias("hour")).agg(F.count_distinct("fingerprint").alias("w"))
    return hourly.withColumn("at_us", F.col("hour") * HOUR).select("estate", "at_us", F.col("hour").alias("seq"), "w", F.expr(_B).cast("double").alias("b"))


def guard(d: DataFrame) -> DataFrame:
    signed = d.sparkSession.sql("SELECT 'e1' AS estate, 19744L AS day, 30.0D AS baseline")
    return baseline.growth(ticks(d), signed)


_TICKS = f", tk0 AS (SELECT estate, at_us // {HOUR} AS hour, count(DISTINCT fingerprint) AS w FROM d GROUP BY 1, 2), tk AS (SELECT estate, hour, hour // 24 AS day, w, {_B.replace('at_us', f'hour * {HOUR}')}::DOUBLE AS b FROM tk0)"
over_decisions("baseline_guard", guard, _TICKS + """, dy AS (SELECT estate, day, arg_max(b, hour) AS baseline, list_sort(list(w))[count(*) // 2 + 1]::BIGINT AS velocity FROM tk GROUP BY 1, 2),
 md AS (SELECT x.estate, x.day, any_value(x.baseline) AS baseline, any_value(x.velocity) AS velocity, list_sort(list(y.baseline))[count(*) // 2 + 1] AS median FROM dy x JOIN dy y ON x.estate = y.estate AND y.day <= x.day AND (SELECT count(*) FROM dy z WHERE z.estate = x.estate AND z.day > y.day AND z.day <= x.day) < 40 GROUP BY 1, 2),
 rt AS (SELECT *, greatest(median, CASE WHEN estate = 'e1' AND day >= 19744 THEN 30.0 ELSE 0 END) AS ref FROM md), rr AS (SELECT *, CASE WHEN ref > 0 THEN greatest(baseline, velocity) / ref ELSE 0 END AS ratio FROM rt)
 SELECT estate, day, baseline, median, velocity, ratio, CASE WHEN ratio > 3 THEN (SELECT min(u.day) FROM rr u WHERE u.estate = rr.estate AND u.day <= rr.day AND NOT EXISTS (SELECT 1 FROM rr c WHERE c.estate = rr.estate AND c.day BETWEEN u.day AND rr.day AND c.ratio <= 3)) END AS since FROM rr""")
over_decisions("baseline_bootstrap", lambda d: baseline.bootstrap(ticks(d).select(F.concat_ws("|", "estate", F.floor(F.col("at_us") / DAY).cast("string")).alias("estate"), "at_us", "seq", "w"), 4), _TICKS + """, bt AS (SELECT concat_ws('|', estate, day) AS estate, w, row_number() OVER (PARTITION BY estate, day ORDER BY hour) - 1 AS i, count(*) OVER (PARTITION BY estate, day) AS n FROM tk),
 bs AS (SELECT estate, any_value(n) AS n, list_sort(list(w)) AS whole, list_sort(list(w) FILTER (2 * i + 1 < 4 * n / 3.0)) AS early, list_sort(list(w) FILTER (2 * i + 1 >= 4 * n / 3.0)) AS late FROM bt GROUP BY 1),
 bo AS (SELECT *, CASE WHEN n < 5 THEN 'few' WHEN early[len(early) // 2 + 1] < 4 AND late[len(late) // 2 + 1] >= 4 THEN 'refused' WHEN whole[n // 2 + 1] < 4 THEN 'quiet' ELSE 'learned' END AS outcome FROM bs)
 SELECT estate, n, outcome, CASE WHEN outcome = 'learned' THEN whole[n // 2 + 1]::DOUBLE END AS baseline FROM bo""")

#: Proofs as they stand at the end of January 2024; each decision carries its own.
NOW_US, LIVE, BAR = 1_706_486_400_000_000, {"conf_min": 0.95, "window": "5m"}, 0.95
_AT = "concat('2024-0', {0}, '-', lpad(CAST(1 + alert_id % 28 AS STRING), 2, '0'), 'T0', alert_id % 10, ':30:00', CASE alert_id % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '+02:00' ELSE '-05:30' END)"
_PROOF = {
    "trained_at": f"CASE WHEN alert_id % 31 = 0 THEN 'soon' WHEN alert_id % 29 = 0 THEN '2024-01-28T00:00:00' ELSE {_AT.format(1)} END",
    "issued_by": "CASE WHEN alert_id % 23 = 0 THEN 'ana' WHEN alert_id % 23 = 1 THEN 'run 1/v2' WHEN alert_id % 23 > 2 THEN concat('run-', user_id, '/v1') END",
    "days": "k % 60", "model": "CASE WHEN alert_id % 19 > 0 THEN 'm1' END", "pipeline": "CASE WHEN alert_id % 17 = 0 THEN 'p0' ELSE 'p1' END",
    "threshold": "CASE WHEN alert_id % 13 = 0 THEN CAST(0.8 AS DOUBLE) WHEN alert_id % 13 = 1 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.95 AS DOUBLE) END",
    "second": "CASE WHEN alert_id % 11 = 0 THEN 'ana' WHEN alert_id % 11 = 1 THEN '' WHEN alert_id % 11 > 2 THEN 'ben' END",
    "due_at": f"CASE WHEN alert_id % 37 = 0 THEN 'later' ELSE {_AT.format('CASE WHEN k % 3 = 0 THEN 1 ELSE 2 END')} END",
    "digest": f"CASE WHEN alert_id % 7 = 0 THEN 'edited' ELSE '{freshness.config_hash(LIVE)}' END",
    "banned": "user_id % 41 = 0", "pending": "k % 5 = 0", "migration_until": "CASE WHEN user_id % 3 = 0 THEN '2024-02-15' WHEN user_id % 3 = 1 THEN '2024-01-15T12:00:00' END",
}


def proofs(d: DataFrame) -> DataFrame:
    rows = d.select("alert_id", "fingerprint", *[F.expr(e).alias(c) for c, e in _PROOF.items()])
    rows = freshness.with_drift(rows, d.where("became_sev12 = 1 AND k >= 95").select("fingerprint", F.concat(F.lit("inc-"), "alert_id").alias("incident")), d.where("alert_id % 97 = 0"))
    both, now = F.array(F.lit("ana"), F.col("second")), F.lit(NOW_US)
    fit = freshness.fit_leg(F.struct("trained_at", "issued_by", F.col("days").alias("valid_days"), "model", "pipeline"), now, "m1", "p1")
    bar = freshness.threshold_leg(F.struct("threshold", both.alias("attested_by"), "due_at", F.col("digest").alias("config_hash")), now, LIVE, BAR)
    entry = freshness.entry_leg(F.struct("banned", "pending", both.alias("attested_by"), F.col("trained_at").alias("attested_at"), F.col("days").alias("ttl_days"), "incident", "rewritten"), now, F.col("migration_until"))
    legs = rows.select("alert_id", fit.alias("fit"), bar.alias("bar"), entry.alias("entry"))
    return legs.select("alert_id", F.col("fit.reason").alias("fit"), F.col("bar.reason").alias("threshold"), F.col("entry.reason").alias("entry"), F.array_join(freshness.stale_reasons(F.col("fit"), F.col("bar"), F.col("entry")), "|").alias("stale"))


over_decisions("freshness_legs", proofs, ", p AS (SELECT alert_id, fingerprint, " + ", ".join(f"{e} AS {c}" for c, e in _PROOF.items()) + f""" FROM d),
 t AS (SELECT *, CASE WHEN regexp_matches(trained_at, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$') THEN epoch_us(TRY_CAST(trained_at AS TIMESTAMPTZ)) END AS made, epoch_us(TRY_CAST(due_at AS TIMESTAMPTZ)) AS due, greatest(days, 1) * {DAY} AS span FROM p),
 l AS (SELECT alert_id, CASE WHEN made IS NULL THEN 'invalid fit_trained_at' WHEN alert_id % 23 < 3 THEN 'invalid issued_by' WHEN {NOW_US} > made + span THEN 'fit TTL expired' WHEN model IS NULL THEN 'model_pin mismatch' WHEN pipeline <> 'p1' THEN 'label pipeline drift' END AS fit,
  CASE WHEN threshold < 0.85 THEN 'below conf floor' WHEN alert_id % 11 < 3 THEN 'not two operators' WHEN due IS NULL THEN 'invalid revalidation_due_at' WHEN {NOW_US} > due THEN 'revalidation clock lapsed' WHEN threshold <> 0.95 THEN 'threshold is not the live bar' WHEN digest = 'edited' THEN 'config_hash mismatch' END AS threshold,
  CASE WHEN banned THEN 'security category banned' WHEN pending AND coalesce(migration_until, '') <> '2024-02-15' THEN 're-attestation pending' WHEN alert_id % 11 < 3 THEN 'not two people' WHEN made IS NULL THEN 'invalid attested_at' WHEN {NOW_US} > made + span THEN 'entry TTL expired'
   WHEN fingerprint IN (SELECT fingerprint FROM d WHERE became_sev12 = 1 AND k >= 95) THEN 'incident linkage' WHEN fingerprint IN (SELECT fingerprint FROM d WHERE alert_id % 97 = 0) THEN 'drift check failed' END AS entry FROM t)
 SELECT alert_id, fit, threshold, entry, concat_ws('|', 'lock1_stale: ' || fit, 'lock2_stale: ' || threshold, 'lock3_stale: ' || entry) AS stale FROM l""")
