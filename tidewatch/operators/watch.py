"""Monitors over decisions: bands, rates, ladders of budgets, spend and the outbox's schedule."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import asof, ladder

#: Seconds to the next attempt, by attempts made; the last one goes on.
BACKOFF_S = [5, 15, 45, 120, 300, 900, 1800, 1800]


def band_trips(decided: DataFrame, baselines: DataFrame, window_us: int, least: int = 30, cap: float = 0.5) -> DataFrame:
    """Per policy and tumbling window: suppression rate against the signed baseline's band; `trip` names why, null if in band."""
    by = decided.groupBy("policy_id", F.floor(F.col("at_us") / window_us).alias("window")).agg(F.count("*").alias("n"), F.count_if(F.col("action") == "suppress").alias("k"))
    rows = by.join(baselines, "policy_id").withColumn("rate", F.col("k") / F.col("n"))
    dev = F.abs(F.col("rate") - F.col("expected")) / F.greatest(F.col("sigma"), F.lit(1e-9))
    trip = F.when(F.col("n") < least, None).when(F.col("rate") > cap, "absolute_guardrail").when(dev > F.when(F.col("review_due"), 2.0).otherwise(3.0), F.when(F.col("review_due"), "review_due_drift").otherwise("slo_band"))
    return rows.select("policy_id", "window", "n", "k", F.round("rate", 6).alias("rate"), trip.alias("trip"))


def page_rate(decided: DataFrame, budget: float, span_us: int = 300_000_000) -> DataFrame:
    """Each decision with its estate's pages a minute over the trailing span (both ends count), and whether they are over the budget. Passing through is paging."""
    rows = decided.select("estate", F.col("alert_id").alias("seq"), "at_us", F.coalesce(F.col("action").isin(*ladder.PAGES).cast("int"), F.lit(0)).alias("page"))
    counted = ladder.trailing(rows, "estate", span_us, {"pages": "page"})
    rate = F.col("pages") / F.lit(span_us / 60_000_000)
    return counted.select("estate", F.col("seq").alias("alert_id"), "pages", (rate > budget).alias("over"))


#: Rank of severity labels; unknown ones come last. Seconds in which a fingerprint that has paged does not page again.
SEVERITY_RANK = {"critical": 0, "p1": 0, "high": 1, "p2": 1, "medium": 2, "p3": 2, "low": 3, "p4": 3, "info": 4}
LAST_RANK, PAGED_AGAIN_US = 5, 300_000_000


def severity_rank(severity: Column) -> Column:
    label = F.lower(F.trim(F.coalesce(severity, F.lit(""))))
    return F.coalesce(*[F.when(label == s, r) for s, r in SEVERITY_RANK.items()], F.lit(LAST_RANK))


class Budget:
    """The third step's admission over one activation: who pages within the minute's budget, and who is held.

    Critical alerts may use the whole budget, others a share of it. Within a class an alert
    pages if fewer held ones rank ahead of it than pages are left: graver first, then the
    larger level shift, then who has been held longest.
    """

    def __init__(self, per_minute: int, share: float = 0.5, most: int = 10_000):
        self.cap, self.other_cap, self.most = per_minute, int(per_minute * share), most
        self.paged: dict[str, int] = {}
        self.tokens: deque = deque()
        self.held: dict[str, list] = {}  # fingerprint: key in rank, class, whether it has paged
        self.waiting: dict[bool, list] = {True: [], False: []}  # keys in rank of those that have not

    def _drop(self, entry: list) -> None:
        if not entry[2]:
            keys = self.waiting[entry[1]]
            del keys[bisect_left(keys, entry[0])]

    def hold(self, at: int, fingerprint: str, severity: str, z: float) -> list:
        entry = self.held.get(fingerprint)
        if entry is None:
            if len(self.held) >= self.most:
                oldest = next(iter(self.held))  # entries come in order of time
                self._drop(self.held.pop(oldest))
            entry = self.held[fingerprint] = [(SEVERITY_RANK.get(severity, LAST_RANK), -z, at, fingerprint), severity in ("critical", "p1"), False]
            insort(self.waiting[entry[1]], entry[0])
        elif entry[0][1] != -z:
            self._drop(entry)
            entry[0] = (entry[0][0], -z, *entry[0][2:])
            if not entry[2]:
                insort(self.waiting[entry[1]], entry[0])
        return entry

    def admit(self, at: int, fingerprint: str, severity: str | None, z: float | None) -> bool:
        label, last = (severity or "").strip().lower(), self.paged.get(fingerprint)
        entry = self.hold(at, fingerprint, label, z or 0.0)
        if last is not None and at - last < PAGED_AGAIN_US:
            return False
        while self.tokens and self.tokens[0][0] < at - 60_000_000:
            self.tokens.popleft()
        critical = label in ("critical", "p1")
        left = self.cap - len(self.tokens)
        if not critical:
            left = min(left, self.other_cap - sum(not c for _, c in self.tokens))
        keys = self.waiting[critical]
        if left <= 0 or bisect_left(keys, entry[0]) >= left:
            return False
        self._drop(entry)
        entry[2] = True
        self.tokens.append((at, critical))
        self.paged[fingerprint] = at
        return True


def rate_capped(rows: DataFrame, per_minute: int, share: float = 0.5) -> DataFrame:
    """estate, alert_id and state (`sent`, `held`) of the alerts of each activation of the third step.

    rows: estate, activation, alert_id, at_us, fingerprint, severity_in, z. An activation starts anew,
    so it is the unit that is folded; a null z is 0.
    """

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("at_us", "ascending"), ("alert_id", "ascending")])
        budget = Budget(per_minute, share)
        sent = [budget.admit(r["at_us"], r["fingerprint"], r["severity_in"], r["z"]) for r in part.to_pylist()]
        return pa.table({"estate": part["estate"], "alert_id": part["alert_id"], "state": pa.array(["sent" if s else "held" for s in sent], pa.string())})

    return rows.select("estate", "activation", "alert_id", "at_us", "fingerprint", "severity_in", "z").groupBy("estate", "activation").applyInArrow(run, "estate string, alert_id long, state string")


def digest(held: DataFrame, top: int) -> DataFrame:
    """Of each estate the top fingerprints of held alerts (estate, fingerprint, alert_id, at_us, severity_in, z): by severity as first held, level shift as last seen, time of the first and fingerprint."""
    first, last = F.struct("at_us", "alert_id"), F.struct("at_us", "alert_id")
    by = held.groupBy("estate", "fingerprint").agg(F.count("*").alias("n"), F.min_by("severity_in", first).alias("severity_in"), F.max_by(F.coalesce("z", F.lit(0.0)), last).alias("z"), F.min("at_us").alias("since_us"), F.max_by("alert_id", last).alias("alert_id"))
    order = Window.partitionBy("estate").orderBy(severity_rank(F.col("severity_in")), F.col("z").desc(), "since_us", "fingerprint")
    return by.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def canary(observed: DataFrame, every: int) -> DataFrame:
    """Every every-th observation (estate, seq, at_us, step) of an estate while it is degraded; the count goes on over all its time."""
    return asof.running(observed.where("step > 0").select("estate", "seq", "at_us", "step"), "estate").where(F.col("nth") % every == 0)


def daily_caps(costs: DataFrame, cap: float) -> DataFrame:
    """estate, alert_id, admitted and spent (of the day, this one included if admitted) of each call in order of time.

    A call that would pass the cap is refused and costs nothing, so a later, cheaper one may still be
    admitted; which are depends on all before, so an estate's day is folded as one.
    """

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("at_us", "ascending"), ("alert_id", "ascending")])
        spent, admitted, so_far = 0, [], []
        for cost in part["cost"].to_pylist():
            fits = spent + cost <= cap
            spent += cost if fits else 0
            admitted.append(fits), so_far.append(spent)
        return pa.table({"estate": part["estate"], "alert_id": part["alert_id"], "admitted": pa.array(admitted, pa.bool_()), "spent": pa.array(so_far, pa.float64())})

    day = costs.select("estate", "alert_id", "at_us", F.coalesce(F.col("cost").cast("double"), F.lit(0.0)).alias("cost"), F.floor(F.col("at_us") / 86_400_000_000).alias("day"))
    return day.groupBy("estate", "day").applyInArrow(run, "estate string, alert_id long, admitted boolean, spent double")


def retry_delay(attempt: Column, error: Column, retry_after: Column, floor_s: int = 60) -> Column:
    """Seconds to the next attempt without jitter; a rate limit waits for what the vendor asks, floor_s at least."""
    base = F.get(F.array(*[F.lit(s) for s in BACKOFF_S]), F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(len(BACKOFF_S) - 1)).cast("int"))
    return F.when(error == "rate_limited", F.greatest(base, F.lit(floor_s), F.coalesce(retry_after, F.lit(0)))).otherwise(base)


def due(outbox: DataFrame, now_us: int, limit: int) -> DataFrame:
    """Queued rows whose time has come and whose lease is free, by priority and age."""
    ready = (F.col("status") == "queued") & (F.col("next_us") <= now_us) & (F.coalesce("lease_us", F.lit(0)) <= now_us)
    return outbox.where(ready).orderBy(F.col("priority").desc(), "next_us", "alert_id").limit(limit)


def expired_mutes(log: DataFrame, now_us: int) -> DataFrame:
    """Applied mutes past their end that no expiry names."""
    return log.where((F.col("type") == "applied") & (F.col("until_us") <= now_us)).select("seq", "fingerprint").join(log.where("type = 'expired'").select(F.col("applied_seq").alias("seq")), "seq", "left_anti")


#: Decisions a window needs, and what a baseline that does not say has.
LEAST_DECISIONS, BAND_SIGMAS, REVIEW_SIGMAS, MOST_SUPPRESSED = 30, 3.0, 2.0, 0.5


def trips(decided: DataFrame, baselines: DataFrame, windows_us: list[int]) -> DataFrame:
    """Each decision of a policy with a baseline: suppressions of the trailing window (both ends count), and `trip`, why the rate is out of band (null: it is not).

    decided: policy_id, seq, at_us, action. baselines: one row a policy, with window_us (one of windows_us), expected,
    sigma, signed_by, review_due, and if it says band_sigmas, review_sigmas and most. A baseline that fewer than two
    different people signed is none. A rate over the most is out whatever the band; a review that is due narrows it.
    """
    signed = baselines.where(F.size(F.array_distinct(F.array_compact("signed_by"))) >= 2)
    rows = decided.where("policy_id is not null and at_us is not null").select("policy_id", "seq", "at_us", F.coalesce((F.col("action") == "suppress").cast("int"), F.lit(0)).alias("quiet"))
    has = lambda c, otherwise: F.coalesce(F.col(c), F.lit(otherwise)) if c in baselines.columns else F.lit(otherwise)
    out = None
    for span in windows_us:
        mine = signed.where(F.col("window_us") == span)
        counted = ladder.trailing(rows.join(mine.select("policy_id"), "policy_id", "left_semi").withColumn("one", F.lit(1)), "policy_id", span, {"n": "one", "k": "quiet"})
        rate = F.col("k") / F.col("n")
        off = F.abs(rate - F.col("expected")) / F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(1e-9)
        due = F.coalesce(F.col("review_due"), F.lit(False))
        trip = F.when(F.col("n") < LEAST_DECISIONS, None).when(rate > has("most", MOST_SUPPRESSED), "absolute_guardrail").when(due & (off > has("review_sigmas", REVIEW_SIGMAS)), "review_due_drift").when(~due & (off > has("band_sigmas", BAND_SIGMAS)), "slo_band")
        part = counted.join(mine, "policy_id").select("policy_id", "seq", "at_us", "n", "k", trip.alias("trip"))
        out = part if out is None else out.unionByName(part)
    return out
