"""The correlator: change windows, duplicates, episodes and adaptive storms of an estate, folded in order of arrival.

Fold is the state of one estate. Batch runs sort each estate's rows by time, so a task
streams through them and holds the state alone, not the rows; the streaming form keeps
the state between micro-batches. Estates are independent, so they are what Spark deals
out; within one the semantics are sequential by definition.

Input is what `events` makes: alerts, resolves and verdicts as rows of one table. Rows
without estate or time take no part. A null fingerprint counts as empty, a null service
as `unknown`, a null severity as none. Equal rows are each an alert; of rows of one time
the lower seq comes first, then alerts, resolves, verdicts.
"""

from __future__ import annotations

import json
import pickle
from collections import Counter, deque

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import windows as trailing

#: Seconds: dedup window, storm window, freshness of episodes and of what was observed, least tick, freeze after a storm, age of labels, between pages of a service; floor and multiplier of storms.
DEDUP_S, STORM_S, FRESH_S, TICK_S, FREEZE_S, LABEL_S, PAGE_S = 300.0, 60.0, 259_200.0, 60.0, 300.0, 900.0, 300.0
FLOOR, MULTIPLIER, ALPHA = 20, 5.0, 1 - 2 ** (-60 / 21_600)
#: Seconds of a cold start and of each of its samples, the least samples that teach, and the baseline that counts as already learned.
START_S, SAMPLE_S, LEAST_SAMPLES, LEARNED = 1_800.0, 60.0, 5, 0.01
#: Who may close an episode.
AUTHORITIES = ["operator_resolve", "verified_resolve"]
RESULT = "estate string, alert_id long, kind string, anchor_id long, storm_size long, flap_count long, prior string, novel boolean, paged boolean, storm_services string"
EVENT = "estate string, at_us long, seq long, what string, fingerprint string, service string, held boolean, labels_us long, said string"
OUT = pa.schema([("estate", pa.string()), ("alert_id", pa.int64()), ("kind", pa.string()), ("anchor_id", pa.int64()), ("storm_size", pa.int64()), ("flap_count", pa.int64()), ("prior", pa.string()), ("novel", pa.bool_()), ("paged", pa.bool_()), ("storm_services", pa.string())])
NEVER = float("-inf")


class Seen:
    """A fingerprint's alert that later ones repeat."""

    __slots__ = ("first", "last", "anchor", "service", "prior")

    def __init__(self, at: float, anchor: int, service: str):
        self.first = self.last = at
        self.anchor, self.service, self.prior = anchor, service, None


class Episode:
    __slots__ = ("last", "open", "flaps")

    def __init__(self, at: float):
        self.last, self.open, self.flaps = at, True, 0


class Fold:
    def __init__(self, floor: int = FLOOR, multiplier: float = MULTIPLIER):
        self.floor, self.multiplier = floor, multiplier
        self.seen: dict[str, Seen] = {}
        self.episodes: dict[str, Episode] = {}
        self.observed: dict[str, float] = {}
        # (time, fingerprint) in order of time: what may expire next
        self.seen_at, self.episodes_at, self.observed_at, self.window = deque(), deque(), deque(), deque()
        self.in_window: Counter = Counter()
        self.paged_at: dict[str, float] = {}
        self.storm_until = self.last_storm = self.last_tick = NEVER
        self.baseline = 0.0
        self.start: float | None = None
        self.started, self.sample_from, self.sample, self.samples = False, NEVER, set(), []

    def expire(self, now: float) -> None:
        while self.window and self.window[0][0] < now - STORM_S:
            fingerprint = self.window.popleft()[1]
            self.in_window[fingerprint] -= 1
            if not self.in_window[fingerprint]:
                del self.in_window[fingerprint]
        for queue, kept, last, span in (
            (self.seen_at, self.seen, lambda s: s.last, DEDUP_S),
            (self.episodes_at, self.episodes, lambda e: e.last, FRESH_S),
            (self.observed_at, self.observed, lambda t: t, FRESH_S),
        ):
            while queue and queue[0][0] < now - span:
                fingerprint = queue.popleft()[1]
                if fingerprint in kept and last(kept[fingerprint]) < now - span:
                    del kept[fingerprint]

    def learn(self, now: float, fingerprint: str) -> None:
        """The cold start: distinct fingerprints by minute, whatever becomes of the alerts, give the first baseline."""
        if self.start is None:
            self.start = self.sample_from = now
        if self.started:
            return
        if now - self.sample_from >= SAMPLE_S:
            if self.sample:
                self.samples.append(len(self.sample))
            self.sample, self.sample_from = set(), now
        self.sample.add(fingerprint)
        if now - self.start >= START_S:
            self.started = True
            n, median = len(self.samples), lambda of: sorted(of)[len(of) // 2]
            if self.baseline <= LEARNED and n >= LEAST_SAMPLES:
                split = [min(2, int((i + 0.5) * 3 / n)) < 2 for i in range(n)]
                early, late = ([w for w, first in zip(self.samples, split) if first is side] for side in (True, False))
                incident = median(early) < self.floor <= median(late)
                if not incident and median(self.samples) >= self.floor:
                    self.baseline = float(median(self.samples))
            self.sample, self.samples = set(), []

    def tick(self, now: float) -> None:
        if now - self.last_tick >= TICK_S:
            if now - self.last_storm >= FREEZE_S:
                self.baseline += ALPHA * (len(self.in_window) - self.baseline)
            self.last_tick = now

    def ingest(self, now: float, alert_id: int, fingerprint: str, service: str, held: bool = False, labels: float | None = None) -> tuple:
        """(kind, anchor, storm size, flap count, prior, novel, paged, services of the storm) of one alert; held: a change window holds it; labels: time of its labels, if known."""
        self.learn(now, fingerprint)
        self.expire(now)
        novel = fingerprint not in self.observed and fingerprint not in self.episodes
        self.observed[fingerprint] = now
        self.observed_at.append((now, fingerprint))
        if labels is not None and now - labels > LABEL_S:
            paged = now - self.paged_at.get(service, NEVER) >= PAGE_S
            if paged:
                self.paged_at[service] = now
            return "label_stale", alert_id, 0, 0, None, False, paged, None
        return self.classify(now, alert_id, fingerprint, service, held, novel)

    def classify(self, now: float, alert_id: int, fingerprint: str, service: str, held: bool, novel: bool) -> tuple:
        plain = lambda kind, anchor=alert_id, flaps=0, prior=None: (kind, anchor, 0, flaps, prior, novel, False, None)
        if held:
            return plain("change_window")
        episode, had = self.episodes.get(fingerprint), self.seen.get(fingerprint)
        if episode and episode.open and had and now - had.first <= DEDUP_S:
            had.last = now
            self.seen_at.append((now, fingerprint))
            return plain("duplicate", had.anchor, episode.flaps, had.prior)
        if now < self.storm_until:
            return plain("storm")
        kind = "new"
        if episode is None:
            episode = self.episodes[fingerprint] = Episode(now)
        elif not episode.open:
            kind, episode.open, episode.flaps = "reopened", True, episode.flaps + 1
            if had:
                had.prior = None
        episode.last = now
        self.episodes_at.append((now, fingerprint))
        self.tick(now)
        self.window.append((now, fingerprint))
        self.in_window[fingerprint] += 1
        size = len(self.in_window)
        if size >= max(self.floor, self.multiplier * self.baseline):
            self.storm_until, self.last_storm = now + STORM_S, now
            services = Counter(self.seen[f].service if f in self.seen else "unknown" for f in self.in_window)
            return "storm_start", alert_id, size, episode.flaps, None, novel, False, json.dumps(services, sort_keys=True)  # not recorded as seen
        self.seen[fingerprint] = Seen(now, alert_id, service)
        self.seen_at.append((now, fingerprint))
        return plain(kind, flaps=episode.flaps)

    def resolve(self, fingerprint: str) -> bool:
        """Closes an open episode; what it said to duplicates goes with it. Silence never closes one."""
        episode = self.episodes.get(fingerprint)
        if episode is None or not episode.open:
            return False
        episode.open = False
        if fingerprint in self.seen:
            self.seen[fingerprint].prior = None
        return True

    def verdict(self, fingerprint: str, said: str) -> None:
        if fingerprint in self.seen:
            self.seen[fingerprint].prior = said

    def take(self, at_us: int, seq: int, what: str, fingerprint: str | None, service: str | None, held: bool | None, labels_us: int | None, said: str | None) -> tuple | None:
        """One row of `events`; alerts give a row, resolves and verdicts none."""
        fingerprint = fingerprint or ""
        if what == "alert":
            return self.ingest(at_us / 1e6, seq, fingerprint, service or "unknown", bool(held), None if labels_us is None else labels_us / 1e6)
        if what == "verdict":
            self.verdict(fingerprint, said)
        elif what == "resolve" and said in AUTHORITIES:
            self.resolve(fingerprint)
        return None


def events(alerts: DataFrame, resolves: DataFrame | None = None, verdicts: DataFrame | None = None) -> DataFrame:
    """One table of what an estate's fold takes: alerts (alert_id, and held and labels_us if they have them), resolves (seq, authority; any other authority than AUTHORITIES closes nothing) and verdicts (seq, action), all with estate, at_us and fingerprint."""
    has = lambda name, type_: F.col(name).cast(type_) if name in alerts.columns else F.lit(None).cast(type_)
    none = lambda type_: F.lit(None).cast(type_)
    out = alerts.select("estate", "at_us", F.col("alert_id").alias("seq"), F.lit("alert").alias("what"), "fingerprint", "service", has("held", "boolean").alias("held"), has("labels_us", "long").alias("labels_us"), none("string").alias("said"))
    for rows, what, said in ((resolves, "resolve", "authority"), (verdicts, "verdict", "action")):
        if rows is not None:
            out = out.union(rows.select("estate", "at_us", "seq", F.lit(what), "fingerprint", none("string"), none("boolean"), none("long"), F.col(said)))
    return out.where("estate is not null and at_us is not null")


def hold(alerts: DataFrame, change_windows: DataFrame) -> DataFrame:
    """alerts with held: whether a change window (service or `*`, begin_us, end_us) holds them. Alert ids must be unique."""
    inside = trailing.in_change_window(alerts, change_windows).select("alert_id", F.lit(True).alias("held"))
    return alerts.join(inside, "alert_id", "left")


def correlate(alerts: DataFrame, resolves: DataFrame | None = None, verdicts: DataFrame | None = None) -> DataFrame:
    """Batch: each estate's rows, sorted, through one fold; a task holds a batch of rows and the state."""

    def run(batches):
        estate, fold = None, None
        for batch in batches:
            rows, out = batch.to_pydict(), []
            for who, *row in zip(*rows.values()):
                if who != estate:
                    estate, fold = who, Fold()
                found = fold.take(*row)
                if found:
                    out.append((who, row[1], *found))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), OUT)], schema=OUT)

    rows = events(alerts, resolves, verdicts).select(*[c.split()[0] for c in EVENT.split(", ")])
    return rows.repartition("estate").sortWithinPartitions("estate", "at_us", "seq", "what").mapInArrow(run, RESULT)


def correlate_stream(rows: DataFrame) -> DataFrame:
    """Streaming: the same fold as state of each estate; micro-batches are the order of arrival. rows: a stream of alerts, or of `events`."""

    def step(key, parts, state):
        fold = pickle.loads(state.get[0]) if state.exists else Fold()
        whole = pd.concat(list(parts)).sort_values(["at_us", "seq", "what"], kind="stable")
        whole = whole[["at_us", "seq", "what", "fingerprint", "service", "held", "labels_us", "said"]].astype(object)
        out = []
        for row in whole.where(whole.notna(), None).itertuples(index=False, name=None):
            found = fold.take(*row)
            if found:
                out.append((key[0], row[1], *found))
        state.update((pickle.dumps(fold),))
        yield pd.DataFrame(out, columns=OUT.names)

    rows = rows if "what" in rows.columns else events(rows)
    return rows.groupBy("estate").applyInPandasWithState(step, RESULT, "fold binary", "append", "NoTimeout")
