"""The degradation ladder of an estate: four steps, entered and left on trailing rates, with dwell times and holds.

An observation is a decision: what the vendor did and which action came of it. After
each, the step may change once. A step is left when it has lasted dwell_us (a stale
policy does not wait), on conditions that must partly have held without a break.

Batch: trailing sums are windows over (estate, bucket of time). The machine itself is
run by segments of time, all at once: a segment maps the state it is entered with to
the state it is left with, and as only the age of a step and of a hold matters, and only
up to dwell and hold, nearly all segments are entered in one of four states (a step,
long entered, nothing held). Those are tried first; where a segment is left in another
state, the next one is run from that state too, until each state that a segment is left
in has been run. What remains is a composition of small maps, first within blocks of
segments, then over blocks. So no task folds all of an estate's history, and the result
is that of the fold, observation by observation.

Streaming: Fold is the state of one estate between micro-batches.

Nulls: rows without estate, at_us or seq take no part; a null vendor_outcome is no
sample, a null action no page, a null backlog none, a null policy_until_us no bound.
Observations are in order of at_us, then seq; rows equal in both are in no order and
should not occur. An empty table has no transitions.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidewatch.operators.tables import stored

MINUTE = 60_000_000
#: What counts as a sample of the vendor's health, and what as a page.
UNHEALTHY, HEALTHY = ["timer_win", "unhealthy_error"], ["answered"]
PAGES = ["page_now", "page_business_hours", "passthrough"]


@dataclass(frozen=True)
class Rules:
    """Bounds of the ladder; times in microseconds."""

    enter_rate: float = 0.25
    health_us: int = 15 * MINUTE
    min_decisions: int = 30
    dwell_us: int = 10 * MINUTE
    exit_hold_us: int = 10 * MINUTE
    pages_per_minute: float = 60.0
    pressure_us: int = 5 * MINUTE
    pressure_times: float = 3.0
    backlog: int = 1000


TRANSITION = "estate string, at_us long, seq long, from_step int, to_step int, cause string"


class Fold:
    """One estate, observation by observation."""

    def __init__(self, rules: Rules, started_us: int):
        self.rules, self.step, self.entered = rules, 0, started_us
        self.health: deque = deque()
        self.bad = 0
        self.pages: deque = deque()
        self.since: dict[str, int] = {}

    def held(self, name: str, condition: bool, hold_us: int, at: int) -> bool:
        if not condition:
            self.since.pop(name, None)
            return False
        return at - self.since.setdefault(name, at) >= hold_us

    def observe(self, at: int, outcome: str | None, action: str | None, backlog: int | None = None, policy_until: int | None = None) -> tuple[int, int, str] | None:
        """(from, to, cause) if the step changes."""
        r = self.rules
        if outcome in UNHEALTHY or outcome in HEALTHY:
            self.health.append((at, outcome in UNHEALTHY))
            self.bad += outcome in UNHEALTHY
        if action in PAGES:
            self.pages.append(at)
        while self.health and self.health[0][0] < at - r.health_us:
            self.bad -= self.health.popleft()[1]
        while self.pages and self.pages[0] < at - r.pressure_us:
            self.pages.popleft()
        n, rate = len(self.health), self.bad / len(self.health) if self.health else 0.0
        paging = len(self.pages) / (r.pressure_us / MINUTE)
        fresh = policy_until is None or at <= policy_until
        over, dwelt = paging > r.pages_per_minute, at - self.entered >= r.dwell_us
        to, cause = None, ""
        if self.step == 0 and dwelt:
            if n >= r.min_decisions and rate > r.enter_rate:
                to, cause = 1, "timer_win_rate"
            elif paging > r.pressure_times * r.pages_per_minute:
                to, cause = 3, "page_pressure"
        elif self.step == 1:
            if not fresh:
                to, cause = 2, "policy_stale"
            elif dwelt and over:
                to, cause = 2, "page_rate"
            elif dwelt and self.held("recover", n >= r.min_decisions and rate < r.enter_rate / 2 and not over, r.exit_hold_us, at):
                to, cause = 0, "recovered"
        elif self.step == 2 and dwelt:
            if self.held("up", over or (backlog or 0) >= r.backlog, r.pressure_us, at):
                to, cause = 3, "sustained_pressure"
            elif fresh and self.held("down", not over, r.exit_hold_us, at):
                to, cause = 1, "pressure_over"
        elif self.step == 3 and dwelt and self.held("down", not over, r.exit_hold_us, at):
            to, cause = 2, "pressure_over"
        if to is None:
            return None
        was, self.step, self.entered, self.since = self.step, to, at, {}
        return was, to, cause


# Signals: what an observation finds in its trailing windows, as bits.
HOT, PRESSED, OVER, CALM, FULL, FRESH = (1 << k for k in range(6))


def trailing(rows: DataFrame, key: str, span_us: int, sums: dict[str, str]) -> DataFrame:
    """rows with a column for each of sums: the sum of an expression over rows of the key from at_us - span_us up to this row, in order of at_us and seq.

    A row goes to its own bucket of time and the next one, so windows run over (key, bucket).
    """
    spread = rows.withColumn("late", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("bucket", F.floor(F.col("at_us") / span_us) + F.col("late"))
    upto = Window.partitionBy(key, "bucket").orderBy("at_us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key, "bucket").orderBy("at_us").rangeBetween(Window.unboundedPreceding, -span_us - 1)
    out = spread.withColumns({name: F.sum(F.expr(e)).over(upto) - F.coalesce(F.sum(F.expr(e)).over(before), F.lit(0)) for name, e in sums.items()})
    return out.where("late = 0").drop("late", "bucket")


def signals(observations: DataFrame, rules: Rules) -> DataFrame:
    """estate, seq, at_us and bits. observations: estate, seq, at_us, vendor_outcome, action, and if they have them backlog and policy_until_us."""
    has = lambda c, kind: F.col(c) if c in observations.columns else F.lit(None).cast(kind)
    sample = F.col("vendor_outcome").isin(*UNHEALTHY)
    rows = observations.where("estate is not null and at_us is not null and seq is not null").select(
        "estate", "seq", "at_us",
        F.coalesce(sample.cast("int"), F.lit(0)).alias("bad"),
        F.coalesce((sample | F.col("vendor_outcome").isin(*HEALTHY)).cast("int"), F.lit(0)).alias("asked"),
        F.coalesce(F.col("action").isin(*PAGES).cast("int"), F.lit(0)).alias("page"),
        (F.coalesce(has("backlog", "long"), F.lit(0)) >= rules.backlog).alias("full"),
        F.coalesce(F.col("at_us") <= has("policy_until_us", "long"), F.lit(True)).alias("fresh"),
    )
    rows = trailing(trailing(rows, "estate", rules.health_us, {"n_bad": "bad", "n": "asked"}), "estate", rules.pressure_us, {"n_pages": "page"})
    rate = F.when(F.col("n") > 0, F.col("n_bad") / F.col("n")).otherwise(0.0)
    paging = F.col("n_pages") / F.lit(rules.pressure_us / MINUTE)
    enough, over = F.col("n") >= rules.min_decisions, paging > rules.pages_per_minute
    said = {HOT: enough & (rate > rules.enter_rate), PRESSED: paging > rules.pressure_times * rules.pages_per_minute, OVER: over, CALM: enough & (rate < rules.enter_rate / 2) & ~over, FULL: F.col("full"), FRESH: F.col("fresh")}
    bits = sum((F.when(c, b).otherwise(0) for b, c in said.items()), F.lit(0))
    return rows.select("estate", "seq", "at_us", bits.alias("bits"))


class Hold:
    """A condition over the observations at which it is looked at: when it has held long enough."""

    def __init__(self, at: np.ndarray, looked: np.ndarray, condition: np.ndarray, hold_us: int):
        self.where = np.flatnonzero(looked)
        self.at, self.hold = at[self.where], hold_us
        on = condition[self.where].astype(np.int8)
        edge = np.diff(on, prepend=0, append=0)
        self.begin, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    def first(self, start: int, since: int | None) -> tuple[int | None, int | None]:
        """(first observation from start on at which the condition has held, since when it holds at the end if there is none)."""
        k = int(np.searchsorted(self.where, start))
        if k == len(self.where):
            return None, since
        for run in range(int(np.searchsorted(self.end, k, "right")), len(self.begin)):
            b = max(int(self.begin[run]), k)
            from_us = since if since is not None and b == k else int(self.at[b])
            j = max(int(np.searchsorted(self.at, from_us + self.hold)), b)
            if j < self.end[run]:
                return int(self.where[j]), None
            if self.end[run] == len(self.where):
                return None, from_us
        return None, None


#: A step, when it was entered, and since when its conditions up and down (or recover) hold.
State = tuple[int, int, int | None, int | None]


class Segment:
    """A stretch of an estate's observations, by which any state can be moved on."""

    def __init__(self, at: np.ndarray, bits: np.ndarray, rules: Rules):
        self.at, self.rules = at, rules
        on = lambda b: (bits & b) > 0
        always, over, fresh = np.ones(len(at), bool), on(OVER), on(FRESH)
        self.hot, self.start = on(HOT), np.flatnonzero(on(HOT) | on(PRESSED))
        self.stale, self.over = np.flatnonzero(~fresh), np.flatnonzero(over)
        self.recover = Hold(at, always, on(CALM), rules.exit_hold_us)
        self.up = Hold(at, always, over | on(FULL), rules.pressure_us)
        self.down_if_fresh = Hold(at, fresh, ~over, rules.exit_hold_us)
        self.down = Hold(at, always, ~over, rules.exit_hold_us)

    @staticmethod
    def next(found: np.ndarray, start: int) -> int | None:
        k = np.searchsorted(found, start)
        return int(found[k]) if k < len(found) else None

    def move(self, state: State, i: int) -> tuple[tuple[int, int, str] | None, State]:
        """The first transition from observation i on as (observation, to, cause), or else the state at the end."""
        step, entered, up, down = state
        dwelt = max(i, int(np.searchsorted(self.at, entered + self.rules.dwell_us)))
        found: list[tuple[int, int, str]] = []  # in order of precedence

        def add(j: int | None, to: int, cause: str) -> None:
            if j is not None:
                found.append((j, to, cause))

        if step == 0:
            j = self.next(self.start, dwelt)
            if j is not None:
                add(j, *((1, "timer_win_rate") if self.hot[j] else (3, "page_pressure")))
        elif step == 1:
            add(self.next(self.stale, i), 2, "policy_stale")
            add(self.next(self.over, dwelt), 2, "page_rate")
            j, down = self.recover.first(dwelt, down)
            add(j, 0, "recovered")
        elif step == 2:
            j, up = self.up.first(dwelt, up)
            add(j, 3, "sustained_pressure")
            j, down = self.down_if_fresh.first(dwelt, down)
            add(j, 1, "pressure_over")
        else:
            j, down = self.down.first(dwelt, down)
            add(j, 2, "pressure_over")
        return (min(found, key=lambda x: x[0]) if found else None), (step, entered, up, down)

    def run(self, state: State) -> tuple[list[tuple[int, int, int, str]], State]:
        """All transitions (observation, from, to, cause) and the state at the end."""
        out, i = [], 0
        while True:
            change, end = self.move(state, i)
            if change is None:
                return out, end
            j, to, cause = change
            out.append((j, state[0], to, cause))
            state, i = (to, int(self.at[j]), None, None), j + 1


def written(state: State, begin: int, rules: Rules) -> str:
    """A state as text, relative to the time from which it counts; what is older than it matters counts as just old enough."""
    step, entered, up, down = state
    old = lambda at, most: "" if at is None else str(max(at - begin, -most))
    return f"{step}|{old(entered, rules.dwell_us)}|{old(up, rules.pressure_us)}|{old(down, rules.exit_hold_us)}"


def read(text: str, begin: int) -> State:
    step, *times = text.split("|")
    entered, up, down = (None if t == "" else int(t) + begin for t in times)
    return int(step), entered, up, down


_PATH = pa.struct([("at_us", pa.int64()), ("seq", pa.int64()), ("from_step", pa.int32()), ("to_step", pa.int32()), ("cause", pa.string())])
_MAP = "estate string, place long, segment long, follows long, entered string, left string, path array<struct<at_us:long,seq:long,from_step:int,to_step:int,cause:string>>"
_MAP_ARROW = pa.schema([("estate", pa.string()), ("place", pa.int64()), ("segment", pa.int64()), ("follows", pa.int64()), ("entered", pa.string()), ("left", pa.string()), ("path", pa.list_(_PATH))])


def _mapped(rows: DataFrame, wanted: DataFrame, rules: Rules, segment_us: int) -> DataFrame:
    """What each wanted segment (estate, place, segment, follows, entered) makes of the states it is entered with."""

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        own = own.sort_by([("at_us", "ascending"), ("seq", "ascending")])
        at, seq = own["at_us"].to_numpy(), own["seq"].to_numpy()
        segment, out = Segment(at, own["bits"].to_numpy(), rules), []
        for a in asked.to_pylist():
            path, end = segment.run(read(a["entered"], a["segment"] * segment_us))
            left = None if a["follows"] is None else written(end, a["follows"] * segment_us, rules)
            out.append(a | {"left": left, "path": [{"at_us": int(at[j]), "seq": int(seq[j]), "from_step": f, "to_step": t, "cause": c} for j, f, t, c in path]})
        return pa.Table.from_pylist(out, _MAP_ARROW)

    key = ["estate", "segment"]
    needed = rows.join(wanted.select(*key).distinct(), key, "left_semi").select("estate", "segment", "seq", "at_us", "bits")
    return needed.groupBy(*key).cogroup(wanted.select("estate", "place", "segment", "follows", "entered").groupBy(*key)).applyInArrow(run, _MAP)


def _followed(rows: list[dict], entered: str | None) -> Iterator[tuple[dict, str]]:
    """Maps in order of place, each the one for the state that the one before left."""
    by = {(r["place"], r["entered"]): r for r in rows}
    for place in range(min(r["place"] for r in rows), max(r["place"] for r in rows) + 1):
        r = by[place, entered]
        yield r, entered
        entered = r["left"]


def transitions(observations: DataFrame, rules: Rules = Rules(), segment_us: int = 60 * MINUTE, block: int = 64) -> DataFrame:
    """estate, at_us, seq, from_step, to_step and cause of each change of step. The ladder starts at step 0 with the estate's first observation."""
    rows = stored(signals(observations, rules).withColumn("segment", F.floor(F.col("at_us") / segment_us)), "signals")
    order = Window.partitionBy("estate").orderBy("segment")
    segments = rows.groupBy("estate", "segment").agg(F.min("at_us").alias("first"))
    segments = segments.select("estate", "segment", "first", (F.row_number().over(order) - 1).cast("long").alias("place"), F.lead("segment").over(order).alias("follows"))
    segments = stored(segments, "segments")
    usual = F.array(*[F.lit(written((k, -rules.dwell_us, None, None), 0, rules)) for k in range(4)])
    start = F.concat(F.lit("0|"), (F.col("first") - F.col("segment") * segment_us).cast("string"), F.lit("||"))
    wanted = stored(segments.select("estate", "place", "segment", "follows", F.explode(F.when(F.col("place") == 0, F.array(start)).otherwise(usual)).alias("entered")), "wanted")
    known: DataFrame | None = None
    while True:
        more = stored(_mapped(rows, wanted, rules, segment_us), "maps")
        known = more if known is None else known.unionByName(more)
        ahead = known.select("estate", F.col("follows").alias("segment"), F.col("left").alias("entered")).where("segment is not null").distinct()
        wanted = stored(ahead.join(known.select("estate", "segment", "entered"), ["estate", "segment", "entered"], "left_anti").join(segments.select("estate", "segment", "place", "follows"), ["estate", "segment"]).select("estate", "place", "segment", "follows", "entered"), "wanted")
        if wanted.isEmpty():
            break
    maps = known.withColumn("block", F.floor(F.col("place") / block))

    def compose(table: pa.Table) -> pa.Table:
        part = table.to_pylist()
        first = min(r["place"] for r in part)
        out = []
        for entered in sorted({r["entered"] for r in part if r["place"] == first}):
            last = None
            for last, _ in _followed(part, entered):
                pass
            out.append({"estate": last["estate"], "place": last["block"], "entered": entered, "left": last["left"]})
        return pa.Table.from_pylist(out, pa.schema([("estate", pa.string()), ("place", pa.int64()), ("entered", pa.string()), ("left", pa.string())]))

    def along(table: pa.Table) -> pa.Table:
        part = table.to_pylist()
        start = next(r["entered"] for r in part if r["place"] == 0)  # a first block has one state only
        out = [{"estate": r["estate"], "block": r["place"], "begun": e} for r, e in _followed(part, start)]
        return pa.Table.from_pylist(out, pa.schema([("estate", pa.string()), ("block", pa.int64()), ("begun", pa.string())]))

    def told(own: pa.Table, begun: pa.Table) -> pa.Table:
        out = [{"estate": r["estate"]} | step for r, _ in _followed(own.to_pylist(), begun["begun"][0].as_py()) for step in r["path"]]
        return pa.Table.from_pylist(out, pa.schema([("estate", pa.string()), *_PATH]))

    light = maps.select("estate", "block", "place", "entered", "left")
    blocks = light.groupBy("estate", "block").applyInArrow(compose, "estate string, place long, entered string, left string")
    begun = stored(blocks.groupBy("estate").applyInArrow(along, "estate string, block long, begun string"), "begun")
    return maps.select("estate", "block", "place", "entered", "left", "path").groupBy("estate", "block").cogroup(begun.groupBy("estate", "block")).applyInArrow(told, TRANSITION)


def intervals(changes: DataFrame) -> DataFrame:
    """estate, step, from_us and until_us (null: still so) of each step that was entered, and degraded_us, how long the estate had been off step 0 by then."""
    w = Window.partitionBy("estate").orderBy("at_us", "seq")
    off = F.last(F.when(F.col("from_step") == 0, F.col("at_us")), ignorenulls=True).over(w)
    return changes.select("estate", F.col("to_step").alias("step"), F.col("at_us").alias("from_us"), F.lead("at_us").over(w).alias("until_us"), (F.col("at_us") - off).alias("degraded_us"))


class Ladder(StatefulProcessor):
    """The fold as a stream's state. A timer drops an estate's samples when no later observation can count them."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle) -> None:
        self.handle = handle
        self.fold = handle.getValueState("fold", "fold binary, last_us long")

    def _fold(self) -> tuple[Fold | None, int]:
        if not self.fold.exists():
            return None, 0
        blob, last = self.fold.get()
        return pickle.loads(blob), last

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fold, last = self._fold()
        part = pd.concat(list(rows)).sort_values(["at_us", "seq"], kind="stable")
        out = []
        whole = lambda v: None if v is None or v != v else int(v)
        for r in part.itertuples():
            fold = fold or Fold(self.rules, r.at_us)
            change = fold.observe(int(r.at_us), r.vendor_outcome, r.action, whole(r.backlog), whole(r.policy_until_us))
            if change:
                out.append((key[0], int(r.at_us), int(r.seq), *change))
        last = max(last, int(part["at_us"].iloc[-1]))
        self.fold.update((pickle.dumps(fold), last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((last + max(self.rules.health_us, self.rules.pressure_us)) // 1000 + 1)
        yield pd.DataFrame(out, columns=["estate", "at_us", "seq", "from_step", "to_step", "cause"]).astype({"at_us": "int64", "seq": "int64", "from_step": "int32", "to_step": "int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fold, last = self._fold()
        if fold:
            fold.health.clear(), fold.pages.clear()
            fold.bad = 0
            self.fold.update((pickle.dumps(fold), last))
        return iter(())

    def close(self) -> None:
        pass


def transitions_stream(observations: DataFrame, rules: Rules = Rules(), lateness: str = "0 seconds") -> DataFrame:
    """The transitions of a stream of observations that arrive in order; needs the RocksDB state store. Later rows than the watermark are dropped by Spark."""
    has = lambda c: F.col(c) if c in observations.columns else F.lit(None).cast("long").alias(c)
    rows = observations.where("estate is not null and at_us is not null and seq is not null").select("estate", "seq", "at_us", "vendor_outcome", "action", has("backlog"), has("policy_until_us"), F.timestamp_micros("at_us").alias("ts"))
    return rows.withWatermark("ts", lateness).groupBy("estate").transformWithStateInPandas(Ladder(rules), TRANSITION, "append", "eventTime")
