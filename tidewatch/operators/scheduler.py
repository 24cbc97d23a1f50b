"""The outbox's scheduler: claims, leases, retries, dead letters and the second channel, as a state machine of each order.

Orders and results are one stream of inputs; what falls due in between (a claim, a lease
that runs out, an age that is exceeded, the second channel) is done at its own time. In
batch, each order's inputs are sorted and folded; as a stream, the same fold is its state, and timers
wake it. An order is small and independent of others, so no key is a task of its own.

A result counts if it is of the attempt that is in flight; others come too late and are
passed over. Inputs of equal time are taken in order of seq. Null at_us or outbox_id take
no part. A second order of an id is passed over. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidewatch.operators.watch import BACKOFF_S

SECOND = 1_000_000
EVENT = "outbox_id string, at_us long, event string, attempt int, status string, error string"
#: Events that a task sends at a time.
EVENTS = 8_192
INPUT = ["outbox_id", "at_us", "seq", "kind", "next_us", "max_age_us", "attempt", "outcome", "error", "retry_after_s"]


@dataclass(frozen=True)
class Rules:
    lease_s: int = 300
    jitter: float = 0.2
    rate_limit_floor_s: int = 60
    second_channel_s: int = 900
    second_channel: bool = True


def retry_s(outbox_id: str, attempt: int, outcome: str | None, retry_after_s: float | None, rules: Rules) -> float:
    """Seconds to the next attempt: the schedule, give or take a share that the order and attempt fix; a rate limit asks for more."""
    base = BACKOFF_S[min(max(attempt - 1, 0), len(BACKOFF_S) - 1)]
    draw = int.from_bytes(hashlib.sha256(f"{outbox_id}|{attempt}".encode()).digest()[:8], "big") / 2**64
    delay = base * (1 + rules.jitter * (2 * draw - 1))
    if outcome == "rate_limited":
        delay = max(delay, rules.rate_limit_floor_s, retry_after_s or 0)
    return delay


class Order:
    """One order: queued, in_flight, delivered or dead_letter."""

    def __init__(self, outbox_id: str, rules: Rules):
        self.id, self.rules = outbox_id, rules
        self.status: str | None = None
        self.attempt = 0
        self.created = self.next = self.max_age = self.leased = 0
        self.fired = False

    def _say(self, at: int, event: str, error: str | None = None) -> tuple:
        return self.id, at, event, self.attempt, self.status, error

    def due(self) -> tuple[int, int, str] | None:
        """(time, precedence, what) of what comes next if nothing is heard."""
        if self.status not in ("queued", "in_flight"):
            return None
        coming = []
        if self.max_age > self.created:
            coming.append((self.max_age, 0, "max_age"))
        if self.rules.second_channel and not self.fired:
            coming.append((self.created + self.rules.second_channel_s * SECOND, 1, "second_channel"))
        if self.status == "queued":
            coming.append((max(self.next, self.created), 2, "claim"))
        else:
            coming.append((self.leased + self.rules.lease_s * SECOND + 1, 2, "lease_out"))
        return min(coming)

    def until(self, at: int) -> Iterator[tuple]:
        """What falls due up to a time, in order."""
        while (coming := self.due()) and coming[0] <= at:
            now, _, what = coming
            if what == "max_age":
                self.status = "dead_letter"
                yield self._say(now, "dead_letter", "max_age_exceeded")
            elif what == "second_channel":
                self.fired = True
                yield self._say(now, "second_channel", "undelivered_past_limit")
            elif what == "claim":
                self.status, self.leased, self.attempt = "in_flight", now, self.attempt + 1
                yield self._say(now, "claim")
            else:
                self.status, self.next = "queued", now
                yield self._say(now, "lease_out")

    def take(self, row: dict) -> Iterator[tuple]:
        """An input, after all that fell due before it."""
        at = row["at_us"]
        if row["kind"] == "order":
            if self.status is None:
                self.status, self.created = "queued", at
                self.next, self.max_age = row["next_us"] if row["next_us"] is not None else at, row["max_age_us"] or 0
                yield self._say(at, "queued")
                yield from self.until(at)
            return
        yield from self.until(at - 1)
        if self.status != "in_flight" or row["attempt"] != self.attempt:
            return
        if row["outcome"] == "accepted":
            self.status = "delivered"
            yield self._say(at, "confirmed")
        elif row["outcome"] == "terminal":
            self.status = "dead_letter"
            yield self._say(at, "dead_letter", row["error"])
            if self.rules.second_channel and not self.fired:
                self.fired = True
                yield self._say(at, "second_channel", row["error"])
        else:
            self.next = at + round(retry_s(self.id, self.attempt, row["outcome"], row["retry_after_s"], self.rules) * SECOND)
            if self.max_age > self.created and self.next > self.max_age:
                self.status = "dead_letter"
                yield self._say(at, "dead_letter", "max_age_exceeded")
            else:
                self.status = "queued"
                yield self._say(at, "failed", row["error"])
        yield from self.until(at)


_ARROW = pa.schema([("outbox_id", pa.string()), ("at_us", pa.int64()), ("event", pa.string()), ("attempt", pa.int32()), ("status", pa.string()), ("error", pa.string())])


def inputs(orders: DataFrame, results: DataFrame) -> DataFrame:
    """Orders (outbox_id, at_us, seq, next_us, max_age_us) and results (outbox_id, at_us, seq, attempt, outcome, error, retry_after_s) as one table."""
    none = {"next_us": "long", "max_age_us": "long", "attempt": "int", "outcome": "string", "error": "string", "retry_after_s": "double"}
    wide = lambda df, kind: df.select(*[F.lit(kind).alias(c) if c == "kind" else F.col(c).cast(none.get(c, df.schema[c].dataType)) if c in df.columns else F.lit(None).cast(none[c]).alias(c) for c in INPUT])
    return wide(orders, "order").unionByName(wide(results, "result")).where("outbox_id is not null and at_us is not null")


def folded(batches: Iterator[pa.RecordBatch], until_us: int, rules: Rules) -> Iterator[tuple]:
    """The events of orders whose inputs come one order after the other, in order of time."""
    order: Order | None = None
    for batch in batches:
        for values in zip(*(c.to_pylist() for c in batch.columns)):
            if order is None or order.id != values[0]:
                if order is not None:
                    yield from order.until(until_us)
                order = Order(values[0], rules)
            if values[1] <= until_us:
                yield from order.take(dict(zip(INPUT, values)))
    if order is not None:
        yield from order.until(until_us)


def schedule(rows: DataFrame, until_us: int, rules: Rules = Rules()) -> DataFrame:
    """All events of all orders up to a time, from inputs(). Orders are sorted and stream through the fold, so neither an order nor a task's orders are held."""

    def run(batches):
        for events in batched(folded(batches, until_us, rules), EVENTS):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*events), _ARROW.types)], schema=_ARROW)

    return rows.select(*INPUT).repartition("outbox_id").sortWithinPartitions("outbox_id", "at_us", F.col("seq").asc_nulls_last()).mapInArrow(run, EVENT)


class Scheduler(StatefulProcessor):
    """The fold as state; a timer stands for what the order waits for."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle) -> None:
        self.handle = handle
        self.order = handle.getValueState("order", "order binary")

    def _load(self, key) -> Order:
        return pickle.loads(self.order.get()[0]) if self.order.exists() else Order(key[0], self.rules)

    def _keep(self, order: Order) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        coming = order.due()
        if coming:
            self.handle.registerTimer(-(-coming[0] // 1000))
        self.order.update((pickle.dumps(order),))

    @staticmethod
    def _frame(out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=_ARROW.names).astype({"at_us": "int64", "attempt": "int32"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        order, out = self._load(key), []
        for row in pd.concat(list(rows)).sort_values(["at_us", "seq"], kind="stable").to_dict("records"):
            out += order.take({k: None if v is None or v != v else int(v) if k in ("next_us", "max_age_us", "attempt") else v for k, v in row.items()})
        self._keep(order)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        order = self._load(key)
        # no input before the watermark is to come, so all that falls due until then can be told at once
        out = list(order.until(max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000))
        self._keep(order)
        yield self._frame(out)

    def close(self) -> None:
        pass


def schedule_stream(rows: DataFrame, rules: Rules = Rules(), lateness: str = "0 seconds") -> DataFrame:
    """The events as a stream of inputs brings them about; needs the RocksDB state store. What falls due is told when the watermark has passed it."""
    timed = rows.select(*INPUT, F.timestamp_micros("at_us").alias("ts")).withWatermark("ts", lateness)
    return timed.groupBy("outbox_id").transformWithStateInPandas(Scheduler(rules), EVENT, "append", "eventTime")
