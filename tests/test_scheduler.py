"""The outbox's scheduler: rules by hand, batch by a tick-by-tick account, stream as batch."""

import random

from pyspark.sql import functions as F
from tidewatch.operators import scheduler
from tidewatch.operators.scheduler import SECOND

RULES = scheduler.Rules(lease_s=30, second_channel_s=90)
ORDERS = "outbox_id string, at_us long, seq long, next_us long, max_age_us long, row string"
RESULTS = "outbox_id string, at_us long, seq long, attempt int, outcome string, error string, retry_after_s double"
END = 4_000 * SECOND


def cases(n=60, seed=3):
    rng, orders, results = random.Random(seed), [], []
    for k in range(n):
        at = rng.randint(0, 50) * SECOND
        orders.append((f"o{k}", at, 2 * k, rng.choice([None, at, at + 5 * SECOND]), rng.choice([None, at, at + 200 * SECOND, at + 2_000 * SECOND]), "row"))
        for j in range(rng.randint(0, 8)):
            at += rng.choice([1, 7, 20, 60, 200]) * SECOND
            results.append((f"o{k}", at, 1_000 + j, rng.choice([j + 1, j + 1, j + 1, 1, 9]), rng.choice(["accepted", "timeout", "timeout", "rate_limited", "terminal"]), "e", rng.choice([None, 100.0])))
    return orders, results


def tables(spark, orders, results):
    return spark.createDataFrame(orders, ORDERS), spark.createDataFrame(results, RESULTS)


def account(order, results, end):
    """Second by second: what an order does, from its rules as they are stated."""
    oid, created, _, next_us, max_age, _ = order
    out, status, attempt, due, leased, fired = [(oid, created, "queued", 0, "queued", None)], "queued", 0, created if next_us is None else next_us, None, False
    heard = sorted((r[1], r[2], *r[3:]) for r in results)
    times = {created, end, due, created + 90 * SECOND, max_age or 0}
    steps = sorted(t for t in times | {h[0] for h in heard} if t >= created)
    while steps:
        now = steps.pop(0)
        if now > end or status in ("delivered", "dead_letter"):
            break
        while heard and heard[0][0] < now:
            heard.pop(0)
        if heard and heard[0][0] == now and status == "in_flight" and not (leased + 30 * SECOND < now):
            while heard and heard[0][0] == now:
                _, _, no, outcome, error, after = heard.pop(0)
                if no != attempt or status != "in_flight":
                    continue
                if outcome == "accepted":
                    status = "delivered"
                    out.append((oid, now, "confirmed", attempt, status, None))
                elif outcome == "terminal":
                    status = "dead_letter"
                    out.append((oid, now, "dead_letter", attempt, status, error))
                    if not fired:
                        out.append((oid, now, "second_channel", attempt, status, error))
                else:
                    due = now + round(scheduler.retry_s(oid, attempt, outcome, after, RULES) * SECOND)
                    if max_age and max_age > created and due > max_age:
                        status = "dead_letter"
                        out.append((oid, now, "dead_letter", attempt, status, "max_age_exceeded"))
                    else:
                        status = "queued"
                        out.append((oid, now, "failed", attempt, status, error))
                        steps = sorted({*steps, due})
        if status in ("delivered", "dead_letter"):
            break
        if max_age and max_age > created and now >= max_age:
            status = "dead_letter"
            out.append((oid, max_age, "dead_letter", attempt, status, "max_age_exceeded"))
            break
        if not fired and now >= created + 90 * SECOND:
            fired = True
            out.append((oid, now, "second_channel", attempt, status, "undelivered_past_limit"))
        if status == "in_flight" and now > leased + 30 * SECOND:
            status, due = "queued", now
            out.append((oid, now, "lease_out", attempt, status, None))
        if status == "queued" and now >= due:
            status, leased, attempt = "in_flight", now, attempt + 1
            out.append((oid, now, "claim", attempt, status, None))
            steps = sorted({*steps, now + 30 * SECOND + 1})
    return out


def test_batch(spark):
    orders, results = cases()
    o, r = tables(spark, orders, results)
    got = sorted(map(repr, map(tuple, scheduler.schedule(scheduler.inputs(o, r), END, RULES).collect())))
    want = sorted(repr(e) for order in orders for e in account(order, [x for x in results if x[0] == order[0]], END))
    assert got == want
    assert {e.split(", ")[2] for e in want} == {"'queued'", "'claim'", "'confirmed'", "'failed'", "'dead_letter'", "'lease_out'", "'second_channel'"}
    assert scheduler.schedule(scheduler.inputs(o.limit(0), r.limit(0)), END, RULES).count() == 0
    again = o.unionByName(o).unionByName(o.withColumn("outbox_id", F.lit(None).cast("string")))
    assert scheduler.schedule(scheduler.inputs(again, r), END, RULES).count() == len(want)


def test_retries():
    rules = scheduler.Rules()
    for attempt, base in ((1, 5), (2, 15), (8, 1_800), (99, 1_800)):
        found = [scheduler.retry_s(f"o{k}", attempt, "timeout", None, rules) for k in range(200)]
        assert min(found) >= 0.8 * base and max(found) <= 1.2 * base and len(set(found)) > 100
    assert scheduler.retry_s("o", 1, "rate_limited", None, rules) == 60 and scheduler.retry_s("o", 1, "rate_limited", 100.0, rules) == 100


def test_stream_is_batch(spark, tmp_path):
    orders, results = cases(25, 5)
    last = [("end", END + 10 * SECOND, 0, END * 9, None, "row")]
    o, r = tables(spark, orders + last, results)
    rows = scheduler.inputs(o, r)
    want = sorted(map(repr, map(tuple, scheduler.schedule(rows, END, RULES).where("outbox_id <> 'end'").collect())))
    key, source = "spark.sql.streaming.stateStore.providerClass", str(tmp_path / "in")
    had = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for a, b in ((0, 60 * SECOND), (60 * SECOND, 300 * SECOND), (300 * SECOND, END * 2)):
            rows.where((F.col("at_us") >= a) & (F.col("at_us") < b)).coalesce(1).write.mode("append").parquet(source)
            q = scheduler.schedule_stream(spark.readStream.schema(rows.schema).parquet(source), RULES).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            q.awaitTermination(120)
            assert q.exception() is None
    finally:
        spark.conf.set(key, had)
    got = spark.read.schema(scheduler.EVENT).parquet(str(tmp_path / "out")).where((F.col("at_us") <= END) & (F.col("outbox_id") != "end"))
    assert sorted(map(repr, map(tuple, got.collect()))) == want


def test_orders_stream_through_tasks(spark):
    """No Python call for each order, and an order whose inputs lie in several batches is one fold."""
    o, r = tables(spark, *cases(40, 7))
    rows = scheduler.inputs(o, r)
    out = scheduler.schedule(rows, END, RULES)
    plan = out._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    want, key = sorted(map(repr, map(tuple, out.collect()))), "spark.sql.execution.arrow.maxRecordsPerBatch"
    had = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        assert sorted(map(repr, map(tuple, scheduler.schedule(rows, END, RULES).collect()))) == want
    finally:
        spark.conf.set(key, had)
