"""The correlator's fold against a plain account that looks at all of the past for each alert."""

import json
import random

import pytest
from pyspark.sql import functions as F
from tidewatch.operators import correlator
from tidewatch.plans import catalog

US = 1_000_000
TOUCH = ("new", "reopened", "storm_start")


def learned(alerts, floor):
    """The first baseline of a cold start and when it is there: alerts are (second, fingerprint)."""
    begin = mark = alerts[0][0]
    minute, samples = set(), []
    for at, fp in alerts:
        if at - mark >= 60:
            samples += [len(minute)] if minute else []
            minute, mark = set(), at
        minute.add(fp)
        if at - begin >= 1800:
            mid = lambda x: sorted(x)[len(x) // 2]
            if len(samples) < 5:
                return at, None
            early = [s for i, s in enumerate(samples) if (i + 0.5) / len(samples) < 2 / 3]
            late = samples[len(early) :]
            if (mid(early) < floor and mid(late) >= floor) or mid(samples) < floor:
                return at, None
            return at, float(mid(samples))
    return float("inf"), None


def account(rows, floor=correlator.FLOOR):
    """rows: (at_us, seq, what, fingerprint, service, held, labels_us, said) of one estate."""
    rows = sorted(rows, key=lambda r: r[:3])
    ready, first = learned([(r[0] / 1e6, r[3]) for r in rows if r[2] == "alert"], floor)
    done, out, pages, baseline, ticked, asked = [], [], {}, 0.0, None, False
    for at_us, seq, what, fp, service, held, labels_us, said in rows:
        at = at_us / 1e6
        if what == "alert" and not asked and at >= ready:
            asked = True
            baseline = first if first is not None and baseline <= 0.01 else baseline
        # what became of the fingerprint so far
        last, is_open, flaps, had, prior = None, False, 0, None, None
        for d in done:
            if d["fp"] != fp:
                continue
            if d["kind"] in TOUCH:
                gone = last is None or d["at"] - last > 259_200
                if gone:
                    flaps = 0
                elif not is_open:
                    flaps, prior = flaps + 1, None
                last, is_open = d["at"], True
                if d["kind"] != "storm_start":
                    had, prior = d, None
            elif d["kind"] == "closes":
                if is_open:
                    is_open, prior = False, None
            elif d["kind"] == "says":
                prior = d["said"]
        if what != "alert":
            if what == "verdict":
                done.append({"at": at, "fp": fp, "kind": "says", "said": said})
            elif said in ("operator_resolve", "verified_resolve"):
                done.append({"at": at, "fp": fp, "kind": "closes"})
            continue
        known = last is not None and at - last <= 259_200
        novel = not known and not any(d["fp"] == fp and d["kind"] not in ("closes", "says") and at - d["at"] <= 259_200 for d in done)
        size, shown, told, paged, services, anchor = 0, 0, None, False, None, seq
        if labels_us is not None and at - labels_us / 1e6 > 900:
            kind, novel, paged = "label_stale", False, at - pages.get(service, float("-inf")) >= 300
            if paged:
                pages[service] = at
        elif held:
            kind = "change_window"
        elif known and is_open and had and at - had["at"] <= 300:
            kind, anchor, shown, told = "duplicate", had["seq"], flaps, prior
        elif any(d["kind"] == "storm_start" and at - d["at"] < 60 for d in done):
            kind = "storm"
        else:
            kind = "reopened" if known and not is_open else "new"
            shown = (flaps + (not is_open)) if known else 0
            near = {d["fp"] for d in done if d["kind"] in TOUCH and d["at"] >= at - 60}
            if ticked is None or at - ticked >= 60:
                if not any(d["kind"] == "storm_start" and at - d["at"] < 300 for d in done):
                    baseline += correlator.ALPHA * (len(near) - baseline)
                ticked = at
            near.add(fp)
            if len(near) >= max(floor, 5 * baseline):
                kind, size, services = "storm_start", len(near), {}
                for f in near:
                    # a record lives on by its duplicates
                    own = [d for d in done if d["fp"] == f and d["kind"] in ("new", "reopened", "duplicate")]
                    s = own[-1]["service"] if own and at - own[-1]["at"] <= 300 else "unknown"
                    services[s] = services.get(s, 0) + 1
        done.append({"at": at, "fp": fp, "kind": kind, "seq": seq, "service": service})
        out.append((seq, kind, anchor, size, shown, told, novel, paged, services))
    return out


def made(seed):
    rng, rows, at = random.Random(seed), [], 0
    for k in range(900):
        burst = 300 < k < 420 or 600 < k < 660
        at += rng.choice([0, 1, 1, 2]) * US if burst else rng.choice([0, 5, 20, 61]) * US
        if k in (500, 800):
            at += 80 * 3_600 * US
        n = rng.randrange(60 if burst else 12)
        fp, service = f"f{n}", f"s{n % 3}"
        rows.append((at, 3 * k, "alert", fp, service, rng.random() < 0.05, at - rng.choice([10, 1_200]) * US if rng.random() < 0.06 else None, None))
        if rng.random() < 0.3:
            rows.append((at, 3 * k + 1, "verdict", fp, None, None, None, rng.choice(["page_now", "suppress"])))
        if rng.random() < 0.15:
            rows.append((at + rng.choice([0, 30]) * US, 3 * k + 2, "resolve", fp, None, None, None, rng.choice(["operator_resolve", "verified_resolve", "silence"])))
    return rows


def listed(rows):
    return sorted((r["estate"], r["alert_id"], r["kind"], r["anchor_id"], r["storm_size"], r["flap_count"], r["prior"] or "", r["novel"], r["paged"], r["storm_services"] or "") for r in rows)


def wanted(estate, rows):
    return [(estate, a, k, n, size, flaps, prior or "", novel, paged, json.dumps(s, sort_keys=True) if s else "") for a, k, n, size, flaps, prior, novel, paged, s in account(rows)]


def frames(spark, estates):
    """Alerts, resolves and verdicts of the estates as tables."""
    rows = [(e, *r) for e, of in estates.items() for r in of]
    df = spark.createDataFrame(rows, correlator.EVENT)
    alerts = df.where("what = 'alert'").drop("what", "said").withColumnRenamed("seq", "alert_id")
    return alerts, df.where("what = 'resolve'").withColumnRenamed("said", "authority"), df.where("what = 'verdict'").withColumnRenamed("said", "action")


def test_every_step_against_the_account(spark):
    estates = {f"e{k}": made(k) for k in range(3)}
    got = listed(correlator.correlate(*frames(spark, estates)).collect())
    want = sorted(w for e, rows in estates.items() for w in wanted(e, rows))
    assert got == want
    assert {w[2] for w in want} == {"new", "duplicate", "reopened", "storm", "storm_start", "change_window", "label_stale"}
    assert {w[6] for w in want} == {"", "page_now", "suppress"} and max(w[5] for w in want) > 1


@pytest.mark.parametrize("early,kinds", [(30, 0), (3, 1), (None, 1)])
def test_cold_start(early, kinds):
    """A busy estate learns its baseline and has no storm after it; one that was calm until an incident, and one that just began, has."""
    rows, seq = [], 0
    for minute in range(45):
        n = 30 if early is None or minute >= 20 else early
        for k in range(n):
            if early is not None or minute >= 31 or minute < 3:
                rows.append((minute * 60 * US + k * 2 * US, seq, "alert", f"{minute}-{k}", "s", False, None, None))
                seq += 1
    fold = correlator.Fold()
    got = [(r[1], *fold.take(*r)) for r in rows]
    assert [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], w[3]) for w in account(rows)]
    late = [g for r, g in zip(rows, got) if r[0] >= 32 * 60 * US and g[1] == "storm_start"]
    assert bool(late) == bool(kinds)


def test_stream_with_all_inputs_equals_batch(spark, tmp_path):
    alerts, resolves, verdicts = frames(spark, {"a": made(7), "b": made(8)})
    both = correlator.events(alerts, resolves, verdicts)
    for part, until in enumerate((10_000_000_000, 10**15)):
        both.where(F.col("at_us").between(part * 10_000_000_000 + part, until)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(both.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = correlator.correlate_stream(stream).writeStream.format("memory").queryName("all_steps").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    assert listed(spark.sql("SELECT * FROM all_steps").collect()) == listed(correlator.correlate(alerts, resolves, verdicts).collect())


def test_nulls_and_empty(spark):
    schema = "estate string, alert_id long, at_us long, fingerprint string, service string, severity_in string, n int"
    df = spark.createDataFrame([("e", 1, 0, None, None, None, 0), ("e", 2, 1, None, None, None, 0), (None, 3, 0, "f", "s", "low", 0), ("e", 4, None, "f", "s", "low", 0), ("e", 5, 2, "g", "s", " P1", 0), ("e", 5, 2, "g", "s", " P1", 0)], schema)
    got = listed(correlator.correlate(df).collect())
    assert [(g[1], g[2]) for g in got] == [(1, "new"), (2, "duplicate"), (5, "duplicate"), (5, "new")]
    assert correlator.correlate(df.limit(0)).count() == 0
    shut = spark.createDataFrame([("*", 0, 9)], "service string, begin_us long, end_us long")
    once = df.dropDuplicates(["alert_id"])
    held = {r["alert_id"]: r["kind"] for r in correlator.correlate(correlator.hold(once, shut)).collect()}
    assert held == {1: "change_window", 2: "change_window", 5: "new"}


def test_query_over_its_table(spark):
    sf = "/root/testdata/sf0.01"
    got = catalog.QUERIES["correlator_episodes"](spark, sf)
    assert {"new", "duplicate", "reopened", "change_window", "storm"} <= {r["kind"] for r in got.select("kind").distinct().collect()}
    assert got.count() == catalog.QUERIES["correlator"](spark, sf).count()
