"""The baseline's guard and bootstrap against plain accounts."""

import random

from tidewatch.operators import baseline


def median(values):
    s = sorted(values)
    return s[len(s) // 2]


def test_growth(spark, monkeypatch):
    monkeypatch.setattr(baseline, "RING", 5)
    rng, ticks, signed = random.Random(6), [], [("a", 20, 30.0), ("a", 25, 8.0), ("b", 2, 100.0)]
    for estate in ("a", "b", "c"):
        for day in sorted(rng.sample(range(45), 35)):
            level = 30 if (estate, day // 10) in (("a", 1), ("a", 2), ("c", 3)) else 4
            for k in range(rng.randint(1, 6)):
                ticks.append((estate, day * baseline.DAY + k, k, rng.randint(0, 2 * level), float(level + rng.randint(0, 2)), "row"))
    df = spark.createDataFrame([*ticks, (None, 1, 1, 1, 1.0, "row"), ("a", None, 1, 1, 1.0, "row")], "estate string, at_us long, seq long, w long, b double, day string").repartition(3)
    got = {(r["estate"], r["day"]): tuple(r)[2:] for r in baseline.growth(df, spark.createDataFrame(signed, "estate string, day long, baseline double")).collect()}
    want = {}
    for estate in ("a", "b", "c"):
        ring, since = [], None
        for day in sorted({t[1] // baseline.DAY for t in ticks if t[0] == estate}):
            own = sorted(t for t in ticks if t[0] == estate and t[1] // baseline.DAY == day)
            ring = [*ring, own[-1][4]][-5:]
            word = max(((d, b) for e, d, b in signed if e == estate and d <= day), default=(0, 0.0))[1]
            ref, velocity = max(median(ring), word), median([t[3] for t in own])
            ratio = max(own[-1][4], velocity) / ref
            since = (since if since is not None else day) if ratio > 3 else None
            want[estate, day] = (own[-1][4], median(ring), velocity, ratio, since)
    assert got == want and any(w[4] is not None for w in want.values())
    assert baseline.growth(df.limit(0)).count() == 0


def test_bootstrap(spark):
    cases = {"busy": [25] * 9, "spike": [1, 1, 1, 1, 1, 1, 40, 40, 40], "quiet": [3] * 9, "few": [50] * 4, "late but busy before": [30, 25, 22, 21, 50, 50], "ties": [20, 20, 20, 20, 20]}
    rows = [(name, k, k, w) for name, ws in cases.items() for k, w in enumerate(ws)] + [(None, 1, 1, 9), ("few", 9, 9, None)]
    got = {r["estate"]: (r["outcome"], r["baseline"]) for r in baseline.bootstrap(spark.createDataFrame(rows, "estate string, at_us long, seq long, w long")).collect()}
    assert got == {"busy": ("learned", 25.0), "spike": ("refused", None), "quiet": ("quiet", None), "few": ("few", None), "late but busy before": ("learned", 30.0), "ties": ("learned", 20.0)}
