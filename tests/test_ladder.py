"""The ladder: batch by segments and stream against the plain fold."""

import random

import numpy as np
import pytest
from tidewatch.operators import ladder

RULES = ladder.Rules(health_us=900, min_decisions=5, dwell_us=600, exit_hold_us=600, pages_per_minute=3 / (300 / ladder.MINUTE), pressure_us=300, backlog=4)
SCHEMA = "estate string, seq long, at_us long, vendor_outcome string, action string, backlog long, policy_until_us long, bits string, segment string"


def observations(seed: int, n: int, estate: str, pace: int = 90) -> list[tuple]:
    """Quiet and troubled stretches by turns, with ties in time."""
    rng, at, out = random.Random(seed), rng_start(seed), []
    mood = 0
    for k in range(n):
        if rng.random() < 0.03:
            mood = rng.randint(0, 3)
        at += rng.choice([0, 1, pace // 3, pace, pace * 2]) if rng.random() > 0.01 else 4_000
        bad = rng.random() < (0.6 if mood == 1 else 0.05)
        outcome = rng.choice(["timer_win", "unhealthy_error"]) if bad else rng.choice(["answered", "answered", "answered", "structural", None])
        action = "page_now" if rng.random() < (0.95 if mood >= 2 else 0.1) else rng.choice(["suppress", "folded", None])
        out.append((estate, k, at, outcome, action, rng.choice([None, 0, 9 if mood == 3 else 1]), rng.choice([None, 10**9]) if rng.random() > 0.02 else at - 1, "bits", "segment"))
    return out


def rng_start(seed: int) -> int:
    return 1_000 + 37 * seed


def folded(rows: list[tuple], rules: ladder.Rules) -> list[tuple]:
    out = []
    for estate in sorted({r[0] for r in rows}):
        own = sorted((r for r in rows if r[0] == estate), key=lambda r: (r[2], r[1]))
        fold = ladder.Fold(rules, own[0][2])
        for _, seq, at, outcome, action, backlog, until, *_ in own:
            change = fold.observe(at, outcome, action, backlog, until)
            if change:
                out.append((estate, at, seq, *change))
    return sorted(out)


def test_a_segment_moves_as_the_fold():
    """Cut anywhere, with the state written and read in between."""
    for seed in range(60):
        rows = observations(seed, 400, "e")
        fold, at, bits = ladder.Fold(RULES, rows[0][2]), [], []
        want, begun = [], rows[0][2]
        for _, k, t, outcome, action, backlog, until, *_ in rows:
            change = fold.observe(t, outcome, action, backlog, until)
            if change:
                want.append((k, *change))
            n, rate, paging = len(fold.health), fold.bad / max(1, len(fold.health)), len(fold.pages) / (RULES.pressure_us / ladder.MINUTE)
            over = paging > RULES.pages_per_minute
            said = [n >= 5 and rate > 0.25, paging > 3 * RULES.pages_per_minute, over, n >= 5 and rate < 0.125 and not over, (backlog or 0) >= 4, until is None or t <= until]
            at.append(t), bits.append(sum(1 << i for i, s in enumerate(said) if s))
        at, bits, rng = np.array(at), np.array(bits), random.Random(seed)
        cuts = [0, *sorted(rng.sample(range(1, 400), rng.randint(1, 30))), 400]
        state, got = (0, begun, None, None), []
        for a, b in zip(cuts, cuts[1:]):
            state = ladder.read(ladder.written(state, int(at[a]), RULES), int(at[a]))
            path, state = ladder.Segment(at[a:b], bits[a:b], RULES).run(state)
            got += [(a + j, f, t, c) for j, f, t, c in path]
        assert got == want


@pytest.mark.parametrize("segment_us,block", [(2_000, 3), (500, 64), (10**9, 64)])
def test_batch_is_the_fold(spark, segment_us, block):
    rows = observations(1, 1_500, "hot") + observations(2, 300, "b") + observations(3, 5, "c")
    want = folded(rows, RULES)
    assert {w[3:] for w in want} >= {(0, 1, "timer_win_rate"), (0, 3, "page_pressure"), (1, 0, "recovered"), (3, 2, "pressure_over"), (2, 1, "pressure_over")}
    odd = [(None, 1, 1, "answered", "page_now", 1, 1, "", ""), ("b", None, 1, "answered", "page_now", 1, 1, "", ""), ("b", 1, None, "answered", "page_now", 1, 1, "", "")]
    df = spark.createDataFrame(rows + odd, SCHEMA).repartition(5)
    got = ladder.transitions(df, RULES, segment_us, block)
    assert sorted(map(tuple, got.collect())) == want


def test_batch_of_little(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ladder.transitions(df, RULES).count() == 0
    one = spark.createDataFrame([("e", 1, 5, None, None)], "estate string, seq long, at_us long, vendor_outcome string, action string")
    assert ladder.transitions(one, RULES).count() == 0


def test_intervals(spark):
    changes = spark.createDataFrame([("e", 10, 1, 0, 1, "timer_win_rate"), ("e", 30, 2, 1, 2, "page_rate"), ("e", 70, 3, 2, 1, "pressure_over"), ("e", 90, 4, 1, 0, "recovered"), ("e", 99, 5, 0, 3, "page_pressure")], ladder.TRANSITION)
    got = [tuple(r) for r in ladder.intervals(changes).orderBy("from_us").collect()]
    assert got == [("e", 1, 10, 30, 0), ("e", 2, 30, 70, 20), ("e", 1, 70, 90, 60), ("e", 0, 90, 99, 80), ("e", 3, 99, None, 0)]


def test_stream_is_the_fold(spark, tmp_path):
    rows = sorted(observations(1, 600, "hot") + observations(2, 300, "b"), key=lambda r: r[2])
    source = tmp_path / "in"
    key = "spark.sql.streaming.stateStore.providerClass"
    had = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in range(0, len(rows), 250):
            spark.createDataFrame(rows[k : k + 250], SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
            stream = spark.readStream.schema(SCHEMA).parquet(str(source))
            q = ladder.transitions_stream(stream, RULES).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
            q.awaitTermination(120)
            assert q.exception() is None
    finally:
        spark.conf.set(key, had)
    assert sorted(map(tuple, spark.read.schema(ladder.TRANSITION).parquet(str(tmp_path / "out")).collect())) == folded(rows, RULES)
