"""Degraded admission, spend and reads of the past against plain accounts, on hot keys, ties and nulls."""

import random

import pytest
from pyspark.sql import functions as F
from tidewatch.operators import asof, policy, watch


def admitted(rows, cap, share):
    """The third step, as its rule says it: all held alerts are ranked for each one."""
    rank = lambda s: watch.SEVERITY_RANK.get(s, 5)
    grave = lambda s: s in ("critical", "p1")
    out, held, tokens, paged = [], {}, [], {}
    for at, alert_id, fp, severity, z in sorted(rows):
        s, z = (severity or "").strip().lower(), z or 0.0
        known = held.get(fp)
        if known is None:
            if len(held) >= 10_000:
                del held[min(held, key=lambda f: held[f]["at"])]
            known = held[fp] = {"s": s, "z": z, "at": at, "fp": fp, "paged": False}
        known["z"] = z
        sent = False
        if not (fp in paged and at - paged[fp] < 300_000_000):
            tokens = [t for t in tokens if t[0] >= at - 60_000_000]
            left = cap - len(tokens)
            if not grave(s):
                left = min(left, int(cap * share) - sum(not g for _, g in tokens))
            key = lambda e: (rank(e["s"]), -e["z"], e["at"], e["fp"])
            ahead = sum(1 for e in held.values() if not e["paged"] and e is not known and grave(e["s"]) == grave(s) and key(e) < key(known))
            if left > 0 and ahead < left:
                sent = known["paged"] = True
                tokens.append((at, grave(s)))
                paged[fp] = at
        out.append((alert_id, "sent" if sent else "held"))
    return out


def test_rate_capped(spark):
    rng, rows, want = random.Random(4), [], []
    fixed = {f"f{k}": rng.choice(["critical", "P1 ", "high", "low", None, "odd"]) for k in range(60)}
    for activation in range(3):
        at, own = 0, []
        for k in range(400):
            at += rng.choice([0, 1_000_000, 3_000_000, 20_000_000])
            fp = rng.choice(list(fixed)) if activation else rng.choice(list(fixed)[:8])
            own.append((at, activation * 1_000 + k, fp, fixed[fp], rng.choice([None, -2.0, 0.0, 3.5])))
        rows += [("e", activation, i, at, fp, s, z) for at, i, fp, s, z in own]
        want += [("e", *x) for x in admitted(own, 6, 0.5)]
    df = spark.createDataFrame(rows, "estate string, activation long, alert_id long, at_us long, fingerprint string, severity_in string, z double").repartition(4)
    assert sorted(map(tuple, watch.rate_capped(df, 6).collect())) == sorted(want)
    assert {w[2] for w in want} == {"sent", "held"}
    assert watch.rate_capped(df.limit(0), 6).count() == 0


def test_the_digest_is_bounded():
    budget = watch.Budget(1, most=3)
    for k in range(6):
        budget.admit(k, f"f{k}", "low", 0.0)
    assert list(budget.held) == ["f3", "f4", "f5"]
    assert sum(map(len, budget.waiting.values())) == sum(not e[2] for e in budget.held.values())


def test_daily_caps_admit_a_later_cheaper_call(spark):
    df = spark.createDataFrame([("e", 1, 0, 60.0), ("e", 2, 1, 50.0), ("e", 3, 2, 40.0), ("e", 4, 3, None), ("e", 5, 86_400_000_000, 90.0)], "estate string, alert_id long, at_us long, cost double")
    got = sorted(map(tuple, watch.daily_caps(df, 100).collect()))
    assert got == [("e", 1, True, 60.0), ("e", 2, False, 60.0), ("e", 3, True, 100.0), ("e", 4, True, 100.0), ("e", 5, True, 90.0)]


@pytest.mark.parametrize("inclusive", [True, False])
def test_asof(spark, inclusive):
    rng = random.Random(8)
    key = lambda: "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", None])
    left = [(key(), rng.choice([None, rng.randint(0, 400)]), rng.randint(0, 3), k) for k in range(500)]
    right = [(key(), rng.choice([None, rng.randint(0, 400)]), rng.randint(0, 3), k) for k in range(150)]
    schema = "key string, at_us long, seq long, value long"
    got = asof.asof(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "key", inclusive, span_us=50).collect()
    assert len(got) == len(left)
    for r in got:
        if r["key"] is None or r["at_us"] is None:
            assert r["found"] is None
            continue
        here = [(t, s, v) for k, t, s, v in right if k == r["key"] and t is not None and ((t, s) <= (r["at_us"], r["seq"]) if inclusive else (t, s) < (r["at_us"], r["seq"]))]
        assert (r["found"] and (r["found"]["at_us"], r["found"]["seq"], r["found"]["value"])) == (max(here) if here else None)


def test_running_goes_on_over_buckets(spark):
    df = spark.createDataFrame([("h", 10 * k // 3, k) for k in range(300)] + [("x", 5, 1)], "key string, at_us long, seq long")
    assert {(r["key"], r["seq"]): r["nth"] for r in asof.running(df, span_us=7).collect()} == {("h", k): k + 1 for k in range(300)} | {("x", 1): 1}


def test_what_is_screened_pages_and_a_duplicate_without_prior_goes_on(spark):
    schema = "alert_id long, severity_in string, action string, reason string, answered boolean, kind string, prior string, screened boolean, step int, stale array<string>, lifecycle string, witnesses long, floor int"
    base = ("high", "suppress", "allowlist", True, "new", None, False, 0, [], "ok", 2, 1)
    row = lambda i, **new: (i, *[new.get(n, v) for n, v in zip(schema.replace(",", "").split()[2::2], base)])
    rows = [
        row(1, screened=True), row(2, kind="duplicate"), row(3, kind="duplicate", prior="page_now"), row(4, kind="change_window", screened=True), row(5, kind="storm"),
        row(6, step=1, severity_in=" High"), row(7, step=2, severity_in="P1"), row(8, step=2), row(9, step=3), row(10, stale=["fit", "allowlist"]), row(11, lifecycle="expired"), row(12, witnesses=0), row(13, answered=False), row(14, kind="duplicate", screened=True), row(15, kind="duplicate", step=1, severity_in=None),
    ]
    got = {r["alert_id"]: (r["path"], r["final"], r["why"]) for r in policy.compose(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        1: ("screen", "page_now", "firewall_flagged"), 2: ("table", "suppress", "allowlist"), 3: ("structural", "page_now", "dedup"), 4: ("structural", "page_business_hours", "change_window"), 5: ("structural", "folded", "storm"),
        6: ("degraded", "page_business_hours", "failopen_step1"), 7: ("degraded", "page_now", "failopen_step2"), 8: ("degraded", "folded", "failopen_step2_digest"), 9: ("degraded", "folded", "failopen_step3_digest"),
        10: ("table", "page_now", "freshness:fit|allowlist"), 11: ("table", "passthrough", "policy_blocked:expired"), 12: ("table", "page_now", "uncorroborated"), 13: ("table", "passthrough", "error:missing_answer"), 14: ("screen", "page_now", "firewall_flagged"), 15: ("degraded", "passthrough", "failopen_step1"),
    }


def test_a_reverted_override_expires_only_when_live(spark):
    schema = "policy_id string, version long, state string, override_until_us long, review_at_us long, grace_until_us long"
    rows = [("p", 1, "live", 5, 99, None), ("p", 2, "draft", 5, 5, 5), ("p", 3, "live", None, 5, 5), ("p", 4, "review_due", 5, 5, 5), ("p", 5, "review_due", None, 5, None)]
    got = {r["version"]: (r["new_state"], r["event"]) for r in policy.lifecycle_tick(spark.createDataFrame(rows, schema), 10).collect()}
    assert got == {1: ("expired", "policy_override_reverted"), 2: ("draft", None), 3: ("review_due", "policy_review_due"), 4: ("expired", "policy_expired"), 5: ("review_due", None)}


def test_advice_by_severity_and_a_share_of_fingerprints(spark):
    import hashlib

    fps = [f"fp{k}" for k in range(3_000)]
    df = spark.createDataFrame([(f, "low") for f in fps] + [("x", s) for s in ("Emergency", "FATAL", "p2", "notice", None)] + [(None, None)], "fingerprint string, severity string")
    got = sorted(repr(tuple(r)) for r in df.where(policy.advised(F.col("severity"), F.col("fingerprint"))).collect())
    want = [(f, s) for f, s in [(f, "low") for f in fps] + [("x", s) for s in ("Emergency", "FATAL", "p2", "notice", None)] + [(None, None)] if (s or "").lower() in ("critical", "high", "p1", "p2", "emergency", "fatal") or int(hashlib.sha256((f or "").encode()).hexdigest(), 16) % 100 == 0]
    assert got == sorted(map(repr, want))


def test_history_is_strictly_earlier(spark, tmp_path):
    """Decisions of one microsecond do not see each other, whatever their ids; one of them at most is history, so SQL leaves no tie."""
    import duckdb
    from tidewatch.plans import catalog, control

    assert control  # it adds the query to the catalog

    rows = [(i, 1_704_067_200 + i // 4, 11, "view", 30.0, f'{{"k": {45 if i % 4 != (i // 4) % 4 else 3}}}') for i in range(80)]
    events = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double, props string")
    k = F.get_json_object("props", "$.k").cast("int")
    events = events.withColumn("user_id", F.when(k < 30, 15).otherwise(5)).select("event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props")
    events.write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"SET TimeZone = 'UTC'; CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    columns = ["alert_id", "prior_id", "prior_action"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES['history_read']})").fetchall()
    got = catalog.QUERIES["history_read"](spark, str(tmp_path)).select(columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert len(want) == 80 and sum(w[1] is None for w in want) == 4
