"""The tap: vendors' payloads at their edges, episodes against a plain fold, and verdicts told again."""

import random

import pytest
from pyspark.sql import functions as F
from tidewatch.operators import tap
from tidewatch.sources import vendors

LEVELS = {"P1": "SEV1", "high": "SEV2"}
EVENT = "episode string, at_us long, seq long, event_type string, estate_severity string, service string, title string, vendor string, incident_url string, gate_relevant boolean"


def hook(spark, *bodies):
    return spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "seq long, body string").withColumn("subscription", F.lit("s"))


def test_an_empty_priority_falls_through_to_the_urgency(spark):
    body = '{"event": {"id": "e", "event_type": "incident.triggered", "data": {"id": "i", "urgency": " high ", "priority": {"summary": ""}, "html_url": "u"}}}'
    row = vendors.from_pager_v3(hook(spark, body), LEVELS).first()
    assert (row["severity_raw"], row["estate_severity"], row["incident_url"]) == (" high ", "SEV2", "u")


def test_a_payload_without_an_alert_object_is_the_alert(spark):
    bare = '{"alertId": "a", "action": "", "message": "m", "priority": "P1", "createdAt": "t", "teams": [{"name": "x"}], "details": {"region": "eu"}}'
    within = '{"actionTimestamp": "", "alert": {"alertId": "a", "action": "Close", "message": "", "priority": "", "createdAt": "t", "details": {}}}'
    rows = vendors.from_genie(hook(spark, bare, within, "[]", "{"), LEVELS).orderBy("seq").collect()
    seen = [(r["event_type"], r["title"], r["service"], r["estate_severity"], r["region"], r["has_details"], r["idempotency_key"]) for r in rows[:2]]
    assert seen == [("Create", "m", "x", "SEV1", "eu", True, "og:a:Create:t"), ("Close", "a", "opsgenie", None, "", False, "og:a:Close:t")]
    assert [r["problem"] for r in rows] == [None, None, "needs alertId", "needs alertId"]


def test_vendor_events_as_alerts(spark):
    body = '{"alerts": [{"status": "firing", "fingerprint": "f", "labels": {"severity": "", "region": "r", "service": "s", "alertname": "n"}}]}'
    row = vendors.alerts_of(vendors.from_manager(hook(spark, body), LEVELS)).first()
    assert (row["alert_id"], row["check_name"], row["severity_in"], row["labels"]) == ("alertmanager:f", "alertmanager.alert", "unknown", {"region": "r", "estate_severity": "", "vendor_event_type": "firing"})
    import hashlib

    assert row["fingerprint"] == hashlib.sha256(b"s|alertmanager.alert|unknown|r||").hexdigest()[:16]


def told(rows):
    """The fold of one episode's events in order: what is known after each."""
    paged = acked = closed = False
    severity, out = rows[0]["estate_severity"], []
    for r in rows:
        kind, was = r["event_type"] or "", severity
        paged |= kind in tap.PAGED + tap.ACKNOWLEDGED
        acked |= kind in tap.ACKNOWLEDGED
        closed |= kind in tap.RESOLVED
        if "priority" in kind.lower() and r["estate_severity"] is not None:
            severity = r["estate_severity"]
        out.append((r["seq"], "paged" if paged else "unpaged" if acked or closed else "unknown", severity, was))
    return out


@pytest.mark.parametrize("span", [1, 7, 1_000])
def test_following_an_episode_by_buckets_is_the_fold(spark, span):
    rng = random.Random(span)
    kinds = [*tap.PAGER_TYPES, "Close", "UpdatePriority", "note", "note", "note", None]
    rows = [(rng.choice(["a", "a", "b", "c"]), rng.randrange(60), i, rng.choice(kinds), rng.choice(["SEV1", "SEV2", None]), "s", "t", "opsgenie", rng.choice(["", None, f"u{i}"]), True) for i in range(150)]
    rows += [("only", 5, 900, None, None, "s", "t", "opsgenie", None, False)]
    events = spark.createDataFrame(rows, EVENT)
    got = {r["seq"]: (r["seq"], r["human_disposition"], r["severity"], r["was_severity"]) for r in tap.followed(events, span).collect()}
    ends = {r["episode"]: r for r in tap.episodes(events).collect()}
    assert len(got) == len(rows)
    for episode in {r[0] for r in rows}:
        listed = sorted((dict(zip([f.name for f in events.schema], r)) for r in rows if r[0] == episode), key=lambda r: (r["at_us"], r["seq"]))
        want = told(listed)
        assert [got[w[0]] for w in want] == want
        end = ends[episode]
        assert (end["human_disposition"], end["final_severity"], end["estate_severity"], end["events"]) == (want[-1][1], want[-1][2], listed[0]["estate_severity"], len(listed))
        assert end["incident_url"] == next((r["incident_url"] for r in listed if r["incident_url"]), None)
    assert tap.severity_changes(tap.followed(events, span)).count() == sum(w[2] != w[3] for e in {r[0] for r in rows} for w in told(sorted((dict(zip([f.name for f in events.schema], r)) for r in rows if r[0] == e), key=lambda r: (r["at_us"], r["seq"]))))


def test_no_events(spark):
    none = spark.createDataFrame([], EVENT)
    assert tap.followed(none).count() == tap.episodes(none).count() == 0
    empty = spark.createDataFrame([], EVENT + ", failure string, problem string, idempotency_key string, has_details boolean")
    assert tuple(tap.health(tap.evaluable(empty)).first()) == (0, 0, 0, 0, 0, 0, 100.0)


def test_a_duplicate_is_told_the_last_verdict_before_it(spark):
    rows = [("f", 1, 1, True, "own"), ("f", 2, 2, None, "page"), ("f", 3, 3, True, "own"), ("f", 3, 4, False, None), ("f", 9, 5, True, "own"), (None, 9, 6, True, "own"), ("g", 9, 7, True, "own")]
    df = spark.createDataFrame(rows, "fingerprint string, at_us long, seq long, duplicate boolean, action string")
    got = {r["seq"]: (r["action"], r["from_cache"]) for r in tap.told_again(df, ["action"], 4).collect()}
    assert got == {1: (None, True), 2: ("page", False), 3: ("page", True), 4: (None, False), 5: (None, True), 6: ("own", False), 7: (None, True)}


def test_a_payload_is_parsed_once(spark):
    """What is asked of parsed fields does not parse again; the first row of a key is kept whole, and rows without order come last."""
    rows = hook(spark, '{"alertId": "a"}', "[]")
    for of, n in ((vendors.from_pager_v3, 1), (vendors.from_genie, 1), (vendors.from_manager, 1)):
        plan = of(rows, LEVELS).where("problem is null and event_type <> ''").select("seq", "title", "service")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == n
    keyed = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("k", None, "c"), (None, 5, "d"), (None, 4, "e"), ("o", None, "f")], "idempotency_key string, seq long, title string")
    assert sorted(map(repr, map(tuple, vendors.first_of_each(keyed, "seq").collect()))) == ["('k', 1, 'a')", "('o', None, 'f')", "(None, 4, 'e')"]
