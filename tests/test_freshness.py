"""Legs of freshness at their edges."""

import datetime

from pyspark.sql import functions as F
from tidewatch.operators import freshness

DAY = freshness.DAY_US


def test_instants_are_read_as_python_reads_them(spark):
    texts = ["2024-01-05T00:00:00Z", " 2024-01-05T00:00:00.123456+02:00 ", "2024-01-05 10:00-05:30", "2024-01-05T00:00:00", "2024-01-05", "2024-13-05T00:00:00Z", "soon", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", freshness.instant(F.col("t")).alias("strict"), freshness.instant(F.col("t"), naive=True).alias("loose")).collect()
    for r in rows:
        try:
            at = datetime.datetime.fromisoformat(r["t"].strip().replace("Z", "+00:00"))
        except (ValueError, AttributeError):
            at = None
        micros = at and round(at.replace(tzinfo=at.tzinfo or datetime.UTC).timestamp() * 1e6)
        assert r["loose"] == micros, r
        assert r["strict"] == (micros if at and at.tzinfo else None), r


def test_a_leg_holds_up_to_its_last_moment(spark):
    at = "1970-01-02T00:00:00Z"
    fit = "struct<trained_at:string,issued_by:string,valid_days:int,model:string,pipeline:string>"
    df = spark.createDataFrame([(0, (at, "r/1", 2, "m", "p"), 3 * DAY), (1, (at, "r/1", 2, "m", "p"), 3 * DAY + 1), (2, (at, "r/1", None, "m", "p"), 2 * DAY), (3, (at, "r/1", -5, "m", "p"), 2 * DAY + 1), (4, None, 0), (5, (at, "r//1", 2, "m", "p"), 0), (6, (at, None, 2, "m", "p"), 0), (7, (at, "r/1", 2, None, "p"), 0)], f"id int, f {fit}, now long")
    got = {r["id"]: tuple(r["leg"]) for r in df.select("id", freshness.fit_leg(F.col("f"), F.col("now"), "m", "p").alias("leg")).collect()}
    assert got == {0: (True, None), 1: (False, "fit TTL expired"), 2: (True, None), 3: (False, "fit TTL expired"), 4: (False, "invalid fit_trained_at"), 5: (False, "invalid issued_by"), 6: (False, "invalid issued_by"), 7: (False, "model_pin mismatch")}


def test_threshold_and_people(spark):
    bar = "struct<threshold:double,attested_by:array<string>,due_at:string,config_hash:string>"
    config, due = {"b": 1, "a": "é"}, "1970-01-02T00:00:00Z"
    good = freshness.config_hash(config)
    df = spark.createDataFrame([(0, (0.9, ["a", "b"], due, good)), (1, (0.9, ["a", "b", "a"], due, good)), (2, (0.9, ["a", None], due, good)), (3, (0.9, ["a", "b", "c"], due, good)), (4, (0.9, None, due, good)), (5, (None, ["a", "b"], due, good)), (6, (0.91, ["a", "b"], due, good)), (7, (0.9, ["a", "b"], due, None))], f"id int, b {bar}")
    got = {r["id"]: r["leg"]["reason"] for r in df.select("id", freshness.threshold_leg(F.col("b"), F.lit(DAY), config, 0.9).alias("leg")).collect()}
    assert got == {0: None, 1: None, 2: "not two operators", 3: "not two operators", 4: "not two operators", 5: "below conf floor", 6: "threshold is not the live bar", 7: "config_hash mismatch"}
    late = df.where("id = 0").select(freshness.threshold_leg(F.col("b"), F.lit(DAY + 1), config, 0.9).alias("leg")).first()["leg"]
    assert tuple(late) == (False, "revalidation clock lapsed")


def test_drift_keeps_each_entry_once(spark):
    entries = spark.createDataFrame([("f", 1), ("f", 2), ("g", 3), (None, 4)], "fingerprint string, id int")
    hits = spark.createDataFrame([("f", "i2"), ("f", "i1"), (None, "i3")], "fingerprint string, incident string")
    got = sorted((r["id"], r["incident"], r["rewritten"]) for r in freshness.with_drift(entries, hits, spark.createDataFrame([("g",), ("g",)], "fingerprint string")).collect())
    assert got == [(1, "i1", False), (2, "i1", False), (3, None, True), (4, None, False)]
    entry = F.struct(F.lit(False).alias("banned"), F.lit(True).alias("pending"), F.array(F.lit("a"), F.lit("b")).alias("attested_by"), F.lit("1970-01-01T00:00:00Z").alias("attested_at"), F.lit(9).alias("ttl_days"), F.lit(None).cast("string").alias("incident"), F.lit(False).alias("rewritten"))
    for until, reason in (("1970-01-05", None), ("1970-01-01", "re-attestation pending"), ("never", "re-attestation pending"), (None, "re-attestation pending")):
        assert spark.range(1).select(freshness.entry_leg(entry, F.lit(DAY), F.lit(until).cast("string")).alias("leg")).first()["leg"]["reason"] == reason
