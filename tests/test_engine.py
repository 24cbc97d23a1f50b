"""Numeric anchors, the correlator's fold, chains and the streaming twins."""

import pandas as pd
import pytest
from pyspark.sql import functions as F
from tidewatch.functions import stats
from tidewatch.operators import analytics, correlator, eventlog, windows
from tidewatch.plans import catalog
from tidewatch.sources import alerts as src
from tidewatch.streaming import monitors

SF = "/root/testdata/sf0.001"


def test_anchors(spark):
    assert stats.min_n_to_clear(0.002) == 1351
    assert stats.p_star(100, 50_000) == 100 / 50_100
    low, high = stats.wilson(F.col("k"), F.col("n"))
    row = spark.createDataFrame([(81, 200), (0, 0)], "k long, n long").select(low.alias("low"), high.alias("high")).collect()
    assert (round(row[0]["low"], 4), round(row[0]["high"], 4)) == (0.3394, 0.4742)
    assert tuple(row[1]) == (0.0, 0.0)
    chi = spark.createDataFrame([(50, 38), (4, 5)], "b long, c long").select(stats.mcnemar_chi2(F.col("b"), F.col("c")).alias("x")).withColumn("p", stats.erfc(F.sqrt(F.col("x") / 2))).collect()
    assert round(chi[0]["x"], 4) == 1.375 and round(chi[0]["p"], 3) == 0.241
    assert chi[1]["x"] is None


def test_correlator_fold():
    fold = correlator.Fold()
    kinds = [fold.ingest(t, i, "f", "s")[0] for i, t in enumerate([0.0, 300.0, 601.0])]
    assert kinds == ["new", "duplicate", "new"]
    fold = correlator.Fold()
    kinds = [fold.ingest(1.0, i, f"f{i}", "s")[0] for i in range(22)]
    assert kinds == ["new"] * 19 + ["storm_start"] + ["storm"] * 2
    assert fold.ingest(62.0, 99, "f19", "s")[0] != "duplicate"  # what declared the storm was not recorded as seen


def test_stream_equals_batch(spark, tmp_path):
    rows = src.alerts(spark.read.parquet(f"{SF}/events.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = correlator.correlate_stream(stream).writeStream.format("memory").queryName("kinds").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    got = {tuple(r) for r in spark.sql("SELECT * FROM kinds").collect()}
    assert got == {tuple(r) for r in correlator.correlate(rows).collect()} and got


def test_watermarked_rate(spark, tmp_path):
    decided = src.decisions(spark.read.parquet(f"{SF}/events.parquet")).withColumn("ts", F.timestamp_micros("at_us")).select("ts", "service", "action")
    decided.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(decided.schema).parquet(str(tmp_path / "in"))
    query = monitors.suppression_rate(stream).writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("SELECT sum(n) FROM rates").first()[0] == decided.count()


def test_chain_breaks_are_seen(spark):
    rows = spark.createDataFrame([(0, k, f"b{k}") for k in range(5)], "segment long, alert_id long, body string")
    good = eventlog.chain(rows)
    assert tuple(eventlog.verify(good).first()) == (0, 5, 0, 0)
    bad = good.withColumn("body", F.when(F.col("alert_id") == 2, "forged").otherwise(F.col("body")))
    assert tuple(eventlog.verify(bad).first()) == (0, 5, 0, 1)


def test_empty_and_null(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    none = src.decisions(events.limit(0))
    assert analytics.noise_top_checks(none).isEmpty() and analytics.deciles(none).isEmpty()
    assert analytics.rank_auc(none).first()["auc"] is None
    raw = spark.createDataFrame([("not json",), (None,), ('{"routing_key":"k","payload":{"summary":"s","source":"h","severity":"x"}}',)], "body string")
    got = src.from_pager(raw).select("service", "problem").collect()
    assert [r["problem"] for r in got] == ["routing_key,summary,source,severity"] * 2 + [""]
    assert got[2]["service"] == "h"
    metric = spark.createDataFrame([('{"service":"a","metric":{"value":"1.5","threshold":"bad"}}',)], "body string")
    assert tuple(src.from_generic(metric).select("metric_value", "metric_threshold").first()) == (1.5, None)


def test_pushdown(spark, capsys):
    catalog.QUERIES["trailing_distinct"](spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    assert "ReadSchema" in plan and "SinglePartition" not in plan


@pytest.mark.parametrize("name", ["correlator"])
def test_rows_only(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() == 1000


def test_windows_ties(spark):
    rows = spark.createDataFrame(pd.DataFrame({"estate": ["e"] * 4, "alert_id": range(4), "at_us": [0, 0, 60_000_000, 60_000_001], "fingerprint": list("abac")}))
    assert {r["alert_id"]: r["w"] for r in windows.trailing_distinct(rows).collect()} == {0: 2, 1: 2, 2: 2, 3: 2}


def test_river_fold(spark):
    """now is 100 s; the silent page is found, a late confirmation is none."""
    made, sure = "decision_made", "forward_confirmed"
    rows = [
        (1, 1, made, "page_now", "o1", 0),
        (2, 1, made, "page_now", "o2", 40), (3, 1, made, "page_business_hours", "o3", 39),
        (4, 1, made, "page_now", "o4", 0), (4, 2, sure, None, "o4", 99),
        (5, 1, made, "page_now", "o5", 0), (5, 2, sure, None, "other", 1),
        (6, 1, made, "page_now", "o6", 0), (6, 2, sure, None, "o6", 1), (6, 3, made, "suppress", None, 2),
        (7, 1, "decision_requested", None, None, 0), (7, 2, "decision_requested", None, None, 1),
        (8, 1, made, "passthrough", "o8", 0), (9, 1, made, "passthrough", None, 0), (10, 1, made, "passthrough", "o10", 0), (10, 2, sure, None, "o10", 1),
        (11, 1, made, "folded", None, 0), (12, 1, "feedback", None, None, 0), (13, 1, made, "page_now", None, 0), (13, 2, sure, None, None, 1),
        (14, 1, made, "suppress", "o14", 0), (14, 2, made, "page_now", "p14", 1), (14, 3, sure, None, "o14", 2), (15, 1, made, None, None, 0),
    ]
    log = spark.createDataFrame([(*r[:5], r[5] * 1_000_000) for r in rows], "alert_id long, seq long, type string, disposition string, outbox_id string, at_us long")
    got = {r["alert_id"]: r["status"] for r in eventlog.river(log, 100_000_000).collect()}
    late, some = "PAGED_ANOMALY", "passthrough_decided"
    assert got == {1: late, 2: "decided_unconfirmed", 3: late, 4: "paged", 5: late, 6: "suppressed", 7: "requested", 8: "passthrough_unconfirmed", 9: some, 10: some, 11: "folded_into_aggregate", 12: "unknown", 13: late, 14: late, 15: "unknown"}


def test_a_page_tells_whether_there_are_older_rows(spark):
    from tidewatch.operators import decisionlog

    rows = spark.range(10).select(F.col("id").alias("seq"))
    for before, want, older in ((None, [9, 8, 7], True), (4, [3, 2, 1], True), (3, [2, 1, 0], False), (2, [1, 0], False), (0, [], None)):
        got = decisionlog.page(rows, 3, before).orderBy(F.col("seq").desc()).collect()
        assert [r["seq"] for r in got] == want and {r["has_older"] for r in got} == ({older} if got else set())
