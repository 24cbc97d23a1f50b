"""The log: whole commits or none, batches once, tails that repeat and lose nothing, faults that are found."""

import json
import shutil

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tidewatch.sources import log


def events(spark, n, start=0, parts=3):
    df = spark.range(start, start + n, 1, parts)
    empty = F.lit(None).cast(f"struct<{log.OUTBOX.replace(' ', ':').replace(',:', ',')}>")
    return df.select(F.lit("decision_made").alias("type"), F.lit("engine").alias("actor"), F.concat(F.lit("a"), F.col("id").cast("string")).alias("alert_id"), F.lit("f").alias("fingerprint"), F.lit("e").alias("episode_id"), F.lit(None).cast("string").alias("outbox_id"), F.col("id").alias("at_us"), F.lit('{"ü":1}').alias("body"), empty.alias("outbox"))


def seqs(df):
    return sorted((r["seq"], r["alert_id"]) for r in df.collect())


def test_append_and_read(spark, tmp_path):
    path = str(tmp_path / "log")
    log.append(events(spark, 100), path)
    log.append(events(spark, 50, 100), path)
    log.append(events(spark, 0), path)
    want = [(k + 1, f"a{k}") for k in range(150)]
    assert seqs(log.read(spark, path)) == want
    assert seqs(log.read(spark, path, since="120")) == want[120:]
    got = log.read(spark, path, replay="30").orderBy("seq", F.col("kind").desc()).collect()
    assert (got[0]["kind"], got[0]["seq"], got[0]["missed"]) == ("gap", 120, 120)
    assert [(r["seq"], r["alert_id"]) for r in got[1:]] == want[120:]
    assert log.read(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="only appended"):
        events(spark, 1).write.format("tidewatch_log").mode("overwrite").save(path)


def test_a_failed_append_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    log.append(events(spark, 10), path)
    broken = events(spark, 1_000, 10).withColumn("body", F.when(F.col("at_us") == 900, F.raise_error(F.lit("killed"))).otherwise(F.col("body")))
    with pytest.raises(Exception, match="killed"):
        log.append(broken, path)
    with pytest.raises(Exception, match="no row with: bad"):
        log.append(events(spark, 5).withColumn("problem", F.when(F.col("at_us") == 3, "bad")), path)
    assert seqs(log.read(spark, path)) == [(k + 1, f"a{k}") for k in range(10)]
    log.append(events(spark, 1, 10), path, batch="b1")
    log.append(events(spark, 1, 10), path, batch="b1")
    assert log.read(spark, path).count() == 11


def run(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    path, source, cp = str(tmp_path / "log"), str(tmp_path / "in"), tmp_path / "cp"
    log.register(spark)

    def once():
        run(spark.readStream.schema(events(spark, 1).schema).parquet(source).writeStream.format("tidewatch_log").option("path", path).option("writer", "s").option("checkpointLocation", str(cp)).trigger(availableNow=True).start())

    events(spark, 20, parts=2).write.parquet(source)
    once()
    events(spark, 20, 20, parts=2).write.mode("append").parquet(source)
    once()
    assert log.read(spark, path).count() == 40
    newest = max((f for f in (cp / "commits").iterdir() if f.name.isdigit()), key=lambda f: int(f.name))
    newest.unlink()  # as if the driver had died between the log's commit and Spark's
    for crc in (cp / "commits").glob(f".{newest.name}.crc"):
        crc.unlink()
    once()
    got = log.read(spark, path)
    assert got.count() == 40 and got.select("alert_id").distinct().count() == 40
    assert log.audit(spark, path).where("problem is not null").count() == 0


def test_a_tail_goes_on(spark, tmp_path):
    path, out, cp = str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "cp")
    log.register(spark)

    def once(replay):
        q = spark.readStream.format("tidewatch_log").option("path", path).option("replay", str(replay)).load().writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).start()
        q.processAllAvailable()
        q.stop()

    log.append(events(spark, 30), path)
    once(100)
    log.append(events(spark, 10, 30), path)
    log.append(events(spark, 10, 40), path)
    once(100)
    once(100)
    assert seqs(spark.read.parquet(out)) == [(k + 1, f"a{k}") for k in range(50)]
    log.append(events(spark, 60, 50), path)
    once(25)
    got = spark.read.parquet(out)
    gap = got.where("kind = 'gap'").collect()
    assert [(r["seq"], r["missed"]) for r in gap] == [(85, 35)]
    assert seqs(got.where("kind = 'event'")) == [(k + 1, f"a{k}") for k in [*range(50), *range(85, 110)]]


@pytest.mark.parametrize("fault", ["changed", "dropped", "swapped", "cut", "gone", "commit", "none"])
def test_faults_are_found(spark, tmp_path, fault):
    path = tmp_path / "log"
    log.append(events(spark, 60, parts=1), str(path), key="k")
    log.append(events(spark, 60, 60, parts=1), str(path), key="k")
    first = json.loads((path / "commits" / f"{1:020d}.json").read_text())
    name = path / "data" / first["files"][0]["name"]
    rows = pq.read_table(name)
    if fault == "changed":
        bodies = rows["body"].to_pylist()
        bodies[20] = "{}"
        rows = rows.set_column(rows.schema.get_field_index("body"), "body", [bodies])
    elif fault == "dropped":
        rows = rows.take([k for k in range(60) if k != 20])
    elif fault == "swapped":
        rows = rows.take([*range(20), 21, 20, *range(22, 60)])
    elif fault == "cut":
        rows = rows.slice(0, 20)
    pq.write_table(rows, name)
    if fault == "gone":
        name.unlink()
    if fault == "commit":
        first["writer"] = "other"
        (path / "commits" / f"{1:020d}.json").write_bytes(log.canonical(first))
    got = {(r["place"], r["problem"]) for r in log.audit(spark, str(path), "k").where("problem is not null").collect()}
    row = "row is not the one that was written"
    assert got == {"changed": {(21, row)}, "dropped": {(21, row)}, "swapped": {(21, row)}, "cut": {(21, "rows are missing or added")}, "gone": {(1, "file is gone")}, "commit": {(1, "seal"), (2, "commit follows another")}, "none": set()}[fault]


def test_export_and_checkpoint(spark, tmp_path):
    path, dest = str(tmp_path / "log"), tmp_path / "warm"
    log.append(events(spark, 40), path)
    doc = log.checkpoint(path, "key", "2024-01-01T00:00:00Z")
    log.append(events(spark, 40, 40), path)
    manifest = log.export(spark, path, str(dest), "key", "s1", 10, 70)
    assert json.loads((dest / "manifest.json").read_text()) == manifest
    assert manifest["event_count"] == 60 and manifest["hmac"] == log.seal(manifest, "key") and (manifest["window_start_us"], manifest["window_end_us"]) == (10, 69)
    lines = [json.loads(x) for f in sorted(dest.glob("*.jsonl")) for x in f.read_text().splitlines()]
    assert [r["seq"] for r in lines] == list(range(11, 71))
    assert log.holds(path, doc, "key") and not log.holds(path, doc, "other")
    with pytest.raises(ValueError, match="key"):
        log.export(spark, path, str(dest), "", "s1", 0, 1)
    shutil.rmtree(f"{path}/data")
    with pytest.raises(ValueError, match="file is gone"):
        log.export(spark, path, str(dest), "key", "s1", 0, 80)
    (tmp_path / "log" / "commits" / f"{1:020d}.json").write_text("{}")
    assert not log.holds(path, doc, "key")


def test_orders_coalesce_and_receipts_update(spark, tmp_path):
    path = str(tmp_path / "log")
    schema = "alert_id string, fingerprint string, episode_id string, at_us long, seq long, body string, pages boolean, dedup_key string, payload_sha256 string, priority int, next_us long, max_age_us long"
    row = lambda n, episode, pages=True: (f"a{n}", "f", episode, n, n, "{}", pages, "d", "p", 1, n, 99)
    log.append(log.enqueue(spark.createDataFrame([row(1, "x"), row(2, "x"), row(3, "y", False), row(4, "y")], schema), log.live_orders(log.read(spark, path))), path)
    orders = log.outbox(log.read(spark, path)).collect()
    assert sorted((o["episode_id"], o["status"], o["attempt"]) for o in orders) == [("x", "queued", 0), ("y", "queued", 0)]
    decided = {r["alert_id"]: r["outbox_id"] for r in log.read(spark, path).collect()}
    assert decided["a1"] == decided["a2"] and decided["a3"] is None and decided["a4"] != decided["a1"]
    answers = spark.createDataFrame([(decided["a1"], True, 5, None, None), (decided["a4"], False, 6, 60, "timeout")], "outbox_id string, ok boolean, at_us long, next_us long, error string")
    log.append(log.receipts(answers, log.outbox(log.read(spark, path))), path)
    log.append(log.enqueue(spark.createDataFrame([row(7, "x"), row(8, "y")], schema), log.live_orders(log.read(spark, path))), path)
    after = {(o["episode_id"], o["outbox_id"]): (o["status"], o["attempt"], o["error"]) for o in log.outbox(log.read(spark, path)).collect()}
    assert after[("x", decided["a1"])] == ("delivered", 1, None) and after[("y", decided["a4"])] == ("queued", 1, "timeout")
    assert sorted(e for e, _ in after) == ["x", "x", "y"]  # x was delivered, so it gets a new order; y's is still live
    with pytest.raises(Exception, match="order not found"):
        log.append(log.receipts(answers.withColumn("outbox_id", F.lit("?")), log.outbox(log.read(spark, path))), path)
