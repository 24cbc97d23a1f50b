"""The event log as a Spark data source: an append is one commit, and a tail reads on from where it was.

A log is a folder. Each task of an append writes a file of its own; the driver then
publishes all of them by one small commit file, so either every row of a batch is in
the log or none is. What no commit names (files of killed or repeated tasks) does not
exist to readers. A batch of a stream is committed once, however often it is run again.
There is one writer at a time, as for any log that numbers its rows.

Rows are numbered when they are committed: a commit gives each file its first seq, and
a row's seq follows from its place in the file. A row carries its event and what it
does to the outbox, so a decision and its order to page are in the log together or not
at all.

Rows of a file are chained: row_hash is SHA-256 of the row's canonical JSON and the
hash before it. A commit names each file's last hash and the hash of the commit before,
and may be sealed by HMAC-SHA-256. So files are checked side by side, and a row that
was changed, dropped or moved is found with its place.

Files are reached through pyarrow's file systems (a path, file://, hdfs://, s3:// and
the like), which driver and executors must share.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

#: Rows that a tail reads at most; if more are unread, one `gap` row stands for the rest.
MAX_REPLAY = 10_000
#: Rows of a read's batch.
BATCH = 4_096
OUTBOX = "outbox_id string, episode_id string, dedup_key string, payload_sha256 string, status string, priority int, attempt int, next_us long, max_age_us long, error string"
EVENT = f"type string, actor string, alert_id string, fingerprint string, episode_id string, outbox_id string, at_us long, body string, outbox struct<{OUTBOX.replace(' ', ':').replace(',:', ',')}>"
ROW = f"seq long, kind string, missed long, {EVENT}, row_hash string"
GENESIS = "0" * 64
LIVE = ["queued", "in_flight"]

_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
_OUTBOX_ARROW = pa.struct([(n, _KINDS[k]) for n, k in (c.split(" ") for c in OUTBOX.split(", "))])
_EVENT_ARROW = [("type", pa.string()), ("actor", pa.string()), ("alert_id", pa.string()), ("fingerprint", pa.string()), ("episode_id", pa.string()), ("outbox_id", pa.string()), ("at_us", pa.int64()), ("body", pa.string()), ("outbox", _OUTBOX_ARROW)]
_FILE_ARROW = pa.schema([*_EVENT_ARROW, ("row_hash", pa.string())])
_ROW_ARROW = pa.schema([("seq", pa.int64()), ("kind", pa.string()), ("missed", pa.int64()), *_FILE_ARROW])


def canonical(value) -> bytes:
    """JSON with sorted keys, without white space."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode("utf-8", "surrogatepass")


def row_hash(row: dict, before: str) -> str:
    return hashlib.sha256(canonical(row) + before.encode()).hexdigest()


class Folder:
    """A log's files and commits."""

    def __init__(self, path: str):
        self.fs, self.root = pa.fs.FileSystem.from_uri(path)

    def commit_name(self, n: int) -> str:
        return f"{self.root}/commits/{n:020d}.json"

    def exists(self, name: str) -> bool:
        return self.fs.get_file_info(name).type == pa.fs.FileType.File

    def read(self, name: str) -> bytes:
        with self.fs.open_input_stream(name) as f:
            return f.read()

    def commit(self, n: int) -> dict | None:
        """The n-th commit, from 1."""
        return json.loads(self.read(self.commit_name(n))) if n > 0 and self.exists(self.commit_name(n)) else None

    def last(self, known: int = 0) -> int:
        """The number of the newest commit: steps of doubling width beyond a known one, then halving."""
        low, step = known, 1
        while self.exists(self.commit_name(low + step)):
            low, step = low + step, step * 2
        while step > 1:
            step //= 2
            if self.exists(self.commit_name(low + step)):
                low += step
        return low

    def back(self, n: int) -> Iterator[dict]:
        """Commits from the n-th back to the first."""
        while n > 0:
            yield self.commit(n)
            n -= 1

    def publish(self, n: int, commit: dict) -> None:
        """Write a commit aside and move it to its place, so that it is whole when it is seen."""
        aside = f"{self.root}/aside/{uuid.uuid4().hex}.json"
        self.fs.create_dir(f"{self.root}/aside", recursive=True)
        self.fs.create_dir(f"{self.root}/commits", recursive=True)
        with self.fs.open_output_stream(aside) as f:
            f.write(canonical(commit))
        if self.exists(self.commit_name(n)):
            raise RuntimeError(f"commit {n} exists: the log has another writer")
        self.fs.move(aside, self.commit_name(n))

    def files(self, after: int, upto: int) -> list[dict]:
        """Files with rows after one seq up to another, in order."""
        out = []
        for c in self.back(self.last()):
            if c["head"] <= after:
                break
            out += [f for f in c["files"] if f["first"] <= upto and f["first"] + f["rows"] - 1 > after]
        return sorted(out, key=lambda f: f["first"])

    def head(self) -> int:
        n = self.last()
        return self.commit(n)["head"] if n else 0


def seal(commit: dict, key: str) -> str:
    """HMAC of a commit without its seal."""
    return hmac.new(key.encode(), canonical({k: v for k, v in commit.items() if k != "hmac"}), hashlib.sha256).hexdigest()


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int
    last_hash: str


class Append:
    """Writes a task's file, and publishes or forgets what all tasks wrote."""

    def __init__(self, options: dict):
        self.path, self.writer, self.key = options["path"], options.get("writer", "batch"), options.get("key")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        folder, name, rows, last = Folder(self.path), f"{uuid.uuid4().hex}.parquet", 0, GENESIS
        folder.fs.create_dir(f"{folder.root}/data", recursive=True)
        with folder.fs.open_output_stream(f"{folder.root}/data/{name}") as f, pq.ParquetWriter(f, _FILE_ARROW, compression="zstd") as out:
            for batch in batches:
                hashes = []
                own = batch.select([n for n, _ in _EVENT_ARROW])
                if "problem" in batch.schema.names and (bad := [p for p in batch["problem"].to_pylist() if p]):
                    raise ValueError(f"the log takes no row with: {bad[0]}")
                for row in own.to_pylist():
                    last = row_hash(row, last)
                    hashes.append(last)
                out.write_batch(pa.RecordBatch.from_arrays([*[c.cast(t) for c, (_, t) in zip(own.columns, _EVENT_ARROW)], pa.array(hashes, pa.string())], schema=_FILE_ARROW))
                rows += len(hashes)
        return Written(name, rows, last)

    def _committed(self, folder: Folder, batch: int | str) -> bool:
        """Whether this writer's batch is in the log; only its newest commit can be the same."""
        own = next((c for c in folder.back(folder.last()) if c["writer"] == self.writer), None)
        return own is not None and own["batch"] == batch

    def publish(self, messages: list, batch: int | str) -> None:
        folder = Folder(self.path)
        if self._committed(folder, batch):
            self.forget(messages)
            return
        n = folder.last()
        before = folder.read(folder.commit_name(n)) if n else b""
        first, files = (json.loads(before)["head"] if n else 0) + 1, []
        for m in messages:
            if m is not None and m.rows:
                files.append({"name": m.name, "first": first, "rows": m.rows, "last_hash": m.last_hash})
                first += m.rows
        commit = {"writer": self.writer, "batch": batch, "head": first - 1, "files": files, "before": hashlib.sha256(before).hexdigest()}
        if self.key:
            commit["hmac"] = seal(commit, self.key)
        folder.publish(n + 1, commit)

    def forget(self, messages: list) -> None:
        folder = Folder(self.path)
        for m in messages:
            if m is not None:
                folder.fs.delete_file(f"{folder.root}/data/{m.name}")


class BatchAppend(DataSourceArrowWriter):
    """An append of a whole DataFrame; option `batch` names it, so that the same one is not added twice in a row."""

    def __init__(self, options: dict):
        self.append, self.batch = Append(options), options.get("batch", uuid.uuid4().hex)

    def write(self, iterator):
        return self.append.write(iterator)

    def commit(self, messages) -> None:
        self.append.publish(messages, self.batch)

    def abort(self, messages) -> None:
        self.append.forget(messages)


class StreamAppend(DataSourceStreamArrowWriter):
    """An append by micro-batch; option `writer` names the stream."""

    def __init__(self, options: dict):
        self.append = Append(options)

    def write(self, iterator):
        return self.append.write(iterator)

    def commit(self, messages, batchId: int) -> None:
        self.append.publish(messages, batchId)

    def abort(self, messages, batchId: int) -> None:
        self.append.forget(messages)


@dataclass
class Slice(InputPartition):
    """Rows of a file after one seq up to another, or a gap."""

    name: str
    first: int
    after: int
    upto: int
    missed: int = 0


def slices(folder: Folder, after: int, upto: int, replay: int) -> list[Slice]:
    """What a read of (after, upto] is made of; if more than replay rows are unread, the gap and the newest of them. The same for the same bounds, always."""
    out = []
    if replay and upto - after > replay:
        out.append(Slice("", 0, after, upto - replay, upto - replay - after))
        after = upto - replay
    return out + [Slice(f["name"], f["first"], after, upto) for f in folder.files(after, upto)]


def rows_of(path: str, part: Slice) -> Iterator[pa.RecordBatch]:
    if part.missed:
        gap = {"seq": part.upto, "kind": "gap", "missed": part.missed}
        yield pa.RecordBatch.from_pylist([gap], _ROW_ARROW)
        return
    folder, seq = Folder(path), part.first
    with folder.fs.open_input_file(f"{folder.root}/data/{part.name}") as f:
        for batch in pq.ParquetFile(f).iter_batches(BATCH):
            begin, end = max(0, part.after + 1 - seq), min(batch.num_rows, part.upto + 1 - seq)
            if begin < end:
                own = batch.slice(begin, end - begin)
                n = own.num_rows
                head = [pa.array(range(seq + begin, seq + end), pa.int64()), pa.array(["event"] * n), pa.nulls(n, pa.int64())]
                yield pa.RecordBatch.from_arrays([*head, *own.columns], schema=_ROW_ARROW)
            seq += batch.num_rows


class Read(DataSourceReader):
    """The log as it is; options since (rows after this seq) and replay (0: all)."""

    def __init__(self, options: dict):
        self.path, self.since, self.replay = options["path"], int(options.get("since", 0)), int(options.get("replay", 0))

    def partitions(self) -> list[Slice]:
        folder = Folder(self.path)
        return slices(folder, self.since, folder.head(), self.replay) or [Slice("", 0, 0, 0)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return rows_of(self.path, partition) if partition.name or partition.missed else iter(())


class Tail(DataSourceStreamReader):
    """The log as it grows; offsets are seqs, so a restart goes on after the last row that was processed."""

    def __init__(self, options: dict):
        self.path, self.since, self.replay = options["path"], int(options.get("since", 0)), int(options.get("replay", MAX_REPLAY))

    def initialOffset(self) -> dict:
        return {"seq": self.since}

    def latestOffset(self) -> dict:
        return {"seq": max(self.since, Folder(self.path).head())}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        return slices(Folder(self.path), start["seq"], end["seq"], self.replay)

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return rows_of(self.path, partition)


class LogSource(DataSource):
    """format("tidewatch_log") with option path."""

    @classmethod
    def name(cls) -> str:
        return "tidewatch_log"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> Read:
        return Read(self.options)

    def streamReader(self, schema) -> Tail:
        return Tail(self.options)

    def writer(self, schema, overwrite: bool) -> BatchAppend:
        if overwrite:
            raise ValueError("a log is only appended to")
        return BatchAppend(self.options)

    def streamWriter(self, schema, overwrite: bool) -> StreamAppend:
        return StreamAppend(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogSource)


def append(rows: DataFrame, path: str, **options: str) -> None:
    """Append rows (columns of EVENT, and if they have it problem, which must be null) as one commit."""
    register(rows.sparkSession)
    rows.write.format("tidewatch_log").options(**options).mode("append").save(path)


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("tidewatch_log").options(**options).load(path)


def outbox(log: DataFrame) -> DataFrame:
    """The outbox as of a log: each order's newest state."""
    return log.where("outbox is not null").groupBy(F.col("outbox.outbox_id").alias("id")).agg(F.max_by("outbox", "seq").alias("o"), F.min("seq").alias("created_seq")).select("o.*", "created_seq")


def enqueue(decided: DataFrame, live: DataFrame) -> DataFrame:
    """Decisions as rows of a log, each page with its order: an episode that has a live order, or gets one by an earlier row, gets no second one but points at the first.

    decided: alert_id, fingerprint, episode_id, at_us, seq (order of arrival), body, pages (boolean), dedup_key,
    payload_sha256, priority, next_us, max_age_us. live: outbox_id, episode_id of queued or sent orders.
    The order's id follows from its episode and first decision, so a repeated batch makes the same.
    """
    own = F.sha2(F.concat_ws("|", "episode_id", "alert_id", F.col("at_us").cast("string")), 256)
    first = decided.where("pages").groupBy("episode_id").agg(F.min_by(F.struct("seq", F.substring(own, 1, 32).alias("id")), "seq").alias("first"))
    had = live.groupBy("episode_id").agg(F.min("outbox_id").alias("had"))
    rows = decided.join(first, "episode_id", "left").join(had, "episode_id", "left")
    box = F.when(F.col("pages"), F.coalesce("had", "first.id"))
    new = F.col("pages") & F.col("had").isNull() & (F.col("seq") == F.col("first.seq"))
    order = F.struct(box.alias("outbox_id"), "episode_id", "dedup_key", "payload_sha256", F.lit("queued").alias("status"), "priority", F.lit(0).alias("attempt"), "next_us", "max_age_us", F.lit(None).cast("string").alias("error"))
    return rows.orderBy("seq").select(F.lit("decision_made").alias("type"), F.lit("engine").alias("actor"), "alert_id", "fingerprint", "episode_id", box.alias("outbox_id"), "at_us", "body", F.when(new, order).alias("outbox"))


def receipts(answers: DataFrame, orders: DataFrame) -> DataFrame:
    """Receipts as rows of a log, each with its order's new state. answers: outbox_id, ok, at_us, next_us, error; orders as outbox() gives them. Answers to unknown orders come out with `problem`, which no log takes."""
    o = orders.select("outbox_id", F.struct("episode_id", "dedup_key", "payload_sha256", "priority", "attempt", "max_age_us").alias("o"))
    rows = answers.join(o, "outbox_id", "left")
    state = F.struct("outbox_id", "o.episode_id", "o.dedup_key", "o.payload_sha256", F.when(F.col("ok"), "delivered").otherwise("queued").alias("status"), "o.priority", (F.col("o.attempt") + 1).alias("attempt"), "next_us", "o.max_age_us", F.when(~F.col("ok"), F.col("error")).alias("error"))
    body = F.to_json(F.struct("outbox_id", "error"))
    return rows.select(F.when(F.col("ok"), "forward_confirmed").otherwise("forward_failed").alias("type"), F.lit("forwarder").alias("actor"), F.lit(None).cast("string").alias("alert_id"), F.lit(None).cast("string").alias("fingerprint"), F.col("o.episode_id").alias("episode_id"), "outbox_id", "at_us", body.alias("body"), F.when(F.col("o").isNotNull(), state).alias("outbox"), F.when(F.col("o").isNull(), "order not found").alias("problem"))


AUDIT = "file string, first long, rows long, place long, problem string"


def audit(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """Each file of the log with the place (seq) and kind of its first fault, null if it is whole; commits that break their own chain or seal are rows without a file.

    Commits are followed on the driver (one small record for each batch); files are read side by side.
    """
    folder, faults, named, before = Folder(path), [], [], b""
    for n in range(1, folder.last() + 1):
        raw = folder.read(folder.commit_name(n))
        commit = json.loads(raw)
        if commit["before"] != hashlib.sha256(before).hexdigest():
            faults.append((None, None, None, n, "commit follows another"))
        if key and not hmac.compare_digest(commit.get("hmac", ""), seal(commit, key)):
            faults.append((None, None, None, n, "seal"))
        named += [(f["name"], f["first"], f["rows"], f["last_hash"]) for f in commit["files"]]
        before = raw

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Folder(path)
        for batch in batches:
            out = []
            for f in batch.to_pylist():
                out.append({k: f[k] for k in ("file", "first", "rows")} | dict(zip(("place", "problem"), first_fault(own, f))))
            yield pa.RecordBatch.from_pylist(out, pa.schema([("file", pa.string()), ("first", pa.int64()), ("rows", pa.int64()), ("place", pa.int64()), ("problem", pa.string())]))

    files = spark.createDataFrame(named, "file string, first long, rows long, last_hash string").repartition(max(1, min(len(named), 1_000)))
    return files.mapInArrow(check, AUDIT).unionByName(spark.createDataFrame(faults, AUDIT))


def first_fault(folder: Folder, f: dict) -> tuple[int | None, str | None]:
    name = f"{folder.root}/data/{f['file']}"
    if not folder.exists(name):
        return f["first"], "file is gone"
    last, seq = GENESIS, f["first"]
    with folder.fs.open_input_file(name) as source:
        for batch in pq.ParquetFile(source).iter_batches(BATCH):
            for row in batch.to_pylist():
                said = row.pop("row_hash")
                last = row_hash(row, last)
                if said != last:
                    return seq, "row is not the one that was written"
                seq += 1
    if seq - f["first"] != f["rows"] or last != f["last_hash"]:
        return seq, "rows are missing or added"
    return None, None


def export(spark: SparkSession, path: str, dest: str, key: str, segment_id: str, after: int, upto: int) -> dict:
    """Rows (after, upto] as JSON lines under dest, and their manifest, sealed; refuses a log that fails its audit. Each exported file is named with its digest."""
    if not key:
        raise ValueError("an export is sealed: a key is needed")
    bad = audit(spark, path, None).where("problem is not null").first()
    if bad:
        raise ValueError(f"the log is broken: {bad['problem']} at {bad['place']}")
    parts = [s for s in slices(Folder(path), after, upto, 0)]
    out_fs, out_root = pa.fs.FileSystem.from_uri(dest)
    out_fs.create_dir(out_root, recursive=True)
    table = spark.createDataFrame([(s.name, s.first) for s in parts], "name string, first long").repartition(max(1, min(len(parts), 1_000)))

    def run(batches):
        fs, root = pa.fs.FileSystem.from_uri(dest)
        for batch in batches:
            for p in batch.to_pylist():
                digest, rows, lo, hi = hashlib.sha256(), 0, None, None
                name = f"{p['first']:020d}.jsonl"
                with fs.open_output_stream(f"{root}/{name}") as f:
                    for b in rows_of(path, Slice(p["name"], p["first"], after, upto)):
                        for r in b.to_pylist():
                            line = canonical(r) + b"\n"
                            f.write(line), digest.update(line)
                            rows, lo, hi = rows + 1, r["at_us"] if lo is None else min(lo, r["at_us"]), r["at_us"] if hi is None else max(hi, r["at_us"])
                yield pa.RecordBatch.from_pylist([{"name": name, "rows": rows, "sha256": digest.hexdigest(), "lo": lo, "hi": hi}], pa.schema([("name", pa.string()), ("rows", pa.int64()), ("sha256", pa.string()), ("lo", pa.int64()), ("hi", pa.int64())]))

    files = [r.asDict() for r in table.mapInArrow(run, "name string, rows long, sha256 string, lo long, hi long").orderBy("name").collect()]
    manifest = {"format": 1, "segment_id": segment_id, "seq_start": after + 1, "seq_end": upto, "event_count": sum(f["rows"] for f in files), "window_start_us": min((f["lo"] for f in files), default=None), "window_end_us": max((f["hi"] for f in files), default=None), "files": [{k: f[k] for k in ("name", "rows", "sha256")} for f in files]}
    manifest["hmac"] = seal(manifest, key)
    with out_fs.open_output_stream(f"{out_root}/manifest.json") as f:
        f.write(canonical(manifest))
    return manifest


def checkpoint(path: str, key: str, now: str, window_start: str = "GENESIS") -> dict:
    """The signed head of a log: what it had when, provable against any later state of it."""
    folder = Folder(path)
    n = folder.last()
    raw = folder.read(folder.commit_name(n)) if n else b""
    doc = {"commits": n, "head_seq": folder.head(), "head_hash": hashlib.sha256(raw).hexdigest(), "window_start_ts": window_start, "window_end_ts": now}
    return doc | {"hmac": seal(doc, key)}


def holds(path: str, doc: dict, key: str) -> bool:
    """Whether a log still begins with what a checkpoint signed."""
    folder = Folder(path)
    raw = folder.read(folder.commit_name(doc["commits"])) if doc["commits"] and folder.exists(folder.commit_name(doc["commits"])) else b""
    return hmac.compare_digest(doc["hmac"], seal(doc, key)) and hashlib.sha256(raw).hexdigest() == doc["head_hash"]


def live_orders(log: DataFrame) -> DataFrame:
    return outbox(log).where(F.col("status").isin(*LIVE)).select("outbox_id", "episode_id")
