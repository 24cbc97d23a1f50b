"""Substring dedup of word windows with a prefilter of repeated anchors.

Words are runs of bytes other than space and \\t to \\r. A window is WINDOW
consecutive words of one document. The first pass counts the anchors of all
windows (see repeats), partition by partition, into a filter of the repeated ones. The second
pass sends on only what passes the filter, and not a row a window:
windows that follow each other and share an anchor form a segment, known by a
128-bit cryptographic digest of its words.

Exact grouping: segments of equal anchor and digest form a class. If it has several
members, all their windows are repeated. Where a class of one member shares its anchor with
other classes, the windows of each of those classes, from one member of it, are
grouped by the digest of their words; those that several classes have are repeated.
Equal windows have equal anchors at equal offsets, so none is missed. Each word
that a repeated window covers is removed.

Counting is a partial aggregate, so a passage that a third of all documents hold
is one row a task; joining the counts back splits where a key is crowded.

Null text has no words. A document of fewer words than a window keeps all.
Repeated rows are documents of their own: their windows start elsewhere too and
both lose them. Rows are told apart by id and text; rows equal in both share what
is removed. A text of any length is scanned as a whole. Without rows there is no result. Null ids are documents like others. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import repeats
from tidewatch.llm.common import chunks, forget, stored
from tidewatch.llm.hashing import word_hashes, words_raw

WINDOW = 35
GRAM = 16
CHUNK_CHARS = 1_000_000


class Block:
    """Words of some texts end to end, with the windows that lie within one text."""

    def __init__(self, texts: list[str | None], window: int, gram: int):
        words: list[bytes] = []
        upto = [0]
        for t in texts:
            words += words_raw(t)
            upto.append(len(words))
        self.words, self.begin = words, np.array(upto, np.int64)
        self.values = word_hashes(words) if words else np.empty(0, np.uint64)
        self.rolling = repeats.Rolling(self.values)
        self.grams = self.rolling.grams(gram)
        at = repeats.anchors(self.grams, window - gram + 1)
        owner = np.repeat(np.arange(len(texts)), np.diff(self.begin))[: len(at)]
        start = np.arange(len(at))
        fits = start + window <= self.begin[owner + 1]
        self.start, self.owner, self.anchor = start[fits], owner[fits], at[fits]

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash of the anchor, text, first word, number of windows) of each run of windows with one anchor."""
        if not len(self.anchor):
            return np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 3
        new = np.concatenate([[True], (self.anchor[1:] != self.anchor[:-1]) | (self.owner[1:] != self.owner[:-1])])
        at = np.flatnonzero(new)
        return self.grams[self.anchor[at]], self.owner[at], self.start[at], np.diff(np.append(at, len(new)))

    def digests(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return digests(self.words, begin, end)


def digests(words: list[bytes], begin, end) -> np.ndarray:
    """Two 64-bit integers for each range of words, from a cryptographic digest of the words themselves."""
    joined = b" ".join(words)
    upto = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=upto[1:])
    made = [hashlib.blake2b(joined[a:b], digest_size=16).digest() for a, b in zip(upto[begin].tolist(), (upto[end] - 1).tolist())]
    return np.frombuffer(b"".join(made), np.int64).reshape(-1, 2)


def blocks(texts: list[str | None], window: int, gram: int):
    for a, b in chunks(texts, CHUNK_CHARS):
        yield a, Block(texts[a:b], window, gram)


def segments(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """(k: hash of the anchor, h1, h2: digest; id, x, code: start and number of windows) of segments whose anchor passes the filter of repeated ones, stored."""
    expected = repeats.total_bytes(rows.select("t")) / 5 * 2 / (window - gram + 2)
    id_type = rows.schema["id"].dataType.simpleString()
    known = rows.sparkSession.sparkContext.broadcast(repeats.build(rows.select("t"), lambda texts: (b.segments()[0] for _, b in blocks(texts, window, gram)), expected))

    def candidates(batches):
        for batch in batches:
            for first, b in blocks(batch.column(2).to_pylist(), window, gram):
                key, owner, start, n = b.segments()
                hit = np.flatnonzero(known.value.repeated(key)) if len(key) else key
                if not len(hit):
                    continue
                owner, start, n = owner[hit], start[hit], n[hit]
                h = b.digests(start, start + n + window - 1)
                row = pa.array(owner + first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[hit].view(np.int64)), pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column(0).take(row), batch.column(1).take(row), pa.array((start - b.begin[owner]) * window + n - 1)], names=["k", "h1", "h2", "id", "x", "code"]
                )

    out = stored(rows.mapInArrow(candidates, f"k long, h1 long, h2 long, id {id_type}, x long, code long"), "segments")
    known.destroy()
    return out


def opened_windows(rows: DataFrame, opened: DataFrame, window: int) -> DataFrame:
    """(h1, h2, id, x, start, alone) of each window of the segments in opened (id_, x_, open: (code, alone))."""
    both = rows.join(opened, F.col("id").eqNullSafe(F.col("id_")) & F.col("x").eqNullSafe(F.col("x_"))).select("id", "x", "t", "open.code", "open.alone")

    def run(batches):
        for batch in batches:
            found, row, starts, lone = [np.empty((0, 2), np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, bool)]
            for i, text in enumerate(batch.column(2).to_pylist()):
                code, alone = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (3, 4))
                n = code % window + 1
                start = np.repeat(code // window, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                found.append(digests(words_raw(text), start, start + window))
                row.append(np.full(len(start), i))
                starts.append(start)
                lone.append(np.repeat(alone, n))
            h, same = np.concatenate(found), pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column(0).take(same), batch.column(1).take(same), pa.array(np.concatenate(starts)), pa.array(np.concatenate(lone))], names=["h1", "h2", "id", "x", "start", "alone"])

    return both.mapInArrow(run, f"h1 long, h2 long, id {rows.schema['id'].dataType.simpleString()}, x long, start long, alone boolean")


def repeated_windows(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """(id, x, codes): runs of repeated windows of a row as start * window + number of windows - 1, stored. rows: id, x (hash of the text), t."""
    places = segments(rows, window, gram)
    by = ["k", "h1", "h2"]
    classes = stored(places.groupBy(*by).agg(F.count("*").alias("n"), F.min(F.struct("id", "x", "code")).alias("first")), "classes")
    several = classes.where("n > 1").select(*[F.col(c).alias(f"{c}_") for c in by])
    sure = places.join(several, (F.col("k") == F.col("k_")) & (F.col("h1") == F.col("h1_")) & (F.col("h2") == F.col("h2_"))).select("id", "x", "code")
    crowded = classes.groupBy("k").agg(F.count("*").alias("classes"), F.min("n").alias("least")).where("classes > 1 and least = 1").select("k")
    open_ = classes.join(crowded, "k", "left_semi").groupBy(F.col("first.id").alias("id_"), F.col("first.x").alias("x_")).agg(F.collect_list(F.struct("first.code", (F.col("n") == 1).alias("alone"))).alias("open"))
    windows = stored(opened_windows(rows, open_, window), "windows")
    again = windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select(F.col("h1").alias("h1_"), F.col("h2").alias("h2_"))
    more = windows.where("alone").join(again, (F.col("h1") == F.col("h1_")) & (F.col("h2") == F.col("h2_"))).select("id", "x", (F.col("start") * window).alias("code"))
    out = stored(sure.union(more).groupBy("id", "x").agg(F.collect_list("code").alias("codes")), "repeated")
    del several, sure, crowded, open_, again, more
    forget(places, classes, windows)
    return out


def marked(words: int, codes, window: int) -> np.ndarray:
    """Which words the windows of codes cover."""
    depth = np.zeros(words + 1, np.int64)
    if codes is not None and len(codes):
        at = np.asarray(codes)
        np.add.at(depth, at // window, 1)
        np.add.at(depth, at // window + at % window + window, -1)
    return np.cumsum(depth[:-1]) > 0


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """Per row: key, n_words, n_removed and the kept words joined by a space (digest: only their SHA-256)."""
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("x"), F.col(text).cast("string").alias("t"))
    found = repeated_windows(rows, window, gram).withColumnsRenamed({"id": "id_", "x": "x_"})
    both = rows.join(found, F.col("id").eqNullSafe(F.col("id_")) & (F.col("x") == F.col("x_")), "left").select("id", "t", "codes")

    def remove(batches):
        for batch in batches:
            n, gone, out = [], [], []
            for t, at in zip(batch.column(1).to_pylist(), batch.column(2)):
                words = words_raw(t)
                off = marked(len(words), at.values.to_numpy() if at.is_valid else None, window)
                kept = b" ".join([w for w, x in zip(words, off.tolist()) if not x]) if off.any() else b" ".join(words)
                n.append(len(words))
                gone.append(int(off.sum()))
                out.append(hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())], names=[key, "n_words", "n_removed", name])

    name = "kept_sha256" if digest else "kept"
    return both.mapInArrow(remove, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_words long, n_removed long, {name} string")
