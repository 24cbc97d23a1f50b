"""Best-fit packing: documents as token sequences of a bounded length, by patterns that non-negative least squares fit to the histogram of lengths.

Only the histogram, of max_tokens entries at most, comes to the driver. There, patterns
of a few documents are enumerated over classes of lengths, non-negative least squares
fits how often each is needed, the counts are rounded, each pattern is filled with
lengths that are there (the last document of a pattern is the one that fits best), and
what is left over is packed by decreasing length, best fit first. The plan speaks of
lengths and ranks, not of documents: a piece finds its place from its length and its
rank among pieces of equal length, which is counted by partition, so a length that a
third of all pieces have is dealt like any other.

Null texts count as empty; an empty text is its end token alone. Repeated rows and
repeated or null ids are packed each on its own. An empty table gives no rows. A text
is read through in stretches, so that a very long one needs no more memory than its
stretch and one piece. Columns other than the asked ones are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import stored

#: Tokens of a sequence, the id that ends a document, classes of lengths and documents of a pattern.
MAX_TOKENS, END_ID, CLASSES, PATTERN_SIZE = 4096, 1, 128, 3
#: Characters of a text that are looked at together; pieces of words that a worker remembers; characters of the longest odd word remembered.
STRETCH, REMEMBERED, LONG_WORD = 1 << 20, 600_000, 64

#: Characters on which every version of Unicode agrees: ASCII and the letters of Latin-1.
_PLAIN = re.compile("[\0-\x7fÀ-ÖØ-öø-ÿ]*")
#: The tokenizer's pattern over lower-cased texts of those.
_PIECES = re.compile("[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\t-\r a-z0-9ß-öø-ÿ]+")
_SPACE, _CHUNKS = re.compile("[\t-\r ]"), re.compile("[^\t-\r ]+")
#: What the file names its normalizer, pattern and added tokens; other files are tokenized by the library alone.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary, as a table for translate."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: b if b in shown else 256 + hidden.index(b) for b in range(256)}


def pack_ids(ids: list[int]) -> bytes:
    """ids as little-endian 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Ids(dict):
    """Ids of a piece of a word, as bytes; a piece that is not remembered is asked of the tokenizer."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        said = json.loads(self.whole.to_str())
        self.added = [t["content"] for t in said["added_tokens"]]
        steps = (said["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.quick = (
            [n["type"] for n in (said["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and [(s["type"], (s.get("pattern") or {}).get("Regex")) for s in steps] == [("Split", _PATTERN), ("ByteLevel", None)]
            and not any(_SPACE.search(t) or not t for t in self.added)
        )
        self.letters = byte_letters()
        self.model = self.whole.model.tokenize

    def __missing__(self, piece: str) -> bytes:
        """A piece after a line feed is a word that the library cuts by itself."""
        if piece[0] == "\n":
            out = self.library(piece[1:])
        else:
            out = pack_ids([t.id for t in self.model(piece.encode().decode("latin-1").translate(self.letters))])
        if len(piece) <= LONG_WORD:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = out
        return out

    def library(self, text: str) -> bytes:
        return pack_ids(self.whole.encode(text, add_special_tokens=False).ids)

    def plain(self, text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and not any(t in text for t in self.added)

    def of(self, text: str) -> Iterator[bytes]:
        """Ids of a text, stretch by stretch. White space ends words and has no ids, so a text can be cut there."""
        if not self.quick:
            yield self.library(text)
            return
        begin = 0
        while begin < len(text):
            cut = _SPACE.search(text, begin + STRETCH) if len(text) - begin > STRETCH else None
            end = cut.start() if cut else len(text)
            part = text if end - begin == len(text) else text[begin:end]
            if self.plain(part):
                pieces = _PIECES.findall(part.lower())
            else:
                pieces = [p for word in _CHUNKS.findall(part) for p in (_PIECES.findall(word.lower()) if self.plain(word) else ["\n" + word])]
            yield b"".join(map(self.__getitem__, pieces))
            begin = end


_TOKENIZERS: dict[str, Ids] = {}


def tokenizer(path: str) -> Ids:
    """One for each worker and file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Ids(path)
    return _TOKENIZERS[path]


def cut(ids: Ids, text: str | None, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> Iterator[bytes]:
    """A document's pieces of max_tokens ids at most, each as bytes; the end token is the last one's last."""
    size, held = 4 * max_tokens, bytearray()
    for part in _ended(ids.of(text or ""), end_id):
        held += part
        if len(held) > size:
            whole = (len(held) - 1) // size * size
            for k in range(0, whole, size):
                yield bytes(held[k : k + size])
            del held[:whole]
    yield bytes(held)


def _ended(parts: Iterator[bytes], end_id: int) -> Iterator[bytes]:
    yield from parts
    yield end_id.to_bytes(4, "little")


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", max_tokens: int = MAX_TOKENS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """key, piece, start, length and ids_crc32 of each piece of each document; with_ids adds the ids as little-endian 32-bit integers."""
    kind = docs.schema[key].dataType
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = tokenizer(path)
        for batch in batches:
            row, piece, start, length, crc, kept, size = [], [], [], [], [], [], 0
            for r in range(batch.num_rows):
                at = 0
                for k, part in enumerate(cut(ids, batch.column(1)[r].as_py(), max_tokens, end_id)):
                    n = len(part) // 4
                    row.append(r), piece.append(k), start.append(at), length.append(n), crc.append(zlib.crc32(part))
                    at += n
                    if with_ids:
                        kept.append(part)
                        size += len(part)
                    if len(row) >= 10_000 or size > STRETCH * 8:
                        yield made(batch, row, piece, start, length, crc, kept)
                        row, piece, start, length, crc, kept, size = [], [], [], [], [], [], 0
            if row:
                yield made(batch, row, piece, start, length, crc, kept)

    def made(batch, row, piece, start, length, crc, kept):
        columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, *([pa.array(kept, pa.binary())] if with_ids else [])], ["key", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    schema = f"key {kind.simpleString()}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return out.mapInArrow(run, schema).withColumnRenamed("key", key)


def patterns(classes: int = CLASSES, size: int = PATTERN_SIZE) -> list[tuple[int, ...]]:
    """All ways to fill a sequence with up to size documents, as classes in decreasing order that add up to all classes."""

    def of(left: int, most: int, slots: int) -> Iterator[tuple[int, ...]]:
        if slots == 1:
            if 0 < left <= most:
                yield (left,)
            return
        for first in range(min(left - slots + 1, most), 0, -1):
            if first * slots < left:
                return
            for rest in of(left - first, first, slots - 1):
                yield first, *rest

    return [p for n in range(1, size + 1) for p in of(classes, classes, n)]


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by an active set: columns enter by their gradient, and leave where the solution would turn negative."""
    x, inside = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    small = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0.0)))
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[inside] = -np.inf
        best = int(np.argmax(slope))
        if not slope[best] > small:
            break
        inside[best] = True
        while True:
            at = np.flatnonzero(inside)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - s[low], 1e-300))
            x[at] += step * (s - x[at])
            inside[at[x[at] <= 1e-12]] = False
            x[~inside] = 0
            if not inside.any():
                break
    return x


class Left:
    """How many pieces of each length are left, with the largest one up to a length at hand."""

    def __init__(self, histogram: dict[int, int]):
        self.n = {k: v for k, v in histogram.items() if v > 0}
        self.there = sum(1 << k for k in self.n)

    def largest(self, most: int, least: int = 1) -> int:
        """The largest length from least to most of which pieces are left, else 0."""
        if most < least:
            return 0
        found = (self.there & ((2 << most) - 1)).bit_length() - 1
        return found if found >= least else 0

    def take(self, lengths: list[int], times: int) -> None:
        for k in lengths:
            self.n[k] -= times
            if not self.n[k]:
                self.there &= ~(1 << k)

    def often(self, lengths: list[int]) -> int:
        """How many sequences of such lengths can be made."""
        return min(self.n[k] // lengths.count(k) for k in set(lengths))


def fill(left: Left, lengths: list[int], room: int) -> list[int]:
    """lengths with the best fitting others, largest first, while there is room."""
    used: dict[int, int] = {}
    for k in lengths:
        used[k] = used.get(k, 0) + 1
    most = room
    while most and (k := left.largest(most)):
        free = left.n[k] - used.get(k, 0)
        if free <= 0:
            most = k - 1
            continue
        n = min(free, room // k)
        lengths = lengths + [k] * n
        used[k] = used.get(k, 0) + n
        room -= n * k
        most = min(room, k - 1)
    return lengths


def plan(histogram: dict[int, int], max_tokens: int = MAX_TOKENS, classes: int = CLASSES, size: int = PATTERN_SIZE) -> list[tuple[list[int], int]]:
    """(lengths in a sequence, how many such sequences) for all pieces of a histogram of lengths 1 to max_tokens.

    Each step uses up a length or a pattern, so the plan has no more entries than both together.
    """
    left, out = Left(histogram), []
    width = -(-max_tokens // min(classes, max_tokens))
    top = max_tokens // width
    kinds = [p for p in patterns(top, size) if len(p) > 1]

    def use(lengths: list[int], times: int) -> None:
        left.take(lengths, times)
        out.append((lengths, times))

    if n := left.n.get(max_tokens, 0):
        use([max_tokens], n)
    b = np.zeros(top + 1)
    for k, n in left.n.items():
        b[min(-(-k // width), top)] += n
    a = np.zeros((top + 1, len(kinds)))
    for j, p in enumerate(kinds):
        for c in p:
            a[c, j] += 1
    weight = np.arange(top + 1.0)[:, None]  # long pieces are hard to place afterwards
    times = np.rint(nnls(weight * a, weight[:, 0] * b)).astype(int) if kinds else np.zeros(0, int)
    for j in sorted(np.flatnonzero(times), key=lambda j: (-kinds[j][0], kinds[j])):
        wanted = int(times[j])
        while wanted > 0:
            lengths, room = [], max_tokens
            for i, c in enumerate(kinds[j]):
                most = room if i == len(kinds[j]) - 1 else min(c * width, room)
                k = left.largest(most, (c - 1) * width + 1)
                while k and left.n[k] <= lengths.count(k):
                    k = left.largest(k - 1, (c - 1) * width + 1)
                if not k:
                    break
                lengths.append(k)
                room -= k
            if len(lengths) < len(kinds[j]):
                break
            lengths = fill(left, lengths, room)
            now = min(wanted, left.often(lengths))
            use(lengths, now)
            wanted -= now
    while k := left.largest(max_tokens):
        lengths = fill(left, [k], max_tokens - k)
        use(lengths, left.often(lengths))
    return out


def places(planned: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """The plan as a table by length and rank: where ranks begin, the first sequence, how many of the length are in one, and their offset."""
    given: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in planned:
        at = 0
        for k in sorted(set(lengths), reverse=True):
            n = lengths.count(k)
            rows.append((k, given.get(k, 0), sequence, n, at))
            given[k] = given.get(k, 0) + n * times
            at += n * k
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "begin", "sequence", "each", "offset"), table.T))


#: Ranks of equal lengths stay below this.
_RANKS = 1 << 44


def pack(rows: DataFrame, length: str = "length", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """rows with sequence_id and offset. Lengths lie between 1 and max_tokens; others raise an error.

    Rows are written once with their rank among those of equal length in their partition; the ranks' beginnings come from counts by partition and length.
    """
    spark, names = rows.sparkSession, rows.columns
    schema = "part long, rank long, size long, row struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in rows.schema) + ">"

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(max_tokens + 1, np.int64)
        for batch in batches:
            size = batch.column(0).to_numpy(zero_copy_only=False)
            if batch.column(0).null_count or (len(size) and (size.min() < 1 or size.max() > max_tokens)):
                raise ValueError(f"lengths must lie between 1 and {max_tokens}")
            order = np.argsort(size, kind="stable")
            found, first, n = np.unique(size[order], return_index=True, return_counts=True)
            rank = np.empty(len(size), np.int64)
            rank[order] = np.arange(len(size)) - np.repeat(first, n) + np.repeat(seen[found], n)
            seen[found] += n
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(size), part)), pa.array(rank), pa.array(size), batch.column(1)], ["part", "rank", "size", "row"])

    kept = stored(rows.select(F.col(length).cast("long").alias("size"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")).mapInArrow(ranked, schema), "pieces")
    counts = stored(kept.groupBy("part", "size").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    table = places(plan(histogram, max_tokens))
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("part", "size", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    known = spark.sparkContext.broadcast(table)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = known.value
        keys = t["length"] * _RANKS + t["begin"]
        for batch in batches:
            size, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            at = np.searchsorted(keys, size * _RANKS + rank, "right") - 1
            nth, slot = np.divmod(rank - t["begin"][at], t["each"][at]) if len(size) else (rank, rank)
            sequence, offset = t["sequence"][at] + nth, t["offset"][at] + slot * size
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], ["row", "sequence_id", "offset"])

    if not histogram:
        return kept.select("row.*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    asked = kept.join(begins, ["part", "size"]).select("size", (F.col("rank") + F.col("begin")).alias("rank"), "row")
    out = asked.mapInArrow(placed, f"row {kept.schema['row'].dataType.simpleString()}, sequence_id long, offset long")
    return out.select("row.*", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """Packed pieces (with ids) as sequences: sequence_id, ids (the pieces' ids in order of offset), and the offset at which each piece begins. A group is one sequence, so it is bounded."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.expr("aggregate(transform(parts, p -> p.ids), cast('' as binary), (a, x) -> concat(a, x))").alias("ids"), F.col("parts.offset").alias("begins"))
