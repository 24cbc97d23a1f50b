"""What the two exact substring deduplications share: rolling hashes, anchors, and a filter of repeated anchors.

A window of fixed length is represented by its anchor, the short gram in it with
the least hash, leftmost among equals. Equal windows have equal anchors at equal
offsets, and two places of a window have two places of the anchor; so a window's
count is at most its anchor's, and a filter that lets every repeated anchor pass
never loses a repeated window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import forget, stored
from tidewatch.llm.hashing import ODD, mix

BASES = [int(ODD[0]), int(ODD[1])]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Bits of a key's fingerprint besides those that number the expected keys; keys of a piece, as planned; pieces at most; keys of a message to the pieces.
SPARE, PIECE, MAX_PIECES, MESSAGE = 8, 1 << 19, 1 << 14, 1 << 22
#: Bits of the filter to a repeated key, and their bounds (128 MB). A fuller filter passes more keys on, and loses none.
BITS_PER_KEY, MIN_BITS, MAX_BITS = 16, 1 << 16, 1 << 30
#: Low bits that hold a position while the least hash of a window is sought.
PLACE = np.uint64((1 << 28) - 1)


def powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of base k and of its inverse."""
    if k not in _POWERS or len(_POWERS[k][0]) <= n:
        size = 1 << max(16, n.bit_length())
        made = []
        for b in (BASES[k], pow(BASES[k], -1, 1 << 64)):
            x = np.full(size + 1, b, np.uint64)
            x[0] = 1
            made.append(np.cumprod(x, dtype=np.uint64))
        _POWERS[k] = tuple(made)
    return _POWERS[k]


class Rolling:
    """Hashes of any span of a sequence of 64-bit values, in constant time each."""

    def __init__(self, values: np.ndarray, k: int = 0):
        self.k, n = k, len(values)
        up, self.down = powers(k, n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def spans(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64), self.k)

    def grams(self, size: int) -> np.ndarray:
        n = max(0, len(self.sums) - size)
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n], 2 + self.k)


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of width grams, the position of its least one, leftmost among equals."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    v = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    if span < width:
        v = np.minimum(v[:n], v[width - span : width - span + n])
    return (v & PLACE).astype(np.int64)


class Places:
    """Where keys of an expected number go: a fingerprint of bits each, whose upper ones are the piece."""

    def __init__(self, expected: float):
        pieces = 1
        while pieces < min(MAX_PIECES, expected / PIECE):
            pieces *= 2
        self.pieces, self.bits = pieces, max(20, int(expected).bit_length()) + SPARE

    def fingerprints(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    @property
    def span(self) -> int:
        """Fingerprints of a piece."""
        return (1 << self.bits) // self.pieces


class Filter:
    """Two bits for each repeated fingerprint, within the slots of its piece."""

    def __init__(self, places: Places, slots: int, packed: np.ndarray):
        self.places, self.slots, self.packed = places, slots, packed

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key passes: all that occur twice do, and some others."""
        prints = self.places.fingerprints(keys)
        out, piece = np.ones(len(keys), bool), prints // self.places.span * self.slots
        for at in slots_of(prints, self.slots):
            at = piece + at
            out &= (self.packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def slots_of(prints: np.ndarray, slots: int):
    h = mix(prints.view(np.uint64), 1)
    for k in range(2):
        yield (h >> np.uint64(32 * k) & np.uint64(slots - 1)).astype(np.int64)


def width_of(mean: float) -> int:
    """Bytes of a difference."""
    return next((w for w in (1, 2, 3) if 256**w >= 2 * mean), 4)


def gaps(at: np.ndarray, width: int) -> bytes:
    """Sorted integers as differences, width bytes each: the greatest number adds itself and goes on."""
    most = 256**width - 1
    step = np.diff(at, prepend=0)
    more = step // most
    out = np.full(len(at) + int(more.sum()), most, "<u4")
    out[np.cumsum(more + 1) - 1] = step % most
    return out.view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def from_gaps(raw, width: int) -> np.ndarray:
    step = np.zeros((len(raw) // width, 4), np.uint8)
    step[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    step = step.view("<u4").ravel()
    return np.cumsum(step, dtype=np.int64)[step < 256**width - 1]


def build(rows: DataFrame, keys_of, expected: float) -> Filter:
    """Filter of the repeated ones of the keys that keys_of yields for a column of texts, which are read once. expected: about how many keys there are.

    Each task sends the fingerprints of its own keys, once or twice each, to their
    pieces; there the repeated ones are told exactly. The filter is sized by their
    number, within bounds, and passes through the driver to the executors.
    """
    places = Places(expected)

    def touched(batches):
        def send(held):
            at = np.sort(np.concatenate([places.fingerprints(keys) for keys in held]))
            more = np.ones(len(at), bool)
            more[2:] = at[2:] != at[:-2]
            at = at[more]
            width, number = width_of((1 << places.bits) / len(at)), at // places.span
            edge = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(at)]])
            for k in range(0, len(edge) - 1, 64):
                some = list(zip(edge[k : k + 64].tolist(), edge[k + 1 : k + 65].tolist()))
                yield pa.RecordBatch.from_arrays([pa.array([int(number[a]) for a, _ in some], pa.int32()), pa.array([width] * len(some), pa.int32()), pa.array([gaps(at[a:b] - number[a] * places.span, width) for a, b in some], pa.binary())], names=["piece", "width", "prints"])

        held, size = [], 0
        for batch in batches:
            for keys in keys_of(batch.column(0).to_pylist()):
                held.append(keys)
                size += len(keys)
                if size >= MESSAGE:
                    yield from send(held)
                    held, size = [], 0
        if size:
            yield from send(held)

    def told(table: pa.Table) -> pa.Table:
        at = np.sort(np.concatenate([from_gaps(raw.as_buffer(), w) for w, raw in zip(table["width"].to_pylist(), table["prints"])]))
        at = np.unique(at[1:][at[1:] == at[:-1]])
        width = width_of(places.span / max(1, len(at)))
        return pa.table([pa.array([table["piece"][0].as_py()], pa.int32()), pa.array([width], pa.int32()), pa.array([gaps(at, width)], pa.binary()), pa.array([len(at)], pa.int64())], names=["piece", "width", "prints", "n"])

    sent = rows.mapInArrow(touched, "piece int, width int, prints binary")
    found = stored(sent.groupBy("piece").applyInArrow(told, "piece int, width int, prints binary, n long"), "repeated")
    repeated = found.agg(F.sum("n")).first()[0] or 0
    bits = max(MIN_BITS, 64 * places.pieces)
    while bits < min(MAX_BITS, repeated * BITS_PER_KEY):
        bits *= 2
    slots = bits // places.pieces

    def packed(batches):
        for batch in batches:
            for piece, width, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                prints, on = from_gaps(raw.as_buffer(), width) + piece * places.span, np.zeros(slots, np.uint8)
                for at in slots_of(prints, slots):
                    on[at] = 1
                yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())], names=["piece", "bits"])

    whole = np.zeros(bits // 8, np.uint8)
    for row in found.mapInArrow(packed, "piece int, bits binary").toLocalIterator():
        whole[row["piece"] * slots // 8 : (row["piece"] + 1) * slots // 8] = np.frombuffer(row["bits"], np.uint8)
    forget(found)
    return Filter(places, slots, whole)


def total_bytes(rows: DataFrame) -> int:
    return rows.agg(F.sum(F.octet_length(rows.columns[-1]).cast("long"))).first()[0] or 0
