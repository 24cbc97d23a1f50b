"""Substring dedup of byte strings by a distributed merge sort of suffixes.

Each byte that is covered by a WINDOW-byte string which also starts in a row of
smaller id is removed; strings are judged on the input. Suffixes are compared on
their first WINDOW bytes, so what is sorted are the strings themselves.

1. Windows with the same anchor (see repeats) that follow each other form a segment, a suffix cut where its
   last window ends. A filter drops segments whose anchor occurs once; it never drops one that repeats.
2. Tasks sort segments into runs, in which equal ones are already settled, and front-code them: a segment is
   its common prefix with the one before and the rest. Runs are cut by splitters from a bounded sample and
   exchanged. For each range a loser tree merges the parts of all runs. It keeps with each suffix the length of
   the prefix it is known to share with the last winner, and compares only what lies beyond. Segments that share
   all bytes are equal; those in a row of larger id than the least are repeats as a whole.
3. Windows of unlike segments can be equal too, if the anchor is. The windows of such segments, where they are
   first seen, go through a filter of their own and then, as suffixes of WINDOW bytes, through runs, exchange and
   loser trees again.

Whatever is removed has been found equal byte for byte; hashes only decide what need not be compared.

Null text and texts shorter than a window lose nothing. Repeated rows have equal
ids, so neither removes the other. Rows without an id take no part and keep
everything. Rows of equal id and different text are told apart. Extra columns
are ignored. Long texts are scanned in pieces. Without rows there is no result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import repeats
from tidewatch.llm.common import forget, stored
from tidewatch.llm.hashing import ODD, mix

WINDOW, GRAM = 50, 32
#: Bytes that are scanned at once.
PIECE = 1 << 18
#: Suffixes of a run, of a part that is sent, and of a range, as planned.
RUN, PART, RANGE = 200_000, 8_192, 200_000
#: Rows, and segments of each, that splitters are drawn from.
SAMPLE_ROWS, SAMPLE_EACH = 2_000, 8
#: A value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64), 1)


class Block:
    """Segments of the pieces of some texts: row, start, n (windows), key (hash of the anchor), offset (of the anchor from the start)."""

    def __init__(self, pieces: list[tuple[int, int, bytes]], window: int, gram: int):
        blob = self.blob = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
        size = np.array([len(p) for _, _, p in pieces], np.int64)
        begin = np.cumsum(size) - size
        self.values = BYTE_VALUES[blob]
        self.rolling = repeats.Rolling(self.values)
        sums, n = self.rolling.sums, max(0, len(blob) - gram + 1)
        order = (sums[gram:] - sums[:n]) * self.rolling.down[:n]
        order *= ODD[2]
        at = repeats.anchors(order, window - gram + 1)
        owner = np.repeat(np.arange(len(pieces)), np.maximum(0, size - window + 1))
        within = np.arange(len(owner)) - np.repeat(np.cumsum(np.maximum(0, size - window + 1)) - np.maximum(0, size - window + 1), np.maximum(0, size - window + 1))
        start = begin[owner] + within
        anchor = at[start]
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        self.begin, self.n, self.offset = start[first], np.diff(np.append(first, len(start))), anchor[first] - start[first]
        self.key = mix(order[anchor[first]])
        self.row = np.array([r for r, _, _ in pieces], np.int64)[owner[first]]
        self.start = within[first] + np.array([o for _, o, _ in pieces], np.int64)[owner[first]]


def blocks(texts: list[bytes | None], window: int, gram: int):
    held, size = [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(0, len(text or b"") - window + 1), PIECE):
            piece = text[at : at + PIECE + window - 1]
            held.append((row, at, piece))
            size += len(piece)
            if size >= PIECE:
                yield Block(held, window, gram)
                held, size = [], 0
    if held:
        yield Block(held, window, gram)


def width_of(window: int, gram: int) -> int:
    """Bytes of a segment's key: the longest segment, and a byte each for the anchor's offset and the number of windows."""
    return 2 * window - gram + 2


def segment_keys(b: Block, hit: np.ndarray, window: int, gram: int) -> np.ndarray:
    """A row of bytes for each segment: its own, zeros up to the longest, offset and number of windows. Equal rows are equal segments."""
    longest = 2 * window - gram
    place = np.arange(longest)
    inside = place < (b.n[hit] + window - 1)[:, None]
    out = np.zeros((len(hit), longest + 2), np.uint8)
    out[:, :longest] = np.where(inside, b.blob[np.minimum(b.begin[hit][:, None] + place, len(b.blob) - 1)], 0)
    out[:, longest], out[:, longest + 1] = b.offset[hit], b.n[hit]
    return out


def anchor_of(keys: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the anchor of each segment, from its key."""
    at = keys[:, -2].astype(np.int64)[:, None] + np.arange(gram)
    values = BYTE_VALUES[np.take_along_axis(keys, at, 1)]
    return mix((values * repeats.powers(0, gram)[0][:gram]).sum(1, dtype=np.uint64)).view(np.int64)


def parts_ddl(id_type: str) -> str:
    return f"range int, shared binary, rest binary, ids array<{id_type}>, many array<int>, xs array<long>, starts array<long>, ns array<int>"


def lists(values, edges: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))


def blobs(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


class Run:
    """Keys of one width with their places, sorted once it is full."""

    def __init__(self, width: int, splitters: list[bytes]):
        self.width, self.edges = width, np.array(splitters, f"S{width}")
        self.held: list[tuple] = []
        self.size = 0

    def add(self, keys: np.ndarray, ids: pa.Array, x: pa.Array, start: np.ndarray, n: np.ndarray) -> None:
        self.held.append((keys, ids, x, start, n))
        self.size += len(keys)

    def flush(self) -> pa.RecordBatch:
        """Front-coded parts of a range each, and parts of negative range: places that equal one of smaller id in this run."""
        keys, start, n = (np.concatenate([h[k] for h in self.held]) for k in (0, 3, 4))
        ids, x = (pa.concat_arrays([h[k] for h in self.held]) for k in (1, 2))
        self.held, self.size = [], 0
        rank = pc.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64)
        by_id = np.argsort(rank, kind="stable")
        order = by_id[np.argsort(np.ascontiguousarray(keys[by_id]).view(f"S{self.width}").ravel(), kind="stable")]
        keys, rank = keys[order], rank[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]).any(1)
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        own = rank == rank[first][group]
        kept, many, distinct = order[own], np.bincount(group[own], minlength=len(first)), keys[first]
        # parts: cut where a range ends, and after PART keys
        upto = np.searchsorted(np.ascontiguousarray(distinct).view(f"S{self.width}").ravel(), self.edges)
        cut = np.unique(np.concatenate([np.arange(0, len(distinct), PART), upto, [0, len(distinct)]]))
        shared = np.zeros(len(distinct), np.int64)
        shared[1:] = (distinct[1:] != distinct[:-1]).argmax(1)
        shared[cut[:-1]] = 0
        rest = distinct[np.arange(self.width) >= shared[:, None]]
        at = lambda sizes: np.concatenate([[0], np.cumsum(sizes)])[cut]
        none = np.zeros(len(cut), np.int64)
        coded = [np.searchsorted(upto, cut[:-1], "right").astype(np.int32), blobs(shared.astype(np.uint8), cut), blobs(rest, at(self.width - shared)), lists(ids.take(pa.array(order[first])), cut), lists(many.astype(np.int32), cut), lists(x.take(pa.array(kept)), at(many)), lists(start[kept], at(many)), lists(np.empty(0, np.int32), none)]
        # settled places: neighbours of a row become one
        gone = order[~own]
        gone = gone[np.lexsort((start[gone], x.take(pa.array(gone)).to_numpy(), rank_of(ids, gone)))]
        gx, gs, gn, gr = x.take(pa.array(gone)).to_numpy(), start[gone], n[gone].astype(np.int64), rank_of(ids, gone)
        apart = np.ones(len(gone), bool)
        apart[1:] = (gr[1:] != gr[:-1]) | (gx[1:] != gx[:-1]) | (gs[1:] != gs[:-1] + gn[:-1])
        lead = np.flatnonzero(apart)
        total = np.add.reduceat(gn, lead) if len(lead) else np.empty(0, np.int64)
        cut = np.unique(np.append(np.arange(0, len(lead), PART), len(lead)))
        none = np.zeros(len(cut), np.int64)
        where = -1 - (mix(gs[lead][cut[:-1]].astype(np.uint64) + np.uint64(len(lead))) % np.uint64(len(self.edges) + 1)).astype(np.int32)
        told = [where.astype(np.int32), blobs(np.empty(0, np.uint8), none), blobs(np.empty(0, np.uint8), none), lists(ids.take(pa.array(gone[lead])), cut), lists(np.empty(0, np.int32), none), lists(gx[lead], cut), lists(gs[lead], cut), lists(total.astype(np.int32), cut)]
        names = ["range", "shared", "rest", "ids", "many", "xs", "starts", "ns"]
        both = [pa.concat_arrays([a if isinstance(a, pa.Array) else pa.array(a), b if isinstance(b, pa.Array) else pa.array(b)]) for a, b in zip(coded, told)]
        return pa.RecordBatch.from_arrays(both, names=names)


def rank_of(ids: pa.Array, at: np.ndarray) -> np.ndarray:
    return pc.rank(ids.take(pa.array(at)), tiebreaker="dense").to_numpy().astype(np.int64)


def repeated_segments(texts: list[bytes | None], known, window: int, gram: int):
    """(block, its segments whose anchor passes the filter of repeated ones)."""
    for b in blocks(texts, window, gram):
        hit = np.flatnonzero(known.value.repeated(b.key))
        if len(hit):
            yield b, hit


def segment_runs(rows: DataFrame, window: int, gram: int):
    """Parts of sorted runs of the segments whose anchor passes the filter of repeated ones, and that filter, to be destroyed later. rows: id, x, b."""
    width, id_type = width_of(window, gram), rows.schema["id"].dataType.simpleString()
    n_rows, n_bytes = rows.agg(F.count("*"), F.sum(F.octet_length("b").cast("long"))).first()
    expected = (n_bytes or 0) * 2 / (window - gram + 2)
    known = rows.sparkSession.sparkContext.broadcast(repeats.build(rows.select("b"), lambda texts: (b.key for b in blocks(texts, window, gram)), expected))

    def heads(batches):
        for batch in batches:
            for b, hit in repeated_segments(batch.column(0).to_pylist(), known, window, gram):
                some = np.sort(np.random.default_rng(len(hit)).permutation(len(hit))[: SAMPLE_EACH * len(np.unique(b.row[hit]))])
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in segment_keys(b, hit[some], window, gram)], pa.binary())], names=["head"])

    splitters = splitters_of(rows.select("b").sample(min(1.0, SAMPLE_ROWS / max(1, n_rows)), seed=1).mapInArrow(heads, "head binary"), expected)

    def sort(batches):
        run = Run(width, splitters)
        for batch in batches:
            for b, hit in repeated_segments(batch.column(2).to_pylist(), known, window, gram):
                row = pa.array(b.row[hit])
                run.add(segment_keys(b, hit, window, gram), batch.column(0).take(row), batch.column(1).take(row), b.start[hit], b.n[hit])
                if run.size >= RUN:
                    yield run.flush()
        if run.size:
            yield run.flush()

    return rows.mapInArrow(sort, parts_ddl(id_type)), known


def splitters_of(heads: DataFrame, total: float) -> list[bytes]:
    """Ends of ranges of about RANGE keys, from a bounded sample of keys."""
    wanted = int(-(-total // RANGE))
    if wanted < 2:
        return []
    some = sorted(heads.toArrow()["head"].to_pylist())
    return sorted({some[k * len(some) // wanted] for k in range(1, wanted)}) if some else []


class LoserTree:
    """Merges sorted front-coded runs.

    known[r] is how many bytes the run's next suffix shares with the last suffix that
    beat it; of two that lost to the same winner, the one that shares more is the less.
    """

    def __init__(self, coded: list[tuple[bytes, bytes]], window: int):
        self.window, self.coded = window, coded
        width = 1
        while width < len(coded):
            width *= 2
        self.width = width
        self.index, self.at = [-1] * width, [0] * width
        self.next: list[bytes] = [b""] * width
        self.known = [-1] * width
        self.loser = [0] * width
        for r in range(len(coded)):
            self._advance(r)
        winner = [*range(width)] * 2
        for node in range(width - 1, 0, -1):
            winner[node], self.loser[node] = self._play(winner[2 * node], winner[2 * node + 1])
        self.best = winner[1] if width > 1 else 0

    def _advance(self, r: int) -> None:
        shared, rest = self.coded[r]
        i = self.index[r] = self.index[r] + 1
        if i >= len(shared):
            self.known[r] = -1
            return
        n = self.known[r] = shared[i]
        upto = self.at[r] + self.window - n
        self.next[r] = self.next[r][:n] + rest[self.at[r] : upto]
        self.at[r] = upto

    def _play(self, a: int, b: int) -> tuple[int, int]:
        known = self.known
        n = known[a]
        if n != known[b]:
            return (a, b) if n > known[b] else (b, a)
        if n < 0 or n == self.window:
            return a, b
        x, y = int.from_bytes(self.next[a][n:]), int.from_bytes(self.next[b][n:])
        if x <= y:
            known[b] = self.window - ((x ^ y).bit_length() + 7) // 8
            return a, b
        known[a] = self.window - ((x ^ y).bit_length() + 7) // 8
        return b, a

    def merged(self, base: list[int], keep: bool) -> tuple[list[int], list[int], list[bytes]]:
        """(base of the run and index of each suffix, in order; where a new suffix begins; those suffixes, if kept)."""
        known, loser, index, at, string, coded, width, size = self.known, self.loser, self.index, self.at, self.next, self.coded, self.window, self.width
        items, new, keys, r = [], [], [], self.best
        number = int.from_bytes
        while (n := known[r]) >= 0:
            i = index[r]
            if n < width:
                new.append(len(items))
                if keep:
                    keys.append(string[r])
            items.append(base[r] + i)
            shared, rest = coded[r]
            i += 1
            index[r] = i
            if i < len(shared):
                n = shared[i]
                begin = at[r]
                end = at[r] = begin + width - n
                string[r] = string[r][:n] + rest[begin:end]
            else:
                n = -1
            known[r] = n
            node = (r + size) >> 1
            while node:
                other = loser[node]
                o = known[other]
                # most games are settled by what is known; n is what the present winner shares
                if n < o:
                    loser[node] = r
                    r, n = other, o
                elif n == o and 0 <= n < width:
                    x, y = number(string[r][n:]), number(string[other][n:])
                    if x <= y:
                        known[other] = width - ((x ^ y).bit_length() + 7) // 8
                    else:
                        known[r] = width - ((x ^ y).bit_length() + 7) // 8
                        loser[node], r = r, other
                node >>= 1
        return items, new, keys


def merge(width: int, gram: int | None):
    """Merges the parts of one range: places that equal one of smaller id and, with gram, places of the least id of each key.

    Result: id, x, start, n and, for the latter, k (hash of the anchor) and lead (1 once a key).
    """

    def run(table: pa.Table) -> pa.Table:
        names = ["id", "x", "start", "n", "k", "lead"]
        flat = lambda c: table[c].combine_chunks().flatten()
        ids, x, start = flat("ids"), flat("xs"), flat("starts").to_numpy()
        if table["range"][0].as_py() < 0:
            none = pa.nulls(len(ids), pa.int64())
            return pa.table([ids, x, pa.array(start), flat("ns"), none, none.cast(pa.int32())], names=names)
        coded = list(zip(table["shared"].to_pylist(), table["rest"].to_pylist()))
        base = np.cumsum([0, *(len(c[0]) for c in coded)]).tolist()
        at, new, keys = LoserTree(coded, width).merged(base, gram is not None)
        # items in merged order, and the group of equal ones that each is in
        at, new = np.array(at, np.int64), np.array(new, np.int64)
        group = np.zeros(len(at), np.int64)
        group[new[1:]] = 1
        group = np.cumsum(group)
        rank = pc.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64)[at]
        least = np.minimum.reduceat(rank, new)
        many = flat("many").to_numpy()
        first = np.cumsum(many) - many
        n = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, width)[:, -1].astype(np.int32) if gram else np.ones(len(new), np.int32)

        def places(chosen):
            """(place, item) of all places of chosen items."""
            size = many[at[chosen]]
            return np.repeat(first[at[chosen]] - (np.cumsum(size) - size), size) + np.arange(size.sum()), np.repeat(chosen, size)

        place, item = places(np.flatnonzero(rank > least[group]))
        out = [ids.take(pa.array(at[item])), x.take(pa.array(place)), pa.array(start[place]), pa.array(n[group[item]]), pa.nulls(len(item), pa.int64()), pa.nulls(len(item), pa.int32())]
        if gram:
            anchor = anchor_of(np.frombuffer(b"".join(keys), np.uint8).reshape(-1, width), gram)
            place, item = places(np.flatnonzero(rank == least[group]))
            lead = np.ones(len(item), np.int32)
            lead[1:] = group[item][1:] != group[item][:-1]
            more = [ids.take(pa.array(at[item])), x.take(pa.array(place)), pa.array(start[place]), pa.array(n[group[item]]), pa.array(anchor[group[item]]), pa.array(lead)]
            out = [pa.concat_arrays([a, b]) for a, b in zip(out, more)]
        return pa.table(out, names=names)

    return run


def merged(parts: DataFrame, width: int, gram: int | None, id_type: str) -> DataFrame:
    return parts.groupBy("range").applyInArrow(merge(width, gram), f"id {id_type}, x long, start long, n int, k long, lead int")


class Windows:
    """Windows of segments, given as strings, end to end: hash, owner and begin of each."""

    def __init__(self, strings: list[bytes], window: int):
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.blob = np.frombuffer(b"".join(strings), np.uint8)
        n = size - window + 1
        self.owner = np.repeat(np.arange(len(strings)), n)
        self.within = np.arange(len(self.owner)) - np.repeat(np.cumsum(n) - n, n)
        self.begin = (np.cumsum(size) - size)[self.owner] + self.within
        self.hash = repeats.Rolling(BYTE_VALUES[self.blob]).spans(self.begin, self.begin + window)


def opened_segments(rows: DataFrame, opened: DataFrame, window: int) -> DataFrame:
    """(s, id, x, start) of the segments in column open (start, n) of opened (id_, x_)."""
    both = rows.join(opened, (F.col("id") == F.col("id_")) & (F.col("x") == F.col("x_"))).select("id", "x", "b", "open.start", "open.n")

    def run(batches):
        for batch in batches:
            strings, row, at = [], [], []
            for i, (text, starts, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)))):
                strings += [text[s : s + m + window - 1] for s, m in zip(starts, n)]
                row += [i] * len(starts)
                at += starts
            same = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(strings, pa.binary()), batch.column(0).take(same), batch.column(1).take(same), pa.array(at, pa.int64())], names=["s", "id", "x", "start"])

    return both.mapInArrow(run, f"s binary, id {rows.schema['id'].dataType.simpleString()}, x long, start long")


def window_runs(opened: DataFrame, window: int, total: int) -> DataFrame:
    """Parts of sorted runs of the windows of opened (s, id, x, start) that pass the filter of repeated ones. total: how many windows there are."""
    known = opened.sparkSession.sparkContext.broadcast(repeats.build(opened.select("s"), lambda texts: iter([Windows(texts, window).hash]), total))

    def repeated(strings):
        w = Windows(strings, window)
        return w, np.flatnonzero(known.value.repeated(w.hash)) if len(strings) else np.empty(0, np.int64)

    def keys(w, hit):
        return w.blob[w.begin[hit][:, None] + np.arange(window)]

    def heads(batches):
        for batch in batches:
            w, hit = repeated(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in keys(w, hit)], pa.binary())], names=["head"])

    splitters = splitters_of(opened.select("s").sample(min(1.0, SAMPLE_ROWS * SAMPLE_EACH / max(1, total)), seed=1).mapInArrow(heads, "head binary"), total)

    def sort(batches):
        run = Run(window, splitters)
        for batch in batches:
            for a in range(0, batch.num_rows, 5_000):
                part = batch.slice(a, 5_000)
                w, hit = repeated(part.column(0).to_pylist())
                if len(hit):
                    row = pa.array(w.owner[hit])
                    run.add(keys(w, hit), part.column(1).take(row), part.column(2).take(row), part.column(3).to_numpy()[w.owner[hit]] + w.within[hit], np.ones(len(hit), np.int64))
                if run.size >= RUN:
                    yield run.flush()
        if run.size:
            yield run.flush()

    return opened.mapInArrow(sort, parts_ddl(opened.schema["id"].dataType.simpleString()))


def removed_ranges(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """(id, x, start, n): of rows (id, x, b), lists of the first byte and the number of removed windows that follow each other."""
    rows, id_type = rows.where("id is not null"), rows.schema["id"].dataType.simpleString()
    runs, known = segment_runs(rows, window, gram)
    settled = stored(merged(runs, width_of(window, gram), gram, id_type), "settled")
    known.destroy()
    classes = settled.where("k is not null")
    crowded = classes.groupBy("k").agg(F.sum("lead").alias("classes")).where("classes > 1").select("k")
    chosen = classes.join(crowded, "k", "left_semi")
    opened = stored(chosen.groupBy(F.col("id").alias("id_"), F.col("x").alias("x_")).agg(F.collect_list(F.struct("start", "n")).alias("open")), "chosen")
    strings = stored(opened_segments(rows, opened, window), "opened")
    forget(opened)
    total = strings.agg(F.sum(F.octet_length("s").cast("long") - (window - 1))).first()[0] or 0
    single = merged(window_runs(strings, window, total), window, None, id_type)
    gone = settled.where("k is null").select("id", "x", "start", "n").union(single.select("id", "x", "start", "n"))
    out = stored(gone.groupBy("id", "x").agg(F.collect_list(F.struct("start", "n")).alias("g")).select("id", "x", "g.start", "g.n"), "gone")
    forget(settled, strings)
    return out


def merged_spans(start: np.ndarray, n: np.ndarray, window: int) -> tuple[list[int], list[int]]:
    """Begins and ends of maximal removed byte ranges."""
    order = np.argsort(start, kind="stable")
    begin, end = start[order], (start + n + window - 1)[order]
    upto = np.maximum.accumulate(end)
    new = np.concatenate([[True], begin[1:] > upto[:-1]])
    return begin[new].tolist(), upto[np.append(np.flatnonzero(new)[1:] - 1, len(upto) - 1)].tolist()


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans and the kept bytes (digest: only their SHA-256)."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").cast("binary").alias("b"))
    again = not rows.where("id is not null").groupBy("id").count().where("count > 1").isEmpty()
    rows = rows.select("id", (F.xxhash64("b") if again else F.lit(0).cast("long")).alias("x"), "b")
    gone = removed_ranges(rows, window, gram).withColumnsRenamed({"id": "id_", "x": "x_"})
    both = rows.join(gone, (F.col("id") == F.col("id_")) & (F.col("x") == F.col("x_")), "left").select("id", "b", "start", "n")

    def remove(batches):
        for batch in batches:
            columns = [], [], [], []
            for raw, start, n in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                raw = raw or b""
                begins, ends = merged_spans(start.values.to_numpy(), n.values.to_numpy().astype(np.int64), window) if start.is_valid else ([], [])
                kept = [raw[a:b] for a, b in zip([0, *ends], [*begins, len(raw)])]
                if digest:
                    h = hashlib.sha256()
                    for k in kept:
                        h.update(k)
                for column, value in zip(columns, (len(raw), sum(ends) - sum(begins), len(begins), h.hexdigest() if digest else b"".join(kept))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string() if digest else pa.binary())))], names=[key, "n_bytes", "n_removed", "n_spans", name])

    name = "kept_sha256" if digest else "kept"
    return both.mapInArrow(remove, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, {name} {'string' if digest else 'binary'}")
