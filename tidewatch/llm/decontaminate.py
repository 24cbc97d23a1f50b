"""Benchmark decontamination with a generalised suffix automaton.

Items are normalised to words (A-Z lower-cased; runs of digits, a-z and
characters beyond ASCII) and put into one suffix automaton over word numbers.
Documents stream through it in Spark tasks; where the longest match reaches
WINDOW words, those words are hit and the items of the reached state are noted.
An item of fewer words matches as a whole.

Most words never start a match: only runs of words whose neighbours follow each
other somewhere in an item (the automaton's two-word states, looked up in bulk)
are walked through.

Null text has no words. Items without words or with null text match nothing.
Items with equal ids count once, also if their texts differ; a null id marks
words but is not listed. Repeated documents get equal results, and extra columns
are ignored. Items are sent to executors in parts of at most PART_BYTES of text;
more items than that take more passes over the documents. A text of any length is
walked as a whole; without documents there is no result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import stored

WINDOW = 10
#: Item text that one automaton holds.
PART_BYTES = 8 << 20
#: Upper to lower case; what is no digit, letter or byte of a longer character parts words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class SuffixAutomaton:
    """States of all items' word sequences; `hits` streams a sequence through them."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.number: dict[bytes, int] = {}
        for _, words in items:
            for w in words:
                self.number.setdefault(w, len(self.number))
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int, int]] = []  # state of a prefix, item, words of the item's window
        pairs = set()
        self.alone: set[int] = set()
        for k, (_, words) in enumerate(items):
            ids = [self.number[w] for w in words]
            pairs.update(zip(ids, ids[1:]))
            if len(ids) == 1:
                self.alone.add(ids[0])
            last = 0
            for i, c in enumerate(ids, 1):
                last = self._extend(last, c)
                if i >= window or i == len(ids):
                    ends.append((last, k, min(window, len(ids))))
        # items of windows: a window's state is the ancestor whose lengths include the window's
        self.items: dict[tuple[int, int], set[int]] = {}
        for state, k, n in ends:
            while self.length[self.link[state]] >= n:
                state = self.link[state]
            self.items.setdefault((state, n), set()).add(k)
        self.lengths = sorted({n for _, n in self.items}, reverse=True)
        self.least = self.lengths[-1] if self.lengths else window
        self.names = [None if name is None else name for name, _ in items]
        self.pairs = np.array(sorted(a << 32 | b for a, b in pairs), np.int64)
        self.single = np.array(sorted(self.alone), np.int64)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[last].get(c)) is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of words, at least as long as the shortest window, in which each neighbouring two are two of an item."""
        out = []
        if len(ids) > 1 and len(self.pairs):
            both = ids[:-1] << 32 | ids[1:]
            ok = (ids[:-1] >= 0) & (ids[1:] >= 0)
            at = np.searchsorted(self.pairs, both[ok])
            ok[ok] = self.pairs[np.minimum(at, len(self.pairs) - 1)] == both[ok]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], ok.view(np.int8), [0]])))
            begin, end = edge[::2], edge[1::2] + 1
            long = end - begin >= max(2, self.least)
            out = list(zip(begin[long].tolist(), end[long].tolist()))
        if len(self.single):
            out += [(i, i + 1) for i in np.flatnonzero(np.isin(ids, self.single)).tolist()]
        return out

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """(begin, end of each occurrence of a window; items that have such a window)."""
        ids = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        nxt, link, length = self.next, self.link, self.length
        for begin, end in self.runs(ids):
            state = size = 0
            for i, c in enumerate(ids[begin:end].tolist(), begin + 1):
                while state and c not in nxt[state]:
                    state = link[state]
                    size = length[state]
                if c in nxt[state]:
                    state, size = nxt[state][c], size + 1
                at = state
                for n in self.lengths:
                    if size >= n:
                        while length[link[at]] >= n:
                            at = link[at]
                        if (k := self.items.get((at, n))) is not None:
                            spans.append((i - n, i))
                            found |= k
        return np.array(spans, np.int64).reshape(-1, 2), found

    def covered(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        spans, found = self.hits(words)
        depth = np.zeros(len(words) + 1, np.int64)
        if len(spans):
            np.add.at(depth, spans[:, 0], 1)
            np.add.at(depth, spans[:, 1], -1)
        return np.cumsum(depth[:-1]) > 0, found


_BUILT: dict[str, SuffixAutomaton] = {}


def automaton(name: str, shipped, window: int) -> SuffixAutomaton:
    """One automaton for a worker process, as long as tasks ask for it."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = SuffixAutomaton([(item, words_of(text)) for item, text in shipped.value], window)
    return _BUILT[name]


def parts(items: DataFrame, item_id: str, text: str) -> Iterator[tuple[str, object, bool]]:
    """Name, broadcast list of (item id as text, text) and whether it is the last, of parts of about PART_BYTES at most; one at least."""
    rows = items.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("string").alias("t")).where(F.col("t").isNotNull())
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = 1 + int(total * 1.2) // PART_BYTES
    for k in range(n):
        yield uuid.uuid4().hex, rows.sparkSession.sparkContext.broadcast([tuple(r) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()]), k == n - 1


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: list[str] | None = None, cut: bool = False) -> DataFrame:
    """Columns keep (key alone, if not given), the text as `__text` (cut: without its hit words), `__n_words`, `__ends` (begin, end of maximal hit word ranges) and `__items` (ids) of every row."""
    keep = [key] if keep is None else keep
    kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    out = docs.select(*keep, F.col(text).cast("string").alias("__text"), F.lit(0).cast("long").alias("__n_words"), F.array().cast("array<long>").alias("__ends"), F.array().cast("array<string>").alias("__items"))
    for k, (name, shipped, last) in enumerate(parts(items, item_id, item_text)):
        if k:
            out = stored(out, "decontaminate")

        def run(batches, name=name, shipped=shipped, cut=cut and last):
            sam = automaton(name, shipped, window)
            for batch in batches:
                n = len(keep)
                counts, ends, ids, texts = [], [], [], []
                for t, had, names in zip(batch.column(n).to_pylist(), batch.column(n + 2).to_pylist(), batch.column(n + 3).to_pylist()):
                    words = words_of(t)
                    mask, found = sam.covered(words)
                    for a, b in zip(had[::2], had[1::2]):
                        mask[a:b] = True
                    counts.append(len(words))
                    ends.append(np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).tolist() if found or had else [])
                    texts.append(without(t, ends[-1]) if cut else t)
                    ids.append(sorted({*names, *(sam.names[i] for i in found if sam.names[i] is not None)}))
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string()) if cut else batch.column(n), pa.array(counts, pa.int64()), pa.array(ends, pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.string()))], names=[*keep, "__text", "__n_words", "__ends", "__items"])

        out = out.mapInArrow(run, f"{kept}__text string, __n_words long, __ends array<long>, __items array<string>")
    return out


def n_hit(ends: str = "__ends"):
    """Hit words: ends less begins of the ranges."""
    return F.aggregate(ends, F.struct(F.lit(0).cast("long").alias("s"), F.lit(-1).cast("long").alias("sign")), lambda a, x: F.struct((a.s + a.sign * x).alias("s"), (-a.sign).alias("sign")), lambda a: a.s)


def report(docs: DataFrame, items: DataFrame, key: str = "doc_id", **columns) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 and contaminated."""
    return contamination(docs, items, key, **columns).select(
        key, F.col("__n_words").alias("n_words"), n_hit().alias("n_hit"), F.size("__items").cast("long").alias("n_items"), F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"), (F.size("__ends") > 0).alias("contaminated")
    )


def clean(docs: DataFrame, items: DataFrame, text: str = "text", max_coverage: float = 0.5, **columns) -> DataFrame:
    """docs without hit words; a document with more than max_coverage of its words hit goes as a whole.

    A removed range takes the text from its first word's first character to its last
    word's last. Columns and types are those of docs.
    """
    cols = docs.columns
    # the other columns go as one, so they may have any names
    others = [c for c in cols if c != text]
    packed = docs.select(F.col(f"`{text}`").alias("text"), (F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(0)).alias("row"))
    found = contamination(packed, items, key="row", text="text", keep=["row"], cut=True, **columns)
    found = found.where((F.col("__n_words") == 0) | (n_hit() <= max_coverage * F.col("__n_words")))
    return found.select(*[F.col("__text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in cols])


def without(text: str | None, ends) -> str | None:
    if text is None or not len(ends):
        return text
    raw = text.encode("utf-8", "surrogatepass")
    is_word = np.frombuffer(raw.translate(WORD_BYTES), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[0], is_word.view(np.int8), [0]])))
    begin, end = edge[::2], edge[1::2]
    out, at = [], 0
    for a, b in zip(ends[::2], ends[1::2]):
        out.append(raw[at : begin[a]])
        at = end[b - 1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")
