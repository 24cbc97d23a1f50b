"""Byte-level BPE encoding and decoding.

Two tiers. A minimal perfect hash over the vocabulary resolves every pre-token
that is a vocabulary entry. A pre-token that is none is merged by a heap of
ranked pairs over a linked list of its bytes. A bounded memo numbers the distinct
pre-tokens of a task and keeps their ids, so each is resolved once while it is there.

Null text counts as empty text: no ids. Empty text has no ids; without rows there is no result. Texts of any
length are handled in pieces of pre-tokens, so memory does not grow with them.
Rows are independent: repeated rows and repeated ids give repeated results.
Extra columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import BATCH_ROWS, chunks

#: Rank files above this size are refused: the vocabulary goes to every executor.
MAX_VOCABULARY_BYTES = 64 << 20
#: Characters of text whose pre-tokens are held at once, and pre-tokens of a piece of a longer text.
CHUNK_CHARS, PIECE_TOKENS = 400_000, 100_000
#: Pre-tokens, and ids of these, that a task remembers.
MEMO_ENTRIES, MEMO_IDS = 400_000, 4_000_000
#: Odd multipliers of the displacement and of the mixing, and the word they wrap in.
STEP, MIX, MASK = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (1 << 64) - 1


class PerfectHash:
    """Minimal perfect hash of byte strings: hash, then displace; a bucket of one key names its slot."""

    def __init__(self, keys: list[bytes]):
        n = max(1, len(keys))
        self.size, self.buckets = n, max(1, n // 2)
        self.shift = np.zeros(self.buckets, np.int64)
        self.slot_of = np.full(n, -1, np.int64)
        groups: dict[int, list[int]] = {}
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            groups.setdefault(h % self.buckets, []).append(i)
        free = [True] * n
        singles = []
        for bucket, members in sorted(groups.items(), key=lambda g: -len(g[1])):
            if len(members) == 1:
                singles.append((bucket, members[0]))
                continue
            shift = 0
            while True:
                slots = {self._slot(hashes[i], shift) for i in members}
                if len(slots) == len(members) and all(free[s] for s in slots):
                    break
                shift += 1
            self.shift[bucket] = shift
            for i in members:
                s = self._slot(hashes[i], shift)
                free[s], self.slot_of[s] = False, i
        left = (s for s, is_free in enumerate(free) if is_free)
        for bucket, i in singles:
            s = next(left)
            self.shift[bucket], self.slot_of[s] = -s - 1, i

    def _slot(self, h: int, shift: int) -> int:
        x = (h + shift * STEP) & MASK
        x = ((x ^ (x >> 32)) * MIX) & MASK
        return (x ^ (x >> 32)) % self.size

    def slots(self, tokens: list[bytes]) -> np.ndarray:
        """The only key index that each token can be; the caller compares."""
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
        shift = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        x = h + np.maximum(shift, 0).astype(np.uint64) * np.uint64(STEP)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(MIX)
        moved = (x ^ (x >> np.uint64(32))) % np.uint64(self.size)
        return self.slot_of[np.where(shift < 0, -shift - 1, moved.astype(np.int64))]


#: Characters up to U+024F by class; texts of these alone are split by the standard library's faster engine.
LATIN = {r"\p{L}": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"\p{N}": "0-9\xb2\xb3\xb9\xbc-\xbe", r"\s": "\t-\r \x85\xa0", r"\S": "^\t-\r \x85\xa0"}
BEYOND_LATIN = re.compile("[^\x00-\u024f]")


def latin_pattern(pattern: str) -> re.Pattern | None:
    """pattern with its Unicode classes written out for LATIN; None if it uses others."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        name = next((k for k in LATIN if pattern.startswith(k, i)), pattern[i])
        if name == "\\" or name == r"\S" and inside:
            return None
        inside = name == "[" or inside and name != "]"
        out.append(name if name not in LATIN else LATIN[name] if inside else f"[{LATIN[name]}]")
        i += len(name)
    return re.compile("".join(out))


def other_classes(pattern: str) -> tuple[str, str] | None:
    """(expression for the characters whose classes differ, pattern with those taken out of its classes); None if there are none.

    The regex package follows a later version of Unicode than tiktoken: characters
    that are letters or numbers here but were not assigned there. tiktoken itself is
    asked, about the characters that this Python's own tables do not know.
    """
    later = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn"]
    out, found = pattern, set()
    for name in (r"\p{L}", r"\p{N}"):
        here = regex.compile(name)
        asked = tiktoken.Encoding("class", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        differ = [c for c in later if here.match(c) and not asked.encode_ordinary(c)]
        if differ and name in pattern:
            found.update(differ)
            out = out.replace(name, f"[{name}--[{ranges(differ)}]]")
    return (f"[{ranges(sorted(found))}]", out) if found else None


def ranges(chars: list[str]) -> str:
    """Sorted characters as ranges of a character class."""
    out: list[list[int]] = []
    for c in map(ord, chars):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


class Numbered(dict):
    """Numbers keys in the order in which they are first asked for; new are those that were not looked up before."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        n = self[key] = len(self)
        return n


class ByteBpe:
    """Encoder and decoder for a table of ranked byte strings."""

    def __init__(self, ranked: list[tuple[bytes, int]], pattern: str, other: tuple[str, str] | None = None):
        self.keys = [k for k, _ in ranked]
        self.hash = PerfectHash(self.keys)
        self.split = regex.compile(pattern)
        self.other = other and (re.compile(other[0]), regex.compile(other[1], regex.V1))
        self.split_latin = latin_pattern(pattern)
        self.bytes_of = [b""] * (1 + max(r for _, r in ranked))
        for k, r in ranked:
            self.bytes_of[r] = k
        ids = dict(ranked)
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        # every way to put a vocabulary entry together from two others, as one integer per pair
        self.pairs = {(ids[k[:i]] << 32) | ids[k[i:]]: r for k, r in ranked for i in range(1, len(k)) if k[:i] in ids and k[i:] in ids}
        self.byte_pairs = [self.pairs.get(a << 32 | b, -1) for a in self.byte_ids for b in self.byte_ids]
        self.packed = [r.to_bytes(4, "little") for _, r in ranked]
        self.forget()

    def forget(self) -> None:
        """Empty the memo: numbers of pre-tokens, and of each number its first place in flat and how many ids it has."""
        self.memo = Numbered()
        self.flat, self.begin, self.length = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)

    def pre_tokens(self, text: str) -> list[str]:
        if self.split_latin is not None and not BEYOND_LATIN.search(text):
            return self.split_latin.findall(text)
        return self.splitter(text).findall(text)

    def splitter(self, text: str) -> regex.Pattern:
        """The pattern, with classes as the vocabulary's own library has them where the text needs it."""
        return self.other[1] if self.other and self.other[0].search(text) else self.split

    def merge(self, token: bytes) -> list[int]:
        """Ids of a pre-token that is no vocabulary entry: lowest rank first, leftmost among equals."""
        n, pair, first = len(token), self.pairs.get, self.byte_pairs
        ids = [*map(self.byte_ids.__getitem__, token)]
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        # of each part that is left, the rank of its pair with the next one; -1: none
        ranks = [first[a << 8 | b] for a, b in zip(token, token[1:])]
        ranks.append(-1)
        heap = [r << 32 | i for i, r in enumerate(ranks) if r >= 0]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i, rank = top & 0xFFFFFFFF, top >> 32
            # an entry is stale if its left part was merged away or its pair has changed since
            if ranks[i] != rank:
                continue
            j = after[i]
            ids[i], ids[j], ranks[j] = rank, -1, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = ranks[i] = pair(rank << 32 | ids[k], -1)
                if r >= 0:
                    heappush(heap, r << 32 | i)
            else:
                ranks[i] = -1
            if (h := before[i]) >= 0:
                r = ranks[h] = pair(ids[h] << 32 | rank, -1)
                if r >= 0:
                    heappush(heap, r << 32 | h)
        return [x for x in ids if x >= 0]

    def resolve(self, tokens: list[str]) -> list[bytes]:
        """Ids of each of some distinct pre-tokens, as little-endian 32-bit integers."""
        raw = [t.encode("utf-8", "surrogatepass") for t in tokens]
        found, keys, packed, merge = self.hash.slots(raw).tolist(), self.keys, self.packed, self.merge
        return [packed[key] if keys[key] == token else array("I", merge(token)).tobytes() for token, key in zip(raw, found)]

    def encode_tokens(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, number of ids of each pre-token)."""
        if len(self.memo) > MEMO_ENTRIES or len(self.flat) > MEMO_IDS:
            self.forget()
        codes = np.fromiter(map(self.memo.__getitem__, tokens), np.int64, len(tokens))
        if new := self.memo.new:
            ids = self.resolve(new)
            length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            self.begin = np.append(self.begin, len(self.flat) + np.cumsum(length) - length)
            self.length = np.append(self.length, length)
            self.flat = np.append(self.flat, np.frombuffer(b"".join(ids), "<u4"))
            new.clear()
        n = self.length[codes]
        at = np.repeat(self.begin[codes] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return self.flat[at], n

    def encode(self, text: str | None) -> list[int]:
        return self.encode_tokens(self.pre_tokens(text or ""))[0].tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digest_long(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids and of the decoded bytes, a piece at a time."""
        found, n, coded, decoded = (m.group() for m in self.splitter(text).finditer(text)), 0, hashlib.sha256(), hashlib.sha256()
        while piece := list(islice(found, PIECE_TOKENS)):
            ids, _ = self.encode_tokens(piece)
            n += len(ids)
            coded.update(ids.tobytes())
            decoded.update(self.decode(ids.tolist()))
        return n, coded.hexdigest(), decoded.hexdigest()

    def digest(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        for begin, end in chunks(texts, CHUNK_CHARS):
            part = [t or "" for t in texts[begin:end]]
            if end == begin + 1 and len(part[0]) > CHUNK_CHARS:
                yield self.digest_long(part[0])
                continue
            tokens: list[str] = []
            upto = [0]
            for t in part:
                tokens += self.pre_tokens(t)
                upto.append(len(tokens))
            ids, n = self.encode_tokens(tokens)
            upto = np.concatenate([[0], np.cumsum(n)])[upto].tolist()
            as_ints = ids.tolist()
            for a, b in zip(upto, upto[1:]):
                yield b - a, hashlib.sha256(ids[a:b].tobytes()).hexdigest(), hashlib.sha256(self.decode(as_ints[a:b])).hexdigest()


def read_ranks(spark: SparkSession, path: str) -> list[tuple[bytes, int]]:
    """Rank file, `base64 rank` a line, read through Spark from local or shared storage; its size is checked."""
    url = path if "://" in path else f"file://{path}"
    row = spark.read.format("binaryFile").load(url).select("length").first()
    if row["length"] > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path}: {row['length']} bytes; at most {MAX_VOCABULARY_BYTES} can go to every executor")
    lines = bytes(spark.read.format("binaryFile").load(url).select("content").first()["content"]).split(b"\n")
    return [(base64.b64decode(a), int(b)) for a, b in (x.split() for x in lines if x.strip())]


_BUILT: dict[str, ByteBpe] = {}


def built(key: str, shipped: tuple, pattern: str) -> ByteBpe:
    """One encoder for a worker process, as long as it lives."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = ByteBpe(shipped[0], pattern, shipped[1])
    return _BUILT[key]


class BpeTokenizer:
    """The operator: encode, decode or digest a column of texts."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        ranked = read_ranks(spark, path)
        self.key = hashlib.sha256(repr((ranked, pattern)).encode()).hexdigest()
        self.pattern, self.ranked = pattern, spark.sparkContext.broadcast((ranked, other_classes(pattern)))

    def encode(self, df: DataFrame, text: str = "text", into: str = "ids") -> DataFrame:
        """All columns of df and the ids of column text."""
        key, ranked, pattern = self.key, self.ranked, self.pattern

        @F.pandas_udf("array<int>")
        def ids_of(texts):
            bpe = built(key, ranked.value, pattern)
            return texts.map(bpe.encode, na_action=None)

        return df.withColumn(into, ids_of(F.coalesce(F.col(text), F.lit(""))))

    def decode(self, df: DataFrame, ids: str = "ids", into: str = "decoded") -> DataFrame:
        """All columns of df and the bytes that column ids stands for."""
        key, ranked, pattern = self.key, self.ranked, self.pattern

        @F.pandas_udf("binary")
        def bytes_of(rows):
            bpe = built(key, ranked.value, pattern)
            return rows.map(lambda x: b"" if x is None else bpe.decode(map(int, x)), na_action=None)

        return df.withColumn(into, bytes_of(F.col(ids)))

    def digest(self, df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """key, n_tokens, ids_sha256 and decoded_sha256 of each row; encodes and decodes whole texts."""
        name, ranked, pattern = self.key, self.ranked, self.pattern
        schema = f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

        def run(batches):
            bpe = built(name, ranked.value, pattern)
            for batch in batches:
                rows = [row for begin in range(0, batch.num_rows, BATCH_ROWS) for row in bpe.digest(batch.column(1).slice(begin, BATCH_ROWS).to_pylist())]
                columns = list(zip(*rows)) if rows else [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())],
                    names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
                )
            # the worker may go on to other operators
            bpe.forget()
            pa.default_memory_pool().release_unused()

        return df.select(key, F.col(text).cast("string")).mapInArrow(run, schema)
