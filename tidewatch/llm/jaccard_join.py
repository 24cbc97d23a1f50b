"""N-gram Jaccard self-join by universe partitioning and the pigeonhole principle.

A document's set holds its distinct shingles of some words. Two documents link when
100 * intersection >= percent * union; a Join holds both numbers and what follows
from them. Sets fall into size bands, each wider than the one before by
(100 - percent) / percent, so partners lie in the same or the next band. For a band
whose sets can differ from a partner in H shingles at most, shingles are hashed
to H + 1 segments: partners agree in one segment at least. Each set indexes its
segments' signatures under its own band and, where it can have smaller partners
there, under the band before.

Allocation by cost: an empty segment agrees with every other empty one, the
longest posting list there is, so empty segments are not listed. Each band takes
some segments more than H + 1 instead: if one of two partners has no more empty
segments than that, they agree in a segment that holds shingles. A set with more
empty ones is listed once more, over H + 1 segments and among such sets only; there
the cost of lists of empty segments is weighed against leaving them out and
indexing the others with their one-deletion neighbourhoods as well, which find
partners that differ by one shingle in a segment. Two sets that share empty
segments only, and differ by two shingles or more in each segment that neither
leaves out, have more than half of their segments empty; a set with so many indexes
the empty ones too. How many segments a band takes more, and whether empty ones are
left out, is what costs least by the sizes of all sets. No link is lost, whichever
way a band goes.

Signatures are shuffled once, and sorted; those of one class alone end there. A
signature that a sample of rows shows to be frequent is salted by class, so its
postings are spread over tasks; the sample decides nothing else.

Equal sets form one class; classes are what is joined. In each bucket of equal
signatures classes are first compared with the bucket's least class, exactly,
then, where a bucket still holds several components, with its class of most links.
What is connected needs no further comparison; remaining pairs of a bucket whose
classes lie in different components are all compared. So no link between
components is lost, and a large group of near copies does not become all pairs.

Before shingles are fetched, pairs are held against two exact bounds: sizes, and
the parities of the shingles' counts in BITS places. Each shingle that only one
set has turns one parity, so parities that differ in more places than the sets
may differ in shingles rule the pair out. Large sets have as many places as shingles.

Null text, empty text and text without words have the empty set, linked with
nothing: n_shingles 0, a component of its own. Fewer words than a shingle has are one
shingle. Repeated rows are equal sets, so they share a component. Rows that share
an id but differ in text are documents of their own, told apart by a hash of the text. A row without an id keeps
its n_shingles; its component is the least id it reaches, null if none. Extra columns are ignored.
"""

from __future__ import annotations

from math import erfc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import BATCH_ROWS, forget, stored
from tidewatch.llm.components import components
from tidewatch.llm.hashing import ODD, mix, word_hashes, words_lower

#: Ids of documents that are sent to every executor; more are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000
#: Rows of the sample that shows frequent signatures, the share from which one is salted, and by how many salts.
SAMPLE_ROWS, FREQUENT, SALTS = 2_000, 0.01, 64
#: Buckets of a class before the present one that tell whether a pair has been met.
EARLIER = 8
#: Parities kept of a set, in 64-bit words.
WORDS = 8
BITS = 64 * WORDS
FACTS = ["n", *[f"p{i}" for i in range(WORDS)]]
#: Sets of more shingles than this have parities in as many places as shingles, too, in a column of their own.
WIDE_FROM = 1024
#: Texts that are Python strings at a time.
SLICE = 256


class Join:
    """Shingle size and threshold, and the size bands that follow."""

    def __init__(self, words: int = 3, percent: int = 90):
        if words < 1 or not 50 < percent <= 100:
            raise ValueError("shingles need a word, and the threshold lies above 50 %")
        self.words, self.percent = words, percent
        #: First size of each band; the last holds more shingles than any text can have.
        self.edges = [1]
        while self.edges[-1] < 1 << 40:
            self.edges.append(self.edges[-1] * 100 // percent + 1)
        self._edges = np.array(self.edges, np.int64)

        #: Segments that each band has beyond H + 1, and bands whose listed empty segments are left out; see allocate.
        self.spare: dict[int, int] = {}
        self.leave_out: set[int] = set()

    def allocate(self, sizes: list[tuple[int, int]]) -> None:
        """From (set size, number of sets): per band the spare segments that make fewest signatures, and whether one-deletion neighbourhoods cost less than pairs of equal empty segments."""
        self.spare, self.leave_out = {}, set()
        held: dict[int, list[tuple[int, int]]] = {}
        for n, count in sizes:
            for k in self.bands(n):
                held.setdefault(k, []).append((n, count))
        for k, listed in held.items():
            n, count = np.array(listed, np.float64).T
            m = self.segments(k)
            tries = {0, 1, 2, 3, *(-(-m * share // 100) for share in range(1, 41))}
            beyond = {g: share_beyond(n, m + g, g) for g in tries}
            self.spare[k] = min(sorted(tries), key=lambda g: float((count * (m + g + beyond[g] * (m + n))).sum()))
            rare = count * beyond[self.spare[k]]
            pairs = (float(rare.sum()) * (self.spare[k] + 1)) ** 2 / m / 2
            if pairs > float((rare * n).sum()):
                self.leave_out.add(k)

    def bands(self, n: int) -> tuple[int, ...]:
        """Under which a set of n shingles is indexed: its own, and the one before if partners can be there."""
        own = self.band(n)
        return (own, own - 1) if own and -(-n * self.percent // 100) < self.edges[own] else (own,)

    def band(self, size: int) -> int:
        return int(np.searchsorted(self._edges, size, "right")) - 1

    def segments(self, k: int) -> int:
        """One more than the most shingles in which a set of band k can differ from a partner of its size or larger."""
        r = self.edges[k + 1] - 1
        return (r + r * 100 // self.percent) * (100 - self.percent) // (100 + self.percent) + 1

    def may_link(self, a: str, b: str):
        """No bound rules out the pair whose facts have the suffixes a and b."""
        differ = sum((F.bit_count(F.col(f"p{i}{a}").bitwiseXOR(F.col(f"p{i}{b}"))) for i in range(1, WORDS)), F.bit_count(F.col(f"p0{a}").bitwiseXOR(F.col(f"p0{b}"))))
        na, nb = F.col(f"n{a}"), F.col(f"n{b}")
        return (differ * (100 + self.percent) <= (na + nb) * (100 - self.percent)) & (na * 100 >= nb * self.percent) & (nb * 100 >= na * self.percent)


def share_beyond(n: np.ndarray, segments: int, spare: int) -> np.ndarray:
    """About the share of sets of n shingles with more than spare of the segments empty: their number is taken as Poisson, from 30 on as normal."""
    empty = segments * (1 - 1 / segments) ** n
    z = (spare + 0.5 - empty) / np.sqrt(2 * np.maximum(empty, 30))
    normal = np.array([erfc(x) / 2 for x in z.tolist()])
    term, fewer = np.exp(-empty), np.zeros(len(n))
    for j in range(min(spare, 200) + 1):
        fewer += term
        term = term * empty / (j + 1)
    return np.where(empty < 30, np.maximum(1 - fewer, 0), normal)


def shingles(words: list[bytes], hashes: np.ndarray, seed: int, size: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    if not words:
        return np.empty(0, np.uint64)
    n = min(size, len(words))
    h = np.full(len(words) - n + 1, (n << 8) + seed, np.uint64)
    for k in range(n):
        h = mix(h * ODD[0] + hashes[k : len(hashes) - n + 1 + k])
    return np.unique(h)


def sets_of(texts: list[str | None], seed: int, size: int):
    """The shingle set of each text."""
    for text in texts:
        words = words_lower(text)
        yield shingles(words, word_hashes(words), seed, size)


def sets_in(column: pa.Array, seed: int, size: int):
    """The shingle set of each text of a column, of which a slice at a time becomes Python strings."""
    for begin in range(0, len(column), SLICE):
        yield from sets_of(column.slice(begin, SLICE).to_pylist(), seed, size)


def class_of(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit digests of a set."""
    a, b = (int(mix(s, k).sum(dtype=np.uint64)) for k in (2, 3))
    return a - (a >> 63 << 64), b - (b >> 63 << 64)


def parities(s: np.ndarray) -> np.ndarray:
    """Of the number of shingles in each of BITS places, packed."""
    odd = np.bincount((mix(s, 1) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_parities(s: np.ndarray) -> bytes | None:
    """Parities of a large set in a power of two of places, at least its size."""
    if len(s) <= WIDE_FROM:
        return None
    bits = 1 << len(s).bit_length()
    odd = np.bincount((mix(s, 1) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def turned(a: bytes, b: bytes) -> int:
    """In how many places the parities of two large sets differ; the longer one is folded to the other's size."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def signatures(s: np.ndarray, join: Join) -> np.ndarray:
    """Signatures under which a set is indexed."""
    n, out = len(s), []
    if not n:
        return np.empty(0, np.uint64)
    content = mix(s, 1)
    low, high = (content & np.uint64(0xFFFFFFFF)).astype(np.float64), (content >> np.uint64(32)).astype(np.float64)

    def dealt(m: int, family: int):
        """Over m segments: each shingle's segment, and of the segments the sum of contents, the place and whether it holds any."""
        at = (s % np.uint64(m)).astype(np.int64)
        total = np.bincount(at, low, m).astype(np.uint64) + (np.bincount(at, high, m).astype(np.uint64) << np.uint64(32))
        return at, total, mix(np.arange(m, dtype=np.uint64) + np.uint64(family << 40), 1), np.bincount(at, minlength=m) > 0

    for k in join.bands(n):
        m, spare = join.segments(k), join.spare.get(k, 0)
        _, total, place, full = dealt(m + spare, 2 * k)
        out.append(mix(total[full] ^ place[full]))
        if m + spare - full.sum() <= spare:
            continue
        at, total, place, full = dealt(m, 2 * k + 1)
        if k not in join.leave_out or full.all():
            out.append(mix(total ^ place))
        else:
            shown = full if 2 * full.sum() >= m else np.ones(m, bool)
            out += [mix(total[shown] ^ place[shown]), mix((total[at] - content) ^ place[at])]
    return np.unique(np.concatenate(out))


def scan_sets(docs: DataFrame, seed: int, join: Join) -> DataFrame:
    """(row's id and x, n, c, d, parities): size, two digests and parities of each row's set."""

    def run(batches):
        for batch in batches:
            found, wide = [], []
            for s in sets_in(batch.column(2), seed, join.words):
                found.append((len(s), *class_of(s), *parities(s).tolist()))
                wide.append(wide_parities(s))
            columns = list(zip(*found)) if found else [()] * (3 + WORDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in columns), pa.array(wide, pa.binary())], names=["id", "x", "n", "c", "d", *FACTS[1:], "wide"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, x long, n long, c long, d long, {', '.join(f'{x} long' for x in FACTS[1:])}, wide binary")


def scan_signatures(docs: DataFrame, seed: int, join: Join, frequent: np.ndarray) -> DataFrame:
    """(sig, salt, c) of each class, once a task. salt is 0 unless sig is one of frequent, a sorted array."""

    def run(batches):
        done: set[int] = set()
        for batch in batches:
            sig, cls, size = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0

            def send():
                at, c = np.concatenate(sig).view(np.int64), np.concatenate(cls)
                often = np.isin(at, frequent) if len(frequent) else np.zeros(len(at), bool)
                salt = np.where(often, 1 + c % SALTS, 0).astype(np.int8)
                return pa.RecordBatch.from_arrays([pa.array(at), pa.array(salt), pa.array(c)], names=["sig", "salt", "c"])

            for s in sets_in(batch.column(2), seed, join.words):
                c = class_of(s)[0] if len(s) else 0
                if not len(s) or c in done:
                    continue
                done.add(c)
                got = signatures(s, join)
                sig.append(got)
                cls.append(np.full(len(got), c, np.int64))
                size += len(got)
                if size > 1 << 18:
                    yield send()
                    sig, cls, size = [], [], 0
            if size:
                yield send()

    return docs.mapInArrow(run, "sig long, salt byte, c long")


def frequent_signatures(rows: DataFrame, n: int, seed: int, join: Join) -> np.ndarray:
    """Signatures that a share of FREQUENT of a bounded sample of rows has: at most 1 / FREQUENT times those of a row."""
    some = rows.sample(min(1.0, SAMPLE_ROWS / max(1, n)), seed=1)

    def run(batches):
        for batch in batches:
            for s in sets_in(batch.column(2), seed, join.words):
                yield pa.RecordBatch.from_arrays([pa.array(signatures(s, join).view(np.int64))], names=["sig"])

    often = some.mapInArrow(run, "sig long").groupBy("sig").agg(F.count("*").alias("n")).where(F.col("n") >= max(4, SAMPLE_ROWS * FREQUENT))
    return np.sort(often.select("sig").toArrow()["sig"].to_numpy())


def shared_signatures(rows: DataFrame, seed: int, join: Join, frequent: np.ndarray) -> DataFrame:
    """(sig, c, m) of signatures that several classes have, each once; m is the least class of the signature, among those of its salt.

    Signatures of the same classes become one, named by a hash of these; where two names clash, their classes share a bucket, and no pair is lost.
    """
    each = Window.partitionBy("sig", "salt")
    hits = scan_signatures(rows, seed, join, frequent).withColumn("before", F.lag("c").over(each.orderBy("c"))).where("before is null or before <> c")
    hits = hits.withColumns({"m": F.min("c").over(each), "top": F.max("c").over(each), "all": F.bit_xor(F.xxhash64("c")).over(each)})
    return hits.where("m <> top or salt > 0").select(F.when(F.col("salt") > 0, F.col("sig")).otherwise(F.col("all")).alias("sig"), "c", "m").distinct()


def with_earlier(left: DataFrame) -> DataFrame:
    """left (sig, u, ...) and earlier_u: the EARLIER buckets before sig that class u is in."""
    return left.withColumn("earlier_u", F.collect_list("sig").over(Window.partitionBy("u").orderBy("sig").rowsBetween(-EARLIER, -1)))


def first_met():
    """u and v have not just been in one bucket. It holds in the first bucket of every pair, and in few others."""
    return ~F.arrays_overlap("earlier_u", "earlier_v")


def scan_shingles(docs: DataFrame, seed: int, join: Join) -> DataFrame:
    """(c, s): digest and shingles of each row's set, for rows that are compared."""

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE):
                found = [s.view(np.int64) for s in sets_of(batch.column(2).slice(begin, SLICE).to_pylist(), seed, join.words)]
                at = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
                values = pa.array(np.concatenate([np.empty(0, np.int64), *found]))
                yield pa.RecordBatch.from_arrays([pa.array([class_of(s.view(np.uint64))[0] for s in found], pa.int64()), pa.ListArray.from_arrays(pa.array(at), values)], names=["c", "s"])

    return docs.mapInArrow(run, "c long, s array<long>")


def linked(pairs: DataFrame, shingle_sets: DataFrame, join: Join) -> DataFrame:
    """The pairs (u, v) whose sets meet the threshold, by exact intersection. v can be a hub: its rows are joined while they are small."""
    a, b = shingle_sets.select(F.col("c").alias("u"), F.col("s").alias("su")), shingle_sets.select(F.col("c").alias("v"), F.col("s").alias("sv"))
    both = pairs.join(b, "v").join(a, "u").withColumn("i", F.size(F.array_intersect("su", "sv")))
    return both.where(f"100L * i >= {join.percent}L * (size(su) + size(sv) - i)").select("u", "v")


def narrowed(pairs: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    """pairs without those of large sets whose wide parities rule them out."""
    wide = classes.where("wide is not null")
    of = lambda side: wide.select(F.col("c").alias(side), F.col("n").alias(f"n{side}"), F.col("wide").alias(f"w{side}"))
    both = pairs.join(of("u"), "u", "left").join(of("v"), "v", "left").select("u", "v", "nu", "nv", "wu", "wv")

    def run(batches):
        for batch in batches:
            ok = [a is None or b is None or turned(a, b) * (100 + join.percent) <= (m + n) * (100 - join.percent) for m, n, a, b in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "u long, v long")


def verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, seed: int, join: Join) -> DataFrame:
    """The pairs (u, v) that link, stored; shingles are read from a row of each class in pairs."""
    compared = pairs.select(F.col("u").alias("c")).union(pairs.select("v")).distinct()
    wanted = stored(classes.join(compared, "c", "left_semi").select(F.col("rep").alias("id_"), F.col("rep_x").alias("x_")), "compared")
    few = wanted.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    found = rows.join(F.broadcast(wanted) if few else wanted, F.col("id").eqNullSafe(F.col("id_")) & (F.col("x") == F.col("x_")), "left_semi")
    sets = stored(scan_shingles(found, seed, join).dropDuplicates(["c"]), "shingles", BATCH_ROWS)
    out = stored(linked(pairs, sets, join), "links")
    forget(wanted, sets)
    return out


def text_hash(text: str):
    """Tells rows of one id, or of none, apart."""
    return F.xxhash64(F.col(text).cast("string"))


def members(docs: DataFrame, key: str, text: str, join: Join) -> tuple[DataFrame, DataFrame]:
    """Per row: id, x (hash of the text), n, c (class). Per class: c, rep (its least id) and component."""
    rows = docs.select(F.col(key).alias("id"), text_hash(text).alias("x"), F.col(text).cast("string").alias("t"))
    for seed in range(8):
        sets = stored(scan_sets(rows, seed, join), "sets", BATCH_ROWS)
        classes = stored(sets.where("n > 0").groupBy("c").agg(F.min("id").alias("rep"), F.coalesce(F.min_by("x", "id"), F.min("x")).alias("rep_x"), F.max("wide").alias("wide"), (F.min("d") != F.max("d")).alias("mixed"), *[F.max(x).alias(x) for x in FACTS]), "classes")
        if classes.where("mixed").isEmpty():
            break
    sizes = sets.where("n > 0").groupBy("n").agg(F.countDistinct("c").alias("sets")).collect()  # a row for each distinct size
    join.allocate([tuple(r) for r in sizes])
    facts, classes = classes.select("c", *FACTS), classes.select("c", "rep", "rep_x", "n", "wide")
    facts_of = lambda side: facts.select(F.col("c").alias(side), *[F.col(x).alias(f"{x}_{side}") for x in FACTS])
    frequent = frequent_signatures(rows, sets.count(), seed, join)
    buckets = stored(shared_signatures(rows, seed, join, frequent), "buckets", BATCH_ROWS)
    shown = lambda df: df.distinct().join(facts_of("u"), "u").join(facts_of("v"), "v").where(join.may_link("_u", "_v")).select("u", "v")
    # with the least class of all its buckets; then with the least of each bucket, unless they are connected by now
    first = stored(narrowed(shown(buckets.where("c <> m").groupBy(F.col("c").alias("u")).agg(F.min("m").alias("v"))), classes, join), "pairs", BATCH_ROWS)
    links = verified(first, classes, rows, seed, join)
    known = components(links)
    near = buckets.where("c <> m").select(F.col("c").alias("u"), F.col("m").alias("v"))
    if len(frequent):
        least = buckets.groupBy("sig").agg(F.min("m").alias("v"), F.max("m").alias("x")).where("v <> x").select("sig", "v")
        near = near.union(buckets.select("sig", F.col("m").alias("u")).distinct().join(least, "sig").where("u <> v").select("u", "v"))
    placed_of = lambda side: known.select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))
    near = near.distinct().join(placed_of("u"), "u", "left").join(placed_of("v"), "v", "left").where("not coalesce(cu, u) <=> coalesce(cv, v)").select("u", "v").join(first, ["u", "v"], "left_anti")
    second = stored(narrowed(shown(near), classes, join), "pairs", BATCH_ROWS)
    new = verified(second, classes, rows, seed, join)
    had, links = links, stored(links.union(new), "links")
    known = components(links)
    forget(first, second, had, new)
    for hubs in (True, False):
        # buckets that still hold several components: compare with the class of most links, then across components
        placed = stored(buckets.join(known.withColumnRenamed("id", "c"), "c", "left").select("sig", "c", F.coalesce("component", "c").alias("component")), "placed")
        several = placed.groupBy("sig").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("k")).where("a <> b and k > 2").select("sig")
        left = placed.join(several, "sig", "left_semi").withColumnsRenamed({"c": "u", "component": "cu"}).join(facts_of("u"), "u")
        if hubs:
            degree = links.select("u").union(links.select("v")).groupBy("u").agg(F.count("*").alias("degree"))
            hub = left.join(degree, "u", "left").groupBy("sig").agg(F.max_by(F.struct("u", "cu", *[f"{x}_u" for x in FACTS]), F.struct(F.coalesce("degree", F.lit(0)), "u")).alias("h"))
            right = hub.select("sig", F.col("h.u").alias("v"), F.col("h.cu").alias("cv"), *[F.col(f"h.{x}_u").alias(f"{x}_v") for x in FACTS])
            apart, fresh = (F.col("cu") != F.col("cv")) & (F.col("u") != F.col("v")), F.lit(True)
        else:
            left = with_earlier(left)
            right = left.select("sig", F.col("u").alias("v"), F.col("cu").alias("cv"), F.col("earlier_u").alias("earlier_v"), *[F.col(f"{x}_u").alias(f"{x}_v") for x in FACTS])
            apart = (F.col("cu") != F.col("cv")) & (F.col("u") > F.col("v"))
            fresh = first_met()
        right = right.withColumnRenamed("sig", "sig_")
        more = left.join(right, (F.col("sig") == F.col("sig_")) & apart & join.may_link("_u", "_v") & fresh).select("u", "v").distinct()
        more = stored(narrowed(more.join(links, ["u", "v"], "left_anti"), classes, join), "pairs", BATCH_ROWS)
        if not more.isEmpty():
            had, new = links, verified(more, classes, rows, seed, join)
            links = stored(had.union(new), "links")
            forget(had, new)
            known = components(links)
        del several, left, right
        forget(placed, more)
    least = classes.join(known.withColumnRenamed("id", "c"), "c", "left").select("c", "rep", F.coalesce("component", "c").alias("component"))
    least = stored(least, "placed")
    forget(buckets, links)
    return sets.select("id", "x", "n", "c"), least


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, percent: int = 90) -> DataFrame:
    """Per row: key, n_shingles and component_id."""
    sets, least = members(docs, key, text, Join(words, percent))
    named = least.join(least.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("c", "component_id")
    out = sets.join(named, "c", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, percent: int = 90) -> DataFrame:
    """docs with one row of each component: of least id (none comes last), then of least class and text hash; columns are those of docs.

    Rows with the empty set are components of their own; of those, repeated rows of one id stay once.
    """
    sets, least = members(docs, key, text, Join(words, percent))
    placed = sets.where("n > 0").join(least.select("c", "component"), "c")
    first = placed.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "c", "x")).alias("first"))
    kept = first.select(F.col("first.id").alias("__id"), F.col("first.x").alias("__x"), F.lit(False).alias("__own")).union(sets.where("n = 0").select("id", "x", F.col("id").isNull()).distinct())
    kept = stored(kept, "kept")
    # rows go as one column, so theirs may have any names
    asked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{key}`").alias("key"), text_hash(text).alias("hash"))
    held = asked.join(kept, F.col("key").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__x")))
    again = sets.groupBy("id", "x").count().where("count > 1")
    if again.isEmpty():
        return held.select("row.*")
    return held.where("__own").select("row").union(held.where("not __own").dropDuplicates(["key", "hash"]).select("row")).select("row.*")
