"""Merkle manifest, divergence audit and best-fit packing against brute force, on small tables with nulls, empty and long texts, ties, repeated rows, hot groups and clashing columns."""

import collections
import hashlib
import random
import re
import struct
import zlib

import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tidewatch.llm import divergence, merkle, packing, queries
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp long, idx long, leaf string, term string, n long, length long, part long, row string, sequence_id long"
WORDS = ["river", "Stone", "été", "naïve", "東京", "don't", "x1y", "--", "42", "Ünder", "we'll", "a"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, 7, "leaf", "term", 7, 7, 7, "row", 7) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice(WORDS) + ("\n" if rng.random() < 0.1 else "") for _ in range(n))
    out = []
    for k in range(260):
        source = "hot" if k % 3 == 0 else rng.choice(["a", "b", "é", None, "", f"one{k}"])
        t = rng.choice([None, "", text(rng.randint(1, 80))])
        out.append((k, t, rng.choice(["en", "de", None]), source, None if k % 9 == 0 else k))
    out += [(5, "again", "en", "hot", 1), (5, "again", "en", "hot", 1), (None, "no id", "en", "hot", 1), (None, None, None, None, None), (7, text(30_000), "fr", "a", 3)]
    return out


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    doc_id, _, lang, source, n_chars = row
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(level):
    """Levels of a tree over digests."""
    out = [level]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def beside(levels, k):
    """(left siblings, right siblings) of leaf k, level by level."""
    out = []
    for level in levels[:-1]:
        b = k // 3 * 3
        out.append((level[b:k], level[k + 1 : b + 3]))
        k //= 3
    return out


def manifest_of(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        changed = r[1] if r[1] is None or r[0] is None or zlib.crc32(str(r[0]).encode()) % 2 else r[1].replace("\n", "")
        groups[r[3]].append((r[0] is not None, r[0] or 0, leaf_of(r, r[1]), leaf_of(r, changed), r[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for i, g in enumerate(names):
        for k, (_, _, leaf, now, doc_id) in enumerate(sorted(groups[g])):
            steps = beside(trees[g], k) + beside(top, i)
            for lo, hi in steps:
                now = h(*lo, now, *hi)
            out.append((doc_id, leaf, trees[g][-1][0], top[-1][0], h(*[x for lo, hi in steps for x in lo + hi]), now, now == top[-1][0]))
    return sorted(map(repr, out))


def query(spark, monkeypatch, name, df):
    monkeypatch.setattr(queries, "table", lambda s, d, t: df)
    return queries.QUERIES[name](spark, "")


@pytest.mark.parametrize("fragment", [20_000, 7])
def test_manifest(spark, rows, monkeypatch, fragment):
    """Small fragments and ranges meet runs across several rounds of merging."""
    monkeypatch.setattr(merkle, "FRAGMENT", fragment)
    if fragment == 7:
        monkeypatch.setattr(merkle, "RANGE", 15)
        monkeypatch.setattr(merkle, "MERGED", 3)
    got = query(spark, monkeypatch, "op11_merkle_manifest", frame(spark, rows)).collect()
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got) == manifest_of(rows)


def test_manifest_of_little(spark, monkeypatch):
    assert query(spark, monkeypatch, "op11_merkle_manifest", frame(spark, [])).count() == 0
    for few in ([(1, "a\n", "en", None, 2)], [(k, None, None, "s", None) for k in range(4)], [(2, "x", None, f"s{k}", 1) for k in range(10)]):
        got = query(spark, monkeypatch, "op11_merkle_manifest", frame(spark, few)).collect()
        columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        assert sorted(repr(tuple(r[c] for c in columns)) for r in got) == manifest_of(few)


def test_forest_is_associative():
    """However nodes come together, what is resolved is the same."""
    rng = random.Random(3)
    for n in (1, 2, 3, 8, 28, 82):
        leaves = [h(str(k)) for k in range(n)]
        want = tree(leaves)[-1][0]
        for _ in range(5):
            order = list(range(n))
            rng.shuffle(order)
            cut = rng.randint(0, n)
            parts = [merkle.Forest(n), merkle.Forest(n)]
            for part, ks in zip(parts, (order[:cut], order[cut:])):
                for k in ks:
                    part.add(0, k, leaves[k])
            whole = merkle.Forest(n)
            for part in rng.sample(parts, 2):
                for (level, k), d in part.open.items():
                    whole.add(level, k, d)
            assert whole.open == {(len(whole.sizes) - 1, 0): want}


def audit_of(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for _, text, lang, source, _ in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in docs:
        kept = sorted(t for t, n in docs[lang].items() if n >= 3)
        groups = {s: c for (g, s), c in counts.items() if g == lang}
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        of, whole = {s: p(c) for s, c in groups.items()}, p(sum(groups.values(), collections.Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s, c in groups.items():
            pairs = [(-sum(f(of[s][t], of[o][t]) for t in kept), o.encode()) for o in groups if o != s]
            terms = [(-f(of[s][t], whole[t]), t.encode()) for t in kept if c[t] and of[s][t] > whole[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:200])):
                out += [(lang, s, part, x.decode(), -v, k + 1) for k, (v, x) in enumerate(found)]
    return sorted(map(repr, out))


@pytest.mark.parametrize("held", [200_000, 20])
def test_audit(spark, rows, monkeypatch, held):
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "STRETCH", 1000)
    more = rows + [(900 + k, None if k else "...", "none", f"s{k}", 1) for k in range(3)]  # a language without terms
    got = query(spark, monkeypatch, "op12_divergence_audit", frame(spark, more)).collect()
    columns = ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got) == audit_of(more)
    assert query(spark, monkeypatch, "op12_divergence_audit", frame(spark, [])).count() == 0


PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_are_the_librarys():
    """Quick and library paths, added tokens, later letters, marks, odd spaces, texts cut into stretches."""
    rng, own, library = random.Random(1), packing.Ids(PATH), Tokenizer.from_file(PATH)
    pool = ["a", "B", "é", "É", "ß", "'s", "'LL", "7", "42", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "—", "’", "東", "<|endoftext|>", "é", "İ", "Σ", "!!", "×", "µ", " ", "́", "_", "😀", "ﬁ"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 25))) for _ in range(3_000)]
    for t in texts:
        assert b"".join(own.of(t)) == packing.pack_ids(library.encode(t, add_special_tokens=False).ids)
    was, packing.STRETCH = packing.STRETCH, 50
    try:
        t = " ".join(texts)
        assert b"".join(own.of(t)) == packing.pack_ids(library.encode(t, add_special_tokens=False).ids)
    finally:
        packing.STRETCH = was


def test_packing(spark, rows, monkeypatch):
    library = Tokenizer.from_file(PATH)
    want = []
    for r in rows:
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want.append((r[0], k // 4096, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    got = query(spark, monkeypatch, "op13_best_fit_packing", frame(spark, rows)).collect()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got) == sorted(map(repr, want))
    check_places(got, 4096)
    total = sum(r["length"] for r in got)
    assert len({r["sequence_id"] for r in got}) <= -(-total // 4096) + 1
    assert query(spark, monkeypatch, "op13_best_fit_packing", frame(spark, [])).count() == 0


def check_places(got, most):
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= most


def test_packed_sequences_hold_the_ids(spark, rows):
    docs = frame(spark, rows).where("doc_id is not null and doc_id not in (5, 7)")
    packed = packing.pack(packing.pieces(docs, PATH, max_tokens=64, with_ids=True), max_tokens=64)
    made = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert made[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == bytes(r["ids"])
    assert sum(map(len, made.values())) == 4 * packed.agg(F.sum("length")).first()[0]


def test_plans():
    """Every piece is planned once, no sequence is too long, and the number of sequences is near the least possible."""
    rng = random.Random(2)
    for most, draw, times in ((4096, lambda: rng.randint(1, 4096), 3_000), (4096, lambda: int(min(4096, rng.lognormvariate(6, 1)) + 1), 3_000), (100, lambda: rng.choice([51, 60, 99]), 50), (100, lambda: 1, 999), (7, lambda: rng.randint(1, 7), 400)):
        histogram = collections.Counter(min(draw(), most) for _ in range(times))
        planned = packing.plan(dict(histogram), most)
        used = collections.Counter()
        for lengths, n in planned:
            assert 0 < sum(lengths) <= most and n > 0
            for k in lengths:
                used[k] += n
        assert used == histogram
        big = sum(n for k, n in histogram.items() if 2 * k > most)
        least = max(big, -(-sum(k * n for k, n in histogram.items()) // most))
        assert sum(n for _, n in planned) <= 1.02 * least + 1


def test_nnls():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(20):
        a, b = rng.random((12, 30)), rng.random(12)
        x = packing.nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and (slope < 1e-6).all() and np.abs(slope[x > 0]).max(initial=0) < 1e-6


def test_hot_lengths_are_ranked_across_partitions(spark):
    df = spark.range(0, 5_000, 1, 7).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 50 + 1).alias("length"))
    got = packing.pack(df, max_tokens=64).collect()
    assert len(got) == 5_000
    check_places(got, 64)
    assert len({r["sequence_id"] for r in got}) <= sum(r["length"] for r in got) / 64 * 1.01 + 1
    with pytest.raises(Exception, match="lengths must lie"):
        packing.pack(df.withColumn("length", F.lit(65)), max_tokens=64).count()
