"""Source divergence audit: how far each source's use of words lies from the other sources of its language, and from the language.

For a group g of N term occurrences over the V kept terms of its language, a term of
count c has p = 1 + floor(SCALE * (c + 1) / (N + V)), and two groups lie
f = floor((p - q)^2 / q) apart in a term. The sum of f over all V terms is found by
inclusion and exclusion over the groups' supports, without a row for a term that a
group lacks: V times the price of a term that both lack, plus, for each count in a
group's histogram of counts, the price of such a term if the other lacks it, plus a
correction for each term that both have, from a join of the terms' postings. The
postings join makes a row for each term and pair of sources that share it, summed
where it is made; its size goes with the sources of a term, never with documents.

Terms are runs of letters, A-Z (lower-cased) or any character beyond ASCII. Null
texts, languages and sources count as empty. A row is a document of its own, repeated
or not. A group without terms, and a language without kept terms, has its pairs, with
value 0 in the latter case. An empty table gives no rows. Counts are exact: whole
numbers of 38 digits where 64 bits may not do. Terms are counted batch by batch in
tasks, at most HELD different ones at a time, so a long text or a frequent word is
pre-aggregated before it is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import stored

#: About the sum of p over a group's terms. Documents of a language that keep a term; ranks of a group's terms; different terms that a task holds.
SCALE, MIN_DOCUMENTS, TOP_TERMS, HELD = 1_000_000_000, 3, 200, 200_000
#: Bytes of a text that are cut into terms together.
STRETCH = 1 << 22

#: A-Z to a-z; other ASCII than letters to a space.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> Iterator[list[bytes]]:
    """Terms of a text, stretch by stretch."""
    raw = text.encode("utf-8", "surrogatepass").translate(_TERMS)
    begin = 0
    while begin < len(raw):
        end = raw.find(b" ", begin + STRETCH) if len(raw) - begin > STRETCH else -1
        end = len(raw) if end < 0 else end
        yield (raw if end - begin == len(raw) else raw[begin:end]).split()
        begin = end


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with it), a few rows for each; a group has a row of null term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurrences: dict[tuple, Counter] = {}
        documents: dict[tuple, Counter] = {}
        held = 0

        def rows():
            for group, found in occurrences.items():
                seen, names = documents[group], list(found)
                n = len(names) + 1
                yield pa.RecordBatch.from_arrays([pa.array([group[0]] * n), pa.array([group[1]] * n), pa.array([None, *(t.decode("utf-8", "surrogatepass") for t in names)], pa.string()), pa.array([0, *found.values()], pa.int64()), pa.array([0, *(seen[t] for t in names)], pa.int64())], ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for r, group in enumerate(zip(langs, sources)):
                if group not in occurrences:
                    occurrences[group], documents[group] = Counter(), Counter()
                whole: Counter = Counter()
                for words in terms(texts[r].as_py()):
                    whole.update(words)
                before = len(occurrences[group])
                occurrences[group].update(whole)
                documents[group].update(whole.keys())
                held += len(occurrences[group]) - before
                if held >= HELD:
                    yield from rows()
                    occurrences, documents, held = {}, {}, 0
        yield from rows()

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def p_of(count: Column, total: Column, kept: Column) -> Column:
    """p of a term of a count, from the group's total and the number of kept terms; 1 + SCALE where there is neither."""
    wide = lambda c: c.cast("decimal(20,0)")
    return 1 + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(count + 1), wide(F.greatest(total + kept, F.lit(1))))


def apart(p: Column, q: Column) -> Column:
    """f of two values of p; their squares stay below 2^63, as no p is above SCALE + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def whole_sum(value: Column) -> Column:
    """The sum of 64-bit integers as 38 digits, by halves that cannot overflow."""
    half = F.lit(1 << 32)
    return F.sum(F.shiftright(value, 32)).cast("decimal(38,0)") * half.cast("decimal(10,0)") + F.sum(value.bitwiseAND(F.lit((1 << 32) - 1))).cast("decimal(38,0)")


def postings(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n, lang_n (occurrences in the language) and once (true in one row of each term of a language) of kept terms, and a row of null term for each group; stored.

    One shuffle, by language and term, serves the sums, the documents of a language and its totals.
    """
    clean = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))]
    by = counted(docs.select(*clean)).withColumn("spot", F.coalesce("term", "source")).repartition("lang", "spot")
    sums = by.groupBy("lang", "spot", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "spot", "term")
    told = sums.withColumns({"lang_n": F.sum("n").over(term), "lang_docs": F.sum("docs").over(term), "least": F.min("source").over(term)})
    kept = told.where(F.col("term").isNull() | (F.col("lang_docs") >= MIN_DOCUMENTS))
    return stored(kept.select("lang", "source", "term", "n", "lang_n", (F.col("term").isNotNull() & (F.col("source") == F.col("least"))).alias("once")), "postings")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (`pair`: to each other source; `term`: terms above the language's use), item, value and rank (from 1)."""
    kept = postings(docs, text, lang, source)
    langs = kept.groupBy("lang").agg(F.count_if("once").alias("v"), F.sum("n").alias("lang_total"))
    groups = stored(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(langs, "lang").withColumn("p0", p_of(F.lit(0), F.col("total"), F.col("v"))), "groups")
    priced = kept.where("term is not null").join(groups, ["lang", "source"]).withColumn("p", p_of(F.col("n"), F.col("total"), F.col("v")))

    of_lang = p_of(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    above = priced.withColumn("q", of_lang).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    ranked = above.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", "v", "p0", "q0")
    exact = lambda c: c.cast("decimal(19,0)")
    neither = pairs.select("lang", "source", "item", (exact(apart(F.col("p0"), F.col("q0"))) * exact(F.col("v"))).cast("decimal(38,0)").alias("part"))
    counts = priced.groupBy("lang", "source", "n", "p").agg(F.count("*").alias("m"))
    single = pairs.join(counts, ["lang", "source"]).groupBy("lang", "source", "item").agg(
        F.sum((exact(F.col("m")) * exact(apart(F.col("p"), F.col("q0")) - apart(F.col("p0"), F.col("q0")))).cast("decimal(38,0)")).alias("there"),
        F.sum((exact(F.col("m")) * exact(apart(F.col("q0"), F.col("p")) - apart(F.col("q0"), F.col("p0")))).cast("decimal(38,0)")).alias("back"),
    )
    one = priced.select("lang", "term", "source", "p", "p0")
    two = priced.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    mend = lambda p, p0, q, q0: apart(F.col(p), F.col(q)) - apart(F.col(p), F.col(q0)) - apart(F.col(p0), F.col(q)) + apart(F.col(p0), F.col(q0))
    both = one.join(two, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(whole_sum(mend("p", "p0", "q", "q0")).alias("there"), whole_sum(mend("q", "q0", "p", "p0")).alias("back"))
    ways = lambda df: df.select("lang", "source", "item", F.col("there").alias("part")).unionAll(df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("part")))
    sums = neither.unionAll(ways(stored(single, "single"))).unionAll(ways(stored(both, "both"))).groupBy("lang", "source", "item").agg(F.sum("part").cast("long").alias("value"))
    far = sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(best))
    return far.unionByName(ranked)
