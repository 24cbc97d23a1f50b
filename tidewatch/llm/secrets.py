"""Secret scans through a trigram inverted index, with DataFrame functions alone.

Each rule's regular expression is turned into a Boolean query over trigrams: an
OR of ANDs of three-letter strings that any match must contain, in lower case.
The index holds a posting (trigram, document) for each queried trigram of each
document; a rule's postings are intersected by key, and only the resulting
candidates are verified with the expression itself. A rule without mandatory
trigrams (a long run of hexadecimal digits) scans every text.

Per kind, matches are leftmost and do not overlap; a match whose measured group
is too short is dropped and what it consumed stays consumed. Positions count
code points, the end is exclusive. Null and empty texts have no spans. Repeated
rows are reported each; rows that share an id share candidates, and verification
keeps them exact. Null ids are joined null-safely. Very long texts are
scanned as a whole, positions summed by blocks; without rows there is no result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:
    from re import _constants as rc
    from re import _parser as rp
except ImportError:  # Python before 3.11
    import sre_constants as rc
    import sre_parse as rp

#: At most so many literal strings are followed side by side while a query is derived.
MAX_STRINGS = 32
#: Elements whose running totals are summed one by one; longer lists are summed by blocks of this size.
BLOCK = 128


@dataclass(frozen=True)
class Rule:
    """kind, expression (of both Java's and Python's syntax), group whose length is measured, and its least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules. A run's least length is written into the expression where that yields the same matches.
BASE = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
]
#: Further rules, public formats of keys; they add spans.
MORE = [
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
]


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """OR of ANDs of trigrams that lower-cased text with a match must contain; empty: no trigram is mandatory."""
    clauses: list[frozenset[str]] = [frozenset()]
    exact = {""}

    def close() -> None:
        nonlocal clauses, exact
        options = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in exact}
        if frozenset() not in options:
            clauses = [a | b for a in clauses for b in options]
        exact = {""}

    def strings(seq) -> set[str] | None:
        """All texts that a sequence matches, if they are few."""
        out = {""}
        for op, arg in seq:
            if (part := one(op, arg)) is None or len(out) * len(part) > MAX_STRINGS:
                return None
            out = {a + b for a in out for b in part}
        return out

    def one(op, arg) -> set[str] | None:
        if op is rc.LITERAL:
            return {chr(arg).lower()}
        if op is rc.IN:
            chars: set[str] = set()
            for kind, x in arg:
                if kind is rc.LITERAL:
                    chars.add(chr(x).lower())
                elif kind is rc.RANGE and x[1] - x[0] < MAX_STRINGS:
                    chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    return None
            return chars if len(chars) <= 8 else None
        if op is rc.SUBPATTERN:
            return strings(arg[-1])
        if op is rc.BRANCH:
            parts = [strings(x) for x in arg[1]]
            return None if None in parts else set().union(*parts)
        if op is rc.MAX_REPEAT and arg[1] <= 1:
            part = strings(arg[2])
            return None if part is None else part | ({""} if arg[0] == 0 else set())
        if op is rc.AT:
            return {""}
        return None

    def walk(seq) -> None:
        nonlocal exact
        for op, arg in seq:
            part = one(op, arg)
            if part is not None and len(exact) * len(part) <= MAX_STRINGS:
                exact = {a + b for a in exact for b in part}
            elif op is rc.SUBPATTERN:
                walk(arg[-1])
            else:
                close()
                if part is not None and len(part) <= MAX_STRINGS:
                    exact = set(part)

    walk(rp.parse(pattern))
    close()
    if frozenset() in clauses:
        return []
    return [c for c in sorted(set(clauses), key=sorted) if not any(d < c for d in clauses)]


def let(x: Column, body) -> Column:
    """body(x), with x evaluated once."""
    return F.element_at(F.transform(F.array(x), body), 1)


def running_totals(steps: Column) -> Column:
    """Sums of the first 1, 2, ... elements, by blocks, so that long lists take no quadratic time."""

    def upto(t):
        blocks = F.sequence(F.lit(0), (F.size(t) - 1).cast("int").bitwiseAND(F.lit(-BLOCK)), F.lit(BLOCK))
        total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)
        sums = F.transform(blocks, lambda b: total(F.slice(t, b + 1, F.lit(BLOCK))))
        bases = let(sums, lambda s: F.transform(s, lambda _, i: total(F.slice(s, F.lit(1), i))))
        return let(bases, lambda base: F.transform(t, lambda _, i: F.element_at(base, (F.floor(i / BLOCK) + 1).cast("int")) + total(F.slice(t, (F.floor(i / BLOCK) * BLOCK + 1).cast("int"), i % BLOCK + 1))))

    return let(steps, lambda t: F.when(F.size(t) == 0, F.array().cast("array<long>")).otherwise(upto(t)))


def running_greatest(steps: Column) -> Column:
    """The greatest of the first 1, 2, ... elements (0 at least), by blocks as well."""
    most = lambda x: F.coalesce(F.array_max(x), F.lit(0).cast("long"))
    first = lambda i: F.floor(i / BLOCK) * BLOCK

    def upto(t):
        tops = F.transform(F.sequence(F.lit(0), F.greatest(F.size(t) - 1, F.lit(0)), F.lit(BLOCK)), lambda b: most(F.slice(t, b + 1, F.lit(BLOCK))))
        return let(tops, lambda s: F.transform(t, lambda _, i: F.greatest(most(F.slice(s, F.lit(1), F.floor(i / BLOCK).cast("int"))), most(F.slice(t, (first(i) + 1).cast("int"), i % BLOCK + 1)))))

    return let(steps, upto)


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order of kind, end, kind): texts between matches and matches, laid end to end."""
    p = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, p, F.lit(0))
    measured = F.regexp_extract_all(text, p, F.lit(rule.group)) if rule.group else matches
    gaps = F.split(text, rule.pattern, -1)
    kind = "array<struct<start:bigint,ord:int,end:bigint,kind:string>>"

    def positions(ms):
        steps = F.transform(ms, lambda _, i: (F.length(F.get(gaps_once, i)) + F.when(i > 0, F.length(F.get(ms, i - 1))).otherwise(0)).cast("long"))
        return let(running_totals(steps), lambda starts: F.transform(ms, lambda m, i: F.struct(F.get(starts, i).alias("start"), F.lit(order).alias("ord"), (F.get(starts, i) + F.length(m)).alias("end"), F.lit(rule.kind).alias("kind"))))

    def with_gaps(g):
        nonlocal gaps_once
        gaps_once = g
        found = let(matches, positions)
        if not rule.least:
            return found
        return let(measured, lambda m: F.filter(found, lambda _, i: F.length(F.get(m, i)) >= rule.least))

    gaps_once = gaps
    return F.coalesce(F.when(text.rlike(rule.pattern), let(gaps, with_gaps)), F.array()).cast(kind)


def candidates(docs: DataFrame, rules: list[Rule], key: str, text: str) -> DataFrame:
    """key and kinds (those whose trigram query the document's postings meet), for documents that have any."""
    queries = [(r.kind, k, clause) for r in rules for k, clause in enumerate(trigram_query(r.pattern))]
    grams = sorted({g for _, _, clause in queries for g in clause})
    has = let(F.lower(F.col(text)), lambda low: F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(g)) for g in grams]))
    postings = docs.select(F.col(key).alias("__key"), F.explode(F.array_compact(has)).alias("gram"))
    # the clauses, a table bounded by the rules: which bit each trigram sets
    clauses = docs.sparkSession.createDataFrame([(g, kind, k, 1 << bit, (1 << len(clause)) - 1) for kind, k, clause in queries for bit, g in enumerate(sorted(clause))], "gram string, kind string, clause int, bit long, all_bits long")
    met = postings.join(F.broadcast(clauses), "gram").groupBy("__key", "kind", "clause", "all_bits").agg(F.bit_or("bit").alias("bits"))
    return met.where("bits = all_bits").groupBy("__key").agg(F.collect_set("kind").alias("__kinds"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", base: list[Rule] = BASE, more: list[Rule] = MORE, keep: list[str] | None = None) -> DataFrame:
    """Columns keep (key alone, if not given) and, for each rule, its kind's spans in a column `found_<kind>`."""
    rules = [*base, *more]
    indexed = [r for r in rules if trigram_query(r.pattern)]
    keep = [key] if keep is None else keep
    rows = docs.select(F.col(key).alias("__key"), F.struct(*keep).alias("__row"), F.col(text).cast("string").alias("__text"))
    found = candidates(docs.select(F.col(key), F.col(text).cast("string").alias(text)), indexed, key, text)
    found = found.withColumnRenamed("__key", "__key2")
    rows = rows.join(found, F.col("__key").eqNullSafe(F.col("__key2")), "left")
    text_of = lambda r: F.when(F.array_contains("__kinds", r.kind), F.col("__text")) if r in indexed else F.col("__text")
    return rows.select("__row.*", *[spans_of(text_of(r), r, k).alias(f"found_{r.kind}") for k, r in enumerate(rules)])


def joined(*columns: str) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.array_sort(F.concat(*columns)), lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", base: list[Rule] = BASE, more: list[Rule] = MORE) -> DataFrame:
    """Per document: n_<kind> of each base rule, base_sha256 and spans."""
    names = [f"found_{r.kind}" for r in base]
    return scan(docs, key, text, base, more).select(
        key,
        *[F.size(n).cast("long").alias(f"n_{r.kind}") for n, r in zip(names, base)],
        F.sha2(joined(*names), 256).alias("base_sha256"),
        joined(*names, *[f"found_{r.kind}" for r in more]).alias("spans"),
    )


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", base: list[Rule] = BASE, more: list[Rule] = MORE, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by mark; overlapping spans are replaced as one.

    Texts are cut at four bytes a character, so a piece costs its own length wherever it is, and a
    text with thousands of spans no more than their sum. Columns may have any names.
    """
    cols, rules = docs.columns, [*base, *more]
    others = [c for c in cols if c != text]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0))
    packed = docs.select(row.alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    found = scan(packed, "key", "text", base, more, keep=["row", "text"])
    spans = found.select("row", "text", F.array_sort(F.concat(*[f"found_{r.kind}" for r in rules])).alias("spans"))
    chars = lambda raw, a, b: F.decode(F.substring(raw, (4 * a + 1).cast("int"), (4 * (b - a)).cast("int")), "UTF-32")

    def pieces(raw):
        def between(highs):
            before = F.transform(F.col("spans"), lambda s, i: F.struct(F.when(i > 0, F.get(highs, i - 1)).otherwise(0).alias("a"), s.start.alias("b")))
            kept = F.transform(F.filter(before, lambda p: p.b >= p.a), lambda p: chars(raw, p.a, p.b))
            return F.concat(kept, F.array(chars(raw, F.element_at(highs, -1), F.length("text"))))

        return let(running_greatest(F.transform("spans", lambda s: s.end)), between)

    cut = F.when(F.size("spans") > 0, F.array_join(let(F.encode("text", "UTF-32"), pieces), mark)).otherwise(F.col("text"))
    return spans.select(*[cut.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in cols])


def plain_matches(text: str, rule: Rule) -> list[tuple[int, int]]:
    """Brute force, for tests."""
    return [m.span() for m in re.finditer(rule.pattern, text) if len(m.group(rule.group)) >= rule.least]
