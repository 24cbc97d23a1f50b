"""URL filters: host and path rules, and a path-template tree for the rest.

A url's host is what follows the first `://` up to `/`, `?`, `#` or the end, with
A-Z lower-cased; its path goes on up to `?`, `#` or the end. A rule fits its host
and all its subdomains if the path starts with the rule's; the longest fitting
rule gives the verdict.

Other urls are judged by the tree. Per host, paths are cut into segments; a
segment of digits, of hexadecimal digits or with digits inside becomes a typed
wildcard. Sibling branches are merged into one wildcard if they are statistically
similar: by a two-proportion test of their share of blocked labels against that of
their siblings together, where both have labels, and by a chi-squared test of what
comes next in the path (number, hexadecimal, word or end). Branches that differ
stay apart. So a branch without labels takes part in what its like siblings' labels say. A template is
rejected if its smoothed share of blocked labels reaches PURITY; the prior weighs
WEIGHT labels and a share UNLABELLED of the template's pages without one, so few labels
do not decide for many pages. Labels are the urls that a rule judges (or a column of the caller's).

Everything is aggregated by (host, path of typed segments) before it is shuffled,
so a host with a third of all pages costs no task more than its distinct paths.
Null urls and urls without `://` have an empty host and path; no rule fits them
and the tree allows them. Repeated rows get equal verdicts. Extra columns are
ignored; a url of any length is handled, and segments from the depth-th on are one
segment of the tree (a parameter, DEPTH unless given). Without rows there is no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import forget, stored

#: verdict, host and path of each rule.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
DEPTH = 6
#: Prior of a blocked label and its weight, and the smoothed share from which a template is rejected.
PRIOR, WEIGHT, UNLABELLED, PURITY = 0.2, 4.0, 0.1, 0.8
#: Two-proportion z, and chi-squared of the next segments' shapes, beyond which a branch is kept apart (99 % and 99.9 %).
Z_APART, CHI_APART = 2.58, 16.27
SHAPES = ["number", "hexadecimal", "word", "end"]


def host_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.when(url.contains("://"), F.expr("1")).isNotNull()
    host = F.regexp_extract(F.substring(url, F.length(rest) + 4, F.length(url)), r"\A[^/?#]*", 0)
    return F.when(after, F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    return F.when(url.contains("://"), F.regexp_extract(F.substring(url, F.length(rest) + 4, F.length(url)), r"\A[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null if none fits."""
    rule = verdict = None
    for what, text in sorted(rules, key=lambda r: -len(r[1])):
        rule_host, slash, rest = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"),) * 2


def typed(segment: Column) -> Column:
    return (
        F.when(segment.rlike(r"\A[0-9]+\z"), "{n}")
        .when(segment.rlike(r"\A[0-9a-fA-F-]{8,}\z"), "{h}")
        .when(segment.rlike("[0-9]"), F.regexp_replace(segment, "[0-9]+", "{n}"))
        .otherwise(segment)
    )


def segments_of(path: Column, depth: int) -> Column:
    """Typed segments, depth at most; a slash at the end is a segment of its own."""
    parts = F.transform(F.slice(F.split(F.substring(path, 2, 1 << 30), "/", depth), 1, depth), typed)
    return F.when(path == "", F.array().cast("array<string>")).otherwise(parts)


def shape(segment: Column) -> Column:
    return F.when(segment.isNull(), "end").when(segment == "{n}", "number").when(segment == "{h}", "hexadecimal").otherwise("word")


def templates(paths: DataFrame) -> DataFrame:
    """(host, segs, n, bad, good) to (..., template): from the root down, branches are kept or merged.

    A node's statistics are aggregates of partial aggregates; the kept branches of a
    level are joined back by (host, template so far, segment).
    """
    now = stored(paths.withColumn("template", F.lit("")), "paths")
    counts = ["bad", "good", *SHAPES]
    for level in range(now.agg(F.max(F.size("segs"))).first()[0] or 0):
        seg, then = F.get("segs", F.lit(level)), shape(F.get("segs", F.lit(level + 1)))
        here = now.where(seg.isNotNull()).groupBy("host", "template", seg.alias("seg")).agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), *[F.sum(F.when(then == x, F.col("n")).otherwise(0)).alias(x) for x in SHAPES])
        nodes = here.groupBy("host", "template").agg(F.count("*").alias("branches"), *[F.sum(c).alias(f"all_{c}") for c in counts])
        total = lambda names, prefix="": sum((F.col(f"{prefix}{x}") for x in names[1:]), F.col(f"{prefix}{names[0]}"))
        labelled, pages = total(["bad", "good"]), total(SHAPES)
        others, other_pages = total(["bad", "good"], "all_") - labelled, total(SHAPES, "all_") - pages
        pooled = F.try_divide(F.col("all_bad"), F.col("all_bad") + F.col("all_good"))
        apart_by = F.abs(F.try_divide(F.col("bad"), labelled) - F.try_divide(F.col("all_bad") - F.col("bad"), others))
        spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), labelled) + F.try_divide(F.lit(1), others)))
        unlike_labels = F.coalesce(F.try_divide(apart_by, spread) > Z_APART, F.lit(False))
        cells = [F.coalesce(F.try_divide(F.pow(F.col(x) * other_pages - (F.col(f"all_{x}") - F.col(x)) * pages, F.lit(2)), pages * other_pages * F.col(f"all_{x}")), F.lit(0.0)) for x in SHAPES]
        unlike_shape = sum(cells[1:], cells[0]) > CHI_APART
        kept = here.join(nodes, ["host", "template"]).where(unlike_labels | unlike_shape | (F.col("branches") == 1)).select(F.col("host").alias("at_host"), F.col("template").alias("at"), F.col("seg").alias("kept"))
        step = now.join(kept, (F.col("host") == F.col("at_host")) & (F.col("template") == F.col("at")) & (seg == F.col("kept")), "left")
        name = F.when(seg.isNull(), F.col("template")).otherwise(F.concat(F.col("template"), F.lit("/"), F.coalesce("kept", F.when(seg.startswith("{"), seg).otherwise("*"))))
        had, now = now, stored(step.withColumn("template", name).select("host", "segs", "n", "bad", "good", "template"), "paths")
        forget(had)
    return now


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, key: str = "page_id", url: str = "url", label: str | None = None, depth: int = DEPTH) -> DataFrame:
    """key, host, path, rule, verdict, template and purity of every row. label: a column with `block` or `allow`, else the rules' verdicts."""
    rows = pages.select(F.col(key).alias("__key"), F.col(url).cast("string").alias("__url"), (F.col(label) if label else F.lit(None)).cast("string").alias("__label"))
    rows = rows.select("__key", "__label", host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path")).na.fill("", ["host", "path"])
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict, "segs": segments_of(F.col("path"), depth)})
    said = F.coalesce("__label", "ruled")
    paths = rows.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count_if(said == "block").alias("bad"), F.count_if(said == "allow").alias("good"))
    tree = templates(paths)
    labelled = F.sum("bad") + F.sum("good")
    weight = WEIGHT + UNLABELLED * (F.sum("n") - labelled)
    pure = tree.groupBy("host", "template").agg(((F.sum("bad") + PRIOR * weight) / (labelled + weight)).alias("purity"))
    known = tree.select("host", "segs", "template").join(pure, ["host", "template"]).select(F.col("host").alias("h"), F.col("segs").alias("s"), "template", "purity")
    out = rows.join(known, (F.col("host") == F.col("h")) & (F.col("segs") == F.col("s")), "left")
    by_tree = F.when((F.col("host") != "") & (F.col("purity") >= PURITY), "block").otherwise("allow")
    return out.select(F.col("__key").alias(key), "host", "path", "rule", F.coalesce("ruled", by_tree).alias("verdict"), "template", F.round("purity", 6).alias("purity"))
