"""Read-side analytics over decisions: aggregations that shuffle partial results only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.kernel import kernel_action, tuner_bucket
from tidewatch.functions.stats import Z1, erfc, mcnemar_chi2, wilson

is_action = lambda a: F.count_if(F.col("action") == a)


def noise_top_checks(d: DataFrame, top: int = 50) -> DataFrame:
    by = d.groupBy("fingerprint").agg(F.count("*").alias("volume"), is_action("suppress").alias("suppressed"), F.min_by("service", "alert_id").alias("service"), F.min_by("check_name", "alert_id").alias("check_name"))
    return by.withColumn("suppress_rate", F.round(F.col("suppressed") / F.col("volume"), 4)).orderBy(F.col("volume").desc(), "fingerprint").limit(top)


def team_load(d: DataFrame, nights: float = 30.0) -> DataFrame:
    nights = max(nights, 1 / 1440)
    by = d.groupBy("team").agg(F.count_if(F.col("action").isin("page_now", "page_business_hours", "suppress")).alias("before"), is_action("page_now").alias("after"))
    return by.select("team", "before", "after", F.round(F.col("before") / nights, 4).alias("before_per_night"), F.round(F.col("after") / nights, 4).alias("after_per_night"))


def reason_breakdown(d: DataFrame) -> DataFrame:
    by = d.groupBy("reason").agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("total"))  # one row
    return by.crossJoin(F.broadcast(total)).select("reason", "n", F.round(F.col("n") * 100 / F.col("total"), 4).alias("pct"))


def coverage(d: DataFrame, taus=(70, 80, 90)) -> DataFrame:
    """One pass for all thresholds, then one row each."""
    labelled = d.where("became_sev12 is not null").agg(F.count("*").alias("n"), *[F.count_if(F.col("conf_h") >= t).alias(f"t{t}") for t in taus])
    return labelled.select("n", F.expr(f"stack({len(taus)}, {', '.join(f'{t}, t{t}' for t in taus)}) as (tau_h, covered)")).withColumn("coverage", F.round(F.col("covered") / F.col("n"), 6))


def rank_auc(d: DataFrame, score: str = "p1_h", label: str = "became_sev12") -> DataFrame:
    """Mann-Whitney over a histogram of scores, so that only distinct scores are ordered; ties count half."""
    h = d.where(F.col(label).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label)).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    below = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)  # one row a distinct score, 101 at most
    won = h.withColumn("below", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    out = won.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.sum(F.col("pos") * (2 * F.col("below") + F.col("neg"))).alias("twice"))
    return out.select("positives", "negatives", F.round(F.col("twice") / F.try_divide(F.lit(1.0), F.lit(0.5)) / F.when(F.col("positives") * F.col("negatives") > 0, F.col("positives") * F.col("negatives")), 6).alias("auc"))


def global_rank(d: DataFrame, score: str, key: str, keep: list[str], buckets: int = 1024) -> DataFrame:
    """r: 0-based rank by score, ties by key (an integer), without a sort of all rows in one task.

    Keys are cut into equal ranges. A histogram of (score, range) gives where each cell
    begins; rows are only ranked within their cell. score has few distinct values, so
    the histogram is small. Nothing depends on how rows are dealt out.
    """
    ends = d.agg(F.min(key).alias("lo"), (F.max(key) + 1).alias("hi"))
    rows = d.select(*keep, F.col(score).alias("o"), F.col(key).alias("i")).crossJoin(F.broadcast(ends))
    rows = rows.withColumn("cell", F.floor((F.col("i") - F.col("lo")) * buckets / (F.col("hi") - F.col("lo"))))
    edges = rows.groupBy("o", "cell").agg(F.count("*").alias("c"))
    before = edges.select(F.col("o").alias("o_"), F.col("cell").alias("cell_"), (F.sum("c").over(Window.orderBy("o", "cell")) - F.col("c")).alias("offset"))
    inside = rows.withColumn("at", F.row_number().over(Window.partitionBy("o", "cell").orderBy("i")) - 1)
    return inside.join(before, (F.col("o") == F.col("o_")) & (F.col("cell") == F.col("cell_"))).select(*keep, (F.col("offset") + F.col("at")).alias("r"))


def deciles(d: DataFrame) -> DataFrame:
    """Equal-count deciles by p1, ties by id, observed rate and Wilson interval."""
    rows = d.where("became_sev12 is not null")
    n = rows.agg(F.count("*").alias("total"))
    ranked = global_rank(rows, "p1_h", "alert_id", ["became_sev12"]).crossJoin(F.broadcast(n))
    by = ranked.withColumn("decile", F.floor((10 * (F.col("r") + 1) - 1) / F.col("total"))).groupBy("decile").agg(F.count("*").alias("n"), F.sum("became_sev12").alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return by.select("decile", "n", "k", F.round(F.col("k") / F.col("n"), 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


#: Closed bands with gaps between them; rows in a gap are in no band.
BANDS = [(50, 59), (60, 69), (70, 79), (80, 94), (95, 100)]


def confidence_bands(d: DataFrame, bands=BANDS) -> DataFrame:
    band = F.coalesce(*[F.when(F.col("conf_h").between(a, b), F.lit(f"{a}-{b}")) for a, b in bands])
    by = d.where("became_sev12 is not null").withColumn("band", band).where("band is not null").groupBy("band").agg(F.count("*").alias("n"), F.sum("became_sev12").alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return by.select("band", "n", "k", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), (F.col("n") < 30).alias("thin"))


def tuner_grid(d: DataFrame, grid=(80, 85, 90, 95), c_fp: int = 100, c_fn: int = 50_000) -> DataFrame:
    """All grid points in one pass: a struct of conditional sums each, no cross join of rows."""
    aggs = []
    for g in grid:
        b = tuner_bucket(c_fp, c_fn, g)
        aggs += [F.count_if(b == "suppress").alias(f"s{g}"), F.count_if(b == "page_now").alias(f"p{g}"), F.count_if(b == "queue").alias(f"q{g}"), F.coalesce(F.sum(F.when(b == "suppress", F.col("p1_h"))), F.lit(0)).alias(f"e{g}")]
    wide = d.agg(F.count("*").alias("n"), *aggs)
    return wide.select("n", F.expr(f"stack({len(grid)}, {', '.join(f'{g}, s{g}, p{g}, q{g}, e{g}' for g in grid)}) as (conf_min, suppressed, paged, queued, expected_h)")).withColumn("cost", (F.col("n") - F.col("suppressed")) * c_fp * 100 + F.col("expected_h") * c_fn)


def certificate(d: DataFrame, pass_u: float = 0.005, fail_u: float = 0.01, min_n: int = 300, min_confirmed: int = 25, rot: float = 0.2) -> DataFrame:
    """Suppressed rows: labelled n, SEVs k, unlabelled m, one-sided bound, label rot and verdict. Below either floor there is no bound."""
    quiet = F.col("action") == "suppress"
    by = d.agg(F.count_if(quiet & F.col("became_sev12").isNotNull()).alias("n"), F.count_if(quiet & (F.col("became_sev12") == 1)).alias("k"), F.count_if(quiet & F.col("became_sev12").isNull()).alias("m"), F.count_if(F.col("became_sev12") == 1).alias("confirmed"))
    enough = (F.col("n") >= min_n) & (F.col("confirmed") >= min_confirmed)
    u = wilson(F.col("k"), F.col("n"), Z1)[1]
    verdict = F.when(~enough, "INSUFFICIENT-N").when((u <= pass_u) & (F.col("k") == 0), "PASS").when((u > fail_u) | (F.col("k") >= 1), "FAIL").otherwise("FLAG")
    return by.select("n", "k", "m", "confirmed", F.when(enough, F.round(u, 6)).alias("upper"), F.coalesce(F.try_divide("m", F.col("n") + F.col("m")) > rot, F.lit(False)).alias("label_rot"), verdict.alias("verdict"))


def accuracy(d: DataFrame) -> DataFrame:
    lab = d.where("became_sev12 is not null").groupBy("severity_in").agg(F.count("*").alias("n"), F.sum("became_sev12").alias("sev12"), F.count_if((F.col("became_sev12") == 1) & (F.col("action") == "suppress")).alias("false_suppressed"), F.count_if((F.col("action") == "page_now") & (F.col("became_sev12") == 1)).alias("right_pages"), is_action("page_now").alias("pages"))
    return lab.select("*", F.round(F.coalesce(F.try_divide("false_suppressed", "sev12"), F.lit(0.0)), 6).alias("false_suppress_rate"), F.round(F.try_divide("right_pages", "pages"), 6).alias("page_precision"))


def psi(d: DataFrame, feature: Column, reference: Column, eps: float = 1e-9) -> DataFrame:
    """Population stability index of feature between reference rows and the others."""
    by = d.groupBy(feature.alias("bucket")).agg(F.count_if(reference).alias("e"), F.count_if(~reference).alias("a"))
    total = by.agg(F.sum("e").alias("te"), F.sum("a").alias("ta"))
    share = by.crossJoin(F.broadcast(total)).select("bucket", "e", "a", F.greatest(F.col("e") / F.col("te"), F.lit(eps)).alias("pe"), F.greatest(F.col("a") / F.col("ta"), F.lit(eps)).alias("pa"))
    return share.select("bucket", "e", "a", F.round((F.col("pa") - F.col("pe")) * F.log(F.col("pa") / F.col("pe")), 6).alias("psi"))


def flip_records(d: DataFrame) -> DataFrame:
    """Equal inputs with unlike actions. Distinct values are partial aggregates; no self-join."""
    key = F.sha2(F.concat_ws("|", "service", "check_name", (F.floor(F.col("k") / 10)).cast("string")), 256)
    by = d.groupBy(key.alias("input_sha256")).agg(F.count("*").alias("n"), F.min("alert_id").alias("first_id"), F.max("alert_id").alias("last_id"), F.size(F.collect_set("action")).cast("long").alias("actions"))
    return by.where("n > 1").withColumn("flipped", F.col("actions") > 1)


def impact(d: DataFrame, conf_min: int = 80) -> DataFrame:
    return d.withColumn("replayed", kernel_action(conf_min=conf_min)).groupBy(F.concat_ws("->", "action", "replayed").alias("transition")).agg(F.count("*").alias("n"))


def paired_mcnemar(d: DataFrame) -> DataFrame:
    """Three arms of each alert: b agrees in the control pair only, c in the variant only."""
    a1, a2, b = kernel_action(90), kernel_action(90, page_h=32), kernel_action(80, uncertain_h=45)
    by = d.select(a1.alias("x"), a2.alias("y"), b.alias("z")).agg(F.count("*").alias("n"), F.count_if((F.col("x") == F.col("y")) & (F.col("x") != F.col("z"))).alias("b"), F.count_if((F.col("x") != F.col("y")) & (F.col("x") == F.col("z"))).alias("c"))
    chi2 = mcnemar_chi2(F.col("b"), F.col("c"))
    return by.withColumns({"chi2": F.round(chi2, 6), "p": F.round(erfc(F.sqrt(chi2 / 2)), 5)})


def backtest(d: DataFrame) -> DataFrame:
    """Per incident (service and day) the opening alert's action; an incident with a SEV that opens suppressed is a miss."""
    day = F.floor(F.col("at_us") / 86_400_000_000)
    by = d.groupBy("service", day.alias("day")).agg(F.min_by("action", F.struct("at_us", "alert_id")).alias("opening"), F.max("became_sev12").alias("sev"), F.count("*").alias("n"))
    return by.withColumn("miss", (F.coalesce("sev", F.lit(0)) == 1) & (F.col("opening") == "suppress"))


def latency_quantiles(d: DataFrame, by: str = "check_name", x: str = "metric_value") -> DataFrame:
    """Interpolated and discrete quantiles. percentile merges value counts, so no group is sorted as rows."""
    return d.groupBy(by).agg(F.count("*").alias("n"), F.round(F.percentile(x, 0.5), 6).alias("p50"), F.round(F.percentile(x, 0.95), 6).alias("p95"), F.round(F.expr(f"percentile_disc(0.99) within group (order by {x})"), 6).alias("p99_disc"), F.max(x).alias("worst"))


def cold_summary(d: DataFrame) -> DataFrame:
    return d.select("action", "check_name", F.floor(F.col("at_us") / 86_400_000_000).alias("day")).groupingSets([["action"], ["check_name"], ["day"]], "action", "check_name", "day").agg(F.count("*").alias("n")).select("action", "check_name", "day", "n")


#: Resamples of an interval, its seed, and the ranks of its ends.
RESAMPLES, SEED, LOW, HIGH = 200, 20261004, 0.025, 0.975


def auc_interval(d: DataFrame, score: str = "p1_h", label: str = "became_sev12", resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """positives, negatives and the ends of a bootstrap interval of the rank AUC; ends are null where there are no positives or no negatives.

    Each row would be drawn as often as a Poisson variable of mean 1 says, so the c rows of a score
    and label are drawn as often as one of mean c says: a draw for each cell of the histogram and
    resample, by a generator keyed by both. Rows are aggregated once, and neither their order nor
    their partitions matter. A resample without positives or negatives counts as 0.5. Rows without
    label take no part; a null score is the lowest.
    """
    import numpy as np
    import pyarrow as pa

    cells = d.where(F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.col(label)).cast("long").alias("pos"), F.sum(1 - F.col(label)).cast("long").alias("neg"))

    def draw(batches):
        for batch in batches:
            pos, neg = [], []
            for s, p, n in zip(*(c.to_pylist() for c in batch.columns)):
                bits = 0 if s is None else int(np.float64(s).view(np.uint64)) ^ (1 << 63)
                pos.append(np.random.Generator(np.random.Philox(key=[seed, bits], counter=1)).poisson(p, resamples))
                neg.append(np.random.Generator(np.random.Philox(key=[seed, bits], counter=1 << 64)).poisson(n, resamples))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pos, pa.list_(pa.int64())), pa.array(neg, pa.list_(pa.int64()))], ["s", "pos", "neg"])

    drawn = cells.select("s", "pos", "neg").mapInArrow(draw, "s double, pos array<long>, neg array<long>")
    each = drawn.select("s", F.posexplode(F.arrays_zip("pos", "neg")).alias("b", "w")).select("s", "b", F.col("w.pos").alias("pos"), F.col("w.neg").alias("neg"))
    below = Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    won = each.withColumn("below", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    aucs = won.groupBy("b").agg(F.when(pairs > 0, F.sum(F.col("pos").cast("double") * (2 * F.col("below") + F.col("neg"))) / 2 / pairs).otherwise(0.5).alias("auc"))
    ends = aucs.agg(F.sort_array(F.collect_list("auc")).alias("a"))  # as many as there are resamples
    totals = cells.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    both = F.coalesce((F.col("positives") > 0) & (F.col("negatives") > 0), F.lit(False))
    at = lambda k: F.when(both, F.round(F.get("a", F.lit(min(int(k * resamples), resamples - 1))), 4))
    return totals.crossJoin(ends).select("positives", "negatives", at(LOW).alias("low"), at(HIGH).alias("high"))
