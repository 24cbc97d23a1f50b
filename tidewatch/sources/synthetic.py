"""Made-up alerts, answers and arrivals. Every random number is a function of the seed, its purpose and a row's own counter, so rows do not depend on partitions, order or retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of alerts and their shares; fixed values.
KINDS = {"known_noise": 0.55, "deploy_adjacent": 0.20, "p3p4_warning": 0.20, "real_sev": 0.05}
#: Probabilities of the answers by what is true, in ten-thousandths; fixed values.
OPTIONS = ["p1_critical", "p2_high", "p3_medium", "p4_low", "known_noise", "cannot_determine"]
TEMPLATES = {
    "p1_critical": [8600, 900, 300, 100, 50, 50],
    "p2_high": [1000, 8200, 500, 150, 100, 50],
    "p3_medium": [40, 800, 8000, 700, 400, 60],
    "p4_low": [40, 100, 800, 8400, 500, 60],
    "known_noise": [9, 40, 200, 400, 9300, 51],
}
SERVICES, CHECKS, REGIONS = [f"svc-{i}" for i in range(10)], ["error_rate", "latency", "cpu", "queue", "disk"], ["r0", "r1", "r2"]
#: Each so many-th triple of service, check and region is noise's own.
NOISE_EACH = 8
#: A cell of arrivals has at most this mean, and from WIDE_MEAN on its Poisson terms are taken from 12 deviations below the mean on: e to the minus 700 and less has no double precision.
MAX_MEAN, WIDE_MEAN = 100_000.0, 500.0


def uniform(seed: int, purpose: str, *counter: Column | str) -> Column:
    """A number of [0, 1) with 52 random bits."""
    bits = F.substring(F.sha2(F.concat_ws(":", F.lit(f"{seed}:{purpose}"), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in counter]), 256), 1, 13)
    return F.conv(bits, 16, 10).cast("long") / float(1 << 52)


def among(options: list[str], u: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in options]), (F.floor(u * len(options)) + 1).cast("int"))


def between(low: int, high: int, u: Column) -> Column:
    """A whole number from low to high, both included."""
    return (low + F.floor(u * (high - low + 1))).cast("int")


def kind_of(u: Column) -> Column:
    out, upto = None, 0.0
    for kind, share in list(KINDS.items())[:-1]:
        upto = round(upto + share, 4)
        out = F.when(u < upto, kind) if out is None else out.when(u < upto, kind)
    return out.otherwise(list(KINDS)[-1])


def alerts(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """n labelled alerts i = 0 to n - 1, 53 seconds apart. Noise has triples of its own, so no other alert has a fingerprint of noise."""
    u = lambda purpose: uniform(seed, purpose, "i")
    triples = len(SERVICES) * len(CHECKS) * len(REGIONS)
    quiet = -(-triples // NOISE_EACH)
    j = F.floor(u("triple") * (triples - quiet))
    at = F.when(F.col("kind") == "known_noise", F.floor(u("triple") * quiet) * NOISE_EACH).otherwise(j + F.floor(j / (NOISE_EACH - 1)) + 1)
    rows = spark.range(n).select(F.col("id").alias("i")).withColumn("kind", kind_of(u("kind"))).withColumn("at", at)
    pick = lambda options, c: F.element_at(F.array(*[F.lit(x) for x in options]), (c + 1).cast("int"))
    noise, sev, deploy = F.col("kind") == "known_noise", F.col("kind") == "real_sev", F.col("kind") == "deploy_adjacent"
    rows = rows.withColumns({
        "service": pick(SERVICES, F.col("at") % len(SERVICES)), "check_name": pick(CHECKS, F.floor(F.col("at") / len(SERVICES)) % len(CHECKS)), "region": pick(REGIONS, F.floor(F.col("at") / (len(SERVICES) * len(CHECKS)))),
        "severity_in": F.when(sev, "critical").when(noise | deploy, "warning").otherwise(among(["warning", "info"], u("severity"))),
        "became_sev12": F.when(sev | (deploy & (u("became") < 0.05)), 1).otherwise(0),
    })
    truth = F.when(noise, "known_noise").when(deploy, F.when(F.col("became_sev12") == 1, "p2_high").otherwise("p3_medium")).when(sev, F.when(u("truth") < 0.7, "p1_critical").otherwise("p2_high")).otherwise(F.when(u("truth") < 0.7, "p3_medium").otherwise("p4_low"))
    low, width = F.when(sev, 2.0).when(noise, 1.3).when(deploy, 1.2).otherwise(1.05), F.when(sev, 2.0).when(noise, 1.2).when(deploy, 1.0).otherwise(0.4)
    return rows.select(
        "i", (F.col("i") * 53_000_000).alias("at_us"), "kind", "service", "check_name", "region", "severity_in", F.lit("prod").alias("env"), F.concat("region", F.lit("-a")).alias("cluster"),
        F.substring(F.sha2(F.concat_ws("|", "service", "check_name", "severity_in", "region", F.lit("prod"), F.concat("region", F.lit("-a"))), 256), 1, 16).alias("fingerprint"),
        F.round(80 * (low + width * u("metric")), 2).alias("metric_value"), F.when(noise, between(60, 600, u("breach"))).when(deploy, between(120, 1800, u("breach"))).otherwise(between(300, 3600, u("breach"))).alias("breach_s"),
        truth.alias("severity_true"), "became_sev12", F.when(noise, "suppress").when(F.col("became_sev12") == 1, "page_now").otherwise("page_business_hours").alias("disposition_true"),
    )


def answers(rows: DataFrame, seed: int, counter: str, label_noise: float = 0.0) -> DataFrame:
    """rows (severity_true, disposition_true) with probs_h (hundredths of OPTIONS, 100 together), q1_choice, q3_choice and q3_conf_h.

    Each probability of the template of what is true is moved by up to a tenth and rounded; the largest takes what
    is then missing of 100. A share of label_noise of the choices is another option. A truth without a template has null.
    """
    base = F.create_map(*[x for kind, p in TEMPLATES.items() for x in (F.lit(kind), F.array(*[F.lit(v) for v in p]))])
    template = F.try_element_at(base, F.col("severity_true"))
    moved = F.array(*[F.floor(F.get(template, F.lit(j)) * (0.9 + 0.2 * uniform(seed, f"p{j}", counter)) / 100 + 0.5).cast("int") for j in range(len(OPTIONS))])
    total = F.reduce("moved", F.lit(0), lambda s, x: s + x)
    top = F.array_position("moved", F.array_max("moved"))
    fixed = F.transform("moved", lambda x, j: F.when(j + 1 == top, x + 100 - total).otherwise(x))
    flips = uniform(seed, "flip", counter) < label_noise
    others = F.array_remove(F.array(*[F.lit(o) for o in OPTIONS]), F.col("severity_true"))
    wrong = F.get(others, F.floor(uniform(seed, "other", counter) * (len(OPTIONS) - 1)).cast("int"))
    u = uniform(seed, "confidence", counter)
    confidence = F.when(F.col("disposition_true") == "suppress", 90 + F.floor(u * 9)).otherwise(80 + F.floor(u * 19)).cast("int")
    known = F.when(template.isNotNull(), F.col("fixed"))
    return rows.withColumn("moved", moved).withColumn("fixed", fixed).select(*[F.col(f"`{c}`") for c in rows.columns], known.alias("probs_h"), F.when(template.isNotNull(), F.when(flips, wrong).otherwise(F.element_at(F.array(*[F.lit(o) for o in OPTIONS]), top.cast("int")))).alias("q1_choice"), F.col("disposition_true").alias("q3_choice"), confidence.alias("q3_conf_h"))


def poisson(mean: Column, u: Column) -> Column:
    """The number of arrivals whose distribution function first exceeds u; terms beyond 12 deviations of the mean are under 1e-16, those left out below under 1e-24."""
    wide = mean > WIDE_MEAN
    least = F.when(wide, F.floor(mean - 12 * F.sqrt(mean) - 24)).otherwise(0).cast("int")
    steps = F.sequence(least + 1, F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int"))
    k = least.cast("double")
    # the least term's logarithm, by Stirling's series; the next part of it is under 1e-14
    log = k * F.log(mean / k) + k - mean - F.log(2 * F.pi() * k) / 2 - 1 / (12 * k) + 1 / (360 * k * k * k)
    term = F.when(wide, F.exp(log)).otherwise(F.exp(-mean))
    start = F.struct(term.alias("term"), term.alias("upto"), least.alias("n"))

    def step(s: Column, k: Column) -> Column:
        term = s["term"] * mean / k
        return F.struct(term.alias("term"), (s["upto"] + term).alias("upto"), (s["n"] + F.when(s["upto"] <= u, 1).otherwise(0)).alias("n"))

    return F.reduce(steps, start, step, lambda s: s["n"])


def arrivals(cells: DataFrame, seed: int, *key: str) -> DataFrame:
    """A row with nth (from 1) and at_us for each arrival: Poisson of a cell's mean, dealt evenly over its span_us from from_us on. key names a cell; a mean that is null, 0 or less has none."""
    drawn = cells.where(F.col("mean") > 0).withColumn("n", F.when(F.col("mean") <= MAX_MEAN, poisson(F.col("mean"), uniform(seed, "count", *key))).otherwise(F.raise_error(F.lit(f"a cell's mean is at most {MAX_MEAN:g}"))))
    each = drawn.where("n > 0").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return each.withColumn("at_us", F.col("from_us") + F.floor(uniform(seed, "at", *key, "nth") * F.col("span_us"))).drop("n", "mean", "from_us", "span_us")


def schedule(spark: SparkSession, seed: int, rate_per_s: float, duration_s: float, storms: list[tuple[float, float, float]] = (), mean: float = 4.0) -> DataFrame:
    """(kind, cell, nth, at_us): arrivals at a base rate, and of each storm (start, seconds, times the rate) besides. Cells are of so many arrivals on average, so the table is made in parallel."""
    parts = []
    for kind, start, seconds, rate in [("base", 0.0, duration_s, rate_per_s), *((f"storm-{i}", s, d, rate_per_s * m) for i, (s, d, m) in enumerate(storms))]:
        if rate <= 0 or seconds <= 0:
            continue
        count = max(1, round(rate * seconds / mean))
        edge = lambda k, a=start, d=seconds, c=count: (F.lit(round(a * 1e6)) + F.floor(k * round(d * 1e6) / c)).cast("long")
        id_ = F.col("id")
        parts.append(spark.range(count).select(F.lit(kind).alias("kind"), id_.alias("cell"), edge(id_).alias("from_us"), (edge(id_ + 1) - edge(id_)).alias("span_us"), F.lit(rate * seconds / count).alias("mean")))
    if not parts:
        return spark.createDataFrame([], "kind string, cell long, nth int, at_us long")
    cells = parts[0]
    for p in parts[1:]:
        cells = cells.unionByName(p)
    return arrivals(cells, seed, "kind", "cell").select("kind", "cell", "nth", "at_us")
