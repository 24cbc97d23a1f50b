"""What is made up does not depend on partitions, and has the shares and rates asked for."""

import math

import pytest
from pyspark.sql import functions as F
from tidewatch.sources import synthetic


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_alerts_do_not_depend_on_partitions(spark):
    made = synthetic.answers(synthetic.alerts(spark, 400, 3), 3, "i", 0.2)
    once = rows_of(made)
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "97")
    try:
        assert rows_of(synthetic.answers(synthetic.alerts(spark, 400, 3), 3, "i", 0.2)) == once
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert rows_of(synthetic.answers(synthetic.alerts(spark, 300, 3), 3, "i", 0.2).where("i < 300")) == [r for r in once if r[0] < 300]
    assert rows_of(synthetic.alerts(spark, 400, 4)) != rows_of(synthetic.alerts(spark, 400, 3))


def test_shares_and_labels(spark):
    n = 20_000
    made = synthetic.alerts(spark, n, 11)
    share = {r["kind"]: r["count"] / n for r in made.groupBy("kind").count().collect()}
    for kind, p in synthetic.KINDS.items():
        assert abs(share[kind] - p) < 5 * (p * (1 - p) / n) ** 0.5
    quiet = made.where("kind = 'known_noise'").select("service", "check_name", "region").distinct()
    assert made.where("kind <> 'known_noise'").join(quiet, ["service", "check_name", "region"], "left_semi").count() == 0
    triples = made.select("service", "check_name", "region").distinct().count()
    assert triples == len(synthetic.SERVICES) * len(synthetic.CHECKS) * len(synthetic.REGIONS)
    assert made.where("service is null or check_name is null or region is null or metric_value is null or breach_s is null").count() == 0
    assert made.where("kind = 'real_sev' and became_sev12 = 0 or kind in ('known_noise', 'p3p4_warning') and became_sev12 = 1").count() == 0


def test_answers_are_hundredths_that_make_a_whole(spark):
    made = synthetic.answers(synthetic.alerts(spark, 4_000, 5), 5, "i")
    assert made.where(F.reduce("probs_h", F.lit(0), lambda s, x: s + x) != 100).count() == 0
    assert made.where("q1_choice <> severity_true or q3_conf_h not between 80 and 98").count() == 0
    wrong = synthetic.answers(synthetic.alerts(spark, 4_000, 5), 5, "i", 0.25).where("q1_choice <> severity_true").count()
    assert abs(wrong / 4_000 - 0.25) < 5 * (0.25 * 0.75 / 4_000) ** 0.5
    odd = spark.createDataFrame([(1, None, "suppress"), (2, "odd", None)], "i long, severity_true string, disposition_true string")
    assert [(r["probs_h"], r["q1_choice"]) for r in synthetic.answers(odd, 1, "i").collect()] == [(None, None)] * 2


@pytest.mark.parametrize("mean", [0.3, 4.0, 60.0, 500.0])
def test_counts_are_poisson(spark, mean):
    n = 4_000
    cells = spark.range(n).select("id", F.lit(mean).alias("mean"))
    got = cells.select(synthetic.poisson(F.col("mean"), synthetic.uniform(2, "c", "id")).alias("n")).agg(F.avg("n"), F.var_samp("n")).first()
    assert abs(got[0] - mean) < 5 * (mean / n) ** 0.5
    assert abs(got[1] - mean) < 6 * ((mean + 2 * mean**2) / n) ** 0.5


def test_a_schedule_with_a_storm(spark):
    made = synthetic.schedule(spark, 9, 5.0, 600.0, [(100.0, 60.0, 10.0)])
    by = {r["kind"]: r for r in made.groupBy("kind").agg(F.count("*").alias("n"), F.min("at_us").alias("a"), F.max("at_us").alias("b")).collect()}
    assert abs(by["base"]["n"] - 3_000) < 5 * 3_000**0.5 and abs(by["storm-0"]["n"] - 3_000) < 5 * 3_000**0.5
    assert 0 <= by["base"]["a"] and by["base"]["b"] < 600e6 and 100e6 <= by["storm-0"]["a"] and by["storm-0"]["b"] < 160e6
    tenths = [r["n"] for r in made.where("kind = 'base'").groupBy(F.floor(F.col("at_us") / 60e6).alias("m")).agg(F.count("*").alias("n")).collect()]
    assert len(tenths) == 10 and all(abs(t - 300) < 5 * 300**0.5 for t in tenths)
    assert synthetic.schedule(spark, 9, 0.0, 600.0).count() == 0


def test_cells_without_a_mean_have_no_arrivals(spark):
    cells = spark.createDataFrame([(1, None), (2, 0.0), (3, -1.0)], "id long, mean double").withColumns({"from_us": F.lit(0), "span_us": F.lit(10)})
    assert synthetic.arrivals(cells, 1, "id").count() == 0
    with pytest.raises(Exception, match="at most"):
        synthetic.arrivals(cells.withColumn("mean", F.lit(1e6)), 1, "id").collect()


@pytest.mark.parametrize("mean", [3.0, 499.0, 501.0, 1_260.0, 7_560.0])
def test_counts_of_any_mean_are_the_distributions(spark, mean):
    """Against sums of terms by the logarithm of the factorial; means over 500 were refused."""
    us = [0.001, 0.2, 0.5, 0.77, 0.999, 1 - 1e-9]
    want, k, upto = [], 0, 0.0
    for u in us:
        while (upto_k := upto + math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))) <= u:
            upto, k = upto_k, k + 1
        want.append(k)
    df = spark.createDataFrame(list(enumerate(us)), "id long, u double").withColumn("mean", F.lit(mean))
    assert [r["n"] for r in df.select("id", synthetic.poisson(F.col("mean"), F.col("u")).alias("n")).orderBy("id").collect()] == want


def test_a_busy_cell_has_all_its_arrivals(spark):
    cells = spark.range(200).select(F.col("id"), F.lit(900.0).alias("mean"), F.lit(0).alias("from_us"), F.lit(1_000).alias("span_us"))
    n = synthetic.arrivals(cells, 4, "id").count()
    assert abs(n - 180_000) < 5 * 180_000**0.5
