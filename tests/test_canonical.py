"""Canonical JSON, byte for byte that of Python's json module."""

import hashlib
import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tidewatch.functions import canonical

KIND = "struct<z:string,a:double,`é k`:bigint,m:map<string,array<struct<y:boolean,x:string>>>,l:array<double>,s:struct<b:int,a:map<string,string>>>"


def python(x, ascii_only):
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only)


def plain(x):
    return {k: plain(v) for k, v in (x.asDict() if isinstance(x, T.Row) else x).items()} if isinstance(x, (T.Row, dict)) else [plain(v) for v in x] if isinstance(x, list) else x


TEXTS = ["", "plain", 'a"b\\c', "\x00\x01\x1f\x7f\b\t\n\f\r", "é ퟿￿", "😀 \U0010ffff x", "/</", None]


@pytest.mark.parametrize("ascii_only", [False, True])
def test_nested_values(spark, ascii_only):
    rng = random.Random(5)
    some = lambda: rng.choice(TEXTS)
    key = lambda: rng.choice([t for t in TEXTS if t is not None])
    rows = [((some(), rng.choice([None, 0.1, -3.0, 1e22]), rng.choice([None, -(2**63), 7]), rng.choice([None, {}, {key(): [(True, some()), None], key(): None}]), rng.choice([None, [], [1.5, None]]), rng.choice([None, (None, {key(): some(), key(): some()}), (3, None)])),) for _ in range(120)]
    df = spark.createDataFrame([*rows, (None,)], f"v {KIND}")
    got = df.select("v", canonical.canonical(F.col("v"), df.schema["v"].dataType, ascii_only).alias("t"), canonical.digest(F.col("v"), df.schema["v"].dataType).alias("h")).collect()
    for r in got:
        value = plain(r["v"]) if r["v"] is not None else None
        assert r["t"] == python(value, ascii_only)
        assert r["h"] == hashlib.sha256(python(value, False).encode()).hexdigest()


def test_doubles(spark):
    rng = random.Random(9)
    edges = [0.0, -0.0, 1.0, 1e-3, 9.99e-4, 1e-4, 1.5e-4, 9.9e-5, 1e-5, -1.25e-7, 1e7, 1.5e7, 123456789.125, 9007199254740993.0, 1e15, 1e16, 1.2e16, 1e21, 1e22, 1e100, 1.7976931348623157e308, 5e-324, 2.0**-44, math.inf, -math.inf]
    drawn = [x for x in (struct.unpack("d", rng.randbytes(8))[0] for _ in range(10_000)) if not math.isnan(x)] + [rng.uniform(-1, 1) * 10 ** rng.randrange(-8, 20) for _ in range(10_000)]
    rows = spark.createDataFrame([(x,) for x in edges + drawn], "x double")
    wrong = [(r["x"], r["t"]) for r in rows.select("x", canonical.canonical(F.col("x"), T.DoubleType()).alias("t")).collect() if r["t"] != json.dumps(r["x"])]
    assert not wrong, (len(wrong), wrong[:8])
    assert spark.createDataFrame([(math.nan,)], "x double").select(canonical.number(F.col("x"))).first()[0] == json.dumps(math.nan)


def test_what_has_no_form(spark):
    for kind in (T.DateType(), T.DecimalType(5, 2), T.MapType(T.LongType(), T.StringType()), T.StructType([T.StructField("a", T.DateType())])):
        with pytest.raises(TypeError):
            canonical.canonical(F.lit(None), kind)


def test_no_python_runs(spark):
    df = spark.createDataFrame([((1, "x"),)], "v struct<b:int,a:string>")
    plan = df.select(canonical.digest(F.col("v"), df.schema["v"].dataType))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.replace("PythonRDD", "") and "Arrow" not in plan
