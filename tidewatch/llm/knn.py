"""Exact top-k search as a Voronoi kNN join for integer inner products.

Vectors become integers, floor(64 * x). Pivots, a bounded sample, divide all rows
into cells. First each query is solved in its own cell, which gives a lower bound
of its k-th score. Summaries of the other cells (radius about the pivot, longest
vector) bound the query's scores there from above: with pivot p and radius r no
member scores more than q.p + |q| r, nor more than |q| times the longest. Only the
cells that reach the lower bound are asked. Queries that need a cell are cut into blocks, and so is the
cell, so a common vector or a crowded cell is spread over tasks, and a row of a cell
is sent once for each block of queries that need it, not for each query or group. Each pair of
blocks is solved exactly, and the best k of all blocks are kept.

Vectors that are null or hold null or non-finite components take no part, nor do
rows without an id. Shorter vectors count as padded with zeros. Rows that share an
id are the same row's copies: a query never finds its own id, and repeated
identical rows count once. Fewer than k candidates give fewer ranks. Scores beyond the range of
a long are held at its ends. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import stored

SCALE = 64
#: Bounds of the number of pivots, which is the square root of the number of queries.
MIN_PIVOTS, MAX_PIVOTS = 4, 256
#: Rows of a block of queries and of a block of data: a score matrix of 8 MB.
QUERY_BLOCK, DATA_BLOCK = 512, 2048


def integers(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(id, v): valid rows, once each."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col(key).isNotNull() & F.col(column).isNotNull() & F.coalesce(finite, F.lit(False)))
    return rows.select(F.col(key).cast("long").alias("id"), F.transform(column, lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("long")).alias("v")).distinct()


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def solve(k: int):
    """Best k data rows of a block for each query of a block, ties to the smaller id."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        if not queries.num_rows or not data.num_rows:
            return schema.empty_table()
        data = data.sort_by("id")
        qid, did = queries["id"].to_numpy(), data["id"].to_numpy()
        q, d = matrix(queries["v"]), matrix(data["v"])
        top = lambda x: max(1.0, float(np.abs(x.astype(float)).max(initial=0)))
        if top(q) * top(d) * max(1, q.shape[1]) < 2**53:
            score = (q.astype(np.float64) @ d.T.astype(np.float64)).astype(np.int64)
        else:
            score = np.clip(q.astype(object) @ d.T.astype(object), -(2**63), 2**63 - 1).astype(np.int64)
        out = []
        for i in range(len(qid)):
            own = np.flatnonzero(did != qid[i])
            s = score[i, own]
            if len(s) > k:
                least = np.partition(s, len(s) - k)[len(s) - k]
                above = np.flatnonzero(s > least)
                best = np.concatenate([above, np.flatnonzero(s == least)[: k - len(above)]])
            else:
                best = np.arange(len(s))
            out.append((np.full(len(best), qid[i]), did[own[best]], s[best]))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out)], schema=schema)

    return run


def needed(q: np.ndarray, own: np.ndarray, least: np.ndarray, pivots: np.ndarray, radius: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """Which cells each query must ask: all but its own whose upper bound reaches the query's lower bound. Cells without rows have radius -inf."""
    norm = np.sqrt((q**2).sum(1))[:, None]
    cross = q @ pivots.T
    reach = np.maximum(radius, 0)
    slack = 1e-6 + 1e-9 * (np.abs(cross) + norm * (reach + 1) + norm * longest)
    out = (np.minimum(cross + norm * reach, norm * longest) + slack >= least[:, None]) & (radius >= 0)
    out[np.arange(len(q)), own] = False
    return out


def top_k(vectors: DataFrame, k: int = 20, key: str = "vec_id", column: str = "embedding", query_every: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score: the k best rows for each row whose id is divisible by query_every."""
    spark = vectors.sparkSession
    rows = integers(vectors, key, column)
    n, n_queries, dim = rows.agg(F.count("*"), F.count_if(F.col("id") % query_every == 0), F.max(F.size("v"))).first()
    dim = dim or 0
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v"))))
    wanted = min(MAX_PIVOTS, max(MIN_PIVOTS, math.isqrt(n_queries)))
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()
    pivots = np.array([r["v"] for r in chosen], float).reshape(len(chosen), dim)

    def assign(batches):
        square = (pivots**2).sum(1)
        for batch in batches:
            x = matrix(batch.column(1)).astype(float)
            near = ((x**2).sum(1)[:, None] - 2 * x @ pivots.T + square).argmin(1) if len(x) else np.empty(0, np.int64)
            away = np.sqrt(((x - pivots[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(away)], names=["id", "v", "cell", "away"])

    placed = stored(rows.mapInArrow(assign, "id long, v array<long>, cell int, away double"), "cells")
    is_query = F.col("id") % query_every == 0
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))
    summary = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"), F.max(norm).alias("longest"), F.count_if(is_query).alias("nq")).collect()
    size = {r["cell"]: r["n"] for r in summary}
    radius, longest = np.full(len(chosen), -np.inf), np.zeros(len(chosen))
    for r in summary:
        radius[r["cell"]], longest[r["cell"]] = r["radius"], r["longest"]
    blocks = lambda count, size: -(-count // size)
    part = lambda count: F.pmod(F.xxhash64("id"), F.col(count)).cast("int")

    def solved(asks: DataFrame, asked: dict[int, int]) -> DataFrame:
        """Best k of each block for asks (id, v, s: cell); asked: queries of each cell."""
        plan = spark.createDataFrame([(s, blocks(n, QUERY_BLOCK), blocks(size[s], DATA_BLOCK)) for s, n in asked.items()], "s int, nq int, nd int")  # a row for each pivot at most
        ask = asks.join(F.broadcast(plan), "s").select("id", "v", "s", part("nq").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("nd") - 1)).alias("db"))
        data = placed.join(F.broadcast(plan), F.col("cell") == F.col("s")).select("id", "v", "s", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb"), part("nd").alias("db"))
        data = data.select([F.col(c).alias(f"{c}_") for c in data.columns]).toDF(*data.columns)
        by = ["s", "qb", "db"]
        return ask.groupBy(*by).cogroup(data.groupBy(*by)).applyInArrow(solve(k), "query_id long, vec_id long, score long").distinct()

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    best = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    queries = placed.where(is_query)
    first = stored(best(solved(queries.select("id", "v", F.col("cell").alias("s")), {r["cell"]: r["nq"] for r in summary if r["nq"]})).select("query_id", "vec_id", "score"), "first")
    bound = first.groupBy("query_id").agg(F.count("*").alias("found"), F.min("score").alias("least")).where(F.col("found") >= k).select("query_id", "least")

    def choose(batches):
        for batch in batches:
            q = matrix(batch.column(1)).astype(float)
            least = batch.column(3).cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
            at, cell = np.nonzero(needed(q, batch.column(2).to_numpy(), least, pivots, radius, longest))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(cell.astype(np.int32))], names=["id", "v", "s"])

    rest = stored(queries.join(bound, F.col("id") == F.col("query_id"), "left").select("id", "v", "cell", "least").mapInArrow(choose, "id long, v array<long>, s int"), "asks")
    asked = {r["s"]: r["n"] for r in rest.groupBy("s").agg(F.count("*").alias("n")).collect()}
    found = first.union(solved(rest, asked)).distinct() if asked else first
    return best(found).select("query_id", "rank", "vec_id", "score")
