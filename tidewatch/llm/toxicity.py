"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Features are the distinct hashed words of a text. P(grade <= k) is the logistic
function of cut_k - w.x: one weight vector shared by ordered cuts. Fitting draws a
bounded sample of graded rows, an equal part of each grade as far as there are so
many, so that rare grades are learnt from; each row weighs what its grade's part
stands for. It keeps the buckets whose share of texts is clearly higher above one of the cuts
than below it, and descends the likelihood. Weights are held at floor or more (0 unless given), so that
many neutral words never outweigh a few toxic ones; floor None lets them have either sign. Scoring reads whole texts
in Spark tasks and yields the expected grade.

Null and empty texts have no features and get the base severity. Rows without a
grade are not learned from; without any graded rows, or with one grade only, the
severity is that grade, or 0. Repeated rows get equal results and extra columns
are ignored. Very long texts are one set of words; without rows there is no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.decontaminate import words_of
from tidewatch.llm.hashing import word_hashes

BUCKETS = 1 << 20
#: Expected number of graded rows that a fit reads.
FIT_ROWS = 10_000
#: Buckets are features if so many sample texts have them and the two shares differ by so many standard errors.
MIN_TEXTS, MIN_Z, MAX_FEATURES = 5, 5.0, 4_096
STEPS, RATE, DECAY = 600, 0.1, 1e-6


def buckets_of(text: str | None) -> np.ndarray:
    """Distinct hashed words of a whole text."""
    words = words_of(text)
    return np.unique((word_hashes(words) % np.uint64(BUCKETS)).astype(np.int32)) if words else np.empty(0, np.int32)


def logistic(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class OrdinalModel:
    """Buckets, their weights, and the cuts between grades 0, 1, ..."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, cuts: np.ndarray):
        self.buckets, self.weights, self.cuts = buckets, weights, cuts

    def above(self, texts: list[str | None]) -> np.ndarray:
        """P(grade > k) of each text, a column a cut."""
        table = np.full(BUCKETS, -1, np.int32)
        table[self.buckets] = np.arange(len(self.buckets))
        total = np.zeros(len(texts))
        for i, text in enumerate(texts):
            at = table[buckets_of(text)]
            total[i] = self.weights[at[at >= 0]].sum()
        return logistic(total[:, None] - self.cuts[None, :])


def fit_sparse(rows: np.ndarray, columns: np.ndarray, grade: np.ndarray, width: int, weight: np.ndarray | None = None, floor: float | None = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(weights, cuts) by Adam on the penalised likelihood; cuts stay ordered as a first cut and positive gaps."""
    n, levels = len(grade), int(grade.max())
    weight = np.full(n, 1 / n) if weight is None else weight / weight.sum()
    w = np.zeros(width)
    # params: first cut, logarithms of the gaps
    share = np.clip([weight[grade <= k].sum() for k in range(levels)], 1e-4, 1 - 1e-4)
    start = np.log(share / (1 - share))
    c = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m = [np.zeros(width), np.zeros(levels)]
    v = [np.zeros(width), np.zeros(levels)]
    for t in range(1, STEPS + 1):
        gaps = np.exp(np.clip(c[1:], -10, 10))
        cuts = c[0] + np.concatenate([[0.0], np.cumsum(gaps)])
        eta = np.bincount(rows, w[columns], n)
        edges = np.concatenate([np.zeros((n, 1)), logistic(cuts[None, :] - eta[:, None]), np.ones((n, 1))], 1)
        at = np.arange(n)
        p = np.maximum(edges[at, grade + 1] - edges[at, grade], 1e-12)
        slope = edges * (1 - edges)
        g_eta = (slope[at, grade + 1] - slope[at, grade]) / p * weight
        g_cut = np.array([(np.where(grade == k, slope[:, k + 1], 0) - np.where(grade == k + 1, slope[:, k + 1], 0)) @ (-weight / p) for k in range(levels)])
        tail = np.cumsum(g_cut[::-1])[::-1]
        grads = [np.bincount(columns, g_eta[rows], width) + DECAY * w, np.concatenate([tail[:1], tail[1:] * gaps])]
        for k, (x, g) in enumerate(zip((w, c), grads)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            x -= RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        if floor is not None:
            np.maximum(w, floor, out=w)
    return w, c[0] + np.concatenate([[0.0], np.cumsum(np.exp(np.clip(c[1:], -10, 10)))])


def contrast(buckets: np.ndarray, row: np.ndarray, upper: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """By bucket: how many standard errors its share of the upper texts is above that of the others."""
    shares, n = [], []
    for side in (upper, ~upper):
        w = np.where(side, weight, 0)
        shares.append(np.bincount(buckets, w[row], BUCKETS) / max(w.sum(), 1e-12))
        n.append(max(1, side.sum()))
    pooled = (shares[0] * n[0] + shares[1] * n[1]) / sum(n)
    with np.errstate(divide="ignore", invalid="ignore"):
        z = (shares[0] - shares[1]) / np.sqrt(pooled * (1 - pooled) * (1 / n[0] + 1 / n[1]))
    z[~np.isfinite(z)] = 0
    return z


def fit(rows: DataFrame, grade: Column, text: str = "text", key: str = "doc_id", fit_rows: int = FIT_ROWS, floor: float | None = 0.0, labels: DataFrame | None = None) -> OrdinalModel:
    """Fit on about fit_rows of the rows whose grade (0, 1, ...) is not null.

    labels: a table of key (each once) that holds the grade instead of rows. It is drawn from before texts are joined
    to it, so no more than about fit_rows labels are broadcast, and no text is shuffled.
    """
    own = [F.col(text).alias("t")] if labels is None else []
    graded = (rows if labels is None else labels).select(F.col(key).cast("string").alias("k"), grade.cast("int").alias("y"), *own).where("y is not null")
    there = dict(graded.groupBy("y").count().collect())
    part, left = {}, fit_rows
    for k, (y, n) in enumerate(sorted(there.items(), key=lambda x: x[1])):  # rarest first: what it leaves goes to the others
        part[y] = min(1.0, left / (len(there) - k) / n)
        left -= part[y] * n
    draw = F.pmod(F.xxhash64("k", F.lit("toxicity")), F.lit(1 << 20))
    graded = graded.where(F.coalesce(*[F.when(F.col("y") == y, draw < int((1 << 20) * p)) for y, p in part.items()], F.lit(True)))
    if labels is not None:
        graded = rows.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).join(F.broadcast(graded), "k").select("k", "y", "t")

    def features(batches):
        for batch in batches:
            found = [buckets_of(t) for t in batch.column(2).to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.empty(0, np.int32), *found])))], names=["k", "y", "x"])

    sample = graded.mapInArrow(features, "k string, y int, x array<int>").toArrow().sort_by("k")
    y = sample["y"].to_numpy().astype(np.int64)
    none = np.empty(0, np.int64)
    if not len(y):
        return OrdinalModel(none, none.astype(float), np.full(1, np.inf))
    if y.min() == y.max():
        return OrdinalModel(none, none.astype(float), np.where(np.arange(max(1, y[0])) < y[0], -np.inf, np.inf))
    x = sample["x"].combine_chunks()
    buckets, row = x.flatten().to_numpy(), np.repeat(np.arange(len(y)), np.diff(x.offsets.to_numpy()))
    weight = np.array([1 / part[g] for g in y.tolist()])
    best, texts = np.zeros(BUCKETS), np.bincount(buckets, minlength=BUCKETS)
    for cut in range(y.max()):
        z = contrast(buckets, row, y > cut, weight)
        best = np.where(np.abs(z) > np.abs(best), z, best) if floor is None else np.maximum(best, z)
    best[texts < MIN_TEXTS] = 0
    chosen = np.argsort(-np.abs(best), kind="stable")[:MAX_FEATURES]
    chosen = np.sort(chosen[np.abs(best[chosen]) >= MIN_Z])
    place = np.full(BUCKETS, -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    column = place[buckets]
    weights, cuts = fit_sparse(row[column >= 0], column[column >= 0], y, len(chosen), weight, floor)
    return OrdinalModel(chosen, weights, cuts)


def score(docs: DataFrame, model: OrdinalModel, text: str = "text", key: str = "doc_id", toxic_from: float = 0.5) -> DataFrame:
    """Per row: key, severity (expected grade), grade (the highest that is likelier reached than not) and toxic (it reaches the highest)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            above = shipped.value.above(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(above.sum(1)), pa.array((above >= 0.5).sum(1).astype(np.int32)), pa.array(above[:, -1] >= toxic_from)], names=[key, "severity", "grade", "toxic"])

    return docs.select(F.col(key), F.col(text).cast("string").alias("__text")).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, severity double, grade int, toxic boolean")
