"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters are lower-cased and everything but letters becomes one separator;
n-grams of one to three characters are hashed to BUCKETS. Fitting sums n-gram
counts by language in Spark. The log-probability matrix (languages x BUCKETS) is
broadcast, and batches of whole texts are scored with numpy.

A text that is null, empty or without a letter gets language `und` and score 0.
Without any training row every text gets `und`. Ties go to the first language in
order of name. Repeated rows get equal results; extra columns are ignored by the
prediction. Long texts are scored in one go, at a few bytes a character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import chunks

BUCKETS = 1 << 15
#: Expected number of labelled rows that a fit reads, drawn by language and a hash of the row's key.
FIT_ROWS = 20_000
#: The matrix goes to every executor: more languages than this are refused.
MAX_LANGUAGES = 1_000
CHUNK_CHARS = 250_000
#: Rows of a batch whose texts are Python strings together.
SLICE = 500
UNKNOWN = "und"

_FOLD: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """Code point of each letter's lower case, 0 for what is no letter."""
    if not _FOLD:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if (x := chr(c)).isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _FOLD.append(table)
    return _FOLD[0]


def hashed_ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of the n-grams of all texts, text of each n-gram's first character, letters of each text)."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    x, owner = fold_table()[codes], np.repeat(np.arange(len(texts), dtype=np.int32), size)
    letters = np.bincount(owner[x > 0], minlength=len(texts))
    # a run of characters that are no letters counts once
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] > 0) | (x[:-1] > 0) | (owner[1:] != owner[:-1])
    x, owner = x[keep], owner[keep]
    if not len(x):
        return np.empty(0, np.int32), owner, letters
    one = x * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (x[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
    three = (two[:-1] ^ (x[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    same2 = owner[1:] == owner[:-1]
    same3 = owner[2:] == owner[:-2]
    h = np.concatenate([one[x > 0], two[same2], three[same3]]) >> np.uint32(17)
    return h.astype(np.int32), np.concatenate([owner[x > 0], owner[:-1][same2], owner[:-2][same3]]), letters


class LanguageModel:
    """languages and the matrix of log-probabilities, one column a language."""

    def __init__(self, languages: list[str], logp: np.ndarray, prior: np.ndarray):
        self.languages, self.logp, self.prior = languages, logp, prior

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names: list[str] = []
        scores: list[float] = []
        for begin, end in chunks(texts, max(50_000, CHUNK_CHARS * 4 // max(4, len(self.languages)))):
            part = [t or "" for t in texts[begin:end]]
            buckets, owner, letters = hashed_ngrams(part)
            if not self.languages:
                names += [UNKNOWN] * len(part)
                scores += [0.0] * len(part)
                continue
            total = np.empty((len(part), len(self.languages)))
            for k in range(len(self.languages)):
                total[:, k] = np.bincount(owner, self.logp[:, k][buckets], len(part)) + self.prior[k]
            best = total.argmax(1)
            top = total[np.arange(len(part)), best]
            share = 1 / np.exp(total - top[:, None]).sum(1)
            names += [self.languages[b] if n else UNKNOWN for b, n in zip(best.tolist(), letters.tolist())]
            scores += np.where(letters > 0, share, 0.0).tolist()
        return names, scores


def shares(sizes: dict[str, int], total: int) -> dict[str, float]:
    """What share of each language's rows is drawn, so that about total are: what rare ones leave goes to the others."""
    out = {}
    for k, (name, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        take = min(n, total / (len(sizes) - k))
        out[name], total = take / n, total - take
    return out


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", fit_rows: int = FIT_ROWS) -> LanguageModel:
    """Fit on about fit_rows of the rows with a language and a text: all rows of rare languages first, then equal shares, drawn by a hash of key. Priors are those of all rows."""
    usable = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(lang).alias("l"), F.col(text).alias("t"))
    docs = dict(usable.groupBy("l").count().limit(MAX_LANGUAGES + 1).collect())
    if len(docs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if sum(docs.values()) > fit_rows:
        below = F.create_map(*[x for name, share in shares(docs, fit_rows).items() for x in (F.lit(name), F.lit(int(share * (1 << 62))).cast("long"))])
        usable = usable.where(F.pmod(F.xxhash64("k", F.lit("langid")), F.lit(1 << 62)) < below[F.col("l")])

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in (whole.slice(begin, SLICE) for whole in batches for begin in range(0, whole.num_rows, SLICE)):
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for begin, end in chunks(texts, CHUNK_CHARS):
                buckets, owner, _ = hashed_ngrams(texts[begin:end])
                names = np.array(langs[begin:end], object)
                for name in set(names.tolist()):
                    had = np.bincount(buckets[(names == name)[owner]], minlength=BUCKETS)
                    sums[name] = sums.get(name, 0) + had
        for name, had in sums.items():
            at = np.flatnonzero(had)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(had[at], pa.int64())], names=["l", "b", "n"])
    summed = usable.select("t", "l").mapInArrow(count, "l string, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n"))
    languages = sorted(docs)
    counts = np.zeros((BUCKETS, len(languages)))
    found = summed.toArrow()
    at = {name: k for k, name in enumerate(languages)}
    if found.num_rows:
        column = np.fromiter((at[x] for x in found["l"].to_pylist()), np.int64, found.num_rows)
        counts[found["b"].to_numpy(), column] = found["n"].to_numpy()
    logp = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * BUCKETS))
    prior = np.log(np.array([docs[x] for x in languages], float) / max(1, sum(docs.values())))
    return LanguageModel(languages, logp, prior)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", key: str = "doc_id", keep: list[str] | None = None, into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns keep (key alone, if not given), and the language and score of every row, by the names of into."""
    keep = [key] if keep is None else keep
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + f", {into[0]} string, {into[1]} double"
    at = keep.index(text) if text in keep else len(keep)

    def run(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, SLICE):
                batch = whole.slice(begin, SLICE)
                names, scores = shipped.value.predict(batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, *into])

    return docs.select(*keep, *[] if text in keep else [F.col(text).cast("string").alias("__text")]).mapInArrow(run, schema)
