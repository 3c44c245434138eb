"""Counterfactual-regularised toxicity classifier.

A logistic model over the words of a whole text and their prefixes (presence, hashed). It is fitted on a bounded
sample of labelled rows: for each row that names a group of people a counterfactual row is made by swapping
every identity term for the next one of its set, and the squared difference of the two scores' logits is
penalised, so that naming a group neither raises nor lowers a score by itself.

Defined results: null and empty texts get the score of a text without any known feature; equal texts get equal
scores; a null id is not held out; rows without a label are scored only; an id with several labels counts as
toxic if one of them says so; without labelled rows every score is 0. Extra columns are not used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, read, store, with_fields, word_list

#: Most labelled rows that the model is fitted on (taken in the order of a hash of the id).
SAMPLE_ROWS = 20_000
#: Hashed features, and how many of them (the most associated with the label) the model uses at most.
SPACE, FEATURES = 1 << 22, 2048
LEAST_ROWS = 3
PREFIXES = (4, 5, 6)
RIDGE, COUNTERFACTUAL = 3e-4, 1.0
STEPS, RATE = 400, 0.1
THRESHOLD = 0.7
#: Words a Python worker remembers the features of.
CACHE_WORDS = 300_000

#: Identity terms by set; a term's counterfactual is the next one of its set.
IDENTITY = (
    "women men", "woman man", "girls boys", "girl boy", "muslims christians jews hindus buddhists atheists", "muslim christian jewish hindu buddhist atheist",
    "gay straight lesbian bisexual", "black white asian latino", "immigrants natives refugees", "immigrant native refugee", "africans europeans americans",
    "frauen männer", "muslime christen juden", "schwule heteros", "ausländer inländer",
    "femmes hommes", "musulmans chrétiens juifs", "étrangers français",
    "mujeres hombres", "musulmanes cristianos judíos", "extranjeros españoles",
)
SWAP = {a.encode(): b.encode() for s in IDENTITY for x in [s.split()] for a, b in zip(x, x[1:] + x[:1])}


def word_features(w: bytes) -> list[int]:
    """The word itself and its prefixes of a few characters, hashed."""
    s = w.decode("utf-8", "surrogatepass")
    return [xxhash.xxh3_64_intdigest(x) % SPACE for x in (b"=" + w, *(s[:n].encode("utf-8", "surrogatepass") for n in PREFIXES if len(s) >= n))]


class Features(dict):
    """word -> tuple of its features, of those in ``only`` if given (as their places)."""

    def __init__(self, only: dict[int, int] | None = None):
        super().__init__()
        self.only = only

    def __missing__(self, w: bytes) -> tuple[int, ...]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        f = word_features(w)
        self[w] = got = tuple(f if self.only is None else (self.only[x] for x in f if x in self.only))
        return got

    def of(self, words: set[bytes]) -> list[int]:
        return sorted({f for w in words for f in self[w]})


def _sample(docs: DataFrame, labels: DataFrame, learn, label: str, rows: int) -> DataFrame:
    """(y, text) of at most ``rows`` labelled rows that ``learn`` allows; equal rows of one id count once."""
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).cast("int").alias("y"))
    own_rows = docs.where(learn & F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("_h"))
    ids = own_rows.select(F.col("doc_id").alias("_id"), "_h").distinct().join(own, "_id").select("_id", F.col("_h").alias("_th"), "y")
    ids = ids.orderBy(F.xxhash64("_id"), "_id", "_th").limit(rows)
    # bounded by ``rows``
    got = own_rows.join(F.broadcast(ids), (F.col("doc_id") == F.col("_id")) & (F.col("_h") == F.col("_th")))
    return got.select("_id", "_th", "y", "text").dropDuplicates(["_id", "_th"]).select("y", "text")


def _sample_features(sample: DataFrame) -> DataFrame:
    """(y, x, swapped): features of each sampled text and of its counterfactual (null: it names no group)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Features()
        kind = pa.list_(pa.int32())
        for b in batches:
            words = [set(word_list(t)) for t in b.column("text").to_pylist()]
            swapped = [{SWAP.get(w, w) for w in ws} if not ws.isdisjoint(SWAP) else None for ws in words]
            yield pa.record_batch(
                [b.column("y"), pa.array([cache.of(ws) for ws in words], kind), pa.array([None if ws is None else cache.of(ws) for ws in swapped], kind)],
                ["y", "x", "swapped"],
            )

    return sample.mapInArrow(run, "y int, x array<int>, swapped array<int>")


def select_features(rows: DataFrame, most: int = FEATURES, least: int = LEAST_ROWS) -> list[int]:
    """The features most associated with the label by chi-square, of those in at least ``least`` rows.

    A feature must exceed what the largest of as many unrelated ones would reach by chance, about 2 ln(count), so
    that a small sample yields few features and no noise.
    """
    n, pos = rows.agg(F.count("*"), F.sum("y")).first()
    if not n or not pos or pos == n:
        return []
    c = rows.select("y", F.explode("x").alias("f")).groupBy("f").agg(F.count("*").alias("a"), F.sum("y").alias("p")).where(F.col("a") >= least)
    expected = F.col("a") * (pos / n)
    chi = (F.col("p") - expected) ** 2 / (expected * (1 - pos / n) * (1 - F.col("a") / (n + 1.0)))
    chance = 2 * math.log(max(c.count(), 1))
    return [r["f"] for r in c.withColumn("chi", chi).where(F.col("chi") >= chance).orderBy(F.desc("chi"), "f").limit(most).select("f").collect()]


class Rows:
    """Sparse 0/1 rows."""

    def __init__(self, lists: list[list[int]], width: int):
        self.n, self.width = len(lists), width
        self.row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        self.col = np.array([c for x in lists for c in x], np.int64)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, g[self.row], self.width)


def fit(x: list[list[int]], y: np.ndarray, pairs: list[tuple[list[int], list[int]]], width: int, counterfactual: float = COUNTERFACTUAL) -> tuple[np.ndarray, float]:
    """Weights and bias: class-balanced logistic loss + ridge + penalty on the logit change of each pair."""
    a = Rows(x, width)
    p, q = Rows([i for i, _ in pairs], width), Rows([j for _, j in pairs], width)
    pos = max(y.sum(), 1)
    cost = np.where(y == 1, 0.5 / pos, 0.5 / max(len(y) - pos, 1))
    theta, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, STEPS + 1):
        w, b = theta[:-1], theta[-1]
        g = cost * (1 / (1 + np.exp(-np.clip(a.times(w) + b, -40, 40))) - y)
        grad = np.append(a.back(g) + RIDGE * w, g.sum())
        if pairs:
            change = (p.times(w) - q.times(w)) * (2 * counterfactual / len(pairs))
            grad[:-1] += p.back(change) - q.back(change)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - RATE * (1 - t / (STEPS + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return theta[:-1], float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, learn, label: str = "toxic", rows: int = SAMPLE_ROWS, counterfactual: float = COUNTERFACTUAL) -> tuple[dict[int, float], float]:
    """(feature -> weight, bias); ``learn``: boolean column of the documents that labels may be taken of."""
    r = store(_sample_features(_sample(docs, labels, learn, label, rows)), "toxicity-sample")
    chosen = set(select_features(r))
    if not chosen:
        return {}, -40.0
    # identity terms always have a weight, so that the penalty can act on it
    chosen |= {f for w in SWAP for f in word_features(w)}
    place = {f: i for i, f in enumerate(sorted(chosen))}
    some = _chosen_rows(r, place)
    x, y = [t[1] for t in some], np.array([t[0] for t in some])
    pairs = [(t[1], t[2]) for t in some if t[2] is not None]
    w, b = fit(x, y, pairs, len(place), counterfactual)
    return {f: float(w[i]) for f, i in place.items() if w[i]}, b


def _chosen_rows(r: DataFrame, place: dict[int, int]) -> list[tuple[int, list[int], list[int] | None]]:
    """The sampled rows cut to the chosen features (bounded by the sample's rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int32())
        for b in batches:
            cut = [pa.array([None if x is None else [place[f] for f in x if f in place] for x in b.column(c).to_pylist()], kind) for c in ("x", "swapped")]
            yield pa.record_batch([b.column("y"), *cut], ["y", "x", "swapped"])

    return [(t["y"], t["x"], t["swapped"]) for t in r.mapInArrow(run, "y int, x array<int>, swapped array<int>").collect()]


def score(docs: DataFrame, model: tuple[dict[int, float], float], name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``, the score (0 to 1) of the column ``text``."""
    weights, bias = model
    place = {f: i for i, f in enumerate(weights)}
    value = np.array([*weights.values(), 0.0])
    docs = docs.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Features(place)
        for b in batches:
            z = np.array([value[cache.of(set(word_list(t)))].sum() + bias for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))), pa.float64())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, with_fields(docs, **{name: "double"}))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    model = train(docs, read(spark, sf_dir, "labels"), ~held)
    s = score(docs, model)
    return s.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
