"""Document quality from a linear-chain conditional random field over lines.

Every line gets a feature vector (shares of character classes, word and repetition figures) together with those
of the lines before and after it. The field labels each line good or bad; training labels are the document's
label on each of its lines. Forward-backward gives every line's marginal probability of being good; the mean
over lines, weighted by their lengths, is the document's raw quality, and a one-dimensional logistic fit on the
sample turns it into the score.

Defined results: a null or empty text is one empty line; equal texts get equal scores; a null id is not held
out; an id with several labels is good if one of them says so; without labels of both kinds every score is 0.5.
Extra columns are not used. Texts are never cut: a long document is a long chain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, read, store, with_fields
from .toxicity import _sample

#: Most labelled rows that the field is fitted on, and the lines beyond which a labelled row is left out of the fit.
SAMPLE_ROWS, SAMPLE_LINES = 4_000, 400
STEPS, RATE, RIDGE = 150, 0.1, 1e-3
THRESHOLD = 0.3

#: Byte classes of the line features.
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t", "mark": b".,;:'\"?()-", "symbol": b"!#$%&*+/<=>@[\\]^_`{|}~"}
_CLASS = np.zeros(256, np.uint8)
for _i, _b in enumerate(CLASSES.values(), 1):
    _CLASS[list(_b)] = _i
OWN = len(CLASSES) + 8
WIDTH = 3 * OWN + 3


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines, OWN) features and the lines' weights (characters + 1)."""
    lines = (text or "").split("\n")
    raw = [x.encode("utf-8", "surrogatepass") for x in lines]
    size = np.array([len(x) for x in raw], np.float64)
    flat = _CLASS[np.frombuffer(b"".join(raw), np.uint8)].astype(np.int64)
    line = np.repeat(np.arange(len(raw)), size.astype(np.int64))
    k = len(CLASSES) + 1
    share = np.bincount(line * k + flat, minlength=len(raw) * k).reshape(-1, k)[:, 1:] / np.maximum(size, 1)[:, None]
    count, rest = {}, np.zeros((len(raw), 8))
    for x in raw:
        count[x] = count.get(x, 0) + 1
    for i, x in enumerate(raw):
        w = x.split()
        n = len(w)
        if n:
            d = len(set(w))
            # neighbours that repeat, share of distinct words, mean length, repeats of the line in the text
            rest[i, :6] = (sum(map(bytes.__eq__, w, w[1:])) / n, d / n, (size[i] - n + 1) / n / 10, np.log1p(n) / 5, d > 1, count[x] > 1)
        rest[i, 6] = n == 0
        rest[i, 7] = 1.0
    return np.concatenate([share, rest], axis=1), size + 1


def with_neighbours(f: np.ndarray) -> np.ndarray:
    """Own, previous and next line's features, and whether there is a previous, a next, and any other line."""
    n = len(f)
    out = np.zeros((n, WIDTH))
    out[:, :OWN] = f
    out[1:, OWN : 2 * OWN] = f[:-1]
    out[:-1, 2 * OWN : 3 * OWN] = f[1:]
    out[1:, -3], out[:-1, -2], out[:, -1] = 1, 1, n > 1
    return out


class Chains:
    """Lines of many documents as chains, walked side by side."""

    def __init__(self, lengths: np.ndarray):
        # documents by falling length: those still alive at step t are the first alive[t]
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        first = np.concatenate(([0], np.cumsum(lengths)[:-1]))[self.order]
        self.alive = np.searchsorted(-self.lengths, -np.arange(1, (self.lengths[0] if len(lengths) else 0) + 1), "right")
        self.at = [first[:a] + t for t, a in enumerate(self.alive)]

    def marginals(self, emit: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) per line and the expected transition counts; emit: logit of good against bad per line."""
        n = len(emit)
        e = np.stack([np.zeros(n), emit], axis=1)
        e = np.exp(e - e.max(axis=1, keepdims=True))
        t = np.exp(trans - trans.max())
        fwd, back = np.empty((n, 2)), np.ones((n, 2))
        prev = None
        for at in self.at:
            a = e[at] if prev is None else (prev[: len(at)] @ t) * e[at]
            prev = fwd[at] = a / a.sum(axis=1, keepdims=True)
        expected = np.zeros((2, 2))
        for i in range(len(self.at) - 2, -1, -1):
            here, after = self.at[i][: len(self.at[i + 1])], self.at[i + 1]
            x = e[after] * back[after]
            b = x @ t.T
            back[here] = b / b.sum(axis=1, keepdims=True)
            both = fwd[here][:, :, None] * t * x[:, None, :]
            expected += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        p = fwd * back
        return p[:, 1] / p.sum(axis=1), expected


Model = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[float, float]]


def _raw(p: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(p * weight, first) / np.add.reduceat(weight, first)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Model:
    """Field weights (mean and scale of features, emission weights, transitions) and the final logistic fit."""
    lengths = np.array([len(f) for f, _ in docs])
    x = np.concatenate([with_neighbours(f) for f, _ in docs])
    weight, first = np.concatenate([w for _, w in docs]), np.concatenate(([0], np.cumsum(lengths)[:-1]))
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean, scale = np.where(scale > 1e-9, mean, 0), np.where(scale > 1e-9, scale, 1)
    x = (x - mean) / scale
    lab = np.repeat(y, lengths)
    # both labels weigh the same in sum, each document as one
    cost = np.repeat(np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) / lengths, lengths)
    chains = Chains(lengths)
    pairs = np.zeros((2, 2))
    for v in (0, 1):
        pairs[v, v] = (lengths[y == v] - 1).sum()
    theta = np.zeros(WIDTH + 4)
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    lines = max(len(lab), 1)
    for t in range(1, STEPS + 1):
        p, expected = chains.marginals(x @ theta[:WIDTH], theta[WIDTH:].reshape(2, 2))
        grad = np.concatenate([x.T @ (cost * (p - lab)), ((expected - pairs) / lines).ravel()]) + RIDGE * theta
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad * grad
        theta = theta - RATE * (1 - t / (STEPS + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-9)
    trans = theta[WIDTH:].reshape(2, 2)
    p, _ = chains.marginals(x @ theta[:WIDTH], trans)
    z = _logit(_raw(p, weight, first))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a ridge-bound logistic fit
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((q - y) * z).sum() + 0.1 * (a - 1), (q - y).sum()])
        w = q * (1 - q) + 1e-6
        h = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum()]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g) * 0.5
    return mean, scale, theta[:WIDTH], trans, (float(a), float(b))


def predict(texts: list[str | None], model: Model | None) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    mean, scale, w, trans, (a, b) = model
    docs = [line_features(t) for t in texts]
    lengths = np.array([len(f) for f, _ in docs], np.int64)
    emit = np.concatenate([((with_neighbours(f) - mean) / scale) @ w for f, _ in docs])
    p, _ = Chains(lengths).marginals(emit, trans)
    raw = _raw(p, np.concatenate([x for _, x in docs]), np.concatenate(([0], np.cumsum(lengths)[:-1])))
    return 1 / (1 + np.exp(-np.clip(a * _logit(raw) + b, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, learn, label: str = "quality", rows: int = SAMPLE_ROWS) -> Model | None:
    """The field, fitted on at most ``rows`` labelled documents that ``learn`` (boolean column) allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, f, w = [], [], []
            for label_, t in zip(b.column("y").to_pylist(), b.column("text").to_pylist()):
                if t.count("\n") < SAMPLE_LINES:
                    x, size = line_features(t)
                    y.append(label_)
                    f.append(x.astype("<f4").tobytes())
                    w.append(size.astype("<f4").tobytes())
            yield pa.record_batch([pa.array(y, pa.int32()), pa.array(f, pa.binary()), pa.array(w, pa.binary())], ["y", "f", "w"])

    got = store(_sample(docs, labels, learn, label, rows).mapInArrow(run, "y int, f binary, w binary"), "quality-sample").collect()
    y = np.array([r["y"] for r in got])
    if not len(y) or y.min() == y.max():
        return None
    return fit([(np.frombuffer(r["f"], "<f4").reshape(-1, OWN).astype(float), np.frombuffer(r["w"], "<f4").astype(float)) for r in got], y)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with a column ``score`` (0 to 1) of the column ``text``."""
    docs = docs.drop("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(predict(b.column("text").to_pylist(), model), pa.float64())], names=[*b.schema.names, "score"])

    return docs.mapInArrow(run, with_fields(docs, score="double"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    s = score(docs, train(docs, read(spark, sf_dir, "labels"), ~held))
    return s.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
