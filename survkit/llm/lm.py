"""Language-model scoring with a weighted backoff automaton over word bigrams.

The model interpolates bigram and unigram estimates, P(v|u) = (1 - w) c(uv)/c(u) + w P(v). As an automaton:
the root has an arc for every word with weight log P(v); each word that was seen as a context is a state with
an arc for every bigram seen after it, weight log P(v|u), and a failure arc to the root, weight log w. Reading
v leads to v's state. A text is read once from left to right: the state takes its arc, or its failure arc and
then the root's, and the weights add up to the log-probability. The backoff weight w is chosen from a grid by
the likelihood of all training texts, each token left out of its own counts.

No table of the corpus is ever broadcast or collected. Documents are dealt into blocks; a block asks the count
shards for the distinct n-grams it holds (6-byte hashes with its own training counts), a shard adds up what all
blocks sent and answers each block in the order of its request, and the block builds the part of the automaton
that its texts can reach. A frequent n-gram is one entry per block, whatever its count.

Defined results: a null text is empty and scores its end token alone; repeated rows and null ids are scored
like any other row (a null id has no remainder: its row is not held out and is learnt from); extra columns are
not used; without any training text every token gets the same base probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import block_id, crc_mod, mix64, read, store

#: Add-constant of the base (unigram) model.
ADD = 0.1
#: Backoff weights to choose from.
WEIGHTS = (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99)
#: Bytes of text in a block, about.
BLOCK_BYTES = 4 << 20
END, START = b"\n", b"\r"
_LOW = np.uint64((1 << 48) - 1)


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between white space, then the end token, which no word can equal."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    w.append(END)
    return w


class Vocabulary(dict):
    """word -> number, in order of first use."""

    def __missing__(self, w: bytes) -> int:
        n = self[w] = len(self)
        return n


def _narrow(x: np.ndarray) -> tuple[str, bytes]:
    """Numbers in the narrowest type that holds them."""
    kind = np.min_scalar_type(int(x.max(initial=0)))
    return kind.str, x.astype(kind).tobytes()


class Block:
    """Token sequence of a block's texts and its distinct n-grams.

    cur: token at each position; prev: the one before (START at a text's first); doc: the text's number.
    For n-grams of order 1 and 2: ``keys`` sorted distinct hashes, ``where`` the key of each word / position.
    """

    def __init__(self, texts: list[str | None]):
        words = Vocabulary()
        start = words[START]
        get = words.__getitem__
        each = [np.fromiter(map(get, w), np.int64, len(w)) for w in map(tokens, texts)]
        self.n = np.array([len(x) for x in each])
        self.cur = np.concatenate(each)
        self.prev = np.concatenate(([start], self.cur[:-1]))
        first = np.concatenate(([0], np.cumsum(self.n)[:-1]))
        self.prev[first] = start
        self.first, self.doc = first, np.repeat(np.arange(len(each)), self.n)
        with np.errstate(over="ignore"):
            h = mix64(np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words)))
            code, pair = np.unique(self.prev * len(words) + self.cur, return_inverse=True)
            h2 = mix64(h[code // len(words)] * np.uint64(0x9E3779B97F4A7C15) + h[code % len(words)] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(2))
        self.keys, self.where = {}, {}
        k, inv = np.unique(h, return_inverse=True)
        self.keys[1], self.where[1] = k, inv
        k, inv = np.unique(h2, return_inverse=True)
        self.keys[2], self.where[2] = k, inv[pair]

    def counts(self, train: np.ndarray) -> dict[int, np.ndarray]:
        """Training counts of the distinct n-grams."""
        on = train[self.doc]
        return {1: np.bincount(self.where[1][self.cur[on]], minlength=len(self.keys[1])), 2: np.bincount(self.where[2][on], minlength=len(self.keys[2]))}


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


ASKED = "shard int, block int, ord int, keys binary, kind string, counts binary"
ANSWER = "block int, ord int, shard int, kind string, totals binary"


def _ask(shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b = Block(pdf["text"].tolist())
        rows = []
        for order, c in b.counts(pdf["train"].to_numpy(bool)).items():
            s = _shard(b.keys[order], shards)
            cuts = np.flatnonzero(np.diff(s)) + 1
            for k, x, no in zip(np.split(b.keys[order], cuts), np.split(c, cuts), s[np.concatenate(([0], cuts))]):
                low = np.ascontiguousarray(k & _LOW).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
                rows.append((int(no), int(pdf["block"].iloc[0]), order, low, *_narrow(x)))
        return pd.DataFrame(rows, columns=["shard", "block", "ord", "keys", "kind", "counts"])

    return run


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for order, part in pdf.groupby("ord"):
        n = np.array([len(k) // 6 for k in part["keys"]])
        keys = np.zeros((n.sum(), 8), np.uint8)
        keys[:, :6] = np.frombuffer(b"".join(part["keys"]), np.uint8).reshape(-1, 6)
        c = np.concatenate([np.frombuffer(x, k) for k, x in zip(part["kind"], part["counts"])]).astype(np.int64)
        uniq, inv = np.unique(keys.view(np.uint64).ravel(), return_inverse=True)
        total = np.zeros(len(uniq), np.int64)
        np.add.at(total, inv, c)
        for block, x in zip(part["block"], np.split(total[inv], np.cumsum(n)[:-1])):
            out.append((block, order, int(part["shard"].iloc[0]), *_narrow(x)))
    return pd.DataFrame(out, columns=["block", "ord", "shard", "kind", "totals"])


class Automaton:
    """The part of the backoff automaton that one block can reach, for each backoff weight of the grid."""

    def __init__(self, block: Block, totals: dict[int, np.ndarray], stats: tuple[int, int, int]):
        self.block, self.stats = block, stats
        self.word = totals[1][block.where[1]]  # count of each word of the block
        self.pair = totals[2]

    def read(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One pass over all texts: per text n_known, base score, score for each weight.

        own: per text 1 to take each token out of its own counts, 0 to use the counts as they are.
        """
        b, (n, v, texts) = self.block, self.stats
        out = own[b.doc]
        cv, cuv = self.word[b.cur], self.pair[b.where[2]]
        cu = np.where(np.isin(np.arange(len(b.cur)), b.first), texts, self.word[b.prev])
        root = (np.maximum(cv - out, 0) + ADD) / (np.maximum(n - out, 0) + ADD * (v + 1))
        state = np.maximum(cu - out, 0)
        arc = np.divide(np.maximum(cuv - out, 0), state, out=np.zeros(len(state)), where=state > 0)
        total = lambda x: np.add.reduceat(x, b.first)
        scores = []
        for w in WEIGHTS:
            # an unseen context has no state: it is the root itself, at no cost
            scores.append(total(np.log10(np.where(state > 0, (1 - w) * arc + w * root, root))))
        return total((cv > 0).astype(np.int64)), total(np.log10(root)), np.stack(scores, axis=1)


def _stats(docs: DataFrame, shards: int) -> tuple[int, int, int]:
    """Training tokens, distinct training tokens, training texts; words are counted in shards of hashes."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = Vocabulary()
            n = 0
            for t in b.column("text").to_pylist():
                w = tokens(t)
                n += len(w)
                for x in w:
                    seen[x]
            h = np.unique(mix64(np.fromiter((xxhash.xxh3_64_intdigest(w) for w in seen), np.uint64, len(seen))))
            s = _shard(h, shards)
            cuts = np.flatnonzero(np.diff(s)) + 1
            no = s[np.concatenate(([0], cuts))].astype(np.int32) if len(h) else np.empty(0, np.int32)
            part = [k.tobytes() for k in np.split(h, cuts)] if len(h) else []
            yield pa.record_batch(
                [pa.array([*no, -1], pa.int32()), pa.array([*part, b""], pa.binary()), pa.array([0] * len(no) + [n], pa.int64()), pa.array([0] * len(no) + [b.num_rows], pa.int64())],
                ["shard", "keys", "n", "texts"],
            )

    def distinct(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"v": [len(np.unique(np.frombuffer(b"".join(pdf["keys"]), np.uint64)))]})

    t = store(docs.where("train").select("text").mapInArrow(ask, "shard int, keys binary, n long, texts long"), "lm-words")
    n, texts = t.where("shard = -1").agg(F.sum("n"), F.sum("texts")).first()
    v = t.where("shard >= 0").select("shard", "keys").groupBy("shard").applyInPandas(distinct, "v long").agg(F.sum("v")).first()[0]
    return n or 0, v or 0, texts or 0


def score(docs: DataFrame, held_out, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out``: boolean column; rows where it is true are not learnt from.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    size = d.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    shards = max(1, -(-blocks // 2))
    d = d.withColumn("train", ~F.col("held_out")).withColumn("block", block_id(blocks, "doc_id", "text").cast("int"))
    stats = _stats(d, shards)
    # one exchange of the texts: both uses below read the same shuffle
    d = d.repartition(blocks, "block")
    answers = d.groupBy("block").applyInPandas(_ask(shards), ASKED).groupBy("shard").applyInPandas(_answer, ANSWER)

    def read_block(pdf: pd.DataFrame, ans: pd.DataFrame) -> pd.DataFrame:
        cols = ["held_out", "n_tokens", "n_known", "base_score", "scores", "loo"]
        if not len(pdf):
            return pd.DataFrame(columns=["doc_id", *cols])
        b = Block(pdf["text"].tolist())
        ans = ans.sort_values(["ord", "shard"])
        totals = {o: np.concatenate([np.frombuffer(x, k) for k, x in zip(p["kind"], p["totals"])]).astype(np.int64) for o, p in ans.groupby("ord")}
        a = Automaton(b, totals, stats)
        train = pdf["train"].to_numpy(bool)
        known, base, scores = a.read(np.zeros(len(pdf), np.int64))
        _, _, loo = a.read(train.astype(np.int64))
        # the leave-one-out likelihood of the block's training texts, on its first row
        sums = [None] * len(pdf)
        sums[0] = loo[train].sum(axis=0)
        return pd.DataFrame({"doc_id": pdf["doc_id"].tolist(), "held_out": ~train, "n_tokens": b.n, "n_known": known, "base_score": base, "scores": list(scores), "loo": sums})

    schema = "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, scores array<double>, loo array<double>"
    d = d.withColumn("doc_id", F.col("doc_id").cast("string"))
    got = store(d.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(read_block, schema), "lm-scores")
    fit = got.where("loo IS NOT NULL").agg(*[F.sum(F.col("loo")[i]).alias(str(i)) for i in range(len(WEIGHTS))]).first()
    pick = int(np.argmax([x if x is not None else -np.inf for x in fit]))
    return got.select(
        F.col("doc_id").cast("long").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(stats[0]).cast("long").alias("train_tokens"),
        "base_score", F.col("scores")[pick].alias("score"), F.lit(WEIGHTS[pick]).alias("backoff_weight"),
    )


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 10) == 0)
