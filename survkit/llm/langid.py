"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent letter n-grams (1 to 3 letters, words padded by a blank),
counted over a bounded sample of labelled documents. A document's own most frequent n-grams are compared with
each profile by the out-of-place distance: the sum of the rank differences, an n-gram that the profile lacks
counting as the profile's length. The nearest profile wins, ties to the lesser name.

Defined results: a null text or one without letters is ``und`` with score 0, as is every text when nothing was
learnt; equal texts get equal predictions; a null id is not held out; extra columns are not used. N-grams of
equal counts are ranked by a hash of the n-gram, the same in profiles and documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, read, with_fields

#: Documents of a language that its profile is learnt from, about, and the n-grams of a profile.
SAMPLE_ROWS, PROFILE, LONGEST = 1_500, 400, 3
UNKNOWN = "und"
#: N-grams and words a Python worker remembers.
CACHE_GRAMS, CACHE_WORDS = 200_000, 200_000
LETTERS = re.compile(r"[^\W\d_]+")


def grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(w) - n + 1) if w[i : i + n] != " "]


def _place(gram: str) -> int:
    return xxhash.xxh3_64_intdigest(gram.encode("utf-8", "surrogatepass")) >> 2


def profiles(docs: DataFrame, learn, rows: int = SAMPLE_ROWS, size: int = PROFILE) -> dict[str, dict[str, int]]:
    """language -> n-gram -> rank (from 0), learnt from documents that ``learn`` (boolean column) allows."""
    d = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "doc_id", "text")
    # rows whose hash (id and text: null or repeated ids are dealt by their texts) falls in the share that gives about ``rows`` of each language: no language is gathered in a task
    n = d.groupBy(F.col("lang").alias("_l")).agg(F.count("*").alias("_n"))
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) * F.col("_n") < rows << 20
    # equal rows count once, so that one text or id repeated very often can't fill the sample
    sample = d.join(F.broadcast(n), F.col("lang") == F.col("_l")).where(share).withColumn("_h", F.xxhash64("text")).dropDuplicates(["lang", "doc_id", "_h"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for b in batches:
            for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                words.setdefault(lang, Counter()).update(LETTERS.findall(t.lower()))
        for lang, ws in words.items():
            c: Counter = Counter()
            for w, n in ws.items():
                for g in grams(w):
                    c[g] += n
            yield pa.record_batch([pa.array([lang] * len(c)), pa.array(list(c)), pa.array(list(c.values()), pa.int64()), pa.array([_place(g) for g in c], pa.int64())], ["lang", "gram", "n", "place"])

    c = sample.select("lang", "text").mapInArrow(count, "lang string, gram string, n long, place long").groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.first("place").alias("place"))
    top = c.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "place"))).where(F.col("r") <= size)
    out: dict[str, dict[str, int]] = {}
    for r in top.collect():
        out.setdefault(r["lang"], {})[r["gram"]] = r["r"] - 1
    return dict(sorted(out.items()))


class Profiler:
    """Ranks a text's n-grams and measures its distance to every profile."""

    def __init__(self, known: dict[str, dict[str, int]], size: int = PROFILE):
        self.langs, self.known, self.size = list(known), list(known.values()), size
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.words: dict[str, np.ndarray] = {}
        self.place = np.zeros(1024, np.int64)
        self.rank = np.zeros((1024, len(self.langs)), np.int64)

    def _id(self, gram: str) -> int:
        i = self.ids.get(gram)
        if i is None:
            i = self.ids[gram] = len(self.ids)
            if i >= len(self.place):
                self.place = np.concatenate([self.place, np.zeros_like(self.place)])
                self.rank = np.concatenate([self.rank, np.zeros_like(self.rank)])
            self.place[i] = _place(gram)
            self.rank[i] = [p.get(gram, -1) for p in self.known]
        return i

    def _word(self, w: str) -> np.ndarray:
        got = self.words.get(w)
        if got is None:
            got = self.words[w] = np.array([self._id(g) for g in grams(w)], np.int64)
        return got

    def nearest(self, text: str | None) -> tuple[str, float]:
        words = Counter(LETTERS.findall(text.lower())) if text else None
        if not words or not self.langs:
            return UNKNOWN, 0.0
        if len(self.ids) > CACHE_GRAMS or len(self.words) > CACHE_WORDS:
            self.clear()
        lists = [self._word(w) for w in words]
        counts = np.bincount(np.concatenate(lists), np.repeat(list(words.values()), [len(x) for x in lists]))
        own = np.flatnonzero(counts)
        n = counts[own]
        if len(own) > self.size:
            keep = n >= np.partition(n, len(n) - self.size)[len(n) - self.size]
            own, n = own[keep], n[keep]
        own = own[np.lexsort((self.place[own], -n))[: self.size]]
        theirs = self.rank[own]
        far = np.where(theirs >= 0, np.abs(theirs - np.arange(len(own))[:, None]), self.size).sum(axis=0)
        best = int(np.argmin(far))
        return self.langs[best], float(1 - far[best] / (self.size * len(own)))


def identify(docs: DataFrame, known: dict[str, dict[str, int]]) -> DataFrame:
    """``docs`` with columns lang_pred and score of the column ``text``."""
    docs = docs.drop("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Profiler(known)
        for b in batches:
            got = [p.nearest(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, with_fields(docs, lang_pred="string", score="double"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    known = profiles(docs, ~held)
    s = identify(docs.select("doc_id", "text"), known)
    return s.select("doc_id", held.alias("held_out"), "lang_pred", "score")
