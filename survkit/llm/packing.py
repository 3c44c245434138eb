"""Lexical retrieval packing: documents are packed into token windows next to lexically similar ones.

Documents are tokenised once into a table in the shared folder; document frequencies and the mean length come
from all of it. Shards of a bounded number of tokens each hold a BM25 inverted index over their documents.
Within a shard a seed document opens a window, its highest-weighted terms query the index, and its best unused
neighbours fill the window greedily; the last one is cut to fit and its rest becomes the next seed. Windows are
therefore full but for the shard's last tokens, which go into windows whose lengths are powers of two.

Defined results: a null text is empty and gives a document of the end id alone; repeated rows and rows with a
null id are documents of their own; long documents fill windows of their own before their rest is packed;
equal BM25 scores go by the row order in the shard; extra columns are not used.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, store

WINDOW = 4096
END_ID = 2
#: Tokens of a shard, about; a shard is one task's index.
SHARD_TOKENS = 2_000_000
QUERY_TERMS = 12
K1, B = 1.2, 0.75
#: Words whose ids a Python worker remembers; new words that one call of the tokenizer gets; characters split at a time.
CACHE_WORDS, CALL_WORDS, SPLIT_CHARS = 250_000, 500, 1_000_000

#: How the vocabulary file splits normalised text, for characters up to U+00FF.
LETTER, NUMBER, SPACE = r"a-zªµºß-öø-ÿ", r"0-9²³¹¼½¾", r"\t-\r \x85\xa0"
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")


def vocabulary_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """word -> its ids as little-endian 16-bit bytes."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        if size > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the last id of a word is one with the word-end mark
        mark = json.loads(self.tokenizer.to_str())["model"]["end_of_word_suffix"]
        self.ends = np.array([bool(mark) and (self.tokenizer.id_to_token(i) or "").endswith(mark) for i in range(size)])

    def learn(self, words: list[str]) -> None:
        """Ids of new words, many in a call: as words of one text, which the word-end marks part again."""
        calls = [words[k : k + CALL_WORDS] for k in range(0, len(words), CALL_WORDS)]
        for own, got in zip(calls, self.tokenizer.encode_batch_fast([" ".join(x) for x in calls], add_special_tokens=False)):
            ids = np.array(got.ids, "<u2")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(own) and cuts[-1] == len(ids):
                raw = ids.tobytes()
                self.update(zip(own, (raw[2 * a : 2 * z] for a, z in zip([0, *cuts.tolist()], cuts.tolist()))))
            else:
                self.update((w, self.whole(w)) for w in own)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def by_words(self, text: str) -> bool:
        """Whether the split above is the vocabulary's own for this text: no special token's string, nothing above U+00FF."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return not any(x in text for x in self.special)

    def texts(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as the library gives them without added special tokens."""
        out: list[bytes] = []
        for part in _parts(texts):
            split = [SPLIT.findall(t.lower()) if t and self.by_words(t) else None for t in part]
            words = set(chain.from_iterable(filter(None, split)))
            new = words.difference(self)
            if len(self) + len(new) > CACHE_WORDS:
                self.clear()
                new = words
            self.learn(list(new))
            out += [b"".join(map(self.__getitem__, x)) if x is not None else self.whole(t) if t else b"" for t, x in zip(part, split)]
        return out


def _parts(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Consecutive texts of about SPLIT_CHARS characters."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= SPLIT_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


_CACHES: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _CACHES:
        _CACHES[path] = WordIds(path)
    return _CACHES[path]


def tokenise(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n, ids, df): a row per document; a row with null ids per task with the document frequencies of its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        df = np.zeros(1 << 16, np.int64)
        names = ["doc_id", "n", "ids", "df"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        for b in batches:
            end = np.array([END_ID], "<u2").tobytes()
            ids = [x + end for x in words.texts(b.column("text").to_pylist())]
            for x in ids:
                df[np.unique(np.frombuffer(x, "<u2"))] += 1
            n = [len(x) // 2 for x in ids]
            yield pa.record_batch([b.column("doc_id"), pa.array(n, kinds[1]), pa.array(ids, kinds[2]), pa.nulls(len(ids), kinds[3])], names)
        if df.any():
            yield pa.record_batch([pa.nulls(1, kinds[0]), pa.array([0], kinds[1]), pa.nulls(1, kinds[2]), pa.array([df], kinds[3])], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, ids binary, df array<long>")


class Index:
    """BM25 inverted index of one shard's documents."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        terms, tfs = zip(*(np.unique(d, return_counts=True) for d in docs))
        self.terms = terms
        length = np.array([len(d) for d in docs])
        owner = np.repeat(np.arange(len(docs)), [len(t) for t in terms])
        flat, tf = np.concatenate(terms), np.concatenate(tfs).astype(np.float32)
        weight = idf[flat] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[owner] / mean))
        cuts = np.cumsum([len(t) for t in terms])[:-1]
        self.best = [t[np.argsort(-w, kind="stable")[:QUERY_TERMS]] for t, w in zip(terms, np.split(weight, cuts))]
        order = np.argsort(flat, kind="stable")
        self.owner, self.weight = owner[order], weight[order]
        self.at = np.searchsorted(flat[order], np.arange((1 << 16) + 1))
        self.n = len(docs)

    def neighbours(self, doc: int, used: np.ndarray) -> np.ndarray:
        """Unused documents that share a query term with ``doc``, best first."""
        spans = [slice(self.at[t], self.at[t + 1]) for t in self.best[doc].tolist()]
        if not spans:
            return np.empty(0, np.int64)
        scores = np.bincount(np.concatenate([self.owner[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
        scores[used] = 0
        found = np.flatnonzero(scores)
        return found[np.argsort(-scores[found], kind="stable")]


def pack(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece of one shard."""
    index = Index(docs, idf, mean)
    start, used = [0] * len(docs), np.zeros(len(docs), bool)
    pieces: list[tuple[int, int, int, int, int]] = []
    seq, room, fresh, seed = 0, window, 0, -1

    def place(d: int) -> bool:
        """Put as much of d as fits; true if all of it is placed now."""
        nonlocal seq, room
        used[d] = True
        n = min(room, len(docs[d]) - start[d])
        pieces.append((d, start[d], n, seq, window - room))
        start[d] += n
        room -= n
        if not room:
            seq, room = seq + 1, window
        return start[d] == len(docs[d])

    while True:
        if seed < 0:
            while fresh < len(docs) and used[fresh]:
                fresh += 1
            if fresh == len(docs):
                break
            seed = fresh
        while not place(seed):
            pass
        at, mine, seed = seq, seed, -1
        if room == window:
            continue
        for d in index.neighbours(mine, used).tolist():
            done = place(d)
            if seq > at:
                seed = -1 if done else d
                break
    # what is left of the last window: lengths that are powers of two, the largest first
    tail = [p for p in pieces if p[3] == seq]
    pieces = [p for p in pieces if p[3] != seq]
    left = sum(p[2] for p in tail)
    sizes = [1 << k for k in range(left.bit_length() - 1, -1, -1) if left >> k & 1]
    off = 0
    for d, s, n, _, _ in tail:
        while n:
            k = min(n, sizes[0] - off)
            pieces.append((d, s, k, seq, off))
            s, n, off = s + k, n - k, off + k
            if off == sizes[0]:
                sizes.pop(0)
                seq, off = seq + 1, 0
    return pieces


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, path: str | None = None, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    t = store(tokenise(docs, path or vocabulary_file()), "packing-tokens")
    own = t.where("ids IS NOT NULL")
    n, tokens = own.agg(F.count("*"), F.sum("n")).first()
    n, tokens = n or 0, tokens or 0
    shards = max(1, -(-tokens // shard_tokens))
    idf = np.full(1 << 16, np.log(1 + 2 * (n + 0.5)), np.float32)
    # one number per vocabulary entry: bounded by the vocabulary
    for r in t.where("df IS NOT NULL").select(F.posexplode("df").alias("term", "df")).where("df > 0").groupBy("term").agg(F.sum("df").alias("df")).collect():
        idf[r["term"]] = np.log(1 + (n - r["df"] + 0.5) / (r["df"] + 0.5))
    mean = tokens / max(n, 1)
    # the row's place in the stored table deals repeated rows apart; it is the same whenever a task is run again
    shard = F.pmod(F.xxhash64("doc_id", "n", F.monotonically_increasing_id()), F.lit(shards)).cast("long")

    def run(part: pa.Table) -> pa.Table:
        # rows in an order of their own, so that a repeated task packs alike
        part = part.sort_by([("doc_id", "ascending"), ("n", "ascending"), ("ids", "ascending")])
        ids = [np.frombuffer(x, "<u2") for x in part.column("ids").to_pylist()]
        own, no = part.column("doc_id").to_pylist(), part.column("shard")[0].as_py()
        rows = [
            (own[d], s, k, zlib.crc32(ids[d][s : s + k].astype("<u4").tobytes()), len(ids[d]), (no << 32) + q, o)
            for d, s, k, q, o in pack(ids, idf, mean, window)
        ]
        cols = list(zip(*rows))
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in PIECES.split(", ")])

    return own.select("doc_id", "n", "ids", shard.alias("shard")).groupBy("shard").applyInArrow(run, PIECES)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
