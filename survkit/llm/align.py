"""Cross-tokenizer alignment by diagonal run skipping, and corpus-wide counts of the token pairs it links.

Two tokenizers cut the same bytes. Offsets where tokens of both end cut them into groups; inside a group tokens
overlap without a common end. Where both cut alike, the two arrays of end offsets are equal at a constant index
shift: exponential probing compares ever longer slices at that shift and jumps over the whole one-to-one stretch.
At the first difference the two arrays are merged step by step up to the next common end, which closes an
irregular group and gives the new shift. Cost follows the irregular groups, not the tokens.

Documents are aligned in blocks of a few megabytes, each block once; its links are kept in the shared folder as
numbers of the block's distinct id pairs. For the corpus-wide counts a block sends each distinct pair once, with
its count, to the bin of the pair's hash; the bin adds up what all blocks sent and answers in the order asked.
A frequent pair is one entry a block, whatever its count; bins grow in number with the entries. The highest count
of each id of the second tokenizer is one number per vocabulary entry, the only thing that is sent to all tasks.

Defined results: texts that are null or empty, or that either tokenizer doesn't give back byte for byte, have no
tokens and no groups: zeros and an empty digest; repeated rows count as often as they occur; null ids are kept;
equal highest counts are all highest; special tokens' strings in a text are plain text; an empty table gives no
rows; extra columns are not used, whatever their names. A text of any length is aligned as a whole.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import read, store

#: Characters of text in a block, and of those that are aligned at once, about.
BLOCK_CHARS, AT_ONCE_CHARS = 4_000_000, 500_000
#: Distinct pairs of blocks that a bin adds up, about; at least LEAST_BINS bins.
BIN_PAIRS = 1_000_000
LEAST_BINS = 64


def byte_bpe_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ByteBPE:
    """A byte-level BPE vocabulary file; texts get a space in front."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        # fixed values: byte-level entries write a byte as a character of its own, printable ones as themselves
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
        special = {x["id"] for x in model["added_tokens"]}
        vocab = {bytes(map(byte.__getitem__, t)): i for t, i in model["model"]["vocab"].items() if i not in special}
        self.bytes = [b""] * (max(model["model"]["vocab"].values()) + 1)
        for t, i in vocab.items():
            self.bytes[i] = t
        # ids must follow the order of the merges: then the merge of least id is the merge of first rank
        merges = [x if isinstance(x, list) else x.split(" ") for x in model["model"]["merges"]]
        order = [model["model"]["vocab"][a + b] for a, b in merges]
        if order != sorted(order):
            raise ValueError("the vocabulary's ids don't follow its merges")
        self.encoder = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encoder.encode_ordinary(" " + t) for t in texts]


class Pieces:
    """A sentence-piece model, which puts the space in front itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        entry = lambda i: bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()
        self.bytes = [entry(i) for i in range(m.get_piece_size())]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []


_LOADED: dict[tuple[type, str], ByteBPE | Pieces] = {}


def loaded(kind: type, path: str):
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


def irregular_groups(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Rows (i, x, j, y): tokens i..x of A and j..y of B form a group that isn't one-to-one; both arrays end alike.

    All other tokens pair off in order.
    """
    raw_a, raw_b = ends_a.astype("<u8").tobytes(), ends_b.astype("<u8").tobytes()
    a, b, n = ends_a.tolist(), ends_b.tolist(), len(ends_a)
    out: list[int] = []
    i = shift = 0
    while i < n:
        step, at = 1, 8 * shift
        while i < n and raw_a[8 * i : 8 * (i + step)] == raw_b[8 * i + at : 8 * (i + step) + at]:
            i += step
            step *= 2
        if i >= n:
            break
        while step > 1:
            step //= 2
            if raw_a[8 * i : 8 * (i + step)] == raw_b[8 * i + at : 8 * (i + step) + at]:
                i += step
        x, y = i, i + shift
        while a[x] != b[y]:
            if a[x] < b[y]:
                x += 1
            else:
                y += 1
        out += (i, x, i + shift, y)
        i, shift = x + 1, y - x
    return np.array(out, np.int64).reshape(-1, 4)


def _last(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n tokens close a group, if start..end are the irregular ones."""
    d = np.zeros(n + 1, np.int64)
    d[start] += 1
    d[end] -= 1
    return np.cumsum(d[:-1]) == 0


class Decimals:
    """Ids as decimal digits, each with a place for the sign that follows."""

    def __init__(self, n: int):
        text = np.char.mod("%d", np.arange(n)).astype(f"S{len(str(n)) + 1}")
        self.len = np.char.str_len(text).astype(np.int64)
        self.table = text.view(np.uint8).reshape(n, -1)

    def join(self, ids: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each followed by its sign, as bytes; where each one ends."""
        cells, size = self.table[ids], self.len[ids]
        cells[np.arange(len(ids)), size] = signs
        return cells[np.arange(cells.shape[1]) <= size[:, None]], np.cumsum(size + 1)


class Aligned:
    """The aligned tokens of a list of texts, one after the other.

    a, b: ids; last_a, last_b: whether a token closes its group; to_a, to_b: where each text's tokens end;
    link_a, link_b: token positions of each overlapping pair in byte order; to_link: where each text's links end.
    """

    def __init__(self, texts: list[str | None], first: ByteBPE, second: Pieces):
        use = [k for k, t in enumerate(texts) if t]
        plain = [texts[k] for k in use]
        a, b = [[] for _ in texts], [[] for _ in texts]
        for k, t, x, y in zip(use, plain, first.encode(plain), second.encode(plain)):
            want = (" " + t).encode("utf-8", "surrogatepass")
            if b"".join(map(first.bytes.__getitem__, x)) == want == b"".join(map(second.bytes.__getitem__, y)):
                a[k], b[k] = x, y
        self.to_a, self.to_b = np.cumsum([len(x) for x in a]), np.cumsum([len(x) for x in b])
        self.a = np.fromiter(chain.from_iterable(a), np.int64, int(self.to_a[-1]))
        self.b = np.fromiter(chain.from_iterable(b), np.int64, int(self.to_b[-1]))
        size_a, size_b = (np.array([len(x) for x in t.bytes]) for t in (first, second))
        ends_a, ends_b = np.cumsum(size_a[self.a]), np.cumsum(size_b[self.b])
        g = irregular_groups(ends_a, ends_b)
        self.last_a, self.last_b = _last(len(self.a), g[:, 0], g[:, 1]), _last(len(self.b), g[:, 2], g[:, 3])
        # each end of either side closes one overlap
        ends = np.sort(np.concatenate((ends_a, ends_b[~self.last_b])), kind="stable")
        self.link_a, self.link_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        self.to_group = np.concatenate(([0], np.cumsum(self.last_a)))[self.to_a]
        self.to_link = self.to_a + self.to_b - self.to_group

    def digests(self, digits: Decimals) -> list[str]:
        """Per text the SHA-256 of its groups written as ``a1,a2|b1;a3|b2``; empty without tokens."""
        in_a, in_b = np.cumsum(self.last_a) - self.last_a, np.cumsum(self.last_b) - self.last_b
        before_b = np.concatenate(([0], np.flatnonzero(self.last_b) + 1))
        after_a = np.flatnonzero(self.last_a) + 1
        at_a = np.arange(len(self.a)) + before_b[in_a]
        at_b = np.arange(len(self.b)) + after_a[in_b]
        ids, signs = np.empty(len(self.a) + len(self.b), np.int64), np.empty(len(self.a) + len(self.b), np.uint8)
        ids[at_a], ids[at_b] = self.a, self.b
        signs[at_a], signs[at_b] = np.where(self.last_a, ord("|"), ord(",")), np.where(self.last_b, ord(";"), ord(","))
        flat, ends = digits.join(ids, signs)
        ends = np.concatenate(([0], ends))[np.concatenate(([0], self.to_a + self.to_b))].tolist()
        raw = flat.tobytes()
        return [hashlib.sha256(raw[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(ends, ends[1:])]


def _narrow(x: np.ndarray) -> tuple[str, bytes]:
    kind = np.min_scalar_type(int(x.max(initial=0)))
    return kind.str, x.astype(kind).tobytes()


def _split(texts: list[str | None], most: int) -> Iterator[slice]:
    """Slices of consecutive texts of about so many characters."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= most or k + 1 == len(texts):
            yield slice(start, k + 1)
            start, size = k + 1, 0


def groups(docs: DataFrame, a_file: str | None = None, b_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, ``a_ids``, ``b_ids`` and, for each group, how many tokens of either side end with it: ``a_to``, ``b_to``."""
    a_file, b_file = a_file or byte_bpe_file(), b_file or piece_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = loaded(ByteBPE, a_file), loaded(Pieces, b_file)
        for batch in batches:
            for part in _split(texts := batch.column(1).to_pylist(), BLOCK_CHARS):
                x = Aligned(texts[part], first, second)
                rows = []
                for s, e, p, q in zip([0, *x.to_a], x.to_a, [0, *x.to_b], x.to_b):
                    rows.append((x.a[s:e], x.b[p:q], np.flatnonzero(x.last_a[s:e]) + 1, np.flatnonzero(x.last_b[p:q]) + 1))
                cols = [pa.array([r[k].tolist() for r in rows], pa.list_(pa.int32())) for k in range(4)]
                yield pa.record_batch([batch.column(0)[part], *cols], ["id", "a_ids", "b_ids", "a_to", "b_to"])

    key = docs.schema[id_col].dataType.simpleString()
    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {key}, a_ids array<int>, b_ids array<int>, a_to array<int>, b_to array<int>")
    return got.withColumnRenamed("id", id_col)


BLOCKS = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, digest array<string>, n_pairs long, pairs binary, kind string, counts binary, link_kind string, links binary"


def _blocks(docs: DataFrame, a_file: str, b_file: str, most: int) -> DataFrame:
    """Aligned blocks: per document its numbers and digest, the block's distinct id pairs with counts, each link's pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = loaded(ByteBPE, a_file), loaded(Pieces, b_file)
        digits, wide = Decimals(max(len(first.bytes), len(second.bytes))), len(second.bytes)
        kinds = [pa.int64(), *[pa.list_(pa.int64())] * 4, pa.list_(pa.string()), pa.int64(), pa.binary(), pa.string(), pa.binary(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in BLOCKS.split(", ")]
        no = TaskContext.get().partitionId() << 32
        for batch in batches:
            own, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in _split(texts, most):
                numbers, digest, codes = [[], [], []], [], []
                # the lists of tokens and their offsets exist for a part of the block at a time
                for some in _split(texts[part], AT_ONCE_CHARS):
                    x = Aligned(texts[part][some], first, second)
                    for n, y in zip(numbers, (x.to_a, x.to_b, x.to_group)):
                        n += np.diff(y, prepend=0).tolist()
                    digest += x.digests(digits)
                    codes.append(x.a[x.link_a] * wide + x.b[x.link_b])
                    del x
                pairs, link, count = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
                # frequent pairs first: small numbers, which compress well
                order = np.argsort(-count, kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                row = [no, own[part], *numbers, digest, len(pairs), pairs[order].astype("<u8").tobytes(), *_narrow(count[order]), *_narrow(place[link])]
                yield pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds)], names)
                no += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BLOCKS)


def _bins(pairs: np.ndarray, bins: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(bins)


def _ask(bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                pairs, counts = np.frombuffer(r["pairs"], "<u8"), np.frombuffer(r["counts"], r["kind"])
                bin_ = _bins(pairs, bins)
                order = np.argsort(bin_, kind="stable")
                own, at = np.unique(bin_[order], return_index=True)
                to = [*at[1:], len(order)]
                rows = [(int(n), r["block"], pairs[order[s:e]].tobytes(), *_narrow(counts[order[s:e]])) for n, s, e in zip(own, at, to)]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.string(), pa.binary()))] if rows else [pa.array([], k) for k in (pa.int32(), pa.int64(), pa.binary(), pa.string(), pa.binary())], ["bin", "block", "pairs", "kind", "counts"])

    return run


ANSWER = "block long, bin int, kind string, totals binary, best_kind string, best binary"


def _answer(wide: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Corpus-wide counts in the order asked, a row for each block; the first also has each B id's highest here."""
        pairs = np.concatenate([np.frombuffer(x, "<u8") for x in pdf["pairs"]])
        counts = np.concatenate([np.frombuffer(x, k) for x, k in zip(pdf["counts"], pdf["kind"])]).astype(np.int64)
        uniq, inv = np.unique(pairs, return_inverse=True)
        total = np.zeros(len(uniq), np.int64)
        np.add.at(total, inv, counts)
        best = np.zeros(wide, np.int64)
        np.maximum.at(best, (uniq % np.uint64(wide)).astype(np.int64), total)
        cuts = np.cumsum([len(x) // 8 for x in pdf["pairs"]])[:-1]
        rows = [(blk, n, *_narrow(t), None, None) for blk, n, t in zip(pdf["block"], pdf["bin"], np.split(total[inv], cuts))]
        rows[0] = (*rows[0][:4], *_narrow(best))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in ANSWER.split(", ")])

    return run


LINKED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def linked(docs: DataFrame, a_file: str | None = None, b_file: str | None = None, block_chars: int = BLOCK_CHARS, bin_pairs: int = BIN_PAIRS) -> DataFrame:
    """Per document: token, group and link numbers, links whose pair is the most frequent of its B id, sum of pair counts, digest."""
    a_file, b_file = a_file or byte_bpe_file(), b_file or piece_file()
    t = store(_blocks(docs, a_file, b_file, block_chars), "align-blocks", large_rows=True)
    asked = t.agg(F.sum("n_pairs")).first()[0] or 0
    bins, wide = max(LEAST_BINS, -(-asked // bin_pairs)), len(loaded(Pieces, b_file).bytes)
    messages = t.where("n_pairs > 0").select("block", "pairs", "kind", "counts").mapInArrow(_ask(bins), "bin int, block long, pairs binary, kind string, counts binary")
    answers = store(messages.groupBy("bin").applyInPandas(_answer(wide), ANSWER), "align-answers")

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros(wide, np.int64)
        for batch in batches:
            for kind, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                top = np.maximum(top, np.frombuffer(x, kind))
        yield pa.record_batch([pa.array(np.arange(wide)), pa.array(top)], ["b", "top"])

    # a number for each entry of the second vocabulary
    best = np.zeros(wide, np.int64)
    for r in answers.where("best IS NOT NULL").select("best_kind", "best").mapInArrow(highest, "b long, top long").where("top > 0").groupBy("b").agg(F.max("top").alias("top")).collect():
        best[r["b"]] = r["top"]
    best_of = docs.sparkSession.sparkContext.broadcast(best)

    def read_block(pdf: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        names = [x.split()[0] for x in LINKED.split(", ")]
        if not len(pdf):
            return pd.DataFrame(columns=names)
        r = pdf.iloc[0]
        pairs = np.frombuffer(r["pairs"], "<u8")
        order = np.argsort(_bins(pairs, bins), kind="stable")
        total = np.zeros(len(pairs), np.int64)
        got = got.sort_values("bin")
        if len(pairs):
            total[order] = np.concatenate([np.frombuffer(x, k) for x, k in zip(got["totals"], got["kind"])])
        top = total == best_of.value[(pairs % np.uint64(wide)).astype(np.int64)]
        link = np.frombuffer(r["links"], r["link_kind"])
        n_a, n_b, n_groups = (np.array(r[k], np.int64) for k in ("n_a", "n_b", "n_groups"))
        n_links = n_a + n_b - n_groups
        ends = np.concatenate(([0], np.cumsum(n_links)))
        per = lambda x: np.diff(np.concatenate(([0], np.cumsum(x[link], dtype=np.int64)))[ends])
        # ids as Python integers or None: a float column would round large ones
        own = pd.array([None if pd.isna(v) else int(v) for v in r["doc_id"]], dtype="Int64")
        return pd.DataFrame({"doc_id": own, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "n_best": per(top), "count_sum": per(total), "groups_sha256": list(r["digest"])})[names]

    return t.groupBy("block").cogroup(answers.select("block", "bin", "kind", "totals").groupBy("block")).applyInPandas(read_block, LINKED)


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(read(spark, sf_dir, "documents"))
