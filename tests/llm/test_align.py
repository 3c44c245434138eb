"""Cross-tokenizer alignment against brute force by offsets, the tokenizer libraries alone, and edge rows."""

import hashlib
import os
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from survkit.llm import align, common

DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("block", T.StringType()), ("n_a", T.StringType()), ("id", T.StringType()))])


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def tokenizers():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(align.byte_bpe_file())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=align.piece_file())


def brute(docs, tokenizers):
    """The contract read plainly: library calls, byte offsets, sets and dictionaries."""
    a_lib, b_lib = tokenizers
    a_bytes, b_bytes = align.loaded(align.ByteBPE, align.byte_bpe_file()).bytes, align.loaded(align.Pieces, align.piece_file()).bytes
    per, count = [], Counter()
    for _, t in docs:
        a = a_lib.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_lib.encode(t) if t else []
        if t and not b"".join(a_bytes[i] for i in a) == (" " + t).encode() == b"".join(b_bytes[i] for i in b):
            a = b = []
        spans = []
        for ids, table in ((a, a_bytes), (b, b_bytes)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(table[i]), i))
                at += len(table[i])
            spans.append(out)
        links, k = [], 0
        for s, e, i in spans[0]:
            while k and spans[1][k - 1][1] > s:
                k -= 1
            while k < len(spans[1]) and spans[1][k][0] < e:
                if spans[1][k][1] > s:
                    links.append((i, spans[1][k][2]))
                k += 1
        shared = {x[1] for x in spans[0]} & {x[1] for x in spans[1]}
        parts, x, y = [], [], []
        rest = list(spans[1])[::-1]
        for s, e, i in spans[0]:
            x.append(i)
            if e in shared:
                while rest and rest[-1][1] <= e:
                    y.append(rest.pop()[2])
                parts.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
                x, y = [], []
        count.update(links)
        per.append((len(a), len(b), len(parts), links, hashlib.sha256(";".join(parts).encode()).hexdigest() if a else ""))
    best = defaultdict(int)
    for (i, j), n in count.items():
        best[j] = max(best[j], n)
    return [(d, n_a, n_b, g, len(l), sum(count[p] == best[p[1]] for p in l), sum(count[p] for p in l), h) for (d, _), (n_a, n_b, g, l, h) in zip(docs, per)]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@given(st.lists(st.tuples(st.booleans(), st.booleans()), max_size=200))
@settings(max_examples=200, deadline=None)
def test_irregular_groups_equal_shared_offsets(cuts):
    cuts = [*cuts, (True, True)]
    a, b = (np.array([k + 1 for k, c in enumerate(cuts) if c[s]]) for s in (0, 1))
    g = align.irregular_groups(a, b)
    last_a, last_b = align._last(len(a), g[:, 0], g[:, 1]), align._last(len(b), g[:, 2], g[:, 3])
    shared = sorted(set(a.tolist()) & set(b.tolist()))
    assert a[last_a].tolist() == shared == b[last_b].tolist()
    assert all(x > i or y > j for i, x, j, y in g.tolist())


def test_long_stretches_take_few_comparisons():
    ends = np.arange(1, 200_001)
    assert len(align.irregular_groups(ends, ends)) == 0
    other = np.delete(ends, [5, 100_000])
    assert align.irregular_groups(ends, other).tolist() == [[5, 6, 5, 5], [100_000, 100_001, 99_999, 99_999]]


EDGE = [
    (1, None), (2, ""), (3, "one two  three"), (3, "one two  three"), (None, "naïve 中文 \U0001f600"), (5, " "), (6, "w7x9 " * 20_000 + "é" * 5_000),
    (7, "a▁b"), (8, "x <|endoftext|> <s> <0x41> </s> <unk>"), (9, "\0 tab\there\r\n\x85 ​"), (1 << 60, "x"), (10, "é ﬁ ①"),
]


def test_edges(spark, tokenizers):
    want = sorted(brute(EDGE, tokenizers), key=repr)
    got = align.linked(frame(spark, EDGE), block_chars=50, bin_pairs=10)
    assert rows(got) == want and got.columns == [x.split()[0] for x in align.LINKED.split(", ")]
    by = {r[0]: r for r in want}
    assert by[1][1:] == by[2][1:] == by[7][1:] == (0, 0, 0, 0, 0, 0, "") and by[8][1] > 8 and by[9][1] > 5
    assert align.linked(frame(spark, [])).collect() == []
    assert [tuple(r)[1:7] for r in align.linked(frame(spark, [(1, None), (None, "")])).collect()] == [(0,) * 6] * 2


@pytest.mark.parametrize("table", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_brute_force(spark, tokenizers, table):
    docs = [(r["doc_id"], r["text"]) for r in common.read(spark, table, "documents").collect()]
    assert rows(align.op13_align(spark, table)) == sorted(brute(docs, tokenizers), key=repr)


def test_groups_are_whole(spark):
    first, second = align.loaded(align.ByteBPE, align.byte_bpe_file()), align.loaded(align.Pieces, align.piece_file())
    for r in align.groups(frame(spark, EDGE)).collect():
        assert len(r["a_to"]) == len(r["b_to"]) and r["a_to"][-1:] == [len(r["a_ids"])][: len(r["a_to"])]
        p = q = 0
        for x, y in zip(r["a_to"], r["b_to"]):
            assert b"".join(first.bytes[i] for i in r["a_ids"][p:x]) == b"".join(second.bytes[i] for i in r["b_ids"][q:y])
            p, q = x, y


def test_a_row_group_holds_few_blocks(spark, monkeypatch):
    import pyarrow.parquet as pq

    rng = np.random.default_rng(0)
    words = np.array([f"w{k:x}" for k in range(1 << 16)])
    docs = frame(spark, [(k, " ".join(words[rng.integers(0, len(words), 100_000)])) for k in range(12)]).coalesce(1)
    seen, store = [], align.store

    def kept(df, name, **kw):
        seen.append((name, store(df, name, **kw)))
        return seen[-1][1]

    monkeypatch.setattr(align, "store", kept)
    monkeypatch.setitem(common.LARGE_ROWS, "parquet.block.size", str(2 << 20))
    monkeypatch.setattr(align, "AT_ONCE_CHARS", 100_000)
    got = rows(align.linked(docs, block_chars=500_000))
    blocks = dict(seen)["align-blocks"]
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in blocks.inputFiles()]
    groups = [f.row_group(k) for f in files for k in range(f.num_row_groups)]
    # a reader holds a row group's rows: their bytes are bounded, not their number times a block
    assert sum(g.num_rows for g in groups) == 12 and max(g.total_byte_size for g in groups) <= 4 << 20 < sum(g.total_byte_size for g in groups)
    monkeypatch.setattr(align, "AT_ONCE_CHARS", 1 << 30)
    assert got == rows(align.linked(docs, block_chars=500_000))
