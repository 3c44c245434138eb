"""Phrase mining: SQL, brute force with shared slots and many blocks, edge rows, exact scores."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import types as T

from survkit.llm import common, phrases

DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("phrase", T.StringType()), ("n", T.StringType()), ("shard", T.StringType()))])


def frame(spark, rows):
    return spark.createDataFrame([(k, t, lang, "x", "y", "z") for k, (t, lang) in enumerate(rows)], DOCS)


def counts(rows, least):
    f, n = Counter(), Counter()
    for t, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    return {p: c for p, c in f.items() if c >= least}, n


def brute(rows, least=30, top=2000):
    f, n = counts(rows, least)
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2:
            continue
        cuts = [(2_000_000 * a // (f[lang, p[:c]] + f[lang, p[c:]]), c) for c in range(1, len(p))]
        score, c = min(cuts)
        longer = [b for (o, q), b in f.items() if o == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if all(100 * b < 80 * a for b in longer):
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:c]], f[lang, p[c:]]))
    return sorted((lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for k, (s, a, p, l, r) in enumerate(sorted(x)[:top]))


def mined(spark, rows, top=2000, **how):
    return sorted(tuple(r) for r in phrases.collocations(*phrases.frequent_phrases(frame(spark, rows), **how), top=top).collect())


def corpus(seed, n=700):
    """Random texts over few words, with long repeats, in three languages, one of them null."""
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(12)] + ["É", "ß", "中文", "a|b", "x\x85y", "Up"]
    rows = []
    for _ in range(n):
        w = rng.choice(words, rng.integers(0, 60), p=rng.dirichlet(np.ones(len(words)) * 0.3)).tolist()
        seps = rng.choice([" ", "  ", "\t", ". ", "\n", " ,"], len(w), p=[0.8, 0.05, 0.05, 0.04, 0.03, 0.03])
        rows.append(("".join(a + b for a, b in zip(w, seps)), ["en", "de", None][rng.integers(3)]))
    return rows + [("new york city hall is open " * 40, "en"), ("sich " * 90, "de")]


@pytest.mark.parametrize("seed,shards,block,bits", [(1, 4, 200, 16), (4, 3, 100, 6)])
def test_equals_brute_force(spark, seed, shards, block, bits):
    """Also with 64 slots, nearly all of them shared: nothing is lost or counted twice."""
    rows = corpus(seed)
    want = brute(rows, 30)
    assert len(want) > 40 and mined(spark, rows, shards=shards, block_bytes=block, slot_bits=bits) == want


def test_phrases_start_within_a_cycle(spark):
    """Pairs of frequent words are counted before all words are; each is complete after one full cycle."""
    rows = [("a b c d " * 50, "en")] * 8 + [("rare pair " * 20, "en")] * 2
    blocks = phrases._blocks(frame(spark, rows).repartition(8), 4, 1 << 20)
    blocks = common.store(blocks, "test-blocks")
    state, reached, _, log = phrases.count_phrases(blocks, 1680, 4)
    starts = {(r["k"], r["start"]) for r in state.where("k > 0").collect()}
    assert {(1, 0), (2, 1), (3, 2), (4, 3)} <= starts and max(s for k, s in starts if k == 2) >= 4 and len(log) <= 4 * 4 + 2


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    got = phrases.op12_phrases(spark, sf)
    want = con.execute(phrases.OP12_SQL)
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_edges(spark):
    assert mined(spark, []) == [] == mined(spark, [(None, None), ("", "en"), (" ., ", "en"), ("a b", "en")])
    long = "x y " * 150_000 + "." + "one two three " * 50
    rows = [(long, "en"), ("UND und\tund", None), ("und " * 40, "und")] + [("same text here", "fr")] * 31
    assert mined(spark, rows, block_bytes=50_000) == brute(rows)


def test_ties_go_by_bytes_and_the_list_is_cut(spark):
    rows = [(f"{w}1 {w}2.", "en") for w in ("b", "a", "é", "z", "中") for _ in range(30)]
    got = mined(spark, rows, top=3)
    assert [r[2] for r in got] == ["a1 a2", "b1 b2", "z1 z2"] and {r[7] for r in got} == {1_000_000}
    assert [r[2] for r in mined(spark, rows)][3:] == ["é1 é2", "中1 中2"]


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**15
    found = spark.createDataFrame([("en", "a", 1, big + 7), ("en", "b", 1, big + 1), ("en", "a b", 2, big)], phrases.PHRASES)
    totals = spark.createDataFrame([("en", 10**17)], "lang string, n long")
    assert [tuple(r) for r in phrases.collocations(found, totals).collect()] == [("en", 1, "a b", big, big + 7, big + 1, 10**17, 2_000_000 * big // (2 * big + 8))]
