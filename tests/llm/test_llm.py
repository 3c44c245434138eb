"""Small tests of the text operators: brute force, edge rows, round trips, held-out accuracy."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from survkit.llm import common, decontam, jaccard, langid, lm, packing, pii, quality, queries, topk, toxicity, urlfilter

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "benchmark", "labels", "pages")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("score", T.StringType()), T.StructField("n_chars", T.LongType())])


def frame(spark, rows):
    """Documents with extra columns whose names clash with those the operators make."""
    return spark.createDataFrame([(i, t, "en", "extra", None if t is None else len(t)) for i, t in rows], DOCS)


LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
EDGE = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "one two three four five six"), (5, "?! ..."), (6, LONG), (7, "Über Straße ñandú"), (8, "a <|endoftext|> b 中文 \U0001f600")]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()[name]).fetchdf()
    got = queries.queries()[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) > 0
    assert sorted(map(repr, got[cols].values.tolist())) == sorted(map(repr, want[cols].values.tolist()))


# op1


def test_contamination_edges(spark):
    item = " ".join(f"k{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item), (2, "short item here"), (3, None), (4, ""), (None, "no id"), (5, "short item here")], "item_id long, text string")
    rows = [*EDGE, (20, "x " * 3 + item.upper() + " y"), (21, "z " * 500 + "Short, item; HERE!"), (22, "no id")]
    got = decontam.contamination(frame(spark, rows), bench).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[20]["n_hit"] == 20 and by[20]["items"] == ["1"] and by[20]["contaminated"]
    assert by[21]["n_hit"] == 3 and by[21]["items"] == ["2", "5"] and not by[21]["contaminated"]
    assert by[1]["n_words"] == by[2]["n_words"] == 0 and by[6]["n_words"] == 30_000
    assert not any(by[i]["contaminated"] for i in (1, 2, 3, 5, 6, 22))
    for size in (0, 64 << 20):  # joined by a shuffle and by a broadcast
        assert {r["doc_id"]: r["n_hit"] for r in decontam.contamination(frame(spark, rows), bench, broadcast_bytes=size).collect()} == {k: v["n_hit"] for k, v in by.items()}
    kept = decontam.remove(frame(spark, rows), bench)
    assert kept.count() == len(rows) - 1 and kept.columns == DOCS.names
    cut = {r["doc_id"]: r["text"] for r in decontam.remove(frame(spark, rows), bench, mode="spans").collect()}
    assert words(cut[20]) == ["x", "x", "x", "y"] and cut[6] == LONG and cut[1] is None


def test_contamination_of_nothing(spark):
    empty = frame(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(empty, bench).count() == 0
    assert [r["n_hit"] for r in decontam.contamination(frame(spark, [(1, "a b")]), bench).collect()] == [0]


# op2


def test_toxicity_regularisation():
    # "group" (0) occurs mostly in toxic rows, "insult" (1) in all of them; 2 is the swapped group
    x = [[0, 1]] * 30 + [[1]] * 10 + [[0]] * 3 + [[]] * 60
    y = np.array([1] * 40 + [0] * 63)
    pairs = [([0, 1], [1, 2])] * 30 + [([0], [2])] * 3
    free, _ = toxicity.fit(x, y, pairs, 3, counterfactual=0.0)
    held, b = toxicity.fit(x, y, pairs, 3, counterfactual=10.0)
    assert abs(held[0] - held[2]) < 0.2 * abs(free[0] - free[2])
    assert held[1] + b > 1 and held[0] + b < 0.85


def test_toxicity_edges_and_accuracy(spark):
    docs = common.read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    labels = common.read(spark, "/root/testdata/sf0.01", "labels")
    held = common.crc_mod(F.col("doc_id"), 3) == 1
    model = toxicity.train(docs, labels, ~held)
    s = toxicity.score(docs.where(held), model).join(labels, "doc_id").collect()
    assert sum((r["score"] >= toxicity.THRESHOLD) == bool(r["toxic"]) for r in s) / len(s) > 0.93
    out = toxicity.score(frame(spark, EDGE), model)
    assert out.columns == [*[c for c in DOCS.names if c != "score"], "score"]
    assert all(0 <= r["score"] <= 1 for r in out.collect()) and out.count() == len(EDGE)
    none = toxicity.train(frame(spark, EDGE), labels.limit(0), F.lit(True))
    assert max(r["score"] for r in toxicity.score(frame(spark, EDGE), none).collect()) < 1e-9


def test_sample_counts_rows(spark):
    rows = [(1, "same text")] * 300 + [(2, f"text {i}") for i in range(300)] + [(3, "third"), (4, None)]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 1)], "doc_id long, toxic int")
    got = [tuple(r) for r in toxicity._sample(frame(spark, rows), labels, F.lit(True), "toxic", 1000).collect()]
    assert len(got) == 302 and got.count((1, "same text")) == 1 and (1, "third") in got
    assert toxicity._sample(frame(spark, rows), labels, F.lit(True), "toxic", 50).count() == 50


# op3


def test_packing_is_exact(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_file())
    rows = [*EDGE, *[(100 + i, f"piece {i} " * (i * 7 % 90)) for i in range(60)]]
    got = packing.pack_documents(frame(spark, rows), shard_tokens=20_000).toPandas()
    want = Counter()
    for i, x in rows:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert got["doc_tokens"].where(got["start"] == 0).count() == len(rows)
    assert got["length"].sum() == sum(n * k for (_, n, _), k in want.items())
    whole = got[(got["start"] == 0) & (got["length"] == got["doc_tokens"])]
    for r in whole.itertuples():
        assert (None if math.isnan(r.doc_id) else int(r.doc_id), r.doc_tokens, r.ids_crc32) in want
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["offset"].tolist() == [0, *np.cumsum(s["length"])[:-1]] and s["length"].sum() <= 4096
    sizes = got.groupby("sequence_id")["length"].sum()
    assert all(n & (n - 1) == 0 for n in sizes)
    assert packing.pack_documents(frame(spark, [])).count() == 0


def test_packing_neighbours():
    a, b = np.array([5, 6, 7, 8] * 20, "<u2"), np.array([50, 60, 70, 80] * 20, "<u2")
    docs = [a, b, a, b, a, b]
    pieces = packing.pack(docs, np.ones(1 << 16, np.float32), 80.0, window=240)
    first = {d for d, _, _, s, _ in pieces if s == 0}
    assert first == {0, 2, 4}


# op4


def test_topk_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-3, 4, 8).tolist()) for i in range(150)]
    rows += [(7, rows[7][1]), (200, [1, 2]), (220, [3, 4])]
    v = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = topk.topk(v, F.col("vec_id") % 20 == 0, k=5, query_rows=3, shard_rows=7).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    uniq = {(i, tuple(x)) for i, x in rows}
    for q, x in uniq:
        if q % 20 == 0:
            c = sorted((-sum(a * b for a, b in zip(x, y)), j) for j, y in uniq if j != q and len(y) == len(x))[:5]
            assert sorted(by.get(q, [])) == [(n + 1, j, -s) for n, (s, j) in enumerate(c)]


def test_quantised_edges(spark):
    rows = [(1, [0.5, -0.01]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (None, [1.0, 1.0]), (6, [])]
    got = {r["vec_id"]: r["v"] for r in topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {1: [32, -1], 6: []}


# op5


def test_url_filter_as_of(spark):
    caps = spark.createDataFrame(
        [(1, "http://a.bad.com/x", "2024-01-10"), (2, "http://a.bad.com/x", "2024-02-10"), (3, "https://A.bad.com:80/x", "2024-03-10"), (4, None, "2024-01-10"), (5, "http://ok.com/p/q", "2024-05-05"), (6, "http://ok.com/z", None), (6, "http://ok.com/z", None), (7, "junk", "2024-01-01")],
        "page_id long, url string, day string",
    ).withColumn("day", F.to_date("day"))
    log = [("l1", "domain", "bad.com", "add", "2024-01-05"), ("l1", "domain", "bad.com", "remove", "2024-02-01"), ("l1", "domain", "bad.com", "add", "2024-03-01"), ("l2", "prefix", "ok.com/p", "add", "2024-05-05"), ("l3", "host", None, "add", "2024-01-01")]
    ch = spark.createDataFrame(log, "list string, kind string, value string, action string, day string").withColumn("day", F.to_date("day"))
    got = sorted((r["page_id"], r["lists"]) for r in urlfilter.judge(caps, ch).collect())
    assert got == [(1, "l1"), (2, ""), (3, "l1"), (4, ""), (5, "l2"), (6, ""), (6, ""), (7, "")]


def test_url_filter_open_entries_have_no_last_day(spark):
    caps = spark.createDataFrame([(1, "http://a.com/x", "2027-01-14"), (2, "http://a.com/x", "2041-07-01"), (3, "http://b.com/x", "2041-07-01")], "page_id long, url string, day string").withColumn("day", F.to_date("day"))
    log = [("l1", "host", "a.com", "add", "2024-01-05"), ("l1", "host", "b.com", "add", "2024-01-05"), ("l1", "host", "b.com", "remove", "2041-07-01"), ("l2", "host", "b.com", "add", "2050-01-01")]
    ch = spark.createDataFrame(log, "list string, kind string, value string, action string, day string").withColumn("day", F.to_date("day"))
    assert sorted((r["page_id"], r["lists"]) for r in urlfilter.judge(caps, ch).collect()) == [(1, "l1"), (2, "l1"), (3, "")]
    assert urlfilter.judge(caps.limit(0), ch).count() == 0


def test_url_filter_path_depths(spark):
    urls = ["http://h.com/a/b/c?q=1", "http://h.com/a/b", "http://h.com/a/bb/c", "http://h.com/x", "http://h.com", "http://h.com/", "http://g.com/s/t/u.html#f", "https://u:p@G.com:8/s/t/u.html"]
    caps = spark.createDataFrame([(i, u, "2024-05-01") for i, u in enumerate(urls)], "page_id long, url string, day string").withColumn("day", F.to_date("day"))
    log = [("deep", "prefix", "h.com/a/b"), ("whole", "prefix", "h.com/a/b/c"), ("top", "prefix", "h.com"), ("url", "prefix", "http://g.com/s/t/u.html"), ("host", "host", "h.com")]
    ch = spark.createDataFrame([(*x, "add", "2024-01-01") for x in log], "list string, kind string, value string, action string, day string").withColumn("day", F.to_date("day"))
    got = {r["page_id"]: (r["lists"], r["n_entries"]) for r in urlfilter.judge(caps, ch).collect()}
    top = ("host,top", 2)
    assert got == {0: ("deep,host,top,whole", 4), 1: ("deep,host,top", 3), 2: top, 3: top, 4: top, 5: top, 6: ("url", 1), 7: ("url", 1)}


# op6


def test_quality_edges_and_accuracy(spark):
    docs = common.read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    labels = common.read(spark, "/root/testdata/sf0.01", "labels")
    held = common.crc_mod(F.col("doc_id"), 5) == 0
    model = quality.train(docs, labels, ~held)
    s = quality.score(docs.where(held), model).join(labels, "doc_id").collect()
    assert sum((r["score"] >= quality.THRESHOLD) == bool(r["quality"]) for r in s) / len(s) > 0.93
    got = quality.score(frame(spark, EDGE), model).collect()
    assert len(got) == len(EDGE) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.train(docs, labels.limit(0), F.lit(True)) is None


def test_field_marginals_by_enumeration():
    rng = np.random.default_rng(2)
    lengths = np.array([1, 4, 3])
    emit, trans = rng.normal(size=8), rng.normal(size=(2, 2))
    p, _ = quality.Chains(lengths).marginals(emit, trans)
    at = 0
    for n in lengths:
        e, total, good = emit[at : at + n], 0.0, np.zeros(n)
        for k in range(1 << n):
            y = [(k >> i) & 1 for i in range(n)]
            z = math.exp(sum(e[i] * y[i] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
            total, good = total + z, good + z * np.array(y)
        assert np.allclose(p[at : at + n], good / total)
        at += n


# op7


def test_surrogates(spark):
    rows = [
        (1, "Mail bob.smith@corp.org or call +1 (212) 555-0101, card 4111 1111 1111 1111."), (2, "card 4111111111111111 again; BOB.SMITH@corp.org, 10.20.30.40."),
        (3, "Mr. John Fairfax met Mary Fairfax"), (4, 'token = "0123456789abcdef0123"'), (5, None), (6, ""), (None, "ip 10.20.30.40"), (7, "plain text of 1234 words"), (7, "plain text of 1234 words"),
        *[(100 + i, f"u{i}@x.com {i % 200}.1.2.{i % 250}") for i in range(300)],
    ]
    out = pii.replace(frame(spark, rows), "k", counts=True).collect()
    assert len(out) == len(rows)
    got = {r["doc_id"]: r["text"] for r in out}
    assert "bob" not in got[1].lower() and "4111 1111" not in got[1] and "555-0101" not in got[1]
    card = re.search(r"card (4\d{3} \d{4} \d{4} \d{4})\.", got[1])[1].replace(" ", "")
    assert card in got[2]  # one entity, two formats
    assert sum((d * 2 - 9 if d > 4 else d * 2) if i % 2 else d for i, d in enumerate(map(int, card[::-1]))) % 10 == 0
    mail = re.search(r"Mail (\S+)", got[1])[1]
    assert mail in got[2].lower()
    assert re.search(r"(\d+\.\d+\.\d+\.\d+)", got[2])[1] == got[None].split()[1] != "10.20.30.40"
    assert "Fairfax" not in got[3] and got[3].startswith("Mr. ") and len(set(re.findall(r"[A-Z]\w+", got[3])[-1:])) == 1
    new = re.findall(r"met (\w+) (\w+)", got[3])[0]
    assert new[0] in pii.GIVEN["latin", "f"].split() and new[0] != "Mary" and got[3].split(" met ")[0].endswith(new[1])
    assert re.fullmatch(r'token = "[0-9a-f]{20}"', got[4]) and got[4] != rows[3][1]
    assert got[5] is None and got[6] == "" and got[7] == rows[7][1]
    mails = [got[100 + i].split()[0] for i in range(300)]
    assert len(set(mails)) == 300 and not set(mails) & {f"u{i}@x.com" for i in range(300)}
    again = {r["doc_id"]: r["text"] for r in pii.replace(frame(spark, rows), "k").collect()}
    assert again == got and {r["doc_id"]: r["text"] for r in pii.replace(frame(spark, rows), key="other").collect()} != got
    assert pii.replace(frame(spark, []), "k").count() == 0


def test_surrogate_collisions(spark):
    # 100 of 100 three-digit numbers that start with 7: every surrogate would be a real entity, so widen by kind
    ents = spark.createDataFrame([("name", f"n{i}") for i in range(3000)], "kind string, canon string")
    got = pii.surrogates(ents, "k").collect()
    assert len(got) == 3000 and len({r["sur"] for r in got}) == 3000


def test_surrogates_of_exhausted_spaces(spark):
    # all numbers of three digits that start with 7, all secrets of one letter and seven dashes: no free one of that length
    real = [("phone", f"7{i:02d}") for i in range(100)] + [("secret", c + "-------") for c in "abcdefghijklmnopqrstuvwxyz"]
    got = pii.surrogates(spark.createDataFrame(real, "kind string, canon string"), "k").collect()
    assert len(got) == len(real) == len({(r["kind"], r["sur"]) for r in got}) and not {(r["kind"], r["sur"]) for r in got} & set(real)
    assert all(r["sur"][0] == "7" for r in got if r["kind"] == "phone")
    rows = [(1, "Password: ________"), (2, "token: --------"), (3, "token: a-------"), *[(100 + i, f"+7 {i // 100:02d} {i % 100:02d}") for i in range(10_000)]]
    out = {r["doc_id"]: r["text"] for r in pii.replace(frame(spark, rows), "k").collect()}
    assert out[1] == rows[0][1] and out[2] == rows[1][1] and out[3] != rows[2][1]
    new = [out[100 + i] for i in range(10_000)]
    assert len(set(new)) == 10_000 and not set(new) & {x for _, x in rows} and all(re.fullmatch(r"\+7 \d\d \d{3,}", x) for x in new)


PHONES = ["+14155552671", "415-555-2671", "415.555.2671", "1-415-555-2671", "+49 30 1234567", "+33 1 23 45 67 89", "0033 1 23 45 67 89", "+49 (0) 30 1234567", "030 1234567", "01 23 45 67 89", "020 7946 0958", "(020) 7946 0958", "+1 (212) 555-0101", "+1 23 45"]
IP6 = ["2001:db8:0:0:0:0:0:1", "2001:0DB8::1", "fe80::1ff:fe23:4567:890a", "2001:db8:1:2:3:4:5:6", "::1"]
PLAIN = ["2024-01-15", "01.02.2024 12:30:45", "01.02.2024 12", "978-3-16-148410-0", "std::dec", "x 1234567 y", "3.14159", "00:1b:44:11:3a:b7", "1+12345678"]


def test_phone_and_address_formats(spark):
    rows = list(enumerate(["call " + x + ", now" for x in PHONES] + ["from " + x + ". End" for x in IP6] + PLAIN))
    out = {r["doc_id"]: r for r in pii.replace(frame(spark, rows), "k", counts=True).collect()}
    for i, x in enumerate(PHONES):
        assert out[i]["kinds"] == ["phone"] and out[i]["n_entities"] == 1 and out[i]["text"] != rows[i][1], x
        assert re.sub(r"\d", "0", out[i]["text"]) == re.sub(r"\d", "0", rows[i][1]), x
    at = len(PHONES)
    for i, x in enumerate(IP6, at):
        assert out[i]["kinds"] == ["ip6"] and re.fullmatch(r"from [0-9a-f]{4}(:[0-9a-f]{4}){7}\. End", out[i]["text"]), x
    assert out[at]["text"] == out[at + 1]["text"] and len({out[i]["text"] for i in range(at, at + 5)}) == 4  # one address, two formats
    assert [out[i]["text"] for i in range(at + 5, len(rows))] == PLAIN
    kept = pii.replace(frame(spark, [(1, "ssn 012-34-5678, card 0111 1111 1111 1111")]), "k", counts=True).first()
    assert kept["kinds"] == ["card", "ssn"]


# op8


def test_lm_brute_force(spark):
    rows = [(i, f"the cat {i % 7} sat on the mat {i % 3}") for i in range(40)] + [(50, None), (51, ""), (None, "the cat"), (52, "never seen")]
    held = common.crc_mod(F.col("doc_id"), 10) == 0
    got = lm.score(frame(spark, rows), held, block_bytes=400).collect()
    assert len(got) == len(rows)
    toks = [((t or "").lower().split() + ["\n"], i is None or zlib.crc32(str(i).encode()) % 10 != 0) for i, t in rows]
    c, pair, ctx = Counter(), Counter(), Counter()
    for w, train in toks:
        if train:
            c.update(w)
            pair.update(zip(["\r", *w], w))
            ctx.update(["\r", *w[:-1]])
    n, v = sum(c.values()), len(c)
    wt = got[0]["backoff_weight"]
    p1 = lambda x: (c[x] + 0.1) / (n + 0.1 * (v + 1))
    p2 = lambda u, x: (1 - wt) * pair[u, x] / ctx[u] + wt * p1(x) if ctx[u] else p1(x)
    want = sorted((round(sum(math.log10(p1(x)) for x in w), 6), round(sum(math.log10(p2(u, x)) for u, x in zip(["\r", *w], w)), 6), len(w), n) for w, _ in toks)
    assert sorted((round(r["base_score"], 6), round(r["score"], 6), r["n_tokens"], r["train_tokens"]) for r in got) == want
    # the arcs of a state and its failure arc hold all of its probability
    for u in ctx:
        assert abs(sum(p2(u, x) for x in c) + wt * 0.1 / (n + 0.1 * (v + 1)) - 1) < 1e-9
    assert lm.score(frame(spark, []), held).count() == 0


# op9


def test_components_with_hubs(spark):
    # a hub, a chain, a ring and a pair; more salts than one hub's edges fill, and one salt step for every edge
    edges = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000 + i, 2000 + (i + 1) % 9) for i in range(9)] + [(5000, 299), (7, 7)]
    want = {n: 0 for n in [*range(300), 5000]} | {n: 1000 for n in range(1000, 1101)} | {n: 2000 for n in range(2000, 2009)}
    for step in (1, 1 << 18):
        got = common.components(spark.createDataFrame(edges, "a long, b long"), salt_edges=step).collect()
        assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)


def test_jaccard_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = list(EDGE)
    for g in range(12):
        base = [f"v{x}" for x in rng.integers(0, 500, 120)]
        for k in range(int(rng.integers(1, 9))):
            w = list(base)
            for _ in range(int(rng.integers(0, 6))):
                w[int(rng.integers(0, len(w)))] = "changed"
            rows.append((1000 + 20 * g + k, " ".join(w)))
    rows += [(5000 + i, "the same words again and again here") for i in range(6)]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t)) else set() for _, t in rows]
    link = [[j for j in range(len(rows)) if j != i and sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])] for i in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *(root[j] for j in link[i])]) for i in range(len(rows))]
    ids = lambda r: [x for i, (x, _) in enumerate(rows) if root[i] == r and x is not None]
    key = lambda x: -1 if x is None else x
    want = sorted((key(x), key(min(ids(root[i]), default=None)), len(link[i])) for i, (x, _) in enumerate(rows))
    for tile in (2048, 3):
        got = jaccard.near_duplicates(frame(spark, rows), tile=tile).collect()
        assert sorted((key(r["doc_id"]), key(r["class_id"]), r["n_links"]) for r in got) == want
    kept = jaccard.keep_one(frame(spark, rows))
    assert kept.columns == DOCS.names and kept.count() == len(set(root)) and kept.where("doc_id = 3").count() == 1
    assert jaccard.near_duplicates(frame(spark, [])).count() == 0


def test_pruning_never_drops_likely_pairs():
    for n in (25, 100, 200):
        m = jaccard.least_matches(n, 0.8, 1e-6)
        assert 0 < m < 0.8 * n
        tail = lambda k: sum(math.comb(n + 1, j) * 0.8**j * 0.2 ** (n + 1 - j) for j in range(k + 1))
        assert tail(m) >= 1e-6 > tail(m - 1)


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in common.components(e).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


# op10


def test_language(spark):
    docs = common.read(spark, "/root/testdata/sf0.01", "documents")
    held = common.crc_mod(F.col("doc_id"), 4) == 2
    known = langid.profiles(docs, ~held)
    got = langid.identify(docs.where(held), known).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.95
    edge = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(frame(spark, EDGE), known).collect()}
    assert edge[1] == edge[2] == edge[5] == ("und", 0.0) and edge[3][0] in known
    assert {r["lang_pred"] for r in langid.identify(frame(spark, EDGE), {}).collect()} == {"und"}


# pipeline


def test_pipeline_stages(spark):
    docs = common.read(spark, SF, "documents")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    near = {r["doc_id"]: r["class_id"] for r in jaccard.near_duplicates(docs).collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.store(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert left and left <= ids
        if name == "near_duplicates":
            assert len({near[i] for i in left}) == len(left)
        ids = left
    assert decontam.contamination(docs, common.read(spark, SF, "benchmark")).where("contaminated").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == ids


def test_pipeline_edges(spark):
    docs = frame(spark, EDGE).withColumn("source", F.lit("s"))
    for name, stage in corpus_pipeline.STAGES:
        docs = common.store(stage(spark, docs, SF), f"test-{name}")
        assert docs.count() > 0
