"""Benchmark decontamination: benchmark n-gram windows against every token window of the documents.

DataFrame functions only. The windows of the benchmark (13 consecutive words; an item of fewer words is one
window) form a hash set that is broadcast while its measured size is under a bound and joined by a shuffle
beyond it. A document row yields one 64-bit hash per word position and window length; the join finds equal
hashes, its condition compares the words themselves, so a hash collision is never a hit.

Defined results: a null or empty text has no words and is clean; benchmark rows with a null text, no words or
a null id take no part; repeated rows each give a row; only the named columns are used, so extra columns
pass through ``remove`` untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WORD, read, sealed, words_col

WINDOW = 13
#: Document share of hit words from which a document counts as contaminated: 20 * n_hit >= n_words.
SHARE_INV = 20
#: Most bytes of benchmark windows that are broadcast.
BROADCAST_BYTES = 64 << 20


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(h, len, win, items): every distinct window of the benchmark with the ids that have it."""
    w = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), words_col(F.col("text")).alias("w"))
    w = w.where(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(window)))
    w = w.select("item", "w", "len", F.explode_outer(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("p"))
    w = w.select("item", "len", F.expr("slice(w, p, len)").alias("win"))
    return w.groupBy("len", "win").agg(F.sort_array(F.collect_set("item")).alias("items")).select(F.xxhash64("win").alias("h"), "len", "win", "items")


def _spans(docs: DataFrame, wins: DataFrame, lengths: list[int], broadcast: bool) -> DataFrame:
    """One row per document (key: doc_id, th, n_words; m equal rows): hit spans (from, to) and item ids."""
    d = docs.select("doc_id", F.xxhash64("text").alias("th"), words_col(F.col("text")).alias("w"))
    none = F.expr("CAST(array() AS array<struct<h:bigint,p:int,len:int>>)")
    grams = [
        F.expr(f"transform(sequence(1, size(w) - {n - 1}), p -> struct(xxhash64(slice(w, p, {n})) AS h, p AS p, {n} AS len))")
        for n in lengths
    ]
    # the first element of each document has position 0 and joins the marker row: documents without a hit stay
    mark = F.expr("array(struct(0L AS h, 0 AS p, 0 AS len))")
    d = d.select("doc_id", "th", "w", F.concat(mark, *[F.when(F.size("w") >= n, g).otherwise(none) for n, g in zip(lengths, grams)]).alias("g"))
    # the outer form: for the plain one the optimiser infers a filter on the array's size, which evaluates it a second time
    d = d.select("doc_id", "th", "w", F.explode_outer("g").alias("g"))
    d = d.select("doc_id", "th", "w", F.col("g.h").alias("h"), F.col("g.p").alias("p"), F.col("g.len").alias("len"), F.size("w").cast("long").alias("n_words"))
    mine = F.expr("slice(w, p, len)")
    if not broadcast:
        # a shuffled row carries its own window only, never the document's words
        d = d.withColumn("dw", F.expr("slice(w, greatest(p, 1), len)")).drop("w")
        mine = F.col("dw")
    marker = wins.sparkSession.range(1).select(
        F.lit(0).cast("long").alias("h"), F.lit(0).alias("len"), F.expr("CAST(array() AS array<string>)").alias("win"), F.expr("CAST(array() AS array<string>)").alias("items")
    )
    t = wins.union(marker).select(F.col("h").alias("wh"), F.col("len").alias("wlen"), "win", "items")
    if broadcast:
        t = F.broadcast(t)
    hits = d.join(t, (d.h == t.wh) & (d.len == t.wlen) & ((d.len == 0) | (mine == F.col("win"))))
    span = F.when(F.col("p") > 0, F.struct(F.col("p").alias("a"), (F.col("p") + F.col("len")).alias("b")))
    return (
        hits.groupBy("doc_id", "th", "n_words")
        .agg(
            F.sum((F.col("p") == 0).cast("long")).alias("m"),
            F.sort_array(F.collect_set(span)).alias("spans"),
            F.collect_set(F.when(F.col("p") > 0, F.col("items"))).alias("its"),
        )
        .withColumn("items", F.sort_array(F.array_distinct(F.flatten("its"))))
        .drop("its")
    )


def _n_hit():
    """Words in the union of the sorted spans [a, b)."""
    return F.expr(
        "aggregate(spans, struct(0 AS n, 0 AS e), (s, x) -> struct(s.n + greatest(0, x.b - greatest(x.a, s.e)) AS n, greatest(s.e, x.b) AS e), s -> CAST(s.n AS bigint))"
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document row: doc_id, th (hash of its text), n_words, n_hit, spans, items, contaminated."""
    wins = windows(benchmark, window)
    got = wins.groupBy("len").agg(F.sum(F.expr("64 + aggregate(win, 0, (s, x) -> s + octet_length(x) + 16) + aggregate(items, 0, (s, x) -> s + octet_length(x) + 16)")).alias("b")).collect()
    lengths, size = sorted(r["len"] for r in got), sum(r["b"] for r in got)
    out = _spans(docs, wins, lengths, size <= broadcast_bytes).withColumn("n_hit", _n_hit())
    out = out.withColumn("contaminated", F.expr(f"n_hit > 0 AND {SHARE_INV} * n_hit >= n_words"))
    return out.withColumn("m", F.explode_outer(F.expr("sequence(1L, m)"))).drop("m")


def remove(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", window: int = WINDOW) -> DataFrame:
    """``documents``: drop contaminated documents. ``spans``: drop the hit words of contaminated documents instead.

    All columns of ``docs`` stay; n_chars follows the new text where it exists.
    """
    bad = contamination(docs, benchmark, window).where("contaminated").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("spans").alias("__spans"))
    bad = bad.dropDuplicates(["__id", "__th"])
    d, opened = sealed(docs, "doc_id", "text", "n_chars")
    d = d.withColumn("__h", F.xxhash64("text"))
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__th"))
    if mode == "documents":
        return opened(d.join(bad.drop("__spans"), on, "left_anti"))
    low = F.translate("text", UPPER, LOWER)
    # separators around the words: one more than words; original words by the same split on the unlowered text
    d = d.join(bad, on, "left")
    d = d.withColumn("__s", F.split(low, WORD, -1)).withColumn("__w", F.regexp_extract_all("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)))
    # per position: +1 where a span begins, -1 where one ends; a running sum above 0 is a hit word
    keep = F.expr("transform(__w, (x, i) -> IF(exists(__spans, s -> s.a <= i + 1 AND i + 1 < s.b), '', x))")
    text = F.expr("concat(__s[0], array_join(transform(__k, (x, i) -> concat(x, __s[i + 1])), ''))")
    d = d.withColumn("__k", keep).withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(text))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return opened(d)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return c.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP1_SQL = r"""
WITH low AS (SELECT 'x' AS one), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item, n, w[p:p + n - 1] AS win FROM (
    SELECT item, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, p, n, w[p:p + n - 1] AS win FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.p, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM hit)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
