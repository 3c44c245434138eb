"""N-gram Jaccard join with Bayesian candidate pruning (near-duplicate documents).

A document is the set of its five-word shingles (a text of fewer words, but not none, is one shingle). Two
documents are linked when the Jaccard similarity of their sets is at least the threshold.

1. Documents with equal sets form a class of copies; from here on each class is one representative.
2. Candidates: representatives that agree on all rows of a MinHash band. At the threshold a pair misses all
   bands with a probability of (1 - t^ROWS)^BANDS, 1.3e-7 at 0.8.
3. Band buckets are linked as stars (member to least member), never as pairs; the components of these stars
   hold every candidate pair. Components are dealt to tasks, large ones as tiles of bounded size.
4. In a tile the MinHash values of the candidate pairs are compared a chunk at a time; a pair is dropped as
   soon as the posterior probability of reaching the threshold (uniform prior) is below the tolerance.
5. What is left is verified on the exact shingle sets. A tile returns link counts per document and the edges
   of a spanning forest, not its pairs; the forests' components are the near-duplicate classes.

Defined results: a null or wordless text has no shingles, no link and a class of its own; repeated rows each
give a row and count as copies; a null id is a value like any other except that it can't lead a class with
non-null ids (class ids are the least id); extra columns are not touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_HASH, components, mix64, read, sealed, store, word_list

SHINGLE, THRESHOLD = 5, 0.8
ROWS, BANDS = 5, 40
#: A pair is dropped when the probability that it reaches the threshold falls below this.
TOLERANCE = 1e-6
CHUNK = 25
#: Most representatives of a component in one task's tile side; larger components are cut into tiles.
TILE, TILE_BYTES = 2048, 32 << 20
#: Most members whose ids are broadcast to pick their texts; beyond it the texts are picked by a shuffled join.
BROADCAST_ROWS = 1_000_000
_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def shingle_hashes(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    out = []
    get = WORD_HASH.__getitem__
    mult = [_PRIMES[i % 5] * np.uint64(2 * (i // 5) + 1) for i in range(size)]
    with np.errstate(over="ignore"):
        for t in texts:
            w = word_list(t)
            h = np.fromiter(map(get, w), np.uint64, len(w))
            if not len(h):
                out.append(h)
                continue
            n = min(size, len(h))
            s = np.full(len(h) - n + 1, n, np.uint64)
            for i in range(n):
                s = s + mix64(h[i : len(h) - n + 1 + i] * mult[i])
            out.append(np.unique(mix64(s)))
    return out


@lru_cache
def _hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, n, dtype=np.uint64)


def minhash(sets: list[np.ndarray], n: int) -> np.ndarray:
    """(documents, n) 32-bit MinHash values; every set must have a member."""
    a, b = _hash_family(n)
    out = np.empty((len(sets), n), np.uint32)
    with np.errstate(over="ignore"):
        for i, s in enumerate(sets):
            for at in range(0, len(s), 4096):  # long documents by pieces
                x = ((s[at : at + 4096, None] * a + b) >> np.uint64(32)).min(axis=0).astype(np.uint32)
                out[i] = np.minimum(out[i], x) if at else x
    return out


@lru_cache
def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Least m for which a pair with m of n equal MinHash values may still reach the threshold.

    With a uniform prior the posterior of the similarity is Beta(m + 1, n - m + 1); its tail above t is the
    probability of at most m successes in n + 1 trials of chance t.
    """
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


def _profile(docs: DataFrame, rows: int, bands: int) -> DataFrame:
    """(doc_id, th, key, bands): hash of the text, key of the shingle set (null: no shingles), one hash per band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                sets = shingle_hashes(b.column("text").to_pylist())
                sig = iter(minhash([s for s in sets if len(s)], rows * bands))
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                band = [None if k is None else [xxhash.xxh3_64_intdigest(r.tobytes(), j) - 2**63 for j, r in enumerate(next(sig).reshape(bands, rows))] for k in keys]
                yield pa.record_batch([b.column("doc_id"), b.column("th"), pa.array(keys, pa.binary()), pa.array(band, pa.list_(pa.int64()))], ["doc_id", "th", "key", "bands"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return d.mapInArrow(run, "doc_id long, th long, key binary, bands array<long>")


def _member_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The shingle sets of the members' representatives, computed anew from their whole texts."""
    schema = "root binary, key binary, mass long, shingles binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                blobs = [s.tobytes() for s in shingle_hashes(b.column("text").to_pylist())]
                yield pa.record_batch([b.column("root"), b.column("key"), b.column("mass"), pa.array(blobs, pa.binary())], ["root", "key", "mass", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"), "text")
    reps = members.select(F.col("lead.doc_id").alias("want"), F.col("lead.th").alias("want_h"))
    if members.count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(reps), F.col("id").eqNullSafe(F.col("want")) & (F.col("h") == F.col("want_h")), "left_semi")
    # a representative that is repeated row by row comes once
    both = members.join(texts, F.col("lead.doc_id").eqNullSafe(F.col("id")) & (F.col("lead.th") == F.col("h"))).select("root", "key", "mass", "text")
    return both.mapInArrow(run, schema).dropDuplicates(["key"])


def compare(sig: np.ndarray, mass: np.ndarray, left: np.ndarray, right: np.ndarray, sets: list[np.ndarray], threshold: float, tolerance: float, rows: int, bands: int):
    """Link counts and forest edges of one tile: pairs (left[i], right[j]) of members, each unordered pair once.

    Returns (links per member, list of (member, member)); a link counts the other side's copies.
    """
    links, edges = np.zeros(len(sig), np.int64), []
    # inverted lists over the right side's shingles for exact counts of common members
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate([sets[j] for j in right])
    owner = np.repeat(np.arange(len(right), dtype=np.int32), sizes[right])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    del order
    parent = list(range(len(sig)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    same = left is right
    banded = sig.reshape(len(sig), bands, rows)
    for i_at, i in enumerate(left):
        js = np.arange(i_at + 1, len(right)) if same else np.arange(len(right))
        if not len(js):
            continue
        cand = (banded[right[js]] == banded[i]).all(axis=2).any(axis=1)
        js = js[cand]
        hits = np.zeros(len(js), np.int64)
        for at in range(0, rows * bands, CHUNK):
            if not len(js):
                break
            hits += (sig[right[js], at : at + CHUNK] == sig[i, at : at + CHUNK]).sum(axis=1)
            seen = min(at + CHUNK, rows * bands)
            ok = hits >= least_matches(seen, threshold, tolerance)
            js, hits = js[ok], hits[ok]
        if not len(js):
            continue
        lo, hi = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(right))[js]
        # common / union >= t without a division's rounding: t is a multiple of 1e-6 here
        union = sizes[i] + sizes[right[js]] - both
        js = js[both * 1_000_000 >= round(threshold * 1_000_000) * union]
        links[i] += mass[right[js]].sum()
        links[right[js]] += mass[i]
        for j in right[js]:
            x, y = find(i), find(int(j))
            if x != y:
                parent[x] = y
                edges.append((i, int(j)))
    return links, edges


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, rows: int = ROWS, bands: int = BANDS, tile: int = TILE) -> DataFrame:
    """Per document row: doc_id, class_id (least id of its class), copies (other rows with the same set), n_links
    (other rows whose similarity reaches the threshold, copies included); th and class_th, the hashes of its text
    and of the text that stands for its class."""
    spark = docs.sparkSession
    prof = store(_profile(docs, rows, bands), "jaccard-profiles")
    # representative: the least id of a class of equal sets
    classes = store(prof.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("lead"), F.count("*").alias("mass"), F.first("bands").alias("bands")), "jaccard-classes")
    # band hashes seen by more than one representative; the class key names a representative
    buckets = classes.select("key", F.posexplode("bands").alias("band", "h"))
    stars = buckets.groupBy("band", "h").agg(F.min("key").alias("low"), F.count("*").alias("n")).where("n > 1")
    edges = buckets.join(stars, ["band", "h"]).where("key <> low").select(F.col("key").alias("a"), F.col("low").alias("b")).distinct()
    comp = components(edges, name="jaccard-candidates").withColumnRenamed("node", "key")
    members = comp.join(classes.select("key", "lead", "mass"), "key")
    sets = store(_member_sets(docs, store(members, "jaccard-members")), "jaccard-sets")
    sizes = sets.groupBy("root").agg(F.count("*").alias("size"), F.sum(F.octet_length("shingles")).alias("bytes"))
    sets = sets.join(sizes.select("root", F.ceil(F.greatest(F.col("size") / tile, F.col("bytes") / TILE_BYTES)).cast("int").alias("parts")), "root")
    sets = sets.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    # each member goes to every tile that pairs its part with another: g tiles; a tile side holds about `tile` members
    tiled = sets.withColumn("other", F.explode_outer(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "root", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "key", "mass", "shingles"
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable").reset_index(drop=True)
        s = [np.frombuffer(b, np.uint64) for b in pdf["shingles"]]
        sig = minhash(s, rows * bands)
        x, y = pdf["x"].iloc[0], pdf["y"].iloc[0]
        left = np.flatnonzero(pdf["part"] == x)
        right = left if x == y else np.flatnonzero(pdf["part"] == y)
        if not len(left) or not len(right):
            return pd.DataFrame({"key": [], "links": [], "to": []})
        links, forest = compare(sig, pdf["mass"].to_numpy(), left, right, s, threshold, tolerance, rows, bands)
        some = np.flatnonzero(links)
        keys = pdf["key"]
        a = pd.DataFrame({"key": keys.iloc[some].tolist(), "links": links[some], "to": None})
        b = pd.DataFrame({"key": [keys[i] for i, _ in forest], "links": 0, "to": [keys[j] for _, j in forest]})
        return pd.concat([a, b])

    found = store(tiled.groupBy("root", "x", "y").applyInPandas(run, "key binary, links long, to binary"), "jaccard-links")
    linked = found.groupBy("key").agg(F.sum("links").alias("links"))
    near = components(found.where("to IS NOT NULL").select(F.col("key").alias("a"), F.col("to").alias("b")), name="jaccard-classes").withColumnRenamed("node", "key")
    c = classes.select("key", "lead", "mass").join(near, "key", "left").join(linked, "key", "left")
    c = c.withColumn("root", F.coalesce("root", "key"))
    least = c.groupBy("root").agg(F.min("lead").alias("first"))
    c = c.join(least, "root").select("key", "first", "mass", F.coalesce("links", F.lit(0)).alias("links"))
    # a class of copies may hold a third of all rows: its join is dealt anew by AQE, its row here is one
    out = prof.select("doc_id", "th", "key").join(c, "key", "left")
    return out.select(
        "doc_id",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.when(F.col("key").isNull(), F.lit(0)).otherwise(F.col("mass") - 1).cast("long").alias("copies"),
        F.when(F.col("key").isNull(), F.lit(0)).otherwise(F.col("links") + F.col("mass") - 1).cast("long").alias("n_links"),
        "th",
        F.when(F.col("key").isNull(), F.col("th")).otherwise(F.col("first.th")).alias("class_th"),
    )


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` without the near duplicates: of each class the row of its least id stays (of equal rows, one)."""
    near = store(near_duplicates(docs, **settings), "jaccard-rows")
    key = [F.col("doc_id").alias("__id"), F.col("th").alias("__th")]
    drop = near.where("NOT (doc_id <=> class_id AND th = class_th)").select(*key).distinct()
    again = near.where("copies > 0 AND doc_id <=> class_id AND th = class_th").groupBy(*key).count().where("count > 1").drop("count")
    d, opened = sealed(docs, "doc_id", "text")
    d = d.withColumn("__h", F.xxhash64("text"))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__th"))
    kept = d.join(drop, on, "left_anti")
    if not again.isEmpty():
        kept = kept.join(again, on, "left_anti").unionByName(kept.join(again, on, "left_semi").dropDuplicates(["doc_id", "__h"]))
    return opened(kept)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).drop("th", "class_th")
