"""Exact top-k search: tiled matrix products of query blocks and vector shards, per-tile selection, tree merge.

Vectors are packed into blocks of a fixed number of rows. Each (query block, shard) tile is one matrix
product in one task, which keeps the k best of each query; the partial lists of a query block are merged in a
tree of bounded fan-in, so no task holds more than ``FAN_IN`` partial lists of one block.

Defined results: vectors that are null or hold a null or non-finite component take no part, nor do rows with a
null id; vectors are compared with those of the same length only; rows that repeat both id and vector count
once; a row is never a candidate for its own id. Equal scores go by the smaller id. Extra columns are unused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import block_id, read, store

K = 20
QUERY_ROWS, SHARD_ROWS, FAN_IN = 1024, 8192, 16
PART = "dim int, qb int, sb int, ids binary, n int, top_ids binary, top_scores binary"


def _matrix(blobs: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype="<i8").reshape(-1, dim)


def _pack(rows: DataFrame, n_blocks: int, block: str) -> DataFrame:
    """(dim, block, ids, vecs): one row per block, ids ascending."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        dim = int(pdf["dim"].iloc[0])
        vecs = np.array(pdf["v"].tolist(), dtype="<i8").reshape(len(pdf), dim)
        return pd.DataFrame({"dim": [dim], block: [int(pdf["block"].iloc[0])], "ids": [pdf["vec_id"].to_numpy("<i8").tobytes()], "vecs": [vecs.tobytes()]})

    return rows.withColumn("block", block_id(n_blocks, "vec_id", "v").cast("int")).groupBy("dim", "block").applyInPandas(pack, f"dim int, {block} int, ids binary, vecs binary")


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to smaller ids."""
    if len(scores) > k:
        # everything at or above the k-th score, so that ties at the border are settled by id
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= cut
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _lists(qids: np.ndarray, tops: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[bytes, bytes]:
    """Per query k ids and k scores; unused places have the least score."""
    a, b = np.full((len(qids), k), -1, "<i8"), np.full((len(qids), k), np.iinfo(np.int64).min, "<i8")
    for i, (x, s) in enumerate(tops):
        a[i, : len(x)], b[i, : len(s)] = x, s
    return a.tobytes(), b.tobytes()


def topk(vectors: DataFrame, is_query: Column, k: int = K, query_rows: int = QUERY_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest integer inner products of each query row.

    ``vectors``: vec_id long, v array<long>; already cleaned (see ``quantised``).
    """
    v = store(vectors.select("vec_id", "v", F.size("v").alias("dim"), is_query.alias("q")).distinct(), "topk-vectors")
    n, nq = v.agg(F.count("*"), F.count(F.when(F.col("q"), 1))).first()
    shards, blocks = -(-n // shard_rows) or 1, -(-nq // query_rows) or 1
    s, q = _pack(v, shards, "sb"), _pack(v.where("q"), blocks, "qb")

    def tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                dim, qi, si = r.dim, np.frombuffer(r.ids, "<i8"), np.frombuffer(r.sids, "<i8")
                x, y = (np.frombuffer(z, "<i8").reshape(-1, dim) if dim else np.zeros((len(w), 0), np.int64) for z, w in ((r.qvecs, qi), (r.vecs, si)))
                # exact in doubles while every partial sum stays below 2^53, else in 64-bit integers
                top = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(dim, 1)
                tops = []
                for i in range(0, len(qi), 128):
                    part = (x[i : i + 128].astype(float) @ y.T.astype(float)).astype(np.int64) if top < 2**53 else x[i : i + 128] @ y.T
                    for me, row in zip(qi[i : i + 128], part):
                        own = si == me
                        tops.append(best(si[~own], row[~own], k) if own.any() else best(si, row, k))
                a, b = _lists(qi, tops, k)
                yield pd.DataFrame({"dim": [dim], "qb": [r.qb], "sb": [r.sb], "ids": [r.ids], "n": [len(qi)], "top_ids": [a], "top_scores": [b]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        qi = np.frombuffer(first["ids"], "<i8")
        a, b = (np.concatenate([np.frombuffer(z, "<i8").reshape(len(qi), k) for z in pdf[c]], axis=1) for c in ("top_ids", "top_scores"))
        used = b > np.iinfo(np.int64).min
        ids, scores = _lists(qi, [best(a[i][used[i]], b[i][used[i]], k) for i in range(len(qi))], k)
        return pd.DataFrame({"dim": [first["dim"]], "qb": [first["qb"]], "sb": [first["up"]], "ids": [first["ids"]], "n": [len(qi)], "top_ids": [ids], "top_scores": [scores]})

    # every query block visits every shard: it is copied once per shard and joined on the shard, the side that grows
    visits = q.withColumnRenamed("vecs", "qvecs").withColumn("sb", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    parts = visits.join(s.withColumnRenamed("ids", "sids"), ["dim", "sb"]).mapInPandas(tile, PART)
    while True:
        parts = parts.withColumn("up", F.floor(F.col("sb") / FAN_IN).cast("int")).groupBy("dim", "qb", "up").applyInPandas(merge, PART)
        if shards <= FAN_IN:
            break
        shards = -(-shards // FAN_IN)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                qi = np.frombuffer(r.ids, "<i8")
                a, b = np.frombuffer(r.top_ids, "<i8"), np.frombuffer(r.top_scores, "<i8")
                out = pd.DataFrame({"query_id": np.repeat(qi, k), "rank": np.tile(np.arange(1, k + 1, dtype="int32"), len(qi)), "vec_id": a, "score": b})
                yield out[b > np.iinfo(np.int64).min]

    return parts.mapInPandas(rows, "query_id long, rank int, vec_id long, score long")


def quantised(embeddings: DataFrame, scale: float = 64.0) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; rows without a usable vector or id are left out."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    ok = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ok)
    return e.select("vec_id", F.transform("embedding", lambda c: F.floor(F.lit(scale) * c).cast("long")).alias("v"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk(quantised(read(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)


OP4_SQL = """
WITH e AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id) AS rank
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0) WHERE rank <= 20
"""
