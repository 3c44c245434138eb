"""Seeded column permutations, JVM-side, without sorted draws or a global row number on one task.

1. rows get a dense index 0..n-1 in the order of a hash of their keys, by a distributed running count: the index
   depends on the rows alone, not on how they are partitioned;
2. a permutation of 0..n-1 is a column expression, a keyed bijection: each of some rounds may swap the index with
   its mirror image key - index (modulo n); whether it does depends on a hash of the greater of the two, so both
   decide alike and every round is its own inverse, for any n;
3. the row with index i borrows the feature value of the row whose index is the image of i.

Columns of short numbers, such as bins, need neither the bijection nor the join: how many rows have each value is a
bounded table, and the values are dealt like cards.  Blocks of consecutive indices are dealt their numbers of each value
(multivariate hypergeometric, on the driver), then each block shuffles its own cards: together a uniformly random
permutation of all rows, by index and seed alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir, store
from .cumulative import running_sums

_RID = "_rid"
#: Rounds of the bijection.
ROUNDS = 48
#: A block that shuffles its values has so many rows at least and at most; rows that are handed on at once.
LEAST_BLOCK, MOST_BLOCK, AT_ONCE = 10_000, 250_000, 10_000


def permuted(index: Column, n: int, *key: Column | int, rounds: int = ROUNDS) -> Column:
    """The image of ``index`` (0..n-1) under a permutation chosen by ``key``."""
    key = [k if isinstance(k, Column) else F.lit(k) for k in key]

    def swap(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(r, *key), F.lit(n)) - x, F.lit(n))
        top = F.greatest(x, mirror)
        return F.when(F.xxhash64(top, r, *key).bitwiseAND(F.lit(1)) == 1, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index.cast("long"), swap)


def with_dense_index(df: DataFrame, keys: list[str], name: str = _RID) -> DataFrame:
    """``df`` with an index 0..n-1 in the order of a hash of the keys (equal rows in any order)."""
    ensure_checkpoint_dir(df.sparkSession)
    ties = [*keys, *[c for c in df.columns if c not in keys]]
    tagged = df.withColumn("_order", F.xxhash64(*keys)).withColumn("_one", F.lit(1).cast("long"))
    idx = running_sums(tagged, "_order", ["_one"], ties=ties)
    return store(idx.withColumn(name, F.col("cum__one") - 1).drop("_one", "cum__one", "_order"), "indexed")


def permuted_copies(df: DataFrame, features: list[str], repeats: int, keys: list[str], seed: int = 0) -> DataFrame:
    """Union of copies of ``df`` with one feature permuted: columns + feature (name) + repeat."""
    indexed = with_dense_index(df, keys)
    n = indexed.count()
    types = dict(df.dtypes)
    if all(types[f] in ("tinyint", "smallint") for f in features):
        return _dealt_copies(indexed, df.columns, features, repeats, seed, n)
    repeat = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat")
    copies = indexed.select("*", repeat)
    parts = []
    for i, f in enumerate(features):
        src = indexed.select(F.col(_RID).alias("_src"), F.col(f).alias("_val"))
        to = copies.withColumn("_src", permuted(F.col(_RID), max(n, 1), F.lit(i), F.col("repeat"), seed))
        copy = to.join(src, "_src").withColumn(f, F.col("_val"))
        parts.append(copy.select(F.lit(f).alias("feature"), "repeat", *df.columns))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _dealt(counts: np.ndarray, sizes: list[int], seed: list[int]) -> np.ndarray:
    """Of cards with these counts per value, how many of each the blocks of these sizes get."""
    rng, left, out = np.random.default_rng(seed), counts.copy(), []
    for size in sizes:
        out.append(rng.multivariate_hypergeometric(left, size, method="marginals"))
        left -= out[-1]
    return np.array(out).reshape(len(sizes), len(counts))


def _dealt_copies(indexed: DataFrame, columns: list[str], features: list[str], repeats: int, seed: int, n: int) -> DataFrame:
    """The copies where every feature is a column of short numbers; a null is a value of its own."""
    some = [F.struct(F.lit(k).alias("feature"), F.col(f).cast("int").alias("value")) for k, f in enumerate(features)]
    per = indexed.select(F.explode(F.array(*some)).alias("x")).groupBy("x.feature", "x.value").count().collect()
    values = [sorted(((r["value"], r["count"]) for r in per if r["feature"] == k), key=lambda v: (v[0] is not None, v[0])) for k in range(len(features))]
    size = min(max(n // 64, LEAST_BLOCK), MOST_BLOCK)
    sizes = [min(size, n - s) for s in range(0, n, size)]
    # numbers per feature, repeat, block and value; a block of the greatest size has a few thousand of them
    cards = {(k, r): _dealt(np.array([c for _, c in v], np.int64), sizes, [seed, k, r]).astype("<u4") for k, v in enumerate(values) for r in range(repeats)}
    hands = indexed.sparkSession.sparkContext.broadcast(cards)
    own = [pa.array([v for v, _ in some], pa.int16()) for some in values]
    kept = [f.name for f in indexed.schema.fields if f.name in columns]

    def shuffled(key: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, t = key[0].as_py(), pa.Table.from_batches(rows).sort_by(_RID)
        plain = {c: t.column(c).combine_chunks() for c in kept}
        for k, f in enumerate(features):
            for r in range(repeats):
                hand = np.repeat(np.arange(len(own[k])), hands.value[k, r][no])
                np.random.default_rng([seed, k, r, no]).shuffle(hand)
                copy = plain | {f: own[k].take(pa.array(hand)).cast(plain[f].type)}
                for s in range(0, len(hand), AT_ONCE):
                    m = min(AT_ONCE, len(hand) - s)
                    out = {"feature": pa.repeat(pa.scalar(f), m), "repeat": pa.repeat(pa.scalar(r, pa.int32()), m), **{c: copy[c].slice(s, m) for c in columns}}
                    yield pa.RecordBatch.from_pydict(out)

    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("repeat", T.IntegerType()), *[indexed.schema[c] for c in columns]])
    if not n:
        return indexed.sparkSession.createDataFrame([], schema)
    blocks = indexed.withColumn("_block", F.floor(F.col(_RID) / F.lit(size)).cast("int"))
    # a number of tasks of their own: the exchange is small, what it leads to is many times larger
    return blocks.repartition(min(len(sizes), max(200, len(sizes) // 8)), "_block").groupBy("_block").applyInArrow(shuffled, schema)
