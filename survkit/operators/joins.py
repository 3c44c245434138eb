"""Joins against small lookup tables, with a measured size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, store

# A lookup of more rows or bytes than these is not broadcast; the salted shuffle join takes over.
MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 << 20
# Parts that the rows of one key are dealt into by the shuffle join.
SALTS = 32
# Blocks of members along each side of a pair join.
PAIR_BLOCKS = 16


def measured(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of a stored table: values as text, field names included, plus 16 bytes per value."""
    width = F.octet_length(F.to_json(F.struct(*df.columns))) + F.lit(16 * len(df.columns))
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(width.cast("long")).alias("b")).first()
    return r["n"], r["b"] or 0


def join_lookup(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", max_rows: int = MAX_BROADCAST_ROWS,
                materialized: bool = False, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Join (left or inner) ``big`` to a lookup table that is usually small (one row per region, ...).

    The lookup is written once to the shared checkpoint folder, measured
    exactly, and broadcast only when its rows and bytes are within bounds.  A
    broadcast keeps ``big`` where it is: no exchange on a low-cardinality key
    (which would put each region -- possibly a third of all rows -- in one
    task) and the current partitioning (e.g. by asset id) survives the join.
    Beyond the bounds each key's rows of ``big`` are dealt into ``SALTS``
    parts by their own values and the lookup is repeated per part.
    ``materialized`` says the lookup is already written (only measured here).
    """
    if how not in ("left", "inner"):
        raise ValueError("a lookup join is left or inner")
    if not materialized:
        ensure_checkpoint_dir(small.sparkSession)
        small = store(small, "lookup")
    rows, size = measured(small)
    if rows <= max_rows and size <= max_bytes:
        return big.join(F.broadcast(small), on, how)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(SALTS)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def ordered_pairs(a: DataFrame, b: DataFrame, left: str, right: str, part: list[str], blocks: int = PAIR_BLOCKS) -> DataFrame:
    """Rows of ``a`` and ``b`` of one ``part`` with ``left`` < ``right``: the pairs of a member list.

    Members are dealt into blocks and a pair of blocks is one join key, so
    the pairs of one part are spread over blocks x blocks keys.
    """
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    x = a.withColumn("_x", F.pmod(F.xxhash64(left), F.lit(blocks)).cast("int")).withColumn("_y", every)
    y = b.withColumn("_y", F.pmod(F.xxhash64(right), F.lit(blocks)).cast("int")).withColumn("_x", every)
    return x.join(y, [*part, "_x", "_y"]).filter(F.col(left) < F.col(right)).drop("_x", "_y")
