"""Helpers shared by the text operators: shared-folder tables, word splitting, hashing, components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word: digits, letters a-z (after lower-casing A-Z) and every character beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The same split for UTF-8 bytes: upper case to lower case, every other ASCII byte that is no word character to a blank.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where it is unset and the master is local, a fresh one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="survkit-llm-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: Write options for rows of some megabytes: by default a file's buffered bytes are looked at every 100 rows only, and
#: a reader takes up to 4,096 rows of a row group at once. With these a row group has few such rows.
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def store(df: DataFrame, name: str, large_rows: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: computed once, lineage cut, safe to lose executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.options(compression="zstd", **(LARGE_ROWS if large_rows else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_fields(df: DataFrame, **types: str) -> StructType:
    """The schema of ``df`` with further fields."""
    out = StructType(list(df.schema.fields))
    for name, kind in types.items():
        out = out.add(name, kind)
    return out


def sealed(docs: DataFrame, *own: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` with its columns ``own`` and one more, which holds all others; and the way back.

    An operator then sees no name but those it knows, whatever the table's other columns are called. The function
    returned gives a frame its columns back in their old order, followed by further columns named in the call.
    """
    rest = {c: f"c{i}" for i, c in enumerate(docs.columns) if c not in own}
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    packed = F.struct(*[quoted(c).alias(n) for c, n in rest.items()], F.lit(None).cast("int").alias("none")).alias("sealed")

    def opened(df: DataFrame, *more: str) -> DataFrame:
        return df.select(*[F.col("sealed")[rest[c]].alias(c) if c in rest else F.col(c) for c in docs.columns if c not in more], *more)

    return docs.select(*[c for c in docs.columns if c in own], packed), opened


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores in front until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def words_col(text: Column) -> Column:
    """Array of the lower-cased words of a text (null text: no words)."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def word_list(text: str | None) -> list[bytes]:
    """The same words as UTF-8 bytes, in Python."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (null id: remainder null)."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(n)


class WordHash(dict):
    """word -> 64-bit hash; a cache that starts anew when it holds ``most`` words."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, w: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


WORD_HASH = WordHash()


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit changes every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def block_id(n: int, *cols: str) -> Column:
    """A number from 0 to n-1 that depends on the row's values alone, so a repeated task deals alike."""
    return F.pmod(F.xxhash64(*cols), F.lit(n))


def _with_least(e: DataFrame, salts: int) -> DataFrame:
    """(u, v, m): every edge with the least of u and all of u's neighbours.

    A hub's edges are dealt by a hash of v: least ones per (u, salt), then per u, which goes back to the (u, salt)
    groups, at most ``salts`` rows of a node; the edges meet it there, not all of a hub's in one task.
    """
    e = e.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int"))
    part = e.groupBy("u", "s").agg(F.min("v").alias("low"))
    low = part.groupBy("u").agg(F.least(F.min("low"), F.col("u")).alias("m"))
    return e.join(part.select("u", "s").join(low, "u"), ["u", "s"]).select("u", "v", "m")


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "cc", salt_edges: int = 1 << 18) -> DataFrame:
    """Connected components of an edge list: (node, root), root the least node; nodes without an edge are absent.

    Alternating large-star and small-star steps on a table in the shared folder: a logarithmic number of
    rounds, each an aggregation and a join on the node. A hub's edges are dealt over salts, whose number grows
    with the edges (one more for every ``salt_edges``), in the aggregation and in the join.
    """
    e = store(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), name)
    salts = 16 + e.count() // salt_edges
    sums = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        down = _with_least(both, salts).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # here every v is less than its u, so m is the least neighbour
        small = _with_least(down, salts).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = store(small.where("u <> v").distinct(), name)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == sums:
            break
        sums = now
    roots = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
