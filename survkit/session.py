"""Spark session helpers.

The library never creates a cluster session on its own; it configures the
one it is given.  ``local_session`` is for tests and the bench only.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job of the library relies on.  AQE re-plans joins at runtime
# (broadcast only when the materialised side is measured small), coalesces
# tiny shuffle partitions and splits skewed join partitions.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "survkit") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in RECOMMENDED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is configured by the operator and is read from the
    session, from the configuration or from ``setCheckpointDir``.  Only on a
    local master (tests, bench) a fresh private folder is taken when it is
    unset; elsewhere executors would not share it, so that is an error.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        current = sc.getCheckpointDir()
    if not current and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not current:
        current = tempfile.mkdtemp(prefix="survkit-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", current)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for materialised tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def store(df, name: str = "stored"):
    """Write ``df`` once as parquet under the shared checkpoint folder and scan it back.

    Used for inputs read several times: the plan upstream runs exactly once
    (an RDD checkpoint of an unpersisted plan computes it twice), the lineage
    is cut (a lost executor costs a re-read, not a recomputation), and later
    reads get parquet column pruning and filter pushdown.
    """
    import uuid

    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def input_bytes(spark: SparkSession, path: str) -> int:
    """Total size of the files under ``path`` (Hadoop file system listing, no scan)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(hpath).getLength())


def cluster_settings(total_input_bytes: int, input_per_shuffle_partition: int = 1 << 30,
                     scan_split_bytes: int = 512 << 20, advisory_bytes: int = 256 << 20) -> dict[str, str]:
    """Shuffle / scan sizing for a cluster run (apply when the session is built).

    Shuffled bytes are a fraction of the (columnar, compressed) input, so one
    initial shuffle partition per GiB of input keeps a reduce task well inside
    executor memory (100 TB -> ~100k partitions); AQE then coalesces small
    partitions and splits skewed ones against the advisory size.
    """
    parts = max(200, -(-total_input_bytes // input_per_shuffle_partition))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(advisory_bytes),
        "spark.sql.files.maxPartitionBytes": str(scan_split_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * advisory_bytes),
        **RECOMMENDED_CONF,
    }
