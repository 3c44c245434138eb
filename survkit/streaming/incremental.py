"""Incremental failure counts over arriving per-region failure files.

The same count as ``failures_by_region_year`` maintained by Structured
Streaming: failure files dropped into a folder are read as a stream, joined
to the (static) asset table, and counted per (region, failure year).  The
state is one counter per (region, year); the checkpoint lives in the shared
folder, so a restarted query resumes without double counting.

A micro-batch takes files up to a number of bytes, not of files: each batch
joins the whole asset table, so many small files must not mean many batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..sources.files import FAILURE_KIND, SEP, TS_FORMAT

#: Bytes of new files in one micro-batch, about.
BATCH_BYTES = 8 << 30


def failure_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Failure files that arrive in the region folders below ``folder``; other kinds are passed over."""
    sch = T.StructType(list(S.FAILURE_SCHEMA.fields) + [T.StructField("region", T.StringType())])
    return (
        spark.readStream.schema(sch).option("sep", SEP).option("header", True)
        .option("timestampFormat", TS_FORMAT).option("timestampNTZFormat", TS_FORMAT).option("maxBytesPerTrigger", BATCH_BYTES)
        .option("pathGlobFilter", f"*{FAILURE_KIND}*").csv(folder)
    )


def counts_by_region_year(stream: DataFrame, assets: DataFrame) -> DataFrame:
    f = stream.select(F.col("region").alias(S.REGION), F.col("IDTC").alias(S.ASSET_ID), F.col("DDCC").alias(S.FAILED_AT))
    ev = f.join(assets.select(S.REGION, S.ASSET_ID), [S.REGION, S.ASSET_ID], "inner")
    return ev.groupBy(S.REGION, F.year(S.FAILED_AT).alias(S.FAILURE_YEAR)).agg(F.count(F.lit(1)).alias("n"))


def run_to_table(counts: DataFrame, out_path: str, checkpoint: str) -> None:
    """Process everything available now; each micro-batch rewrites the current totals to ``out_path``."""

    def write_batch(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out_path)

    q = (
        counts.writeStream.outputMode("complete")
        .foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
