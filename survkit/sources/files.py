"""Per-region source files: ';'-separated asset ("pipes") and failure ("events") files in a tree of folders.

Discovery walks the whole tree below a root, as the listing of a recursive scan: a folder belongs to the study if
its path holds a tag; its own name is the region; a file's kind is in its name, and files of both kinds lie in one
folder.  Everything else in the tree is passed over.  Reading is one multi-file scan per kind with a declared
schema (no inference, headers are checked against it); each row's region comes from the path of its file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S

SEP = ";"
TS_FORMAT = "yyyy-MM-dd HH:mm:ss"


ASSET_KIND, FAILURE_KIND = "pipes", "events"
OPTIONS = dict(sep=SEP, header=True, timestampFormat=TS_FORMAT, timestampNTZFormat=TS_FORMAT)


def write_region_files(assets: DataFrame, failures: DataFrame, root: str, tag: str = "clean") -> str:
    """Write assets and failures as per-region ';' CSV files in the source column names: <root>/<tag>/region=<name>/<kind>-*.csv."""
    base = f"{root.rstrip('/')}/{tag}"
    a = assets.select(
        F.col(S.REGION).alias("region"),
        F.col(S.ASSET_ID).alias("IDT"),
        F.col(S.INSTALLED_AT).cast("timestamp_ntz").alias("DDP"),
        F.col(S.SIZE).alias("DIAMETRE"),
        F.col(S.MATERIAL).alias("MATERIAU"),
        F.col(S.MATERIAL_AGE).alias("MATAGE"),
    )
    f = failures.select(
        F.col(S.REGION).alias("region"),
        F.col(S.ASSET_ID).alias("IDTC"),
        F.col(S.FAILED_AT).cast("timestamp_ntz").alias("DDCC"),
    )
    for kind, rows in ((ASSET_KIND, a), (FAILURE_KIND, f)):
        # the writers' file names start with the kind
        rows.write.mode("append").partitionBy("region").option("mapreduce.output.basename", kind).options(**OPTIONS).csv(base)
    return base


def discover(spark: SparkSession, root: str, tag: str, first_only: bool = False) -> DataFrame:
    """(region, kind, path) of the files below ``root`` in folders whose path holds ``tag``.

    A folder that has files must have some of each kind.  If folders share a name, the last in path order counts.
    ``first_only`` takes the first file of a kind by name, for trees that keep other versions beside it; else all
    files of a kind are parts of one table.  Only the listing is read, no file.
    """
    # the folder names above the root don't count for the tag
    top = F.lit(root.rstrip("/").rpartition("/")[2])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    files = files.select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"))
    below = F.element_at(F.split("folder", F.concat(F.lit("/\\Q"), top, F.lit("\\E(?=/|$)")), 2), 2)
    files = files.where(F.contains(below, F.lit(tag)))
    kind = F.when(F.contains("name", F.lit(FAILURE_KIND)), FAILURE_KIND).when(F.contains("name", F.lit(ASSET_KIND)), ASSET_KIND)
    files = files.withColumn("kind", kind).withColumn("region", region_of("folder"))
    lacking = files.groupBy("folder").agg(F.collect_set("kind").alias("kinds")).where(F.size("kinds") < 2).select("folder").limit(1).collect()
    if lacking:
        raise ValueError(f"{lacking[0][0]} has no file of one of the kinds {ASSET_KIND}, {FAILURE_KIND}")
    files = files.where(F.col("kind").isNotNull()).withColumn("_last", F.max("folder").over(Window.partitionBy("region"))).where("folder = _last")
    if first_only:
        files = files.withColumn("_first", F.min("name").over(Window.partitionBy("folder", "kind"))).where("name = _first")
    return files.select("region", "kind", "path")


def region_of(folder: str | Column) -> Column:
    """A folder's own name, without the column name of a partition folder."""
    return F.regexp_replace(F.regexp_extract(folder, "([^/]*)$", 1), "^[A-Za-z_]+=", "")


def read_region_files(spark: SparkSession, root: str, tag: str, first_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(assets, failures) of the discovered files, in the master column names."""
    found = discover(spark, root, tag, first_only).collect()  # the list of files, which a scan's planning holds anyway
    # a row's file is a URI: undo its escapes, a plus sign is no blank there
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    region = region_of(F.regexp_extract(path, "^(.*)/[^/]*$", 1)).alias(S.REGION)

    def scan(kind: str, schema: T.StructType) -> DataFrame:
        paths = sorted(r["path"] for r in found if r["kind"] == kind)
        if not paths:
            return spark.createDataFrame([], schema).withColumn(S.REGION, F.lit(None).cast("string"))
        return spark.read.schema(schema).options(**OPTIONS, enforceSchema=False).csv(paths).select("*", region)

    assets = scan(ASSET_KIND, S.ASSET_SCHEMA).select(
        S.REGION,
        F.col("IDT").alias(S.ASSET_ID),
        F.col("DDP").alias(S.INSTALLED_AT),
        F.col("DIAMETRE").alias(S.SIZE),
        F.col("MATERIAU").alias(S.MATERIAL),
        F.col("MATAGE").alias(S.MATERIAL_AGE),
    )
    failures = scan(FAILURE_KIND, S.FAILURE_SCHEMA).select(S.REGION, F.col("IDTC").alias(S.ASSET_ID), F.col("DDCC").alias(S.FAILED_AT))
    return assets, failures
