"""Column roles of the asset / failure data model and the study parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Master-table column names.
REGION = "region"
ASSET_ID = "asset_id"
INSTALLED_AT = "installed_at"
SIZE = "size_mm"
MATERIAL = "material"
MATERIAL_AGE = "material_age"
FAILED_AT = "failed_at"
ID = "id"

# Derived columns.
INSTALL_YEAR = "install_year"
FAILURE_YEAR = "failure_year"
OBS_START = "obs_start"
OBS_END = "obs_end"
START = "last_failure_year"
EVENT = "event"
DURATION = "duration"
REPAIRS = "repairs"

# Values of the source format (fixed values: the sentinel for an unknown
# material, the junk marker of the material/period column).
UNKNOWN_MATERIAL = "INCONNU"
JUNK_MATERIAL_AGE = "r"

ASSET_SCHEMA = T.StructType(
    [
        T.StructField("IDT", T.LongType()),
        T.StructField("DDP", T.TimestampNTZType()),
        T.StructField("DIAMETRE", T.DoubleType()),
        T.StructField("MATERIAU", T.StringType()),
        T.StructField("MATAGE", T.StringType()),
    ]
)

FAILURE_SCHEMA = T.StructType(
    [
        T.StructField("IDTC", T.LongType()),
        T.StructField("DDCC", T.TimestampNTZType()),
    ]
)


@dataclass(frozen=True)
class Study:
    """Parameters of an out-of-time study.

    cutoff: first year that is not known yet (training sees years < cutoff).
    init: assumed history length used by the episode-start variants.
    horizon: number of years after the cutoff that make the label.
    """

    cutoff: int = 1999
    init: int = 1
    horizon: int = 2


DEFAULT_STUDY = Study()
