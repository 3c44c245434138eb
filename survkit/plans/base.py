"""Query registry and the shared derived tables.

Each registered query is a function ``(spark, sf_dir) -> DataFrame`` built
only from DataFrame / SQL operators on the given tables.  Its DuckDB oracle
(when the operator is SQL-expressible) is registered next to it, written on
top of the same derived tables expressed as CTEs (``PRELUDE``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import clean as C
from ..operators import integrate as I
from ..sources import fixtures as FX

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
ROWS_ONLY: set[str] = set()


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` (DuckDB) omitted means rows-only check."""

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        else:
            ROWS_ONLY.add(name)
        return fn

    return deco


class Data:
    """Derived tables of one data directory: lazy plans, but for the stored ones (``all_c_stored``, ``obs``)."""

    def __init__(self, spark: SparkSession, sf_dir: str, study: S.Study = S.DEFAULT_STUDY):
        self.spark = spark
        self.sf_dir = sf_dir
        self.study = study

    def table(self, name: str) -> DataFrame:
        return FX.table(self.spark, self.sf_dir, name)

    @property
    def assets(self) -> DataFrame:
        return FX.assets(self.spark, self.sf_dir)

    def failures(self, clean: bool = True) -> DataFrame:
        return FX.failures(self.spark, self.sf_dir, clean=clean)

    @property
    def events(self) -> DataFrame:
        """Master events: the failure rows of the full master table.

        In the fixture every failure belongs to a known asset, so the inner
        join equals the left join's rows with a failure; deriving it by a
        filter lets both tables share one join (and one exchange) per plan.
        """
        from pyspark.sql import functions as F

        return self.all.filter(F.col(S.FAILED_AT).isNotNull())

    @property
    def all(self) -> DataFrame:
        """Master all: failures plus never-failed assets."""
        if getattr(self, "_all", None) is None:
            self._all = FX.master_tables(self.spark, self.sf_dir)[1]
        return self._all

    @property
    def events_integrated(self) -> DataFrame:
        """Master events by the integration operator (failure file x asset file on region + key)."""
        return I.master_events(self.failures(), self.assets)

    @property
    def all_integrated(self) -> DataFrame:
        return I.master_all(self.failures(), self.assets)

    @property
    def events_c(self) -> DataFrame:
        """Cleaned failure rows with year columns."""
        if getattr(self, "_events_c", None) is None:
            self._events_c = C.with_years(C.clean(self.events))
        return self._events_c

    @property
    def all_c(self) -> DataFrame:
        """Cleaned rows of the full table (failures + survivors) with years."""
        if getattr(self, "_all_c", None) is None:
            self._all_c = C.with_years(C.clean(self.all))
        return self._all_c

    @property
    def all_c_stored(self) -> DataFrame:
        """``all_c`` written once to the shared folder (for queries that scan it several
        times: bin edges, quantiles, then the main aggregate)."""
        if getattr(self, "_all_c_stored", None) is None:
            from ..session import ensure_checkpoint_dir, store

            ensure_checkpoint_dir(self.spark)
            self._all_c_stored = store(self.all_c, "all-c")
        return self._all_c_stored

    def once(self) -> Data:
        """Let ``all_c`` and ``events_c`` read the stored table: the master join then runs once per query."""
        self._all_c = self.all_c_stored
        self._events_c = self._all_c.filter(F.col(S.FAILED_AT).isNotNull())
        return self

    @property
    def obs(self) -> DataFrame:
        """Per-region observation window, written once per query to the shared folder."""
        if getattr(self, "_obs", None) is None:
            from ..operators.episodes import obs_window
            from ..session import ensure_checkpoint_dir, store

            ensure_checkpoint_dir(self.spark)
            self._obs = store(obs_window(self.all_c), "obs-window")
        return self._obs


# Names of the given tables' regions and of the cleaned material / period values (fixed by their rule).
REGIONS = [f"NATION_{k}" for k in range(25)]
MATERIAL_AGES = [f"{m}{y}" for m in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY") for y in range(1995, 2003, 2)]

# DuckDB text of the same derivation.  Every oracle query starts with it.
PRELUDE = """
WITH assets AS (
  SELECT n.n_name AS region, o.o_orderkey AS asset_id, o.o_orderdate AS installed_at,
         o.o_totalprice AS size_mm, c.c_mktsegment AS material,
         CASE WHEN o.o_orderpriority = '4-NOT SPECIFIED' THEN 'r'
              ELSE c.c_mktsegment || CAST(CAST(1995 + 2 * floor((year(o.o_orderdate) - 1995) / 2) AS BIGINT) AS VARCHAR)
         END AS material_age
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
),
failures AS (
  SELECT a.region, l.l_orderkey AS asset_id, l.l_shipdate AS failed_at
  FROM lineitem l JOIN assets a ON l.l_orderkey = a.asset_id
  WHERE l.l_returnflag = 'R' AND l.l_shipdate >= a.installed_at
),
failures_raw AS (
  SELECT a.region, l.l_orderkey AS asset_id, l.l_shipdate AS failed_at
  FROM lineitem l JOIN assets a ON l.l_orderkey = a.asset_id
  WHERE l.l_returnflag = 'R'
),
master_events AS (
  SELECT f.region, a.asset_id, a.installed_at, a.size_mm, a.material, a.material_age, f.failed_at,
         f.region || '_' || CAST(a.asset_id AS VARCHAR) AS id
  FROM failures f JOIN assets a ON f.region = a.region AND f.asset_id = a.asset_id
),
master_all AS (
  SELECT coalesce(f.region, a.region) AS region, a.asset_id, a.installed_at, a.size_mm, a.material,
         a.material_age, f.failed_at,
         coalesce(f.region, a.region) || '_' || CAST(a.asset_id AS VARCHAR) AS id
  FROM failures f FULL OUTER JOIN assets a ON f.region = a.region AND f.asset_id = a.asset_id
),
ev_c AS (
  SELECT *, CAST(year(installed_at) AS INTEGER) AS install_year, CAST(year(failed_at) AS INTEGER) AS failure_year
  FROM master_events
  WHERE material IS DISTINCT FROM 'INCONNU' AND material_age IS DISTINCT FROM 'r'
),
all_c AS (
  SELECT *, CAST(year(installed_at) AS INTEGER) AS install_year, CAST(year(failed_at) AS INTEGER) AS failure_year
  FROM master_all
  WHERE material IS DISTINCT FROM 'INCONNU' AND material_age IS DISTINCT FROM 'r'
)
"""


def sql(body: str, ctes: str = "") -> str:
    """Oracle SQL: the prelude, optional extra CTEs (each ``name AS (...)``), then the body."""
    extra = (",\n" + ctes.strip().rstrip(",")) if ctes.strip() else ""
    return PRELUDE.rstrip() + extra + "\n" + body.strip()
