"""L2 descriptive queries: counts, bins, cross-tabs, rates, grids."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.scalar import category_code, clamp_low, safe_ratio
from ..operators import bins as B
from ..operators import clean as C
from ..operators import counts as K
from ..operators.quantiles import grouped_quantiles_discrete
from ..session import store
from .base import REGIONS, Data, query, sql

# Fixture parameters (FIXTURES.md): install years of the fixture start in
# 1995, so the low-year clamp uses 1997 in place of the source's 1930.
CLAMP_YEAR = 1997
SIZE_CAP = 20000.0


def _bin_sql(x: str, edges_list: str, n: int) -> str:
    """SQL bin number from a DuckDB list of n+1 edges (1-based lists)."""
    return B.sql_bin(x, [f"{edges_list}[{k + 1}]" for k in range(1, n)])


def _label_sql(bin_col: str, edges_list: str, lowest: bool = False) -> str:
    return f"CASE WHEN {bin_col} IS NULL THEN 'nan' ELSE ({B.sql_labels(edges_list, lowest)})[{bin_col}] END"


def _ew_edges_sql(x: str, src: str, n: int, name: str) -> str:
    """CTE: one row with the list of n+1 equal-width edges of x over src."""
    inner = ", ".join(f"mn + {k} * ((mx - mn) / {n})" for k in range(1, n))
    return f"""{name} AS (
      SELECT [mn - 0.001 * (mx - mn), {inner}, mx] AS e
      FROM (SELECT CAST(min({x}) AS DOUBLE) AS mn, CAST(max({x}) AS DOUBLE) AS mx FROM {src}))"""


def _q_edges_sql(x: str, src: str, q: int, name: str) -> str:
    probs = ", ".join(str(k / q) for k in range(q + 1))
    return f"{name} AS (SELECT quantile_cont({x}, [{probs}]) AS e FROM {src})"


# ---------------------------------------------------------------- A1 - A4

@query(
    "count_by_region",
    sql("SELECT region, count(*) AS n FROM ev_c WHERE region IS NOT NULL GROUP BY region"),
)
def count_by_region(spark, sf_dir):
    return K.count_by(Data(spark, sf_dir).events_c, [S.REGION])


@query(
    "failures_by_region_year",
    sql(
        """SELECT region, failure_year, count(*) AS n FROM ev_c
           WHERE region IS NOT NULL AND failure_year IS NOT NULL GROUP BY region, failure_year"""
    ),
)
def failures_by_region_year(spark, sf_dir):
    return K.count_by(Data(spark, sf_dir).events_c, [S.REGION, S.FAILURE_YEAR])


@query(
    "mean_size_by_region",
    sql("SELECT region, avg(size_mm) AS mean_size FROM ev_c WHERE region IS NOT NULL GROUP BY region"),
)
def mean_size_by_region(spark, sf_dir):
    ev = Data(spark, sf_dir).events_c.filter(F.col(S.REGION).isNotNull())
    return ev.groupBy(S.REGION).agg(F.avg(S.SIZE).alias("mean_size"))


@query(
    "materials_by_region",
    sql(
        """SELECT region, list_sort(list(DISTINCT material) FILTER (WHERE material IS NOT NULL)) AS materials
           FROM ev_c WHERE region IS NOT NULL GROUP BY region"""
    ),
)
def materials_by_region(spark, sf_dir):
    ev = Data(spark, sf_dir).events_c.filter(F.col(S.REGION).isNotNull())
    return ev.groupBy(S.REGION).agg(F.sort_array(F.collect_set(S.MATERIAL)).alias("materials"))


# ---------------------------------------------------------------- scalar rows

@query(
    "clamp_year",
    sql(f"SELECT id, install_year, greatest(install_year, {CLAMP_YEAR}) AS install_year_clamped FROM all_c"),
)
def clamp_year(spark, sf_dir):
    a = Data(spark, sf_dir).all_c
    return a.select(S.ID, S.INSTALL_YEAR, clamp_low(S.INSTALL_YEAR, CLAMP_YEAR).alias("install_year_clamped"))


@query(
    "lifetime",
    sql("SELECT id, failed_at, failure_year - install_year AS lifetime FROM ev_c"),
)
def lifetime(spark, sf_dir):
    ev = Data(spark, sf_dir).events_c
    return ev.select(S.ID, S.FAILED_AT, (F.col(S.FAILURE_YEAR) - F.col(S.INSTALL_YEAR)).alias("lifetime"))


# Codes for the fixture's five segments; anything else takes the default.
SEGMENT_CODES = {"AUTOMOBILE": "A1", "BUILDING": "B1", "HOUSEHOLD": "H1", "MACHINERY": "M1"}
DEFAULT_CODE = "X0"


@query(
    "category_code",
    sql(
        "SELECT material, CASE material "
        + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEGMENT_CODES.items())
        + f" ELSE '{DEFAULT_CODE}' END AS code FROM (SELECT DISTINCT material FROM all_c)"
    ),
)
def category_code_q(spark, sf_dir):
    m = Data(spark, sf_dir).all_c.select(S.MATERIAL).distinct()
    return m.select(S.MATERIAL, category_code(S.MATERIAL, SEGMENT_CODES, DEFAULT_CODE).alias("code"))


@query(
    "distinct_values",
    sql(
        """SELECT DISTINCT 'material' AS column_name, material AS value FROM all_c WHERE material IS NOT NULL
           UNION ALL SELECT DISTINCT 'material_age', material_age FROM all_c WHERE material_age IS NOT NULL
           UNION ALL SELECT DISTINCT 'region', region FROM all_c WHERE region IS NOT NULL"""
    ),
)
def distinct_values(spark, sf_dir):
    cols = [S.MATERIAL, S.MATERIAL_AGE, S.REGION]
    a = Data(spark, sf_dir).all_c.select(*cols).distinct()
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in cols]))
    return a.select(pairs.alias("p")).select("p.*").filter(F.col("value").isNotNull()).distinct()


# ---------------------------------------------------------------- bins B1-B4

@query(
    "bin_equal_width",
    sql(
        f"""SELECT region, asset_id, failed_at, install_year,
                   {_bin_sql('install_year', 'e', 10)} AS year_bin,
                   {_label_sql(_bin_sql('install_year', 'e', 10), 'e')} AS year_range
            FROM ev_c CROSS JOIN ye""",
        _ew_edges_sql("install_year", "ev_c", 10, "ye"),
    ),
)
def bin_equal_width(spark, sf_dir):
    ev = Data(spark, sf_dir).events_c
    out = B.cut(ev, S.INSTALL_YEAR, 10, "year")
    return out.select(S.REGION, S.ASSET_ID, S.FAILED_AT, S.INSTALL_YEAR, "year_bin", "year_range")


@query(
    "bin_quantile",
    sql(
        f"""SELECT region, asset_id, failed_at, size_mm,
                   {_bin_sql('size_mm', 'e', 5)} AS size_bin,
                   {_label_sql(_bin_sql('size_mm', 'e', 5), 'e', True)} AS size_range
            FROM all_c CROSS JOIN qe""",
        _q_edges_sql("size_mm", "all_c", 5, "qe"),
    ),
)
def bin_quantile(spark, sf_dir):
    a = Data(spark, sf_dir).all_c_stored
    out = B.qcut(a, S.SIZE, 5, "size")
    return out.select(S.REGION, S.ASSET_ID, S.FAILED_AT, S.SIZE, "size_bin", "size_range")


@query(
    "log_bins",
    sql(
        f"""SELECT region, asset_id, failed_at, {_bin_sql('ln(size_mm)', 'e', 5)} AS log_size_bin
            FROM ev_c CROSS JOIN le""",
        _ew_edges_sql("ln(size_mm)", "ev_c", 5, "le"),
    ),
)
def log_bins(spark, sf_dir):
    ev = Data(spark, sf_dir).events_c
    x = F.log(F.col(S.SIZE))
    edges = B.equal_width_edges(ev, x, 5)
    return ev.select(S.REGION, S.ASSET_ID, S.FAILED_AT, B.bin_expr(x, edges).alias("log_size_bin"))


# ---------------------------------------------------------------- A6 / A7

@query(
    "failures_by_material_yearbin",
    sql(
        f"""SELECT material, {_bin_sql('install_year', 'e', 10)} AS year_bin, count(*) AS n
            FROM ev_c CROSS JOIN ye WHERE material IS NOT NULL GROUP BY ALL""",
        _ew_edges_sql("install_year", "ev_c", 10, "ye"),
    ),
)
def failures_by_material_yearbin(spark, sf_dir):
    ev = B.cut(Data(spark, sf_dir).events_c, S.INSTALL_YEAR, 10, "year")
    return K.count_by(ev, [S.MATERIAL, "year_bin"]).select(S.MATERIAL, "year_bin", "n")


_EV_NZ = "ev_nz AS (SELECT * FROM ev_c WHERE size_mm IS DISTINCT FROM 0)"


@query(
    "failures_by_material_sizebin",
    sql(
        f"""SELECT material, {_bin_sql('size_mm', 'e', 10)} AS size_bin, count(*) AS n
            FROM ev_nz CROSS JOIN se WHERE material IS NOT NULL GROUP BY ALL""",
        _EV_NZ + ",\n" + _ew_edges_sql("size_mm", "ev_nz", 10, "se"),
    ),
)
def failures_by_material_sizebin(spark, sf_dir):
    ev = C.drop_zero_size(Data(spark, sf_dir).events_c)
    ev = B.cut(ev, S.SIZE, 10, "size")
    return K.count_by(ev, [S.MATERIAL, "size_bin"])


@query(
    "failures_sizebin_yearbin",
    sql(
        f"""SELECT {_bin_sql('size_mm', 'se.e', 10)} AS size_bin, {_bin_sql('install_year', 'ye.e', 10)} AS year_bin,
                   count(*) AS n
            FROM ev_nz CROSS JOIN se CROSS JOIN ye GROUP BY ALL""",
        _EV_NZ + ",\n" + _ew_edges_sql("size_mm", "ev_nz", 10, "se") + ",\n"
        + _ew_edges_sql("install_year", "ev_c", 10, "ye"),
    ),
)
def failures_sizebin_yearbin(spark, sf_dir):
    ev = Data(spark, sf_dir).events_c
    year_edges = B.equal_width_edges(ev, S.INSTALL_YEAR, 10)  # before the zero-size drop
    ev = C.drop_zero_size(ev)
    ev = B.cut(ev, S.SIZE, 10, "size")
    ev = ev.withColumn("year_bin", B.bin_expr(F.col(S.INSTALL_YEAR).cast("double"), year_edges))
    return K.count_by(ev, ["size_bin", "year_bin"])


# ---------------------------------------------------------------- A8 cross-tabs

XT_COLS = ["year_bin", "size_bin", S.MATERIAL, S.MATERIAL_AGE, S.REGION]


def _failed():
    """A failure row of a known asset (events have one by definition)."""
    return F.col(S.FAILED_AT).isNotNull() & F.col(S.ID).isNotNull()


def _binned_all(d: Data):
    """all_c with clamped install-year bins (cut 5) and size quintiles (qcut 5)."""
    a = d.all_c_stored.withColumn("year_c", clamp_low(S.INSTALL_YEAR, CLAMP_YEAR))
    a = B.cut(a, "year_c", 5, "year")
    return B.qcut(a, S.SIZE, 5, "size")


_BINNED_ALL_SQL = (
    f"ac AS (SELECT *, greatest(install_year, {CLAMP_YEAR}) AS year_c FROM all_c),\n"
    + _ew_edges_sql("year_c", "ac", 5, "ye5") + ",\n"
    + _q_edges_sql("size_mm", "all_c", 5, "qe5") + ",\n"
    + f"""ab AS (SELECT ac.*, {_bin_sql('year_c', 'ye5.e', 5)} AS year_bin, {_bin_sql('size_mm', 'qe5.e', 5)} AS size_bin
            FROM ac CROSS JOIN ye5 CROSS JOIN qe5)"""
)


def _gid(cols, used):
    return sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in used)


def _xtab_sql(src: str) -> str:
    sets = [list(p) for p in combinations(XT_COLS, 2)] + [[c] for c in XT_COLS]
    gs = ", ".join("(" + ", ".join(s) + ")" for s in sets)
    cols = ", ".join(XT_COLS)
    keep = " OR ".join(
        "(" + f"gid = {_gid(XT_COLS, s)}" + "".join(f" AND {c} IS NOT NULL" for c in s) + ")" for s in sets
    )
    return f"""SELECT * FROM (
        SELECT {cols}, CAST(grouping_id({cols}) AS INTEGER) AS gid, count(*) AS n
        FROM {src} GROUP BY GROUPING SETS ({gs})) WHERE {keep}"""


@query("crosstab_all_pairs", sql(_xtab_sql("ab"), _BINNED_ALL_SQL))
def crosstab_all_pairs(spark, sf_dir):
    return K.all_pair_crosstabs(_binned_all(Data(spark, sf_dir)), XT_COLS)


_EVB_SQL = (
    _BINNED_ALL_SQL
    + """,
    evb AS (SELECT e.*, x.year_bin, x.size_bin FROM ev_c e
            JOIN (SELECT DISTINCT id, year_bin, size_bin FROM ab) x ON e.id = x.id)"""
)


@query("crosstab_all_pairs_failures", sql(_xtab_sql("evb"), _EVB_SQL))
def crosstab_all_pairs_failures(spark, sf_dir):
    """The same 10 pairwise cross-tabs + margins over failure rows (bins looked up by asset)."""
    return K.all_pair_crosstabs(_binned_events(Data(spark, sf_dir)), XT_COLS)


# ---------------------------------------------------------------- A9 pivot

@query(
    "pivot_year_region",
    sql(
        "SELECT failure_year, "
        + ", ".join(f"nullif(count(*) FILTER (WHERE region = '{r}'), 0) AS \"{r}\"" for r in REGIONS)
        + " FROM ev_c WHERE failure_year IS NOT NULL GROUP BY failure_year"
    ),
)
def pivot_year_region(spark, sf_dir):
    ev = Data(spark, sf_dir).events_c.filter(F.col(S.FAILURE_YEAR).isNotNull())
    # The value list is the distinct regions (a bounded category list).
    return ev.groupBy(S.FAILURE_YEAR).pivot(S.REGION).agg(F.count(F.lit(1)))


# ---------------------------------------------------------------- rates

def _rate_sql(keys: list[str], scale: float, ev: str = "ev_c", al: str = "all_c", extra: str = "") -> str:
    k = ", ".join(keys)
    nn = " AND ".join(f"{c} IS NOT NULL" for c in keys)
    return f"""SELECT {k}, a.n_rows, e.n_failures, CAST(e.n_failures AS DOUBLE) / a.n_rows * {scale} AS rate
      FROM (SELECT {k}, count(*) AS n_rows FROM {al} WHERE {nn} GROUP BY ALL) a
      JOIN (SELECT {k}, count(*) AS n_failures FROM {ev} WHERE {nn} GROUP BY ALL) e USING ({k}) {extra}"""


@query("rate_by_material", sql(_rate_sql([S.MATERIAL], 100.0)))
def rate_by_material(spark, sf_dir):
    d = Data(spark, sf_dir)
    return K.rate(d.events_c, d.all_c, [S.MATERIAL], 100.0)


_NZ = ("ev_nz AS (SELECT * FROM ev_c WHERE size_mm IS DISTINCT FROM 0), "
       "all_nz AS (SELECT * FROM all_c WHERE size_mm IS DISTINCT FROM 0)")


@query("rate_by_size", sql(_rate_sql([S.SIZE], 100.0, "ev_nz", "all_nz"), _NZ))
def rate_by_size(spark, sf_dir):
    d = Data(spark, sf_dir)
    return K.rate(C.drop_zero_size(d.events_c), C.drop_zero_size(d.all_c), [S.SIZE], 100.0)


@query(
    "rate_by_material_size",
    sql(_rate_sql([S.MATERIAL, S.SIZE], 100.0, "ev_nz", "all_nz", f"WHERE size_mm <= {SIZE_CAP}"), _NZ),
)
def rate_by_material_size(spark, sf_dir):
    d = Data(spark, sf_dir)
    r = K.rate(C.drop_zero_size(d.events_c), C.drop_zero_size(d.all_c), [S.MATERIAL, S.SIZE], 100.0)
    return C.cap_size(r, SIZE_CAP)


@query("rate_by_material_year", sql(_rate_sql([S.MATERIAL, S.INSTALL_YEAR], 100.0)))
def rate_by_material_year(spark, sf_dir):
    d = Data(spark, sf_dir)
    return K.rate(d.events_c, d.all_c, [S.MATERIAL, S.INSTALL_YEAR], 100.0)


@query(
    "rate_by_region_year",
    sql(
        """SELECT region, failure_year, n_rows, n_failures, CAST(n_failures AS DOUBLE) / n_rows * 100.0 AS rate
           FROM (SELECT region, failure_year, count(*) AS n_failures FROM ev_c
                 WHERE region IS NOT NULL AND failure_year IS NOT NULL GROUP BY ALL) e
           JOIN (SELECT region, count(*) AS n_rows FROM all_c WHERE region IS NOT NULL GROUP BY ALL) a USING (region)"""
    ),
)
def rate_by_region_year(spark, sf_dir):
    d = Data(spark, sf_dir)
    ev = K.count_by(d.events_c, [S.REGION, S.FAILURE_YEAR], "n_failures")
    al = K.count_by(d.all_c, [S.REGION], "n_rows")
    return ev.join(al, S.REGION).withColumn("rate", safe_ratio("n_failures", "n_rows", 100.0))


# ---------------------------------------------------------------- J6 lookup, A5, A11, A16

def _size_lookup(d: Data, compat: bool = False):
    """(id, size_bin) of the installed table; deduplicated unless compat."""
    b = B.qcut(d.all_c_stored, S.SIZE, 5, "size").select(S.ID, "size_bin")
    return b if compat else b.dropDuplicates([S.ID])


_LOOKUP_SQL = (
    _q_edges_sql("size_mm", "all_c", 5, "qe5") + ",\n"
    + f"""lk_all AS (SELECT id, {_bin_sql('size_mm', 'qe5.e', 5)} AS size_bin FROM all_c CROSS JOIN qe5),
      lk AS (SELECT DISTINCT id, size_bin FROM lk_all)"""
)


@query(
    "bin_lookup",
    sql("SELECT e.id, e.failed_at, e.material, lk.size_bin FROM ev_c e JOIN lk ON e.id = lk.id", _LOOKUP_SQL),
)
def bin_lookup(spark, sf_dir):
    d = Data(spark, sf_dir)
    return d.events_c.join(_size_lookup(d), S.ID).select(S.ID, S.FAILED_AT, S.MATERIAL, "size_bin")


@query(
    "bin_lookup_compat",
    sql("SELECT e.id, e.failed_at, e.material, lk_all.size_bin FROM ev_c e JOIN lk_all ON e.id = lk_all.id",
        _LOOKUP_SQL),
)
def bin_lookup_compat(spark, sf_dir):
    """Many-to-many lookup as in the source: an asset with k failures counts k^2 times."""
    d = Data(spark, sf_dir)
    return d.events_c.join(_size_lookup(d, compat=True), S.ID).select(S.ID, S.FAILED_AT, S.MATERIAL, "size_bin")


DIMS = ["size_bin", S.MATERIAL, S.MATERIAL_AGE, S.REGION]


def _long(df, value_cols):
    st = [F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("category")) for c in DIMS]
    return df.select(*value_cols, F.explode(F.array(*st)).alias("_d")).select(*value_cols, "_d.*").filter(
        F.col("category").isNotNull()
    )


_LONG_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS dimension, CAST({c} AS VARCHAR) AS category, {{v}} FROM {{src}} WHERE {c} IS NOT NULL"
    for c in DIMS
)


@query(
    "median_lifetime",
    sql(
        "SELECT dimension, category, CAST(median(lifetime) AS DOUBLE) AS median_lifetime FROM lt_long GROUP BY ALL",
        _LOOKUP_SQL
        + """, lt AS (SELECT e.*, e.failure_year - e.install_year AS lifetime, lk.size_bin
                    FROM ev_c e JOIN lk ON e.id = lk.id),
           lt_long AS ("""
        + _LONG_SQL.format(v="lifetime", src="lt")
        + ")",
    )
)
def median_lifetime(spark, sf_dir):
    d = Data(spark, sf_dir)
    # a row's bin is an expression of its own size: no join by id
    lt = B.qcut(d.all_c_stored, S.SIZE, 5, "size").filter(_failed()).withColumn(
        "lifetime", F.col(S.FAILURE_YEAR) - F.col(S.INSTALL_YEAR)
    )
    long = _long(lt, ["lifetime"])
    med = grouped_quantiles_discrete(long, ["dimension", "category"], "lifetime", [0.5])
    return med.select("dimension", "category", F.col("q").alias("median_lifetime"))


_MARGINAL_SQL = (
    _LOOKUP_SQL
    + """, evb AS (SELECT e.*, lk.size_bin FROM ev_c e JOIN lk ON e.id = lk.id),
       alb AS (SELECT a.*, lk.size_bin FROM all_c a LEFT JOIN lk ON a.id = lk.id),
       ev_long AS ("""
    + _LONG_SQL.format(v="1 AS one", src="evb")
    + "), al_long AS ("
    + _LONG_SQL.format(v="1 AS one", src="alb")
    + """),
       mr AS (SELECT a.dimension, a.category, a.n_rows, e.n_failures,
                     CAST(e.n_failures AS DOUBLE) / a.n_rows AS rate
              FROM (SELECT dimension, category, count(*) AS n_rows FROM al_long GROUP BY ALL) a
              LEFT JOIN (SELECT dimension, category, count(*) AS n_failures FROM ev_long GROUP BY ALL) e
              USING (dimension, category))"""
)


def _marginal(d: Data):
    # rows and failures per combination in one pass, then per category of each dimension
    a = B.qcut(d.all_c_stored, S.SIZE, 5, "size")
    t = a.groupBy(*DIMS).agg(F.count(F.lit(1)).alias("r"), F.sum(_failed().cast("long")).alias("f"))
    c = _long(t, ["r", "f"]).groupBy("dimension", "category").agg(F.sum("r").alias("n_rows"), F.sum("f").alias("n_failures"))
    c = c.withColumn("n_failures", F.when(F.col("n_failures") > 0, F.col("n_failures")))
    return c.withColumn("rate", safe_ratio("n_failures", "n_rows", 1.0))


@query("marginal_rate", sql("SELECT dimension, category, n_rows, n_failures, rate FROM mr", _MARGINAL_SQL))
def marginal_rate(spark, sf_dir):
    """Failures / rows per category of each dimension; null rate where no failure."""
    return _marginal(Data(spark, sf_dir)).select("dimension", "category", "n_rows", "n_failures", "rate")


@query(
    "marginal_rate_scaled",
    sql(
        """SELECT dimension, category, n_rows, n_failures, rate,
                  rate * avg(n_rows) OVER (PARTITION BY dimension) / avg(rate) OVER (PARTITION BY dimension)
                    AS rate_scaled
           FROM mr""",
        _MARGINAL_SQL,
    )
)
def marginal_rate_scaled(spark, sf_dir):
    """rate x mean(count) / mean(rate), per dimension (aggregate of a few rows per dimension)."""
    m = _marginal(Data(spark, sf_dir))
    w = Window.partitionBy("dimension")
    return m.withColumn("rate_scaled", F.col("rate") * F.avg("n_rows").over(w) / F.avg("rate").over(w))


# ---------------------------------------------------------------- J10 / A15 / P15 grids

PAIR_COLS = XT_COLS


def _pair_long(df, cols, keep):
    """One row per (input row, column pair): the pair's names and values as text; ``keep`` columns stay."""
    st = [
        F.struct(
            F.lit(x).alias("x_name"), F.lit(y).alias("y_name"),
            F.col(x).cast("string").alias("x_value"), F.col(y).cast("string").alias("y_value"),
        )
        for x, y in combinations(cols, 2)
    ]
    return df.select(*keep, F.explode(F.array(*st)).alias("_p")).select(*keep, "_p.*")


def _pair_sums(t, cols, names):
    """Sums of count columns of column combinations, per cell of every column pair."""
    p = _pair_long(t, cols, names).filter(F.col("x_value").isNotNull() & F.col("y_value").isNotNull())
    return p.groupBy("x_name", "y_name", "x_value", "y_value").agg(*[F.sum(n).alias(n) for n in names])


def _pair_grid(df, cols):
    """Per pair: distinct x values x distinct y values (category lists only)."""
    vals = df.select(*cols).distinct().select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in cols]))
        .alias("_v")
    ).select("_v.*").filter(F.col("value").isNotNull()).distinct()
    pairs = df.sparkSession.createDataFrame(list(combinations(cols, 2)), "x_name string, y_name string")
    xs = vals.withColumnRenamed("name", "x_name").withColumnRenamed("value", "x_value")
    ys = vals.withColumnRenamed("name", "y_name").withColumnRenamed("value", "y_value")
    return F.broadcast(pairs).join(xs, "x_name").join(ys, "y_name")


def _binned_events(d: Data):
    """Events in the installed table's bins: a bin is an expression of the row's own size and year, no join by id."""
    return _binned_all(d).filter(_failed())


def _sql_pair_long(src, cols):
    return " UNION ALL ".join(
        f"SELECT '{x}' AS x_name, '{y}' AS y_name, CAST({x} AS VARCHAR) AS x_value, CAST({y} AS VARCHAR) AS y_value "
        f"FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL"
        for x, y in combinations(cols, 2)
    )


def _sql_values(src, cols):
    return " UNION ".join(f"SELECT '{c}' AS name, CAST({c} AS VARCHAR) AS value FROM {src} WHERE {c} IS NOT NULL"
                          for c in cols)


_GRID_SQL = (
    _BINNED_ALL_SQL
    + f""",
    evb AS (SELECT e.*, x.year_bin, x.size_bin FROM ev_c e
            JOIN (SELECT DISTINCT id, year_bin, size_bin FROM ab) x ON e.id = x.id),
    vals AS ({_sql_values('ab', PAIR_COLS)}),
    grid AS (SELECT p.x_name, p.y_name, vx.value AS x_value, vy.value AS y_value
             FROM (VALUES {", ".join(f"('{x}', '{y}')" for x, y in combinations(PAIR_COLS, 2))}) p(x_name, y_name)
             JOIN vals vx ON vx.name = p.x_name JOIN vals vy ON vy.name = p.y_name),
    al_pairs AS (SELECT x_name, y_name, x_value, y_value, count(*) AS n_rows FROM ({_sql_pair_long('ab', PAIR_COLS)})
                 GROUP BY ALL),
    ev_pairs AS (SELECT x_name, y_name, x_value, y_value, count(*) AS n_failures
                 FROM ({_sql_pair_long('evb', PAIR_COLS)}) GROUP BY ALL)"""
)


@query(
    "crosstab_grid",
    sql(
        """SELECT g.x_name, g.y_name, g.x_value, g.y_value, coalesce(a.n_rows, 0) AS n_rows
           FROM grid g LEFT JOIN al_pairs a USING (x_name, y_name, x_value, y_value)""",
        _GRID_SQL,
    ),
)
def crosstab_grid(spark, sf_dir):
    """Installed counts on the full grid of every column pair, 0 where empty."""
    t = store(K.tuples(_binned_all(Data(spark, sf_dir)), PAIR_COLS, "n_rows"), "tuples")
    grid = _pair_grid(t, PAIR_COLS)
    cnt = _pair_sums(t, PAIR_COLS, ["n_rows"])
    keys = ["x_name", "y_name", "x_value", "y_value"]
    return grid.join(cnt, keys, "left").select(*keys, F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


@query(
    "crosstab_rate",
    sql(
        """SELECT g.x_name, g.y_name, g.x_value, g.y_value,
                  coalesce(e.n_failures, 0) AS n_failures, coalesce(a.n_rows, 0) AS n_rows,
                  CASE WHEN e.n_failures IS NULL OR a.n_rows IS NULL THEN 0.0
                       ELSE CAST(e.n_failures AS DOUBLE) / a.n_rows * 1000 END AS rate
           FROM grid g LEFT JOIN al_pairs a USING (x_name, y_name, x_value, y_value)
           LEFT JOIN ev_pairs e USING (x_name, y_name, x_value, y_value)""",
        _GRID_SQL,
    ),
)
def crosstab_rate(spark, sf_dir):
    """Per-mille failure rate of every cell of every column pair, 0 where missing."""
    d = Data(spark, sf_dir)
    keys = ["x_name", "y_name", "x_value", "y_value"]
    # rows and failures per combination in one pass
    t = _binned_all(d).groupBy(*PAIR_COLS).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(_failed().cast("long")).alias("n_failures"))
    t = store(t, "tuples")
    out = _pair_grid(t, PAIR_COLS).join(_pair_sums(t, PAIR_COLS, ["n_rows", "n_failures"]), keys, "left")
    both = (F.col("n_failures") > 0) & (F.col("n_rows") > 0)
    return out.select(
        *keys,
        F.coalesce("n_failures", F.lit(0)).alias("n_failures"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.when(both, safe_ratio("n_failures", "n_rows", 1000.0)).otherwise(F.lit(0.0)).alias("rate"),
    )


_EVGRID_SQL = (
    _BINNED_ALL_SQL
    + f""",
    evb AS (SELECT e.*, x.year_bin, x.size_bin FROM ev_c e
            JOIN (SELECT DISTINCT id, year_bin, size_bin FROM ab) x ON e.id = x.id),
    vals AS ({_sql_values('evb', PAIR_COLS)}),
    grid AS (SELECT p.x_name, p.y_name, vx.value AS x_value, vy.value AS y_value
             FROM (VALUES {", ".join(f"('{x}', '{y}')" for x, y in combinations(PAIR_COLS, 2))}) p(x_name, y_name)
             JOIN vals vx ON vx.name = p.x_name JOIN vals vy ON vy.name = p.y_name),
    ev_pairs AS (SELECT x_name, y_name, x_value, y_value, count(*) AS n
                 FROM ({_sql_pair_long('evb', PAIR_COLS)}) GROUP BY ALL),
    mins AS (SELECT x_name, y_name, min(n) AS mn FROM ev_pairs GROUP BY ALL)"""
)


@query(
    "crosstab_logsize",
    sql(
        """SELECT g.x_name, g.y_name, g.x_value, g.y_value, coalesce(e.n, 0) AS n,
                  CASE WHEN e.n IS NULL THEN 0.0 ELSE ln(CAST(e.n AS DOUBLE) / m.mn) * 7 END AS log_size
           FROM grid g LEFT JOIN ev_pairs e USING (x_name, y_name, x_value, y_value)
           LEFT JOIN mins m USING (x_name, y_name)""",
        _EVGRID_SQL,
    )
)
def crosstab_logsize(spark, sf_dir):
    """Failure cross-tab marker size ln(n / min n) * 7 per pair, 0 for empty cells."""
    evb = store(K.tuples(_binned_events(Data(spark, sf_dir)), PAIR_COLS), "tuples")
    keys = ["x_name", "y_name", "x_value", "y_value"]
    grid = _pair_grid(evb, PAIR_COLS)
    ev = _pair_sums(evb, PAIR_COLS, ["n"])
    mins = ev.groupBy("x_name", "y_name").agg(F.min("n").alias("_mn"))
    out = grid.join(ev, keys, "left").join(mins, ["x_name", "y_name"], "left")
    return out.select(
        *keys,
        F.coalesce("n", F.lit(0)).alias("n"),
        F.when(F.col("n").isNull(), F.lit(0.0))
        .otherwise(F.log(F.col("n") / F.col("_mn")) * F.lit(7.0))
        .alias("log_size"),
    )


# P15 variant: failure cross-tab sizes ln(n / min n) * 10 on the installed
# grid, install years cut in 10 bins (no clamp), sizes in quintiles.
_EVGRID10_SQL = (
    _ew_edges_sql("install_year", "all_c", 10, "ye10") + ",\n"
    + _q_edges_sql("size_mm", "all_c", 5, "qe5b") + ",\n"
    + f"""ab10 AS (SELECT all_c.*, {_bin_sql('install_year', 'ye10.e', 10)} AS year_bin,
                      {_bin_sql('size_mm', 'qe5b.e', 5)} AS size_bin FROM all_c CROSS JOIN ye10 CROSS JOIN qe5b),
    evb10 AS (SELECT e.*, x.year_bin, x.size_bin FROM ev_c e
              JOIN (SELECT DISTINCT id, year_bin, size_bin FROM ab10) x ON e.id = x.id),
    vals10 AS ({_sql_values('ab10', PAIR_COLS)}),
    grid10 AS (SELECT p.x_name, p.y_name, vx.value AS x_value, vy.value AS y_value
               FROM (VALUES {", ".join(f"('{x}', '{y}')" for x, y in combinations(PAIR_COLS, 2))}) p(x_name, y_name)
               JOIN vals10 vx ON vx.name = p.x_name JOIN vals10 vy ON vy.name = p.y_name),
    ev_pairs10 AS (SELECT x_name, y_name, x_value, y_value, count(*) AS n
                   FROM ({_sql_pair_long('evb10', PAIR_COLS)}) GROUP BY ALL),
    mins10 AS (SELECT x_name, y_name, min(n) AS mn FROM ev_pairs10 GROUP BY ALL)"""
)


@query(
    "crosstab_logsize_installed_grid",
    sql(
        """SELECT g.x_name, g.y_name, g.x_value, g.y_value, coalesce(e.n, 0) AS n,
                  CASE WHEN e.n IS NULL THEN 0.0 ELSE ln(CAST(e.n AS DOUBLE) / m.mn) * 10 END AS log_size
           FROM grid10 g LEFT JOIN ev_pairs10 e USING (x_name, y_name, x_value, y_value)
           LEFT JOIN mins10 m USING (x_name, y_name)""",
        _EVGRID10_SQL,
    ),
)
def crosstab_logsize_installed_grid(spark, sf_dir):
    """Failure cross-tab marker sizes (k = 10) over the grid of installed values."""
    d = Data(spark, sf_dir)
    ab = B.qcut(B.cut(d.all_c_stored, S.INSTALL_YEAR, 10, "year"), S.SIZE, 5, "size")
    t = store(ab.groupBy(*PAIR_COLS).agg(F.sum(_failed().cast("long")).alias("n")), "tuples")
    keys = ["x_name", "y_name", "x_value", "y_value"]
    grid = _pair_grid(t, PAIR_COLS)
    ev = _pair_sums(t.filter("n > 0"), PAIR_COLS, ["n"])
    mins = ev.groupBy("x_name", "y_name").agg(F.min("n").alias("_mn"))
    out = grid.join(ev, keys, "left").join(mins, ["x_name", "y_name"], "left")
    return out.select(
        *keys,
        F.coalesce("n", F.lit(0)).alias("n"),
        F.when(F.col("n").isNull(), F.lit(0.0)).otherwise(F.log(F.col("n") / F.col("_mn")) * F.lit(10.0)).alias("log_size"),
    )
