"""URL filters as a temporal list join: every capture is judged by the entries active when it was fetched.

A list is a log of dated changes (list, kind, value, action, day): ``add`` puts an entry on the list, ``remove``
takes it off. The log becomes validity intervals [from, to); an as-of join matches each capture's keys (its
host, every parent domain, its path prefixes from the host alone to the whole path) with the interval that holds
its day. Intervals are cut into buckets of days and the join is an equality on key and bucket, so an entry with a
long history meets only the captures of the same days. Captures are reduced to distinct (host, day) and, for the
prefixes, to distinct (host, path, day) before the joins: for its host and domains, a host with a third of all
captures is one row per day.

Defined results: a capture without a url or day matches nothing and is kept (blocked false); entries with a null
in any of their columns take no part; of several changes to an entry on one day the last action in alphabetical
order (remove) holds; repeated captures each give a row; extra columns are not used. A prefix entry may be a whole
URL without query and fragment; its scheme, user and port don't count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read

BUCKET_DAYS = 32


def intervals(changes: DataFrame) -> DataFrame:
    """(list, kind, value, from_day, to_day) of a change log; to_day is exclusive, null while open."""
    c = changes.dropna(subset=["list", "kind", "value", "action", "day"]).groupBy("list", "kind", "value", "day").agg(F.max("action").alias("action"))
    w = Window.partitionBy("list", "kind", "value").orderBy("day")
    c = c.withColumn("before", F.lag("action").over(w)).where("before IS NULL OR before <> action")
    c = c.withColumn("to_day", F.lead("day").over(w))
    return c.where("action = 'add'").select("list", "kind", "value", F.col("day").alias("from_day"), "to_day")


def url_keys(url: str = "url") -> list[tuple[str, str]]:
    """SQL of the host and of the array of keys (kind, value) of a URL."""
    host = f"regexp_replace(regexp_extract(lower({url}), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '[.]+$', '')"
    path = f"split(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/')"
    return [("host", host), ("path", path)]


def judge(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """Per capture: page_id, host, day, blocked, lists (sorted, comma-joined), n_entries."""
    (_, host), (_, path) = url_keys()
    c = captures.select("page_id", F.coalesce(F.expr(host), F.lit("")).alias("host"), F.coalesce(F.expr(f"array_join({path}, '/')"), F.lit("")).alias("path"), "day")
    some = c.where("host <> '' AND day IS NOT NULL")
    labels, parts = "split(host, '[.]')", "split(path, '/')"
    names = f"concat(array(struct('host' AS kind, host AS value)), transform(sequence(1, size({labels})), i -> struct('domain' AS kind, array_join(slice({labels}, i, size({labels})), '.') AS value)))"
    # the first part of a path is empty
    prefixes = f"transform(sequence(1, size({parts})), i -> struct('prefix' AS kind, concat(host, array_join(slice({parts}, 1, i), '/')) AS value))"
    number = lambda x: F.floor(F.datediff(x, F.lit("1970-01-01")) / BUCKET_DAYS)
    url_host, url_path = (sql for _, sql in url_keys("value"))
    whole = F.expr(f"IF(kind = 'prefix' AND value rlike '^[A-Za-z][A-Za-z0-9+.-]*://[^?#]*$', concat({url_host}, array_join({url_path}, '/')), value)")
    # an open interval has buckets up to the last capture's day
    e = intervals(changes.withColumn("value", whole)).crossJoin(F.broadcast(captures.agg(F.max("day").alias("last"))))
    e = e.withColumn("bucket", F.explode_outer(F.sequence(number(F.col("from_day")), number(F.coalesce("to_day", F.greatest("last", "from_day")))))).drop("last")

    def hits(by: list[str], keys: str, ls: str, n: str) -> DataFrame:
        need = some.select(*by).distinct().withColumn("k", F.explode(F.expr(keys))).select(*by, "k.kind", "k.value", number(F.col("day")).alias("bucket"))
        hit = need.join(e, ["kind", "value", "bucket"]).where("from_day <= day AND (to_day IS NULL OR day < to_day)")
        return hit.groupBy(*by).agg(F.collect_set("list").alias(ls), F.count("*").alias(n))

    out = c.join(hits(["host", "day"], names, "ls", "n"), ["host", "day"], "left").join(hits(["host", "path", "day"], prefixes, "pls", "pn"), ["host", "path", "day"], "left")
    none = F.expr("CAST(array() AS array<string>)")
    lists = F.sort_array(F.array_union(F.coalesce("ls", none), F.coalesce("pls", none)))
    n = (F.coalesce("n", F.lit(0)) + F.coalesce("pn", F.lit(0))).cast("long")
    return out.select("page_id", "host", "day", (n > 0).alias("blocked"), F.array_join(lists, ",").alias("lists"), n.alias("n_entries"))


def _captures(pages: DataFrame) -> DataFrame:
    """Pages as captures: the tables have no fetch time, so each page's is derived from its id."""
    return pages.withColumn("day", F.expr("date_add(DATE '2024-01-01', CAST(pmod(page_id * 37, 700) AS INT))"))


def _changes(pages: DataFrame) -> DataFrame:
    """A change log derived from the captured hosts: blocked hosts, their domains, and some path prefixes.

    Days come from the hash of the value: every third entry stays, the rest are removed, some are added again.
    """
    host = F.expr(url_keys()[0][1])
    prefix = F.expr("concat(" + url_keys()[0][1] + ", '/', " + url_keys()[1][1] + "[1])")
    hosts = pages.where("url IS NOT NULL").select(host.alias("host"), prefix.alias("prefix")).distinct()
    entries = (
        hosts.select(F.lit("host").alias("kind"), F.col("host").alias("value"))
        .union(hosts.select(F.lit("prefix"), F.col("prefix")))
        .union(hosts.where("size(split(host, '[.]')) > 3").select(F.lit("domain"), F.expr("substring_index(host, '.', -3)")))
    )
    entries = entries.where("value <> ''").distinct().withColumn("h", F.expr("CAST(conv(substr(md5(concat(kind, ':', value)), 1, 6), 16, 10) AS INT)")).where("h % 4 = 0")
    days = "array(struct('add' AS action, h % 300 AS n), struct('remove' AS action, h % 300 + 90 AS n), struct('add' AS action, h % 300 + 240 AS n))"
    e = entries.withColumn("c", F.explode(F.expr(f"slice({days}, 1, 1 + CAST(floor(h / 4) % 3 AS INT))")))
    listed = F.expr("element_at(array('malware', 'adult', 'spam'), CAST(floor(h / 16) % 3 AS INT) + 1)")
    return e.select(listed.alias("list"), "kind", "value", F.col("c.action").alias("action"), F.expr("date_add(DATE '2024-01-01', c.n)").alias("day"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge(_captures(pages), _changes(pages)).withColumn("day", F.col("day").cast("string"))


OP5_SQL = r"""
WITH cap AS (
  SELECT page_id, DATE '2024-01-01' + CAST((page_id * 37) % 700 AS INTEGER) AS day,
         coalesce(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '[.]+$', ''), '') AS host,
         string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/') AS path
  FROM pages),
c AS (SELECT page_id, day, host, coalesce(host || array_to_string(path[1:2], '/'), '') AS prefix, host || '/' || path[2] AS p2 FROM cap),
ent AS (
  SELECT DISTINCT kind, value FROM (
    SELECT 'host' AS kind, host AS value FROM c UNION ALL SELECT 'prefix', p2 FROM c
    UNION ALL SELECT 'domain', array_to_string(string_split(host, '.')[-3:], '.') FROM c WHERE len(string_split(host, '.')) > 3)
  WHERE value <> ''),
hashed AS (SELECT kind, value, CAST('0x' || substr(md5(kind || ':' || value), 1, 6) AS INTEGER) AS h FROM ent),
iv AS (
  SELECT kind, value, ['malware', 'adult', 'spam'][(h // 16) % 3 + 1] AS list, a, b FROM (
    SELECT kind, value, h, h % 300 AS a, CASE WHEN (h // 4) % 3 = 0 THEN NULL ELSE h % 300 + 90 END AS b FROM hashed WHERE h % 4 = 0
    UNION ALL SELECT kind, value, h, h % 300 + 240, NULL FROM hashed WHERE h % 4 = 0 AND (h // 4) % 3 = 2)),
hit AS (
  SELECT DISTINCT c.page_id, iv.kind, iv.value, iv.list FROM c JOIN iv
    ON ((iv.kind = 'host' AND iv.value = c.host) OR (iv.kind = 'prefix' AND iv.value = c.prefix) OR (iv.kind = 'domain' AND (c.host = iv.value OR c.host LIKE '%.' || iv.value)))
   AND c.day >= DATE '2024-01-01' + CAST(iv.a AS INTEGER) AND (iv.b IS NULL OR c.day < DATE '2024-01-01' + CAST(iv.b AS INTEGER))
  WHERE c.host <> ''),
agg AS (SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, count(*) AS n FROM hit GROUP BY page_id)
SELECT c.page_id, c.host, CAST(c.day AS VARCHAR) AS day, agg.n IS NOT NULL AS blocked, coalesce(agg.lists, '') AS lists, CAST(coalesce(agg.n, 0) AS BIGINT) AS n_entries
FROM c LEFT JOIN agg ON c.page_id = agg.page_id
"""
