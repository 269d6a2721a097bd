"""URL rules as a sort-merge range join, in DataFrame functions only.

A rule covers a host, its subdomains, and the paths that begin with its path.  A host's key has its
labels from the right, each ended by a dot, so a host and all below it are the interval of keys that
begin with its own; the paths of a rule are the interval of strings that begin with the rule's.
Such intervals nest or are apart.

Points and the ends of intervals are sorted together and swept.  How many intervals are open is a
running sum; the interval opened last at a depth is the one that lies there in the stack.  A first
sweep, over hosts, gives each URL's host the stack of rule hosts above it; a second one, over the
paths of each of those, gives the topmost rule, which has the longest path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Points of a sweep that one task sorts, about; more are dealt to salts, to each of which go the intervals.
SALT_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; null or no ``://``: empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_key(host: Column) -> Column:
    """Host labels from the right, each ended by a dot: the hosts below one host share its key as a prefix."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def events(intervals: DataFrame, points: DataFrame, by: list[str], salts: int) -> DataFrame:
    """``by, salt, at, kind, name, depth``: all ends and points, and how many intervals are open there.

    ``intervals``: ``by, prefix, name``, the strings that begin with ``prefix``; ``points``: ``by, at,
    name``.  ``kind``: 0 opens, 1 is a point, 2 closes.  No text has the byte that ends an interval.
    """
    binary = lambda c: F.col(c).cast("binary")
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("salt")
    ends = intervals.select(*by, "name", each, F.explode(F.array(F.struct(binary("prefix").alias("at"), F.lit(0).alias("kind")), F.struct(F.concat(binary("prefix"), F.lit(b"\xff")).alias("at"), F.lit(2).alias("kind")))).alias("end"))
    ends = ends.select(*by, "salt", "end.at", "end.kind", "name")
    rows = ends.union(points.select(*by, F.pmod(F.xxhash64("at"), F.lit(salts)).alias("salt"), binary("at").alias("at"), F.lit(1).alias("kind"), "name"))
    return rows.withColumn("depth", F.sum(1 - F.col("kind")).over(_sweep(*by, "salt")))


def _sweep(*by: str):
    return Window.partitionBy(*by).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _opened(depth: int | Column):
    """The name of the interval opened last at this depth, if it is open."""
    return F.when((F.col("kind") == 0) & (F.col("depth") == depth), F.col("name"))


def host_stacks(keys: DataFrame, points: DataFrame, salts: int) -> DataFrame:
    """``at, stack``: for each point (a host's key) the rule hosts' keys that it begins with, the outermost first.

    ``keys``, ``points``: one column, ``key`` and ``at``.
    """
    first = lambda c: F.substring_index(c, ".", 1).alias("label")
    intervals = keys.select(first("key"), F.col("key").alias("prefix"), F.col("key").alias("name"))
    # Hosts below a rule's have its first label, so each label is swept alone; how deep rules nest is known before.
    deepest = events(intervals, points.limit(0).select(first("at"), "at", F.col("at").alias("name")), ["label"], 1).agg(F.max("depth")).first()[0] or 0
    if not deepest:
        return points.limit(0).select("at", F.array().cast("array<string>").alias("stack"))
    swept = events(intervals, points.select(first("at"), "at", F.col("at").alias("name")), ["label"], salts)
    stack = F.array(*[F.when(F.col("depth") >= k, F.last(_opened(k), ignorenulls=True).over(_sweep("label", "salt"))) for k in range(1, deepest + 1)])
    return swept.withColumn("stack", stack).where("kind = 1 and depth > 0").select(F.col("name").alias("at"), F.filter("stack", lambda x: x.isNotNull()).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col, host, path, rule, verdict`` for each row of ``pages``.

    ``rules``: ``host, path, action`` (allow or block); the longest fitting rule (host and path
    together) wins, a block among equals.  A rule without host fits nothing; null paths are empty.
    A null URL or one without ``://`` has an empty host and path; no rule fits it and it gets the
    default.  Repeated rows are judged alike.  Null ids are kept.  Other columns are not read, so
    their names cannot clash.
    """
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rules = rules.select(F.translate(F.col("host"), UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action").where("host <> ''")
    rules = materialize(rules.groupBy("host", "path").agg(F.max("action").alias("action")).withColumn("key", reversed_key(F.col("host"))), "rules")
    # Equal host and path are judged once, which also folds repeated URLs.
    distinct = materialize(urls.where("host <> ''").select("host", "path").distinct().withColumn("at", reversed_key(F.col("host"))), "urls")
    hosts = distinct.select("at").distinct()
    size = distinct.agg(F.count(F.lit(1)).alias("urls"), F.approx_count_distinct("at").alias("hosts")).first()
    stacks = host_stacks(rules.select("key").distinct(), hosts, 1 + size.hosts // SALT_ROWS)
    points = distinct.join(stacks.withColumnRenamed("at", "host_key"), F.col("at") == F.col("host_key"))
    points = points.select(F.explode("stack").alias("key"), F.col("path").alias("at"), F.struct("host", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("action")).alias("name"))
    rule = F.concat("host", "path")
    intervals = rules.select("key", F.col("path").alias("prefix"), F.struct("host", rule.alias("rule"), "action").alias("name"))
    swept = events(intervals, points, ["key"], 1 + size.urls // SALT_ROWS)
    top = F.last(_opened(F.col("depth")), ignorenulls=True).over(_sweep("key", "salt", "depth"))
    fits = swept.withColumn("top", top).where("kind = 1 and depth > 0").select(F.col("name.host").alias("h"), F.col("at").cast("string").alias("p"), "top")
    best = fits.groupBy("h", "p").agg(F.max(F.struct(F.length("top.rule").alias("n"), F.col("top.action").alias("action"), F.col("top.rule").alias("rule"))).alias("best"))
    judged = urls.where("host <> ''").join(best, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    judged = judged.select("id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
    judged = judged.union(urls.where("host = ''").select("id", "host", "path", F.lit(None).cast("string"), F.lit(default)))
    return judged.withColumnRenamed("id", id_col)
