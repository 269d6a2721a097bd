"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Each source has a target of tokens.  Document rates between 0 and ``CAP`` that stay closest to even
ones (in bounded entropy) while meeting the targets are tilted exponentially in the document's
size: ``rate = CAP / (1 + exp(-lambda * size / scale))``.  One ``lambda`` a source solves the convex
dual; Newton's steps, kept in a bracket, are sums over the table of sizes of each source, so
documents are read once, whatever the number of steps.

Rates become whole copies by systematic rounding along each source's documents in order of size:
``copies = floor(R_i + u) - floor(R_{i-1} + u)`` with R the running sum of rates.  As sizes only grow
along that order, a source's tokens miss their target by less than its largest document.  Rates are
whole multiples of ``1 / UNIT`` there, so running sums are exact and do not depend on the order of
additions.

No running sum goes over the documents of a source in one task: sums of bands of sizes, of the sizes
in a band, of the buckets of a size and, at last, of the documents of a bucket are added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

CAP = 2
#: The weights of the sources in order, repeated.
WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
#: Documents of one source and size that are numbered in one task, about; more are dealt to buckets.
BUCKET_ROWS = 50_000
#: Source and sizes that have buckets, at most (a larger table has larger buckets instead); they are broadcast.
MOST_WIDE = 100_000
#: Parts of the order of sources.
PARTS = 32
#: Rates are rounded to multiples of 1 / UNIT before they are summed.
UNIT = 1 << 24
MOST_STEPS, TOLERANCE = 60, 1e-9
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text):
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def _key(source: Column) -> Column:
    """A source as text that is never null, so that joins on it need no care."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def ranked(by_source: DataFrame) -> DataFrame:
    """Adds ``rank``, from 0, by code point with null last; each part of the order numbers its own."""
    order = [F.col("source").isNull(), F.col("source")]
    parts = materialize(by_source.repartitionByRange(PARTS, *order).withColumn("part", F.spark_partition_id()), "ranked")
    size = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = size.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parts.withColumn("own", own).join(F.broadcast(before), F.col("part") == F.col("p")).select(*by_source.columns, (F.col("before") + F.col("own") - 1).alias("rank"))


def targets(by_source: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size`` (one row a source).

    Sources by code point, null last, weigh ``weights`` in turn and share ``budget`` times all sizes.
    A target stops at ``CAP`` times its source's size; the excess is shared anew by weight among the
    others until none is above.  Each round is a sum over the table, and stops one more source at least.
    """
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    t = ranked(by_source).withColumns({"w": F.get(wheel, (F.col("rank") % len(weights)).cast("int")), "cap": CAP * F.col("source_size").cast("double")})
    t = materialize(t.select("source", "source_size", "w", "cap"), "weights")
    level, stopped = 0.0, -1
    while True:
        full = (F.col("cap") <= F.col("w") * level) if stopped >= 0 else F.lit(False)
        r = t.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("cap"))).alias("cap"), F.sum(F.when(~full, F.col("w"))).alias("w"), F.sum("source_size").cast("double").alias("all")).first()
        if r["n"] == stopped or not r.w:
            break
        level, stopped = (budget * r["all"] - (r.cap or 0.0)) / r.w, r["n"]
    return t.select("source", "source_size", F.least("cap", F.col("w") * level).alias("target"))


def _rate(lam, x):
    return CAP / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), lam * x))))


def solve(hist: DataFrame, goal: DataFrame) -> DataFrame:
    """``source, lam, scale, full`` from the size table ``source, size, n`` and ``targets``.

    ``full``: the target is the cap itself and every document goes in ``CAP`` times.
    """
    goal = goal.withColumn("full", F.col("target") >= CAP * F.col("source_size") * (1 - 1e-12))
    mass = hist.where("size > 0").groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"))
    state = goal.join(mass.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", "target", "full", F.coalesce("scale", F.lit(1.0)).alias("scale"), F.lit(0.0).alias("lam"), F.lit(-1e4).alias("lo"), F.lit(1e4).alias("hi"), (F.col("full") | (F.col("target") <= 0) | F.col("scale").isNull()).alias("done")
    )
    state = materialize(state, "dual")
    for _ in range(MOST_STEPS):
        if state.where("not done").isEmpty():
            break
        at = hist.where("size > 0").withColumnRenamed("source", "s").join(state.where("not done").select("source", "lam", "scale"), F.col("s").eqNullSafe(F.col("source")))
        x = F.col("size") / F.col("scale")
        r, mass_ = _rate(F.col("lam"), x), F.col("size") * F.col("n")
        sums = at.groupBy(F.col("source").alias("s")).agg(F.sum(mass_ * r).alias("got"), F.sum(mass_ * x * r * (1 - r / CAP)).alias("slope"))
        new = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left")
        miss = F.col("got") - F.col("target")
        done = F.col("done") | (F.abs(miss) <= TOLERANCE * F.col("target"))
        lo, hi = F.when(miss < 0, F.col("lam")).otherwise(F.col("lo")), F.when(miss > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - miss / F.nullif(F.col("slope"), F.lit(0.0))
        new = new.select("source", "target", "full", "scale", F.col("lam").alias("was"), newton.alias("newton"), lo.alias("lo"), hi.alias("hi"), done.alias("done"))
        inside = (F.col("newton") > F.col("lo")) & (F.col("newton") < F.col("hi"))
        lam = F.when(F.col("done"), F.col("was")).when(inside, F.col("newton")).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = materialize(new.select("source", "target", "full", "scale", lam.alias("lam"), "lo", "hi", "done"), "dual")
    return state.select("source", "lam", "scale", "full", "target")


def rates_to_copies(rows: DataFrame, hist: DataFrame, dual: DataFrame) -> DataFrame:
    """``id, source, size, copies`` and ``dual``'s other columns; the same rows get the same copies in any run.

    ``rows``: id, source, size.  ``hist``: source, size, n.  ``dual``: one row a source.
    """
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("full"), float(CAP)).when(F.col("target") <= 0, 0.0).otherwise(_rate(F.col("lam"), F.col("size") / F.col("scale")))
    dual = dual.withColumn("key", _key(F.col("source"))).drop("source")
    sizes = hist.select(_key(F.col("source")).alias("key"), "size", "n").join(dual, "key")
    sizes = sizes.withColumns({"rate": F.rint(rate * UNIT).cast("bigint"), "band": F.floor(F.sqrt("size"))}).drop("lam", "scale", "full")
    sizes = sizes.withColumn("mass", F.col("n") * F.col("rate"))
    running = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda what, *by: F.coalesce(F.sum(what).over(running(*by)), F.lit(0))
    bands = sizes.groupBy("key", "band").agg(F.sum("mass").alias("mass")).select("key", "band", before("mass", "key", "band").alias("below"))
    sizes = sizes.withColumn("in_band", before("mass", "key", "band", "size")).join(bands, ["key", "band"])
    sizes = materialize(sizes.withColumn("below", F.col("below") + F.col("in_band")).drop("in_band", "band", "mass"), "masses")

    all_ = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bucket_rows = max(BUCKET_ROWS, -(-all_ // MOST_WIDE))
    wide = sizes.where(F.col("n") > bucket_rows).select(F.col("key").alias("wkey"), F.col("size").alias("wsize"), F.ceil(F.col("n") / bucket_rows).alias("buckets"))
    rows = rows.withColumn("key", _key(F.col("source"))).join(F.broadcast(wide), (F.col("key") == F.col("wkey")) & (F.col("size") == F.col("wsize")), "left")
    rows = rows.select("id", "source", "key", "size", F.coalesce(F.pmod(F.xxhash64("id", F.lit(3)), F.col("buckets")), F.lit(0)).alias("bucket"))
    cells = rows.groupBy("key", "size", "bucket").agg(F.count(F.lit(1)).alias("m")).join(sizes.drop("n"), ["key", "size"])
    cells = cells.withColumn("below", F.col("below") + before(F.col("m") * F.col("rate"), "key", "size", "bucket")).drop("m")
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy(F.xxhash64("id", F.lit(7)), "id")))
    rows = rows.join(cells, ["key", "size", "bucket"])
    start = F.pmod(F.xxhash64("key"), F.lit(UNIT))
    upto = lambda k: F.shiftright(F.col("below") + F.col("rate") * k + start, UNIT.bit_length() - 1)
    return rows.withColumn("copies", (upto(F.col("k")) - upto(F.col("k") - 1)).cast("int")).drop("key", "bucket", "k", "rate", "below")


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id_col, source, size, source_size, target, copies`` for each row of ``docs``.

    Null texts have size 0 and are taken as often as nothing is: never.  A null source is a source of
    its own, the last.  Repeated rows are numbered apart and rounded apart; which of two equal rows
    gets the extra copy cannot be told and does not matter.  An empty table has an empty plan.
    Columns other than the three named are not read, so their names cannot clash.
    """
    rows = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size")), "sizes")
    hist = materialize(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "hist")
    goal = materialize(targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, budget), "targets")
    dual = solve(hist, goal).join(goal.select(F.col("source").alias("gs"), "source_size"), F.col("source").eqNullSafe(F.col("gs"))).drop("gs")
    out = rates_to_copies(rows, hist, dual)
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies")
