"""Space: subsets, overlap, homogeneity, places on axes."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..axes import axis, known
from ..bounds import Bounds, PolygonBounds
from ..tables import small


def time_predicate(lo, hi, mode: str = "intended") -> Column:
    """A closed interval of times; ``literal`` leaves out an upper bound given as a day or month."""
    t = F.col("time")
    upper = t < F.lit(hi) if mode == "literal" and len(str(hi)) <= 10 else t <= F.lit(hi)
    return (t >= F.lit(lo)) & upper


def subset(cells: DataFrame, domain: Bounds, mode: str = "intended") -> DataFrame:
    """Cells in a box, or under a polygon: then what is outside is null, and rows and columns all outside are cut."""
    if isinstance(domain, PolygonBounds):
        # One pass for the grid; which of it is inside is computed once.
        grid = small(cells.select("x", "y").distinct(), "grid")
        inside = small(domain.inside(grid, "parity" if mode == "intended" else "literal"), "inside")
        kept = grid.join(inside.select("x").distinct(), "x", "left_semi").join(inside.select("y").distinct(), "y", "left_semi")
        mask = small(kept.join(inside.withColumn("in", F.lit(True)), ["x", "y"], "left").select("x", "y", F.struct("in").alias("mask")), "mask")
        return cells.join(mask, ["x", "y"]).withColumn("value", F.when(F.col("mask.in"), F.col("value"))).select(*cells.columns)
    out = cells.where(domain.contains())
    return out.where(time_predicate(domain.time.min, domain.time.max, mode)) if domain.time else out


def ranges(axes: DataFrame) -> DataFrame:
    """``name`` and the least and largest of time, x and y."""
    at = lambda a: F.when(F.col("axis") == a, F.col("at")) if a != "time" else F.col("time")
    return axes.groupBy("name").agg(*[f(at(c)).alias(f"{c}_{n}") for c in ("time", "x", "y") for n, f in (("min", F.min), ("max", F.max))])


def overlap(cells: DataFrame, axes: DataFrame | None = None) -> DataFrame:
    """One row: the largest minimum and the smallest maximum of time, lon and lat over datasets."""
    if axes is not None:
        each = ranges(axes)
    else:
        each = cells.groupBy("name").agg(*[f(c).alias(f"{c}_{n}") for c in ("time", "x", "y") for n, f in (("min", F.min), ("max", F.max))])
    return each.agg(*[f(f"{c}_{n}").alias(f"{a}_{n}") for c, a in (("time", "time"), ("x", "lon"), ("y", "lat")) for n, f in (("min", F.max), ("max", F.min))])


def overlap_bounds(cells: DataFrame, axes: DataFrame | None = None) -> Bounds:
    r = overlap(cells, axes).first()
    if r is None or r.lon_min is None or r.lon_min > r.lon_max or r.lat_min > r.lat_max or r.time_min > r.time_max:
        raise ValueError("the datasets do not overlap")
    return Bounds((r.lon_min, r.lon_max), (r.lat_min, r.lat_max), (r.time_min, r.time_max))


def homogeneous(cells: DataFrame) -> DataFrame:
    """One row: whether all datasets have the same times, longitudes and latitudes."""
    prints = cells.groupBy("name").agg(*[F.sha2(F.array_join(F.transform(F.array_sort(F.collect_set(c)), lambda v: v.cast("string")), ","), 256).alias(c) for c in ("time", "x", "y")])
    return prints.agg((F.count_distinct("time", "x", "y") <= 1).alias("homogeneous"))


def shift_longitude(cells: DataFrame, axes: DataFrame | None = None) -> DataFrame:
    """0..360 to -180..180, for datasets that reach 180 or more."""
    top = small(axis(known(cells, axes), "x").groupBy("name").agg(F.struct(F.max("x").alias("x")).alias("top")), "tops")
    shifted = F.when((F.col("top.x") >= 180) & (F.col("x") >= 180), F.col("x") - 360).otherwise(F.col("x"))
    return cells.join(top, "name").withColumn("x", shifted).select(*cells.columns)


def index_axes(cells: DataFrame) -> DataFrame:
    """``name, x, y, xi, yi``: places on the ascending axes, counted from 0."""
    grid = cells.select("name", "x", "y").distinct()
    rank = lambda c: F.dense_rank().over(Window.partitionBy("name").orderBy(c)) - 1
    return grid.withColumns({"xi": rank("x"), "yi": rank("y")})


def axis_order(places: DataFrame, c: str = "x", index: str = "xi") -> DataFrame:
    """``name, axis, order`` of an axis as it is stored (``name, index, c``): ascending, descending or mixed."""
    step = F.col(c) - F.lag(c).over(Window.partitionBy("name").orderBy(index))
    each = places.select("name", index, c).distinct().withColumn("step", step).groupBy("name").agg(F.min("step").alias("lo"), F.max("step").alias("hi"))
    return each.select("name", F.lit(c).alias("axis"), F.when(F.col("hi") < 0, "descending").when(F.col("lo") < 0, "mixed").otherwise("ascending").alias("order"))


def reverse_axis(cells: DataFrame, c: str = "x", index: str = "xi") -> DataFrame:
    """Cells whose stored places on a descending axis are turned round; a mixed axis stays, with a warning."""
    places = cells.select("name", index, c).distinct()
    order = small(axis_order(places, c, index).join(places.groupBy("name").agg(F.max(index).alias("last")), "name").select("name", F.struct("order", "last").alias("axis")), "orders")
    if mixed := [r["name"] for r in order.where("axis.order = 'mixed'").collect()]:
        warnings.warn(f"axis {c} of {', '.join(mixed)} neither rises nor falls", stacklevel=2)
    turned = F.when(F.col("axis.order") == "descending", F.col("axis.last") - F.col(index)).otherwise(F.col(index))
    return cells.join(order, "name").withColumn(index, turned.cast(cells.schema[index].dataType)).select(*cells.columns)
