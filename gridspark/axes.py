"""The axes of datasets: a small table ``name, axis, at, time`` that steps of a plan share.

One row for each distinct place on the axes ``x`` and ``y`` (in ``at``) and for each distinct time
(in ``time``, kept as it is stored).  It is as long as the axes, not as the cells, so ranges, grids,
weights, years and first days are taken from it instead of from another pass over the cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import small


def axes_of(cells: DataFrame) -> DataFrame:
    """One pass: each task first folds its own cells to their distinct places.  Axes that the cells lack have no rows."""
    kind = cells.schema["time"].dataType if "time" in cells.columns else "date"
    none, no_time = F.lit(None).cast("double"), F.lit(None).cast(kind)
    rows = [F.struct(F.lit(a).alias("axis"), F.col(a).cast("double").alias("at"), no_time.alias("time")) for a in ("x", "y") if a in cells.columns]
    if "time" in cells.columns:
        rows.append(F.struct(F.lit("time").alias("axis"), none.alias("at"), F.col("time").alias("time")))
    return cells.select("name", F.explode(F.array(*rows)).alias("p")).select("name", "p.axis", "p.at", "p.time").distinct()


def known(cells: DataFrame, axes: DataFrame | None) -> DataFrame:
    """The axes given, or those of the cells, computed once."""
    return small(axes_of(cells), "axes") if axes is None else axes


def axis(axes: DataFrame, c: str) -> DataFrame:
    """``name, c`` of the places of one axis."""
    return axes.where(F.col("axis") == c).select("name", F.col("time" if c == "time" else "at").alias(c)).where(F.col(c).isNotNull())


def bracket(nodes: DataFrame, points: DataFrame, by: list[str], c: str) -> DataFrame:
    """``by, c_out, below, at_or_above, after``: the nodes around each point, from one sorted sweep.

    ``nodes``: ``by, c``; ``points``: ``by, c_out``.  ``after``: the node that follows ``at_or_above``.
    """
    order = Window.partitionBy(*by).orderBy(c)
    nodes = nodes.select(*by, F.col(c).alias("v"), F.lit(1).alias("kind"), F.struct(F.col(c).alias("v"), F.lead(c).over(order).alias("after")).alias("node"))
    points = points.select(*by, F.col(f"{c}_out").alias("v"), F.lit(0).alias("kind"), F.lit(None).cast(nodes.schema["node"].dataType).alias("node"))
    swept = Window.partitionBy(*by).orderBy("v", "kind")
    rows = nodes.union(points).withColumns({
        "below": F.last("node", ignorenulls=True).over(swept.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "above": F.first("node", ignorenulls=True).over(swept.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    return rows.where("kind = 0").select(*by, F.col("v").alias(f"{c}_out"), F.col("below.v").alias("below"), F.col("above.v").alias("at_or_above"), F.col("above.after").alias("after")).distinct()


def for_each_name(axes: DataFrame, table: DataFrame) -> DataFrame:
    """The rows of ``table`` for each dataset, without a product of tables: the names go along as one array."""
    names = axes.select(F.sort_array(F.collect_set("name")).alias("names")).scalar()
    return table.withColumn("name", F.explode(names))
