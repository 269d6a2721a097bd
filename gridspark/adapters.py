"""Adapters: tables of gridded data under any column names to canonical coordinates.

``x, y, lev, time`` are the axes; ``lon, lat`` the places of cells, which on a rectilinear grid are
``x`` and ``y``.  Columns are told by an ``axis`` attribute in their metadata (X, Y, Z, T), by what
the caller says, or by known names, in this order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import spatial
from .registry import register

#: Names by which axes are known.
SYNONYMS = {
    "x": ("x", "lon", "lons", "longitude", "longitudes", "rlon", "nlon", "i", "nav_lon"),
    "y": ("y", "lat", "lats", "latitude", "latitudes", "rlat", "nlat", "j", "nav_lat"),
    "lev": ("lev", "plev", "level"),
    "time": ("time", "times", "date", "dates", "julian"),
}
#: The axis attributes.
ATTRIBUTES = {"x": "X", "y": "Y", "lev": "Z", "time": "T"}
#: Names that stand for places where a table has columns for an axis besides.
_PLACES = {"x": ("lon", "lons", "longitude", "longitudes", "nav_lon"), "y": ("lat", "lats", "latitude", "latitudes", "nav_lat")}


def axis_columns(df: DataFrame, labels: dict[str, str] | None = None) -> dict[str, str]:
    """Each column that is an axis or a place, and its canonical name."""
    labels = {axis: column for axis, column in (labels or {}).items() if column}
    if missing := [c for c in labels.values() if c not in df.columns]:
        raise ValueError(f"no columns {missing}")
    out: dict[str, str] = {}
    for axis, names in SYNONYMS.items():
        marked = [f.name for f in df.schema if f.metadata.get("axis", "").upper() == ATTRIBUTES[axis]]
        found = marked or ([labels[axis]] if axis in labels else [c for c in df.columns if c.lower() in names])
        places = [c for c in df.columns if c.lower() in _PLACES.get(axis, ())]
        if len(found) > 1 or (found and places and places != found):
            # A curvilinear grid: an axis and, for each of its points, a place.
            found, place = [c for c in found if c not in places], places
            if len(found) != 1 or len(place) != 1:
                raise ValueError(f"columns {[*found, *place]} could all be {axis}")
            out[place[0]] = {"x": "lon", "y": "lat"}[axis]
        if found:
            out[found[0]] = axis
    if len({*out.values()}) < len(out):
        raise ValueError(f"more than one column for an axis: {out}")
    return out


def rename_axes(df: DataFrame, **labels: str) -> DataFrame:
    """Axis columns by their canonical names, with their axis attribute; ``labels`` names columns that the known names leave out."""
    canonical = axis_columns(df, labels)
    cols = []
    for f in df.schema:
        name = canonical.get(f.name, f.name)
        marked = {**f.metadata, "axis": ATTRIBUTES[name]} if f.name in canonical and name in ATTRIBUTES else f.metadata
        cols.append(F.col(f"`{f.name}`").alias(name, metadata=marked))
    return df.select(*cols)


def mesh(df: DataFrame) -> DataFrame:
    """``lon`` and ``lat`` of a rectilinear grid are its axes."""
    return df.withColumns({c: F.col(a) for c, a in (("lon", "x"), ("lat", "y")) if c not in df.columns and a in df.columns})


@register("adapter.basic")
class Adapter:
    """Renames axes, brings longitudes to -180..180, and passes the table to ``post_process``, which subclasses override."""

    def __call__(self, df: DataFrame, x: str | None = None, y: str | None = None, z: str | None = None, t: str | None = None) -> DataFrame:
        df = rename_axes(df, **{k: v for k, v in (("x", x), ("y", y), ("lev", z), ("time", t)) if v})
        return self.post_process(self.wrap(df))

    def wrap(self, df: DataFrame) -> DataFrame:
        """Longitudes, and the axis where it is one: on a curvilinear grid ``x`` is a number of a column and stays."""
        own, marks = "name" in df.columns, {f.name: f.metadata for f in df.schema}
        df = df if own else df.withColumn("name", F.lit(""))
        if "lon" in df.columns:
            top = df.groupBy("name").agg(F.max("lon").alias("lon")).withColumn("lon", F.struct("lon"))
            df = spatial.shift_longitude(df.withColumns({"x": F.col("lon"), "kept": F.struct("x")}), top.select("name", F.lit("x").alias("axis"), F.col("lon.lon").alias("at"), F.lit(None).cast("date").alias("time")))
            df = df.withColumns({"lon": F.col("x"), "x": F.col("kept.x")}).drop("kept")
        elif "x" in df.columns:
            top = df.groupBy("name").agg(F.max("x").alias("at")).select("name", F.lit("x").alias("axis"), "at", F.lit(None).cast("date").alias("time"))
            df = spatial.shift_longitude(df, top)
        return df.select(*[F.col(f"`{c}`").alias(c, metadata=marks[c]) for c in marks])

    def post_process(self, df: DataFrame) -> DataFrame:
        return df
