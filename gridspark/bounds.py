"""Intervals, boxes and polygons as Column predicates."""

from __future__ import annotations

import datetime as dt
import json
import struct
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import register


@dataclass(frozen=True)
class Domain:
    """A closed interval; on a periodic axis an upper bound below the lower one wraps around."""

    name: str
    bnds: tuple | None = None
    periodic: bool = False
    valid_range: tuple | None = None

    def __post_init__(self) -> None:
        lo, hi = self.bnds or self.valid_range or (None, None)
        if lo is None or hi is None:
            return
        if hi < lo and not self.periodic:
            raise ValueError(f"{self.name}: {hi} is below {lo}")
        if self.valid_range and any(not self.valid_range[0] <= v <= self.valid_range[1] for v in (lo, hi)):
            raise ValueError(f"{self.name}: {lo}, {hi} leave {self.valid_range}")

    @property
    def min(self):
        return (self.bnds or self.valid_range)[0]

    @property
    def max(self):
        return (self.bnds or self.valid_range)[1]

    def __getitem__(self, i: int):
        return (self.min, self.max)[i]

    def with_item(self, i: int, value) -> Domain:
        """The interval with another lower (0) or upper (1) end, checked anew."""
        return replace(self, bnds=(value, self.max) if i == 0 else (self.min, value))

    def slices(self) -> list[tuple]:
        if self.periodic and self.max < self.min:
            return [(self.min, self.valid_range[1]), (self.valid_range[0], self.max)]
        return [(self.min, self.max)]

    def contains(self, c: Column) -> Column:
        parts = [c.between(F.lit(a), F.lit(b)) for a, b in self.slices()]
        return parts[0] if len(parts) == 1 else parts[0] | parts[1]

    def to_dict(self) -> dict:
        a, b = ("Min", "Max") if self.valid_range else ("Start", "End")
        return {f"{self.name}{a}": self.min, f"{self.name}{b}": self.max}


def as_time(value, upper: bool = False):
    """A time given as text: a year, month, day or more.  As an upper end a year, month or day reaches to its last moment."""
    if not isinstance(value, str):
        return value
    for form, n in (("%Y", 4), ("%Y-%m", 7), ("%Y-%m-%d", 10)):
        if len(value) == n:
            first = dt.datetime.strptime(value, form)
            if not upper:
                return first
            after = first.replace(year=first.year + 1) if n == 4 else (first.replace(day=28) + dt.timedelta(days=4)).replace(day=1) if n == 7 else first + dt.timedelta(days=1)
            return after - dt.timedelta(microseconds=1)
    return dt.datetime.fromisoformat(value)


@register("bounds.bbox")
class Bounds:
    """A longitude-latitude-time box; what is not given does not bound.  Times may be text."""

    def __init__(self, lon_bnds=None, lat_bnds=None, time_bnds=None) -> None:
        self.lon = Domain("lon", lon_bnds, periodic=True, valid_range=(-180.0, 180.0))
        self.lat = Domain("lat", lat_bnds, valid_range=(-90.0, 90.0))
        self.time = Domain("time", (as_time(time_bnds[0]), as_time(time_bnds[1], upper=True))) if time_bnds else None

    def to_dict(self) -> dict:
        return self.lon.to_dict() | self.lat.to_dict() | (self.time.to_dict() if self.time else {})

    def contains(self, lon: str | Column = "x", lat: str | Column = "y") -> Column:
        col = lambda c: F.col(c) if isinstance(c, str) else c
        return self.lon.contains(col(lon)) & self.lat.contains(col(lat))


@register("bounds.polygon")
class PolygonBounds(Bounds):
    """Polygons as a table of edges ``poly, ring, x1, y1, x2, y2``; holes are rings like others."""

    def __init__(self, edges: DataFrame) -> None:
        self.edges = edges
        r = edges.agg(F.min("x1"), F.max("x1"), F.min("y1"), F.max("y1")).first()
        super().__init__((r[0], r[1]), (r[2], r[3]))

    @classmethod
    def load(cls, spark: SparkSession, path: str, names: list[str] | None = None, field: str = "NAME", fmt: str | None = None) -> PolygonBounds:
        """Boundaries of a GeoJSON file or a shapefile (with its table of attributes beside it), of any file system Spark reads."""
        fmt = fmt or path.rsplit(".", 1)[-1].lower()
        if fmt in ("json", "geojson"):
            return cls(geojson_edges(spark, path, names, field))
        if fmt == "shp":
            read = lambda p: bytes(spark.read.format("binaryFile").load(p).select("content").first()[0])
            return cls(edges_of(spark, shapes(read(path), read(path[: -len("shp")] + "dbf")), names, field))
        raise ValueError(f"boundaries of format {fmt!r} cannot be read")

    from_geojson = load

    def vertices(self) -> DataFrame:
        return self.edges.select("poly", "ring", F.col("x1").alias("x"), F.col("y1").alias("y"))

    def inside(self, points: DataFrame, mode: str = "parity") -> DataFrame:
        """The distinct ``x, y`` of ``points`` (a grid) that lie in any polygon.

        Parity over all rings leaves holes out; ``literal`` looks at outer rings alone.  Points on
        an edge are undefined.
        """
        edges = self.edges if mode == "parity" else self.edges.where("ring = 0")
        grid = points.where(self.contains()).select("x", "y").distinct()
        at = F.col("x1") + (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
        cross = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < at)
        hit = grid.join(F.broadcast(edges), cross)
        return hit.groupBy("x", "y", "poly").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").select("x", "y").distinct()


def geojson_edges(spark: SparkSession, path: str, names: list[str] | None = None, field: str = "NAME") -> DataFrame:
    """The edges of a GeoJSON file, taken apart by tasks: one row a feature, then a ring, then an edge."""
    features = "array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    rows = spark.read.schema(f"features {features}").option("multiLine", True).json(path).select(F.posexplode("features").alias("k", "f"))
    if names:
        rows = rows.where(F.element_at("f.properties", F.lit(field)).isin(list(names)))
    parts = F.when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json("f.geometry.coordinates", "array<array<array<double>>>"))).otherwise(F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>"))
    rows = rows.select(F.coalesce(F.element_at("f.properties", F.lit(field)), F.col("k").cast("string")).alias("id"), F.posexplode(parts).alias("p", "rings"))
    rows = rows.select(F.concat_ws("/", "id", "p").alias("poly"), F.posexplode("rings").alias("ring", "points"))
    closed = F.when(F.element_at("points", 1) == F.element_at("points", -1), F.col("points")).otherwise(F.concat("points", F.slice("points", 1, 1)))
    pairs = F.arrays_zip(F.slice(F.col("points"), 1, F.size("points") - 1).alias("a"), F.slice(F.col("points"), 2, F.size("points") - 1).alias("b"))
    rows = rows.withColumn("points", closed).select("poly", "ring", F.explode(pairs).alias("e"))
    return rows.select("poly", "ring", *[F.element_at(f"e.{v}", i).alias(f"{c}{k}") for k, v in ((1, "a"), (2, "b")) for i, c in ((1, "x"), (2, "y"))])


def shapes(shp: bytes, dbf: bytes) -> dict:
    """The polygons of a shapefile with their attributes, as GeoJSON features."""
    n, head, size = struct.unpack_from("<IHH", dbf, 4)
    columns, at = [], 32
    while dbf[at] != 0x0D:
        columns.append((dbf[at : at + 11].split(b"\0")[0].decode("latin-1"), dbf[at + 16]))
        at += 32
    tables = []
    for k in range(n):
        place, row = head + k * size + 1, {}
        for name, width in columns:
            row[name] = dbf[place : place + width].decode("utf-8", "replace").strip()
            place += width
        tables.append(row)
    features, at = [], 100
    while at + 8 <= len(shp):
        words = struct.unpack_from(">I", shp, at + 4)[0]
        kind = struct.unpack_from("<I", shp, at + 8)[0]
        rings: list[list] = []
        if kind in (5, 15, 25):
            parts, points = struct.unpack_from("<II", shp, at + 44)
            starts = [*struct.unpack_from(f"<{parts}I", shp, at + 52), points]
            xy = struct.unpack_from(f"<{2 * points}d", shp, at + 52 + 4 * parts)
            rings = [[[xy[2 * i], xy[2 * i + 1]] for i in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)]
        elif kind:
            raise ValueError(f"shapes of type {kind} are no polygons")
        features.append({"properties": tables[len(features)] if len(features) < len(tables) else {}, "geometry": {"type": "Polygon", "coordinates": rings}})
        at += 8 + 2 * words
    return {"type": "FeatureCollection", "features": features}


def edges_of(spark: SparkSession, geojson: dict, names: list[str] | None = None, field: str = "NAME") -> DataFrame:
    """The edges of the features whose ``field`` is among ``names`` (all without names)."""
    rows = []
    for k, feature in enumerate(geojson["features"]):
        if names and feature["properties"].get(field) not in names:
            continue
        g = feature["geometry"]
        polygons = [g["coordinates"]] if g["type"] == "Polygon" else g["coordinates"]
        for p, rings in enumerate(polygons):
            for r, ring in enumerate(rings):
                closed = ring if ring[0] == ring[-1] else [*ring, ring[0]]
                rows += [(f"{feature['properties'].get(field, k)}/{p}", r, *map(float, a[:2]), *map(float, b[:2])) for a, b in zip(closed, closed[1:], strict=False)]
    return spark.createDataFrame(rows, "poly string, ring int, x1 double, y1 double, x2 double, y2 double")
