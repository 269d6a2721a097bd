import dataclasses
import datetime as dt
import json
import os
import pathlib
import shutil
import struct
import subprocess
import sys

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

import __spark_entry__
from gridspark import tables
from gridspark.adapters import Adapter, rename_axes
from gridspark.bounds import Bounds, Domain, PolygonBounds
from gridspark.functions.metadata import build_extractor
from gridspark.model import Ensemble, concat
from gridspark.operators import regrid, spatial, timeops
from gridspark.plans.catalog import ORACLE, QUERIES
from gridspark.registry import Registry, register, registry
from gridspark.sources import load_bucket, load_esgf, load_intake, load_intake_esm, load_local, names_from_paths, netcdf, select_variable

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    plain = lambda v: v.date() if isinstance(v, dt.datetime) and v.time() == dt.time() else v
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    want = duck.execute("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({ORACLE[name]}) AS q").fetchall()
    assert got == sorted((tuple(plain(v) for v in r) for r in want), key=repr)


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_season_months():
    assert [timeops.season_months(s) for s in ("DJF", "MAM", "J", "JJ", "A", "JFMAMJJASOND")] == [(12, 2), (3, 5), (1, 1), (6, 7), (4, 4), (1, 12)]
    with pytest.raises(ValueError):
        timeops.season_months("XYZ")


def _months(spark, first=1990, years=3):
    return spark.createDataFrame([("a", dt.date(first + i // 12, i % 12 + 1, 1), 0.0, 0.0, float(i)) for i in range(12 * years)], "name string, time date, x double, y double, value double")


@pytest.mark.parametrize(("mode", "count"), [("intended", 6), ("literal", 7)])
def test_djf_cut(spark, mode, count):
    times = sorted(r.time for r in timeops.select_season(_months(spark), "DJF", mode).collect())
    assert len(times) == count and times[0] == dt.date(1990, 12, 1) and times[5] == dt.date(1992, 2, 1)


def test_domains():
    assert Domain("lon", (170, -170), True, (-180, 180)).slices() == [(170, 180), (-180, -170)]
    assert Bounds((0, 10), (0, 5)).to_dict() == {"lonMin": 0, "lonMax": 10, "latMin": 0, "latMax": 5}
    with pytest.raises(ValueError):
        Domain("lat", (10, 0))
    with pytest.raises(ValueError):
        Bounds(lat_bnds=(-100, 0))


def test_linear_reproduces_planes_and_numpy(spark):
    xs, ys = [0.0, 1.0, 3.0, 7.0], [0.0, 2.0, 5.0]
    cells = spark.createDataFrame([("a", dt.date(2000, 1, 1), x, y, 1 + 2 * x + 3 * y + x * y) for x in xs for y in ys], "name string, time date, x double, y double, value double")
    target = spark.createDataFrame([(x, y) for x in (0.0, 0.5, 3.0, 6.9, 8.0) for y in (0.0, 1.5, 5.0)], "x double, y double")
    got = {(r.x, r.y): r.value for r in regrid.regrid(cells, target).collect()}
    assert len(got) == 12
    assert all(np.isclose(v, 1 + 2 * x + 3 * y + x * y) for (x, y), v in got.items())


def test_missing_corner_is_missing(spark):
    cells = spark.createDataFrame([("a", 1, x, y, None if (x, y) == (1.0, 1.0) else 1.0) for x in (0.0, 1.0, 2.0) for y in (0.0, 1.0)], "name string, time int, x double, y double, value double")
    target = spark.createDataFrame([(0.5, 0.5), (1.5, 0.0)], "x double, y double")
    assert {r.value for r in regrid.regrid(cells, target).collect()} == {None}


def test_conservative_keeps_the_integral_of_a_constant(spark):
    cells = spark.createDataFrame([("a", 1, float(x), float(y), 5.0) for x in range(0, 40, 10) for y in range(-20, 30, 10)], "name string, time int, x double, y double, value double")
    target = spark.createDataFrame([(float(x), float(y)) for x in (5, 15) for y in (-10, 10)], "x double, y double")
    assert {round(r.value, 9) for r in regrid.regrid(cells, target, "conservative").collect()} == {5.0}


def test_ensemble(spark):
    c = _months(spark)
    e = Ensemble(c, ["a"])
    with pytest.raises(ValueError):
        concat(e, e)
    with pytest.raises(ValueError):
        e.bundle("b").add_mean("b", "a")
    assert e.bundle("b").add_mean("b").names == ["a", "ENS"] and len(e) == 1
    with pytest.raises(NotImplementedError):
        regrid.regrid(c, c, "patch")
    with pytest.raises(ValueError):
        spatial.overlap_bounds(c.unionByName(c.selectExpr("'b' name", "time", "x + 5 x", "y", "value")))


def test_frequencies(spark):
    def freq(*times):
        return timeops.infer_frequency(spark.createDataFrame([("a", t) for t in times], "name string, time timestamp_ntz")).first().freq

    day = dt.datetime(2000, 1, 1)
    assert freq(*(day + dt.timedelta(hours=6 * i) for i in range(4))) == "6h"
    assert freq(*(dt.datetime(2000 + i, 1, 1) for i in range(3))) == "YS"
    assert freq(day, day + dt.timedelta(days=1), day + dt.timedelta(days=5)) == "unknown"
    assert freq(day) == "unknown"


def test_sources_and_registry(spark):
    assert names_from_paths(["/a/x_1.nc", "/a/x_22.nc"]) == ["1", "22"]
    with pytest.raises(NotImplementedError):
        load_esgf()
    with pytest.raises(ValueError):
        select_variable(spark.createDataFrame([(1, 2, 3, 4, 5)], "time int, x int, y int, a int, b int"))
    r = Registry()
    r["a.b"] = 1
    assert r["a.b"] == 1 and r["a"]["b"] == 1
    with pytest.raises(ValueError):
        del r["a"]
    e = build_extractor("t", "*_{model}_*_{variable}.nc", index=[1, 6])
    assert (e.fields, e.sep, e.ext, e.place("variable")) == (("model", "variable"), "_", ".nc", 6)
    with pytest.raises(ValueError):
        e.place("other")


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_plans_have_no_cartesian_product_and_push_filters(spark, capsys):
    QUERIES["subset_box"](spark, SF).explain()
    regrid.regrid(QUERIES["select_label"](spark, SF), QUERIES["grid_from_data"](spark, SF)).explain()
    assert "CartesianProduct" not in capsys.readouterr().out
    plan = _plan(QUERIES["select_label"](spark, SF))
    assert "PushedFilters: [In(l_returnflag" in plan and "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_quantity:double,l_returnflag:string" in plan.replace("l_shipdate:timestamp_ntz", "")


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if n.startswith(("regrid", "homogenize", "flagship", "polygon_subset", "meshgrid"))])
def test_plans_read_the_cells_once_and_have_no_nested_loops(spark, name):
    plan = _plan(QUERIES[name](spark, SF)).split("== Physical Plan ==")[1]
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    reads = sum("FileScan parquet" in line and "lineitem" in line for line in plan.split("\n"))
    # The ensemble mean stands beside its members, so the flagship reads them twice.
    assert reads <= (2 if name == "flagship" else 1)


def test_bins_do_not_depend_on_the_time_zone(spark):
    hours = [("a", dt.datetime(2024, 3, 30) + dt.timedelta(hours=i), 0.0, 0.0, float(i)) for i in range(72)]
    cells = spark.createDataFrame(hours, "name string, time timestamp_ntz, x double, y double, value double")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Europe/Berlin", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = {r.time: r.value for r in timeops.resample(cells, "6h").collect()}
            assert got == {dt.datetime(2024, 3, 30) + dt.timedelta(hours=6 * k): 6 * k + 2.5 for k in range(12)}
            assert timeops.infer_frequency(cells).first().freq == "h"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_values_keep_their_digits(spark):
    cells = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), 0.0, 0.0, 0.001)], "name string, time timestamp_ntz, x double, y double, value double")
    assert timeops.resample(cells, "D").first().value == 0.001


def test_frequencies_by_month_ends_and_seasons(spark):
    def freq(*days):
        return timeops.infer_frequency(spark.createDataFrame([("a", dt.date.fromisoformat(t)) for t in days], "name string, time date")).first().freq

    assert freq("2000-01-31", "2000-02-29", "2000-03-31") == "ME" and freq("2000-12-31", "2001-12-31", "2002-12-31") == "YE"
    assert freq("2000-12-16", "2001-01-16", "2001-02-15", "2001-12-16") == "MS"
    assert freq("2000-03-31", "2000-06-30", "2000-09-30") == "QE"


def test_resampling_leaves_what_has_the_frequency(spark):
    day = lambda n: [(n, dt.date(2000, 1, 1) + dt.timedelta(days=i), 0.0, 0.0, float(i)) for i in range(60)]
    e = Ensemble(_months(spark, 2000, 1).unionByName(spark.createDataFrame(day("b"), "name string, time date, x double, y double, value double")), ["a", "b"])
    got = e.bundle("all").resample(gaps=False)
    assert got["a"].count() == 12 and got["b"].count() == 2 and {r.bundle for r in got.cells.collect()} == {"all"}
    assert e.resample("Y", reference="b").cells.count() == 2 and e[["a"]].resample("MS").cells.count() == 12


def test_month_units(spark):
    d = timeops.decode_month_units(spark.createDataFrame([(0.0,), (13.0,), (None,)], "time double"), "months since 1999-12-01 00:00:00")
    assert [(r.time.year, r.time.month, r.time.day) for r in d.collect()][:2] == [(1999, 12, 1), (2001, 1, 1)]
    for units, value in (("days since 2000-01-01", 1.0), ("months since 2000-01-15", 1.0), ("months since 2000-01-01", 1.5)):
        with pytest.raises(ValueError):
            timeops.decode_month_units(spark.createDataFrame([(value,)], "time double"), units)


def test_bounds_of_text_times():
    b = Bounds(time_bnds=("1990", "1990-02"))
    assert b.time.min == dt.datetime(1990, 1, 1) and b.time.max == dt.datetime(1990, 2, 28, 23, 59, 59, 999999)
    assert Domain("lon", (0, 10), True, (-180, 180)).with_item(1, -10).slices() == [(0, 180), (-180, -10)]
    with pytest.raises(ValueError):
        Domain("lat", (0, 10), False, (-90, 90)).with_item(0, 20)


RINGS = [[[0.0, 0.0], [0.0, 8.0], [8.0, 8.0], [8.0, 0.0], [0.0, 0.0]], [[2.0, 2.0], [4.0, 2.0], [4.0, 4.0], [2.0, 4.0], [2.0, 2.0]]]


def _shapefile(folder):
    body = struct.pack("<I4d2I2I", 5, 0, 0, 8, 8, 2, 10, 0, 5) + b"".join(struct.pack("<2d", *p) for r in RINGS for p in r)
    other = struct.pack("<I4d2II", 5, 20, 20, 21, 21, 1, 4, 0) + struct.pack("<8d", 20, 20, 21, 20, 21, 21, 20, 20)
    records = b"".join(struct.pack(">2I", k + 1, len(r) // 2) + r for k, r in enumerate((body, other)))
    (folder / "b.shp").write_bytes(bytes(100) + records)
    column = b"NAME".ljust(11, b"\0") + b"C" + bytes(4) + bytes([6]) + bytes(15)
    (folder / "b.dbf").write_bytes(struct.pack("<4BIHH", 3, 0, 0, 0, 2, 65, 7) + bytes(20) + column + b"\r" + b" hole  " + b" other ")
    features = [{"properties": {"NAME": "hole"}, "geometry": {"type": "Polygon", "coordinates": RINGS}}, {"properties": {"NAME": "other"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[20, 20], [21, 20], [21, 21]]]]}}]
    (folder / "b.geojson").write_text(json.dumps({"features": features}))


@pytest.mark.parametrize("file", ["b.shp", "b.geojson"])
def test_polygon_files(spark, tmp_path, file):
    _shapefile(tmp_path)
    grid = spark.createDataFrame([(1.0, 1.0), (3.0, 3.0), (7.0, 5.0), (20.8, 20.3), (9.0, 1.0)], "x double, y double")
    inside = lambda names: {(r.x, r.y) for r in PolygonBounds.load(spark, f"{tmp_path}/{file}", names).inside(grid).collect()}
    assert inside(["hole"]) == {(1.0, 1.0), (7.0, 5.0)} and inside(None) == {(1.0, 1.0), (7.0, 5.0), (20.8, 20.3)}
    assert PolygonBounds.load(spark, f"{tmp_path}/{file}", ["other"]).to_dict() == {"lonMin": 20, "lonMax": 21, "latMin": 20, "latMax": 21}
    with pytest.raises(ValueError):
        PolygonBounds.load(spark, f"{tmp_path}/b.kml")


def test_adapter(spark):
    d = spark.createDataFrame([(1, 200.0, 10.0, 5.0)], "julian int, lons double, other double, v double")
    got = Adapter()(d, y="other")
    assert got.columns == ["time", "x", "y", "v"] and got.first().x == -160.0
    assert [f.metadata.get("axis") for f in got.schema] == ["T", "X", "Y", None]
    assert Adapter()(got).collect() == got.collect()  # once adapted, always adapted
    marked = d.select(F.col("other").alias("far", metadata={"axis": "Y"}), "lons", "julian", "v")
    assert Adapter()(marked).columns == ["y", "x", "time", "v"]
    with pytest.raises(ValueError):
        rename_axes(d.withColumn("lon", F.lit(1)).withColumn("longitude", F.lit(1)))
    with pytest.raises(ValueError):
        rename_axes(d, y="absent")

    class Scaled(Adapter):
        def post_process(self, df):
            return df.withColumn("v", F.col("v") * 2)

    assert Scaled()(d).first().v == 10.0
    with pytest.warns(UserWarning, match="neither rises nor falls"):
        spatial.reverse_axis(spark.createDataFrame([("a", k, x) for k, x in enumerate((1.0, 3.0, 2.0))], "name string, xi int, x double"))


def test_local_files(spark, tmp_path):
    cells = _months(spark, 2000, 1).drop("name")
    for n in ("m1", "m2"):
        cells.where("month(time) < 7").write.parquet(f"{tmp_path}/x_mon_{n}_h_r_200001-200006.parquet")
        cells.where("month(time) > 6").drop("time").limit(1).write.parquet(f"{tmp_path}/x_mon_{n}_h_r_200007-200012.parquet")
    e = load_local(spark, str(tmp_path), project="CMIP5", convert_times=True, chunks=3)
    assert e.names == ["m1", "m2"] and e["m1"].count() == 7 and e["m2"].agg(F.max("time")).first()[0] == dt.date(2000, 7, 1)
    assert load_local(spark, [f"{tmp_path}/*m1*06.parquet", f"{tmp_path}/*m2*06.parquet"], load_all=True).names == ["1", "2"]
    data = registry["metadata.CMIP5"].at(str(tmp_path))
    assert dataclasses.replace(data, ext=".parquet").names(dataclasses.replace(data, ext=".parquet").data(spark)).count() == 2
    with pytest.raises(ValueError):
        load_local(spark, f"{tmp_path}/none*")
    with pytest.raises(NotImplementedError):
        load_local(spark, [f"{tmp_path}/x_mon_m1_h_r_200001-200006.parquet", "a.nc"], names=["a", "b"]) if (tmp_path / "a.nc").write_text("") is None else load_local(spark, f"{tmp_path}/*.nc")


def _cdf(path, version, dims, variables, records=0, unknown=False):
    """A classic NetCDF file, written field by field; ``variables``: name -> (dims, type, attributes, array)."""
    n, off = (">q", ">q") if version == 5 else (">i", ">i" if version == 1 else ">q")
    kinds = {"i1": 1, "S1": 2, ">i2": 3, ">i4": 4, ">f4": 5, ">f8": 6, ">i8": 10}
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    num = lambda v: struct.pack(n, v)
    text = lambda t: num(len(t)) + pad(t.encode())

    def attributes(a):
        out = struct.pack(">i", 12 if a else 0) + num(len(a))
        for k, v in a.items():
            v = np.frombuffer(v.encode(), "S1") if isinstance(v, str) else np.atleast_1d(v)
            out += text(k) + struct.pack(">i", kinds["S1" if v.dtype.kind == "S" else v.dtype.str if v.dtype.itemsize > 1 else "i1"]) + num(len(v)) + pad(v.tobytes())
        return out

    names = list(dims)
    variables = {k: (d, kind, a, v.astype(kind)) for k, (d, kind, a, v) in variables.items()}
    alone = sum("time" in d[:1] and dims["time"] == 0 for d, *_ in variables.values()) == 1
    each = lambda d, a: a[:1].tobytes() if dims[d[0]] == 0 else a.tobytes()

    def header(begins):
        out = b"CDF" + bytes([version]) + num(-1 if unknown else records) + struct.pack(">i", 10) + num(len(dims)) + b"".join(text(k) + num(v) for k, v in dims.items())
        out += attributes({"title": "t"}) + struct.pack(">i", 11) + num(len(variables))
        for k, (d, kind, a, values) in variables.items():
            out += text(k) + num(len(d)) + b"".join(num(names.index(x)) for x in d) + attributes(a) + struct.pack(">i", kinds[kind]) + num(len(pad(each(d, values)))) + struct.pack(off, begins[k])
        return out

    at, begins, body = len(header(dict.fromkeys(variables, 0))), {}, b""
    for k, (d, _, _, a) in variables.items():
        if dims[d[0]] != 0:
            begins[k], body = at + len(body), body + pad(a.tobytes())
    of_records = {k: v for k, v in variables.items() if dims[v[0][0]] == 0}
    start = at + len(body)
    for k, (_, _, _, a) in of_records.items():
        begins[k], start = start, start + (len(a[:1].tobytes()) if alone else len(pad(a[:1].tobytes())))
    for r in range(records):
        for _, _, _, a in of_records.values():
            body += a[r : r + 1].tobytes() if alone else pad(a[r : r + 1].tobytes())
    path.write_bytes(header(begins) + body)


@pytest.mark.parametrize(("version", "unknown"), [(1, False), (2, True), (5, False)])
def test_netcdf(spark, tmp_path, version, unknown):
    lat, lon = np.array([-10.0, 0.0, 10.0], ">f8"), np.array([100.0, 200.0], ">f4")
    packed = np.arange(12, dtype=">i2").reshape(2, 3, 2)
    packed[0, 1, 1], packed[1, 2, 0] = -1, -32767  # missing as marked, and never written
    clt = {"scale_factor": np.array(0.5, ">f8"), "add_offset": np.array(10.0, ">f4"), "missing_value": np.array(-1, ">i2"), "coordinates": "height"}
    bounds = np.zeros((2, 2), ">f8")
    variables = {
        "lat": (["lat"], ">f8", {"units": "degrees_north"}, lat), "lon": (["lon"], ">f4", {}, lon),
        "time": (["time"], ">f8", {"units": "days since 2001-01-31 12:00", "bounds": "time_bnds"}, np.array([0.0, 31.25], ">f8")),
        "time_bnds": (["time", "nv"], ">f8", {}, bounds), "odd": (["time", "nv"], "i1", {"units": "1"}, np.ones((2, 2), "i1")),
        "clt": (["time", "lat", "lon"], ">i2", clt, packed),
    }
    dims = {"time": 0, "lat": 3, "lon": 2, "nv": 2}
    for name in "ab":
        _cdf(tmp_path / f"clt_mon_{name}_h_r_200101-200102.nc", version, dims, variables, 2, unknown)
    e = load_local(spark, f"{tmp_path}/*.nc", variable="clt")
    times = [dt.datetime(2001, 1, 31, 12), dt.datetime(2001, 3, 3, 18)]
    want = {(t, -160.0 if x == 200 else x, y): None if packed[k, j, i] < 0 else 10 + 0.5 * packed[k, j, i] for k, t in enumerate(times) for j, y in enumerate(lat) for i, x in enumerate(lon)}
    for name in "ab":
        assert {tuple(r)[:3]: r.value for r in e[name].select("time", "x", "y", "value").collect()} == want and e[name].count() == 12
    assert load_local(spark, str(tmp_path), project="CMIP5", variable="clt").names == ["a", "b"]
    with pytest.raises(ValueError, match="name one"):
        load_local(spark, f"{tmp_path}/*.nc")
    with pytest.raises(ValueError, match="no variable"):
        load_local(spark, f"{tmp_path}/*.nc", variable="pr")
    whole = (tmp_path / "clt_mon_a_h_r_200101-200102.nc").read_bytes()
    if not unknown:
        (tmp_path / "cut.cdf").write_bytes(whole[:-8])
        with pytest.raises(Exception, match="the file ends within"):
            load_local(spark, f"{tmp_path}/cut.cdf", variable="clt").cells.collect()
    (tmp_path / "short.cdf").write_bytes(whole[:90])
    with pytest.raises(ValueError, match="ends within its header"):
        load_local(spark, f"{tmp_path}/short.cdf")
    # One record variable alone stands without padding; a dimension without a variable gives places; coordinates of two dimensions come along.
    places = np.arange(6, dtype=">f8").reshape(2, 3)
    alone = {"nav_lon": (["j", "i"], ">f8", {}, places), "nav_lat": (["j", "i"], ">f8", {}, places + 1), "v": (["time", "j", "i"], ">i2", {"coordinates": "nav_lon nav_lat"}, np.arange(18, dtype=">i2").reshape(3, 2, 3)), "text": (["i"], "S1", {}, np.array([b"a", b"b", b"c"], "S1"))}
    _cdf(tmp_path / "alone.cdf", version, {"time": 0, "j": 2, "i": 3}, alone, 3, unknown)
    got = sorted(tuple(r) for r in netcdf.read_netcdf(spark, [f"{tmp_path}/alone.cdf"]).select("time", "j", "i", "nav_lon", "nav_lat", "v").collect())
    assert got == [(t, j, i, j * 3.0 + i, j * 3.0 + i + 1, float(t * 6 + j * 3 + i)) for t in range(3) for j in range(2) for i in range(3)]


def test_times_of_calendars():
    at = lambda n, units, calendar="standard": [str(v)[:19] for v in netcdf.decode_times(np.array(n, "f8"), units, calendar)]
    assert at([0.5, np.nan], "days since 2000-02-29") == ["2000-02-29T12:00:00", "NaT"]
    assert at([6], "hours since 1999-12-31 21:30:15") == ["2000-01-01T03:30:15"]
    assert at([59, 365], "days since 2000-01-01", "noleap") == ["2000-03-01T00:00:00", "2001-01-01T00:00:00"]
    assert at([59, 60], "days since 2001-01-01", "all_leap") == ["NaT", "2001-03-01T00:00:00"]
    assert at([30, 59, 360], "days since 2001-01-01", "360_day") == ["2001-02-01T00:00:00", "NaT", "2002-01-01T00:00:00"]
    assert at([0, 13], "months since 1999-12-01") == ["1999-12-01T00:00:00", "2001-01-01T00:00:00"]
    # 14 October 1582 never was: the day after the 4th is the 15th.
    assert at([0, 1], "days since 1582-10-04") == ["1582-10-14T00:00:00", "1582-10-15T00:00:00"]
    assert at([730120], "days since 0001-01-01", "proleptic_gregorian") == ["2000-01-02T00:00:00"] and at([730122], "days since 1-1-1") == ["2000-01-02T00:00:00"]
    for bad in ((0.5, "months since 2000-01-01", "standard"), (1, "fortnights since 2000-01-01", "standard"), (1, "days since 2000-01-01", "julian")):
        with pytest.raises(ValueError):
            at([bad[0]], *bad[1:])


def test_other_sources(spark, tmp_path):
    cells = _months(spark).drop("name")
    cells.write.parquet(f"{tmp_path}/a.parquet")
    got = load_bucket(spark, "s3://b/data/*", opener=lambda p: cells, lister=lambda p: [p.replace("*", n) for n in ("one", "two")])
    assert got.names == ["one", "two"]
    with pytest.raises(ValueError):
        load_bucket(spark, "ftp://x/y")
    with pytest.raises(NotImplementedError):
        load_bucket(spark, "gc://b/x.zarr")
    nested = {"ocean": {"container": "catalog", "entries": {"sst": {"container": "xarray", "path": f"{tmp_path}/a.parquet"}, "t": {"container": "csv"}}}, "land": {"container": "xarray", "path": f"{tmp_path}/a.parquet"}}
    (tmp_path / "c.json").write_text(json.dumps(nested))
    assert load_intake(spark, catfile=f"{tmp_path}/c.json").names == ["sst", "land"] and load_intake(spark, catfile=f"{tmp_path}/c.json", names=["ocean.sst"]).names == ["sst"]
    assert load_intake(spark, catfile=f"{tmp_path}/c.json", depth=1).names == ["land"]
    (tmp_path / "e.csv").write_text(f"variable_id,source_id,path\nvalue,m1,{tmp_path}/a.parquet\npr,m1,x\n")
    assert load_intake_esm(spark, {"variable_id": "value"}, catfile=f"{tmp_path}/e.csv").names == ["value.m1"]
    with pytest.raises(ValueError):
        load_intake_esm(spark, {"no": "x"}, catfile=f"{tmp_path}/e.csv")
    for load in (lambda: load_intake(spark), lambda: load_intake_esm(spark, {"a": "b"})):
        with pytest.raises(NotImplementedError):
            load()
    with pytest.raises(ValueError):
        load_esgf(node="MARS")


def test_distance_regridding_near_the_poles_and_the_date_line(spark):
    rnd = np.random.default_rng(1)
    src = [(float(x), float(y)) for x, y in zip(rnd.uniform(-180, 180, 400), np.concatenate([rnd.uniform(-90, 90, 200), rnd.uniform(88, 90, 200)]), strict=True)] + [(179.95, 10.0), (-179.95, 40.0)]
    dst = [(float(x), float(y)) for x, y in zip(rnd.uniform(-180, 180, 80), np.concatenate([rnd.uniform(-90, 90, 40), rnd.uniform(88, 90, 40)]), strict=True)] + [(-179.95, 10.0), (179.95, 40.0)]
    nodes = spark.createDataFrame([("a", *p) for p in src], "name string, x double, y double")
    got = {(r.xo, r.yo): (r.x, r.y) for r in regrid.DistanceRegridder.nearest(nodes, spark.createDataFrame(dst, "x double, y double"), 50_000.0).collect()}

    def far(a, b):
        (x1, y1), (x2, y2) = np.radians(a), np.radians(b)
        return 2 * 6371228.0 * np.arcsin(min(1, np.sqrt(np.sin((y2 - y1) / 2) ** 2 + np.cos(y1) * np.cos(y2) * np.sin((x2 - x1) / 2) ** 2)))

    want = {p: min(src, key=lambda q, p=p: far(p, q)) for p in dst if min(far(p, q) for q in src) <= 50_000}
    assert got == want and len(want) > 20 and (-179.95, 10.0) in want


def test_curvilinear_weights_reproduce_bilinear_fields(spark):
    lon = lambda i, j: i + 0.3 * j + 0.05 * i * j
    lat = lambda i, j: j - 0.2 * i + 0.02 * i * j
    cells = spark.createDataFrame([("a", 1, i, j, lon(i, j), lat(i, j), 3.0 * i + 2.0 * j + i * j) for i in range(6) for j in range(5)], "name string, time int, xi int, yi int, lon double, lat double, value double")
    points = [(i + s, j + t) for i in range(5) for j in range(4) for s, t in ((0.2, 0.7), (0.5, 0.5))]
    target = spark.createDataFrame([(lon(u, v), lat(u, v)) for u, v in points] + [(-9.0, 0.0)], "x double, y double")
    got = {(round(r.x, 9), round(r.y, 9)): r.value for r in regrid.regrid_curvilinear(cells, target).collect()}
    assert len(got) == len(points)
    assert all(np.isclose(got[round(lon(u, v), 9), round(lat(u, v), 9)], 3 * u + 2 * v + u * v) for u, v in points)


def test_regridders(spark):
    c = QUERIES["select_label"](spark, SF)
    own = Ensemble(c, ["A", "R"])
    assert sorted(map(str, own.regrid("A").cells.collect())) == sorted(map(str, own.cells.collect()))
    target = regrid.grid_from_res(spark, (30, 30), (-60, 60), (-30, 30))
    kept = own.regrid(target, "nearest", clean=True).cells.count()
    assert kept == own.regrid(target, backend="scipy", method="nearest").cells.count()
    with pytest.raises(NotImplementedError):
        own.regrid(target, "patch")
    with pytest.raises(NotImplementedError):
        own.regrid(target, "linear", backend="pyresample")

    @register("regridder.first")
    class First(regrid.Regridder):
        methods = ("first",)

        def weights(self, axes):
            return {}

        def apply(self, cells, weights):
            return cells.where("x < 0")

    assert own.regrid(target, backend="first").cells.where("x >= 0").count() == 0


def test_large_tables_are_written_instead_of_held(spark, monkeypatch):
    c = _months(spark)
    target = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "x double, y double")
    near = lambda: sorted(map(str, regrid.nearest_grid(c, target).collect()))
    want = near()
    for most in ((3, 10), (3, 0)):
        monkeypatch.setattr(tables, "MOST_LOCAL", most[0])
        monkeypatch.setattr(tables, "MOST_BROADCAST", most[1])
        assert near() == want


def test_the_rest_imports_without_the_training_data_operators(tmp_path):
    root = pathlib.Path(__file__).parent.parent
    for gone in (("gridspark/llm", "tests/llm"), ("gridspark/llm", "tests/llm", "corpus_pipeline.py")):
        tree = tmp_path / str(len(gone))
        shutil.copytree(root, tree, ignore=lambda folder, names, gone=gone: [n for n in names if n == ".git" or os.path.relpath(os.path.join(folder, n), root) in gone])
        code = "import __spark_entry__ as e; q = e.queries(); assert q.keys() >= e.oracle_sql().keys() and 'flagship' in q and not any(k.startswith('op') or k == 'pipeline' for k in q)"
        subprocess.run([sys.executable, "-c", code], cwd=tree, env={**os.environ, "PYTHONPATH": str(tree)}, check=True)
