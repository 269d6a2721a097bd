"""One query per operator over cubes derived from the test tables, and equivalent SQL."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import mesh
from ..axes import known
from ..bounds import Bounds, PolygonBounds, edges_of
from ..functions import metadata as md
from ..model import Ensemble, bias, concat
from ..operators import regrid as rg
from ..operators import spatial, timeops
from ..registry import registry
from ..tables import shared_dir
from .. import sources

#: The cubes that the queries are made on.
_X, _Y = "CAST(-157.5 AS DOUBLE) + 45 * (l_suppkey % 8)", "CAST(-67.5 AS DOUBLE) + 45 * (l_partkey % 4)"
OBS = f"SELECT l_returnflag AS name, CAST(l_shipdate AS DATE) AS time, {_X} AS x, {_Y} AS y, l_quantity AS value FROM lineitem"
CUBE = f"SELECT name, CAST(date_trunc('month', time) AS DATE) AS time, x, y, avg(value) AS value FROM ({OBS}) AS o GROUP BY 1, 2, 3, 4"
_HX = f"CASE l_returnflag WHEN 'N' THEN CAST(22.5 AS DOUBLE) + 45 * (l_suppkey % 8) WHEN 'R' THEN CAST(-168.75 AS DOUBLE) + CAST(22.5 AS DOUBLE) * (l_suppkey % 16) ELSE {_X} END"
_HY = f"CASE l_returnflag WHEN 'R' THEN CAST(-78.75 AS DOUBLE) + CAST(22.5 AS DOUBLE) * (l_partkey % 8) ELSE {_Y} END"
HETERO = f"SELECT l_returnflag AS name, CAST(date_trunc('month', l_shipdate) AS DATE) AS time, {_HX} AS x, {_HY} AS y, avg(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3, 4"
EV = "SELECT event_type AS name, ts AS time, CAST(-165 AS DOUBLE) + 30 * (user_id % 12) AS x, CAST(-75 AS DOUBLE) + 30 * (CAST(floor(user_id / 12) AS BIGINT) % 6) AS y, CAST(value AS DOUBLE) AS value FROM events"
_WITH = {"obs": OBS, "cube": CUBE, "hetero": HETERO, "ev": EV}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = "events" if name == "ev" else "lineitem"
    return spark.sql(_WITH[name].replace(f"FROM {source}", "FROM {source}"), source=spark.read.parquet(f"{sf_dir}/{source}.parquet"))


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _sql(rows: list[tuple], columns: str, name: str = "v") -> str:
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS {name}({columns})"


NAMES = ["A", "N", "R"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, on: str = "cube", name: str | None = None):
    """Registers a function of (spark, sf_dir) or of a view; ``sql`` may use the views as tables."""

    def put(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE[key] = "WITH " + ", ".join(f"{k} AS ({v})" for k, v in _WITH.items()) + (", " + sql[5:] if sql.startswith("WITH ") else " " + sql)
        return f

    return put


def on(which: str, sql: str, key: str, f: Callable[[DataFrame], DataFrame]) -> None:
    query(sql, name=key)(lambda spark, sf_dir: f(view(spark, sf_dir, which)))


# --- sources ---------------------------------------------------------------------------------------

on("obs", "SELECT name, time, x, y, value FROM obs", "load_variable_select", lambda c: sources.select_variable(c, variable="value"))


def _files_of(spark, sf_dir, which: str, pattern: str, parts: dict[str, str]) -> str:
    """Writes each dataset of a view to files of its own, one a condition, and returns their folder."""
    folder = f"{shared_dir(spark)}/gridspark/files-{uuid.uuid4().hex}"
    cells = view(spark, sf_dir, which)
    for name in NAMES:
        for label, where in parts.items():
            cells.where(F.col("name") == name).where(where).select(F.col("time").alias("date"), F.col("x").alias("lon"), F.col("y").alias("lat"), F.col("value").alias("clt")).write.parquet(f"{folder}/{pattern.format(name=name, part=label)}")
    return folder


@query("SELECT name, time, x, y, value FROM cube")
def source_local(spark, sf_dir):
    """A folder of files, one a dataset, with their own axis names; the datasets are named by what tells the files apart."""
    folder = _files_of(spark, sf_dir, "cube", "clt_{name}_v1.parquet", {"all": "true"})
    return sources.load_local(spark, f"{folder}/*.parquet").cells.select("name", "time", "x", "y", "value")


@query("SELECT name || '2' AS name, time, x, y, value FROM cube")
def multi_file_union(spark, sf_dir):
    """Datasets of a project, each spread over several files."""
    folder = _files_of(spark, sf_dir, "cube", "clt_mon_{name}_hist_r1_{part}.parquet", {"199501-199712": "year(time) < 1998", "199801-200112": "year(time) >= 1998"})
    return sources.load_local(spark, folder, project="CMIP5", labels={n: n + "2" for n in NAMES}).cells.select("name", "time", "x", "y", "value")


on("cube", "SELECT 'y' AS axis", "squeeze_axes", lambda c: sources.squeeze(c.where("y = -67.5")))
on("cube", "SELECT name, time, x, value FROM cube WHERE y = -67.5", "squeeze_drop", lambda c: sources.squeezed(c.where("y = -67.5")))

RCMED = [(i, f"header {i}") for i in range(12)] + [(12, "10.5,20.0,0,2000-01-01 00:00:00,1.5\r"), (13, "10.5,21.0,0,2000-01-01 00:00:00,-9999\r"), (14, "11.5,20.0,0,2000-02-01 00:00:00,2.25\r")]


@query("SELECT * FROM (VALUES ('rcmed', TIMESTAMP '2000-01-01', 20.0::DOUBLE, 10.5::DOUBLE, 1.5::DOUBLE), ('rcmed', TIMESTAMP '2000-01-01', 21.0, 10.5, NULL), ('rcmed', TIMESTAMP '2000-02-01', 20.0, 11.5, 2.25)) AS t(name, time, x, y, value)")
def rcmed_text_parse(spark, sf_dir):
    return sources.rcmed_cells(values(spark, RCMED, "n int, line string"), "rcmed", -9999)


@query("SELECT * FROM (VALUES ('36', 'TRMM', '-9999'), ('37', 'CRU', NULL)) AS t(parameter_id, \"database\", missingdataflag)")
def rcmed_metadata(spark, sf_dir):
    return sources.rcmed_metadata(spark, {"fields_name": ["parameter_id", "database", "missingdataflag"], "data": [[36, "TRMM", "-9999"], [37, "CRU", None]]})


def _rcmed_answer(params: dict) -> str:
    if "param_info" in params:
        return json.dumps({"fields_name": ["parameter_id", "database", "units", "missingdataflag"], "data": [[36, "TRMM", "mm", "-9999"], [37, "CRU", "K", None]]})
    return "\r\n".join("Parameter: pr (mm)" if n == 2 else line.strip() for n, line in RCMED) + "\r\n"


@query("SELECT * FROM (VALUES ('TRMM', TIMESTAMP '2000-01-01', 20.0::DOUBLE, 10.5::DOUBLE, 1.5::DOUBLE), ('TRMM', TIMESTAMP '2000-01-01', 21.0, 10.5, NULL), ('TRMM', TIMESTAMP '2000-02-01', 20.0, 11.5, 2.25)) AS t(name, time, x, y, value)")
def source_rcmed(spark, sf_dir):
    return sources.RCMEDSource(fetch=_rcmed_answer)(spark, 3, 36, Bounds((0, 30), (0, 20))).cells.select("name", "time", "x", "y", "value")


_CATALOG = [("clt", "m1", "a"), ("clt", "m2", "b"), ("pr", "m1", "c")]


@query("SELECT * FROM " + _sql(_CATALOG, "variable_id, source_id, path") + " WHERE variable_id = 'clt' AND source_id IN ('m2', 'm3')")
def catalog_search(spark, sf_dir):
    return sources.search_catalog(values(spark, _CATALOG, "variable_id string, source_id string, path string"), {"variable_id": "clt", "source_id": ["m2", "m3"]})


@query("SELECT n AS month_number, CAST((n + 23999 + 1) // 12 AS INT) AS year, CAST((n + 24000) % 12 + 1 AS INT) AS month, 1 AS day FROM (SELECT CAST(unnest(generate_series(0, 30)) AS BIGINT) AS n) AS t")
def month_units_decode(spark, sf_dir):
    decoded = timeops.decode_month_units(spark.range(31).withColumn("time", F.col("id")), "months since 2000-01-01")
    return decoded.select(F.col("id").alias("month_number"), "time.year", "time.month", "time.day")


PATHS = ["/data/clt_modelA_hist.nc", "/data/clt_modelB_hist.nc", "/data/clt_C_hist.nc"]


@query("SELECT p AS path, regexp_extract(p, '^/data/clt_(.*)_hist.nc$', 1) AS name FROM " + _sql([(p,) for p in PATHS], "p"))
def names_from_paths(spark, sf_dir):
    return values(spark, list(zip(PATHS, sources.names_from_paths(PATHS), strict=True)), "path string, name string")


# --- metadata ---------------------------------------------------------------------------------------

CORDEX_FILES = [f"/d/{v}_AFR-44_{g}_hist_r1i1p1_{m}_v1_mon_{t}.nc" for v in ("clt", "pr") for g, m in (("ECMWF", "RCA4"), ("CCCma", "CRCM5")) for t in ("199001-199912", "200001-200912")]
CMIP5_FILES = [f"{v}_Amon_{m}_rcp45_r1i1p1_200601-210012.nc" for v in ("tas", "pr") for m in ("CanESM2", "MIROC5")]
OBS_FILES = ["/o/pr_TRMM-L3_v7A_199801-201312.nc", "/o/clcalipso_obs4MIPs_CALIPSO_L3_V1_200606_201212.nc", "/o/zos_AVISO_L4_199210-201012.nc"]


def _files(spark, names):
    return values(spark, [(n,) for n in names], "filename string")


def _fields(names: tuple[str, ...], source: str, path: str = "f") -> str:
    stem = f"split(replace(split({path}, '/')[-1], '.nc', ''), '_')"
    return f"SELECT f AS filename, {', '.join(f'{stem}[{i + 1}] AS {n}' for i, n in enumerate(names))} FROM {source}"


_CORDEX_SQL, _CMIP5_SQL = _sql([(x,) for x in CORDEX_FILES], "f"), _sql([(x,) for x in CMIP5_FILES], "f")


@query(_fields(md.CORDEX, _CORDEX_SQL))
def meta_extract_cordex(spark, sf_dir):
    return registry["metadata.CORDEX"].extract(_files(spark, CORDEX_FILES))


@query(_fields(md.CMIP5, _CMIP5_SQL))
def meta_extract_cmip5(spark, sf_dir):
    return registry["metadata.CMIP5"].extract(_files(spark, CMIP5_FILES))


@query("SELECT * FROM " + _sql([(OBS_FILES[0], "pr", "TRMM", "L3", "v7A", "199801-201312"), (OBS_FILES[1], "clcalipso", "CALIPSO", "L3", "V1", "200606-201212"), (OBS_FILES[2], "zos", "AVISO", "L4", "v1", "199210-201012")], "filename, variable, instrument, processing_level, version, time"))
def meta_extract_obs4mips(spark, sf_dir):
    return registry["metadata.obs4MIPs"].extract(_files(spark, OBS_FILES))


@query("SELECT f AS filename, CASE WHEN f LIKE '%AVISO%' THEN 'zos_AVISO_L4_v1_199210-201012.nc' ELSE regexp_replace(replace(replace(split(f, '/')[-1], '_obs4MIPs_', '_'), 'TRMM-L3', 'TRMM_L3'), '^(.*calipso.*)_(\\d+)_(\\d+)\\.nc$', '\\1_\\2-\\3.nc') END AS name FROM " + _sql([(x,) for x in OBS_FILES], "f"))
def meta_filter_filename(spark, sf_dir):
    return _files(spark, OBS_FILES).select("filename", md.obs4mips_name(F.col("filename")).alias("name"))


@query("SELECT * FROM (VALUES ('pr_TRMM_L3_v7A_*.nc', '199801-201312'), ('clcalipso_CALIPSO_L3_V1_*.nc', '200606-201212'), ('zos_AVISO_L4_v1_*.nc', '199210-201012')) AS t(pattern, time_values)")
def meta_pattern_obs4mips(spark, sf_dir):
    return registry["metadata.obs4MIPs"].pattern(_files(spark, OBS_FILES)).select("pattern", F.array_join("values", ",").alias("time_values"))


@query("SELECT * FROM (VALUES ('TRMM'), ('CALIPSO'), ('AVISO')) AS t(instrument)")
def meta_instruments(spark, sf_dir):
    e = registry["metadata.obs4MIPs"]
    return e.instruments(e.extract(_files(spark, OBS_FILES)))


@query("SELECT DISTINCT variable FROM (" + "SELECT split(split(f, '/')[-1], '_')[1] AS variable FROM " + _CORDEX_SQL + ") AS q")
def meta_variables(spark, sf_dir):
    e = registry["metadata.CORDEX"]
    return e.variables(e.extract(_files(spark, CORDEX_FILES)))


@query("SELECT f AS filename, 'clcalipso' AS variable, 'CALIPSO' AS instrument, 'L3' AS processing_level, 'V1' AS version, '200606-201212' AS time FROM " + _sql([(OBS_FILES[1],)], "f"))
def meta_query_cleaned(spark, sf_dir):
    """The wanted value is met after what is ignored has been cut out of it."""
    e = registry["metadata.obs4MIPs"]
    return e.query(e.extract(_files(spark, OBS_FILES)), variable="cl")


@query("SELECT f AS filename, split(f, '-')[1] AS model, replace(split(f, '-')[3], '.dat', '') AS variable FROM " + _sql([("m1-x-pr.dat",), ("m2-y-clt.dat",)], "f"))
def meta_params(spark, sf_dir):
    e = registry["metadata.params"] if "metadata.params" in _registered() else md.build_extractor_from_params("params", ["model", "variable"], sep="-", ext=".dat", index=[0, 2])
    return e.extract(_files(spark, ["m1-x-pr.dat", "m2-y-clt.dat"]))


TEMPLATE_FILES = ["x_RCA4_y_1_2_3_clt.nc", "x_CRCM5_y_1_2_3_pr.nc"]


@query("SELECT f AS filename, split(f, '_')[2] AS model, replace(split(f, '_')[7], '.nc', '') AS variable FROM " + _sql([(x,) for x in TEMPLATE_FILES], "f"))
def meta_template(spark, sf_dir):
    return md.build_extractor("template", "*_{model}_*_{variable}.nc", split_by="variable", name_field="model", index=[1, 6]).extract(_files(spark, TEMPLATE_FILES)) if "metadata.template" not in _registered() else registry["metadata.template"].extract(_files(spark, TEMPLATE_FILES))


def _registered() -> set[str]:
    return {f"metadata.{k}" for k in registry["metadata"]}


@query("SELECT regexp_replace(split(f, '/')[-1], '_[0-9-]+.nc$', '_*.nc') AS pattern, string_agg(regexp_extract(f, '_([0-9-]+).nc$', 1), ',' ORDER BY f) AS time_values FROM " + _CORDEX_SQL + " GROUP BY 1")
def meta_split_values(spark, sf_dir):
    return registry["metadata.CORDEX"].pattern(_files(spark, CORDEX_FILES)).select("pattern", F.array_join("values", ",").alias("time_values"))


@query("SELECT regexp_replace(split(f, '/')[-1], '_[0-9-]+.nc$', '_*.nc') AS pattern, CAST(row_number() OVER (PARTITION BY regexp_replace(f, '_[0-9-]+.nc$', '') ORDER BY f) - 1 AS INT) AS ordinal, strptime(regexp_extract(f, '_([0-9]+)-[0-9]+.nc$', 1), '%Y%m')::DATE AS time FROM " + _CORDEX_SQL)
def time_from_filename(spark, sf_dir):
    p = registry["metadata.CORDEX"].pattern(_files(spark, CORDEX_FILES)).select("pattern", F.posexplode("values").alias("ordinal", "v"))
    return p.select("pattern", "ordinal", F.try_to_date(F.split("v", "-")[0], "yyyyMM").alias("time"))


@query(f"SELECT * FROM ({_fields(md.CORDEX, _CORDEX_SQL)}) AS c WHERE variable = 'pr' AND model IN ('RCA4', 'X')")
def meta_query(spark, sf_dir):
    e = registry["metadata.CORDEX"]
    return e.query(e.extract(_files(spark, CORDEX_FILES)), variable="pr", model=["RCA4", "X"])


@query(f"SELECT DISTINCT model FROM ({_fields(md.CORDEX, _CORDEX_SQL)}) AS c")
def meta_get_field(spark, sf_dir):
    e = registry["metadata.CORDEX"]
    return e.get_field(e.extract(_files(spark, CORDEX_FILES)), "model")


@query(f"SELECT a.filename, b.filename AS matched FROM ({_fields(md.CORDEX, _CORDEX_SQL)}) AS a JOIN ({_fields(md.CMIP5, _CMIP5_SQL)}) AS b ON a.variable = b.variable")
def meta_groupby(spark, sf_dir):
    a, b = registry["metadata.CORDEX"], registry["metadata.CMIP5"]
    g = a.group(a.extract(_files(spark, CORDEX_FILES)), b, b.extract(_files(spark, CMIP5_FILES)), "variable")
    return g.select("filename", F.explode("matches.filename").alias("matched"))


# --- coordinates and bounds ----------------------------------------------------------------------------

on("hetero", "SELECT name, time, CASE WHEN name = 'N' AND x >= 180 THEN x - 360 ELSE x END AS x, y, value FROM hetero", "adapter_lon_shift", spatial.shift_longitude)
_ADAPTED = "SELECT name, time, CASE WHEN name = 'N' AND x >= 180 THEN x - 360 ELSE x END AS x, y, CASE WHEN name = 'N' AND x >= 180 THEN x - 360 ELSE x END AS lon, y AS lat, value FROM hetero"
on("hetero", _ADAPTED, "adapter_basic", lambda c: mesh(registry["adapter.basic"]()(c.withColumnsRenamed({"x": "nav_lon", "y": "Latitude", "time": "when"}), t="when")))
on("hetero", "SELECT name, time, x / 45 AS x, y / 45 AS y, CASE WHEN name = 'N' AND x >= 180 THEN x - 360 ELSE x END AS lon, y AS lat, value FROM hetero", "adapter_curvilinear", lambda c: registry["adapter.basic"]()(c.select("name", F.col("time").alias("dates"), (F.col("x") / 45).alias("i"), (F.col("y") / 45).alias("j"), F.col("x").alias("longitude"), F.col("y").alias("lat"), "value")))
on("cube", "SELECT DISTINCT name, 'x' AS axis, CASE name WHEN 'A' THEN 'descending' ELSE 'ascending' END AS \"order\" FROM cube", "adapter_axis_order", lambda c: spatial.axis_order(_stored(c)))
on("cube", "SELECT name, time, CAST((x + 157.5) / 45 AS INT) AS xi, x, y, value FROM cube", "adapter_reverse", lambda c: spatial.reverse_axis(_stored(c)))


def _stored(cells):
    """The cube with places on its x axis, which A has in falling order."""
    return cells.withColumn("xi", F.when(F.col("name") == "A", (157.5 - F.col("x")) / 45).otherwise((F.col("x") + 157.5) / 45).cast("int"))


on("hetero", "SELECT DISTINCT name, x, y, CAST(dense_rank() OVER (PARTITION BY name ORDER BY x) - 1 AS INT) AS xi, CAST(dense_rank() OVER (PARTITION BY name ORDER BY y) - 1 AS INT) AS yi FROM hetero", "adapter_axis_index", spatial.index_axes)
on("hetero", "SELECT DISTINCT x, y FROM hetero WHERE x BETWEEN -100 AND 100 AND y BETWEEN -30 AND 60", "domain_contains", lambda c: c.where(Bounds((-100, 100), (-30, 60)).contains()).select("x", "y").distinct())
on("cube", "SELECT DISTINCT x, y FROM cube WHERE x >= 100 OR x <= -100", "domain_contains_wrap", lambda c: c.where(Bounds((100, -100)).contains()).select("x", "y").distinct())
SQUARE = {"features": [{"properties": {"NAME": "a"}, "geometry": {"type": "Polygon", "coordinates": [[[-170, -80], [120, -80], [120, 80], [-170, 80]], [[-80, -40], [30, -40], [30, 40], [-80, 40]]]}}, {"properties": {"NAME": "b"}, "geometry": {"type": "Polygon", "coordinates": [[[130, -80], [170, -80], [170, 80], [130, 80]]]}}]}
_IN_A, _IN_HOLE, _IN_B = "(x BETWEEN -170 AND 120 AND y BETWEEN -80 AND 80)", "(x BETWEEN -80 AND 30 AND y BETWEEN -40 AND 40)", "(x BETWEEN 130 AND 170 AND y BETWEEN -80 AND 80)"


def _polygon(spark, names=None):
    return PolygonBounds(edges_of(spark, SQUARE, names))


@query(f"SELECT DISTINCT x, y FROM hetero WHERE {_IN_B}")
def polygon_contains(spark, sf_dir):
    return _polygon(spark, ["b"]).inside(view(spark, sf_dir, "hetero"))


@query(f"SELECT DISTINCT x, y FROM hetero WHERE {_IN_A} AND NOT {_IN_HOLE}")
def polygon_holes(spark, sf_dir):
    return _polygon(spark, ["a"]).inside(view(spark, sf_dir, "hetero"))


@query(f"SELECT DISTINCT x, y FROM hetero WHERE {_IN_A}")
def polygon_holes_literal(spark, sf_dir):
    return _polygon(spark, ["a"]).inside(view(spark, sf_dir, "hetero"), "literal")


@query(f"SELECT DISTINCT x, y FROM hetero WHERE ({_IN_A} AND NOT {_IN_HOLE}) OR {_IN_B}")
def polygon_names(spark, sf_dir):
    return _polygon(spark).inside(view(spark, sf_dir, "hetero"))


@query(f"SELECT name, time, x, y, CASE WHEN {_IN_A} AND NOT {_IN_HOLE} THEN value END AS value FROM cube WHERE x IN (SELECT x FROM cube WHERE {_IN_A} AND NOT {_IN_HOLE}) AND y IN (SELECT y FROM cube WHERE {_IN_A} AND NOT {_IN_HOLE})")
def polygon_subset_crop(spark, sf_dir):
    return spatial.subset(view(spark, sf_dir, "cube"), _polygon(spark, ["a"]))


@query("SELECT -170.0::DOUBLE AS lon_min, 120.0::DOUBLE AS lon_max, -80.0::DOUBLE AS lat_min, 80.0::DOUBLE AS lat_max")
def polygon_bbox(spark, sf_dir):
    return _polygon(spark, ["a"]).edges.agg(F.min("x1").alias("lon_min"), F.max("x1").alias("lon_max"), F.min("y1").alias("lat_min"), F.max("y1").alias("lat_max"))


@query("SELECT 'b/0' AS poly, 0 AS ring, x::DOUBLE AS x, y::DOUBLE AS y FROM (VALUES (130, -80), (170, -80), (170, 80), (130, 80)) AS t(x, y)")
def polygon_vertices(spark, sf_dir):
    return _polygon(spark, ["b"]).vertices()


# --- subsets ------------------------------------------------------------------------------------------

on("cube", "SELECT * FROM cube WHERE x BETWEEN -100 AND 100 AND y BETWEEN -30 AND 60 AND time BETWEEN DATE '1996-01-01' AND DATE '1999-12-01'", "subset_box", lambda c: spatial.subset(c, Bounds((-100, 100), (-30, 60), (_date("1996-01-01"), _date("1999-12-01")))))
on("cube", "SELECT * FROM cube WHERE time >= DATE '1996-01-01' AND time <= DATE '1996-12-01'", "subset_time", lambda c: c.where(spatial.time_predicate(_date("1996-01-01"), _date("1996-12-01"))))
on("cube", "SELECT * FROM cube WHERE time >= DATE '1996-01-01' AND time < DATE '1996-12-01'", "subset_time_literal", lambda c: c.where(spatial.time_predicate(_date("1996-01-01"), _date("1996-12-01"), "literal")))
_OVER = "SELECT max(t0) AS time_min, min(t1) AS time_max, max(x0) AS lon_min, min(x1) AS lon_max, max(y0) AS lat_min, min(y1) AS lat_max FROM (SELECT name, min(time) t0, max(time) t1, min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM hetero GROUP BY name) AS e"
on("hetero", _OVER, "overlap", spatial.overlap)
on("hetero", f"SELECT h.* FROM hetero h, ({_OVER}) o WHERE x BETWEEN lon_min AND lon_max AND y BETWEEN lat_min AND lat_max AND time BETWEEN time_min AND time_max", "subset_overlap", lambda c: Ensemble(c, NAMES).subset().cells.drop("bundle"))
on("obs", "SELECT (count(DISTINCT t) <= 1) AS homogeneous FROM (SELECT name, string_agg(DISTINCT x::VARCHAR, ',' ORDER BY x::VARCHAR) || string_agg(DISTINCT y::VARCHAR, ',' ORDER BY y::VARCHAR) AS t FROM obs GROUP BY name) AS s", "homogeneous_grid", lambda c: spatial.homogeneous(c.withColumn("time", F.lit(0))))
on("hetero", "SELECT (count(DISTINCT t) <= 1) AS homogeneous FROM (SELECT name, string_agg(DISTINCT x::VARCHAR, ',' ORDER BY x::VARCHAR) AS t FROM hetero GROUP BY name) AS s", "homogeneous", spatial.homogeneous)
on("cube", "SELECT * FROM cube WHERE name IN ('A', 'R')", "select_label", lambda c: Ensemble(c, NAMES)[["A", "R"]].cells.drop("bundle"))


def _date(s: str):
    import datetime

    return datetime.date.fromisoformat(s)


# --- time ------------------------------------------------------------------------------------------------

on("obs", "SELECT name, CAST(date_trunc('month', time) AS DATE) AS time, x, y, value FROM obs", "normalize_monthly", lambda c: timeops.normalize_times(c, "monthly"))
on("cube", "SELECT name, time, x, y, value FROM cube", "normalize_inferred", lambda c: timeops.normalize_times(c.withColumn("time", F.date_add("time", 14))))
on("ev", "SELECT name, date_trunc('day', time)::TIMESTAMP AS time, x, y, value FROM ev", "normalize_daily", lambda c: timeops.normalize_times(c, "daily"))
on("ev", "SELECT name, date_trunc('month', time)::TIMESTAMP + (time - date_trunc('hour', time)) AS time, x, y, value FROM ev", "normalize_literal", lambda c: timeops.normalize_times(c, mode="literal"))
on("cube", "SELECT DISTINCT name, 'MS' AS freq FROM cube", "infer_freq", timeops.infer_frequency)
on("cube", "SELECT DISTINCT name, 'MS' AS freq FROM cube", "infer_freq_season", lambda c: timeops.infer_frequency(timeops.select_season(c, "DJF")))
_YEARS = "(SELECT name AS n, min(year(time)) AS ys, max(year(time)) AS ye FROM cube GROUP BY name) AS r"


def _season(key: str, season, months: str, cut: str, mode: str = "intended") -> None:
    on("cube", f"SELECT name, time, x, y, value FROM cube JOIN {_YEARS} ON name = n WHERE month(time) IN ({months}) AND {cut}", key, lambda c: timeops.select_season(c, season, mode))


_PAD = "year(time) * 100 + month(time) BETWEEN ys * 100 + {0} AND ye * 100 + {1}"
_season("season_djf", "DJF", "12, 1, 2", _PAD.format(12, 2))
_season("season_mam", "MAM", "3, 4, 5", _PAD.format(3, 5))
_season("season_son", "SON", "9, 10, 11", _PAD.format(9, 11))
_season("season_range_tuple", (4, 9), "4, 5, 6, 7, 8, 9", _PAD.format(4, 9))
_season("season_djf_literal", "DJF", "12, 1, 2", "(year(time) > ys OR month(time) = 12) AND (year(time) < ye OR year(time) = ye)", "literal")
_season("season_mam_literal", "MAM", "3, 4, 5", "year(time) > ys AND year(time) <= ye", "literal")
_season("season_son_literal", "SON", "9, 10, 11", "year(time) > ys AND (year(time) < ye OR month(time) < 11)", "literal")
_R = "SELECT name, {0} AS time, x, y, avg(value) AS value FROM {1} GROUP BY 1, 2, 3, 4"
on("obs", _R.format("CAST(last_day(date_trunc('year', time) + INTERVAL 11 MONTH) AS DATE)", "obs"), "resample_year", lambda c: timeops.resample(c, "Y", gaps=False))
on("obs", _R.format("CAST(date_trunc('quarter', time) AS DATE)", "obs"), "resample_quarter", lambda c: timeops.resample(c, "QS", gaps=False))
on("obs", _R.format("CAST(date_trunc('week', time) + INTERVAL 6 DAY AS DATE)", "obs"), "resample_week", lambda c: timeops.resample(c, "W", gaps=False))
on("obs", _R.format("time", "obs"), "resample_day", lambda c: timeops.resample(c, "D", gaps=False))
on("obs", "WITH r AS (SELECT name, CAST(date_trunc('month', time) AS DATE) AS time, x, y, avg(value) AS value FROM obs GROUP BY 1, 2, 3, 4), s AS (SELECT name, CAST(unnest(generate_series(min(time), max(time), INTERVAL 1 MONTH)) AS DATE) AS time FROM r GROUP BY name), g AS (SELECT DISTINCT name, x, y FROM r) SELECT s.name, s.time, g.x, g.y, r.value FROM s JOIN g ON s.name = g.name LEFT JOIN r ON r.name = s.name AND r.time = s.time AND r.x = g.x AND r.y = g.y", "resample_month_gapfill", lambda c: timeops.resample(c, "MS"))
_D0 = "(SELECT name AS n, date_trunc('day', min(time))::TIMESTAMP AS d0 FROM ev GROUP BY name) AS z"
on("ev", f"SELECT name, d0 + to_seconds(CAST(floor(epoch(time - d0) / 21600) * 21600 AS BIGINT)) AS time, x, y, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) / count(value) AS value FROM ev JOIN {_D0} ON name = n GROUP BY 1, 2, 3, 4", "resample_6h", lambda c: timeops.resample(c, "6h", gaps=False, how=_exact_mean))
on("obs", "SELECT name, time, x, y, value FROM cube", "resample_reference", lambda c: Ensemble(c.where("name <> 'A'").unionByName(timeops.resample(c.where("name = 'A'"), "MS", gaps=False)), NAMES).resample(reference="A", gaps=False).cells.drop("bundle"))


def _exact_mean(value):
    """A mean whose sum does not depend on the order of rows, for values of two decimals."""
    return F.sum(value.cast("decimal(12,2)")).cast("double") / F.count(value)


@query("SELECT y, m, d, try_cast(printf('%04d-%02d-%02d', y, m, d) AS DATE) AS date FROM " + _sql([(2000, 2, 29), (2000, 2, 30), (2001, 12, 30)], "y, m, d"))
def calendar_to_gregorian(spark, sf_dir):
    return values(spark, [(2000, 2, 29), (2000, 2, 30), (2001, 12, 30)], "y int, m int, d int").withColumn("date", timeops.to_gregorian(F.col("y"), F.col("m"), F.col("d")))


# --- grids and regridding ------------------------------------------------------------------------------------


@query("SELECT -20 + i * 0.88::DOUBLE AS x, -10 + j * 0.88::DOUBLE AS y FROM (SELECT unnest(generate_series(0, 45)) AS i) AS a, (SELECT unnest(generate_series(0, 22)) AS j) AS b")
def grid_from_res(spark, sf_dir):
    return rg.grid_from_res(spark, (0.88, 0.88), (-20, 20), (-10, 10))


on("cube", "SELECT DISTINCT name, x, y FROM cube", "grid_from_data", rg.grid_of)
on("cube", "SELECT a.x, b.y FROM (SELECT DISTINCT x FROM cube) AS a, (SELECT DISTINCT y FROM cube) AS b", "meshgrid", lambda c: _mesh_of(known(c, None)))


def _mesh_of(axes):
    """Each y of any dataset with each x, which go along as one array."""
    return axes.where("axis = 'y'").select(F.col("at").alias("y")).distinct().withColumn("x", F.explode(axes.where("axis = 'x'").select(F.collect_set("at")).scalar()))


_TX = "(SELECT CAST(-150 AS DOUBLE) + 30 * unnest(generate_series(0, 10)) AS x)"
_TY = "(SELECT CAST(-70 AS DOUBLE) + 20 * unnest(generate_series(0, 7)) AS y)"


def _target(spark) -> DataFrame:
    return rg.grid_from_res(spark, (30, 20), (-150, 180), (-70, 90))


def _axis_sql(c: str, t: str) -> str:
    return f"SELECT name, s.{c} AS lo, s.hi, t.{c} AS o, (t.{c} - s.{c}) / (s.hi - s.{c}) AS f FROM (SELECT name, {c}, lead({c}) OVER w AS hi, row_number() OVER w AS k FROM (SELECT DISTINCT name, {c} FROM cube) AS d WINDOW w AS (PARTITION BY name ORDER BY {c})) AS s JOIN {t} AS t ON (t.{c} > s.{c} AND t.{c} <= s.hi) OR (k = 1 AND t.{c} = s.{c})"


_LINEAR = f"WITH ax AS ({_axis_sql('x', _TX)}), ay AS ({_axis_sql('y', _TY)}), wx AS (SELECT name, o, lo AS x, 1 - f AS w FROM ax UNION ALL SELECT name, o, hi, f FROM ax), wy AS (SELECT name, o, lo AS y, 1 - f AS w FROM ay UNION ALL SELECT name, o, hi, f FROM ay) SELECT c.name, c.time, wx.o AS x, wy.o AS y, CASE WHEN count(c.value) = 4 THEN round(sum(c.value * wx.w * wy.w), 6) END AS value FROM cube c JOIN wx ON c.name = wx.name AND c.x = wx.x JOIN wy ON c.name = wy.name AND c.y = wy.y GROUP BY 1, 2, 3, 4"


def _rounded():
    return F.round("value", 6)


def _regrid(method: str):
    return lambda spark, sf_dir: rg.regrid(view(spark, sf_dir, "cube"), _target(spark), method).withColumn("value", _rounded())


query(_LINEAR, name="regrid_linear")(_regrid("linear"))
query(_LINEAR, name="regrid_bilinear")(_regrid("bilinear"))
query(f"WITH ax AS ({_axis_sql('x', _TX)}), ay AS ({_axis_sql('y', _TY)}), wx AS (SELECT name, o, CASE WHEN f <= 0.5 THEN lo ELSE hi END AS x FROM ax), wy AS (SELECT name, o, CASE WHEN f <= 0.5 THEN lo ELSE hi END AS y FROM ay) SELECT c.name, c.time, wx.o AS x, wy.o AS y, round(c.value, 6) AS value FROM cube c JOIN wx ON c.name = wx.name AND c.x = wx.x JOIN wy ON c.name = wy.name AND c.y = wy.y", name="regrid_nearest")(_regrid("nearest"))
query("SELECT name, time, x, y, round(value, 6) AS value FROM cube", name="regrid_same_grid")(lambda spark, sf_dir: rg.regrid(view(spark, sf_dir, "cube"), view(spark, sf_dir, "cube").select("x", "y").distinct(), "nearest").withColumn("value", _rounded()))


def _edges_sql(c: str, table: str, part: str, lim: tuple[float, float]) -> str:
    by, keep = (f"PARTITION BY {part} ", f"{part}, ") if part else ("", "")
    return f"SELECT {keep}{c}, greatest(coalesce((lag({c}) OVER w + {c}) / 2, {c} - (lead({c}) OVER w - {c}) / 2), {lim[0]}) AS lo, least(coalesce(({c} + lead({c}) OVER w) / 2, {c} + ({c} - lag({c}) OVER w) / 2), {lim[1]}) AS hi FROM {table} WINDOW w AS ({by}ORDER BY {c})"


_CX, _CY = "(SELECT CAST(-150 AS DOUBLE) + 60 * unnest(generate_series(0, 5)) AS x)", "(SELECT CAST(-60 AS DOUBLE) + 60 * unnest(generate_series(0, 2)) AS y)"
query(
    f"WITH sx AS ({_edges_sql('x', '(SELECT DISTINCT name, x FROM cube) AS q', 'name', (-1e9, 1e9))}), sy AS ({_edges_sql('y', '(SELECT DISTINCT name, y FROM cube) AS q', 'name', (-90.0, 90.0))}), tx AS ({_edges_sql('x', _CX + ' AS q', '', (-1e9, 1e9))}), ty AS ({_edges_sql('y', _CY + ' AS q', '', (-90.0, 90.0))}), wx AS (SELECT name, sx.x, tx.x AS o, least(sx.hi, tx.hi) - greatest(sx.lo, tx.lo) AS w FROM sx JOIN tx ON sx.lo < tx.hi AND tx.lo < sx.hi), wy AS (SELECT name, sy.y, ty.y AS o, sin(radians(least(sy.hi, ty.hi))) - sin(radians(greatest(sy.lo, ty.lo))) AS w FROM sy JOIN ty ON sy.lo < ty.hi AND ty.lo < sy.hi) SELECT c.name, c.time, wx.o AS x, wy.o AS y, round(sum(c.value * wx.w * wy.w) / sum(wx.w * wy.w), 9) AS value FROM cube c JOIN wx ON c.name = wx.name AND c.x = wx.x JOIN wy ON c.name = wy.name AND c.y = wy.y GROUP BY 1, 2, 3, 4",
    name="regrid_conservative",
)(lambda spark, sf_dir: rg.regrid(view(spark, sf_dir, "cube"), rg.grid_from_res(spark, (60, 60), (-150, 210), (-60, 120)), "conservative").withColumn("value", F.round("value", 9)))
on("cube", "SELECT c.name, c.time, c.x, c.y, round(c.value, 6) AS value FROM cube c", "regrid_own_grid", lambda c: Ensemble(c, NAMES).regrid("N").cells.select("name", "time", "x", "y", _rounded().alias("value")))
_CURVED = "(SELECT 5.0::DOUBLE + 6 * unnest(generate_series(-10, 10)) AS xo)"


@query(
    f"WITH p AS (SELECT xo, yo, ((xo - 0.2 * yo) / 0.5 + 157.5) / 45 AS u, (yo / 0.5 + 67.5) / 45 AS v FROM {_CURVED} AS a, (SELECT 1.0::DOUBLE + 7 * unnest(generate_series(-5, 4)) AS yo) AS b), q AS (SELECT xo, yo, floor(u) AS i, floor(v) AS j, u - floor(u) AS s, v - floor(v) AS t FROM p), "
    "k AS (SELECT xo, yo, i, j, (1 - s) * (1 - t) AS w FROM q UNION ALL SELECT xo, yo, i + 1, j, s * (1 - t) FROM q UNION ALL SELECT xo, yo, i, j + 1, (1 - s) * t FROM q UNION ALL SELECT xo, yo, i + 1, j + 1, s * t FROM q), g AS (SELECT DISTINCT name, (x + 157.5) / 45 AS i, (y + 67.5) / 45 AS j FROM cube), "
    "f AS (SELECT name, xo, yo FROM g JOIN k ON g.i = k.i AND g.j = k.j GROUP BY 1, 2, 3 HAVING count(*) = 4) "
    "SELECT c.name, c.time, k.xo AS x, k.yo AS y, CASE WHEN count(c.value) = 4 THEN round(sum(c.value * k.w), 6) END AS value FROM cube c JOIN k ON (c.x + 157.5) / 45 = k.i AND (c.y + 67.5) / 45 = k.j JOIN f ON f.name = c.name AND f.xo = k.xo AND f.yo = k.yo GROUP BY 1, 2, 3, 4"
)
def regrid_curvilinear(spark, sf_dir):
    """A sheared grid: longitudes of a row move with its latitude."""
    cells = view(spark, sf_dir, "cube").select("name", "time", ((F.col("x") + 157.5) / 45).cast("int").alias("xi"), ((F.col("y") + 67.5) / 45).cast("int").alias("yi"), (0.5 * F.col("x") + 0.1 * F.col("y")).alias("lon"), (0.5 * F.col("y")).alias("lat"), "value")
    return rg.regrid_curvilinear(cells, rg.grid_from_res(spark, (6, 7), (-55, 66), (-34, 30))).withColumn("value", _rounded())


_NEAR = [(-157.3, -67.4), (-157.5, -67.2), (-100.0, 0.0), (22.4, 22.6)]


@query(
    "WITH t AS (SELECT x::DOUBLE AS xo, y::DOUBLE AS yo FROM " + _sql(_NEAR, "x, y") + "), d AS (SELECT name, xo, yo, x, y, round(2 * 6371228.0::DOUBLE * asin(sqrt(pow(sin(radians(yo - y) / 2), 2) + cos(radians(y)) * cos(radians(yo)) * pow(sin(radians(xo - x) / 2), 2))), 3) AS d FROM (SELECT DISTINCT name, x, y FROM cube) AS g, t), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, xo, yo ORDER BY d, y, x) AS k FROM d WHERE d <= 50000) AS q WHERE k = 1) SELECT f.name, f.time, t.xo AS x, t.yo AS y, c.value FROM (SELECT DISTINCT name, time FROM cube) AS f CROSS JOIN t LEFT JOIN b ON b.name = f.name AND b.xo = t.xo AND b.yo = t.yo LEFT JOIN cube c ON c.name = f.name AND c.time = f.time AND c.x = b.x AND c.y = b.y"
)
def regrid_distance_nearest(spark, sf_dir):
    return rg.nearest_by_distance(view(spark, sf_dir, "cube"), values(spark, _NEAR, "x double, y double"))


def _pick(c: str, t: str, by: str) -> str:
    other = f"s.{c}" if by == "o" else f"t.{c}"
    return f"SELECT name, x, o FROM (SELECT name, s.{c} AS x, t.{c} AS o, row_number() OVER (PARTITION BY name, {'t' if by == 'o' else 's'}.{c} ORDER BY abs(s.{c} - t.{c}), {other}) AS k FROM (SELECT DISTINCT name, {c} FROM cube) AS s, {t} AS t) AS q WHERE k = 1"


for _key, _by in (("s2d", "o"), ("d2s", "x")):
    query(f"WITH px AS ({_pick('x', _TX, _by)}), py AS ({_pick('y', _TY, _by)}) SELECT c.name, c.time, px.o AS x, py.o AS y, round(sum(c.value), 6) AS value FROM cube c JOIN px ON c.name = px.name AND c.x = px.x JOIN py ON c.name = py.name AND c.y = py.x GROUP BY 1, 2, 3, 4", name=f"regrid_nearest_{_key}")(
        lambda spark, sf_dir, k=_key: rg.nearest_grid(view(spark, sf_dir, "cube"), _target(spark), k).withColumn("value", _rounded())
    )

# --- ensembles ---------------------------------------------------------------------------------------------------

on("cube", "SELECT name, 'all' AS bundle, time, x, y, value FROM cube", "bundle", lambda c: Ensemble(c, NAMES).bundle("all").cells)
on("cube", "SELECT name, CASE WHEN name IN ('A', 'N') THEN 'two' END AS bundle, time, x, y, value FROM cube", "bundle_partial", lambda c: Ensemble(c, NAMES).bundle(two=["A", "N"]).cells)
on("cube", "SELECT name, CASE WHEN name = 'R' THEN 'one' END AS bundle, time, x, y, value FROM cube", "unbundle", lambda c: Ensemble(c, NAMES).bundle(two=["A", "N"], one=["R"]).unbundle("two").cells)
on("cube", "SELECT name, time, x, y, round(value, 6) AS value FROM cube UNION ALL SELECT 'ENS', time, x, y, round(avg(value), 6) FROM cube GROUP BY time, x, y", "add_mean", lambda c: Ensemble(c, NAMES).bundle("all").add_mean("all").cells.select("name", "time", "x", "y", _rounded().alias("value")))
on("cube", "SELECT name, x, y, round(avg(value), 6) AS value FROM cube GROUP BY name, x, y", "climatology", lambda c: Ensemble(c, NAMES).climatology().withColumn("value", _rounded()))
on("cube", "SELECT c.name, c.time, c.x, c.y, c.value - r.value AS value FROM cube c LEFT JOIN cube r ON r.name = 'A' AND r.time = c.time AND r.x = c.x AND r.y = c.y WHERE c.name <> 'A' UNION ALL SELECT name, time, x, y, value FROM cube WHERE name = 'A'", "metric_bias", lambda c: Ensemble(c, NAMES).apply_metric(bias, "A").cells.drop("bundle"))
on("cube", "SELECT c.name, c.time, c.x, c.y, c.value - r.value AS value FROM cube c LEFT JOIN cube r ON r.name = 'A' AND r.time = c.time AND r.x = c.x AND r.y = c.y", "metric_bias_along_labels", lambda c: Ensemble(c, NAMES).apply_metric(bias, "A", along_labels=True).cells.drop("bundle"))
on("cube", "SELECT name, time, x, y, CASE WHEN name = 'N' THEN value * 2 ELSE value END AS value FROM cube", "apply_on_labels", lambda c: Ensemble(c, NAMES).apply_on_labels(lambda d: d.withColumn("value", F.col("value") * 2), "N").cells.drop("bundle"))
on("cube", "SELECT name, time, x, y, value + 1 AS value FROM cube", "apply_udf", lambda c: Ensemble(c, NAMES).apply_pandas(lambda p: p.assign(value=p["value"] + 1)).cells.drop("bundle"))
on("cube", "SELECT name, time, x, y, value FROM cube", "concat", lambda c: concat(Ensemble(c, NAMES)[["A"]], Ensemble(c, NAMES)[["N", "R"]]).cells.drop("bundle"))
on("cube", "SELECT name, time, x, y, CASE WHEN name = 'N' THEN value * 3 ELSE value END AS value FROM cube UNION ALL SELECT 'new', time, x, y, value FROM cube WHERE name = 'A'", "assign", lambda c: Ensemble(c, NAMES).assign(c.where("name = 'N'").withColumn("value", F.col("value") * 3).unionByName(c.where("name = 'A'").withColumn("name", F.lit("new"))), ["N", "new"]).cells.drop("bundle"))
on("cube", "WITH e AS (SELECT count(DISTINCT time) * count(DISTINCT x) * count(DISTINCT y) * 8 AS b FROM cube GROUP BY name) SELECT CAST(sum(b) AS BIGINT) AS bytes, printf('%.2fkB', sum(b) / 1000.0) AS rendered FROM e", "ensemble_size", lambda c: Ensemble(c, NAMES).size())


def _homogenized(spark: SparkSession, sf_dir: str) -> Ensemble:
    return Ensemble(view(spark, sf_dir, "hetero"), NAMES).adapt().homogenize(freq="Y", season="DJF", target=rg.grid_from_res(spark, (45, 45), (-135, 180), (-45, 90)), domain=Bounds((-160, 160), (-70, 70)))


_CHAIN = (
    "WITH sh AS (SELECT name, time, CASE WHEN name = 'N' AND x >= 180 THEN x - 360 ELSE x END AS x, y, value FROM hetero), b AS (SELECT * FROM sh WHERE x BETWEEN -160 AND 160 AND y BETWEEN -70 AND 70), "
    "yr AS (SELECT name AS n, min(year(time)) AS ys, max(year(time)) AS ye FROM b GROUP BY name), s AS (SELECT b.* FROM b JOIN yr ON name = n WHERE month(time) IN (12, 1, 2) AND year(time) * 100 + month(time) BETWEEN ys * 100 + 12 AND ye * 100 + 2), "
    "q AS (SELECT name, CAST(last_day(date_trunc('year', time) + INTERVAL 11 MONTH) AS DATE) AS time, x, y, avg(value) AS value FROM s GROUP BY 1, 2, 3, 4), "
    + ", ".join(f"a{c} AS (SELECT name, s0.{c} AS lo, hi, t.{c} AS o, (t.{c} - s0.{c}) / (hi - s0.{c}) AS f FROM (SELECT name, {c}, lead({c}) OVER w AS hi, row_number() OVER w AS k FROM (SELECT DISTINCT name, {c} FROM q) AS d WINDOW w AS (PARTITION BY name ORDER BY {c})) AS s0 JOIN (SELECT CAST({lo} AS DOUBLE) + 45 * unnest(generate_series(0, {n})) AS {c}) AS t ON (t.{c} > s0.{c} AND t.{c} <= hi) OR (k = 1 AND t.{c} = s0.{c})), w{c} AS (SELECT name, o, lo AS {c}, 1 - f AS w FROM a{c} UNION ALL SELECT name, o, hi, f FROM a{c})" for c, lo, n in (("x", -135, 6), ("y", -45, 2)))
    + ", h AS (SELECT q.name, q.time, wx.o AS x, wy.o AS y, CASE WHEN count(q.value) = 4 THEN sum(q.value * wx.w * wy.w) END AS value FROM q JOIN wx ON q.name = wx.name AND q.x = wx.x JOIN wy ON q.name = wy.name AND q.y = wy.y GROUP BY 1, 2, 3, 4)"
)


@query(_CHAIN + " SELECT name, time, x, y, round(value, 6) AS value FROM h")
def homogenize(spark, sf_dir):
    return _homogenized(spark, sf_dir).cells.select("name", "time", "x", "y", _rounded().alias("value"))


@query(_CHAIN + ", m AS (SELECT * FROM h UNION ALL SELECT 'ENS', time, x, y, avg(value) FROM h GROUP BY time, x, y) SELECT name, x, y, round(avg(value), 6) AS value FROM m GROUP BY name, x, y")
def flagship(spark, sf_dir):
    """Homogenised, bundled, with the ensemble mean, as a climatology."""
    return _homogenized(spark, sf_dir).bundle("all").add_mean("all").climatology().withColumn("value", _rounded())
