"""Sources of ensembles.

A source is called with a session and what it is to load; ``load`` gives one table a dataset, under
any column names, which an adapter brings to canonical axes and an ensemble holds together.  Gridded
data are read as Parquet or classic NetCDF; formats and services that need a library or network that is not here are
refused after their arguments have been checked.
"""

from __future__ import annotations

import json
import os
import re
import urllib.parse
import urllib.request
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants
from ..adapters import mesh
from ..bounds import Bounds
from ..functions.metadata import Extractor
from ..registry import register, registry
from ..tables import listing
from .netcdf import read_netcdf

_AXES = ("time", "x", "y", "lev", "lon", "lat", "xi", "yi")


class DataSource:
    """Base of all sources; subclasses override ``load``."""

    def __init__(self, adapter=None) -> None:
        self.adapter = adapter or "basic"

    def load(self, spark: SparkSession, *args, **kw) -> dict[str, DataFrame]:
        raise NotImplementedError

    def __call__(self, spark: SparkSession, *args, dims: dict[str, str] | None = None, labels: dict[str, str] | None = None, variable: str | None = None, **kw):
        """An ensemble of what is loaded.

        ``dims``: column names of the axes x, y, z, t that the known names leave out.  ``labels``: new
        names of datasets.
        """
        from ..model import Ensemble

        adapter = registry["adapter"][self.adapter]() if isinstance(self.adapter, str) else self.adapter
        cells, names = None, []
        for name, table in self.load(spark, *args, variable=variable, **kw).items():
            new = (labels or {}).get(name, name)
            part = select_variable(mesh(adapter(table, **(dims or {}))), variable=variable, name=new)
            cells = part if cells is None else cells.unionByName(part, allowMissingColumns=True)
            names.append(new)
        if cells is None:
            raise ValueError("nothing was found")
        return Ensemble(cells, names)


def select_variable(df: DataFrame, axes: tuple[str, ...] = _AXES, variable: str | None = None, name: str | None = None) -> DataFrame:
    """One variable of a wide table as ``value``, with the axes that the table has; inferred if there is only one."""
    found = [c for c in df.columns if c not in axes and c != "name"]
    if len(found) == 1:
        variable = found[0]
    elif variable is None:
        raise ValueError(f"variables {found}: name one")
    who = F.lit(name) if name else F.col("name") if "name" in df.columns else F.lit(variable)
    return df.select(who.alias("name"), *[c for c in axes if c in df.columns], F.nullif(F.col(variable).cast("double"), F.lit(float("nan"))).alias("value"))


def _read(spark: SparkSession, paths: list[str], variable: str | None = None) -> DataFrame:
    """Files of one dataset as one table, of NetCDF files one variable."""
    grids = [p for p in paths if p.endswith((".nc", ".nc3", ".nc4", ".cdf"))]
    out = read_netcdf(spark, grids, variable) if grids else None
    for p in paths:
        if p not in grids:
            part = spark.read.parquet(p)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no files")
    return out


def times_of_files(files: DataFrame, extractor: Extractor, path: str = "filename", form: str = "yyyyMM") -> DataFrame:
    """``filename, time`` : the date with which each file's ``time`` field begins."""
    return extractor.extract(files, path).select("filename", F.try_to_date(F.split("time", "-")[0], form).alias("time"))


@register("source.local")
class LocalFileSource(DataSource):
    """Parquet files and folders and classic NetCDF files, one dataset a path or, with a ``project``, one a name in the file names."""

    def load(self, spark: SparkSession, paths: str | list[str] = "./*.parquet", variable: str | None = None, names: list[str] | None = None, project: str | None = None, convert_times: bool = False, load_all: bool = False, chunks: int | None = None) -> dict[str, DataFrame]:
        """``convert_times``: files without a time take the date in their names.  ``chunks``: partitions of each dataset.  ``load_all``: kept in memory."""
        patterns = [paths] if isinstance(paths, str) else list(paths)
        if project:
            groups = self._of_project(spark, registry["metadata"][project], patterns, convert_times, variable)
        else:
            # Each path that is given is a dataset, of all files that it names; one pattern alone gives one a file.
            found = [listing(spark, p) for p in patterns]
            if len(patterns) == 1 and not names:
                found = [[f] for f in found[0]]
            if not all(found):
                raise ValueError(f"no files at {patterns}")
            own = names or names_from_paths([f[0] for f in found] if len(patterns) == 1 else patterns)
            groups = {n: _read(spark, f, variable) for n, f in zip(own, found, strict=True)}
        if chunks:
            groups = {n: d.repartition(chunks) for n, d in groups.items()}
        return {n: d.persist() for n, d in groups.items()} if load_all and not chunks else groups

    @staticmethod
    def _of_project(spark: SparkSession, extractor: Extractor, patterns: list[str], convert_times: bool, variable: str | None) -> dict[str, DataFrame]:
        from dataclasses import replace

        rows = []
        for ext in (".parquet", ".nc"):
            rows += replace(extractor, ext=ext).at(*patterns).data(spark).where(F.endswith("filename", F.lit(ext))).orderBy("filename").collect()
        groups: dict[str, list[str]] = {}
        for r in rows:
            groups.setdefault(r[extractor.naming], []).append(r["filename"])
        out = {}
        for name in sorted(groups):
            tables = []
            for path in groups[name]:
                t = _read(spark, [path], variable)
                if convert_times and not {*t.columns} & {"time", "times", "date", "dates", "julian"}:
                    day = next(r["time"] for r in rows if r["filename"] == path).split("-")[0]
                    t = t.withColumn("time", F.try_to_date(F.lit(day), {4: "yyyy", 6: "yyyyMM", 8: "yyyyMMdd"}[len(day)]))
                tables.append(t)
            whole = tables[0]
            for t in tables[1:]:
                whole = whole.unionByName(t, allowMissingColumns=True)
            out[name] = whole
        return out


def names_from_paths(paths: list[str]) -> list[str]:
    """The part of each path between what all begin and end with."""
    if len(paths) == 1:
        return [os.path.splitext(os.path.basename(paths[0]))[0]]
    head = os.path.commonprefix(paths)
    tail = os.path.commonprefix([p[::-1] for p in paths])[::-1]
    return [p[len(head) : max(len(head), len(p) - len(tail))] or p for p in paths]


@register("source.bucket")
class BucketSource(DataSource):
    """Datasets in buckets, one a path; a path that ends in ``*`` stands for all below it."""

    def load(self, spark: SparkSession, *paths: str, variable: str | None = None, bucket_type: str | None = None, opener: Callable[[str], DataFrame] | None = None, lister: Callable[[str], list[str]] | None = None) -> dict[str, DataFrame]:
        out = {}
        for path in paths:
            kind = path.split("://")[0] if "://" in path else bucket_type
            if kind not in ("s3", "gc"):
                raise ValueError(f"buckets of type {kind!r}: s3 and gc are known")
            at = {"s3": "s3a", "gc": "gs"}[kind] + "://" + path.split("://")[-1]
            for p in (lister or (lambda a: listing(spark, a)))(at) if at.endswith("*") else [at]:
                if p.rstrip("/").endswith(".zarr") and opener is None:
                    raise NotImplementedError("zarr needs a reader that is not installed")
                out[p.rstrip("/").split("/")[-1]] = (opener or spark.read.parquet)(p)
        return out


def walk_catalog(catalog: dict, depth: int = 5, prefix: str = "") -> dict[str, dict]:
    """Entries of a nested catalogue by dotted names, as deep as ``depth``."""
    out: dict[str, dict] = {}
    for name, entry in catalog.items():
        out[prefix + name] = entry
        if depth > 1 and isinstance(entry.get("entries"), dict):
            out |= walk_catalog(entry["entries"], depth - 1, f"{prefix}{name}.")
    return out


def _document(spark: SparkSession, path: str) -> str:
    if path.startswith(("http://", "https://")):
        raise NotImplementedError(f"{path} needs a network that is not here")
    return spark.read.option("wholetext", True).text(path).first()[0]


@register("source.intake")
class IntakeSource(DataSource):
    """A catalogue: nested JSON of entries with a ``container``, a ``path`` or further ``entries``."""

    def load(self, spark: SparkSession, variable: str | None = None, names: list[str] | None = None, depth: int = 5, catfile: str = constants.DEFAULT_INTAKE_CAT, auth_token: str | None = None) -> dict[str, DataFrame]:
        """``names``: short or dotted; both are known."""
        if auth_token:
            os.environ["GOOGLE_APPLICATION_CREDENTIALS"] = auth_token
        entries = walk_catalog(json.loads(_document(spark, catfile)), depth)
        wanted = {n: e for n, e in entries.items() if e.get("container") == "xarray" and (not names or n in names or n.split(".")[-1] in names)}
        return {n.split(".")[-1]: _read(spark, [e["path"]]) for n, e in wanted.items()}


def search_catalog(table: DataFrame, query: dict) -> DataFrame:
    """Rows of a flat catalogue whose columns are among the wanted values; an unknown column is an error."""
    if unknown := [k for k in query if k not in table.columns]:
        raise ValueError(f"no columns {unknown}")
    for k, v in query.items():
        table = table.where(F.col(k).isin([v] if isinstance(v, str) else list(v)))
    return table


@register("source.intake-esm")
class IntakeESMSource(DataSource):
    """A flat catalogue (CSV with a ``path`` column): one dataset for each combination of its other columns but the path."""

    def load(self, spark: SparkSession, query: dict, variable: str | None = None, catfile: str = constants.DEFAULT_INTAKE_ESM_CAT) -> dict[str, DataFrame]:
        if catfile.startswith(("http://", "https://")):
            raise NotImplementedError(f"{catfile} needs a network that is not here")
        table = search_catalog(spark.read.option("header", True).csv(catfile), query)
        keys = [c for c in table.columns if c != "path"]
        rows = table.groupBy(*keys).agg(F.array_sort(F.collect_list("path")).alias("paths")).orderBy(*keys).collect()
        return {".".join(str(r[k]) for k in keys): _read(spark, r["paths"]) for r in rows}

    def __call__(self, spark: SparkSession, query: dict, **kw):
        kw.setdefault("variable", query.get("variable_id"))
        return super().__call__(spark, query, **kw)


def rcmed_cells(lines: DataFrame, name: str, missing: float, header: int = 12) -> DataFrame:
    """Cells from the numbered lines ``n, line`` of a text response: ``lat,lon,lev,time,value`` after the header."""
    p = F.split(F.rtrim(F.regexp_replace("line", "\r$", "")), ",")
    num = lambda i: F.get(p, i).try_cast("double")
    body = lines.where(F.col("n") >= header)
    return body.select(F.lit(name).alias("name"), F.try_to_timestamp(F.get(p, 3)).cast("timestamp_ntz").alias("time"), num(1).alias("x"), num(0).alias("y"), F.nullif(num(4), F.lit(float(missing))).alias("value"))


def rcmed_metadata(spark: SparkSession, document: dict) -> DataFrame:
    """The service's table of parameters: ``fields_name`` names the columns of ``data``."""
    fields = document["fields_name"]
    return spark.createDataFrame([tuple(None if v is None else str(v) for v in row) for row in document["data"]], ", ".join(f"`{f}` string" for f in fields))


def rcmed_variable(header: list[str]) -> str:
    """The variable's name from the response's header."""
    found = re.search(r"Parameter:\s*([^(]*)", "\n".join(header))
    if not found:
        raise ValueError("a response without a parameter")
    return found[1].strip()


def _fetch(params: dict) -> str:
    with urllib.request.urlopen(constants.RCMED_QUERY_URL + urllib.parse.urlencode(params), timeout=60) as r:
        return r.read().decode()


@register("source.rcmed")
class RCMEDSource(DataSource):
    """A service that answers a box and a parameter with lines of text; ``fetch`` maps request parameters to the answer."""

    def __init__(self, adapter=None, fetch: Callable[[dict], str] = _fetch) -> None:
        super().__init__(adapter)
        self.fetch = fetch

    def get_metadata(self, spark: SparkSession) -> DataFrame:
        return rcmed_metadata(spark, json.loads(self.fetch({"param_info": "yes"})))

    def load(self, spark: SparkSession, dataset_id: int, parameter_id: int, domain: Bounds, variable: str | None = None, chunks: int | None = None) -> dict[str, DataFrame]:
        known = self.get_metadata(spark).where(F.col("parameter_id") == str(parameter_id)).first()
        if known is None:
            raise ValueError(f"no parameter {parameter_id}")
        text = self.fetch({"datasetId": dataset_id, "parameterId": parameter_id, **domain.to_dict()})
        lines = spark.createDataFrame(list(enumerate(x for x in text.split("\n") if x)), "n int, line string")
        flag = known["missingdataflag"]
        cells = rcmed_cells(lines, known["database"], float(flag) if flag is not None else float("nan")).drop("name")
        cells = cells.withColumnRenamed("value", rcmed_variable(text.split("\n")[:12]))
        return {known["database"]: cells.repartition(chunks) if chunks else cells}


@register("source.esgf")
class ESGFSource(DataSource):
    """A federation of nodes; searching them is not offered."""

    def load(self, spark: SparkSession | None = None, variable: str | None = None, project: str | None = None, node: str = "JPL", **kw) -> dict[str, DataFrame]:
        if node not in constants.ESGF_NODES:
            raise ValueError(f"no node {node!r}")
        raise NotImplementedError(f"searching {constants.ESGF_NODES[node]} is not offered")

    def __call__(self, spark: SparkSession | None = None, *args, **kw):
        return self.load(spark, *args, **kw)


def squeeze(cells: DataFrame, axes: tuple[str, ...] = ("time", "x", "y")) -> DataFrame:
    """``axis``: those with one distinct value, which a squeeze would drop."""
    n = cells.agg(*[F.count_distinct(c).alias(c) for c in axes])
    return n.select(F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).alias("n")) for c in axes])).alias("a")).where("a.n = 1").select("a.axis")


def squeezed(cells: DataFrame, axes: tuple[str, ...] = ("time", "x", "y")) -> DataFrame:
    """Cells without the axes of one distinct value."""
    return cells.drop(*[r.axis for r in squeeze(cells, axes).collect()])


def units_of(metadata: DataFrame, parameter: int) -> Column:
    return metadata.where(F.col("parameter_id") == str(parameter)).select("units").scalar()


load_local, load_bucket, load_intake, load_intake_esm, load_rcmed, load_esgf = LocalFileSource(), BucketSource(), IntakeSource(), IntakeESMSource(), RCMEDSource(), ESGFSource()
