"""Metadata from file names: extractors are field lists turned into Column expressions."""

from __future__ import annotations

import string
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import registry
from ..tables import listing

#: Fields of the known naming schemes.
CORDEX = ("variable", "domain", "driving_model", "experiment", "ensemble", "model", "version", "time_step", "time")
CMIP5 = ("variable", "temporal_resolution", "model", "experiment", "ensemble", "time")
OBS4MIPS = ("variable", "instrument", "processing_level", "version", "time")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def obs4mips_name(path: Column) -> Column:
    """Known irregular names brought to the scheme: field separators, both dates of CALIPSO joined, and a version for AVISO."""
    name = F.replace(F.replace(basename(path), F.lit("_obs4MIPs_"), F.lit("_")), F.lit("TRMM-L3"), F.lit("TRMM_L3"))
    # Of AVISO names the first three fields and the last are sure; the version between is v1.
    name = F.when(F.contains(name, F.lit("AVISO")), F.regexp_replace(name, r"^([^_]*_[^_]*_[^_]*)_(?:.*_)?([^_]*)$", "$1_v1_$2")).otherwise(name)
    return F.when(F.contains(F.lower(name), F.lit("calipso")), F.regexp_replace(name, r"_(\d+)_(\d+)(\.nc)$", "_$1-$2$3")).otherwise(name)


@dataclass(frozen=True)
class Extractor:
    fields: tuple[str, ...]
    sep: str = "_"
    ext: str = ".nc"
    split_by: str = "time"
    name_field: str | None = None
    index: tuple[int, ...] | None = None
    filter_filename: Callable[[Column], Column] = basename
    ignored: dict[str, tuple[str, ...]] = field(default_factory=dict)
    paths: tuple[str, ...] = ()

    def at(self, *paths: str) -> Extractor:
        """The extractor of these folders or patterns."""
        return replace(self, paths=paths)

    def files(self, spark: SparkSession) -> DataFrame:
        """``filename`` of the files found: of a folder those with the extension, else those that the pattern names."""
        found = []
        for path in self.paths or ("./*" + self.ext,):
            inside = listing(spark, path.rstrip("/") + "/*" + self.ext)
            found += inside or listing(spark, path)
        return spark.createDataFrame([(f,) for f in sorted({*found})], "filename string")

    def data(self, spark: SparkSession) -> DataFrame:
        return self.extract(self.files(spark))

    @property
    def naming(self) -> str:
        """The field that names datasets."""
        return self.name_field or self.fields[0]

    def names(self, data: DataFrame) -> DataFrame:
        return self.get_field(data, self.naming)

    def variables(self, data: DataFrame) -> DataFrame:
        return self.get_field(data, "variable")

    def models(self, data: DataFrame) -> DataFrame:
        return self.get_field(data, "model")

    def instruments(self, data: DataFrame) -> DataFrame:
        return self.get_field(data, "instrument")

    def place(self, name: str) -> int:
        if name not in self.fields:
            raise ValueError(f"no field {name!r}")
        return (self.index or tuple(range(len(self.fields))))[self.fields.index(name)]

    def _parts(self, c: Column) -> Column:
        stem = F.regexp_replace(self.filter_filename(c), "\\Q" + self.ext + "\\E$", "")
        return F.split(stem, "\\Q" + self.sep + "\\E")

    def extract(self, files: DataFrame, path: str = "filename") -> DataFrame:
        """``filename`` and a column a field; a short name has nulls for what it lacks."""
        parts = self._parts(F.col(path))
        return files.select(F.col(path).alias("filename"), *[F.get(parts, self.place(f)).alias(f) for f in self.fields])

    def pattern(self, files: DataFrame, path: str = "filename") -> DataFrame:
        """``pattern, values``: names with the split field as ``*``, and its sorted values."""
        k = self.place(self.split_by)
        parts = self._parts(F.col(path))
        starred = F.concat(F.array_join(F.transform(parts, lambda p, i: F.when(i == k, "*").otherwise(p)), self.sep), F.lit(self.ext))
        return files.select(starred.alias("pattern"), F.get(parts, k).alias("v")).groupBy("pattern").agg(F.array_sort(F.collect_list("v")).alias("values"))

    def clean(self, name: str) -> Column:
        c = F.col(name)
        for bad in self.ignored.get(name, ()):
            c = F.replace(c, F.lit(bad), F.lit(""))
        return c

    def query(self, data: DataFrame, **wanted) -> DataFrame:
        """Records whose cleaned fields are among the wanted values."""
        for name, values in wanted.items():
            self.place(name)
            data = data.where(self.clean(name).isin([values] if isinstance(values, str) else list(values)))
        return data

    def get_field(self, data: DataFrame, name: str) -> DataFrame:
        self.place(name)
        return data.select(name).distinct()

    def group(self, data: DataFrame, other: Extractor, other_data: DataFrame, name: str) -> DataFrame:
        """Each record with the list of the other's records of the same cleaned value."""
        key = "__key"
        matches = other_data.select(other.clean(name).alias(key), F.struct(*other_data.columns).alias("m")).groupBy(key).agg(F.array_sort(F.collect_list("m")).alias("matches"))
        return data.withColumn(key, self.clean(name)).join(matches, key).drop(key)


def build_extractor(name: str, template: str, split_by: str = "time", name_field: str | None = None, index: list[int] | None = None, **kw) -> Extractor:
    """From a template such as ``*_{model}_*_{variable}.nc``: fields in braces, separator and extension from the text between."""
    parts = [(text, f) for text, f, _, _ in string.Formatter().parse(template)]
    fields = tuple(f for _, f in parts if f)
    between = [t for t, _ in parts[1:] if t and not t.startswith(".")] or ["_"]
    sep = between[0].strip("*")[:1] or "_"
    tail = parts[-1][0] if parts[-1][1] is None else ""
    ext = tail if tail.startswith(".") else ".nc"
    return build_extractor_from_params(name, list(fields), sep, ext, split_by, name_field, index, **kw)


def build_extractor_from_params(
    name: str, fields: list[str], sep: str | None = None, ext: str | None = None, split_by: str | None = None, name_field: str | None = None,
    index: list[int] | None = None, filter_filename: Callable[[Column], Column] | None = None, **ignored: list[str],
) -> Extractor:
    """An extractor of these fields, registered as ``metadata.<name>``; ``ignored``: what is cut out of a field's values."""
    hook = (lambda path: filter_filename(basename(path))) if filter_filename else basename
    out = Extractor(tuple(fields), sep or "_", ext or ".nc", split_by or "time", name_field or fields[0], tuple(index) if index else None, hook, {k: (v,) if isinstance(v, str) else tuple(v) for k, v in ignored.items()})
    registry[f"metadata.{name}"] = out
    return out


registry["metadata.CORDEX"] = Extractor(CORDEX, name_field="model")
registry["metadata.CMIP5"] = Extractor(CMIP5, name_field="model")
registry["metadata.obs4MIPs"] = Extractor(OBS4MIPS, name_field="instrument", filter_filename=obs4mips_name, ignored={"variable": ("calipso", "Lidarsr532")})
