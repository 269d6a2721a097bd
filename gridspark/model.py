"""The ensemble: one long table of cells with the dataset as a column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .axes import axis, known
from .bounds import Bounds
from .operators import regrid as rg
from .operators import spatial, timeops
from .registry import registry
from .tables import small


class Ensemble:
    """Datasets as rows ``name, time, x, y, value`` and a ``bundle`` label; ``names`` keeps their order.

    Operations return new ensembles and leave the cells alone until an action.  What they must know
    beforehand (ranges, grids, years, weights) comes from ``axes``, a small table of each dataset's
    places and times, which one pass over the cells makes when it is first asked for and which later
    operations carry along: subsets, seasons, bins and grids of the axes give those of the result.
    """

    def __init__(self, cells: DataFrame, names: list[str], axes: DataFrame | None = None, adapter: str | None = None) -> None:
        """``axes``: those of the cells, where a step knows them; they are computed when first asked for."""
        if adapter:
            cells = registry["adapter"][adapter]()(cells)
        # Bundle of each name as far as operations have set one; not known of cells that bring their own.
        self._bundles: dict[str, str] | None = None if "bundle" in cells.columns else {}
        self.cells = cells if "bundle" in cells.columns else cells.withColumn("bundle", F.lit(None).cast("string"))
        self._names, self._axes, self._settled = list(names), axes, False

    def _with(self, cells: DataFrame, names: list[str] | None = None, axes: DataFrame | None = None) -> Ensemble:
        return Ensemble(cells, self._names if names is None else names, axes)

    @property
    def bundles(self) -> dict[str, str]:
        """The bundle of each name that has one."""
        if self._bundles is None:
            found = self.cells.where("bundle is not null").select("name", "bundle").distinct().collect()  # a row a dataset
            self._bundles = {r["name"]: r.bundle for r in found}
        return self._bundles

    def _keep_bundle(self, f: Callable[[DataFrame], DataFrame], axes: DataFrame | None) -> Ensemble:
        """A step that regroups cells; the bundle of each dataset is put back from its label."""
        label = F.lit(None).cast("string")
        for name, bundle in self.bundles.items():
            label = F.when(F.col("name") == name, bundle).otherwise(label)
        return self._carry(self._with(f(self.cells.drop("bundle")).withColumn("bundle", label), axes=axes))

    def _carry(self, out: Ensemble, bundles: dict[str, str] | None = None) -> Ensemble:
        out._bundles = self._bundles if bundles is None else bundles
        out._settled = self._settled and out._axes is self._axes
        return out

    @property
    def axes(self) -> DataFrame:
        """``name, axis, at, time``, computed once."""
        if not self._settled:
            self._axes = known(self.cells, None) if self._axes is None else small(self._axes, "axes")
            self._settled = True
        return self._axes

    @property
    def names(self) -> list[str]:
        return list(self._names)

    @property
    def first(self) -> DataFrame:
        return self[0]

    def __len__(self) -> int:
        return len(self._names)

    def __getitem__(self, key):
        if isinstance(key, list):
            return self._with(self.cells.where(F.col("name").isin(key)), [n for n in self._names if n in key])
        name = self._names[key] if isinstance(key, int) else key
        return self.cells.where(F.col("name") == name)

    def assign(self, cells: DataFrame, names: list[str] | None = None) -> Ensemble:
        """Datasets of ``names`` take the place of those of the same name, or follow at the end; without names, all are replaced."""
        if names is None:
            return self._with(cells)
        kept = [n for n in self._names if n not in names]
        if not kept:
            return Ensemble(cells, names)
        new = Ensemble(cells, names).cells
        order = [*self._names, *[n for n in names if n not in self._names]]
        return Ensemble(self.cells.where(F.col("name").isin(kept)).unionByName(new), order)

    def apply(self, f: Callable[..., DataFrame], *args, **kw) -> Ensemble:
        return self._with(f(self.cells, *args, **kw))

    def apply_pandas(self, f: Callable, schema: str | None = None) -> Ensemble:
        """An opaque pandas function of one dataset at a time; a dataset must fit in a task."""
        return self._with(self.cells.groupBy("name").applyInPandas(f, schema or self.cells.schema))

    def apply_on_labels(self, f: Callable[..., DataFrame], *labels: str) -> Ensemble:
        mine = F.col("name").isin(list(labels))
        return self._with(f(self.cells.where(mine)).unionByName(self.cells.where(~mine)))

    def compute(self) -> Ensemble:
        return self._with(self.cells.checkpoint())

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Ensemble:
        return self._with(self.cells.persist(level))

    def adapt(self) -> Ensemble:
        """Longitudes of all datasets in -180..180."""
        tops = {r["name"] for r in axis(self.axes, "x").groupBy("name").agg(F.max("x").alias("x")).where("x >= 180").collect()}
        turn = lambda c: F.when(F.col("name").isin(list(tops)) & (F.col(c) >= 180), F.col(c) - 360).otherwise(F.col(c))
        axes = self.axes.withColumn("at", F.when(F.col("axis") == "x", turn("at")).otherwise(F.col("at")))
        return self._carry(self._with(self.cells.withColumn("x", turn("x")), axes=axes))

    def subset(self, domain: Bounds | None = None) -> Ensemble:
        domain = domain or spatial.overlap_bounds(self.cells, None if self._axes is None else self.axes)  # least and largest need no axes
        axes = None
        if type(domain) is Bounds and self._axes is not None:
            at, is_ = F.col("at"), lambda a: F.col("axis") == a
            inside = (is_("x") & domain.lon.contains(at)) | (is_("y") & domain.lat.contains(at))
            when = is_("time") & spatial.time_predicate(domain.time.min, domain.time.max) if domain.time else is_("time")
            axes = self._axes.where(inside | when)
        return self._carry(self._with(spatial.subset(self.cells, domain), axes=axes))

    def _times(self, f: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
        """The axes with other times."""
        if self._axes is None:
            return None
        kind = self._axes.schema["time"].dataType
        times = f(axis(self._axes, "time")).select("name", F.lit("time").alias("axis"), F.lit(None).cast("double").alias("at"), F.col("time").cast(kind).alias("time"))
        return self._axes.where("axis <> 'time'").union(times.distinct())

    def normalize_times(self, frequency: str | None = None, mode: str = "intended") -> Ensemble:
        found = timeops.frequencies(self.axes) if not frequency and mode == "intended" else None
        return self._carry(self._with(timeops.normalize_times(self.cells, frequency, mode, found=found), axes=self._times(lambda t: timeops.normalize_times(t, frequency, mode, found=found))))

    def select_season(self, season=None, mode: str = "intended") -> Ensemble:
        if not season:
            return self
        years = timeops.season_years(axis(self.axes, "time"))
        return self._carry(self._with(timeops.select_season(self.cells, season, mode, years=years), axes=self._times(lambda t: timeops.select_season(t, season, mode, years=years))))

    def resample(self, freq: str | None = None, gaps: bool = True, reference: str | None = None, how=F.avg) -> Ensemble:
        """Means at a frequency, by default that of ``reference`` or the first dataset; datasets that have it pass unchanged."""
        found = timeops.frequencies(self.axes)
        freq = freq or found[reference or self._names[0]]
        n, unit = timeops.parse_frequency(freq)
        same = [name for name, f in found.items() if f != "unknown" and timeops.parse_frequency(f) == (n, unit)]
        rest = ~F.col("name").isin(same)
        if len(same) == len(found):
            return self

        def f(cells: DataFrame) -> DataFrame:
            out = timeops.resample(cells.where(rest), freq, gaps, how, self.axes.where(rest))
            return out.unionByName(cells.where(~rest).select(*out.columns)) if same else out

        def bins(t: DataFrame) -> DataFrame:
            return timeops.binned(t.where(rest), t.where(rest), n, unit).select("name", F.col("time").cast(t.schema["time"].dataType).alias("time")).union(t.where(~rest))

        return self._keep_bundle(f, None if gaps else self._times(bins))

    def regrid(self, target: DataFrame | str | None = None, method: str | None = None, backend: str | None = None, clean: bool = False, **options) -> Ensemble:
        """On ``target(x, y)``, the grid of a dataset, or that of the first."""
        if target is None or isinstance(target, str):
            own = self.axes.where(F.col("name") == (target or self._names[0]))
            target = axis(own, "y").select("y", F.explode(own.where("axis = 'x'").select(F.collect_list("at")).scalar()).alias("x")).select("x", "y")
        return self._keep_bundle(lambda c: rg.regrid(c, target, method, backend, self.axes, clean, **options), None)

    def homogenize(self, freq: str | None = None, domain: Bounds | None = None, season=None, target=None, method: str | None = None, backend: str | None = None, frequency: str | None = None) -> Ensemble:
        """Normalised times, a common box, a season, a frequency and a grid, in this order."""
        self.axes  # noqa: B018 (one pass, which all steps share)
        e = self.normalize_times(frequency).subset(domain).select_season(season)
        return (e.resample(freq, gaps=False) if freq else e).regrid(target, method, backend)

    def bundle(self, name: str | None = None, **names: list[str]) -> Ensemble:
        groups = {name: self._names} if name else names
        label = F.col("bundle")
        for new, members in groups.items():
            label = F.when(F.col("name").isin(list(members)), new).otherwise(label)
        own = {m: new for new, members in groups.items() for m in members}
        return self._carry(self._with(self.cells.withColumn("bundle", label), axes=self._axes), {**self.bundles, **own})

    def unbundle(self, *names: str) -> Ensemble:
        gone = F.col("bundle").isin(list(names)) if names else F.lit(True)
        out = self._with(self.cells.withColumn("bundle", F.when(gone, None).otherwise(F.col("bundle"))), axes=self._axes)
        return self._carry(out, {m: b for m, b in self.bundles.items() if names and b not in names})

    def add_mean(self, bundle: str, label: str = "ENS") -> Ensemble:
        if label in self._names:
            raise ValueError(f"{label} is a member already")
        mean = self.cells.where(F.col("bundle") == bundle).groupBy("bundle", "time", "x", "y").agg(F.avg("value").alias("value")).withColumn("name", F.lit(label))
        return self._with(self.cells.unionByName(mean), [*self._names, label])

    def climatology(self) -> DataFrame:
        return self.cells.groupBy("name", "x", "y").agg(F.avg("value").alias("value"))

    def apply_metric(self, metric: Callable, *labels: str, along_labels: bool = False) -> Ensemble:
        """``metric(value, *label values)`` as a Column, each cell joined to the labels' cells of its time and place."""
        keys = ["time", "x", "y"]
        cells = self.cells if along_labels else self.cells.where(~F.col("name").isin(list(labels)))
        out = cells
        for k, label in enumerate(labels):
            out = out.join(self[label].select(*keys, F.struct("value").alias(f"label{k}")), keys, "left")
        out = out.withColumn("value", metric(F.col("value"), *[F.col(f"label{k}.value") for k in range(len(labels))])).select(*self.cells.columns)
        return self._with(out if along_labels else out.unionByName(self.cells.where(F.col("name").isin(list(labels)))))

    def size(self) -> DataFrame:
        """Bytes of the dense arrays and their text in decimal units."""
        each = self.cells.groupBy("name").agg(*[F.count_distinct(c).alias(c) for c in ("time", "x", "y")])
        total = each.agg(F.sum(F.col("time") * F.col("x") * F.col("y") * 8).cast("bigint").alias("bytes"))
        text = F.lit(None).cast("string")
        for unit, size in (("B", 1), ("kB", 1e3), ("MB", 1e6), ("GB", 1e9), ("TB", 1e12)):
            text = F.when(F.col("bytes") >= size, F.format_string(f"%.2f{unit}", F.col("bytes") / size)).otherwise(text)
        return total.withColumn("rendered", text)

    def to_pandas(self):
        return self.cells.toPandas()


def bias(value, reference):
    return value - reference


def concat(*ensembles: Ensemble) -> Ensemble:
    names = [n for e in ensembles for n in e.names]
    if len({*names}) < len(names):
        raise ValueError("a dataset name occurs more than once")
    cells = ensembles[0].cells
    for e in ensembles[1:]:
        cells = cells.unionByName(e.cells)
    return Ensemble(cells, names)
