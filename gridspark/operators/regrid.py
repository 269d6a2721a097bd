"""Regridding: every method is a sparse table of weights, applied by a join and a sum.

Weights are made from the axes of datasets and of the target by sorted sweeps, once for each pair of
grids, and are small beside the cells.  Backends are classes in the registry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..axes import axis, bracket, for_each_name, known
from ..registry import register, registry
from ..tables import materialize, remove, small


def grid_of(cells: DataFrame) -> DataFrame:
    return cells.select("name", "x", "y").distinct()


def grid_from_res(spark, res: tuple[float, float], lon: tuple[float, float], lat: tuple[float, float]) -> DataFrame:
    """Half-open ranges of both axes as a mesh."""
    nx, ny = (max(0, int(-(-(hi - lo) // step))) for step, (lo, hi) in zip(res, (lon, lat), strict=True))
    k = F.col("id")
    return spark.range(nx * ny).select((F.lit(float(lon[0])) + F.floor(k / max(ny, 1)) * F.lit(float(res[0]))).alias("x"), (F.lit(float(lat[0])) + (k % max(ny, 1)) * F.lit(float(res[1]))).alias("y"))


# --- weights of one axis ---------------------------------------------------------------------------


def linear_weights(axes: DataFrame, dst: DataFrame, c: str, nearest: bool = False) -> DataFrame:
    """``name, c, c_out, w``: two nodes for each target within the axis, zero weights kept; nearest keeps one, the lower on a tie."""
    points = for_each_name(axes, dst.select(F.col(c).alias(f"{c}_out")).distinct())
    o, first = F.col(f"{c}_out"), F.col("below").isNull()
    hit = bracket(axis(axes, c), points, ["name"], c).where(F.col("at_or_above").isNotNull() & (~first | (o == F.col("at_or_above"))))
    lo, hi = F.coalesce("below", "at_or_above"), F.when(first, F.col("after")).otherwise(F.col("at_or_above"))
    hit = hit.select("name", f"{c}_out", lo.alias("lo"), hi.alias("hi"))
    if nearest:
        return hit.select("name", F.when(o - F.col("lo") <= F.col("hi") - o, F.col("lo")).when(F.col("hi").isNull(), F.col("lo")).otherwise(F.col("hi")).alias(c), f"{c}_out", F.lit(1.0).alias("w"))
    share = (o - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    both = F.array(F.struct(F.col("lo").alias(c), (1 - share).alias("w")), F.struct(F.col("hi").alias(c), share.alias("w")))
    return hit.select("name", f"{c}_out", F.explode(both).alias("p")).select("name", f"p.{c}", f"{c}_out", "p.w")


def _cells_of_nodes(df: DataFrame, c: str) -> DataFrame:
    """``name, c, lo, hi``: cells reach halfway to the next nodes, latitudes no further than the poles."""
    limits = (-90.0, 90.0) if c == "y" else (-1e9, 1e9)
    w = Window.partitionBy("name").orderBy(c)
    prev, next_ = F.lag(c).over(w), F.lead(c).over(w)
    lo = F.coalesce((prev + F.col(c)) / 2, F.col(c) - (next_ - F.col(c)) / 2)
    hi = F.coalesce((F.col(c) + next_) / 2, F.col(c) + (F.col(c) - prev) / 2)
    return df.select("name", c).distinct().withColumns({"lo": F.greatest(lo, F.lit(limits[0])), "hi": F.least(hi, F.lit(limits[1]))})


def overlap_weights(axes: DataFrame, dst: DataFrame, c: str) -> DataFrame:
    """Conservative weights of one axis: the shared length of cells (sines for latitude).

    All edges of both sides are sorted; between two neighbouring edges there is one cell of either
    side at most, those that began last.
    """

    def edges(of: DataFrame, side: str) -> DataFrame:
        node = lambda v: F.struct(v.cast("double").alias("v"))
        ends = F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("kind"), node(F.col(c)).alias("node")), F.struct(F.col("hi").alias("at"), F.lit(0).alias("kind"), node(F.lit(None)).alias("node")))
        return of.select("name", F.explode(ends).alias("e")).select("name", "e.at", "e.kind", F.lit(side).alias("side"), "e.node")

    both = edges(_cells_of_nodes(axis(axes, c), c), "src").union(edges(_cells_of_nodes(for_each_name(axes, dst.select(c).distinct()), c), "dst"))
    w = Window.partitionBy("name").orderBy("at", "kind")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda side: F.last(F.when(F.col("side") == side, F.col("node")), ignorenulls=True).over(upto)["v"]
    parts = both.select("name", "at", F.lead("at").over(w).alias("to"), last("src").alias(c), last("dst").alias(f"{c}_out")).where(F.col("to") > F.col("at")).dropna()
    size = F.sin(F.radians("to")) - F.sin(F.radians("at")) if c == "y" else F.col("to") - F.col("at")
    return parts.select("name", c, f"{c}_out", size.alias("w"))


def nearest_weights(axes: DataFrame, dst: DataFrame, c: str, direction: str) -> DataFrame:
    """``name, c, c_out``: the nearest source of each target, or (d2s) the nearest target of each source; the lower on a tie."""
    src, out = axis(axes, c), for_each_name(axes, dst.select(F.col(c).alias(f"{c}_out")).distinct())
    if direction == "s2d":
        near, point, node = bracket(src, out, ["name"], c), f"{c}_out", c
        p = F.col(point)
    else:
        near = bracket(out.select("name", F.col(f"{c}_out").alias(c)), src.select("name", F.col(c).alias(f"{c}_out")), ["name"], c).withColumnRenamed(f"{c}_out", c)
        p, point, node = F.col(c), c, f"{c}_out"
    lower = (p - F.col("below") <= F.col("at_or_above") - p) | F.col("at_or_above").isNull()
    return near.select("name", point, F.when(lower, F.col("below")).otherwise(F.col("at_or_above")).alias(node), F.lit(1.0).alias("w"))


# --- backends --------------------------------------------------------------------------------------


class Regridder:
    """A backend: ``setup`` makes weights for a target once, ``apply`` uses them, ``clean`` removes them.

    A backend of one's own overrides ``weights`` (small tables by name) and ``apply``.
    """

    methods: tuple[str, ...] = ()

    def __init__(self, target: DataFrame, method: str | None = None, **options) -> None:
        self.method = method or self.methods[0]
        if self.method not in self.methods:
            raise NotImplementedError(f"{type(self).__name__} offers {', '.join(self.methods)}, not {self.method}")
        self.target, self.options, self._weights, self._goal = target, options, None, None

    @property
    def goal(self) -> DataFrame:
        """The axes of the target, computed once."""
        if self._goal is None:
            self._goal = known(self.target.withColumn("name", F.lit("")), None)
        return self._goal

    def weights(self, axes: DataFrame) -> dict[str, DataFrame]:
        raise NotImplementedError

    def apply(self, cells: DataFrame, weights: dict[str, DataFrame]) -> DataFrame:
        raise NotImplementedError

    def setup(self, axes: DataFrame) -> None:
        self._weights = {k: small(v, f"weights-{k}") for k, v in self.weights(axes).items()}

    def clean(self) -> None:
        for w in (self._weights or {}).values():
            remove(w)
        self._weights = None

    def __call__(self, cells: DataFrame, axes: DataFrame | None = None) -> DataFrame:
        if self._weights is None:
            self.setup(known(cells, axes))
        return self.apply(cells, self._weights)


def _spread(cells: DataFrame, weights: dict[str, DataFrame], value) -> DataFrame:
    """Cells met with the weights of both axes, summed up for each target."""
    hit = cells.join(weights["x"].withColumnRenamed("w", "wx"), ["name", "x"]).join(weights["y"].withColumnRenamed("w", "wy"), ["name", "y"])
    return hit.groupBy("name", "time", F.col("x_out").alias("x"), F.col("y_out").alias("y")).agg(value(F.col("wx") * F.col("wy")).alias("value"))


@register("regridder.scipy")
class AxisRegridder(Regridder):
    """linear: null where any of the four nodes is missing.  nearest: the nearer node of each axis.  Nothing outside."""

    methods = ("linear", "nearest")

    def weights(self, axes: DataFrame) -> dict[str, DataFrame]:
        return {c: linear_weights(axes, axis(self.goal, c), c, self.method == "nearest") for c in ("x", "y")}

    def apply(self, cells: DataFrame, weights: dict[str, DataFrame]) -> DataFrame:
        n = 1 if self.method == "nearest" else 4
        return _spread(cells, weights, lambda w: F.when(F.count("value") == n, F.sum(F.col("value") * w)))


@register("regridder.esmf")
class AreaRegridder(Regridder):
    """bilinear; conservative: area means over the nodes that have a value; nearest_s2d, nearest_d2s (sums).  Patch is not offered."""

    methods = ("bilinear", "conservative", "nearest_s2d", "nearest_d2s")

    def weights(self, axes: DataFrame) -> dict[str, DataFrame]:
        make = {"bilinear": linear_weights, "conservative": overlap_weights}.get(self.method) or (lambda a, t, c: nearest_weights(a, t, c, self.method[-3:]))
        return {c: make(axes, axis(self.goal, c), c) for c in ("x", "y")}

    def apply(self, cells: DataFrame, weights: dict[str, DataFrame]) -> DataFrame:
        total = lambda w: F.sum(F.col("value") * w)
        value = {"bilinear": lambda w: F.when(F.count("value") == 4, total(w)), "conservative": lambda w: total(w) / F.nullif(F.sum(F.when(F.col("value").isNotNull(), w)), F.lit(0.0))}.get(self.method, total)
        return _spread(cells, weights, value)


def _distance(lat1, lon1, lat2, lon2):
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * 6371228.0) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


@register("regridder.pyresample")
class DistanceRegridder(Regridder):
    """Each target takes the nearest source node within ``radius`` metres (ties: smaller y, then x), else null.

    Nodes and targets meet in bands of latitude as wide as the radius, cut into pieces of longitude
    that are as wide at the band's end nearest to a pole; a target looks into its own and the next ones.
    """

    methods = ("nearest",)

    def weights(self, axes: DataFrame) -> dict[str, DataFrame]:
        radius = self.options.get("radius", 50_000.0)
        # A mesh of the axes, made without a product: each y of a dataset goes along with its array of x.
        xs = axis(axes, "x").groupBy("name").agg(F.collect_list("x").alias("xs"))
        src = axis(axes, "y").join(xs, "name").select("name", "y", F.explode("xs").alias("x"))
        out = {"near": self.nearest(src, self.target, radius)}
        out["times"] = axis(axes, "time").groupBy("name").agg(F.collect_list("time").alias("times"))
        return out

    @staticmethod
    def nearest(src: DataFrame, target: DataFrame, radius: float) -> DataFrame:
        """``name, xo, yo, x, y`` of all targets that have a node of the dataset near."""
        band = radius / 111_194.0
        reach = F.lit(float(radius / 6371228.0))

        def pieces(b: Column) -> Column:
            steep = F.cos(F.radians(F.least(F.lit(90.0), F.greatest(F.abs((b - 1) * band), F.abs((b + 2) * band)))))
            width = F.when(steep > F.sin(reach) * 1.001, F.degrees(F.asin(F.sin(reach) / steep)) * 1.001)
            return F.coalesce(F.greatest(F.floor(F.lit(360.0) / width), F.lit(1)), F.lit(1)).cast("bigint")

        turn = lambda lon: F.pmod(lon, F.lit(360.0)) / 360.0
        src = src.withColumn("b", F.floor(F.col("y") / band)).withColumn("p", F.least(F.floor(turn(F.col("x")) * pieces(F.col("b"))), pieces(F.col("b")) - 1))
        dst = target.select(F.col("x").alias("xo"), F.col("y").alias("yo")).distinct()
        near = dst.withColumn("b", F.explode(F.array(*[F.floor(F.col("yo") / band) + k for k in (-1, 0, 1)])))
        n, at = pieces(F.col("b")), F.least(F.floor(turn(F.col("xo")) * pieces(F.col("b"))), pieces(F.col("b")) - 1)
        near = near.withColumn("p", F.explode(F.array_distinct(F.array(*[F.pmod(at + k, n) for k in (-1, 0, 1)]))))
        d = F.round(_distance(F.col("y"), F.col("x"), F.col("yo"), F.col("xo")), 3)
        best = near.join(src, ["b", "p"]).withColumn("d", d).where(F.col("d") <= radius).groupBy("name", "xo", "yo").agg(F.min(F.struct("d", "y", "x")).alias("m"))
        return best.select("name", "xo", "yo", F.col("m.x").alias("x"), F.col("m.y").alias("y"))

    def apply(self, cells: DataFrame, weights: dict[str, DataFrame]) -> DataFrame:
        hit = cells.join(weights["near"], ["name", "x", "y"]).select("name", "time", "xo", "yo", "value")
        dst = self.target.select(F.col("x").alias("xo"), F.col("y").alias("yo")).distinct()
        frame = for_each_name(weights["times"], dst).join(weights["times"], "name").select("name", F.explode("times").alias("time"), "xo", "yo")
        return frame.join(hit, ["name", "time", "xo", "yo"], "left").select("name", "time", F.col("xo").alias("x"), F.col("yo").alias("y"), "value")


_OF = {"linear": "scipy", "nearest": "scipy", "bilinear": "esmf", "conservative": "esmf", "nearest_s2d": "esmf", "nearest_d2s": "esmf", "patch": "esmf"}


def regrid(cells: DataFrame, target: DataFrame, method: str | None = None, backend: str | None = None, axes: DataFrame | None = None, clean: bool = False, **options) -> DataFrame:
    """Cells on the rectilinear ``target(x, y)``; datasets that are on it already pass unchanged.

    ``backend`` is a key of the registry (by default the one that offers the method, else scipy).
    ``clean`` removes written weights, so the result must have been computed by then: it is written first.
    """
    regridder = registry["regridder"][backend or _OF.get(method, "scipy")](target, method, **options)
    axes = known(cells, axes)
    found = {r["name"]: r.same for r in on_grid(axes, regridder.goal).collect()}  # a row a dataset
    same, rest = [n for n, s in found.items() if s], [n for n, s in found.items() if not s]
    columns = ["name", "time", "x", "y", "value"]
    if not rest:
        return cells.select(*columns)
    out = regridder(cells.where(F.col("name").isin(rest)), axes.where(F.col("name").isin(rest))).select(*columns)
    if clean:
        out = materialize(out, "regridded")
        regridder.clean()
    return out.unionByName(cells.where(F.col("name").isin(same)).select(*columns)) if same else out


def on_grid(axes: DataFrame, goal: DataFrame) -> DataFrame:
    """``name, same``: whether a dataset's axes are those of the target, by fingerprints of both."""
    mark = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_set(c)), lambda v: v.cast("double").cast("string")), ","), 256)
    at = lambda a: F.when(F.col("axis") == a, F.col("at"))
    rows = axes.select("name", "axis", "at", F.lit(False).alias("goal")).union(goal.select("name", "axis", "at", F.lit(True).alias("goal")))
    marks = rows.groupBy("goal", "name").agg(F.concat(mark(at("x")), mark(at("y"))).alias("mark"))
    wanted = F.max(F.when(F.col("goal"), F.col("mark"))).over(Window.partitionBy())  # a row a dataset
    return marks.select("goal", "name", (F.col("mark") == wanted).alias("same")).where("not goal").select("name", "same")


def nearest_by_distance(cells: DataFrame, target: DataFrame, radius: float = 50_000.0, axes: DataFrame | None = None) -> DataFrame:
    return DistanceRegridder(target, radius=radius)(cells, axes)


def nearest_grid(cells: DataFrame, target: DataFrame, direction: str = "s2d", axes: DataFrame | None = None) -> DataFrame:
    """s2d: each target takes its nearest source node.  d2s: each source goes to its nearest target, which sums them."""
    return AreaRegridder(target, f"nearest_{direction}")(cells, axes)


# --- curvilinear grids -----------------------------------------------------------------------------


def quad_weights(grid: DataFrame, target: DataFrame, size: float | None = None) -> DataFrame:
    """``name, xo, yo, xi, yi, w``: bilinear weights within the quads of a grid ``name, xi, yi, lon, lat``.

    Quads and targets meet in square buckets of ``size`` degrees (by default of a quad's largest
    extent), so no pair of far ones is looked at.  Of quads that share a target the first is taken.
    """
    corner = lambda dx, dy, k: grid.select("name", (F.col("xi") - dx).alias("xi"), (F.col("yi") - dy).alias("yi"), F.col("lon").alias(f"x{k}"), F.col("lat").alias(f"y{k}"))
    quads = corner(0, 0, 0).join(corner(1, 0, 1), ["name", "xi", "yi"]).join(corner(0, 1, 2), ["name", "xi", "yi"]).join(corner(1, 1, 3), ["name", "xi", "yi"])
    quads = quads.withColumns({f"{m}{c}": f(*[f"{c}{k}" for k in range(4)]) for c in "xy" for m, f in (("lo", F.least), ("hi", F.greatest))})
    if size is None:
        r = quads.agg(F.max(F.greatest(F.col("hix") - F.col("lox"), F.col("hiy") - F.col("loy")))).first()[0]
        size = float(r) if r else 1.0
    box = lambda v: F.floor(v / size)
    quads = quads.withColumn("bx", F.explode(F.sequence(box(F.col("lox")), box(F.col("hix"))))).withColumn("by", F.explode(F.sequence(box(F.col("loy")), box(F.col("hiy")))))
    points = target.select(F.col("x").alias("xo"), F.col("y").alias("yo")).distinct().withColumns({"bx": box(F.col("xo")), "by": box(F.col("yo"))})
    met = quads.join(points, ["bx", "by"]).where("xo between lox and hix and yo between loy and hiy")
    v = {"e": (1, 0), "f": (2, 0)}
    d = {f"{n}{c}": F.col(f"{c}{a}") - F.col(f"{c}{b}") for n, (a, b) in v.items() for c in "xy"}
    d |= {f"g{c}": F.col(f"{c}0") - F.col(f"{c}1") + F.col(f"{c}3") - F.col(f"{c}2") for c in "xy"} | {f"h{c}": F.col(f"{c}o") - F.col(f"{c}0") for c in "xy"}
    met = met.withColumns(d)
    cross = lambda a, b: F.col(f"{a}x") * F.col(f"{b}y") - F.col(f"{a}y") * F.col(f"{b}x")
    met = met.withColumns({"k2": cross("g", "f"), "k1": cross("e", "f") + cross("h", "g"), "k0": cross("h", "e")})
    # The quadratic of t, or its line where opposite edges are parallel.
    flat = F.abs("k2") <= 1e-12 * F.abs("k1")
    root = F.sqrt(F.greatest(F.lit(0.0), F.col("k1") * F.col("k1") - 4 * F.col("k0") * F.col("k2")))
    both = F.when(flat, F.array(-F.col("k0") / F.nullif("k1", F.lit(0.0)))).otherwise(F.array((-F.col("k1") + root) / (2 * F.nullif("k2", F.lit(0.0))), (-F.col("k1") - root) / (2 * F.nullif("k2", F.lit(0.0)))))
    met = met.withColumn("t", F.explode(both))
    by_x, by_y = F.col("ex") + F.col("gx") * F.col("t"), F.col("ey") + F.col("gy") * F.col("t")
    s = F.when(F.abs(by_x) >= F.abs(by_y), (F.col("hx") - F.col("fx") * F.col("t")) / F.nullif(by_x, F.lit(0.0))).otherwise((F.col("hy") - F.col("fy") * F.col("t")) / F.nullif(by_y, F.lit(0.0)))
    met = met.withColumn("s", s).where("s between -1e-9 and 1 + 1e-9 and t between -1e-9 and 1 + 1e-9")
    first = met.groupBy("name", "xo", "yo").agg(F.min(F.struct("yi", "xi", "t", "s")).alias("q"))
    s, t = F.col("q.s"), F.col("q.t")
    four = F.array(*[F.struct((F.col("q.xi") + dx).alias("xi"), (F.col("q.yi") + dy).alias("yi"), w.alias("w")) for dx, dy, w in ((0, 0, (1 - s) * (1 - t)), (1, 0, s * (1 - t)), (0, 1, (1 - s) * t), (1, 1, s * t))])
    return first.select("name", "xo", "yo", F.explode(four).alias("p")).select("name", "xo", "yo", "p.xi", "p.yi", "p.w")


def regrid_curvilinear(cells: DataFrame, target: DataFrame, size: float | None = None) -> DataFrame:
    """Bilinear values at ``target(x, y)`` of cells ``name, time, xi, yi, lon, lat, value``; null where a corner is missing."""
    weights = small(quad_weights(small(cells.select("name", "xi", "yi", "lon", "lat").distinct(), "grid"), target, size), "quads")
    hit = cells.select("name", "time", "xi", "yi", "value").join(weights, ["name", "xi", "yi"])
    value = F.when(F.count("value") == 4, F.sum(F.col("value") * F.col("w")))
    return hit.groupBy("name", "time", F.col("xo").alias("x"), F.col("yo").alias("y")).agg(value.alias("value"))
