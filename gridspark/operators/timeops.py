"""Time: normalisation, frequency, seasons, resampling, calendars."""

from __future__ import annotations

import re

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..axes import axis, known
from ..tables import materialize, small

_YEAR = "JFMAMJJASOND"
#: Frequency aliases.
ALIASES = {"Y": "YE", "A": "YE", "YE": "YE", "YS": "YS", "AS": "YS", "Q": "QE", "QE": "QE", "QS": "QS", "M": "ME", "ME": "ME", "MS": "MS", "W": "W", "D": "D", "H": "h", "h": "h", "T": "min", "min": "min", "S": "s", "s": "s"}
_UNITS = {"D": 86400, "h": 3600, "min": 60, "s": 1}


def _floor(part: str, t: Column) -> Column:
    """The first midnight of a day, week, month, quarter or year; by dates, so no time zone has a say."""
    day = t.cast("date")
    return (day if part == "DAY" else F.trunc(day, part)).cast("timestamp_ntz")


def parse_frequency(freq: str) -> tuple[int, str]:
    m = re.fullmatch(r"(\d*)([A-Za-z]+)(?:-[A-Z]+)?", freq)
    if not m or m[2] not in ALIASES:
        raise ValueError(f"unknown frequency {freq!r}")
    return int(m[1] or 1), ALIASES[m[2]]


def season_months(season: str | tuple[int, int]) -> tuple[int, int]:
    """First and last month of a season given by initials or as a pair."""
    if not isinstance(season, str):
        return tuple(season)
    at = (_YEAR * 2).find(season) if 0 < len(season) <= 12 else -1  # the first place where its initials stand in two years
    if at >= 0:
        return at % 12 + 1, (at + len(season) - 1) % 12 + 1
    raise ValueError(f"unknown season {season!r}")


#: Frequencies whose times go to the first of the month, and to midnight.
_MONTHLY, _DAILY = ("YS", "YE", "QS", "QE", "MS", "ME"), ("W", "D")


def normalize_times(cells: DataFrame, frequency: str | None = None, mode: str = "intended", axes: DataFrame | None = None, found: dict[str, str] | None = None) -> DataFrame:
    """Monthly data to the first of the month, daily data to midnight, each dataset by its frequency (``found``, else inferred) if none is given.

    Times of other frequencies stay.  ``literal``: day 1 and hour 0 always, minutes kept.
    """
    kind = cells.schema["time"].dataType.simpleString()
    t = F.col("time").cast("timestamp_ntz")
    if mode == "literal":
        new = _floor("MONTH", t) + F.make_dt_interval(F.lit(0), F.lit(0), F.minute(t), F.extract(F.lit("SECOND"), t))
    elif frequency:
        new = _floor({"monthly": "MONTH", "daily": "DAY"}[frequency], t)
    else:
        found = frequencies(known(cells, axes)) if found is None else found
        of = lambda units: F.col("name").isin([n for n, f in found.items() if f.lstrip("0123456789") in units])
        new = F.when(of(_MONTHLY), _floor("MONTH", t)).when(of(_DAILY), _floor("DAY", t)).otherwise(t)
    return cells.withColumn("time", new.cast(kind))


def to_gregorian(year: Column, month: Column, day: Column) -> Column:
    """A date of another calendar as a date; one that does not exist is null."""
    return F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd")


def decode_months(months: Column, year0: int, month0: int = 1) -> dict[str, Column]:
    """Months since an epoch as year, month and day of the 360-day calendar."""
    n = months + (year0 * 12 + month0 - 1)
    return {"year": F.floor(n / 12).cast("int"), "month": (F.pmod(n, F.lit(12)) + 1).cast("int"), "day": F.lit(1)}


#: Fixed value: month units, and the date that they count from.
_MONTH_UNITS = r"months since (\d{1,4})-(\d{1,2})(?:-(\d{1,2}))?(?:[ T].*)?"


def decode_month_units(df: DataFrame, units: str, column: str = "time") -> DataFrame:
    """Whole months since a date as a struct ``year, month, day`` of the 360-day calendar.

    Other units, a date that is not the first of its month, and numbers that are not whole are an error.
    """
    m = re.fullmatch(_MONTH_UNITS, units.strip())
    if not m or not 1 <= int(m[2]) <= 12 or int(m[3] or 1) != 1:
        raise ValueError(f"times of units {units!r} cannot be told")
    if df.where(F.col(column).isNotNull() & (F.col(column).cast("double") != F.floor(F.col(column).cast("double")))).limit(1).count():
        raise ValueError("months that are not whole cannot be told")
    parts = decode_months(F.col(column).cast("bigint"), int(m[1]), int(m[2]))
    return df.withColumn(column, F.struct(*[c.alias(k) for k, c in parts.items()]))


def season_years(times: DataFrame) -> DataFrame:
    """``name, years``: the first and last year of each dataset in ``name, time``, computed once."""
    years = F.struct(F.min(F.year("time")).alias("first"), F.max(F.year("time")).alias("last"))
    return small(times.groupBy("name").agg(years.alias("years")), "years")


def select_season(cells: DataFrame, season: str | tuple[int, int] | None, mode: str = "intended", axes: DataFrame | None = None, years: DataFrame | None = None) -> DataFrame:
    """The months of a season, cut to whole seasons at both ends of each dataset's years (``years``, else those of ``axes`` or the cells).

    ``literal`` compares years and months as unpadded text does.
    """
    if not season:
        return cells
    ms, me = season_months(season)
    y, m, ys, ye = F.year("time"), F.month("time"), F.col("years.first"), F.col("years.last")
    years = season_years(cells if axes is None else axis(axes, "time")) if years is None else years
    wanted = m.between(ms, me) if ms <= me else (m >= ms) | (m <= me)
    if mode == "intended":
        cut = (y * 100 + m >= ys * 100 + ms) & (y * 100 + m <= ye * 100 + me)
    else:
        lo = (y > ys) | ((y == ys) & (F.lit(ms >= 10) & (m >= ms) | F.lit(ms == 1) & (m >= 10)))
        hi = (y < ye) | ((y == ye) & (F.lit(me >= 10) & (m < me) | F.lit(2 <= me <= 9) | F.lit(me == 1) & (m < 10)))
        cut = lo & hi
    return cells.join(years, "name").where(wanted & cut).select(*cells.columns)


def _seconds(t: Column, since: Column) -> Column:
    """Whole seconds from a midnight, by the fields of both, so no time zone has a say."""
    return F.date_diff(t.cast("date"), since.cast("date")).cast("bigint") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.floor(F.second(t))


def _bin(t: Column, n: int, unit: str, day0: Column | None) -> Column:
    """The label of a time's bin: last days for periods named by their end, else the left edge."""
    if unit in _UNITS:
        step = n * _UNITS[unit]
        return (day0 + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.floor(_seconds(t, day0) / step) * step).cast("decimal(18,6)"))).cast("timestamp_ntz")
    if unit == "W":
        return F.date_add(_floor("WEEK", t).cast("date"), 6).cast("timestamp_ntz")
    start = _floor({"Y": "YEAR", "Q": "QUARTER", "M": "MONTH"}[unit[0]], t)
    if unit.endswith("S"):
        return start
    return F.last_day(F.add_months(start.cast("date"), {"Y": 11, "Q": 2, "M": 0}[unit[0]])).cast("timestamp_ntz")


def binned(times: DataFrame, cells: DataFrame, n: int, unit: str) -> DataFrame:
    """``cells`` with the labels of their bins for times; ``times``: ``name, time``, of which days and shorter take their first midnight."""
    cells = cells.withColumn("time", F.col("time").cast("timestamp_ntz"))
    if unit not in _UNITS:
        return cells.withColumn("time", _bin(F.col("time"), n, unit, None))
    day0 = small(times.groupBy("name").agg(F.struct(_floor("DAY", F.min("time")).alias("at")).alias("first_day")), "first-days")
    return cells.join(day0, "name").withColumn("time", _bin(F.col("time"), n, unit, F.col("first_day.at"))).drop("first_day")


def resample(cells: DataFrame, freq: str, gaps: bool = True, how: Callable[[Column], Column] = F.avg, axes: DataFrame | None = None) -> DataFrame:
    """Mean (or another aggregate) per bin, cell and dataset.  With ``gaps``, empty bins within a dataset's range are null rows."""
    n, unit = parse_frequency(freq)
    if n > 1 and unit not in _UNITS:
        raise ValueError("multiples of days and shorter only")
    kind = cells.schema["time"].dataType.simpleString()
    times = cells if axes is None else axis(axes, "time")
    out = binned(times, cells, n, unit).groupBy("name", "time", "x", "y").agg(how(F.col("value")).alias("value"))
    if gaps:
        out = materialize(out, "resampled")  # ends, grid and values are taken from the means, not from the cells again
        step = f"INTERVAL {n} {dict(D='DAY', h='HOUR', min='MINUTE', s='SECOND')[unit]}" if unit in _UNITS else {"Y": "INTERVAL 12 MONTH", "Q": "INTERVAL 3 MONTH", "M": "INTERVAL 1 MONTH", "W": "INTERVAL 7 DAY"}[unit[0]]
        ends = out.groupBy("name").agg(F.min("time").alias("a"), F.max("time").alias("b"))
        if unit in ("YE", "QE", "ME"):
            labels = F.transform(F.expr(f"sequence(trunc(cast(a as date), 'MONTH'), trunc(cast(b as date), 'MONTH'), {step})"), lambda t: F.last_day(t).cast("timestamp_ntz"))
        else:
            labels = F.expr(f"sequence(a, b, {step})")
        bins = small(ends.select("name", labels.alias("bins")), "bins")
        spine = out.select("name", "x", "y").distinct().join(bins, "name").select("name", F.explode("bins").alias("time"), "x", "y")
        out = spine.join(out, ["name", "time", "x", "y"], "left")
    return out.select("name", F.col("time").cast(kind).alias("time"), "x", "y", "value")


def infer_frequency(cells: DataFrame, axes: DataFrame | None = None) -> DataFrame:
    """``name, freq`` from the steps between distinct times: YS, QS, MS, YE, QE, ME, W, D, h, min, s with multiples, or unknown.

    Where the steps differ (a season's months), the first three times, taken to the first of their
    months, tell.
    """
    t = axis(known(cells, axes), "time").selectExpr("name", "cast(time AS timestamp_ntz) AS t").distinct()
    steps = t.selectExpr("name", "t", "lag(t) OVER (PARTITION BY name ORDER BY t) AS p", "row_number() OVER (PARTITION BY name ORDER BY t) AS k")
    clock = "hour({0}) * 3600 + minute({0}) * 60 + second({0})"  # of the fields, so no time zone has a say
    d = steps.selectExpr(
        "name", "k BETWEEN 2 AND 3 AS early", "day(t) = 1 AS starts", "date(t) = last_day(date(t)) AS ends",
        "year(t) * 12 + month(t) - year(p) * 12 - month(p) AS m",
        f"date_diff(date(t), date(p)) * 86400L + ({clock.format('t')}) - ({clock.format('p')}) AS s",
    )
    of = {"m0": "min(m)", "m1": "max(m)", "s0": "min(s)", "s1": "max(s)", "n": "count(s)", "starts": "every(starts)", "ends": "every(ends)", "e0": "min(m) FILTER (WHERE early)", "e1": "max(m) FILTER (WHERE early)"}
    a = d.groupBy("name").agg(*[F.expr(e).alias(k) for k, e in of.items()])

    def by_months(m: str, edge: str) -> str:
        return f"concat(CASE WHEN {m} % 12 = 0 THEN 'Y' WHEN {m} = 3 THEN 'Q' WHEN {m} = 1 THEN 'M' ELSE concat(cast({m} AS string), 'M') END, {edge})"

    sizes = (("W", 604800), ("D", 86400), ("h", 3600), ("min", 60), ("s", 1))
    fixed = " ".join(f"WHEN s0 % {size} = 0 THEN concat(CASE WHEN s0 <> {size} THEN cast(s0 DIV {size} AS string) ELSE '' END, '{unit}')" for unit, size in sizes)
    freq = f"""CASE WHEN n < 2 THEN 'unknown'
        WHEN (starts OR ends) AND m0 = m1 AND m0 > 0 THEN {by_months("m0", "CASE WHEN starts THEN 'S' ELSE 'E' END")}
        WHEN s0 = s1 THEN CASE {fixed} END
        WHEN e0 = e1 AND e0 > 0 THEN {by_months("e0", "'S'")}
        ELSE 'unknown' END AS freq"""
    return a.selectExpr("name", freq)


def frequencies(axes: DataFrame) -> dict[str, str]:
    """The inferred frequency of each name; one row a dataset is collected."""
    return {r["name"]: r.freq for r in infer_frequency(axes, axes).collect()}
