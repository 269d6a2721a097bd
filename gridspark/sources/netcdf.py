"""NetCDF files of the classic formats (CDF-1, 2 and 5) as tables; those of NetCDF-4 are HDF5 and are refused.

A header is read on the driver, for names and types alone.  Values are read by the executors: a file is
read by one task, at most 2 GiB long (the bound of Spark's binary files), and leaves it in batches of rows.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType, LongType, StructField, StructType, TimestampNTZType

#: Fixed values of the format: element types by their number, and the tags of the header's lists.
_TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
_DIMENSIONS, _VARIABLES, _ATTRIBUTES = 10, 11, 12
#: Fixed values of the format: what unwritten elements hold, by type.
_FILLS = {"i1": -127, ">i2": -32767, ">i4": -2147483647, ">f4": 9.969209968386869e36, ">f8": 9.969209968386869e36, "u1": 255, ">u2": 65535, ">u4": 4294967295, ">i8": -9223372036854775806, ">u8": 18446744073709551614}
_BATCH_ROWS = 65536


@dataclass
class Variable:
    dims: tuple[str, ...]
    kind: str
    begin: int
    attributes: dict[str, object] = field(default_factory=dict)


@dataclass
class Header:
    """``sizes`` of dimensions, the record dimension's included; ``stride``: bytes of one record of all variables."""

    sizes: dict[str, int]
    record: str | None
    stride: int
    attributes: dict[str, object]
    variables: dict[str, Variable]

    def size(self, v: Variable) -> int:
        """Bytes of a variable, or of one record of it, without padding."""
        return int(np.prod([self.sizes[d] for d in v.dims if d != self.record], dtype=object)) * np.dtype(v.kind).itemsize

    def coordinates(self, name: str) -> list[str]:
        """Coordinates that lie across several dimensions of a variable, as its attribute names them."""
        v = self.variables[name]
        named = str(v.attributes.get("coordinates", "")).split()
        return [c for c in named if c in self.variables and c not in v.dims and self.variables[c].dims and {*self.variables[c].dims} <= {*v.dims} and self.variables[c].kind != "S1"]

    def data(self) -> list[str]:
        """Variables that are neither coordinates nor bounds nor text."""
        named = " ".join(str(v.attributes.get(k, "")) for v in self.variables.values() for k in ("coordinates", "bounds", "climatology", "grid_mapping")).split()
        return [n for n, v in self.variables.items() if v.dims and n not in self.sizes and n not in named and v.kind != "S1"]


class _Reader:
    def __init__(self, data: bytes | memoryview) -> None:
        self.data, self.at = data, 4
        version = data[3] if len(data) > 3 and bytes(data[:3]) == b"CDF" else 0
        if version not in (1, 2, 5):
            raise NotImplementedError("only the classic formats of NetCDF can be read; HDF5 needs a reader that is not installed")
        self.count, self.offset = ">q" if version == 5 else ">i", ">i" if version == 1 else ">q"

    def number(self, form: str) -> int:
        (value,) = struct.unpack_from(form, self.data, self.at)
        self.at += struct.calcsize(form)
        return value

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise struct.error("the header is cut off")
        got = bytes(self.data[self.at : self.at + n])
        self.at += -(-n // 4) * 4
        return got

    def name(self) -> str:
        return self.take(self.number(self.count)).decode()

    def list_of(self, tag: int) -> range:
        found, n = self.number(">i"), self.number(self.count)
        if found not in (0, tag) or (found == 0 and n) or n < 0:
            raise ValueError("a list of the header is damaged")
        return range(n)

    def kind(self) -> str:
        n = self.number(">i")
        if n not in _TYPES:
            raise ValueError(f"no element type {n}")
        return _TYPES[n]

    def attributes(self) -> dict[str, object]:
        out: dict[str, object] = {}
        for _ in self.list_of(_ATTRIBUTES):
            name, kind, n = self.name(), self.kind(), self.number(self.count)
            raw = self.take(n * np.dtype(kind).itemsize)
            out[name] = raw.decode("utf-8", "replace").rstrip("\0") if kind == "S1" else np.frombuffer(raw, kind)
        return out


def read_header(data: bytes | memoryview, length: int) -> Header:
    """The header at the start of a file of ``length`` bytes; ``struct.error`` if ``data`` ends before it does."""
    r = _Reader(data)
    records = r.number(r.count)
    dims = [(r.name(), r.number(r.count)) for _ in r.list_of(_DIMENSIONS)]
    record = next((n for n, size in dims if size == 0), None)
    header = Header(dict(dims), record, 0, r.attributes(), {})
    for _ in r.list_of(_VARIABLES):
        name = r.name()
        of = [r.number(r.count) for _ in range(r.number(r.count))]
        if any(not 0 <= d < len(dims) for d in of):
            raise ValueError(f"variable {name} has a dimension that is not there")
        attributes, kind = r.attributes(), r.kind()
        r.number(r.count)  # the stored size, which follows from the dimensions
        header.variables[name] = Variable(tuple(dims[d][0] for d in of), kind, r.number(r.offset), attributes)
    each = [v for v in header.variables.values() if v.dims[:1] == (record,)]
    # A record variable that is alone is not padded.
    header.stride = header.size(each[0]) if len(each) == 1 else sum(-(-header.size(v) // 4) * 4 for v in each)
    if record is not None:
        if records < 0:  # not known when the header was written
            records = (length - min((v.begin for v in each), default=length)) // header.stride if header.stride else 0
        header.sizes[record] = records
    return header


def values(data: bytes | memoryview, header: Header, name: str) -> np.ndarray:
    """The stored elements of a variable, as a view of the file."""
    v = header.variables[name]
    shape, item = tuple(header.sizes[d] for d in v.dims), np.dtype(v.kind).itemsize
    if 0 in shape:
        return np.empty(shape, v.kind)
    steps = [item]
    for n in shape[:0:-1]:
        steps.insert(0, steps[0] * n)
    if v.dims[:1] == (header.record,):
        steps[0] = header.stride
    if v.begin + sum((n - 1) * s for n, s in zip(shape, steps, strict=False)) + item > len(data):
        raise ValueError(f"the file ends within variable {name}")
    return np.ndarray(shape, v.kind, data, v.begin, tuple(steps[: len(shape)]))


def decoded(raw: np.ndarray, v: Variable) -> tuple[np.ndarray, np.ndarray]:
    """Elements as doubles, scaled and shifted as the attributes say, and where they are missing."""
    missing = np.zeros(raw.shape, bool)
    fills = [np.atleast_1d(v.attributes[k]) for k in ("_FillValue", "missing_value") if k in v.attributes and not isinstance(v.attributes[k], str)]
    if "_FillValue" not in v.attributes and np.dtype(v.kind).itemsize > 1:  # all values of a byte count
        fills.append(np.array([_FILLS[v.kind]], v.kind))
    for fill in np.concatenate(fills) if fills else ():
        missing |= raw == np.asarray(fill).astype(raw.dtype)
    out = raw.astype("f8")
    one = lambda k, none: float(np.atleast_1d(v.attributes[k])[0]) if k in v.attributes else none
    scale, offset = one("scale_factor", 1.0), one("add_offset", 0.0)
    return out if (scale, offset) == (1.0, 0.0) else out * scale + offset, missing | np.isnan(out)


#: Units of time in microseconds, and names of calendars.
_UNITS = {"microsecond": 1, "millisecond": 1000, "second": 1_000_000, "sec": 1_000_000, "s": 1_000_000, "minute": 60_000_000, "min": 60_000_000, "hour": 3_600_000_000, "hr": 3_600_000_000, "h": 3_600_000_000, "day": 86_400_000_000, "d": 86_400_000_000}
_CALENDARS = {"standard": "standard", "gregorian": "standard", "proleptic_gregorian": "proleptic", "noleap": "365", "365_day": "365", "all_leap": "366", "366_day": "366", "360_day": "360"}
_SINCE = re.compile(r"\s*([A-Za-z]+?)s?\s+since\s+(\d{1,4})-(\d{1,2})-(\d{1,2})(?:[T ]+(\d{1,2}):(\d{1,2})(?::(\d{1,2}(?:\.\d*)?))?)?\s*(?:Z|UTC|[+-]?0{1,2}:?0{0,2})?\s*")
_DAY = 86_400_000_000


def _days(year, month, day):
    """Days since 1970 of dates of the Gregorian calendar."""
    first = (np.asarray(year, "i8") * 12 + month - 1 - 1970 * 12).astype("M8[M]").astype("M8[D]")
    return first.astype("i8") + day - 1


def decode_times(numbers: np.ndarray, units: str, calendar: str = "standard") -> np.ndarray:
    """Numbers since a date as ``datetime64[us]``; missing ones, and dates that the Gregorian calendar lacks, are NaT.

    Months count in the calendar of 360 days and must be whole.  Dates of the standard calendar before
    15 October 1582 count as Julian ones and are given by their Gregorian names.
    """
    m, kind = _SINCE.fullmatch(units), _CALENDARS.get(calendar.lower())
    unit = m and m[1].lower()
    if not m or kind is None or (unit != "month" and unit not in _UNITS):
        raise ValueError(f"times of units {units!r} and calendar {calendar!r} cannot be told")
    year, month, day = int(m[2]), int(m[3]), int(m[4])
    clock = int(m[5] or 0) * 3_600_000_000 + int(m[6] or 0) * 60_000_000 + round(float(m[7] or 0) * 1_000_000)
    numbers = np.asarray(numbers, "f8")
    known = np.isfinite(numbers)
    n = np.where(known, numbers, 0.0)
    if unit == "month":
        if (n != np.floor(n)).any():
            raise ValueError("months that are not whole cannot be told")
        unit, n, kind = "day", n * 30, "360"
    # Whole units and their rest apart, so that large numbers keep their microseconds.
    whole = np.floor(n)
    us = whole.astype("i8") * _UNITS[unit] + np.rint((n - whole) * _UNITS[unit]).astype("i8") + clock
    days, rest = np.floor_divide(us, _DAY), np.mod(us, _DAY)
    if kind in ("standard", "proleptic"):
        start = int(_days(year, month, day))
        if kind == "standard" and (year, month, day) < (1582, 10, 15):
            y, k = (year - 1, month + 12) if month < 3 else (year, month)  # a year that begins in March ends with its leap day
            start = 365 * y + y // 4 + (153 * (k - 3) + 2) // 5 + day - 719471
        days = days + start
    else:
        lengths = {"365": [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31], "366": [31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31], "360": [30] * 12}[kind]
        begins = np.concatenate([[0], np.cumsum(lengths)])
        at = days + year * begins[12] + begins[month - 1] + day - 1
        y, of_year = np.floor_divide(at, begins[12]), np.mod(at, begins[12])
        mon = np.searchsorted(begins, of_year, "right")
        d = of_year - begins[mon - 1] + 1
        days = _days(y, mon, d)
        known = known & (days < _days(y, mon + 1, 1))
    return np.where(known, days * _DAY + rest, np.iinfo("i8").min).astype("M8[us]")


def _is_time(v: Variable) -> bool:
    return " since " in str(v.attributes.get("units", ""))


def _coordinate(data: bytes | memoryview, header: Header, name: str) -> np.ndarray:
    """A coordinate's values, or the places of a dimension that has none; missing ones are NaN or NaT."""
    if name not in header.variables:
        return np.arange(header.sizes[name])
    v = header.variables[name]
    out, missing = decoded(values(data, header, name), v)
    out = np.where(missing, np.nan, out)
    return decode_times(out, str(v.attributes["units"]), str(v.attributes.get("calendar", "standard"))) if _is_time(v) else out


def batches(data: bytes | memoryview, variable: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """All elements of a variable with the coordinates that ``schema`` names, in the order stored."""
    header = read_header(data, len(data))
    if variable not in header.variables:
        raise ValueError(f"no variable {variable}")
    v = header.variables[variable]
    named = [f.name for f in schema if f.name != variable]
    if {*named} != {*v.dims, *header.coordinates(variable)}:
        raise ValueError(f"variable {variable} has other coordinates than {named}")
    raw = values(data, header, variable)
    places = {n: (_coordinate(data, header, n), [v.dims.index(d) for d in (header.variables[n].dims if n in header.variables else (n,))]) for n in named}
    for lo in range(0, raw.size, _BATCH_ROWS):
        at = np.unravel_index(np.arange(lo, min(lo + _BATCH_ROWS, raw.size)), raw.shape)
        columns = []
        for f in schema:
            if f.name == variable:
                got, missing = decoded(raw[at], v)
                columns.append(pa.array(got, f.type, mask=missing))
            else:
                all_, axes = places[f.name]
                columns.append(pa.array(all_[tuple(at[k] for k in axes)], f.type, from_pandas=True))
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _header_of(spark: SparkSession, path: str) -> Header:
    """The header alone, of a file in any file system Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    length, n = system.getFileStatus(at).getLen(), 1 << 16
    while True:
        stream = system.open(at)
        try:
            data = bytes(stream.readNBytes(min(n, length)))
        finally:
            stream.close()
        try:
            return read_header(data, length)
        except struct.error:
            if n >= length:
                raise ValueError(f"{path} ends within its header") from None
            n *= 4


def read_netcdf(spark: SparkSession, paths: list[str], variable: str | None = None) -> DataFrame:
    """One variable (inferred if there is only one) of files as a row an element, with its coordinates; missing values are null.

    Other variables are not read.  All files must have the variable on the same coordinates.
    """
    header = _header_of(spark, paths[0])
    if variable is None:
        found = header.data()
        if len(found) != 1:
            raise ValueError(f"variables {found}: name one")
        variable = found[0]
    if variable not in header.variables or header.variables[variable].kind == "S1":
        raise ValueError(f"no variable {variable} of numbers in {paths[0]}")

    def kind(n: str):
        own = header.variables.get(n)
        return (LongType(), pa.int64()) if own is None else (TimestampNTZType(), pa.timestamp("us")) if _is_time(own) else (DoubleType(), pa.float64())

    names = [*header.variables[variable].dims, *header.coordinates(variable)]
    schema = pa.schema([*[pa.field(n, kind(n)[1]) for n in names], pa.field(variable, pa.float64())])

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    yield from batches(memoryview(content.as_buffer()), variable, schema)
                except (ValueError, struct.error) as e:
                    raise ValueError(f"{path.as_py()}: {e}") from e

    # Spark packs files into a task up to spark.sql.files.maxPartitionBytes; one that is longer is a task's alone.
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    return files.mapInArrow(read, StructType([*[StructField(n, kind(n)[0]) for n in names], StructField(variable, DoubleType())]))
