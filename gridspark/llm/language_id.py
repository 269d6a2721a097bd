"""Language identification with hyperdimensional letter-trigram profiles.

Each letter class has a random +1/-1 vector.  A trigram is bound as the product of its letters'
vectors, the first rolled by two places and the second by one, so order counts.  A document is the
sum (bundle) of its trigrams, a language the sum of its documents' unit vectors, and the language
of a text is the prototype of the largest cosine.

Equal trigrams are counted first, so bundling is one product of a count matrix with the bound
vectors; whole texts count, in chunks of bounded size.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .shared import materialize

DIMENSIONS = 1024
SEED = 20240229
#: Prototypes are sent to every worker: so many languages at most (4096 of 8 KB are 32 MB).
MOST_LANGUAGES = 4096
UNDETERMINED = "und"
#: Labelled rows that a length needs for a least cosine of its own.
LEAST_LABELLED = 200
#: The least cosine of any text (unrelated vectors have 0.03), and what of the lowest ones of a length still counts as language.
LEAST_COSINE, LOWEST, SLACK = 0.05, 0.001, 0.8
#: Letter classes: a-z, other letters of Latin scripts (hashed), and letters of all other scripts (hashed).
LATIN, CLASSES = 64, 4096
_UNIT = float(1 << 24)
#: Cosines are counted first without so many of their last bits: 2048 bins between a power of two and the next.
_BIN_BITS = 12
#: Bound vectors widened at once, and counts held at once.
_WIDEN, _COUNTS = 2048, 1 << 21


@functools.cache
def _letter_classes() -> np.ndarray:
    """Class of each code point: 0 for no letter, 1-26 for a-z, below ``LATIN`` for other Latin letters, the rest above."""
    out = np.zeros(sys.maxunicode + 1, dtype=np.uint16)
    for i in range(sys.maxunicode + 1):
        if 0xD800 <= i < 0xE000 or not (c := chr(i)).isalpha():
            continue
        low = ord(c.lower()[0])
        if 97 <= low <= 122:
            out[i] = low - 96
        else:
            first, last = (27, LATIN) if low < 0x250 else (LATIN, CLASSES)
            out[i] = first + low * 2654435761 % (1 << 32) % (last - first)
    return out


@functools.cache
def _letters() -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], dtype=np.int8), size=(CLASSES, DIMENSIONS))


def _bound(grams: np.ndarray, bits: int = 6) -> np.ndarray:
    """The bound vectors of trigram numbers (three classes of so many bits), in bytes."""
    v, mask = _letters(), (1 << bits) - 1
    out = np.roll(v[grams >> 2 * bits], 2, axis=1)
    out *= np.roll(v[grams >> bits & mask], 1, axis=1)
    out *= v[grams & mask]
    return out


def _bundle(counts: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """``counts @ bound``, of which few rows at a time are widened (sums of whole numbers, so the order is free)."""
    out = np.zeros((len(counts), DIMENSIONS), np.float32)
    for a in range(0, len(bound), _WIDEN):
        out += counts[:, a : a + _WIDEN].astype(np.float32) @ bound[a : a + _WIDEN].astype(np.float32)
    return out


def _codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter classes of the code points, with a 0 before and after each row, and the row of each."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    b = data[lead].astype(np.int32)
    tail = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32) & 0x3F
    two = (b & 0x1F) << 6 | tail[lead + 1]
    three = (b & 0x0F) << 12 | tail[lead + 1] << 6 | tail[lead + 2]
    point = np.where(b < 0x80, b, np.where(b < 0xE0, two, three))
    far = np.flatnonzero(b >= 0xF0)
    point[far] = (b[far] & 0x07) << 18 | tail[lead[far] + 1] << 12 | tail[lead[far] + 2] << 6 | tail[lead[far] + 3]
    code = _letter_classes()[point]
    row = (np.searchsorted(offsets, lead, side="right") - 1).astype(np.int32)
    n = len(offsets) - 1
    places = np.searchsorted(lead, offsets)  # of each row's first code point
    places[-1] = len(lead)
    edges = np.stack([places[:-1], places[1:]], axis=1).ravel()
    return np.insert(code, edges, 0), np.insert(row, edges, np.repeat(np.arange(n, dtype=np.int32), 2))


def bundles(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, last row + 1, vectors): the bundled vector of each row, zero without letters."""
    for lo, hi, data, off in tb.chunks(column):
        code, row = _codes(data, off)
        keep = np.ones(len(code), dtype=bool)
        keep[1:] = (code[1:] != 0) | (code[:-1] != 0) | (row[1:] != row[:-1])
        code, row = code[keep], row[keep]
        bits = 6 if not len(code) or code.max() < LATIN else 12
        code = code.astype(np.int32 if bits == 6 else np.int64)
        gram = code[:-2] << 2 * bits | code[1:-1] << bits | code[2:]
        ok = (row[:-2] == row[2:]) & (gram != 0)
        gram, row = gram[ok], row[:-2][ok]
        if not len(gram):
            yield lo, hi, np.zeros((hi - lo, DIMENSIONS), np.float32)
            continue
        if bits == 6:
            seen = np.flatnonzero(np.bincount(gram))
            place = np.zeros(int(seen[-1]) + 1, dtype=np.int64)
            place[seen] = np.arange(len(seen))
            gram = place[gram]
        else:
            seen, gram = np.unique(gram, return_inverse=True)
        bound, out = _bound(seen, bits), np.zeros((hi - lo, DIMENSIONS), np.float32)
        step = max(1, _COUNTS // len(seen))
        limits = np.searchsorted(row, np.arange(0, hi - lo + step, step))
        for s, (a, b) in enumerate(zip(limits[:-1], limits[1:], strict=True)):
            n = min(step, hi - lo - s * step)
            if n > 0:
                counts = np.bincount((row[a:b].astype(np.int64) - s * step) * len(seen) + gram[a:b], minlength=n * len(seen))
                out[s * step : s * step + n] = _bundle(counts.reshape(n, len(seen)), bound)
        yield lo, hi, out


def learn(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Language names (sorted) and their prototypes, each of length one.

    Rows with a null language or a text without letters teach nothing.  Sums are of whole numbers,
    so the prototypes do not depend on the order of rows.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            names = b.column(1).to_pylist()
            for lo, hi, v in bundles(b.column(0)):
                length = np.linalg.norm(v, axis=1, keepdims=True)
                whole = np.rint(v / np.where(length == 0, 1, length) * _UNIT).astype(np.int64)
                for name in {*names[lo:hi]}:
                    own = np.array([x == name for x in names[lo:hi]])
                    sums[name] = sums.get(name, 0) + whole[own].sum(axis=0)
        yield from _as_rows(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[name] = sums.get(name, 0) + np.frombuffer(raw, dtype=np.int64)
        yield from _as_rows(sums)

    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null")
    found = rows.mapInArrow(bundle, "lang string, v binary").repartition("lang").mapInArrow(add, "lang string, v binary").limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    sums = {r.lang: np.frombuffer(r.v, dtype=np.int64).astype(np.float64) for r in found}
    sums = {k: v for k, v in sums.items() if v.any()}
    names = sorted(sums)
    return names, np.array([sums[x] / np.linalg.norm(sums[x]) for x in names], dtype=np.float32).reshape(len(names), DIMENSIONS)


def _as_rows(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    if sums:
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "v": pa.array([v.tobytes() for v in sums.values()], pa.binary())})


def classify(column: pa.Array, names: list[str], prototypes: np.ndarray) -> tuple[list[str], list[float]]:
    """Language and cosine (0 to 1) of each text; ``und`` and 0 without letters or prototypes."""
    langs: list[str] = []
    scores: list[float] = []
    for _, _, v in bundles(column):
        length = np.linalg.norm(v, axis=1)
        if not names:
            langs += [UNDETERMINED] * len(v)
            scores += [0.0] * len(v)
            continue
        cosine = v @ prototypes.T / np.where(length == 0, 1, length)[:, None]
        best = cosine.argmax(axis=1)
        langs += [names[i] if ok else UNDETERMINED for i, ok in zip(best, length > 0, strict=True)]
        scores += np.clip(cosine[np.arange(len(v)), best], 0, 1).astype(float).tolist()
    return langs, scores


def detect(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score`` for each row of ``docs``.

    A null text or one without any letter gets ``und`` and score 0.  Ties go to the first language
    by name.  Repeated rows give repeated results; no other column is read.
    """
    names, prototypes = model
    shared = docs.sparkSession.sparkContext.broadcast((names, prototypes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = classify(b.column(1), *shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def _lengths(column: pa.Array) -> np.ndarray:
    """The number of binary digits of each text's number of bytes."""
    return np.frexp(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(float))[1]


def _lowest(keys: DataFrame, share: float) -> list[tuple[int, int, float]]:
    """(digits, number of cosines, the cosine that ``share`` of them are below) of each length, exact and interpolated as ``percentile`` does.

    ``keys`` has a column ``key``: the digits above the 32 bits of a cosine, whose order is that of
    cosines from 0 up.  They are counted in bins, then one by one in the few bins that hold the
    ranks asked for, so no place gets all cosines of a length.
    """
    bin_of = F.shiftright("key", _BIN_BITS)

    def counted(rows: DataFrame, by: Column) -> np.ndarray:
        found = [(r.by, r.n) for r in rows.groupBy(by.alias("by")).agg(F.count(F.lit(1)).alias("n")).collect()]
        return np.array(sorted(found), dtype=np.int64).reshape(-1, 2)

    def nth(table: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        return table[np.searchsorted(np.cumsum(table[:, 1]), ranks, side="right"), 0]

    bins = counted(keys, bin_of)
    if not len(bins):
        return []
    digits, first = np.unique(bins[:, 0] >> 32 - _BIN_BITS, return_index=True)
    n = np.add.reduceat(bins[:, 1], first)
    position = (n - 1) * share
    ranks = (np.cumsum(n) - n + np.stack([np.floor(position), np.ceil(position)])).astype(np.int64)
    met = np.unique(nth(bins, ranks))
    rest = bins[~np.isin(bins[:, 0], met)] * [1 << _BIN_BITS, 1]
    table = np.concatenate([rest, counted(keys.where(bin_of.isin(met.tolist())), F.col("key"))])
    low, high = (nth(table[table[:, 0].argsort()], ranks) & 0xFFFFFFFF).astype(np.uint32).view(np.float32).astype(float)
    return list(zip(digits.tolist(), n.tolist(), (low + (position - np.floor(position)) * (high - low)).tolist(), strict=True))


def least_cosines(rows: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", lang_col: str = "lang") -> np.ndarray:
    """The cosine that a text needs to be in a language at all, by the binary digits of its length.

    Longer texts come nearer to their language, so what is far from all there is in none.  Of all
    labelled texts of each length the lowest ``LOWEST`` set the bound, less some slack; a length of
    too few has that of the shorter ones.
    """
    names, prototypes = model
    shared = rows.sparkSession.sparkContext.broadcast((names, prototypes))
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = classify(b.column(0), *shared.value)
            ok = np.array([x != UNDETERMINED for x in langs], dtype=bool)
            bits = (np.array(scores, dtype=np.float32) + np.float32(0)).view(np.int32)  # no -0.0, whose bits sort last
            key = _lengths(b.column(0)).astype(np.int64) << 32 | bits
            yield pa.RecordBatch.from_arrays([pa.array(key[ok], pa.int64())], ["key"])

    keys = materialize(rows.select("text").mapInArrow(run, "key long"), "cosines")
    least = np.full(64, LEAST_COSINE)
    for digits, n, low in _lowest(keys, LOWEST):
        if n >= LEAST_LABELLED:
            least[digits] = max(LEAST_COSINE, SLACK * low)
    return np.maximum.accumulate(least)


def keep_identified(docs: DataFrame, model: tuple[list[str], np.ndarray], least: float | np.ndarray = LEAST_COSINE, text_col: str = "text") -> DataFrame:
    """The rows whose language is determined with a cosine of ``least`` (by length, or one for all) or more, all columns kept.

    Null and empty texts and those without letters go; repeated rows go or stay together.  Columns
    are taken by place, so names do not matter.
    """
    names, prototypes = model
    shared = docs.sparkSession.sparkContext.broadcast((names, prototypes, np.broadcast_to(least, 64).copy()))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, prototypes, least = shared.value
            langs, scores = classify(b.column(at), names, prototypes)
            near = np.array(scores, dtype=float) >= least[_lengths(b.column(at))]
            yield b.filter(pa.array([x != UNDETERMINED and bool(s) for x, s in zip(langs, near, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
