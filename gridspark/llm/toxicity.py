"""Toxicity scores of texts whose words may be disguised.

Noisy channel: a word with digits or signs among its letters, with a letter three times or more in
a row becomes a lattice of what it may stand for.  So does a whole run of letters, digits and signs
that stand alone, apart by spaces or punctuation; there a word may end after each of them.  Viterbi
decoding under a character trigram model, counted over all documents, picks the likeliest plain form.
Two or three neighbouring words, one separator apart, have a lattice of two paths, with the spaces
and without; the second is taken where it is a known bad word and the likelier one.
All other words have a lattice of one path, themselves, and are taken as they stand.

Scoring: words and their beginnings that stand in toxic documents far more often than in others form
a weighted lexicon; the score is the noisy-or over the words of the restored text.  Occurrences
after the same word count once, and once a document, so copies and repeats lend words no weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .language_id import CLASSES, LATIN, _codes, _letter_classes

#: What signs and digits stand for in disguised words.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c"}
#: Log-probabilities of the channel for a sign read as a letter, a sign that is noise, and one or two letters for a run.
READ, NOISE, SINGLE, DOUBLE = -0.5, -6.0, -0.2, -1.0
#: Fixed value: log-probability of the channel for a space put into a word.
BROKEN = -3.0
#: Labelled rows that the lexicon is fitted on (a sample by hash of the id); bounds the lexicon and what is broadcast.
MOST_LABELLED = 20_000
#: A word or beginning counts when it stands behind so many different words in toxic documents.
LEAST_SUPPORT = 5
#: ... and when the share of toxic ones among its occurrences is surely above this.
LEAST_SURE = 0.5
#: ... and their plain share is this or more; a beginning shared with harmless words gives way to a longer one.
LEAST_SHARE = 0.95
#: Longest word, runs of equal letters counted once, that its likeliest form replaces; longer ones may be keys and addresses and are scored in both forms.
LONGEST = 40
#: Letters, digits and signs in a row, each alone, that are taken as spelt out.
LEAST_SPELT = 4
_PREFIXES = (4, 5, 6)
_BITS, _CLASSES = 6, 64
#: Letter classes of the character model: those of Latin letters, which letters of other scripts share.
_FOLD = np.array([c if c < LATIN else 27 + c % (_CLASSES - 27) for c in range(CLASSES)], dtype=np.uint8)
_Z = 2.58

_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LETTER = _ALNUM.copy()
_LETTER[48:58] = False
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[ord(c) for c in LEET]] = True
_EDGE = np.zeros(256, dtype=bool)  # signs that are also punctuation at the edge of a word
_EDGE[[ord(c) for c in "!|+("]] = True


# --- the character model ---------------------------------------------------------------------


def learn_characters(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log-probabilities of a letter class after two others, from the trigrams of all texts."""
    size = _CLASSES**3

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            for _, _, data, off in tb.chunks(b.column(0)):
                code, row = _codes(data, off)
                keep = np.ones(len(code), dtype=bool)
                keep[1:] = (code[1:] != 0) | (code[:-1] != 0) | (row[1:] != row[:-1])
                code = _FOLD[code[keep]].astype(np.int64)
                total += np.bincount(code[:-2] << 2 * _BITS | code[1:-1] << _BITS | code[2:], minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    counts = np.zeros(size)
    for r in docs.select(text_col).mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.gram] = r.n
    counts = counts.reshape(_CLASSES, _CLASSES, _CLASSES)
    one = counts.sum(axis=(0, 1)) + 1
    two = counts.sum(axis=0)
    p1 = one / one.sum()
    p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
    p3 = (counts + 20 * p2) / (counts.sum(axis=2, keepdims=True) + 20)
    return np.log(p3).astype(np.float32)


def _class(c: str) -> int:
    return int(_FOLD[_letter_classes()[ord(c)]])


def _cuts(text: str) -> list[str]:
    """The text whole, and with a word's end before it, at one place within it, or both."""
    inner = [text, *(f"{text[:x]} {text[x:]}" for x in range(1, len(text)))]
    return inner + [" " + x for x in inner]


def decode(word: str, model: np.ndarray, spelt: bool = False) -> tuple[str, float]:
    """The likeliest plain form of a word and its log-probability (Viterbi over the last two letters).

    A ``spelt`` run may stand for several words, which spaces part.
    """
    word = word.lower()
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}  # what is read so far: (the part before, text)
    i = 0
    while i < len(word):
        c, j = word[i], i + 1
        while j < len(word) and word[j] == c:
            j += 1
        run, sign = j - i, c in LEET
        letters = LEET.get(c, c if c.isalpha() else "")
        options = [("", NOISE * run)] if sign or not letters else []
        for x in letters:
            cost = READ * run if sign else 0.0
            if run <= 2:
                options.append((x * run, cost))
            if run >= 2 and (sign or run >= 3):
                options += [(x, cost + SINGLE), (x * 2, cost + DOUBLE)]
        if spelt:
            if run >= 3 and not sign:
                options += [(f"{x}{a}{x}", DOUBLE) for x in letters for a in (f"{x} ", f" {x}")]  # two words meet
            options = [(y, cost) for text, cost in options for y in (_cuts(text) if " " not in text else (text, " " + text))]
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (p, out) in states.items():
            for text, cost in options:
                if not b and text[:1] == " ":
                    continue
                a2, b2, p2 = a, b, p + cost
                for x in text:
                    k = _class(x)
                    p2 += float(model[a2, b2, k])
                    a2, b2 = b2, k
                if (a2, b2) not in new or p2 > new[a2, b2][0]:
                    new[a2, b2] = (p2, (out, text) if text else out)
        states, i = new, j
    best = max((p + (float(model[a, b, 0]) if b or not spelt else 0.0), _text(out)) for (a, b), (p, out) in states.items())
    return best[1], best[0]


def likelihood(text: str, model: np.ndarray) -> float:
    """Log-probability of a text under the character model, from a word's beginning to a word's end."""
    a = b = 0
    out = 0.0
    for c in text.lower() + " ":
        k = _class(c)
        if k or b:
            out, a, b = out + float(model[a, b, k]), b, k
    return out


def _mended(w: tb.Words, data: np.ndarray, begin: np.ndarray, end: np.ndarray, bad: np.ndarray, model: np.ndarray) -> Iterator[tuple[int, np.uint64]]:
    """(first word, whole hash) of neighbouring words that spaces broke out of one of ``bad`` (sorted features of whole words)."""
    row = np.repeat(np.arange(len(w.count)), w.count)
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    plain = (letters[end] - letters[begin] == end - begin) & (end > begin)
    # A word goes on in the next one if nothing but one separator stands between their letters.
    on = np.zeros(len(row), dtype=bool)
    on[:-1] = plain[:-1] & plain[1:] & (row[1:] == row[:-1]) & (begin[1:] - end[:-1] == 1)
    for m in (2, 3):
        at = np.flatnonzero(on[: len(on) - m + 1] if m == 2 else on[: len(on) - 2] & on[1 : len(on) - 1]) if len(on) >= m else np.zeros(0, np.int64)
        if not len(at):
            continue
        whole = w.joined_hash([(begin[at + x], end[at + x]) for x in range(m)])
        place = np.minimum(np.searchsorted(bad, whole ^ np.uint64(1)), len(bad) - 1)
        for k in np.flatnonzero(bad[place] == whole ^ np.uint64(1)):
            parts = [data[begin[at[k] + x] : end[at[k] + x]].tobytes().decode("utf-8", "ignore") for x in range(m)]
            if likelihood("".join(parts), model) + BROKEN * (m - 1) > likelihood(" ".join(parts), model):
                yield int(at[k]), whole[k]


def _text(out: tuple | None) -> str:
    parts = []
    while out:
        out, text = out
        parts.append(text)
    return "".join(reversed(parts))


# --- words of a chunk, disguised ones restored ---------------------------------------------------


def _spelt_runs(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    """(row, first byte, last byte + 1, what is spelt) of each run of letters, digits and signs that stand alone, with a letter among them."""
    n = len(data)
    if not n:
        return
    inside = _ALNUM[data] | _SIGN[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1

    def sums(mask: np.ndarray) -> np.ndarray:
        s = np.concatenate([[0], np.cumsum(mask)])
        return s[stop] - s[start]

    glyph = (data & 0xC0) != 0x80
    kept = sums(_ALNUM[data] & glyph)
    other = sums(inside & ~_ALNUM[data])
    alone = ((kept == 1) & (sums(_EDGE[data]) == other)) | ((kept == 0) & (other == 1))
    row = np.searchsorted(off, start, side="right") - 1
    fresh = np.ones(len(start), dtype=bool)
    fresh[1:] = (row[1:] != row[:-1]) | ~alone[1:] | ~alone[:-1]
    at = np.flatnonzero(fresh)
    size = np.diff(np.append(at, len(start)))
    letters = np.concatenate([[0], np.cumsum(sums(_LETTER[data]) > 0)])
    run = (size >= LEAST_SPELT) & (letters[at + size] > letters[at])
    for x, m in zip(at[run].tolist(), size[run].tolist(), strict=True):
        a, b = int(start[x]), int(stop[x + m - 1])
        own = inside[a:b].copy()
        for y in range(x, x + m):
            if kept[y]:
                own[start[y] - a : stop[y] - a] &= _ALNUM[data[start[y] : stop[y]]]
        yield int(row[x]), a, b, data[a:b][own].tobytes()


def _restored(data: np.ndarray, off: np.ndarray, model: np.ndarray, known: dict[bytes, str]) -> tuple[tb.Words, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, str, int]]]:
    """Words, begin and end of each one's core, which are replaced, and (row, restored word, its first word's number)."""
    w = tb.Words(data, off)
    n = len(data)
    # The core reaches from the first letter, digit or sign to the last letter or digit; one lone $ or @ behind it belongs to it.
    ahead = np.where(_ALNUM[data] | _SIGN[data], np.arange(n), n)
    ahead = np.minimum.accumulate(ahead[::-1])[::-1] if n else ahead
    behind = np.maximum.accumulate(np.where(_ALNUM[data], np.arange(n), -1)) if n else np.zeros(0, np.int64)
    begin = np.minimum(ahead[w.start], w.end) if len(w.start) else w.start
    end = behind[w.end - 1] + 1 if len(w.start) else w.end
    tail = np.minimum(end, n - 1)
    lone = (end < w.end) & np.isin(data[tail], [ord("$"), ord("@")]) & ((end + 1 == w.end) | (data[np.minimum(end + 1, n - 1)] != data[tail])) if len(w.start) else np.zeros(0, bool)
    end = np.where((end > begin) & lone, end + 1, end)
    end = np.maximum(end, begin)

    def sums(mask: np.ndarray) -> np.ndarray:
        s = np.concatenate([[0], np.cumsum(mask)])
        return s[end] - s[begin]

    letters, signs = sums(_LETTER[data]), sums(_SIGN[data])
    low = tb._LOWER[data]
    triple = np.zeros(n, dtype=bool)
    if n > 2:
        triple[2:] = (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & _LETTER[data[2:]]
    odd = ((signs > 0) & (letters > 0)) | (sums(triple) > 0)
    again = np.zeros(n, dtype=bool)
    again[1:] = (low[1:] == low[:-1]) & (_LETTER | _SIGN)[data[1:]]
    long = end - begin - sums(again) > LONGEST
    row = np.repeat(np.arange(len(w.count)), w.count)
    out: list[tuple[int, str, int]] = []
    replaced = np.zeros(len(w.start), dtype=bool)
    raw = data.tobytes()
    for r, first, last, spelt in _spelt_runs(data, off):
        plain = known.get(b" " + spelt)
        if plain is None:
            plain = decode(spelt.decode("utf-8", "ignore"), model, spelt=True)[0]
            if len(spelt) <= 4 * LONGEST:
                known[b" " + spelt] = plain
        if max(map(len, plain.split()), default=0) < 2:
            continue
        # The words that the run holds whole give way to it; what it shares with others is scored with both.
        lo, hi = np.searchsorted(w.start, first, side="right") - 1, np.searchsorted(w.start, last)
        out.append((r, plain, int(lo)))
        replaced[lo:hi] |= (begin[lo:hi] >= first) & (end[lo:hi] <= last)
    for k in np.flatnonzero(odd & ~replaced):
        core = raw[begin[k] : end[k]]
        plain = known.get(core)
        if plain is None:
            if len(known) > 200_000:
                known.clear()
            plain = decode(core.decode("utf-8", "ignore"), model)[0]
            if len(core) <= 4 * LONGEST:
                known[core] = plain
        out.append((int(row[k]), plain, int(k)))
        replaced[k] = not long[k]
    return w, begin, end, replaced, out


def _features(column: pa.Array, model: np.ndarray, known: dict[bytes, str], bad: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, words, features, words before) of the restored words; features: the word and its beginnings.

    With ``bad`` features, also of words that spaces broke.
    """
    for lo, hi, data, off in tb.chunks(column):
        w, begin, end, replaced, out = _restored(data, off, model, known)
        row = np.repeat(np.arange(hi - lo), w.count)
        before = np.concatenate([[np.uint64(0)], w.span_hash(begin, end)])[:-1] if len(row) else np.zeros(0, np.uint64)
        before[w.first[:-1][w.count > 0]] = 0
        keep = ~replaced & (end > begin)
        parts = [(w, begin[keep], end[keep], row[keep], before[keep])]
        joined = np.frombuffer("\n".join(x for _, x, _ in out).encode(), dtype=np.uint8)
        if len(joined):
            extra = tb.Words(joined, np.array([0, len(joined)]))
            line = np.concatenate([[0], np.cumsum(joined == 10)])[extra.start]
            parts.append((extra, extra.start, extra.end, np.array([r for r, _, _ in out])[line], before[[k for _, _, k in out]][line]))
        found = []
        for words, a, b, r, ahead in parts:
            whole = words.span_hash(a, b)
            found.append((r, whole, whole ^ np.uint64(1), ahead))
            for k in _PREFIXES:
                ok = b - a > k
                found.append((r[ok], whole[ok], words.span_hash(a[ok], a[ok] + k), ahead[ok]))
        mended = list(_mended(w, data, begin, end, bad, model)) if bad is not None and len(bad) else []
        if mended:
            at, whole = np.array([k for k, _ in mended]), np.array([x for _, x in mended], dtype=np.uint64)
            found.append((row[at], whole, whole ^ np.uint64(1), before[at]))
        yield (lo, *(np.concatenate(x) for x in zip(*found, strict=True)))


# --- learning and scoring ------------------------------------------------------------------------


def learn_lexicon(docs: DataFrame, labels: DataFrame, characters: np.ndarray, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """Features (sorted), their weights and the score of a text without any.

    ``labels`` beyond ``MOST_LABELLED`` rows are sampled by hash of the id; null labels teach nothing,
    nor does an id with labels of both kinds.
    """
    labels = labels.select(F.col(id_col), (F.col(label_col) > 0).alias("toxic")).where("toxic is not null")
    labels = labels.groupBy(id_col).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").drop("other")
    n = labels.count()
    part = F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < int(1_000_000 * min(1.0, MOST_LABELLED / max(n, 1)))
    rows = docs.select(id_col, text_col).join(F.broadcast(labels.where(part)), id_col).select(text_col, "toxic")
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(characters)

    def counted(rows: DataFrame, wanted) -> dict[int, int]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[bytes, str] = {}
            among = None if wanted is None else wanted.value
            for b in batches:
                for _, row, _, feature, before in _features(b.column(0), shared.value, known):
                    if among is not None:
                        ok = np.isin(feature, among)
                        row, feature, before = row[ok], feature[ok], before[ok]
                    order = np.lexsort((before, feature, row))
                    row, feature, before = row[order], feature[order], before[order]
                    head = np.ones(len(row), dtype=bool)  # a document speaks once for each feature
                    head[1:] = (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])
                    yield pa.RecordBatch.from_arrays([pa.array(feature[head].view(np.int64)), pa.array(before[head].view(np.int64))], ["f", "before"])

        pairs = rows.select(text_col).mapInArrow(run, "f bigint, before bigint").distinct()
        counts = pairs.groupBy("f").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= (LEAST_SUPPORT if wanted is None else 1))
        return {r.f: r.n for r in counts.toLocalIterator()}

    totals = rows.agg(F.count_if("toxic").alias("bad"), F.count(F.lit(1)).alias("all")).first()
    bad = counted(rows.where("toxic"), None)
    features = np.sort(np.array(list(bad), dtype=np.int64).view(np.uint64))
    good = counted(rows.where("not toxic"), sc.broadcast(features))
    n1 = np.array([bad[int(x)] for x in features.view(np.int64)], dtype=float)
    n0 = np.array([good.get(int(x), 0) for x in features.view(np.int64)], dtype=float)
    n, p = n1 + n0, n1 / np.maximum(n1 + n0, 1)
    sure = (p + _Z**2 / (2 * n) - _Z * np.sqrt(p * (1 - p) / n + _Z**2 / (4 * n**2))) / (1 + _Z**2 / n) if len(n) else p
    keep = (sure >= LEAST_SURE) & (p >= LEAST_SHARE)
    return features[keep], sure[keep], 0.1 * (totals.bad + 1) / (totals.all + 2)


def score(column: pa.Array, characters: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray, float], known: dict[bytes, str]) -> np.ndarray:
    features, weights, base = lexicon
    out = np.full(len(column), base)
    if not len(features):
        return out
    for lo, row, word, feature, _ in _features(column, characters, known, features):
        at = np.minimum(np.searchsorted(features, feature), len(features) - 1)
        hit = np.flatnonzero(features[at] == feature)
        best: dict[tuple[int, int], float] = {}
        for r, x, v in zip(row[hit].tolist(), word[hit].tolist(), weights[at[hit]].tolist(), strict=True):
            best[r, x] = max(best.get((r, x), 0.0), v)
        clean: dict[int, float] = {}
        for (r, _), v in sorted(best.items()):
            clean[r] = clean.get(r, 1 - base) * (1 - v)
        for r, v in clean.items():
            out[lo + r] = 1 - v
    return np.clip(out, 0, 1)


def toxicity(docs: DataFrame, characters: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score`` (0 to 1) for each row.

    A null, empty or wordless text has the base score.  Each distinct word counts once, by its best
    feature, so order, ties and repeats do not matter.  Repeated rows give repeated results; no
    other column is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((characters, lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, str] = {}
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score(b.column(1), *shared.value, known))], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")
