"""Benchmark decontamination: BM25 with block-max pruning over an inverted index of test items.

Every training text is cut into overlapping passages of words, and each passage is a query.
Passages grow with the items: an item of up to ``HALF * 2**k`` words is looked for in passages of
twice as many, which start so near each other that one of them holds a verbatim copy whole.  An
item's score is the sum of its terms' BM25 impacts found in the passage, as a share of the score of
the item with itself.  Items lie in blocks; each term keeps its largest share in each block and over
all.  The search is WAND with block maxima, of many passages at once:

1. A passage whose terms' largest shares, and what all non-essential terms (very common ones, whose
   lists are never read) could add, stay below the threshold reads no list.
2. The lists of the others are merged in the order of blocks.  The next block in any of a passage's
   lists is a pivot; it is opened only if the maxima of the terms that have it reach the threshold.
3. What is opened is scored in full, and every item at or above the threshold is taken, however many.

A taken item counts only if its question and its answer are both found in the text around the
passage, by word n-grams.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .shared import materialize

K1, B = 1.2, 0.75
#: Words between the starts of passages, for items of at most so many words; doubled until a longer item fits.  A passage has twice as many.
HALF = 64
BLOCK_ITEMS = 4
#: Items in one index; a larger benchmark is indexed in shards.
SHARD_ITEMS = 4096
#: Shards that one pass over the texts meets (they are cut into words once); of more, further passes.
PASS_SHARDS = 4
#: Passages searched at once.
PASSAGES = 8192
#: Words of an item that the index holds together in a shard at most (bounds what is sent to workers).
SHARD_WORDS = 1 << 20
#: A term in more than this share of the items is non-essential.
COMMON = 0.1
THRESHOLD, LEAST_QUESTION, LEAST_ANSWER = 0.6, 0.5, 0.5


def tokens(column: pa.Array) -> Iterator[tuple[int, int, tb.Words]]:
    """Words of letters and digits, lowered, of chunks of rows."""
    column = pc.utf8_lower(column)
    for lo, hi, data, off in tb.chunks(column):
        yield lo, hi, tb.Words(data, off, tb.PUNCTUATION, lower=False)


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the last sentence is the answer, or the last third of the only one."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if re.search(r"\w", s)]
    if len(sentences) > 1:
        return " ".join(sentences[:-1]), sentences[-1]
    words = text.split()
    cut = -(-2 * len(words) // 3)
    return " ".join(words[:cut]), " ".join(words[cut:])


def _item_hashes(text: str) -> np.ndarray:
    for _, _, w in tokens(pa.array([text], pa.string())):
        return w.hash
    return np.zeros(0, np.uint64)


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n``-word runs, or of the whole if it is shorter."""
    n = min(n, len(h))
    if not n:
        return np.zeros(0, np.uint64)
    acc = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        acc = tb.mix(acc * np.uint64(0xD6E8FEB86659FD93) + h[i : len(h) - n + 1 + i])
    return acc


@dataclass
class Index:
    half: int  # words between the starts of passages, no fewer than an item has
    ids: list
    terms: np.ndarray  # sorted vocabulary of this shard
    question: list[tuple[int, np.ndarray]]
    answer: list[tuple[int, np.ndarray]]
    lists: np.ndarray  # limits of each essential term's blocks
    blocks: np.ndarray
    maxima: np.ndarray
    top: np.ndarray  # of each term: the largest of its block maxima
    slack: np.ndarray  # of each block: most that its non-essential terms add
    block_terms: list[np.ndarray]  # its items' terms, one item after the other
    block_shares: list[np.ndarray]
    block_starts: list[np.ndarray]


def build_indexes(ids: list, texts: list[str], df: dict[int, int], n_items: int, average: float) -> list[Index]:
    """An index for the items of each passage length."""
    hashes = [_item_hashes(t or "") for t in texts]
    halves: dict[int, list[int]] = {}
    for i, h in enumerate(hashes):
        if len(h):
            halves.setdefault(max(HALF, 1 << (len(h) - 1).bit_length()), []).append(i)
    return [_build_index(half, known, ids, texts, hashes, df, n_items, average) for half, known in sorted(halves.items())]


def _build_index(half: int, known: list[int], ids: list, texts: list[str], hashes: list[np.ndarray], df: dict[int, int], n_items: int, average: float) -> Index:
    scored = []
    for i in known:
        t, tf = np.unique(hashes[i], return_counts=True)
        d = np.array([df[int(x)] for x in t.view(np.int64)], dtype=float)
        impact = np.log1p((n_items - d + 0.5) / (d + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(hashes[i]) / average))
        # Items whose commonest term is the same (those of one language) share blocks, which keeps the maxima tight.
        scored.append(((int(t[np.lexsort((t, -d))[0]]), float(impact.sum())), i, t, impact / impact.sum(), d > COMMON * n_items))
    scored.sort(key=lambda x: (x[0], x[1]))
    terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x[2] for x in scored)]))
    most: dict[tuple[int, int], float] = {}
    slack = np.zeros(-(-len(scored) // BLOCK_ITEMS))
    item_terms, item_shares = [], []
    for k, (_, _, t, share, common) in enumerate(scored):
        at = np.searchsorted(terms, t)
        item_terms.append(at)
        item_shares.append(share)
        slack[k // BLOCK_ITEMS] = max(slack[k // BLOCK_ITEMS], share[common].sum())
        for x, s in zip(at[~common].tolist(), share[~common].tolist(), strict=True):
            key = (x, k // BLOCK_ITEMS)
            most[key] = max(most.get(key, 0.0), s)
    keys = sorted(most)
    lists = np.searchsorted(np.array([x for x, _ in keys], dtype=np.int64), np.arange(len(terms) + 1))
    question, answer = [], []
    for _, i, *_ in scored:
        q, a = split_item(texts[i])
        for part, n, into in ((q, 3, question), (a, 2, answer)):
            h = _item_hashes(part)
            into.append((min(n, len(h)), np.unique(_grams(h, n))))
    parts = [range(k, min(k + BLOCK_ITEMS, len(scored))) for k in range(0, len(scored), BLOCK_ITEMS)]
    maxima = np.array([most[k] for k in keys])
    top = np.zeros(len(terms))
    np.maximum.at(top, np.array([x for x, _ in keys], dtype=np.int64), maxima)
    return Index(
        half, [ids[i] for _, i, *_ in scored], terms, question, answer, lists,
        np.array([b for _, b in keys], dtype=np.int64), maxima, top, slack,
        [np.concatenate([item_terms[i] for i in p]) for p in parts],
        [np.concatenate([item_shares[i] for i in p]) for p in parts],
        [np.concatenate([[0], np.cumsum([len(item_terms[i]) for i in p])[:-1]]) for p in parts],
    )


def _found(part: tuple[int, np.ndarray], h: np.ndarray) -> float:
    n, grams = part
    return float(np.isin(grams, _grams(h, n)).mean()) if n and len(h) >= n else 1.0 if not n else 0.0


def _pivots(index: Index, term: np.ndarray, half: np.ndarray, half_row: np.ndarray, threshold: float) -> Iterator[tuple[int, int]]:
    """(passage, block) in order, of blocks whose items the passage could lift to the threshold."""
    n_terms, n_blocks = len(index.terms), len(index.slack)
    enough = threshold - 1e-9
    follows = np.append(half_row[1:] == half_row[:-1], False)
    for s in range(0, len(half_row), PASSAGES):
        e = min(s + PASSAGES, len(half_row))
        lo, hi = np.searchsorted(half, [s, e + 1])
        lo, hi = lo + np.flatnonzero(term[lo:hi] >= 0), hi
        p, t = half[lo], term[lo]
        before = (p > s) & follows[np.maximum(p - 1, 0)]  # a half is also the second one of the passage before
        both = np.unique(np.concatenate([p * n_terms + t, (p[before] - 1) * n_terms + t[before]]))
        p, t = both // n_terms, both % n_terms
        alive = np.bincount(p - s, weights=index.top[t], minlength=e + 1 - s) + index.slack.max() >= enough
        alive[e - s :] = False
        keep = alive[p - s]
        p, t = p[keep], t[keep]
        at, size = index.lists[t], index.lists[t + 1] - index.lists[t]
        place = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        key = np.repeat(p, size) * n_blocks + index.blocks[place]
        order = np.argsort(key, kind="stable")
        key = key[order]
        begins = np.flatnonzero(np.diff(key, prepend=-1))
        bound = np.add.reduceat(index.maxima[place[order]], begins) if len(begins) else np.zeros(0)
        key = key[begins]
        # A block that only non-essential terms could lift stands in no list.
        alone = np.flatnonzero(index.slack >= enough)
        if len(alone):
            every = (np.arange(s, e)[:, None] * n_blocks + alone).ravel()
            key, bound = np.append(key, np.setdiff1d(every, key)), np.append(bound, np.zeros(len(every) - np.isin(every, key).sum()))
            order = np.argsort(key)
            key, bound = key[order], bound[order]
        yield from ((k // n_blocks, k % n_blocks) for k in key[bound + index.slack[key % n_blocks] >= enough].tolist())


def search(index: Index, w: tb.Words, threshold: float) -> Iterator[tuple[int, int, float, float, float, int]]:
    """(row, item place, best score, question and answer overlap, passages) for verified hits, by row and item."""
    if not len(index.ids) or not len(w.start):
        return
    h = w.hash
    at = np.minimum(np.searchsorted(index.terms, h), len(index.terms) - 1)
    term = np.where(index.terms[at] == h, at, -1)
    # Half passages, never across rows; a passage is one half and the next.
    halves = -(-w.count // index.half)
    first_half = np.concatenate([[0], np.cumsum(halves)])
    half_row = np.repeat(np.arange(len(w.count)), halves)
    row = np.repeat(np.arange(len(w.count)), w.count)
    half = first_half[row] + (np.arange(len(h)) - w.first[row]) // index.half
    hits: dict[tuple[int, int], list] = {}
    present, last, own = np.zeros(len(index.terms), dtype=bool), -1, np.zeros(0, np.int64)
    for p, b in _pivots(index, term, half, half_row, threshold):
        if p != last:
            present[own] = False
            r = half_row[p]
            begin = w.first[r] + (p - first_half[r]) * index.half
            end = min(begin + 2 * index.half, w.first[r + 1])
            own = term[begin:end]
            own, last = own[own >= 0], p
            present[own] = True
        scores = np.add.reduceat(index.block_shares[b] * present[index.block_terms[b]], index.block_starts[b])
        for i in np.flatnonzero(scores >= threshold):
            s, k = float(scores[i]), int(b * BLOCK_ITEMS + i)
            around = h[max(w.first[r], begin - index.half) : min(w.first[r + 1], end + index.half)]
            q, a = _found(index.question[k], around), _found(index.answer[k], around)
            if q >= LEAST_QUESTION and a >= LEAST_ANSWER:
                x = hits.setdefault((int(r), k), [0.0, 0.0, 0.0, 0])
                x[:] = [max(x[0], s), max(x[1], q), max(x[2], a), x[3] + 1]
    for (r, i), x in sorted(hits.items()):
        yield (r, i, *x)


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[Index]]:
    """For each pass over the texts the indexes of its shards; term statistics are those of all items.

    Items of null text or without words are never found.  Items of equal text are all kept; an item
    that is repeated whole counts once.
    """
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).distinct()

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, w in tokens(b.column(0)):
                row = np.repeat(np.arange(len(w.count)), w.count)
                pair = np.unique(np.stack([row.astype(np.uint64), w.hash]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pair[1].view(np.int64)), pa.array(np.zeros(pair.shape[1], np.int64))], ["t", "words"])
                yield pa.RecordBatch.from_arrays([pa.array([None] * len(w.count), pa.int64()), pa.array(w.count.astype(np.int64))], ["t", "words"])

    terms = lambda of: of.select("text").mapInArrow(postings, "t bigint, words bigint")
    counted = materialize(terms(items).groupBy("t").agg(F.count_if(F.expr("words > 0 or t is not null")).alias("n"), F.sum("words").alias("words"), F.count(F.lit(1)).alias("all")), "terms")
    whole = counted.where("t is null").first()
    if whole is None or not whole.words:
        return
    shards = max(1, -(-whole["all"] // SHARD_ITEMS), -(-int(whole.words) // SHARD_WORDS))
    shard = F.pmod(F.xxhash64("id", "text"), F.lit(shards))
    held: list[Index] = []
    for k in range(shards):
        mine = items.where(shard == k)
        # No more terms than the shard has words come to the driver.
        df = {r.t: r.n for r in counted.where("t is not null").join(terms(mine).select("t").distinct(), "t", "left_semi").toLocalIterator()}
        rows = sorted(mine.collect(), key=lambda r: (r.id is None, r.id, r.text or ""))
        held += build_indexes([r.id for r in rows], [r.text for r in rows], df, whole.n, whole.words / whole.n)
        if k % PASS_SHARDS == PASS_SHARDS - 1 or k == shards - 1:
            yield held
            held = []


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``id_col, item_col, score, question_overlap, answer_overlap, passages`` for each row and item it leaks.

    A null, empty or wordless text leaks nothing; texts and items of any length are searched whole.
    Repeated rows give repeated results; items of equal text are each found.  Where a score ties
    with the threshold the item is found.  Other columns are not read, so their names cannot clash.
    """
    out, kind, item_kind = None, docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, score double, question_overlap double, answer_overlap double, passages int"

    def searcher(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(0)
                for lo, _, w in tokens(b.column(1)):
                    for index in shared.value:
                        found = list(search(index, w, threshold))
                        if not found:
                            continue
                        r, i, s, q, a, n = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array([lo + x for x in r])), pa.array([index.ids[x] for x in i]), pa.array(s), pa.array(q), pa.array(a), pa.array(n, pa.int32())], ["a", "b", "c", "d", "e", "f"])

        return run

    for shard in indexes(benchmark, item_col):
        part = docs.select(id_col, text_col).mapInArrow(searcher(docs.sparkSession.sparkContext.broadcast(shard)), schema)
        out = part if out is None else out.union(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows that leak no item, with all their columns, by place, so names do not matter.

    Null, empty and wordless texts stay; repeated rows stay or go together.
    """
    at = docs.columns.index(text_col)

    def filterer(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, dtype=bool)
                for lo, _, w in tokens(b.column(at)):
                    for index in shared.value:
                        for r, *_ in search(index, w, threshold):
                            keep[lo + r] = False
                yield b.filter(pa.array(keep))

        return run

    for shard in indexes(benchmark, item_col):
        docs = docs.mapInArrow(filterer(docs.sparkSession.sparkContext.broadcast(shard)), docs.schema)
    return docs
