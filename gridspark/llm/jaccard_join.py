"""N-gram Jaccard self-join by prefix trees.

1. Equal sets form a class, of which one represents all.
2. How many classes hold a shingle, to the power of two above, and then its hash, is the global order
   of shingles.  Counts (to 255 in a block) may be raised by hash collisions, never lost: blocks of
   texts send sorted 48-bit keys to the buckets that count them and get the levels back.
3. Two sets that link share a shingle among the first ``n - ceil(n * num / den) + 1`` of both, so a
   set with that many shingles of its own alone links with none, and is left here.  For the others,
   the shared shingles of that prefix tell the candidates; the components of candidates are the
   groups that a trie has to hold.
4. In a group the ordered sets form a compressed trie.  One walk carries all queries along: the
   overlap with a path is counted once for every set below it, and a query leaves a subtree when
   the rest of both sides cannot bring the overlap to what their lengths ask for.
5. Components of the links give the groups.

A group beyond ``BLOCK`` sets or ``CELL_SHINGLES`` shingles is cut into blocks that meet two by two
in tasks of their own.  Links are never written out: a task returns, for each set, how many
documents it links to and the smallest id in its part, so the output is linear in the group however
dense the links are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .components import components, contract
from .shared import materialize, unclashing

#: Bytes of text packed into a block, of which a longer text makes one of its own.
BLOCK_TEXT = 1 << 20
#: Shingles that a bucket of the count holds, and the least number of buckets.
BUCKET_SHINGLES, LEAST_BUCKETS = 1 << 20, 256
#: Sets, and shingles of all its sets, that a block holds; larger groups are cut into blocks.
BLOCK, CELL_SHINGLES = 512, 1 << 20
#: Bytes of a walk's table of sets by shared shingles; beyond that a task walks its sets in parts.
WALK_BYTES = 1 << 27
#: Ids of classes, with fingerprints, and of candidates are broadcast while they are at most so many (about 80 MB).
MOST_BROADCAST = 1_000_000
#: Bits of a shingle's hash that are counted.
_KEY_BITS = 48


def _sets(text: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The hashes of the distinct shingles of each text, ascending."""
    for _, _, data, off in tb.chunks(text):
        h, at, _, _ = tb.shingles(tb.Words(data, off), k)
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield np.unique(h[a:b])


def _keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The counted keys of a block, ascending, and how many of its sets hold each."""
    return np.unique(np.concatenate(sets) >> np.uint64(64 - _KEY_BITS), return_counts=True)


def _slices(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that hold some of the keys, and the limits of their slices."""
    bucket = (keys >> np.uint64(_KEY_BITS - bits)).astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    return bucket[at], np.append(at, len(keys))


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, byte plane by byte plane: the high planes are nearly all zero."""
    step = np.diff(keys, prepend=np.uint64(0))
    return np.ascontiguousarray(step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _KEY_BITS // 8].T).tobytes()


def unpack_keys(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(_KEY_BITS // 8, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, : _KEY_BITS // 8] = planes.T
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def levels(counts: np.ndarray) -> np.ndarray:
    """0 for what one set alone holds, else the least power of two that the count does not exceed."""
    return np.ceil(np.log2(counts)).astype(np.uint8)


def ordered(s: np.ndarray, level: np.ndarray, num: int, den: int) -> tuple[np.ndarray, int]:
    """The shared shingles of a set in the global order, and how many of them are in its prefix (none: it links with nothing).

    What no other set holds comes first in the order and is not stored.
    """
    common = level > 0
    prefix = len(s) - -(-len(s) * num // den) + 1 - int(len(s) - common.sum())
    v = np.sort(level[common].astype(np.uint64) << np.uint64(56) | s[common] & np.uint64((1 << 56) - 1))
    return v, max(0, min(prefix, len(v)))


def trie_links(sets: list[np.ndarray], num: int, den: int, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (query, stored) with ``den * shared >= num * union``, each pair once (query < stored).

    Empty sets link with nothing.  ``sizes`` are the whole sizes of sets given without what they alone hold.
    """
    m = len(sets)
    held = np.array([len(s) for s in sets], dtype=np.int64)
    n = held if sizes is None else sizes
    if m < 2 or not held.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    universe, rank, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), held)
    kept = df[rank] > 1  # what one set alone holds can match nothing
    place = np.cumsum(df > 1) - 1
    rank, owner, universe = place[rank[kept]], owner[kept], universe[df > 1]
    if not len(universe):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if m > 2 and m * len(universe) > WALK_BYTES:
        return _in_parts(sets, num, den, n, min(m, 2 * int(np.ceil(np.sqrt(m * len(universe) / WALK_BYTES)))))
    has = np.zeros((m, len(universe)), dtype=bool)
    has[owner, rank] = True
    limits = np.searchsorted(owner, np.arange(m + 1))
    spread = owner * len(universe) + rank  # ascending: owners in order, ranks in order within each
    path = [rank[limits[i] : limits[i + 1]] for i in range(m)]
    order = sorted(range(m), key=lambda i: path[i].astype(">u4").tobytes())
    common = np.zeros(m + 1, dtype=np.int64)
    for j in range(1, m):
        a, b = path[order[j - 1]], path[order[j]]
        w = min(len(a), len(b))
        d = np.flatnonzero(a[:w] != b[:w])
        common[j] = d[0] if len(d) else w
    found_q, found_y = [], []
    order_n = n[order]
    order_len = np.array([len(path[i]) for i in order])
    # A node is a run lo..hi of sorted sets with one common path; the walk carries (queries, overlaps).
    todo = [(0, m, 0, np.arange(m), np.zeros(m, dtype=np.int64))]
    while todo:
        lo, hi, depth, q, o = todo.pop()
        shared = int(common[lo + 1 : hi].min()) if hi - lo > 1 else int(order_len[lo])
        chain = path[order[lo]][depth:shared]
        if len(chain):
            hits = has[np.ix_(q, chain)]
            o = o + hits.sum(axis=1)
            least, most = int(order_n[lo:hi].min()), int(order_len[lo:hi].max()) - shared
            rest = limits[q + 1] - np.searchsorted(spread, q * len(universe) + chain[-1], side="right")
            reach = o + np.minimum(rest, most)
            alive = (num + den) * reach >= num * (n[q] + least)
            q, o = q[alive], o[alive]
        if not len(q):
            continue
        while lo < hi and order_len[lo] == shared:  # sets that end here come first
            y = order[lo]
            ok = (q < y) & ((num + den) * o >= num * (n[q] + n[y]))
            if ok.any():
                found_q.append(q[ok])
                found_y.append(np.full(int(ok.sum()), y))
            lo += 1
        while lo < hi:
            step = lo + 1
            while step < hi and common[step] > shared:
                step += 1
            todo.append((lo, step, shared, q, o))
            lo = step
    return (np.concatenate(found_q), np.concatenate(found_y)) if found_q else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _in_parts(sets: list[np.ndarray], num: int, den: int, sizes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """``trie_links`` of parts two by two, each pair of sets in one walk."""
    at = [np.arange(len(sets))[k::parts] for k in range(parts)]
    found = []
    for k, mine in enumerate(at):
        for other in at[k:] if len(mine) else ():
            both = mine if other is mine else np.sort(np.concatenate([mine, other]))
            q, y = trie_links([sets[x] for x in both], num, den, sizes[both])
            q, y = both[q], both[y]
            keep = (q % parts != y % parts) if other is not mine else np.ones(len(q), dtype=bool)
            found.append((q[keep], y[keep]))
    return np.concatenate([q for q, _ in found]), np.concatenate([y for _, y in found])


def _local_roots(m: int, q: np.ndarray, y: np.ndarray) -> np.ndarray:
    label = np.arange(m)
    while True:
        new = label.copy()
        np.minimum.at(new, q, label[y])
        np.minimum.at(new, y, label[q])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents whose ``k``-word shingle sets link at ``shared / union >= num / den``.

    Returns one row per row of ``docs``: the id, ``n_shingles``, ``component_id`` (smallest id
    reachable by links, itself included), ``class_id`` (smallest id with the same set) and
    ``n_links`` (rows that this row links to).  Words are runs of bytes other than space and
    0x09-0x0D, with A-Z lowered.  A text of 1 to k-1 words is one shingle.  A null, empty or blank
    text has no shingle, links with nothing and is its own component and class.  Rows repeated
    whole are rows of one class.  A null id never leads a component that has another id.  Columns
    other than the two named are not read, so their names cannot clash.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(_sets(b.column(1), k))
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n, pa.array([_fingerprint(s.tobytes()) if len(s) else None for s in sets], pa.binary())], ["id", "n", "print"])

    rows = materialize(docs.mapInArrow(describe, f"id {kind}, n bigint, print binary"), "rows")
    same = rows.where("print is not null").groupBy("print", "id").agg(F.count(F.lit(1)).alias("rows"), F.any_value("n").alias("n"))
    classes = same.groupBy("print").agg(F.min("id").alias("rep"), F.sum("rows").alias("copies"), F.any_value("n").alias("n"), F.min_by("rows", "id").alias("rep_rows"))
    classes = materialize(classes, "classes")
    whole = classes.agg(F.count(F.lit(1)).alias("sets"), F.coalesce(F.sum("n"), F.lit(0)).alias("shingles"), F.coalesce(F.max("rep_rows"), F.lit(0)).alias("rep_rows")).first()
    bits = max(LEAST_BUCKETS, whole.shingles // BUCKET_SHINGLES).bit_length() - 1

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A row of the same id with another text is not this class.
        for b in batches:
            yield b.filter(pa.array([_fingerprint(s.tobytes()) == p for s, p in zip(_sets(b.column(3), k), b.column(1).to_pylist(), strict=True)], pa.bool_()))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in right(batches):
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and size + len(row[3]) > BLOCK_TEXT:
                    yield _block(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield _block(held)

    def texts(reps: DataFrame) -> DataFrame:
        reps = reps.select(F.col("rep").alias("id"), "print", "copies")
        return docs.join(F.broadcast(reps) if whole.sets <= MOST_BROADCAST else reps, "id").select("id", "print", "copies", "text")

    # A class stands in one block only: a block's name is its classes, and counts are of classes, not of rows.
    once = texts(classes.where("rep_rows = 1"))
    if whole.rep_rows > 1:
        again = texts(classes.where("rep_rows > 1")).mapInArrow(right, f"id {kind}, print binary, copies bigint, text string")
        once = once.union(again.dropDuplicates(["id", "print"]))
    blocks = materialize(once.mapInArrow(pack, f"block binary, rep array<{kind}>, copies array<bigint>, text array<string>"), "blocks")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, texts in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                keys, counts = _keys(list(_sets(texts.values, k)))
                bucket, at = _slices(keys, bits)
                cut = list(zip(at[:-1], at[1:], strict=True))
                counts = np.minimum(counts, 255).astype(np.uint8)
                yield pa.RecordBatch.from_pydict({"bucket": bucket, "block": [block] * len(cut), "keys": [pack_keys(keys[i:j]) for i, j in cut], "counts": [counts[i:j].tobytes() for i, j in cut]})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), (block, raw, counts) in _groups(batches, 1):
            keys = [unpack_keys(r) for r in raw]
            _, at = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.bincount(at, weights=np.frombuffer(b"".join(counts), dtype=np.uint8))
            level, ends = levels(sums)[at], np.cumsum([len(x) for x in keys])
            yield pa.RecordBatch.from_pydict({"block": block, "bucket": pa.array([bucket] * len(block), pa.int64()), "levels": [zlib.compress(x.tobytes(), 1) for x in np.split(level, ends[:-1])]})

    counted = blocks.select("block", "text").mapInArrow(deal, "bucket bigint, block binary, keys binary, counts binary").repartition("bucket").sortWithinPartitions("bucket")
    counted = materialize(counted.mapInArrow(count, "block binary, bucket bigint, levels binary"), "levels")
    # A block has at most one row of each bucket.
    counted = counted.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "levels"))).alias("levels")).select("block", F.col("levels.levels").alias("levels"))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rep, copies, texts, parts in zip(*(b.column(c) for c in ("rep", "copies", "text", "levels")), strict=True):
                sets = list(_sets(texts.values, k))
                keys, _ = _keys(sets)
                level = np.frombuffer(b"".join(zlib.decompress(x) for x in parts.as_py()), dtype=np.uint8)
                got = [ordered(s, level[np.searchsorted(keys, s >> np.uint64(64 - _KEY_BITS))], num, den) for s in sets]
                stay = [x for x, (_, prefix) in enumerate(got) if prefix]
                if stay:
                    held = [rep.values.take(pa.array(stay)), copies.values.take(pa.array(stay)), pa.array([len(sets[x]) for x in stay]), pa.array([got[x][1] for x in stay]), pa.array([len(got[x][0]) for x in stay]), pa.array([got[x][0].tobytes() for x in stay], pa.binary())]
                    yield pa.RecordBatch.from_arrays(held, ["rep", "copies", "n", "prefix", "held", "set"])

    ordered_sets = materialize(blocks.join(counted, "block").select("rep", "copies", "text", "levels").mapInArrow(order, f"rep {kind}, copies bigint, n bigint, prefix bigint, held bigint, set binary"), "ordered")

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [np.frombuffer(s, dtype=np.int64)[:p] for s, p in zip(b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True)]
            rep = b.column(0).take(pa.array(np.repeat(np.arange(len(v)), [len(x) for x in v])))
            yield pa.RecordBatch.from_arrays([rep, pa.array(np.concatenate(v) if v else np.zeros(0, np.int64))], ["rep", "shingle"])

    emitted = materialize(ordered_sets.select("rep", "prefix", "set").mapInArrow(prefixes, f"rep {kind}, shingle bigint"), "prefixes")
    met = emitted.groupBy("shingle").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader <> last").select("shingle", "leader")
    # A set has no more leaders than shingles.
    pairs = contract(emitted.join(met, "shingle").select(F.col("rep").alias("a"), F.col("leader").alias("b")))
    label = materialize(components(pairs).withColumnRenamed("id", "rep"), "labelled")
    members = ordered_sets.select("rep", "held").join(label, "rep")
    size = members.groupBy("label").agg(F.count(F.lit(1)).alias("all"), F.sum("held").alias("weight"))
    size = size.select("label", F.greatest(F.ceil(F.col("all") / BLOCK), F.ceil(F.col("weight") / CELL_SHINGLES)).cast("int").alias("blocks"))
    label = materialize(label.join(size, "label").select("rep", "label", "blocks"), "sized")

    # Spares the sets a shuffle where the ids are few.
    found = ordered_sets.select("rep", "copies", "n", "set").join(F.broadcast(label) if label.count() <= MOST_BROADCAST else label, "rep")
    own = F.pmod(F.xxhash64("rep", F.lit(2)), F.col("blocks").cast("bigint")).cast("int")
    found = found.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    found = found.select("label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "copies", "n", "set")

    def join_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), group in _groups(batches, 3):
            once = sorted({r: x for x, r in enumerate(zip(group[1], group[4], strict=True))}.values())  # rows repeated whole
            own, rep, copies, n, raw = ([c[x] for x in once] for c in group)
            q, y = trie_links([np.frombuffer(r, dtype=np.uint64) for r in raw], num, den, np.array(n, dtype=np.int64))
            if i != j:  # pairs within a block belong to the cell of that block alone
                own = np.array(own)
                apart = own[q] != own[y]
                q, y = q[apart], y[apart]
            if len(q):
                root, weight, links = _local_roots(len(rep), q, y), np.array(copies, dtype=np.int64), np.zeros(len(rep), dtype=np.int64)
                np.add.at(links, q, weight[y])
                np.add.at(links, y, weight[q])
                at = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array([rep[x] for x in at]), pa.array([rep[root[x]] for x in at]), pa.array(links[at])], ["a", "b", "links"])

    key = ["label", "i", "j"]
    linked = found.repartition(*key).sortWithinPartitions(*key, "rep")
    linked = materialize(linked.mapInArrow(join_cells, f"a {kind}, b {kind}, links bigint"), "linked")

    # A set has at most one root in each of its cells.
    label = components(contract(linked.select("a", "b")))
    degree = linked.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    of_rep = label.join(degree, "id", "left").select(F.col("id").alias("rep"), "label", "links")
    of_class = classes.select("print", "rep", "copies").join(of_rep, "rep", "left")
    of_class = of_class.select(F.col("print").alias("p"), "rep", "copies", "label", "links")
    out = rows.select("id", "n", "print").join(of_class, F.col("print") == F.col("p"), "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("label", "rep", "id").alias("component_id"),
        F.coalesce("rep", "id").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"),
    )


def keep_one(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates, with all columns: that of the smallest id, then the first in the table.

    Rows are numbered and grouped by these numbers, so rows that share an id, or have none, are rows
    like others; null ids come last.  Null, empty and blank texts are groups of their own, and stay.
    No column's name can clash.
    """
    (row,) = unclashing("row")
    docs = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = materialize(near_duplicates(docs, k, num, den, row, text_col).select(row, F.col("component_id").alias("group")), "groups")
    # Only groups of several rows have a row that is not its own group's name.
    several = groups.where(F.col(row) != F.col("group")).select("group").distinct()
    members = groups.join(several, "group", "left_semi").join(docs.select(row, F.col(id_col).alias("id")), row)
    members = materialize(members.select(row, "group", F.struct(F.col("id").isNull().alias("none"), "id", F.col(row).alias("row")).alias("place")), "members")
    first = members.groupBy("group").agg(F.min("place").alias("first")).select("group", F.col("first.row").alias("stays"))
    gone = members.join(first, "group").where(F.col(row) != F.col("stays")).select(row)
    return docs.join(gone, row, "left_anti").select(*[c for c in docs.columns if c != row])


def _fingerprint(raw: bytes) -> bytes:
    import hashlib

    return hashlib.md5(raw, usedforsecurity=False).digest()


def _block(held: list[tuple]) -> pa.RecordBatch:
    """One row of many texts, named by their classes."""
    rep, print_, copies, text = zip(*held, strict=True)
    return pa.RecordBatch.from_pydict({"block": [_fingerprint(b"".join(print_))], "rep": [list(rep)], "copies": [list(copies)], "text": [list(text)]})


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Runs of rows with equal first ``keys`` columns, from batches sorted by them."""
    now, held = None, None
    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        for row, key in enumerate(zip(*cols[:keys], strict=True)):
            if key != now:
                if held:
                    yield now, held
                now, held = key, [[] for _ in cols[keys:]]
            for x, c in zip(held, cols[keys:], strict=True):
                x.append(c[row])
    if held:
        yield now, held
