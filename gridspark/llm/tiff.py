"""TIFF columns: a writer for payloads and a reader that walks image directories.

The reader takes both byte orders, strips and tiles, chunky and planar samples, no compression,
PackBits, LZW and deflate, and the horizontal predictor, for samples of 8 bits (others are refused).
It emits one row per page; a damaged page costs itself alone, not the others of its file.

The writer lays a page out as the page's digest says: codec, predictor, strips or tiles, chunky or
planar.  So every way of storing carries its share of all bytes, whatever the sizes of the texts.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import packed

NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
WIDTH, SAMPLES = 64, 3
ROW = WIDTH * SAMPLES
#: Rows of a page at most, and of a strip; width of a tile and its height at most (a multiple of 16, no more than the page asks for).
PAGE_ROWS, STRIP_ROWS = 4096, 256
TILE = (32, 64)
#: Bytes of a page that the reader unpacks at most; a larger page is an error row.
MOST_PAGE = 1 << 28
#: Bytes of each field type.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
PAGE = "page int, n_pages int, width int, height int, samples int, compression int, predictor int, pixels binary, error string"
_BROKEN = (ValueError, KeyError, IndexError, OverflowError, struct.error, zlib.error)


# --- codecs ---------------------------------------------------------------------------------------


def packbits_encode(raw: bytes, row: int = ROW) -> bytes:
    """Runs of three or more equal bytes, and the bytes between them; nothing reaches over a row's end."""
    px = np.frombuffer(raw, dtype=np.uint8)
    if not len(px):
        return b""
    new = np.ones(len(px), dtype=bool)
    new[1:] = px[1:] != px[:-1]
    new[::row] = True
    start = np.flatnonzero(new)
    long = np.diff(np.append(start, len(px))) > 2
    head = np.ones(len(start), dtype=bool)
    head[1:] = long[1:] | long[:-1] | (start[1:] % row == 0)
    out = []
    for a, b, run in zip(start[head].tolist(), [*start[head][1:].tolist(), len(raw)], long[head].tolist(), strict=True):
        for i in range(a, b, 128):
            n = min(128, b - i)
            out.append(bytes((257 - n, raw[i])) if run and n > 1 else bytes((n - 1,)) + raw[i : i + n])
    return b"".join(out)


def packbits_decode(raw: bytes, most: int = MOST_PAGE) -> bytes:
    out, size, i = [], 0, 0
    while i < len(raw) and size < most:
        n = raw[i]
        if n < 128:
            out.append(raw[i + 1 : i + 2 + n])
            i += 2 + n
        elif n > 128:
            out.append(raw[i + 1 : i + 2] * (257 - n))
            i += 2
        else:
            i += 1
            continue
        size += len(out[-1])
    return b"".join(out)


_CLEAR, _END, _FULL = 256, 257, 4094
#: Width of the n-th code after a clear code (growing one code early, as TIFF has it), and the bit at which it begins.
_CODE_BITS = np.array([9 if n < 511 else 10 if n < 1023 else 11 if n < 2047 else 12 for n in range(258, 4096)])
_CODE_AT = np.concatenate([[0], np.cumsum(_CODE_BITS)[:-1]])


def lzw_encode(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first, from a clear code to an end code."""
    codes, cleared = [_CLEAR], [0]
    put = codes.append
    longer: list[dict[int, int] | None] = [None] * 4096  # of each code: the codes of its word and one more byte
    size, word = 258, -1
    for c in raw:
        known = longer[word]
        if known is None:
            if word >= 0:
                longer[word] = {c: size}
            else:
                word = c
                continue
        elif c in known:
            word = known[c]
            continue
        else:
            known[c] = size
        put(word)
        word = c
        size += 1
        if size == _FULL:
            cleared.append(len(codes))
            put(_CLEAR)
            longer, size = [None] * 4096, 258
    if word >= 0:
        put(word)
    put(_END)
    # Each code's place since the last clear code gives its width; of its 12 bits the last ``width`` are written.
    limits = np.array([0, *(x + 1 for x in cleared), len(codes)])
    width = _CODE_BITS[np.arange(len(codes)) - np.repeat(limits[:-1], np.diff(limits))]
    bits = np.array(codes, dtype=np.uint16)[:, None] >> np.arange(11, -1, -1, dtype=np.uint16) & 1
    return np.packbits(bits[np.arange(12) >= 12 - width[:, None]].astype(np.uint8)).tobytes()


def lzw_decode(raw: bytes, most: int = MOST_PAGE) -> bytes:
    """Codes are cut out of the bits from one clear code to the next at once.

    The word of an entry is what its code wrote and the byte after it, so the output is the table:
    each code points at an earlier one, each byte at an earlier byte, and doubling steps lead from
    there to the letters.
    """
    data = np.frombuffer(raw + b"\0\0\0", dtype=np.uint8).astype(np.int32)
    out, size, begin, bits = [], 0, 0, 8 * len(raw)
    while size < most:
        some = min(len(_CODE_BITS), (bits - begin) // 9 + 1)
        at = begin + _CODE_AT[:some]
        n = int(np.searchsorted(at + _CODE_BITS[:some], bits, side="right"))
        at, width = at[:n], _CODE_BITS[:n]
        byte = at >> 3
        codes = ((data[byte] << 16 | data[byte + 1] << 8 | data[byte + 2]) >> (24 - width - (at & 7))) & (1 << width) - 1
        stops = np.flatnonzero((codes == _CLEAR) | (codes == _END))
        stop = int(stops[0]) if len(stops) else n
        if stop:
            out.append(_words(codes[:stop], most - size))
            size += len(out[-1])
        if stop == n:
            if n == len(_CODE_BITS):
                raise ValueError("LZW table overflows")
            break
        if codes[stop] == _END:
            break
        begin = int(at[stop] + width[stop])
    return b"".join(out)


def _words(codes: np.ndarray, most: int) -> bytes:
    """What the codes after a clear code write; not much beyond ``most`` bytes."""
    k = np.arange(len(codes), dtype=np.int32)
    if (codes > 257 + k).any():
        raise ValueError("LZW code out of order")
    above = np.where(codes < 256, k, codes - 258)  # the code that wrote all but the last byte
    length, up = (codes >= 256).astype(np.int32), above
    while True:  # steps up to a letter
        if (up == up[up]).all() and not length[up].any():
            break
        length, up = length + np.where(up == k, 0, length[up]), up[up]
    length += 1
    ends = np.cumsum(length, dtype=np.int64)
    if ends[-1] > most:
        codes, above, length, ends = (x[: int(np.searchsorted(ends, most)) + 1] for x in (codes, above, length, ends))
    start = (ends - length).astype(np.int32)
    owner = np.repeat(k[: len(codes)], length)
    here = np.arange(int(ends[-1]), dtype=np.int32)
    source = np.where(codes[owner] < 256, here, here - start[owner] + start[above[owner]])
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    return codes[owner[source]].astype(np.uint8).tobytes()


def unpack(raw: bytes, compression: int, most: int) -> bytes:
    """The bytes of a strip or tile, of which ``most`` are wanted; what a block holds beyond them is left."""
    if compression == NONE:
        return raw
    if compression == PACKBITS:
        return packbits_decode(raw, most)
    if compression == LZW:
        return lzw_decode(raw, most)
    if compression in (DEFLATE, 32946):
        return zlib.decompressobj().decompress(raw, most)
    raise ValueError(f"compression {compression}")


# --- writing ---------------------------------------------------------------------------------------


def choice(page: bytes) -> tuple[int, int, bool, int]:
    """Compression, predictor, whether in tiles, and planar configuration, from the digest of the page.

    Each codec takes a third of the pages, tiles a half, the predictor and planar samples a quarter each.
    """
    d = int.from_bytes(hashlib.sha256(page).digest()[:4], "big")
    return (PACKBITS, LZW, DEFLATE)[d % 3], 2 if d // 3 % 4 == 0 else 1, bool(d // 12 % 2), 2 if d // 24 % 4 == 0 else 1


def write(payload: bytes, choose: Callable[[bytes], tuple[int, int, bool, int]] = choice, order: str = "<") -> bytes:
    """Pages of 64 RGB pixels a row that hold the payload (a positive multiple of 192 bytes); ``order``: of bytes."""
    pages = [payload[i : i + PAGE_ROWS * ROW] for i in range(0, len(payload), PAGE_ROWS * ROW)]
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        rows = len(page) // ROW
        compression, predictor, tiled, planar = choose(page)
        px = np.frombuffer(page, dtype=np.uint8).reshape(rows, WIDTH, SAMPLES)
        bw, bh = (TILE[0], min(TILE[1], rows + -rows % 16)) if tiled else (WIDTH, STRIP_ROWS)
        if tiled:
            px = np.concatenate([px, np.zeros((-rows % bh, WIDTH, SAMPLES), np.uint8)])
        places, sizes = [], []
        for plane in [px] if planar == 1 else [px[:, :, k : k + 1] for k in range(SAMPLES)]:
            for y in range(0, len(px), bh):
                for x in range(0, WIDTH, bw):
                    block = plane[y : y + bh, x : x + bw]
                    if predictor == 2:
                        block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
                    raw = block.tobytes()
                    raw = zlib.compress(raw, 6) if compression == DEFLATE else lzw_encode(raw) if compression == LZW else packbits_encode(raw, bw * block.shape[2]) if compression == PACKBITS else raw
                    places.append(len(out))
                    sizes.append(len(raw))
                    out += raw
        out += b"\0" * (len(out) % 2)
        blocks = {322: (4, [bw]), 323: (4, [bh]), 324: (4, places), 325: (4, sizes)} if tiled else {273: (4, places), 278: (4, [bh]), 279: (4, sizes)}
        fields = {256: (4, [WIDTH]), 257: (4, [rows]), 258: (3, [8] * SAMPLES), 259: (3, [compression]), 262: (3, [2]), 277: (3, [SAMPLES]), 284: (3, [planar]), 317: (3, [predictor]), **blocks}
        entries = b""
        for tag, (kind, values) in sorted(fields.items()):
            raw = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(raw) > 4:
                raw, at = struct.pack(order + "I", len(out)), raw
                out += at + b"\0" * (len(at) % 2)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        out[link : link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


# --- reading ---------------------------------------------------------------------------------------


def directories(raw: bytes) -> list[dict[int, list[int]]]:
    """The fields of each image directory, in the order of their links."""
    return list(walk(raw))


def walk(raw: bytes) -> Iterator[dict[int, list[int]]]:
    """``directories`` one by one, as far as they can be read; a loop of links is an error."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or len(raw) < 8 or struct.unpack(order + "H", raw[2:4])[0] != 42:
        raise ValueError("not a TIFF")
    at, seen = struct.unpack(order + "I", raw[4:8])[0], set()
    while at:
        if at in seen:
            raise ValueError("directories in a loop")
        seen.add(at)
        n = struct.unpack_from(order + "H", raw, at)[0]
        fields: dict[int, list[int]] = {}
        for k in range(n):
            place = at + 2 + 12 * k
            tag, kind, count = struct.unpack_from(order + "HHI", raw, place)
            if kind in (1, 3, 4) and _SIZES[kind] * count <= len(raw):
                if _SIZES[kind] * count > 4:
                    place = struct.unpack_from(order + "I", raw, place + 8)[0] - 8
                fields[tag] = list(struct.unpack_from(f"{order}{count}{'B?HI'[kind - 1]}", raw, place + 8))
        yield fields
        at = struct.unpack_from(order + "I", raw, at + 2 + 12 * n)[0]


def pixels(raw: bytes, fields: dict[int, list[int]]) -> np.ndarray:
    """height x width x samples of one page."""
    w, h = fields[256][0], fields[257][0]
    spp, planar = fields.get(277, [1])[0], fields.get(284, [1])[0]
    compression, predictor = fields.get(259, [1])[0], fields.get(317, [1])[0]
    if any(b != 8 for b in fields.get(258, [8])) or predictor not in (1, 2):
        raise ValueError("samples of 8 bits and predictors 1 and 2 only")
    tiled = 322 in fields
    bw, bh = (fields[322][0], fields[323][0]) if tiled else (w, min(h, fields.get(278, [h])[0]))
    if min(w, h, spp, bw, bh) < 1 or planar not in (1, 2):
        raise ValueError("a page without pixels")
    if max(w * h, bw * bh) * spp > MOST_PAGE:
        raise ValueError(f"a page of more than {MOST_PAGE} bytes")
    places, sizes = (fields[324], fields[325]) if tiled else (fields[273], fields[279])
    across, down = -(-w // bw), -(-h // bh)
    if len(places) != across * down * (1 if planar == 1 else spp):
        raise ValueError("strips or tiles are missing")
    out = np.zeros((h, w, spp), dtype=np.uint8)
    own = spp if planar == 1 else 1
    for k, (a, n) in enumerate(zip(places, sizes, strict=True)):
        plane, rest = divmod(k, across * down)
        y, x = rest // across * bh, rest % across * bw
        rows = bh if tiled else min(bh, h - y)
        part = unpack(raw[a : a + n], compression, rows * bw * own)
        block = np.frombuffer(part, dtype=np.uint8, count=rows * bw * own).reshape(rows, bw, own)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        block = block[: h - y, : w - x]
        if planar == 1:
            out[y : y + block.shape[0], x : x + block.shape[1]] = block
        else:
            out[y : y + block.shape[0], x : x + block.shape[1], plane] = block[..., 0]
    return out


def read(raw: bytes | None) -> list[tuple]:
    """The ``PAGE`` rows of one file."""
    found, broken = [], None
    try:
        for fields in walk(raw or b""):
            found.append(fields)
    except _BROKEN as e:
        broken = str(e) or type(e).__name__
    if not found:
        return [(None,) * 8 + (broken or "no page",)]
    n, rows = len(found) + (broken is not None), []
    for k, f in enumerate(found):
        try:
            px = pixels(raw, f)
            rows.append((k, n, px.shape[1], px.shape[0], px.shape[2], f.get(259, [1])[0], f.get(317, [1])[0], px.tobytes(), None))
        except _BROKEN as e:
            rows.append((k, n, *(None,) * 6, str(e) or type(e).__name__))
    return rows + ([(n - 1, n, *(None,) * 6, broken)] if broken else [])


def pages(media: DataFrame, media_col: str = "media") -> DataFrame:
    """The other columns of ``media`` and ``PAGE``, one row a page, in order.

    A null or empty file, or one without any directory, gives one row with null page columns and its
    ``error``.  A damaged page gives a row with its number and ``error`` and no pixels; where the
    links to further pages are damaged, one such row stands for them.  Repeated rows give repeated
    pages.  Columns of the names of ``PAGE`` must not be among the others.
    """
    others = [c for c in media.columns if c != media_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32()] * 7 + [pa.binary(), pa.string()]
        for b in batches:
            for i in range(b.num_rows):
                rows = read(b.column(len(others))[i].as_py())
                kept = [c.take(pa.array([i] * len(rows), pa.int64())) for c in b.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], [*others, *(x.split()[0] for x in PAGE.split(", "))])

    kinds = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in others)
    return packed(media.select(*others, media_col), run, f"{kinds}, {PAGE}")


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, media_bytes, media_sha256, media``: each whole text as a TIFF.

    The payload is the UTF-8 text (null: empty) filled with spaces to a positive multiple of 192.
    Repeated rows are stored each; a text of any length makes as many pages as it needs.  Other
    columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text = (b.column(1)[i].as_py() or "").encode()
                media = write(text.ljust(max(1, -(-len(text) // ROW)) * ROW))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([len(text)]), pa.array([len(media)]), pa.array([hashlib.sha256(media).hexdigest()]), pa.array([media], pa.binary())], ["id", "n_bytes", "media_bytes", "media_sha256", "media"])

    return packed(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, n_bytes bigint, media_bytes bigint, media_sha256 string, media binary")


def digests(read: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What ``pages`` read back, one row a file: digests of the payload and a histogram of its samples.

    ``feature``: 16 hexadecimal digits, the share of samples in each sixteenth of the range,
    rounded to fifteenths.  A file of which any page is damaged has null digests.  Equal texts,
    equal rows but for the id; repeated rows stay repeated.  Other columns are not read.
    """
    kind = read.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, n, tail, hist, whole = hashlib.sha256(), 0, b"", np.zeros(16, dtype=np.int64), True
        for b in batches:
            at, out = [], []
            for i, (page, of, px) in enumerate(zip(*(b.column(k).to_pylist() for k in (4, 5, 6)), strict=True)):
                if not page:
                    sha, n, tail, hist, whole = hashlib.sha256(), 0, b"", np.zeros(16, dtype=np.int64), True
                if px is None:
                    whole = False
                else:
                    sha.update(px)
                    n, tail = n + len(px), (tail + px)[-16:]
                    hist += np.bincount(np.frombuffer(px, dtype=np.uint8) >> 4, minlength=16)
                if page is None or page == of - 1:
                    at.append(i)
                    out.append((n, sha.hexdigest(), zlib.crc32(tail), "".join(f"{int(x):x}" for x in np.rint(15 * hist / max(n, 1)))) if whole else (None,) * 4)
            cols = list(zip(*out, strict=True)) or [[]] * 4
            kept = [c.take(pa.array(at, pa.int64())) for c in b.columns[:4]]
            yield pa.RecordBatch.from_arrays([*kept[:2], *(pa.array(c, t) for c, t in zip(cols[:3], (pa.int64(), pa.string(), pa.int64()), strict=True)), *kept[2:], pa.array(cols[3], pa.string())], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    rows = read.select(id_col, "n_bytes", "media_bytes", "media_sha256", "page", "n_pages", "pixels")
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
