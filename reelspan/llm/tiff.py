"""TIFF files as rows: image directories, strips and tiles, PackBits, LZW and deflate, predictors.

``decode_pages`` walks the directories of each file and emits one row per page. ``encode_pages``
stores bytes losslessly as 8-bit grey pages, so that decoding can be tried on any table.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.llm.common import keyed_text, map_arrow, slices

#: Fixed values of the format: field type -> bytes, the tags that are read, compression numbers.
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}

#: Width of an encoded page, rows of a page and of a strip at most, and edge of a tile.
PAGE_WIDTH, PAGE_ROWS, STRIP_ROWS, TILE = 64, 512, 128, 64
#: Bytes of the samples of one page at most; a larger one is reported and not decoded.
MOST_PAGE_BYTES = 256 << 20
#: What a compressed byte can stand for at most, by compression.
_MOST_GROWTH = {NONE: 1, PACKBITS: 64, LZW: 4096, DEFLATE: 1040, OLD_DEFLATE: 1040}
_RUN = re.compile(rb"(.)\1{2,127}", re.S)


def packbits_decode(data: bytes, most: int = MOST_PAGE_BYTES) -> bytes:
    """Undoes PackBits run-length coding; stops when it has ``most`` bytes."""
    out, i, n, made = [], 0, len(data), 0
    while i < n and made < most:
        head = data[i]
        if head < 128:
            out.append(data[i + 1 : i + 2 + head])
            i, made = i + 2 + head, made + 1 + head
        elif head > 128:
            out.append(data[i + 1 : i + 2] * (257 - head))
            i, made = i + 2, made + 257 - head
        else:
            i += 1
    return b"".join(out)


def packbits_encode(data: bytes) -> bytes:
    """PackBits: runs of 3 or more bytes as runs, the rest as literals of at most 128 bytes."""
    out, done = [], 0

    def literal(end: int) -> None:
        for i in range(done, end, 128):
            part = data[i : min(i + 128, end)]
            out.append(bytes([len(part) - 1]) + part)

    for m in _RUN.finditer(data):
        literal(m.start())
        out.append(bytes([257 - (m.end() - m.start())]) + m[1])
        done = m.end()
    literal(len(data))
    return b"".join(out)


#: Codes of LZW in this format.
CLEAR, END, FIRST, LAST = 256, 257, 258, 4094


def lzw_decode(data: bytes, most: int = MOST_PAGE_BYTES) -> bytes:
    """Undoes LZW with codes of 9 to 12 bits, high bits first, widened one code early; stops when it has
    ``most`` bytes. A table that is full stays as it is until it is cleared."""
    made = 0
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, before = list(base), [], b""
    width, held, bits = 9, 0, 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == CLEAR:
            table, width, before = list(base), 9, b""
            continue
        if code == END:
            break
        if not before:
            word = table[code]
        else:
            if code < len(table):
                word = table[code]
            elif code == len(table):
                word = before + before[:1]
            else:
                raise ValueError("LZW code beyond the table")
            size = len(table) + 1
            if size <= 4096:
                table.append(before + word[:1])
            if size == 511 or size == 1023 or size == 2047:
                width += 1
        out.append(word)
        before, made = word, made + len(word)
        if made >= most:
            break
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, high bits first, widened one code early."""
    start = {bytes([i]): i for i in range(256)}
    table, size, width = dict(start), FIRST, 9
    held, bits, out = CLEAR, 9, bytearray()
    word = b""
    for i in range(len(data)):
        grown = word + data[i : i + 1]
        if grown in table:
            word = grown
            continue
        held, bits = held << width | table[word], bits + width
        table[grown] = size
        size += 1
        if size == 512 or size == 1024 or size == 2048:
            width += 1
        elif size > LAST:
            held, bits = held << width | CLEAR, bits + width
            table, size, width = dict(start), FIRST, 9
        word = data[i : i + 1]
        if bits > 512:
            rest = bits & 7
            out += (held >> rest).to_bytes((bits - rest) >> 3, "big")
            held, bits = held & ((1 << rest) - 1), rest
    if word:
        held, bits = held << width | table[word], bits + width
        size += 1
        if size == 512 or size == 1024 or size == 2048:
            width += 1
    held, bits = held << width | END, bits + width
    pad = -bits % 8
    return bytes(out) + (held << pad).to_bytes((bits + pad) >> 3, "big")


def unpack(data: bytes, compression: int, most: int = MOST_PAGE_BYTES) -> bytes:
    """Decodes a strip or tile, of which no more than ``most`` bytes are wanted."""
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return packbits_decode(data, most)
    if compression == LZW:
        return lzw_decode(data, most)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, most)
    raise ValueError(f"compression {compression} isn't supported")


def directories(data: bytes) -> Iterator[dict[int, tuple]]:
    """The tags of each image directory, in the order of the chain; a chain that loops ends."""
    if data[:4] == b"II*\0":
        e = "<"
    elif data[:4] == b"MM\0*":
        e = ">"
    else:
        raise ValueError("no TIFF header")
    at, seen = struct.unpack_from(e + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        (count,) = struct.unpack_from(e + "H", data, at)
        tags = {}
        for i in range(count):
            tag, kind, n = struct.unpack_from(e + "HHI", data, at + 2 + 12 * i)
            size = TYPE_BYTES.get(kind, 0) * n
            place = at + 10 + 12 * i
            if size > 4:
                (place,) = struct.unpack_from(e + "I", data, place)
            if kind in (1, 3, 4):
                tags[tag] = struct.unpack_from(f"{e}{n}{'?B?HI'[kind]}", data, place)
        yield tags
        (at,) = struct.unpack_from(e + "I", data, at + 2 + 12 * count)


def undone(block: np.ndarray, predictor: int, big: bool) -> np.ndarray:
    """A block (rows x columns x samples) without its predictor: differences of neighbours in a row (2),
    or of the bytes of floats, which are stored most significant ones first (3)."""
    if predictor == 2:
        return np.cumsum(block, axis=1, dtype=block.dtype.newbyteorder("="))
    if predictor == 3:
        rows, columns, deep = block.shape
        flat = np.ascontiguousarray(block).view("u1").reshape(rows, -1, deep)
        flat = np.cumsum(flat, axis=1, dtype="u1").reshape(rows, block.dtype.itemsize, columns * deep)
        return np.ascontiguousarray(flat.transpose(0, 2, 1)).view(">f4").reshape(rows, columns, deep)
    return block


def page_samples(data: bytes, tags: dict[int, tuple], big: bool, most: int = MOST_PAGE_BYTES) -> np.ndarray:
    """The samples of a page as rows x columns x samples, from strips or tiles. Samples of 1, 2 or 4
    bits come as bytes. Whatever the header claims, no more is held than ``most`` bytes, and nothing
    where the stored bytes are too few for it."""
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    bits, floats = set(tags.get(BITS, (1,))), one(FORMAT, 1) == 3
    if len(bits) != 1 or not bits <= ({32} if floats else {1, 2, 4, 8, 16, 32}):
        raise ValueError(f"{sorted(bits)} bits a sample aren't supported")
    (depth,) = bits
    kind = np.dtype("u1" if depth <= 8 else f"{'>' if big else '<'}{'f' if floats else 'u'}{depth // 8}")
    planes = samples if one(PLANAR, 1) == 2 else 1
    deep = 1 if planes > 1 else samples
    compression, predictor = one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if compression not in _MOST_GROWTH:
        raise ValueError(f"compression {compression} isn't supported")
    if predictor not in (1, 2, 3) or predictor == 2 and (depth < 8 or floats) or predictor == 3 and not floats:
        raise ValueError(f"predictor {predictor} isn't supported for these samples")
    tiled = TILE_OFFSETS in tags
    block_w = one(TILE_WIDTH) if tiled else width
    block_h = one(TILE_HEIGHT) if tiled else min(one(ROWS_PER_STRIP, height), height)
    if min(width, height, samples, block_w, block_h) < 1:
        raise ValueError("a page, strip or tile without samples")
    row_bytes = -(-block_w * deep * depth // 8)
    if max(height * width * samples * kind.itemsize, row_bytes * block_h) > most:
        raise ValueError(f"a page of {width} x {height} x {samples} samples is larger than {most} bytes")
    offsets, sizes = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_BYTES])
    across, down = -(-width // block_w), -(-height // block_h)
    if len(offsets) != len(sizes) or len(offsets) != across * down * planes:
        raise ValueError(f"{len(offsets)} offsets and {len(sizes)} sizes for {across * down * planes} strips or tiles")
    rows_of = lambda i: block_h if tiled else min(block_h, height - i % (across * down) // across * block_h)
    for i, (offset, size) in enumerate(zip(offsets, sizes, strict=True)):
        if max(0, min(size, len(data) - offset)) * _MOST_GROWTH[compression] < rows_of(i) * row_bytes:
            raise ValueError(f"strip or tile {i} holds too few bytes")
    out = np.zeros((height, width, samples), dtype=kind.newbyteorder("="))
    for i, (offset, size) in enumerate(zip(offsets, sizes, strict=True)):
        plane, k = divmod(i, across * down)
        top, left = k // across * block_h, k % across * block_w
        rows = rows_of(i)
        raw = np.frombuffer(unpack(data[offset : offset + size], compression, rows * row_bytes), dtype="u1", count=rows * row_bytes)
        if depth < 8:
            each = np.unpackbits(raw.reshape(rows, row_bytes), axis=1).reshape(rows, -1, depth)[:, : block_w * deep]
            block = np.dot(each, 1 << np.arange(depth)[::-1]).astype("u1").reshape(rows, block_w, deep)
        else:
            block = undone(raw.view(kind).reshape(rows, block_w, deep), predictor, big)
        rows, columns = min(rows, height - top), min(block_w, width - left)
        target = out[top : top + rows, left : left + columns]
        if planes > 1:
            target[:, :, plane] = block[:rows, :columns, 0]
        else:
            target[:] = block[:rows, :columns]
    return out


def pages(data: bytes) -> Iterator[tuple[int, dict, np.ndarray]]:
    """(page number, tags, samples) of each page of a file."""
    for number, tags in enumerate(directories(data)):
        yield number, tags, page_samples(data, tags, data[:1] == b"M")


def write_tiff(images: list[tuple[np.ndarray, int, int, bool]]) -> bytes:
    """A little-endian file of 8-bit grey pages: (rows x columns, compression, predictor, tiled)."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for image, compression, predictor, tiled in images:
        height, width = image.shape
        blocks = []
        if tiled:
            padded = np.zeros((-(-height // TILE) * TILE, -(-width // TILE) * TILE), dtype="u1")
            padded[:height, :width] = image
            blocks = [padded[y : y + TILE, x : x + TILE] for y in range(0, height, TILE) for x in range(0, width, TILE)]
        else:
            blocks = [image[y : y + STRIP_ROWS] for y in range(0, height, STRIP_ROWS)]
        places = []
        for block in blocks:
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.zeros((len(block), 1), dtype="u1"))
            raw = block.tobytes()
            data = zlib.compress(raw, 6) if compression == DEFLATE else lzw_encode(raw) if compression == LZW else packbits_encode(raw) if compression == PACKBITS else raw
            places.append((len(out), len(data)))
            out += data + b"\0" * (len(data) % 2)
        offsets, sizes = [p[0] for p in places], [p[1] for p in places]
        tags = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor])]
        tags += [(TILE_WIDTH, 3, [TILE]), (TILE_HEIGHT, 3, [TILE]), (TILE_OFFSETS, 4, offsets), (TILE_BYTES, 4, sizes)] if tiled else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [STRIP_ROWS]), (STRIP_BYTES, 4, sizes)]
        fields = []
        for tag, kind, values in sorted(tags):
            packed = struct.pack(f"<{len(values)}{'?B?HI'[kind]}", *values)
            if len(packed) > 4:
                place = struct.pack("<I", len(out))
                out += packed + b"\0" * (len(packed) % 2)
            else:
                place = packed.ljust(4, b"\0")
            fields.append(struct.pack("<HHI", tag, kind, len(values)) + place)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + b"".join(fields)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def payload_of(text: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of 64."""
    return text.ljust(max(64, -(-len(text) // 64) * 64), b"\0")


def store(payload: bytes) -> bytes:
    """A payload as a TIFF file of 64 samples a row, in pages of at most 512 rows. Compression,
    predictor and layout of a page follow from the payload's checksum and the page number, so
    equal payloads give equal files and all decoders are used."""
    grid = np.frombuffer(payload, dtype="u1").reshape(-1, PAGE_WIDTH)
    turn, images = zlib.crc32(payload), []
    for page, top in enumerate(range(0, len(grid), PAGE_ROWS)):
        compression, predictor = ((DEFLATE, 2), (PACKBITS, 1), (LZW, 1 + (turn >> 9 & 1)), (DEFLATE, 1), (PACKBITS, 1), (DEFLATE, 2))[(turn + page) % 6]
        images.append((grid[top : top + PAGE_ROWS], compression, predictor, bool((turn >> 8) + page & 1)))
    return write_tiff(images)


def encode_pages(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes (of the text, null as empty) and media (its TIFF file), one row for each row."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch):
                bodies = piece.column(1).cast(pa.binary()).to_pylist()
                media = [store(payload_of(b)) for b in bodies]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([len(b) for b in bodies], pa.int64()), pa.array(media, pa.binary())], names=["key", "n_bytes", "media"])

    return map_arrow(keyed_text(df, key, text), run, "key long, n_bytes long, media binary").withColumnRenamed("key", key)


#: What a file that isn't sound may raise.
BROKEN = (ValueError, KeyError, IndexError, TypeError, OverflowError, MemoryError, struct.error, zlib.error)
PAGES = "page int, n_pages int, width int, height int, samples_per_pixel int, bits int, compression string, predictor int, tiled boolean, mean double, error string, samples binary, media_bytes long, media_sha256 string"


def decode_pages(df: DataFrame, key: str = "doc_id", media: str = "media", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per page of each file: key, the ``carry`` columns, page (from 0), n_pages, width,
    height, samples_per_pixel, bits, compression, predictor, tiled, mean of the samples, error,
    samples (rows, then columns, then channels; native bytes), media_bytes and media_sha256.

    A null or empty file, and one whose chain of directories can't be read, gives one row with page
    null and the reason in ``error``; a page that can't be decoded (broken, larger than
    MOST_PAGE_BYTES, or of a kind that isn't supported, as JPEG or fax pages) gives a row with its
    number and the reason, and no samples. Repeated rows give repeated pages; other columns are not
    read, and those of ``carry`` may have any name but the key's. Pages of a file follow each other in
    order within their partition. Memory: one file and one decoded page at a time.
    """
    clash = {c.split()[0] for c in PAGES.split(", ")} & set(carry)
    if clash:
        raise ValueError(f"rename {sorted(clash)} before carrying them: the result has columns of these names")
    picked = df.select(F.col(key).alias("key"), F.col(media).cast("binary").alias("media"), *(F.col(c) for c in carry))
    kinds = {f.name: f.dataType.simpleString() for f in picked.schema}
    extra = "".join(f"{c} {kinds[c]}, " for c in carry)

    def run(batches):
        for batch in batches:
            schema = batch.schema
            for i in range(batch.num_rows):
                head = batch.slice(i, 1)
                data = head.column(1)[0].as_py() or b""
                digest = hashlib.sha256(data).hexdigest()
                try:
                    listed = list(directories(data))
                    if not listed:
                        raise ValueError("no image directory")
                except BROKEN as problem:
                    yield row(head, schema, (*[None] * 10, reason(problem), None, len(data), digest))
                    continue
                for number, tags in enumerate(listed):
                    one = lambda tag, default: int(tags[tag][0]) if tags.get(tag) else default  # noqa: B023, E731
                    facts = (number, len(listed), one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(BITS, 1), NAMES.get(one(COMPRESSION, 1), str(one(COMPRESSION, 1))), one(PREDICTOR, 1), TILE_OFFSETS in tags)
                    try:
                        samples = page_samples(data, tags, data[:1] == b"M")
                        yield row(head, schema, (*facts, float(samples.mean(dtype=np.float64)), None, samples.tobytes(), len(data), digest))
                    except BROKEN as problem:
                        yield row(head, schema, (*(x if not isinstance(x, int) or x < 1 << 31 else None for x in facts), None, reason(problem), None, len(data), digest))

    def reason(problem: Exception) -> str:
        return f"{type(problem).__name__}: {problem}"[:200]

    def row(head: pa.RecordBatch, schema: pa.Schema, values: tuple) -> pa.RecordBatch:
        types = [pa.int32()] * 6 + [pa.string(), pa.int32(), pa.bool_(), pa.float64(), pa.string(), pa.binary(), pa.int64(), pa.string()]
        names = [c.split()[0] for c in PAGES.split(", ")]
        return pa.RecordBatch.from_arrays([head.column(0), *(head.column(2 + i) for i in range(len(carry))), *(pa.array([v], t) for v, t in zip(values, types, strict=True))], names=[schema.names[0], *carry, *names])

    return map_arrow(picked, run, f"key {kinds['key']}, {extra}{PAGES}").withColumnRenamed("key", key)


def page_digests(decoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each decoded file: payload_bytes, payload_sha256, tail_crc32 (last 64 bytes),
    media_bytes, media_sha256 and feature (layout of the pages and mean of all samples).

    ``decoded`` is what ``decode_pages`` gave, with ``n_bytes`` carried; the pages of a file follow
    each other there, so the digest is taken in one pass without a shuffle."""

    def run(batches):
        state = None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["error"] is not None:
                    raise ValueError(f"a stored page can't be read: {r['error']}")
                if r["page"] == 0:
                    state = [hashlib.sha256(), 0, b"", 0.0, []]
                data = r["samples"]
                state[0].update(data)
                state[1] += len(data)
                state[2] = (state[2] + data)[-64:]
                state[3] += r["mean"] * len(data)
                state[4].append(f"{r['width']}x{r['height']}:{r['compression']}:{r['predictor']}:{'tile' if r['tiled'] else 'strip'}")
                if r["page"] == r["n_pages"] - 1:
                    rows.append((r["key"], r["n_bytes"], state[1], state[0].hexdigest(), zlib.crc32(state[2]), r["media_bytes"], r["media_sha256"], f"mean={state[3] / state[1]:.4f};" + ",".join(state[4])))
            if rows:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                names = ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    picked = decoded.select(F.col(key).alias("key"), "n_bytes", "page", "n_pages", "width", "height", "compression", "predictor", "tiled", "mean", "error", "samples", "media_bytes", "media_sha256")
    return map_arrow(picked, run, "key long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("key", key)
