"""Token ids in patched frame-of-reference blocks, as files in the order of document ids.

A block holds up to 1024 ids: their minimum, the differences from it packed at the width of a
percentile of the block (of some stated percentiles the one that makes the block smallest), and a list
of exceptions, position and difference, for those that are wider. A file is a run of blocks, then an
index of the places where blocks start and a directory of its documents; ``_index.json`` of a folder
lists the files in order with the ids before each. Files are written by one task each under a name
of their own and count only once the index names them, so tasks may fail and run again.

``token_blocks`` is a Spark data source: it writes (doc_id long, ids binary), or with option ``tokenizer`` (doc_id long,
text string), which the writing task encodes, and reads back
(doc_id, start, n_tokens, ids_crc32), with option ``ids`` set to ``true`` the ids too. Ids in columns are
little-endian unsigned 32-bit integers. Tasks read stretches of a file by the index of block starts.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from reelspan.llm.common import Scratch, bound_batches, keyed_text, slices, tidied

MAGIC = b"PFORIDS1"
#: Ids of a block; percentiles of its widths that are tried; bits of an exception.
BLOCK, PERCENTILES, EXCEPTION_BITS = 1024, (50, 75, 90, 95, 99, 100), 48
#: Ids that a task packs at once, after which a file is closed, and of a stretch that one task reads.
PACK_IDS, FILE_IDS, READ_IDS = 64 * BLOCK, 1 << 27, 1 << 23
END_ID = 1
HEAD, TAIL = struct.Struct("<IHBH"), struct.Struct("<QQQ8s")
_POWERS = (1 << np.arange(32, dtype=np.uint64)).astype(np.uint32)
INDEX = "_index.json"


def pack(ids: np.ndarray) -> list[bytes]:
    """The blocks of some ids (uint32), each of BLOCK ids but for the last."""
    whole = len(ids) // BLOCK * BLOCK
    parts = ([ids[:whole].reshape(-1, BLOCK)] if whole else []) + ([ids[whole:].reshape(1, -1)] if whole < len(ids) else [])
    return [block for part in parts for block in _pack_even(part)]


def _pack_even(grid: np.ndarray) -> list[bytes]:
    """The blocks of rows of equal length."""
    rows, n = grid.shape
    low = grid.min(axis=1)
    rest = grid - low[:, None]
    width = np.searchsorted(_POWERS, rest.ravel(), side="right").reshape(rows, n)  # bits that each difference takes
    within = np.bincount((np.arange(rows)[:, None] * 33 + width).ravel(), minlength=rows * 33).reshape(rows, 33).cumsum(axis=1)
    tried = np.stack([(within >= -(-n * p // 100)).argmax(axis=1) for p in PERCENTILES], axis=1)
    cost = tried * n + (n - np.take_along_axis(within, tried, axis=1)) * EXCEPTION_BITS
    chosen = np.take_along_axis(tried, cost.argmin(axis=1)[:, None], axis=1)[:, 0]
    out: list[bytes] = [b""] * rows
    for w in np.unique(chosen):
        at = np.flatnonzero(chosen == w)
        values = rest[at].astype("<u4")
        bits = np.unpackbits(values.view(np.uint8).reshape(len(at), n, 4), axis=2, bitorder="little")[:, :, :w]
        packed = np.packbits(bits.reshape(len(at), n * int(w)), axis=1, bitorder="little")
        for k, row in enumerate(at):
            places = np.flatnonzero(width[row] > w)
            out[row] = HEAD.pack(int(low[row]), n, int(w), len(places)) + packed[k].tobytes() + places.astype("<u2").tobytes() + values[k][places].tobytes()
    return out


def unpack(block: bytes | memoryview) -> np.ndarray:
    """The ids of a block."""
    low, n, w, exceptions = HEAD.unpack_from(block)
    size = -(-n * w // 8)
    bits = np.zeros((n, 32), np.uint8)
    if w:
        bits[:, :w] = np.unpackbits(np.frombuffer(block, np.uint8, size, HEAD.size), count=n * w, bitorder="little").reshape(n, w)
    rest = np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()
    if exceptions:
        places = np.frombuffer(block, "<u2", exceptions, HEAD.size + size)
        rest[places] = np.frombuffer(block, "<u4", exceptions, HEAD.size + size + 2 * exceptions)
    return rest + np.uint32(low)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it."""
    local = re.match(r"^(?:file:)?(/.*)", path)
    if local:
        return fs.LocalFileSystem(), "/" + local[1].lstrip("/")
    return fs.FileSystem.from_uri(path)


class BlockFile:
    """One file as it is written: takes documents in order and holds a bounded number of ids."""

    def __init__(self, folder: str, name: str):
        self.fs, path = file_system(f"{folder}/{name}")
        self.name, self.out = name, self.fs.open_output_stream(path)
        self.out.write(MAGIC)
        self.at, self.starts, self.docs, self.lengths = len(MAGIC), [], [], []
        self.held, self.size, self.ids = [], 0, 0

    def add(self, doc: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        self.docs.append(doc)
        self.lengths.append(n)
        self.ids += n
        self.held.append(ids)
        self.size += n
        if self.size >= PACK_IDS:
            self.flush(self.size // BLOCK * BLOCK)

    def flush(self, n: int) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        for i in range(0, n, PACK_IDS):
            for block in pack(ids[i : min(i + PACK_IDS, n)]):
                self.starts.append(self.at)
                self.at += len(block)
                self.out.write(block)
        self.held, self.size = [ids[n:].tobytes()], len(ids) - n

    def close(self) -> dict:
        self.flush(self.size)
        nulls = np.array([d is None for d in self.docs], np.uint8)
        self.out.write(np.array([*self.starts, self.at], "<u8").tobytes() + np.array([d or 0 for d in self.docs], "<i8").tobytes() + nulls.tobytes() + np.array(self.lengths, "<u8").tobytes())
        self.out.write(TAIL.pack(len(self.starts), len(self.docs), self.at, MAGIC))
        self.out.close()
        return {"name": self.name, "docs": len(self.docs), "ids": self.ids}


@dataclass
class Written(WriterCommitMessage):
    """The files of a task."""

    partition: int
    files: list[dict]


@dataclass
class Stretch(InputPartition):
    """One of ``parts`` stretches of a file; ``start`` counts the ids of the files before it."""

    name: str
    start: int
    part: int
    parts: int


class BlockWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder, self.most, self.tokenizer = options["path"], int(options.get("file_ids", FILE_IDS)), options.get("tokenizer")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        partition, current, files = TaskContext.get().partitionId(), None, []
        where, folder = file_system(self.folder)
        where.create_dir(folder, recursive=True)
        with tidied():
            for doc, ids in self.documents(iterator):
                if current is None:
                    current = BlockFile(self.folder, f"part-{partition:05d}-{len(files):03d}-{uuid.uuid4().hex}.ids")
                current.add(doc, ids)
                if current.ids >= self.most:
                    files.append(current.close())
                    current = None
            if current is not None:
                files.append(current.close())
        return Written(partition, files)

    def documents(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
        """The documents with their ids, with END_ID at the end where this task encodes them."""
        own, end = self.tokenizer and encoder(self.tokenizer), struct.pack("<I", END_ID)
        for batch in batches:
            for piece in slices(batch):
                values = piece.column(1).to_pylist()
                yield from zip(piece.column(0).to_pylist(), [x + end for x in own.encode(values)] if own else values, strict=True)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Writes the index, which names the files that count, and moves it into place."""
        start, files = 0, []
        for message in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
            for f in message.files:
                files.append({**f, "start": start})
                start += f["ids"]
        where, folder = file_system(self.folder)
        where.create_dir(folder, recursive=True)
        fresh = f"{folder}/{INDEX}.{uuid.uuid4().hex}"
        with where.open_output_stream(fresh) as out:
            out.write(json.dumps({"ids": start, "files": files}).encode())
        where.move(fresh, f"{folder}/{INDEX}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Removes the files of tasks that had ended."""
        where, folder = file_system(self.folder)
        for f in (f for m in messages if m is not None for f in m.files):
            where.delete_file(f"{folder}/{f['name']}")


class BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.with_ids, self.most = options["path"], options.get("ids", "false") == "true", int(options.get("read_ids", READ_IDS))

    def partitions(self) -> list[Stretch]:
        where, folder = file_system(self.folder)
        with where.open_input_stream(f"{folder}/{INDEX}") as f:
            files = json.loads(f.read())["files"]
        return [Stretch(f["name"], f["start"], i, parts) for f in files for parts in [max(1, -(-f["ids"] // self.most))] for i in range(parts)] or [Stretch("", 0, 0, 1)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in documents(self.folder, partition, self.with_ids) if partition.name else ():
            rows.append(row)
            held += len(row[4]) + 64
            if held > 4 << 20 or len(rows) == 4096:
                yield self.batch(rows)
                rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * self.with_ids
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[i], pa.binary() if i == 4 else pa.int64()) for i in range(len(names))], names=names)


def documents(folder: str, stretch: Stretch, with_ids: bool) -> Iterator[tuple]:
    """(doc_id, start, n_tokens, crc32, ids) of the documents that begin within a stretch of a file; of a
    long document a bounded number of blocks is held, unless its ids are asked for."""
    where, path = file_system(f"{folder}/{stretch.name}")
    with where.open_input_file(path) as f:
        size = f.size()
        n_blocks, n_docs, at, magic = TAIL.unpack(f.read_at(TAIL.size, size - TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{stretch.name} is no file of token blocks")
        foot = f.read_at(size - TAIL.size - at, at)
        starts = np.frombuffer(foot, "<u8", n_blocks + 1)
        docs = np.frombuffer(foot, "<i8", n_docs, 8 * (n_blocks + 1))
        nulls = np.frombuffer(foot, np.uint8, n_docs, 8 * (n_blocks + 1 + n_docs))
        lengths = np.frombuffer(foot, "<u8", n_docs, 8 * (n_blocks + 1 + n_docs) + n_docs).astype(np.int64)
        ends = lengths.cumsum()
        begins, total = ends - lengths, int(ends[-1]) if n_docs else 0
        bound = lambda k: int(np.searchsorted(begins, total * k // stretch.parts, side="left"))
        first, last = bound(stretch.part), n_docs if stretch.part == stretch.parts - 1 else bound(stretch.part + 1)
        if first >= last:
            return
        place = int(begins[first])
        blocks, skip = _blocks(f, starts, place // BLOCK), place % BLOCK
        have = next(blocks)[skip:] if place < total else np.empty(0, "<u4")
        for i in range(first, last):
            left, crc, kept = int(lengths[i]), 0, []
            while left:
                if not len(have):
                    have = next(blocks)
                part, have = have[:left], have[left:]
                left -= len(part)
                crc = zlib.crc32(part.tobytes(), crc)
                if with_ids:
                    kept.append(part.tobytes())
            yield None if nulls[i] else int(docs[i]), stretch.start + int(begins[i]), int(lengths[i]), crc, b"".join(kept)


def _blocks(f, starts: np.ndarray, first: int, at_once: int = 64) -> Iterator[np.ndarray]:
    """The ids of all blocks from one on."""
    for b in range(first, len(starts) - 1, at_once):
        end = min(b + at_once, len(starts) - 1)
        data = memoryview(f.read_at(int(starts[end] - starts[b]), int(starts[b])))
        for k in range(b, end):
            yield unpack(data[int(starts[k] - starts[b]) : int(starts[k + 1] - starts[b])])


class TokenBlocks(DataSource):
    """Spark's side of the format; see the module."""

    @classmethod
    def name(cls) -> str:
        return "token_blocks"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if self.options.get("ids", "false") == "true" else "")

    def reader(self, schema) -> BlockReader:
        return BlockReader(self.options)

    def writer(self, schema, overwrite: bool) -> BlockWriter:
        return BlockWriter(self.options)


#: The normalisers and the pattern of tokenizers that drop white space and lower-case, under
#: which the words of a text between white space are encoded each for itself.
WORD_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_SPACE = re.compile("[ \t-\r]+")
_LATIN = [chr(c) for c in range(256)]  # characters that are their own composed form and lower-case one by one
_LOWER = bytes(ord(c.lower()) for c in _LATIN)
_CLASS = {k: b"".join(b"\\x%02x" % ord(c) for c in _LATIN if test(c)) for k, test in {b"L": str.isalpha, b"N": lambda c: unicodedata.category(c)[0] == "N", b"S": lambda c: re.match(r"\s", c) and not "\x1c" <= c <= "\x1f"}.items()}
#: The same pattern for lower-cased text of such characters, one byte each.
PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[%(L)s]+|[%(N)s]|[^%(S)s%(L)s%(N)s]+" % _CLASS)
#: Pieces of a generation that a worker remembers, the longest of them, and characters that are cut at once.
PIECES_HELD, PIECE_LENGTH, HELD_CHARS = 1 << 19, 48, 1 << 19
#: What stands between words that are encoded in one text, and how many these are.
MARK, JOINED = ",", 256


class Remembered:
    """Values by key in two generations: what was used since the last change, and what was used in the
    one before it. Rare keys go, frequent ones stay."""

    def __init__(self, limit: int):
        self.limit, self.now, self.before = limit, {}, {}

    def missing(self, keys: set) -> list:
        """Keys without a value; those of the older generation are taken over."""
        keys = keys.difference(self.now)
        known = [k for k in keys if k in self.before]
        self.now.update(zip(known, map(self.before.__getitem__, known), strict=True))
        return list(keys.difference(known))

    def age(self, fresh: list) -> None:
        """Forgets long ones among new keys, and the older generation where the newer one is full."""
        for k in fresh:
            if len(k) > PIECE_LENGTH:
                del self.now[k]
        if len(self.now) > self.limit:
            self.now, self.before = {}, self.now


class Encoder:
    """Texts to ids by the tokenizers library; where the tokenizer's rules allow it (see WORD_PATTERN), equal words
    are handed to the library once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        rules = (spec["normalizer"] or {}).get("normalizers"), splits[0].get("pattern"), splits[0].get("behavior"), splits[0].get("invert")
        plain = not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in spec["added_tokens"])
        self.by_word = plain and rules == (WORD_NORMALIZERS, {"Regex": WORD_PATTERN}, "Removed", True)
        self.marks = [t["content"] for t in spec["added_tokens"]]
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.mark = self.library.encode(MARK, add_special_tokens=False).ids
        self.pieces = Remembered(PIECES_HELD)

    def plain(self, texts: list[str]) -> list[bytes]:
        """The library's ids of whole texts."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def apart(self, pieces: list[str]) -> list[bytes]:
        """The library's ids of pieces. Words of letters go to it many to a text, with MARK between, and are parted at MARK's id,
        which no letters give; all others, and a text that doesn't come apart as it was put together, go each for itself."""
        letters = [p for p in pieces if p.isalpha() and p.isascii() | p.islower()]
        known: dict[str, bytes] = {}
        for i in range(0, len(letters) if len(self.mark) == 1 else 0, JOINED):
            part = letters[i : i + JOINED]
            ids = np.array(self.library.encode_batch_fast([f" {MARK} ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(ids == self.mark[0])
            if len(at) == len(part) - 1:
                data, ends = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
                known.update((p, data[a:b]) for p, a, b in zip(part, [0, *(e + 4 for e in ends)], ends, strict=False))
        rest = [p for p in pieces if p not in known]
        known.update(zip(rest, self.plain(rest), strict=True))
        return [known[p] for p in pieces]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self.plain(texts)
        out: list[bytes] = []
        first = held = 0
        for i, text in enumerate(texts):  # pieces of a bounded number of texts are held
            held += len(text)
            if held >= HELD_CHARS or i == len(texts) - 1:
                out += self.encode_words(texts[first : i + 1])
                first, held = i + 1, 0
        return out

    def encode_words(self, texts: list[str]) -> list[bytes]:
        cut, of = [self.cut(t) for t in texts], self.pieces.now.get
        out: list[bytes] = []
        late, unknown = [], set()
        for i, pieces in enumerate(cut):
            ids = list(map(of, pieces))
            try:
                out.append(b"".join(ids))
            except TypeError:  # some piece is not known
                gaps = [k for k, x in enumerate(ids) if x is None]
                late.append((i, ids, gaps))
                out.append(b"")
                unknown.update([pieces[k] for k in gaps])
        fresh = self.pieces.missing(unknown)
        self.pieces.now.update(zip(fresh, self.apart([k if isinstance(k, str) else k.decode("latin-1") for k in fresh]), strict=True))
        for i, ids, gaps in late:
            for k in gaps:
                ids[k] = self.pieces.now[cut[i][k]]
            out[i] = b"".join(ids)
        self.pieces.age(fresh)
        return out

    def cut(self, text: str) -> list:
        """Pieces that are encoded each for itself: as the pattern cuts a text, where all its characters are of
        the first 256 (as bytes); else the words between ASCII white space, which are cut on if they can be."""
        if any(m in text for m in self.marks):
            return [text]
        try:
            return PIECES.findall(text.encode("latin-1").translate(_LOWER))
        except UnicodeEncodeError:
            words = ASCII_SPACE.split(text)
        out: list = []
        for word in words:
            try:
                out += PIECES.findall(word.encode("latin-1").translate(_LOWER))
            except UnicodeEncodeError:
                out.append(word)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder, which keeps its words from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_ids(df: DataFrame, path: str, folder: str, key: str = "doc_id", text: str = "text") -> None:
    """Writes all documents of ``df``, encoded by the tokenizers file at ``path`` (special strings as the library takes
    them), each with END_ID after it, to a folder of token blocks in ascending order of their keys.

    A null or empty text is its end id alone; null keys come first; rows with equal keys are all
    written, in an order that their texts give; other columns are not read; an empty table gives
    an index without files. Ranges are cut by key, text and row, so neither a key nor a text that many rows
    share makes a task longer than others.
    """
    spark = df.sparkSession
    spark.dataSource.register(TokenBlocks)
    bound_batches(spark)
    docs = keyed_text(df, key, text).toDF("doc_id", "text").withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())  # equal rows are interchangeable
    order = [F.col("doc_id").asc_nulls_first(), "h", "row"]
    sorted_docs = docs.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    sorted_docs.write.format("token_blocks").option("tokenizer", path).mode("append").save(folder)


def read_ids(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """One row for each document of a folder of token blocks: doc_id, start, n_tokens, ids_crc32 and,
    where asked for, ids."""
    spark.dataSource.register(TokenBlocks)
    return spark.read.format("token_blocks").option("ids", str(ids).lower()).load(folder)


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the ids of all documents and reads them back: doc_id, start (ids of all documents before),
    n_tokens with the end id, and the crc32 of the ids; see ``write_ids`` for nulls and ties."""
    folder = f"{Scratch(df.sparkSession, 'token-blocks').base}/ids"
    write_ids(df, path, folder, key, text)
    return read_ids(df.sparkSession, folder)
