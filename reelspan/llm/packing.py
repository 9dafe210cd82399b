"""Bounded-space online packing of token sequences.

Each task tokenizes its documents and keeps a fixed number of open windows. A piece goes to the
open window with the least room that still holds it (best fit); when none holds it, the fullest
window is emitted and a new one opens. Cuts are free, so a gap that is worth a piece is filled
before its window goes. At the end a task closes its windows against each other and is left with
at most one part-filled window; those leftovers are merged in groups of bounded size, in rounds,
until few remain.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.llm.common import Scratch, keyed_text, map_arrow, slices
from reelspan.llm.token_counts import _LOOSE, CACHE_ENTRIES, CACHE_LENGTH, PRE_TOKENS, byte_symbols

#: Tokens of a window; open windows of a task; the smallest gap that a cut may fill.
WINDOW, OPEN_WINDOWS, LEAST_CUT = 2048, 32, 8
#: Leftover windows that one task of the merge sees at most.
MERGE_GROUP = 64
END_ID = 1
#: A run of white space so long that the pattern's search for its end would go too deep; the characters are the pattern's ``\\s``.
LONG_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class Encoder(dict):
    """Texts to little-endian uint32 ids; remembers the ids of space-led pieces.

    The ids are those of the tokenizers file at ``path``. Pieces that are not remembered yet are
    encoded by a rank table built from that file, which gives the library's ids."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        back = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes(back[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in self.special}
        self.encoder = tiktoken.Encoding("own", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens=dict(self.special))
        self.one_piece = tiktoken.Encoding("piece", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
        self.allowed = set(self.special)

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode_plain(piece)
        if len(piece) <= CACHE_LENGTH:
            if len(self) > CACHE_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids

    def encode_plain(self, text: str) -> bytes:
        """The ids of a text by the encoder's pattern. A long run of white space is one piece, without its last
        character where a word follows, which that belongs to."""
        ids, at = [], 0
        for run in LONG_RUN.finditer(text):
            end = run.end() if run.end() == len(text) or any(text.startswith(s, run.end()) for s in self.special) else run.end() - 1
            ids += self.encoder.encode(text[at : run.start()], allowed_special=self.allowed)
            ids += self.one_piece.encode_ordinary(text[run.start() : end])
            at = end
        ids += self.encoder.encode(text[at:], allowed_special=self.allowed)
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """All ids of a text; the strings of special tokens count as those tokens."""
        if not text:
            return b""
        if _LOOSE.search(text) or any(s in text for s in self.special):
            return self.encode_plain(text)
        head, *rest = text.split(" ")
        return (self[head] if head else b"") + b"".join([self[" " + x] for x in rest])


class Packer:
    """Open windows, each a list of (doc_id, start, doc_tokens, ids as bytes)."""

    def __init__(self, space: int, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, least_cut: int = LEAST_CUT):
        self.space, self.window, self.limit, self.least = space, window, open_windows, least_cut
        self.fill: list[int] = []
        self.held: list[list[tuple]] = []
        self.made = 0
        self.out: list[tuple] = []

    def emit(self, pieces: list[tuple], keep_ids: bool = False) -> None:
        """Writes the rows of a closed window."""
        number, offset = (self.space << 32) + self.made, 0
        self.made += 1
        for doc, start, total, ids in pieces:
            n = len(ids) // 4
            self.out.append((doc, start, n, zlib.crc32(ids), total, number, offset, ids if keep_ids else None))
            offset += n

    def add(self, doc, ids: bytes, start: int, total: int) -> None:
        """Places the ids of a document, or of a piece of one."""
        full, at = 4 * self.window, 0
        for at in range(full, len(ids) + 1, full):
            self.emit([(doc, start, total, ids[at - full : at])])
            start += self.window
        ids = ids[at:]
        n = len(ids) // 4
        if not n:
            return
        best, fullest = -1, -1
        for i, held in enumerate(self.fill):
            if held + n <= self.window and (best < 0 or held > self.fill[best]):
                best = i
            if fullest < 0 or held > self.fill[fullest]:
                fullest = i
        if best < 0 and len(self.fill) < self.limit:
            self.fill.append(0)
            self.held.append([])
            best = len(self.fill) - 1
        if best < 0:
            gap = self.window - self.fill[fullest]
            if gap >= self.least:
                self.held[fullest].append((doc, start, total, ids[: 4 * gap]))
                ids, start, n = ids[4 * gap :], start + gap, n - gap
            self.emit(self.held[fullest])
            self.fill[fullest], self.held[fullest], best = 0, [], fullest
        if n:
            self.fill[best] += n
            self.held[best].append((doc, start, total, ids))
            if self.fill[best] == self.window:
                self.emit(self.held[best])
                del self.fill[best], self.held[best]

    def close(self) -> None:
        """Merges the open windows: the fullest ones are filled from the emptiest. At most one
        part-filled window stays, which keeps its ids for the merge with other tasks."""
        loose = [p for _, pieces in sorted(zip(self.fill, self.held, strict=True), key=lambda x: -x[0]) for p in pieces]
        current, room = [], self.window
        for doc, start, total, ids in loose:
            at = 0
            while at < len(ids):
                part = ids[at : at + 4 * room]
                current.append((doc, start + at // 4, total, part))
                at, room = at + len(part), room - len(part) // 4
                if not room:
                    self.emit(current)
                    current, room = [], self.window
        if current:
            self.emit(current, keep_ids=True)
        self.fill, self.held = [], []

    def batch(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        types = [pa.int64()] * 7 + [pa.binary()]
        columns = zip(*rows, strict=True) if rows else [[]] * 8
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def pack(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, open_windows: int = OPEN_WINDOWS, merge_group: int = MERGE_GROUP) -> DataFrame:
    """Packs all documents into windows of at most ``window`` tokens; one row for each piece:
    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids by the tokenizers file at ``path``, without added special tokens, then
    id 1; a null or empty text is the id 1 alone. Repeated rows are packed each on its own, a null
    key stays null, other columns are not read, an empty table gives no rows. Windows of a task
    depend on the rows of its partition alone, so a lost task gives the same windows again.
    """

    def run(batches):
        encoder, packer = Encoder(path), Packer(TaskContext.get().partitionId(), window, open_windows)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            for piece in slices(batch):
                for doc, body in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    ids = encoder.encode(body) + end
                    packer.add(doc, ids, 0, len(ids) // 4)
                yield packer.batch()
        packer.close()
        yield packer.batch()

    docs = keyed_text(df, key, text).toDF("doc_id", "text")
    scratch = Scratch(df.sparkSession, "packing")
    pieces = scratch.keep(map_arrow(docs, run, SCHEMA), "pieces")
    last = pieces.agg(F.max(F.shiftright("sequence_id", 32))).first()[0]
    parts = 0 if last is None else last + 1  # tasks that wrote, whatever the plan had foreseen
    done, left = pieces.where("ids is null").drop("ids"), pieces.where("ids is not null")
    space = parts
    while parts > 1:  # each round leaves at most one part-filled window for merge_group of them
        groups = -(-parts // merge_group)
        merged = merge(left, groups, space, window, scratch)
        done = done.unionByName(merged.where("ids is null").drop("ids"))
        left, parts, space = merged.where("ids is not null"), groups, space + groups
    return done.unionByName(left.drop("ids"))


def merge(left: DataFrame, groups: int, space: int, window: int, scratch: Scratch) -> DataFrame:
    """Joins part-filled windows, at most one of each task, in ``groups`` groups of bounded size."""

    def join(data: pa.Table) -> pa.Table:
        rows = sorted(data.to_pylist(), key=lambda r: (r["sequence_id"], r["offset"]))
        packer = Packer(space + (rows[0]["sequence_id"] >> 32) % groups, window)
        packer.held = [[(r["doc_id"], r["start"], r["doc_tokens"], r["ids"]) for r in rows]]
        packer.fill = [0]
        packer.close()
        return pa.Table.from_batches([packer.batch()])

    keyed = left.withColumn("g", (F.shiftright("sequence_id", 32) % groups).cast("long"))
    return scratch.keep(keyed.groupBy("g").applyInArrow(join, SCHEMA), f"merged-{space}")
