"""Benchmark decontamination by greedy string tiling.

Five-word seeds that a document shares with a benchmark item pick the pairs to compare and the
parts of the document worth comparing. Running Karp-Rabin greedy string tiling then marks the
longest common passages that do not overlap, long ones first, whatever their order; an item counts
as leaked when the tiles cover enough of it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache, reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspan.llm.common import Scratch, map_arrow, slices

#: Words of a seed and of the shortest tile; share of an item's words that tiles must cover.
SEED_WORDS, COVERAGE = 5, 0.5
#: Bytes of benchmark text that are sent to the executors at once, in one pass over the documents; more
#: items take more passes. Pairs whose tiling a task remembers, and the longest of these in words.
CHUNK_BYTES, REMEMBERED, LONGEST = 16 << 20, 4096, 2048
#: Characters of scripts without spaces between words; each is a word.
_LONE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")

_GAPS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
_BASE, _PRIME = 1_000_003, (1 << 61) - 1
HITS = "tiling_hits__"
HIT_TYPE = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("item_words", T.LongType()), T.StructField("covered_words", T.LongType()), T.StructField("n_tiles", T.LongType())]))
_HIT_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("item_words", pa.int64()), ("covered_words", pa.int64()), ("n_tiles", pa.int64())]))


def words_of(text: str) -> list[bytes]:
    """Lower-case words; ASCII marks part words, other characters do not. A character of a script that
    puts no spaces between words (Han, kana, Thai, Lao, Khmer, Burmese) is a word."""
    if not text.isascii():
        text = _LONE.sub(r" \g<0> ", text)
    return text.lower().encode().translate(_GAPS).split()


def windows(seq: list[int], marked: bytearray, size: int):
    """(start, Karp-Rabin hash) of each run of ``size`` unmarked tokens, by a running hash."""
    top = pow(_BASE, size, _PRIME)
    held, length = 0, 0
    for i, token in enumerate(seq):
        if marked[i]:
            held = length = 0
            continue
        held, length = (held * _BASE + token + 1) % _PRIME, length + 1
        if length > size:
            held = (held - (seq[i - size] + 1) * top) % _PRIME
        if length >= size:
            yield i - size + 1, held


def tiles(item: list[int], doc: list[int], least: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in doc, length) of non-overlapping matches of at
    least ``least`` tokens, longest first, each token of either side in one tile at most. Negative
    tokens in ``doc`` part passages and match nothing."""
    in_item, in_doc = bytearray(len(item)), bytearray(int(t < 0) for t in doc)
    out: list[tuple[int, int, int]] = []
    size = max(least, min(len(item), len(doc)))
    while True:
        at = defaultdict(list)
        for i, h in windows(item, in_item, size):
            at[h].append(i)
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        longest = 0
        for j, h in windows(doc, in_doc, size) if at else ():
            for i in at.get(h, ()):
                if i and j and not in_item[i - 1] and not in_doc[j - 1] and item[i - 1] == doc[j - 1]:
                    continue  # part of a match that begins further left
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not in_item[i + n] and not in_doc[j + n]:
                    n += 1
                if n >= size:
                    found[n].append((i, j))
                    longest = max(longest, n)
        if longest > 2 * size:
            size = longest
            continue
        queue = [(-n, i, j) for n in found for i, j in found[n]]
        heapify(queue)
        while queue:
            n, i, j = heappop(queue)
            free = [k for k in range(-n) if not in_item[i + k] and not in_doc[j + k]]
            if len(free) == -n:
                in_item[i : i - n] = in_doc[j : j - n] = b"\1" * -n
                out.append((i, j, -n))
                continue
            run = 0  # what longer tiles have left of a match competes with the others by its length
            for a, b in zip(free, [*free[1:], -1][: len(free)], strict=True):
                run += 1
                if b != a + 1:
                    if run >= size:
                        heappush(queue, (-run, i + a + 1 - run, j + a + 1 - run))
                    run = 0
        if size <= least:
            return out
        size = max(least, size // 2)


class Index:
    """The seeds of a bounded set of benchmark items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocab: dict[bytes, int] = {}
        self.items = []
        keys, owners, places = [], [], []
        for number, (_, text) in enumerate(items):
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text)]
            self.items.append(ids)
            if len(ids) >= SEED_WORDS:
                seeds = self.seeds(np.array(ids, dtype=np.int64))
                keys.append(seeds)
                owners.append(np.full(len(seeds), number))
                places.append(np.arange(len(seeds)))
        self.ids = [i for i, _ in items]
        if not keys:
            keys, owners, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        keys_ = np.concatenate(keys)
        order = np.argsort(keys_, kind="stable")
        self.keys, self.owners, self.places = keys_[order], np.concatenate(owners)[order], np.concatenate(places)[order]
        self.remembered = lru_cache(maxsize=REMEMBERED)(self._tile)

    @staticmethod
    def seeds(ids: np.ndarray) -> np.ndarray:
        """A hash of each run of SEED_WORDS word numbers; equal hashes are checked by the tiling."""
        out = np.zeros(len(ids) - SEED_WORDS + 1, dtype=np.uint64)
        for k in range(SEED_WORDS):
            out = (out ^ (ids[k : k + len(out)].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def tile(self, number: int, doc: tuple[int, ...]) -> tuple[int, int]:
        """(covered words, tiles) of an item in the part of a document that shares seeds with it."""
        return self.remembered(number, doc) if len(doc) <= LONGEST else self._tile(number, doc)

    def _tile(self, number: int, doc: tuple[int, ...]) -> tuple[int, int]:
        found = tiles(self.items[number], list(doc))
        return sum(n for _, _, n in found), len(found)

    def hits(self, text: str, coverage: float) -> list[dict]:
        """The items of which ``text`` holds at least a share of ``coverage``, in order of place."""
        get, words = self.vocab.get, words_of(text)
        if len(words) < SEED_WORDS or not len(self.keys):
            return []
        ids = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        unknown = np.r_[0, np.cumsum(ids < 0)]
        whole = np.flatnonzero(unknown[SEED_WORDS:] == unknown[:-SEED_WORDS])
        if not len(whole):
            return []
        keys = self.seeds(ids)[whole]
        distinct, place = np.unique(keys, return_inverse=True)
        low, high = np.searchsorted(self.keys, distinct, "left"), np.searchsorted(self.keys, distinct, "right")
        n = high - low
        which = np.repeat(np.arange(len(distinct)), n)  # each distinct seed with each of its places in items
        if not len(which):
            return []
        here = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(len(which))
        order = np.argsort(self.owners[here], kind="stable")
        owners, inside, which = self.owners[here][order], self.places[here][order], which[order]
        bounds = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1], True]).tolist()
        out = []
        for k, m in zip(bounds[:-1], bounds[1:], strict=True):
            owner = int(owners[k])
            need = coverage * len(self.items[owner])
            if reach(inside[k:m]) < need:
                continue  # tiles cover no more than seeds do
            wanted = np.zeros(len(distinct), dtype=bool)
            wanted[which[k:m]] = True
            starts = whole[wanted[place]]
            if reach(starts) < need:
                continue
            starts = starts.tolist()
            part, end = [], 0
            for start in starts:
                if start > end and part:
                    part.append(-1)
                part += ids[max(start, end) : start + SEED_WORDS].tolist()
                end = start + SEED_WORDS
            covered, n = self.tile(owner, tuple(part))
            if covered >= need:
                out.append({"item_id": self.ids[owner], "item_words": len(self.items[owner]), "covered_words": covered, "n_tiles": n})
        return out


def reach(starts: np.ndarray) -> int:
    """How many words the seeds that begin at these places cover."""
    starts = np.unique(starts)
    return int(np.minimum(np.diff(starts), SEED_WORDS).sum()) + SEED_WORDS


def chunks(benchmark: DataFrame, key: str, text: str, limit: int):
    """The items in groups whose text is at most ``limit`` bytes (one item may be longer)."""
    picked = benchmark.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).dropDuplicates()
    total = picked.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-2 * total // limit)) if total > limit else 1
    for part in range(parts):
        share = picked.where(F.pmod(F.xxhash64("k", "t"), F.lit(parts)) == part) if parts > 1 else picked
        yield sorted(((r["k"], r["t"]) for r in share.collect()), key=lambda r: (r[0] is None, r))


def with_hits(df: DataFrame, items: list[tuple], text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """``df`` with all its columns and one more, HITS: those of the benchmark's ``items``, a chunk of
    bounded size, that leak into each row's text. One pass without a shuffle, one index in a task."""
    place, shared = df.columns.index(text), df.sparkSession.sparkContext.broadcast(items)
    schema = T.StructType([*df.schema.fields, T.StructField(HITS, HIT_TYPE)])

    def run(batches):
        index = Index(shared.value)
        for batch in batches:
            for piece in slices(batch, place):
                hits = [index.hits(t, coverage) if t else [] for t in piece.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(hits, _HIT_ARROW)], names=[*piece.schema.names, HITS])

    return map_arrow(df, run, schema)


def contamination(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row for each document and benchmark item that it leaks: key, item_id, item_words,
    covered_words, n_tiles, coverage. Clean documents have no row.

    Keys are numbers; a key that can't be cast to long is an error. Null and empty texts leak nothing,
    neither do items of fewer than five words (they would flag common phrases). Items with equal text
    each have their row; repeated rows of ``df`` give repeated rows; repeated (item, text) rows of the
    benchmark count once. Other columns of either table are not read. Covered words are those of the
    item, each counted once. A benchmark beyond ``chunk_bytes`` is looked for chunk by chunk, each in
    a pass of its own over the documents.
    """
    picked = df.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    found = [with_hits(picked, items, text, coverage).select(key, F.explode(HITS).alias("h")) for items in chunks(benchmark, item_key, item_text, chunk_bytes)]
    hits = reduce(DataFrame.unionByName, found)
    return hits.select(key, "h.item_id", "h.item_words", "h.covered_words", "h.n_tiles", (F.col("h.covered_words") / F.col("h.item_words")).alias("coverage"))


def remove_leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows of ``df``, all columns, that leak no benchmark item; after each chunk of the benchmark
    but the last what is kept is written."""
    scratch, before = Scratch(df.sparkSession, "tiling"), None
    for number, items in enumerate(chunks(benchmark, item_key, item_text, chunk_bytes)):
        if before is not None:
            df = scratch.keep(df, f"pass-{number}")
            scratch.drop(before)
        before, df = f"pass-{number}", with_hits(df, items, text, coverage).where(F.size(HITS) == 0).drop(HITS)
    return df
