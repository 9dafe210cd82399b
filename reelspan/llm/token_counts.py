"""Token counts by rank-synchronous array merging.

Pre-tokens that a task has not met yet are held as one ragged numpy array. In each step every
sequence finds its lowest-rank adjacent pair and all sequences apply theirs at once; what
survives when no sequence has a pair left are the tokens. Text is cut into space-led pieces
first, whose counts a task remembers, so that merging runs once for a distinct piece.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from reelspan.llm.common import keyed_text, map_batches

#: Splits text before merging (the rule of the byte-level vocabularies).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space before white space or the end: there a cut at spaces could part what belongs together.
_LOOSE = re.compile(r" (?:\s|\Z)")
_NONE = np.iinfo(np.int32).max
#: Pieces that a task remembers, and the longest piece that is remembered.
CACHE_ENTRIES, CACHE_LENGTH = 400_000, 48


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the others take the code points from 256 on in turn."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class MergeTable:
    """The merges of a byte-level BPE file as an open-addressing numpy hash table."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.of_byte = np.array([vocab[c] for c in byte_symbols()], dtype=np.int64)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, dtype=np.int32)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slots(keys).tolist(), strict=True)):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & (len(self.keys) - 1)
            self.keys[slot], self.ranks[slot] = key, rank

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each pair, _NONE where there is no merge."""
        slot = self._slots(keys)
        got = self.keys[slot]
        out = np.where(got == keys, self.ranks[slot], _NONE)
        open_ = np.flatnonzero((got != keys) & (got >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            got = self.keys[slot[open_]]
            hit = got == keys[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (got >= 0)]
        return out

    def surviving(self, sequences: list[bytes]) -> np.ndarray:
        """How many symbols each byte sequence keeps when no merge applies to it any more."""
        counts = np.array([len(s) for s in sequences], dtype=np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(sequences), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(sequences)), counts)
        ranks = self._pair_ranks(symbols, owner)
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(ranks, starts)
            lengths = np.diff(np.r_[starts, len(symbols)])
            live = np.repeat(lowest != _NONE, lengths)
            if not live.all():
                symbols, owner, ranks = symbols[live], owner[live], ranks[live]
                lowest, lengths = lowest[lowest != _NONE], lengths[lowest != _NONE]
                if not len(symbols):
                    break
            at = np.flatnonzero(ranks == np.repeat(lowest, lengths))
            first = np.r_[True, np.diff(at) != 1]  # in a run of overlapping pairs every other one applies
            at = at[(at - at[first][np.cumsum(first) - 1]) % 2 == 0]
            symbols[at] = self.made[ranks[at]]
            counts -= np.bincount(owner[at], minlength=len(counts))
            kept = np.ones(len(symbols), dtype=bool)
            kept[at + 1] = False
            new_at = np.cumsum(kept)[at] - 1
            symbols, owner, ranks = symbols[kept], owner[kept], ranks[kept]
            changed = np.unique(np.r_[new_at, np.maximum(new_at - 1, 0)])
            ranks[changed] = self._pair_ranks(symbols, owner, changed)
        return counts

    def _pair_ranks(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """The rank of the pair that begins at each place; _NONE at the end of a sequence."""
        at = np.arange(len(symbols)) if at is None else at
        out = np.full(len(at), _NONE, dtype=np.int32)
        inner = at < len(symbols) - 1
        inner[inner] = owner[at[inner]] == owner[at[inner] + 1]
        here = at[inner]
        out[inner] = self.rank(symbols[here] << 20 | symbols[here + 1])
        return out


class Counter:
    """Counts the tokens of texts, remembering pieces and pre-tokens."""

    def __init__(self, path: str):
        self.merges, self.pattern = MergeTable(path), regex.compile(PRE_TOKENS)
        self.pieces: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def cut(self, text: str) -> list[str]:
        """Space-led pieces that tokenize independently of each other."""
        if _LOOSE.search(text):
            return self.pattern.findall(text)
        head, *rest = text.split(" ")
        return [*([head] if head else ()), *(" " + x for x in rest)]

    def counts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        special = self.merges.special
        rows: list[tuple[int, list[str]]] = []
        for text in texts:
            parts, found = [text], 0
            for token in special:
                if token in text:
                    parts = [p for x in parts for p in x.split(token)]
                    found += text.count(token)
            rows.append((found, [piece for part in parts if part for piece in self.cut(part)]))
        if len(self.pieces) > CACHE_ENTRIES:
            self.pieces.clear()
        if len(self.words) > CACHE_ENTRIES:
            self.words.clear()
        known = self.pieces
        fresh = list({p for _, pieces in rows for p in pieces}.difference(known))
        cut = [self.pattern.findall(p) for p in fresh]
        new = list({w for words in cut for w in words}.difference(self.words))
        long_pieces: dict[str, int] = {}
        local = dict(zip(new, self.merges.surviving([w.encode() for w in new]).tolist(), strict=True)) if new else {}
        self.words.update((w, n) for w, n in local.items() if len(w) <= CACHE_LENGTH)
        word = self.words
        for piece, words in zip(fresh, cut, strict=True):
            n = sum([word[w] if w in word else local[w] for w in words])
            (known if len(piece) <= CACHE_LENGTH else long_pieces)[piece] = n
        if long_pieces:
            known = {**known, **long_pieces} if len(known) < 1000 else _Both(known, long_pieces)
        get = known.__getitem__
        return [found + sum(map(get, pieces)) for found, pieces in rows]


class _Both(dict):
    """Looks in two dicts without copying the large one."""

    def __init__(self, large: dict, small: dict):
        super().__init__(small)
        self.large = large

    def __missing__(self, key):
        return self.large[key]


def count_tokens(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """One row for each row of ``df``: key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``path`` is a byte-level BPE file of the tokenizers library, there at the same place on every
    executor. A null text counts as empty (0 bytes, 0 tokens); repeated rows give repeated rows; a
    null key stays null; other columns of ``df`` are not read. No shuffle and no state beyond
    bounded caches of a task.
    """

    def make():
        counter = Counter(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            counts = counter.counts(texts)
            sizes = pc.binary_length(batch.column(1)).cast(pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], names=[key, "n_bytes", "n_tokens", "over_limit"])

        return work

    return map_batches(keyed_text(df, key, text), make, f"{key} long, n_bytes long, n_tokens long, over_limit boolean")
