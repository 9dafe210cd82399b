"""Bitmaps of bounded size that sift rows where they are read, before anything moves.

A sieve lets all wanted values through and few others; what passes is still joined exactly. Its size
follows the number of wanted values up to a fixed limit, beyond which it only lets more through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from reelspan.llm.common import map_arrow

#: Bits of a sieve: at least, at most (16 MB), and for each wanted value.
LEAST_BITS, MOST_BITS, BITS_EACH = 1 << 16, 1 << 27, 16
#: Stretches of a bitmap; each is marked by one task, so that the bitmap comes to the driver once.
STRETCHES = 64


class Sieve:
    """A bitmap over hashed 64-bit values."""

    def __init__(self, bits: int):
        self.shift, self.marks = np.uint64(64 - (bits.bit_length() - 1)), np.zeros(bits // 8, dtype=np.uint8)

    def slots(self, values: np.ndarray) -> np.ndarray:
        """The bit of each value."""
        return (values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def passes(self, values: np.ndarray) -> np.ndarray:
        """Which values may be wanted."""
        at = self.slots(values)
        return (self.marks[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def sieve_of(wanted: DataFrame) -> Sieve:
    """The sieve of the values in the only column of ``wanted``, a long without nulls."""
    target = LEAST_BITS
    need = BITS_EACH * wanted.count()
    while target < min(need, MOST_BITS):
        target *= 2

    width = target // STRETCHES

    def place(batches):
        own = Sieve(target)
        for batch in batches:
            slots = np.unique(own.slots(batch.column(0).to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array((slots // width).astype(np.int32)), pa.array((slots % width).astype(np.int32))], names=["stretch", "slot"])

    def mark(batches):
        flat: dict[int, np.ndarray] = {}
        for batch in batches:
            stretch, slot = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k in np.unique(stretch).tolist():
                flat.setdefault(k, np.zeros(width, dtype=bool))[slot[stretch == k]] = True
        rows = [np.packbits(x, bitorder="little").tobytes() for x in flat.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(flat), pa.int32()), pa.array(rows, pa.binary())], names=["stretch", "bits"])

    out = Sieve(target)
    placed = map_arrow(wanted, place, "stretch int, slot int").repartition("stretch")
    for row in map_arrow(placed, mark, "stretch int, bits binary").collect():
        out.marks[row["stretch"] * width // 8 :][: width // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out
