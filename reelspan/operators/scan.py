"""Running values over ordered rows without one task for each key: a prefix scan in two levels.

The rows of a key are cut into stretches of its order. Each stretch is summed on its own, the sums of the
stretches run in a second, much smaller window, and what lies before a stretch is joined back to its rows.
A key of any length is thus as many tasks' work as it has stretches. Rows move once, by
(key, stretch), which serves the window and the join alike; what else moves is one row a stretch.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelspan.functions.text import let

#: Rows of a stretch where the order is a dense number.
STRETCH_ROWS = 1 << 16
_FIRST_STRETCH = -(2**62)


@dataclass(frozen=True)
class Fold:
    """A running value: its kind (count, sum, max, min, bit_xor, first or last), what is folded, whether a row's
    own value counts, and whether it runs backward, from the last row on. Nulls are passed over; where there is nothing
    yet the value is null (a count: 0)."""

    kind: str
    value: Column
    own: bool = True
    backward: bool = False

    def over(self, value: Column, window) -> Column:
        """The fold within a window, of what was not folded yet."""
        plain = {"count": F.count, "sum": F.sum, "max": F.max, "min": F.min, "bit_xor": F.bit_xor}
        at_edge = {"first": F.first, "last": F.last}
        return (plain[self.kind](value) if self.kind in plain else at_edge[self.kind](value, ignorenulls=True)).over(window)

    def frame(self, keys: list[str], order: list[str], own: bool):
        """The window of the rows up to one, with or without itself."""
        ordered = W.partitionBy(*keys).orderBy(*[F.col(o).desc() if self.backward else F.col(o) for o in order])
        return ordered.rowsBetween(W.unboundedPreceding, 0 if own else -1)

    def total(self, value: Column, order: list[str]) -> Column:
        """The fold of a whole stretch."""
        if self.kind in ("first", "last"):
            pick = F.min_by if (self.kind == "first") != self.backward else F.max_by
            return pick(value, F.when(value.isNotNull(), F.struct(*order)))
        return {"count": F.count, "sum": F.sum, "max": F.max, "min": F.min, "bit_xor": F.bit_xor}[self.kind](value)

    def joined(self, before: Column, here: Column) -> Column:
        """The fold of what lies before a stretch and of what lies in it."""
        if self.kind in ("max", "min"):
            return F.greatest(before, here) if self.kind == "max" else F.least(before, here)
        if self.kind in ("first", "last"):
            return F.coalesce(before, here) if self.kind == "first" else F.coalesce(here, before)
        both = before.bitwiseXOR(here) if self.kind == "bit_xor" else before + here
        return F.coalesce(both, before, here)


def dense(order: str, size: int | None = None) -> Column:
    """The stretch of a row by a whole number that counts up, as positions do."""
    return F.floor(F.col(order) / (size or STRETCH_ROWS)).cast("long")


def timed(seconds: str, size: float) -> Column:
    """The stretch of a row by a time; what is not finite goes to the ends, null stays null."""
    bounded = F.when(F.col(seconds).isNotNull(), F.greatest(F.least(F.col(seconds), F.lit(1e15)), F.lit(-1e15)))
    return F.floor(bounded / size).cast("long")


def running(df: DataFrame, by: list[str], order: list[str], stretch: Column, folds: Mapping[str, Fold]) -> DataFrame:
    """Adds running values over the rows of each key in ``order`` (nulls first).

    ``stretch`` is a whole number that never falls along the order and has few rows to a value; a null one
    comes first. Keys that hold a null make one group, as in a window, in one stretch. Sums of
    doubles are added stretch by stretch, so beyond the first stretch the last bits may differ from a
    plain window's. No rows give no rows; columns of ``df`` keep their names and order.
    """
    no_key = F.lit(False)
    for k in by:
        no_key = no_key | F.col(k).isNull()
    place = F.coalesce(stretch, F.lit(_FIRST_STRETCH)).cast("long")
    cut = df.withColumn("_stretch", F.when(no_key, F.lit(0).cast("long")).otherwise(place))
    cut = cut.withColumns({f"_value_{n}": f.value for n, f in folds.items()})
    here = cut.withColumns({f"_here_{n}": f.over(F.col(f"_value_{n}"), f.frame([*by, "_stretch"], order, f.own)) for n, f in folds.items()})
    totals = cut.groupBy(*by, "_stretch").agg(*[f.total(F.col(f"_value_{n}"), order).alias(f"_all_{n}") for n, f in folds.items()])
    across = {n: replace(f, kind="sum") if f.kind == "count" else f for n, f in folds.items()}
    before = totals.select(*by, "_stretch", *[f.over(F.col(f"_all_{n}"), f.frame(by, ["_stretch"], own=False)).alias(f"_before_{n}") for n, f in across.items()])
    joined = here.join(before, [*by, "_stretch"], "left")
    return joined.select(*[F.col(c) for c in df.columns if c not in folds], *[f.joined(F.col(f"_before_{n}"), F.col(f"_here_{n}")).alias(n) for n, f in folds.items()])


#: Values of a block of an array that is summed up in levels.
_BLOCK = 64


def running_sums(values: Column, levels: int = 2) -> Column:
    """The running sums of an array of longs within its row, the same scan in blocks: each block on its own, then the sums of
    blocks, ``levels`` deep. An empty array gives an empty one."""
    add = lambda v, i: F.aggregate(F.slice(v, F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, x: a + x)
    summed = lambda array: let(array, lambda v: F.transform(v, lambda _, i: add(v, i)))
    if not levels:
        return summed(values)

    def across(v: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), F.floor(F.size(v) / _BLOCK).cast("int")), lambda b: b * _BLOCK < F.size(v))
        return let(F.transform(firsts, lambda b: summed(F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK)))), laid)

    def laid(blocks: Column) -> Column:
        ends = running_sums(F.transform(blocks, lambda b: F.element_at(b, -1)), levels - 1)
        shifted = lambda e: F.transform(blocks, lambda b, k: F.transform(b, lambda x: x + F.coalesce(F.get(e, k - 1), F.lit(0))))
        return F.flatten(let(ends, shifted))

    return let(values, across)
