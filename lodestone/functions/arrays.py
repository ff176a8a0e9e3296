"""Folds over arrays whose states are all kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def states_before(xs: Column, zero: Column, step: Callable[[Column, Column], Column], block: int = 128) -> Column:
    """For each element, the state of a fold before it.

    Growing arrays are copied within a block only, and each block begins with the last state of the one before, so the time is linear but
    for arrays of many thousand blocks. ``xs`` must be a column, as it is read for each block.
    """
    cuts = F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0)), F.lit(block))
    none = F.filter(F.array(zero), lambda s: F.lit(False))

    def within(state: Column, part: Column) -> Column:
        first = F.struct(state.alias("at"), none.alias("out"))
        return F.aggregate(part, first, lambda a, x: F.struct(step(a["at"], x).alias("at"), F.array_append(a["out"], a["at"]).alias("out")))

    first = F.struct(zero.alias("at"), F.filter(F.array(none), lambda s: F.lit(False)).alias("blocks"))

    def next_block(a: Column, cut: Column) -> Column:
        # One element of an array, so that the fold of the block is worked out once.
        done = F.transform(F.array(within(a["at"], F.slice(xs, cut + 1, F.lit(block)))), lambda w: F.struct(w["at"].alias("at"), F.array_append(a["blocks"], w["out"]).alias("blocks")))
        return F.get(done, F.lit(0))

    return F.aggregate(cuts, first, next_block, lambda a: F.flatten(a["blocks"]))
