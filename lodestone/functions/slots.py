"""Which rows may have one of many keys: a table of hash slots tells within the task, so that few others are shuffled to a join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 26


def _slot(columns: list[str]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SLOTS))


def may_be_in(keys: DataFrame, columns: list[str]) -> Column:
    """True for rows whose columns are in keys, and for few others. The driver gets at most SLOTS / 64 rows of 12 bytes, as Arrow batches."""
    bit = F.expr("shiftleft(1L, cast(slot % 64 as int))")
    cells = keys.select(_slot(columns).alias("slot")).groupBy(F.floor(F.col("slot") / 64).cast("int").alias("cell")).agg(F.bit_or(bit).alias("bits")).toArrow()
    held = np.zeros(SLOTS // 64, dtype=np.int64)
    held[cells["cell"].to_numpy()] = cells["bits"].to_numpy()
    shared = keys.sparkSession.sparkContext.broadcast(held.tobytes())

    @F.pandas_udf("boolean")
    def may_be(slot: pd.Series) -> pd.Series:
        bits, at = np.frombuffer(shared.value, dtype=np.int64), slot.to_numpy(np.int64)
        return pd.Series((bits[at >> 6] >> (at & 63) & 1).astype(bool))

    return may_be(_slot(columns))
