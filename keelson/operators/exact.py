"""Sums that are the same to the last bit however the rows are laid out.

Float addition depends on its order, and the order on partitions and batches. Here every addend is rounded to a multiple of
2**-36 and added as an integer: in a task as 64-bit integers over a bounded number of rows, across tasks as decimals.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

SCALE = 2.0 ** 36
#: Addends of up to 1,000 in size cannot overflow 64 bits within this many rows.
ROWS = 100_000
CHUNK = 16_384
PARTIAL = "i int, v bigint"
BLOCK = "block"


def fixed(addends: np.ndarray) -> np.ndarray:
    return np.rint(addends * SCALE).astype(np.int64)


def blocks(rows: DataFrame, columns) -> DataFrame:
    """The rows as matrices of at most CHUNK rows, one in each row of the column BLOCK, column after column. Passes over a stored table
    of them read and hand over a few large values instead of every number."""
    columns = list(columns)

    def pack(batches):
        for pdf in batches:
            x = pdf[columns].to_numpy(dtype=float)
            yield pd.DataFrame({BLOCK: [x[at:at + CHUNK].tobytes(order="F") for at in range(0, len(x), CHUNK)]})

    return rows.select(*columns).mapInPandas(pack, f"{BLOCK} binary")


def row_sums(rows: DataFrame, columns, size: int, contributions) -> np.ndarray:
    """The `size` sums over all rows, or over the rows of `blocks`. `contributions(x)` gets a matrix of at most CHUNK rows, column
    after column in memory, and returns the sums of `fixed` addends, which must be computed row by row (matrix products over rows
    only of whole numbers whose sums stay below 2**53)."""
    width = len(list(columns))
    packed = rows if rows.columns == [BLOCK] else blocks(rows, columns)

    def partial(batches):
        held, total = 0, np.zeros(size, np.int64)
        for pdf in batches:
            for data in pdf[BLOCK]:
                if held + CHUNK > ROWS:
                    yield pd.DataFrame({"i": np.arange(size, dtype=np.int32), "v": total})
                    held, total = 0, np.zeros(size, np.int64)
                total = total + contributions(np.frombuffer(data).reshape(width, -1).T)
                held += CHUNK
        yield pd.DataFrame({"i": np.arange(size, dtype=np.int32), "v": total})

    out = np.zeros(size)
    for r in summed(packed.mapInPandas(partial, PARTIAL), ["i"]).collect():
        out[r["i"]] = float(r["v"]) / SCALE
    return out


def summed(partial: DataFrame, keys) -> DataFrame:
    """Exact sums of the fixed-point column `v` per key."""
    return partial.groupBy(*keys).agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
