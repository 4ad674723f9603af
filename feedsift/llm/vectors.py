"""What the two operators on vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Not null, no null or non-finite component, and not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def dimension(df: DataFrame, vector: str) -> int:
    """The commonest size of the usable vectors (the smaller of equals; 0 without any)."""
    sizes = df.filter(usable(vector)).groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    found = sizes.orderBy(F.desc("n"), "d").first()
    return int(found["d"]) if found else 0


def matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    """Rows of a list column, each of size d, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def rotations(d: int, n: int, seed: int) -> np.ndarray:
    """n random orthogonal matrices of size d, below each other: (n d, d)."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.linalg.qr(rng.standard_normal((d, d)))[0] for _ in range(n)])
