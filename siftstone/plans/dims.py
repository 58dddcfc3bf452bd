"""Joins with look-up tables whose size is checked before they are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a look-up table is broadcast; a longer one is joined by shuffle.
BROADCAST_ROWS = 50_000


def sized(dim: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``dim`` with a broadcast hint if it has at most ``rows`` rows, else unchanged."""
    return F.broadcast(dim) if dim.limit(rows + 1).count() <= rows else dim
