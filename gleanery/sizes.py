"""Broadcasting with a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side of more rows than this is joined by a shuffle.
BROADCAST_ROWS = 50_000


#: What has been persisted to be counted, until release().
_kept: list[DataFrame] = []


def kept(df: DataFrame) -> DataFrame:
    """df, persisted until release(); for what is small, costs much and is read twice."""
    _kept.append(df.persist())
    return _kept[-1]


def release() -> None:
    """Frees what kept() has persisted so far; plans that read it compute it anew."""
    while _kept:
        _kept.pop().unpersist()


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, keep: bool = False) -> DataFrame:
    """A broadcast hint for a side of at most `rows` rows, else the side itself; counts no further than that.

    `keep` persists a side that costs much and is small, such as the best k
    rows of each query, so that counting it doesn't compute it twice.
    """
    if keep:
        df = kept(df)
        return F.broadcast(df) if df.count() <= rows else df
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
