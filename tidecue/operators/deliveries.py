"""Rows that were delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_delivery(df: DataFrame, key: str | list[str], arrived: str = "ingested_at") -> DataFrame:
    """One row per key: the delivery with the greatest arrival time.

    Deliveries are aggregated map-side before the shuffle, so a key that was
    sent any number of times costs one row per partition. A null arrival time
    counts as the earliest. Null keys form one group. Other columns are kept.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(keys)
    order = F.coalesce(F.col(f"`{arrived}`").cast("timestamp"), F.timestamp_seconds(F.lit(-10**10)))
    packed = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), order).alias("_row")
    grouped = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(packed)
    return grouped.select(*[F.col(f"`{k}`") for k in keys], *[F.col("_row").getField(c).alias(c) for c in rest]).select(*[F.col(f"`{c}`") for c in df.columns])
