"""Broadcast only what has been measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
#: Rows of a side that holds nothing but ids; the bytes bound it too.
BROADCAST_IDS = 2_000_000


def small_side(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Mark a dictionary-like side for broadcast when it really is small, in rows and in bytes.

    One bounded pass: it ends after ``max_rows + 1`` rows and adds up the length of each row
    as JSON, so a few rows with long texts count for what they hold.  A larger side keeps no
    hint and joins by shuffle, where adaptive execution splits skewed partitions.
    """
    measured = df.limit(max_rows + 1).agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("bytes"),
    ).first()
    if measured["rows"] <= max_rows and measured["bytes"] <= max_bytes:
        return F.broadcast(df)
    return df


def small_ids(ids: DataFrame) -> DataFrame:
    """The same for a side of one id column: more rows may travel, in as many bytes."""
    return small_side(ids, max_rows=BROADCAST_IDS)
