"""Running numbers and sums within keys, without a task that holds a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_offsets(rows: DataFrame, keys: list[str], bucket: str, amount: Column) -> DataFrame:
    """Per key and bucket the sum of amount in the key's earlier buckets, as offset_.

    Buckets are counted before they are put in order, so the window sees at most as many rows a key as there are buckets."""
    totals = rows.groupBy(*keys, bucket).agg(F.sum(amount).alias("total_"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, bucket, F.coalesce(F.sum("total_").over(before), F.lit(0)).alias("offset_"))
