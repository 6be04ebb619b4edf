"""Sinks: whole tables, slices and text exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition: list[str] | None = None, order: list[str] | None = None) -> None:
    """Replace a table; rows of a partition lie together, in order."""
    if partition:
        df = df.repartition(*partition).sortWithinPartitions(*partition, *(order or []))
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def overwrite_slice(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replace only the partitions that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def export_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated, a null as an empty field, without quotes."""
    flat = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    df.select(F.concat_ws("\t", *flat).alias("value")).write.mode("overwrite").text(path)
