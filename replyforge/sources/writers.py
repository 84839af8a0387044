"""Writing stage tables, CSV exports and metric files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_stage(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Parquet between jobs; partition by brand when jobs read one brand."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def export_csv(df: DataFrame, path: str, order_by: tuple[str, ...] = ()) -> None:
    """CSV export that ``read_csv`` reads back, newlines and quotes included.

    With ``order_by`` the files follow each other in that order (a range
    exchange and a sort per file, not one task).
    """
    (df.orderBy(*order_by) if order_by else df).write.mode("overwrite").options(
        header="true", quote='"', escape='"',
        ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false",
    ).csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    """More files for a CSV folder; their columns need not be those that are there."""
    df.write.mode("append").options(
        header="true", quote='"', escape='"',
        ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false",
    ).csv(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """A one-row frame holding one JSON text becomes one JSON record."""
    df.write.mode("overwrite").text(path)
