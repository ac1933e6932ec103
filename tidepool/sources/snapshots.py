"""A panel as CSV files, one folder per date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_snapshots(panel: DataFrame, folder: str, places: int = 2) -> None:
    """Write the rows of each date, with numbers rounded, under `date=...`; all of a date's rows go through one task."""
    numbers = {c: F.round(c, places) for c, kind in panel.dtypes if kind == "double"}
    panel.withColumns(numbers).repartition("date").sortWithinPartitions("date", "symbol").write.mode("overwrite").partitionBy("date").option("header", True).csv(folder)


def read_snapshots(like: DataFrame, folder: str) -> DataFrame:
    """The panel that was written, with the columns and types of `like`."""
    inside = [f for f in like.schema.fields if f.name != "date"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inside) + ", date date"
    return like.sparkSession.read.schema(schema).option("header", True).csv(folder).select(*like.columns)
