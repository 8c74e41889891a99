"""Writers. None of them overwrites unless asked to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from platewise.sources.feature_store import write_plates


def sink_by_plate(df: DataFrame, path: str, key: str = "plate", mode: str = "errorifexists") -> None:
    """One directory per plate, or shared files sorted by plate for many. ``mode='ignore'`` keeps what is already there."""
    write_plates(df, path, [], key, mode)


def sink_subset(df: DataFrame, condition: Column, path: str, mode: str = "errorifexists") -> None:
    """Rows of one drug (or any condition) to their own table."""
    df.where(condition).write.mode(mode).parquet(path)


def sink_csv(df: DataFrame, path: str, sep: str = ",", single_file: bool = False, mode: str = "errorifexists") -> None:
    """Result table as CSV. ``single_file`` is for small reports only: it uses one task."""
    (df.coalesce(1) if single_file else df).write.mode(mode).option("header", True).option("sep", sep).csv(path)
