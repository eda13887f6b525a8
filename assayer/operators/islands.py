"""Runs and clusters: rows in order that belong together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, key: list[str], order: list[str], same: str, name: str = "run") -> DataFrame:
    """Numbers the runs of rows of a key with the same value, from 1."""
    w = Window.partitionBy(*key).orderBy(*order)
    turn = F.coalesce((~F.col(same).eqNullSafe(F.lag(same).over(w))).cast("int"), F.lit(1))
    first = F.when(F.row_number().over(w) == 1, 1).otherwise(turn)
    return df.withColumn("__turn", first).withColumn(name, F.sum("__turn").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__turn")


def clusters(df: DataFrame, key: list[str], value: str, gap: float, tie: list[str], name: str = "cluster") -> DataFrame:
    """Numbers the clusters of a key's values, from 1: a step above the gap starts one."""
    w = Window.partitionBy(*key).orderBy(value, *tie)
    df = df.withColumn("__turn", F.coalesce((F.col(value) - F.lag(value).over(w) > gap).cast("int"), F.lit(1)))
    return df.withColumn(name, F.sum("__turn").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__turn")


def running(df: DataFrame, key: list[str], *order: Column | str) -> tuple[Window, Window]:
    """Frames from the first row to this one, and from this one to the last."""
    w = Window.partitionBy(*key).orderBy(*order)
    return w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
