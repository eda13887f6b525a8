"""Versioned rows: the newest of a key, what has none newer, and appending the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: list[str], *newest: Column) -> DataFrame:
    """One row a key: the first in the given order. Spark limits groups below the shuffle."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*newest))).where("__r = 1").drop("__r")


def latest_in_first_place(df: DataFrame, key: str, version: str, place: str, retired: Column) -> DataFrame:
    """The newest version of a key with the key's first place; retired ones go after the pick, so an older version never comes back."""
    w = Window.partitionBy(key)
    ranked = df.withColumn("first_place", F.min(place).over(w)).withColumn("__r", F.row_number().over(w.orderBy(F.desc(version))))
    return ranked.where("__r = 1").where(~retired).drop("__r")


def without_newer(df: DataFrame, key: str, version: str) -> DataFrame:
    """Rows for which no row of the same key has a larger version: an anti-join with a residual."""
    other = df.select(F.col(key).alias("__k"), F.col(version).alias("__v"))
    return df.join(other, (F.col(key) == F.col("__k")) & (F.col("__v") > F.col(version)), "left_anti")


def next_version(df: DataFrame, key: str, version: str) -> DataFrame:
    return df.groupBy(key).agg((F.coalesce(F.max(version), F.lit(0)) + 1).cast("long").alias("next_version"), F.count(version).alias("versions"))


def append_versions(base: DataFrame, new: DataFrame, key: str, version: str) -> tuple[DataFrame, DataFrame]:
    """New rows whose version is the one after the newest, and those that are refused."""
    top = base.groupBy(key).agg(F.max(version).alias("__top"))
    checked = new.join(top, key, "left").withColumn("__ok", F.col(version) == F.coalesce("__top", F.lit(0)) + 1)
    return checked.where("__ok").drop("__ok", "__top"), checked.where("NOT __ok").drop("__ok", "__top")
