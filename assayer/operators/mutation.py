"""Changes of tables, as new tables: upserts, inserts that happen once, redaction, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(base: DataFrame, changes: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """Base with its rows replaced by changes of the same key, and new ones added; with a version column, a change counts only if its version is the base's next."""
    columns = [c for c in base.columns if c != key]
    new = changes.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__new"))
    both = base.withColumn("__old", F.lit(True)).join(new, key, "full")
    takes = F.col("__new").isNotNull()
    if version:
        takes &= F.col("__old").isNull() | (F.col(f"__{version}") == F.col(version) + 1)
    return both.select(key, *[F.when(takes, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def change_classes(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """created, updated and unchanged keys of changes."""
    columns = [c for c in base.columns if c != key]
    old = base.select(F.col(key), F.struct(*columns).alias("__o"))
    new = changes.select(F.col(key), F.struct(*columns).alias("__n"))
    state = F.when(F.col("__o").isNull(), "created").when(F.col("__o").eqNullSafe(F.col("__n")), "unchanged").otherwise("updated")
    return new.join(old, key, "left").select(key, state.alias("change"))


def insert_once(existing: DataFrame, new: DataFrame, key: list[str], *first: Column) -> DataFrame:
    """New rows whose key is neither in the table nor in a new row before."""
    from assayer.operators.latest import latest

    return latest(new, key, *first).join(existing.select(*key), key, "left_anti")


def redact(events: DataFrame, deleted: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Events with columns emptied where their subject was deleted."""
    gone = deleted.select(key).distinct().withColumn("__gone", F.lit(True))
    rows = events.join(gone, key, "left")
    return rows.select(*[F.when(F.col("__gone").isNull(), F.col(c)).alias(c) if c in columns else F.col(c) for c in events.columns])


def replace_children(base: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All children of the parents named in new are replaced by new's."""
    return base.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def rename_prefix(keys: DataFrame, col: str, old: str, new: str) -> DataFrame:
    """Distinct keys with a prefix, and the keys they become."""
    hits = keys.where(F.col(col).startswith(old)).select(col).distinct()
    return hits.withColumn("renamed", F.concat(F.lit(new), F.substring(F.col(col), len(old) + 1, 1 << 30)))


def plan_changes(wanted: DataFrame, live: DataFrame, key: str, content: str) -> DataFrame:
    """insert, new version, retire or keep of each key."""
    both = wanted.select(key, F.col(content).alias("__w"), F.lit(True).alias("__in")).join(live.select(key, F.col(content).alias("__l"), F.lit(True).alias("__has")), key, "full")
    what = F.when(F.col("__has").isNull(), "insert").when(F.col("__in").isNull(), "retire").when(~F.col("__w").eqNullSafe(F.col("__l")), "new version").otherwise("keep")
    return both.select(key, what.alias("what"))
