"""Pages, feeds and limited search groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_with_total(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page, each row with the number of all rows; the count is an aggregate of its own, as an unpartitioned window would bring every row to one task."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row on the right


def matching(conditions: list[Column | None]) -> Column:
    """The conjunction of the conditions that are given."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def contains_ci(col: Column | str, term: str) -> Column:
    """Whether a column holds the term in any case; % and _ are ordinary characters."""
    return F.contains(F.lower(F.col(col) if isinstance(col, str) else col), F.lit(term.lower()))


def search_groups(groups: list[tuple[str, DataFrame, Column, Column]], per_group: int = 5) -> DataFrame:
    """At most `per_group` hits of each (group, rows, key, text), by text ignoring case and key."""
    hits = [rows.select(F.lit(name).alias("hit_group"), key.cast("string").alias("key"), text.alias("hit")).orderBy(F.lower("hit"), "key").limit(per_group) for name, rows, key, text in groups]
    return reduce(DataFrame.unionByName, hits)


def numbered(df: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """df with the place of each row in an order, from 1. Rows are sorted in ranges; a range's first place comes from the sizes of the ranges before, a row a range."""
    from assayer.sources.shared import staged

    ranged = staged(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("__n")).withColumn("__one", F.lit(0))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__one").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return ranged.withColumn("__i", inside).join(sizes.select("__p", before.alias("__b")), "__p").withColumn(name, F.col("__b") + F.col("__i")).drop("__p", "__i", "__b")
