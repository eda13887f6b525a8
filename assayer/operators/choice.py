"""Choice rules of papers: alternatives, best n of m, negative marks, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_alternative(df: DataFrame, group: list[str], mark: str, *order: str) -> DataFrame:
    """Adds `chosen`: the alternative with the highest mark, an earlier one on ties."""
    w = Window.partitionBy(*group).orderBy(F.desc(mark), *order)
    return df.withColumn("chosen", F.row_number().over(w) == 1)


def best_n(df: DataFrame, section: list[str], mark: str, n: int | Column, *order: str) -> DataFrame:
    """Adds `counted`: whether an item is among the n highest of its section, earlier ones first on ties."""
    w = Window.partitionBy(*section).orderBy(F.desc(mark), *order)
    return df.withColumn("place", F.row_number().over(w)).withColumn("counted", F.col("place") <= n)


def negative(earned: Column, penalty: Column) -> Column:
    """An item that earned nothing costs its penalty."""
    return F.when(earned == 0, -penalty).otherwise(earned)


def outcome(attempted: Column, chosen: Column, counted: Column) -> Column:
    return F.when(~attempted, "not attempted").when(~chosen, "other alternative scored higher").when(~counted, "not among the best").otherwise("counted")


def section_max(df: DataFrame, section: list[str], mark: str, n: int) -> DataFrame:
    """The sum of a section's n largest marks."""
    tops = F.slice(F.sort_array(F.collect_list(mark), asc=False), 1, n)
    return df.groupBy(*section).agg(F.aggregate(tops, F.lit(0).cast("decimal(28,4)"), lambda a, x: (a + x).cast("decimal(28,4)")).alias("section_max"))


def choice_rules(items: DataFrame, paper: str, section: str, slot: str, alternative: str, mark: str, n: int, *order: str) -> DataFrame:
    """Items with chosen, counted and outcome: of each slot the best alternative, of those the n best of a section."""
    chosen = best_alternative(items, [paper, section, slot], mark, alternative, *order)
    w = Window.partitionBy(paper, section, "chosen").orderBy(F.desc(mark), slot, alternative, *order)
    ranked = chosen.withColumn("place", F.row_number().over(w)).withColumn("counted", F.col("chosen") & (F.col("place") <= n))
    return ranked.withColumn("outcome", outcome(F.col(mark).isNotNull(), F.col("chosen"), F.col("counted")))
