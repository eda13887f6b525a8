"""Steps of a batch that a later run takes up where an earlier one ended."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "step string, path string"


def run(spark: SparkSession, folder: str, steps: list[tuple[str, Callable[[DataFrame | None], DataFrame]]]) -> DataFrame:
    """Each step's table, made from the one before, is written to the shared folder and then entered in a log. A step that is in the log is read and not made again; one that was cut off has no entry and is made anew."""
    log = f"{folder}/log"
    spark.createDataFrame([], LOG).write.mode("append").parquet(log)
    done = {r["step"]: r["path"] for r in spark.read.schema(LOG).parquet(log).collect()}  # a row a step
    table: DataFrame | None = None
    for name, make in steps:
        path = f"{folder}/{name}"
        if name not in done:
            make(table).write.mode("overwrite").parquet(path)
            spark.createDataFrame([(name, path)], LOG).write.mode("append").parquet(log)
        table = spark.read.parquet(path).withColumn("__step", F.lit(name)).drop("__step")
    return table


ENTRIES = "step string, batch string"


def advance(spark: SparkSession, folder: str, key: str, arrived: DataFrame, steps: list[tuple[str, Callable[[DataFrame], DataFrame]]], parts: int = 1) -> DataFrame:
    """The last step's rows of all ids that have come so far. A ledger says which ids a step has done, so that a run takes only those that wait: ids of the step before (of arrived(key), for the first) that are not among the step's own. make(ids) gives a step's rows of these ids, with the key as a column; the tables of earlier steps can be read with done().

    Waiting ids go in `parts` by their hash, each written as a batch and then entered in the ledger. A batch without an entry is as if it had never been: what was cut off is done again, and no id is done twice. One run at a time may advance a folder.
    """
    before = arrived.select(key).where(F.col(key).isNotNull()).distinct()
    for name, make in steps:
        waiting = before.join(done(spark, folder, name, key), key, "left_anti")
        for part in range(parts):
            mine = waiting.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part)
            if mine.isEmpty():
                continue
            batch = uuid.uuid4().hex
            made = make(mine)
            made.write.parquet(f"{folder}/{name}/batch={batch}")
            mine.join(made.select(key).distinct(), key, "left_anti").write.parquet(f"{folder}/{name}-none/batch={batch}")  # ids that gave no row are done as well
            spark.createDataFrame([(name, batch)], ENTRIES).coalesce(1).write.mode("append").parquet(f"{folder}/ledger")
        before = done(spark, folder, name, key)
    return rows_of(spark, folder, steps[-1][0])


def _batches(spark: SparkSession, folder: str, name: str) -> list[str]:
    """A step's batches in the ledger, a row a run and part."""
    spark.createDataFrame([], ENTRIES).write.mode("append").parquet(f"{folder}/ledger")
    return [r["batch"] for r in spark.read.schema(ENTRIES).parquet(f"{folder}/ledger").where(F.col("step") == name).collect()]


def done(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    """The ids that a step has done."""
    batches = _batches(spark, folder, name)
    if not batches:
        return spark.createDataFrame([], f"{key} long")
    every = spark.read.parquet(*(f"{folder}/{name}/batch={b}" for b in batches)).select(key)
    return every.union(spark.read.parquet(*(f"{folder}/{name}-none/batch={b}" for b in batches)).select(key)).distinct()


def rows_of(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A step's rows, of all its batches."""
    return spark.read.parquet(*(f"{folder}/{name}/batch={b}" for b in _batches(spark, folder, name)))
