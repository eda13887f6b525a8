"""Tables staged in the cluster's shared folder."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; only where that is unset and executors are threads of the driver, as in tests, in a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = _OWN.setdefault("at", f"file://{tempfile.mkdtemp(prefix='spark-shared-')}")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written and read again: this cuts the lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Staged in buckets of a key, as many as a shuffle has parts. What is joined or grouped by the key, or by it and others within dealt_once(), isn't moved again."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    table = re.sub(r"\W", "_", path.rsplit("/", 1)[-1])
    df.write.option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # only the name: the files are ours
    return out


@contextlib.contextmanager
def dealt_once(spark: SparkSession) -> Iterator[None]:
    """Rows that lie together by some of a join's keys are not dealt again by all of them. Holds for what is executed within."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def by_key(df: DataFrame) -> DataFrame:
    """To be joined by sorting and merging, however small its files look: rows that repeat are files of a few MB and many times that as a broadcast, which the driver builds and holds."""
    return df.hint("merge")
