"""What the operators share: the cluster's shared folder, staged tables, folds and pinned columns."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: Hashes of repeated rows that are broadcast at most; copies of a row that one task writes together.
SENT, RUN = 100_000, 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where that is unset and the executors are threads of the driver, as in tests, it is a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = _OWN.setdefault("at", f"file://{tempfile.mkdtemp(prefix='spark-shared-')}")
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it again: this cuts the lineage, and lost executors lose nothing of it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Gives freed memory back to the system. Python workers stay behind a task, and what their allocators hold counts as the executor's memory."""
    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def releasing(f: Callable) -> Callable:
    """f, which gives its memory back after its own variables are gone: what they hold can't be given back from within. Spark looks at a function's arguments, so it needs a lambda that names them."""

    @functools.wraps(f)
    def run(*args):
        out = f(*args)
        release()
        return out

    return run


def small_batches(spark: SparkSession) -> None:
    """Documents may be long: a thousand of them make a batch for Python, not ten thousand, unless the session has fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= 1000:
        spark.conf.set(name, "1000")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def text_bytes(col: str = "text") -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")


def collapsed(rows: DataFrame, size: Column) -> tuple[DataFrame, Row]:
    """Every distinct row once, with row_hash and the number of its copies; and bytes (the sum of `size` over distinct rows), all_bytes (over all) and again (hashes that occur more than once).

    A hash only names the rows to compare: these are grouped by all their columns, with partial counts, so a row with any number of copies is one row a task. Where more than SENT hashes occur again, all rows are grouped.
    """
    columns = rows.columns
    rows = rows.withColumn("row_hash", F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))]))
    keys = staged(rows.groupBy("row_hash").agg(F.count("*").alias("copies"), F.first(size).alias("bytes"), F.sum(size).alias("all_bytes")), "row-hashes")
    seen = keys.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("all_bytes"), F.lit(0)).alias("all_bytes"), F.count_if(F.col("copies") > 1).alias("again")).first()
    if not seen["again"]:
        return rows.withColumn("copies", F.lit(1).cast("long")), seen
    counted = lambda x: x.groupBy("row_hash", *columns).agg(F.count("*").alias("copies")).select(*columns, "row_hash", "copies")
    if seen["again"] > SENT:
        return counted(rows), seen
    again = F.broadcast(keys.where("copies > 1").select("row_hash"))  # SENT rows of 8 bytes at most
    once = rows.join(again, "row_hash", "left_anti").select(*columns, "row_hash", F.lit(1).cast("long").alias("copies"))
    return once.unionByName(counted(rows.join(again, "row_hash", "left_semi"))), seen


def expanded(rows: DataFrame, again: int) -> DataFrame:
    """Every row as often as `copies` says, with the number of the copy from 0 on. Copies are dealt to tasks in runs of RUN. again: whether any row has copies at all."""
    if not again:
        return rows.drop("copies").withColumn("copy", F.lit(0).cast("long"))
    rows = staged(rows, "copies")
    runs = rows.where("copies > 1").withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(RUN).cast("long"))))
    runs = runs.repartition("row_hash", "__from") if "row_hash" in rows.columns else runs.repartition(F.xxhash64(*rows.columns), "__from")
    more = runs.withColumn("copy", F.explode(F.sequence("__from", F.least(F.col("__from") + RUN, F.col("copies")) - 1)))
    return rows.where("copies = 1").withColumn("copy", F.lit(0).cast("long")).unionByName(more.drop("__from")).drop("copies")


def sample_share(bound: int, there: int) -> float:
    """Share of rows that makes about `bound` of them."""
    return 1.0 if there <= bound else bound / there


def hashed_share(key: Column, share: float, seed: int = 0) -> Column:
    """Picks a share of the rows by a hash of their key: the same rows in each run."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))
