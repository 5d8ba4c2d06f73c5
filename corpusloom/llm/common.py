"""What the operators share: the shared folder, skew-safe joins, checked broadcasts, word rules."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import shutil
import sys
import tempfile
import types
import uuid
import weakref

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the quality, dedup and mixing operators: a run of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Rows of a lookup table that may be broadcast; above it, joins shuffle.
BROADCAST_ROWS = 200_000
#: A key is hot when it has more than one in so many of all rows, so there are at most as many hot keys.
HOT_SHARE = 2_000


#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 8 << 20


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or in local mode our own where it is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="corpusloom-")
        weakref.finalize(spark.sparkContext, shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Lowers this session's bound on the bytes of an Arrow batch to BATCH_BYTES: the default lets 64 MB of long texts into a worker at once."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def in_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """df.mapInArrow(function, schema), whose workers give free memory back when a task ends: an executor keeps its idle workers."""
    return df.mapInArrow(lambda batches: _tidied(function, batches), schema)


def _tidied(function, batches):
    try:
        yield from function(batches)
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has it
            ctypes.CDLL(None).malloc_trim(0)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/corpusloom-{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def unique_column(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def join_lookup(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Joins a lookup table that has each key once, whatever share of big's rows one key has.

    A counted size of at most `limit` rows is broadcast. Beyond it, big's rows are dealt over salts and the
    lookup rows repeated for each salt, so no key meets in one task.
    """
    if small.limit(limit + 1).count() <= limit:
        return big.join(F.broadcast(small), keys, how)
    salts = 16
    salt = unique_column(big, "salt")
    left = big.withColumn(salt, (F.rand(7) * salts).cast("int") if how == "inner" else F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    right = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, salt], how).drop(salt)


def join_hot(big: DataFrame, small: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join on one key; small has each key once, with big's rows of that key in the column `count`.

    Keys with more than a HOT_SHARE-th of all rows are at most HOT_SHARE by arithmetic: those few are
    broadcast. The rest have no hot key and are shuffled.
    """
    least = max(1, total // HOT_SHARE)
    hot = small.filter(F.col(count) > least)
    cold = small.filter(F.col(count) <= least)
    few = hot.select(key).withColumn("_hot", F.lit(True))
    marked = big.join(F.broadcast(few), key, "left")
    return (
        marked.filter(F.col("_hot")).drop("_hot").join(F.broadcast(hot), key)
        .unionByName(marked.filter(F.col("_hot").isNull()).drop("_hot").join(cold, key))
    )


def worker_state(name: str, make):
    """Something dear that tasks of one Python worker share, such as a tokenizer: made once in each process."""
    held = sys.modules.setdefault("corpusloom_worker_state", types.ModuleType("corpusloom_worker_state"))
    if not hasattr(held, name):
        setattr(held, name, make())
    return getattr(held, name)


def strings(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; null as empty."""
    return [x or "" for x in column.to_pylist()]


def words_expr(text):
    """The words of a text column (WORD) as an array; null: none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def n_words_expr(text):
    """The number of words (WORD) without keeping them: runs of white space are cut to one space first."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    body = F.trim(flat)
    spaces = F.length(body) - F.length(F.replace(body, F.lit(" "), F.lit("")))
    return F.when(body == "", F.lit(0)).otherwise(spaces + 1).cast("long")
