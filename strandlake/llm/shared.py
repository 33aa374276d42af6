"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space and the control characters 0x09-0x0D end a word; bytes.split() cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="strandlake-")


def _own_machine(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that driver and executors share (spark.checkpoint.dir).

    Only where the session names none and driver and executors are one process, as in tests, a folder
    of this machine is used; on a cluster that is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not _own_machine(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base or _own_folder()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Rows that go to a Python worker at a time: Spark's own 10,000 whole texts would be held by the JVM, by Arrow
#: and by the worker at once.
BATCH_ROWS = 2000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Whether Spark removes the shuffle files of a query when it ends. Otherwise they stay until the driver happens to
#: collect its garbage, which takes long in a stage of many tables, however much disk they fill.
_CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _writing(spark: SparkSession):
    """What is planned and run within hands at most BATCH_ROWS rows to Python at a time, and leaves no shuffle files."""
    own = {_CLEANUP_CONF: "true"}
    if not 0 < int(spark.conf.get(_BATCH_CONF)) <= BATCH_ROWS:
        own[_BATCH_CONF] = str(BATCH_ROWS)
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@lru_cache(maxsize=1)
def _trim() -> Callable:
    """glibc's malloc_trim; where there is none, nothing."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError, TypeError):
        return lambda _: 0


def give_back() -> None:
    """Hand memory that Arrow and malloc keep for later to the machine: a worker outlives its tasks and
    shares the executor's memory with all that follows."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def lean(run: Callable) -> Callable:
    """The same function of batches for mapInArrow; its worker keeps no unused memory between results or after them."""

    @wraps(run)
    def held(batches):
        for out in run(batches):
            yield out
            del out
            give_back()
        give_back()

    return held


def materialise(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder, or one within it, and read it back: lineage ends here, and what
    was shuffled for it is removed."""
    path = f"{folder}/{label}-{uuid.uuid4().hex}" if folder else scratch_dir(df.sparkSession, label)
    with _writing(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, folder: str) -> None:
    """Remove a folder that scratch_dir gave, once all that is made from its tables has been written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_hot(rows: DataFrame, groups: DataFrame, keys: list[str], n: str, most: int = 4096) -> DataFrame:
    """Inner join of rows with groups (one row a key, n of the rows have it), with no key in one task.

    Groups of more than 1 / most of all rows are fewer than most, so they are broadcast, and their rows
    stay where they are; the others are joined by key.
    """
    total = groups.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    hot = F.broadcast(groups.where(F.col(n) * most > total))
    known = rows.join(hot, keys)
    return known.unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(groups.where(F.col(n) * most <= total), keys))


def join_salted(rows: DataFrame, table: DataFrame, key: str, spread: str, most: int = 4096, share: int = 256, folder: str | None = None) -> DataFrame:
    """Inner join of rows with a table of one row a key, no key's rows in one task and nothing of the table broadcast.

    A share is 1 / most of all rows, or share rows where that is more.  Keys that more rows name are fewer
    than most; only these keys are broadcast, and their rows are dealt by the hash of spread to one copy of
    the table's row for each share, less than 2 * most copies in all.  A null key joins nothing.
    """
    counts = materialise(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")), "key-counts", folder)
    unit = max(counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // most, share)
    hot = F.broadcast(counts.where(F.col("n") > unit).select(key, F.ceil(F.col("n") / unit).cast("int").alias("__shares")))
    shares = F.coalesce("__shares", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("__share", F.pmod(F.xxhash64(spread), shares).cast("int")).drop("__shares")
    copies = table.join(hot, key, "left").withColumn("__share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("__shares")
    return dealt.join(copies, [key, "__share"]).drop("__share")


def utf8_bytes(text: Column) -> Column:
    """Bytes of the text in UTF-8; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, unlike lower(), which follows Unicode."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
