"""Tables in the shared folder, and running numbers that no single task has to see whole."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Positions that one window partition may hold.
BLOCK = 1 << 16

#: Where stored tables lie, and lists of those made in the open scopes of this thread, the outermost first.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_SCOPES: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scopes", default=())
#: Tables that nobody deleted yet: they go with the driver.
_LEFT: set[str] = set()
#: Whether the files of a query's shuffles go as it ends, not only when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is made only in local mode, where none is set, and goes
    with the driver."""
    context = spark.sparkContext
    where = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = getattr(context, "_facetflow_dir", None)
        if where is None:
            where = context._facetflow_dir = tempfile.mkdtemp(prefix="facetflow-")
            atexit.register(shutil.rmtree, where, ignore_errors=True)
    return where


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str = "table") -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage and survives lost executors.

    What was shuffled on the way isn't needed once the table lies there, and is deleted with that."""
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    noted(spark, path)
    return out


def noted(spark: SparkSession, path: str) -> None:
    """Has what lies at a path of the shared folder deleted with the open scopes, or else with the driver."""
    if not _LEFT:
        atexit.register(_delete_left, spark._jvm, spark._jsc.hadoopConfiguration())
    _LEFT.add(path)
    for made in _SCOPES.get():
        made.append(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a path of any file system, with all below it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _LEFT.discard(path)


def _delete_left(jvm, configuration) -> None:
    for path in _LEFT:
        with contextlib.suppress(Exception):  # the session may be gone before the driver
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(configuration).delete(where, True)
    _LEFT.clear()


def discard(*tables: DataFrame | None) -> None:
    """Deletes stored tables that nothing needs any more; other frames are left alone."""
    for table in tables:
        if table is not None and (path := _PATHS.pop(table, None)):
            delete(table.sparkSession, path)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes, at its end, what was stored within it, but for tables passed to the function it gives:

    with scope(spark) as keep:
        result = keep(stored(query(spark, folder)))

    Frames that still read the deleted tables must have been used before.
    """
    made: list[str] = []
    kept: set[str] = set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(_PATHS[table])
        return table

    token = _SCOPES.set((*_SCOPES.get(), made))
    try:
        yield keep
    finally:
        _SCOPES.reset(token)
        for path in made:
            if path not in kept:
                delete(spark, path)


def running_sum(df: DataFrame, keys: list[str], position: str, value: Column, name: str) -> DataFrame:
    """df with the sum of value over rows of its keys up to and with its own, by position (unique, not
    negative).  Sums run within blocks of positions; only a row for each block meets in one window."""
    block = F.floor(F.col(position) / BLOCK).cast("long")
    rows = df.withColumn("_block", block).withColumn("_value", value.cast("long"))
    sums = rows.groupBy(*keys, "_block").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*keys, "_block").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(offsets, [*keys, "_block"]).withColumn(name, F.col("_offset") + F.sum("_value").over(within))
    return out.drop("_block", "_value", "_offset")


def numbered(df: DataFrame, keys: list[str], position: str, name: str) -> DataFrame:
    """df with 0, 1, 2, ... in the order of position, for each of the keys."""
    return running_sum(df, keys, position, F.lit(1), "_n").withColumn(name, F.col("_n") - 1).drop("_n")


def placed(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """df with 1, 2, 3, ... in a total order, for each of the keys.

    Rows are dealt by ranges of the order, and stored, as ranges are drawn anew whenever they are computed;
    a key with any number of rows is counted a range at a time.
    """
    ordered = df.withColumns({f"_o{i}": c for i, c in enumerate(order)})
    by = [f"_o{i}" for i in range(len(order))]
    rows = stored(ordered.repartitionByRange(*keys, *by).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = rows.groupBy(*keys, "_range").agg(F.count("*").alias("_count"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_range", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*by))
    return rows.join(offsets, [*keys, "_range"]).withColumn(name, F.col("_offset") + within).select(*df.columns, name)
