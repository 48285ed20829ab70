"""Shuffled data goes once the table that it was for is stored."""

import time
from pathlib import Path

from facetflow.operators import tables


def shuffled(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {str(p) for d in manager.localDirs() for p in Path(d.getPath()).rglob("shuffle_*.data")}


def test_shuffle_files_go_with_the_write_and_the_table_stays(spark):
    old, before = spark.conf.get(tables._CLEANUP), shuffled(spark)
    df = spark.range(10_000).selectExpr("id % 100 as k", "id").groupBy("k").sum("id").withColumnRenamed("sum(id)", "n")
    out = tables.stored(df, "sums")
    for _ in range(100):  # they are deleted in the background
        if not shuffled(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffled(spark) - before
    assert spark.conf.get(tables._CLEANUP) == old
    # the frame that was stored can be used, and stored, again
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in df.collect()} == {tuple(r) for r in tables.stored(df, "again").collect()}
