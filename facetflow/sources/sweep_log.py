"""Benchmark logs as rows: a header for each run, then its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetflow.operators.tables import BLOCK

# The two line formats.  A time has no exponent.
HEADER = r"^Running(?:\s+mode=(\S+))?\s+mesh=(\S+)\s+target_vertices=(\S+)\s+threads=(\d+)(?:\s+partitions=(\d+))?\s*$"
TIME = r"^Simplification time:\s*([0-9]+(?:\.[0-9]+)?)\s*s\s*$"
DEFAULT_MODE = "sequential"


def events(lines: DataFrame) -> DataFrame:
    """(log_id, line_no, kind, mode, mesh, target, threads, seconds) of the header and time lines of
    lines(log_id, line_no, line)."""
    line = F.trim("line")
    part = lambda k: F.regexp_extract(line, HEADER, k)
    found = lines.withColumn("kind", F.when(line.rlike(HEADER), "run").when(line.rlike(TIME), "time")).where(F.col("kind").isNotNull())
    run = F.col("kind") == "run"
    return found.select(
        "log_id", "line_no", "kind",
        F.when(run, F.when(part(1) == "", DEFAULT_MODE).otherwise(part(1))).alias("mode"), F.when(run, part(2)).alias("mesh"), F.when(run, part(3)).alias("target"),
        F.when(run, part(4).cast("int")).alias("threads"), F.when(~run, F.regexp_extract(line, TIME, 1).cast("double")).alias("seconds"),
    )


def paired(lines: DataFrame) -> DataFrame:
    """Each time with the run before it, if that is the event before; a header serves one time.

    Events meet within blocks of lines; only the last event of each block goes on to the next one.
    """
    found = events(lines).withColumn("_block", F.floor(F.col("line_no") / BLOCK).cast("long"))
    own = F.struct("kind", "mode", "mesh", "target", "threads")
    order = Window.partitionBy("log_id", "_block").orderBy("line_no")
    ends = found.groupBy("log_id", "_block").agg(F.max_by(own, "line_no").alias("_last"))
    carried = ends.select("log_id", "_block", F.lag("_last").over(Window.partitionBy("log_id").orderBy("_block")).alias("_carried"))
    within = found.withColumn("_before", F.lag(own).over(order)).where("kind = 'time'")
    before = F.coalesce("_before", "_carried")
    times = within.join(carried, ["log_id", "_block"]).withColumn("_before", before)
    return times.select("log_id", "line_no", F.coalesce(F.col("_before.kind") == "run", F.lit(False)).alias("has_run"), *(F.col(f"_before.{c}").alias(c) for c in ("mode", "mesh", "target", "threads")), "seconds")


def sessions(lines: DataFrame) -> DataFrame:
    """(log_id, mode, mesh, target, threads, seconds): of runs that repeat, the last time counts."""
    return paired(lines).where("has_run").groupBy("log_id", "mode", "mesh", "target", "threads").agg(F.max_by("seconds", "line_no").alias("seconds"))


def warnings(lines: DataFrame) -> DataFrame:
    """(log_id, orphans, duplicates, unfinished): times without a run, repeated runs, a last run without time."""
    rows = paired(lines)
    runs = rows.where("has_run").groupBy("log_id", "mode", "mesh", "target", "threads").agg((F.count("*") - 1).alias("more"))
    last = events(lines).groupBy("log_id").agg(F.max_by("kind", "line_no").alias("last"))
    orphans = rows.groupBy("log_id").agg(F.count_if(~F.col("has_run")).alias("orphans"))
    zero = F.lit(0).cast("long")
    joined = last.join(orphans, "log_id", "left").join(runs.groupBy("log_id").agg(F.sum("more").alias("duplicates")), "log_id", "left")
    return joined.select("log_id", F.coalesce("orphans", zero).alias("orphans"), F.coalesce("duplicates", zero).alias("duplicates"), (F.col("last") == "run").alias("unfinished"))
