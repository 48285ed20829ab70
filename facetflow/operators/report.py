"""Sweep reports on runs(mode, mesh, target, threads, seconds)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What a complete sweep holds.
MODES = ["sequential", "partitioned_batch"]
MESHES = ["bunny", "buddha", "dragon"]
TARGETS = ["25%", "10%", "1%", "0.5%"]
THREADS = [1, 2, 4, 8, 16]
KEYS = ["mode", "mesh", "target"]


def sweep_matrix(spark: SparkSession, modes: list[str], meshes: list[str], targets: list[str], threads: list[int], logs: DataFrame | None = None) -> DataFrame:
    """Every run that a sweep makes: the product of four short lists, exploded from one row (or each row of logs)."""
    rows = spark.range(1).select() if logs is None else logs
    out = rows.select(*rows.columns, F.explode(F.array(*map(F.lit, modes))).alias("mode"))
    for name, values in (("mesh", meshes), ("target", targets), ("threads", threads)):
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out


def speedups(runs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """runs with speedup: the time with one thread over the time; runs without that baseline are dropped.
    Here and below, columns named in by (such as log_id) keep the runs of different logs apart."""
    base = runs.where("threads = 1").select(*by, *KEYS, F.col("seconds").alias("base"))
    return runs.join(base, [*by, *KEYS]).select(*by, *KEYS, "threads", "seconds", F.try_divide("base", "seconds").alias("speedup"))


def time_pivot(runs: DataFrame, targets: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Times with one thread: a row for each mode and mesh, a column for each target, null where missing."""
    names = {t: "t_" + t.rstrip("%").replace(".", "p") for t in targets}
    wide = runs.where("threads = 1").groupBy(*by, "mode", "mesh").pivot("target", targets).agg(F.first("seconds"))
    return wide.select(*by, "mode", "mesh", *(F.col(f"`{t}`").alias(n) for t, n in names.items()))


def missing_runs(runs: DataFrame, expected: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Runs of expected(*by, mode, mesh, target, threads) that runs lacks."""
    return expected.join(runs, [*by, *KEYS, "threads"], "left_anti")


def missing_names(runs: DataFrame, by: tuple[str, ...] = (), targets: list[str] = TARGETS, meshes: list[str] = MESHES, threads: list[int] = THREADS) -> DataFrame:
    """(*by, mode, kind, value): targets, meshes and thread counts that no run of a mode has."""
    wanted = {"target": targets, "mesh": meshes, "threads": [str(n) for n in threads]}
    seen = runs.groupBy(*by, "mode").agg(*(F.collect_set(F.col(k).cast("string")).alias(k) for k in wanted))  # few names each
    lacking = [F.struct(F.lit(k).alias("kind"), F.array_except(F.array(*map(F.lit, values)), F.col(k)).alias("values")) for k, values in wanted.items()]
    return seen.select(*by, "mode", F.inline(F.array(*lacking))).select(*by, "mode", "kind", F.explode("values").alias("value"))


def missing_baselines(runs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(mode, mesh, target) combinations of what runs holds without a run with one thread."""
    lists = runs.groupBy(*by).agg(*(F.collect_set(c).alias(c) for c in KEYS))  # the different names of a sweep are few
    every = lists.select(*by, F.explode("mode").alias("mode"), "mesh", "target").select(*by, "mode", F.explode("mesh").alias("mesh"), "target").select(*by, "mode", "mesh", F.explode("target").alias("target"))
    return every.join(runs.where("threads = 1"), [*by, *KEYS], "left_anti")


def ranked(values: DataFrame, column: str, expected: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """The different values in report order: expected ones as listed, then the rest by name (column rank)."""
    place = F.array_position(F.array(*map(F.lit, expected)), F.col(column))
    return values.select(*by, column).distinct().withColumn("rank", F.when(place > 0, place).otherwise(len(expected) + 1)).orderBy(*by, "rank", column)


def thread_counts(runs: DataFrame) -> DataFrame:
    """The different thread counts, ascending."""
    return runs.select("threads").distinct().orderBy("threads")


def first_seen(rows: DataFrame, column: str, position: str) -> DataFrame:
    """The different values in the order in which they first appear."""
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(position).alias(position)).orderBy(position)


def render_jobs(outputs: DataFrame, meshes: list[str], threads: list[int], targets: list[str]) -> DataFrame:
    """Pictures to make: outputs(mesh, target, threads, path) for the wanted combinations."""
    return outputs.where(F.col("mesh").isin(meshes) & F.col("threads").isin(threads) & F.col("target").isin(targets))
