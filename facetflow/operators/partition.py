"""Spatial slabs, and how edges and candidates fall into them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetflow.operators.tables import stored

#: The least span that slabs are cut from.
LEAST_SPAN = 1e-12


def bounding_box(vertices: DataFrame) -> DataFrame:
    """(mesh_id, n, min and max by axis, axis): the longest axis, the first of equals."""
    box = vertices.groupBy("mesh_id").agg(F.count("*").alias("n"), *(f(c).alias(f"{name}_{c}") for c in "xyz" for name, f in (("min", F.min), ("max", F.max))))
    sx, sy, sz = (F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz")
    axis = F.when((sx >= sy) & (sx >= sz), "x").when(sy >= sz, "y").otherwise("z")
    return box.withColumn("axis", axis)


def slab_partitions(vertices: DataFrame, parts: int) -> DataFrame:
    """(mesh_id, vid, part): equal slabs along the longest axis, the last closed; at most one a vertex."""
    box = bounding_box(vertices)
    pick = lambda prefix: F.when(F.col("axis") == "x", F.col(f"{prefix}x")).when(F.col("axis") == "y", F.col(f"{prefix}y")).otherwise(F.col(f"{prefix}z"))
    bounds = box.select("mesh_id", "axis", pick("min_").alias("low"), F.greatest(pick("max_") - pick("min_"), F.lit(LEAST_SPAN)).alias("span"), F.least(F.lit(parts), F.col("n")).alias("p"))
    share = F.least(F.greatest((pick("") - F.col("low")) / F.col("span"), F.lit(0.0)), F.lit(1.0))
    part = F.least(F.col("p") - 1, F.floor(share * F.col("p"))).cast("int")
    # one row a mesh, stored: the join knows its size, and sends it to the vertices while it is small
    bounds = stored(bounds, "bounds")
    return vertices.join(bounds, "mesh_id").select("mesh_id", "vid", part.alias("part"))


def partition_counts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("mesh_id", "part").agg(F.count("*").alias("vertices"))


def edge_classes(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """edges(mesh_id, hi, lo, o1, o0, ...) with part: that of all four corners, null (boundary) where they
    differ or one has none, as vertices made since the last partitioning."""
    corners = edges.select(*edges.columns, F.explode(F.array("hi", "lo", "o1", "o0")).alias("_v"))
    known = corners.join(parts.select("mesh_id", F.col("vid").alias("_v"), F.col("part").alias("_p")), ["mesh_id", "_v"], "left")
    seen = known.groupBy(*edges.columns).agg(F.min("_p").alias("_least"), F.max("_p").alias("_most"), F.count("_p").alias("_n"))
    same = (F.col("_n") == 4) & (F.col("_least") == F.col("_most"))
    return seen.select(*edges.columns, F.when(same, F.col("_least")).alias("part"))


def class_counts(classified: DataFrame) -> DataFrame:
    """(mesh_id, interior, boundary and their fractions)."""
    counts = classified.groupBy("mesh_id").agg(F.count("part").alias("interior"), F.count_if(F.col("part").isNull()).alias("boundary"))
    total = F.col("interior") + F.col("boundary")
    return counts.withColumns({f"{k}_fraction": F.coalesce(F.try_divide(F.col(k), total), F.lit(0.0)) for k in ("interior", "boundary")})


def load_imbalance(classified: DataFrame, parts: int) -> DataFrame:
    """(mesh_id, most, least, imbalance) of candidates in all slabs, empty ones too: most / least; 1 if all
    are empty; the most itself if only some are."""
    counts = classified.where(F.col("part").isNotNull()).groupBy("mesh_id", "part").agg(F.count("*").alias("n"))
    some = counts.groupBy("mesh_id").agg(F.max("n").alias("most"), F.min("n").alias("few"), F.count("*").alias("filled"))
    zero = F.lit(0).cast("long")
    every = classified.select("mesh_id").distinct().join(some, "mesh_id", "left")
    most = F.coalesce("most", zero)
    least = F.when(F.coalesce("filled", zero) < parts, zero).otherwise(F.col("few"))
    out = every.select("mesh_id", most.alias("most"), least.alias("least"))
    imbalance = F.when(F.col("most") == 0, 1.0).when(F.col("least") == 0, F.col("most").cast("double")).otherwise(F.try_divide(F.col("most"), F.col("least")))
    return out.withColumn("imbalance", imbalance)


def partition_topk(classified: DataFrame, k: int) -> DataFrame:
    """The k cheapest interior candidates of each slab, with their place."""
    order = Window.partitionBy("mesh_id", "part").orderBy(F.round("cost", 6) + F.lit(0.0), "hi", "lo")
    return classified.where(F.col("part").isNotNull()).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
