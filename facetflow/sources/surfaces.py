"""Surfaces derived from a table of parts: an open terrain and a closed shell around it.

vertices(mesh_id, vid, x, y, z) and faces(mesh_id, fid, v0, v1, v2), least id first, winding kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetflow.functions.vecmath import least_first
from facetflow.operators.tables import numbered

VERTEX_SCHEMA = "mesh_id string, vid long, x double, y double, z double"
FACE_SCHEMA = "mesh_id string, fid long, v0 long, v1 long, v2 long"
#: How far the shell's lower layer lies below the upper one.
DEPTH = 10.0


@dataclass
class Surface:
    vertices: DataFrame
    faces: DataFrame


def turned(faces: DataFrame) -> DataFrame:
    v0, v1, v2 = least_first((F.col("v0"), F.col("v1"), F.col("v2")))
    return faces.select("mesh_id", "fid", v0.alias("v0"), v1.alias("v1"), v2.alias("v2"))


def grid_side(spark: SparkSession, sf_dir: str) -> int:
    return math.isqrt(spark.read.parquet(f"{sf_dir}/part.parquet").count())


def terrain(spark: SparkSession, sf_dir: str) -> Surface:
    """A square grid of parts in the order of their keys; the size of a part is its height."""
    w = grid_side(spark, sf_dir)
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lit("terrain").alias("mesh_id"), "p_partkey", "p_size")
    row, column = F.floor(F.col("vid") / max(w, 1)).cast("long"), F.col("vid") % max(w, 1)
    grid = numbered(part, ["mesh_id"], "p_partkey", "vid").where(F.col("vid") < w * w)
    vertices = grid.select("mesh_id", "vid", column.cast("double").alias("x"), row.cast("double").alias("y"), (F.col("p_size") / 10.0).alias("z"))
    return Surface(vertices, grid_faces(vertices, w))


def grid_faces(vertices: DataFrame, w: int) -> DataFrame:
    """Two faces for each cell of a grid of w x w vertices."""
    cells = vertices.where((F.col("x") < w - 1) & (F.col("y") < w - 1)).select("mesh_id", F.col("vid").alias("a"))
    corners = F.array(
        F.struct((F.col("a") * 2).alias("fid"), F.col("a").alias("v0"), (F.col("a") + 1).alias("v1"), (F.col("a") + w + 1).alias("v2")),
        F.struct((F.col("a") * 2 + 1).alias("fid"), F.col("a").alias("v0"), (F.col("a") + w + 1).alias("v1"), (F.col("a") + w).alias("v2")),
    )
    return cells.select("mesh_id", F.inline(corners))


def grid_rim(vertices: DataFrame, w: int) -> DataFrame:
    """(mesh_id, src, dst): the half-edges of grid_faces without a flip, which lead round the grid."""
    x, y, vid = F.col("x"), F.col("y"), F.col("vid")
    sides = [(y == 0) & (x < w - 1), (x == w - 1) & (y < w - 1), (y == w - 1) & (x > 0), (x == 0) & (y > 0)]
    onward = [F.when(side, vid + step) for side, step in zip(sides, (1, w, -1, -w), strict=True)]
    return vertices.where(F.lit(w > 1)).select("mesh_id", vid.alias("src"), F.explode(F.array_compact(F.array(*onward))).alias("dst"))


def shell(spark: SparkSession, sf_dir: str) -> Surface:
    """The terrain, the same turned over below it, and walls along the rim: a closed surface."""
    w = grid_side(spark, sf_dir)
    n = w * w
    top = terrain(spark, sf_dir)
    below = top.vertices.select("mesh_id", (F.col("vid") + n).alias("vid"), "x", "y", (F.col("z") - DEPTH).alias("z"))
    vertices = top.vertices.union(below).withColumn("mesh_id", F.lit("shell"))
    under = top.faces.select("mesh_id", (F.col("fid") + 2 * n).alias("fid"), (F.col("v0") + n).alias("v0"), (F.col("v2") + n).alias("v1"), (F.col("v1") + n).alias("v2"))
    rim = grid_rim(top.vertices, w)
    a, b = F.col("src"), F.col("dst")
    walls = rim.select(
        "mesh_id",
        F.inline(
            F.array(
                F.struct((4 * n + 2 * a).alias("fid"), b.alias("v0"), a.alias("v1"), (a + n).alias("v2")),
                F.struct((4 * n + 2 * a + 1).alias("fid"), b.alias("v0"), (a + n).alias("v1"), (b + n).alias("v2")),
            )
        ),
    )
    faces = top.faces.union(under).union(walls).withColumn("mesh_id", F.lit("shell"))
    return Surface(vertices, turned(faces))


def tiles(spark: SparkSession, sf_dir: str, side: int = 32) -> Surface:
    """The terrain cut into meshes of side x side cells: as many meshes as the table asks for, none larger."""
    whole = terrain(spark, sf_dir)
    w = grid_side(spark, sf_dir)
    at = F.col("fid") / 2  # twice the cell's corner
    row, column = F.floor(F.floor(at) / max(w, 1) / side), F.floor(F.floor(at) % max(w, 1) / side)
    name = F.concat_ws("-", F.lit("tile"), row.cast("string"), column.cast("string"))
    faces = whole.faces.withColumn("mesh_id", name)
    used = faces.select("mesh_id", F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct()
    return Surface(used.join(whole.vertices.drop("mesh_id"), "vid").select("mesh_id", "vid", "x", "y", "z"), faces)
