"""Wavefront OBJ text as a source and a sink.

Three dialects:
- strict: a line is blank, a comment, `v` with exactly three numbers, `f` with exactly three corners, or
  some other tag, which is ignored; anything else is an error.  Faces may only use vertices read so far.
  Faces without area and repeats of a corner set (whatever the winding) are dropped, the first stays.
- permissive: lines begin with `v ` or `f `; numbers beyond the third are ignored; faces that aren't
  triangles or use vertices that don't exist (yet) are dropped.
- polygons: as permissive, but faces of any size are cut into fans and bounds aren't checked.
"""

from __future__ import annotations

from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from facetflow.functions import vecmath as M
from facetflow.operators.quadrics import corners
from facetflow.operators.tables import delete, discard, new_path, numbered, running_sum, stored
from facetflow.sources.surfaces import Surface, turned

MODES = ("strict", "permissive", "polygons")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(mesh_id, line_no, line) of the files at path; the mesh is named after its file.

    A file may be read in many blocks: lines are counted within a block, and blocks are placed by the counts
    of those before them.  The rows are stored first, so that blocks stay as they were cut.
    """
    text = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    rows = stored(text, "lines")
    counts = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(counts.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift")), "blocks")
    name = F.regexp_replace("file", r"\.obj$", "")
    return rows.join(offsets, ["file", "block"]).select(name.alias("mesh_id"), (F.col("at") + F.col("shift")).alias("line_no"), "line")


def _fail(bad: Column, message: str, otherwise: Column) -> Column:
    return F.when(bad, F.raise_error(F.concat(F.lit(f"{message}: "), F.coalesce("line", F.lit(""))))).otherwise(otherwise)


def _number(token: Column, strict: bool) -> Column:
    """A double; the suffixes d and f, which Spark's cast accepts, are no part of one."""
    value = F.when(~token.rlike("[dDfF]$") | token.rlike("(?i)^[+-]?inf$"), token.try_cast("double"))
    return _fail(value.isNull(), "expected a floating-point number", value) if strict else value


def _corner(token: Column, seen: Column, strict: bool) -> Column:
    """A 0-based vertex: before the first slash, 1-based, or counted back from the vertices read so far."""
    digits = F.regexp_extract(token, r"^(-?[0-9]+)", 1)
    n = digits.try_cast("long")
    at = F.when(n > 0, n - 1).otherwise(seen + n)
    if not strict:
        return at
    bad = n.isNull() | (n == 0) | (at < 0) | (at >= seen)
    return _fail(F.coalesce(bad, F.lit(True)), "face index out of range", at)


def parse(lines: DataFrame, mode: str = "strict") -> Surface:
    """The surface that lines(mesh_id, line_no, line) describe; a face's fid is its line, or, of polygons, its
    number in the order of lines and corners."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    strict = mode == "strict"
    tagged = _split(lines).withColumn("tag", F.col("t")[0])
    if not strict:
        tagged = tagged.where(F.col("line").startswith("v ") | F.col("line").startswith("f "))
    size = F.size("t")
    own = tagged.where(F.col("tag").isin("v", "f"))
    is_vertex = F.col("tag") == "v" if strict else (F.col("tag") == "v") & (size >= 4)
    counted = running_sum(own, ["mesh_id"], "line_no", is_vertex.cast("int"), "seen").drop("t")
    faces = counted.where("tag = 'f'")
    if mode == "polygons":
        faces = running_sum(_split(faces).where(size >= 4), ["mesh_id"], "line_no", size - 3, "upto")
    return surface_of(counted.where("tag = 'v'") if strict else _split(counted).where(is_vertex), faces, mode)


def _split(lines: DataFrame) -> DataFrame:
    """lines with their words as t."""
    trimmed = F.regexp_replace("line", r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    return lines.withColumn("t", F.split(trimmed, "[ \t]+"))


def surface_of(vertices: DataFrame, faces: DataFrame, mode: str) -> Surface:
    """The surface of lines of vertices(mesh_id, line, seen) and of faces(mesh_id, line_no, line, seen), each with
    the number of vertices read so far, and, of polygons, with that of the triangles up to and with its own (upto)."""
    strict = mode == "strict"
    token = lambda k: F.get(F.col("t"), F.lit(k))
    size = F.size("t")
    xyz = [_number(token(k), strict) for k in (1, 2, 3)]
    if strict:
        xyz[0] = _fail(size != 4, "a vertex needs three coordinates", xyz[0])
    vertices = _split(vertices).select("mesh_id", (F.col("seen") - 1).alias("vid"), *(c.alias(k) for c, k in zip(xyz, "xyz", strict=True)))
    faces = _split(faces)
    if mode == "polygons":
        faces = faces.where(size >= 4).withColumn("k", F.explode(F.sequence(F.lit(2), size - 2)))
        picked = [F.get(F.col("t"), k) for k in (F.lit(1), F.col("k"), F.col("k") + 1)]
        fid = F.col("upto") - size + 1 + F.col("k")
    else:
        faces = faces if strict else faces.where(size == 4)
        picked = [token(k) for k in (1, 2, 3)]
        fid = F.col("line_no")
    at = [_corner(p, F.col("seen"), strict) for p in picked]
    if strict:
        at[0] = _fail(size != 4, "only triangular faces are supported", at[0])
    faces = faces.select("mesh_id", fid.alias("fid"), *(c.alias(f"v{k}") for k, c in enumerate(at)), "seen")
    if mode == "permissive":
        faces = faces.where(" and ".join(f"v{k} >= 0 and v{k} < seen" for k in range(3)))
    faces = faces.drop("seen")
    if strict:
        faces = without_repeats(without_flat(faces, vertices))
    return Surface(vertices, turned(faces))


def without_flat(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces with three different corners and an area that isn't exactly zero."""
    c = M.cross(M.sub(M.vec("b"), M.vec("a")), M.sub(M.vec("c"), M.vec("a")))
    return corners(faces.where("v0 <> v1 and v1 <> v2 and v0 <> v2"), vertices).where(M.length(c) != 0).select(faces.columns)


def without_repeats(faces: DataFrame) -> DataFrame:
    """The first face of each set of corners, with its own winding."""
    key = F.array_sort(F.array("v0", "v1", "v2")).alias("key")
    first = F.min(F.struct("fid", "v0", "v1", "v2")).alias("f")
    return faces.groupBy("mesh_id", key).agg(first).select("mesh_id", "f.*")


def check(surface: Surface) -> Surface:
    """Raises ValueError unless there are vertices and all corners exist."""
    if surface.vertices.isEmpty():
        raise ValueError("a mesh needs at least one vertex")
    used = surface.faces.select("mesh_id", F.explode(F.array("v0", "v1", "v2")).alias("vid"))
    if not used.join(surface.vertices, ["mesh_id", "vid"], "left_anti").isEmpty():
        raise ValueError("a face uses a vertex that doesn't exist")
    return surface


def read_obj(spark: SparkSession, path: str, mode: str = "strict") -> Surface:
    return parse(read_lines(spark, path), mode)


def reindexed(surface: Surface) -> Surface:
    """Vertices numbered 0, 1, ... in the order of their ids (unused ones too); faces follow, and those with
    a missing corner go."""
    ids = numbered(surface.vertices, ["mesh_id"], "vid", "new")
    faces = surface.faces
    for k in ("v0", "v1", "v2"):
        faces = faces.join(ids.select("mesh_id", F.col("vid").alias(k), F.col("new").alias(f"_{k}")), ["mesh_id", k]).drop(k).withColumnRenamed(f"_{k}", k)
    return Surface(ids.select("mesh_id", F.col("new").alias("vid"), "x", "y", "z"), turned(faces))


@F.pandas_udf(StringType())
def seventeen(numbers: pd.Series) -> pd.Series:
    """Numbers with 17 significant digits, rounded from their exact values, without trailing zeros."""
    return numbers.map("{:.17g}".format)


def export_lines(surface: Surface, digits: int | None = None) -> DataFrame:
    """(mesh_id, section, a, b, c, line): vertex lines in the order of ids, then faces by corners, 1-based.

    Numbers are written as the shortest text that reads back as the same double, or with 17 digits.  An empty
    surface has no lines; vertices without a place are an error with 17 digits.
    """
    if digits not in (None, 17):
        raise ValueError("digits are the shortest (None) or 17")
    number = (lambda c: F.when(c.isNull(), F.raise_error(F.lit("a vertex has no place"))).otherwise(seventeen(c))) if digits else (lambda c: c.cast("string"))
    dense = reindexed(surface)
    zero = F.lit(0).cast("long")
    v = dense.vertices.select("mesh_id", F.lit(0).alias("section"), F.col("vid").alias("a"), zero.alias("b"), zero.alias("c"), F.concat_ws(" ", F.lit("v"), *(number(F.col(k)) for k in "xyz")).alias("line"))
    f = dense.faces.select("mesh_id", F.lit(1).alias("section"), F.col("v0").alias("a"), F.col("v1").alias("b"), F.col("v2").alias("c"), F.concat_ws(" ", F.lit("f"), *((F.col(k) + 1).cast("string") for k in ("v0", "v1", "v2"))).alias("line"))
    return v.union(f)


def _in_ranges(lines: DataFrame) -> DataFrame:
    """Dealt by ranges of the order of the file, so that tasks write neighbouring sections side by side."""
    order = ["mesh_id", "section", "a", "b", "c"]
    return lines.repartitionByRange(*order).sortWithinPartitions(*order)


def write_obj(surface: Surface, path: str) -> None:
    """A folder a mesh under path; its parts, by their numbers, are the sections of one OBJ text with 17 digits.

    However large a mesh is, a task writes a range of its lines.
    """
    lines = stored(export_lines(surface, 17), "export")  # ranges are drawn from what is written, not made anew
    _in_ranges(lines).select("mesh_id", "line").write.partitionBy("mesh_id").text(path)
    discard(lines)


def parts_of(spark: SparkSession, folder: str) -> list[str]:
    """The part files of a folder by their numbers."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    paths = [str(status.getPath()) for status in found if status.getPath().getName().startswith("part-")]
    return sorted(paths, key=lambda path: int(path.rsplit("/part-", 1)[1].split("-")[0]))


def joined_file(spark: SparkSession, folder: str, path: str) -> None:
    """The parts of a folder as one file of the driver, copied a buffer at a time."""
    hadoop, configuration = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "wb"):
        pass  # a path that can't be written is an ordinary error
    local = hadoop.fs.FileSystem.getLocal(configuration).getRawFileSystem()
    out = local.create(hadoop.fs.Path(Path(path).absolute().as_uri()), True)
    try:
        for part in parts_of(spark, folder):
            where = hadoop.fs.Path(part)
            own = where.getFileSystem(configuration).open(where)
            try:
                hadoop.io.IOUtils.copyBytes(own, out, 1 << 20, False)
            finally:
                own.close()
    finally:
        out.close()


def write_obj_file(surface: Surface, path: str) -> None:
    """One mesh as one file of the driver: sections are written side by side, then joined."""
    spark = surface.vertices.sparkSession
    lines, folder = stored(export_lines(surface, 17), "export"), new_path(spark, "sections")
    try:
        _in_ranges(lines).select("line").write.text(folder)
        joined_file(spark, folder, path)
    finally:
        delete(spark, folder)
        discard(lines)


NAME = r"([^/]+)_r([0-9]+(?:p[0-9]+)?)_t([0-9]+)\.obj$"


def named_outputs(files: DataFrame, targets: list[str] | None = None) -> DataFrame:
    """(mesh, target, threads, path) of files(path) named <mesh>_r<label>_t<threads>.obj, p for the decimal point."""
    part = lambda k: F.regexp_extract("path", NAME, k)
    found = files.where(F.col("path").rlike(NAME)).select(part(1).alias("mesh"), F.translate(part(2), "p", ".").alias("target"), part(3).cast("int").alias("threads"), "path")
    return found.where(F.col("target").isin(targets)) if targets is not None else found


def discover(spark: SparkSession, folder: str, targets: list[str] | None = None) -> DataFrame:
    """named_outputs() of the files in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.obj").load(folder).select("path")
    return named_outputs(files, targets)


def add_originals(outputs: DataFrame, originals: DataFrame) -> DataFrame:
    """outputs with originals(mesh, path) as target 100, for all thread counts of the mesh (or 1)."""
    threads = outputs.select("mesh", "threads").distinct()
    added = originals.join(threads, "mesh", "left").select("mesh", F.lit("100").alias("target"), F.coalesce("threads", F.lit(1)).alias("threads"), "path")
    return outputs.unionByName(added.join(outputs, ["mesh", "target", "threads"], "left_anti"))
