"""OBJ text as a data source that reads files by ranges of bytes: spark.read.format("obj").

Options: `dialect` (strict, permissive, polygons), `rows` (v, f or counts), `range_bytes`, and `parts` (true if
every mesh is a folder mesh_id=<name> of numbered parts, as the sink writes them).  Without parts, load() takes
a file or a folder of *.obj files, and a mesh is named after its file.

A line belongs to the range in which its first byte lies.  A range counts its own lines and vertices; a
prefix pass, one row a range, places it behind those before it.  So no line is shuffled to be numbered, and a
reader of vertices gets no lines of faces.

Defined results: an empty file gives no rows, as does a range that lies within one long line; a last line
needs no line break; bytes that aren't UTF-8 become replacement characters; a missing path is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from facetflow.operators.tables import stored
from facetflow.sources import obj
from facetflow.sources.surfaces import Surface

RANGE_BYTES = 64 << 20
#: Bytes that a task handles at a time; a longer line is handled whole.
PIECE = 4 << 20

PLACE = "mesh_id string, part int, start long"
SCHEMAS = {
    "counts": f"{PLACE}, lines long, vertices long, fans long",
    "v": f"{PLACE}, line_no long, seen long, upto long, line string",
    "f": f"{PLACE}, line_no long, seen long, upto long, line string",
}


@dataclass
class Range(InputPartition):
    mesh_id: str
    part: int
    path: str
    start: int
    stop: int


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files_of(path: str, parts: bool) -> Iterator[tuple[str, int, fs.FileInfo]]:
    """(mesh, part, file) of all files at a path."""
    system, where = file_system(path)
    info = system.get_file_info(where)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        yield info.base_name.removesuffix(".obj"), 0, info
        return
    for found in system.get_file_info(fs.FileSelector(where, recursive=parts)):
        if found.type != fs.FileType.File:
            continue
        if not parts and found.base_name.endswith(".obj"):
            yield found.base_name.removesuffix(".obj"), 0, found
        folder = found.path.rsplit("/", 2)[-2]
        if parts and folder.startswith("mesh_id=") and found.base_name.startswith("part-"):
            yield unquote(folder.removeprefix("mesh_id=")), int(found.base_name.split("-")[1]), found


def up_to_break(file: pa.NativeFile, at: int, size: int) -> bytes:
    """The bytes from at to the next line break with it, or to the end of the file."""
    found = []
    while at < size:
        data = file.read_at(min(1 << 20, size - at), at)
        end = data.find(b"\n") + 1
        found.append(data[:end] if end else data)
        if end:
            break
        at += len(data)
    return b"".join(found)


def pieces(file: pa.NativeFile, start: int, stop: int) -> Iterator[bytes]:
    """The lines that begin in [start, stop), in order, some megabytes of whole lines at a time."""
    size, at = file.size(), start
    if start:
        before = up_to_break(file, start - 1, stop)
        if not before.endswith(b"\n"):
            return
        at = start - 1 + len(before)
    while at < stop:
        data = file.read_at(min(PIECE, stop - at), at)
        cut = data.rfind(b"\n") + 1
        if not cut or (at + len(data) >= stop and cut < len(data)):
            data += up_to_break(file, at + len(data), size)
            cut = len(data)
        yield data[:cut]
        at += cut


class ObjReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.rows = options.get("rows", "v")
        self.strict = options.get("dialect", "strict") == "strict"
        self.size = int(options.get("range_bytes", RANGE_BYTES))
        self.parts = options.get("parts", "false").lower() == "true"

    def partitions(self) -> list[Range]:
        return [Range(mesh, part, file.path, k, min(k + self.size, file.size)) for mesh, part, file in files_of(self.path, self.parts) for k in range(0, file.size, self.size)]

    def read(self, range_: Range) -> Iterator[pa.RecordBatch]:
        lines = vertices = fans = 0
        with file_system(self.path)[0].open_input_file(range_.path) as file:
            for data in pieces(file, range_.start, range_.stop):
                text = pa.array(data.removesuffix(b"\n").decode(errors="replace").split("\n"))
                tags, seen, upto = self.counted(text)
                if self.rows != "counts":
                    at = np.flatnonzero(tags[self.rows])
                    if len(at):
                        yield self.batch(range_, lines + at, vertices + seen[at], fans + upto[at], text.take(pa.array(at)))
                lines, vertices, fans = lines + len(text), vertices + int(seen[-1]), fans + int(upto[-1])
        if self.rows == "counts":
            yield self.batch(range_, *(np.array([n], dtype=np.int64) for n in (lines, vertices, fans)))

    def batch(self, range_: Range, *columns: np.ndarray | pa.Array) -> pa.RecordBatch:
        n = len(columns[0])
        place = [pa.array([range_.mesh_id] * n), pa.array([range_.part] * n, pa.int32()), pa.array([range_.start] * n, pa.int64())]
        names = [field.split()[0] for field in SCHEMAS[self.rows].split(", ")]
        return pa.RecordBatch.from_arrays([*place, *(pa.array(c) for c in columns)], names=names)

    def counted(self, text: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Which lines are vertices and faces, and the vertices and triangles of fans up to and with each line."""
        trimmed = pc.utf8_trim(text, " \t\r\n")
        size = pc.list_value_length(pc.split_pattern_regex(trimmed, "[ \t]+")).to_numpy(zero_copy_only=False)
        tags = {}
        for tag in "vf":
            own = pc.match_substring_regex(trimmed, f"^{tag}([ \t]|$)")
            if not self.strict:
                own = pc.and_(own, pc.starts_with(text, f"{tag} "))
            tags[tag] = own.to_numpy(zero_copy_only=False)
        if not self.strict:
            tags["v"] = tags["v"] & (size >= 4)
        fans = np.where(tags["f"] & (size >= 4), size - 3, 0)
        return tags, np.cumsum(tags["v"], dtype=np.int64), np.cumsum(fans, dtype=np.int64)


class ObjSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "obj"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("rows", "v")]

    def reader(self, schema) -> ObjReader:
        return ObjReader(dict(self.options))


def read(spark: SparkSession, path: str, mode: str = "strict", range_bytes: int = RANGE_BYTES, parts: bool = False) -> Surface:
    """The surfaces of OBJ files, as obj.read_obj() gives them, read by ranges of bytes."""
    if mode not in obj.MODES:
        raise ValueError(f"unknown mode {mode!r}")
    spark.dataSource.register(ObjSource)
    rows = lambda which: spark.read.format("obj").options(rows=which, dialect=mode, range_bytes=range_bytes, parts=parts).load(path)
    place = ["mesh_id", "part", "start"]
    before = Window.partitionBy("mesh_id").orderBy("part", "start").rowsBetween(Window.unboundedPreceding, -1)
    earlier = [F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in ("lines", "vertices", "fans")]
    # one row a range; stored, so that the joins know its size
    offsets = stored(rows("counts").select(*place, *earlier), "ranges-of-files")

    def whole(which: str) -> DataFrame:
        sums = {"line_no": "_lines", "seen": "_vertices", "upto": "_fans"}
        return rows(which).join(offsets, place).select("mesh_id", "line", *((F.col(k) + F.col(n)).alias(k) for k, n in sums.items()))

    return obj.surface_of(whole("v"), whole("f"), mode)
