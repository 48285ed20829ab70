"""Rendering as a query: project, shade, spread over pixels, keep the nearest."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetflow.functions import vecmath as M
from facetflow.operators.quadrics import corners
from facetflow.operators.tables import stored

# Background, colour of a lone vertex, shade of a face and its share that falls off, least
# span of a picture and least area (twice) of a face in it.
BLANK, SPLAT = 255, 45
SHADE, FALL = 215, 85
LEAST_SPAN, LEAST_AREA = 1e-12, 1e-8
#: Width and height of a picture, and its margin, where none are given.
SIDE, PADDING = 512, 24
#: Side of a tile, pixels that a task looks at together, and winners that it holds before it sends them off.
TILE, AT_ONCE, HELD = 64, 1 << 20, 1 << 20
# How a known mesh is looked at, and turned, where nothing else is asked for.
PROJECTIONS = ("xy", "-xy", "xz", "-xz", "yz", "-yz")
AUTO = "auto"
DEFAULT_PROJECTIONS = {"bunny": "xy", "buddha": "-xy", "dragon": "yz"}
DEFAULT_ROTATIONS: dict[str, str] = {"dragon": "ccw"}
#: Depth is compared after rounding, so that results don't depend on the order of operations.
DEPTH_DIGITS = 9


def project(projection: str, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Across, up and depth; a leading '-' turns the depth round."""
    plane = projection.removeprefix("-")
    u, v, depth = {"xy": (x, y, z), "yz": (y, z, x)}.get(plane, (x, z, y))
    return u, v, -depth if projection.startswith("-") else depth


def projection_of(mesh: Column, asked: str = AUTO) -> Column:
    """What is asked for, or by default a mesh's own view, xz for unknown ones."""
    own = F.lit(None)
    for name, view in DEFAULT_PROJECTIONS.items():
        own = F.when(mesh == name, view).otherwise(own)
    return F.coalesce(own, F.lit("xz")) if asked == AUTO else F.lit(asked)


def rotation_of(mesh: Column, asked: str = AUTO) -> Column:
    """A mesh's own rotation where its default view is shown, else none."""
    own = F.lit(None)
    for name, turn in DEFAULT_ROTATIONS.items():
        own = F.when(mesh == name, turn).otherwise(own)
    return F.coalesce(own, F.lit("none")) if asked == AUTO else F.lit("none")


def raster_points(vertices: DataFrame, projection: str, width: int, height: int, padding: int = 0) -> DataFrame:
    """(mesh_id, vid, px, py, depth): fitted to the picture with one scale, centred, y downwards."""
    u, v, depth = project(projection, *M.vec())
    flat = vertices.select("mesh_id", "vid", u.alias("u"), v.alias("v"), depth.alias("depth"))
    box = flat.groupBy("mesh_id").agg(F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("v").alias("v0"), F.max("v").alias("v1"))
    su, sv = (F.greatest(F.col(f"{c}1") - F.col(f"{c}0"), F.lit(LEAST_SPAN)) for c in "uv")
    scale = F.least(F.lit(float(max(width - 2 * padding, 1))) / su, F.lit(float(max(height - 2 * padding, 1))) / sv)
    fit = box.select("mesh_id", "u0", "v0", scale.alias("scale"), ((width - su * scale) / 2).alias("left"), ((height - sv * scale) / 2).alias("low"))
    fit = stored(fit, "fit")  # a row a mesh: the join knows its size
    px = F.col("left") + (F.col("u") - F.col("u0")) * F.col("scale")
    py = height - (F.col("low") + (F.col("v") - F.col("v0")) * F.col("scale"))
    return flat.join(fit, "mesh_id").select("mesh_id", "vid", px.alias("px"), py.alias("py"), "depth")


def face_shade(projection: str, a: M.Vec, b: M.Vec, c: M.Vec) -> Column:
    """Flat shade of a face by how far it looks at the viewer, halves to even."""
    n = M.cross(M.sub(b, a), M.sub(c, a))
    size = F.greatest(M.length(n), F.lit(1e-12))
    toward = {"xy": n[2], "yz": n[0]}.get(projection.removeprefix("-"), n[1])
    return F.bround(SHADE - FALL * F.abs(toward / size), 0).cast("int")


def face_shades(faces: DataFrame, vertices: DataFrame, projection: str) -> DataFrame:
    """(mesh_id, fid, color) of the faces whose corners exist."""
    return corners(faces, vertices).select("mesh_id", "fid", face_shade(projection, *(M.vec(k) for k in "abc")).alias("color"))


def _runs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sizes 2, 3: the owners 0 0 1 1 1 and the places 0 1 0 1 2."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _shares(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices whose sizes add up to most, or that hold one."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, most + (ends[start - 1] if start else 0), "right")))
        yield slice(start, stop)
        start = stop


def _rounded(depth: np.ndarray) -> np.ndarray:
    """To DEPTH_DIGITS, halves away from zero; doubles too large to have such digits stay."""
    k = 10.0**DEPTH_DIGITS
    return np.where(np.abs(depth) * k >= 2.0**52, depth, np.copysign(np.floor(np.abs(depth) * k + 0.5) / k, depth)) + 0.0


def _nearest(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """A row for each key: the greatest depth, the first face among equals."""
    order = np.lexsort((rows["fid"], -rows["depth"], rows["key"]))
    keys = rows["key"][order]
    first = order[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else order
    return {name: column[first] for name, column in rows.items()}


def _painter(width: int, height: int, tile: int, at_once: int, held: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Faces in, winners out.  Faces are binned by the tiles that their boxes touch, tiles are filled in shares
    of at_once pixels, and no more than about held winners are kept before they go to be merged with those of
    other tasks; so a task's memory doesn't grow with its faces."""
    across = -(-width // tile)

    def share(face: dict[str, np.ndarray], own: np.ndarray, tx: np.ndarray, ty: np.ndarray) -> dict[str, np.ndarray]:
        """Winners among bins: the face own meets the tile (tx, ty)."""
        left, right = np.maximum(face["x0"][own], tx * tile), np.minimum(face["x1"][own], tx * tile + tile - 1)
        top, bottom = np.maximum(face["y0"][own], ty * tile), np.minimum(face["y1"][own], ty * tile + tile - 1)
        wide = right - left + 1
        bin_of, at = _runs(wide * (bottom - top + 1))
        px, py, f = left[bin_of] + at % wide[bin_of], top[bin_of] + at // wide[bin_of], own[bin_of]
        x, y = px + 0.5, py + 0.5
        w = []
        for u, v in ("bc", "ca", "ab"):
            ux, uy, vx, vy = (face[k][f] for k in (f"{u}x", f"{u}y", f"{v}x", f"{v}y"))
            w.append(((x - ux) * (vy - uy) - (y - uy) * (vx - ux)) / face["area"][f])
        inside = (w[0] >= 0) & (w[1] >= 0) & (w[2] >= 0)
        f, w = f[inside], [k[inside] for k in w]
        depth = _rounded(w[0] * face["ad"][f] + w[1] * face["bd"][f] + w[2] * face["cd"][f])
        key = (face["mesh"][f] * height + py[inside]) * width + px[inside]
        return _nearest({"key": key, "depth": depth, "fid": face["fid"][f], "color": face["color"][f]})

    def binned(face: dict[str, np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
        ranges = [(face[f"{k}0"] // tile, face[f"{k}1"] // tile) for k in "xy"]
        counts = (ranges[0][1] - ranges[0][0] + 1) * (ranges[1][1] - ranges[1][0] + 1)
        for part in _shares(counts, at_once):
            n = ranges[0][1][part] - ranges[0][0][part] + 1
            owner, at = _runs(counts[part])
            tx, ty, own = ranges[0][0][part][owner] + at % n[owner], ranges[1][0][part][owner] + at // n[owner], owner + part.start
            order = np.lexsort((ty * across + tx, face["mesh"][own]))  # a tile's faces together
            own, tx, ty = own[order], tx[order], ty[order]
            wide = np.minimum(face["x1"][own], tx * tile + tile - 1) - np.maximum(face["x0"][own], tx * tile) + 1
            high = np.minimum(face["y1"][own], ty * tile + tile - 1) - np.maximum(face["y0"][own], ty * tile) + 1
            for some in _shares(wide * high, at_once):
                yield share(face, own[some], tx[some], ty[some])

    def out(names: list[str], rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        mesh, pixel = np.divmod(rows["key"], width * height)
        return pa.RecordBatch.from_pydict(
            {
                "mesh_id": pa.DictionaryArray.from_arrays(pa.array(mesh.astype(np.int32)), pa.array(names, pa.string())).cast(pa.string()),
                "fid": rows["fid"],
                "px": (pixel % width).astype(np.int32),
                "py": (pixel // width).astype(np.int32),
                "depth": rows["depth"],
                "color": rows["color"].astype(np.int32),
            }
        )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, int] = {}
        best = None
        for batch in batches:
            if not batch.num_rows:
                continue
            mesh = batch.column("mesh_id").dictionary_encode()
            code = np.array([codes.setdefault(n, len(codes)) for n in mesh.dictionary.to_pylist()], dtype=np.int64)
            face = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names if n != "mesh_id"}
            face["mesh"] = code[mesh.indices.to_numpy()]
            for found in binned(face):
                best = found if best is None else _nearest({n: np.concatenate((c, found[n])) for n, c in best.items()})
                if len(best["key"]) > held:
                    yield out(list(codes), best)
                    best = None
            if best is None:
                codes = {}
        if best is not None:
            yield out(list(codes), best)

    return task


def _fitted(box: DataFrame, projection: str, width: int, height: int, padding: int) -> DataFrame:
    """(mesh_id, _u0, _v0, _scale, _left, _low): how raster_points fits a view, from the bounds of vertices."""
    low, high = project(projection, *(F.col(f"min_{k}") for k in "xyz")), project(projection, *(F.col(f"max_{k}") for k in "xyz"))
    su, sv = (F.greatest(high[k] - low[k], F.lit(LEAST_SPAN)) for k in range(2))
    scale = F.least(F.lit(float(max(width - 2 * padding, 1))) / su, F.lit(float(max(height - 2 * padding, 1))) / sv)
    return box.select("mesh_id", low[0].alias("_u0"), low[1].alias("_v0"), scale.alias("_scale"), ((width - su * scale) / 2).alias("_left"), ((height - sv * scale) / 2).alias("_low"))


def bounds(vertices: DataFrame) -> DataFrame:
    """(mesh_id, min_x .. max_z), a row a mesh."""
    return vertices.groupBy("mesh_id").agg(*(f(k).alias(f"{name}_{k}") for k in "xyz" for name, f in (("min", F.min), ("max", F.max))))


def rasterize(vertices: DataFrame, faces: DataFrame, projection: str, width: int = SIDE, height: int = SIDE, padding: int = PADDING) -> DataFrame:
    """(mesh_id, px, py, depth, color) of the pixels that a face covers; all others are blank.

    The greatest depth wins, the first face among equals.  Tasks fill the tiles that their faces touch and
    send only each pixel's winner, so what is shuffled follows faces and pixels of the picture, not their
    product.  Faces with a corner that doesn't exist or has no place aren't drawn.  A mesh without faces shows
    its vertices; an empty table gives no pixels.
    """
    return views(vertices, faces, (projection,), width, height, padding).drop("projection")


def views(vertices: DataFrame, faces: DataFrame, projections: Sequence[str], width: int = SIDE, height: int = SIDE, padding: int = PADDING) -> DataFrame:
    """(projection, mesh_id, px, py, depth, color): rasterize for several views; corners are joined once for all."""
    c = F.col
    box = stored(bounds(vertices), "box")  # a row a mesh: the joins know its size
    whole = corners(faces.select("mesh_id", "fid", "v0", "v1", "v2"), vertices)
    bare = vertices.join(faces.select("mesh_id").distinct(), "mesh_id", "left_anti")
    if len(projections) > 1:
        whole, bare = stored(whole, "corners"), stored(bare, "bare")
    low = lambda k: F.greatest(F.lit(0), F.floor(F.least(f"a{k}", f"b{k}", f"c{k}"))).cast("int")
    high = lambda k, n: F.least(F.lit(n - 1), F.ceil(F.greatest(f"a{k}", f"b{k}", f"c{k}"))).cast("int")
    out = None
    for projection in projections:
        fit = _fitted(box, projection, width, height, padding)

        def point(prefix: str, projection: str = projection) -> tuple[Column, Column, Column]:
            u, v, depth = project(projection, *M.vec(prefix))
            return c("_left") + (u - c("_u0")) * c("_scale"), height - (c("_low") + (v - c("_v0")) * c("_scale")), depth

        flat = whole.join(fit, "mesh_id").select(
            "mesh_id", c("fid").cast("long").alias("fid"), *(value.alias(k + j) for k in "abc" for j, value in zip(("x", "y", "d"), point(k), strict=True)),
            face_shade(projection, *(M.vec(k) for k in "abc")).alias("color"),
        )
        area = M.edge_side(c("ax"), c("ay"), c("bx"), c("by"), c("cx"), c("cy"))
        boxes = flat.withColumn("area", area).where(F.abs("area") >= LEAST_AREA).withColumns({"x0": low("x"), "x1": high("x", width), "y0": low("y"), "y1": high("y", height)})
        seen = boxes.where("x0 <= x1 and y0 <= y1").where((c("ad") + c("bd") + c("cd")).isNotNull())
        lit = seen.mapInArrow(_painter(width, height, TILE, AT_ONCE, HELD), "mesh_id string, fid long, px int, py int, depth double, color int")
        x, y, depth = point("")
        dots = bare.join(fit, "mesh_id").select("mesh_id", c("vid").alias("fid"), F.bround(x, 0).cast("int").alias("px"), F.bround(y, 0).cast("int").alias("py"), depth.alias("depth"), F.lit(SPLAT).alias("color"))
        own = lit.union(dots.where(f"px >= 0 and px < {width} and py >= 0 and py < {height}")).withColumn("projection", F.lit(projection))
        out = own if out is None else out.union(own)
    nearest = F.max_by(F.struct("depth", "color"), F.struct("depth", -c("fid"))).alias("n")
    return out.groupBy("projection", "mesh_id", "px", "py").agg(nearest).select("projection", "mesh_id", "px", "py", "n.depth", "n.color")


def turned_left(pixels: DataFrame, width: int) -> DataFrame:
    """The picture turned counter-clockwise: (x, y) goes to (y, width - 1 - x)."""
    return pixels.withColumns({"px": F.col("py"), "py": (F.lit(width - 1) - F.col("px")).cast("int")})


def centred(vertices: DataFrame) -> DataFrame:
    """Vertices around their mean, the widest extent scaled to 1 (unless it is zero)."""
    box = vertices.groupBy("mesh_id").agg(*(F.avg(k).alias(f"m{k}") for k in "xyz"), F.greatest(*(F.max(k) - F.min(k) for k in "xyz")).alias("span"))
    box = stored(box, "box")
    over = F.when(F.col("span") > 0, F.col("span")).otherwise(1.0)
    return vertices.join(box, "mesh_id").select("mesh_id", "vid", *(((F.col(k) - F.col(f"m{k}")) / over).alias(k) for k in "xyz"))
