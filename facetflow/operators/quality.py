"""Comparing surfaces: structure, renders, verdict."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetflow.operators.graph import connected_components
from facetflow.operators.raster import BLANK, views
from facetflow.operators.tables import stored

PROJECTIONS = ("xy", "xz", "yz")
#: Faces that a task links up together: some 100 MB.
FACES = 1 << 19


def _digits(c: str) -> Column:
    """The fewest digits that tell a double from all others, as SQL writes it; a cast gives 4.7E-4, and on some JVMs too many."""
    return F.udf(lambda value: None if value is None else repr(value), "string")(c)


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number of each one's component, for numbers below n and links between them."""
    parent = np.arange(n)
    while len(a):
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        a, b = parent[a], parent[b]
        a, b = a[a != b], b[a != b]
    return parent


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Faces in; the vertices of each block of FACES with the least vertex that links within the block lead to."""

    def labelled(block: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(block)
        mesh = table["mesh_id"].combine_chunks().dictionary_encode()
        code = np.tile(mesh.indices.to_numpy(), 3)
        vid = np.concatenate([table[v].to_numpy() for v in ("v0", "v1", "v2")])
        order = np.lexsort((vid, code))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (np.diff(vid[order]) != 0) | (np.diff(code[order]) != 0)
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
        first = order[new]
        one, two, three = number.reshape(3, -1)
        root = first[_labels(len(first), np.concatenate((one, one)), np.concatenate((two, three)))]
        names = pa.DictionaryArray.from_arrays(pa.array(code[first]), mesh.dictionary).cast(pa.string())
        return pa.RecordBatch.from_arrays([names, pa.array(vid[first]), pa.array(vid[root])], ["mesh_id", "vid", "root"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= FACES:
            yield labelled(held)
            held = []
    if sum(b.num_rows for b in held):
        yield labelled(held)


def components(faces: DataFrame) -> DataFrame:
    """(mesh_id, vid, component) of the vertices in use; the component is its least vertex.

    Tasks link up what they hold, faces with close corners together; what is left to do between tasks are links
    between the components that share a vertex."""
    sound = faces.where("v0 <> v1 and v1 <> v2 and v0 <> v2").select("mesh_id", "v0", "v1", "v2")
    dealt = sound.repartitionByRange("mesh_id", "v0").sortWithinPartitions("mesh_id", "v0")
    local = stored(dealt.mapInArrow(_linked, "mesh_id string, vid long, root long"), "linked")
    least = local.groupBy("mesh_id", "vid").agg(F.min("root").alias("root"), F.collect_set("root").alias("_roots"))
    node = lambda c: F.struct("mesh_id", F.col(c).alias("vid"))
    shared = least.where(F.size("_roots") > 1).select("mesh_id", "root", F.explode("_roots").alias("other")).where("root <> other")
    found = connected_components(shared.select(node("root").alias("a"), node("other").alias("b")), stored)
    of_roots = found.select("node.mesh_id", F.col("node.vid").alias("root"), F.col("component.vid").alias("component"))
    return least.select("mesh_id", "vid", "root").join(of_roots, ["mesh_id", "root"], "left").select("mesh_id", "vid", F.coalesce("component", "root").alias("component"))


def structural_stats(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(mesh_id, vertices, faces, degenerate_faces, components); without faces every vertex is a component."""
    f = faces.groupBy("mesh_id").agg(F.count("*").alias("faces"), F.count_if((F.col("v0") == F.col("v1")) | (F.col("v1") == F.col("v2")) | (F.col("v0") == F.col("v2"))).alias("degenerate_faces"))
    c = components(faces).where("vid = component").groupBy("mesh_id").agg(F.count("*").alias("components"))
    v = vertices.groupBy("mesh_id").agg(F.count("*").alias("vertices"))
    joined = v.join(f, "mesh_id", "left").join(c, "mesh_id", "left")
    zero = F.lit(0).cast("long")
    return joined.select("mesh_id", "vertices", F.coalesce("faces", zero).alias("faces"), F.coalesce("degenerate_faces", zero).alias("degenerate_faces"), F.coalesce("components", "vertices").alias("components"))


def render_disagreement(first: DataFrame, second: DataFrame, width: int, height: int, threshold: int = 20, keys: Sequence[str] = ("mesh_id",)) -> DataFrame:
    """(keys, differing, fraction) of pixels that two renders of a mesh show more than threshold apart."""
    a = first.select(*keys, "px", "py", F.col("color").alias("one"))
    b = second.select(*keys, "px", "py", F.col("color").alias("two"))
    apart = F.abs(F.coalesce("one", F.lit(BLANK)) - F.coalesce("two", F.lit(BLANK))) > threshold
    counts = a.join(b, [*keys, "px", "py"], "full").groupBy(*keys).agg(F.count_if(apart).alias("differing"))
    return counts.withColumn("fraction", F.col("differing") / (width * height))


def verdict(reference: tuple[DataFrame, DataFrame], candidate: tuple[DataFrame, DataFrame], width: int = 512, height: int = 512, padding: int = 24, threshold: int = 20, most_diff: float = 0.08, most_increase: int = 1) -> DataFrame:
    """(scope, name, value) rows on two surfaces (vertices, faces) with one mesh_id: structure, renders, flags."""
    pictures = [views(v, f, PROJECTIONS, width, height, padding) for v, f in (reference, candidate)]
    diffs = stored(render_disagreement(*pictures, width, height, threshold, ("mesh_id", "projection")), "diffs")
    mean = diffs.groupBy("mesh_id").agg((F.sum("differing") / (len(PROJECTIONS) * width * height)).alias("mean"))
    names = ["vertices", "faces", "degenerate_faces", "components"]
    stats = [structural_stats(*s).select("mesh_id", *(F.col(n).alias(f"{p}_{n}") for n in names)) for s, p in ((reference, "a"), (candidate, "b"))]
    joined = stats[0].join(stats[1], "mesh_id").join(mean.withColumn("mean_text", _digits("mean")), "mesh_id", "left")
    average, increase = F.coalesce("mean", F.lit(0.0)), F.col("b_components") - F.col("a_components")
    text = lambda c: c.cast("string")
    rows = [F.struct(F.lit(scope).alias("scope"), F.lit(n).alias("name"), text(F.col(f"{p}_{n}")).alias("value")) for scope, p in (("reference", "a"), ("candidate", "b")) for n in names]
    rows += [
        F.struct(F.lit("summary").alias("scope"), F.lit("average_render_diff").alias("name"), F.coalesce("mean_text", F.lit("0.0")).alias("value")),
        F.struct(F.lit("summary").alias("scope"), F.lit("component_increase").alias("name"), text(increase).alias("value")),
        F.struct(F.lit("summary").alias("scope"), F.lit("flagged").alias("name"), text((average > most_diff) | (increase > most_increase)).alias("value")),
    ]
    summary = joined.select(F.inline(F.array(*rows)))
    return summary.union(diffs.select(F.lit("render_diff").alias("scope"), F.col("projection").alias("name"), _digits("fraction").alias("value")))
