"""The registered queries on surfaces derived from a table, and the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetflow.functions import vecmath as M
from facetflow.operators import partition, quadrics, quality, raster, report, select, topology
from facetflow.operators.tables import new_path, noted, stored
from facetflow.plans.simplify import simplify, stats_table
from facetflow.plans.options import SimplifyOptions
from facetflow.sources import obj, obj_ranges, surfaces, sweep_log
from facetflow.sources.surfaces import Surface, grid_side, shell, terrain

PARTS = 8
WIDTH, HEIGHT, PADDING = raster.SIDE, raster.SIDE, raster.PADDING
tidy = M.tidy


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: tidy(F.col(c)) for c in columns})


def _edges(s: SparkSession, d: str) -> DataFrame:
    return topology.half_edges(terrain(s, d).faces)


def _candidates(s: SparkSession, d: str) -> DataFrame:
    t = terrain(s, d)
    return quadrics.edge_candidates(topology.two_sided_edges(topology.half_edges(t.faces)), t.vertices, quadrics.vertex_quadrics(t.faces, t.vertices))


def _classified(s: SparkSession, d: str) -> DataFrame:
    return partition.edge_classes(_candidates(s, d), partition.slab_partitions(terrain(s, d).vertices, PARTS))


def terrain_vertices(s, d):
    return terrain(s, d).vertices


def terrain_faces(s, d):
    return terrain(s, d).faces


def shell_vertices(s, d):
    return _rounded(shell(s, d).vertices, "z")


def shell_faces(s, d):
    return shell(s, d).faces


def face_planes(s, d):
    t = terrain(s, d)
    return _rounded(quadrics.face_planes(t.faces, t.vertices).select("fid", "nx", "ny", "nz", "d", "area"), "nx", "ny", "nz", "d", "area")


def total_area(s, d):
    t = terrain(s, d)
    return quadrics.face_planes(t.faces, t.vertices).agg(F.round(F.sum("area"), 3).alias("area"), F.count("*").alias("faces"))


def face_min_rotation(s, d):
    """Faces as they might come, corners turned twice, then least first again."""
    f = terrain(s, d).faces.select("mesh_id", "fid", F.col("v1").alias("v0"), F.col("v2").alias("v1"), F.col("v0").alias("v2"))
    return surfaces.turned(f)


def half_edges(s, d):
    return _edges(s, d)


def two_sided_edges(s, d):
    return topology.two_sided_edges(_edges(s, d))


def boundary_edges(s, d):
    return topology.boundary_edges(_edges(s, d))


def closed_vertices(s, d):
    return topology.closed_vertices(_edges(s, d))


def vertex_degrees(s, d):
    return topology.neighbours(_edges(s, d)).groupBy(F.col("v").alias("vid")).agg(F.count("*").alias("degree"))


def link_violations(s, d):
    """On the terrain with faces from its low corners to a far vertex, so that links are broken."""
    t = terrain(s, d)
    low = t.faces.join(t.vertices.where("z < 1").select("mesh_id", F.col("vid").alias("v0")), ["mesh_id", "v0"], "left_semi")
    extra = low.select("mesh_id", (F.col("fid") + 10_000_000).alias("fid"), F.col("v0"), F.col("v2").alias("v1"), F.lit(0).cast("long").alias("v2")).where("v0 <> 0 and v1 <> 0")
    edges = topology.half_edges(t.faces.union(extra))
    return topology.link_violations(topology.two_sided_edges(edges), edges)


def collapsible_edges(s, d):
    return topology.collapsible_edges(_edges(s, d))


def conflict_sets(s, d):
    sets = topology.conflict_sets(topology.two_sided_edges(_edges(s, d)))
    return sets.select("hi", "lo", F.array_join(F.transform("claim", lambda x: x.cast("string")), ",").alias("claim"))


def euler_characteristic(s, d):
    t, c = terrain(s, d), shell(s, d)
    return topology.euler_characteristic(t.vertices, t.faces).union(topology.euler_characteristic(c.vertices, c.faces))


def vertex_quadrics(s, d):
    t = terrain(s, d)
    return _rounded(quadrics.vertex_quadrics(t.faces, t.vertices).drop("mesh_id"), *(f"q_{k}" for k in M.Q))


def edge_candidates(s, d):
    return _rounded(_candidates(s, d).select("hi", "lo", "o1", "o0", "px", "py", "pz", "cost"), "px", "py", "pz", "cost")


def cheapest_collapses(s, d):
    return _rounded(quadrics.cheapest(_candidates(s, d), 10).select("hi", "lo", "cost"), "cost")


def bounding_box(s, d):
    return partition.bounding_box(terrain(s, d).vertices)


def slab_partitions(s, d):
    return partition.slab_partitions(terrain(s, d).vertices, PARTS)


def partition_counts(s, d):
    return partition.partition_counts(partition.slab_partitions(terrain(s, d).vertices, PARTS))


def edge_classes(s, d):
    return _classified(s, d).select("hi", "lo", "part")


def class_counts(s, d):
    return _rounded(partition.class_counts(_classified(s, d)), "interior_fraction", "boundary_fraction")


def load_imbalance(s, d):
    return _rounded(partition.load_imbalance(_classified(s, d), PARTS), "imbalance")


def partition_topk(s, d):
    return _rounded(partition.partition_topk(_classified(s, d), 16).select("part", "place", "hi", "lo", "cost"), "cost")


def obj_lines(s: SparkSession, d: str) -> DataFrame:
    """The terrain as OBJ text: comments, other tags, scientific numbers, slashes, negative and flat faces."""
    n = grid_side(s, d) ** 2
    t = terrain(s, d)
    vertices = stored(t.vertices, "vertices")
    faces = surfaces.grid_faces(vertices, grid_side(s, d))
    whole = lambda c: F.col(c).cast("long").cast("string")
    v = vertices.select("mesh_id", F.col("vid").alias("line_no"), F.concat(F.lit("  v  "), whole("x"), F.lit("\t"), whole("y"), F.lit(" "), F.round(F.col("z") * 10, 0).cast("int").cast("string"), F.lit("e-1\r")).alias("line"))
    one, back = (lambda c: (F.col(c) + 1).cast("string")), (lambda c: (F.col(c) - n).cast("string"))
    even = F.concat(F.lit("f "), one("v0"), F.lit("/7/7 "), one("v1"), F.lit("//2 "), one("v2"))
    odd = F.concat(F.lit("f "), back("v0"), F.lit(" "), back("v1"), F.lit(" "), back("v2"), F.lit("x"))
    again = F.concat(F.lit("f "), one("v0"), F.lit(" "), one("v2"), F.lit(" "), one("v1"))
    flat = F.concat(F.lit("f "), one("v0"), F.lit(" "), one("v0"), F.lit(" "), one("v1"))
    noise = F.when(F.col("fid") % 3 == 0, "# f 1 2").otherwise("vn 0 0 1")
    own = [F.when(F.col("fid") % 2 == 0, even).otherwise(odd), again, flat, noise]
    return v.union(faces.select("mesh_id", F.inline(F.array(*(F.struct((F.col("fid") * 4 + n + i).alias("line_no"), c.alias("line")) for i, c in enumerate(own))))))


def obj_vertices(s, d):
    return obj.parse(obj_lines(s, d)).vertices


def obj_faces(s, d):
    return obj.parse(obj_lines(s, d)).faces


def obj_permissive_faces(s, d):
    """The same text read leniently: repeats and flat faces stay."""
    lines = obj_lines(s, d).withColumn("line", F.regexp_replace(F.trim("line"), "[x\r]", "")).withColumn("line", F.regexp_replace("line", "^v  ", "v "))
    return obj.parse(lines, "permissive").faces


def obj_polygon_faces(s, d):
    """The terrain's cells as faces of four corners, cut into fans."""
    t = terrain(s, d)
    w = grid_side(s, d)
    v = t.vertices.select("mesh_id", F.col("vid").alias("line_no"), F.concat_ws(" ", F.lit("v"), *(F.col(k).cast("string") for k in "xyz")).alias("line"))
    at = lambda k: (F.col("v0") + k + 1).cast("string")
    f = t.faces.where("fid % 2 = 0").select("mesh_id", (F.floor(F.col("fid") / 2) + w * w).alias("line_no"), F.concat_ws(" ", F.lit("f"), at(0), at(1), at(w + 1), at(w)).alias("line"))
    return obj.parse(v.union(f), "polygons").faces


def _written(s: SparkSession, d: str) -> Surface:
    """The terrain, written as parts of an OBJ text and read again by ranges of bytes."""
    path = new_path(s, "written")
    noted(s, path)
    obj.write_obj(terrain(s, d), path)
    return obj_ranges.read(s, path, parts=True)


def obj_written_vertices(s, d):
    return _written(s, d).vertices


def obj_written_faces(s, d):
    return _written(s, d).faces


def obj_export(s, d):
    """The terrain without its low vertices, and so without their faces."""
    t = terrain(s, d)
    kept = t.vertices.where("z >= 1")
    return obj.export_lines(Surface(kept, t.faces)).select("section", "a", "b", "c", "line")


def _independent(t: Surface) -> DataFrame:
    edges = stored(topology.half_edges(t.faces), "edges")
    priced = quadrics.edge_candidates(topology.collapsible_edges(edges), t.vertices, quadrics.vertex_quadrics(t.faces, t.vertices))
    return select.independent_batch(stored(priced, "priced"), edges)


def independent_batch(s, d):
    return _rounded(_independent(terrain(s, d)).select("hi", "lo", "px", "py", "pz", "cost"), "px", "py", "pz", "cost")


def contract_once(s, d):
    """Faces after all collapses of independent_batch."""
    t = terrain(s, d)
    chosen = independent_batch(s, d).select(F.lit("terrain").alias("mesh_id"), "hi", "lo")
    return select.contract_faces(t.faces, chosen)


def contract_vertices(s, d):
    chosen = independent_batch(s, d).withColumn("mesh_id", F.lit("terrain"))
    return _rounded(select.contract_vertices(terrain(s, d).vertices, chosen), "x", "y", "z")


def greedy_batch(s, d):
    """What a greedy pass by cost keeps of the shell's edges."""
    t = shell(s, d)
    edges = stored(topology.half_edges(t.faces), "edges")
    priced = quadrics.edge_candidates(topology.collapsible_edges(edges), t.vertices, quadrics.vertex_quadrics(t.faces, t.vertices))
    return _rounded(select.greedy_batch(stored(priced, "priced"), edges).select("hi", "lo", "cost"), "cost")


def simplify_batch(s, d):
    """The shell, simplified in rounds to 70 % of its vertices."""
    return _rounded(simplify(shell(s, d), SimplifyOptions(0.7, threads=PARTS)).surface.vertices, "x", "y", "z")


def simplify_sequential(s, d):
    """Edge by edge to half of the vertices, every tile of the terrain by itself."""
    return _rounded(simplify(surfaces.tiles(s, d), SimplifyOptions(0.5, mode="sequential")).surface.vertices, "x", "y", "z")


def simplify_invariants(s, d):
    """Vertices, edges, faces and Euler characteristic of the shell simplified in rounds, and its open edges."""
    done = simplify(shell(s, d), SimplifyOptions(0.7, threads=PARTS)).surface
    rim = topology.boundary_edges(topology.half_edges(done.faces)).groupBy("mesh_id").agg(F.count("*").alias("rim"))
    counts = topology.euler_characteristic(done.vertices, done.faces).join(rim, "mesh_id", "left")
    return counts.withColumn("rim", F.coalesce("rim", F.lit(0).cast("long")))


def tile_counts(s, d):
    """Vertices and faces of each tile of the terrain."""
    t = surfaces.tiles(s, d)
    return topology.euler_characteristic(t.vertices, t.faces)


def simplify_stats(s, d):
    t = terrain(s, d)
    return stats_table(simplify(t, SimplifyOptions(0.9, threads=PARTS)), t.faces).where("kind <> 'phase'")


def connected_components(s, d):
    """Islands: components of the faces whose corners all stand above the water line."""
    t = terrain(s, d)
    dry = t.faces
    for k in ("v0", "v1", "v2"):
        dry = dry.join(t.vertices.where("z > 2").select("mesh_id", F.col("vid").alias(k)), ["mesh_id", k], "left_semi")
    return quality.components(dry)


def structural_stats(s, d):
    """Of the terrain with a face without area beside each of its faces with a low first corner."""
    t = terrain(s, d)
    low = t.faces.join(t.vertices.where("z < 1").select("mesh_id", F.col("vid").alias("v0")), ["mesh_id", "v0"], "left_semi")
    bad = low.select("mesh_id", (F.col("fid") + 10_000_000).alias("fid"), F.col("v0"), F.col("v0").alias("v1"), F.col("v2"))
    return quality.structural_stats(t.vertices, t.faces.union(bad))


def raster_points(s, d):
    return _rounded(raster.raster_points(terrain(s, d).vertices, "xy", WIDTH, HEIGHT, PADDING).drop("mesh_id"), "px", "py", "depth")


def face_shades(s, d):
    t = terrain(s, d)
    return raster.face_shades(t.faces, t.vertices, "xz").drop("mesh_id")


def raster_zbuffer(s, d):
    t = terrain(s, d)
    return _rounded(raster.rasterize(t.vertices, t.faces, "xy", WIDTH, HEIGHT, PADDING).drop("mesh_id"), "depth")


def render_disagreement(s, d):
    """Pixels that differ once the terrain's high parts are cut down to half."""
    t = terrain(s, d)
    low = t.vertices.withColumn("z", F.when(F.col("z") > 2.5, 2.5).otherwise(F.col("z")))
    a, b = raster.rasterize(t.vertices, t.faces, "xy", WIDTH, HEIGHT, PADDING), raster.rasterize(low, t.faces, "xy", WIDTH, HEIGHT, PADDING)
    return _rounded(quality.render_disagreement(a, b, WIDTH, HEIGHT), "fraction")


def quality_verdict(s, d):
    # every surface is used many times; without tables of its own the plan outgrows the driver
    vertices = stored(terrain(s, d).vertices, "vertices")
    before = (vertices, stored(surfaces.grid_faces(vertices, grid_side(s, d)), "faces"))
    chosen = stored(_independent(Surface(*before)), "chosen")  # places as they are: rounding is for output only
    after = (stored(select.contract_vertices(before[0], chosen), "vertices"), stored(select.contract_faces(before[1], chosen), "faces"))
    return quality.verdict(before, after)


def raster_turned(s, d):
    t = terrain(s, d)
    return raster.turned_left(raster.rasterize(t.vertices, t.faces, "xy", WIDTH, HEIGHT, PADDING), WIDTH).select("px", "py", "color")


# The names that these had while the ones above rendered small pictures.
def raster_zbuffer_full(s, d):
    return raster_zbuffer(s, d)


def render_disagreement_full(s, d):
    return render_disagreement(s, d)


def raster_turned_full(s, d):
    return raster_turned(s, d)


def centred_vertices(s, d):
    return _rounded(raster.centred(terrain(s, d).vertices).drop("mesh_id"), "x", "y", "z")


def stride_sample(s, d):
    """Every step-th face in order, step = faces / 100 rounded down, at least 1."""
    from facetflow.operators.tables import numbered

    f = numbered(terrain(s, d).faces, ["mesh_id"], "fid", "place")
    step = max(1, f.count() // 100)
    return f.where(F.col("place") % step == 0).select("fid", "v0", "v1", "v2", "place")


def log_lines(s: SparkSession, d: str, log: str = "o_orderstatus") -> DataFrame:
    """A sweep log for every status of orders (or what log names): headers, times, repeats, orphans and noise."""
    o = s.read.parquet(f"{d}/orders.parquet")
    k = F.col("o_orderkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.floor(k / n) % len(values)).cast("int") + 1)
    head = F.concat(
        F.lit("Running"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(" mode="), pick(report.MODES, 2))), F.lit(" mesh="), pick(report.MESHES, 3), F.lit(" target_vertices="), pick(report.TARGETS, 5),
        F.lit(" threads="), pick(report.THREADS, 7).cast("string"), F.when(k % 2 == 0, " partitions=4").otherwise(""),
    )
    time = F.concat(F.lit("Simplification time: "), F.col("o_totalprice").cast("decimal(12,2)").cast("string"), F.when(k % 11 == 0, "e1").otherwise(""), F.lit(" s"))
    own = [(F.when(k % 13 == 0, "noise").otherwise(head), 0), (F.lit("  vertices: 12"), 1), (time, 2)]
    return o.select(F.col(log).cast("string").alias("log_id"), F.inline(F.array(*(F.struct((k * 3 + i).alias("line_no"), c.alias("line")) for c, i in own))))


def log_sessions(s, d):
    return sweep_log.sessions(log_lines(s, d))


def log_warnings(s, d):
    return sweep_log.warnings(log_lines(s, d))


BY_LOG = ("log_id",)


def speedups(s, d):
    return _rounded(report.speedups(log_sessions(s, d), BY_LOG), "speedup")


def time_pivot(s, d):
    return report.time_pivot(log_sessions(s, d), report.TARGETS, BY_LOG)


def missing_runs(s, d):
    """Of every log that has lines, even if no run of it was timed."""
    m = report.sweep_matrix(s, report.MODES, report.MESHES, report.TARGETS, report.THREADS, log_lines(s, d).select(*BY_LOG).distinct())
    return report.missing_runs(log_sessions(s, d), m, BY_LOG)


def missing_baselines(s, d):
    return report.missing_baselines(log_sessions(s, d), BY_LOG)


def sweep_progress(s, d):
    """The sweep matrix with how often each log ran each cell."""
    m = report.sweep_matrix(s, report.MODES, report.MESHES, report.TARGETS, report.THREADS)
    times = sweep_log.paired(log_lines(s, d)).where("has_run").groupBy(*report.KEYS, "threads").agg(F.count("*").alias("n"))
    return m.join(times, [*report.KEYS, "threads"], "left").select(*report.KEYS, "threads", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def target_order(s, d):
    return report.ranked(log_sessions(s, d), "target", report.TARGETS[::-1], BY_LOG).select(*BY_LOG, "target", F.col("rank").cast("long").alias("rank"))


def first_seen_targets(s, d):
    return report.first_seen(sweep_log.events(log_lines(s, d)), "target", "line_no")


def customer_sessions(s: SparkSession, d: str) -> DataFrame:
    """The orders of each customer as a log of their own: sweeps that lack most runs."""
    return sweep_log.sessions(log_lines(s, d, "o_custkey"))


def customer_missing_runs(s, d):
    logs = log_lines(s, d, "o_custkey").select(*BY_LOG).distinct()
    return report.missing_runs(customer_sessions(s, d), report.sweep_matrix(s, report.MODES, report.MESHES, report.TARGETS, report.THREADS, logs), BY_LOG)


def customer_missing_baselines(s, d):
    return report.missing_baselines(customer_sessions(s, d), BY_LOG)


def customer_missing_names(s, d):
    return report.missing_names(customer_sessions(s, d), BY_LOG)


def _outputs(s: SparkSession, d: str) -> DataFrame:
    """Files of simplified meshes, a name for each order; some names are none."""
    k = F.col("o_orderkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.floor(k / n) % len(values)).cast("int") + 1)
    label = F.translate(F.rtrim(F.translate(pick(report.TARGETS, 5), "%", " ")), ".", "p")
    name = F.concat(F.lit("out/"), k.cast("string"), F.lit("/"), pick(report.MESHES, 3), F.lit("_r"), label, F.lit("_t"), pick(report.THREADS, 7).cast("string"), F.when(k % 9 == 0, ".ply").otherwise(".obj"))
    return s.read.parquet(f"{d}/orders.parquet").select(name.alias("path"))


def named_outputs(s, d):
    return obj.named_outputs(_outputs(s, d))


def outputs_with_originals(s, d):
    """Outputs of two meshes, each once, and the originals of three, two of which have thread counts to go by."""
    found = obj.named_outputs(_outputs(s, d)).where("mesh <> 'dragon'").groupBy("mesh", "target", "threads").agg(F.min("path").alias("path"))
    originals = s.read.parquet(f"{d}/orders.parquet").select(F.element_at(F.array(*map(F.lit, report.MESHES)), (F.col("o_orderkey") % 3).cast("int") + 1).alias("mesh")).distinct().select("mesh", F.concat("mesh", F.lit(".obj")).alias("path"))
    return obj.add_originals(found, originals)


def render_jobs(s, d):
    """Pictures of two meshes at all targets but one, with the view and the turn of each."""
    jobs = report.render_jobs(obj.named_outputs(_outputs(s, d)), report.MESHES[1:], report.THREADS, [t.rstrip("%") for t in report.TARGETS[1:]])
    return jobs.select("mesh", "target", "threads", "path", raster.projection_of(F.col("mesh")).alias("projection"), raster.rotation_of(F.col("mesh")).alias("rotation"))


def thread_counts(s, d):
    return report.thread_counts(sweep_log.events(log_lines(s, d)).where("threads is not null"))


# The names that these had while the ones above told of one log only.
def log_speedups(s, d):
    return speedups(s, d)


def log_time_pivot(s, d):
    return time_pivot(s, d)


def log_missing_runs(s, d):
    return missing_runs(s, d)


def log_missing_baselines(s, d):
    return missing_baselines(s, d)


def log_target_order(s, d):
    return target_order(s, d)


QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [
    terrain_vertices, terrain_faces, shell_vertices, shell_faces, face_planes, total_area, face_min_rotation, half_edges, two_sided_edges, boundary_edges,
    closed_vertices, vertex_degrees, link_violations, collapsible_edges, conflict_sets, euler_characteristic, vertex_quadrics, edge_candidates,
    cheapest_collapses, bounding_box, slab_partitions, partition_counts, edge_classes, class_counts, load_imbalance, partition_topk, obj_vertices,
    obj_faces, obj_permissive_faces, obj_export, independent_batch, contract_once, contract_vertices, greedy_batch, simplify_batch, simplify_sequential,
    simplify_stats, connected_components, structural_stats, raster_points, face_shades, raster_zbuffer, render_disagreement, quality_verdict,
    raster_turned, centred_vertices, stride_sample, log_sessions, log_warnings, speedups, time_pivot, missing_runs, missing_baselines, sweep_progress, target_order,
    first_seen_targets, log_speedups, log_time_pivot, log_missing_runs, log_missing_baselines, log_target_order,
    customer_missing_runs, customer_missing_baselines, customer_missing_names, thread_counts,
    obj_polygon_faces, obj_written_vertices, obj_written_faces, simplify_invariants, tile_counts, named_outputs, outputs_with_originals, render_jobs,
    raster_zbuffer_full, render_disagreement_full, raster_turned_full,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}
