"""The registered surface queries as DuckDB SQL over the same tables, from shared table expressions."""

from __future__ import annotations

import re

from facetflow.functions.vecmath import Q
from facetflow.operators import report
from facetflow.operators.raster import PADDING, SIDE

PARTS, SIZE, PAD = 8, SIDE, PADDING

# name -> (what it needs, its body)
CTES: dict[str, tuple[str, str]] = {
    "w": ("", "SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS w FROM part"),
    "vertices": ("w", "SELECT 'terrain' AS mesh_id, vid, CAST(vid % w AS DOUBLE) AS x, CAST(vid // w AS DOUBLE) AS y, p_size / 10.0 AS z FROM (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS vid, p_size FROM part), w WHERE vid < w * w"),
    "cells": ("vertices w", "SELECT vid AS a, w FROM vertices, w WHERE x < w - 1 AND y < w - 1"),
    "faces": ("cells", "SELECT 'terrain' AS mesh_id, a * 2 AS fid, a AS v0, a + 1 AS v1, a + w + 1 AS v2 FROM cells UNION ALL SELECT 'terrain', a * 2 + 1, a, a + w + 1, a + w FROM cells"),
    "he": ("faces", "SELECT mesh_id, v0 AS src, v1 AS dst, v2 AS opp, fid FROM faces UNION ALL SELECT mesh_id, v1, v2, v0, fid FROM faces UNION ALL SELECT mesh_id, v2, v0, v1, fid FROM faces"),
    "rim": ("he", "SELECT h.* FROM he h ANTI JOIN he g ON h.src = g.dst AND h.dst = g.src"),
    "two": ("he", "SELECT h.mesh_id, h.src AS hi, h.dst AS lo, h.opp AS o1, g.opp AS o0 FROM he h JOIN he g ON h.src = g.dst AND h.dst = g.src WHERE h.src > h.dst"),
    "nbr": ("he", "SELECT src AS v, dst AS n FROM he UNION SELECT dst, src FROM he"),
    "closed": ("he rim", "SELECT DISTINCT src AS vid FROM he WHERE src NOT IN (SELECT src FROM rim) AND src NOT IN (SELECT dst FROM rim)"),
    "plane0": ("faces vertices", """SELECT f.fid, f.v0, f.v1, f.v2, a.x AS ax, a.y AS ay, a.z AS az,
      (b.y - a.y) * (c.z - a.z) - (b.z - a.z) * (c.y - a.y) AS cx, (b.z - a.z) * (c.x - a.x) - (b.x - a.x) * (c.z - a.z) AS cy, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS cz
      FROM faces f JOIN vertices a ON f.v0 = a.vid JOIN vertices b ON f.v1 = b.vid JOIN vertices c ON f.v2 = c.vid"""),
    "planes": ("plane0", """SELECT fid, v0, v1, v2, nx, ny, nz, -(nx * ax + ny * ay + nz * az) AS d, s * 0.5 AS area FROM (
      SELECT *, CASE WHEN s = 0 THEN 0 ELSE cx / s END AS nx, CASE WHEN s = 0 THEN 0 ELSE cy / s END AS ny, CASE WHEN s = 0 THEN 0 ELSE cz / s END AS nz
      FROM (SELECT *, sqrt(cx * cx + cy * cy + cz * cz) AS s FROM plane0))"""),
    "quad": ("planes vertices", "SELECT v.vid, " + ", ".join(f"coalesce(sum({'nx ny nz d'.split()['abcd'.index(k[0])]} * {'nx ny nz d'.split()['abcd'.index(k[1])]}), 0) AS q_{k}" for k in Q) + " FROM vertices v LEFT JOIN (SELECT *, unnest([v0, v1, v2]) AS vid FROM planes) p ON v.vid = p.vid GROUP BY v.vid"),
    "sums": ("two quad vertices", "SELECT t.*, u.x AS ux, u.y AS uy, u.z AS uz, l.x AS lx, l.y AS ly, l.z AS lz, " + ", ".join(f"a.q_{k} + b.q_{k} AS {k}" for k in Q) + " FROM two t JOIN quad a ON t.hi = a.vid JOIN quad b ON t.lo = b.vid JOIN vertices u ON t.hi = u.vid JOIN vertices l ON t.lo = l.vid"),
    "dets": ("sums", """SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det,
      -ad * (bb * cc - bc * bc) - ab * (-bd * cc + bc * cd) + ac * (-bd * bc + bb * cd) AS dx,
      aa * (-bd * cc + bc * cd) + ad * (ab * cc - bc * ac) + ac * (-ab * cd + bd * ac) AS dy,
      aa * (-bb * cd + bd * bc) - ab * (-ab * cd + bd * ac) - ad * (ab * bc - bb * ac) AS dz FROM sums"""),
    "points": ("dets", """SELECT *, CASE WHEN abs(det) >= 1e-8 THEN dx / det ELSE (ux + lx) / 2 END AS px, CASE WHEN abs(det) >= 1e-8 THEN dy / det ELSE (uy + ly) / 2 END AS py,
      CASE WHEN abs(det) >= 1e-8 THEN dz / det ELSE (uz + lz) / 2 END AS pz FROM dets"""),
    "cand": ("points", "SELECT hi, lo, o1, o0, px, py, pz, px * (aa * px + ab * py + ac * pz + ad) + py * (ab * px + bb * py + bc * pz + bd) + pz * (ac * px + bc * py + cc * pz + cd) + (ad * px + bd * py + cd * pz + dd) AS cost FROM points"),
    "box": ("vertices", """SELECT mesh_id, count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z,
      CASE WHEN max(x) - min(x) >= max(y) - min(y) AND max(x) - min(x) >= max(z) - min(z) THEN 'x' WHEN max(y) - min(y) >= max(z) - min(z) THEN 'y' ELSE 'z' END AS axis FROM vertices GROUP BY mesh_id"""),
    "slab": ("vertices box", f"""SELECT v.mesh_id, vid, CAST(least(least({PARTS}, n) - 1, floor(least(greatest((c - low) / span, 0), 1) * least({PARTS}, n))) AS INTEGER) AS part FROM (
      SELECT v.mesh_id, vid, n, CASE axis WHEN 'x' THEN x WHEN 'y' THEN y ELSE z END AS c, CASE axis WHEN 'x' THEN min_x WHEN 'y' THEN min_y ELSE min_z END AS low,
      greatest(CASE axis WHEN 'x' THEN max_x - min_x WHEN 'y' THEN max_y - min_y ELSE max_z - min_z END, 1e-12) AS span FROM vertices v, box) v"""),
    "class": ("cand slab", "SELECT c.*, CASE WHEN a.part = b.part AND a.part = d.part AND a.part = e.part THEN a.part END AS part FROM cand c JOIN slab a ON hi = a.vid JOIN slab b ON lo = b.vid JOIN slab d ON o1 = d.vid JOIN slab e ON o0 = e.vid"),
    "valid": ("two closed nbr", """SELECT * FROM two t WHERE hi IN (SELECT vid FROM closed) AND lo IN (SELECT vid FROM closed) AND NOT EXISTS (
      SELECT 1 FROM nbr a JOIN nbr b ON a.n = b.n WHERE a.v = t.hi AND b.v = t.lo AND a.n <> t.o1 AND a.n <> t.o0)"""),
    "ranked": ("cand valid", "SELECT c.*, row_number() OVER (ORDER BY round(cost, 6) + 0.0, c.hi, c.lo) AS r FROM cand c SEMI JOIN valid v ON c.hi = v.hi AND c.lo = v.lo"),
    "writes": ("ranked", "SELECT r, unnest([hi, lo]) AS v FROM ranked"),
    "reads": ("writes nbr", "SELECT r, v FROM writes UNION SELECT r, n FROM writes JOIN nbr ON writes.v = nbr.v"),
    "won": ("ranked reads writes", "SELECT * FROM ranked WHERE r NOT IN (SELECT a.r FROM reads a JOIN writes b ON a.v = b.v WHERE b.r < a.r)"),
    "moved": ("faces won", """SELECT f.mesh_id, fid, coalesce(a.lo, f.v0) AS v0, coalesce(b.lo, f.v1) AS v1, coalesce(c.lo, f.v2) AS v2 FROM faces f
      LEFT JOIN won a ON f.v0 = a.hi LEFT JOIN won b ON f.v1 = b.hi LEFT JOIN won c ON f.v2 = c.hi"""),
    "lines": ("", """SELECT o_orderstatus AS log_id, o_orderkey * 3 + i AS line_no, CASE i WHEN 0 THEN CASE WHEN k % 13 = 0 THEN 'noise' ELSE head END WHEN 1 THEN '  vertices: 12' ELSE tim END AS line FROM (
      SELECT *, o_orderkey AS k, 'Running' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ' mode=' || (['sequential', 'partitioned_batch'])[(o_orderkey // 2) % 2 + 1] END || ' mesh=' || (['bunny', 'buddha', 'dragon'])[(o_orderkey // 3) % 3 + 1]
        || ' target_vertices=' || (['25%', '10%', '1%', '0.5%'])[(o_orderkey // 5) % 4 + 1] || ' threads=' || ([1, 2, 4, 8, 16])[(o_orderkey // 7) % 5 + 1] || CASE WHEN o_orderkey % 2 = 0 THEN ' partitions=4' ELSE '' END AS head,
        'Simplification time: ' || CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS VARCHAR) || CASE WHEN o_orderkey % 11 = 0 THEN 'e1' ELSE '' END || ' s' AS tim FROM orders), range(0, 3) AS t(i)"""),
    "ev": ("lines", r"""SELECT log_id, line_no, kind, CASE WHEN kind = 'run' THEN CASE WHEN m[1] = '' THEN 'sequential' ELSE m[1] END END AS mode, CASE WHEN kind = 'run' THEN m[2] END AS mesh, CASE WHEN kind = 'run' THEN m[3] END AS target,
      CASE WHEN kind = 'run' THEN CAST(m[4] AS INTEGER) END AS threads, CASE WHEN kind = 'time' THEN CAST(regexp_extract(line, 'time:\s*([0-9.]+)', 1) AS DOUBLE) END AS seconds FROM (
      SELECT *, [regexp_extract(line, 'mode=(\S+)', 1), regexp_extract(line, 'mesh=(\S+)', 1), regexp_extract(line, 'target_vertices=(\S+)', 1), regexp_extract(line, 'threads=(\d+)', 1)] AS m,
      CASE WHEN line LIKE 'Running%' THEN 'run' WHEN regexp_full_match(line, 'Simplification time:\s*[0-9]+(\.[0-9]+)?\s*s\s*') THEN 'time' END AS kind FROM lines) WHERE kind IS NOT NULL"""),
    "pairs": ("ev", """SELECT log_id, line_no, seconds, coalesce(lag(kind) OVER o = 'run', false) AS has_run, lag(mode) OVER o AS mode, lag(mesh) OVER o AS mesh, lag(target) OVER o AS target, lag(threads) OVER o AS threads, kind
      FROM ev WINDOW o AS (PARTITION BY log_id ORDER BY line_no)"""),
    "sess": ("pairs", "SELECT log_id, mode, mesh, target, threads, arg_max(seconds, line_no) AS seconds FROM pairs WHERE kind = 'time' AND has_run GROUP BY ALL"),
    "runs": ("sess", "SELECT log_id, mode, mesh, target, threads, seconds FROM sess"),
    "files": ("", """SELECT 'out/' || o_orderkey || '/' || (['bunny', 'buddha', 'dragon'])[(o_orderkey // 3) % 3 + 1] || '_r' || (['25', '10', '1', '0p5'])[(o_orderkey // 5) % 4 + 1] || '_t' || ([1, 2, 4, 8, 16])[(o_orderkey // 7) % 5 + 1]
      || CASE WHEN o_orderkey % 9 = 0 THEN '.ply' ELSE '.obj' END AS path FROM orders"""),
    "outputs": ("files", r"""SELECT regexp_extract(path, '([^/]+)_r[0-9p]+_t[0-9]+\.obj$', 1) AS mesh, replace(regexp_extract(path, '_r([0-9]+(p[0-9]+)?)_t[0-9]+\.obj$', 1), 'p', '.') AS target,
      CAST(regexp_extract(path, '_t([0-9]+)\.obj$', 1) AS INTEGER) AS threads, path FROM files WHERE path LIKE '%.obj'"""),
    "tile": ("faces w", "SELECT 'tile-' || (((fid // 2) // w) // 32) || '-' || (((fid // 2) % w) // 32) AS mesh_id, fid, v0, v1, v2 FROM faces, w"),
    "matrix": ("", "SELECT * FROM (SELECT unnest(" + str(report.MODES) + ") AS mode), (SELECT unnest(" + str(report.MESHES) + ") AS mesh), (SELECT unnest(" + str(report.TARGETS) + ") AS target), (SELECT unnest(" + str(report.THREADS) + ") AS threads)"),
}


# Across, up, depth, and the part of the normal that looks at the viewer, by projection.
VIEWS = {"xy": ("x", "y", "z", "cz"), "xz": ("x", "z", "y", "cy"), "yz": ("y", "z", "x", "cx")}


def _points(vertices: str, view: str) -> str:
    u, v, depth, _ = VIEWS[view]
    return f"""SELECT vid, ({SIZE} - su * k) / 2 + ({u} - u0) * k AS px, {SIZE} - (({SIZE} - sv * k) / 2 + ({v} - v0) * k) AS py, {depth} AS depth FROM {vertices},
      (SELECT *, least({SIZE - 2 * PAD}.0 / su, {SIZE - 2 * PAD}.0 / sv) AS k FROM (SELECT min({u}) AS u0, min({v}) AS v0, greatest(max({u}) - min({u}), 1e-12) AS su, greatest(max({v}) - min({v}), 1e-12) AS sv FROM {vertices}))"""


def _raster(points: str, faces: str, planes: str, view: str) -> str:
    """The pixels of a surface: px, py, depth, color.  Each face meets the pixels of its box only."""
    return f"""SELECT px, py, arg_max(depth, (depth, -fid)) AS depth, arg_max(color, (depth, -fid)) AS color FROM (
      SELECT fid, i AS px, j AS py, color, round(w0 * ad + w1 * bd + w2 * cd, 9) + 0.0 AS depth FROM (
        SELECT *, ((i + 0.5 - bx) * (cy - by_) - (j + 0.5 - by_) * (cx - bx)) / area AS w0, ((i + 0.5 - cx) * (ay - cy) - (j + 0.5 - cy) * (ax - cx)) / area AS w1, ((i + 0.5 - ax) * (by_ - ay) - (j + 0.5 - ay) * (bx - ax)) / area AS w2 FROM (
          SELECT *, unnest(range(greatest(0, CAST(floor(least(ay, by_, cy)) AS BIGINT)), least({SIZE - 1}, CAST(ceil(greatest(ay, by_, cy)) AS BIGINT)) + 1)) AS j FROM (
            SELECT *, (cx - ax) * (by_ - ay) - (cy - ay) * (bx - ax) AS area, unnest(range(greatest(0, CAST(floor(least(ax, bx, cx)) AS BIGINT)), least({SIZE - 1}, CAST(ceil(greatest(ax, bx, cx)) AS BIGINT)) + 1)) AS i FROM (
              SELECT f.fid, a.px AS ax, a.py AS ay, a.depth AS ad, b.px AS bx, b.py AS by_, b.depth AS bd, c.px AS cx, c.py AS cy, c.depth AS cd,
                CAST(round_even(215 - 85 * abs(s.{VIEWS[view][3]} / greatest(sqrt(s.cx * s.cx + s.cy * s.cy + s.cz * s.cz), 1e-12)), 0) AS INTEGER) AS color
              FROM {faces} f JOIN {points} a ON f.v0 = a.vid JOIN {points} b ON f.v1 = b.vid JOIN {points} c ON f.v2 = c.vid JOIN {planes} s ON f.fid = s.fid)))
        WHERE abs(area) >= 1e-8)
      WHERE w0 >= 0 AND w1 >= 0 AND w2 >= 0) GROUP BY px, py"""


MIN_FIRST = """CASE WHEN {0} <= {1} AND {0} <= {2} THEN {0} WHEN {1} < {0} AND {1} <= {2} THEN {1} ELSE {2} END AS v0,
  CASE WHEN {0} <= {1} AND {0} <= {2} THEN {1} WHEN {1} < {0} AND {1} <= {2} THEN {2} ELSE {0} END AS v1,
  CASE WHEN {0} <= {1} AND {0} <= {2} THEN {2} WHEN {1} < {0} AND {1} <= {2} THEN {0} ELSE {1} END AS v2"""

SHELL_FACES = f"""SELECT 'shell' AS mesh_id, fid, {MIN_FIRST.format("a", "b", "c")} FROM (
  SELECT fid, v0 AS a, v1 AS b, v2 AS c FROM faces UNION ALL SELECT fid + 2 * w * w, v0 + w * w, v2 + w * w, v1 + w * w FROM faces, w
  UNION ALL SELECT 4 * w * w + 2 * src, dst, src, src + w * w FROM rim, w UNION ALL SELECT 4 * w * w + 2 * src + 1, dst, src + w * w, dst + w * w FROM rim, w)"""

# the terrain with its high parts cut down
CTES["lowv"] = ("vertices", "SELECT mesh_id, vid, x, y, least(z, 2.5) AS z FROM vertices")
CTES["lowplane"] = ("faces lowv", CTES["plane0"][1].replace("JOIN vertices", "JOIN lowv"))
CTES["low"] = ("lowv", _points("lowv", "xy"))
CTES["lowpixels"] = ("faces low lowplane", _raster("low", "faces", "lowplane", "xy"))
# the terrain after one batch of collapses
CTES["afterv"] = ("won vertices", "SELECT v.mesh_id, vid, coalesce(px, x) AS x, coalesce(py, y) AS y, coalesce(pz, z) AS z FROM (SELECT * FROM vertices WHERE vid NOT IN (SELECT hi FROM won)) v LEFT JOIN won ON vid = lo")
CTES["afterf"] = ("moved", f"SELECT mesh_id, fid, {MIN_FIRST.format('a', 'b', 'c')} FROM (SELECT mesh_id, fid, v0 AS a, v1 AS b, v2 AS c FROM moved WHERE v0 <> v1 AND v1 <> v2 AND v0 <> v2)")
CTES["afterplane"] = ("afterf afterv", CTES["plane0"][1].replace("FROM faces", "FROM afterf").replace("JOIN vertices", "JOIN afterv"))
for _view in VIEWS:
    for _name, _v, _f, _plane in (("", "vertices", "faces", "plane0"), ("after_", "afterv", "afterf", "afterplane")):
        CTES[f"{_name}pts_{_view}"] = (_v, _points(_v, _view))
        CTES[f"{_name}pixels_{_view}"] = (f"{_f} {_name}pts_{_view} {_plane}", _raster(f"{_name}pts_{_view}", _f, _plane, _view))
# the chain from faces to ranked collapses once more, for the shell
CTES["s_vertices"] = ("vertices w", "SELECT 'shell' AS mesh_id, vid, x, y, z FROM vertices UNION ALL SELECT 'shell', vid + w * w, x, y, z - 10 FROM vertices, w")
CTES["s_faces"] = ("faces rim w", SHELL_FACES)
_CHAIN = "he rim two nbr closed plane0 planes quad sums dets points cand valid ranked writes reads".split()
for _name in _CHAIN:
    _needs, _body = CTES[_name]
    _own = lambda text: re.sub(rf"\b({'|'.join(['vertices', 'faces', *_CHAIN])})\b", r"s_\1", text)
    CTES[f"s_{_name}"] = (_own(_needs), _own(_body))
# the chain from log lines to runs once more, with a log for each customer
_LOGS = "lines ev pairs sess runs".split()
for _name in _LOGS:
    _needs, _body = CTES[_name]
    _own = lambda text: re.sub(rf"\b({'|'.join(_LOGS)})\b", r"c_\1", text)
    CTES[f"c_{_name}"] = (_own(_needs), _own(_body.replace("o_orderstatus AS log_id", "CAST(o_custkey AS VARCHAR) AS log_id")))
#: Rounds of the greedy choice: collapses that no conflicting one precedes are won, and what reads their ends goes.
GREEDY = """rounds(step, r, state) AS (SELECT 0, r, 'left' FROM s_ranked UNION ALL (
  WITH l AS (SELECT step, r FROM rounds WHERE state = 'left'),
    f AS (SELECT v, min(w.r) AS m FROM s_writes w JOIN l ON w.r = l.r GROUP BY v),
    late AS (SELECT DISTINCT a.r FROM s_reads a JOIN l ON a.r = l.r JOIN f ON a.v = f.v WHERE f.m < a.r),
    best AS (SELECT step, r FROM l WHERE r NOT IN (SELECT r FROM late)),
    ends AS (SELECT DISTINCT v FROM s_writes w JOIN best ON w.r = best.r),
    gone AS (SELECT DISTINCT a.r FROM s_reads a JOIN l ON a.r = l.r JOIN ends ON a.v = ends.v)
  SELECT step + 1, r, 'won' FROM best UNION ALL SELECT step + 1, r, 'left' FROM l WHERE r NOT IN (SELECT r FROM gone)))"""
MATERIALIZED = {"s_ranked", "s_writes", "s_reads"}


def _ordered(names: str, done: list[str]) -> list[str]:
    for name in names.split():
        if name not in done:
            _ordered(CTES[name][0], done)
            done.append(name)
    return done


def sql(needs: str, body: str, recursive: str = "") -> str:
    parts = [f'"{n}" AS {"MATERIALIZED " if n in MATERIALIZED else ""}({CTES[n][1]})' for n in _ordered(needs, [])]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([*parts, *([recursive] if recursive else [])])} {body}"


def _tidy(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in columns)


def _euler(name: str, vertices: str, faces: str) -> str:
    return f"""SELECT '{name}' AS mesh_id, v, e, f, v - e + f AS chi FROM (SELECT {vertices} AS v FROM vertices), (SELECT count(*) AS f FROM {faces}),
      (SELECT count(*) AS e FROM (SELECT least(v0, v1), greatest(v0, v1) FROM {faces} UNION SELECT least(v1, v2), greatest(v1, v2) FROM {faces} UNION SELECT least(v0, v2), greatest(v0, v2) FROM {faces}))"""


BROKEN = """bf AS (SELECT fid, v0, v1, v2 FROM faces UNION ALL SELECT fid + 10000000, v0, v2, 0 FROM faces JOIN vertices ON v0 = vid WHERE z < 1 AND v0 <> 0),
  bh AS (SELECT src, dst, arg_max(opp, fid) AS opp FROM (SELECT v0 AS src, v1 AS dst, v2 AS opp, fid FROM bf UNION ALL SELECT v1, v2, v0, fid FROM bf UNION ALL SELECT v2, v0, v1, fid FROM bf) GROUP BY src, dst),
  bt AS (SELECT h.src AS hi, h.dst AS lo, h.opp AS o1, g.opp AS o0 FROM bh h JOIN bh g ON h.src = g.dst AND h.dst = g.src WHERE h.src > h.dst),
  bn AS (SELECT src AS v, dst AS n FROM bh UNION SELECT dst, src FROM bh)"""

COMPONENTS = """part_faces AS (SELECT f.* FROM faces f JOIN vertices a ON v0 = a.vid JOIN vertices b ON v1 = b.vid JOIN vertices c ON v2 = c.vid WHERE a.z > 2 AND b.z > 2 AND c.z > 2),
  adj AS (SELECT v0 AS a, v1 AS b FROM part_faces UNION SELECT v1, v0 FROM part_faces UNION SELECT v1, v2 FROM part_faces UNION SELECT v2, v1 FROM part_faces UNION SELECT v0, v2 FROM part_faces UNION SELECT v2, v0 FROM part_faces)"""


def _differing(a: str, b: str) -> str:
    return f"SELECT count(*) FILTER (abs(coalesce(a.color, 255) - coalesce(b.color, 255)) > 20) AS n FROM {a} a FULL JOIN {b} b ON a.px = b.px AND a.py = b.py"


def _components(faces: str, vertices: str, name: str) -> str:
    """Table expressions that count the components of a surface in which every vertex is used."""
    return f"""{name}_adj AS (SELECT v0 AS a, v1 AS b FROM {faces} UNION SELECT v1, v0 FROM {faces} UNION SELECT v1, v2 FROM {faces} UNION SELECT v2, v1 FROM {faces} UNION SELECT v0, v2 FROM {faces} UNION SELECT v2, v0 FROM {faces}),
      {name}_reach(n, step) AS (SELECT min(a), 0 FROM {name}_adj UNION SELECT b, 0 FROM {name}_reach JOIN {name}_adj ON n = a)"""


def _verdict() -> str:
    """The terrain against itself after one batch; both are connected, which reaching every vertex from the least shows."""
    views = [f"SELECT '{v}' AS view, n FROM ({_differing(f'pixels_{v}', f'after_pixels_{v}')})" for v in VIEWS]
    rows = []
    for scope, v, f, name in (("reference", "vertices", "faces", "one"), ("candidate", "afterv", "afterf", "two")):
        rows += [f"SELECT '{scope}' AS scope, '{n}' AS name, CAST(({q}) AS VARCHAR) AS value" for n, q in (
            ("vertices", f"SELECT count(*) FROM {v}"), ("faces", f"SELECT count(*) FROM {f}"), ("degenerate_faces", f"SELECT count(*) FROM {f} WHERE v0 = v1 OR v1 = v2 OR v0 = v2"),
            ("components", f"SELECT CASE WHEN (SELECT count(*) FROM {name}_reach) = (SELECT count(*) FROM {v}) THEN 1 END"),
        )]
    mean = f"(SELECT sum(n) / {3.0 * SIZE * SIZE} FROM diffs)"
    rows += [f"SELECT 'summary', 'average_render_diff', CAST({mean} AS VARCHAR)", "SELECT 'summary', 'component_increase', '0'", f"SELECT 'summary', 'flagged', CAST({mean} > 0.08 AS VARCHAR)"]
    rows += [f"SELECT 'render_diff', view, CAST(n / {SIZE * SIZE}.0 AS VARCHAR) FROM diffs"]
    needs = "afterv afterf " + " ".join(f"pixels_{v} after_pixels_{v}" for v in VIEWS)
    return sql(needs, " UNION ALL ".join(rows), f"diffs AS ({' UNION ALL '.join(views)}), {_components('faces', 'vertices', 'one')}, {_components('afterf', 'afterv', 'two')}")


def _reports(pivot: str, lines: str = "lines", runs: str = "runs") -> dict[str, str]:
    """Sweep reports for every log."""
    keys = ("log_id", "mode", "mesh", "target", "threads")
    same = lambda names: " AND ".join(f"m.{k} = r.{k}" for k in names)
    return {
        "speedups": sql(runs, f"SELECT log_id, mode, mesh, target, a.threads, a.seconds, round(b.seconds / a.seconds, 6) + 0.0 AS speedup FROM {runs} a JOIN {runs} b USING (log_id, mode, mesh, target) WHERE b.threads = 1"),
        "time_pivot": sql(runs, f"SELECT log_id, mode, mesh, {pivot} FROM {runs} WHERE threads = 1 GROUP BY log_id, mode, mesh"),
        "missing_runs": sql(f"{runs} matrix", f"SELECT m.* FROM (SELECT * FROM (SELECT DISTINCT log_id FROM {lines}), matrix) m ANTI JOIN {runs} r ON {same(keys)}"),
        "missing_baselines": sql(runs, f"SELECT m.* FROM (SELECT DISTINCT a.log_id, a.mode, b.mesh, c.target FROM {runs} a JOIN {runs} b ON a.log_id = b.log_id JOIN {runs} c ON a.log_id = c.log_id) m ANTI JOIN (SELECT * FROM {runs} WHERE threads = 1) r ON {same(keys[:4])}"),
        "target_order": sql(runs, f"SELECT DISTINCT log_id, target, CAST(coalesce(nullif(list_position({report.TARGETS[::-1]}, target), 0), 5) AS BIGINT) AS rank FROM {runs}"),
    }


def oracle_sql() -> dict[str, str]:
    pivot = ", ".join(f"max(CASE WHEN target = '{t}' THEN seconds END) AS t_{t.rstrip('%').replace('.', 'p')}" for t in report.TARGETS)
    zbuffer = sql("pixels_xy", f"SELECT CAST(px AS INTEGER) AS px, CAST(py AS INTEGER) AS py, {_tidy('depth')}, color FROM pixels_xy")
    disagreement = sql("pixels_xy lowpixels", f"SELECT 'terrain' AS mesh_id, n AS differing, round(n / {SIZE * SIZE}, 6) + 0.0 AS fraction FROM ({_differing('pixels_xy', 'lowpixels')})")
    turned = sql("pixels_xy", f"SELECT CAST(py AS INTEGER) AS px, CAST({SIZE - 1} - px AS INTEGER) AS py, color FROM pixels_xy")
    reports = _reports(pivot)
    return {
        "terrain_vertices": sql("vertices", "SELECT * FROM vertices"),
        "terrain_faces": sql("faces", "SELECT * FROM faces"),
        "shell_vertices": sql("vertices w", "SELECT 'shell' AS mesh_id, vid, x, y, round(z, 6) + 0.0 AS z FROM vertices UNION ALL SELECT 'shell', vid + w * w, x, y, round(z - 10, 6) + 0.0 FROM vertices, w"),
        "shell_faces": sql("faces rim w", SHELL_FACES),
        "face_planes": sql("planes", f"SELECT fid, {_tidy('nx', 'ny', 'nz', 'd', 'area')} FROM planes"),
        "total_area": sql("planes", "SELECT round(sum(area), 3) AS area, count(*) AS faces FROM planes"),
        "face_min_rotation": sql("faces", f"SELECT mesh_id, fid, {MIN_FIRST.format('b', 'c', 'a')} FROM (SELECT mesh_id, fid, v0 AS a, v1 AS b, v2 AS c FROM faces)"),
        "half_edges": sql("he", "SELECT * FROM he"),
        "two_sided_edges": sql("two", "SELECT * FROM two"),
        "boundary_edges": sql("rim", "SELECT * FROM rim"),
        "closed_vertices": sql("closed", "SELECT 'terrain' AS mesh_id, vid FROM closed"),
        "vertex_degrees": sql("nbr", "SELECT v AS vid, count(*) AS degree FROM nbr GROUP BY v"),
        "link_violations": sql("faces vertices", f", {BROKEN} SELECT DISTINCT 'terrain' AS mesh_id, hi, lo FROM bt JOIN bn a ON a.v = hi JOIN bn b ON b.v = lo AND a.n = b.n WHERE a.n <> o1 AND a.n <> o0"),
        "collapsible_edges": sql("valid", "SELECT * FROM valid"),
        "conflict_sets": sql("two", "SELECT hi, lo, array_to_string(list_sort(list_distinct([hi, lo, o1, o0])), ',') AS claim FROM two"),
        "euler_characteristic": sql("faces rim w vertices", f", sf AS ({SHELL_FACES}) {_euler('terrain', 'count(*)', 'faces')} UNION ALL {_euler('shell', '2 * count(*)', 'sf')}"),
        "vertex_quadrics": sql("quad", "SELECT vid, " + _tidy(*(f"q_{k}" for k in Q)) + " FROM quad"),
        "edge_candidates": sql("cand", f"SELECT hi, lo, o1, o0, {_tidy('px', 'py', 'pz', 'cost')} FROM cand"),
        "cheapest_collapses": sql("cand", f"SELECT hi, lo, {_tidy('cost')} FROM (SELECT * FROM cand ORDER BY round(cost, 6) + 0.0, hi, lo LIMIT 10)"),
        "bounding_box": sql("box", "SELECT * FROM box"),
        "slab_partitions": sql("slab", "SELECT * FROM slab"),
        "partition_counts": sql("slab", "SELECT mesh_id, part, count(*) AS vertices FROM slab GROUP BY ALL"),
        "edge_classes": sql("class", 'SELECT hi, lo, part FROM "class"'),
        "class_counts": sql("class", 'SELECT \'terrain\' AS mesh_id, count(part) AS interior, count(*) - count(part) AS boundary, round(count(part) / count(*), 6) + 0.0 AS interior_fraction, round((count(*) - count(part)) / count(*), 6) + 0.0 AS boundary_fraction FROM "class"'),
        "load_imbalance": sql("class", f"""SELECT 'terrain' AS mesh_id, most, least, round(CASE WHEN most = 0 THEN 1.0 WHEN least = 0 THEN most ELSE most / least END, 6) + 0.0 AS imbalance FROM (
          SELECT max(n) AS most, min(n) AS least FROM (SELECT p, count(part) AS n FROM range({PARTS}) t(p) LEFT JOIN "class" c ON c.part = p GROUP BY p))"""),
        "partition_topk": sql("class", f'SELECT part, CAST(place AS INTEGER) AS place, hi, lo, {_tidy("cost")} FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY round(cost, 6) + 0.0, hi, lo) AS place FROM "class" WHERE part IS NOT NULL) WHERE place <= 16'),
        "obj_vertices": sql("vertices", "SELECT * FROM vertices"),
        "obj_faces": sql("faces w", "SELECT mesh_id, fid * 4 + w * w AS fid, v0, v1, v2 FROM faces, w"),
        "obj_permissive_faces": sql("faces w", "SELECT mesh_id, fid * 4 + w * w AS fid, v0, v1, v2 FROM faces, w UNION ALL SELECT mesh_id, fid * 4 + w * w + 1, v0, v2, v1 FROM faces, w UNION ALL SELECT mesh_id, fid * 4 + w * w + 2, v0, v0, v1 FROM faces, w"),
        "obj_written_vertices": sql("vertices", "SELECT * FROM vertices"),
        "obj_written_faces": sql("faces w", "SELECT mesh_id, w * w + row_number() OVER (ORDER BY v0, v1, v2) - 1 AS fid, v0, v1, v2 FROM faces, w"),
        "obj_export": sql("faces vertices", """, k AS (SELECT *, row_number() OVER (ORDER BY vid) - 1 AS i FROM vertices WHERE z >= 1) SELECT 0 AS section, i AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c, 'v ' || x || ' ' || y || ' ' || z AS line FROM k
          UNION ALL SELECT 1, a.i, b.i, c.i, 'f ' || (a.i + 1) || ' ' || (b.i + 1) || ' ' || (c.i + 1) FROM faces JOIN k a ON v0 = a.vid JOIN k b ON v1 = b.vid JOIN k c ON v2 = c.vid"""),
        "independent_batch": sql("won", f"SELECT hi, lo, {_tidy('px', 'py', 'pz', 'cost')} FROM won"),
        "contract_once": sql("moved", f"SELECT mesh_id, fid, {MIN_FIRST.format('a', 'b', 'c')} FROM (SELECT mesh_id, fid, v0 AS a, v1 AS b, v2 AS c FROM moved WHERE v0 <> v1 AND v1 <> v2 AND v0 <> v2)"),
        "contract_vertices": sql("won vertices", "SELECT v.mesh_id, vid, round(coalesce(px, x), 6) + 0.0 AS x, round(coalesce(py, y), 6) + 0.0 AS y, round(coalesce(pz, z), 6) + 0.0 AS z FROM (SELECT * FROM vertices WHERE vid NOT IN (SELECT hi FROM won)) v LEFT JOIN won ON vid = lo"),
        "connected_components": sql("faces vertices", "SELECT 'terrain' AS mesh_id, n AS vid, min(c) AS component FROM reach GROUP BY n", f"{COMPONENTS}, reach(n, c) AS (SELECT a, a FROM adj UNION SELECT adj.b, reach.c FROM reach JOIN adj ON reach.n = adj.a AND reach.c < adj.b)"),
        "structural_stats": sql("faces vertices", "SELECT 'terrain' AS mesh_id, (SELECT count(*) FROM vertices) AS vertices, (SELECT count(*) FROM faces) + (SELECT count(*) FROM faces JOIN vertices ON v0 = vid WHERE z < 1) AS faces, (SELECT count(*) FROM faces JOIN vertices ON v0 = vid WHERE z < 1) AS degenerate_faces, CAST(1 AS BIGINT) AS components"),
        "raster_points": sql("pts_xy", f"SELECT vid, {_tidy('px', 'py', 'depth')} FROM pts_xy"),
        "face_shades": sql("plane0", "SELECT fid, CAST(round_even(215 - 85 * abs(cy / greatest(sqrt(cx * cx + cy * cy + cz * cz), 1e-12)), 0) AS INTEGER) AS color FROM plane0"),
        "raster_zbuffer": zbuffer,
        "raster_zbuffer_full": zbuffer,
        "render_disagreement": disagreement,
        "render_disagreement_full": disagreement,
        "raster_turned": turned,
        "raster_turned_full": turned,
        "quality_verdict": _verdict(),
        "greedy_batch": sql("s_ranked s_writes s_reads", f"SELECT hi, lo, {_tidy('cost')} FROM rounds JOIN s_ranked USING (r) WHERE state = 'won'", GREEDY),
        "centred_vertices": sql("vertices", ", m AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS s FROM vertices) SELECT vid, round((x - mx) / s, 6) + 0.0 AS x, round((y - my) / s, 6) + 0.0 AS y, round((z - mz) / s, 6) + 0.0 AS z FROM vertices, m"),
        "stride_sample": sql("faces", "SELECT fid, v0, v1, v2, place FROM (SELECT *, row_number() OVER (ORDER BY fid) - 1 AS place, count(*) OVER () AS n FROM faces) WHERE place % greatest(1, n // 100) = 0"),
        "log_sessions": sql("sess", "SELECT * FROM sess"),
        "log_warnings": sql("pairs", """SELECT log_id, count(*) FILTER (kind = 'time' AND NOT has_run) AS orphans, CAST(count(*) FILTER (kind = 'time' AND has_run) - count(DISTINCT CASE WHEN kind = 'time' AND has_run THEN (mode, mesh, target, threads) END) AS BIGINT) AS duplicates,
          arg_max(kind, line_no) = 'run' AS unfinished FROM pairs GROUP BY log_id"""),
        **reports,
        **{f"log_{name}": text for name, text in reports.items()},
        **{f"customer_{name}": text for name, text in _reports(pivot, "c_lines", "c_runs").items() if name.startswith("missing")},
        "customer_missing_names": sql("c_runs", " UNION ALL ".join(f"SELECT r.log_id, r.mode, '{kind}' AS kind, e.value FROM (SELECT DISTINCT log_id, mode FROM c_runs) r, (SELECT unnest({[str(v) for v in values]}) AS value) e WHERE NOT EXISTS (SELECT 1 FROM c_runs x WHERE x.log_id = r.log_id AND x.mode = r.mode AND CAST(x.{kind} AS VARCHAR) = e.value)" for kind, values in (("target", report.TARGETS), ("mesh", report.MESHES), ("threads", report.THREADS)))),
        "sweep_progress": sql("matrix pairs", "SELECT m.*, count(p.line_no) AS n FROM matrix m LEFT JOIN (SELECT * FROM pairs WHERE kind = 'time' AND has_run) p ON m.mode = p.mode AND m.mesh = p.mesh AND m.target = p.target AND m.threads = p.threads GROUP BY ALL"),
        "obj_polygon_faces": sql("faces", "SELECT mesh_id, row_number() OVER (ORDER BY fid) - 1 AS fid, v0, v1, v2 FROM faces"),
        "named_outputs": sql("outputs", "SELECT * FROM outputs"),
        "outputs_with_originals": sql("outputs", """, o AS (SELECT mesh, target, threads, min(path) AS path FROM outputs WHERE mesh <> 'dragon' GROUP BY ALL)
          SELECT * FROM o UNION ALL SELECT m.mesh, '100', coalesce(t.threads, 1), m.mesh || '.obj' FROM (SELECT unnest(['bunny', 'buddha', 'dragon']) AS mesh) m LEFT JOIN (SELECT DISTINCT mesh, threads FROM o) t ON m.mesh = t.mesh"""),
        "render_jobs": sql("outputs", "SELECT mesh, target, threads, path, CASE mesh WHEN 'buddha' THEN '-xy' ELSE 'yz' END AS projection, CASE mesh WHEN 'dragon' THEN 'ccw' ELSE 'none' END AS rotation FROM outputs WHERE mesh <> 'bunny' AND target <> '25'"),
        "tile_counts": sql("tile", """SELECT mesh_id, v, e, f, v - e + f AS chi FROM (SELECT mesh_id, count(*) AS f FROM tile GROUP BY mesh_id) JOIN (SELECT mesh_id, count(DISTINCT u) AS v FROM (SELECT mesh_id, unnest([v0, v1, v2]) AS u FROM tile) GROUP BY mesh_id) USING (mesh_id)
          JOIN (SELECT mesh_id, count(*) AS e FROM (SELECT mesh_id, v0 AS p, v1 AS q FROM tile UNION SELECT mesh_id, least(v1, v2), greatest(v1, v2) FROM tile UNION SELECT mesh_id, v0, v2 FROM tile) GROUP BY mesh_id) USING (mesh_id)"""),
        # every collapse of a closed surface takes a vertex, three edges and two faces
        "simplify_invariants": sql("s_vertices s_faces", """, n AS (SELECT (SELECT count(*) FROM s_vertices) AS v, (SELECT count(*) FROM s_faces) AS f),
          m AS (SELECT v, f, v - CAST(greatest(1, ceil(CAST(0.7 AS DOUBLE) * v)) AS BIGINT) AS k FROM n)
          SELECT 'shell' AS mesh_id, v - k AS v, f * 3 // 2 - 3 * k AS e, f - 2 * k AS f, v - f // 2 AS chi, CAST(0 AS BIGINT) AS rim FROM m"""),
        "thread_counts": sql("ev", "SELECT DISTINCT threads FROM ev WHERE threads IS NOT NULL"),
        "first_seen_targets": sql("ev", "SELECT target, min(line_no) AS line_no FROM ev WHERE target IS NOT NULL GROUP BY target"),
    }
