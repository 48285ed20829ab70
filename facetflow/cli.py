"""Command line: simplify, compare, report and render OBJ files.

Errors are told on one line of the error stream, and the exit code is 1.

python -m facetflow.cli simplify IN OUT TARGET [THREADS] [--mode M] [--threads N] [--partitions N]
    [--batch-size N] [--repartition-every N] [--stats-out FILE]
python -m facetflow.cli compare REFERENCE CANDIDATE [--output FILE]
python -m facetflow.cli report LOG
python -m facetflow.cli render OBJ OUT.pgm [--mesh NAME] [--projection P] [--width N] [--height N] [--padding N]
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from facetflow.operators import quality, raster, report, tables
from facetflow.plans.options import BATCH, SEQUENTIAL, SimplifyOptions, check_paths, parse_count, parse_fraction
from facetflow.plans.simplify import simplify
from facetflow.sources import obj, sweep_log


class _Parser(argparse.ArgumentParser):
    def error(self, message: str) -> None:
        raise ValueError(f"{message}; {self.format_usage().strip()}")


def parser() -> argparse.ArgumentParser:
    # Names of commands and flags, and defaults.
    top = _Parser(prog="facetflow", allow_abbrev=False)
    commands = top.add_subparsers(dest="command", required=True, parser_class=_Parser)
    s = commands.add_parser("simplify", allow_abbrev=False)
    s.add_argument("input")
    s.add_argument("output")
    s.add_argument("target", type=parse_fraction)
    s.add_argument("threads_", nargs="?", type=parse_count, metavar="threads")
    s.add_argument("--mode", choices=(SEQUENTIAL, BATCH), default=SEQUENTIAL)
    s.add_argument("--threads", type=parse_count, default=1)
    zero = lambda text: parse_count(text, zero=True)
    for name in ("--partitions", "--batch-size", "--repartition-every"):
        s.add_argument(name, type=zero, default=0)
    s.add_argument("--stats-out")
    c = commands.add_parser("compare", allow_abbrev=False)
    c.add_argument("reference")
    c.add_argument("candidate")
    for name, kind, default in (("--width", int, 512), ("--height", int, 512), ("--padding", int, 24), ("--pixel-threshold", int, 20), ("--max-render-diff", float, 0.08), ("--max-component-increase", int, 1)):
        c.add_argument(name, type=kind, default=default)
    c.add_argument("--output")
    r = commands.add_parser("report", allow_abbrev=False)
    r.add_argument("log")
    p = commands.add_parser("render", allow_abbrev=False)
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--mesh")
    # = is needed before a view that begins with a sign
    p.add_argument("--projection", choices=(raster.AUTO, *raster.PROJECTIONS), default=raster.AUTO)
    for name, default in (("--width", 900), ("--height", 700), ("--padding", 35)):
        p.add_argument(name, type=parse_count, default=default)
    return top


def quoted(value: object) -> str:
    """A CSV field: text always in quotes, inner ones doubled; numbers bare, nothing for None."""
    if value is None:
        return ""
    return '"' + value.replace('"', '""') + '"' if isinstance(value, str) else f"{value:.17g}" if isinstance(value, float) else str(value)


def write_rows(path: str, header: list[str], rows: list, bare: tuple[int, ...] = ()) -> None:
    """A CSV file; columns numbered in bare hold fixed words, which are not quoted."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as out:
        out.write(",".join(header) + "\n")
        for row in rows:
            out.write(",".join(str(v) if i in bare else quoted(v) for i, v in enumerate(row)) + "\n")


def write_picture(pixels: list, width: int, height: int, path: str) -> None:
    """Pixels as a grey picture (binary PGM), blank where there are none: at most width x height of them."""
    grey = bytearray([raster.BLANK]) * (width * height)
    for x, y, color in pixels:
        grey[y * width + x] = color
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_bytes(f"P5 {width} {height} 255\n".encode() + bytes(grey))


def run(spark: SparkSession, argv: list[str]) -> int:
    with tables.scope(spark):
        return _run(spark, parser().parse_args(argv))


def _run(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.command == "simplify":
        check_paths(a.input, a.output)
        options = SimplifyOptions(a.target, a.threads_ or a.threads, a.mode, a.partitions, a.batch_size, a.repartition_every)
        marks = [time.time()]
        surface = obj.check(obj.read_obj(spark, a.input))
        marks.append(time.time())
        done = simplify(surface, options)
        marks.append(time.time())
        obj.write_obj_file(done.surface, a.output)
        marks.append(time.time())
        took = dict(zip(("mesh_load_seconds", "simplification_seconds", "mesh_write_seconds"), (y - x for x, y in zip(marks, marks[1:], strict=False)), strict=True))
        summary = {name: value for kind, scope, name, value, _ in done.stats if (kind, scope) == ("metric", "summary")}
        print(f"Mode: {options.mode}")
        for name in ("initial_vertex_count", "final_vertex_count", "initial_face_count", "final_face_count"):
            print(f"{name}: {summary[name]:.0f}")
        for name, seconds in took.items():
            print(f"{name}: {seconds:.3f} s")
        if a.stats_out:
            paths = [("metadata", "run", "input_path", None, a.input), ("metadata", "run", "output_path", None, a.output)]
            times = [("phase", "total", k, v, None) for k, v in took.items() if k != "simplification_seconds"]
            write_rows(a.stats_out, ["kind", "scope", "name", "numeric_value", "text_value"], done.stats[:1] + paths + done.stats[1:] + times, bare=(0,))
    elif a.command == "compare":
        pair = []
        for path in (a.reference, a.candidate):
            s = obj.read_obj(spark, path, "permissive")
            pair.append(tuple(df.withColumn("mesh_id", F.lit("m")) for df in (s.vertices, s.faces)))
        rows = quality.verdict(*pair, a.width, a.height, a.padding, a.pixel_threshold, a.max_render_diff, a.max_component_increase).collect()
        for row in rows:
            print(*row)
        if a.output:
            write_rows(a.output, ["scope", "name", "value"], [tuple(r) for r in rows])
    elif a.command == "render":
        view = a.projection
        name = a.mesh or Path(a.input).stem.split("_r")[0]
        turn = raster.DEFAULT_ROTATIONS.get(name, "none") if view == raster.AUTO else "none"
        view = raster.DEFAULT_PROJECTIONS.get(name, "xz") if view == raster.AUTO else view
        s = obj.read_obj(spark, a.input, "permissive")
        pixels, width, height = raster.rasterize(s.vertices, s.faces, view, a.width, a.height, a.padding), a.width, a.height
        if turn == "ccw":
            pixels, width, height = raster.turned_left(pixels, width), height, width
        write_picture([tuple(r) for r in pixels.select("px", "py", "color").toLocalIterator()], width, height, a.output)
    else:
        text = obj.read_lines(spark, a.log).withColumnRenamed("mesh_id", "log_id")
        runs = sweep_log.sessions(text).drop("log_id")
        sweep_log.warnings(text).show(truncate=False)
        report.speedups(runs).orderBy("mode", "mesh", "target", "threads").show(1000, truncate=False)
        report.time_pivot(runs, report.TARGETS).orderBy("mode", "mesh").show(truncate=False)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    spark = spark or SparkSession.builder.appName("facetflow").getOrCreate()
    try:
        return run(spark, sys.argv[1:] if argv is None else argv)
    except (PySparkException, Py4JJavaError) as e:  # a missing file, or a line that a source refuses
        text = str(getattr(e, "java_exception", e)).strip()
        print(f"error: {text.splitlines()[0]}", file=sys.stderr)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
    return 1


if __name__ == "__main__":
    sys.exit(main())
