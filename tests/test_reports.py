"""Sweep reports over all logs, against plain Python."""

from itertools import product

import pytest

from facetflow.operators import report
from facetflow.plans import queries as Q


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_reports_cover_every_log(spark, sf_dir):
    runs = [tuple(r) for r in Q.log_sessions(spark, sf_dir).select("log_id", *report.KEYS, "threads", "seconds").collect()]
    logs = {r["log_id"] for r in Q.log_lines(spark, sf_dir).select("log_id").distinct().collect()}
    assert logs == {"F", "O", "P"} == {r[0] for r in runs}
    base = {r[:4]: r[5] for r in runs if r[4] == 1}
    speedups = {tuple(r)[:6]: r["speedup"] for r in Q.log_speedups(spark, sf_dir).collect()}
    assert speedups == pytest.approx({r: base[r[:4]] / r[5] for r in runs if r[:4] in base}, abs=1e-6)
    pivot = {k[:3]: tuple(base.get((*k[:3], t)) for t in report.TARGETS) for k in base}
    assert rows(Q.log_time_pivot(spark, sf_dir)) == sorted(((*k, *v) for k, v in pivot.items()), key=str)
    matrix = set(product(logs, report.MODES, report.MESHES, report.TARGETS, report.THREADS))
    assert rows(Q.log_missing_runs(spark, sf_dir)) == sorted(matrix - {r[:5] for r in runs}, key=str)
    lists = {g: [{r[k] for r in runs if r[0] == g} for k in (1, 2, 3)] for g in logs}
    every = {(g, *c) for g in logs for c in product(*lists[g])}
    assert rows(Q.log_missing_baselines(spark, sf_dir)) == sorted(every - set(base), key=str)
    ranks = {(g, t, report.TARGETS[::-1].index(t) + 1) for g in logs for t in lists[g][2]}
    assert rows(Q.log_target_order(spark, sf_dir)) == sorted(ranks, key=str)


def test_missing_baselines_by_log(spark):
    """A log that lacks a baseline is told apart from one that has it."""
    runs = spark.createDataFrame([("A", "m", "x", "1%", 1, 2.0), ("B", "m", "x", "1%", 2, 1.0)], "log_id string, mode string, mesh string, target string, threads int, seconds double")
    assert rows(report.missing_baselines(runs, ("log_id",))) == [("B", "m", "x", "1%")]
    assert report.speedups(runs, ("log_id",)).count() == 1
