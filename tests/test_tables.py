"""Scopes of stored tables: nested ones with equal contents, and one a thread."""

import threading
from pathlib import Path

from facetflow.operators import tables


def folder(spark, df):
    return Path(tables._PATHS[df].removeprefix("file:"))


def test_equal_nested_scopes_close_in_order(spark):
    with tables.scope(spark) as keep_outer:
        with tables.scope(spark) as keep:
            a = keep(tables.stored(spark.range(3), "a"))
            b = tables.stored(spark.range(3), "b")
            where_a, where_b = folder(spark, a), folder(spark, b)
        # both scopes held the same paths; the inner one is gone
        assert where_a.exists() and not where_b.exists()
        assert len(tables._SCOPES.get()) == 1
        c = keep_outer(tables.stored(spark.range(2), "c"))
        where_c = folder(spark, c)
    assert not where_a.exists() and where_c.exists()
    assert tables._SCOPES.get() == ()
    tables.discard(c)
    assert not where_c.exists()


def test_a_failing_scope_deletes_its_tables(spark):
    seen = []
    try:
        with tables.scope(spark), tables.scope(spark):
            seen.append(folder(spark, tables.stored(spark.range(1))))
            raise KeyError("x")
    except KeyError:
        pass
    assert not seen[0].exists() and tables._SCOPES.get() == ()


def test_threads_have_scopes_of_their_own(spark):
    ready, done, seen = threading.Event(), threading.Event(), []

    def other():
        with tables.scope(spark):
            ready.set()
            done.wait(60)
            seen.append(len(tables._SCOPES.get()))

    thread = threading.Thread(target=other)
    thread.start()
    ready.wait(60)
    table = tables.stored(spark.range(1))
    where = folder(spark, table)
    done.set()
    thread.join()
    assert seen == [1] and where.exists()
    tables.discard(table)
