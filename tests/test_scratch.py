"""Intermediate tables: when they go, and what overlapping writers leave of the session's settings."""

import os
import threading

import pytest

from hashloom.plans import scratch


def tables(spark):
    folder = scratch.scratch_dir(spark)
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_tables_go_with_their_scope(spark):
    before = tables(spark)
    with scratch.scope(spark):
        outer = scratch.materialize(spark.range(5), "outer")
        with pytest.raises(KeyError), scratch.scope(spark):
            assert scratch.materialize(outer.where("id > 1"), "inner").count() == 3
            raise KeyError
        assert {t.split("-")[0] for t in tables(spark) - before} == {"outer"} and outer.count() == 5
    assert tables(spark) == before
    kept = scratch.materialize(spark.range(2), "kept")
    assert kept.count() == 2 and len(tables(spark) - before) == 1


def test_overlapping_writers_put_the_setting_back(spark):
    spark.conf.set(scratch.SHUFFLES_GO, "false")
    found = []
    work = lambda k: found.append(scratch.materialize(spark.range(1000).repartition(4).selectExpr(f"id % {k + 1} as x").distinct(), f"t{k}").count())
    threads = [threading.Thread(target=work, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert sorted(found) == [1, 2, 3, 4, 5, 6] and spark.conf.get(scratch.SHUFFLES_GO) == "false" and not scratch._writers
