"""Scratch tables: what they hold, and what writing them leaves behind."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

from cloneloom import scratch


def place(table):
    return table._scratch_path.removeprefix("file://").removeprefix("file:")


def names(table):
    path = place(table)
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, files in os.walk(path) for f in files)


@pytest.mark.parametrize("rows", [0, 1, 1000])
def test_local_tables_hold_data_files_only(spark, rows):
    """A checksum file or _SUCCESS would cost a process each, started by an executor or the driver."""
    table = scratch.cut(spark.range(rows).repartition(3))
    assert sorted(r.id for r in table.collect()) == list(range(rows))
    found = names(table)
    assert found and all(f.startswith("part-") and f.endswith(".parquet") for f in found)
    scratch.release(table)
    assert not os.path.exists(place(table))


def test_folders_of_the_committer_are_made_without_processes(spark, monkeypatch):
    """Hadoop without its native library starts chmod for each folder that it makes; the driver's are there before."""
    made = []
    real = Path.mkdir
    monkeypatch.setattr(Path, "mkdir", lambda self, *a, **k: (made.append(str(self)), real(self, *a, **k))[1])
    table = scratch.cut(spark.range(5))
    assert any(m.endswith("_temporary/0/_temporary") for m in made)
    assert table.count() == 5 and not os.path.exists(os.path.join(place(table), "_temporary"))


def test_a_failed_write_raises(spark):
    with pytest.raises(Exception, match="nothing to read"):
        scratch.cut(spark.range(4).selectExpr("raise_error('nothing to read') as x"))


def test_the_drivers_garbage_goes_when_its_heap_is_large(spark, monkeypatch):
    monkeypatch.setattr(scratch, "HEAP_SHARE", 0, raising=False)
    monkeypatch.setattr(scratch, "EVERY_S", 0, raising=False)
    held = spark.sparkContext._jvm.java.lang.ref.WeakReference("a string that only the reference knows")
    scratch.cut(spark.range(1))
    assert held.get() is None
