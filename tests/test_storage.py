"""Tables between the steps of a job: what a finished step leaves behind."""

import os
import pathlib

import pytest
from cadenza import storage


def folders(spark):
    return {p.name for p in pathlib.Path(storage.scratch_dir(spark).removeprefix("file:")).glob("cadenza-t-*")}


def test_settled_keeps_the_result_only(spark):
    before = folders(spark)

    def build():
        first = storage.stored(spark.range(10), "t-first")
        inner = storage.settled(lambda: storage.stored(first.filter("id > 3"), "t-deep").filter("id > 5"), "t-inner")
        return inner.union(first.filter("id = 0"))

    out = storage.settled(build, "t-out")
    left = folders(spark) - before
    assert sorted(r["id"] for r in out.collect()) == [0, 6, 7, 8, 9] and len(left) == 1 and next(iter(left)).startswith("cadenza-t-out")


def test_a_step_that_fails_leaves_later_ones_alone(spark):
    with pytest.raises(ZeroDivisionError):
        storage.settled(lambda: 1 / 0, "t-bad")
    kept = storage.stored(spark.range(3), "t-kept")
    assert storage.settled(lambda: kept.filter("id > 0"), "t-next").count() == 2 and kept.count() == 3


def test_discarded_tables_leave_no_files(spark):
    table = storage.stored(spark.range(5), "discarded")
    folder = table.inputFiles()[0].removeprefix("file:").rpartition("/")[0]
    folder = "/" + folder.lstrip("/")
    assert os.path.isdir(folder)
    storage.discard(table)
    assert not os.path.exists(folder)
