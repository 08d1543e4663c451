"""One commit for several tables: whatever fails, and whenever, readers find one state whole."""

import pytest
from pyspark.sql import functions as F

from planwatch.sources.snapshots import Conflict, Snapshots, save_documents

TABLES = {"columns": "doc int, name string", "cells": "doc int, v int", "events": "doc int, text string, resolved boolean"}


def state(tables, version=None):
    return {t: sorted(map(tuple, tables.read(t, version).collect())) for t in TABLES}


def rows(spark, columns, cells, events):
    return {"columns": spark.createDataFrame(columns, TABLES["columns"]), "cells": spark.createDataFrame(cells, TABLES["cells"]), "events": spark.createDataFrame(events, TABLES["events"])}


@pytest.fixture
def saved(spark, tmp_path):
    tables = Snapshots(spark, str(tmp_path / "t"), TABLES, buckets=4)
    assert state(tables) == {t: [] for t in TABLES}
    first = rows(spark, [(d, f"c{d}") for d in range(6)], [(d, v) for d in range(6) for v in (1, 2)], [(1, "open", False), (1, "done", True), (2, "open", False)])
    assert save_documents(tables, first["events"], first["columns"], first["cells"]) == 1
    return tables


def test_documents_are_replaced_and_resolved_events_stay(spark, saved):
    before = state(saved)
    new = rows(spark, [(1, "new")], [], [(1, "now", False)])
    save_documents(saved, new["events"], new["columns"], new["cells"])
    got = state(saved)
    assert got["columns"] == [(d, "new" if d == 1 else f"c{d}") for d in range(6)] and [c for c in got["cells"] if c[0] == 1] == []
    assert got["events"] == [(1, "done", True), (1, "now", False), (2, "open", False)]
    assert state(saved, 1) == before


@pytest.mark.parametrize("step", ["columns", "cells", "events", "manifest"])
def test_a_failure_between_steps_leaves_the_old_state_whole(spark, saved, step):
    before = state(saved)

    def fails(at):
        if at == step:
            raise OSError("planted")

    new = rows(spark, [(1, "new")], [(1, 9)], [(2, "x", False)])
    docs = spark.createDataFrame([(1,), (2,)], "doc int")
    with pytest.raises(OSError, match="planted"):
        saved.commit(new, docs, after=fails)
    assert saved.version() == 1 and state(saved) == before
    assert saved.commit(new, docs) == 2 and state(saved) != before
    assert len(saved.vacuum(keep=1)) == 1 and state(saved)["columns"][1] == (1, "new")  # the failed commit's files; those of the first are still named


def test_of_two_commits_at_once_one_is_refused(spark, saved):
    new = rows(spark, [(1, "mine")], [], [])
    other = rows(spark, [(1, "theirs")], [], [])
    docs = spark.createDataFrame([(1,)], "doc int")
    with pytest.raises(Conflict):
        saved.commit(new, docs, after=lambda step: saved.commit(other, docs) if step == "manifest" else None)
    assert (1, "theirs") in state(saved)["columns"] and saved.version() == 2


def test_rows_of_other_documents_are_refused(spark, saved):
    with pytest.raises(ValueError, match="aren't named"):
        saved.commit({"columns": spark.createDataFrame([(d, "x") for d in range(20)], TABLES["columns"])}, spark.createDataFrame([(1,)], "doc int"))
    assert saved.version() == 1 and saved.read("columns").where(F.col("name") == "x").count() == 0


def test_a_document_without_rows_is_gone(spark, saved):
    saved.commit({}, spark.createDataFrame([(d,) for d in range(5)], "doc int"))
    assert state(saved) == {"columns": [(5, "c5")], "cells": [(5, 1), (5, 2)], "events": []}
