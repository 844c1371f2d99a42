from datetime import datetime

from symloom.operators.snapshots import snapshot_changes
from tests.conftest import as_set

SCHEMA = "snapshotNo int, projectId long, qualifiedName string, kind string, signature string, deliveredAt timestamp_ntz, id long, grp string, no int, state string"


def row(no, project, name, kind="function", signature="()", hour=1, id=1):
    return (no, project, name, kind, signature, datetime(2025, 1, 1, hour) if hour else None, id, "clash", 7, "clash")


def test_added_removed_changed(rows):
    data = [
        row(1, 1, "a"), row(1, 1, "b"), row(1, 1, "c"), row(1, 1, "d", signature=None),
        row(2, 1, "a", signature="( )"), row(2, 1, "c", kind="variable"), row(2, 1, "d", signature=" "), row(2, 1, "e"),
        row(4, 1, "a", signature="(x)"), row(4, 1, "b"), row(4, 1, "d"),
    ]
    want = {(1, 2, "b", "removed"), (1, 2, "c", "changed"), (1, 2, "e", "added"), (1, 4, "a", "changed"), (1, 4, "b", "added"), (1, 4, "c", "removed"), (1, 4, "e", "removed"), (1, 4, "d", "changed")}
    assert as_set(snapshot_changes(rows(data, SCHEMA))) == want


def test_corrections_repeats_and_white_space(rows):
    data = [
        row(1, 1, "a", signature="(x)", hour=2), row(1, 1, " a ", signature="(old)", hour=1), row(1, 1, "a", signature="(x)", hour=2),
        row(2, 1, "\ta", signature="( x\n)", hour=1), row(2, 1, "a", signature="(wrong)", hour=None),
    ]
    assert as_set(snapshot_changes(rows(data, SCHEMA))) == set()


def test_a_tie_has_one_result(rows):
    data = [row(1, 1, "a", signature="(x)", id=1), row(1, 1, "a", signature="(y)", id=2), row(2, 1, "a", signature="(y)", id=3)]
    assert as_set(snapshot_changes(rows(data, SCHEMA))) == set() == as_set(snapshot_changes(rows(data[::-1], SCHEMA)))


def test_a_missing_delivery_is_no_removal(rows):
    data = [row(1, 1, "a"), row(3, 1, "a"), row(1, 2, "a"), row(2, 2, "b"), row(3, 2, "a")]
    assert as_set(snapshot_changes(rows(data, SCHEMA))) == {(2, 2, "a", "removed"), (2, 2, "b", "added"), (2, 3, "b", "removed"), (2, 3, "a", "added")}


def test_nulls_and_empty(spark, rows):
    data = [row(1, 1, "a"), row(2, 1, None), row(None, 1, "x"), row(1, None, "x"), row(2, 1, "  ")]
    assert as_set(snapshot_changes(rows(data, SCHEMA))) == {(1, 2, "a", "removed")}
    assert snapshot_changes(spark.createDataFrame([], SCHEMA)).collect() == []
    assert as_set(snapshot_changes(rows([row(1, 1, "a", kind=None), row(2, 1, "a", kind=None), row(3, 1, "a")], SCHEMA))) == {(1, 3, "a", "changed")}
