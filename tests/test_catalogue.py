import importlib
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from symloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
# These read source text by rules that SQL doesn't repeat; tests hold them against fixtures instead.
WITHOUT_SQL = {"extract_declarations", "extract_calls", "extract_type_references", "resolve_references", "resolve_calls", "index_summary", "find_usages", "rename_lines", "index_symbols", "index_edges", "index_unknown"}


def test_every_core_query_has_sql_or_a_reason():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == WITHOUT_SQL
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    assert {"p2_found", "p3_found", "p4_found"} <= set(entry.queries())


def test_the_core_stands_alone(monkeypatch):
    monkeypatch.setitem(sys.modules, "symloom.llm", None)
    monkeypatch.setitem(sys.modules, "symloom.llm.catalogue", None)
    assert set(importlib.reload(entry).queries()) == set(catalogue.queries())
    core = Path(catalogue.__file__).parents[1]
    assert not [p for p in core.rglob("*.py") if "llm" not in p.relative_to(core).parts and "symloom.llm" in p.read_text()]


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data here")
def test_entry_gives_rows(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["symbol_id", "name", "kind", "n_references"] and not rows.isEmpty()
