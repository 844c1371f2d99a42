from pathlib import Path

import pytest
from pyspark.sql import functions as F

from symloom.plans import extraction
from symloom.sources import members
from symloom.sources.reader import Scan
from tests.conftest import as_set
from tests.test_members import SOURCE, VIEWS

FILES = "projectId long, filePath string, content string"
TWINS = "struct Own: View { var body: some View { VStack { Row(); Held(); Lost() } } }\nstruct Held { }"


@pytest.fixture
def folder(rows, tmp_path):
    files = [(1, "/a/Card.swift", SOURCE), (1, "/a/Home.swift", VIEWS), (2, "/b/Own.swift", TWINS), (1, "/b/Own.swift", TWINS), (None, "/c/Own.swift", TWINS)]
    rows(files, FILES).write.parquet(str(tmp_path / "source_files.parquet"))
    return str(tmp_path)


def _written(spark) -> set:
    return {p for p in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).rglob("part-*")}


def test_symbols_read_the_files_once_and_write_no_tokens(spark, folder):
    before = _written(spark)
    found = extraction.index_symbols(spark, folder)
    assert _written(spark) == before
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Scan parquet") == 1
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # of files, of symbols


def test_placeholders_wait_for_a_type_of_their_project(spark, folder):
    waiting = extraction.index_symbols(spark, folder).where(F.startswith("qualifiedName", F.lit("unresolved:")))
    got = as_set(waiting.where("name IN ('Row', 'Held', 'Lost')").select("projectId", "name", "kind", "filePath"))
    assert got == {(1, "Lost", "struct", None), (2, "Row", "struct", None), (2, "Lost", "struct", None)}


def test_symbols_of_kept_facts_are_the_same(spark, folder):
    sources = spark.read.parquet(f"{folder}/source_files.parquet")
    assert sorted(map(str, members.symbols(members.facts(sources)).collect())) == sorted(map(str, extraction.index_symbols(spark, folder).collect())) != []


def test_places_of_brackets():
    scan = Scan("a {\n f(x[0]) { } ; \"}\" } /* { */ b ")
    assert scan.tokens == ["a", "{", "f", "(", "x", "[", "0", "]", ")", "{", "}", ";", '"}"', "}", "b"]
    assert scan.brace == [-1, -1, *[1] * 11, -1, -1] and scan.round == [0, 0, 0, 0, 1, 1, 2, 1, 0, 0, 0, 0, 0, 0, 0]
    assert scan.mate == {3: 8, 8: 3, 5: 7, 7: 5, 9: 10, 10: 9, 1: 13, 13: 1}
    assert [scan.line(0), scan.line(2), scan.column(2)] == [1, 2, 2]
