from symloom.sources.declarations import declarations, scoped_tokens
from symloom.streaming.incremental import VERSIONS, changed_versions, current, follow
from tests.conftest import as_set


def drop(rows, folder, data):
    rows(data, VERSIONS).coalesce(1).write.mode("append").parquet(folder)


def test_incremental_equals_full(spark, rows, tmp_path):
    source, table, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    first = [(1, "/a", "class A { func f() { } }"), (1, "/b", "struct B { }"), (1, "/c", "enum C { }")]
    second = [(1, "/a", "class A { func g() { } }"), (1, "/b", "struct B { }"), (1, "/c", "// nothing left"), (1, "/d", None), (None, "/e", "class E { }")]
    for data in (first, second):
        drop(rows, source, data)
        follow(spark.readStream.schema(VERSIONS).parquet(source), table, state).awaitTermination()
    columns = ["filePath", "kind", "name", "parent", "line", "end_line"]
    full = declarations(scoped_tokens(rows([second[0], second[1], second[2]], VERSIONS)))
    assert as_set(current(spark, table).select(*columns)) == as_set(full.select(*columns))


def test_repeats_do_not_pass(spark, rows, tmp_path):
    source = str(tmp_path / "in")
    for data in ([(1, "/a", "x"), (1, "/b", "x")], [(1, "/a", "x"), (1, "/b", "y")]):
        drop(rows, source, data)
        query = changed_versions(spark.readStream.schema(VERSIONS).parquet(source)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
    assert as_set(spark.read.parquet(str(tmp_path / "out")).select("filePath", "content")) == {("/a", "x"), ("/b", "x"), ("/b", "y")}


def test_order_lateness_and_deletion(spark, rows, tmp_path):
    schema = VERSIONS + ", version long, deleted boolean"
    source, table, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    first = [(1, "/a", "struct Zed { }", 1, False), (1, "/a", "struct Abc { }", 2, False), (1, "/b", "struct Old { }", 5, None), (1, "/c", "struct Gone { }", 1, False), (1, "/d", "struct Kept { }", None, False)]
    second = [(1, "/b", "struct Late { }", 4, False), (1, "/c", None, 2, True), (1, "/e", None, 1, True), (1, "/d", "struct New { }", 1, False), (1, "/d", "struct Zero { }", 0, False), (None, "/f", "struct F { }", 1, False)]
    seen = []
    for data in (first, second):
        rows(data, schema).coalesce(1).write.mode("append").parquet(source)
        follow(spark.readStream.schema(schema).parquet(source), table, state).awaitTermination()
        seen.append(as_set(current(spark, table).select("filePath", "name")))
    assert seen == [{("/a", "Abc"), ("/b", "Old"), ("/c", "Gone"), ("/d", "Kept")}, {("/a", "Abc"), ("/b", "Old"), ("/d", "New")}]
