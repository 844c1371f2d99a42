import re

import pytest

from symloom.plans import extraction
from symloom.sources import declarations as table_form
from symloom.sources import reader
from tests.test_members import VIEWS
from tests.test_receivers import SWIFT as RECEIVERS
from tests.test_sources import SWIFT

FILES = "projectId long, filePath string, content string"
LOCALS = """class A { func f() {
    let a: [B<C, D>], d: E = x; a.go(); d.go()
    struct In { func g() { a.no(); let `in`: F!; `in`.go() } }
    lost()
    for c: G in x { c.no() }
    let t: (H) ->
        I
    t.go(); Ünit.m(); éa(); self.b.m(); Self.n(); super.o()
    } }
func free(x: Int) { if true { A.b.c(); A.b.c.d(); Make() } }"""


def test_calls_of_one_pass_are_those_of_the_token_table(rows):
    whole = [SWIFT, RECEIVERS, VIEWS, LOCALS]
    words = [re.findall(r"\w+|\s+|.", t, re.DOTALL) for t in whole]
    # Odd texts: each with a stretch left out.
    odd = ["".join(w[:i] + w[i + 2 :]) for w in words for i in range(0, len(w), 7)]
    files = rows([(1, f"/{i}.swift", t) for i, t in enumerate([*whole, *odd, "", "f(", "func f() { g("])], FILES)
    old, new = table_form.calls(table_form.scoped_tokens(files)), reader.calls(files)
    assert new.columns == old.columns
    assert sorted(map(str, new.collect())) == sorted(map(str, old.collect())) != []


def test_resolving_calls_reads_each_text_once(spark, monkeypatch):
    at = "/root/testdata/sf0.001"
    read = spark.sparkContext.accumulator(0)

    def counted(text, path):
        read.add(1)
        return reader.read_calls(text)

    per_file = reader._per_file
    monkeypatch.setattr(reader, "_per_file", lambda sources, columns, _: per_file(sources, columns, counted))
    edges = extraction.resolve_calls(spark, at).collect()
    files = spark.read.parquet(f"{at}/source_files.parquet").where("content IS NOT NULL AND filePath IS NOT NULL").select("projectId", "filePath").distinct().count()
    assert edges and read.value == files


@pytest.mark.parametrize("text", ["f(" * 3000, "func f() { " * 1000, "let a: " * 3000, "func f() { let a: B<" * 500])
def test_calls_of_deep_texts(text):
    assert isinstance(reader.read_calls(text), list)
