from symloom.operators import resolve
from symloom.sources.declarations import calls, scoped_tokens
from tests.conftest import as_set
from tests.test_resolve import NODES, node

SWIFT = '''class App {
    func run() {
        before.load()
        let c: Client = make(); c.load()
        var d: Store<Int, [String: Int]>? = nil, e: Client!
        d.save()
        e.stop()
        let e: Net.Socket
        e.stop()
        if let g: Guess = x { g.no() }
        other.load(c.last())
        self.c.deep()
        Upper.shared.m()
        Upper.a.b.far()
        Mod.Kind.make()
        c?.maybe()
        foo(a, c: x)
        func inner() { c.lost() }
    }
    func next() { c.load() }
}
'''


def test_receivers_of_instance_calls(rows):
    scoped = scoped_tokens(rows([(1, "/a.swift", SWIFT)], "projectId long, filePath string, content string"))
    got = as_set(calls(scoped).where("call_kind IN ('instanceCall', 'staticCall')").select("callee", "receiver", "call_kind", "line"))
    of = "instanceCall"
    assert got == {
        ("load", None, of, 3), ("load", "Client", of, 4), ("save", "Store<Int, [String: Int]>", of, 6), ("stop", "Client", of, 7), ("stop", "Net.Socket", of, 9), ("no", None, of, 10), ("load", None, of, 11), ("last", "Client", of, 11), ("deep", None, of, 12),
        ("m", "Upper", "staticCall", 13), ("far", None, of, 14), ("make", "Mod", "staticCall", 15), ("maybe", None, of, 16), ("lost", None, of, 18), ("load", None, of, 20),
    }


def test_annotated_locals_give_edges(rows):
    text = "class App { func run() {\nlet c: Client = x\nc.load() } }"
    nodes = rows([node(1, "class", "Client"), node(2, "function", "load", "Client.load"), node(3, "function", "run", "App.run", line=1)], NODES)
    found = calls(scoped_tokens(rows([(1, "/a.swift", text)], "projectId long, filePath string, content string")))
    assert as_set(resolve.call_edges(nodes, rows([(1, 2)], "sourceId long, targetId long"), found)) == {(3, 2, "instanceCall")}


def test_receivers_from_the_compiler(rows):
    calls_of = rows([(1, "/a", "run", 1, "load", None, "instanceCall", 5), (1, "/a", "run", 1, "load", "Own", "instanceCall", 5), (1, "/a", "run", 1, "load", None, "instanceCall", 6)], "projectId long, filePath string, caller string, caller_line int, callee string, receiver string, call_kind string, line int")
    symbols = rows([(1, "class", "Client", None), (2, "function", "load", "u2")], "id long, kind string, name string, usr string")
    occurrences = rows([("/a", 5, "u2", "load(id:)", ["call"], [("u9", ["calledBy"])]), ("/a", 6, "u2", "load(id:)", ["reference"], [])], "filePath string, line int, symbolUSR string, symbolName string, roles array<string>, relations array<struct<usr:string,roles:array<string>>>")
    filled = resolve.fill_receivers(calls_of, symbols, rows([(1, 2)], "sourceId long, targetId long"), occurrences)
    assert as_set(filled.select("receiver", "line")) == {("Client", 5), ("Own", 5), (None, 6)}
