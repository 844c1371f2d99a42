from symloom.sources import members
from symloom.sources.lexer import lex
from symloom.streaming.incremental import VERSIONS, current_facts, follow
from tests.conftest import as_set

FILES = "projectId long, filePath string, content string"

SOURCE = '''import Foundation
@testable import App.Core

/// A card.
/// Two lines.
@MainActor
public final class Card<T>: Base<T, Int>, @unchecked Sendable where T: Hashable {
    @State private var count: Int = 0, total = [1, 2].map { $0 + 1 }, name: String?
    @Environment(\\.theme) var theme
    private(set) lazy var size: [String: Int] = [:] { didSet { print("x") } }
    /** Loads. */
    @discardableResult static func load(_ id: Int = 3, from url: URL...,
                                        done: @escaping (Int) -> Void) async throws -> [String: Int] { let hidden = 1 }
    public init?(path: String) { }
    static func == (a: Card, b: Card) -> Bool { true }
    typealias Done = (Int) -> Void
}
indirect enum Shape: String {
    case dot, line(Int, to: Int), text = "a \\(f("b")) c"
}
extension Outer.Inner: P { }
'''
VIEWS = '''struct Home: View {
    var body: some View {
        VStack {
            if model.items.isEmpty { EmptyCard() } else if wide { WideCard { Text("x") } } else { Core.Plain() }
            ForEach(items) { item in Row(item) }
            switch state {
            case .loading, .idle: Loader()
            default: Failed(reason)
            }
        }
        .environment(\\.theme, Theme())
        .navigationDestination(for: Item.self) { Detail($0) }
    }
    func plain() { _ = NotShown() }
    @ViewBuilder func part() -> X { Side() }
    func store() { let m = HomeModel() }
}
struct Row { }
struct ThemeKey: EnvironmentKey { static let defaultValue: Theme = .light }
extension EnvironmentValues { var theme: Theme { get { self[ThemeKey.self] } } }
'''


def test_clauses_of_declarations(rows):
    got = {}
    for r in members.declarations(members.facts(rows([(1, "/f.swift", SOURCE)], FILES))).collect():
        got[r.name] = (r.kind, r.line, r.end_line, r.access_level, r.attributes, r.modifiers, r.inherited_types, r.signature, r.documentation)
    none = [[], [], []]
    assert got == {
        "Card": ("class", 6, 17, "public", ["@MainActor"], ["final"], ["Base<T, Int>", "@unchecked Sendable"], None, "A card.\nTwo lines."),
        "count": ("variable", 8, 8, "private", ["@State"], [], [], "Int", None), "total": ("variable", 8, 8, "private", ["@State"], [], [], None, None), "name": ("variable", 8, 8, "private", ["@State"], [], [], "String?", None),
        "theme": ("variable", 9, 9, None, ["@Environment"], [], [], None, None), "size": ("variable", 10, 10, "private", [], ["lazy"], [], "[String: Int] { get }", None),
        "load": ("function", 12, 13, None, ["@discardableResult"], ["static"], [], "throws async (_ id: Int, from url: URL, done: @escaping (Int) -> Void) -> [String: Int]", "Loads."),
        "init?": ("initializer", 14, 14, "public", *none, "(path: String)", None), "==": ("function", 15, 15, None, [], ["static"], [], "(a: Card, b: Card) -> Bool", None),
        "Done": ("typeAlias", 16, 16, None, *none, "(Int) -> Void", None), "Shape": ("enum", 18, 20, None, [], ["indirect"], ["String"], None, None),
        "dot": ("enumCase", 19, 19, None, *none, None, None), "line": ("enumCase", 19, 19, None, *none, "(Int, to: Int)", None), "text": ("enumCase", 19, 19, None, *none, '"a \\(f("b")) c"', None),
        "Outer.Inner": ("extension", 21, 21, None, [], [], ["P"], None, None),
    }


def test_wrappers_environment_and_views(rows):
    found = members.facts(rows([(1, "/a/Card.swift", SOURCE), (1, "/a/Home.swift", VIEWS)], FILES)).cache()
    assert as_set(members.wrappers(found).select("symbol", "wrapperName", "argument", "view", "line")) == {
        ("Card.count", "State", None, "Card", 8), ("Card.total", "State", None, "Card", 8), ("Card.name", "State", None, "Card", 8), ("Card.theme", "Environment", "\\.theme", "Card", 9),
    }
    assert as_set(members.environment_keys(found).select("keyName", "valueType", "declaring", "line")) == {("ThemeKey", "Theme", "ThemeKey", 19), ("theme", "Theme", "EnvironmentValues+Home.swift:20", 20)}
    assert as_set(members.environment_injections(found).select("view", "keyPath", "line")) == {("Home", "\\.theme", 3)}
    assert {(r.target, r.metadata) for r in members.edges(found).where("kind = 'composesView'").collect()} == {
        ("unresolved:VStack", None), ("unresolved:EmptyCard", "if model.items.isEmpty"), ("unresolved:WideCard", "if model.items.isEmpty > if wide"), ("unresolved:Plain", "if model.items.isEmpty > if wide"),
        ("Row", "ForEach"), ("unresolved:Loader", "case .loading, .idle"), ("unresolved:Failed", "default"), ("unresolved:Theme", None), ("unresolved:NavigationDestination(Item)", None), ("unresolved:Detail", None), ("unresolved:Side", None),
    }


def test_index_from_files(rows):
    found = members.facts(rows([(1, "/a/Card.swift", SOURCE), (1, "/b/Top.swift", "import Foundation\nfunc top() { }\nstruct A { struct B { var x: Int } }")], FILES)).cache()
    symbols = {r.qualifiedName: r for r in members.symbols(found).collect()}
    assert {"Card", "Card.count", "Outer.Inner+Card.swift:21", "Top.swift:top", "A.B", "B.x", "file:/a/Card.swift", "module:Foundation", "module:App.Core"} <= set(symbols)
    assert (symbols["Card"].attributes, symbols["Card"].modifiers, symbols["Card.theme"].modifiers) == ('["@MainActor"]', '["final"]', None)
    got = as_set(members.edges(found).select("source", "target", "kind", "metadata"))
    assert {("A", "A.B", "contains", None), ("A.B", "B.x", "contains", None), ("file:/b/Top.swift", "module:Foundation", "imports", None), ("file:/a/Card.swift", "module:App.Core", "imports", '{"testable":true}')} <= got


def test_stream_keeps_all_facts(spark, rows, tmp_path):
    source, table, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for text in (SOURCE, VIEWS):
        rows([(1, "/a/F.swift", text)], VERSIONS).coalesce(1).write.mode("append").parquet(source)
        follow(spark.readStream.schema(VERSIONS).parquet(source), table, state).awaitTermination()
    full = members.facts(rows([(1, "/a/F.swift", VIEWS)], VERSIONS))
    assert as_set(members.edges(current_facts(spark, table))) == as_set(members.edges(full)) != set()


def test_odd_texts(rows):
    odd = ["", "}}} {", "class", 'let a = "open', "/* open", "func", "case", "@", 'let a = "\\(', "struct A {" * 300, "let x = " + "[" * 20_000, "func f(" * 200, "if x " * 200, "<" * 2_000, "#if A\n", "init", "private", "x.y.z(", "switch x { case", "@A(b", '"' * 7]
    told = "#if DEBUG\nlet a = 1\n#else\nlet b = 2\n#endif\n/* a /* b */ let c = 1 */ let d = 4"
    found = members.facts(rows([(1, f"/{i}.swift", t) for i, t in enumerate([*odd, told])], FILES)).cache()
    assert [r.name for r in found.where(f"filePath = '/{len(odd)}.swift'").orderBy("pos").collect()] == ["a", "b", "d"]
    assert found.count() > 3


def test_lexer_of_odd_texts():
    for text in ('a "b\\(c("d\\(e)f"))g" h', '#"a\\#(b)"#c', '"""\na "q" \\("x")\n"""z', '"a\\', "#", '"\\("' * 50, "struct A {" * 3000, '"\\(' * 3000, "/*" * 3000):
        found = lex(text)
        assert len({len(c) for c in found.values()}) == 1 and all(text[a:b] == t for t, a, b in zip(found["token"], found["start"], found["stop"], strict=True))
    assert lex('a "b\\(c("d\\(e)f"))g" h')["token"] == ["a", '"b\\(c("d\\(e)f"))g"', "h"]
    assert lex("a /* b /* c */ d */ e // f\n g")["token"] == ["a", "e", "g"]
    assert lex("(a[{b}]) }")["mate"] == [7, None, 6, 5, None, 3, 2, 0, None]
