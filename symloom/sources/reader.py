"""What a Swift file says, read in one pass over its text: declarations, imports, wrappers, environment keys and
injections, composed views, and calls.

Only what a file says leaves its task: tokens are neither shuffled nor written.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from unicodedata import category

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from symloom.sources.declarations import ACCESS_WORDS, BLOCK_WORDS, MODIFIER_WORDS, NO_CALLS, NO_TYPES, TYPE_WORDS
from symloom.sources.lexer import ROWS, _comment_end, _literal_end

# The wrappers, views and endings that the reference tells apart.
WRAPPERS = frozenset("State Binding Environment EnvironmentObject Observable ObservedObject StateObject Published AppStorage SceneStorage FocusState FocusedValue Query Entry MainActor".split())
NO_VIEWS = frozenset(
    "Color Font Image Text Spacer Divider CGFloat CGSize CGPoint CGRect String Int Double Bool Date URL Array Dictionary Set Optional AnyView EmptyView TupleView ForEach Group Section EdgeInsets Alignment HorizontalAlignment VerticalAlignment Animation Transition some Self Never".split()
)
NO_VIEW_ENDINGS = tuple("ViewModel Model Manager Service Repository Store Controller Coordinator Provider Factory Handler Delegate DataSource Helper Formatter Router Interactor Presenter UseCase".split())
CONTROL = frozenset(("if", "else", "for", "while", "repeat", "switch", "do", "catch", "guard", "defer"))

_TEXTS = ("fact", "kind", "name", "parent", "access_level", "signature", "documentation", "argument")
_LISTS = ("attributes", "modifiers", "inherited_types")
_NUMBERS = ("pos", "line", "column", "end_line")
_TYPES = {**dict.fromkeys(_TEXTS, "string"), **dict.fromkeys(_LISTS, "array<string>"), **dict.fromkeys(_NUMBERS, "int"), "testable": "boolean"}
FACTS = ", ".join(["projectId long", "filePath string", *[f"{c} {t}" for c, t in _TYPES.items()]])
CALLS = "projectId long, filePath string, caller string, caller_line int, callee string, receiver string, call_kind string, line int"

# The lexer's tokens, words first: no comment or literal begins like one.
_TOKEN = re.compile(r"""(?:[^\S\r\n]|\uFEFF|\r\n|\r|\n)*+(?:([@\#]?`?[^\W\d]\w*`?)|(///[^\r\n]*)|(//[^\r\n]*)|(/\*)|("[^"\\\r\n]++"(?!"))|(\#*")|(\$\w+|\d\w*(?:\.\d\w*)?|->|\S))""", re.VERBOSE)
_BREAK = re.compile(r"\r\n|\r|\n")
_LABEL = re.compile(r"[A-Za-z0-9_]*[ \t\n\x0b\f\r]*:[ \t\n\x0b\f\r]*")
_LAST_BRACKET, _DOTS = re.compile(r"[ \t\n\x0b\f\r]*\)$"), re.compile(r"[ \t\n\x0b\f\r]*\.[ \t\n\x0b\f\r]*\.[ \t\n\x0b\f\r]*\.$")
_OPENERS = {")": "(", "]": "[", "}": "{"}

_TYPE, _ACCESS, _MODIFIER, _BLOCK = frozenset(TYPE_WORDS), frozenset(ACCESS_WORDS), frozenset(MODIFIER_WORDS), frozenset(BLOCK_WORDS)
_LEADS = _ACCESS | _MODIFIER
_NO_TYPE_NAMES = _LEADS | frozenset(NO_TYPES)
_NO_CALL = frozenset(NO_CALLS)
_MARKS = _TYPE | _BLOCK | frozenset(("func", "init", "var", "let", "typealias", "case", "default", "import"))
_FUNCTIONS = ("function", "initializer")
# Words and signs after which a line goes on, and with which one does.
_OPEN_ENDS = frozenset(("=", "+", "-", "*", "/", "%", "&", "|", "^", "<", ">", "?", ":", ".", ",", "->", "as", "is", "in", "where", "try", "await", "some", "any"))
_GOES_ON = frozenset((".", "?", ":", "&", "|", "+", "*", "/", "%", "=", "<", ">", ",", "->", "as", "is", "where", "throws", "async", "rethrows", "reasync", "{", ")", "]"))
_ACCESSORS = frozenset(("get", "set", "willSet", "didSet"))
_EFFECTS = frozenset(("async", "reasync", "throws", "rethrows"))
_DIRECTIVES = frozenset(("#if", "#else", "#elseif", "#endif"))
_IMPORTED = frozenset(("struct", "class", "enum", "protocol", "func", "let", "var", "typealias", "actor"))
_GIVES = frozenset(("environment", "environmentObject"))
_MOST_AROUND = 64  # braces around one that count, the innermost


def _letter(word: str) -> bool:
    return bool(word) and (word[0] == "_" or word[0].isalpha())


def _named(word: str | None) -> bool:
    return word is not None and _letter(word[1:] if word[:1] == "`" else word)


def _upper(word: str | None) -> bool:
    return bool(word) and category(word[0]) == "Lu"


def _without_label(text: str) -> str:
    return text[found.end() :] if _letter(text) and (found := _LABEL.match(text, 1)) else text


def _short(text: str, most: int) -> str:
    return text if len(text) <= 40 else text[:most] + "..."


class Scan:
    """A text's tokens by position, and what its braces open.

    ``brace`` is the brace a token stands in or -1, ``round`` the round and square brackets open around
    it within that brace (an opening one not itself), ``mate`` the matching bracket. ``marks`` are the positions of
    words that may head something, of braces and semicolons, ``calls`` those of opening round brackets.
    """

    def __init__(self, text: str) -> None:
        self.breaks = [m.end() for m in _BREAK.finditer(text)]
        self.tokens: list[str] = []
        self.start: list[int] = []
        self.stop: list[int] = []
        self.brace: list[int] = []
        self.round: list[int] = []
        self.mate: dict[int, int] = {}
        self.docs: dict[int, str] = {}
        self.marks: list[int] = []
        self.calls: list[int] = []
        self.colons: list[int] = []
        self._lex(text)
        self._scope()

    def _lex(self, text: str) -> None:
        tokens, starts, stops, brace_of, round_of, mate, marks = self.tokens, self.start, self.stop, self.brace, self.round, self.mate, self.marks
        docs: list[str] = []
        opened: list[int] = []
        braces, rounds = [-1], [0]
        brace, level = -1, 0  # the tops of the two
        end, at = len(text), 0
        while end and (text[end - 1].isspace() or text[end - 1] == "\ufeff"):
            end -= 1
        while at < end:
            for match in _TOKEN.finditer(text, at, end):
                kind = match.lastindex
                start, at = match.span(kind)
                if kind == 1:
                    token = match[1]
                    if docs:
                        self.docs[len(tokens)] = "\n".join(docs)
                        docs.clear()
                    if token in _MARKS:
                        marks.append(len(tokens))
                    tokens.append(token)
                    starts.append(start)
                    stops.append(at)
                    brace_of.append(brace)
                    round_of.append(level)
                    continue
                if kind == 3:
                    continue
                if kind == 2:
                    docs.append(match[2][3:].strip())
                    continue
                jumped = False
                if kind == 4:
                    at = _comment_end(text, start)
                    if text.startswith("/**", start) and at - start > 4:
                        docs.append(text[start + 3 : at - 2].strip())
                    break
                if kind == 6:
                    at, jumped = _literal_end(text, start), True
                token, pos = text[start:at], len(tokens)
                if token in _OPENERS:
                    while token == "}" and opened and tokens[opened[-1]] != "{":  # a brace closes what was left open within it
                        opened.pop()
                    if opened and tokens[opened[-1]] == _OPENERS[token]:
                        other = opened.pop()
                        mate[other], mate[pos] = pos, other
                        if token == "}":
                            braces.pop()
                            rounds.pop()
                            brace, level = braces[-1], rounds[-1]
                        else:
                            level -= 1
                            rounds[-1] = level
                if docs:
                    self.docs[pos] = "\n".join(docs)
                    docs.clear()
                tokens.append(token)
                starts.append(start)
                stops.append(at)
                brace_of.append(brace)
                round_of.append(level)
                if token == "{":
                    marks.append(pos)
                    opened.append(pos)
                    braces.append(pos)
                    rounds.append(0)
                    brace, level = pos, 0
                elif token == "(" or token == "[":
                    if token == "(":
                        self.calls.append(pos)
                    opened.append(pos)
                    level += 1
                    rounds[-1] = level
                elif token == "}" or token == ";":
                    marks.append(pos)
                elif token == ":":
                    self.colons.append(pos)
                if jumped:
                    break
            else:
                break

    def _scope(self) -> None:
        """``heads``: (kind, name, piece) of each word that begins a declaration; ``pieces``: of each mark; ``opens`` on
        a brace: (kind, name, pos) of what it is the body of; ``kinds``: (kind, name) of each brace; ``leader`` on a brace:
        the last head before it in the brace that it stands in."""
        tokens, round_of, brace_of = self.tokens, self.round, self.brace
        self.heads: dict[int, tuple[str, str]] = {}
        self.pieces: dict[int, int] = {}
        self.opens: dict[int, tuple[str, str, int]] = {}
        self.kinds: dict[int, tuple[str, str | None]] = {}
        self.leader: dict[int, int] = {}
        self.ends: dict[int, list[int]] = defaultdict(list)  # by brace: what ends its pieces
        count: dict[int, int] = defaultdict(int)
        last: dict[int, tuple[str, str, int, int]] = {}
        lead: dict[int, int] = {}
        n = len(tokens)
        for pos in self.marks:
            token, brace, flat = tokens[pos], brace_of[pos], round_of[pos] == 0
            piece = self.pieces[pos] = count[brace]
            if token == "{":
                found = last.get(brace) if flat else None
                if found and found[3] == piece:
                    self.opens[pos] = found[:3]
                    self.kinds[pos] = found[:2]
                else:
                    self.kinds[pos] = ("block", None)
                if brace in lead:
                    self.leader[pos] = lead[brace]
            if token in "{};":
                if flat:
                    count[brace] += 1
                    self.ends[brace].append(pos)
                continue
            if not flat or (pos and tokens[pos - 1] == "."):
                continue
            after = tokens[pos + 1] if pos + 1 < n else None
            kind = None
            if token in _TYPE:
                if _named(after) and after not in _NO_TYPE_NAMES:
                    kind = token
            elif token == "func":
                kind = "function" if after is not None else None
            elif token == "init":
                kind = "initializer" if after in ("(", "?", "!", "<") else None
            elif token in ("var", "let", "typealias", "case") and _named(after):
                kind = {"typealias": "typeAlias", "case": "enumCase"}.get(token, "variable")
            if kind:
                name = "init" + (after if after in ("?", "!") else "") if token == "init" else after.replace("`", "")
                self.heads[pos] = (kind, name)
                last[brace] = (kind, name, pos, piece)
                lead[brace] = pos
            elif token in _BLOCK:
                last[brace] = ("block", token, pos, piece)

    def line(self, pos: int) -> int:
        return bisect_right(self.breaks, self.start[pos]) + 1

    def column(self, pos: int) -> int:
        row = bisect_right(self.breaks, self.start[pos])
        return self.start[pos] - (self.breaks[row - 1] if row else 0) + 1

    def last_line(self, pos: int) -> int:
        return bisect_right(self.breaks, self.stop[pos] - 1) + 1

    def breaks_before(self, pos: int) -> bool:
        """Whether a token begins on another line than the one before it ends."""
        return pos > 0 and self.line(pos) != self.last_line(pos - 1)

    def token(self, pos: int) -> str | None:
        return self.tokens[pos] if 0 <= pos < len(self.tokens) else None

    def word(self, pos: int) -> str:
        """A token as it stands in a text: with a blank before it if one or more come before it."""
        return " " + self.tokens[pos] if pos and self.start[pos] > self.stop[pos - 1] else self.tokens[pos]

    def piece(self, pos: int) -> int:
        """How many braces and semicolons before a token end something in the brace that it stands in."""
        ends = self.ends.get(self.brace[pos], ())
        return bisect_right(ends, pos - 1)

    def scope(self, pos: int) -> tuple[str, str | None] | None:
        """(kind, name) of the innermost brace around a token; of a closing brace, of what it closes."""
        token = self.tokens[pos]
        if token == "{":
            return None
        return self.kinds.get(self.mate.get(pos, self.brace[pos]) if token == "}" else self.brace[pos])

    def around(self, brace: int) -> list[int]:
        """A brace and those around it, from the inside."""
        found = [brace]
        while len(found) <= _MOST_AROUND and self.brace[found[-1]] >= 0:
            found.append(self.brace[found[-1]])
        return found


def _text(words: list[str]) -> str | None:
    return "".join(words).strip(" ") or None


def _texts(scan: Scan, parts: list[tuple[int, list]]) -> list[str]:
    """The text of each of a clause's items that has any, in order."""
    word = scan.word
    return [t for _, words in parts if words and (t := _text([word(w[0]) for w in words]))]


def _leads(scan: Scan, kept: list[int]) -> tuple[dict[int, int], dict[int, int], set[int]]:
    """Of heads the place where the declaration begins, with its first attribute or modifier; of those and their
    arguments the head they belong to; the positions in arguments."""
    tokens, heads = scan.tokens, scan.heads
    given, run, led = -1, -1, False
    first: dict[int, int] = {}
    softs: list[int] = []
    in_args: set[int] = set()
    for pos in kept:
        token = tokens[pos]
        if token == "(" and pos and scan.start[pos] == scan.stop[pos - 1] and (tokens[pos - 1][0] == "@" or tokens[pos - 1] in _LEADS) and pos in scan.mate:
            given = scan.mate[pos]
        if given >= pos:
            in_args.add(pos)
            soft = True
        elif token[0] == "@":
            soft = len(token) > 1
        elif token in _LEADS:
            after = scan.token(pos + 1)
            type_class = token == "class" and (after is None or (_named(after) and after not in _NO_TYPE_NAMES))
            soft = not type_class and not (pos and tokens[pos - 1] == ".")
        else:
            soft = False
        if soft:
            softs.append(pos)
            if not led:
                run = pos
        if pos in heads:
            first[pos] = run if led else pos
        led = soft
    leads: dict[int, int] = {}
    order = list(first)
    for pos in softs:
        at = bisect_right(order, pos)
        if pos not in first and at < len(order) and first[order[at]] <= pos:
            leads[pos] = order[at]
    return first, leads, in_args


def _leading(scan: Scan, leads: dict[int, int], in_args: set[int]) -> dict[int, list[tuple[str, str | None]]]:
    """Per head its attributes, modifiers and access level in order, with their first argument."""
    groups: dict[tuple[int, int | None], list[int]] = {}
    of = None
    for pos, head in leads.items():
        if pos not in in_args:
            of = pos
        groups.setdefault((head, of), []).append(pos)
    out: dict[int, list[tuple[str, str | None]]] = defaultdict(list)
    for (head, of), places in groups.items():
        if of not in places:
            continue
        args = [p for p in places if p in in_args]
        comma = next((p for p in args if scan.tokens[p] == "," and scan.round[p] == scan.round[args[0]] + 1), None)
        text = _text([scan.word(p) for p in args[1:-1] if comma is None or p < comma])
        out[head].append((scan.tokens[of], None if text is None else _without_label(text)))
    return out


class _Group:
    """The words of one declaration's clauses, by binding, clause and list item."""

    __slots__ = ("angle", "binding", "body", "called", "clause", "conditions", "item", "kind", "last", "lists", "parts", "pos", "slot", "typed")

    def __init__(self, pos: int, kind: str) -> None:
        self.pos, self.kind = pos, kind
        self.typed, self.called, self.lists = kind in _TYPE, kind in _FUNCTIONS, kind in ("variable", "enumCase")
        self.angle = self.conditions = self.binding = self.item = 0
        self.clause, self.slot = None, None
        self.parts: dict[tuple[int, str, int], list[tuple[int, str | None, bool]]] = {}
        self.last = pos
        self.body: dict[int, int] = {}


def declared(scan: Scan) -> list[dict]:
    """The declarations of types and of files, one per name of a ``var`` or ``case``; those in bodies of functions and
    accessors are left out. ``pos`` is the head's or, of further names, the name's own, ``brace`` the brace it stands
    in, ``body`` the one it opens, ``given`` its attributes with their first argument."""
    tokens, start, stop, round_of = scan.tokens, scan.start, scan.stop, scan.round
    typed = {b: kind in _TYPE for b, (kind, _) in scan.kinds.items()} | {-1: True}
    closes = lambda p: typed[scan.mate.get(p, scan.brace[p])]
    kept = [p for p, (t, b) in enumerate(zip(tokens, scan.brace, strict=True)) if t == "{" or (closes(p) if t == "}" else typed[b])]
    first, leads, in_args = _leads(scan, kept)
    groups: dict[int, _Group] = {}
    open_: dict[int, _Group | None] = {}
    brace_of, heads = scan.brace, scan.heads
    for i, pos in enumerate(kept):
        brace = brace_of[pos]
        if pos in heads:
            groups[pos] = open_[brace] = _Group(pos, heads[pos][0])
        g = open_.get(brace)
        if g is None or pos in leads:
            continue
        token, flat = tokens[pos], round_of[pos] == 0
        prev = tokens[pos - 1] if pos else None
        kind = g.kind
        if token == "<" or token == ">":
            if start[pos] == (stop[pos - 1] if pos else -1):
                if token == ">":
                    g.angle -= 1
                elif _named(prev):
                    g.angle += 1
        elif token == "where":
            g.conditions += 1
        mark = None
        if pos == g.pos:
            mark = "name"
        elif flat and g.angle == 0:
            if token == ":":
                if g.typed:
                    mark = "inherits" if g.conditions == 0 else None
                elif kind == "variable" and i > 1 and tokens[kept[i - 2]] in ("var", "let", ","):
                    mark = "type"
            elif token == "where":
                mark = "where" if g.typed or g.called else None
            elif token == ",":
                mark = "name" if g.lists else None
            elif token == "(":
                mark = "params" if g.called else "payload" if kind == "enumCase" else None
            elif token == "=":
                mark = None if g.called or g.typed else "value"
            elif g.called:
                mark = "effects" if token in _EFFECTS else "returns" if token == "->" else None
        if mark:
            g.clause = mark
        clause = g.clause
        mark2 = None
        if clause == "params":
            if token == "(" and flat:
                mark2 = "label"
            elif round_of[pos] == 1 and g.angle == 0:
                if token == ",":
                    mark2 = "label"
                elif token == ":":
                    mark2 = "type" if (i > 1 and tokens[kept[i - 2]] in ("(", ",")) or (i > 2 and tokens[kept[i - 3]] in ("(", ",")) else None
                elif token == "=":
                    mark2 = "default"
        comma = token == "," and g.angle == 0
        body, hidden = False, False
        if token == "{" and flat:
            after = scan.token(pos + 1)
            body = g.typed or g.called or (kind == "variable" and (clause in ("name", "type") or after in _ACCESSORS))
            hidden = not body and kind == "variable" and after is None
        breaks = not g.typed and flat and token not in _GOES_ON and prev not in _OPEN_ENDS and pos > g.pos + 1 and scan.breaks_before(pos)
        if body or breaks or token in _DIRECTIVES or (token == ";" and flat):
            open_[brace] = None
            if not body:
                continue
        if comma:
            if g.lists and flat:
                g.binding += 1
            if (clause == "inherits" and flat) or (clause == "params" and round_of[pos] == 1):
                g.item += 1
        if mark2:
            g.slot = mark2
        words = g.parts.setdefault((g.binding, clause, g.item), [])
        if body:
            g.body[g.binding] = pos
            continue
        g.last = pos
        listed = clause == "inherits" and comma and flat
        if (mark is None or mark in ("payload", "effects")) and not listed and not hidden:
            words.append((pos, g.slot, mark2 is not None))
    leading = _leading(scan, leads, in_args)
    out: list[dict] = []
    for g in groups.values():
        out += _made(scan, g, first[g.pos], leading.get(g.pos, []))
    return out


def _parameter(scan: Scan, words: list[tuple[int, str | None, bool]]) -> str | None:
    labels = [scan.tokens[p] for p, slot, sign in words if slot == "label" and not sign and scan.tokens[p][0] != "@" and scan.tokens[p] != ")"][:2]
    types = _text([scan.word(p) for p, slot, sign in words if slot == "type" and not sign])
    if types is None:
        return None
    if types.count("(") < types.count(")"):  # the parameter list's own bracket
        types = _LAST_BRACKET.sub("", types)
    return " ".join(labels) + ": " + _DOTS.sub("", types)


def _made(scan: Scan, g: _Group, lead: int, leading: list[tuple[str, str | None]]) -> list[dict]:
    """The rows of one head, one per binding."""
    own_name, kind, bare = scan.heads[g.pos][1], g.kind, g.kind == "enumCase"
    given = [x for x in leading if x[0][0] == "@"]
    modifiers = [] if bare else [t for t, _ in leading if t in _MODIFIER]
    access = None if bare else next((t for t, _ in leading if t in _ACCESS), None)
    by: dict[int, dict[str, list[tuple[int, list]]]] = {}
    for (binding, clause, item), words in g.parts.items():  # items of a clause rise
        by.setdefault(binding, {}).setdefault(clause, []).append((item, words))
    end_line = max([scan.last_line(g.last), *(scan.line(scan.mate[b]) for b in g.body.values() if b in scan.mate)])
    line, column, tokens = scan.line(lead), scan.column(lead), scan.tokens
    documentation = None if bare or kind == "extension" else scan.docs.get(lead)
    out = []
    for binding, clauses in by.items():
        text = lambda clause: max(_texts(scan, clauses[clause]), default=None) if clause in clauses else None  # noqa: B023, E731
        names = max(([tokens[w[0]] for w in words] for _, words in clauses.get("name", ())), default=[])
        first = names[0].replace("`", "") if names else None
        if kind == "extension":
            name = text("name")
        elif kind == "variable" or bare:
            name = first
        elif kind == "function" and first is not None and not _named(first):
            name = "".join(t for t in names if not _named(t))
        else:
            name = own_name
        if name is None:
            continue
        type_, returns = text("type"), text("returns")
        params = "(" + ", ".join(p for _, w in clauses.get("params", ()) if (p := _parameter(scan, w)) is not None) + ")" if g.called else None
        signature = None
        if kind == "function":
            effects = max(([scan.tokens[p] for p, _, _ in w] for _, w in clauses.get("effects", ())), default=[])
            signature = ("throws " if "throws" in effects or "rethrows" in effects else "") + ("async " if "async" in effects or "reasync" in effects else "") + params + ("" if returns is None else " -> " + returns)
        elif kind == "initializer":
            signature = params
        elif kind == "typeAlias":
            signature = text("value")
        elif bare:
            payload = text("payload")
            signature = text("value") if payload is None else payload
        elif kind == "variable":
            signature = (type_ or "") + (" { get }" if binding in g.body else "")
        places = [p for _, w in clauses.get("name", ()) for p, _, _ in w]
        out.append({
            "pos": places[0] if binding else g.pos, "brace": scan.brace[g.pos], "kind": kind, "name": name, "line": line, "column": column, "end_line": end_line, "access_level": access, "given": given, "modifiers": modifiers,
            "inherited_types": _texts(scan, clauses["inherits"]) if "inherits" in clauses else [], "signature": signature or None, "type": type_, "returns": returns,
            "documentation": documentation, "body": g.body.get(binding),
        })
    return out


def _nesting(scan: Scan, found: list[dict]) -> Callable[[int], dict]:
    """Of a brace: whether all around it are types (``emits``), the innermost declaration, the innermost type's name
    (``owner``), whether a view builder is among them, and whether a property is (``hidden``)."""
    bodies = {d["body"]: d for d in found if d["body"] is not None}
    known: dict[int, dict] = {}

    def views(d: dict) -> bool:
        if d["kind"] == "function":
            return any(n == "@ViewBuilder" for n, _ in d["given"]) or "View" in (d["returns"] or "")
        return d["kind"] == "variable" and (d["name"] == "body" or any(n == "@ViewBuilder" for n, _ in d["given"]) or "View" in (d["type"] or ""))

    def of(brace: int) -> dict:
        if brace not in known:
            all_ = [bodies.get(b) for b in scan.around(brace)]
            owner = next((d for d in all_ if d and d["kind"] in _TYPE and d["kind"] not in ("actor", "protocol")), None)
            known[brace] = {
                "emits": all(d and d["kind"] in _TYPE for d in all_), "inner": all_[0], "owner": owner and owner["name"],
                "viewing": any(d and views(d) for d in all_), "hidden": any(d and d["kind"] == "variable" for d in all_),
            }
        return known[brace]

    return of


def _qualified(kind: str, name: str, parent: str | None, line: int, path: str) -> str:
    file = path.rpartition("/")[2]
    if kind == "extension":
        return f"{name}+{file}:{line}"
    if parent is not None:
        return f"{parent}.{name}"
    return f"{file}:{name}" if kind in ("function", "variable", "initializer") else name


def _imports(scan: Scan) -> Iterator[dict]:
    """Imports of modules by their whole path; ``import struct A.B`` imports that type's path."""
    tokens, n = scan.tokens, len(scan.tokens)
    for pos in scan.marks:
        if tokens[pos] != "import" or scan.brace[pos] != -1:
            continue
        words = []
        for p in range(pos + 1, n):
            token, prev = tokens[p], tokens[p - 1]
            if scan.brace[p] != -1:
                continue
            if token == "import":
                break
            if token in _IMPORTED and prev == "import":
                continue
            if token != "." and prev != "." and prev != "import" and prev not in _IMPORTED:
                break
            words.append(token)
        if words:
            yield {"fact": "import", "pos": pos, "line": scan.line(pos), "name": "".join(words).strip(" "), "testable": pos > 0 and tokens[pos - 1] == "@testable"}


class _Conditions:
    """What composed views stand under: labels of ``if`` chains, ``switch`` labels and ``ForEach``."""

    def __init__(self, scan: Scan) -> None:
        self.scan = scan
        tokens = scan.tokens
        self.chains: dict[int, list[int]] = defaultdict(list)  # the ifs of each chain, by its first
        self.cases: dict[int, list[int]] = defaultdict(list)  # the labels of each switch, by its brace
        self.next_if: dict[int, int] = {}
        own: dict[int, tuple[int | None, str | None]] = {}
        first: dict[int, int] = {}
        before: dict[int, int] = {}
        loose: dict[int, int] = {}
        after_else: dict[int, str] = {}
        for pos in scan.marks:
            token, brace, prev = tokens[pos], scan.brace[pos], tokens[pos - 1] if pos else ""
            if token == "if":
                if prev not in (".", "else"):
                    loose[brace] = pos
                if prev != "." and scan.token(pos + 1) not in (":", None):
                    if prev != "else":
                        first[brace] = pos
                    if brace in first:
                        self.chains[first[brace]].append(pos)
                    if brace in before:
                        self.next_if[before[brace]] = pos
                    before[brace] = pos
            elif token == "else":
                if pos:
                    after_else[brace] = prev
            elif token in ("case", "default"):
                if brace >= 0 and scan.kinds[brace][1] == "switch" and prev not in ("if", "guard", "while", "for", ",", "."):
                    self.cases[brace].append(pos)
            elif token == "{":
                opens = scan.opens.get(pos)
                of_if = opens and opens[0] == "block" and (opens[1] == "if" or (opens[1] == "else" and after_else.get(brace) == "}"))
                own[pos] = (loose.get(brace) if of_if else None, prev)
        self.own, self.known, self.texts = own, {}, {}

    def _if(self, pos: int) -> str | None:
        """The text of an ``if``: what its statement has in its brace, up to the next ``if``."""
        if pos not in self.texts:
            scan, brace = self.scan, self.scan.brace[pos]
            ends = scan.ends.get(brace, ())
            at = bisect_right(ends, pos)
            end = ends[at] if at < len(ends) else len(scan.tokens) - 1
            end = min(end, self.next_if.get(pos, end + 1) - 1)
            words, p = [], pos + 1
            while p <= end:
                if scan.brace[p] == brace and scan.tokens[p] != "{":
                    words.append(scan.word(p))
                # What a closure holds stands in another brace.
                p = scan.mate[p] if scan.tokens[p] == "{" and p in scan.mate else p + 1
            self.texts[pos] = "if " + _short("".join(words).strip(" "), 37) if words else None
        return self.texts[pos]

    def _brace(self, brace: int) -> list[str]:
        chain, callee = self.own[brace]
        found = [(p, label) for p in self.chains.get(chain, ()) if p < brace and (label := self._if(p)) is not None] if chain is not None else []
        return [label for _, label in sorted(found)] + ["ForEach"] * (callee_of(self.scan, brace) == "ForEach")

    def labels(self, brace: int) -> list[str]:
        """The conditions that a brace stands under, from the outermost on."""
        if brace not in self.known:
            self.known[brace] = [label for b in reversed(self.scan.around(brace)) for label in self._brace(b)]
        return self.known[brace]

    def case(self, pos: int) -> str | None:
        """The label of the ``switch`` that a token stands right in."""
        scan, brace = self.scan, self.scan.brace[pos]
        labels = self.cases.get(brace, ())
        at = bisect_right(labels, pos)
        if not at:
            return None
        first = labels[at - 1]
        if scan.tokens[first] != "case":
            return "default"
        end = labels[at] if at < len(labels) else len(scan.tokens)
        words = []
        for p in range(first + 1, end):
            token = scan.tokens[p]
            if scan.brace[p] != brace or token == "{":
                if scan.mate.get(brace, end) <= p:
                    break
                continue
            if token == "where" or (token == ":" and scan.round[p] == 0):
                break
            if token == "}" and (scan.scope(p) or ("", None))[1] != "switch":
                continue
            words.append(scan.word(p))
        return "case " + _short("".join(words).strip(" "), 35)


def callee_of(scan: Scan, bracket: int) -> str | None:
    """The word that a bracket follows, for a trailing closure that of the call."""
    before = scan.tokens[bracket - 1] if bracket else ""
    if scan.tokens[bracket] == "{" and before == ")":
        call = scan.mate.get(bracket - 1)
        return scan.tokens[call - 1] if call else None
    return before


def _shown(scan: Scan, nesting: Callable[[int], dict]) -> Iterator[dict]:
    """Views composed and environment values given."""
    tokens, token_at = scan.tokens, scan.token
    conditions = None
    statements: dict[int, tuple[int, int | None]] = {}

    def statement(pos: int) -> int | None:
        """The line on which the statement of a token begins."""
        brace, p = scan.brace[pos], pos
        at, line = statements.get(brace, (brace, None))
        while p > at:
            token = tokens[p]
            if scan.brace[p] == brace and scan.round[p] == 0 and token not in (".", "}", "?", ":") and (p == 0 or scan.breaks_before(p) or tokens[p - 1] in ("{", ";", "in", "return", "else", ":")):
                line = scan.line(p)
                break
            p = scan.mate[p] if token in _OPENERS and scan.mate.get(p, -1) > at else p - 1
        statements[brace] = (pos, line)
        return line

    places = sorted([*(p - 1 for p in scan.calls if p), *(p - 1 for p in scan.kinds if p), *(p - 1 for p in scan.colons if p and tokens[p - 1] == "for")])
    for pos in places:
        brace, token = scan.brace[pos], tokens[pos]
        if brace < 0 or not (token in _GIVES or token == "for" or _upper(token)):
            continue
        place = nesting(brace)
        if place["owner"] is None:
            continue
        prev, after = tokens[pos - 1] if pos else "", tokens[pos + 1]
        view = key = None
        context: list[str] = []
        conditions = conditions or _Conditions(scan)
        if token in _GIVES and prev == "." and after == "(":
            key = _key(scan, pos + 1)
            if key is None:
                continue
        elif token == "for" and after == ":" and token_at(pos + 3) == "." and token_at(pos + 4) == "self" and token_at(pos + 5) in (")", ","):
            view = f"NavigationDestination({tokens[pos + 2]})"
        elif _upper(token) and place["viewing"] and token not in NO_VIEWS and token != place["owner"] and not token.endswith(NO_VIEW_ENDINGS):
            if prev in ("func", "struct", "class", "enum", "protocol", "actor", "extension", "#"):
                continue
            if after == "(":
                shown = scan.line(pos + 1) == scan.last_line(pos)
            else:
                kind, name, _ = scan.opens.get(pos + 1, ("", "", 0))
                control = (kind == "block" and name in CONTROL) or kind in _TYPE or kind in ("function", "initializer", "variable")
                typed = prev in ("->", "is", "as", "some", "any") or (prev == ":" and token_at(pos - 3) in ("var", "let"))
                shown = after == "{" and not control and not typed and token_at(pos + 2) not in _ACCESSORS
            if not shown:
                continue
            view = token
            case = conditions.case(pos)
            context = [*conditions.labels(brace), *([] if case is None else [case])]
        else:
            continue
        line = scan.line(pos)
        if prev == ".":
            line = statement(pos) or line
        yield {"fact": "view" if key is None else "injection", "pos": pos, "line": line, "parent": place["owner"], "name": view, "argument": " > ".join(context) or None if key is None else key}


def _key(scan: Scan, opens: int) -> str | None:
    """The first argument of what is injected, without its label."""
    end = scan.mate.get(opens)
    if end is None:
        return None
    words = []
    for p in range(opens + 1, end):
        if scan.tokens[p] == "(" and scan.tokens[p - 1] in _GIVES:
            break
        if scan.tokens[p] == "," and scan.round[p] == scan.round[opens] + 1:
            break
        words.append(scan.word(p))
    return _without_label("".join(words).strip(" ")) if words else None


def read_facts(text: str, path: str, wanted: tuple[str, ...] | None = None) -> list[dict]:
    """The facts of one text, of all sorts or of those wanted; a view's ``source`` is the qualified name
    of the first declaration of its parent's name."""
    scan = Scan(text)
    found = declared(scan)
    nesting = _nesting(scan, found)
    out: list[dict] = []
    first: dict[str, tuple[int, str]] = {}
    for d in found:
        top = d["brace"] == -1
        place = {"emits": True, "inner": None, "owner": None, "hidden": False} if top else nesting(d["brace"])
        inner, given, kind = place["inner"], d["given"], d["kind"]
        if place["emits"] and (kind != "enumCase" or (inner and inner["kind"] == "enum")) and (kind != "initializer" or not top):
            parent = None if top else inner["name"]
            out.append({
                "fact": "declaration", **{c: d[c] for c in ("pos", "kind", "name", "access_level", "signature", "documentation", "modifiers", "inherited_types", "line", "column", "end_line")},
                "parent": parent, "attributes": [] if kind == "enumCase" else [n for n, _ in given],
            })
            here = (d["pos"], _qualified(kind, d["name"], parent, d["line"], path))
            first[d["name"]] = min(first.get(d["name"], here), here)
        if kind != "variable" or top or wanted == ("declaration",):
            continue
        if place["owner"] is not None and not place["hidden"]:
            out += [{"fact": "wrapper", "pos": d["pos"], "kind": n[1:], "name": d["name"], "argument": a, "parent": place["owner"], "line": d["line"]} for n, a in given if n[1:] in WRAPPERS]
        if inner and inner["kind"] in ("struct", "extension"):
            if "EnvironmentKey" in inner["inherited_types"] and d["name"] == "defaultValue":
                out.append({"fact": "key", "pos": d["pos"], "name": inner["name"], "signature": d["type"], "parent": inner["name"], "line": inner["line"]})
            if inner["kind"] == "extension" and inner["name"] == "EnvironmentValues":
                out.append({"fact": "key", "pos": d["pos"], "name": d["name"], "signature": d["type"], "parent": "EnvironmentValues", "line": d["line"]})
    if wanted != ("declaration",):
        out += _imports(scan)
        out += _shown(scan, nesting)
    for row in out:
        row["source"] = first.get(row.get("parent"), (0, None))[1] if row["fact"] == "view" else None
    return out


def _local_types(scan: Scan, pos: int, bindings: set[int]) -> str | None:
    """The type annotation of the local whose name stands at ``pos``, in the words of its source: up to a sign that
    ends it in no bracket, or to a line that doesn't continue it."""
    tokens, level, angle, words = scan.tokens, scan.round[pos], 0, []
    for p in range(pos + 2, len(tokens)):
        token = tokens[p]
        if p in bindings:
            break
        angle += (token == "<") - (token == ">")
        inside = scan.round[p] == level and angle == 0
        if (inside and token in ("=", ",", "{", "}", ";")) or scan.round[p] < level:
            break
        if inside and scan.line(p) != scan.line(p - 1) and tokens[p - 1] not in ("->", "&", ".", ":", "some", "any") and token not in ("->", "&", "."):
            break
        words.append(scan.word(p) if words else token)
    return "".join(words) if words else None


def read_calls(text: str) -> list[tuple]:
    """(caller, caller_line, callee, receiver, call_kind, line) of each call in a function of one text; see
    ``declarations.calls``."""
    scan = Scan(text)
    tokens, brace_of, round_of, heads, n = scan.tokens, scan.brace, scan.round, scan.heads, len(scan.tokens)
    # Annotated names first, as they end each other's types.
    led, at, order = None, 0, [p for p in scan.marks if tokens[p] in ("let", "var", "case")]
    bindings: set[int] = set()
    for colon in scan.colons:
        pos = colon - 1
        if pos < 1 or not _named(tokens[pos]) or tokens[pos - 1] not in ("let", "var", ","):
            continue
        while at < len(order) and order[at] < pos:
            led = order[at]
            at += 1
        if led is None or tokens[led] == "case" or brace_of[led] != brace_of[pos] or round_of[led] != round_of[pos] or scan.piece(led) != scan.piece(pos):
            continue
        if led and tokens[led - 1] in ("if", "guard", "while", "case", "for", ","):
            continue
        bindings.add(pos)
    out: list[tuple] = []
    part, body, end, owner = 0, None, -1, None
    local: dict[tuple[int, int, str], str] = {}
    held = sorted(p for p in bindings)
    kept = set()
    events = sorted([*((p, 0) for p in scan.marks if p in heads or tokens[p] in "{}"), *((p - 1, 1) for p in scan.calls if p), *((p, 2) for p in held)])
    # A binding counts within a body only, and only then ends another's type.
    at_body, at_end = None, -1
    for pos, sort in events:
        if sort == 0:
            if tokens[pos] == "{" and (found := _body(scan, pos)):
                at_body, at_end = found, found[2]
        elif sort == 2 and at_body and pos < at_end:
            kept.add(pos)
    for pos, sort in events:
        if sort == 0:
            if pos in heads:
                part += heads[pos][0] in _FUNCTIONS
            elif tokens[pos] == "}":
                part += (scan.scope(pos) or ("", None))[0] in _FUNCTIONS
            elif found := _body(scan, pos):
                body, end = found, found[2]
            continue
        if body is None or pos >= end:
            continue
        name, line, _, owner = body
        if sort == 2:
            if (type_ := _local_types(scan, pos, kept)) is not None:
                local[line, part, tokens[pos].replace("`", "")] = type_
            continue
        token, prev = tokens[pos], tokens[pos - 1] if pos else ""
        if not _letter(token) or token in _NO_CALL or prev == "func":
            continue
        back = [scan.token(pos - i) for i in (2, 3, 4, 5)]
        member, upper = prev == ".", _upper(token)
        on = back[0].replace("`", "") if member and back[1] != "." and _named(back[0]) else None
        callee, receiver = token, None
        if member:
            if _upper(on) and on != "Self":
                of = on
            else:
                of = back[2] if back[1] == "." and back[3] != "." and _letter(back[0] or "") and _upper(back[2]) else None
            kind = "selfCall" if on in ("self", "Self") else "superCall" if on == "super" else "instanceCall" if of is None else "staticCall"
            if kind == "staticCall":
                receiver = of
            elif kind == "selfCall":
                receiver = owner
            elif kind == "instanceCall" and on is not None and (type_ := local.get((line, part, on))) is not None:
                receiver = type_.replace("?", "").replace("!", "")
        elif upper:
            kind, callee, receiver = "initCall", "init", token
        else:
            kind, receiver = ("freeCall", None) if owner is None else ("selfCall", owner)
        out.append((name, line, callee, receiver, kind, scan.line(pos)))
    return out


def _body(scan: Scan, brace: int) -> tuple[str, int, int, str | None] | None:
    """(name, line, end, type) of the function of a type or of the file whose body a brace begins."""
    opens = scan.opens.get(brace)
    if not opens or opens[0] not in _FUNCTIONS or scan.leader.get(brace) != opens[2]:
        return None
    scope = scan.scope(opens[2])
    if scope and scope[0] not in _TYPE:
        return None
    return opens[1], scan.line(opens[2]), scan.mate.get(brace, 1 << 30), scope[1] if scope else None


def _per_file(sources: DataFrame, columns: str, read: Callable[[str, str], list[tuple]]) -> DataFrame:
    """The rows that ``read`` makes of each file with content, each file once; of several contents the greatest counts."""
    schema = to_arrow_schema(StructType.fromDDL(columns))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held.clear()
            return batch

        for batch in batches:
            for project, path, content in zip(*(batch.column(i) for i in range(3)), strict=True):
                project, path = project.as_py(), path.as_py()
                for row in read(content.as_py(), path):
                    held.append((project, path, *row))
                    if len(held) >= ROWS:
                        yield flush()
        if held:
            yield flush()

    files = sources.where("content IS NOT NULL AND filePath IS NOT NULL").groupBy("projectId", "filePath").agg(F.max("content").alias("content"))
    return files.mapInArrow(rows, columns)


def facts(sources: DataFrame, *wanted: str) -> DataFrame:
    """The facts (``FACTS``, source) of each file with content."""
    names = (*_TYPES, "source")

    def read(text: str, path: str) -> list[tuple]:
        return [tuple(map(r.get, names)) for r in read_facts(text, path, wanted or None)]

    return _per_file(sources, FACTS + ", source string", read)


def calls(sources: DataFrame) -> DataFrame:
    """``declarations.calls`` of each file with content."""
    return _per_file(sources, CALLS, lambda text, path: read_calls(text))
