"""Declarations, imports, calls and type references of Swift files, from a table of tokens.

What a token heads and stands in comes from windows over the rows of its file and of its brace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.sources.lexer import tokens

# The language's words that matter here.
TYPE_WORDS = ("struct", "class", "enum", "protocol", "actor", "extension")
ACCESS_WORDS = ("public", "private", "fileprivate", "internal", "package", "open")
MODIFIER_WORDS = ("final", "static", "class", "override", "mutating", "nonmutating", "lazy", "weak", "unowned", "required", "convenience", "indirect", "dynamic", "nonisolated", "isolated", "optional", "prefix", "postfix", "infix")
BLOCK_WORDS = ("if", "else", "for", "while", "repeat", "switch", "do", "catch", "guard", "defer", "in", "return", "get", "set", "willSet", "didSet")
NO_CALLS = (*BLOCK_WORDS, "func", "init", "self", "super", "Self", "throw", "throws", "await", "try", "as", "is", "where", "case", "let", "var", "subscript")

NO_TYPES = ("func", "var", "let", "init", "subscript", "typealias", "case", "deinit", "import")
FILE = ("projectId", "filePath")


def scoped_tokens(sources: DataFrame) -> DataFrame:
    """Tokens with what they head and stand in.

    ``head`` (kind, name, pos, line, column) is set on the word that begins a declaration; ``scope``
    (kind, name) is the innermost brace's declaration, null at the top of a file; ``opens`` on a
    brace is the declaration whose body it begins, with the body's last line and position;
    ``leader`` is the last head in the same brace, with its scope.
    """
    file, inside = Window.partitionBy(*FILE).orderBy("pos"), Window.partitionBy(*FILE, "brace").orderBy("pos")
    near = lambda i: F.lead("token", i).over(file)
    token = F.col("token")
    words = tokens(sources).select("*", near(1).alias("next"), near(-1).alias("prev"), F.lag("stop").over(file).alias("prev_stop"), F.lag("last_line").over(file).alias("prev_line"))
    parts = F.sum(F.when((F.col("round") == 0) & token.isin("{", "}", ";"), 1).otherwise(0)).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    lone = (F.coalesce("prev", F.lit("")) != ".") & (F.col("round") == 0)
    named = F.col("next").rlike(r"^`?[\p{L}_]")
    kind = (
        F.when(token.isin(*TYPE_WORDS) & named & ~F.col("next").isin(*NO_TYPES, *MODIFIER_WORDS, *ACCESS_WORDS), token)
        .when((token == "func") & F.col("next").isNotNull(), "function")
        .when((token == "init") & F.col("next").isin("(", "?", "!", "<"), "initializer")
        .when(token.isin("var", "let") & named, "variable").when((token == "typealias") & named, "typeAlias")
        .when((token == "case") & named, "enumCase")
    )
    name = F.when(token == "init", F.concat(F.lit("init"), F.when(F.col("next").isin("?", "!"), F.col("next")).otherwise(""))).otherwise(F.regexp_replace("next", "`", ""))
    piece = F.coalesce(parts, F.lit(0))
    head = F.when(lone & kind.isNotNull(), F.struct(kind.alias("kind"), name.alias("name"), "pos", "line", "column", "piece"))
    block = F.when(lone & token.isin(*BLOCK_WORDS), F.struct(F.lit("block").alias("kind"), token.alias("name"), "pos", "line", "column", "piece"))
    headed = words.withColumn("piece", piece).withColumn("head", head).withColumn("any", F.coalesce("head", block))
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    headed = headed.withColumn("last", F.last("any", ignorenulls=True).over(so_far))
    opener = F.when((token == "{") & (F.col("round") == 0) & (F.col("last.piece") == F.col("piece")), F.col("last"))
    headed = headed.withColumn("opener", opener).drop("any", "last")
    # A brace and what stands right in it, so that each row sees what the brace opens.
    own = Window.partitionBy(*FILE, F.when(token == "{", F.col("pos")).when(token == "}", F.coalesce("mate", "brace")).otherwise(F.col("brace"))).orderBy("pos")
    brace = F.when(token == "{", F.struct(F.coalesce("opener.kind", F.lit("block")).alias("kind"), F.col("opener.name").alias("name")))
    scope = F.when((token != "{") & ((F.col("brace") >= 0) | (token == "}")), F.first(brace, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    opens = F.when(F.col("opener").isNotNull(), F.struct("opener.*", F.struct(F.col("mate_line").alias("line"), F.col("mate").alias("pos")).alias("close")))
    scoped = headed.withColumns({"scope": scope, "opens": opens}).drop("opener")
    return scoped.withColumn("leader", F.last(F.when(F.col("head").isNotNull(), F.struct("head.*", "scope")), ignorenulls=True).over(so_far))


def _is_type(kind: str) -> Column:
    return F.col(kind).isin(*TYPE_WORDS)


def _with_body(scoped: DataFrame, *kinds: str) -> DataFrame:
    """``body``: the member (name, line, end, type) of one of the kinds that a token stands in, for members
    of types and of files; null outside."""
    before = Window.partitionBy("projectId", "filePath").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    outermost = F.col("opens.kind").isin(*kinds) & (F.col("leader.pos") == F.col("opens.pos")) & (F.col("leader.scope").isNull() | _is_type("leader.scope.kind"))
    body = F.when(outermost, F.struct(F.col("opens.name").alias("name"), F.col("opens.line").alias("line"), F.coalesce("opens.close.pos", F.lit(1 << 30)).alias("end"), F.col("leader.scope.name").alias("type")))
    seen = scoped.withColumn("body", F.last(body, ignorenulls=True).over(before))
    return seen.withColumn("body", F.when(F.col("pos") < F.col("body.end"), F.col("body")))


def declarations(scoped: DataFrame) -> DataFrame:
    """(projectId, filePath, kind, name, parent, line, end_line) of types, their members and top-level
    declarations; what stands in bodies of functions and accessors is left out.

    Only the first name of a ``var`` or ``case`` with several is taken.
    """
    bodies = scoped.where("opens IS NOT NULL AND opens.kind <> 'block'").select("projectId", "filePath", F.col("opens.pos").alias("pos"), F.col("opens.close.line").alias("end_line"))
    heads = scoped.where("head IS NOT NULL").where(F.col("scope").isNull() | F.col("scope.kind").isin(*TYPE_WORDS)).where("head.kind <> 'enumCase' OR scope.kind = 'enum'")
    found = heads.join(bodies, ["projectId", "filePath", "pos"], "left")
    return found.select("projectId", "filePath", "head.kind", "head.name", F.col("scope.name").alias("parent"), "line", F.coalesce("end_line", "line").alias("end_line"))


def imports(scoped: DataFrame) -> DataFrame:
    """(projectId, filePath, module, testable, line) of each import."""
    return scoped.where("token = 'import' AND next IS NOT NULL AND brace = -1").select("projectId", "filePath", F.col("next").alias("module"), (F.coalesce("prev", F.lit("")) == "@testable").alias("testable"), "line")


def _annotated_locals(bodied: DataFrame) -> DataFrame:
    """(projectId, filePath, body_line, part, name, pos, type): each binding of a local ``var`` or ``let`` that has
    a type, in the words of its source; bindings of conditions and patterns are none."""
    file = Window.partitionBy("projectId", "filePath").orderBy("pos")
    token = F.col("token")
    opener = F.struct("token", "brace", "piece", "round", F.coalesce(F.col("prev").isin("if", "guard", "while", "case", "for", ","), F.lit(False)).alias("condition"))
    last = F.last(F.when(token.isin("let", "var", "case"), opener), ignorenulls=True).over(file.rowsBetween(Window.unboundedPreceding, -1))
    led = bodied.withColumn("led", last)
    binds = token.rlike(r"^`?[\p{L}_]") & (F.col("next") == ":") & F.col("prev").isin("let", "var", ",") & F.col("led.token").isin("let", "var") & (F.col("led.brace") == F.col("brace")) & (F.col("led.piece") == F.col("piece")) & (F.col("led.round") == F.col("round")) & ~F.col("led.condition") & F.col("body").isNotNull()
    name = F.when(binds, F.struct(F.regexp_replace("token", "`", "").alias("name"), "pos", "round", "part", F.col("body.line").alias("body_line")))
    held = led.withColumn("local", F.last(name, ignorenulls=True).over(file.rowsBetween(Window.unboundedPreceding, 0))).where("local IS NOT NULL")
    # The type goes on to a sign that ends it in no bracket, or to a line that doesn't continue it.
    own = Window.partitionBy("projectId", "filePath", "local.pos").orderBy("pos")
    angle = F.sum(F.when(token == "<", 1).when(token == ">", -1).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, 0))
    level = held.withColumn("angle", angle).withColumn("row", F.row_number().over(own)).withColumn("line_before", F.lag("line").over(own)).withColumn("end_before", F.lag(F.col("start") + F.length("token")).over(own))
    outside = (F.col("round") == F.col("local.round")) & (F.col("angle") == 0)
    breaks = outside & (F.col("line") != F.col("line_before")) & ~F.col("prev").isin("->", "&", ".", ":", "some", "any") & ~token.isin("->", "&", ".")
    ends = (F.col("row") > 2) & ((outside & token.isin("=", ",", "{", "}", ";")) | (F.col("round") < F.col("local.round")) | breaks)
    inside = level.withColumn("ended", F.coalesce(F.sum(ends.cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).where("ended = 0 AND row > 2")
    spaced = F.concat(F.when((F.col("row") > 3) & (F.col("start") > F.col("end_before")), " ").otherwise(""), "token")
    words = inside.groupBy("projectId", "filePath", "local").agg(F.sort_array(F.collect_list(F.struct("pos", spaced.alias("word")))).alias("words"))
    return words.select("projectId", "filePath", "local.body_line", "local.part", "local.name", "local.pos", F.array_join("words.word", "").alias("type"))


def calls(scoped: DataFrame) -> DataFrame:
    """(projectId, filePath, caller, caller_line, callee, receiver, call_kind, line) of each call in a function.

    A capital callee makes an instance: its callee is ``init``. A call on a local has the type that the
    last annotation of that name before it gives, without ``?`` and ``!``; a function's beginning or end
    forgets annotations. ``Type.m()`` and ``Type.x.m()`` are static calls on Type; other chains have
    no receiver. Functions inside functions belong to the outermost one.
    """
    file = Window.partitionBy("projectId", "filePath").orderBy("pos")
    function = ("function", "initializer")
    bound = F.coalesce(F.col("head.kind").isin(*function), F.lit(False)) | F.coalesce((F.col("token") == "}") & F.col("scope.kind").isin(*function), F.lit(False))
    back = {f"back{i}": F.lag("token", i).over(file) for i in (2, 3, 4, 5)}
    wide = scoped.withColumns({"part": F.sum(bound.cast("int")).over(file.rowsBetween(Window.unboundedPreceding, 0)), **back})
    bodied = _with_body(wide, *function)
    sites = bodied.where("body IS NOT NULL").where(F.col("token").rlike(r"^[\p{L}_]") & (F.col("next") == "(") & ~F.col("token").isin(*NO_CALLS) & (F.coalesce("prev", F.lit("")) != "func"))
    dot = lambda c: F.coalesce(F.col(c) == ".", F.lit(False))
    member, upper = dot("prev"), F.col("token").rlike(r"^\p{Lu}")
    on = F.when(member & ~dot("back3") & F.col("back2").rlike(r"^`?[\p{L}_]"), F.regexp_replace("back2", "`", ""))
    owner = F.when(on.rlike(r"^\p{Lu}") & (on != "Self"), on).when(member & dot("back3") & ~dot("back5") & F.col("back2").rlike(r"^[\p{L}_]") & F.col("back4").rlike(r"^\p{Lu}"), F.col("back4"))
    typed = F.col("body.type").isNotNull()
    kind = (
        F.when(member & on.isin("self", "Self"), "selfCall").when(member & (on == "super"), "superCall").when(member & owner.isNotNull(), "staticCall").when(member, "instanceCall")
        .when(upper, "initCall").when(typed, "selfCall").otherwise("freeCall")
    )
    receiver = F.when(kind == "staticCall", owner).when(~member & upper, F.col("token")).when(kind == "selfCall", F.col("body.type"))
    callee = F.when(~member & upper, "init").otherwise(F.col("token"))
    found = sites.select("projectId", "filePath", F.col("body.line").alias("body_line"), "part", F.when(kind == "instanceCall", on).alias("name"), "pos", F.col("body.name").alias("caller"), callee.alias("callee"), receiver.alias("receiver"), kind.alias("call_kind"), "line")
    events = found.unionByName(_annotated_locals(bodied), allowMissingColumns=True)
    earlier = Window.partitionBy("projectId", "filePath", "body_line", "part", "name").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    local = F.regexp_replace(F.last("type", ignorenulls=True).over(earlier), "[?!]", "")
    known = events.withColumn("receiver", F.when((F.col("call_kind") == "instanceCall") & F.col("name").isNotNull(), local).otherwise(F.col("receiver")))
    return known.where("callee IS NOT NULL").select("projectId", "filePath", "caller", F.col("body_line").alias("caller_line"), "callee", "receiver", "call_kind", "line")


def type_references(scoped: DataFrame) -> DataFrame:
    """(projectId, filePath, container, referenced, line): capital words in a type's clauses, members and
    their bodies that don't name the type itself, declare anything, or follow a dot."""
    word = F.col("token")
    own_clause = _is_type("leader.kind") & (F.col("leader.piece") == F.col("piece")) & (F.col("leader.pos") < F.col("pos"))
    container = F.when(own_clause, F.col("leader.name")).when(_is_type("scope.kind"), F.col("scope.name")).otherwise(F.col("body.type"))
    seen = _with_body(scoped, "function", "initializer", "variable").withColumn("container", container)
    declares = F.coalesce(F.col("prev").isin(".", *TYPE_WORDS, "func", "typealias", "case", "import", "let", "var"), F.lit(False))
    return seen.where(word.rlike(r"^\p{Lu}[\p{L}\p{N}_]*$") & (word != F.col("container")) & (word != "Self") & ~declares).select("projectId", "filePath", "container", word.alias("referenced"), "line")
