"""Edges derived from names: what extensions, inheritance clauses, references and calls mean.

Names resolve within their project, and then in the ``toolkit`` project if one is given, whose
symbols all projects see. Each pass is a pure function of symbols and facts, so deleting
and rebuilding edges is a matter of running it again; an incremental run equals a full one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.functions.names import PLACEHOLDER, TYPE_KINDS, is_named, string_list

REFERRED = (*TYPE_KINDS, "typeAlias")


def _real(nodes: DataFrame) -> DataFrame:
    return nodes.where(~F.coalesce(is_named("qualifiedName", PLACEHOLDER), F.lit(False)))


def _first_by_name(nodes: DataFrame, *kinds: str) -> DataFrame:
    """(projectId, name, target, target_kind): of several of a name the least qualified name and id."""
    found = _real(nodes).where(F.col("kind").isin(*kinds)).groupBy("projectId", "name").agg(F.min(F.struct("qualifiedName", "id", "kind")).alias("first"))
    return found.select("projectId", "name", F.col("first.id").alias("target"), F.col("first.kind").alias("target_kind"))


def _meet(facts: DataFrame, nodes: DataFrame, toolkit: int | None, *kinds: str) -> DataFrame:
    """``facts`` (with projectId and name) that mean something, with target and target_kind: a symbol of
    the own project first, else one of the project whose symbols all others see."""
    own = _first_by_name(nodes, *kinds)
    if toolkit is None:
        return facts.join(own, ["projectId", "name"])
    shared = _first_by_name(nodes.where(F.col("projectId") == toolkit), *kinds).select("name", F.col("target").alias("_target"), F.col("target_kind").alias("_kind"))
    met = facts.join(own, ["projectId", "name"], "left").join(shared, "name", "left")
    found = met.withColumn("target_kind", F.when(F.col("target").isNull(), F.col("_kind")).otherwise(F.col("target_kind"))).withColumn("target", F.coalesce("target", "_target"))
    return found.where("target IS NOT NULL").drop("_target", "_kind")


def placeholder_targets(nodes: DataFrame) -> DataFrame:
    """(placeholder, target): the real type that each placeholder's name stands for, if there is one."""
    waiting = nodes.where(is_named("qualifiedName", PLACEHOLDER)).select("projectId", "name", F.col("id").alias("placeholder"))
    return waiting.join(_first_by_name(nodes, "struct", "class", "enum", "actor"), ["projectId", "name"]).select("placeholder", "target")


def repoint(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges whose placeholder ends are replaced; the other columns stay. Links that become alike are
    left to ``first_writer_wins``."""
    for end in ("sourceId", "targetId"):
        known = mapping.select(F.col("placeholder").alias(end), F.col("target").alias("_real"))
        edges = edges.join(known, end, "left").withColumn(end, F.coalesce("_real", end)).drop("_real")
    return edges


def extension_edges(nodes: DataFrame, toolkit: int | None = None) -> DataFrame:
    """(sourceId, targetId, kind, metadata): ``extends`` from each extension to the types of its name,
    and ``conformsTo`` from those types to the protocols that the extension adds."""
    own = nodes.where("kind = 'extension'").select("projectId", "name", F.col("id").alias("extension"), "inheritedTypes")
    bases = _real(nodes).where(~F.col("kind").isin("extension", "file", "module", "function", "variable")).select("projectId", "name", F.col("id").alias("base"))
    pairs = own.join(bases, ["projectId", "name"])
    none = F.lit(None).cast("string").alias("metadata")
    extends = pairs.select(F.col("extension").alias("sourceId"), F.col("base").alias("targetId"), F.lit("extends").alias("kind"), none)
    added = pairs.select("projectId", "base", F.explode(F.array_distinct(string_list("inheritedTypes"))).alias("name"))
    conforms = _meet(added, nodes, toolkit, "protocol").select(F.col("base").alias("sourceId"), F.col("target").alias("targetId"), F.lit("conformsTo").alias("kind"), F.lit('{"via_extension":true}').alias("metadata"))
    return extends.unionByName(conforms.distinct())


def inheritance_edges(nodes: DataFrame, toolkit: int | None = None) -> DataFrame:
    """(sourceId, targetId, kind): ``inherits`` between classes, ``conformsTo`` otherwise, for each name in
    an inheritance clause that is a type of the project or of the toolkit."""
    clauses = _real(nodes).where(F.col("kind").isin(*TYPE_KINDS)).select("projectId", F.col("id").alias("sourceId"), F.col("kind").alias("source_kind"), F.explode(F.array_distinct(string_list("inheritedTypes"))).alias("name"))
    met = _meet(clauses, nodes, toolkit, *TYPE_KINDS).where("sourceId <> target")
    kind = F.when((F.col("source_kind") == "class") & (F.col("target_kind") == "class"), "inherits").otherwise("conformsTo")
    return met.select("sourceId", F.col("target").alias("targetId"), kind.alias("kind")).distinct()


def reference_sites(nodes: DataFrame, references: DataFrame, toolkit: int | None = None) -> DataFrame:
    """(sourceId, targetId, filePath, line): where a type, named by file and name, refers to types by name.

    What an extension refers to is what its type refers to; nothing refers to itself.
    """
    holders = nodes.where(F.col("kind").isin(*TYPE_KINDS, "extension")).select("projectId", "filePath", F.col("name").alias("container"), F.col("id").alias("holder"), (F.col("kind") == "extension").alias("is_extension"))
    # Of several holders of a name in a file a type comes before its extensions.
    one = holders.groupBy("projectId", "filePath", "container").agg(F.min(F.struct("is_extension", "holder")).alias("h"))
    base = _first_by_name(nodes, *TYPE_KINDS).select("projectId", F.col("name").alias("container"), F.col("target").alias("base"))
    facts = references.select("projectId", "filePath", "container", F.col("referenced").alias("name"), "line").distinct()
    held = facts.join(one, ["projectId", "filePath", "container"]).join(base, ["projectId", "container"], "left")
    source = F.when(F.col("h.is_extension"), F.coalesce("base", "h.holder")).otherwise(F.col("h.holder"))
    met = _meet(held, nodes, toolkit, *REFERRED)
    return met.select(source.alias("sourceId"), F.col("target").alias("targetId"), "filePath", "line").where("sourceId <> targetId")


def reference_edges(nodes: DataFrame, references: DataFrame, toolkit: int | None = None) -> DataFrame:
    """(sourceId, targetId): the distinct links of ``reference_sites``."""
    return reference_sites(nodes, references, toolkit).select("sourceId", "targetId").distinct()


def call_sites(nodes: DataFrame, contains: DataFrame, calls: DataFrame, toolkit: int | None = None) -> DataFrame:
    """(sourceId, targetId, way, call_kind, filePath, line): calls resolved by their receiver's type (way 1), as
    makers of an instance (2), or as free functions (3).

    ``contains`` has sourceId and targetId. Callers are found by file, line and name; calls whose
    callee has no symbol are dropped.
    """
    functions = nodes.where("kind IN ('function', 'initializer')")
    callers = functions.select("projectId", "filePath", F.col("line").alias("caller_line"), F.col("name").alias("caller"), F.col("id").alias("sourceId"))
    facts = calls.select("projectId", "filePath", "caller", "caller_line", "callee", "receiver", "call_kind", "line").distinct().join(callers, ["projectId", "filePath", "caller_line", "caller"])
    place = ("filePath", "line")
    types = _real(nodes).where(F.col("kind").isin(*TYPE_KINDS)).select("projectId", F.col("name").alias("receiver"), F.col("id").alias("owner"))
    members = contains.select(F.col("sourceId").alias("owner"), F.col("targetId").alias("targetId")).join(nodes.select(F.col("id").alias("targetId"), "name", "kind"), "targetId")
    typed = facts.where("receiver IS NOT NULL").join(types, ["projectId", "receiver"])
    by_type = typed.join(members.where("kind IN ('function', 'variable', 'initializer')").select("owner", F.col("name").alias("callee"), "targetId"), ["owner", "callee"]).select("sourceId", "targetId", F.lit(1).alias("way"), "call_kind", *place)
    makers = typed.where("call_kind = 'initCall'").join(members.where("kind = 'initializer'").select("owner", "targetId"), "owner").select("sourceId", "targetId", F.lit(2).alias("way"), F.lit("initCall").alias("call_kind"), *place)
    # Free functions: those no type contains. Overloads are one name, so a call means the first of them.
    free = _real(nodes).join(contains.select(F.col("targetId").alias("id")), "id", "left_anti")
    plain = facts.where("call_kind IN ('freeCall', 'selfCall')").select("projectId", F.col("callee").alias("name"), "sourceId", *place).distinct()
    freely = _meet(plain, free, toolkit, "function").select("sourceId", F.col("target").alias("targetId"), F.lit(3).alias("way"), F.lit("freeCall").alias("call_kind"), *place)
    return by_type.unionByName(makers).unionByName(freely).where("sourceId <> targetId")


def call_edges(nodes: DataFrame, contains: DataFrame, calls: DataFrame, toolkit: int | None = None) -> DataFrame:
    """(sourceId, targetId, metadata): the links of ``call_sites``; of several ways to one link the least counts,
    then the least kind."""
    found = call_sites(nodes, contains, calls, toolkit)
    return found.groupBy("sourceId", "targetId").agg(F.min(F.struct("way", "call_kind")).alias("first")).select("sourceId", "targetId", F.col("first.call_kind").alias("metadata"))


def environment_edges(nodes: DataFrame, contains: DataFrame, wrappers: DataFrame, keys: DataFrame) -> DataFrame:
    """(sourceId, targetId): views and the types that their environment wrappers give them.

    ``wrappers`` has symbolId, wrapperName and argument: ``\\.key`` names a key of ``keys`` (projectId,
    keyName, valueType), ``Type.self`` a type. The owner of the wrapped property is the source;
    nothing uses itself.
    """
    owners = contains.select(F.col("sourceId").alias("owner"), F.col("targetId").alias("symbolId")).join(nodes.select(F.col("id").alias("owner"), "projectId"), "owner")
    used = wrappers.where("wrapperName = 'Environment' AND argument IS NOT NULL").select("symbolId", "argument").distinct().join(owners, "symbolId")
    by_key = used.where(F.startswith("argument", F.lit("\\."))).withColumn("keyName", F.substring("argument", 3, 1 << 30)).join(keys.select("projectId", "keyName", F.col("valueType").alias("name")).where("name IS NOT NULL").distinct(), ["projectId", "keyName"]).select("projectId", "owner", "name")
    by_type = used.where(F.endswith("argument", F.lit(".self")) & ~F.startswith("argument", F.lit("\\."))).select("projectId", "owner", F.regexp_replace("argument", r"\.self$", "").alias("name"))
    met = by_key.unionByName(by_type).join(_first_by_name(nodes, *TYPE_KINDS), ["projectId", "name"])
    return met.where("owner <> target").select(F.col("owner").alias("sourceId"), F.col("target").alias("targetId")).distinct()


def environment_check(nodes: DataFrame, contains: DataFrame, composes: DataFrame, wrappers: DataFrame, injections: DataFrame, system_keys: tuple[str, ...] = (), max_depth: int = 20) -> DataFrame:
    """(view, key, provider, depth): each view's environment keys and the nearest view above that injects
    the same key path; null where none does.

    ``composes`` has from_id and to_id, ``injections`` viewSymbolId and keyPath. ``system_keys``,
    without their ``\\.``, need no provider.
    """
    from symloom.operators.walk import nearest_above

    owners = contains.select(F.col("sourceId").alias("seed"), F.col("targetId").alias("symbolId"))
    asked = wrappers.where("wrapperName = 'Environment' AND argument IS NOT NULL").where(~F.col("argument").isin(*["\\." + k for k in system_keys]) if system_keys else F.lit(True))
    origins = asked.select("symbolId", F.col("argument").alias("mark")).join(owners, "symbolId").join(nodes.select(F.col("id").alias("seed")), "seed", "left_semi").select("seed", "mark")
    marks = injections.select(F.col("viewSymbolId").alias("node"), F.col("keyPath").alias("mark"))
    return nearest_above(composes, marks, origins, max_depth).select(F.col("seed").alias("view"), F.col("mark").alias("key"), "provider", "depth")


def enrich_symbols(symbols: DataFrame, occurrences: DataFrame) -> DataFrame:
    """``symbols`` with usr filled from a compiler's definitions of the same file, line and simple name.

    ``occurrences`` has filePath, line, symbolUSR, symbolName and roles; a usr that is there stays,
    and the first definition by usr counts.
    """
    defined = occurrences.where(F.array_contains("roles", "definition")).groupBy("filePath", "line", F.substring_index("symbolName", "(", 1).alias("name")).agg(F.min("symbolUSR").alias("_usr"))
    return symbols.join(defined, ["filePath", "line", "name"], "left").withColumn("usr", F.coalesce("usr", "_usr")).select(*symbols.columns)


def compiler_edges(symbols: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(sourceId, targetId, kind, metadata) from a compiler's occurrences: calls from the symbol that a call
    stands in, overrides, and requirements from the implementing to the required member."""
    ids = symbols.where("usr IS NOT NULL").groupBy("usr").agg(F.min("id").alias("id"))
    related = occurrences.select("symbolUSR", "roles", F.explode("relations").alias("r"))
    has = lambda name: F.array_contains("r.roles", name)
    kind = F.when(F.array_contains("roles", "call") & has("calledBy"), "calls").when(has("overrideOf"), "overrides").when(has("baseOf"), "implementsRequirement")
    pair = related.select(kind.alias("kind"), "symbolUSR", F.col("r.usr").alias("other")).where("kind IS NOT NULL")
    # A call is recorded at the callee, an override and a base at the overriding and the required member.
    turned = F.col("kind").isin("calls", "implementsRequirement")
    ends = pair.select("kind", F.when(turned, F.col("other")).otherwise(F.col("symbolUSR")).alias("a"), F.when(turned, F.col("symbolUSR")).otherwise(F.col("other")).alias("b"))
    met = ends.join(ids.select(F.col("usr").alias("a"), F.col("id").alias("sourceId")), "a").join(ids.select(F.col("usr").alias("b"), F.col("id").alias("targetId")), "b")
    return met.where("sourceId <> targetId").select("sourceId", "targetId", "kind", F.lit("indexStore").alias("metadata")).distinct()


def fill_receivers(calls: DataFrame, symbols: DataFrame, contains: DataFrame, occurrences: DataFrame) -> DataFrame:
    """``calls`` whose null receivers are filled from a compiler's call occurrences of the same file, line and
    simple callee name: with the type that contains the called symbol, found by its usr.

    Of several occurrences at a place the greatest usr counts, of several types the least name. The
    ``call_edges`` of the result that no edge links yet are the further edges.
    """
    called = occurrences.where(F.array_contains("roles", "call") & F.exists("relations", lambda r: F.array_contains(r["roles"], "calledBy")))
    places = called.groupBy("filePath", "line", F.substring_index("symbolName", "(", 1).alias("callee")).agg(F.max("symbolUSR").alias("usr"))
    ids = symbols.where("usr IS NOT NULL").groupBy("usr").agg(F.min("id").alias("targetId"))
    types = symbols.where(F.col("kind").isin(*TYPE_KINDS)).select(F.col("id").alias("sourceId"), F.col("name").alias("_receiver"))
    owners = contains.select("sourceId", "targetId").join(types, "sourceId").groupBy("targetId").agg(F.min("_receiver").alias("_receiver"))
    known = places.join(ids, "usr").join(owners, "targetId").select("filePath", "line", "callee", "_receiver")
    return calls.join(known, ["filePath", "line", "callee"], "left").withColumn("receiver", F.coalesce("receiver", "_receiver")).select(*calls.columns)
