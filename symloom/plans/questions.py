"""The catalogue's questions, each over a whole graph at once.

Every function takes a Graph and gives a flat DataFrame; a single symbol, module or project is a
filter on the result, which Catalyst pushes down. Names resolve within their project.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symloom.functions.names import API_LEVELS, FILE, MODULE, PLACEHOLDER, TYPE_KINDS, in_tests, is_named, string_list
from symloom.operators.search import ranked_matches
from symloom.operators.walk import walk
from symloom.plans.graph import Graph
from symloom.sources.files import file_states, slices

DECLARED = ("struct", "class", "enum", "actor", "function", "typeAlias")
AUDITED = (*TYPE_KINDS, "function", "variable", "typeAlias")
API_MEMBERS = ("function", "variable", "initializer", "typeAlias", "enum", "struct")


def _as(nodes: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return nodes.select(F.col("id").alias(f"{prefix}_id"), *[F.col(c).alias(f"{prefix}_{_snake(c)}") for c in columns])


def _snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name)


def read_symbol(graph: Graph, sources: DataFrame, hashes: DataFrame, context: int = 0) -> DataFrame:
    """(symbol_id, source, stale): numbered source lines of each symbol with a file and a line.

    ``stale`` tells that the stored hash differs from the file's; it is false if either is missing.
    The source is null where the file's content is.
    """
    keys = ["projectId", "filePath"]
    nodes = graph.nodes(*keys, "line", "endLine").where("filePath IS NOT NULL AND line IS NOT NULL")
    nodes = nodes.select("id", *keys, (F.col("line") - context).alias("first"), (F.coalesce("endLine", "line") + context).alias("last"))
    states = file_states(sources, hashes).select(*keys, (F.col("state") == "changed").alias("stale"))
    # A file's slices, its state and its symbols meet by file and range; slices are distinct, and content moves once per file.
    joined = nodes.join(slices(nodes, sources, keys), [*keys, "first", "last"], "left").join(states, keys, "left")
    return joined.select(F.col("id").alias("symbol_id"), "source", F.coalesce("stale", F.lit(False)).alias("stale"))


def symbol_relations(graph: Graph) -> DataFrame:
    """(symbol_id, section, other_id, other_name, other_kind): members, conformances, extensions."""
    links = graph.links("contains", "conformsTo", "inherits", "extends")
    section = F.when(F.col("kind") == "contains", "member").when(F.col("kind") == "extends", "extension").otherwise("conformance")
    seen = links.select(
        F.when(F.col("kind") == "extends", F.col("targetId")).otherwise(F.col("sourceId")).alias("symbol_id"), section.alias("section"),
        F.when(F.col("kind") == "extends", F.col("sourceId")).otherwise(F.col("targetId")).alias("other_id"),
    ).distinct()
    return seen.join(_as(graph.nodes("name", "kind"), "other", "name", "kind"), "other_id").select("symbol_id", "section", "other_id", "other_name", "other_kind")


def symbols_in_file(graph: Graph) -> DataFrame:
    """(file_path, place, symbol_id, kind, name) in order of line and name; file symbols and placeholders left out."""
    nodes = graph.nodes("filePath", "qualifiedName", "line", "name", "kind").where("filePath IS NOT NULL").where(~F.coalesce(is_named("qualifiedName", PLACEHOLDER, FILE), F.lit(False)))
    place = F.row_number().over(Window.partitionBy("filePath").orderBy(F.asc_nulls_first("line"), "name", "id"))
    return nodes.select(F.col("filePath").alias("file_path"), place.alias("place"), F.col("id").alias("symbol_id"), "kind", "name")


def search(graph: Graph, kind: str | None = None, module: str | None = None, attribute: str | None = None) -> DataFrame:
    """(symbol_id, name, kind, module) of all symbols with the given kind, module and attribute."""
    nodes = graph.nodes("projectId", "moduleId", "filePath", "qualifiedName", "name", "kind", "attributes").where(~F.coalesce(is_named("qualifiedName", PLACEHOLDER), F.lit(False)))
    if kind:
        nodes = nodes.where(F.col("kind") == kind)
    if attribute:
        nodes = nodes.where(F.array_contains(string_list("attributes"), "@" + attribute.lstrip("@")))
    found = graph.module_of(nodes)
    if module:
        found = found.where(F.col("module") == module)
    return found.select(F.col("id").alias("symbol_id"), "name", "kind", "module")


def search_text(graph: Graph, queries: DataFrame, top: int | None = 20, kind: str | None = None, module: str | None = None, attribute: str | None = None) -> DataFrame:
    """(query, symbol_id, score, place): prefix search over name and qualifiedName of the symbols with the
    given kind, module and attribute; placeholders are never found. Scores count all symbols."""
    nodes = graph.nodes("projectId", "moduleId", "filePath", "name", "qualifiedName", "kind", "attributes")
    listed = ~F.coalesce(is_named("qualifiedName", PLACEHOLDER), F.lit(False))
    if kind:
        listed = listed & (F.col("kind") == kind)
    if attribute:
        listed = listed & F.array_contains(string_list("attributes"), "@" + attribute.lstrip("@"))
    if module:
        inside = graph.module_of(nodes).where(F.col("module") == module).select("id", F.lit(True).alias("in_module")).distinct()
        nodes, listed = nodes.join(inside, "id", "left"), listed & F.coalesce("in_module", F.lit(False))
    return ranked_matches(nodes.withColumnRenamed("id", "symbol_id"), "symbol_id", ["name", "qualifiedName"], queries, top, listed)


def lookup(graph: Graph, names: DataFrame) -> DataFrame:
    """(projectId, query, symbol_id, how): what a name means in a project.

    ``names`` has projectId and query. A plain name of a symbol that is no extension, file, module
    or placeholder comes first, then a qualified name, then an extension's name; of several the
    least qualified name and id. Queries that mean nothing have no row.
    """
    nodes = graph.nodes("projectId", "name", "qualifiedName", "kind")
    real = ~F.coalesce(is_named("qualifiedName", PLACEHOLDER), F.lit(False))
    plain = nodes.where(real & ~F.col("kind").isin("extension", "file", "module")).select("projectId", F.col("name").alias("query"), F.lit(1).alias("rank"), "qualifiedName", "id")
    qualified = nodes.select("projectId", F.col("qualifiedName").alias("query"), F.lit(2).alias("rank"), "qualifiedName", "id")
    extension = nodes.where(F.col("kind") == "extension").select("projectId", F.col("name").alias("query"), F.lit(3).alias("rank"), "qualifiedName", "id")
    asked = names.select("projectId", "query").distinct()
    best = asked.join(plain.unionByName(qualified).unionByName(extension), ["projectId", "query"]).groupBy("projectId", "query").agg(F.min(F.struct("rank", "qualifiedName", "id")).alias("best"))
    how = F.when(F.col("best.rank") == 1, "name").when(F.col("best.rank") == 2, "qualified").otherwise("extension")
    return best.select(F.col("projectId").alias("project_id"), "query", F.col("best.id").alias("symbol_id"), how.alias("how"))


def find_conformers(graph: Graph) -> DataFrame:
    """(protocol_id, conformer_id, conformer_name, conformer_kind) of every protocol."""
    protocols = graph.nodes("kind").where("kind = 'protocol'").select(F.col("id").alias("protocol_id"))
    pairs = graph.links("conformsTo").select(F.col("targetId").alias("protocol_id"), F.col("sourceId").alias("conformer_id"))
    return pairs.join(protocols, "protocol_id").join(_as(graph.nodes("name", "kind"), "conformer", "name", "kind"), "conformer_id").select("protocol_id", "conformer_id", "conformer_name", "conformer_kind")


def protocol_coverage(graph: Graph) -> DataFrame:
    """(protocol_id, conformer_id, requirement_id, requirement_name, satisfied).

    A requirement is satisfied when a member of the conformer, or of an extension of it, has its name.
    """
    contains = graph.links("contains").select(F.col("sourceId").alias("owner"), F.col("targetId").alias("member"))
    named = contains.join(graph.nodes("name").select(F.col("id").alias("member"), "name"), "member")
    extends = graph.links("extends").select(F.col("sourceId").alias("owner"), F.col("targetId").alias("conformer_id"))
    conformers = find_conformers(graph).select("protocol_id", "conformer_id")
    needed = conformers.join(named.select(F.col("owner").alias("protocol_id"), F.col("member").alias("requirement_id"), F.col("name").alias("requirement_name")), "protocol_id")
    has = named.select(F.col("owner").alias("conformer_id"), "name").unionByName(named.join(extends, "owner").select("conformer_id", "name")).distinct()
    met = has.select("conformer_id", F.col("name").alias("requirement_name"), F.lit(True).alias("met"))
    return needed.join(met, ["conformer_id", "requirement_name"], "left").select("protocol_id", "conformer_id", "requirement_id", "requirement_name", F.coalesce("met", F.lit(False)).alias("satisfied"))


def dependencies(graph: Graph) -> DataFrame:
    """(symbol_id, direction, edge_kind, other_id, other_name): all edges of each symbol, both ways."""
    links = graph.links().select("sourceId", "targetId", "kind")
    both = links.select(F.explode(F.array(
        F.struct(F.col("sourceId").alias("symbol_id"), F.lit("outgoing").alias("direction"), F.col("kind").alias("edge_kind"), F.col("targetId").alias("other_id")),
        F.struct(F.col("targetId").alias("symbol_id"), F.lit("incoming").alias("direction"), F.col("kind").alias("edge_kind"), F.col("sourceId").alias("other_id")),
    )).alias("x")).select("x.*")
    return both.join(_as(graph.nodes("name"), "other", "name"), "other_id").select("symbol_id", "direction", "edge_kind", "other_id", "other_name")


def find_usages(graph: Graph, references: DataFrame | None = None) -> DataFrame:
    """(symbol_id, file_path, line, used_by, used_by_kind, context): places that use each symbol.

    Type references have the line they stand on, if ``references`` (sourceId, targetId, filePath, line; see
    ``resolve.reference_sites``) are given; other edges, and without it all, that of the using symbol.
    Containment and extension are no use. Of several uses at one place a type reference comes
    first, then the least edge kind, user and id. Users without a file share the place ``""``, 0.
    A member's type is used where its members are: ``parent_types`` names it.
    """
    links = graph.links().where(~F.col("kind").isin("contains", "extends"))
    users = _as(graph.nodes("name", "kind", "filePath", "line"), "user", "name", "kind", "filePath", "line")
    context = F.when(F.col("kind") == "references", "type reference").otherwise(F.col("kind"))
    if references is not None:
        links = links.where("kind <> 'references'")
    sites = links.select(F.col("targetId").alias("symbol_id"), F.col("sourceId").alias("user_id"), (F.col("kind") != "references").alias("late"), context.alias("context")).join(users, "user_id")
    if references is not None:
        exact = references.select(F.col("targetId").alias("symbol_id"), F.col("sourceId").alias("user_id"), F.lit(False).alias("late"), F.lit("type reference").alias("context"), F.col("filePath").alias("user_file_path"), F.col("line").alias("user_line"))
        sites = sites.unionByName(exact.join(users.select("user_id", "user_name", "user_kind"), "user_id"))
    first = sites.groupBy("symbol_id", F.coalesce("user_file_path", F.lit("")).alias("file_path"), F.coalesce("user_line", F.lit(0)).alias("line")).agg(
        F.min(F.struct("late", "context", "user_name", "user_id", "user_kind")).alias("site")
    )
    return first.select("symbol_id", "file_path", "line", F.col("site.user_name").alias("used_by"), F.col("site.user_kind").alias("used_by_kind"), F.col("site.context").alias("context"))


def parent_types(graph: Graph) -> DataFrame:
    """(symbol_id, parent_id, parent_name): the type that contains each symbol; of several the least name and id."""
    types = graph.nodes("name", "kind").where(F.col("kind").isin(*TYPE_KINDS)).select(F.col("id").alias("sourceId"), "name")
    best = graph.links("contains").join(types, "sourceId").groupBy(F.col("targetId").alias("symbol_id")).agg(F.min(F.struct("name", F.col("sourceId").alias("id"))).alias("p"))
    return best.select("symbol_id", F.col("p.id").alias("parent_id"), F.col("p.name").alias("parent_name"))


def lookup_functions(graph: Graph, names: DataFrame) -> DataFrame:
    """(project_id, query, symbol_id, how): what a name means as something to call: a function of that name, an
    initializer that begins with it (for names in init...), a qualified name of a function, or a
    callable at the end of a qualified name after a dot; of several the least qualified name and id."""
    nodes = graph.nodes("projectId", "name", "qualifiedName", "kind").where("kind IN ('function', 'initializer')")
    ways = lambda rows, query, rank: rows.select("projectId", query.alias("query"), F.lit(rank).alias("rank"), "qualifiedName", "id")
    function = nodes.where("kind = 'function'")
    initializer = nodes.where("kind = 'initializer'")
    means = ways(function, F.col("name"), 1).unionByName(ways(initializer, F.col("name"), 2)).unionByName(ways(initializer, F.regexp_extract("name", "^init", 0), 2))
    means = means.unionByName(ways(function, F.col("qualifiedName"), 3)).unionByName(ways(nodes, F.substring_index("qualifiedName", ".", -1), 4))
    best = names.select("projectId", "query").distinct().join(means, ["projectId", "query"]).groupBy("projectId", "query").agg(F.min(F.struct("rank", "qualifiedName", "id")).alias("best"))
    how = F.when(F.col("best.rank") == 1, "function").when(F.col("best.rank") == 2, "initializer").when(F.col("best.rank") == 3, "qualified").otherwise("member")
    return best.select(F.col("projectId").alias("project_id"), "query", F.col("best.id").alias("symbol_id"), how.alias("how"))


def diff_symbols(before: DataFrame, after: DataFrame, top: int | None = 100) -> DataFrame:
    """(projectId, section, place, name, kind, parent): symbols added, removed and modified between two states of
    the declarations, by name, kind and parent; modified ones differ in signature. ``top`` is the
    length of each section of a project, in order of name, kind and parent (none: all of it).

    Both inputs have projectId, name, kind, parent and signature. Of rows alike in the key the
    greatest signature counts; null and blank parents are alike.
    """
    key = ["projectId", "name", "kind", "parent"]
    one = lambda rows, as_: rows.withColumn("parent", F.coalesce("parent", F.lit(""))).groupBy(*key).agg(F.max(F.coalesce("signature", F.lit(""))).alias(as_))
    both = one(before, "old").join(one(after, "new"), key, "full_outer")
    section = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    changed = both.withColumn("section", section).where("section IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("projectId", "section").orderBy("name", "kind", "parent"))
    placed = changed.withColumn("place", place)
    return (placed.where(F.col("place") <= top) if top else placed).select("projectId", "section", "place", "name", "kind", "parent")


def usage_context(usages: DataFrame, sources: DataFrame, context: int = 1) -> DataFrame:
    """The usages that have a line, with the numbered lines around it, the line itself marked; each place is
    cut out once, however many symbols are used there."""
    line = F.col("line")
    placed = usages.where(line > 0).select("symbol_id", F.col("file_path").alias("filePath"), (line - context).alias("first"), (line + context).alias("last"), line.alias("mark"))
    found = placed.join(slices(placed, sources, ["filePath"], marked=True), ["filePath", "first", "last", "mark"])
    return found.select("symbol_id", F.col("filePath").alias("file_path"), F.col("mark").alias("line"), "source")


def impact(graph: Graph, seeds: DataFrame, incoming: bool = True, max_depth: int = 5) -> DataFrame:
    """(seed, node, depth, parent): what a change of each seed may reach, or what it rests on.

    Containment, imports and dependencies of modules don't carry changes; files and modules aren't entered.
    """
    links = graph.links().where(~F.col("kind").isin("contains", "imports", "dependsOn"))
    inner = graph.nodes("kind").where("kind NOT IN ('file', 'module')").select("id")
    a, b = ("targetId", "sourceId") if incoming else ("sourceId", "targetId")
    steps = links.select(F.col(a).alias("from_id"), F.col(b).alias("to_id")).join(inner.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return walk(steps, seeds.join(inner.withColumnRenamed("id", "seed"), "seed", "left_semi"), max_depth)


def call_graph(graph: Graph, seeds: DataFrame, callers: bool = True, max_depth: int = 5) -> DataFrame:
    """(seed, node, depth, parent) along calls; a seed that calls itself through others returns."""
    a, b = ("targetId", "sourceId") if callers else ("sourceId", "targetId")
    return walk(graph.links("calls").select(F.col(a).alias("from_id"), F.col(b).alias("to_id")), seeds, max_depth, root_may_return=True)


def view_trees(graph: Graph, max_depth: int = 10) -> DataFrame:
    """(root, node, depth, parent) of the views composed below each view that no other one composes."""
    links = graph.links("composesView").select(F.col("sourceId").alias("from_id"), F.col("targetId").alias("to_id"))
    roots = links.select(F.col("from_id").alias("seed")).distinct().join(links.select(F.col("to_id").alias("seed")), "seed", "left_anti")
    return walk(links, roots, max_depth).withColumnRenamed("seed", "root")


def dead_code(graph: Graph, max_references: int = 0) -> DataFrame:
    """(symbol_id, name, kind, n_references) of top-level declarations that hardly anything refers to.

    Members, entry points, tests and conforming types aren't asked; ``@main`` is looked for letter
    case aside, so that ``@MainActor`` counts too.
    """
    nodes = graph.nodes("moduleId", "filePath", "qualifiedName", "name", "kind", "attributes")
    tests = graph.modules.where("kind = 'test'").select(F.col("id").alias("moduleId")).distinct()
    asked = (
        nodes.where(F.col("kind").isin(*DECLARED) & ~is_named("qualifiedName", PLACEHOLDER, FILE, MODULE))
        .where(~F.coalesce(F.contains(F.lower("attributes"), F.lit("@main")), F.lit(False)) & ~in_tests("filePath"))
        .join(tests, "moduleId", "left_anti")
        .select("id", "name", "kind")
    )
    links = graph.links().select("sourceId", "targetId", "kind")
    into = links.groupBy(F.col("targetId").alias("id")).agg(
        F.count(F.when(~F.col("kind").isin("extends", "contains"), 1)).alias("n_references"), F.count(F.when(F.col("kind") == "contains", 1)).alias("n_parents")
    )
    conforming = links.where("kind = 'conformsTo'").select(F.col("sourceId").alias("id"))
    counted = asked.join(conforming, "id", "left_anti").join(into, "id", "left").fillna(0, ["n_references", "n_parents"])
    return counted.where((F.col("n_parents") == 0) & (F.col("n_references") <= max_references)).select(F.col("id").alias("symbol_id"), "name", "kind", "n_references")


def access_audit(graph: Graph) -> DataFrame:
    """(symbol_id, access, suggested, reason): declarations more visible than their use needs.

    Only explicit open, public and internal ones of files outside tests that implement no
    requirement are asked. Which files refer to a symbol is counted without collecting them.
    """
    nodes = graph.nodes("filePath", "qualifiedName", "kind", "accessLevel")
    asked = nodes.where(F.col("accessLevel").isin("public", "open", "internal") & F.col("kind").isin(*AUDITED) & F.col("filePath").isNotNull()).where(
        ~is_named("qualifiedName", PLACEHOLDER, FILE, MODULE) & ~in_tests("filePath")
    )
    links = graph.links().select("sourceId", "targetId", "kind")
    files = nodes.where("filePath IS NOT NULL").select(F.col("id").alias("sourceId"), F.col("filePath").alias("from_file"))
    used = links.where(~F.col("kind").isin("contains", "extends")).join(files, "sourceId").groupBy(F.col("targetId").alias("id")).agg(F.min("from_file").alias("low"), F.max("from_file").alias("high"))
    implementing = links.where("kind = 'implementsRequirement'").select(F.col("sourceId").alias("id"))
    seen = asked.join(implementing, "id", "left_anti").join(used, "id", "left")
    unused, own = F.col("low").isNull(), (F.col("low") == F.col("filePath")) & (F.col("high") == F.col("filePath"))
    wide = F.col("accessLevel").isin("public", "open")
    suggested = F.when(wide & unused, "internal").when(wide & own, "fileprivate").when(unused | own, "private")
    reason = F.when(unused, "unused").otherwise("one_file")
    return seen.where(suggested.isNotNull()).select(F.col("id").alias("symbol_id"), F.col("accessLevel").alias("access"), suggested.alias("suggested"), reason.alias("reason"))


def test_coverage(graph: Graph) -> DataFrame:
    """(symbol_id, project_id, name, is_view, tested_by): production types and the test class named
    after them (suffix Tests before Test before Spec, then the greatest name), or ``(referenced)``."""
    tests = graph.modules.where("kind = 'test'").select(F.col("id").alias("moduleId")).distinct().withColumn("in_test", F.lit(True))
    nodes = graph.nodes("projectId", "moduleId", "filePath", "qualifiedName", "name", "kind", "inheritedTypes").join(tests, "moduleId", "left")
    by_path = F.coalesce(F.contains(F.lower("filePath"), F.lit("/tests/")), F.lit(False))
    nodes = nodes.withColumn("in_test", F.coalesce("in_test", F.lit(False)) | by_path).where(~is_named("qualifiedName", PLACEHOLDER))
    suffix = F.when(F.endswith("name", F.lit("Tests")), 5).when(F.endswith("name", F.lit("Test")) | F.endswith("name", F.lit("Spec")), 4)
    rank = F.when(F.endswith("name", F.lit("Tests")), 3).when(F.endswith("name", F.lit("Test")), 2).otherwise(1)
    named = (
        nodes.where("in_test AND kind IN ('struct', 'class')").where(suffix.isNotNull() & (F.length("name") > suffix))
        .groupBy("projectId", F.substr("name", F.lit(1), (F.length("name") - suffix).cast("int")).alias("name")).agg(F.max(F.struct(rank.alias("rank"), F.col("name").alias("test"))).alias("by"))
    )
    referenced = (
        graph.links("references").select("sourceId", "targetId")
        .join(nodes.where("in_test").select(F.col("id").alias("sourceId")), "sourceId", "left_semi")
        .join(nodes.select(F.col("id").alias("targetId"), "projectId", "name"), "targetId")
        .select("projectId", "name", F.lit(True).alias("referenced")).distinct()
    )
    asked = nodes.where(~F.col("in_test") & F.col("kind").isin(*TYPE_KINDS) & (F.col("name") != "CodingKeys"))
    is_view = F.coalesce(F.array_contains(string_list("inheritedTypes"), "View"), F.lit(False))
    return asked.join(named, ["projectId", "name"], "left").join(referenced, ["projectId", "name"], "left").select(
        F.col("id").alias("symbol_id"), F.col("projectId").alias("project_id"), "name", is_view.alias("is_view"), F.coalesce("by.test", F.when(F.col("referenced"), "(referenced)")).alias("tested_by")
    )


def test_coverage_summary(coverage: DataFrame) -> DataFrame:
    """Per project the share of production types with a test, over all and over those that are no views."""
    tested, logic = F.col("tested_by").isNotNull(), ~F.col("is_view")
    part = lambda a, b: F.round(F.when(b > 0, 100.0 * a / b).otherwise(0.0), 6)
    counts = coverage.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("n_types"), F.count(F.when(tested, 1)).alias("n_tested"), F.count(F.when(logic, 1)).alias("n_logic"), F.count(F.when(logic & tested, 1)).alias("n_logic_tested")
    )
    return counts.select("*", part(F.col("n_tested"), F.col("n_types")).alias("percent"), part(F.col("n_logic_tested"), F.col("n_logic")).alias("logic_percent"))


def cross_module_usage(graph: Graph) -> DataFrame:
    """(module_id, target_module_id, target_id, n_uses): types that a module refers to in other modules."""
    placed = graph.module_of(graph.nodes("projectId", "moduleId", "filePath", "kind")).select("id", "kind", "module_id").where("module_id IS NOT NULL")
    targets = placed.where(F.col("kind").isin(*TYPE_KINDS, "typeAlias")).select(F.col("id").alias("targetId"), F.col("module_id").alias("target_module_id"))
    uses = graph.links("references").select("sourceId", "targetId").join(placed.select(F.col("id").alias("sourceId"), "module_id"), "sourceId").groupBy("module_id", "targetId").agg(F.count(F.lit(1)).alias("n_uses"))
    return uses.join(targets, "targetId").where("module_id <> target_module_id").select("module_id", "target_module_id", F.col("targetId").alias("target_id"), "n_uses")


def module_graph(graph: Graph) -> DataFrame:
    """(module_id, dependency_id, n_imports): modules by what their files import."""
    home = graph.nodes("moduleId").where("moduleId IS NOT NULL")
    imports = graph.links("imports").select("sourceId", "targetId").join(home.select(F.col("id").alias("sourceId"), F.col("moduleId").alias("module_id")), "sourceId").groupBy("module_id", "targetId").agg(F.count(F.lit(1)).alias("n"))
    into = imports.join(home.select(F.col("id").alias("targetId"), F.col("moduleId").alias("dependency_id")), "targetId")
    return into.where("module_id <> dependency_id").groupBy("module_id", "dependency_id").agg(F.sum("n").alias("n_imports"))


def module_api(graph: Graph, level: str = "public") -> DataFrame:
    """(module_id, symbol_id, section, owner_id): the declarations of a level in each module, by types,
    functions and variables, and the members of those types, whose level may be implicit."""
    levels = API_LEVELS.get(level, API_LEVELS["public"])
    nodes = graph.nodes("projectId", "moduleId", "filePath", "qualifiedName", "kind", "accessLevel")
    top = graph.module_of(nodes.where(F.col("accessLevel").isin(*levels) & F.col("kind").isin(*AUDITED) & ~is_named("qualifiedName", PLACEHOLDER, FILE))).where("module_id IS NOT NULL")
    section = F.when(F.col("kind") == "function", "function").when(F.col("kind") == "variable", "variable").otherwise("type")
    none = F.lit(None).cast("long").alias("owner_id")
    owners = top.where(F.col("kind").isin(*TYPE_KINDS)).select("module_id", F.col("id").alias("owner_id"))
    members = nodes.where(F.col("kind").isin(*API_MEMBERS) & (F.col("accessLevel").isNull() | F.col("accessLevel").isin(*levels))).select(F.col("id").alias("symbol_id"))
    inside = graph.links("contains").select(F.col("sourceId").alias("owner_id"), F.col("targetId").alias("symbol_id")).distinct().join(owners, "owner_id").join(members, "symbol_id", "left_semi")
    return top.select("module_id", F.col("id").alias("symbol_id"), section.alias("section"), none).unionByName(inside.select("module_id", "symbol_id", F.lit("member").alias("section"), "owner_id"))


def architecture(graph: Graph) -> DataFrame:
    """Per project: modules, protocols, view models, files and symbols, placeholders and all."""
    view_model = F.col("kind").isin("class", "struct") & (F.endswith(F.lower("name"), F.lit("viewmodel")) | F.coalesce(F.contains(F.lower("attributes"), F.lit("@observable")), F.lit(False)))
    symbols = graph.nodes("projectId", "kind", "name", "attributes").groupBy("projectId").agg(
        F.count(F.lit(1)).alias("n_symbols"), F.count(F.when(F.col("kind") == "protocol", 1)).alias("n_protocols"), F.count(F.when(view_model, 1)).alias("n_view_models"), F.count(F.when(F.col("kind") == "file", 1)).alias("n_files")
    )
    modules = graph.modules.select("projectId", "id").distinct().groupBy("projectId").agg(F.count(F.lit(1)).alias("n_modules"))
    projects = graph.projects.select(F.col("id").alias("projectId")).distinct()
    counts = ["n_modules", "n_protocols", "n_view_models", "n_files", "n_symbols"]
    return projects.join(symbols, "projectId", "left").join(modules, "projectId", "left").fillna(0, counts).select(F.col("projectId").alias("project_id"), *counts)


def top_protocols(graph: Graph, top: int = 20) -> DataFrame:
    """(project_id, place, protocol, n_conformers): the report of each project's ``top`` protocols."""
    protocols = graph.nodes("projectId", "name", "kind").where("kind = 'protocol'").select(F.col("id").alias("targetId"), F.col("projectId").alias("project_id"), F.col("name").alias("protocol"))
    counts = graph.links("conformsTo").groupBy("targetId").agg(F.count(F.lit(1)).alias("n")).join(protocols, "targetId").groupBy("project_id", "protocol").agg(F.sum("n").alias("n_conformers"))
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("n_conformers"), "protocol"))
    return counts.withColumn("place", place).where(F.col("place") <= top).select("project_id", "place", "protocol", "n_conformers")


def list_extensions(graph: Graph) -> DataFrame:
    """(type_id, extension_id, conformance, n_members): extensions of each type, a row per conformance they
    add (null if none)."""
    contains = graph.links("contains").groupBy(F.col("sourceId").alias("extension_id")).agg(F.count(F.lit(1)).alias("n_members"))
    extensions = graph.nodes("inheritedTypes").select(F.col("id").alias("extension_id"), F.explode_outer(F.array_distinct(string_list("inheritedTypes"))).alias("conformance"))
    pairs = graph.links("extends").select(F.col("targetId").alias("type_id"), F.col("sourceId").alias("extension_id")).distinct()
    return pairs.join(extensions, "extension_id").join(contains, "extension_id", "left").fillna(0, ["n_members"]).select("type_id", "extension_id", "conformance", "n_members")


def rename_sites(graph: Graph, references: DataFrame | None = None, calls: DataFrame | None = None, siblings: bool = True) -> DataFrame:
    """(symbol_id, file_path, line, category): the places a rename of each symbol touches.

    Of several categories at one place the first counts: declaration, type reference, inheritance,
    extension, function call, protocol implementation, override, overridden base. Inheritance matches
    whole names. A site without a file or a line is none. References and calls have their own lines
    if ``references`` and ``calls`` (sourceId, targetId, filePath, line) are given, else those of the
    using symbol. The overrides of a base are sites of each other, which is for a few symbols; over a
    whole graph leave ``siblings`` out and take ``override_classes``, which has them once each.
    """
    nodes = graph.nodes("projectId", "name", "qualifiedName", "kind", "filePath", "line", "inheritedTypes")
    real = nodes.where(~F.col("kind").isin("file", "module") & ~is_named("qualifiedName", PLACEHOLDER))
    links = graph.links("references", "calls", "implementsRequirement", "overrides").select("sourceId", "targetId", "kind")
    types = real.where(F.col("kind").isin(*TYPE_KINDS, "typeAlias")).select(F.col("id").alias("symbol_id"), "projectId", "name")
    rank = lambda i, c: (F.lit(i).alias("rank"), F.lit(c).alias("category"))
    inherited = real.select("projectId", F.explode(F.array_distinct(string_list("inheritedTypes"))).alias("name"), F.col("id").alias("at"))
    extensions = real.where("kind = 'extension'").select("projectId", "name", F.col("id").alias("at"))
    protocols = nodes.where("kind = 'protocol'").select(F.col("id").alias("owner"))
    requirements = graph.links("contains").select(F.col("sourceId").alias("owner"), F.col("targetId").alias("symbol_id")).join(protocols, "owner", "left_semi").select("symbol_id").distinct()
    overrides = links.where("kind = 'overrides'")
    def uses(kind: str, place: int, category: str) -> DataFrame:
        return links.where(F.col("kind") == kind).select(F.col("targetId").alias("symbol_id"), F.col("sourceId").alias("at"), *rank(place, category))

    sites = [
        real.select(F.col("id").alias("symbol_id"), F.col("id").alias("at"), *rank(1, "declaration")),
        *([uses("references", 2, "type reference")] if references is None else []),
        types.join(inherited, ["projectId", "name"]).select("symbol_id", "at", *rank(3, "inheritance")),
        types.join(extensions, ["projectId", "name"]).select("symbol_id", "at", *rank(4, "extension")),
        *([uses("calls", 5, "function call")] if calls is None else []),
        uses("implementsRequirement", 6, "protocol implementation").join(requirements, "symbol_id", "left_semi"),
        overrides.select(F.col("sourceId").alias("symbol_id"), F.col("targetId").alias("at"), *rank(8, "overridden base")),
    ]
    if siblings:  # the overriders of a base with very many are spread over as many keys as they need
        slots = F.ceil(F.col("n_overriders") / 1000).cast("int")
        classes = override_classes(graph)
        here = classes.select("base_id", "symbol_id", F.explode(F.sequence(F.lit(0), slots - 1)).alias("slot"))
        there = classes.select("base_id", F.col("symbol_id").alias("at"), F.pmod(F.xxhash64("symbol_id"), slots).cast("int").alias("slot"))
        sites.append(here.join(there, ["base_id", "slot"]).where("symbol_id <> at").select("symbol_id", "at", *rank(7, "override")))
    every = sites[0]
    for more in sites[1:]:
        every = every.unionByName(more)
    placed = every.join(nodes.where("filePath IS NOT NULL AND line IS NOT NULL").select(F.col("id").alias("at"), "filePath", "line"), "at")
    for exact, place, category in ((references, 2, "type reference"), (calls, 5, "function call")):
        if exact is not None:
            placed = placed.unionByName(exact.select(F.col("sourceId").alias("at"), F.col("targetId").alias("symbol_id"), *rank(place, category), "filePath", "line").where("filePath IS NOT NULL AND line IS NOT NULL"))
    best = placed.groupBy("symbol_id", "filePath", "line").agg(F.min(F.struct("rank", "category")).alias("best"))
    return best.select("symbol_id", F.col("filePath").alias("file_path"), "line", F.col("best.category").alias("category"))


def override_classes(graph: Graph) -> DataFrame:
    """(base_id, symbol_id, n_overriders): the overriders of each base, which a rename of one renames all."""
    overrides = graph.links("overrides").select(F.col("targetId").alias("base_id"), F.col("sourceId").alias("symbol_id")).distinct()
    counts = overrides.groupBy("base_id").agg(F.count(F.lit(1)).alias("n_overriders"))
    return overrides.join(counts, "base_id").select("base_id", "symbol_id", "n_overriders")


def protocol_impact(graph: Graph) -> DataFrame:
    """(protocol_id, n_conformers, n_requirements, n_satisfied): what a change of each protocol's
    requirements would touch."""
    coverage = protocol_coverage(graph).groupBy("protocol_id").agg(F.count_distinct("requirement_id").alias("n_requirements"), F.count(F.when(F.col("satisfied"), 1)).alias("n_satisfied"))
    conformers = find_conformers(graph).groupBy("protocol_id").agg(F.count(F.lit(1)).alias("n_conformers"))
    return conformers.join(coverage, "protocol_id", "left").fillna(0, ["n_requirements", "n_satisfied"]).select("protocol_id", "n_conformers", "n_requirements", "n_satisfied")
