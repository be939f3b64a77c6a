"""Resolving stubs: modules and classes by name, calls by class, module and import, names across repositories by suffix. All lookups
are equi-joins on computed keys; names that many nodes share are counted, never paired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.durable import Workspace

STUB = "__call__"
#: The order in which definitions count as first or last.
_PLACE = "struct(coalesce(file_path, ''), coalesce(line_start, 0), id)"


def local_id(node_id: Column) -> Column:
    """An id without its repository."""
    return F.regexp_replace(node_id, r"^[^:]*::", "")


def repository_of(node_id: Column) -> Column:
    return F.when(node_id.contains("::"), F.substring_index(node_id, "::", 1))


def prefixes(ids: DataFrame, column: str = "id") -> DataFrame:
    """(id, prefix) for every dotted prefix of an id, the id aside. Turns a prefix join into an equi-join."""
    whole = ids.select(F.col(column).alias("_whole")).where(F.col("_whole").contains("."))
    parts = F.split("_whole", r"\.")
    cut = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    return whole.select("_whole", F.explode(cut).alias("prefix")).withColumnRenamed("_whole", "id")


def owning_modules(nodes: DataFrame) -> DataFrame:
    """(id, module_id): the longest module id that is a dotted prefix of the id."""
    modules = nodes.where("label = 'Module'").select(F.col("id").alias("module_id"))
    found = prefixes(nodes.where("label IN ('Function', 'Class')").select("id")).join(modules, F.col("prefix") == F.col("module_id"))
    return found.groupBy("id").agg(F.max_by("module_id", F.length("module_id")).alias("module_id"))


def _real(nodes: DataFrame, label: str) -> DataFrame:
    """Nodes of ``label`` that are no placeholders, with their repository, which their id tells where the column does not."""
    kept = nodes.where((F.col("label") == label) & (F.coalesce("type", F.lit("")) != "external"))
    return kept.withColumn("repository", F.coalesce("repository", repository_of(F.col("id")))).where(F.col("repository").isNotNull())


def resolve_stubs(stubs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Modules and classes that a repository itself has for its imported modules and bases: repository, stub, resolved_id.

    A stub is looked up by its last part and whole, in this order: modules by last part, modules by the whole stub, classes by
    the whole stub, classes by last part. A module goes by the stem of its file (of several the last path counts), else by its
    name (the first path); a class by its name (the first path and line).
    """
    m = _real(nodes, "Module").select("repository", "id", "name", "file_path", "line_start", F.regexp_extract("file_path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("stem"))
    by_stem = m.where("stem <> ''").groupBy("repository", F.col("stem").alias("key")).agg(F.max_by("id", F.expr(_PLACE)).alias("id"))
    by_name = m.where("name <> ''").groupBy("repository", F.col("name").alias("key")).agg(F.min_by("id", F.expr(_PLACE)).alias("id"))
    classes = _real(nodes, "Class").where("name <> ''").groupBy("repository", F.col("name").alias("key")).agg(
        F.min_by("id", F.expr(_PLACE)).alias("id")
    )
    tagged = [by_stem.withColumn("how", F.lit("stem")), by_name.withColumn("how", F.lit("name")), classes.withColumn("how", F.lit("class"))]
    known = tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).select(F.col("repository").alias("k_repository"), "key", "how", "id")
    last = F.substring_index("stub", ".", -1)
    ways = [(last, "stem"), (last, "name"), (F.col("stub"), "stem"), (F.col("stub"), "name"), (F.col("stub"), "class"), (last, "class")]
    tries = F.array(*(F.struct(F.lit(i).alias("order"), key.alias("try"), F.lit(how).alias("by")) for i, (key, how) in enumerate(ways)))
    asked = stubs.select("repository", "stub").where(F.col("stub") != "").distinct().select("repository", "stub", F.inline(tries))
    on = (F.col("repository") == F.col("k_repository")) & (F.col("try") == F.col("key")) & (F.col("by") == F.col("how"))
    return asked.join(known, on).groupBy("repository", "stub").agg(F.min_by("id", "order").alias("resolved_id"))


def resolve_calls(calls: DataFrame, nodes: DataFrame, imports: DataFrame) -> DataFrame:
    """Calls of stubs that the graph itself can resolve: src_id, stub, expr, resolved_id, tier.

    ``calls`` has src_id, dst_id and callee_expr, ``imports`` src_id (a module) and dst_id. Tier A: a method of the caller's
    class, called bare or on self or cls. Tier B: a function of the caller's module, called bare. Tier C: a function that the
    module imports by name, if its repository has one of that name, or one under an imported module; or one called by the name
    of an imported module (the first path and line). The tiers are tried in this order.
    """
    functions = _real(nodes, "Function").select("id", "repository", "name", "file_path", "line_start")
    stubs = (
        calls.where(F.col("dst_id").startswith(STUB))
        .select("src_id", F.col("dst_id").alias("stub"), F.coalesce("callee_expr", F.lit("")).alias("expr"))
        .distinct()
        .withColumn("callee", F.substring("stub", len(STUB) + 1, 1 << 20))
        .withColumn("bare", (F.col("expr") == "") | (F.col("expr") == F.col("callee")))
        .withColumn("own", F.col("bare") | (F.col("expr") == F.concat(F.lit("self."), "callee")) | (F.col("expr") == F.concat(F.lit("cls."), "callee")))
    )
    owner = F.regexp_extract("src_id", r"^(.*)\.[^.]*$", 1)
    in_class = F.when(F.col("own") & (F.size(F.split(local_id(F.col("src_id")), r"\.")) >= 3), F.concat(owner, F.lit("."), "callee"))
    modules = owning_modules(nodes).withColumnRenamed("id", "m_src")
    space = Workspace(nodes.sparkSession, "calls")  # three steps read each of these
    placed = space.cut(stubs.join(modules, F.col("src_id") == F.col("m_src"), "left").drop("m_src"), "placed")
    in_module = F.when(F.col("bare"), F.concat("module_id", F.lit("."), "callee"))
    way = lambda tier, key: F.struct(F.lit(tier).alias("tier"), key.alias("key"))
    keyed = placed.select("src_id", "stub", "expr", F.inline(F.array(way("A", in_class), way("B", in_module)))).where(F.col("key").isNotNull())
    direct = keyed.join(functions.select(F.col("id").alias("f_id")), F.col("key") == F.col("f_id")).select("src_id", "stub", "expr", "tier", F.col("f_id").alias("id"))

    named = space.cut(functions.where("name <> ''"), "functions")
    by_name = named.groupBy(F.col("repository").alias("f_repository"), F.col("name").alias("f_name")).agg(F.count("*").alias("n"), F.min("id").alias("only"))
    parts = named.select("repository", "name", "id", F.explode(F.array_distinct(F.split(local_id(F.col("id")), r"\."))).alias("part"))
    by_part = parts.groupBy(F.col("repository").alias("p_repository"), F.col("name").alias("p_name"), "part").agg(F.count("*").alias("p_n"), F.min("id").alias("p_id"))
    two = F.regexp_extract(local_id(F.col("id")), r"([^.]+\.[^.]+)$", 1)
    by_two = named.groupBy(F.col("repository").alias("t_repository"), two.alias("two")).agg(F.min_by("id", F.expr(_PLACE)).alias("t_id"))

    segments = space.cut(imports.select(F.col("src_id").alias("i_module"), F.substring_index("dst_id", ".", -1).alias("segment")).distinct(), "imports")
    outside = placed.where("module_id IS NOT NULL").withColumn("repository", repository_of(F.col("src_id")))
    by_import = outside.join(segments, (F.col("module_id") == F.col("i_module")) & (F.col("callee") == F.col("segment")), "left_semi")
    counted = by_import.join(by_name, (F.col("repository") == F.col("f_repository")) & (F.col("callee") == F.col("f_name")))
    unique = counted.where("n = 1").select("src_id", "stub", "expr", F.lit("C").alias("tier"), F.col("only").alias("id"))
    shared = counted.where("n > 1").select("src_id", "stub", "expr", "callee", "module_id", "repository").join(segments, F.col("module_id") == F.col("i_module"))
    within = (F.col("repository") == F.col("p_repository")) & (F.col("callee") == F.col("p_name")) & (F.col("segment") == F.col("part"))
    under = shared.join(by_part, within).groupBy("src_id", "stub", "expr").agg(F.max("p_n").alias("most"), F.min("p_id").alias("id"), F.max("p_id").alias("last"))
    under = under.where("most = 1 AND id = last").select("src_id", "stub", "expr", F.lit("C").alias("tier"), "id")
    prefix = F.when(F.col("expr").contains("."), F.substring_index("expr", ".", 1))
    others = outside.join(segments, (F.col("module_id") == F.col("i_module")) & (F.col("callee") == F.col("segment")), "left_anti").withColumn("prefix", prefix)
    others = others.join(segments, (F.col("module_id") == F.col("i_module")) & (F.col("prefix") == F.col("segment")), "left_semi")
    on = (F.col("repository") == F.col("t_repository")) & (F.concat("prefix", F.lit("."), "callee") == F.col("two"))
    by_prefix = others.join(by_two, on).select("src_id", "stub", "expr", F.lit("C").alias("tier"), F.col("t_id").alias("id"))

    found = direct.unionByName(unique).unionByName(under).unionByName(by_prefix)
    return found.groupBy("src_id", "stub", "expr").agg(F.min_by("id", "tier").alias("resolved_id"), F.min("tier").alias("tier"))


def resolve_names(stubs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stubs (a column ``stub``) that mean exactly one real node, by id, by name or by dotted suffix of the id: stub, id.

    The disjunction is a union of equi-joins: each node is keyed by its id, its name and every dotted suffix of its id. Keys
    that several nodes have are counted before the join.
    """
    real = nodes.where("coalesce(type, '') <> 'external'").select("id", "name")
    parts = F.split("id", r"\.")
    suffixes = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda n: F.array_join(F.slice(parts, n, 1 << 20), "."))
    keys = real.select("id", F.explode(F.array_distinct(F.concat(F.array("id", "name"), suffixes))).alias("key")).where(F.col("key") != "")
    one = keys.groupBy("key").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).where("n = 1")
    return stubs.select("stub").distinct().join(one, F.col("stub") == F.col("key")).select("stub", "id")


def redirect(links: DataFrame, calls: DataFrame | None = None, stubs: DataFrame | None = None) -> DataFrame:
    """Links (src_id, rel, dst_id, expr, repository) with the ends of resolved calls and stubs put in: src_id, rel, dst_id, once
    each. A call is redirected by its caller and how it is written, other stubs in their whole repository."""
    out = links
    if calls is not None:
        to = calls.select(F.col("src_id").alias("r_src"), F.col("stub").alias("r_stub"), F.col("expr").alias("r_expr"), F.col("resolved_id").alias("r_id"))
        on = (F.col("src_id") == F.col("r_src")) & (F.col("dst_id") == F.col("r_stub")) & (F.coalesce("expr", F.lit("")) == F.col("r_expr"))
        out = out.join(to, on & (F.col("rel") == "CALLS"), "left").withColumn("dst_id", F.coalesce("r_id", "dst_id")).drop(*to.columns)
    if stubs is not None:
        to = stubs.select(F.col("repository").alias("s_repository"), F.col("stub").alias("s_stub"), F.col("resolved_id").alias("s_id"))
        on = (F.col("repository") == F.col("s_repository")) & (F.col("dst_id") == F.col("s_stub"))
        out = out.join(to, on, "left").withColumn("dst_id", F.coalesce("s_id", "dst_id")).drop(*to.columns)
    return out.select("src_id", "rel", "dst_id").distinct()


def without_unused_stubs(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` without the placeholders (of type 'external') that no link of ``links`` names any more."""
    ends = links.select(F.col("dst_id").alias("end")).unionByName(links.select(F.col("src_id").alias("end"))).distinct()
    stub = (F.coalesce("type", F.lit("")) == "external") | F.col("id").startswith(STUB)
    return nodes.where(~stub).unionByName(nodes.where(stub).join(ends, F.col("id") == F.col("end"), "left_semi"))


def named_ends(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``links`` with the simple names at their ends (dst_id) put to ids: an id as it is, else a class of that name, else a
    function (of several the least id), else the name itself."""
    simple = nodes.where("label IN ('Class', 'Function') AND name <> ''").groupBy(F.col("name").alias("s_name")).agg(
        F.min_by("id", F.struct("label", "id")).alias("s_id")  # Class comes before Function
    )
    ids = nodes.select(F.col("id").alias("n_id")).distinct()
    out = links.join(ids, F.col("dst_id") == F.col("n_id"), "left").join(simple, F.col("dst_id") == F.col("s_name"), "left")
    return out.withColumn("dst_id", F.coalesce("n_id", "s_id", "dst_id")).drop("n_id", "s_name", "s_id")


def merged(nodes: DataFrame, links: DataFrame, extra: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new nodes, new links): the links of ``extra`` (src_id, rel, dst_id) that are not known, once each, and placeholders
    (id, label, name) for ends that no node has."""
    keys = ["src_id", "rel", "dst_id"]
    new = extra.select(*keys).distinct().join(links.select(*keys), keys, "left_anti")
    ends = new.select(F.explode(F.array("src_id", "dst_id")).alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    call = F.col("id").startswith(STUB)
    return ends.select("id", F.when(call, "Function").otherwise("Module").alias("label"), F.when(call, F.substring("id", len(STUB) + 1, 1 << 20)).otherwise(F.col("id")).alias("name")), new


def namespaced(ids: Column, repository: Column, is_stub: Column) -> Column:
    """Placeholders that stay unresolved get an id of their own repository."""
    return F.when(is_stub & (repository != ""), F.concat(repository, F.lit("::external::"), ids)).otherwise(ids)
