"""Queries over the code graph, with SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions import text as X
from loomgraph.functions.durable import Workspace
from loomgraph.operators import code
from loomgraph.operators import communities as com
from loomgraph.operators import resolution as res
from loomgraph.operators import traversal as tr
from loomgraph.operators import upserts as up
from loomgraph.operators.folders import folder_links
from loomgraph.sources.graph import VIEWS, current_nodes, graph, links
from loomgraph.sources.tables import table

WITH = "WITH " + VIEWS
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(WITH + """SELECT row_number() OVER (ORDER BY CAST(name <> 'cache' AS INT), length(id), id) AS pos, id, name, label
FROM n WHERE contains(name, 'cache') ORDER BY pos LIMIT 20""")
def find_nodes_by_name(spark: SparkSession, folder: str) -> DataFrame:
    return tr.find_nodes(graph(spark, folder)[0], "cache", limit=20)


@query(WITH + """SELECT id, name, label, repository FROM n
WHERE (starts_with(name, 'load_') OR ends_with(name, 'Engine') OR name IN ('open', 'len')) AND NOT contains(coalesce(file_path, ''), 'test_')""")
def node_scan_predicates(spark: SparkSession, folder: str) -> DataFrame:
    n = graph(spark, folder)[0]
    name = F.col("name")
    kept = (name.startswith("load_") | name.endswith("Engine") | name.isin("open", "len")) & ~F.coalesce("file_path", F.lit("")).contains("test_")
    return n.where(kept).select("id", "name", "label", "repository")


@query(WITH + "SELECT e.src_id, e.dst_id, b.name FROM e JOIN n a ON a.id = e.src_id JOIN n b ON b.id = e.dst_id WHERE rel = 'DEFINES' AND a.label = 'Class'")
def hop_defines_out(spark: SparkSession, folder: str) -> DataFrame:
    n, e = graph(spark, folder)
    classes = n.where("label = 'Class'").select("id")
    seen = tr.neighbours(e, "out", "DEFINES").join(classes, "id", "left_semi")
    return seen.join(n.select(F.col("id").alias("other"), "name"), "other").select(F.col("id").alias("src_id"), F.col("other").alias("dst_id"), "name")


@query(WITH + "SELECT e.dst_id AS base_id, count(*) AS n FROM e JOIN n a ON a.id = e.src_id WHERE rel = 'INHERITS' GROUP BY 1")
def hop_inherits_in(spark: SparkSession, folder: str) -> DataFrame:
    n, e = graph(spark, folder)
    seen = tr.neighbours(e, "in", "INHERITS").join(n.select(F.col("id").alias("other")), "other", "left_semi")
    return seen.groupBy(F.col("id").alias("base_id")).agg(F.count("*").alias("n"))


@query(WITH + """, s AS (SELECT src_id AS id, rel, dst_id AS other, 'out' AS direction FROM e UNION ALL SELECT dst_id, rel, src_id, 'in' FROM e)
SELECT * FROM (SELECT id, rel, other, direction, row_number() OVER (PARTITION BY id ORDER BY rel, other, direction) AS pos FROM s) WHERE pos <= 30""")
def first_neighbours_both(spark: SparkSession, folder: str) -> DataFrame:
    return tr.first_neighbours(tr.neighbours(graph(spark, folder)[1], "both"), 30)


@query(WITH + """SELECT a.src_id AS class_id, d.dst_id AS member_id, count(*) AS paths FROM e a JOIN e d ON d.src_id = a.dst_id
WHERE a.rel = 'INHERITS' AND d.rel = 'DEFINES' GROUP BY 1, 2""")
def chain_inherited_members(spark: SparkSession, folder: str) -> DataFrame:
    n, e = graph(spark, folder)
    anchors = e.where("rel = 'INHERITS'").select(F.col("src_id").alias("id")).distinct()
    paths = tr.compose(e, anchors, [("INHERITS", "out"), ("DEFINES", "out")])
    return paths.groupBy(F.col("step_0").alias("class_id"), F.col("step_2").alias("member_id")).agg(F.count("*").alias("paths"))


@query(WITH + """SELECT a.dst_id AS imported, b.dst_id AS reached, count(*) AS paths FROM e a JOIN e b ON b.src_id = a.dst_id
WHERE a.rel = 'IMPORTS' AND b.rel = 'IMPORTS' GROUP BY 1, 2""")
def chain_imports_two_hops(spark: SparkSession, folder: str) -> DataFrame:
    n, e = graph(spark, folder)
    modules = e.where("rel = 'IMPORTS'").select(F.col("src_id").alias("id")).distinct()
    paths = tr.compose(e, modules, [("IMPORTS", "out"), ("IMPORTS", "out")])
    return paths.groupBy(F.col("step_1").alias("imported"), F.col("step_2").alias("reached")).agg(F.count("*").alias("paths"))


@query(WITH + """, m AS (SELECT e.src_id AS owner, f.name AS method FROM e JOIN n f ON f.id = e.dst_id WHERE rel = 'DEFINES' AND f.label = 'Function')
SELECT DISTINCT i.src_id AS class_id, i.dst_id AS base_id, m.method FROM e i JOIN m ON m.owner = i.src_id
WHERE i.rel = 'INHERITS' AND EXISTS (SELECT 1 FROM m b WHERE b.owner = i.dst_id AND b.method = m.method)""")
def overridden_methods(spark: SparkSession, folder: str) -> DataFrame:
    n, e = graph(spark, folder)
    return tr.overrides(e, n)


@query(WITH + "SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE id = e.src_id) OR NOT EXISTS (SELECT 1 FROM n WHERE id = e.dst_id)")
def dangling_links(spark: SparkSession, folder: str) -> DataFrame:
    n, e = graph(spark, folder)
    return tr.dangling(e, n)


@query(WITH + """SELECT e.src_id, coalesce(a.label, CASE rel WHEN 'INHERITS' THEN 'Class' WHEN 'IMPORTS' THEN 'Module' WHEN 'CALLS' THEN 'Function' ELSE 'Module' END) AS src_label,
rel, e.dst_id, coalesce(b.label, CASE rel WHEN 'INHERITS' THEN 'Class' WHEN 'IMPORTS' THEN 'Module' ELSE 'Function' END) AS dst_label
FROM e LEFT JOIN n a ON a.id = e.src_id LEFT JOIN n b ON b.id = e.dst_id""")
def labelled_links(spark: SparkSession, folder: str) -> DataFrame:
    n, e = graph(spark, folder)
    return tr.labelled(e, n)


def _reach(rel: str, hops: int, seeds: str, src: str = "src_id", dst: str = "dst_id") -> str:
    return f"""WITH RECURSIVE {VIEWS}, l AS (SELECT DISTINCT {src} AS src_id, {dst} AS dst_id FROM e WHERE rel = '{rel}'),
    s AS ({seeds}), w AS (SELECT id AS seed, id, 0 AS hop FROM s UNION SELECT w.seed, l.dst_id, w.hop + 1 FROM w JOIN l ON l.src_id = w.id WHERE w.hop < {hops})
    SELECT seed, id, min(hop) AS hop FROM w WHERE id <> seed GROUP BY 1, 2"""


@query(_reach("INHERITS", 5, "SELECT DISTINCT src_id AS id FROM e WHERE rel = 'INHERITS'"))
def reach_inherits_1_5(spark: SparkSession, folder: str) -> DataFrame:
    n, e = graph(spark, folder)
    return tr.reachable(e, e.where("rel = 'INHERITS'").select(F.col("src_id").alias("id")), "INHERITS", 5)


@query(_reach("CALLS", 3, "SELECT DISTINCT src_id AS id FROM e WHERE rel = 'CALLS'"))
def reach_calls_1_3(spark: SparkSession, folder: str) -> DataFrame:
    n, e = graph(spark, folder)
    return tr.reachable(e, e.where("rel = 'CALLS'").select(F.col("src_id").alias("id")), "CALLS", 3)


@query(_reach("IMPORTS", 2, "SELECT DISTINCT dst_id AS id FROM e WHERE rel = 'IMPORTS'", "dst_id", "src_id"))
def reach_imports_in_1_2(spark: SparkSession, folder: str) -> DataFrame:
    """Modules that import another one, at once or over one more."""
    n, e = graph(spark, folder)
    return tr.reachable(e, e.where("rel = 'IMPORTS'").select(F.col("dst_id").alias("id")), "IMPORTS", 2, "in")


@query(_reach("CALLS", 2, "SELECT id FROM n WHERE label = 'Function' AND coalesce(type, '') <> 'external'", "dst_id", "src_id"))
def reach_callers_1_2(spark: SparkSession, folder: str) -> DataFrame:
    n, e = graph(spark, folder)
    return tr.reachable(e, n.where("label = 'Function' AND coalesce(type, '') <> 'external'").select("id"), "CALLS", 2, "in")


@query(WITH + "SELECT e.src_id, e.dst_id FROM e JOIN n a ON a.id = e.src_id WHERE rel = 'IMPORTS' AND contains(a.file_path, 'utils')")
def imports_of_files_out(spark: SparkSession, folder: str) -> DataFrame:
    n, e = graph(spark, folder)
    modules = n.where(F.col("file_path").contains("utils")).select("id")
    return tr.neighbours(e, "out", "IMPORTS").join(modules, "id", "left_semi").select(F.col("id").alias("src_id"), F.col("other").alias("dst_id"))


@query(WITH + """SELECT e.dst_id AS imported, count(*) AS n FROM e LEFT JOIN n b ON b.id = e.dst_id
WHERE rel = 'IMPORTS' AND (b.name IN ('re', 'json', 'typing') OR e.dst_id IN ('re', 'json', 'typing')) GROUP BY 1""")
def imports_in(spark: SparkSession, folder: str) -> DataFrame:
    n, e = graph(spark, folder)
    wanted = ["re", "json", "typing"]
    seen = tr.neighbours(e, "in", "IMPORTS").join(n.select(F.col("id").alias("n_id"), "name"), F.col("id") == F.col("n_id"), "left")
    return seen.where(F.col("name").isin(wanted) | F.col("id").isin(wanted)).groupBy(F.col("id").alias("imported")).agg(F.count("*").alias("n"))


@query(WITH + """SELECT coalesce(b.name, e.dst_id) AS name, count(DISTINCT e.src_id) AS callers FROM e LEFT JOIN n b ON b.id = e.dst_id WHERE rel = 'CALLS' GROUP BY 1""")
def callers_by_name(spark: SparkSession, folder: str) -> DataFrame:
    """Callers of every function name, whether its link was resolved or names a placeholder."""
    n, e = graph(spark, folder)
    seen = tr.neighbours(e, "in", "CALLS").join(n.select(F.col("id").alias("n_id"), "name"), F.col("id") == F.col("n_id"), "left")
    return seen.groupBy(F.coalesce("name", "id").alias("name")).agg(F.count_distinct("other").alias("callers"))


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    """The links as a parser leaves them, before resolution: called functions, bases and imported modules by name."""
    e = table(spark, folder, "edges", "src_id", "rel", "dst_id", "properties").where("rel IN ('CALLS', 'IMPORTS', 'INHERITS') AND src_id LIKE '%::%' AND dst_id <> ''")
    last = F.regexp_extract("dst_id", r"([^.:]*)$", 1)
    stub = (
        F.when(~F.col("dst_id").contains("::"), F.col("dst_id")).when(F.col("rel") == "CALLS", F.concat(F.lit(res.STUB), last))
        .when(F.col("rel") == "IMPORTS", res.local_id(F.col("dst_id"))).otherwise(last)
    )
    expr = F.coalesce(F.col("properties")["callee_expr"], F.lit("")).alias("expr")
    links = e.select("src_id", "rel", stub.alias("dst_id"), expr).unionByName(_likely(*graph(spark, folder)))
    return links.withColumn("repository", res.repository_of(F.col("src_id"))).distinct()


def _likely(n: DataFrame, e: DataFrame) -> DataFrame:
    """Calls that the definitions suggest, as a parser would write them: of each function the next one of its class or module by
    name, and from each function of a module the first one of every module that it imports."""
    f = n.where("label = 'Function' AND coalesce(type, '') <> 'external'").select(F.col("id").alias("f_id"), "name")
    o = n.select(F.col("id").alias("o_id"), F.col("label").alias("o_label"))
    held = e.where("rel = 'DEFINES' AND src_id LIKE '%::%'").join(f, F.col("dst_id") == F.col("f_id")).join(o, F.col("src_id") == F.col("o_id"))
    held = held.select(F.col("src_id").alias("owner"), F.col("f_id").alias("src_id"), "name", "o_label")
    nxt = F.lead("name").over(Window.partitionBy("owner").orderBy("name", "src_id"))
    near = held.withColumn("callee", nxt).where("callee IS NOT NULL")
    near = near.select("src_id", "callee", F.when(F.col("o_label") == "Class", F.concat(F.lit("self."), "callee")).otherwise(F.col("callee")).alias("expr"))
    first = held.where("o_label = 'Module'").groupBy(F.col("owner").alias("m2")).agg(F.min("name").alias("callee"))
    imports = e.where("rel = 'IMPORTS'").select(F.col("src_id").alias("m1"), F.col("dst_id").alias("imported"))
    far = held.where("o_label = 'Module'").join(imports, F.col("owner") == F.col("m1")).join(first, F.col("imported") == F.col("m2"))
    far = far.select("src_id", "callee", F.concat_ws(".", F.regexp_extract("m2", r"([^.:]*)$", 1), "callee").alias("expr"))
    return near.unionByName(far).select("src_id", F.lit("CALLS").alias("rel"), F.concat(F.lit(res.STUB), "callee").alias("dst_id"), "expr")


_PARSED = """, held AS (SELECT e.src_id AS owner, f.id AS src_id, f.name, o.label FROM e JOIN n f ON f.id = e.dst_id JOIN n o ON o.id = e.src_id
  WHERE e.rel = 'DEFINES' AND contains(e.src_id, '::') AND f.label = 'Function' AND coalesce(f.type, '') <> 'external'),
near AS (SELECT src_id, label, lead(name) OVER (PARTITION BY owner ORDER BY name, src_id) AS callee FROM held),
top AS (SELECT owner, min(name) AS callee FROM held WHERE label = 'Module' GROUP BY 1),
p AS (SELECT DISTINCT *, split_part(src_id, '::', 1) AS repository FROM (SELECT src_id, rel, CASE WHEN NOT contains(dst_id, '::') THEN dst_id WHEN rel = 'CALLS' THEN '__call__' || regexp_extract(dst_id, '[^.:]*$')
    WHEN rel = 'IMPORTS' THEN regexp_replace(dst_id, '^[^:]*::', '') ELSE regexp_extract(dst_id, '[^.:]*$') END AS dst_id,
  coalesce(properties['callee_expr'], '') AS expr FROM edges WHERE rel IN ('CALLS', 'IMPORTS', 'INHERITS') AND contains(src_id, '::') AND dst_id <> ''
  UNION ALL SELECT src_id, 'CALLS', '__call__' || callee, CASE WHEN label = 'Class' THEN 'self.' || callee ELSE callee END FROM near WHERE callee IS NOT NULL
  UNION ALL SELECT h.src_id, 'CALLS', '__call__' || top.callee, regexp_extract(top.owner, '[^.:]*$') || '.' || top.callee
    FROM held h JOIN e ON e.rel = 'IMPORTS' AND e.src_id = h.owner JOIN top ON top.owner = e.dst_id WHERE h.label = 'Module')),
real AS (SELECT * REPLACE (coalesce(repository, CASE WHEN contains(id, '::') THEN split_part(id, '::', 1) END) AS repository),
  (coalesce(file_path, ''), coalesce(line_start, 0), id) AS place FROM n WHERE coalesce(type, '') <> 'external'),
f AS (SELECT *, regexp_replace(id, '^[^:]*::', '') AS local FROM real WHERE label = 'Function')"""
_CALLS = """, own AS (SELECT x.id, max_by(m.id, length(m.id)) AS module_id FROM n x JOIN n m ON m.label = 'Module' AND starts_with(x.id, m.id || '.')
        WHERE x.label IN ('Function', 'Class') GROUP BY x.id),
c AS (SELECT DISTINCT p.src_id, dst_id AS stub, expr, substr(dst_id, 9) AS callee, repository, module_id FROM p LEFT JOIN own ON own.id = p.src_id
      WHERE rel = 'CALLS' AND starts_with(dst_id, '__call__')),
seg AS (SELECT DISTINCT src_id AS m, regexp_extract(dst_id, '[^.]*$') AS seg FROM p WHERE rel = 'IMPORTS'),
k AS (SELECT src_id, stub, expr, 'A' AS tier, regexp_replace(src_id, '\\.[^.]*$', '') || '.' || callee AS key FROM c
      WHERE expr IN ('', callee, 'self.' || callee, 'cls.' || callee) AND len(string_split(regexp_replace(src_id, '^[^:]*::', ''), '.')) >= 3
      UNION ALL SELECT src_id, stub, expr, 'B', module_id || '.' || callee FROM c WHERE expr IN ('', callee)),
g AS (SELECT c.* FROM c WHERE EXISTS (SELECT 1 FROM seg WHERE m = module_id AND seg = callee)),
t AS (SELECT k.src_id, stub, expr, tier, f.id FROM k JOIN f ON f.id = k.key
      UNION ALL SELECT src_id, stub, expr, 'C', min(f.id) FROM g JOIN f ON f.repository = g.repository AND f.name = callee GROUP BY 1, 2, 3 HAVING count(*) = 1
      UNION ALL SELECT src_id, stub, expr, 'C', min(f.id) FROM g JOIN f ON f.repository = g.repository AND f.name = callee
        WHERE EXISTS (SELECT 1 FROM seg WHERE m = module_id AND list_contains(string_split(f.local, '.'), seg)) GROUP BY 1, 2, 3 HAVING count(*) = 1
      UNION ALL SELECT src_id, stub, expr, 'C', min_by(f.id, f.place) FROM c JOIN f ON f.repository = c.repository
        AND regexp_extract(f.local, '[^.]+[.][^.]+$') = split_part(expr, '.', 1) || '.' || callee
        WHERE contains(expr, '.') AND NOT EXISTS (SELECT 1 FROM seg WHERE m = module_id AND seg = callee)
        AND EXISTS (SELECT 1 FROM seg WHERE m = module_id AND seg = split_part(expr, '.', 1)) GROUP BY 1, 2, 3),
r AS (SELECT src_id, stub, expr, min_by(id, (tier, id)) AS resolved_id, min(tier) AS tier FROM t GROUP BY 1, 2, 3)"""
_STUBS = """, md AS (SELECT repository, id, name, place, regexp_extract(file_path, '([^/]+?)(?:\\.[^./]*)?$', 1) AS stem FROM real WHERE label = 'Module'),
w AS (SELECT repository, stem AS key, 'stem' AS how, max_by(id, place) AS id FROM md WHERE stem <> '' GROUP BY 1, 2
      UNION ALL SELECT repository, name, 'name', min_by(id, place) FROM md WHERE name <> '' GROUP BY 1, 2
      UNION ALL SELECT repository, name, 'class', min_by(id, place) FROM real WHERE label = 'Class' AND name <> '' GROUP BY 1, 2),
a AS (SELECT DISTINCT repository, dst_id AS stub, list_last(string_split(dst_id, '.')) AS last FROM p WHERE rel IN ('IMPORTS', 'INHERITS')),
b AS (SELECT a.repository, stub, w.id, CASE WHEN how = 'stem' AND key = last THEN 0 WHEN how = 'name' AND key = last THEN 1 WHEN how = 'stem' THEN 2
        WHEN how = 'name' THEN 3 WHEN key = stub THEN 4 ELSE 5 END AS priority
      FROM a JOIN w ON w.repository = a.repository AND w.key IN (a.last, a.stub)),
s AS (SELECT repository, stub, min_by(id, priority) AS resolved_id FROM b GROUP BY 1, 2)"""


def _resolved(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nodes, parsed links, resolved calls and resolved stubs."""
    n, p = graph(spark, folder)[0], _parsed(spark, folder)
    calls = res.resolve_calls(p.where("rel = 'CALLS'").withColumnRenamed("expr", "callee_expr"), n, p.where("rel = 'IMPORTS'"))
    stubs = res.resolve_stubs(p.where("rel IN ('IMPORTS', 'INHERITS')").select("repository", F.col("dst_id").alias("stub")), n)
    return n, p, calls, stubs


@query(WITH + _PARSED + _CALLS + " SELECT * FROM r")
def resolved_calls(spark: SparkSession, folder: str) -> DataFrame:
    return _resolved(spark, folder)[2]


@query(WITH + _PARSED + _STUBS + " SELECT * FROM s")
def resolved_stubs(spark: SparkSession, folder: str) -> DataFrame:
    return _resolved(spark, folder)[3]


_LINKS = """, l AS (SELECT DISTINCT p.src_id, p.rel, coalesce(s.resolved_id, r.resolved_id, p.dst_id) AS dst_id FROM p
  LEFT JOIN r ON r.src_id = p.src_id AND r.stub = p.dst_id AND r.expr = p.expr AND p.rel = 'CALLS'
  LEFT JOIN s ON s.repository = p.repository AND s.stub = p.dst_id AND p.rel <> 'CALLS')"""


@query(WITH + _PARSED + _CALLS + _STUBS + _LINKS + " SELECT * FROM l")
def redirected_links(spark: SparkSession, folder: str) -> DataFrame:
    n, p, calls, stubs = _resolved(spark, folder)
    return res.redirect(p, calls, stubs)


@query(WITH + _PARSED + _CALLS + _STUBS + _LINKS + """, h AS (SELECT id, file_path, name FROM n WHERE label = 'Function' AND file_path <> '')
SELECT id, string_agg(name, ',' ORDER BY name) AS siblings, count(*) AS n FROM (
  SELECT DISTINCT a.id, b.name FROM l JOIN h a ON a.id = l.src_id JOIN h b ON b.id = l.dst_id AND b.file_path = a.file_path WHERE rel = 'CALLS') GROUP BY id""")
def called_siblings(spark: SparkSession, folder: str) -> DataFrame:
    """The functions of its own file that each function calls, by the resolved links."""
    n, p, calls, stubs = _resolved(spark, folder)
    return tr.called_siblings(res.redirect(p, calls, stubs), n)


@query(WITH + _PARSED + _CALLS + _STUBS + _LINKS + """ SELECT id, label FROM n WHERE NOT (coalesce(type, '') = 'external' OR starts_with(id, '__call__'))
OR EXISTS (SELECT 1 FROM l WHERE n.id IN (dst_id, src_id))""".replace("EXISTS (SELECT 1 FROM l WHERE n.id IN (dst_id, src_id))", "id IN (SELECT dst_id FROM l UNION SELECT src_id FROM l)"))
def nodes_without_unused_stubs(spark: SparkSession, folder: str) -> DataFrame:
    n, p, calls, stubs = _resolved(spark, folder)
    return res.without_unused_stubs(n, res.redirect(p, calls, stubs)).select("id", "label")


@query(WITH + _PARSED + """, s AS (SELECT DISTINCT repository, regexp_replace(dst_id, '^__call__', '') AS stub FROM p),
d AS (SELECT DISTINCT stub FROM s), k AS (SELECT DISTINCT n.id, n.name FROM n WHERE coalesce(n.type, '') <> 'external')
SELECT d.stub, min(k.id) AS id FROM d JOIN k ON k.id = d.stub OR k.name = d.stub OR ends_with(k.id, '.' || d.stub) GROUP BY d.stub HAVING count(DISTINCT k.id) = 1""")
def names_resolved_across(spark: SparkSession, folder: str) -> DataFrame:
    """Names as parsed that mean one node in all repositories."""
    names = _parsed(spark, folder).select(F.regexp_replace("dst_id", f"^{res.STUB}", "").alias("stub"))
    return res.resolve_names(names, graph(spark, folder)[0])


@query(WITH + _PARSED + """, x AS (SELECT DISTINCT src_id, 'USES' AS rel, regexp_replace(dst_id, '^__call__', '') AS dst_id FROM p WHERE rel = 'CALLS'),
i AS (SELECT name, min_by(id, (label, id)) AS id FROM n WHERE label IN ('Class', 'Function') AND name <> '' GROUP BY 1),
y AS (SELECT DISTINCT x.src_id, x.rel, coalesce(n.id, i.id, x.dst_id) AS dst_id FROM x LEFT JOIN n ON n.id = x.dst_id LEFT JOIN i ON i.name = x.dst_id),
z AS (SELECT * FROM y EXCEPT SELECT * FROM e)
SELECT src_id, rel, dst_id, NOT EXISTS (SELECT 1 FROM n WHERE n.id = z.dst_id) AS needs_stub FROM z""")
def merged_uses(spark: SparkSession, folder: str) -> DataFrame:
    """Every called name as a USES link that is put to an id and merged into the graph: the new links, and whether their end needs
    a placeholder."""
    n, e = graph(spark, folder)
    uses = _parsed(spark, folder).where("rel = 'CALLS'").select("src_id", F.lit("USES").alias("rel"), F.regexp_replace("dst_id", f"^{res.STUB}", "").alias("dst_id")).distinct()
    stubs, new = res.merged(n, e, res.named_ends(uses, n))
    s = stubs.select(F.col("id").alias("s_id"))
    return new.join(s, F.col("dst_id") == F.col("s_id"), "left").select("src_id", "rel", "dst_id", F.col("s_id").isNotNull().alias("needs_stub"))


@query(WITH + """SELECT x.id, max_by(m.id, length(m.id)) AS module_id FROM n x JOIN n m ON m.label = 'Module' AND starts_with(x.id, m.id || '.')
WHERE x.label IN ('Function', 'Class') GROUP BY x.id""")
def longest_module_prefix(spark: SparkSession, folder: str) -> DataFrame:
    return res.owning_modules(graph(spark, folder)[0])


@query("""SELECT label, CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT id) AS BIGINT) AS ids,
CAST(count(*) FILTER (WHERE properties['type'] = 'external' OR starts_with(id, '__call__')) AS BIGINT) AS stubs FROM nodes GROUP BY label""")
def store_counts(spark: SparkSession, folder: str) -> DataFrame:
    stub = (F.col("properties")["type"] == "external") | F.col("id").startswith("__call__")
    return table(spark, folder, "nodes").groupBy("label").agg(
        F.count("*").alias("rows"), F.count_distinct("id").alias("ids"), F.count_if(stub).alias("stubs")
    )


@query(WITH + """, v AS (UNPIVOT (SELECT repository, label, type, index_run_id FROM n WHERE repository IS NOT NULL) ON label, type, index_run_id INTO NAME field VALUE value)
SELECT DISTINCT repository, field, value FROM v WHERE value <> ''""")
def facets(spark: SparkSession, folder: str) -> DataFrame:
    n = graph(spark, folder)[0].where("repository IS NOT NULL").select("repository", "label", "type", "index_run_id")
    return n.unpivot(["repository"], ["label", "type", "index_run_id"], "field", "value").where("value <> ''").distinct()


@query("SELECT DISTINCT repository FROM nodes WHERE repository <> '' UNION SELECT DISTINCT repository FROM source_files WHERE repository <> ''")
def repositories(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "nodes", "repository").where("repository <> ''")
    return a.union(table(spark, folder, "source_files", "repository").where("repository <> ''")).distinct()


_MEMBERS = """, m AS (SELECT id, concat_ws('::', repository, CASE WHEN coalesce(file_path, '') = '' THEN 'root' WHEN NOT contains(file_path, '/') THEN '.'
  ELSE regexp_replace(file_path, '/[^/]*$', '') END) AS community FROM n WHERE repository IS NOT NULL AND label IN ('Module', 'Class', 'Function'))
"""


@query(WITH + _MEMBERS + "SELECT community, count(*) AS size FROM m GROUP BY 1")
def community_partition(spark: SparkSession, folder: str) -> DataFrame:
    return com.communities(graph(spark, folder)[0])


@query(WITH + _MEMBERS + """, p AS (SELECT DISTINCT least(e.src_id, e.dst_id) AS a, greatest(e.src_id, e.dst_id) AS b FROM e WHERE e.src_id <> e.dst_id),
q AS (SELECT x.community AS ca, y.community AS cb FROM p JOIN m x ON x.id = p.a JOIN m y ON y.id = p.b)
SELECT community, CAST(sum(inner_) AS BIGINT) AS inner, CAST(sum(1 - inner_) AS BIGINT) AS border FROM (
  SELECT ca AS community, CAST(ca = cb AS INT) AS inner_ FROM q UNION ALL SELECT cb, 0 FROM q WHERE ca <> cb) GROUP BY 1""")
def community_link_counts(spark: SparkSession, folder: str) -> DataFrame:
    n, e = graph(spark, folder)
    return com.link_counts(e, com.members(n))


@query(WITH + _MEMBERS + """SELECT a.community AS src_community, b.community AS dst_community, count(*) AS weight
FROM e JOIN m a ON a.id = e.src_id JOIN m b ON b.id = e.dst_id WHERE a.community <> b.community GROUP BY 1, 2""")
def community_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    n, e = graph(spark, folder)
    return com.dependencies(e, com.members(n))


@query(WITH + _MEMBERS + """, d AS (SELECT a.community AS src_id, b.community AS dst_id, count(*) AS weight
FROM e JOIN m a ON a.id = e.src_id JOIN m b ON b.id = e.dst_id WHERE a.community <> b.community GROUP BY 1, 2)
SELECT id AS src_id, 'IN_COMMUNITY' AS rel, community AS dst_id, CAST(1 AS BIGINT) AS weight FROM m UNION ALL SELECT src_id, 'DEPENDS_ON', dst_id, weight FROM d""")
def community_links(spark: SparkSession, folder: str) -> DataFrame:
    n, e = graph(spark, folder)
    return com.community_links(e, com.members(n))


@query(WITH + """, c AS (SELECT DISTINCT node_id, regexp_replace(node_id, '::\\d+$', '') AS base FROM chunks)
SELECT c.node_id, coalesce(n.name, list_last(string_split(base, '::'))) AS name FROM c LEFT JOIN n ON n.id = c.base""")
def chunk_names(spark: SparkSession, folder: str) -> DataFrame:
    """The name of every chunk's node, or the last part of its id where no node has it."""
    c = table(spark, folder, "chunks", "node_id").distinct().withColumn("base", X.base_node_id(F.col("node_id")))
    n = graph(spark, folder)[0].select("id", "name")
    return c.join(n, F.col("base") == F.col("id"), "left").select("node_id", F.coalesce("name", F.substring_index("base", "::", -1)).alias("name"))


@query("""WITH r AS (SELECT DISTINCT id, label, repository, index_run_id, loaded_at, deleted_at FROM nodes WHERE id IS NOT NULL)
SELECT id, max_by(label, (loaded_at, index_run_id, label)) AS label, max_by(index_run_id, (loaded_at, index_run_id, label)) AS index_run_id FROM r GROUP BY id""")
def upsert_last_wins(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "nodes", "id", "label", "index_run_id", "loaded_at").where("id IS NOT NULL")
    return up.last_wins(rows, ["id"], ["loaded_at", "index_run_id", "label"]).select("id", "label", "index_run_id")


_STALE = """, l AS (SELECT repository, max_by(index_run_id, (loaded_at, index_run_id)) AS run FROM nodes WHERE repository IS NOT NULL AND index_run_id IS NOT NULL GROUP BY 1),
g AS (SELECT n.id FROM n JOIN l ON l.repository = n.repository WHERE coalesce(n.index_run_id, '') <> l.run)"""


@query(WITH + _STALE + """ SELECT e.* FROM e WHERE NOT EXISTS (SELECT 1 FROM g WHERE id = e.src_id) AND NOT EXISTS (SELECT 1 FROM g WHERE id = e.dst_id)""")
def stale_run_removed(spark: SparkSession, folder: str) -> DataFrame:
    """The links that are left when every repository keeps only its last run's nodes."""
    n, e = graph(spark, folder)
    return up.without_stale(n, e, up.last_runs(table(spark, folder, "nodes", "repository", "index_run_id", "loaded_at")))[1]


@query(WITH + """, f AS (SELECT DISTINCT repository, file_path FROM source_files WHERE content IS NULL AND file_path <> ''),
g AS (SELECT id FROM n WHERE EXISTS (SELECT 1 FROM f WHERE f.file_path = n.file_path AND f.repository = n.repository))
SELECT e.* FROM e WHERE NOT EXISTS (SELECT 1 FROM g WHERE id = e.src_id) AND NOT EXISTS (SELECT 1 FROM g WHERE id = e.dst_id)""")
def deleted_files_removed(spark: SparkSession, folder: str) -> DataFrame:
    """The links that are left when the nodes of files without content are deleted with their links."""
    n, e = graph(spark, folder)
    gone = table(spark, folder, "source_files", "repository", "file_path", "content").where("content IS NULL AND file_path <> ''")
    return up.without_files(n, e, gone)[1]


@query(WITH + """, k AS (SELECT repository, count(*) AS n FROM n WHERE repository IS NOT NULL GROUP BY 1 ORDER BY n DESC, repository LIMIT 1),
g AS (SELECT id FROM n JOIN k ON k.repository = n.repository)
SELECT rel, count(*) AS n FROM e WHERE NOT EXISTS (SELECT 1 FROM g WHERE id = e.src_id) AND NOT EXISTS (SELECT 1 FROM g WHERE id = e.dst_id) GROUP BY rel""")
def repository_removed(spark: SparkSession, folder: str) -> DataFrame:
    """Links by relation when the largest repository is deleted."""
    n, e = graph(spark, folder)
    sizes = n.where("repository IS NOT NULL").groupBy("repository").agg(F.count("*").alias("size"))
    largest = sizes.orderBy(F.desc("size"), "repository").limit(1).select("repository")
    return up.without_repositories(n, e, largest)[1].groupBy("rel").agg(F.count("*").alias("n"))


@query(WITH + """, s AS (SELECT repository, max_by(indexed_commit, (loaded_at, file_id)) AS commit FROM source_files WHERE indexed_commit IS NOT NULL AND repository IS NOT NULL GROUP BY 1)
SELECT n.id, n.repository, s.commit AS indexed_commit FROM n LEFT JOIN s ON s.repository = n.repository""")
def stamped_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes with the commit of their repository's last loaded file."""
    files = table(spark, folder, "source_files", "file_id", "repository", "indexed_commit", "loaded_at").where("indexed_commit IS NOT NULL AND repository IS NOT NULL")
    meta = files.groupBy("repository").agg(F.max_by("indexed_commit", F.struct("loaded_at", "file_id")).alias("last_indexed_commit"))
    return up.stamped(graph(spark, folder)[0].select("id", "repository"), meta)


@query("""WITH r AS (SELECT DISTINCT repository, CAST(regexp_extract(index_run_id, '-r(\\d+)$', 1) AS INT) AS run, id FROM nodes
  WHERE repository IS NOT NULL AND id IS NOT NULL AND regexp_matches(index_run_id, '-r\\d+$')),
l AS (SELECT repository, max(run) AS last FROM r GROUP BY 1),
b AS (SELECT coalesce(a.repository, p.repository) AS repository, coalesce(a.run, p.run + 1) AS run, a.id IS NOT NULL AS has, p.id IS NOT NULL AS had
      FROM r a FULL JOIN r p ON p.repository = a.repository AND p.run + 1 = a.run AND p.id = a.id)
SELECT b.repository, run, count(*) FILTER (WHERE has AND NOT had) AS added, count(*) FILTER (WHERE NOT has AND had) AS removed,
  count(*) FILTER (WHERE has AND had) AS kept FROM b JOIN l ON l.repository = b.repository AND run <= last GROUP BY 1, 2""")
def run_changes(spark: SparkSession, folder: str) -> DataFrame:
    return up.run_changes(table(spark, folder, "nodes", "id", "repository", "index_run_id").where("id IS NOT NULL"))


@query("""WITH f AS (SELECT DISTINCT repository, list_filter(string_split(regexp_replace(replace(file_path, '\\', '/'), '^(\\./)+', ''), '/'), lambda x: x <> '') AS p
  FROM source_files WHERE file_path IS NOT NULL), d AS (SELECT DISTINCT repository, p[1:i] AS f FROM (SELECT *, unnest(range(1, len(p))) AS i FROM f))
SELECT repository || '::dir::' || array_to_string(f, '/') AS src_id, 'WEAK_LINK' AS rel,
  CASE WHEN len(f) > 1 THEN repository || '::dir::' || array_to_string(f[1:len(f) - 1], '/') ELSE repository END AS dst_id, repository FROM d""")
def folder_chain(spark: SparkSession, folder: str) -> DataFrame:
    return folder_links(table(spark, folder, "source_files", "repository", "file_path"))


@query("""SELECT DISTINCT file_path, replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(file_path, '\\', '/'), '\\.(py|java)$', ''), '/__init__$', ''), '^src/(main|test)/java/', ''), '^src/', ''), '/', '.') AS fqn,
CASE WHEN regexp_matches(file_path, '__init__[.]py$') THEN 'init' WHEN regexp_matches(file_path, '(^|/)test') THEN 'test' ELSE 'source' END AS module_type,
CASE WHEN regexp_matches(lower(file_path), '\\.(md|ya?ml)$|(^|/)dockerfile$') THEN 'non_code' ELSE 'code' END AS file_type FROM source_files""")
def path_functions(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("file_path")
    return table(spark, folder, "source_files", "file_path").select(
        p, X.path_fqn(p).alias("fqn"), X.module_type(p).alias("module_type"), X.file_type(p).alias("file_type")
    ).distinct()


@query("""SELECT DISTINCT node_id, regexp_replace(node_id, '::\\d+$', '') AS base_id,
list_last(string_split(list_last(string_split(regexp_replace(node_id, '::\\d+$', ''), '::')), '.')) AS name FROM chunks WHERE NOT regexp_matches(node_id, ':$')""")
def id_functions(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("node_id")
    return table(spark, folder, "chunks", "node_id").where(~i.endswith(":")).select(
        i, X.base_node_id(i).alias("base_id"), X.display_name(i).alias("name")
    ).distinct()


@query("""WITH c AS (SELECT DISTINCT repository, file_path FROM chunks), s AS (SELECT DISTINCT repository, file_path FROM source_files)
SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM c INTERSECT SELECT * FROM s)
UNION ALL SELECT 'chunks only', count(*) FROM (SELECT * FROM c EXCEPT SELECT * FROM s)
UNION ALL SELECT 'files only', count(*) FROM (SELECT * FROM s EXCEPT SELECT * FROM c)
UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM c UNION SELECT * FROM s)""")
def path_sets(spark: SparkSession, folder: str) -> DataFrame:
    c, s = table(spark, folder, "chunks", "repository", "file_path"), table(spark, folder, "source_files", "repository", "file_path")
    parts = {"both": c.intersect(s), "chunks only": c.subtract(s), "files only": s.subtract(c), "either": c.union(s).distinct()}
    counts = [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "n") for k, d in parts.items()]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


@query("""WITH s AS (SELECT repository, count(DISTINCT indexed_commit) AS commits, max_by(indexed_commit, (loaded_at, file_id)) AS file_commit FROM source_files
  WHERE repository <> '' AND indexed_commit IS NOT NULL GROUP BY 1),
m AS (SELECT id AS repository, max_by(properties['commit'], (loaded_at, index_run_id)) AS graph_commit, max_by(index_run_id, (loaded_at, index_run_id)) AS last_run FROM nodes
  WHERE lower(trim(label)) = 'repositorymetadata' AND id <> '' AND index_run_id IS NOT NULL GROUP BY 1)
SELECT coalesce(s.repository, m.repository) AS repository, commits, file_commit, graph_commit, last_run,
  CASE WHEN coalesce(graph_commit, '') = '' THEN true ELSE graph_commit <> file_commit END AS is_stale FROM s FULL JOIN m ON m.repository = s.repository""")
def index_status(spark: SparkSession, folder: str) -> DataFrame:
    """Per repository the commit of its last loaded file and that of its metadata node: stale if they differ or the graph knows
    none, unknown if there is no file to compare with."""
    s = table(spark, folder, "source_files", "file_id", "repository", "indexed_commit", "loaded_at").where("repository <> '' AND indexed_commit IS NOT NULL")
    s = s.groupBy("repository").agg(F.count_distinct("indexed_commit").alias("commits"), F.max_by("indexed_commit", F.struct("loaded_at", "file_id")).alias("file_commit"))
    m = table(spark, folder, "nodes", "id", "label", "properties", "index_run_id", "loaded_at").where("lower(trim(label)) = 'repositorymetadata' AND id <> '' AND index_run_id IS NOT NULL")
    order = F.struct("loaded_at", "index_run_id")
    m = m.groupBy(F.col("id").alias("repository")).agg(F.max_by(F.col("properties")["commit"], order).alias("graph_commit"), F.max_by("index_run_id", order).alias("last_run"))
    stale = F.when(F.coalesce("graph_commit", F.lit("")) == "", True).otherwise(F.col("graph_commit") != F.col("file_commit"))
    return s.join(m, "repository", "full").select("repository", "commits", "file_commit", "graph_commit", "last_run", stale.alias("is_stale"))


_NOISE = " OR ".join(f"contains(coalesce(path, ''), '/{x}') OR starts_with(coalesce(path, ''), '{x}') OR coalesce(name, '') = '{x}'" for x in X.NOISE)
_FOLDERS = f"""WITH d AS (SELECT id, label, path, name FROM (SELECT id, lower(trim(label)) AS label, properties['path'] AS path, properties['name'] AS name, deleted_at,
  row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, index_run_id DESC, label DESC) AS rn FROM nodes WHERE id IS NOT NULL) WHERE rn = 1 AND deleted_at IS NULL),
k AS (SELECT id, label FROM d WHERE label = 'repositorymetadata' OR label = 'directory' AND NOT ({_NOISE})),
e AS (SELECT DISTINCT src_id, rel, dst_id FROM edges WHERE src_id <> '' AND dst_id <> '')"""


@query(_FOLDERS + " SELECT src_id, dst_id FROM e WHERE rel = 'WEAK_LINK' AND src_id IN (SELECT id FROM k) AND dst_id IN (SELECT id FROM k)")
def master_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Links between repositories and folders that are no noise, where both ends are left."""
    rows = table(spark, folder, "nodes", "id", "label", "properties", "loaded_at", "index_run_id", "deleted_at").where("id IS NOT NULL")
    last = up.last_wins(rows.withColumn("path", F.col("properties")["path"]).withColumn("name", F.col("properties")["name"]).drop("properties"), ["id"], ["loaded_at", "index_run_id", "label"])
    label = F.lower(F.trim("label"))
    quiet = ~X.is_noise(F.coalesce("path", F.lit("")), F.coalesce("name", F.lit("")))
    kept = last.where(F.col("deleted_at").isNull() & ((label == "repositorymetadata") | (label == "directory") & quiet)).select("id")
    e = links(table(spark, folder, "edges", "src_id", "rel", "dst_id")).where("rel = 'WEAK_LINK'")
    e = e.join(kept, F.col("src_id") == F.col("id"), "left_semi").join(kept, F.col("dst_id") == F.col("id"), "left_semi")
    return e.select("src_id", "dst_id")


@query(WITH + _MEMBERS + "SELECT DISTINCT n.repository, m.community FROM m JOIN n USING (id)")
def repository_communities(spark: SparkSession, folder: str) -> DataFrame:
    """The communities that a repository's nodes are members of."""
    n = graph(spark, folder)[0]
    return com.members(n).join(n.select("id", "repository"), "id").select("repository", "community").distinct()


@query()
def built_graph(spark: SparkSession, folder: str) -> DataFrame:
    """The graph that the source files give by themselves, resolved: its links by relation, and how many still end in a placeholder."""
    files = table(spark, folder, "source_files", "repository", "file_path", "content").where("repository IS NOT NULL")
    built = Workspace(spark, "built").cut(code.extract(files), "rows")
    p = F.col("properties")
    n = built.where("kind = 'node'").select(
        "id", "label", p["name"].alias("name"), p["file_path"].alias("file_path"), p["type"].alias("type"), p["line_start"].cast("int").alias("line_start"),
        F.when(F.coalesce(p["type"], F.lit("")) != "external", F.col("repository")).alias("repository"),
    ).distinct()
    e = built.where("kind = 'edge'").select(F.col("id").alias("src_id"), "rel", F.col("other").alias("dst_id"), F.coalesce(p["callee_expr"], F.lit("")).alias("expr"), "repository")
    calls = res.resolve_calls(e.where("rel = 'CALLS'").withColumnRenamed("expr", "callee_expr"), n, e.where("rel = 'IMPORTS'"))
    stubs = res.resolve_stubs(e.where("rel IN ('IMPORTS', 'INHERITS')").select("repository", F.col("dst_id").alias("stub")), n)
    real = n.where("coalesce(type, '') <> 'external'").select(F.col("id").alias("n_id"), "repository", "file_path")
    whole = res.redirect(e, calls, stubs)
    docs = code.non_code(files).select("id", "repository", F.col("properties")["file_path"].alias("file_path"))
    modules = n.where("label = 'Module' AND coalesce(type, '') <> 'external'").select("id", "repository", "file_path")
    held = code.holders(modules, "DEFINES").unionByName(code.holders(docs, "WEAK_LINK")).unionByName(folder_links(files)).select("src_id", "rel", "dst_id")
    whole = whole.withColumn("open", F.lit(True)).unionByName(held.withColumn("open", F.lit(False)))
    ended = whole.join(real.select("n_id"), F.col("dst_id") == F.col("n_id"), "left")
    return ended.groupBy("rel").agg(F.count("*").alias("n"), F.count_if(F.col("open") & F.col("n_id").isNull()).alias("placeholders"))
