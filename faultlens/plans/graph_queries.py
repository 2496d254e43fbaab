"""Registered queries: dependency graphs, call resolution, module trees and file roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultlens import fixed_values as V
from faultlens.operators import graph
from faultlens.plans import tables as D
from faultlens.session import join_large

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


KINDS = ["class", "method", "function"]
LANGS = ["java", "cpp", "c", "python"]


def functions(spark, d):
    """Every part as a function or class of a source file; a third of the names are unique."""
    p = D.load(spark, d, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    base = F.replace("p_name", F.lit(" "), F.lit("_"))
    name = F.when(k % 3 == 0, D.cat(base, k)).otherwise(base)
    lang = F.get(F.array(*[F.lit(x) for x in LANGS]), (k % 4).cast("int"))
    kind = F.get(F.array(*[F.lit(x) for x in KINDS]), (size % 3).cast("int"))
    path = D.cat("=src/", F.lower("p_type"), "=/P", k, "=.java")
    return p.select(
        D.cat(path, "=::", name).alias("id"), name.alias("name"), D.cat(path, "=::", name).alias("component_id"),
        D.cat("=com.", F.lower("p_type"), "=.P", k, "=.", name).alias("qualified_name"), path.alias("file_path"), path.alias("file"),
        kind.alias("component_type"), lang.alias("language"), k.alias("k"), "p_brand")


FUNC_SQL = """fn AS (SELECT 'src/' || lower(p_type) || '/P' || p_partkey || '.java' AS file_path, p_partkey AS k, p_brand,
   replace(p_name, ' ', '_') || CASE WHEN p_partkey % 3 = 0 THEN p_partkey::VARCHAR ELSE '' END AS name, lower(p_type) AS pk,
   ['class', 'method', 'function'][1 + p_size % 3] AS component_type, ['java', 'cpp', 'c', 'python'][1 + p_partkey % 4] AS language FROM part),
funcs AS (SELECT *, file_path || '::' || name AS id, 'com.' || pk || '.P' || k || '.' || name AS qualified_name FROM fn)"""


def calls(spark, d):
    """Every line item as a call from its part to the part numbered like its supplier, in nine spellings."""
    li = D.load(spark, d, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
                                             ((F.col("l_orderkey") + F.col("l_linenumber")) % 9).alias("v"))
    f = functions(spark, d)
    src = f.select(F.col("k").alias("l_partkey"), F.col("id").alias("caller"))
    dst = f.select(F.col("k").alias("l_suppkey"), F.col("id").alias("t_id"), F.col("qualified_name").alias("t_qn"), F.col("name").alias("t_name"))
    v = F.col("v")
    callee = (F.when(v == 0, F.col("t_id")).when(v == 1, F.col("t_qn")).when(v == 2, D.cat("=X::", "t_name"))
              .when(v == 3, D.cat("=P", "l_suppkey", "=.", "t_name")).when(v == 4, F.col("t_name")).when(v == 5, "java.util.List")
              .when(v == 6, "std::vector").when(v == 7, "org.other.Thing.run").otherwise("ASSERT_OK"))
    named = join_large(li, dst, ["l_suppkey"]).select("l_partkey", callee.alias("callee"), "pos")
    return join_large(named, src, ["l_partkey"]).select("caller", "callee", "pos")


CALL_SQL = f"""{FUNC_SQL},
calls AS (SELECT s.id AS caller, l_orderkey * 10 + l_linenumber AS pos, CASE (l_orderkey + l_linenumber) % 9 WHEN 0 THEN t.id WHEN 1 THEN t.qualified_name
   WHEN 2 THEN 'X::' || t.name WHEN 3 THEN 'P' || l_suppkey || '.' || t.name WHEN 4 THEN t.name WHEN 5 THEN 'java.util.List' WHEN 6 THEN 'std::vector'
   WHEN 7 THEN 'org.other.Thing.run' ELSE 'ASSERT_OK' END AS callee FROM lineitem JOIN funcs s ON s.k = l_partkey JOIN funcs t ON t.k = l_suppkey),
ek AS (SELECT 'exact' AS kind, id AS key, id FROM funcs UNION SELECT 'exact', qualified_name, id FROM funcs UNION SELECT 'exact', name, id FROM funcs
  UNION SELECT 'simple', name, id FROM funcs UNION SELECT 'simple', 'P' || k || '.' || name, id FROM funcs),
ku AS (SELECT kind, key, min(id) AS id FROM ek GROUP BY 1, 2 HAVING count(DISTINCT id) = 1),
pkg AS (SELECT id AS caller, CASE WHEN language <> 'java' THEN '' WHEN component_type = 'method' THEN 'com.' || pk ELSE 'com.' || pk || '.P' || k END AS package FROM funcs),
tries AS (SELECT DISTINCT callee, package, unnest([1, 2, 3, 4, 5, 6, 7]) AS step FROM calls JOIN pkg USING (caller)),
tk AS (SELECT *, CASE step WHEN 1 THEN 'exact' WHEN 2 THEN 'exact' WHEN 6 THEN 'exact' ELSE 'simple' END AS kind,
   CASE WHEN step IN (1, 7) THEN callee WHEN step IN (2, 3) AND contains(callee, '::') THEN split_part(callee, '::', -1)
     WHEN step = 4 AND contains(callee, '.') THEN callee WHEN step = 5 AND contains(callee, '.') THEN split_part(callee, '.', -1)
     WHEN step = 6 AND NOT contains(callee, '.') AND package <> '' THEN package || '.' || callee END AS key FROM tries),
best AS (SELECT callee, package, arg_min(id, step) AS resolved FROM tk JOIN ku USING (kind, key) GROUP BY 1, 2),
res AS (SELECT c.caller, c.callee, c.pos, b.resolved, b.resolved IS NOT NULL AS is_resolved FROM calls c JOIN pkg p USING (caller)
   LEFT JOIN best b ON b.callee = c.callee AND b.package = p.package),
live AS (SELECT r.* FROM res r JOIN funcs f ON f.id = r.caller WHERE is_resolved OR NOT (starts_with(callee, 'java.') OR starts_with(callee, 'std::')
   OR (language = 'java' AND contains(callee, '.') AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT package FROM pkg WHERE package <> '') q WHERE
        q.package = regexp_replace(callee, '\\.[^.]*$', '') OR starts_with(q.package, regexp_replace(callee, '\\.[^.]*$', '') || '.')
        OR starts_with(regexp_replace(callee, '\\.[^.]*$', ''), q.package || '.')))
   OR (language IN ('c', 'cpp') AND regexp_full_match(callee, '[A-Z][A-Z0-9_]*'))))"""


def resolved(spark, d):
    return graph.resolve_calls(calls(spark, d), functions(spark, d))


def live_calls(spark, d):
    return graph.live_calls(calls(spark, d), functions(spark, d))


@query("resolved_calls", f"WITH {CALL_SQL} SELECT caller, callee, pos, resolved, is_resolved FROM res")
def resolved_calls(spark, d):
    return resolved(spark, d)


@query("project_calls", f"WITH {CALL_SQL} SELECT caller, callee, pos, resolved, is_resolved FROM live")
def project_calls(spark, d):
    return live_calls(spark, d)


@query("distinct_calls", f"WITH {CALL_SQL} SELECT caller, callee, min(pos) AS pos FROM calls GROUP BY 1, 2")
def distinct_calls(spark, d):
    return graph.first_edges(calls(spark, d))


@query("call_totals", f"""WITH {CALL_SQL} SELECT (SELECT count(*) FROM funcs) AS total_nodes, count(*) FILTER (WHERE is_resolved) AS total_edges,
  count(*) FILTER (WHERE NOT is_resolved) AS unresolved_calls FROM live""")
def call_totals(spark, d):
    return graph.totals(functions(spark, d), live_calls(spark, d))


@query("call_lists", f"""WITH {CALL_SQL}, e AS (SELECT DISTINCT caller, resolved FROM res WHERE is_resolved)
SELECT f.id, f.name, coalesce((SELECT string_agg(resolved, ',' ORDER BY resolved) FROM e WHERE e.caller = f.id), '') AS calls,
  coalesce((SELECT string_agg(caller, ',' ORDER BY caller) FROM e WHERE e.resolved = f.id), '') AS called_by,
  EXISTS (SELECT 1 FROM calls c WHERE c.caller = f.id AND c.callee = f.name) AS is_recursive FROM funcs f""")
def call_lists(spark, d):
    out = graph.call_lists(functions(spark, d), resolved(spark, d))
    return out.select("id", "name", F.array_join("calls", ",").alias("calls"), F.array_join("called_by", ",").alias("called_by"), "is_recursive")


@query("most_connected", f"""WITH {CALL_SQL}, e AS (SELECT DISTINCT caller AS a, resolved AS b FROM res WHERE is_resolved),
dg AS (SELECT f.id, count(DISTINCT o) AS degree FROM funcs f LEFT JOIN (SELECT a AS id, b AS o FROM e UNION SELECT b, a FROM e) x USING (id) GROUP BY 1)
SELECT id, degree FROM dg ORDER BY degree DESC, id LIMIT 50""")
def most_connected(spark, d):
    res = resolved(spark, d).where("is_resolved").select("caller", F.col("resolved").alias("callee"))
    return graph.most_connected(functions(spark, d), res, 50)[0]


@query("connected_calls", f"""WITH {CALL_SQL}, e AS (SELECT caller AS a, resolved AS b FROM res WHERE is_resolved),
dg AS (SELECT f.id, count(DISTINCT o) AS degree FROM funcs f LEFT JOIN (SELECT a AS id, b AS o FROM e UNION SELECT b, a FROM e) x USING (id) GROUP BY 1),
kept AS (SELECT id FROM dg ORDER BY degree DESC, id LIMIT 50)
SELECT a AS caller, b AS callee, count(*) AS n FROM e WHERE a IN (FROM kept) AND b IN (FROM kept) GROUP BY 1, 2""")
def connected_calls(spark, d):
    res = resolved(spark, d).where("is_resolved").select("caller", F.col("resolved").alias("callee"))
    return graph.most_connected(functions(spark, d), res, 50)[1].groupBy("caller", "callee").agg(F.count("*").alias("n"))


@query("component_edges", f"""WITH {CALL_SQL},
raw AS (SELECT DISTINCT s.id AS src, CASE WHEN l_linenumber % 3 = 0 THEN t.id WHEN l_linenumber % 3 = 1 THEN t.file_path || ':' || t.name ELSE t.name END AS callee
   FROM lineitem JOIN funcs s ON s.k = l_partkey JOIN funcs t ON t.k = l_suppkey)
SELECT DISTINCT src, coalesce(f.id, (SELECT min(id) FROM funcs n WHERE n.name = callee)) AS dst FROM raw
LEFT JOIN funcs f ON f.id = callee OR f.file_path || ':' || f.name = callee""")
def component_edges(spark, d):
    f = functions(spark, d)
    src = f.select(F.col("k").alias("l_partkey"), F.col("id").alias("caller"))
    dst = f.select(F.col("k").alias("l_suppkey"), F.col("id").alias("t_id"), D.cat("file_path", "=:", "name").alias("t_old"), F.col("name").alias("t_name"))
    li = D.load(spark, d, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_linenumber") % 3).alias("v")).distinct()
    callee = F.when(F.col("v") == 0, F.col("t_id")).when(F.col("v") == 1, F.col("t_old")).otherwise(F.col("t_name"))
    named = join_large(join_large(li, src, ["l_partkey"]), dst, ["l_suppkey"]).select("caller", callee.alias("callee"))
    return graph.component_edges(f, named)


# --- dependency graph over parts ---------------------------------------------------------------------

def components(spark, d):
    k = F.col("p_partkey")
    ring = F.floor(k / 4) % 5 == 0
    step = F.when(ring & (k % 4 < 3), F.array(k + 1)).when(ring, F.array(k - F.col("p_size") % 4)).otherwise(F.array().cast("array<bigint>"))
    return D.load(spark, d, "part").select(k.alias("id"), F.concat(F.array(k * 2 + F.col("p_size"), k + 1_000_000_000), step).alias("depends_on"))


EDGE_SQL = """ed AS (SELECT DISTINCT src, dst FROM (SELECT p_partkey AS src, p_partkey * 2 + p_size AS dst FROM part
   UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN p_partkey + 1 ELSE p_partkey - p_size % 4 END FROM part
   WHERE (p_partkey // 4) % 5 = 0) WHERE dst IN (SELECT p_partkey FROM part))"""
SCC_SQL = f"""{EDGE_SQL},
reach(a, b) AS (SELECT src, dst FROM ed WHERE src <> dst UNION SELECT r.a, e.dst FROM reach r JOIN ed e ON e.src = r.b),
scc AS (SELECT x.a AS id, min(x.b) AS label FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY 1 HAVING count(*) > 1),
dag AS (SELECT e.src, e.dst FROM ed e LEFT JOIN scc s ON s.id = e.src LEFT JOIN scc t ON t.id = e.dst
   WHERE e.src <> e.dst AND (s.label IS NULL OR t.label IS NULL OR s.label <> t.label OR e.src < e.dst))"""


def part_edges(spark, d):
    return graph.dependency_graph(components(spark, d))


@query("dependency_edges", f"WITH {EDGE_SQL} SELECT src, dst FROM ed")
def dependency_edges(spark, d):
    return part_edges(spark, d)


@query("cycle_groups", f"WITH RECURSIVE {SCC_SQL} SELECT id, label FROM scc")
def cycle_groups(spark, d):
    return graph.cycle_groups(part_edges(spark, d))


@query("acyclic_edges", f"WITH RECURSIVE {SCC_SQL} SELECT src, dst FROM dag")
def acyclic_edges(spark, d):
    return graph.break_cycles(part_edges(spark, d))


@query("dependency_order", f"""WITH RECURSIVE {SCC_SQL},
lv(id, level) AS (SELECT p_partkey, 0 FROM part UNION SELECT e.src, l.level + 1 FROM lv l JOIN dag e ON e.dst = l.id)
SELECT id, max(level) AS level FROM lv GROUP BY 1""")
def dependency_order(spark, d):
    return graph.dependency_order(components(spark, d).select("id"), part_edges(spark, d))


@query("leaf_components", f"""WITH {FUNC_SQL}, e AS (SELECT DISTINCT 'src/' AS x, t.id AS dst FROM lineitem JOIN funcs t ON t.k = l_suppkey),
c AS (SELECT id FROM funcs WHERE component_type = 'class' AND NOT regexp_matches(lower(id), 'error|exception|failed|invalid'))
SELECT id FROM c WHERE (SELECT count(*) FROM c) < 400 OR id NOT IN (SELECT dst FROM e)""")
def leaf_components(spark, d):
    f = functions(spark, d)
    dst = D.load(spark, d, "lineitem").select(F.col("l_suppkey").alias("k")).distinct().join(f.select("k", "id").hint("merge"), "k").select(F.col("id").alias("dst"))
    rows = f.select("id", "component_type")
    many = graph.leaf_nodes(rows, dst, False).limit(V.LEAF_LIMIT).count() == V.LEAF_LIMIT  # then what others depend on is left out
    return graph.leaf_nodes(rows, dst, many)


@query("call_neighbours", f"""WITH {EDGE_SQL}, b AS (SELECT src AS a, dst AS z FROM ed UNION SELECT dst, src FROM ed),
n AS (SELECT a AS source, z AS id FROM b UNION SELECT x.a, y.z FROM b x JOIN b y ON y.a = x.z)
SELECT source, id FROM n WHERE source <> id""")
def call_neighbours(spark, d):
    e = part_edges(spark, d).select(F.col("src").alias("caller"), F.col("dst").alias("callee"))
    return graph.neighbours(e, components(spark, d).select(F.col("id").alias("source")), 2)


@query("callee_neighbours", f"WITH {EDGE_SQL} SELECT src AS source, dst AS id FROM ed WHERE src <> dst")
def callee_neighbours(spark, d):
    e = part_edges(spark, d).select(F.col("src").alias("caller"), F.col("dst").alias("callee"))
    return graph.neighbours(e, components(spark, d).select(F.col("id").alias("source")), 1, "out")


@query("symbol_sites", f"""WITH {CALL_SQL}, asked AS (SELECT DISTINCT callee AS name, split_part(callee, '.', -1) AS short FROM calls),
h AS (SELECT a.name, min(f.qualified_name) AS qn FROM asked a JOIN funcs f ON f.name = a.short GROUP BY 1)
SELECT h.name, f.file_path, CAST(f.k % 100 AS BIGINT) AS start_line, CAST(f.k % 100 + 9 AS BIGINT) AS end_line FROM h JOIN funcs f ON f.qualified_name = h.qn""")
def symbol_sites(spark, d):
    line = F.col("k") % 100
    nodes = functions(spark, d).withColumns({"start_line": line, "end_line": line + 9})
    return graph.symbol_sites(nodes, calls(spark, d).select(F.col("callee").alias("name")))


@query("distinct_graph_nodes", """SELECT 'C' || o_custkey AS node_id, max(o_orderkey) AS seq, arg_max(o_orderpriority, o_orderkey) AS name FROM orders GROUP BY 1""")
def distinct_graph_nodes(spark, d):
    rows = D.load(spark, d, "orders").select(D.cat("=C", "o_custkey").alias("qualified_name"), F.col("o_orderpriority").alias("name"),
                                             F.col("o_orderkey").alias("seq"))
    return graph.distinct_nodes(rows).select("node_id", "seq", "name")


TREE_SQL = """tree AS (SELECT 'R' || r_regionkey AS module, 0 AS depth, 'src/' || r_name AS path, 'R' || r_regionkey AS module_path FROM region
 UNION ALL SELECT 'N' || n_nationkey, 1, 'src/' || r_name, 'R' || r_regionkey || '/N' || n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey
 UNION ALL SELECT 'C' || c_custkey, 2, CASE WHEN c_acctbal < 0 THEN 'own/' || c_custkey ELSE 'src/' || r_name END,
   'R' || r_regionkey || '/N' || n_nationkey || '/C' || c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""


def tree(spark, d):
    none = F.lit(None).cast("string")
    r = D.load(spark, d, "region").select(D.cat("=R", "r_regionkey").alias("module"), none.alias("parent"), D.cat("=src/", "r_name").alias("path"))
    n = D.load(spark, d, "nation").select(D.cat("=N", "n_nationkey").alias("module"), D.cat("=R", "n_regionkey").alias("parent"), none.alias("path"))
    c = D.load(spark, d, "customer").select(D.cat("=C", "c_custkey").alias("module"), D.cat("=N", "c_nationkey").alias("parent"),
                                            F.when(F.col("c_acctbal") < 0, D.cat("=own/", "c_custkey")).alias("path"))
    return graph.module_tree(r.unionByName(n).unionByName(c))


@query("module_tree", f"WITH {TREE_SQL} SELECT * FROM tree")
def module_tree(spark, d):
    return tree(spark, d).select("module", "depth", "path", "module_path")


@query("module_order", f"WITH {TREE_SQL} SELECT module, depth, row_number() OVER (ORDER BY depth DESC, module_path) AS pos FROM tree")
def module_order(spark, d):
    return graph.processing_order(tree(spark, d)).select("module", "depth", F.col("pos").cast("long").alias("pos"))


@query("module_entries", f"""WITH {FUNC_SQL}
SELECT DISTINCT p_brand AS module, file_path AS file, name AS symbol FROM funcs WHERE component_type <> 'method'""")
def module_entries(spark, d):
    f = functions(spark, d)
    comp = F.when(F.col("component_type") == "method", F.col("file_path")).otherwise(D.cat("= ", "id", "= "))
    return graph.module_entries(f.select(F.col("p_brand").alias("module"), comp.alias("component")))


@query("entity_node_join", f"""WITH {FUNC_SQL},
e AS (SELECT p_brand AS module, file_path AS file, k, CASE k % 3 WHEN 0 THEN name WHEN 1 THEN 'P' || k || '.' || name ELSE 'nope' END AS symbol FROM funcs)
SELECT module, file, symbol, CASE WHEN k % 3 < 2 THEN 'n' || k END AS node_id, CASE k % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'qualified_suffix' ELSE 'file_only' END AS match_strategy,
  CASE k % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.85 ELSE 0.5 END::DOUBLE AS confidence FROM e""")
def entity_node_join(spark, d):
    f = functions(spark, d)
    k = F.col("k")
    symbol = F.when(k % 3 == 0, F.col("name")).when(k % 3 == 1, D.cat("=P", k, "=.", "name")).otherwise("nope")
    entries = f.select(F.col("p_brand").alias("module"), "file", symbol.alias("symbol"))
    nodes = f.select(D.cat("=n", k).alias("node_id"), "name", "qualified_name", "file_path", k.alias("seq"), k.alias("start_line"), (k + 5).alias("end_line"))
    return graph.join_nodes(entries, nodes).select("module", "file", "symbol", "node_id", "match_strategy", "confidence")


@query("reconciled_ids", f"""WITH {FUNC_SQL},
p AS (SELECT k, CASE k % 3 WHEN 0 THEN id WHEN 1 THEN file_path || '::made_up' ELSE 'gone/P' || k || '::x' END AS leaf FROM funcs)
SELECT leaf, id, 'exact' AS how FROM p JOIN funcs f ON f.id = leaf UNION ALL SELECT leaf, f.id, 'file' FROM p JOIN funcs f ON f.k = p.k AND p.k % 3 = 1
UNION ALL SELECT leaf, NULL, 'unresolved' FROM p WHERE k % 3 = 2""")
def reconciled_ids(spark, d):
    f = functions(spark, d)
    k = F.col("k")
    leaf = F.when(k % 3 == 0, F.col("id")).when(k % 3 == 1, D.cat("file_path", "=::made_up")).otherwise(D.cat("=gone/P", k, "=::x"))
    return graph.reconcile(f.select(leaf.alias("leaf")), f)


@query("component_listing", f"""WITH {FUNC_SQL}, g AS (SELECT 'src/' || pk || '/G' || (k // 10) AS file, id, qualified_name FROM funcs)
SELECT file, md5('# ' || file || chr(10) || string_agg(chr(9) || id || chr(10) || qualified_name || chr(10), '' ORDER BY id)) AS listing_md5 FROM g GROUP BY 1""")
def component_listing(spark, d):
    f = functions(spark, d).select(D.cat(F.regexp_replace("file_path", "/P.*$", ""), "=/G", F.floor(F.col("k") / 10)).alias("file"), "id", F.col("qualified_name").alias("source_code"))
    return graph.component_listing(f, True).select("file", F.md5("listing").alias("listing_md5"))


@query("complex_modules", f"""WITH {FUNC_SQL} SELECT c_custkey AS module, count(DISTINCT CASE WHEN l_suppkey % 2 = 0 THEN f.file_path END) > 1 AS is_complex
FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN funcs f ON f.k = l_suppkey GROUP BY 1""")
def complex_modules(spark, d):
    li = D.load(spark, d, "lineitem").join(D.load(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = li.select(F.col("o_custkey").alias("module"), F.col("l_suppkey").alias("id")).distinct()
    comp = functions(spark, d).select(F.when(F.col("k") % 2 == 0, F.col("k")).otherwise(-F.col("k")).alias("id"), "file_path")
    return graph.complex_modules(rows, comp)


@query("component_types", """
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'method' WHEN p_type IN ('PROMO', 'SMALL') THEN 'struct' ELSE 'function' END AS component_type FROM part""")
def component_types(spark, d):
    p = D.load(spark, d, "part")
    node = F.when(F.col("p_type").isin("PROMO", "SMALL"), "struct").otherwise("thing")
    return p.select("p_partkey", graph.component_type(F.col("p_size") % 4 == 0, node).alias("component_type"))


FILE_SQL = """fl AS (SELECT p_brand AS repo, p_partkey AS pos, replace(p_name, ' ', '_') || ['.py', '.java', '.md', '_test.js'][1 + p_size % 4] AS base, p_size, p_type FROM part),
files AS (SELECT repo, pos, CASE WHEN p_size % 7 = 0 THEN 'main' || base ELSE base END AS name,
   ['src/app/', '', 'lib/x/', 'docs/deep/er/'][1 + p_size % 4] || CASE WHEN p_size % 7 = 0 THEN 'main' || base ELSE base END AS path FROM fl)"""


def files(spark, d):
    p = D.load(spark, d, "part")
    size = F.col("p_size")
    base = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.get(F.array(*[F.lit(x) for x in (".py", ".java", ".md", "_test.js")]), size % 4))
    name = F.when(size % 7 == 0, F.concat(F.lit("main"), base)).otherwise(base)
    folder = F.get(F.array(*[F.lit(x) for x in ("src/app/", "", "lib/x/", "docs/deep/er/")]), size % 4)
    return p.select(F.col("p_brand").alias("repo"), F.col("p_partkey").alias("pos"), name.alias("name"), F.concat(folder, name).alias("path"))


def sql_has(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), '{w}')" for w in words) + ")"


@query("file_roles", f"""WITH {FILE_SQL}
SELECT pos, ({sql_has('name', V.ENTRY_NAMES)} AND {sql_has('name', V.ENTRY_EXTENSIONS)}) OR lower(name) IN ({', '.join(f"'{x}'" for x in V.ENTRY_FILES)}) AS entry_file,
  {sql_has('path', V.ENTRY_PATHS)} AS entry_path, {sql_has('path', V.CONNECTED_NAMES + V.SOURCE_DIRS)} AS connected,
  lower(name) IN ('main', 'index', 'app', 'server', 'start', 'init', 'run', 'new') OR contains(lower('Int Main' || name), 'int main') AS critical FROM files""")
def file_roles(spark, d):
    name, path = F.col("name"), F.col("path")
    return files(spark, d).select("pos", graph.is_entry_file(name).alias("entry_file"), graph.is_entry_path(path).alias("entry_path"),
                                  graph.is_connected_file(name, path).alias("connected"),
                                  graph.is_critical_function(name, D.cat("=Int Main", name)).alias("critical"))


@query("fallback_entry_points", f"""WITH {FILE_SQL},
t AS (SELECT *, CASE WHEN {sql_has('name', V.FALLBACK_NAMES)} OR {sql_has('path', V.ENTRY_PATHS)} THEN 1 WHEN len(string_split(path, '/')) <= 2 THEN 2 END AS tier,
  -(len(string_split(path, '/')) - 1) - CASE WHEN {sql_has('name', V.FALLBACK_FIRST)} THEN 10 ELSE 0 END
  - CASE WHEN {sql_has('name', V.FALLBACK_EXTENSIONS)} THEN 5 ELSE 0 END AS score FROM files),
r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score, pos) AS rank FROM t
   WHERE tier = (SELECT min(tier) FROM t b WHERE b.repo = t.repo)) SELECT repo, path, rank FROM r WHERE rank <= 5""")
def fallback_entry_points(spark, d):
    return graph.fallback_entry_points(files(spark, d)).select("repo", "path", F.col("rank").cast("long").alias("rank"))


@query("fallback_connected_files", f"""WITH {FILE_SQL},
t AS (SELECT *, CASE WHEN {sql_has('path', V.FALLBACK_DIRS)} THEN 1 WHEN {sql_has('name', V.ENTRY_EXTENSIONS)} AND NOT {sql_has('name', V.FALLBACK_TEST_MARKS)} THEN 2 END AS tier FROM files),
r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY tier, pos) AS rank FROM t WHERE tier IS NOT NULL) SELECT repo, path, rank FROM r WHERE rank <= 10""")
def fallback_connected_files(spark, d):
    return graph.fallback_connected_files(files(spark, d)).select("repo", "path", F.col("rank").cast("long").alias("rank"))


@query("first_readmes", """
WITH f AS (SELECT 'C' || o_custkey AS repo, ['README.txt', 'readme.md', 'NOTES', 'README.md'][1 + o_orderkey % 4] AS path, min(o_orderpriority) AS t FROM orders GROUP BY 1, 2)
SELECT repo, arg_min(t, list_position(['README.md', 'README', 'readme.md', 'README.txt'], path)) AS text FROM f WHERE path <> 'NOTES' GROUP BY 1""")
def first_readmes(spark, d):
    path = F.get(F.array(*[F.lit(x) for x in ("README.txt", "readme.md", "NOTES", "README.md")]), (F.col("o_orderkey") % 4).cast("int"))
    rows = D.load(spark, d, "orders").groupBy(D.cat("=C", "o_custkey").alias("repo"), path.alias("path")).agg(F.min("o_orderpriority").alias("text"))
    return graph.first_readme(rows)
