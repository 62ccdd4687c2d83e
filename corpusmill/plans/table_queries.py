"""Queries on metadata, references, graphs, side tables and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import graph, notes, paging, reports, rules, search, xref
from ..sources.files import list_files
from ..sources.tables import calls, corpus, inline, parts_graph, table, usage
from .registry import CALLS, CORPUS, EDGES, LINES, PARTS, query, values

# --- classes, methods, fields


@query(CORPUS + " SELECT full_name AS name, raw_name FROM corpus ORDER BY full_name LIMIT 100 OFFSET 200")
def all_classes_scan(spark, d):
    return paging.page(corpus(spark, d).select(F.col("full_name").alias("name"), "raw_name"), "name", offset=200)


@query(CORPUS + " SELECT class_id, raw_name, row_number() OVER (ORDER BY raw_name) - 1 AS class_no FROM corpus")
def dense_class_ids(spark, d):
    return paging.dense_ids(corpus(spark, d).select("class_id", "raw_name"), "raw_name", prefix=7)


@query(CORPUS + ", code AS (SELECT class_id FROM corpus WHERE class_id % 11 <> 0) SELECT count(*) AS total, count(*) FILTER (WHERE code.class_id IS NULL) AS unreadable FROM corpus LEFT JOIN code ON corpus.class_id = code.class_id")
def unreadable_accounting(spark, d):
    own = corpus(spark, d)
    code = own.where("class_id % 11 <> 0").select("class_id", F.lit(True).alias("stored"))
    return own.join(code, "class_id", "left").agg(F.count("*").alias("total"), F.count_if(F.col("stored").isNull()).alias("unreadable"))


@query("""SELECT c_custkey AS class_id, c_name AS name, coalesce(n_name, 'Object') AS super_name, c_mktsegment AS flags,
  coalesce(list_sort(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderpriority IS NOT NULL)), []) AS interfaces, coalesce(list_sort(list(o_orderkey) FILTER (WHERE o_orderkey IS NOT NULL)), []) AS methods,
  coalesce(list_sort(list(o_orderkey) FILTER (WHERE o_orderstatus = 'P')), []) AS native_methods FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey
  GROUP BY ALL""")
def class_info(spark, d):
    """Every class, also one without methods."""
    native = F.col("o_orderstatus") == "P"
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("interfaces"), F.sort_array(F.collect_list("o_orderkey")).alias("methods"), F.sort_array(F.collect_list(F.when(native, F.col("o_orderkey")))).alias("native_methods"))
    own = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    own = own.join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    lists = [F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in (("interfaces", "array<string>"), ("methods", "array<long>"), ("native_methods", "array<long>"))]
    return own.select(F.col("c_custkey").alias("class_id"), F.col("c_name").alias("name"), F.coalesce("n_name", F.lit("Object")).alias("super_name"), F.col("c_mktsegment").alias("flags"), *lists)


@query("SELECT p_partkey, p_brand, p_name, count(*) OVER (PARTITION BY p_brand, p_name) AS overload_count FROM part")
def overload_counts(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_brand", "p_name", F.count("*").over(Window.partitionBy("p_brand", "p_name")).alias("overload_count"))


@query("SELECT p_partkey, p_name AS field, p_type AS type, CASE WHEN p_size > 25 THEN 'public static' ELSE 'private' END AS modifiers FROM part WHERE p_brand = 'Brand#2'")
def fields_of_class(spark, d):
    return table(spark, d, "part").where("p_brand = 'Brand#2'").select("p_partkey", F.col("p_name").alias("field"), F.col("p_type").alias("type"), F.when(F.col("p_size") > 25, "public static").otherwise("private").alias("modifiers"))


SIGNATURES = [(1, "load", ["int", "java.lang.String[]"]), (2, "load", ["long[][]"]), (3, "close", ["boolean"])]


@query(
    """SELECT * FROM (VALUES (1, 'load', ['arg0: int', 'arg1: java.lang.String[]'], ['I', '[Ljava/lang/String;']), (2, 'load', ['arg0: long[][]'], ['[[J']),
  (3, 'close', ['arg0: boolean'], ['Z'])) t(id, name, params, descriptors)"""
)
def method_signature(spark, d):
    own = inline(spark, SIGNATURES, "id int, name string, args array<string>")
    params = F.transform("args", lambda a, i: F.concat(F.lit("arg"), i, F.lit(": "), a))
    return own.select("id", "name", params.alias("params"), F.transform("args", E.descriptor).alias("descriptors"))


BATCH = [(0, "part:red widget"), (1, "part:no such"), (2, "x:y:small ring"), (3, "bad")]


@query(f"""WITH b AS (SELECT * FROM {values(BATCH, 'ord, item')}), s AS (SELECT ord, item, regexp_extract(item, '^(.*):[^:]*$', 1) AS cls, regexp_extract(item, '^.*:([^:]*)$', 1) AS method FROM b),
  n AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1) SELECT ord, cls, method, n, CASE WHEN method = '' THEN 'bad request' WHEN n IS NULL THEN 'not found' ELSE 'ok' END AS status FROM s LEFT JOIN n ON method = p_name""")
def batch_methods(spark, d):
    asked = inline(spark, BATCH, "ord int, item string").select("ord", F.regexp_extract("item", "^(.*):[^:]*$", 1).alias("cls"), F.regexp_extract("item", "^.*:([^:]*)$", 1).alias("method"))
    known = table(spark, d, "part").groupBy("p_name").agg(F.count("*").alias("n"))
    found = asked.join(known, F.col("method") == F.col("p_name"), "left")
    return found.select("ord", "cls", "method", "n", F.when(F.col("method") == "", "bad request").when(F.col("n").isNull(), "not found").otherwise("ok").alias("status"))


@query("""SELECT p_partkey, p_brand AS owner, CASE WHEN p_size > 25 THEN 'public static' ELSE 'private' END || ' ' || p_type || ' ' || replace(p_name, ' ', '_') || '(int arg0)' AS signature,
  p_size > 25 AS is_public, p_size > 25 AS is_static, p_size <= 25 AS is_private, CASE WHEN p_type = 'PROMO' THEN ['Promo'] ELSE [] END AS annotations, [p_brand, 'Object'] AS hierarchy FROM part""")
def method_symbol_view(spark, d):
    """A method as one row: its signature in one line, its access as flags, its annotations and the classes above it."""
    public = F.col("p_size") > 25
    access = F.when(public, "public static").otherwise("private")
    signature = F.concat_ws(" ", access, "p_type", F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("(int arg0)")))
    marks = F.when(F.col("p_type") == "PROMO", F.array(F.lit("Promo"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "part").select(
        "p_partkey", F.col("p_brand").alias("owner"), signature.alias("signature"), public.alias("is_public"), public.alias("is_static"), (~public).alias("is_private"),
        marks.alias("annotations"), F.array(F.col("p_brand"), F.lit("Object")).alias("hierarchy"),
    )


@query("SELECT p_name, count(*) AS candidates, count(*) > 1 AS ambiguous, min(p_partkey) AS first FROM part WHERE p_name IN ('red widget', 'small ring') GROUP BY p_name")
def method_by_name(spark, d):
    hit = table(spark, d, "part").where(F.col("p_name").isin("red widget", "small ring"))
    return hit.groupBy("p_name").agg(F.count("*").alias("candidates"), (F.count("*") > 1).alias("ambiguous"), F.min("p_partkey").alias("first"))


REQUESTS = [(i, k) for i, k in enumerate([5, 17, 99999999, 3, 17])]


@query(CORPUS + f", r AS (SELECT * FROM {values(REQUESTS, 'ord, id')}) SELECT ord, id, class_id IS NOT NULL AS found, length(code) AS chars FROM r LEFT JOIN corpus ON id = class_id")
def batch_class_source(spark, d):
    asked = inline(spark, REQUESTS, "ord int, id long")
    return asked.join(corpus(spark, d), F.col("id") == F.col("class_id"), "left").select("ord", "id", F.col("class_id").isNotNull().alias("found"), F.length("code").cast("long").alias("chars"))


@query(CORPUS + " SELECT class_id, full_name FROM corpus WHERE starts_with(full_name, 'src1')")
def main_application_classes(spark, d):
    """A plain prefix, so src1 also finds src10."""
    return corpus(spark, d).where(F.col("full_name").startswith("src1")).select("class_id", "full_name")


@query(CORPUS + " SELECT class_id, full_name FROM corpus WHERE package = 'src1.en' OR starts_with(package, 'src1.en.') ORDER BY full_name LIMIT 500")
def package_classes(spark, d):
    own = corpus(spark, d).where((F.col("package") == "src1.en") | F.col("package").startswith("src1.en."))
    return own.select("class_id", "full_name").orderBy("full_name").limit(500)


@query(CORPUS + " SELECT package, count(*) AS n, starts_with(package || '.', 'src0.') OR starts_with(package || '.', 'src1.') AS library FROM corpus GROUP BY package")
def package_tree(spark, d):
    package = E.package_of(F.col("full_name"))
    return corpus(spark, d).groupBy(package.alias("package")).agg(F.count("*").alias("n")).withColumn("library", E.any_prefix(F.concat("package", F.lit(".")), rules.LIBRARY_PREFIXES))


@query("""SELECT 1 AS priority, s_name AS entry FROM supplier WHERE s_suppkey = 3 UNION ALL SELECT 2, c_name FROM customer WHERE c_mktsegment = 'MACHINERY' AND ends_with(c_name, '7')
  UNION ALL SELECT * FROM (SELECT 4, p_name || '#' || p_partkey FROM part WHERE p_type = 'PROMO' ORDER BY p_partkey LIMIT 10)""")
def entry_points(spark, d):
    first = table(spark, d, "supplier").where("s_suppkey = 3").select(F.lit(1).alias("priority"), F.col("s_name").alias("entry"))
    then = table(spark, d, "customer").where((F.col("c_mktsegment") == "MACHINERY") & F.col("c_name").endswith("7")).select(F.lit(2).alias("priority"), F.col("c_name").alias("entry"))
    last = table(spark, d, "part").where("p_type = 'PROMO'").orderBy("p_partkey").limit(10).select(F.lit(4).alias("priority"), F.concat_ws("#", "p_name", "p_partkey").alias("entry"))
    return first.unionByName(then).unionByName(last)


@query("SELECT url AS path, length(html) AS chars, ceil(strlen(html) / 8000.0)::BIGINT AS min_chunks FROM pages WHERE url = (SELECT min(url) FROM pages)")
def resource_lookup(spark, d):
    pages = table(spark, d, "pages")
    hit = pages.where(F.col("url") == pages.agg(F.min("url")).scalar())
    return hit.select(F.col("url").alias("path"), F.length("html").cast("long").alias("chars"), F.ceil(F.octet_length("html") / 8000.0).alias("min_chunks"))


# --- joins on names and references


@query(CORPUS + """, q AS (SELECT 'src1.en.D' || (class_id) AS n FROM corpus UNION ALL SELECT raw_name FROM corpus)
  SELECT n AS asked, coalesce(a.class_id, b.class_id) AS class_id FROM q LEFT JOIN corpus a ON n = a.full_name LEFT JOIN corpus b ON n = b.raw_name""")
def resolve_names(spark, d):
    """By display name, else by raw name."""
    own = corpus(spark, d)
    asked = own.select(F.concat(F.lit("src1.en.D"), "class_id").alias("asked")).union(own.select("raw_name"))
    shown, raw = own.select(F.col("full_name").alias("asked"), F.col("class_id").alias("a")), own.select(F.col("raw_name").alias("asked"), F.col("class_id").alias("b"))
    return asked.join(shown, "asked", "left").join(raw, "asked", "left").select("asked", F.coalesce("a", "b").alias("class_id"))


@query(EDGES + " SELECT src, dst FROM edges")
def edges_distinct(spark, d):
    return graph.edges(usage(spark, d))


@query(EDGES + " SELECT dst AS src, src AS dst FROM edges")
def edges_transpose(spark, d):
    return graph.transpose(graph.edges(usage(spark, d)))


@query(EDGES + " SELECT src FROM edges WHERE dst = 's3'")
def referrers(spark, d):
    return graph.edges(usage(spark, d)).where("dst = 's3'").select("src")


@query(EDGES + " SELECT dst FROM edges WHERE src = 'o17'")
def callees(spark, d):
    return graph.edges(usage(spark, d)).where("src = 'o17'").select("dst")


@query(EDGES + " SELECT substr(dst, 1, 1) AS kind, count(*) AS n_edges, count(DISTINCT dst) AS targets, count(DISTINCT src) AS sources FROM edges GROUP BY 1")
def degree_stats(spark, d):
    return graph.edges(usage(spark, d)).groupBy(F.substring("dst", 1, 1).alias("kind")).agg(F.count("*").alias("n_edges"), F.countDistinct("dst").alias("targets"), F.countDistinct("src").alias("sources"))


@query(EDGES + ", r AS (SELECT src, CASE WHEN src LIKE 'o%5' THEN '' ELSE 'raw.' || src END AS raw FROM edges WHERE starts_with(dst, 's')) SELECT count(*) AS n_rows, count(DISTINCT coalesce(nullif(raw, ''), src)) AS referrers FROM r")
def distinct_referrers(spark, d):
    raw = F.when(F.col("src").like("o%5"), "").otherwise(F.concat(F.lit("raw."), "src"))
    rows = graph.edges(usage(spark, d)).where(F.col("dst").startswith("s")).withColumn("raw", raw)
    return rows.agg(F.count("*").alias("n_rows"), F.countDistinct(F.coalesce(F.nullif("raw", F.lit("")), "src")).alias("referrers"))


@query(EDGES + ", deg AS (SELECT dst, count(*) AS n FROM edges GROUP BY dst) SELECT count(*) AS probed, round(avg(n), 6) AS mean, max(n) AS most, arg_max(dst, (n, dst)) AS busiest, count(*) FILTER (WHERE n > 10) AS over_10, floor(sum(n) / count(*) * 238000)::BIGINT AS projected FROM deg")
def usage_probe(spark, d):
    deg = graph.edges(usage(spark, d)).groupBy("dst").agg(F.count("*").alias("n"))
    return deg.agg(
        F.count("*").alias("probed"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"), F.max_by("dst", F.struct("n", "dst")).alias("busiest"),
        F.count_if(F.col("n") > 10).alias("over_10"), F.floor(F.sum("n") / F.count("*") * 238000).alias("projected"),
    )


@query(EDGES + ", cheap AS (SELECT DISTINCT 'o' || l_orderkey AS src, 's' || l_suppkey AS dst FROM lineitem), indexed AS (SELECT * FROM edges WHERE NOT (starts_with(dst, 's') AND ends_with(src, '7'))) SELECT src, dst FROM cheap EXCEPT SELECT src, dst FROM indexed")
def referrer_coverage_gap(spark, d):
    edge = graph.edges(usage(spark, d))
    indexed = edge.where(~(F.col("dst").startswith("s") & F.col("src").endswith("7")))
    return xref.missing(edge.where(F.col("dst").startswith("s") & F.col("src").startswith("o")), indexed)


@query(CORPUS + " SELECT class_id FROM corpus WHERE NOT (starts_with(full_name, 'src1') OR starts_with(full_name, 'src2'))")
def exclude_prefix_anti(spark, d):
    return corpus(spark, d).where(search.not_excluded(F.col("full_name"), "src1, src2")).select("class_id")


@query("SELECT c_custkey AS class_id, n_nationkey AS super_id FROM customer JOIN nation ON 'NATION_' || c_nationkey = n_name OR c_nationkey = n_nationkey")
def subclasses(spark, d):
    """Classes whose super class is named by its display or its raw name: two equi-joins, each pair once."""
    c, n = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "nation").select("n_nationkey", "n_name")
    by_name = c.join(n, F.concat(F.lit("NATION_"), "c_nationkey") == F.col("n_name"))
    by_raw = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return by_name.select(F.col("c_custkey").alias("class_id"), F.col("n_nationkey").alias("super_id")).union(by_raw.select("c_custkey", "n_nationkey")).distinct()


@query(PARTS.replace("RECURSIVE", "") + """, t AS (SELECT DISTINCT ON (dst) dst, src FROM graph ORDER BY dst, src) SELECT dst, src FROM t WHERE starts_with(dst, 's')""")
def batch_xrefs(spark, d):
    """For each of a batch of targets its first referrer; one grouped pass serves all."""
    return parts_graph(spark, d).where(F.col("dst").startswith("s")).groupBy("dst").agg(F.min("src").alias("src"))


WORDS = [(1, "token"), (2, "License"), (3, "the"), (4, "idiot")]


@query(LINES + f""", t AS (SELECT * FROM {values(WORDS, 'target_id, word')}), edge AS (SELECT class_id, target_id FROM corpus, t),
  hit AS (SELECT target_id, class_id, line_no, len(list_filter(string_split_regex(line, '[^\\p{{L}}\\p{{Nd}}_]'), lambda x: x = word)) AS n FROM lines JOIN edge USING (class_id) JOIN t USING (target_id) WHERE NOT starts_with(trim(line), 'import ')),
  found AS (SELECT * FROM hit WHERE n > 0)
  SELECT target_id, class_id, line_no, n FROM found UNION ALL SELECT target_id, class_id, 0, 0 FROM edge WHERE (class_id, target_id) NOT IN (SELECT class_id, target_id FROM found)""")
def use_places(spark, d):
    own = corpus(spark, d)
    edge = own.select("class_id", F.explode(F.array(*(F.lit(i) for i, _ in WORDS))).alias("target_id"))
    return xref.occurrences(edge, own, inline(spark, WORDS, "target_id int, word string"))


@query(LINES + f""", hit AS (SELECT class_id, line_no FROM lines WHERE regexp_matches(line, '(^|[^\\p{{L}}\\p{{Nd}}_])token([^\\p{{L}}\\p{{Nd}}_]|$)'))
  SELECT class_id, line_no, full_name, trim(line, ' ') AS snippet FROM hit JOIN lines USING (class_id, line_no) JOIN corpus USING (class_id)""")
def xrefs_to_class(spark, d):
    """Use places joined with their class and line."""
    own = corpus(spark, d)
    edge = own.select("class_id", F.lit(1).alias("target_id"))
    places = xref.occurrences(edge, own, inline(spark, [(1, "token")], "target_id int, word string")).where("line_no > 0")
    found = places.join(xref.lines(own), ["class_id", "line_no"]).join(own.select("class_id", "full_name"), "class_id")
    return found.select("class_id", "line_no", "full_name", F.trim("line").alias("snippet"))


@query(EDGES + " SELECT src, min(dst) AS via FROM edges WHERE dst IN ('p7', 'p8', 's3') GROUP BY src")
def xrefs_to_method(spark, d):
    """References to any override of a method, each referrer once."""
    return graph.edges(usage(spark, d)).where(F.col("dst").isin("p7", "p8", "s3")).groupBy("src").agg(F.min("dst").alias("via"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = 11")
def xrefs_to_field(spark, d):
    return table(spark, d, "lineitem").where("l_partkey = 11").select("l_orderkey", "l_linenumber")


@query(EDGES + ", a AS (SELECT DISTINCT dst FROM edges WHERE src IN ('o1', 'o2')), b AS (SELECT DISTINCT dst FROM edges WHERE src IN ('o2', 'o3')) SELECT dst FROM a UNION SELECT dst FROM b")
def override_union(spark, d):
    edge = graph.edges(usage(spark, d))
    return edge.where("src in ('o1', 'o2')").select("dst").union(edge.where("src in ('o2', 'o3')").select("dst")).distinct()


REFS_A = [("A", "m", 1, "x"), ("A", "m", 1, "x"), ("B", None, 2, "y"), ("C", "n", None, None)]
REFS_B = [("A", "m", 1, "x"), ("B", "", 2, "y"), ("D", "q", 4, "z")]


@query(f"SELECT DISTINCT coalesce(class, '') AS class, coalesce(method, '') AS method, coalesce(line, 0) AS line, coalesce(snippet, '') AS snippet FROM {values(REFS_A + REFS_B, 'class, method, line, snippet')}")
def merge_references(spark, d):
    schema = "class string, method string, line int, snippet string"
    return xref.merged(inline(spark, REFS_A, schema), inline(spark, REFS_B, schema))


@query("""WITH p AS (SELECT l_orderkey AS id, 1 AS level, min(l_linenumber) AS line FROM lineitem WHERE l_quantity > 45 GROUP BY 1 UNION ALL
  SELECT l_orderkey, 2, min(l_linenumber) FROM lineitem WHERE l_quantity > 30 GROUP BY 1 UNION ALL SELECT o_orderkey, 3, 0 FROM orders)
  SELECT id, min(level) AS level, arg_min(line, level) AS line FROM p GROUP BY id""")
def precise_references(spark, d):
    """The most precise of three levels: exact places, else method rows, else the class."""
    li = table(spark, d, "lineitem")

    def level(n: int, least: int):
        return li.where(F.col("l_quantity") > least).groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_linenumber").alias("line")).select("id", F.lit(n).alias("level"), "line")

    whole = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(3).alias("level"), F.lit(0).alias("line"))
    return level(1, 45).union(level(2, 30)).union(whole).groupBy("id").agg(F.min("level").alias("level"), F.min_by("line", "level").alias("line"))


# --- graphs


def _bfs(edges: str, start: str, depth: int, name: str = "graph") -> str:
    return f""", bfs(node, depth) AS (SELECT '{start}', 0 UNION SELECT {edges}, depth + 1 FROM bfs JOIN {name} ON node = {'dst' if edges == 'src' else 'src'} WHERE depth < {depth}),
  least AS (SELECT node, min(depth) AS depth FROM bfs GROUP BY node)"""


@query(PARTS + _bfs("src", "s1", 3) + " SELECT node, depth, (SELECT count(*) FROM least WHERE depth > 0) >= 2000 AS truncated FROM least WHERE depth > 0 ORDER BY depth, node LIMIT 2000")
def callers_chain_layers(spark, d):
    return graph.layers(graph.transpose(parts_graph(spark, d)), "s1", 3)


@query(PARTS + _bfs("dst", "s2", 3) + " SELECT node, depth, (SELECT count(*) FROM least WHERE depth > 0) >= 50 AS truncated FROM least WHERE depth > 0 ORDER BY depth, node LIMIT 50")
def callees_chain_capped(spark, d):
    return graph.layers(parts_graph(spark, d), "s2", 3, cap=50)


@query(CALLS + _bfs("callee", "click.3", 2, "calls").replace("'click.3', 0", "'click.3'::VARCHAR, 0").replace("node = src", "node = caller") + " SELECT node, depth FROM least")
def callgraph_nodes(spark, d):
    edge = calls(spark, d).select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    return graph.expanded(edge, "click.3", 2)[0]


@query(CALLS + _bfs("callee", "click.3", 2, "calls").replace("node = src", "node = caller") + " SELECT caller AS src, callee AS dst, depth FROM calls JOIN least ON caller = node WHERE depth < 2")
def callgraph_edges(spark, d):
    edge = calls(spark, d).select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    return graph.expanded(edge, "click.3", 2)[1]


@query(CALLS + " SELECT callee, n FROM calls WHERE caller = 'view.1'")
def method_callees(spark, d):
    return calls(spark, d).where("caller = 'view.1'").select("callee", "n")


FLOW = """, e AS (SELECT {a} AS src, {b} AS dst, row_number() OVER (PARTITION BY {a} ORDER BY {b}) AS r FROM calls), f AS (SELECT src, dst FROM e WHERE r <= 3),
  l1 AS (SELECT dst AS node, ['{start}', dst] AS path FROM f WHERE src = '{start}'),
  x2 AS (SELECT node, min(path) AS path FROM l1 WHERE node <> '{start}' GROUP BY node),
  l2 AS (SELECT dst AS node, list_append(path, dst) AS path FROM x2 JOIN f ON src = node),
  x3 AS (SELECT node, min(path) AS path FROM l2 WHERE node <> '{start}' AND node NOT IN (SELECT node FROM x2) GROUP BY node),
  l3 AS (SELECT dst AS node, list_append(path, dst) AS path FROM x3 JOIN f ON src = node),
  p AS (SELECT *, 1 AS depth FROM l1 UNION ALL SELECT *, 2 FROM l2 UNION ALL SELECT *, 3 FROM l3)"""


@query(CALLS + FLOW.format(a="caller", b="callee", start="click.3") + " SELECT array_to_string(path, ' > ') AS path, depth, node IN ('error.3', 'purchase.7', 'view.1', 'click.0') AS flagged FROM p")
def call_paths_to_sink(spark, d):
    edge = calls(spark, d).select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    return graph.paths(edge, "click.3", [s[2] for s in rules.SINKS] + ["click.0"], 3, fan=3)


@query(CALLS + FLOW.format(a="callee", b="caller", start="error.3") + " SELECT array_to_string(list_reverse(path), ' > ') AS path, depth, node IN ('click.1', 'signup.2') AS flagged FROM p")
def callers_to_source(spark, d):
    edge = calls(spark, d).select(F.col("callee").alias("src"), F.col("caller").alias("dst"))
    return graph.paths(edge, "error.3", ["click.1", "signup.2"], 3, fan=3, reverse=True)


@query(CALLS + f" SELECT caller, callee, n, category, severity FROM calls JOIN {values(rules.SINKS, 'category, severity, sink')} ON callee = sink")
def sink_calls(spark, d):
    return rules.sinks_of(calls(spark, d)).select("caller", "callee", "n", "category", "severity")


@query(CALLS + " SELECT caller, CASE WHEN contains(caller, 'click') THEN 'user_input' WHEN contains(caller, 'signup') THEN 'user_input' WHEN contains(caller, 'view.2') THEN 'network_input' END AS source_type, sum(n)::BIGINT AS n FROM calls GROUP BY 1, 2")
def source_match(spark, d):
    return calls(spark, d).groupBy("caller").agg(F.sum("n").alias("n")).select("caller", rules.source_of(F.col("caller")).alias("source_type"), "n")


# --- manifests


MANIFEST = """<manifest package="com.x"><uses-sdk targetSdkVersion="30"/><uses-permission name="CAMERA"/><uses-permission name="INTERNET"/>
<permission name="com.x.P" protectionLevel="0x12"/><activity name=".A" exported="true"/><activity name=".B"><intent-filter><data scheme="app" host="go"/></intent-filter></activity>
<activity name=".C" exported="false"><intent-filter/></activity><service name=".S"/><provider name=".D"><intent-filter/></provider></manifest>"""
DANGEROUS = ["CAMERA", "RECORD_AUDIO", "READ_CONTACTS"]


@query("""SELECT * FROM (VALUES ('activity', '.A', 'explicit'), ('activity', '.B', 'implicit')) t(kind, name, why)""")
def attack_surface_components(spark, d):
    """Components that other apps reach: exported, or with an intent filter and no attribute before version 31; a provider only if it says so."""
    xml = inline(spark, [(MANIFEST,)], "xml string")
    found = None
    for kind in ("activity", "service", "receiver", "provider"):
        names = F.explode(F.expr(f"xpath(xml, '//{kind}/@name')")).alias("name")
        explicit = F.expr(f"xpath(xml, '//{kind}[@exported=\"true\"]/@name')")
        implicit = F.expr(f"xpath(xml, '//{kind}[not(@exported) and intent-filter]/@name')")
        sdk = F.expr("xpath_int(xml, '//uses-sdk/@targetSdkVersion')")
        own = xml.select(F.lit(kind).alias("kind"), names, explicit.alias("e"), implicit.alias("i"), sdk.alias("sdk"))
        why = F.when(F.array_contains("e", F.col("name")), "explicit").when((F.lit(kind) != "provider") & F.col("sdk").between(1, 30) & F.array_contains("i", F.col("name")), "implicit")
        own = own.select("kind", "name", why.alias("why")).where("why is not null")
        found = own if found is None else found.union(own)
    return found


@query("SELECT * FROM (VALUES ('dangerous_permission', 'CAMERA'), ('custom_permission', 'com.x.P signature'), ('deeplink', 'app://go')) t(kind, value)")
def attack_surface_rest(spark, d):
    xml = inline(spark, [(MANIFEST,)], "xml string")
    perms = xml.select(F.explode(F.expr("xpath(xml, '//uses-permission/@name')")).alias("value")).where(F.col("value").isin(DANGEROUS)).select(F.lit("dangerous_permission").alias("kind"), "value")
    level = F.expr("conv(substr(xpath_string(xml, '//permission/@protectionLevel'), 3), 16, 10)").cast("int").bitwiseAND(0xF)
    name = F.when(level == 0, "normal").when(level == 1, "dangerous").when(level == 2, "signature").otherwise("other")
    own = xml.select(F.lit("custom_permission").alias("kind"), F.concat_ws(" ", F.expr("xpath_string(xml, '//permission/@name')"), name).alias("value"))
    link = F.concat(F.expr("xpath_string(xml, '//intent-filter/data/@scheme')"), F.lit("://"), F.expr("xpath_string(xml, '//intent-filter/data/@host')"))
    return perms.union(own).union(xml.select(F.lit("deeplink"), link))


@query("SELECT * FROM (VALUES ('activity', 3, 2), ('service', 1, 0), ('provider', 1, 1)) t(kind, n, exported)")
def manifest_digest(spark, d):
    """By regular expressions: a component counts as exported if it says so, or has a filter and doesn't deny it."""
    kinds = inline(spark, [("activity",), ("service",), ("provider",)], "kind string")
    out = None
    for (kind,) in [("activity",), ("service",), ("provider",)]:
        blocks = F.regexp_extract_all(F.lit(MANIFEST), F.lit(rf"(?s)<{kind}\b[^>]*?/>|<{kind}\b.*?</{kind}>"), F.lit(0))
        exported = F.filter(blocks, lambda b: b.contains('exported="true"') | (b.contains("<intent-filter") & ~b.contains('exported="false"')))
        own = kinds.where(F.col("kind") == kind).select("kind", F.size(blocks).alias("n"), F.size(exported).alias("exported"))
        out = own if out is None else out.union(own)
    return out


# --- notes, renames, mappings


@query("""SELECT doc_id, quality, toxic, row_number() OVER (ORDER BY doc_id DESC) AS nth FROM labels WHERE doc_id IS NOT NULL QUALIFY nth <= 20""")
def notes_latest_first(spark, d):
    return paging.top_n(table(spark, d, "labels").where("doc_id is not null").orderBy(F.desc("doc_id")).limit(20).withColumn("all", F.lit(1)), ["all"], [F.desc("doc_id")], 20).select("doc_id", "quality", "toxic", F.col("rank").alias("nth"))


@query("""WITH log AS (SELECT user_id AS key, event_id AS seq, event_type AS value, event_type = 'error' AS deleted FROM events) SELECT key, max(seq) AS seq, arg_max(value, seq) AS value FROM log GROUP BY key HAVING NOT arg_max(deleted, seq)""")
def notes_current(spark, d):
    """Notes as a log; an entry of type error deletes its key's."""
    e = table(spark, d, "events")
    log = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("value"), (F.col("event_type") == "error").alias("deleted"))
    return notes.current(log, ["key"])


@query("SELECT source, count(*) AS n_notes, sum(quality)::BIGINT AS good, list_sort(list(doc_id) FILTER (WHERE toxic = 1)) AS flagged FROM documents JOIN labels USING (doc_id) GROUP BY source")
def notes_rollup(spark, d):
    own = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    return own.groupBy("source").agg(F.count("*").alias("n_notes"), F.sum("quality").alias("good"), F.sort_array(F.collect_list(F.when(F.col("toxic") == 1, F.col("doc_id")))).alias("flagged")).withColumn("flagged", F.when(F.size("flagged") > 0, F.col("flagged")))




@query(CORPUS + ", log AS (SELECT 'x.' || source || '.d' || doc_id AS key, 'R' || (doc_id * 7 % 13) AS new_name, doc_id AS seq FROM documents WHERE doc_id % 9 = 0 UNION ALL SELECT 'x.' || source || '.d' || doc_id, 'S' || doc_id, doc_id + 1 FROM documents WHERE doc_id % 18 = 0) SELECT class_id, raw_name, coalesce(arg_max(new_name, seq), raw_name) AS alias FROM corpus LEFT JOIN log ON raw_name = key GROUP BY class_id, raw_name")
def rename_latest(spark, d):
    own = corpus(spark, d).select("class_id", "raw_name")
    log = _rename_log(own)
    return notes.renamed(own, log)


def _rename_log(own):
    first = own.where("class_id % 9 = 0").select(F.col("raw_name").alias("key"), F.concat(F.lit("R"), F.col("class_id") * 7 % 13).alias("new_name"), F.col("class_id").alias("seq"))
    return first.union(own.where("class_id % 18 = 0").select("raw_name", F.concat(F.lit("S"), "class_id"), F.col("class_id") + 1))


@query("SELECT 'class' AS kind, 'x.' || source || '.d' || doc_id AS raw_name, CASE WHEN doc_id % 18 = 0 THEN 'S' || doc_id ELSE 'R' || (doc_id * 7 % 13) END AS alias FROM documents WHERE doc_id % 9 = 0")
def rename_export(spark, d):
    own = corpus(spark, d).select("class_id", "raw_name")
    return notes.renamed(own, _rename_log(own)).where("raw_name <> alias").select(F.lit("class").alias("kind"), "raw_name", "alias")


@query(CORPUS + " SELECT class_id, CASE WHEN full_name = 'src1' OR starts_with(full_name, 'src1.') THEN 'app.core' || substr(full_name, 5) ELSE full_name END AS alias FROM corpus")
def rename_package(spark, d):
    return notes.move_package(corpus(spark, d), "src1", "app.core").select("class_id", "alias")


MAPPING = [("# a comment",), ("com.acme.Card -> a.a:",), ("    int number -> b",), ("com.acme.Card$Meta -> a.b:",), ("",), ("com.acme.Pay -> com.acme.Pay:",)]


@query("SELECT * FROM (VALUES ('com.acme.Card', 'a.a'), ('com.acme.Card$Meta', 'a.b'), ('com.acme.Pay', 'com.acme.Pay')) t(original, obfuscated)")
def mapping_parse(spark, d):
    return notes.parse_mapping(inline(spark, MAPPING, "line string"))


@query("""SELECT * FROM (VALUES ('class', 'NATION_1', 'Foo', 'applied'), ('class', 'nope', 'Foo', 'not found'), ('method', 'NATION_2', '1bad', 'bad name'), ('table', 'NATION_3', 'X', 'bad kind')) t(kind, key, new_name, status)""")
def mapping_import(spark, d):
    rows = [("class", "NATION_1", "Foo"), ("class", "nope", "Foo"), ("method", "NATION_2", "1bad"), ("table", "NATION_3", "X")]
    return notes.import_mapping(inline(spark, rows, "kind string, key string, new_name string"), table(spark, d, "nation").select(F.col("n_name").alias("key")))


@query(EDGES + ", touched AS (SELECT DISTINCT src FROM edges WHERE dst IN ('c5', 'p9') UNION SELECT unnest(['c5', 'p9'])) SELECT src AS node FROM touched")
def reindex_after_rename(spark, d):
    """What a rename of two nodes makes stale: they and their referrers."""
    gone = inline(spark, [("c5",), ("p9",)], "node string")
    return graph.edges(usage(spark, d)).join(gone, F.col("dst") == F.col("node"), "left_semi").select(F.col("src").alias("node")).union(gone).distinct()


# --- files, plans, status


CACHE = [("h1", 40, 5), ("h2", 30, 1), ("h3", 20, None), ("h4", 50, 9), ("h5", 10, 3)]


@query(f"""WITH g AS (SELECT * FROM {values(CACHE, 'hash, size, last_used')}), o AS (SELECT *, coalesce(sum(size) OVER (ORDER BY last_used NULLS FIRST, hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM g WHERE hash <> 'h1')
  SELECT hash, size, last_used FROM o WHERE 150 > 100 AND 150 - freed > 80""")
def artifact_lru_eviction(spark, d):
    return paging.evict(inline(spark, CACHE, "hash string, size long, last_used long"), 100, "h1")


PLANS = [(100, 0, 8388608), (30, 0, 10), (25, 0, 10), (25, 12, 10), (100, 100, 10), (100, 150, 10), (0, 0, 10), (3, 0, 1)]


@query(f"""WITH p AS (SELECT total::BIGINT AS total, start::BIGINT AS start, chunk::BIGINT AS chunk, least(start, total)::BIGINT AS s FROM {values(PLANS, 'total, start, chunk')}),
  x AS (SELECT *, unnest(generate_series(0, greatest(ceil((total - s) / chunk)::BIGINT, 1) - 1)) AS i FROM p)
  SELECT total, start, chunk, s + i * chunk AS "offset", least(chunk, total - s - i * chunk) AS len, s + i * chunk + least(chunk, total - s - i * chunk) >= total AS is_final FROM x""")
def chunk_plan(spark, d):
    return paging.chunk_plan(inline(spark, PLANS, "total long, start long, chunk long"))


@query("SELECT i AS attempt, (200 * power(2, i - 1))::BIGINT AS delay_ms FROM generate_series(1, 6) t(i)")
def retry_backoff(spark, d):
    return spark.range(1, 7).select(F.col("id").alias("attempt"), (F.lit(200) * F.pow(F.lit(2), F.col("id") - 1)).cast("long").alias("delay_ms"))


MANIFESTS = [("h1", '{"hash": "h1", "classes": 1000, "edges": 5}'), ("h2", '{"hash": "zz", "classes": 3}'), ("h3", "{broken")]


@query("SELECT * FROM (VALUES ('h1', true, NULL), ('h2', false, 'hash differs'), ('h3', false, 'unreadable')) t(hash, complete, reason)")
def manifest_verify(spark, d):
    own = inline(spark, MANIFESTS, "hash string, body string").withColumn("m", F.from_json("body", "hash string, classes long"))
    reason = F.when(F.col("m.hash").isNull(), "unreadable").when(F.col("m.hash") != F.col("hash"), "hash differs")
    return own.select("hash", reason.isNull().alias("complete"), reason.alias("reason"))


SESSIONS = [("b.json", '{"name": "b", "notes": "' + "n" * 150 + '"}'), ("a.json", '{"name": "a", "notes": "short"}'), ("c.json", "oops")]


@query("SELECT * FROM (VALUES ('a.json', 'a', 'short'), ('b.json', 'b', '" + "n" * 100 + "')) t(file, name, preview)")
def session_list(spark, d):
    own = inline(spark, SESSIONS, "file string, body string").withColumn("s", F.from_json("body", "name string, notes string"))
    return own.where("s.name is not null").select("file", "s.name", F.substring("s.notes", 1, 100).alias("preview")).orderBy("file")


SERVICES = [("META-INF/services/a.Api", "# impls\na.One # first\n\na.Two"), ("META-INF/services/b.Api", "b.Only")]


@query(f"""WITH f AS (SELECT * FROM {values(SERVICES, 'path, body')}), l AS (SELECT path, trim(regexp_replace(unnest(string_split(body, chr(10))), '#.*', '')) AS impl FROM f)
  SELECT replace(path, 'META-INF/services/', '') AS service, impl FROM l WHERE impl <> ''""")
def jar_services(spark, d):
    lines = inline(spark, SERVICES, "path string, body string").select("path", F.explode(F.split("body", "\n")).alias("line"))
    return lines.select(F.replace("path", F.lit("META-INF/services/"), F.lit("")).alias("service"), F.trim(F.regexp_replace("line", "#.*", "")).alias("impl")).where("impl <> ''")


JARS = [("lib/okhttp-4.9.1.jar",), ("lib/spring-core-5-3.2.jar",), ("lib/plain.jar",), ("lib/guava-31.1-jre.jar",)]


@query("SELECT * FROM (VALUES ('okhttp', '4.9.1'), ('spring-core-5', '3.2'), ('plain', ''), ('guava', '31.1-jre')) t(name, version)")
def jar_dependencies(spark, d):
    """Name and version part at the last dash before a digit."""
    base = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.jar$", "")
    name = F.regexp_extract(base, r"^(.*)-(\d.*?)$", 1)
    return inline(spark, JARS, "path string").select(F.when(name == "", base).otherwise(name).alias("name"), F.regexp_extract(base, r"^(.*)-(\d.*?)$", 2).alias("version"))


@query()
def list_available_files(spark, d):
    return list_files(spark, d, "*.parquet", suffixes=[".parquet"])


@query("SELECT * FROM (VALUES ('decompile', 29.0), ('trigrams', 60.0), ('graph', 62.5), ('use_places', 81.5)) t(phase, percent)")
def warmup_progress(spark, d):
    """Progress over phases of fixed weight: .58, .04, .01 and .37; the phases before count in full."""
    rows = [("decompile", 0, 0.58, 0.5), ("trigrams", 1, 0.04, 0.5), ("graph", 2, 0.01, 0.5), ("use_places", 3, 0.37, 0.5)]
    before = F.coalesce(F.sum("weight").over(Window.orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    own = inline(spark, rows, "phase string, nth int, weight double, done double")
    return own.select("phase", F.round((before + F.col("weight") * F.col("done")) * 100, 4).alias("percent"))


@query("SELECT cores, heap_mb, least(greatest(least(cores // 2, heap_mb // 1024), 1), 24)::INT AS workers FROM (VALUES (48, 9832), (8, 4096), (2, 512)) t(cores, heap_mb)")
def worker_sizing(spark, d):
    rows = inline(spark, [(48, 9832), (8, 4096), (2, 512)], "cores int, heap_mb int")
    return rows.select("cores", "heap_mb", paging.clamp(F.least(F.floor(F.col("cores") / 2), F.floor(F.col("heap_mb") / 1024)), 1, 24).cast("int").alias("workers"))


# --- reports


@query("SELECT p_partkey, '| ' || p_partkey || ' | ' || replace(replace(p_name, '|', '\\|'), chr(10), ' ') || ' | ' || replace(p_type, '|', '\\|') || ' |' AS line FROM part")
def report_markdown_rows(spark, d):
    return reports.markdown_rows(table(spark, d, "part"), "p_partkey", ["p_partkey", "p_name", "p_type"])


@query("""SELECT '| region | nations |' || chr(10) || '|---|---|' || chr(10) || string_agg(line, chr(10) ORDER BY r_regionkey) AS report FROM
  (SELECT r_regionkey, '| ' || r_name || ' | ' || count(*) || ' |' AS line FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name)""")
def report_markdown(spark, d):
    own = table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_regionkey", "r_name").agg(F.count("*").alias("n"))
    return reports.markdown(reports.markdown_rows(own, "r_regionkey", ["r_name", "n"]), "r_regionkey", ["region", "nations"])


@query("""SELECT r_regionkey, '{"region":"' || r_name || '","nations":[' || string_agg('"' || n_name || '"', ',' ORDER BY n_name) || ']}' AS json FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""")
def report_json(spark, d):
    own = table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    own = own.groupBy("r_regionkey", "r_name").agg(F.sort_array(F.collect_list("n_name")).alias("nations"))
    return own.select("r_regionkey", F.to_json(F.struct(F.col("r_name").alias("region"), "nations")).alias("json"))


@query("""SELECT doc_id, '{"ruleId":"bookmark","level":"note","message":{"text":"quality ' || quality || '"},"locations":[{"logicalLocation":{"fullyQualifiedName":"D' || doc_id || '"}}]}' AS result FROM labels WHERE toxic = 1""")
def report_sarif_rows(spark, d):
    own = table(spark, d, "labels").where("toxic = 1")
    message, target = F.concat(F.lit("quality "), F.col("quality")), F.concat(F.lit("D"), F.col("doc_id"))
    return own.select("doc_id", reports.sarif_result(F.lit("bookmark"), F.lit("note"), message, target).alias("result"))


@query(CALLS.replace("RECURSIVE", "") + """, e AS (SELECT caller AS src, callee AS dst FROM calls WHERE caller = 'view.1'), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
  SELECT '"' || node || '" [label="' || node || CASE WHEN node = 'view.1' THEN ' (root)' ELSE '' END || '"];' AS line FROM n UNION ALL SELECT '"' || src || '" -> "' || dst || '";' FROM e""")
def dot_graph(spark, d):
    edge = calls(spark, d).where("caller = 'view.1'").select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    nodes = edge.select(F.col("src").alias("node")).union(edge.select("dst")).distinct()
    return reports.dot_lines(nodes, edge, "view.1")


@query("SELECT p_partkey, 'Java.use(''' || p_brand || ''').' || replace(p_name, ' ', '_') || '.overload(''' || p_type || ''', ''int'').implementation = trace;' AS line FROM part")
def hook_scripts(spark, d):
    own = table(spark, d, "part")
    return own.select("p_partkey", reports.hook_line(F.col("p_brand"), F.replace("p_name", F.lit(" "), F.lit("_")), F.array("p_type", F.lit("int"))).alias("line"))
