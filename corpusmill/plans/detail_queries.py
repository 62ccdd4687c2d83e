"""Queries on loads, stores, manifests, properties, gated references and report documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import graph, manifests, paging, reports, search, xref
from ..sources import files, shards
from ..sources.tables import calls, corpus, inline, names, table, usage
from .registry import CALLS, CORPUS, EDGES, query, values
from .table_queries import DANGEROUS
from .text_queries import NAMES

# --- loads and stores


SUFFIXES = [".apk", ".JAR", ".txt", ".dex", ".zipx", ".Class", ""]
PATHS = f"WITH files AS (SELECT p_partkey, p_size, replace(p_name, ' ', '_') || p_partkey || {SUFFIXES}[p_partkey % {len(SUFFIXES)} + 1] AS path FROM part)"
LOADABLE = "regexp_matches(lower(path), '(" + "|".join(s.replace(".", "\\.") for s in files.LOADABLE) + ")$')"


def _files(spark, d):
    """Parts as files: their names with suffixes, some of which can be loaded."""
    suffix = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("p_partkey") % len(SUFFIXES) + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", "p_size", F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_partkey"), suffix).alias("path"))


@query(PATHS + f" SELECT p_partkey, path, {LOADABLE} AS loadable FROM files")
def loadable_files(spark, d):
    return _files(spark, d).select("p_partkey", "path", files.loadable(F.col("path")).alias("loadable"))


@query(PATHS + f""", b AS (SELECT *, p_partkey % 4 = 0 AS was, p_size <= 30 AS wanted, p_size > 3 AS there FROM files), m AS (SELECT unnest(['append', 'replace']) AS mode)
  SELECT mode, path, CASE WHEN NOT wanted THEN CASE mode WHEN 'append' THEN 'kept' ELSE 'dropped' END WHEN was AND mode = 'append' THEN 'kept' WHEN NOT {LOADABLE} THEN 'unsupported'
  WHEN there THEN 'added' ELSE 'missing' END AS status FROM b, m WHERE was OR wanted""")
def multi_file_load(spark, d):
    """A load of several files into those that are loaded, in both modes."""
    own = _files(spark, d)
    loaded, asked = own.where("p_partkey % 4 = 0"), own.where("p_size <= 30").select("path", (F.col("p_size") > 3).alias("there"))
    both = [files.load_files(loaded, asked, mode).select(F.lit(mode).alias("mode"), "path", "status") for mode in ("append", "replace")]
    return both[0].unionByName(both[1])


@query(CORPUS + """ SELECT class_id, CASE WHEN code IS NULL THEN 'unreadable' WHEN class_id % 7 = 0 THEN 'cache' WHEN class_id % 11 <> 0 THEN 'store' ELSE 'unreadable' END AS origin,
  CASE WHEN class_id % 7 = 0 OR class_id % 11 <> 0 THEN length(code) END AS chars FROM corpus""")
def code_scan_chain(spark, d):
    """Code from a cache, else from a store that was written and read back with its checksums, else unreadable."""
    own = corpus(spark, d).select("class_id", "code")
    path = shards.once(spark, "code", d, lambda: own.where("class_id % 11 <> 0"), files.put_code)
    chain = files.code_chain(own, [("cache", own.where("class_id % 7 = 0")), ("store", files.get_code(spark, path))])
    return chain.select("class_id", "origin", F.length("code").cast("long").alias("chars"))


@query(EDGES + " SELECT substr(src, 1, 1) AS kind, count(*) AS n, min(dst) AS low, max(dst) AS high FROM edges GROUP BY 1")
def edges_stored(spark, d):
    """The graph as stored: edges with checksums, read only if it was stored for as many classes as there are."""
    classes = table(spark, d, "orders").count()
    path = shards.once(spark, "edges", d, lambda: graph.edges(usage(spark, d)), lambda rows, to: files.put_edges(rows, to, classes))
    found = files.get_edges(spark, path, classes)
    return found.groupBy(F.substring("src", 1, 1).alias("kind")).agg(F.count("*").alias("n"), F.min("dst").alias("low"), F.max("dst").alias("high"))


@query("""SELECT c_custkey, sha256(c_name) AS sha256, printf('%x', list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c_name, ''), lambda x: unicode(x)::BIGINT)), lambda a, b: (a * 31 + b) & 4294967295)) AS string_hash FROM customer""")
def name_hashes(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.sha2("c_name", 256).alias("sha256"), E.string_hash(F.col("c_name")).alias("string_hash"))


# --- classes, methods, names


@query("""SELECT s_suppkey AS class_id, list_filter([CASE WHEN m & 1 <> 0 THEN 'public' END, CASE WHEN m & 16 <> 0 THEN 'final' END, CASE WHEN m & 512 <> 0 THEN 'interface' END,
  CASE WHEN m & 1024 <> 0 THEN 'abstract' END, CASE WHEN m & 4096 <> 0 THEN 'synthetic' END, CASE WHEN m & 8192 <> 0 THEN 'annotation' END, CASE WHEN m & 16384 <> 0 THEN 'enum' END], lambda x: x IS NOT NULL) AS flags,
  coalesce(inner_classes, []) AS inner_classes, coalesce(fields, []) AS fields FROM (SELECT s_suppkey, s_suppkey * 7919 % 32768 AS m FROM supplier) LEFT JOIN (
    SELECT l_suppkey, list_sort(list(DISTINCT 'C' || l_suppkey || '$' || l_linenumber) FILTER (WHERE l_quantity > 45)) AS inner_classes, list_sort(list(DISTINCT p_name)) AS fields
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey) ON l_suppkey = s_suppkey""")
def class_members(spark, d):
    """A class with its access flags by name, its inner classes and the names of its fields; also one without any."""
    used = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    inner = F.when(F.col("l_quantity") > 45, F.concat(F.lit("C"), "l_suppkey", F.lit("$"), "l_linenumber"))
    per = used.groupBy("l_suppkey").agg(F.sort_array(F.collect_set(inner)).alias("inner_classes"), F.sort_array(F.collect_set("p_name")).alias("fields"))
    own = table(spark, d, "supplier").join(per, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    flags = E.access_flags(F.col("s_suppkey") * 7919 % 32768)
    return own.select(F.col("s_suppkey").alias("class_id"), flags.alias("flags"), *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("inner_classes", "fields")))


METHODS = [(0, "red widget", None), (1, "red widget", "PROMO"), (2, "no such", None), (3, "small ring", "none")]


@query(f"""WITH q AS (SELECT * FROM {values(METHODS, 'ord, name, descriptor')}), f AS (SELECT ord, count(p_partkey) AS n, list_sort(list(p_partkey) FILTER (WHERE p_partkey IS NOT NULL)) AS candidates, min(p_brand) AS source
  FROM q LEFT JOIN part ON p_name = name AND (descriptor IS NULL OR descriptor = p_type) GROUP BY ord)
  SELECT ord, CASE WHEN n = 0 THEN 'not found' WHEN n = 1 THEN 'ok' ELSE 'ambiguous' END AS status, CASE WHEN n > 1 THEN candidates END AS candidates, CASE WHEN n = 1 THEN source END AS source FROM f""")
def method_source(spark, d):
    """A method by name and, if given, descriptor: its source, or the candidates where several fit."""
    asked = inline(spark, METHODS, "ord int, name string, descriptor string")
    fits = (F.col("p_name") == F.col("name")) & F.coalesce(F.col("descriptor") == F.col("p_type"), F.col("descriptor").isNull())
    found = asked.join(table(spark, d, "part"), fits, "left").groupBy("ord").agg(F.count("p_partkey").alias("n"), F.sort_array(F.collect_list("p_partkey")).alias("candidates"), F.min("p_brand").alias("source"))
    status = F.when(F.col("n") == 0, "not found").when(F.col("n") == 1, "ok").otherwise("ambiguous")
    return found.select("ord", status.alias("status"), F.when(F.col("n") > 1, F.col("candidates")).alias("candidates"), F.when(F.col("n") == 1, F.col("source")).alias("source"))


TERMS = ["ring", "red widget", "wid*", "a.b", "#00000001"]


@query(NAMES + f""", k AS (SELECT term, name, min(kind_rank) AS r FROM names, (SELECT unnest({TERMS}) AS term) WHERE NOT regexp_matches(term, '[*?\\s.]') AND contains(lower(name), term) GROUP BY term, name)
  SELECT term, ['class', 'method', 'field'][r] AS kind, name, CASE WHEN r = 1 THEN 'display' END AS matched_on FROM k""")
def name_index_answers(spark, d):
    """Terms that the name index answers; those it refuses give no row here and go to the scan."""
    out = None
    for term in TERMS:
        found = search.indexed_names(names(spark, d), term)
        if found is not None:
            own = found.select(F.lit(term).alias("term"), "kind", "name", "matched_on")
            out = own if out is None else out.unionByName(own)
    return out


@query(r"""WITH site AS (SELECT page_id, url || chr(10) || html AS code FROM pages) SELECT page_id FROM site WHERE len(list_filter(regexp_extract_all(code, '//([^\r\n]*)', 1), lambda x: contains(lower(x), '/es/'))) > 0
  OR len(list_filter(regexp_extract_all(code, '/\*(.*?)\*/', 1, 's'), lambda x: contains(lower(x), '/es/'))) > 0""")
def comment_search_lines(spark, d):
    """By the operator's own comments: the rest of a line after //, and /* */."""
    own = table(spark, d, "pages").select("page_id", F.concat_ws("\n", "url", "html").alias("code"))
    return own.where(search.comment_matches(F.col("code"), "/ES/")).select("page_id")


@query(CORPUS + """, hit AS (SELECT count(*) AS total FROM corpus WHERE contains(lower(code), 'tion')), w AS (SELECT *, greatest(least(total - "offset", size), 0) AS returned FROM hit, (VALUES (0, 50), (50, 200), (1000000, 50)) t("offset", size))
  SELECT total, returned, returned + "offset" AS next_offset, total > returned + "offset" AS has_more FROM w""")
def search_window_info(spark, d):
    """The first window, a later one that asks for more than may be had, and one past the end."""
    hits = search.search(corpus(spark, d), "tion", names=False).select("class_id")
    return paging.search_window(hits).union(paging.search_window(hits, 50, 500)).union(paging.search_window(hits, 1_000_000))


# --- references


ASKED = [(0, "class:s3"), (1, "method:c:p7"), (2, "class"), (3, "class:nope"), (4, "field:a:b:c"), (5, "field:o:s1"), (6, "table:s3"), (7, "class:c1"), (8, "class:n2"), (9, "class:r0"), (10, "class:s3")]


@query(EDGES + f""", q AS (SELECT *, string_split(item, ':') AS p FROM {values(ASKED, 'ord, item')}),
  t AS (SELECT ord, item, CASE WHEN ord < 10 AND ((p[1] = 'class' AND len(p) = 2) OR (p[1] IN ('method', 'field') AND len(p) = 3)) THEN p[-1] END AS target FROM q)
  SELECT ord, item, CASE WHEN ord >= 10 THEN 'too many' WHEN target IS NULL THEN 'bad request' WHEN count(dst) = 0 THEN 'not found' ELSE 'ok' END AS status, count(dst) AS n, min(src) AS first
  FROM t LEFT JOIN edges ON target = dst GROUP BY ord, item, target""")
def batch_xrefs_requests(spark, d):
    return xref.batch(inline(spark, ASKED, "ord int, item string"), graph.edges(usage(spark, d)))


@query(EDGES + """, cheap AS (SELECT * FROM edges WHERE dst[1] IN ('s', 'n', 'r')), places AS (SELECT * FROM cheap WHERE NOT (dst[1] = 'n' AND src LIKE '%7') AND dst <> 'r0'), graph AS (SELECT * FROM cheap WHERE dst NOT IN ('n7', 'r0')),
  lack AS (SELECT DISTINCT c.dst, true AS l FROM cheap c LEFT JOIN places p ON c.src = p.src AND c.dst = p.dst WHERE p.src IS NULL), lack2 AS (SELECT DISTINCT c.dst, true AS l FROM cheap c LEFT JOIN graph p ON c.src = p.src AND c.dst = p.dst WHERE p.src IS NULL)
  SELECT src, dst, CASE WHEN lack.l IS NULL THEN 'use_places' WHEN lack2.l IS NULL THEN 'graph' ELSE 'live' END AS way FROM cheap LEFT JOIN lack USING (dst) LEFT JOIN lack2 USING (dst)""")
def xrefs_gated(spark, d):
    """References of each target from its use places if these cover it, else from the graph if that does, else live."""
    kind = F.substring("dst", 1, 1)
    cheap = graph.edges(usage(spark, d)).where(kind.isin("s", "n", "r"))
    places = cheap.where(~((kind == "n") & F.col("src").endswith("7")) & (F.col("dst") != "r0"))
    return xref.gated(cheap, [("use_places", places), ("graph", cheap.where(~F.col("dst").isin("n7", "r0")))])


# --- manifests and properties


COMPONENT = """CASE o_orderkey % 4 WHEN 0 THEN 'activity' WHEN 1 THEN 'service' WHEN 2 THEN 'receiver' ELSE 'provider' END"""


def _manifests(spark, d):
    """A manifest of XML for each customer: its orders are components, permissions and links."""
    at, priority, key = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, manifests.KINDS)), (key % 4 + 1).cast("int"))
    attribute = F.when(at == "F", ' exported="true"').when(at == "P", ' exported="false"').otherwise("")
    link = F.concat(F.lit('<intent-filter><data scheme="app" host="h'), key, F.when(priority == "5-LOW", '" path="/p"/></intent-filter>').otherwise('"/></intent-filter>'))
    component = F.concat(F.lit("<"), kind, F.lit(' name=".C'), key, F.lit('"'), attribute, F.lit(">"), F.when(priority.isin("1-URGENT", "5-LOW"), link).otherwise(""), F.lit("</"), kind, F.lit(">"))
    used = F.when(priority == "2-HIGH", F.concat(F.lit('<uses-permission name="'), F.when(key % 2 == 0, "CAMERA").otherwise("INTERNET"), F.lit('"/>'))).otherwise("")
    level = F.when(key % 5 != 0, F.concat(F.lit('" protectionLevel="0x'), F.lower(F.hex(key % 19)))).otherwise("")
    declared = F.when(priority == "3-MEDIUM", F.concat(F.lit('<permission name="x.P'), key, level, F.lit('"/>'))).otherwise("")
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list(F.concat(component, used, declared))), "").alias("inside"))
    own = table(spark, d, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    head = F.concat(F.lit('<manifest><uses-sdk targetSdkVersion="'), F.col("c_nationkey") + 20, F.lit('"/>'))
    return own.select(F.col("c_custkey").alias("id"), F.concat(head, F.coalesce("inside", F.lit("")), F.lit("</manifest>")).alias("xml"))


@query(f"""SELECT c_custkey AS id, {COMPONENT} AS kind, '.C' || o_orderkey AS name, CASE o_orderstatus WHEN 'F' THEN 'explicit' ELSE 'implicit' END AS why FROM orders JOIN customer ON c_custkey = o_custkey
  WHERE o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderkey % 4 <> 3 AND c_nationkey + 20 < 31)""")
def exported_components(spark, d):
    return manifests.exported(_manifests(spark, d))


@query("""SELECT o_custkey AS id, 'x.P' || o_orderkey AS name, CASE CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE (o_orderkey % 19) & 15 END WHEN 0 THEN 'normal' WHEN 1 THEN 'dangerous' WHEN 2 THEN 'signature' ELSE 'other' END AS level
  FROM orders WHERE o_orderpriority = '3-MEDIUM'""")
def custom_permissions(spark, d):
    return manifests.custom_permissions(_manifests(spark, d))


@query("SELECT DISTINCT o_custkey AS id, 'CAMERA' AS name FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderkey % 2 = 0")
def dangerous_permissions(spark, d):
    return manifests.used_permissions(_manifests(spark, d), DANGEROUS)


@query("SELECT o_custkey AS id, 'app://h' || o_orderkey || CASE o_orderpriority WHEN '5-LOW' THEN '/p' ELSE '' END AS link FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def deeplinks(spark, d):
    return manifests.deeplinks(_manifests(spark, d))


@query("""SELECT p_partkey AS id, unnest(['Manifest-Version', 'Main-Class', 'Class-Path']) AS name, unnest(['1.0', p_brand || '.Main', 'lib/' || p_name || '.jar']) AS value FROM part""")
def jar_manifest(spark, d):
    """Attributes of archives' manifests, one of them over two lines."""
    body = F.concat(F.lit("Manifest-Version: 1.0\r\nMain-Class: "), "p_brand", F.lit(".Main\nClass-Path: lib/"), F.substring("p_name", 1, 4), F.lit("\r\n "), F.expr("substring(p_name, 5)"), F.lit(".jar\n\nno attribute\n"))
    return manifests.attributes(table(spark, d, "part").select(F.col("p_partkey").alias("id"), body.alias("body")))


PROPERTIES = """WITH lines AS (SELECT o_custkey AS class_id, o_orderkey AS line_no, CASE WHEN o_orderkey % 6 = 0 THEN '# ' ELSE ' ' END || 'order.' || o_orderstatus || '.' || o_orderpriority[1] ||
  CASE WHEN o_orderkey % 2 = 0 THEN ' = ' ELSE ':' END || 'v=' || o_orderkey || ' ' AS line FROM orders),
e AS (SELECT class_id, trim(regexp_extract(trim(line, ' '), '^([^=:]+)[=:]', 1), ' ') AS name, arg_max(trim(regexp_extract(trim(line, ' '), '^[^=:]+[=:](.*)$', 1, 's'), ' '), line_no) AS value
  FROM lines WHERE regexp_matches(trim(line, ' '), '^[^#!=:][^=:]*[=:]') GROUP BY 1, 2)"""


def _properties(spark, d):
    """Customers as property files: a line for each of their orders, some of them comments, names repeat."""
    name = F.concat(F.lit("order."), "o_orderstatus", F.lit("."), F.substring("o_orderpriority", 1, 1))
    key = F.col("o_orderkey")
    line = F.concat(F.when(key % 6 == 0, "# ").otherwise(" "), name, F.when(key % 2 == 0, " = ").otherwise(":"), F.lit("v="), key, F.lit(" "))
    return manifests.properties(table(spark, d, "orders").select(F.col("o_custkey").alias("class_id"), key.alias("line_no"), line.alias("line")))


@query(PROPERTIES + ", f AS (SELECT DISTINCT class_id FROM e ORDER BY class_id LIMIT 10) SELECT class_id, count(*) AS n, list_slice(list_sort(list(name)), 1, 5) AS sample FROM e JOIN f USING (class_id) GROUP BY class_id")
def properties_summary(spark, d):
    """The first ten files; the bound is the report's."""
    return manifests.properties_summary(_properties(spark, d))


@query(PROPERTIES + " SELECT class_id, name, value FROM e WHERE contains(lower(name), 'f.1') OR contains(lower(value), 'f.1')")
def properties_search(spark, d):
    return _properties(spark, d).where(search.name_matches(F.col("name"), "F.1") | search.name_matches(F.col("value"), "F.1"))


@query(PROPERTIES + " SELECT class_id, value FROM e WHERE name = 'order.O.5'")
def properties_get(spark, d):
    return _properties(spark, d).where("name = 'order.O.5'").select("class_id", "value")


# --- reports


@query("""WITH n AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'annotation' WHEN 1 THEN 'bookmark' ELSE 'tag' END AS kind, CASE WHEN doc_id % 3 = 0 OR toxic = 1 THEN 'quality ' || quality ELSE 'L' || doc_id END AS message FROM labels WHERE doc_id IS NOT NULL)
  SELECT doc_id, '{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":{"name":"corpusmill","rules":[{"id":"annotation"},{"id":"bookmark"}]}},"results":[' ||
  coalesce(string_agg('{"ruleId":"' || kind || '","level":"note","message":{"text":"' || message || '"},"locations":[{"logicalLocation":{"fullyQualifiedName":"D' || doc_id || '"}}]}', ',') FILTER (WHERE kind <> 'tag'), '') ||
  '],"artifacts":[{"location":{"uri":"D' || doc_id || '"}}]}]}' AS document FROM n GROUP BY doc_id""")
def report_sarif_documents(spark, d):
    """A document for each class: annotations by their content, bookmarks by their note or else their label, nothing of tags."""
    at = F.col("doc_id") % 3
    kind = F.when(at == 0, "annotation").when(at == 1, "bookmark").otherwise("tag")
    message = F.when((at == 0) | (F.col("toxic") == 1), F.concat(F.lit("quality "), "quality")).otherwise(F.concat(F.lit("L"), "doc_id"))
    target = F.concat(F.lit("D"), F.col("doc_id"))
    result = F.when(kind != "tag", reports.sarif_result(kind, F.lit("note"), message, target))
    per = table(spark, d, "labels").where("doc_id is not null").groupBy("doc_id").agg(F.sort_array(F.collect_list(result)).alias("results"))
    return per.select("doc_id", reports.sarif_document(target, F.col("results"), "corpusmill").alias("document"))


@query(CALLS.replace("RECURSIVE", "") + """, e AS (SELECT caller AS src, callee AS dst FROM calls WHERE caller = 'view.1'), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
  l AS (SELECT '"' || node || '" [label="' || node || CASE WHEN node = 'view.1' THEN ' (root)' ELSE '' END || '"];' AS line FROM n UNION ALL SELECT '"' || src || '" -> "' || dst || '";' FROM e)
  SELECT 'digraph G {' || chr(10) || string_agg(line, chr(10) ORDER BY line) || chr(10) || '}' AS dot FROM l""")
def dot_document(spark, d):
    edge = calls(spark, d).where("caller = 'view.1'").select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    nodes = edge.select(F.col("src").alias("node")).union(edge.select("dst")).distinct()
    return reports.dot_document(reports.dot_lines(nodes, edge, "view.1"))


@query("""SELECT p_partkey, 'console.log(Java.use(''' || p_brand || ''').' || replace(p_name, ' ', '_') || '.value);' AS line FROM part""")
def field_scripts(spark, d):
    return table(spark, d, "part").select("p_partkey", reports.field_line(F.col("p_brand"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("line"))


@query(CORPUS + " SELECT DISTINCT 'Java.enumerateLoadedClassesSync().filter(c => c.startsWith(''' || package || '.'')).forEach(c => console.log(c));' AS line FROM corpus")
def enumeration_scripts(spark, d):
    return corpus(spark, d).select(reports.enum_line(F.col("package")).alias("line")).distinct()
