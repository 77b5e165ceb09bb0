"""Queries over the reference's own operators, and the same results in SQL.

The SQL never parses anything: it derives each result from the columns that the
analysed sources were made from (``corpora``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.tables import LANGUAGES
from ..operators import assignments, depsusage, parse, signatures
from ..operators.inheritance import InheritanceFrame
from ..sources import files as S
from . import corpora, plugins
from .corpora import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def joined(c: str) -> Column:
    return F.array_join(c, "|")


# -- sources and languages --------------------------------------------------------------
@query("SELECT 'track' AS callee, count(*) AS calls FROM pages")
def js_script_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls in the scripts of pages, for each callee: tokens alone, without parsing."""
    script = F.explode(F.regexp_extract_all("html", F.lit(r"(?s)<script[^>]*>(.*?)</script>"), F.lit(1)))
    toks = table(spark, sf_dir, "pages").select(script.alias("js")).select(F.filter(C.tokens(F.col("js"), "javascript"), lambda t: ~(t.rlike(r"^\s") | C.is_comment(t, "javascript"))).alias("t"))
    name = r"^[\p{L}_$][\p{L}\p{N}_$]*$"
    words = ("function", "if", "for", "while", "switch", "catch", "return", "typeof", "await", "new")
    t = F.col("t")
    calls = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (F.get(t, i + 1) == "(") & F.get(t, i).rlike(name) & ~F.get(t, i).isin(*words) & (F.coalesce(F.get(t, i - 1), F.lit("")) != "function"))
    owner = lambda i: F.when(F.coalesce(F.get(t, i - 1), F.lit("")) == ".", F.concat(F.coalesce(F.get(t, i - 2), F.lit("")), F.lit("//"))).otherwise("")
    callees = toks.filter(F.size("t") > 1).select(F.explode(F.transform(calls, lambda i: F.concat(owner(i), F.get(t, i)))).alias("callee"))
    return callees.groupBy("callee").agg(F.count("*").alias("calls"))


_EXTENSIONS = "CASE p_partkey % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.mjs' WHEN 3 THEN '.cjs' WHEN 4 THEN '.java' WHEN 5 THEN '.go' WHEN 6 THEN '.PY' ELSE '' END"


@query("SELECT CASE p_partkey % 8 WHEN 0 THEN 'python' WHEN 4 THEN 'java' WHEN 5 THEN 'go' ELSE 'javascript' END AS language, CASE WHEN p_partkey % 8 = 5 THEN false ELSE true END AS object_oriented, count(*) AS files FROM part WHERE p_partkey % 8 < 6 GROUP BY 1, 2")
def scan_language_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.expr(f"concat('a.b/n', p_partkey, {_EXTENSIONS})").alias("path")).withColumn("code", S.language_of(F.col("path")))
    return names.join(F.broadcast(S.languages(spark)), "code").groupBy(F.col("code").alias("language"), "object_oriented").agg(F.count("*").alias("files"))


@query("SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '/fr/|/de/') AND NOT regexp_matches(url, 'html$')")
def scan_exclude_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"))
    return S.excluded(rows, ["/fr/|/de/", "html$"]).select("page_id", F.col("path").alias("url"))


@query("SELECT false AS is_import, 'python' AS language, count(DISTINCT p_brand || '/' || CAST(p_partkey // 100 AS VARCHAR)) AS files FROM part UNION ALL SELECT true, 'javascript', count(DISTINCT o_orderkey // 100) FROM orders")
def scan_app_then_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = corpora.python_imports(spark, sf_dir).unionByName(corpora.javascript_imports(spark, sf_dir).withColumn("is_import", F.lit(True)))
    return both.groupBy("is_import", "language").agg(F.count("*").alias("files"))


@query("SELECT 'src/Brand2/0.py' AS path, false AS is_import, count(*) AS imports FROM part WHERE p_brand = 'Brand#2' AND p_partkey < 100")
def find_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = corpora.python_imports(spark, sf_dir)
    both = both.withColumn("is_import", F.lit(True)).unionByName(both)
    found = S.find_file(both, "src/Brand2/0.py")
    return parse.imports(found).groupBy("path").agg(F.count("*").alias("imports")).select("path", F.lit(False).alias("is_import"), "imports")


# -- tokens, syntax, comments --------------------------------------------------------------
@query("SELECT doc_id, true AS python, true AS javascript, true AS java, true AS go FROM documents")
def tokens_lossless(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    same = [(F.array_join(C.tokens(F.coalesce("text", F.lit("")), x), "") == F.coalesce("text", F.lit(""))).alias(x) for x in LANGUAGES]
    return docs.select("doc_id", *same)


_PY_LINES = """SELECT p_partkey AS k, p_brand, p_size, lower(p_type) AS t, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b,
 'src/' || replace(p_brand, '#', '') || '/' || CAST(p_partkey // 100 AS VARCHAR) || '.py' AS path,
 p_partkey % 7 = 0 AS w, p_partkey % 7 <> 0 AND p_partkey % 5 = 0 AS m, p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 2 = 0 AS u FROM part"""


@query(f"WITH x AS ({_PY_LINES}) SELECT path, count(*) + count(*) FILTER (WHERE u) AS lines FROM x GROUP BY path")
def tokens_count_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpora.python_imports(spark, sf_dir).select("path", F.size(F.filter(C.tokens(F.col("content"), "python"), lambda t: t == "\n")).alias("n"))
    return rows.select("path", (F.col("n") + 1).cast("bigint").alias("lines"))


@query(f"WITH x AS ({_PY_LINES}) SELECT path, count(*) AS nodes, count(*) FILTER (WHERE u) AS calls FROM x GROUP BY path")
def cst_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern over syntax nodes: statements at the top that import, and calls by attribute below statements."""
    nodes = parse.cst(corpora.python_imports(spark, sf_dir))
    tops = nodes.filter(F.col("type").isin("import_statement", "import_from_statement")).groupBy("path").agg(F.count("*").alias("nodes"))
    call = nodes.filter("type = 'call'").alias("c").join(nodes.filter("type = 'attribute'").alias("a"), (F.col("c.path") == F.col("a.path")) & (F.col("c.node_id") == F.col("a.parent_id")))
    return tops.join(call.groupBy("c.path").agg(F.count("*").alias("calls")), "path", "left").select("path", "nodes", F.coalesce("calls", F.lit(0)).cast("bigint").alias("calls"))


@query(f"""WITH x AS ({_PY_LINES}) SELECT path, string_agg(CASE WHEN w THEN 'from ' || t || '.' || a || ' import *' WHEN m THEN 'import ' || t || ' as m' || k
 WHEN u THEN 'from ' || t || '.' || a || ' import ' || b || ' as p' || k || chr(10) || 'p' || k || '.run(' || p_size || ')  ' ELSE 'from ' || t || '.' || a || ' import ' || b || ' as p' || k END, chr(10) ORDER BY k) AS stripped FROM x GROUP BY path""")
def strip_comments_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.strip_comments(corpora.python_imports(spark, sf_dir)).select("path", "stripped")


_JS_LINES = """SELECT o_orderkey AS k, o_custkey AS c, lower(o_orderstatus) AS s, 'web/b' || CAST(o_orderkey // 100 AS VARCHAR) || '.js' AS path, o_orderkey % 3 AS q, o_orderkey % 2 = 0 AS u FROM orders"""
_JS_MODULE = "CASE q WHEN 0 THEN '@' || s || '/pkg-' || c WHEN 1 THEN 'm/' || c ELSE 'lib' || c END"


@query(f"""WITH x AS ({_JS_LINES}) SELECT path, string_agg(CASE q WHEN 0 THEN 'const v' || k || ' = require("@' || s || '/pkg-' || c || '");' WHEN 1 THEN 'import {{ a' || k || ' as v' || k || ' }} from "m/' || c || '";' ELSE 'import v' || k || ' from "lib' || c || '";' END
 || CASE WHEN u THEN chr(10) || 'v' || k || '.go(' || c || '); ' ELSE '' END, chr(10) ORDER BY k) AS stripped FROM x GROUP BY path""")
def strip_comments_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JavaScript's comments are tokens: no parsing, no Python."""
    rows = corpora.javascript_imports(spark, sf_dir)
    return rows.select("path", C.without_comments(F.col("content"), "javascript").alias("stripped"))


# -- imports -----------------------------------------------------------------------------
def _imports(files: DataFrame) -> DataFrame:
    return parse.imports(files).select("path", "module_name", "module_item", "module_alias", "is_wildcard")


@query(f"WITH x AS ({_PY_LINES}) SELECT path, CASE WHEN m THEN t ELSE t || '.' || a END AS module_name, CASE WHEN w OR m THEN '' ELSE b END AS module_item, CASE WHEN w THEN '' WHEN m THEN 'm' || k ELSE 'p' || k END AS module_alias, w AS is_wildcard FROM x")
def imports_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _imports(corpora.python_imports(spark, sf_dir))


@query(f"WITH x AS ({_JS_LINES}) SELECT path, {_JS_MODULE} AS module_name, CASE WHEN q = 1 THEN 'a' || k ELSE '' END AS module_item, 'v' || k AS module_alias, false AS is_wildcard FROM x")
def imports_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _imports(corpora.javascript_imports(spark, sf_dir))


_GO_LINES = """SELECT s_suppkey AS k, s_nationkey AS n, 'go/n' || s_nationkey || '_' || CAST(s_suppkey // 1000 AS VARCHAR) || '.go' AS path, s_suppkey % 4 AS q,
 CASE s_suppkey % 4 WHEN 0 THEN 'github.com/o' || s_nationkey || '/r' || s_suppkey || '/v2' WHEN 1 THEN 'github.com/o' || s_nationkey || '/r' || s_suppkey WHEN 2 THEN 'math/m' || s_suppkey ELSE 'net/http' || s_suppkey END AS module FROM supplier"""


@query(f"""WITH x AS ({_GO_LINES}) SELECT path, '"' || module || '"' AS module_name, '' AS module_item, CASE q WHEN 0 THEN 'a' || k WHEN 3 THEN '"' || module || '"' ELSE '' END AS module_alias, q IN (1, 2) AS is_wildcard FROM x""")
def imports_go(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _imports(corpora.go_imports(spark, sf_dir))


@query("""SELECT 'jv/' || CAST(c_custkey // 100 AS VARCHAR) || '.java' AS path, CASE c_custkey % 4 WHEN 0 THEN 'java.util.C' || c_custkey WHEN 1 THEN 'com.acme.' || lower(c_mktsegment) || '.C' || c_custkey WHEN 2 THEN 'org.x' || c_custkey ELSE 'java.lang.Math.m' || c_custkey END AS module_name, '' AS module_item,
 CASE c_custkey % 4 WHEN 2 THEN '' WHEN 3 THEN 'm' || c_custkey ELSE 'C' || c_custkey END AS module_alias, c_custkey % 4 = 2 AS is_wildcard FROM customer""")
def imports_java(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _imports(corpora.java_imports(spark, sf_dir))


@query(f"WITH x AS ({_PY_LINES}) SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY CASE WHEN w OR m THEN 0 ELSE 1 END, k) - 1 AS INTEGER) AS ord, CASE WHEN w THEN '' WHEN m THEN 'm' || k ELSE 'p' || k END AS module_alias FROM x")
def import_order_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.imports(corpora.python_imports(spark, sf_dir)).select("path", "ord", "module_alias")


@query(f"WITH x AS ({_GO_LINES}) SELECT path, module AS module_name, CASE q WHEN 0 THEN 'a' || k WHEN 3 THEN 'http' || k ELSE '' END AS module_alias, CASE q WHEN 0 THEN 'a' || k WHEN 3 THEN 'http' || k ELSE module END AS identifier FROM x")
def import_normalise_go(spark: SparkSession, sf_dir: str) -> DataFrame:
    module, item, alias = C.normalised(F.col("module_name"), F.col("module_item"), F.col("module_alias"), "go")
    rows = parse.imports(corpora.go_imports(spark, sf_dir)).select("path", module.alias("module_name"), item.alias("item"), alias.alias("module_alias"))
    return rows.select("path", "module_name", "module_alias", C.identifier_key(F.col("module_name"), F.col("item"), F.col("module_alias")).alias("identifier"))


@query(f"WITH x AS ({_PY_LINES}) SELECT path, t || '_' || p_size AS identifier, max(k) AS last_key FROM x GROUP BY 1, 2")
def import_identifier_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of imports with one identifier the last stays."""
    line = corpora.text("from lib{k} import x as {t}_{s}", **corpora.PART)
    rows = parse.imports(corpora.files(table(spark, sf_dir, "part"), F.expr(corpora.PART_PATH["py"]), "p_partkey", line))
    key = C.identifier_key(F.col("module_name"), F.col("module_item"), F.col("module_alias"))
    last = S.latest(rows.withColumn("identifier", key), ["path", "identifier"], "ord")
    return last.select("path", "identifier", F.substring("module_name", 4, 100).cast("bigint").alias("last_key"))


# -- functions ------------------------------------------------------------------------------
def _functions(files: DataFrame) -> DataFrame:
    return parse.functions(files).select("path", "name", joined("parameters").alias("parameters"), "function_type", "access", "parent_class", joined("decorators").alias("decorators"), "is_static", "is_async", "is_abstract")


_F_PY = "'src/' || replace(p_brand, '#', '') || '/' || CAST(p_partkey // 100 AS VARCHAR) || '.py'"


@query(f"""SELECT {_F_PY} AS path, CASE p_partkey % 4 WHEN 2 THEN '__init__' WHEN 3 THEN 's' || p_partkey ELSE 'f' || p_partkey END AS name, CASE p_partkey % 4 WHEN 0 THEN 'a|b=' || p_size WHEN 1 THEN 'a: int' WHEN 2 THEN 'self|x' ELSE 'a' END AS parameters,
 CASE p_partkey % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'async' WHEN 2 THEN 'constructor' ELSE 'static_method' END AS function_type, 'public' AS access, CASE WHEN p_partkey % 4 >= 2 THEN 'C' || p_partkey ELSE '' END AS parent_class,
 CASE WHEN p_partkey % 4 = 3 THEN '@staticmethod' ELSE '' END AS decorators, p_partkey % 4 = 3 AS is_static, p_partkey % 4 = 1 AS is_async, false AS is_abstract FROM part""")
def functions_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _functions(corpora.python_functions(spark, sf_dir))


@query("""SELECT 'web/' || CAST(p_partkey // 100 AS VARCHAR) || '.js' AS path, CASE p_partkey % 4 WHEN 2 THEN 'constructor' WHEN 3 THEN 'm' || p_partkey ELSE 'f' || p_partkey END AS name, CASE p_partkey % 4 WHEN 0 THEN 'a|b = ' || p_size WHEN 1 THEN 'x' WHEN 2 THEN 'y' ELSE '' END AS parameters,
 CASE p_partkey % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'arrow' WHEN 2 THEN 'constructor' ELSE 'async' END AS function_type, 'public' AS access, CASE WHEN p_partkey % 4 >= 2 THEN 'C' || p_partkey ELSE '' END AS parent_class, '' AS decorators, false AS is_static, p_partkey % 4 = 3 AS is_async, false AS is_abstract FROM part""")
def functions_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _functions(corpora.javascript_functions(spark, sf_dir))


@query("""SELECT 'go/' || CAST(p_partkey // 100 AS VARCHAR) || '.go' AS path, CASE p_partkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'f' ELSE 'M' END || p_partkey AS name, CASE p_partkey % 3 WHEN 0 THEN 'a int' WHEN 1 THEN '' ELSE 'n string' END AS parameters,
 CASE WHEN p_partkey % 3 = 2 THEN 'method' ELSE 'function' END AS function_type, CASE WHEN p_partkey % 3 = 1 THEN 'package' ELSE 'public' END AS access, CASE WHEN p_partkey % 3 = 2 THEN 'T' || p_partkey ELSE '' END AS parent_class, '' AS decorators, false AS is_static, false AS is_async, false AS is_abstract FROM part""")
def functions_go(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _functions(corpora.go_functions(spark, sf_dir))


@query("""WITH x AS (SELECT 'jv/' || CAST(p_partkey // 100 AS VARCHAR) || '.java' AS path, p_partkey AS k, unnest([0, 1, 2]) AS q FROM part) SELECT path, CASE q WHEN 0 THEN 'K' || k WHEN 1 THEN 'm' || k ELSE 'o' END AS name, CASE q WHEN 0 THEN '' WHEN 1 THEN 'int a' ELSE 'String b' END AS parameters,
 CASE q WHEN 0 THEN 'constructor' WHEN 1 THEN 'static_method' ELSE 'method' END AS function_type, CASE q WHEN 1 THEN 'public' ELSE 'package' END AS access, 'K' || k AS parent_class, '' AS decorators, q = 1 AS is_static, false AS is_async, false AS is_abstract FROM x""")
def functions_java(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods need a body; of overloads the last stays."""
    return _functions(corpora.java_functions(spark, sf_dir))


@query("SELECT 'jv/' || CAST(p_partkey // 100 AS VARCHAR) || '.java' AS path, 'K' || p_partkey AS parent_class, 'o' AS name, 'String b' AS parameters FROM part")
def function_overload_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _functions(corpora.java_functions(spark, sf_dir)).filter("name = 'o'").select("path", "parent_class", "name", "parameters")


@query(f"SELECT {_F_PY} AS path, 'f' || p_partkey AS name, 2 AS kept FROM part WHERE p_partkey % 4 = 0")
def function_params_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splats are no parameters."""
    return parse.functions(corpora.python_functions(spark, sf_dir)).filter("function_type = 'function'").select("path", "name", F.size("parameters").alias("kept"))


@query("SELECT CASE p_partkey % 3 WHEN 0 THEN 'F' ELSE 'f' END || p_partkey AS name, p_partkey % 3 = 0 AS exported FROM part WHERE p_partkey % 3 < 2")
def go_export_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse.functions(corpora.go_functions(spark, sf_dir)).filter("parent_class = ''")
    return rows.select("name", (C.exported(F.col("name")) & (F.col("access") == "public")).alias("exported"))


# -- classes and inheritance ------------------------------------------------------------------
@query("SELECT 'h/c' || CAST(c_custkey // 100 AS VARCHAR) || '.py' AS path, 'C' || c_custkey AS name, 'N' || c_nationkey AS base_classes, false AS is_abstract, 'public' AS access FROM customer UNION ALL SELECT 'h/n.py', 'N' || n_nationkey, 'R' || n_regionkey, false, 'public' FROM nation")
def classes_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.classes(corpora.hierarchy(spark, sf_dir)).select("path", "name", joined("base_classes").alias("base_classes"), "is_abstract", "access")


@query("SELECT 'jv/' || CAST(c_custkey // 100 AS VARCHAR) || '.java' AS path, 'C' || c_custkey AS name, 'N' || c_nationkey AS base_classes, 'm' AS methods, 'private int x' || c_custkey || ' = ' || c_nationkey || ';' AS fields, 'C' || c_custkey AS constructor, 'public' AS access FROM customer")
def classes_java(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.classes(corpora.java_classes(spark, sf_dir)).select("path", "name", *[joined(c).alias(c) for c in ("base_classes", "methods", "fields")], "constructor", "access")


@query("SELECT 'jv/' || CAST(c_custkey // 100 AS VARCHAR) || '.java' AS path, count(*) AS classes, count(*) AS methods, count(*) AS fields FROM customer GROUP BY 1")
def class_members_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse.classes(corpora.java_classes(spark, sf_dir))
    return rows.groupBy("path").agg(F.count("*").alias("classes"), F.sum(F.size("methods")).cast("bigint").alias("methods"), F.sum(F.size("fields")).cast("bigint").alias("fields"))


def _graph(spark: SparkSession, sf_dir: str) -> InheritanceFrame:
    return InheritanceFrame(parse.inheritance(corpora.hierarchy(spark, sf_dir)).withColumnRenamed("path", "file"))


_EDGES = "SELECT 'C' || c_custkey AS child, 'N' || c_nationkey AS parent FROM customer UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation"


@query(f"SELECT child, parent, 'inherits' AS relationship FROM ({_EDGES})")
def inherit_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).edges.select("child", "parent", "relationship")


@query(f"WITH e AS ({_EDGES}) SELECT DISTINCT parent AS class FROM e WHERE parent NOT IN (SELECT child FROM e)")
def inherit_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).roots()


@query(f"WITH e AS ({_EDGES}) SELECT DISTINCT child AS class FROM e WHERE child NOT IN (SELECT parent FROM e)")
def inherit_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).leaves()


_CLOSURE = f"WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT child, parent, 1 AS depth FROM e UNION ALL SELECT r.child, e.parent, r.depth + 1 FROM r JOIN e ON r.parent = e.child)"


@query(f"{_CLOSURE} SELECT child AS class, parent AS ancestor, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY 1, 2")
def inherit_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).ancestors()


@query(f"{_CLOSURE} SELECT parent AS class, count(DISTINCT child) AS descendants FROM r GROUP BY 1")
def inherit_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).descendants().groupBy("class").agg(F.count("*").alias("descendants"))


_PAIRS = "SELECT 'C' || c_custkey AS class, CASE c_custkey % 3 WHEN 0 THEN 'N' || c_nationkey WHEN 1 THEN 'R' || (c_custkey % 5) ELSE 'C' || c_custkey END AS other FROM customer"


@query(f"{_CLOSURE}, p AS ({_PAIRS}) SELECT p.class, p.other, CASE WHEN p.class = p.other THEN 0 ELSE coalesce((SELECT min(depth) FROM r WHERE r.child = p.class AND r.parent = p.other), -1) END::INTEGER AS depth FROM p")
def inherit_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "customer").select(F.expr("concat('C', c_custkey)").alias("class"), F.expr("CASE c_custkey % 3 WHEN 0 THEN concat('N', c_nationkey) WHEN 1 THEN concat('R', c_custkey % 5) ELSE concat('C', c_custkey) END").alias("other"))
    return _graph(spark, sf_dir).related(pairs).select("class", "other", "depth")


@query(f"{_CLOSURE}, p AS ({_PAIRS}) SELECT p.class, p.other, EXISTS (SELECT 1 FROM r WHERE r.child = p.class AND r.parent = p.other) AS is_ancestor FROM p")
def inherit_is_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "customer").select(F.expr("concat('C', c_custkey)").alias("class"), F.expr("CASE c_custkey % 3 WHEN 0 THEN concat('N', c_nationkey) WHEN 1 THEN concat('R', c_custkey % 5) ELSE concat('C', c_custkey) END").alias("other"))
    return _graph(spark, sf_dir).related(pairs).select("class", "other", "is_ancestor")


@query("""WITH x AS (SELECT p_partkey AS k, unnest(['A', 'B', 'C', 'D']) AS q FROM part) SELECT q || k AS class, CASE q WHEN 'A' THEN 'A' || k WHEN 'B' THEN 'B' || k || '|A' || k WHEN 'C' THEN 'C' || k || '|A' || k ELSE 'D' || k || '|B' || k || '|C' || k || '|A' || k END AS mro FROM x""")
def inherit_mro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diamonds: D has B and C, which both have A."""
    pairs = F.expr("array(struct(0 AS o, concat('B', p_partkey) AS c, concat('A', p_partkey) AS p), struct(0 AS o, concat('C', p_partkey) AS c, concat('A', p_partkey) AS p), struct(0 AS o, concat('D', p_partkey) AS c, concat('B', p_partkey) AS p), struct(1 AS o, concat('D', p_partkey) AS c, concat('C', p_partkey) AS p))")
    edges = table(spark, sf_dir, "part").select(F.explode(pairs).alias("e")).select(F.col("e.c").alias("child"), F.col("e.p").alias("parent"), F.col("e.o").alias("ord"))
    return InheritanceFrame(edges).mro().select("class", joined("mro").alias("mro"))


@query("""SELECT DISTINCT string_agg(b || '.' || i, '|' ORDER BY i) OVER (PARTITION BY b) AS cycle FROM (SELECT DISTINCT p_brand AS b FROM part), (SELECT unnest(range(10)) AS i)""")
def inherit_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of ten names for each brand."""
    ring = table(spark, sf_dir, "part").select("p_brand").distinct().select("p_brand", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"))
    edges = ring.select(F.concat_ws(".", "p_brand", "i").alias("child"), F.concat_ws(".", "p_brand", (F.col("i") + 1) % 10).alias("parent"))
    return InheritanceFrame(edges).cycles().select(joined("cycle").alias("cycle"))


@query("SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) + (SELECT count(DISTINCT n_regionkey) FROM nation) AS total_classes, (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) AS total_relationships, (SELECT count(DISTINCT n_regionkey) FROM nation) AS root_classes, (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)) AS leaf_classes, CAST(0 AS BIGINT) AS circular_inheritance, CAST(2 AS BIGINT) AS max_inheritance_depth")
def inherit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).statistics()


@query(f"SELECT count(*) * 2 AS relationships FROM ({_EDGES})")
def inherit_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merging adds all edges again."""
    g = _graph(spark, sf_dir)
    return g.union(InheritanceFrame.from_classes(parse.classes(corpora.hierarchy(spark, sf_dir)))).edges.agg(F.count("*").alias("relationships"))


# -- package hints ------------------------------------------------------------------------------
def _hints(spark: SparkSession, sf_dir: str, language: str, module: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(module).alias("module"))
    return rows.select("p_partkey", "module", C.package_hint(F.col("module"), language).alias("hint"))


_K = "CAST(p_partkey AS VARCHAR)"


@query(f"SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'foo' || {_K} WHEN 1 THEN 'foo.b' || {_K} || '.c' ELSE '.rel' || {_K} END AS module, CASE p_partkey % 3 WHEN 0 THEN 'foo' || {_K} WHEN 1 THEN 'foo' ELSE '' END AS hint FROM part")
def pkghint_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hints(spark, sf_dir, "python", "CASE p_partkey % 3 WHEN 0 THEN concat('foo', p_partkey) WHEN 1 THEN concat('foo.b', p_partkey, '.c') ELSE concat('.rel', p_partkey) END")


@query(f"""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'os/x' || {_K} WHEN 1 THEN 'github.com/a/b' || {_K} || '/c' WHEN 2 THEN 'github.com/a/b' || {_K} || '/v3/d' WHEN 3 THEN 'go.uber.org/z' || {_K} || '/y' WHEN 4 THEN 'k8s.io/a' || {_K} || '/v2/c' WHEN 5 THEN 'one' || {_K} WHEN 6 THEN '/gocv.io/x/g' || {_K} || '/' ELSE 'gopkg.in/y.v3' END AS module,
 CASE p_partkey % 8 WHEN 0 THEN 'os' WHEN 1 THEN 'github.com/a/b' || {_K} WHEN 2 THEN 'github.com/a/b' || {_K} || '/v3' WHEN 3 THEN 'go.uber.org/z' || {_K} WHEN 4 THEN 'k8s.io/a' || {_K} || '/v2' WHEN 5 THEN 'one' || {_K} WHEN 6 THEN 'gocv.io/x/g' || {_K} ELSE 'gopkg.in/y.v3' END AS hint FROM part""")
def pkghint_go(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hints(spark, sf_dir, "go", "CASE p_partkey % 8 WHEN 0 THEN concat('os/x', p_partkey) WHEN 1 THEN concat('github.com/a/b', p_partkey, '/c') WHEN 2 THEN concat('github.com/a/b', p_partkey, '/v3/d') WHEN 3 THEN concat('go.uber.org/z', p_partkey, '/y') WHEN 4 THEN concat('k8s.io/a', p_partkey, '/v2/c') WHEN 5 THEN concat('one', p_partkey) WHEN 6 THEN concat('/gocv.io/x/g', p_partkey, '/') ELSE 'gopkg.in/y.v3' END")


@query(f"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'lod' || {_K} || '/fp' WHEN 1 THEN '@s/p' || {_K} || '/x' WHEN 2 THEN '../u' || {_K} ELSE 'react' END AS module, CASE p_partkey % 4 WHEN 0 THEN 'lod' || {_K} WHEN 1 THEN '@s/p' || {_K} WHEN 2 THEN '../u' || {_K} ELSE 'react' END AS hint FROM part")
def pkghint_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hints(spark, sf_dir, "javascript", "CASE p_partkey % 4 WHEN 0 THEN concat('lod', p_partkey, '/fp') WHEN 1 THEN concat('@s/p', p_partkey, '/x') WHEN 2 THEN concat('../u', p_partkey) ELSE 'react' END")


@query(f"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'java.util.C' || {_K} WHEN 1 THEN 'javax.swing.X' || {_K} WHEN 2 THEN 'jdk.javadoc' ELSE 'com.acme.C' || {_K} END AS module, CASE p_partkey % 4 WHEN 0 THEN 'java.util' WHEN 1 THEN 'javax.swing' WHEN 2 THEN 'jdk.javadoc' ELSE '' END AS hint FROM part")
def pkghint_java(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hints(spark, sf_dir, "java", "CASE p_partkey % 4 WHEN 0 THEN concat('java.util.C', p_partkey) WHEN 1 THEN concat('javax.swing.X', p_partkey) WHEN 2 THEN 'jdk.javadoc' ELSE concat('com.acme.C', p_partkey) END")


# -- dependency usage ----------------------------------------------------------------------------
def _usage(files: DataFrame) -> DataFrame:
    return depsusage.usage_evidence(files).select("path", "package_hint", "module_name", "module_item", "module_alias", "is_wildcard", "identifier", "line")


_PY_AT = f"WITH x AS ({_PY_LINES}), y AS (SELECT *, CAST(sum(CASE WHEN u THEN 2 ELSE 1 END) OVER (PARTITION BY path ORDER BY k) AS INTEGER) AS l FROM x)"


@query(f"{_PY_AT} SELECT path, t AS package_hint, t || '.' || a AS module_name, CASE WHEN w THEN '' ELSE b END AS module_item, CASE WHEN w THEN '' ELSE 'p' || k END AS module_alias, w AS is_wildcard, CASE WHEN w THEN '' ELSE 'p' || k END AS identifier, l AS line FROM y WHERE w OR u")
def usage_evidence_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usage(corpora.python_imports(spark, sf_dir))


@query(f"WITH x AS ({_JS_LINES}), y AS (SELECT *, CAST(sum(CASE WHEN u THEN 2 ELSE 1 END) OVER (PARTITION BY path ORDER BY k) AS INTEGER) AS l FROM x) SELECT path, CASE q WHEN 0 THEN '@' || s || '/pkg-' || c WHEN 1 THEN 'm' ELSE 'lib' || c END AS package_hint, {_JS_MODULE} AS module_name, CASE WHEN q = 1 THEN 'a' || k ELSE '' END AS module_item, 'v' || k AS module_alias, false AS is_wildcard, 'v' || k AS identifier, l AS line FROM y WHERE u")
def usage_evidence_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usage(corpora.javascript_imports(spark, sf_dir))


@query(f"WITH x AS ({_GO_LINES}) SELECT path, CASE q WHEN 0 THEN module WHEN 1 THEN module ELSE 'math' END AS package_hint, module AS module_name, CASE WHEN q = 0 THEN 'a' || k ELSE '' END AS identifier, q <> 0 AS is_wildcard FROM x WHERE q < 3")
def usage_evidence_go(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usage(corpora.go_imports(spark, sf_dir)).select("path", "package_hint", "module_name", "identifier", "is_wildcard")


@query("""SELECT 'jv/' || CAST(c_custkey // 100 AS VARCHAR) || '.java' AS path, '' AS package_hint, 'org.x' || c_custkey AS module_name, '' AS identifier, CAST(c_custkey % 100 + 1 AS INTEGER) AS line FROM customer WHERE c_custkey % 4 = 2""")
def usage_evidence_java(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usage(corpora.java_imports(spark, sf_dir)).select("path", "package_hint", "module_name", "identifier", "line")


@query(f"{_PY_AT} SELECT path, t || '.' || a AS module_name, l AS line FROM y WHERE w")
def usage_wildcard_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usage(corpora.python_imports(spark, sf_dir)).filter("is_wildcard").select("path", "module_name", "line")


@query(f"WITH x AS ({_PY_LINES}) SELECT t AS package_hint, count(DISTINCT path) AS files, count(*) AS uses FROM x WHERE w OR u GROUP BY t")
def usage_by_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depsusage.usage_by_package(corpora.python_imports(spark, sf_dir))


@query(f"WITH x AS ({_PY_LINES}) SELECT path, CASE WHEN m THEN t ELSE t || '.' || a END AS module_name, CASE WHEN m THEN 'm' ELSE 'p' END || k AS module_alias FROM x WHERE NOT w AND NOT u")
def unused_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depsusage.unused_imports(corpora.python_imports(spark, sf_dir)).select("path", "module_name", "module_alias")


# -- assignments ------------------------------------------------------------------------------------
_ASG = "SELECT p_partkey AS k, 'asg/' || CAST(p_partkey // 100 AS VARCHAR) || '.py' AS path FROM part"


@query(f"""WITH x AS ({_ASG}) SELECT path AS file, path || '//x' || k AS src, '"v' || (k - k % 10) || '"' AS leaf FROM x""")
def assign_resolve_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parse.resolved(corpora.assignments(spark, sf_dir)).filter(F.col("src").contains("//x"))
    return found.select(F.col("path").alias("file"), "src", "leaf")


@query(f"""WITH x AS ({_ASG} WHERE p_partkey % 10 = 0), y AS (SELECT *, unnest(['a', 'b']) AS q FROM x) SELECT path AS file, path || '//' || q || k AS src, 0 AS ord, path || '//' || q || k AS leaf FROM y""")
def assign_resolve_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that stand for each other end at themselves."""
    edges = parse.assign_edges(corpora.assignments(spark, sf_dir)).withColumnRenamed("path", "file").filter(F.col("src").rlike("//[ab][0-9]+$"))
    return assignments.resolve_ordered(edges)


@query(f"""WITH x AS (SELECT p_partkey AS k, {_F_PY} AS path FROM part) SELECT path, path || '//o' || k AS caller, '"' || q || k || '"' AS arg FROM (SELECT *, unnest(CASE WHEN k % 2 = 0 THEN ['u'] ELSE ['u', 'v'] END) AS q FROM x)""")
def assign_asof_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call sees the assignments made before it: one for even keys, two for odd ones."""
    one, two, call = (corpora.text(p, **corpora.PART) for p in ('    y = "u{k}"', '\n    y = "v{k}"', "\n    print(y)"))
    even = F.expr("p_partkey % 2 = 0")
    line = F.concat(corpora.text("def o{k}():\n", **corpora.PART), one, F.when(even, F.concat(call, two)).otherwise(F.concat(two, call)))
    calls = parse.call_edges(corpora.files(table(spark, sf_dir, "part"), F.expr(corpora.PART_PATH["py"]), "p_partkey", line))
    return calls.filter("callee = 'print'").select("path", "caller", F.explode(F.flatten("args")).alias("a")).select("path", "caller", F.col("a.ns").alias("arg"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'f//C//m//x' WHEN o_orderkey % 3 = 1 THEN 'f//C//x' ELSE 'x' END AS ns FROM orders")
def scope_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost known name: in the method, in the class, or bare."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("file"), F.lit("f//C//m").alias("scope"), F.lit("x").alias("symbol"), (F.col("o_orderkey") % 3).alias("q"))
    known = rows.select("file", F.explode(F.expr("CASE q WHEN 0 THEN array('f//C//m//x', 'f//C//x', 'x') WHEN 1 THEN array('f//C//x', 'x') ELSE array('x', 'f//D//x') END")).alias("ns"))
    return assignments.scope_lookup(rows.drop("q"), known).select(F.col("file").cast("bigint").alias("k"), "ns")


# -- call graphs --------------------------------------------------------------------------------------
def _calls(files: DataFrame) -> DataFrame:
    args = F.array_join(F.transform("args", lambda a: F.array_join(F.transform(a, lambda n: n["ns"]), "+")), "|")
    return parse.call_edges(files).select("path", "caller", "callee", args.alias("args"))


def _cal(ext: str) -> str:
    return f"SELECT o_orderkey AS k, o_orderkey % 50 AS f, o_custkey % 10 AS m, o_orderstatus AS s, 'cal/' || CAST(o_orderkey // 100 AS VARCHAR) || '.{ext}' AS path FROM orders"


@query(f"""WITH x AS ({_cal('py')}) SELECT path, path || '//o' || k AS caller, 'lib' || m || '//f' || f AS callee, '"' || s || '"' AS args FROM x UNION ALL SELECT path, path, path || '//o' || k, '' FROM x WHERE k % 2 = 0""")
def call_edges_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(corpora.python_calls(spark, sf_dir))


@query(f"WITH x AS ({_cal('js')}) SELECT path, path || '//o' || k AS caller, 'lib' || m || '//f' || f AS callee, '' AS args FROM x UNION ALL SELECT path, path, path || '//require', '' FROM x")
def call_edges_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments of JavaScript calls are never resolved."""
    return _calls(corpora.javascript_calls(spark, sf_dir))


@query(f"""WITH x AS ({_cal('go')}) SELECT path, path || '//o' || k AS caller, 'lib//x' || m || '//F' || f AS callee, '"' || s || '"' AS args FROM x UNION ALL SELECT path, path, path || '//o' || k, '' FROM x""")
def call_edges_go(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(corpora.go_calls(spark, sf_dir))


@query(f"""WITH x AS ({_cal('java')}) SELECT path, path || '//K' || k || '//o' || k AS caller, 'lib//x' || m || '//M//f' || f AS callee, '"' || s || '"' AS args FROM x UNION ALL SELECT path, path || '//K' || k || '//this//o' || k, path || '//K' || k || '//o' || k, '' FROM x""")
def call_edges_java(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(corpora.java_calls(spark, sf_dir))


@query(f"WITH x AS ({_cal('py')} WHERE o_orderkey % 2 = 0) SELECT DISTINCT path, path || '//o' || k AS callee FROM x UNION SELECT path, 'lib' || m || '//f' || f FROM x")
def call_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.reachable(corpora.python_calls(spark, sf_dir)).select("path", "callee")


@query(f"WITH x AS ({_cal('py')}) SELECT path, count(*) AS calls FROM x GROUP BY path")
def dfs_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each library call is met once in a traversal, from the function that makes it."""
    items = parse.dfs_items(corpora.python_calls(spark, sf_dir)).filter(F.col("namespace").startswith("lib") & F.col("namespace").contains("//f"))
    return items.groupBy("path").agg(F.count("*").alias("calls"))


def _condition(value: str, args: list | None = None) -> dict:
    return {"type": "call", "value": value, "args": args or []}


def _signature(name: str, match: str, *conds: dict) -> dict:
    return {"id": name, "languages": {"python": {"match": match, "conditions": list(conds)}}}


def _evidence(spark: SparkSession, sf_dir: str, *sigs: dict) -> DataFrame:
    return signatures.evidence(parse.dfs_items(corpora.python_calls(spark, sf_dir)), signatures.conditions(spark, list(sigs)))


@query(f"WITH x AS ({_cal('py')}) SELECT path, path || '//o' || k AS caller, 'exact' AS signature_id FROM x WHERE m = 3 AND f = 7")
def sig_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir, _signature("exact", "any", _condition("lib3.f7"))).select("path", "caller", "signature_id")


@query(f"WITH x AS ({_cal('py')}) SELECT path, 'lib3//f' || f AS namespace, count(*) AS evidences FROM x WHERE m = 3 GROUP BY 1, 2")
def sig_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _evidence(spark, sf_dir, _signature("wild", "any", _condition("lib3.*")))
    return found.groupBy("path", "namespace").agg(F.count("*").alias("evidences"))


@query(f"WITH x AS ({_cal('py')}) SELECT path, path || '//o' || k AS caller FROM x WHERE m = 4 AND s IN ('P', 'O')")
def sig_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir, _signature("args", "any", _condition("lib4.*", [{"index": 0, "values": ['"P"', '"O"']}]))).select("path", "caller")


@query(f"WITH x AS ({_cal('py')}) SELECT path, 'any' AS signature_id, CAST(count(DISTINCT m) AS INTEGER) AS matched, count(*) AS evidences FROM x WHERE m IN (1, 2) AND f < 10 GROUP BY path")
def sig_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    conds = [_condition(f"lib{m}.f{f}") for m in (1, 2) for f in range(10)]
    found = _evidence(spark, sf_dir, _signature("any", "any", *conds))
    grouped = found.withColumn("cond", F.floor(F.col("cond") / 10))
    return signatures.matches(grouped).select("path", "signature_id", "matched", "evidences")


@query(f"WITH x AS ({_cal('py')}) SELECT path, 'all' AS signature_id, count(*) AS evidences FROM x WHERE m IN (5, 6, 7) GROUP BY path HAVING count(DISTINCT m) = 3")
def sig_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _evidence(spark, sf_dir, _signature("all", "all", _condition("lib5.*"), _condition("lib6.*"), _condition("lib7.*")), _signature("never", "all", _condition("lib5.*"), {"type": "import", "value": "lib5"}))
    return signatures.matches(found).select("path", "signature_id", "evidences")


@query(f"WITH x AS ({_cal('py')}) SELECT path, path || '//o' || k AS caller, 'lib0//f' || f AS callee, 'm' || k || '.f' || f AS identifier, CAST('P' = s AS INTEGER) AS p FROM x WHERE m = 0")
def sig_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _evidence(spark, sf_dir, _signature("e", "any", _condition("lib0.*")))
    return found.select("path", "caller", F.col("namespace").alias("callee"), F.col("identifier_text").alias("identifier"), F.exists(F.flatten("args"), lambda n: n["ns"] == '"P"').cast("int").alias("p"))


@query(f"WITH x AS ({_PY_LINES}) SELECT 'dependency_usage' AS plugin, count(*) FILTER (WHERE w OR u) AS n FROM x UNION ALL SELECT 'strip_comments', count(DISTINCT path) FROM x")
def plugin_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = plugins.run(corpora.python_imports(spark, sf_dir), [plugins.DEPENDENCY_USAGE, plugins.STRIP_COMMENTS])
    out = None
    for name, rows in found.items():
        one = rows.groupBy().agg(F.count("*").alias("n")).select(F.lit(name).alias("plugin"), "n")
        out = one if out is None else out.unionByName(one)
    return out
