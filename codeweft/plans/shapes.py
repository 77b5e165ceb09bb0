"""More queries over the reference's own operators: one shape of source for each.

As in ``catalogue`` the SQL derives each result from the columns that the sources
were made from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import BUILTINS
from ..operators import depsusage, parse, signatures
from ..operators.inheritance import InheritanceFrame
from ..sources import files as S
from ..sources.shared import stored, written
from . import corpora, plugins
from .catalogue import _F_PY, _PY_LINES, _cal, _condition, _signature, joined, query
from .corpora import CUSTOMER, PART, PART_PATH, _braces, files, table, text


def parts(spark: SparkSession, sf_dir: str, ext: str, line: Column, head: str = "") -> DataFrame:
    return files(table(spark, sf_dir, "part"), F.expr(PART_PATH[ext]), "p_partkey", line, head)


_P = {ext: f"SELECT p_partkey AS k, p_size AS s, {path} AS path FROM part" for ext, path in (("py", _F_PY), ("js", "'web/' || CAST(p_partkey // 100 AS VARCHAR) || '.js'"), ("java", "'jv/' || CAST(p_partkey // 100 AS VARCHAR) || '.java'"))}

# -- directories ------------------------------------------------------------------------
_EXT = "CASE n % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.txt' WHEN 3 THEN '.java' ELSE '.mjs' END"
_NATIONS = f"WITH x AS (SELECT n_nationkey AS n, n_regionkey AS r, {_EXT} AS ext FROM nation), y AS (SELECT *, 'r' || r || '/n' || n || ext AS rel_path, CASE WHEN n % 3 = 2 THEN 0 ELSE n % 3 END AS root, n % 3 = 2 AS is_import FROM x WHERE ext <> '.txt')"


def _stored(spark: SparkSession, sf_dir: str) -> str:
    """A file for each of the 25 nations below two app roots and a root of imports."""
    held = {}
    for row in table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect():
        n = int(row[0])
        name = f"r{row[1]}/n{n}" + (".py", ".js", ".txt", ".java", ".mjs")[n % 5]
        held[f"{('app', 'more', 'lib')[n % 3]}/{name}"] = f"// {n}\n" if n % 5 else f"import m{n}\n"
    for root in ("app", "more", "lib"):
        held[f"{root}/same.py"] = f"import {root}\n"
        held[f"{root}/skip/not.py"] = "import never\n"
    return stored(spark, held, "sources")


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _stored(spark, sf_dir)
    return S.source_files(spark, [f"{base}/app", f"{base}/more"], [f"{base}/lib"], exclude=["/skip/"], include_imports=True)


_SAME = "SELECT 'same.py' AS rel_path, unnest([0, 1, 0]) AS root, unnest([false, false, true]) AS is_import"


@query(f"{_NATIONS} SELECT rel_path, is_import, CAST(root AS INTEGER) AS root, CASE WHEN ext = '.py' THEN 'python' WHEN ext = '.java' THEN 'java' ELSE 'javascript' END AS language, true AS below FROM y UNION ALL SELECT rel_path, is_import, root, 'python', true FROM ({_SAME})")
def scan_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two app roots, then imports; other extensions and excluded folders stay out."""
    return _scanned(spark, sf_dir).select("rel_path", "is_import", "root", "language", F.col("path").endswith(F.concat(F.lit("/"), F.col("rel_path"))).alias("below"))


@query(f"{_NATIONS} SELECT rel_path, is_import FROM y WHERE is_import = false UNION ALL SELECT 'same.py', false FROM range(2)")
def scan_app_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _stored(spark, sf_dir)
    return S.source_files(spark, [f"{base}/app/", f"{base}/more"], [f"{base}/lib"], exclude=["/skip/"]).select("rel_path", "is_import")


@query("SELECT 'same.py' AS rel_path, false AS is_import, 0 AS root, 'app' AS module_name")
def find_file_in_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first root that has the name wins."""
    found = S.find_file(_scanned(spark, sf_dir), "same.py")
    return found.join(parse.imports(found).select("path", "module_name"), "path").select("rel_path", "is_import", "root", "module_name")


@query(f"{_NATIONS} SELECT 'n' || n || ext AS name, n FROM y WHERE n = 5")
def scan_single_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A root that is a file itself: its name is the last part of its path."""
    base = _stored(spark, sf_dir)
    found = S.source_files(spark, [f"{base}/lib/r{_region(spark, sf_dir, 5)}/n5.py"])
    return found.select(F.col("rel_path").alias("name"), F.regexp_extract("content", r"m(\d+)", 1).cast("int").alias("n"))


def _region(spark: SparkSession, sf_dir: str, n: int) -> int:
    return table(spark, sf_dir, "nation").filter(F.col("n_nationkey") == n).select("n_regionkey").collect()[0][0]


@query("SELECT p_partkey AS k, 'n' || p_partkey || '.py' AS name FROM part")
def file_from_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files held in memory go by the last part of their path."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr("concat('some/dir', p_size, '/n', p_partkey, '.py')").alias("path"), F.lit("pass").alias("content"))
    return S.from_dataframe(rows).select(F.regexp_extract("path", r"n(\d+)\.py", 1).cast("bigint").alias("k"), F.col("rel_path").alias("name"))


@query("SELECT * FROM (VALUES ('python', 'Python', true, '.py'), ('javascript', 'JavaScript', true, '.js|.mjs|.cjs'), ('java', 'Java', true, '.java'), ('go', 'Go', false, '.go')) v(code, name, object_oriented, extensions)")
def language_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = S.languages(spark)
    for row in known.collect():
        # By code: the same row again; an unknown code raises.
        if S.language(row["code"]) != (row["name"], row["object_oriented"], tuple(row["extensions"])):
            raise AssertionError(row["code"])
    return known.select("code", "name", "object_oriented", joined("extensions").alias("extensions"))


@query("SELECT * FROM (VALUES ('python', CAST(157 AS BIGINT)), ('javascript', 37), ('go', 19), ('java', 29)) v(language, names)")
def builtin_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(code, name) for code, names in BUILTINS.items() for name in names]
    return spark.createDataFrame(rows, "language string, name string").groupBy("language").agg(F.count_distinct("name").alias("names"))


# -- errors and limits --------------------------------------------------------------------
@query("SELECT 'NotImplementedError: classes of ' || l AS error, l AS language, count(*) AS files FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'java' ELSE 'go' END AS l FROM part) WHERE l IN ('javascript', 'go') GROUP BY ALL")
def class_capability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two languages have no classes to ask for: permissive mode tells which files it leaves out."""
    rows = table(spark, sf_dir, "part").select(F.expr("concat('n', p_partkey, CASE p_partkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.java' ELSE '.go' END)").alias("path"), F.lit("x").alias("content"))
    return parse.errors(S.from_dataframe(rows), ["classes"], beyond=True).groupBy("language", "error").agg(F.count("*").alias("files"))


@query(f"WITH x AS ({_P['py']}) SELECT path, count(*) AS imports FROM x GROUP BY path")
def syntax_errors_tolerated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports after statements that no grammar has."""
    found = parse.imports(parts(spark, sf_dir, "py", text("x = = {s}\ndef :\nimport lib{k}", **PART)))
    return found.filter(F.col("module_name").startswith("lib")).groupBy("path").agg(F.count("*").alias("imports"))


@query(f"WITH x AS ({_P['py']}) SELECT path, count(*) AS kept FROM x GROUP BY path HAVING min(k) % 300 <> 0")
def permissive_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hook fails on some files: those are left out, the others stay."""
    source = parts(spark, sf_dir, "py", text("import lib{k}", **PART))
    least = table(spark, sf_dir, "part").groupBy(F.expr(PART_PATH["py"]).alias("path")).agg((F.min("p_partkey") % 300 == 0).alias("bad"))
    marked = source.join(least, "path").withColumn("content", F.when(F.col("bad"), F.concat(F.lit("bad()\n"), "content")).otherwise(F.col("content")))

    def on_file(path: str, language: str, content: str):
        if content.startswith("bad"):
            raise ValueError("told to fail")
        return ((line,) for line in content.split("\n"))

    return parse.walk(marked, parse.Visitor("line string", on_file=on_file), mode="permissive").groupBy("path").agg(F.count("*").alias("kept"))


@query(f"WITH x AS ({_cal('py')}), y AS (SELECT path, count(*) AS n FROM x GROUP BY path) SELECT path, CAST(5 AS BIGINT) AS steps, true AS truncated FROM y WHERE n > 10")
def traversal_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A traversal that ends at its limit says so."""
    big = table(spark, sf_dir, "orders").groupBy(F.expr("concat('cal/', o_orderkey DIV 100, '.py')").alias("path")).count().filter("count > 10").select("path")
    items = parse.dfs_items(corpora.python_calls(spark, sf_dir).join(big, "path", "left_semi"), limit=5)
    return items.groupBy("path").agg(F.count("*").alias("steps"), F.bool_and("truncated").alias("truncated"))


@query(f"WITH x AS ({_cal('py')}) SELECT DISTINCT path, false AS truncated FROM x")
def graph_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parse.limits(corpora.python_calls(spark, sf_dir))
    return found.select("path", (F.col("calls_truncated") | F.col("items_truncated")).alias("truncated"))


# -- syntax ---------------------------------------------------------------------------------
@query(f"""WITH x AS ({_cal('py')}), y AS (SELECT *, unnest(['o', 'f', 'a']) AS capture FROM x WHERE f < 10) SELECT path, capture, CASE capture WHEN 'o' THEN 'm' || k WHEN 'f' THEN 'f' || f ELSE '"' || s || '"' END AS text, CASE capture WHEN 'a' THEN 'string' ELSE 'identifier' END AS type FROM y""")
def cst_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of a pattern with a predicate."""
    pattern = '(call function: (attribute object: (identifier) @o attribute: (identifier) @f) arguments: (argument_list (string) @a) (#match? @f "^f[0-9]$"))'
    return parse.query(corpora.python_calls(spark, sf_dir), [pattern]).select("path", "capture", "text", "type")


@query(f"WITH x AS ({_cal('py')}) SELECT path, 0 AS query, count(*) AS matches FROM x GROUP BY path UNION ALL SELECT path, 1, count(*) FROM x GROUP BY path")
def cst_query_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of a list run one after the other."""
    found = parse.query(corpora.python_calls(spark, sf_dir), ["(function_definition name: (identifier) @name)", "[(import_statement) @i (import_from_statement) @i]"])
    return found.groupBy("path", "query").agg(F.count_distinct("match").alias("matches"))


@query(f"WITH x AS ({_P['py']}) SELECT path, 'é' || k AS text, CAST(length('é' || k) + 1 AS BIGINT) AS bytes FROM x")
def cst_byte_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges are of UTF-8 bytes."""
    found = parse.query(parts(spark, sf_dir, "py", text("é{k} = {s}", **PART)), ["(assignment left: (identifier) @n)"])
    return found.select("path", "text", (F.col("at.end_byte") - F.col("at.start_byte")).alias("bytes"))


@query(f"WITH x AS ({_P['py']}) SELECT path, count(*) AS imports, count(*) AS calls FROM x GROUP BY path")
def visitor_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A visitor of nodes."""

    def on_node(path: str, language: str, node):
        if node.type in ("import_statement", "call"):
            yield (node.type,)

    found = parse.walk(parts(spark, sf_dir, "py", text("import lib{k}\nlib{k}.go({s})", **PART)), parse.Visitor("type string", ("python",), on_node=on_node))
    return found.groupBy("path").agg(F.count_if(F.col("type") == "import_statement").alias("imports"), F.count_if(F.col("type") == "call").alias("calls"))


@query(f"WITH x AS ({_P['py']}) SELECT 'import_statement' AS type, count(*) AS nodes FROM x UNION ALL SELECT 'call', count(*) FROM x UNION ALL SELECT 'module', count(DISTINCT path) FROM x")
def ast_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syntax nodes kept as a table."""
    held = written(parse.cst(parts(spark, sf_dir, "py", text("import lib{k}\nlib{k}.go({s})", **PART))), "ast")
    return held.filter(F.col("type").isin("import_statement", "call", "module")).groupBy("type").agg(F.count("*").alias("nodes"))


# -- functions and classes --------------------------------------------------------------------
@query(f"WITH x AS ({_P['js']}) SELECT path, 'h' || k AS name, 'y|z = ' || s AS parameters, 'function' AS function_type FROM x")
def functions_js_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of function expressions only those with a name of their own."""
    line = _braces("const f{k} = function (x) << >>;\nconst g{k} = function h{k}(y, z = {s}) << >>;", **PART)
    return parse.functions(parts(spark, sf_dir, "js", line)).select("path", "name", joined("parameters").alias("parameters"), "function_type")


@query(f"""WITH x AS ({_P['java']}) SELECT path, 'm' || k AS name, '@Get("/' || k || '")|@Get("/' || k || '")' AS decorators FROM x UNION ALL SELECT path, 'o' || k, '' FROM x""")
def functions_java_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations with arguments are there twice, those without not at all."""
    line = _braces('class A{k} <<\n  @Get("/{k}") @Override\n  int m{k}() << return 1; >>\n  @Override\n  int o{k}() << return 2; >>\n>>', **PART)
    return parse.functions(parts(spark, sf_dir, "java", line)).select("path", "name", joined("decorators").alias("decorators"))


_PY_CLASS = "@deco\nclass C{k}(B{s}):\n    self.x{k} = {s}\n    def m{k}(self): pass\n    @staticmethod\n    def s{k}(): pass\n    def __init__(self):\n        self.y = 2\n@abstractmethod\nclass D{k}:\n    def a{k}(self): pass"


@query(f"WITH x AS ({_P['py']}) SELECT path, 'C' || k AS name, 'B' || s AS base_classes, 'm' || k || '|__init__' AS methods, 'self.x' || k || ' = ' || s AS fields, '__init__' AS constructor, '@deco' AS decorators, false AS is_abstract FROM x UNION ALL SELECT path, 'D' || k, '', 'a' || k, '', '', '@abstractmethod', true FROM x")
def classes_py_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decorated methods and fields set within methods don't count; a decorator may make a class abstract."""
    rows = parse.classes(parts(spark, sf_dir, "py", text(_PY_CLASS, **PART)))
    return rows.select("path", "name", *[joined(c).alias(c) for c in ("base_classes", "methods", "fields")], "constructor", joined("decorators").alias("decorators"), "is_abstract")


_JAVA_CLASS = '@Ent(name = "{k}")\n@Plain\npublic class A{k} extends B{s} <<\n  void m{k}() << >>\n>>\ninterface I{k} <<\n  void q();\n>>\nabstract class Z{k} <<\n>>'


@query(f"""WITH x AS ({_P['java']}) SELECT path, 'A' || k AS name, 'B' || s AS base_classes, '@Ent(name = "' || k || '")|@Ent(name = "' || k || '")|@Plain' AS decorators, false AS is_abstract, 'public' AS access FROM x UNION ALL SELECT path, 'I' || k, '', '', true, 'public' FROM x UNION ALL SELECT path, 'Z' || k, '', '', true, 'public' FROM x""")
def classes_java_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations with arguments twice, markers once; interfaces are abstract classes without bases."""
    rows = parse.classes(parts(spark, sf_dir, "java", _braces(_JAVA_CLASS, **PART)))
    return rows.select("path", "name", joined("base_classes").alias("base_classes"), joined("decorators").alias("decorators"), "is_abstract", "access")


@query(f"WITH x AS ({_P['py']}) SELECT path, '[@deco] ClassDeclarationNode{{class: C' || k || '(B' || s || '), methods: 2, fields: 1, constructor: true}}' AS shown FROM x UNION ALL SELECT path, '[@abstractmethod] ClassDeclarationNode{{abstract class: D' || k || ', methods: 1, fields: 0, constructor: false}}' FROM x")
def classes_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.shown_classes(parts(spark, sf_dir, "py", text(_PY_CLASS, **PART))).select("path", "shown")


# -- inheritance ----------------------------------------------------------------------------------
@query("SELECT 'C' || c_custkey AS child, 'N' || c_nationkey AS parent, 'inherits' AS relationship, 0 AS line FROM customer")
def inherit_java(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Java's edges: the class extended alone, on no line."""
    line = _braces("class C{k} extends N{n} implements I{n}, Other <<\n>>\nclass G{k} extends pkg.Q <<\n>>", **CUSTOMER)
    found = parse.inheritance(files(table(spark, sf_dir, "customer"), F.expr("concat('jv/', c_custkey DIV 100, '.java')"), "c_custkey", line))
    return found.select("child", "parent", "relationship", "line")


def _families(spark: SparkSession, sf_dir: str) -> InheritanceFrame:
    """X has A and B, A has P and Q, B has Q and R, for each part."""
    line = text("class A{k}(P{k}, Q{k}): pass\nclass B{k}(Q{k}, R{k}): pass\nclass X{k}(A{k}, B{k}): pass", **PART)
    return InheritanceFrame(parse.inheritance(parts(spark, sf_dir, "py", line)).withColumnRenamed("path", "file"))


@query("SELECT 'X' || p_partkey AS class, 'A' || p_partkey || '|B' || p_partkey || '|P' || p_partkey || '|Q' || p_partkey || '|R' || p_partkey AS ancestors FROM part")
def inherit_ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest first, then in the order of the bases."""
    return _families(spark, sf_dir).ancestry().filter(F.col("class").startswith("X")).select("class", joined("ancestors").alias("ancestors"))


@query(f"WITH x AS ({_P['py']} WHERE p_partkey = 7) SELECT 'parent' AS side, 'P' || k AS name, 0 AS ord FROM x UNION ALL SELECT 'parent', 'Q' || k, 1 FROM x UNION ALL SELECT 'child', 'X' || k, 0 FROM x")
def inherit_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct parents in order, and children."""
    g = _families(spark, sf_dir)
    up = g.parents("A7").select(F.lit("parent").alias("side"), F.col("parent").alias("name"), "line")
    down = g.children("A7").select(F.lit("child").alias("side"), F.col("child").alias("name"), "line")
    return up.unionByName(down).select("side", "name", F.when(F.col("name") == "Q7", 1).otherwise(0).alias("ord"))


@query(f"WITH x AS ({_P['py']}), y AS (SELECT path, k, CAST((row_number() OVER (PARTITION BY path ORDER BY k) - 1) * 3 + 3 AS INTEGER) AS l FROM x) SELECT 'X' || k || ' inherits ' || unnest(['A', 'B']) || k || ' at ' || path || ':' || l AS shown FROM y")
def inherit_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _families(spark, sf_dir).shown().filter(F.col("shown").startswith("X"))


@query("SELECT 'InheritanceGraph{classes: ' || (count(*) + (SELECT count(*) FROM nation) + (SELECT count(DISTINCT n_regionkey) FROM nation)) || ', relationships: ' || (count(*) + (SELECT count(*) FROM nation)) || '}' AS shown FROM customer")
def inherit_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return InheritanceFrame(parse.inheritance(corpora.hierarchy(spark, sf_dir)).withColumnRenamed("path", "file")).described()


# -- dependency usage ------------------------------------------------------------------------------
@query("SELECT CASE p_partkey % 2 WHEN 0 THEN 'two.x' ELSE 'one' END AS module_name, CASE p_partkey % 2 WHEN 0 THEN 'n' || p_partkey ELSE 'a' || p_partkey END AS module_item, 'n' || p_partkey AS identifier FROM part")
def import_identifier_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of imports that bind one identifier the last is the one that counts."""
    line = F.concat(text("from one import a{k} as n{k}", **PART), F.when(F.expr("p_partkey % 2 = 0"), text("\nfrom two.x import n{k}", **PART)).otherwise(""))
    return depsusage.identifier_map(parts(spark, sf_dir, "py", line)).select("module_name", "module_item", "identifier")


@query(f"WITH x AS ({_PY_LINES}) SELECT path, count(*) FILTER (WHERE w OR u) AS uses, count(*) AS imports FROM x GROUP BY path")
def parsed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several tables off one parse of each file."""
    held = parse.together(corpora.python_imports(spark, sf_dir), ["evidence", "imports"])
    uses = held["evidence"].groupBy("path").agg(F.count("*").alias("uses"))
    return held["imports"].groupBy("path").agg(F.count("*").alias("imports")).join(uses, "path", "left").select("path", F.coalesce("uses", F.lit(0)).alias("uses"), "imports")


# -- call graphs: a shape for each kind of expression ----------------------------------------------------
def _args(files_: DataFrame, callee: str) -> DataFrame:
    """What the arguments of the calls of a name may be."""
    found = parse.call_edges(files_).filter(F.col("callee").endswith(callee))
    return found.select("path", "caller", F.array_join(F.array_sort(F.transform(F.flatten("args"), lambda a: a["ns"])), "|").alias("args"))


@query(f"WITH x AS ({_P['java']}) SELECT path, path || '//T' || k || '//r' || k AS caller, '\"p' || k || '\"|\"q' || s || '\"' AS args FROM x")
def call_ternary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both branches of a conditional expression, not its condition."""
    return _args(parts(spark, sf_dir, "java", _braces('class T{k} <<\n  void r{k}() <<\n    String v = ok ? "p{k}" : "q{s}";\n    Out.put(v);\n  >>\n>>', **PART)), "put")


@query(f"WITH x AS ({_P['py']}) SELECT path, path || '//r' || k AS caller, '\"l' || k || '\"|\"r' || s || '\"' AS args FROM x")
def call_binary_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _args(parts(spark, sf_dir, "py", text('def r{k}():\n    v = "l{k}" + "r{s}"\n    print(v)', **PART)), "print")


@query(f"WITH x AS ({_P['py']}) SELECT path, path || '//r' || k AS caller, 'lib//a' || k || '//b' || s AS args FROM x")
def call_attribute_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of attributes through what its first name stands for."""
    return _args(parts(spark, sf_dir, "py", text("def r{k}():\n    v = n.a{k}.b{s}\n    print(v)", **PART), "import lib as n\n"), "print")


@query(f"WITH x AS ({_P['java']}) SELECT path, path || '//S' || k || '//r' || k AS caller, 'x' || k || '//y//Z' || s AS callee FROM x UNION ALL SELECT path, path || '//S' || k || '//r' || k, 'x' || k || '//y//Z' || s || '//go' FROM x")
def call_scoped_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A qualified type: the object made from it calls through it."""
    line = _braces("class S{k} <<\n  void r{k}() <<\n    x{k}.y.Z{s} z = new x{k}.y.Z{s}(1);\n    z.go();\n  >>\n>>", **PART)
    return parse.call_edges(parts(spark, sf_dir, "java", line)).filter(F.col("callee").startswith("x")).select("path", "caller", "callee")


@query(f"WITH x AS ({_P['java']}) SELECT path, path || '//N' || k || '//r' || k AS caller, 'K' || k AS callee, CAST(s AS VARCHAR) AS arg FROM x UNION ALL SELECT path, path || '//N' || k || '//r' || k, 'com//acme//K' || k || '//go', '' FROM x")
def call_java_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """new is an edge to a known class, none to an unknown one; the class flows to the variable."""
    line = _braces("import com.acme.K{k};\nclass N{k} <<\n  void r{k}() <<\n    K{k} v = new K{k}({s});\n    v.go();\n    new Unknown{k}();\n  >>\n>>", **PART)
    found = parse.call_edges(parts(spark, sf_dir, "java", line)).filter(F.col("callee").rlike("K[0-9]+(//go)?$") & F.col("caller").contains("//r"))
    return found.select("path", "caller", "callee", F.array_join(F.transform(F.flatten("args"), lambda a: a["ns"]), "|").alias("arg"))


@query(f"WITH x AS ({_P['java']}) SELECT path, path || '//C' || k AS caller, path || '//C' || k || '//h' || k AS callee FROM x")
def call_java_constructor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body of a constructor calls for its class."""
    line = _braces("class C{k} <<\n  void h{k}() << >>\n  C{k}() <<\n    h{k}();\n  >>\n>>", **PART)
    found = parse.call_edges(parts(spark, sf_dir, "java", line)).filter(F.col("callee").rlike("//C[0-9]+//h[0-9]+$") & ~F.col("caller").contains("//this"))
    return found.select("path", "caller", "callee")


@query(f"WITH x AS ({_P['java']}) SELECT path, path || '//V' || k || '//r' || k || '//a' AS src, CAST(s AS VARCHAR) AS leaf FROM x")
def call_java_declarator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a local declaration the first declarator counts."""
    line = _braces("class V{k} <<\n  void r{k}() <<\n    int a = {s}, b = 2;\n  >>\n>>", **PART)
    return parse.resolved(parts(spark, sf_dir, "java", line)).select("path", "src", "leaf")


@query(f"WITH x AS ({_P['js']}) SELECT path, path || '//' || v || k AS src, leaf FROM (SELECT *, unnest(['a', 'b', 'c']) AS v, unnest([CAST(s AS VARCHAR), CAST(s AS VARCHAR), '''t''']) AS leaf FROM x)")
def call_js_declarators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a JavaScript declaration all declarators count."""
    return parse.resolved(parts(spark, sf_dir, "js", text("const a{k} = {s}, b{k} = a{k}, c{k} = 't';", **PART))).select("path", "src", "leaf")


@query(f"WITH x AS ({_P['js']}) SELECT path, path || '//v' || k AS src, 'lib//n' || s AS leaf FROM x")
def call_js_member_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parse.resolved(parts(spark, sf_dir, "js", text("const v{k} = l.n{s};", **PART), "const l = require('lib');\n"))
    return found.filter(F.col("src").rlike("//v[0-9]+$")).select("path", "src", "leaf")


@query(f"WITH x AS ({_P['js']}) SELECT path, path || '//g' || k AS caller, path || '//f' || k AS callee FROM x UNION ALL SELECT path, path || '//K' || k || '//this//m', path || '//K' || k || '//m' FROM x UNION ALL SELECT path, path || '//K' || k, path || '//K' || k || '//constructor' FROM x UNION ALL SELECT path, path || '//K' || k || '//this//constructor', path || '//K' || k || '//constructor' FROM x UNION ALL SELECT path, path || '//K' || k || '//m', path || '//f' || k FROM x")
def call_js_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions, arrows by the name they are bound to, methods and constructors."""
    line = _braces("function f{k}() << >>\nconst g{k} = () => << f{k}(); >>;\nclass K{k} <<\n  constructor() << >>\n  m() << f{k}(); >>\n>>", **PART)
    return parse.call_edges(parts(spark, sf_dir, "js", line)).select("path", "caller", "callee")


@query(f"WITH x AS ({_P['js']}) SELECT path, path AS caller, path || '//K' || k AS callee FROM x UNION ALL SELECT path, path, path || '//K' || k || '//go' FROM x UNION ALL SELECT path, path, 'lib//T' || s FROM x")
def call_js_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """new is an edge always; the class flows on where it is known."""
    line = _braces("class K{k} << >>\nconst a{k} = new K{k}();\na{k}.go();\nconst b{k} = new l.T{s}();", **PART)
    return parse.call_edges(parts(spark, sf_dir, "js", line, "const l = require('lib');\n")).filter(~F.col("callee").endswith("require")).select("path", "caller", "callee")


@query(f"WITH x AS ({_P['java']}) SELECT path, path || '//H' || k || '//r' || k AS caller, 'lib' || k || '//aw' || k AS callee, CAST(1 AS BIGINT) AS n FROM x UNION ALL SELECT path, path || '//H' || k || '//r' || k, path || '//H' || k || '//w' || k, CAST(2 AS BIGINT) FROM x")
def call_java_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a chain the innermost call is an edge, as it is written without its brackets; calls in the arguments from its third call on are there twice."""
    line = _braces("class H{k} <<\n  int w{k}() << return 1; >>\n  void r{k}() <<\n    lib{k}.a(w{k}()).b().c();\n  >>\n>>", **PART)
    found = parse.call_edges(parts(spark, sf_dir, "java", line)).filter(F.col("caller").contains("//r") & ~F.col("caller").contains("//this"))
    return found.groupBy("path", "caller", "callee").agg(F.count("*").alias("n"))


@query(f"WITH x AS ({_P['py']}) SELECT path, CAST(60 AS INTEGER) AS depth, true AS truncated FROM (SELECT DISTINCT path FROM x)")
def syntax_depth_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syntax nested too deep is left out, and the file says so."""
    paths = table(spark, sf_dir, "part").select(F.expr(PART_PATH["py"]).alias("path")).distinct()
    deep = "x = " + "(" * 60 + "f()" + ")" * 60
    found = parse.limits(S.from_dataframe(paths.withColumn("content", F.lit(deep))))
    return found.select("path", F.lit(60).alias("depth"), F.col("calls_truncated").alias("truncated"))


@query(f"WITH x AS ({_P['py']}) SELECT path, unnest(['assignments', 'assignments', 'calls']) AS graph, unnest([path || '//v' || k || ' (->0) => [\"a' || s || '\"]', '\"a' || s || '\" (->1) => []', path || '//f' || k || ' (calls)=> [print]']) AS line FROM x WHERE k % 100 = 7")
def graphs_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of both graphs, without built-in names that lead nowhere."""
    rows = table(spark, sf_dir, "part").filter("p_partkey % 100 = 7")
    line = text('v{k} = "a{s}"\ndef f{k}():\n    print()', **PART)
    found = parse.shown_graphs(files(rows, F.expr(PART_PATH["py"]), "p_partkey", line))
    return found.filter(F.col("line").rlike(r'//v\d+ |^"a|//f\d+ \(calls')).select("path", "graph", "line")


# -- traversal ---------------------------------------------------------------------------------------------
@query(f"WITH x AS ({_P['py']}) SELECT path, path || '//a' || k AS namespace, CAST(count(*) AS BIGINT) AS steps FROM (SELECT *, unnest([1, 2]) FROM x) GROUP BY ALL")
def dfs_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name met again gives the ends of its assignments: first through x, then by its own name."""
    line = text("def a{k}(): pass\nx{k} = a{k}\nx{k}()\na{k}()", **PART)
    found = parse.dfs_items(parts(spark, sf_dir, "py", line)).filter(F.col("namespace").rlike("//a[0-9]+$"))
    return found.groupBy("path", "namespace").agg(F.count("*").alias("steps"))


@query(f"WITH x AS ({_P['py']}) SELECT path, path || '//u' || k AS namespace, 'python' AS language FROM x UNION ALL SELECT path, path || '//K' || k, 'javascript' FROM ({_P['js']})")
def dfs_extra_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What nobody calls is a root of its own: Python's functions and classes, not JavaScript's functions."""
    py = parts(spark, sf_dir, "py", text("def u{k}(): pass", **PART))
    js = parts(spark, sf_dir, "js", _braces("function u{k}() << >>\nclass K{k} << >>", **PART))
    return parse.dfs_items(py.unionByName(js)).filter(F.col("namespace") != F.col("path")).select("path", "namespace", "language")


# -- signatures ------------------------------------------------------------------------------------------------
_YAML = """
signatures:
  - id: yaml.calls
    vendor: acme
    product: lib
    languages:
      python:
        match: any
        conditions:
          - type: call
            value: lib3.f7
          - type: call
            value: lib4.*
            args:
              - index: 0
                values: ['"P"']
"""


@query(f"WITH x AS ({_cal('py')}) SELECT path, 'yaml.calls' AS signature_id, 'acme' AS vendor, 'lib' AS product, CAST(max(CASE WHEN m = 3 THEN 1 ELSE 0 END) + max(CASE WHEN m = 4 THEN 1 ELSE 0 END) AS INTEGER) AS matched, count(*) AS evidences, false AS incomplete FROM x WHERE m = 3 AND f = 7 OR m = 4 AND s = 'P' GROUP BY path")
def sig_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures from a YAML file, with vendor and product."""
    conds = signatures.load_yaml(spark, stored(spark, {"signatures.yaml": _YAML}, "signatures") + "/signatures.yaml")
    found = signatures.matches(signatures.evidence(parse.dfs_items(corpora.python_calls(spark, sf_dir)), conds))
    return found.select("path", "signature_id", "vendor", "product", "matched", "evidences", "incomplete")


@query("SELECT * FROM (VALUES ('a', 'go', 'any', 2, 0, 'call', 'net/http.*'), ('a', 'go', 'any', 2, 1, 'import', 'os'), ('a', 'python', 'all', 1, 0, 'call', 'os.run')) v(signature_id, language, match, total, cond, type, value)")
def sig_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures as conditions; what can't be one raises."""
    for bad in (None, {"id": ""}, {"id": "x", "languages": {"cobol": {"match": "any"}}}, {"id": "x", "languages": {"go": {"match": "some"}}}):
        try:
            signatures.validate([bad])
        except ValueError:
            continue
        raise AssertionError(f"taken for a signature: {bad}")
    made = signatures.conditions(spark, [{"id": "a", "languages": {"go": {"match": "any", "conditions": [_condition("net/http.*"), {"type": "import", "value": "os"}]}, "python": {"match": "all", "conditions": [_condition("os.run")]}}}])
    return made.select("signature_id", "language", "match", "total", "cond", "type", "value")


@query(f"WITH x AS ({_cal('py')}), y AS (SELECT *, CAST(sum(CASE WHEN k % 2 = 0 THEN 4 ELSE 3 END) OVER (PARTITION BY path ORDER BY k) AS INTEGER) AS upto FROM x), z AS (SELECT *, upto - CASE WHEN k % 2 = 0 THEN 4 ELSE 3 END AS r FROM y) SELECT path, path || '//o' || k AS caller, CAST(r + 2 AS INTEGER) AS row, 4 AS start_col, CAST(6 + length('' || k || f) AS INTEGER) + 1 AS end_col, CAST(r + 1 AS INTEGER) AS caller_row, CAST(r + 2 AS INTEGER) AS caller_end_row, true AS library FROM z WHERE m = 2")
def sig_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the identifier and the caller are; a library's callee is nowhere."""
    items = parse.dfs_items(corpora.python_calls(spark, sf_dir), places=True)
    found = signatures.evidence(items, signatures.conditions(spark, [_signature("p", "any", _condition("lib2.*"))]))
    i, c = F.col("identifier_at"), F.col("caller_at")
    return found.select("path", "caller", i["start_row"].alias("row"), i["start_col"].alias("start_col"), i["end_col"].alias("end_col"), c["start_row"].alias("caller_row"), c["end_row"].alias("caller_end_row"), F.col("callee_at").isNull().alias("library"))


# -- plugins ---------------------------------------------------------------------------------------------------
@query(f"WITH x AS ({_PY_LINES}) SELECT count(*) FILTER (WHERE w OR u) AS rows, true AS aborted FROM x")
def plugin_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of a plugin goes to a callback; one that fails ends the run."""
    rows = plugins.run(corpora.python_imports(spark, sf_dir), [plugins.DEPENDENCY_USAGE])["dependency_usage"]
    met = spark.sparkContext.accumulator(0)

    def count(part) -> None:
        for _ in part:
            met.add(1)

    def fail(row) -> None:
        raise RuntimeError("told to fail")

    plugins.each_part(rows, count)
    try:
        plugins.each(rows, fail)
        aborted = False
    except RuntimeError:
        aborted = True
    return spark.createDataFrame([(met.value, aborted)], "rows bigint, aborted boolean")
