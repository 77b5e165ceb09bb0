"""Source files made from columns of the test tables.

What a query should find is known from the columns, so it can be checked without
parsing anything.  Files hold about 100 keys each, so their size doesn't grow
with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import from_dataframe


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(pattern: str, **parts: str) -> Column:
    """A text with SQL expressions for its {names}."""
    out, rest = [], pattern
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(head), F.expr(parts[name]).cast("string")]
    return F.concat(*out, F.lit(rest)) if out else F.lit(pattern)


def files(rows: DataFrame, path: Column, key: str, lines: Column, head: str = "", tail: str = "") -> DataFrame:
    """Files of the rows' lines in order of key; null lines are left out."""
    each = rows.select(path.alias("path"), F.struct(F.col(key).alias("k"), lines.alias("x")).alias("s")).filter("s.x IS NOT NULL")
    body = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["x"]), "\n")
    made = each.groupBy("path").agg(F.concat(F.lit(head), body, F.lit(tail)).alias("content"))
    return from_dataframe(made, rel_path="path")


PART = {"k": "p_partkey", "t": "lower(p_type)", "a": "split_part(p_name, ' ', 1)", "b": "split_part(p_name, ' ', 2)", "s": "p_size"}
PART_PATH = {"py": "concat('src/', replace(p_brand, '#', ''), '/', p_partkey DIV 100, '.py')", "js": "concat('web/', p_partkey DIV 100, '.js')", "go": "concat('go/', p_partkey DIV 100, '.go')", "java": "concat('jv/', p_partkey DIV 100, '.java')"}


def _case(pairs: list[tuple[str, Column]], last: Column) -> Column:
    out = last
    for when, value in reversed(pairs):
        out = F.when(F.expr(when), value).otherwise(out)
    return out


def python_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as imports, wildcards for key % 7 = 0, whole modules for key % 5 = 0; even keys of the rest are used."""
    line = _case([("p_partkey % 7 = 0", text("from {t}.{a} import *", **PART)), ("p_partkey % 5 = 0", text("import {t} as m{k}", **PART)), ("p_partkey % 2 = 0", text("from {t}.{a} import {b} as p{k}\np{k}.run({s})  # call {k}", **PART))], text("from {t}.{a} import {b} as p{k}", **PART))
    return files(table(spark, sf_dir, "part"), F.expr(PART_PATH["py"]), "p_partkey", line)


ORDER = {"k": "o_orderkey", "c": "o_custkey", "s": "lower(o_orderstatus)", "S": "o_orderstatus", "m": "o_custkey % 10", "f": "o_orderkey % 50"}


def javascript_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as imports of three kinds by key % 3; even keys are used."""
    line = _case([("o_orderkey % 3 = 0", text('const v{k} = require("@{s}/pkg-{c}");', **ORDER)), ("o_orderkey % 3 = 1", F.concat(F.lit("import { a"), F.col("o_orderkey"), F.lit(" as v"), F.col("o_orderkey"), F.lit(' } from "m/'), F.col("o_custkey"), F.lit('";')))], text('import v{k} from "lib{c}";', **ORDER))
    used = F.when(F.expr("o_orderkey % 2 = 0"), text("\nv{k}.go({c}); // n {k}", **ORDER)).otherwise("")
    return files(table(spark, sf_dir, "orders"), F.expr("concat('web/b', o_orderkey DIV 100, '.js')"), "o_orderkey", F.concat(line, used))


SUPPLIER = {"k": "s_suppkey", "n": "s_nationkey"}


def go_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as import specs of four kinds by key % 4; those with an alias are used."""
    line = _case([("s_suppkey % 4 = 0", text('\ta{k} "github.com/o{n}/r{k}/v2"', **SUPPLIER)), ("s_suppkey % 4 = 1", text('\t_ "github.com/o{n}/r{k}"', **SUPPLIER)), ("s_suppkey % 4 = 2", text('\t. "math/m{k}"', **SUPPLIER))], text('\t"net/http{k}"', **SUPPLIER))
    rows = table(spark, sf_dir, "supplier")
    path = F.expr("concat('go/n', s_nationkey, '_', s_suppkey DIV 1000, '.go')")
    imports = rows.select("*", F.lit(0).alias("o"), line.alias("line"))
    opened = rows.groupBy("s_nationkey", F.expr("s_suppkey DIV 1000").alias("d")).agg(F.min("s_suppkey").alias("s_suppkey")).select("s_nationkey", "s_suppkey")
    head = opened.select("*", F.lit(-1).alias("o"), F.lit("package p\n\nimport (").alias("line"))
    close = opened.select("*", F.lit(1).alias("o"), F.lit(")\n").alias("line"))
    calls = rows.filter("s_suppkey % 4 = 0").select("*", F.lit(2).alias("o"), _braces("func F{k}() <<\n\ta{k}.Do()\n>>", **SUPPLIER).alias("line"))
    parts = [x.select("s_nationkey", "s_suppkey", F.struct("o", "s_suppkey").alias("k"), "line") for x in (head, imports, close, calls)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return files(both, path, "k", F.col("line"))


CUSTOMER = {"k": "c_custkey", "g": "lower(c_mktsegment)", "n": "c_nationkey"}


def java_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as imports of four kinds by key % 4, and a class that uses the first kind."""
    line = _case([("c_custkey % 4 = 0", text("import java.util.C{k};", **CUSTOMER)), ("c_custkey % 4 = 1", text("import com.acme.{g}.C{k};", **CUSTOMER)), ("c_custkey % 4 = 2", text("import org.x{k}.*;", **CUSTOMER))], text("import static java.lang.Math.m{k};", **CUSTOMER))
    return files(table(spark, sf_dir, "customer"), F.expr("concat('jv/', c_custkey DIV 100, '.java')"), "c_custkey", line)


def python_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as definitions of four kinds by key % 4."""
    line = _case(
        [
            ("p_partkey % 4 = 0", text("def f{k}(a, b={s}, *rest):\n    return a", **PART)),
            ("p_partkey % 4 = 1", text("async def f{k}(a: int):\n    return a", **PART)),
            ("p_partkey % 4 = 2", text("class C{k}:\n    def __init__(self, x):\n        self.x = x", **PART)),
        ],
        text("class C{k}:\n    @staticmethod\n    def s{k}(a):\n        return a", **PART),
    )
    return files(table(spark, sf_dir, "part"), F.expr(PART_PATH["py"]), "p_partkey", line)


def _braces(pattern: str, **parts: str) -> Column:
    """Like text, with << and >> for braces."""
    return F.replace(F.replace(text(pattern, **parts), F.lit("<<"), F.lit("{")), F.lit(">>"), F.lit("}"))


def javascript_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _case(
        [
            ("p_partkey % 4 = 0", _braces("function f{k}(a, b = {s}) << return a; >>", **PART)),
            ("p_partkey % 4 = 1", _braces("const f{k} = (x) => x + {s};", **PART)),
            ("p_partkey % 4 = 2", _braces("class C{k} <<\n  constructor(y) << this.y = y; >>\n>>", **PART)),
        ],
        _braces("class C{k} <<\n  async m{k}() << return {s}; >>\n>>", **PART),
    )
    return files(table(spark, sf_dir, "part"), F.expr(PART_PATH["js"]), "p_partkey", line)


def go_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _case(
        [
            ("p_partkey % 3 = 0", _braces("func F{k}(a int) int << return a >>", **PART)),
            ("p_partkey % 3 = 1", _braces("func f{k}() << >>", **PART)),
        ],
        _braces("func (r *T{k}) M{k}(n string) << >>", **PART),
    )
    return files(table(spark, sf_dir, "part"), F.expr(PART_PATH["go"]), "p_partkey", line, "package p\n")


def java_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class for each part: a constructor, overloads, a static method, an abstract one."""
    line = _braces("abstract class K{k} <<\n  K{k}() << >>\n  public static int m{k}(int a) << return a; >>\n  private void o(int a) << >>\n  void o(String b) << >>\n  abstract void z();\n>>", **PART)
    return files(table(spark, sf_dir, "part"), F.expr(PART_PATH["java"]), "p_partkey", line)


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python classes: customers inherit from nations, nations from regions."""
    c = table(spark, sf_dir, "customer").select(F.expr("concat('h/c', c_custkey DIV 100, '.py')").alias("path"), F.col("c_custkey").cast("bigint").alias("k"), text("class C{k}(N{n}):\n    pass", **CUSTOMER).alias("line"))
    n = table(spark, sf_dir, "nation").select(F.lit("h/n.py").alias("path"), F.col("n_nationkey").cast("bigint").alias("k"), text("class N{n}(R{r}): pass", n="n_nationkey", r="n_regionkey").alias("line"))
    return files(c.unionByName(n), F.col("path"), "k", F.col("line"))


def java_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _braces("public class C{k} extends N{n} <<\n  private int x{k} = {n};\n  C{k}() << >>\n  void m() << >>\n>>", **CUSTOMER)
    return files(table(spark, sf_dir, "customer"), F.expr("concat('jv/', c_custkey DIV 100, '.java')"), "c_custkey", line)


def python_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as functions that call a library; even ones are called by the file."""
    line = text('import lib{m} as m{k}\ndef o{k}():\n    m{k}.f{f}("{S}")', **ORDER)
    called = F.when(F.expr("o_orderkey % 2 = 0"), text("\no{k}()", **ORDER)).otherwise("")
    return files(table(spark, sf_dir, "orders"), F.expr("concat('cal/', o_orderkey DIV 100, '.py')"), "o_orderkey", F.concat(line, called))


def javascript_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _braces('const m{k} = require("lib{m}");\nfunction o{k}() << m{k}.f{f}("{S}"); >>', **ORDER)
    return files(table(spark, sf_dir, "orders"), F.expr("concat('cal/', o_orderkey DIV 100, '.js')"), "o_orderkey", line)


def go_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _braces('import m{k} "lib/x{m}"\n\nfunc o{k}() <<\n\tm{k}.F{f}("{S}")\n>>\n', **ORDER)
    return files(table(spark, sf_dir, "orders"), F.expr("concat('cal/', o_orderkey DIV 100, '.go')"), "o_orderkey", line, "package p\n")


def java_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _braces('class K{k} <<\n  void o{k}() <<\n    lib.x{m}.M.f{f}("{S}");\n  >>\n>>', **ORDER)
    return files(table(spark, sf_dir, "orders"), F.expr("concat('cal/', o_orderkey DIV 100, '.java')"), "o_orderkey", line)


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of ten names that end in a literal, and pairs that stand for each other."""
    line = _case([("p_partkey % 10 = 0", text('x{k} = "v{k}"\na{k} = b{k}\nb{k} = a{k}', **PART))], text("x{k} = x{j}", j="p_partkey - 1", **PART))
    return files(table(spark, sf_dir, "part"), F.expr("concat('asg/', p_partkey DIV 100, '.py')"), "p_partkey", line)
