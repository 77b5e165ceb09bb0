"""URL verdicts by rules, else by logistic regression on hashed character n-grams.

A URL has a host and a path.  A rule names a host and the start of a path; it
fits its host and all subdomains.  The longest rule that fits decides.  Where
none fits, a model does: character n-grams of host and path are hashed to
BUCKETS weights, and a probability of 1/2 or more blocks.

The model is trained from a small labelled table of URLs.  Training works on the
table of products between the labelled URLs: with an L2 penalty the weights are
a weighted sum of the labelled URLs' feature vectors, so gradient descent moves
one number for each labelled URL; STEPS steps are one expression over a single
row.  The table is refused beyond MAX_LABELLED rows.

The plan is DataFrame operations throughout: training, weights and verdicts.

Defined results: a null URL and one without :// have an empty host and path and
are judged by the model's intercept; equal rows get equal results.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

GRAMS = (2, 3, 4)
BUCKETS = 4096
STEPS, RATE, PENALTY = 200, 0.5, 0.01
MAX_LABELLED = 1000
MAX_RULES = 10_000

#: Words of host names to be blocked and of others, and paths of both, from which a small table of invented URLs is made.
BAD = "casino poker slots bet bets jackpot lottery win winner prize bonus free cheap pills viagra pharma adult porn xxx sex cams dating escort ads adserver track tracker click popup spam scam phish warez crack keygen torrent malware replica loan crypto".split()
GOOD = "news library museum school university college hospital council weather garden kitchen recipe history science physics travel railway museum music theatre book reader sport football farm bakery archive journal forum city river mountain energy health law court art film radio guide manual open data linux python garden bird forest nature energy bank post office sea harbour letter nation rest thing other land then".split()
BAD_PATHS = ("bonus?ref=88", "buy-now.html?utm_source=spam", "free/download.exe", "win/win.php?id=9", "click?aff=7")
PATHS = ("en/1204", "de/guide.html", "fr/77", "es/index.html", "articles/history#top", "news/2021/05/report", "", "blog/3?page=2", "about.html", "docs/a/b.html?utm_source=feed")
PREFIXES, TLDS = ("www.", "", "m.", "blog.", "shop."), ("com", "net", "org", "info", "de", "fr")


def _labelled() -> list[tuple[str, int]]:
    """(url, 1 for what is to be blocked): three hosts for each word; two of three bad ones have paths like the others'."""
    out = []
    for label, words in ((1, BAD), (0, sorted(set(GOOD)))):
        for i, word in enumerate(words):
            for k, mate in enumerate((words[(i * 7 + 3) % len(words)], str(i % 9 + 1), "")):
                name = f"{word}{'-' if i % 2 and mate else ''}{mate}"
                path = BAD_PATHS[i % len(BAD_PATHS)] if label and k == i % 3 else PATHS[(3 * i + k) % len(PATHS)]
                out.append((f"http{'s' if i % 2 else ''}://{PREFIXES[(i + 2 * k) % len(PREFIXES)]}{name}.example{i % 4 or ''}.{TLDS[(i + k) % len(TLDS)]}/{path}", label))
    return out


LABELLED = _labelled()


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)


def features(host: Column, path: Column) -> Column:
    """Buckets of the distinct character n-grams of host and path."""

    def grams(x: Column, mark: str, n: int) -> Column:
        padded = F.concat(F.lit("^"), x, F.lit("$"))
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - (n - 1)))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substring(padded, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))

    parts = [grams(x, mark, n) for x, mark in ((host, "h"), (path, "p")) for n in GRAMS]
    return F.when((host == "") & (path == ""), F.expr("CAST(array() AS array<int>)")).otherwise(F.array_distinct(F.concat(*parts)))


def _dot(xs: Column, ys: Column) -> Column:
    return F.aggregate(F.zip_with(xs, ys, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def train(labelled: DataFrame) -> DataFrame:
    """One row (intercept double, weights array<double> of BUCKETS) for labelled (url, label)."""
    if labelled.limit(MAX_LABELLED + 1).count() > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled URLs")
    host, path = host_and_path(F.col("url"))
    f = features(host, path)
    rows = labelled.filter("label IS NOT NULL").select(f.alias("f"), F.col("label").cast("double").alias("y"))
    one = rows.agg(F.array_sort(F.collect_list(F.struct("f", "y"))).alias("all"))
    # A feature vector has equal entries and length 1.
    one = one.select(F.transform("all", lambda r: r["f"]).alias("fs"), F.transform("all", lambda r: r["y"]).alias("ys"))

    def product(a: Column, b: Column) -> Column:
        both = F.sqrt(F.greatest(F.size(a), F.lit(1)).cast("double") * F.greatest(F.size(b), F.lit(1)))
        return F.size(F.array_intersect(a, b)) / both

    # A row of a few thousand numbers, written so that it is computed once.
    one = written(one.withColumn("k", F.transform("fs", lambda a: F.transform("fs", lambda b: product(a, b)))), "url-products")
    n = F.greatest(F.size("ys"), F.lit(1))

    def step(st: Column, _: Column) -> Column:
        # Error of each labelled URL under the present weights.
        miss = F.zip_with(F.col("k"), F.col("ys"), lambda row, y: y - 1.0 / (1.0 + F.exp(-(st["b"] + _dot(row, st["a"])))))
        held = F.transform(F.array(miss), lambda m: F.struct(F.zip_with(st["a"], m, lambda a, e: a * (1.0 - RATE * PENALTY) + RATE * e).alias("a"), (st["b"] + RATE * F.aggregate(m, F.lit(0.0), lambda s, e: s + e) / n).alias("b")))
        return held[0]

    begin = F.struct(F.transform("ys", lambda y: F.lit(0.0)).alias("a"), F.lit(0.0).alias("b"))
    fit = written(one.select("fs", F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), begin, step).alias("m")), "url-model")
    spread = fit.select(F.posexplode("fs").alias("i", "f"), "m").select(F.explode("f").alias("j"), (F.col("m.a")[F.col("i")] / F.sqrt(F.size("f").cast("double"))).alias("w"))
    # The intercept goes along as a bucket of its own.
    sums = spread.groupBy("j").agg(F.sum("w").alias("w")).unionByName(fit.select(F.lit(-1).alias("j"), F.col("m.b").alias("w")))
    full = F.map_from_entries(F.collect_list(F.struct("j", "w")))

    def weight(j: Column) -> Column:
        return F.coalesce(F.try_element_at(F.col("w"), j), F.lit(0.0))

    return sums.agg(full.alias("w")).select(weight(F.lit(-1)).alias("intercept"), F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), weight).alias("weights"))


def _constant(values: Sequence[float]) -> Column:
    """An array literal by one text, folded to a constant once."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def block_probability(host: Column, path: Column, intercept: float, weights: Sequence[float]) -> Column:
    table = _constant(weights)
    f = features(host, path)
    held = F.transform(F.array(f), lambda x: F.aggregate(x, F.lit(0.0), lambda s, j: s + F.get(table, j)) / F.sqrt(F.greatest(F.size(x), F.lit(1)).cast("double")))
    return 1.0 / (1.0 + F.exp(-(held[0] + intercept)))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(host, path, verdict) of the longest rule that fits, else null. Ties: the longer host."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    ranked = sorted(set(rules), key=lambda r: (-len(r[0]) - len(r[1]), -len(r[0]), r))
    table = F.from_json(F.lit(json.dumps([{"host": h, "path": p, "verdict": v} for h, p, v in ranked])), "array<struct<host:string,path:string,verdict:string>>")
    return F.get(F.filter(table, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"])), F.lit(0))


def verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]], labelled: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, probability) for each row of pages. rules: (host, path, allow or block)."""
    model = train(labelled).collect()[0]
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.select("*", longest_rule(F.col("host"), F.col("path"), rules).alias("r"), block_probability(F.col("host"), F.col("path"), model["intercept"], model["weights"]).alias("probability"))
    by_model = F.when(F.col("probability") >= 0.5, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.concat("r.host", "r.path").alias("rule"), F.coalesce("r.verdict", by_model).alias("verdict"), "probability")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The table LABELLED."""
    return spark.sql("SELECT inline(from_json(:rows, 'array<struct<url:string,label:int>>'))", args={"rows": json.dumps([{"url": u, "label": y} for u, y in LABELLED])})
