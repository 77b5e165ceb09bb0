"""Signatures: which call patterns a file shows.

Conditions are few and are broadcast; steps of call graphs are many and are never
shuffled to meet them.  A wildcard meets by equality with one of a namespace's
prefixes.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import prefixes
from ..functions.tables import LANGUAGES, NS, SEPARATORS

CONDITIONS = "signature_id string, vendor string, product string, language string, match string, total int, cond int, type string, value string, args array<struct<index:int,values:array<string>,resolves_to:array<string>>>"
#: More conditions than this are joined by a shuffle.
MAX_CONDITIONS = 100_000


def validate(signatures: Iterable[dict | None]) -> None:
    """Raises for what can't be a signature."""
    for i, s in enumerate(signatures):
        if not s:
            raise ValueError(f"signature {i} is empty")
        if not s.get("id"):
            raise ValueError(f"signature {i} has no id")
        for code, lang in (s.get("languages") or {}).items():
            if code not in LANGUAGES:
                raise ValueError(f"signature {s['id']}: unknown language {code}")
            if lang.get("match") not in ("any", "all"):
                raise ValueError(f"signature {s['id']}: match is neither any nor all")


def conditions(spark: SparkSession, signatures: list[dict]) -> DataFrame:
    """The conditions of signatures, one row each. Keys: id, languages: {code: {match, conditions: [{type, value, args}]}}."""
    validate(signatures)
    rows = []
    for s in signatures:
        for code, lang in (s.get("languages") or {}).items():
            held = lang.get("conditions") or []
            for i, c in enumerate(held):
                args = [(int(a["index"]), [str(v) for v in a.get("values") or []], [str(v) for v in a.get("resolves_to") or a.get("resolvesto") or []]) for a in c.get("args") or []]
                rows.append((s["id"], s.get("vendor", ""), s.get("product", ""), code, lang["match"], len(held), i, c["type"], c["value"], args))
    return spark.createDataFrame(rows, CONDITIONS)


def load_yaml(spark: SparkSession, path: str) -> DataFrame:
    """Conditions from a YAML file: a list of signatures, or one under ``signatures``."""
    import yaml

    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    held = yaml.safe_load(text)
    return conditions(spark, held.get("signatures", []) if isinstance(held, dict) else held)


def unmatchable(conds: DataFrame) -> DataFrame:
    """Conditions that no call can meet: of another type, or a wildcard that its language's separator hides."""
    hidden = F.lit(False)
    for code, sep in SEPARATORS.items():
        hidden = F.when(F.col("language") == code, F.col("value").endswith("*") & ~F.col("value").endswith(sep + "*")).otherwise(hidden)
    return conds.filter((F.col("type") != "call") | hidden)


def evidence(items: DataFrame, conds: DataFrame) -> DataFrame:
    """Steps (path, language, namespace, caller, identifier_text, args, …) that meet a condition, with its signature, vendor and product.

    Steps with places (``parse.dfs_items``) keep them.
    """
    few = conds.limit(MAX_CONDITIONS + 1).count() <= MAX_CONDITIONS
    ns = F.col("value")
    for code, sep in SEPARATORS.items():
        ns = F.when(F.col("language") == code, F.replace(F.col("value"), F.lit(sep), F.lit(NS))).otherwise(ns)
    calls = conds.filter(F.col("type") == "call").withColumn("ns", ns)
    wild = F.col("ns").endswith(NS + "*")
    keys = calls.withColumn("wild", wild).withColumn("key", F.when(wild, F.regexp_replace("ns", r"//\*$", "")).otherwise(F.col("ns"))).drop("ns")
    sep = F.element_at(F.create_map(*[F.lit(x) for kv in SEPARATORS.items() for x in kv]), F.col("language"))
    keys = keys.withColumn("args", F.transform("args", lambda a: F.struct(a["index"].alias("index"), a["values"].alias("values"), F.transform(a["resolves_to"], lambda v: F.replace(v, sep, F.lit(NS))).alias("resolves_to"))))
    keys = keys.withColumnRenamed("args", "required").drop("type")
    steps = items.select("*", F.explode(F.concat(F.array(F.struct(F.lit(False).alias("wild"), F.col("namespace").alias("key"))), F.transform(prefixes(F.col("namespace")), lambda p: F.struct(F.lit(True).alias("wild"), p.alias("key"))))).alias("k")).select("*", "k.wild", "k.key").drop("k")
    met = steps.join(F.broadcast(keys) if few else keys, ["language", "wild", "key"])

    def one(r):
        free = (F.size(r["values"]) == 0) & (F.size(r["resolves_to"]) == 0)
        arg = F.get(F.col("args"), r["index"])
        fits = F.exists(arg, lambda n: F.when(n["is_literal"], F.array_contains(r["values"], n["ns"])).otherwise(F.array_contains(r["resolves_to"], n["ns"])))
        return free | F.coalesce(fits, F.lit(False))

    return met.filter(F.forall("required", one)).drop("wild", "key", "required")


def matches(found: DataFrame) -> DataFrame:
    """(path, language, signature_id, vendor, product, matched, evidences, incomplete): signatures that a file's evidence meets.

    incomplete: the file's call graph was cut off, so there may be more.
    """
    keys = ("path", "language", "signature_id", "vendor", "product", "match", "total")
    each = found.groupBy(*keys).agg(F.count_distinct("cond").cast("int").alias("matched"), F.count("*").alias("evidences"), F.bool_or("truncated").alias("incomplete"))
    return each.filter((F.col("match") == "any") | (F.col("matched") == F.col("total"))).drop("match", "total")
