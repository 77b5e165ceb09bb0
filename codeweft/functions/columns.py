"""Operators on single values as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import comment_pattern, token_pattern
from .tables import GO_HOSTS, GO_ROOTS, NS, SEPARATORS


# -- imports ----------------------------------------------------------------------------
def normalised(module: Column, item: Column, alias: Column, language: str) -> tuple[Column, Column, Column]:
    """An import's contents as they are used: Go's lose their quotes, and the alias is its last part."""
    if language != "go":
        return module, item, alias
    plain = [F.btrim(x, F.lit('"')) for x in (module, item, alias)]
    return plain[0], plain[1], F.element_at(F.split(plain[2], "/"), -1)


def identifier_key(module: Column, item: Column, alias: Column) -> Column:
    """The name an import is used by: alias, else item, else module."""
    return F.when(alias != "", alias).when(item != "", item).otherwise(module)


def _first(parts: Column, n: int, sep: str) -> Column:
    return F.array_join(F.slice(parts, 1, n), sep)


def package_hint(module: Column, language: str) -> Column:
    """The package a module belongs to; empty where it can't be told."""
    if language == "python":
        return F.substring_index(module, ".", 1)
    if language == "java":
        return F.when(module.startswith("java") | module.startswith("jdk"), _first(F.split(module, r"\."), 2, ".")).otherwise("")
    bare = F.btrim(module, F.lit("/"))
    parts = F.split(bare, "/")
    if language == "javascript":
        return F.when(bare.startswith("."), bare).when(bare.startswith("@"), _first(parts, 2, "/")).otherwise(parts[0])
    if language == "go":
        host = F.btrim(parts[0])

        def with_version(n: int) -> Column:
            return F.when((F.size(parts) > n) & F.coalesce(F.get(parts, F.lit(n)), F.lit("")).rlike(r"v\d+$"), _first(parts, n + 1, "/")).otherwise(_first(parts, n, "/"))

        return F.when(bare == "", "").when(host.isin(*GO_ROOTS), host).when(host.isin(*GO_HOSTS), with_version(3)).when(F.size(parts) >= 2, with_version(2)).otherwise(bare)
    return module


def namespace(name: Column, language: str) -> Column:
    """A dotted or slashed name as a namespace."""
    return F.replace(name, F.lit(SEPARATORS[language]), F.lit(NS))


def prefixes(ns: Column) -> Column:
    """All proper prefixes of a namespace, shortest first."""
    parts = F.split(ns, NS)
    return F.transform(F.slice(F.sequence(F.lit(0), F.size(parts) - 1), 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda i: F.array_join(F.slice(parts, 1, i), NS))


def scopes(scope: Column, symbol: Column) -> Column:
    """Where a symbol may be found from a scope, innermost first, the bare symbol last."""
    parts = F.split(scope, NS)
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda i: F.when(i == 0, symbol).otherwise(F.concat_ws(NS, F.slice(parts, 1, i), symbol)))


# -- tokens -----------------------------------------------------------------------------
def tokens(text: Column, language: str) -> Column:
    """All tokens of a text, white space and comments included; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(token_pattern(language)), F.lit(0))


def is_comment(token: Column, language: str) -> Column:
    return token.rlike(comment_pattern(language))


def without_comments(text: Column, language: str) -> Column:
    """A text without comments, and nothing after its last token. For languages whose comments are tokens."""
    if language != "javascript":
        raise NotImplementedError("strings that stand alone need the statements around them: see operators.parse.strip_comments")
    toks = tokens(text, language)
    blank = r"^\s*$"
    last = F.aggregate(F.transform(toks, lambda t: t.rlike(blank)), F.struct(F.lit(0).alias("i"), F.lit(0).alias("n")), lambda a, b: F.struct((a["i"] + 1).alias("i"), F.when(b, a["n"]).otherwise(a["i"] + 1).alias("n")))["n"]
    return F.array_join(F.filter(F.slice(toks, 1, last), lambda t: ~is_comment(t, language)), "")


def exported(name: Column) -> Column:
    """Whether a Go name is visible outside its package."""
    return name.rlike("^[A-Z]")
