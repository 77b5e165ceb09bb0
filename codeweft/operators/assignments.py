"""What names stand for in the end."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.callgraph import resolve


def resolve_ordered(edges: DataFrame) -> DataFrame:
    """(file, src, ord, leaf): as the walk resolves names, cycles included; edges (file, src, dst, seq)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        targets: dict[str, list[str]] = {}
        for src, dst in pdf.sort_values("seq")[["src", "dst"]].itertuples(index=False):
            mine = targets.setdefault(src, [])
            targets.setdefault(dst, [])
            if dst not in mine:
                mine.append(dst)
        rows = [(pdf["file"].iloc[0], s, i, leaf) for s in targets for i, leaf in enumerate(resolve(targets, s))]
        return pd.DataFrame(rows, columns=["file", "src", "ord", "leaf"])

    return edges.select("file", "src", "dst", "seq").groupBy("file").applyInPandas(run, "file string, src string, ord int, leaf string")


def scope_lookup(uses: DataFrame, names: DataFrame) -> DataFrame:
    """uses (file, scope, symbol) with ns: the innermost of names (file, ns) that the symbol can mean."""
    from ..functions.columns import scopes

    tries = uses.select("*", F.posexplode(scopes(F.col("scope"), F.col("symbol"))).alias("far", "ns"))
    met = tries.join(names.select("file", "ns").distinct(), ["file", "ns"])
    return met.groupBy("file", "scope", "symbol").agg(F.min_by("ns", "far").alias("ns"))
