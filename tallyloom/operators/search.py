"""Automated feature candidates (inventory L): generate, score in one long aggregation, apply."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.core import with_scalars
from tallyloom.functions.scalar import concat_pair
from tallyloom.operators.encode import label_encode
from tallyloom.operators.group import freq_encode

UNARY = {
    "abs": F.abs,
    "log": lambda c: F.when(c != 0, F.log(F.abs(c))),
    "sqrt": lambda c: F.sqrt(F.abs(c)),
    "square": lambda c: c * c,
    "sigmoid": lambda c: 1 / (1 + F.exp(-c)),
    "round": F.rint,
    "residual": lambda c: c - F.floor(c),
}


def candidates_unary(df: DataFrame, cols: Sequence[str], fns: Sequence[str], scope: str = "all") -> DataFrame:
    """One column per (column, function), named ``fn(column)``."""
    if "freq" in fns:
        df = freq_encode(df, cols, scope).withColumnsRenamed({f"{c}_freq": f"freq({c})" for c in cols})
    plain = [f for f in fns if f != "freq"]
    return df.withColumns({f"{f}({c})": UNARY[f](F.col(c).cast("double")) for c in cols for f in plain})


def candidates_combine(df: DataFrame, cats: Sequence[str], scope: str = "all") -> DataFrame:
    """Codes of all pairs of categorical columns, named ``combine(a,b)``."""
    pairs = list(combinations(cats, 2))
    for a, b in pairs:
        df = concat_pair(df, a, b, f"_c_{a}_{b}")
    coded = label_encode(df, [f"_c_{a}_{b}" for a, b in pairs], scope)
    return coded.drop(*[f"_c_{a}_{b}" for a, b in pairs]).withColumnsRenamed(
        {f"_c_{a}_{b}_code": f"combine({a},{b})" for a, b in pairs}
    )


def score_candidates(df: DataFrame, target: str, cands: Sequence[str], bins: int = 16) -> DataFrame:
    """Share of the target's variance that equal-width bins of each candidate explain.

    All candidates are unpivoted and reduced to (candidate, bin) sums in one shuffle; the result has
    one row per candidate.  Missing values are a bin of their own.
    """
    ends = with_scalars(
        df, df, {f"lo_{i}": F.min(F.col(f"`{c}`").cast("double")) for i, c in enumerate(cands)}
        | {f"hi_{i}": F.max(F.col(f"`{c}`").cast("double")) for i, c in enumerate(cands)}
    )

    def binned(i: int, c: str) -> Column:
        low, high = F.col(f"_s.lo_{i}"), F.col(f"_s.hi_{i}")
        share = F.try_divide(F.col(f"`{c}`").cast("double") - low, high - low)
        return F.coalesce(F.least(F.floor(share * bins), F.lit(bins - 1)), F.lit(-1)).cast("int").alias(f"_b{i}")

    wide = ends.select(F.col(target).alias("_y"), *[binned(i, c) for i, c in enumerate(cands)])
    cells = wide.unpivot(["_y"], [f"_b{i}" for i in range(len(cands))], "_cand", "_bin").groupBy("_cand", "_bin").agg(
        F.sum("_y").cast("double").alias("t"), F.sum(F.col("_y") * F.col("_y")).cast("double").alias("tt"), F.count("_y").alias("n")
    )
    sums = cells.groupBy("_cand").agg(
        F.sum("t").alias("t"), F.sum("tt").alias("tt"), F.sum("n").alias("n"),
        F.sum(F.try_divide(F.col("t") * F.col("t"), F.col("n"))).alias("between"),
    )
    centre = F.try_divide(F.col("t") * F.col("t"), F.col("n"))
    names = F.create_map(*[F.lit(x) for i, c in enumerate(cands) for x in (f"_b{i}", c)])
    return sums.select(
        F.try_element_at(names, F.col("_cand")).alias("candidate"),
        F.try_divide(F.col("between") - centre, F.col("tt") - centre).alias("score"),
    )


def best_candidates(scores: DataFrame, n: int = 600) -> DataFrame:
    """The ``n`` best candidates (names break ties)."""
    return scores.orderBy(F.desc("score"), "candidate").limit(n)


def apply_candidates(df: DataFrame, chosen: Sequence[str], scope: str = "all") -> DataFrame:
    """Build the named candidates on both splits."""
    for name in chosen:
        fn, inner = name.split("(", 1)
        parts = inner.rstrip(")").split(",")
        df = candidates_combine(df, parts, scope) if fn == "combine" else candidates_unary(df, parts, [fn], scope)
    return df
