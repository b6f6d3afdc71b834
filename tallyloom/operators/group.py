"""Group features (inventory F): fitted statistics, one aggregation per key set, joined to every row.

Grouping always aggregates first (map-side combine keeps hot keys small) and then joins one row per
key back; windows over whole groups are not used.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.core import attach, match, small_keys, small_rows, stat, stored, with_scalars
from tallyloom.ranks import quantile_tables, quantiles
from tallyloom.spec import Fitted, in_scope


def _name(*parts: str) -> str:
    return "_".join(parts)


def group_transform(df: DataFrame, keys: Sequence[str], col: str, aggs: Sequence[str], source: DataFrame | None = None) -> DataFrame:
    """Group statistics of ``col`` on every row."""
    source = df if source is None else source
    stats = source.groupBy(*keys).agg(*[stat(source, col, a).alias(_name(col, *keys, a)) for a in aggs])
    return attach(df, stats, keys, small=small_keys(source, [keys], len(aggs))[tuple(keys)])


def fit_group_encode(
    df: DataFrame, triples: Sequence[tuple[str, Sequence[str], Sequence[str]]], scope: str = "all",
    null_value=None, fill=None,
    source: DataFrame | None = None,
) -> Fitted:
    """Statistics for (column, keys, aggregates) requests; requests that share keys share one ``groupBy``.

    ``null_value`` is read as missing before aggregating; ``fill`` replaces missing results.
    """
    source = in_scope(df, scope, source)
    columns = {col for col, _, _ in triples}
    if null_value is not None:
        source = source.withColumns({c: F.when(F.col(c) != null_value, F.col(c)) for c in columns})
    by_keys: dict[tuple[str, ...], list[tuple[str, str]]] = {}
    for col, keys, aggs in triples:
        by_keys.setdefault(tuple(keys), []).extend((col, a) for a in aggs)
    small = small_keys(source, list(by_keys), max(len(w) for w in by_keys.values()))
    tables = {
        keys: source.groupBy(*keys).agg(*[stat(source, c, a).alias(_name(c, *keys, a)) for c, a in wanted])
        for keys, wanted in by_keys.items()
    }

    def apply(rows: DataFrame) -> DataFrame:
        for keys, table in tables.items():
            rows = attach(rows, table, keys, small=small[keys])
            if fill is not None:
                rows = rows.withColumns(
                    {_name(c, *keys, a): F.coalesce(F.col(_name(c, *keys, a)), F.lit(fill)) for c, a in by_keys[keys]}
                )
        return rows

    return Fitted(tables, apply)


def group_encode(df: DataFrame, triples, scope: str = "all", null_value=None, fill=None, source: DataFrame | None = None) -> DataFrame:
    return fit_group_encode(df, triples, scope, null_value, fill, source).transform(df)


def group_nunique(df: DataFrame, keys: Sequence[str], cols: Sequence[str], scope: str = "all", source: DataFrame | None = None) -> DataFrame:
    """Distinct values of each column per group, on every row.

    Distinct (keys, value) pairs are built first, so a hot group is spread over its values.
    """
    source = in_scope(df, scope, source)
    stats = source.groupBy(*keys).agg(*[F.count_distinct(c).alias(_name(c, *keys, "nunique")) for c in cols])
    return attach(df, stats, keys, small=small_keys(source, [keys], len(cols))[tuple(keys)])


@dataclass(frozen=True)
class KeyCounts:
    """Row counts of several key sets, taken in one pass: ``table`` has the keys, ``_n``, and ``_set``, the number of the set.

    Null keys are levels of their own here; they match no row when a table is joined.
    """

    table: DataFrame
    sets: list[tuple[str, ...]]
    small: dict[tuple[str, ...], bool]

    def of(self, keys: Sequence[str]) -> DataFrame:
        """``keys`` and ``_n`` of one key set, summed up from a larger set where it was not counted itself."""
        keys = list(keys)
        for i, own in enumerate(self.sets):
            if set(own) == set(keys):
                return self.table.where(F.col("_set") == i).select(*keys, "_n")
        return self.above(keys).groupBy(*keys).agg(F.sum("_n").alias("_n"))

    def above(self, keys: Sequence[str]) -> DataFrame:
        """The counts of a set that holds ``keys``."""
        i, own = next((i, s) for i, s in enumerate(self.sets) if set(keys) <= set(s))
        return self.table.where(F.col("_set") == i).select(*own, "_n")

    def fits(self, keys: Sequence[str]) -> bool:
        """Whether a table of these keys is small enough to broadcast; one of fewer keys is no longer."""
        return any(small for own, small in self.small.items() if set(keys) <= set(own))


def count_keys(source: DataFrame, key_sets: Sequence[Sequence[str]]) -> KeyCounts:
    """Count the rows of all key sets with one expand and one shuffle of the facts.

    Sets that lie inside another one are not expanded: they are sums over its groups.  The counts are stored, and their real
    sizes, not estimates, decide which of them may be broadcast.
    """
    wanted = [tuple(dict.fromkeys(k)) for k in key_sets]
    top = [k for i, k in enumerate(wanted) if not any(set(k) < set(o) or (set(k) == set(o) and j < i) for j, o in enumerate(wanted))]
    cols = list(dict.fromkeys(c for k in top for c in k))
    # grouping_id has a bit per column, the first one highest, that is set where the column is not in the set
    ids = {sum(1 << (len(cols) - 1 - n) for n, c in enumerate(cols) if c not in k): i for i, k in enumerate(top)}
    grouped = source.select(*cols).groupingSets([list(k) for k in top], *cols).agg(F.count(F.lit(1)).alias("_n"), F.grouping_id().alias("_id"))
    number = reduce(lambda when, pair: when.when(F.col("_id") == pair[0], pair[1]), ids.items(), F.when(F.lit(False), -1))
    table = stored(grouped.select(*cols, "_n", number.alias("_set")), "key-counts")
    return KeyCounts(table, top, small_rows(table, "_set", top))


def _counted(df: DataFrame, key_sets: dict[str, Sequence[str]], source: DataFrame) -> DataFrame:
    """Add one count column per key set; all key sets are counted in one pass."""
    counts = count_keys(source, list(key_sets.values()))
    for name, keys in key_sets.items():
        stats = counts.of(keys).withColumnRenamed("_n", name)
        df = attach(df, stats, keys, small=counts.fits(keys)).withColumn(name, F.coalesce(name, F.lit(0)))
    return df


def group_count(df: DataFrame, keys: Sequence[str], scope: str = "all", name: str | None = None, source: DataFrame | None = None) -> DataFrame:
    """Group size on every row; groups not seen in scope get 0."""
    return _counted(df, {name or _name(*keys, "count"): keys}, in_scope(df, scope, source))


def level_counts(df: DataFrame, cols: Sequence[str], scope: str, suffix: str, source: DataFrame | None = None) -> DataFrame:
    """Rows of each column's level in scope; unseen levels get 0."""
    return _counted(df, {c + suffix: [c] for c in cols}, in_scope(df, scope, source))


def stats_pack(df: DataFrame, targets: Sequence[str], groups: Sequence[str], scope: str = "all", null_std=0.0, source: DataFrame | None = None) -> DataFrame:
    """Size, mean, std, median, max and min of every target by every other group column.

    One aggregation per group column covers all targets; medians inside large groups are selected for all
    columns together.
    """
    source = in_scope(df, scope, source)
    small = small_keys(source, [[g] for g in groups], 6 * len(targets))
    wanted = {g: [t for t in targets if t != g] for g in groups}
    aggs: dict[str, list[Column]] = {g: [] for g in groups}
    for g in groups:
        for t in wanted[g]:
            base = _name(t, "by", g)
            std = stat(source, t, "std")
            aggs[g] += [
                stat(source, t, "size").alias(base + "_size"),
                stat(source, t, "mean").alias(base + "_mean"),
                (std if null_std is None else F.coalesce(std, F.lit(null_std))).alias(base + "_std"),
                stat(source, t, "max").alias(base + "_max"),
                stat(source, t, "min").alias(base + "_min"),
            ]
    tables = quantile_tables(source, [([g], wanted[g]) for g in groups], {"m": 0.5}, [aggs[g] for g in groups])
    for g, table in zip(groups, tables):
        medians = [_name(t, "by", g) + "_median" for t in wanted[g]]
        table = table.withColumnsRenamed(dict(zip([f"{t}|m" for t in wanted[g]], medians)))
        order = [f"{_name(t, 'by', g)}_{s}" for s in ("size", "mean", "std", "max", "min") for t in wanted[g]]
        df = attach(df, table.select(g, *order, *medians), [g], small=small[(g,)])
    return df


def stats_by(df: DataFrame, key: str, col: str, scope: str = "all", source: DataFrame | None = None) -> DataFrame:
    """Mean, median, max, min and std of one column by key; the std of a single row stays null."""
    return stats_pack(df, [col], [key], scope, None, source)


def freq_encode(df: DataFrame, cols: Sequence[str], scope: str = "all", source: DataFrame | None = None) -> DataFrame:
    """Share of each value among the non-null values in scope; unseen values stay null."""
    source = in_scope(df, scope, source)
    small = small_keys(source, [[c] for c in cols], 1)
    df = with_scalars(df, source, {c: F.count(c) for c in cols}, "_total")
    for c in cols:
        counts = source.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
        df = attach(df, counts, [c], small=small[(c,)])
        df = df.withColumn(f"{c}_freq", F.try_divide(F.col("_n").cast("double"), F.col(f"_total.{c}"))).drop("_n")
    return df.drop("_total")


def log_count(df: DataFrame, cols: Sequence[str], scope: str = "all", source: DataFrame | None = None) -> DataFrame:
    """ln(count + 1) of each value."""
    counted = level_counts(df, cols, scope, "_log_count", source)
    return counted.withColumns({f"{c}_log_count": F.log1p(F.col(f"{c}_log_count").cast("double")) for c in cols})


def _shares(counts: KeyCounts, key: str, resource: str) -> DataFrame:
    """count(key, resource) / count(key) per pair; the key's own count is summed up from its pairs."""
    pairs = counts.of([key, resource])
    owners = pairs.groupBy(key).agg(F.sum("_n").alias("_own"))
    return match(pairs, owners, [key], "inner").select(key, resource, F.try_divide(F.col("_n").cast("double"), F.col("_own")).alias(f"{key}_{resource}_share"))


def usage_share(df: DataFrame, keys: Sequence[str], resource: str, scope: str = "all", source: DataFrame | None = None) -> DataFrame:
    """count(key, resource) / count(key) for each key column; unseen pairs get 0.

    All pairs are counted in one pass; key counts are rolled up from them.
    """
    counts = count_keys(in_scope(df, scope, source), [[k, resource] for k in keys])
    for k in keys:
        name = f"{k}_{resource}_share"
        df = attach(df, _shares(counts, k, resource), [k, resource], small=counts.fits([k, resource])).withColumn(name, F.coalesce(name, F.lit(0.0)))
    return df


def access_pack(df: DataFrame, cats: Sequence[str], resource: str, scope: str = "all", source: DataFrame | None = None) -> DataFrame:
    """:func:`log_count`, :func:`usage_share`, :func:`group_nunique` and :func:`crosstab_encode` of all columns from one pass.

    The facts are expanded to the pairs of columns once; everything else is summed up from the pair counts.  Columns that
    would hold one value on all rows in scope are found on the counts and never joined.
    """
    source = in_scope(df, scope, source)
    counts = count_keys(source, [list(p) for p in combinations(cats, 2)] if len(cats) > 1 else [list(cats)])
    tables: dict[tuple[str, ...], tuple[DataFrame, dict]] = {}
    for a, b in combinations(cats, 2):
        n = f"{a}_{b}_n"
        table = counts.of([a, b]).select(a, b, F.col("_n").alias(n), F.log1p(F.col("_n").cast("double")).alias(f"{a}_{b}_log"))
        fills = {n: 0, f"{a}_{b}_log": 0.0}
        if resource in (a, b):
            key = a if b == resource else b
            table = match(table, _shares(counts, key, resource), [a, b])
            fills[f"{key}_{resource}_share"] = 0.0
        tables[a, b] = (table, fills)
    for c in cats:
        above = counts.above([c])
        aggs, fills = [F.log1p(F.sum("_n").cast("double")).alias(f"{c}_log_count")], {f"{c}_log_count": 0.0}
        if c != resource:
            above = counts.of([c, resource])
            aggs.append(F.count(resource).alias(_name(resource, c, "nunique")))
            fills[_name(resource, c, "nunique")] = None
        tables[(c,)] = (above.groupBy(c).agg(*aggs), fills)
    constant = _constant(counts, cats, resource)
    for keys, (table, fills) in tables.items():
        kept = [f for f in fills if f not in constant]
        if kept:
            df = attach(df, table.select(*keys, *kept), keys, small=counts.fits(keys))
            df = df.withColumns({f: F.coalesce(f, F.lit(fills[f])) for f in kept if fills[f] is not None})
    return df


def _constant(counts: KeyCounts, cats: Sequence[str], resource: str) -> set[str]:
    """Features of :func:`access_pack` with one non-null value over the counted rows, from two aggregations of the counts.

    Rows with a null key, or with a null resource in a share, hold 0.
    """

    def one(low: Column, high: Column) -> Column:
        return F.min(low).eqNullSafe(F.max(high)) & (F.count(low) > 0)

    unkeyed = reduce(lambda w, i: w.when(F.col("_set") == i, reduce(lambda a, b: a | b, [F.col(k).isNull() for k in counts.sets[i]])), range(len(counts.sets)), F.when(F.lit(False), True))
    n = F.when(unkeyed, 0).otherwise(F.col("_n"))
    same_pairs = [counts.sets[r["_set"]] for r in counts.table.groupBy("_set").agg(one(n, n).alias("same")).where("same").collect()]
    out = {f"{a}_{b}_{kind}" for a, b in combinations(cats, 2) if (a, b) in same_pairs for kind in ("n", "log")}
    parts = []
    for c in cats:
        above = counts.above([c]) if c == resource else counts.of([c, resource])
        other = next((k for k in above.columns if k not in (c, "_n")), c)
        parts.append(above.select(F.lit(c).alias("c"), F.col(c).cast("string").alias("k"), F.col(other).isNotNull().alias("known"), "_n"))
    known = F.when(F.col("known"), F.col("_n"))
    per = reduce(DataFrame.union, parts).groupBy("c", "k").agg(
        F.sum("_n").alias("own"), F.min(known).alias("low"), F.max(known).alias("high"), F.count_if("known").alias("met"), F.count_if(~F.col("known")).alias("unmet")
    )
    null = F.col("k").isNull()
    own = F.when(null, 0).otherwise(F.col("own"))
    least, most = (F.when(null, 0.0).otherwise(F.try_divide(F.col(x).cast("double"), F.col("own"))) for x in ("low", "high"))
    least = F.when(null | (F.col("unmet") > 0), 0.0).otherwise(least)
    met = F.when(~null, F.col("met"))
    for r in per.groupBy("c").agg(one(own, own).alias("log"), one(least, F.coalesce(most, F.lit(0.0))).alias("share"), one(met, met).alias("met")).collect():
        names = {"log": f"{r['c']}_log_count"} | ({} if r["c"] == resource else {"share": f"{r['c']}_{resource}_share", "met": _name(resource, r["c"], "nunique")})
        out |= {name for flag, name in names.items() if r[flag]}
    return out


def first_seen(df: DataFrame, keys: Sequence[str], period: str) -> DataFrame:
    """First period of each key and its offset to the first period of all."""
    stats = df.groupBy(*keys).agg(F.min(period).alias("first_seen"))
    out = with_scalars(stats, df, {"start": F.min(period)})
    return out.withColumn("first_offset", F.col("first_seen") - F.col("_s.start")).drop("_s")


def norm_by(df: DataFrame, keys: Sequence[str], col: str, agg: str, source: DataFrame | None = None) -> DataFrame:
    """Value divided by its group's max or mean."""
    ref = _name(col, *keys, agg)
    return group_transform(df, keys, col, [agg], source).withColumn(
        _name(col, "over", *keys, agg), F.try_divide(F.col(col).cast("double"), F.col(ref).cast("double"))
    ).drop(ref)


def filtered_count_ratio(df: DataFrame, key: str, predicate: Column, denom: str, name: str) -> DataFrame:
    """Rows of the key that pass the predicate, divided by a field of the row."""
    stats = df.groupBy(key).agg(F.count_if(predicate).alias("_hits"))
    joined = attach(df, stats, [key], small=small_keys(df, [[key]], 1)[(key,)])
    return joined.withColumn(name, F.try_divide(F.col("_hits").cast("double"), F.col(denom).cast("double"))).drop("_hits")


def crosstab_encode(df: DataFrame, cols: Sequence[str], scope: str = "all", source: DataFrame | None = None) -> DataFrame:
    """Count and ln(count + 1) of each unordered pair of columns, on every row; unseen pairs get 0."""
    pairs = list(combinations(cols, 2))
    df = _counted(df, {f"{a}_{b}_n": [a, b] for a, b in pairs}, in_scope(df, scope, source))
    return df.withColumns({f"{a}_{b}_log": F.log1p(F.col(f"{a}_{b}_n").cast("double")) for a, b in pairs})


def entity_smooth(labels: DataFrame, preds: DataFrame, entity_cols: Sequence[str]) -> DataFrame:
    """Replace predictions by their entity's mean over labels and predictions, once per entity column.

    Both inputs hold ``y`` and the entity columns; a null entity keeps its value.  Each pass works on
    the outcome of the previous one.
    """
    both = labels.withColumn("_is_pred", F.lit(0)).unionByName(preds.withColumn("_is_pred", F.lit(1)))
    small = small_keys(both, [[e] for e in entity_cols], 1)
    for e in entity_cols:
        means = both.where(F.col(e).isNotNull()).groupBy(e).agg(F.avg("y").alias("_m"))
        both = attach(both, means, [e], small=small[(e,)])
        both = both.withColumn("y", F.coalesce("_m", "y")).drop("_m")
    return both.where("_is_pred = 1").drop("_is_pred")


def group_mean_preds(preds: DataFrame, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Mean of row predictions per key, for every prediction column."""
    return preds.groupBy(*key).agg(*[stat(preds, c, "mean").alias(c) for c in cols])


def fold_summary(scores: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Mean and population std of a score over folds."""
    return scores.groupBy(*by).agg(stat(scores, col, "mean").alias("score_mean"), stat(scores, col, "std_pop").alias("score_std"))


def group_median(df: DataFrame, keys: Sequence[str], col: str, name: str | None = None, source: DataFrame | None = None) -> DataFrame:
    """Exact group median on every row."""
    source = df if source is None else source
    small = small_keys(source, [keys], 4)[tuple(keys)]
    table = quantiles(source, keys, col, {name or _name(col, *keys, "median"): 0.5})
    return attach(df, table, keys, small=small)


def global_stats(df: DataFrame, cols: Sequence[str], aggs: Sequence[str], scope: str = "all", source: DataFrame | None = None) -> DataFrame:
    """Global statistics as columns, read from a one-row subquery."""
    source = in_scope(df, scope, source)
    names = [(c, a) for c in cols for a in aggs]
    out = with_scalars(df, source, {_name(c, a): stat(source, c, a) for c, a in names})
    return out.withColumns({_name(c, a): F.col(f"_s.{_name(c, a)}") for c, a in names}).drop("_s")


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """Rows per target value, nulls included."""
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))


def concat_count(df: DataFrame, token: str, scope: str = "all", name: str = "combo") -> DataFrame:
    """Join all columns whose name holds ``token`` into one level and count it; unseen levels get 0.

    The tuple of columns is what is counted; the joined text, which values holding "_" can share, is for display.
    """
    cols = [c for c in df.columns if token in c]
    counts = in_scope(df, scope).groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    text = F.concat_ws("_", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols])
    return match(df, counts, cols).withColumns({name: text, f"{name}_count": F.coalesce("_n", F.lit(0))}).drop("_n")
