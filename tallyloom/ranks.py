"""Exact quantiles of many columns by many group sets at once, without sorting a group or sampling cut points.

Groups of at most ``BIG`` rows are aggregated as they are: their values fit one aggregation buffer; so are larger ones as long
as all of them together, as counted, hold at most ``FITS`` values, which fit one task.  In all other large groups every
wanted rank is selected digit by digit on an order-preserving 64-bit key: a pass counts the rows per next ``DIGIT`` bits,
combined before the shuffle, and the digit that holds the rank is fixed.  All columns, groups and ranks take part in the
same passes, of which 64 / DIGIT, rounded up, always suffice; values that agree end the search earlier.  Before the
first pass the keys are written, so that a pass reads numbers and does not repeat the joins that made the table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.core import broadcast_limit, stored

BIG = 20_000  # rows of a group that may be aggregated in one buffer
FITS = 1 << 22  # values of all large groups together, about 50 bytes each, that one task may hold
DIGIT = 13
LOWEST = -(1 << 63)


def order_key(df: DataFrame, col: str) -> Column:
    """A long for every non-null number whose order, read as unsigned, is that of the values; equal only for equal values."""
    kind, c = df.schema[col].dataType, F.col(f"`{col}`")
    if isinstance(kind, T.IntegralType):
        key = c.cast("long")
    elif isinstance(kind, T.DecimalType) and kind.precision <= 15:  # below 2^53 a double holds every unit
        key = F.rint(c.cast("double") * float(10**kind.scale)).cast("long")
    elif isinstance(kind, T.DecimalType) and kind.precision <= 18:
        key = (c.cast(f"decimal({18 + kind.scale},{kind.scale})") * F.lit(10**kind.scale).cast("decimal(19,0)")).cast("long")
    else:  # exponent and fraction of a double; values too small for an exponent count in steps of the smallest one
        x = c.cast("double")
        a = F.abs(x)
        near = F.floor(F.log2(a)).cast("int")
        part = a / F.pow(F.lit(2.0), near)
        exponent = near + F.when(part >= 2, 1).when(part < 1, -1).otherwise(0)
        fraction = (a / F.pow(F.lit(2.0), exponent) - 1) * float(1 << 52)
        plain = (exponent + 1023).cast("long") * (1 << 52) + fraction.cast("long")
        tiny = (a * 2.0**537 * 2.0**537).cast("long")
        size = F.when(a < 2.0**-1022, tiny).when(a == float("inf"), 2047 << 52).otherwise(plain)
        key = F.when(F.isnan(x), (1 << 63) - 1).when(x < 0, -size).otherwise(size)
    return key.bitwiseXOR(F.lit(LOWEST).cast("long"))


def _owner(df: DataFrame, keys: Sequence[str]) -> Column:
    """The group as text; one text per group, nulls included."""

    def part(k: str) -> Column:
        c = F.col(f"`{k}`")
        return c + F.lit(0.0).cast(df.schema[k].dataType) if isinstance(df.schema[k].dataType, T.FractionalType) else c  # -0.0 and 0.0 are one group

    return F.to_json(F.struct(F.lit(0).alias("_"), *[part(k).alias(f"k{i}") for i, k in enumerate(keys)]), {"ignoreNullFields": "false"})


def _hinted(df: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """A table as a broadcast if its rows, or those it was taken ``of``, as counted, stay below the session's threshold, else for a merge."""
    name = "_owner" if "_owner" in df.columns else "_id"
    size = (df if of is None else of).agg(F.sum(F.octet_length(F.col(name).cast("string")) + 96)).first()[0] or 0
    return F.broadcast(df) if size <= broadcast_limit(df.sparkSession) else df.hint("merge")


def quantile_tables(
    df: DataFrame, sets: Sequence[tuple[Sequence[str], Sequence[str]]], qs: dict[str, float], more: Sequence[Sequence[Column]] = (), big: int = BIG, fits: int = FITS
) -> list[DataFrame]:
    """For every (keys, cols) of ``sets`` one row per group: the keys, the aggregates ``more[i]`` and ``{col}|{q}`` per column and quantile.

    Quantiles are linearly interpolated, over the non-null values (null if there are none); null keys are a group; without
    keys there is one row, also for an empty table.
    """
    sets = [(list(keys), list(cols)) for keys, cols in sets]
    cols = list(dict.fromkeys(c for _, cs in sets for c in cs))
    counted = [
        df.select(_owner(df, keys).alias("_owner")).groupBy("_owner").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > big).select(F.lit(i).alias("_set"), "_owner", (F.col("_n") * len(mine)).alias("_values"))
        for i, (keys, mine) in enumerate(sets)
    ]
    heavy = stored(reduce(DataFrame.union, counted).withColumn("_id", F.monotonically_increasing_id()), "big-groups")
    held = {r[0]: r[1] for r in heavy.groupBy("_set").agg(F.sum("_values")).collect()}  # a row per set
    some = set(held) if sum(held.values()) > fits else set()
    picked = _selected(df, [(i, *sets[i]) for i in some], cols, qs, heavy) if some else None
    tables = []
    for i, (keys, mine) in enumerate(sets):
        rows, light = df, F.lit(True)
        if i in some:
            own = heavy.where(F.col("_set") == i).select("_owner", F.lit(True).alias("_big"))
            rows, light = df.withColumn("_owner", _owner(df, keys)).join(_hinted(own), "_owner", "left"), F.col("_big").isNull()
        extra = list(more[i]) if more else []
        small = [F.percentile(F.when(light, F.col(f"`{c}`").cast("double")), F.lit(float(q))).alias(f"{c}|{n}") for c in mine for n, q in qs.items()]
        table = rows.groupBy(*keys).agg(*extra, *small)
        if i in some:
            found = picked.where(F.col("_set") == i).select("_owner", *[F.col(f"`{c}|{n}`").alias(f"_{c}|{n}") for c in mine for n in qs])
            names = [f"{c}|{n}" for c in mine for n in qs]
            table = table.withColumn("_owner", _owner(table, keys)).join(_hinted(found), "_owner", "left")
            table = table.withColumns({n: F.coalesce(F.col(f"`{n}`"), F.col(f"`_{n}`")) for n in names}).drop("_owner", *[f"_{n}" for n in names])
        tables.append(table)
    return tables


def _selected(df: DataFrame, sets: Sequence[tuple[int, list[str], list[str]]], cols: list[str], qs: dict[str, float], heavy: DataFrame) -> DataFrame:
    """(_set, _owner, `{col}|{q}` ...) of the groups in ``heavy``."""
    keys, values = F.array(*[order_key(df, c) for c in cols]), F.array(*[F.col(f"`{c}`").cast("double") for c in cols])
    owners = F.array(*[F.struct(F.lit(i).alias("_set"), _owner(df, by).alias("_owner")) for i, by, _ in sets])
    ids = heavy.select("_set", "_owner", "_id")  # few: a row per group of more than ``big``
    rows = df.select(keys.alias("_keys"), values.alias("_values"), F.inline(owners)).join(_hinted(ids), ["_set", "_owner"])
    wanted = reduce(lambda a, b: a | b, [(F.col("_set") == i) & F.col("_t").isin([cols.index(c) for c in mine]) for i, _, mine in sets])
    rows = rows.select("_set", "_id", F.posexplode(F.arrays_zip("_keys", "_values")).alias("_t", "_kv")).where(wanted)
    rows = rows.select("_id", "_t", F.col("_kv._keys").alias("_key"), F.col("_kv._values").alias("_v")).where("_key is not null")
    owner = ["_id", "_t"]
    # the bits in which a group's keys differ at all, and the prefix they share
    begun = rows.groupBy(*owner).agg(
        F.count(F.lit(1)).alias("_n"), F.bit_or("_key").alias("_or"), F.bit_and("_key").alias("_and"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
    )
    apart = F.col("_or").bitwiseXOR(F.col("_and"))
    top = F.when(apart < 0, 64).when(apart == 0, 0).otherwise(F.least(F.floor(F.log2(apart.cast("double"))).cast("int") + 2, F.lit(64)))
    begun = begun.withColumn("_top", top).withColumn("_prefix", F.expr("CASE WHEN _top = 64 THEN 0L ELSE shiftrightunsigned(_or, _top) END"))
    spots = F.array(*[
        F.struct(F.lit(j).alias("_q"), F.lit(up).alias("_up"), (F.ceil if up else F.floor)(F.lit(float(q)) * (F.col("_n") - 1)).cast("long").alias("_rank"))
        for j, q in enumerate(qs.values()) for up in (0, 1)
    ])
    state = stored(begun.select(*owner, "_n", "_top", "_prefix", "_low", "_high", F.inline(spots)), "ranks")
    done = [state.where(F.col("_low") == F.col("_high"))]
    state = state.where(F.col("_low") != F.col("_high"))
    if not state.isEmpty():
        rows = stored(rows, "big-keys")
    while not state.isEmpty():
        active = state.select(*owner, "_top", "_prefix").distinct().withColumn("_next", F.greatest(F.col("_top") - DIGIT, F.lit(0)))
        inside = F.expr("CASE WHEN _top = 64 THEN 0L ELSE shiftrightunsigned(_key, _top) END") == F.col("_prefix")
        met = rows.join(_hinted(active, state), owner).where(inside).withColumn("_digit", F.expr("shiftrightunsigned(_key, _next)"))
        counts = met.groupBy(*owner, "_prefix", "_next", "_digit").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = Window.partitionBy(*owner, "_prefix").orderBy("_digit").rowsBetween(Window.unboundedPreceding, 0)  # at most 2 ** DIGIT rows
        counts = counts.withColumn("_upto", F.sum("_c").over(upto)).withColumn("_before", F.col("_upto") - F.col("_c"))
        held = state.drop("_low", "_high", "_top").join(counts, [*owner, "_prefix"]).where("_before <= _rank and _rank < _upto")
        state = stored(held.select(
            *owner, "_n", F.col("_next").alias("_top"), F.col("_digit").alias("_prefix"), F.col("_lo").alias("_low"), F.col("_hi").alias("_high"), "_q", "_up",
            (F.col("_rank") - F.col("_before")).alias("_rank"),
        ), "ranks")
        done.append(state.where((F.col("_low") == F.col("_high")) | (F.col("_top") == 0)))
        state = state.where((F.col("_low") != F.col("_high")) & (F.col("_top") > 0))
    found = reduce(DataFrame.unionByName, done)

    def at(t: int, j: int, up: int, value: str) -> Column:
        return F.max(F.when((F.col("_t") == t) & (F.col("_q") == j) & (F.col("_up") == up), F.col(value)))

    def between(t: int, j: int, q: float) -> Column:
        low, high, spot = at(t, j, 0, "_low"), at(t, j, 1, "_low"), F.lit(float(q)) * (at(t, j, 0, "_n") - 1)
        return F.when(low == high, low).when(F.floor(spot) == F.ceil(spot), low).otherwise((F.ceil(spot) - spot) * low + (spot - F.floor(spot)) * high)

    table = found.groupBy("_id").agg(*[between(t, j, q).alias(f"{c}|{n}") for t, c in enumerate(cols) for j, (n, q) in enumerate(qs.items())])
    return table.join(_hinted(ids), "_id").drop("_id")


def quantiles(df: DataFrame, groups: Sequence[str], col: str, qs: dict[str, float], big: int = BIG, fits: int = FITS) -> DataFrame:
    """Exact, linearly interpolated quantiles of one column: one row per group that holds a value."""
    table = quantile_tables(df.where(F.col(col).isNotNull()).select(*groups, col), [(groups, [col])], qs, big=big, fits=fits)[0]
    return table.select(*groups, *[F.col(f"`{col}|{n}`").alias(n) for n in qs])
