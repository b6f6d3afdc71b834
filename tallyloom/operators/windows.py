"""Ordered features per entity (inventory G) and sorting (inventory U).

Series are cut into blocks of positions; each block also receives the few rows before it that its
frames look back to, so a very long series is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.core import from_moments, is_exact, match, square, stat, stored, wide, with_scalars
from tallyloom.ordered import row_index, running
from tallyloom.operators.relate import nearest_join
from tallyloom.spec import in_scope

BLOCK_ROWS = 1 << 16


def _trusted(df: DataFrame, ids: Sequence[str], order: str) -> DataFrame:
    """Add ``_pos``, the order column itself, and raise when a series has a null or a gap: one subquery over (entity: count, ends)."""
    at = F.col(order).cast("bigint")
    spans = df.groupBy(*ids).agg((F.count(F.lit(1)) == F.coalesce(F.max(at) - F.min(at) + 1, F.lit(0))).alias("_ok"))
    checked = with_scalars(df, spans, {"ok": F.bool_and("_ok")}, "_dense")
    said = F.lit(f"the positions in {order!r} have gaps, nulls or repeats; leave dense out")
    sure = F.when(F.coalesce(F.col("_dense.ok"), F.lit(True)), True).otherwise(F.raise_error(said).cast("boolean"))
    return checked.where(sure).drop("_dense").withColumn("_pos", at)


def _blocks(df: DataFrame, ids: Sequence[str], order: Sequence[str], reach: int, dense: bool) -> DataFrame:
    """Add ``_pos``, ``_block`` and ``_home``; rows are copied to the next block when it looks back to them.

    ``dense`` says the single order column is an integer without gaps, so it is the position itself; a gap, a null or a repeat raises.
    A block is at least ``reach`` rows long, so a row is copied at most once.
    """
    size = max(BLOCK_ROWS, reach)
    placed = _trusted(df, ids, order[0]) if dense else row_index(df, ids, order, "_pos")
    first, last = F.floor(F.col("_pos") / size), F.floor((F.col("_pos") + reach) / size)
    return placed.withColumn("_home", first).withColumn("_block", F.explode(F.sequence(first, last)))


def _over(ids: Sequence[str]):
    return Window.partitionBy(*ids, "_block").orderBy("_pos")


def _finish(df: DataFrame, ids: Sequence[str], columns: Sequence[str], new: dict[str, Column]) -> DataFrame:
    """Evaluate the frames on all rows of a block, then keep only the block's own rows."""
    twice = (F.lag("_pos", 1).over(_over(ids)) == F.col("_pos")).alias("_twice")
    out = df.select(*columns, "_home", "_block", twice, *[e.alias(n) for n, e in new.items()])
    return out.where(_own()).drop("_home", "_block", "_twice")


def _own() -> Column:
    """The rows of the block itself, each position once."""
    once = F.when(F.col("_twice"), F.raise_error(F.lit("a position stands twice in a series; leave dense out")).cast("boolean")).otherwise(True)
    return (F.col("_home") == F.col("_block")) & once


def lags(df: DataFrame, ids: Sequence[str], order: Sequence[str], col: str, ks: Sequence[int], dense: bool = False) -> DataFrame:
    """Value ``k`` rows earlier in the entity's series, for each ``k``."""
    cut = _blocks(df, ids, order, max(ks), dense)
    return _finish(cut, ids, df.columns, {f"{col}_lag_{k}": F.lag(col, k).over(_over(ids)) for k in ks})


def rolling(
    df: DataFrame, ids: Sequence[str], order: Sequence[str], col: str, shifts: Sequence[int], windows: Sequence[int],
    aggs: Sequence[str], dense: bool = False,
) -> DataFrame:
    """Statistics (mean, std) of the ``w`` values that end ``shift`` rows earlier; null until ``w`` values are present.

    Integer and decimal columns use differences of exact running sums, so the cost of a row does not
    depend on the window length; means hold for any bigint, and squares that add up to 1e38 or more raise where a std is
    wanted.  Floating columns are summed frame by frame, which loses no digits.
    """
    reach = max(shifts) + max(windows)
    cut = _blocks(df, ids, order, reach, dense)
    frames = [(s, w) for s in shifts for w in windows]
    if not is_exact(df, col):
        new = {}
        for s, w in frames:
            frame = _over(ids).rowsBetween(-(s + w - 1), -s)
            new |= {f"{col}_{a}_{s}_{w}": F.when(stat(df, col, "count", frame) == w, stat(df, col, a, frame)) for a in aggs}
        return _finish(cut, ids, df.columns, new)
    upto = _over(ids).rowsBetween(Window.unboundedPreceding, 0)
    sums = F.struct(
        F.count(col).over(upto).alias("n"), F.coalesce(F.sum(wide(df, col)).over(upto), F.lit(0)).alias("t"),
        (F.coalesce(F.sum(square(df, col)).over(upto), F.lit(0)) if "std" in aggs else F.lit(0)).alias("q"),
    )
    offsets = sorted({k for s, w in frames for k in (s, s + w)})
    twice = {"_twice": F.lag("_pos", 1).over(_over(ids)) == F.col("_pos")}
    placed = cut.withColumn("_sums", sums).withColumns(twice | {f"_at_{k}": F.lag("_sums", k).over(_over(ids)) for k in offsets})

    def between(s: int, w: int, part: str) -> Column:
        return F.col(f"_at_{s}.{part}") - F.coalesce(F.col(f"_at_{s + w}.{part}"), F.lit(0))

    # Staged as columns, so each wide decimal difference is taken once per row.
    moments = {f"_n_{s}_{w}": between(s, w, "n") for s, w in frames}
    moments |= {f"_{m}_{s}_{w}": between(s, w, m).cast("double") for s, w in frames for m in "tq"}
    new = {
        f"{col}_{a}_{s}_{w}": F.when(F.col(f"_n_{s}_{w}") == w, from_moments(a, *(F.col(f"_{m}_{s}_{w}") for m in "ntq")))
        for s, w in frames for a in aggs
    }
    own = placed.where(_own()).select(*df.columns, *[e.alias(k) for k, e in moments.items()])
    return own.select(*df.columns, *[e.alias(k) for k, e in new.items()])


def momentum(df: DataFrame, ids: Sequence[str], order: Sequence[str], col: str, dense: bool = False) -> DataFrame:
    """Value divided by the previous value of the entity."""
    lagged = lags(df, ids, order, col, [1], dense)
    prev = f"{col}_lag_1"
    return lagged.withColumn(
        f"{col}_momentum", F.try_divide(F.col(col).cast("double"), F.col(prev).cast("double"))
    ).drop(prev)


def _ranks(hist: DataFrame, group: Sequence[str], col: str, sample: DataFrame) -> DataFrame:
    """Average rank of each value of a (group, value, ``_c``) histogram, over the largest rank of the group."""
    cum = running(hist, group, [col], {"_hi": ("sum", F.col("_c"))}, sample=sample)
    ranked = cum.withColumn("_rank", F.col("_hi") - F.col("_c") + (F.col("_c") + 1) / F.lit(2.0))
    # the largest value has the largest rank, which needs no running sum
    sizes = hist.groupBy(*group).agg(F.sum("_c").alias("_n"), F.max_by("_c", col).alias("_last"))
    top = sizes.select(*group, (F.col("_n") - F.col("_last") + (F.col("_last") + 1) / F.lit(2.0)).alias("_top"))
    return match(ranked, top, group).withColumn("_p", F.col("_rank") / F.col("_top"))


def ecdf_band(df: DataFrame, group: str, col: str, k: int, scope: str = "all", name: str | None = None, source: DataFrame | None = None) -> DataFrame:
    """Percentile rank of a value among the rows whose integer group is within ``k`` of its own.

    The (group, value) histogram is copied to its neighbours, never the rows, and written, since ranks read it three times.  With train scope a
    test value takes the percentile of the nearest training value in its band.
    """
    name = name or f"{col}_ecdf_{k}"
    hist = in_scope(df, scope, source).where(F.col(col).isNotNull()).groupBy(group, col).agg(F.count(F.lit(1)).alias("_c"))
    spread = hist.withColumn("_own", F.col(group)).withColumn(
        group, F.explode(F.sequence(F.col(group) - k, F.col(group) + k))
    )
    merged = spread.groupBy(group, col).agg(F.sum("_c").alias("_c"), F.max((F.col("_own") == F.col(group)).cast("int")).alias("_mine"))
    ranks = _ranks(stored(merged, "bands"), [group], col, df)
    if scope == "all":
        table = ranks.where("_mine = 1").select(group, col, F.col("_p").alias(name))
        return df.join(table, [group, col], "left")
    table = ranks.select(group, col, F.col("_p").alias(name))
    return nearest_join(df, table, col, name, [group]).drop(f"nearest_{col}")


def ecdf(df: DataFrame, group: str, col: str, scope: str = "all", name: str | None = None) -> DataFrame:
    """Percentile rank of a value within its group."""
    return ecdf_band(df, group, col, 0, scope, name or f"{col}_ecdf")


def row_id(df: DataFrame, keys: Sequence[str], name: str = "row_id") -> DataFrame:
    """Stable 1-based row number over the whole table, by key."""
    return row_index(df, [], keys, name)


def gini_sum(df: DataFrame, y: str, pred: str, key: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Lorenz-curve area of ``y`` along falling predictions (ties by key), one row, or one per ``by``.

    Each label adds itself to every later cumulative sum, so the sum of cumulative sums is the sum of
    ``y * (n - position + 1)`` and only positions are needed.
    """
    slim = df.select(*by, F.col(y).alias("_y"), (-F.col(pred)).alias("_neg"), *key)
    placed = row_index(slim, by, ["_neg", *key], "_pos")
    sums = placed.groupBy(*by).agg(
        F.sum(wide(placed, "_y")).alias("t"), F.sum(wide(placed, "_y") * wide(placed, "_pos")).alias("tp"), F.count(F.lit(1)).alias("n")
    )
    n, t = F.col("n").cast("double"), F.col("t").cast("double")
    area = (n + 1) * t - F.col("tp").cast("double")
    return sums.select(*by, (F.try_divide(F.try_divide(area, t) - (n + 1) / 2, n)).alias("gini"))


def rank_insert(board: DataFrame, scores: DataFrame, keys: Sequence[str], col: str, score: str, direction: str) -> DataFrame:
    """Rank of new scores in a board: 1 + entries that are strictly better, and rank / entries.

    Board and scores are counted in one running scan per board key; the board is never sorted whole.
    """
    sign = -1 if direction == "maximize" else 1
    points = (
        board.select(*keys, (F.col(col) * sign).alias("_x"), F.lit(1).alias("_b"))
        .unionByName(scores.select(*keys, (F.col(score) * sign).alias("_x"), F.lit(0).alias("_b")))
        .groupBy(*keys, "_x")
        .agg(F.sum("_b").cast("bigint").alias("_b"))
    )
    cum = running(points, keys, ["_x"], {"_upto": ("sum", F.col("_b"))})
    sizes = board.withColumn("_all", F.lit(0)).groupBy(*keys, "_all").agg(F.count(F.lit(1)).alias("board_size"))
    better = cum.select(*keys, "_x", (F.col("_upto") - F.col("_b") + 1).alias("rank"))
    placed = match(scores.withColumn("_x", F.col(score) * sign), better, [*keys, "_x"]).withColumn("_all", F.lit(0))
    return (
        match(placed, sizes, [*keys, "_all"])
        .withColumn("percentile", F.try_divide(F.col("rank").cast("double"), F.col("board_size")))
        .drop("_x", "_all")
    )


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, salts: int = 32) -> DataFrame:
    """The first ``k`` rows per group, in two steps.

    Each group is first cut to ``k`` rows within ``salts`` hash slices, so the last step sees at most
    ``k * salts`` rows of a group.
    """
    slice_ = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
    first = Window.partitionBy(*group, "_slice").orderBy(*order)
    last = Window.partitionBy(*group).orderBy(*order)
    cut = df.withColumn("_slice", slice_).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k)
    return cut.drop("_slice").withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= k).withColumnRenamed("_r", "rank")


def sort_multi(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Global sort (range shuffle)."""
    return df.orderBy(*order)


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Top-n report; each task keeps n rows."""
    return df.orderBy(*order).limit(n)


def arg_best(df: DataFrame, by: Sequence[str], what: str, score: str, direction: str) -> DataFrame:
    """The ``what`` with the best score per key; ties go to the smallest ``what``."""
    value = F.col(score) if direction == "minimize" else -F.col(score)
    return df.groupBy(*by).agg(F.min_by(what, F.struct(value, F.col(what))).alias(what), F.min_by(score, F.struct(value, F.col(what))).alias(score))


