"""Ordered computations that never put a whole group, or the whole table, into one task.

A group may hold a large share of all rows, so ``Window.partitionBy(group)`` is not used on facts.
Rows are cut along the order key into chunks of about equal size; each (group, chunk) is scanned on
its own, chunk totals (one row per group and chunk) are accumulated, and the two are added up.  Cut
points only balance the work: any choice of them gives the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.core import match

SAMPLES_PER_CHUNK = 16
MAX_CHUNKS = 4096


def _sortable(df: DataFrame, col: str) -> Column:
    """Dates and timestamps as ISO text, which sorts the same way; other types as they are."""
    if isinstance(df.schema[col].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.col(col).cast("string")
    return F.col(col)


def chunk_of(df: DataFrame, order: Sequence[str], chunks: int | None = None, sample: DataFrame | None = None) -> Column:
    """Non-decreasing chunk number along ``order``.

    Cut points come from about ``SAMPLES_PER_CHUNK * chunks`` keys picked at random, the way a range
    shuffle finds its bounds; ``sample`` may name a cheaper table with the same keys.
    """
    n = chunks or min(MAX_CHUNKS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = F.struct(*[_sortable(df, c).alias(f"k{i}") for i, c in enumerate(order)])
    source = (df if sample is None else sample).select(key.alias("k"))
    size, wanted = source.count(), SAMPLES_PER_CHUNK * n
    if size > 2 * wanted:
        source = source.sample(wanted / size, seed=17)
    picked = source.limit(4 * wanted).collect()
    ranked = sorted((tuple((v is not None, v) if v is not None else (False, 0) for v in r["k"]), tuple(r["k"])) for r in picked)
    keys = [k for _, k in ranked]
    cuts = list(dict.fromkeys(keys[i * len(keys) // n] for i in range(1, n))) if keys else []
    if not cuts:
        return F.lit(0)
    types = [f.dataType for f in source.schema["k"].dataType]

    def point(row) -> Column:
        parts = [F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(row, types))]
        return parts[0] if len(parts) == 1 else F.struct(*parts)

    if len(order) > 1:
        return search(key, [point(c) for c in cuts])
    alone = _sortable(df, order[0])
    return F.when(alone.isNull(), 0).otherwise(search(alone, [point(c) for c in cuts]))  # nulls sort first


TREE_POINTS = 64


def search(key: Column, points: Sequence[Column], strict: bool = False) -> Column:
    """How many of the sorted ``points`` are <= ``key`` (or < ``key``); ``key`` must not be null.

    A comparison tree for short lists.  Long lists are cut into blocks: the tree finds the block, and
    only that block's points are compared.
    """

    def passed(p: Column) -> Column:
        return p < key if strict else p <= key

    def tree(some: Sequence[Column], base: int) -> Column:
        if not some:
            return F.lit(base)
        mid = len(some) // 2
        return F.when(passed(some[mid]), tree(some[mid + 1 :], base + mid + 1)).otherwise(tree(some[:mid], base))

    if len(points) <= TREE_POINTS:
        return tree(points, 0)
    width = -(-len(points) // TREE_POINTS)
    blocks = [points[i : i + width] for i in range(0, len(points), width)]
    block = tree([b[0] for b in blocks[1:]], 0)
    inner = F.array(*[F.array(*b) for b in blocks])
    return block * width + F.size(F.filter(F.element_at(inner, block + 1), passed))


def running(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    exprs: dict[str, tuple[str, Column]],
    reverse: bool = False,
    chunks: int | None = None,
    sample: DataFrame | None = None,
) -> DataFrame:
    """Inclusive running ``sum`` / ``max`` / ``min`` per group along ``order``.

    ``exprs`` maps an output name to (function, column).  ``order`` should identify a row within its
    group.  With ``reverse`` the scan runs from the largest key down.
    """
    combine = {
        "sum": lambda a, b: a + F.coalesce(b, F.lit(0)),
        "max": lambda a, b: F.greatest(a, b),
        "min": lambda a, b: F.least(a, b),
    }
    cut = df.withColumn("_chunk", chunk_of(df, order, chunks, sample)).withColumn("_all", F.lit(0))
    owner = [*groups, "_all"]
    for name, (_, column) in exprs.items():
        cut = cut.withColumn(f"_in_{name}", column)

    def along(cols: Sequence[str]) -> list[Column]:
        return [F.col(c).desc_nulls_last() if reverse else F.col(c).asc_nulls_first() for c in cols]

    inside = Window.partitionBy(*owner, "_chunk").orderBy(*along(order)).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select(
        *df.columns, "_all", "_chunk",
        *[getattr(F, fn)(f"_in_{name}").over(inside).alias(f"_w_{name}") for name, (fn, _) in exprs.items()],
    )
    totals = cut.groupBy(*owner, "_chunk").agg(
        *[getattr(F, fn)(f"_in_{name}").alias(f"_t_{name}") for name, (fn, _) in exprs.items()]
    )
    # One row per (group, chunk): at most ``chunks`` rows per group.
    before = Window.partitionBy(*owner).orderBy(*along(["_chunk"])).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *owner, "_chunk",
        *[getattr(F, fn)(f"_t_{name}").over(before).alias(f"_o_{name}") for name, (fn, _) in exprs.items()],
    )
    joined = match(local, offsets, [*owner, "_chunk"])
    return joined.select(
        *df.columns,
        *[combine[fn](F.col(f"_w_{name}"), F.col(f"_o_{name}")).alias(name) for name, (fn, _) in exprs.items()],
    )


def row_index(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str = "rn", chunks: int | None = None,
    sample: DataFrame | None = None,
) -> DataFrame:
    """1-based position of each row in its group along ``order`` (which must be a total order)."""
    return running(df, groups, order, {name: ("sum", F.lit(1).cast("bigint"))}, chunks=chunks, sample=sample)
