"""Shared building blocks: order-free statistics, joins of statistics, bounded domains, fold hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE = (Window.unboundedPreceding, Window.unboundedFollowing)


# --- statistics -----------------------------------------------------------------------------


def is_exact(df: DataFrame, col: str) -> bool:
    """True for integer and decimal columns, whose sums do not depend on the order of addition."""
    return isinstance(df.schema[col].dataType, (T.IntegralType, T.DecimalType))


def stat(df: DataFrame, col: str, fn: str, over: WindowSpec | None = None) -> Column:
    """Aggregate expression ``fn`` of ``col``, as an aggregate or over a window.

    On integer and decimal columns mean and std come from exact sums, so the result does not change
    with partitioning, retries or merge order.  On floating columns the built-ins are used.
    """

    def on(c: Column) -> Column:
        return c if over is None else c.over(over)

    c = F.col(col)
    if fn == "count":
        return on(F.count(c))
    if fn == "size":
        return on(F.count(F.lit(1)))
    if fn in ("sum", "min", "max"):
        return on(getattr(F, fn)(c))
    if not is_exact(df, col):
        built_in = {"mean": F.avg, "std": F.stddev_samp, "std_pop": F.stddev_pop}
        return on(built_in[fn](c))
    exact = from_moments(fn, on(F.count(c)), on(F.sum(wide(df, col))), on(F.try_sum(square(df, col))))
    if fn == "mean":
        return exact
    # sums of squares from 1e38 on do not fit the widest decimal; the built-in takes over there, in double precision
    return F.coalesce(exact, on({"std": F.stddev_samp, "std_pop": F.stddev_pop}[fn](c)))


def square(df: DataFrame, col: str) -> Column:
    """The square of an integer or decimal column; that of any bigint fits."""
    return wide(df, col) * wide(df, col)


def wide(df: DataFrame, col: str) -> Column:
    """An integer column as a decimal whose sums and products pass the bigint range; other columns as they are."""
    c = F.col(col)
    return c.cast("decimal(19,0)") if isinstance(df.schema[col].dataType, T.IntegralType) else c


def from_moments(fn: str, n: Column, total: Column, squares: Column) -> Column:
    """Mean, sample std or population std from exact count, sum and sum of squares."""
    total = total.cast("double")
    if fn == "mean":
        return F.try_divide(total, n)
    spread = F.when(squares.isNotNull(), F.greatest(squares.cast("double") - F.try_divide(total * total, n), F.lit(0.0)))
    if fn == "std":
        return F.when(n > 1, F.sqrt(F.try_divide(spread, n - 1)))
    if fn == "std_pop":
        return F.when(n > 0, F.sqrt(F.try_divide(spread, n)))
    raise ValueError(f"unknown statistic {fn!r}")


def with_scalars(df: DataFrame, source: DataFrame, exprs: dict[str, Column], name: str = "_s") -> DataFrame:
    """Add one struct column holding global aggregates of ``source``.

    The aggregates are a scalar subquery (one row by construction), so no join is planned.
    """
    packed = F.struct(*[e.alias(k) for k, e in exprs.items()]).alias(name)
    return df.withColumn(name, source.agg(packed).scalar())


# --- joins ----------------------------------------------------------------------------------


def small_keys(df: DataFrame, key_sets: Sequence[Sequence[str]], n_values: int = 4) -> dict[tuple[str, ...], bool]:
    """Measure, in one pass, which key sets give statistics small enough to broadcast.

    The estimated byte size (distinct keys, with a margin for the sketch's error, times the row width)
    is compared with the session's own broadcast threshold.
    """
    sets = list(dict.fromkeys(tuple(ks) for ks in key_sets))
    limit = broadcast_limit(df.sparkSession)
    if limit <= 0:
        return dict.fromkeys(sets, False)
    row = df.agg(
        *[F.approx_count_distinct(F.struct(*ks)).alias(f"k{i}") for i, ks in enumerate(sets)],
        *[F.max(F.octet_length(F.concat_ws("", *[F.col(c).cast("string") for c in ks]))).alias(f"w{i}") for i, ks in enumerate(sets)],
    ).first()
    return {
        ks: 1.25 * row[f"k{i}"] * (16 * (len(ks) + n_values + 1) + (row[f"w{i}"] or 0)) <= limit
        for i, ks in enumerate(sets)
    }


def small_rows(table: DataFrame, kind: str, sets: Sequence[tuple[str, ...]], n_values: int = 1) -> dict[tuple[str, ...], bool]:
    """For a stored table whose column ``kind`` numbers key sets: whether each set's rows, as counted, may be broadcast."""
    limit = broadcast_limit(table.sparkSession)
    keys = [c for c in table.columns if c != kind]
    width = F.max(F.octet_length(F.concat_ws("", *[F.col(c).cast("string") for c in keys])))
    found = {r[kind]: (r["n"], r["w"] or 0) for r in table.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), width.alias("w")).collect()}
    return {s: found.get(i, (0, 0))[0] * (16 * (len(s) + n_values + 1) + found.get(i, (0, 0))[1]) <= limit for i, s in enumerate(sets)}


def broadcast_limit(spark: SparkSession) -> int:
    """Bytes of ``spark.sql.autoBroadcastJoinThreshold``."""
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold").strip().lower().removesuffix("b")
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    return int(text[:-1]) * units[text[-1]] if text[-1] in units else int(text)


ROW_BYTES = 64  # of a row with a key and a few numbers, in a hash table


def few_rows(table: DataFrame) -> bool:
    """Whether a stored table of keys and numbers, as counted, may be broadcast."""
    return table.count() * ROW_BYTES <= broadcast_limit(table.sparkSession)


def by_size(table: DataFrame) -> DataFrame:
    """A stored table of keys and numbers as the right side of a join: sent to every task only if it is small as counted.

    The size of a compressed file says little about the rows in it, and what is broadcast passes the driver.
    """
    return F.broadcast(table) if few_rows(table) else table.hint("merge")


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "left", small: bool | None = None) -> DataFrame:
    """Join a table with one row per key to every fact row.

    ``small`` is a verdict of :func:`small_keys`: then the facts are not shuffled at all.  If it came out false, it
    is a sort-merge join whose oversized partitions (hot or null keys on the fact side) the adaptive
    planner splits; one row per key keeps each split cheap.  The verdict is passed on as a hint, since the size of a
    compressed file says little about the rows in it.  Without a verdict Spark chooses.
    """
    if small is not None:
        stats = F.broadcast(stats) if small else stats.hint("merge")
    return df.join(stats, list(keys), how)


def match(df: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Like :func:`attach`, but null keys match null keys."""
    taken = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    on = None
    for k in keys:
        test = df[k].eqNullSafe(taken[f"_r_{k}"])
        on = test if on is None else on & test
    return df.join(taken, on, how).drop(*[f"_r_{k}" for k in keys])


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """Raise when a key repeats; at most one offending row reaches the driver."""
    bad = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if bad:
        raise ValueError(f"key {list(keys)} is not unique, e.g. {bad[0].asDict()}")


# --- bounded domains ------------------------------------------------------------------------


def levels(df: DataFrame, col: str, max_levels: int = 1000) -> list:
    """Sorted non-null levels of a column; refuses domains larger than ``max_levels``."""
    rows = df.select(col).where(F.col(col).isNotNull()).distinct().limit(max_levels + 1).collect()
    if len(rows) > max_levels:
        raise ValueError(f"column {col!r} has more than {max_levels} levels")
    return sorted(r[0] for r in rows)


# --- hashing --------------------------------------------------------------------------------

HASH_SPAN = 1 << 32


def key_hash(cols: Sequence[str], seed: int) -> Column:
    """32-bit number in a long, from md5 of the key parts and the seed."""
    text = F.concat(*[part for c in cols for part in (F.col(c).cast("string"), F.lit(":"))], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


# --- shared storage -------------------------------------------------------------------------


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder named in ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = tempfile.mkdtemp(prefix="tallyloom-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in reliable shared storage."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(work_dir(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that its readers do not compute it again."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
