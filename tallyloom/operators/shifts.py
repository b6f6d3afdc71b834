"""Rows, or columns, that are shifted copies of one another (inventory R).

A cell becomes a number and a run of cells the sum of its numbers, each times the power of a base that belongs to its
position, modulo a prime.  Sums up to every position give the hash of any run by one subtraction, and a run that stands some
steps further on has the same hash times a fixed power, so runs at all offsets meet in one shuffle and no column is turned
into a row.  Four such sums make a key of 124 bits; whatever matches is compared cell by cell afterwards.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.core import by_size, cut_lineage, few_rows, stored, with_scalars
from tallyloom.operators.chains import chain_paths
from tallyloom.operators.rowwise import cell_columns
from tallyloom.ordered import row_index

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 48_271_013, 1_597_334_677, 741_103_597)
LANES = range(len(BASES))
POSITION_BITS = 40
FEW = 16  # cells of a row up to which every run is hashed on its own


def _cells(cols: Sequence[str]) -> Column:
    """The cells of a row as texts, never null; a null is told apart from every value."""
    texts = F.expr("array(" + ", ".join("cast(`" + c.replace("`", "``") + "` as string)" for c in cols) + ")")
    return F.transform(texts, lambda x: F.coalesce(F.concat(F.lit("v"), x), F.lit("n")))


def _longs(values: Iterable[int]) -> Column:
    """A constant array of bigints, as one expression."""
    return F.expr("array(" + ", ".join(f"{v}L" for v in values) + ")")


def _codes(text: Column) -> list[Column]:
    """One number below the prime per lane: the halves of two 64-bit hashes."""
    halves = []
    for seed in (1, 2):
        h = F.xxhash64(text, F.lit(seed))
        halves += [F.shiftrightunsigned(h, 32), h.bitwiseAND((1 << 32) - 1)]
    return [h % PRIME for h in halves]


def _key(lanes: Sequence[Column]) -> list[Column]:
    """Four numbers below the prime as the two longs of a key."""
    return [F.shiftleft(lanes[i], 31).bitwiseOR(lanes[i + 1]) for i in (0, 2)]


def _counted(sides: DataFrame, keys: Sequence[str], head: str, donor: str, *more: str) -> DataFrame:
    """Per key how many heads and donors have it (``_heads``, ``_donors``), one of each and ``more`` of the donor.

    One shuffle; a key of a third of all rows is combined before it.  Plain numbers are combined in a hash table; structs
    would be sorted, with all rows of a task in memory.
    """
    return sides.groupBy(*keys).agg(
        F.count(head).alias("_heads"), F.count(donor).alias("_donors"), *[F.min(c).alias(c) for c in (head, donor, *more)]
    )


def _met(sides: DataFrame, keys: Sequence[str], head: str, donor: str, *more: str) -> DataFrame:
    """The columns of ``head`` and ``donor`` (one of them null) and ``more`` of the donor for every key that one head and one donor have."""
    return _counted(sides, keys, head, donor, *more).where("_heads = 1 and _donors = 1").drop("_heads", "_donors")


def _packer(part: int):
    """A cell's number of two lanes."""
    return lambda text: _key(_codes(text))[part]


def _few_sides(df: DataFrame, groups: Sequence[Sequence[str]], key: str, offsets: Sequence[int], reach: int) -> DataFrame:
    """:func:`_sides` for few cells and offsets: each run is hashed on its own, without Python."""
    own, none = F.col("_key"), F.lit(None).cast(df.schema[key].dataType)
    first = [F.col(c) for c in groups[0]]
    parts = [F.array(*[_packer(part)(c) for c in cells]).alias(f"_c{i}_{part}") for i, cells in enumerate(cell_columns(df, groups)) for part in (0, 1)]
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.array(*first).alias("_series"), *parts)

    def run_key(seed: int, low: int, lengths: Sequence[int]) -> Column:
        runs = [F.slice(f"_c{i}_{part}", low + 1, n) for i, n in enumerate(lengths) if n > 0 for part in (0, 1)]
        return F.xxhash64(F.lit(seed), *runs)

    sides = []
    for o in offsets:
        left = [len(g) - o for g in groups]
        kept, v = [len(g) - reach for g in groups], F.element_at("_series", o - 1)
        head = [F.lit(o), run_key(0, 0, kept), run_key(1, 0, left), run_key(2, 0, left), own, none, F.nullif(v, v)]
        tail = [F.lit(o), run_key(0, o, kept), run_key(1, o, left), run_key(2, o, left), none, own, v]
        named = [F.struct(*[c.alias(n) for c, n in zip(side, ("_o", "_pre", "_a", "_b", "_src", "_dst", "_v"))]) for side in (head, tail)]
        sides += [named[0], F.when(v != 0, named[1])]
    return rows.select(F.inline(F.array(*sides))).where("_o is not null")


def _sides(df: DataFrame, groups: Sequence[Sequence[str]], key: str, offsets: Sequence[int], reach: int) -> DataFrame:
    """Both sides of every row at every offset: ``_o``, ``_pre``, ``_a``, ``_b``, ``_src`` or ``_dst``, and the donor's ``_v``.

    ``_a`` and ``_b`` are the key of a run, ``_pre`` that of its first cells, as many as are left at the offset ``reach``; it does
    not depend on the offset, so runs that are alike have it in common.  Sums and keys are taken for whole batches at a time.
    """
    sizes = [len(g) for g in groups]
    if sum(sizes) <= FEW and len(offsets) <= FEW // 2:
        return _few_sides(df, groups, key, offsets, reach)
    series = F.array(*groups[0])
    gives = F.array(*[F.coalesce(F.element_at("_series", o - 1) != 0, F.lit(False)) for o in offsets])
    # measured faster than one generated expression per cell (78 and 123 s of task time on the same table of 40 columns)
    packed = [F.transform(f"_g{i}", _packer(part)).alias(f"_c{i}_{part}") for i in range(len(groups)) for part in (0, 1)]
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), series.alias("_series"), *[F.array(*cells).alias(f"_g{i}") for i, cells in enumerate(cell_columns(df, groups))])
    rows = rows.select("_key", "_series", gives.alias("_gives"), *packed)
    weights = [[np.array([pow(BASES[(lane + 1) % 4], i + 1, PRIME) * pow(BASES[lane], at, PRIME) % PRIME for at in range(n)]) for lane in LANES] for i, n in enumerate(sizes)]

    def lanes(packed: pa.Array, n: int) -> list[np.ndarray]:
        """The two numbers of every packed cell, one row of ``n`` cells each."""
        flat = packed.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
        return [flat >> 31, flat & ((1 << 31) - 1)]

    # refers to nothing of this module but numbers, so that tasks need not import it
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, values = batch.column("_key"), batch.column("_series").flatten()
            gives = batch.column("_gives").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(offsets))
            sums = []
            for i, n in enumerate(sizes):
                codes = lanes(batch.column(f"_c{i}_0"), n) + lanes(batch.column(f"_c{i}_1"), n)
                sums.append([np.pad(np.cumsum(codes[lane] * weights[i][lane] % PRIME, axis=1), ((0, 0), (1, 0))) for lane in LANES])

            def run_key(lane: int, low: int, high: Sequence[int], power: int) -> np.ndarray:
                total = sum(s[lane][:, max(h, 0)] - s[lane][:, max(min(low, h), 0)] for s, h in zip(sums, high))
                return total % PRIME * pow(BASES[lane], power, PRIME) % PRIME

            def side(o: int, at: np.ndarray, four: list, first: list, head: bool) -> pa.RecordBatch:
                own, none = keys.take(pa.array(at)), pa.nulls(len(at), keys.type)
                v = pa.nulls(len(at), values.type) if head else values.take(pa.array(at * sizes[0] + o - 2))
                packs = [pa.array(x[at] << 31 | y[at]) for x, y in (first, four[:2], four[2:])]
                return pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), o, np.int32)), *packs, own if head else none, none if head else own, v], names=["_o", "_pre", "_a", "_b", "_src", "_dst", "_v"]
                )

            kept = [n - reach for n in sizes]
            first = [run_key(lane, 0, kept, 0) for lane in (0, 1)]
            for j, o in enumerate(offsets):
                heads = [run_key(lane, 0, [n - o for n in sizes], o) for lane in LANES]
                yield side(o, np.arange(len(keys)), heads, first, True)
                tails = [run_key(lane, o, sizes, 0) for lane in LANES]
                begun = [run_key(lane, o, [o + k if k > 0 else 0 for k in kept], -o) for lane in (0, 1)]
                yield side(o, np.flatnonzero(gives[:, j]), tails, begun, False)

    own = rows.schema["_key"].dataType
    schema = T.StructType().add("_o", "integer").add("_pre", "long").add("_a", "long").add("_b", "long").add("_src", own).add("_dst", own).add("_v", rows.schema["_series"].dataType.elementType)
    return rows.mapInArrow(run, schema)


def shifted_rows(df: DataFrame, groups: Sequence[Sequence[str]], key: str, offsets: Sequence[int]) -> DataFrame:
    """Pairs (``_o``, ``_src``, ``_dst``, ``_v``): row src without its last o columns has the key of row dst without its first o.

    Of each offset only keys count that one src and one dst (among those with a value to read) have.  The value is the column
    of dst's first group just before the shift.  Pairs meet by hash; :func:`offset_lookup` compares their cells.
    """
    sides = _sides(df, groups, key, offsets, max(offsets))
    return _met(sides, ["_o", "_a", "_b"], "_src", "_dst", "_v").select("_o", "_src", "_dst", "_v")


def _batches(offsets: Sequence[int], longest: int) -> list[list[int]]:
    """The first offset alone, then runs of offsets whose shortest remainder is at least half of their longest."""
    out = [[offsets[0]]]
    for i, o in enumerate(offsets[1:]):
        left = [longest - x for x in (*out[-1], o)]
        if i == 0 or 2 * min(left) < max(left):
            out.append([o])
        else:
            out[-1].append(o)
    return out


def offset_lookup(df: DataFrame, groups: Sequence[Sequence[str]], key: str, offsets: Sequence[int], name: str = "looked_up") -> DataFrame:
    """Value found some steps ahead of a row: the first offset with a hit wins, 0 when there is none.

    At offset o (2 or more) a row's groups of columns, each without its last o, are matched to those of another row without
    their first o; both must be the only ones of their kind, the second among rows whose value is neither null nor 0.  The value
    read is that row's column of the first group just before the shift.  ``key`` is unique; a row without a key gets 0.
    Nulls equal nulls.  A group of no more than o columns says nothing at o.

    Offsets are taken in batches, for the rows still without a hit.  A row whose head is not the only one of its kind stays so at
    larger offsets, where heads are shorter, and drops out.  Once the open rows are few as counted, only those runs go on to a
    later batch that begin like one of them, so every run that could meet or repeat one of these is still counted.  Nothing that
    grows with the rows is broadcast, however small its files are.
    """
    offsets = list(dict.fromkeys(offsets))
    if not offsets or min(offsets) < 2 or max(offsets) > len(groups[0]):
        raise ValueError(f"offsets must lie between 2 and the {len(groups[0])} columns of the first group")
    if max(offsets) >= max(len(g) for g in groups):
        raise ValueError("an offset leaves no column to compare")
    rows = stored(df.withColumn("_id", F.monotonically_increasing_id()), "series")
    known = rows.where(F.col(key).isNotNull())
    cells = known.select("_id", F.array(*[F.array(*cells) for cells in cell_columns(rows, groups)]).alias("_cells"))
    order = F.array_position(F.array(*[F.lit(o) for o in offsets]), F.col("_o"))
    rising = offsets == sorted(offsets)

    def same(own: Column, theirs: Column) -> Column:
        return reduce(lambda a, b: a & b, [
            F.when(F.col("_o") < len(g), F.slice(F.element_at(own, i + 1), 1, F.greatest(F.lit(len(g)) - F.col("_o"), F.lit(0)))
                   == F.slice(F.element_at(theirs, i + 1), F.col("_o") + 1, len(g))).otherwise(True)
            for i, g in enumerate(groups)
        ])

    hits, awaited, few = [], None, False
    for batch in _batches(offsets, max(len(g) for g in groups)):
        sides = _sides(known, groups, "_id", batch, max(batch))
        if few:
            begun = _sides(known.join(F.broadcast(awaited), "_id", "left_semi"), groups, "_id", batch[:1], max(batch)).where("_src is not null")
            sides = sides.join(F.broadcast(stored(begun.select("_pre").distinct(), "begun")), "_pre", "left_semi")
        found = stored(_counted(sides, ["_o", "_a", "_b"], "_src", "_dst", "_v").where("_heads = 1").select("_o", "_src", "_dst", "_v", "_donors"), "met")
        pairs = found.where("_donors = 1").drop("_donors")
        if awaited is not None:
            pairs = pairs.join(by_size(awaited).withColumnRenamed("_id", "_src"), "_src", "left_semi")
        pairs, own, theirs = stored(pairs, "pairs"), cells.toDF("_src", "_own"), cells.toDF("_dst", "_theirs")
        if few_rows(pairs):  # else the cells of all rows are sorted
            own, theirs = own.join(F.broadcast(pairs), "_src"), theirs.join(F.broadcast(pairs.select("_dst").distinct()), "_dst", "left_semi")
        else:
            own = own.hint("merge").join(pairs, "_src")
        both = own.join(theirs.hint("merge"), "_dst")
        hit = both.where(same(F.col("_own"), F.col("_theirs"))).groupBy(F.col("_src").alias("_id")).agg(F.min_by("_v", order).alias("_hit"))
        hits.append(stored(hit, "hits"))
        if batch[-1] == offsets[-1]:
            break
        if rising:
            alone = found.where(F.col("_o") == max(batch)).select(F.col("_src").alias("_id"))
            awaited = alone if awaited is None else alone.join(by_size(awaited), "_id", "left_semi")
        elif awaited is None:
            awaited = known.select("_id")
        awaited = stored(awaited.join(by_size(hits[-1]), "_id", "left_anti"), "awaited")
        if awaited.isEmpty():
            break
        few = few_rows(awaited)
    joined = rows.join(by_size(reduce(DataFrame.unionByName, hits)), "_id", "left")
    return joined.select(*df.columns, F.coalesce("_hit", F.lit(0)).alias(name))


def _power(base: int, position: Column) -> Column:
    """``base`` to the power of a column below 2^40, modulo the prime: one table per byte of the exponent."""
    out = F.lit(1).cast("bigint")
    for shift in range(0, POSITION_BITS, 8):
        table = _longs(pow(base, at << shift, PRIME) for at in range(256))
        out = out * F.element_at(table, F.shiftright(position, shift).bitwiseAND(255).cast("int") + 1) % PRIME
    return out


def column_edges(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Edges src -> dst between columns: src without its last row equals dst without its first, both the only ones of their kind.

    Rows stand in the order of ``key``, which is unique; rows without a key are left out; nulls equal nulls.  Each column is
    hashed where it stands, in one aggregation over (column, cell); only the cells of matching columns are compared.
    """
    names = F.array(*[F.lit(c) for c in cols])
    placed = row_index(df.where(F.col(key).isNotNull()).select(key, _cells(cols).alias("_cells")), [], [key], "_pos")
    placed = cut_lineage(placed)
    counted = with_scalars(placed, placed, {"n": F.count(F.lit(1))})
    weighted = counted.select("_pos", F.col("_s.n").alias("_n"), "_cells", *[_power(BASES[i], F.col("_pos")).alias(f"_w{i}") for i in LANES])
    cells = weighted.select("_pos", "_n", *[f"_w{i}" for i in LANES], F.posexplode("_cells").alias("_c", "_x"))
    codes = _codes(F.col("_x"))
    terms = cells.select("_c", "_pos", "_n", *[(codes[i] * F.col(f"_w{i}") % PRIME).alias(f"_t{i}") for i in LANES])
    hashed = terms.groupBy("_c").agg(
        *[F.sum(F.when(F.col("_pos") < F.col("_n"), F.col(f"_t{i}")).otherwise(0)).alias(f"_h{i}") for i in LANES],
        *[F.sum(F.when(F.col("_pos") > 1, F.col(f"_t{i}")).otherwise(0)).alias(f"_r{i}") for i in LANES],
    )
    heads = _key([F.col(f"_h{i}") % PRIME * BASES[i] % PRIME for i in LANES])
    tails = _key([F.col(f"_r{i}") % PRIME for i in LANES])
    sides = hashed.select(F.inline(F.array(*[
        F.struct(*[c.alias(n) for n, c in zip(("_a", "_b"), lanes)], *[F.when(F.lit(on), F.col("_c")).alias(n) for n, on in (("_src", head), ("_dst", not head))])
        for lanes, head in ((heads, True), (tails, False))
    ])))
    pairs = _met(sides, ["_a", "_b"], "_src", "_dst").select("_src", "_dst").where("_src <> _dst")
    pairs = cut_lineage(pairs)
    plain = counted.select("_pos", F.col("_s.n").alias("_n"), F.posexplode("_cells").alias("_c", "_x"))
    moved = plain.where("_pos < _n").withColumnRenamed("_c", "_src").join(pairs, "_src").select("_src", "_dst", (F.col("_pos") + 1).alias("_pos"), "_x")
    kept = plain.where("_pos > 1").withColumnRenamed("_c", "_dst").join(pairs, "_dst").select("_src", "_dst", "_pos", "_x")
    unlike = moved.union(kept).groupBy("_src", "_dst", "_pos").agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi")).where("_lo <> _hi")
    sure = pairs.join(unlike, ["_src", "_dst"], "left_anti")
    return sure.select(F.element_at(names, F.col("_src") + 1).alias("src"), F.element_at(names, F.col("_dst") + 1).alias("dst"))


def column_chains(df: DataFrame, key: str, cols: Sequence[str], min_len: int = 40) -> DataFrame:
    """Chains among columns (chain, node, position), at least ``min_len`` nodes long and not overlapped; any number of rows."""
    found = chain_paths(cut_lineage(column_edges(df, key, cols))).where("not overlapped").select("chain", "node", "position")
    long = found.groupBy("chain").count().where(F.col("count") >= min_len).select("chain")
    return found.join(long, "chain", "left_semi")
