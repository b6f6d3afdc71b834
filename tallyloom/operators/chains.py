"""Linking rows into chains (inventory R)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.core import stored
from tallyloom.operators.reshape import only_unique
from tallyloom.operators.rowwise import cell_columns, tuple_longs


def link_edges(df: DataFrame, groups: Sequence[Sequence[str]], key: str) -> DataFrame:
    """Edges src -> dst where src's columns 1..n-1 equal dst's columns 2..n and both keys are unique.

    Keys that repeat are dropped before the join, so a common pattern (all zeros) cannot fan out.
    """
    cells = cell_columns(df, groups)
    heads, tails = ([c for g in cells for c in (g[:-1] if head else g[1:])] for head in (True, False))
    sides = [df.select(*[c.alias(n) for c, n in zip(tuple_longs(some), ("_a", "_b"))], F.col(key).alias(end)) for some, end in ((heads, "src"), (tails, "dst"))]
    return only_unique(sides[0], ["_a", "_b"]).join(only_unique(sides[1], ["_a", "_b"]), ["_a", "_b"]).where("src <> dst").select("src", "dst")


def _ends(edges: DataFrame) -> DataFrame:
    """How many edges reach (``_in``) and leave (``_out``) every node."""
    sides = edges.select(F.col("src").alias("node"), F.lit(0).alias("_to"), F.lit(1).alias("_from")).union(edges.select("dst", F.lit(1), F.lit(0)))
    return stored(sides.groupBy("node").agg(F.sum("_to").alias("_in"), F.sum("_from").alias("_out")), "nodes")


def _rings(edges: DataFrame, rounds: int) -> DataFrame | None:
    """The nodes on cycles, each with the smallest of its cycle (``node``, ``low``); None without a cycle.

    Pointer doubling: after r rounds the nodes 2^r steps behind some node are known.  They only become fewer, and once a round
    leaves as many as before, they lead to one another: these are the cycles, and the smallest labels are sought among them alone.
    """
    jumps, before = edges.select(F.col("src").alias("node"), F.col("dst").alias("jump")), None
    for _ in range(rounds + 1):
        left = jumps.agg(F.count_distinct("jump")).first()[0]
        if not left:
            return None
        if left == before:
            break
        before = left
        jumps = stored(jumps.join(jumps.select(F.col("node").alias("jump"), F.col("jump").alias("_jump")).hint("merge"), "jump").select("node", F.col("_jump").alias("jump")), "jumps")
    on = stored(jumps.select(F.col("jump").alias("node")).distinct(), "rings")
    state = edges.select(F.col("src").alias("node"), F.col("dst").alias("jump")).join(on, "node", "left_semi").withColumn("low", F.col("node"))
    for _ in range(left.bit_length()):
        ahead = state.select(F.col("node").alias("jump"), F.col("jump").alias("_jump"), F.col("low").alias("_low"))
        state = stored(state.join(ahead.hint("merge"), "jump").select("node", F.col("_jump").alias("jump"), F.least("low", "_low").alias("low")), "rings")
    return state.select("node", "low")


def _walk(edges: DataFrame, first: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame | None]:
    """Chain and position of every node behind the starts ``first``, and the edges of cycles (None without a cycle).

    For edges of which no two leave or reach the same node.  After round r an open node knows the node 2^r steps behind (``back``);
    it is settled once that one is, so a round is one join of the open nodes.  The nodes of a chain settle with every round, so a
    round that settles none leaves cycles alone.
    """
    settled = [first.select("node", F.col("node").alias("chain"), F.lit(0).cast("bigint").alias("position"))]
    whole = edges.select(F.col("dst").alias("node"), F.col("src").alias("back"))
    left, before = whole, None
    for r in range(rounds + 1):
        n = left.count()
        if not n:
            return reduce(DataFrame.union, settled), None
        if n == before:
            break
        before = n
        known = reduce(DataFrame.union, settled).select(F.col("node").alias("back"), "chain", "position", F.lit(None).cast(edges.schema["src"].dataType).alias("_back"))
        open_ = left.select(F.col("node").alias("back"), F.lit(None).cast(edges.schema["src"].dataType).alias("chain"), F.lit(None).cast("bigint").alias("position"), F.col("back").alias("_back"))
        moved = stored(
            left.join(known.union(open_).hint("merge"), "back")
            .select("node", "chain", (F.col("position") + (1 << r)).alias("position"), F.col("_back").alias("back")), "walked"
        )
        settled.append(moved.where("chain is not null").select("node", "chain", "position"))
        left = moved.where("chain is null").select("node", "back")
    on = left.select(F.col("node").alias("dst"))
    return reduce(DataFrame.union, settled), stored(edges.join(on, "dst", "left_semi").select("src", "dst"), "rings")


def _apart(edges: DataFrame, nodes: DataFrame, rounds: int) -> DataFrame:
    """The chains of edges of which no two leave or reach the same node: none overlaps, and cycles stand alone."""
    paths, ring_edges = _walk(edges, nodes.where("_in = 0").select("node"), rounds)
    out = paths.withColumn("cycle", F.lit(False))
    rings = None if ring_edges is None else _rings(ring_edges, rounds)
    if rings is not None:
        first = rings.where("node = low").select("node")
        around, _ = _walk(ring_edges.join(first.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"), first, rounds)
        out = out.union(around.withColumn("cycle", F.lit(True)))
    return out.select("chain", "node", "position", "cycle", F.lit(False).alias("overlapped"))


def _follow(edges: DataFrame, nodes: DataFrame, rounds: int) -> DataFrame:
    """Pointer doubling along edges without cycles until no node is left with a way to go.

    After round r a node knows the node 2^r steps ahead (``jump``, null behind the end) and, of all paths of less than 2^r
    steps that lead to it from a node without an incoming edge, the longest (``best``: its negative length and its start; of
    equal lengths the smallest start).  Only the nodes with a way to go are joined to what lies ahead.
    """
    first = nodes.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
    begun = first.select("node", F.struct(F.lit(0).cast("bigint").alias("length"), F.col("node").alias("start")).alias("best"))
    state = nodes.join(edges.select(F.col("src").alias("node"), F.col("dst").alias("jump")).hint("merge"), "node", "left")
    state = stored(state.join(begun.hint("merge"), "node", "left"), "chains")
    for r in range(rounds):
        moving = state.where("jump is not null")
        if moving.isEmpty():
            break
        longer = F.struct((F.col("best.length") - (1 << r)).alias("length"), F.col("best.start").alias("start"))
        gained = moving.where("best is not null").groupBy(F.col("jump").alias("node")).agg(F.min(longer).alias("_best"))
        ahead = moving.select(F.col("node").alias("jump"), F.col("jump").alias("_jump"))
        further = moving.select("node", "jump").join(ahead.hint("merge"), "jump").select("node", "_jump")
        state = stored(
            state.join(further.hint("merge"), "node", "left").join(gained.hint("merge"), "node", "left")
            .select("node", F.col("_jump").alias("jump"), F.least("best", "_best").alias("best")), "chains"
        )
    return state


def chain_paths(edges: DataFrame, max_rounds: int = 62) -> DataFrame:
    """Every node of ``src -> dst`` edges with its chain: (chain, node, position, cycle, overlapped).

    A node has at most one outgoing edge; several edges may lead to it.  A chain begins at a node without an incoming edge and
    is named after it; where chains meet, what follows belongs to the longest of them (of equal ones the one with the
    smallest start), and the others end there and are ``overlapped``.  Nodes on a cycle form a chain of their own that starts at
    the smallest of them, with ``cycle`` set; a chain that runs into a cycle ends there, overlapped.

    Pointer doubling: a chain of n nodes takes log2(n) rounds of joins, each written to shared storage and read again (a
    checkpoint would carry the constraints of all rounds before into every plan).  Where no two edges leave or reach the same
    node, every node walks back to its start, and those that never arrive are on cycles.  Otherwise cycles are found first and
    cut, and only then the chains are followed.
    """
    edges = stored(edges.select("src", "dst").where("src is not null and dst is not null"), "edges")
    nodes = _ends(edges)
    n, most = nodes.agg(F.count(F.lit(1)), F.max(F.greatest("_in", "_out"))).first()
    rounds = max(1, n.bit_length())
    if rounds > max_rounds:
        raise ValueError(f"chains of up to 2^{rounds} nodes need more than {max_rounds} rounds")
    if (most or 0) > 1:  # chains meet, or edges repeat
        edges = stored(edges.distinct(), "edges")
        nodes = nodes.select("node")
    else:
        return _apart(edges, nodes, rounds)
    rings = _rings(edges, rounds)
    cut = edges
    if rings is not None:
        into = rings.select(F.col("node").alias("dst"), F.col("low").alias("_low"))
        inside = rings.select(F.col("node").alias("src"), F.lit(True).alias("_inside"))
        known = edges.join(into, "dst", "left").join(inside, "src", "left")
        cut = stored(known.where("_low is null or (_inside and dst <> _low)").select("src", "dst"), "edges")
    else:
        rings = nodes.where(F.lit(False))
    state = _follow(cut, nodes, rounds)
    placed = state.select("node", F.col("best.start").alias("chain"), (-F.col("best.length")).alias("position"))
    here = placed.select(F.col("node").alias("src"), F.col("chain").alias("_from"))
    there = placed.select(F.col("node").alias("dst"), F.col("chain").alias("_to"))
    ended = edges.join(here, "src").join(there, "dst").where("_from <> _to").select(F.col("_from").alias("chain"), F.lit(True).alias("_overlapped")).distinct()
    out = placed.join(rings.select("node", F.lit(True).alias("_cycle")), "node", "left").join(ended, "chain", "left")
    return out.select("chain", "node", "position", F.coalesce("_cycle", F.lit(False)).alias("cycle"), F.coalesce("_overlapped", F.lit(False)).alias("overlapped"))
