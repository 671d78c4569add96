"""Connected components by hooking to the least neighbour and contracting, with joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vergence.llm.common import cut, packed, sized_broadcast


def _oriented(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct()


def _further(hops: DataFrame, rows: int) -> DataFrame:
    on = hops.select(F.col("hi").alias("up"), F.col("up").alias("further"))
    return hops.join(sized_broadcast(on, rows), "up", "left").select("hi", F.coalesce("further", "up").alias("up"))


def _jump(hops: DataFrame, rows: int) -> DataFrame:
    """Follows the hops until each ends at a node that has none; a round makes them four times as long."""
    while not hops.join(sized_broadcast(hops.select(F.col("hi").alias("up")), rows), "up", "left_semi").isEmpty():
        hops = cut(packed(_further(_further(hops, rows), rows), rows))
    return hops


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node that has an edge to another one, but for the least node of
    each component, with that least node.  Loops, repeated and reversed edges and null ends are
    allowed and change nothing; no edges give no rows.

    Each round hooks every node to its least smaller neighbour, follows these hops to their ends
    and replaces the ends of all edges; a star of any size vanishes in one round.  A group of
    edges is only ever aggregated with partial sums or joined, so a hub is split by Spark.  A
    round's edges are counted, and no table of it has more rows: few of them are packed into few
    tasks and joined by broadcasts.
    """
    left, levels, most = cut(_oriented(edges, a, b)), [], 0
    while rows := left.count():
        most, left = max(most, rows), packed(left, rows)
        hops = _jump(cut(packed(left.groupBy("hi").agg(F.min("lo").alias("up")), rows)), rows)
        levels.append(hops)
        of_lo = hops.select(F.col("hi").alias("lo"), F.col("up").alias("lo_up"))
        moved = left.join(sized_broadcast(hops, rows), "hi").join(sized_broadcast(of_lo, rows), "lo", "left").select(F.col("up").alias("a"), F.coalesce("lo_up", "lo").alias("b"))
        left = cut(packed(_oriented(moved, "a", "b"), rows))
    if not levels:
        return left.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    found = levels[-1]
    for hops in reversed(levels[:-1]):
        on = found.select(F.col("hi").alias("up"), F.col("up").alias("end"))
        found = hops.join(sized_broadcast(on, most), "up", "left").select("hi", F.coalesce("end", "up").alias("up")).unionByName(found)
    return packed(found.select(F.col("hi").alias("node"), F.col("up").alias("component")), most)


def extended(found: DataFrame, edges: DataFrame) -> DataFrame:
    """connected_components() of the edges (a, b) and of those that `found` came from."""
    known, rows = found.count(), edges.count()
    of_a = found.select(F.col("node").alias("a"), F.col("component").alias("at_a"))
    of_b = found.select(F.col("node").alias("b"), F.col("component").alias("at_b"))
    moved = packed(edges, rows).join(sized_broadcast(of_a, known), "a", "left").join(sized_broadcast(of_b, known), "b", "left").select(F.coalesce("at_a", "a").alias("a"), F.coalesce("at_b", "b").alias("b"))
    more = cut(connected_components(moved))  # no more rows than edges
    on = more.select(F.col("node").alias("component"), F.col("component").alias("end"))
    return cut(packed(found.join(sized_broadcast(on, rows), "component", "left").select("node", F.coalesce("end", "component").alias("component")).unionByName(more), known + rows))
