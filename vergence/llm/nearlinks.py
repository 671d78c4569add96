"""Classes of similar sets from blocking keys, without all pairs of a group.

Sets that share a key are candidates.  An id is first compared with the least ids of some of its
groups, which links nearly all of a group of near copies.  What is left outside the component that
most of its group is in is compared with more members of that component, and at last with the
whole group, so that no candidate link between different components is lost; large groups do so
in blocks, whose sets are read once for many pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vergence.llm.common import NEAR_PERCENT, cut, packed, sized_broadcast
from vergence.llm.components import connected_components, extended

#: Members that an id is compared with in a round before the last one, and the most rounds.
PROBES, ROUNDS = 4, 2
#: Members of a group beyond which the last round works in blocks, and the values that a block's sets have together.
LARGE, BLOCK_VALUES = 64, 1 << 18
#: Values of the sets of a partition.
PART_VALUES = 1 << 20
_SLICE = 8192


def sizes_fit(percent: int) -> Callable[[Column, Column], Column]:
    """The sizes n of two rows allow the similarity."""
    return lambda a, b: 100 * F.least(a["n"], b["n"]) >= percent * F.greatest(a["n"], b["n"])


def _similar(x: Column, y: Column, percent: int) -> Column:
    """100 * |x and y| >= percent * |x or y| of arrays of distinct values."""
    both = F.size(F.array_intersect(x, y))
    return (both > 0) & (100 * both >= percent * (F.size(x) + F.size(y) - both))


def _pair(x: Column, y: Column) -> list[Column]:
    return [F.least(x["id"], y["id"]).alias("a"), F.greatest(x["id"], y["id"]).alias("b")]


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) whose full sets, given as (id, members), are similar.

    A set that many pairs name is a key with many rows on one side and one row on the other,
    which Spark's skew join splits."""
    of_b = sets.select(F.col("id").alias("b"), F.col("members").alias("of_b"))
    of_a = sets.select(F.col("id").alias("a"), F.col("members").alias("of_a"))
    return cut(pairs.join(of_b, "b").join(of_a, "a").where(_similar(F.col("of_a"), F.col("of_b"), percent)).select("a", "b"))


def _shared(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all x with all y, a slice of the values that both have at a time."""
    each = lambda sets: (np.concatenate([*sets, np.empty(0, np.int64)]), np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
    (of_x, row_x), (of_y, row_y) = each(x), each(y)
    values = np.intersect1d(of_x, of_y)
    out = np.zeros((len(x), len(y)), np.float32)

    def placed(of: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(values, of), max(0, len(values) - 1))
        there = values[at] == of if len(values) else np.zeros(len(of), bool)
        order = np.argsort(at[there], kind="stable")
        return at[there][order], row[there][order]

    (at_x, row_x), (at_y, row_y) = placed(of_x, row_x), placed(of_y, row_y)
    for i in range(0, len(values), _SLICE):
        parts = []
        for at, row, n in ((at_x, row_x, len(x)), (at_y, row_y, len(y))):
            low, high = np.searchsorted(at, [i, i + _SLICE])
            m = np.zeros((n, min(_SLICE, len(values) - i)), np.float32)
            m[row[low:high], at[low:high] - i] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def block_links(outsiders: DataFrame, members: DataFrame, sets: DataFrame, percent: int, block_values: int = BLOCK_VALUES) -> DataFrame:
    """(a, b): similar sets of an outsider and a member of the same arena, both given as (arena, id, n).

    Each block of outsiders meets each block of members; n, the size of the id's set, decides how
    many blocks there are, and a hash of the id which one it is in.  A row of counts for each
    arena is all that is joined by the arena."""
    count = lambda rows, name: rows.groupBy("arena").agg(F.ceil(F.sum("n") / block_values).cast("int").alias(name))
    blocks = cut(count(outsiders, "of_o").join(count(members, "of_m"), "arena"))
    blocks = sized_broadcast(packed(blocks, n := blocks.count()), n)
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    met = outsiders.join(blocks, "arena").select("arena", "id", F.lit(True).alias("outside"), place("of_o").alias("i"), every("of_m").alias("j"))
    met = met.unionByName(members.join(blocks, "arena").select("arena", "id", F.lit(False).alias("outside"), place("of_m").alias("j"), every("of_o").alias("i")))

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["outside"]], pdf[~pdf["outside"]]
        sizes = lambda rows: np.array([len(m) for m in rows["members"]], np.float64)
        both = _shared([np.asarray(m, np.int64) for m in x["members"]], [np.asarray(m, np.int64) for m in y["members"]])
        union = sizes(x)[:, None] + sizes(y)[None, :] - both
        r, c = np.nonzero((both > 0) & (100 * both >= percent * union))
        a, b = x["id"].to_numpy()[r], y["id"].to_numpy()[c]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})[a != b]

    return met.join(sets, "id").groupBy("arena", "i", "j").applyInPandas(links, "a long, b long").distinct()


def similarity_components(rows: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int = NEAR_PERCENT) -> DataFrame:
    """(node, component) of the similar sets among those that share a key.

    rows: distinct (key, id, n), n being the size of the id's set.  sets_of(ids) gives the
    (id, members) of the ids asked for."""
    fits = sizes_fit(percent)
    groups = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("pivot")).where("size > 1")
    held = cut(rows.join(groups.select("key", "pivot"), "key"))
    size = held.count()
    held = packed(held, size)
    pivots = held.where("id <> pivot").groupBy("id").agg(F.slice(F.sort_array(F.collect_set("pivot")), 1, PROBES).alias("pivots"))  # as many as an id has keys
    tried = cut(pivots.select(F.explode("pivots").alias("a"), F.col("id").alias("b")))
    tried = packed(tried, tried.count())
    sets = cut(sets_of(held.select("id").distinct()))
    sets = sets.coalesce(1 + (sets.agg(F.sum(F.size("members"))).first()[0] or 0) // PART_VALUES)
    found = cut(connected_components(verified(tried, sets, percent)))

    many = held.select("key", F.struct("id", "n").alias("x"), "id")
    for turn in range(1, ROUNDS + 1):
        at = found.select(F.col("node").alias("id"), "component")
        placed = many.join(sized_broadcast(at, found.count()), "id", "left").withColumn("component", F.coalesce("component", "id"))
        by_component = placed.groupBy("key", "component").agg(F.count("*").alias("size"), F.min("id").alias("probe"))
        main = by_component.groupBy("key").agg(F.max(F.struct("size", "component", "probe")).alias("main"), F.sum("size").alias("all")).where("main.size < all")
        apart = cut(placed.join(main, "key"))
        others = apart.where("component <> main.component")
        work, left = others.agg(F.sum("all"), F.count("*")).first()
        if not left:
            return found
        last = turn == ROUNDS or work <= 4 * size
        if last:  # each pair of different components that an outsider is in
            arenas = apart.groupBy("main.component").agg(F.count_distinct("id").alias("n")).withColumnRenamed("component", "arena").where(F.col("n") > LARGE)
            arenas = cut(packed(arenas, left))
            arenas = sized_broadcast(arenas, arenas.count())
            large = apart.withColumn("arena", F.col("main.component")).join(arenas, "arena", "left_semi").select("arena", "id", "x.n", "component", "main")
            apart = apart.withColumn("arena", F.col("main.component")).join(arenas, "arena", "left_anti")
            blocks = cut(block_links(large.where("component <> main.component").select("arena", "id", "n").distinct(), large.select("arena", "id", "n").distinct(), sets, percent))
            others = apart.where("component <> main.component")
            whole = apart.select("key", F.col("x").alias("y"), F.col("component").alias("c_y"))
            near = others.select("key", "x", F.col("component").alias("c_x")).join(whole, "key").where("c_x <> c_y").where(fits(F.col("x"), F.col("y")))
            near = near.select(*_pair(F.col("x"), F.col("y")))
        else:
            probes = others.groupBy("id").agg(F.slice(F.array_sort(F.collect_set("main.probe")), 1 + (turn - 1) * PROBES, PROBES).alias("probes"))
            near = probes.select(F.explode("probes").alias("y"), "id").select(F.least("y", "id").alias("a"), F.greatest("y", "id").alias("b"))
        fresh = cut(near.distinct().join(tried, ["a", "b"], "left_anti"))
        fresh = packed(fresh, fresh.count())
        tried = tried.unionByName(fresh)
        more = verified(fresh, sets, percent)
        if last:
            more = more.unionByName(blocks)
        if not more.isEmpty():
            found = extended(found, more)
        if last:
            return found
    return found
