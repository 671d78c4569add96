"""Ordered clean-up: what goes with what, counted first and then applied, from one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Link:
    """Rows of child whose fk is the key of a row of parent that goes, go too."""

    child: str
    fk: str
    parent: str


def levels(tables: list[str], links: list[Link]) -> list[str]:
    """Parents before their children; a cycle is an error."""
    left, out = list(tables), []
    while left:
        free = [t for t in left if not any(x.child == t and x.parent in left and x.parent != t for x in links)]
        if not free:
            raise ValueError("the links of " + ", ".join(left) + " form a cycle")
        out += free
        left = [t for t in left if t not in free]
    return out


def removals(tables: dict[str, tuple[DataFrame, str]], roots: dict[str, Column], links: list[Link], kept: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The keys that go of each table, the children first: the order in which rows can be deleted.

    tables: (rows, key column).  roots: which rows go by themselves.  kept: keys of rows that stay
    whatever holds for them, as a parent with a registered child; what hangs on them stays too,
    unless it is a root itself.  Rows that share a key go together.  A null key or link never goes with another row."""
    gone: dict[str, DataFrame] = {}
    for name in levels(list(tables), links):
        rows, key = tables[name]
        own = rows.where(F.coalesce(roots[name], F.lit(False))).select(key) if name in roots else rows.select(key).where("false")
        for link in (x for x in links if x.child == name):
            own = own.unionByName(rows.join(gone[link.parent].toDF(link.fk), link.fk, "left_semi").select(key))
        own = own.where(F.col(key).isNotNull()).distinct()
        gone[name] = own.join(kept[name].toDF(key), key, "left_anti") if kept and name in kept else own
    return dict(reversed(gone.items()))


def applied(tables: dict[str, tuple[DataFrame, str]], gone: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The rows that stay of each table; applied to what it gives, it changes nothing."""
    return {name: rows.join(gone[name], key, "left_anti") for name, (rows, key) in tables.items()}


def cleanup_report(tables: dict[str, tuple[DataFrame, str]], links: list[Link], gone: dict[str, DataFrame]) -> DataFrame:
    """(place, name, before, removed, after, orphans): the dry run beside what applying leaves; orphans are rows whose parent has gone."""
    left, out = applied(tables, gone), None
    for place, name in enumerate(gone):
        rows, key = tables[name]
        dangling = None
        for link in (x for x in links if x.child == name):
            parent, of = tables[link.parent]
            lost = left[name].join(gone[link.parent].toDF(link.fk), link.fk, "left_semi").select(key)
            dangling = lost if dangling is None else dangling.unionByName(lost)
        marked = rows.join(gone[name].withColumn("_gone", F.lit(True)), key, "left")
        counts = marked.agg(F.count("*").alias("before"), F.count("_gone").alias("removed"))
        orphans = (dangling if dangling is not None else rows.select(key).where("false")).agg(F.count("*").alias("orphans"))
        after = left[name].agg(F.count("*").alias("after"))
        one = counts.select(F.lit(place).alias("place"), F.lit(name).alias("name"), "before", "removed", after.select("after").scalar().alias("after"), orphans.select("orphans").scalar().alias("orphans"))
        out = one if out is None else out.unionByName(one)
    return out
