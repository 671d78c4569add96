"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vergence.llm.common import Scratch, cut, sized_broadcast
from vergence.llm.components import connected_components

#: Least passes, hash bits that a pass concatenates, and neighbours on each side that it compares.
PASSES, BITS, WINDOW = 32, 40, 48
#: Share of lone pairs, just similar enough, that all passes together may miss by chance.
MISSED = 0.01
#: Rows of a block of a component whose links are counted at once.
BLOCK = 512


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vector):
    """Not empty, not all zero, without nulls and other than finite numbers."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    return F.coalesce((F.size(vector) > 0) & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def passes_for(rows: int, least: float, window: int, missed: float = MISSED) -> int:
    """Passes that find a lone pair of that cosine among so many spread vectors: it must agree in the bits that part windows."""
    agree = (1 - math.acos(least) / math.pi) ** max(0.0, math.log2(max(1, rows) / window))
    return max(PASSES, math.ceil(math.log(missed) / math.log(1 - agree))) if agree < 1 else PASSES


def projected(rows: DataFrame, passes: int, bits: int, seed: int) -> DataFrame:
    """(pass, key, vec_id, dim, embedding): a row for each pass, whose key concatenates random sign hashes."""

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)[::-1]
        for pdf in batches:
            dims = pdf["embedding"].map(len)
            for dim in dims.unique():
                some = pdf[dims == dim]
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, passes * bits))
                for i in range(0, len(some), 2048):
                    of = some.iloc[i : i + 2048]
                    keys = (_unit(of["embedding"]) @ planes[dim] >= 0).reshape(len(of), passes, bits) @ weights
                    for p in range(passes):
                        yield pd.DataFrame({"pass": p, "key": keys[:, p], "vec_id": of["vec_id"], "dim": dim, "embedding": of["embedding"]})

    return rows.mapInPandas(project, "pass int, key long, vec_id long, dim int, embedding array<double>")


def _find(parent: dict, x: int) -> int:
    while parent.setdefault(x, x) != x:
        parent[x] = x = parent[parent[x]]
    return x


def window_links(ordered: DataFrame, least: float, window: int) -> DataFrame:
    """(a, b): verified pairs of the windows of each sorted partition, as a forest that joins the same vectors."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            fresh = 0 if held is None else len(held)
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            held, parent = pdf.tail(window), {}
            runs = np.flatnonzero(np.r_[True, (np.diff(pdf["pass"]) != 0) | (np.diff(pdf["dim"]) != 0), True])
            for start, end in zip(runs[:-1], runs[1:]):
                if end - start < 2:
                    continue
                x, ids = _unit(pdf["embedding"].iloc[start:end]), pdf["vec_id"].iloc[start:end].to_numpy()
                for i in range(0, len(ids), window):
                    left, right = x[i : i + window], x[i : i + 2 * window]
                    near = np.argwhere(left @ right.T >= least)
                    for r, c in near[(near[:, 1] > near[:, 0]) & (near[:, 1] - near[:, 0] <= window) & (start + i + near[:, 1] >= fresh)]:
                        a, b = _find(parent, ids[i + r]), _find(parent, ids[i + c])
                        if a != b:
                            parent[max(a, b)] = min(a, b)
            links = [(v, r) for v in list(parent) if (r := _find(parent, v)) != v]
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return ordered.mapInPandas(compare, "a long, b long")


def link_counts(members: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links): exact counts of the links inside components, block against block.

    members: (component, dim, vec_id, weight, embedding), each standing for `weight` equal vectors.
    No task gets more than two blocks at once, and only counts are emitted, however many links there are."""
    sizes = members.groupBy("component").count().withColumn("blocks", F.ceil(F.col("count") / block).cast("int"))
    placed = members.join(sizes, "component").withColumn("at", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
    # blocks i and j meet once, under (i, j) with i <= j
    meets = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meets = meets.select("component", F.least("at", "with").alias("i"), F.greatest("at", "with").alias("j"), "at", "dim", "vec_id", "weight", "embedding")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        out, weight = np.zeros(len(pdf), np.int64), pdf["weight"].to_numpy()
        for dim in pdf["dim"].unique():
            of = (pdf["dim"] == dim).to_numpy()
            rows, cols = np.flatnonzero(of & (pdf["at"] == i).to_numpy()), np.flatnonzero(of & (pdf["at"] == j).to_numpy())
            if len(rows) == 0 or len(cols) == 0:
                continue
            near = _unit(pdf["embedding"].iloc[rows]) @ _unit(pdf["embedding"].iloc[cols]).T >= least
            if i == j:
                np.fill_diagonal(near, False)
                out[rows] += near @ weight[cols]
            else:
                out[rows] += near @ weight[cols]
                out[cols] += weight[rows] @ near
        return pd.DataFrame({"vec_id": pdf["vec_id"], "n_links": out})

    return meets.groupBy("component", "i", "j").applyInPandas(count, "vec_id long, n_links long").groupBy("vec_id").agg(F.sum("n_links").alias("n_links"))


def near_vectors(rows: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", passes: int | None = None, bits: int = BITS, window: int = WINDOW, seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of the table.

    Vectors are linked at a cosine of `least` or more, in double precision.  Equal vectors are one
    from the start.  Each pass orders all others by concatenated random hashes and compares
    windows of neighbours; there are more passes the more vectors there are (passes_for), by a
    bound for spread vectors: in a crowd around one centre more lone pairs are missed (2 % of
    8,800 vectors at cosine 0.88 to it).
    Verified pairs of all passes are united, and then every link inside the united components is
    counted, so that large groups lose none.  Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, nor do vectors of different lengths.  Rows that
    repeat an id are one vector, the least in order.  A null id links with nothing and is kept.
    Other columns are ignored; an empty table gives no rows."""
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    all_rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    one = all_rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    one = scratch.table(one.select("vec_id", F.xxhash64("embedding").alias("h"), F.xxhash64(F.lit(1), "embedding").alias("g"), "embedding"))
    classes = scratch.table(one.groupBy("h", "g").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")))
    count = classes.count()
    reps = sized_broadcast(classes.select(F.col("rep").alias("vec_id"), "weight"), count)
    vectors = one.join(reps, "vec_id").select("vec_id", "weight", "embedding")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    passes = passes_for(count, least, window) if passes is None else passes
    ordered = projected(vectors, passes, bits, seed).repartitionByRange(parts, "pass", "dim", "key", "vec_id").sortWithinPartitions("pass", "dim", "key", "vec_id")
    found = cut(connected_components(window_links(ordered, least, window)))
    labels = found.select(F.col("node").alias("vec_id"), "component").unionByName(found.select(F.col("component").alias("vec_id"), "component").distinct())
    members = vectors.join(labels, "vec_id").select("component", F.size("embedding").alias("dim"), "vec_id", "weight", "embedding")
    counts = cut(labels.join(link_counts(members, least), "vec_id", "left").select(F.col("vec_id").alias("rep"), "component", "n_links"))
    of_class = classes.join(counts, "rep", "left").select("h", "g", (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    of_id = one.select("vec_id", "h", "g").join(of_class, ["h", "g"]).drop("h", "g")
    out = all_rows.select("vec_id").join(of_id, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
