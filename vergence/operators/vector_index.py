"""An inverted-file index over vectors: lists around centroids, of which a query probes the nearest ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vergence.operators.retrieval import DENSE_FLOOR, DENSE_WIDTH, REVIEWS, top_k, without_reviews

#: Rows of the sample of each vector length that centroids are fitted on, most lists, and rounds of the fit.
SAMPLE_ROWS, MOST_LISTS, ROUNDS = 20_000, 1024, 12
#: Share of neighbours in the sample that its own probes must find, and how many of its rows ask for theirs.
TARGET, ASKING = 0.99, 512
#: Vectors, and queries, that one task holds of a list at once.
BLOCK = 2048

_CENTROIDS = "dim int, list int, centroid array<double>, probes int"


def _unit(vectors) -> np.ndarray:
    x = np.array(list(vectors), np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector has a direction; null, empty and zero vectors and those with null or non-finite parts have none."""
    v, limit = F.col(column), float("inf")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < limit))
    return vectors.where(F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False)))


def _means(x: np.ndarray, lists: int) -> np.ndarray:
    """Unit centroids by rounds of nearest means; a list that loses its rows takes the row that fits its own list least."""
    centroids = x[np.unique(np.linspace(0, len(x) - 1, lists).astype(int))].copy()
    for _ in range(ROUNDS):
        cos = x @ centroids.T
        of, fit = cos.argmax(axis=1), cos.max(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, x)
        norm = np.sqrt((sums * sums).sum(axis=1))
        lost = np.flatnonzero(norm < 1e-9)
        sums[lost], norm[lost] = x[np.argsort(fit, kind="stable")[: len(lost)]], 1.0
        centroids = sums / norm[:, None]
    return centroids


def _probes(x: np.ndarray, centroids: np.ndarray, k: int) -> int:
    """The least number of probes by which rows of the sample find the target share of their k nearest others in it."""
    asking = np.linspace(0, len(x) - 1, min(ASKING, len(x))).astype(int)
    cos = x[asking] @ x.T
    cos[np.arange(len(asking)), asking] = -2.0
    near = np.argsort(-cos, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    if near.size == 0:
        return 1
    place = np.argsort(np.argsort(-(x[asking] @ centroids.T), axis=1, kind="stable"), axis=1)
    of = (x @ centroids.T).argmax(axis=1)
    needed = np.sort(np.take_along_axis(place, of[near], axis=1).ravel())
    return int(needed[int(np.ceil(TARGET * len(needed))) - 1]) + 1


def fit(vectors: DataFrame, lists: int | None = None, k: int = DENSE_WIDTH, sample: int = SAMPLE_ROWS) -> DataFrame:
    """(dim, list, centroid, probes) of vectors (vec_id, embedding), for each length of theirs.

    Fitted on at most `sample` rows of a length, those of least hash of their id, so that the
    same rows give the same centroids.  `lists` is by default the root of the length's rows, at
    most MOST_LISTS; `probes` is what the sample's rows need to find their k nearest."""
    rows = usable(vectors, "embedding").select("vec_id", "embedding", F.size("embedding").alias("dim"))
    sizes = rows.groupBy("dim").agg(F.count("*").alias("rows"))
    first = rows.withColumn("_n", F.row_number().over(W.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id"))).where(F.col("_n") <= sample)

    def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _unit(pdf.sort_values("_n")["embedding"])
        n = lists or min(MOST_LISTS, round(float(pdf["rows"].iloc[0]) ** 0.5))
        c = _means(x, max(1, min(n, len(x))))
        return pd.DataFrame({"dim": int(pdf["dim"].iloc[0]), "list": range(len(c)), "centroid": list(c), "probes": _probes(x, c, k)})

    return first.join(sizes, "dim").groupBy("dim").applyInPandas(centroids, _CENTROIDS)


def _assigned(rows: DataFrame, column: str, centroids: DataFrame, probes: int | None) -> DataFrame:
    """rows with dim and each of the lists that they go to, the nearest first: one list, or as many as are probed if `probes` isn't 1."""
    held: dict[int, tuple] = {}
    for r in centroids.orderBy("dim", "list").toLocalIterator():  # at most MOST_LISTS of each length
        held.setdefault(r["dim"], ([], r["probes"]))[0].append(r["centroid"])
    table = {dim: (np.array(c), min(len(c), probes or tuned)) for dim, (c, tuned) in held.items()}
    shared = rows.sparkSession.sparkContext.broadcast(table)
    key = rows.columns[0]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = pdf[column].map(len).to_numpy()
            for dim in set(sizes.tolist()) & set(shared.value):
                of, (c, n) = pdf[sizes == dim], shared.value[dim]
                unit = _unit(of[column])
                near = np.argsort(-(unit @ c.T), axis=1, kind="stable")[:, :n]
                yield pd.DataFrame({key: np.repeat(of[key].to_numpy(), n), "dim": dim, "list": near.ravel(), "unit": [u for u in unit for _ in range(n)]})

    return rows.mapInPandas(assign, f"{key} long, dim int, list int, unit array<double>")


def build(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """(vec_id, dim, list, unit): every usable vector in the list of its nearest centroid; a table to be written."""
    return _assigned(usable(vectors, "embedding").select("vec_id", "embedding"), "embedding", centroids, 1)


def search(queries: DataFrame, index: DataFrame, centroids: DataFrame, k: int = DENSE_WIDTH, floor: float = DENSE_FLOOR, probes: int | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, vec_id, cos, rank): the k nearest vectors in the lists that each query probes, rescored exactly.

    queries (query_id, query).  Probes are those of the fit unless given; all lists give the exact
    result.  A list meets its queries in blocks of about `block` vectors by `block` queries, by
    counted sizes, so that no task holds a whole list and a list of a third of all rows is many
    tasks; each hands on k rows of a query at most.  Unusable vectors hit nothing."""
    asked = _assigned(usable(queries, "query").select("query_id", "query"), "query", centroids, probes)
    parts = lambda df, name: df.groupBy("dim", "list").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    cut = parts(index, "vector_parts").join(parts(asked, "query_parts"), ["dim", "list"])
    dealt = lambda df, key, own, other: df.join(F.broadcast(cut), ["dim", "list"]).select(
        "dim", "list", F.pmod(F.xxhash64(key), F.col(own)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other), key, "unit")
    keys = ["dim", "list", "vector_parts", "query_parts"]
    left, right = dealt(index, "vec_id", "vector_parts", "query_parts"), dealt(asked, "query_id", "query_parts", "vector_parts")

    def score(vectors: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "cos": pd.Series(dtype="float64")})
        if vectors.empty or asking.empty:
            return none
        ids, x, out = vectors["vec_id"].to_numpy(), np.array(list(vectors["unit"])), []
        for query_id, cos in zip(asking["query_id"], np.array(list(asking["unit"])) @ x.T):
            met = np.flatnonzero(cos >= floor)
            best = met[np.lexsort((ids[met], -cos[met]))[:k]]
            out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[best], "cos": cos[best]}))
        return pd.concat([none, *out])

    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, "query_id long, vec_id long, cos double")
    return top_k(met, k, "vec_id", score="cos")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(expected, hits, recall) of the neighbours (query_id, vec_id) that the exact way finds."""
    met = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return met.agg(F.count("*").alias("expected"), F.count("hit").alias("hits")).withColumn("recall", F.try_divide(F.col("hits"), F.col("expected")))


def gated(found: DataFrame, questions: DataFrame, kinds: DataFrame) -> DataFrame:
    """Neighbours of questions (query_id, question) without reviews where reviews are no evidence.

    kinds (vec_id, source_kind).  The gate comes after the cut, so that fewer than k may be left, and ranks keep their gaps."""
    rows = found.join(questions.select("query_id", without_reviews(F.col("question")).alias("_gate")), "query_id", "left").join(kinds.select("vec_id", "source_kind"), "vec_id", "left")
    closed = F.coalesce(F.col("_gate") & (F.col("source_kind") == REVIEWS), F.lit(False))
    return rows.where(~closed).select(*found.columns, "source_kind")
