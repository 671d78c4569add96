"""Retrieval metrics over judged cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: ranks that a case is judged by.
WIDTH = 3


def judged(cases: DataFrame, ranked: DataFrame, width: int = WIDTH) -> DataFrame:
    """(query_id, case_group, rank): the best rank at which the expected asset is found among the first `width`; null if it isn't."""
    hits = ranked.where(F.col("rank") <= width).join(cases.select("query_id", F.col("expected").alias("asset_id")), ["query_id", "asset_id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return cases.select("query_id", "case_group").distinct().join(hits, "query_id", "left")


def metrics(cases: DataFrame, width: int = WIDTH, *by: str) -> DataFrame:
    """(*by, case_group, n, recall_1, recall_3, mrr, ndcg_3, noise_3), each group and all together, to four places."""
    rank = F.col("rank")
    mean = lambda x: F.round(F.avg(x), 4)
    found = lambda k: F.when(rank <= k, 1.0).otherwise(0.0)
    columns = [F.count("*").alias("n"), mean(found(1)).alias("recall_1"), mean(found(3)).alias("recall_3"), mean(F.coalesce(1 / rank, F.lit(0.0))).alias("mrr"), mean(F.coalesce(1 / F.log2(rank + 1), F.lit(0.0))).alias("ndcg_3"), mean(F.when(rank.isNull(), 1.0).otherwise((width - 1) / width)).alias("noise_3")]
    return cases.groupBy(*by, "case_group").agg(*columns).unionByName(cases.groupBy(*by, F.lit("overall").alias("case_group")).agg(*columns))
