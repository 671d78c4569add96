"""Many configurations of a retrieval at once: hits are found one time, and each configuration weighs and ranks them."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vergence.operators.evaluation import WIDTH, metrics
from vergence.operators.retrieval import AFFINITY, DENSE_WEIGHT


#: Best hits of a question that are kept for WIDTH results, because final scores, rounded, may tie where weighed ones don't.
SPARE = 16


@dataclass(frozen=True)
class Configuration:
    """How hits are weighed: strength of title affinity, and the weight of the cosine, null without dense hits."""

    name: str
    alpha: float = 0.0
    dense: float | None = None


#: The three levels of the ablation: lexical, with title affinity, with dense fusion.
LEVELS = (Configuration("L1"), Configuration("L2", AFFINITY), Configuration("L3", AFFINITY, DENSE_WEIGHT))


def swept(lexical: DataFrame, affinity: DataFrame, dense: DataFrame, configurations: tuple[Configuration, ...], key: str, k: int = WIDTH) -> DataFrame:
    """(configuration, query_id, key, final, rank): the k best hits of each question in each configuration.

    lexical (query_id, key, score), affinity (query_id, key, affinity) and dense (query_id, key,
    cos) are read once, whatever the number of configurations; each hit is repeated for each
    configuration beside it, and no hit meets another question's.  With fusion, scores go from 0 to
    1 within the question before the weighted cosine is added, all equal are 1, and dense hits
    count without lexical ones, but not for a question that has none; without it they don't."""
    both = lexical.select("query_id", key, "score").join(dense.select("query_id", key, "cos"), ["query_id", key], "full").join(affinity.select("query_id", key, "affinity"), ["query_id", key], "left")
    table = F.array(*[F.struct(*[F.lit(v).cast("string" if n == "name" else "double").alias(n) for n, v in asdict(c).items()]) for c in configurations])
    each = both.withColumn("c", F.explode(table)).select("query_id", key, "score", "cos", F.col("c.name").alias("configuration"), "c.dense", F.round(F.col("score") * (1 + F.col("c.alpha") * F.coalesce("affinity", F.lit(0.0))), 9).alias("weighed"))
    of = W.partitionBy("configuration", "query_id")
    low, high = F.min("weighed").over(of), F.max("weighed").over(of)
    bounded = each.withColumn("low", low).withColumn("high", high).where("high is not null and (dense is not null or score is not null)")
    scaled = F.when(F.col("weighed").isNull(), 0.0).when(F.col("high") == F.col("low"), 1.0).otherwise((F.col("weighed") - F.col("low")) / (F.col("high") - F.col("low")))
    final = F.when(F.col("dense").isNull(), F.col("weighed")).otherwise(F.round(scaled + F.col("dense") * F.coalesce("cos", F.lit(0.0)), 9))
    ranked = bounded.withColumn("final", final).withColumn("rank", F.row_number().over(of.orderBy(F.desc("final"), key)))
    return ranked.where(F.col("rank") <= k).select("configuration", "query_id", key, "final", "rank")


def sweep_metrics(cases: DataFrame, ranked: DataFrame, configurations: tuple[Configuration, ...], key: str = "asset_id", width: int = WIDTH) -> DataFrame:
    """(configuration, case_group, n, recall_1, recall_3, mrr, ndcg_3, noise_3) of each configuration, each group and all together.

    cases (query_id, expected, case_group); a case without a hit counts in every configuration."""
    met = ranked.where(F.col("rank") <= width).join(cases.select("query_id", F.col("expected").alias(key)), ["query_id", key])
    found = met.groupBy("configuration", "query_id").agg(F.min("rank").alias("rank"))
    every = cases.select("query_id", "case_group").distinct().withColumn("configuration", F.explode(F.array(*[F.lit(c.name) for c in configurations])))
    return metrics(every.join(found, ["configuration", "query_id"], "left"), width, "configuration")


def changes(ranked: DataFrame, before: str, after: str, key: str = "asset_id") -> DataFrame:
    """(query_id, from_rank, to_rank, key): first-ranked hits of `after` that weren't first in `before`, and where they stood there."""
    old = ranked.where(F.col("configuration") == before).select("query_id", key, F.col("rank").alias("from_rank"))
    new = ranked.where((F.col("configuration") == after) & (F.col("rank") == 1)).select("query_id", key, F.col("rank").alias("to_rank"))
    return new.join(old, ["query_id", key], "left").where("from_rank is null or from_rank > 1").select("query_id", "from_rank", "to_rank", key)
