"""Nearest vectors through the index, and dense candidates of questions behind the gate for reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vergence.operators import retrieval, vector_index
from vergence.operators.grams import _stored
from vergence.plans.more import ASKED, query
from vergence.plans.sql import SQL as FIRST
from vergence.sources import views
from vergence.sources.views import table

#: Cosine that a neighbour needs here, and how many are kept.
FLOOR, WIDTH = 0.3, 10
KIND = f"case when label % 2 = 0 then '{retrieval.REVIEWS}' else 'manual' end"


def _asked(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query(None)
def indexed_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors of every fiftieth among all, in the lists of the index that each probes."""
    vectors = table(spark, d, "embeddings")
    centroids = _stored(vector_index.fit(vectors))
    index = _stored(vector_index.build(vectors, centroids))
    return vector_index.search(_asked(vectors), index, centroids, WIDTH, FLOOR).select("query_id", "vec_id", "rank", F.round("cos", 6).alias("cos"))


@query(f"""with a as (select query_id, coalesce(regexp_matches(question, '{retrieval.SERVICE_WORDS}') and not regexp_matches(question, '{retrieval.OPINION_WORDS}'), false) as closed from {ASKED})
    select query_id, n.vec_id, rank, cos, {KIND} as source_kind from ({FIRST["nearest_vectors"]}) n join embeddings v on v.vec_id = n.vec_id left join a using (query_id)
    where not (coalesce(closed, false) and label % 2 = 0)""")
def dense_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors of questions, cut first; then reviews go where the question is about the state of a service."""
    vectors = table(spark, d, "embeddings")
    found = retrieval.nearest(_asked(vectors), vectors, WIDTH, FLOOR).select("query_id", "vec_id", "rank", F.round("cos", 6).alias("cos"))
    return vector_index.gated(found, views.asks(spark, d).select("query_id", "question"), vectors.select("vec_id", F.expr(KIND).alias("source_kind")))
