"""Pieces of words over all documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vergence.operators import grams
from vergence.plans.more import query
from vergence.sources import views
from vergence.sources.views import table

#: Texts that must have a piece.
LEAST = 20


@query(f"""with r as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) as run from documents),
    g as (select distinct doc_id, n, substring(run, i::int, n) as gram from (select doc_id, run, n, unnest(range(1, length(run) - n + 2)) as i from r, (values (2), (3), (4)) s(n) where length(run) >= n))
    select n, gram, count(*) as df from g group by n, gram having count(*) >= {LEAST}""")
def gram_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of two to four letters that many documents have."""
    return grams.gram_frequencies(views.spread(table(spark, d, "documents").select("text")), "text", LEAST, letters="[A-Za-z]")
