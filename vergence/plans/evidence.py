"""Retrieval under all of its rules at once, over evidence on products, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vergence.operators import ranking, retrieval
from vergence.plans.more import ASKED, ROTATED, query
from vergence.plans.sql import AS_OF as NOW
from vergence.plans.sql import mask, terms, top
from vergence.sources import views
from vergence.sources.views import AS_OF, table

# A product's evidence: what it is, a field and a notice, a third of it from reviews, checked 4 to 200 days ago or never.
CHUNKS = "p_name || ' ' || p_type", "case p_size % 3 when 0 then '净含量：' when 1 then '保质期：' else '运费：' end || p_size", "case p_partkey % 3 when 0 then p_name || '的邮费由店铺承担' when 1 then p_name || '质保两年' else '快递三天送到' end"


def _facts(days: str, array: str) -> list[str]:
    """Columns of the evidence, with an interval of days and an array as the engine writes them."""
    return [
        "p_partkey as asset_id", "1 as version_no", "p_name || ' ' || p_brand as title", "case when p_size % 3 = 1 then 'review_import' else 'manual' end as source_kind",
        f"case when p_size % 7 > 0 then {NOW} - {days} end as verified_at", f"{array}({', '.join(CHUNKS)}) as chunks",
    ]


_OWN = f"(select query_id, unnest({terms('question')}) as term from {ASKED})"


@query(f"""with facts as (select {', '.join(_facts('to_days((p_size * 4)::int)', 'list_value'))} from part), c as (select asset_id, unnest(range(0, len(chunks))) as seq, unnest(chunks) as chunk from facts),
    q as (select query_id, unnest(list_distinct(list_concat({terms('question')}, {terms(ROTATED)}))) as term from {ASKED}),
    lex as (select query_id, asset_id, seq, count(*) / sqrt(max(n)) as score from (select asset_id, seq, len(t) as n, unnest(t) as term from (select asset_id, seq, {terms('chunk')} as t from c)) join q using (term) group by all),
    t as (select asset_id, unnest({terms('title')}) as term from facts), idf as (select term, ln(1 + (select count(*) from facts) / (1 + count(*))) as idf from t group by term),
    aff as (select query_id, asset_id, sum(idf) / max(total) as affinity from (select asset_id, term, idf, sum(idf) over (partition by asset_id) as total from t join idf using (term)) join {_OWN} using (term) group by all),
    gate as (select query_id from {ASKED} where regexp_matches(question, '{retrieval.SERVICE_WORDS}') and not regexp_matches(question, '{retrieval.OPINION_WORDS}')),
    s as (select query_id, asset_id, seq, chunk, round(score * ((1 + 3.0 * coalesce(affinity, 0)) * case when {NOW} - verified_at > interval 90 days then 0.5 else 1.0 end), 9) as score
        from lex join facts using (asset_id) join c using (asset_id, seq) left join aff using (query_id, asset_id) where not (source_kind = 'review_import' and query_id in (select query_id from gate))),
    k as (select * from s qualify row_number() over (partition by query_id, asset_id, {mask('chunk')} order by seq) = 1), h as ({top('select * from k', 5, 'score', 'asset_id, seq')}),
    d as (select h.*, asset_id = first(asset_id) over (partition by query_id order by rank) and regexp_matches(split_part(replace(chunk, ':', '：'), '：', 1), '^[一-鿿]{{1,6}}$')
        and list_has_any({terms("split_part(replace(chunk, ':', '：'), '：', 1)")}, {terms('question')}) as named from h join {ASKED} using (query_id))
    select query_id, row_number() over (partition by query_id order by named desc, rank) as rank, asset_id, seq, round(score, 5) as score from d""")
def governed_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The five best chunks for each customer's question: synonyms, the gate for reviews, staleness, affinity and the asked field first."""
    facts = table(spark, d, "part").selectExpr(*_facts("make_dt_interval(cast(p_size * 4 as int))", "array"))
    asked = views.asks(spark, d).select("query_id", "question")
    chunks = facts.select("asset_id", "version_no", F.posexplode("chunks").alias("seq", "chunk"))
    directed = lambda hits, wordings: ranking.field_directed(hits, wordings).drop("chunk")
    hits = retrieval.retrieve(asked, facts.drop("chunks"), chunks, 5, as_of=F.lit(AS_OF).cast("timestamp"), then=directed)
    return hits.select("query_id", "rank", "asset_id", "seq", F.round("score", 5).alias("score"))

