"""Prices and stocks of what a question names, found in the whole catalog, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vergence.functions import labels
from vergence.operators import matching
from vergence.plans.more import ASKED, INTENT, LABEL, PRICED, RESIDUAL, query
from vergence.plans.sql import PRODUCTS
from vergence.sources import views

#: Questions about a stock, and the brand whose stocks aren't set.
ABOUT_STOCK, UNSET_BRAND = "货|库存", "Brand#13"

# Every question as it is, and once more with the last word of the product's name and the category's alias.
QUESTIONS = f"""(select query_id * 2 as query_id, question from {ASKED} union all
    select query_id * 2 + 1, replace(replace(question, name, regexp_extract(name, '\\S+$')), category, lower(category)) from {ASKED})"""
GOODS = f"(select id, name, category, case when brand <> '{UNSET_BRAND}' then stock end as stock, price_cents from ({PRODUCTS}))"
# Every piece of every name against every piece of every question.
MATCHED = f"""pieces as (select substring(name, i::int, n::int) as piece, min(id) as id from {GOODS}, (select unnest(range(1, 64)) as i), (select unnest(range(2, 64)) as n) where i + n - 1 <= length(name) group by 1),
    asked as (select query_id, i, n, substring(question, i::int, n::int) as piece, question from {QUESTIONS}, (select unnest(range(1, 256)) as i), (select unnest(range(2, 64)) as n) where i + n - 1 <= length(question)),
    matched as (select query_id, question, id as product_id, piece from asked join pieces using (piece) qualify row_number() over (partition by query_id order by n desc, id, i) = 1)"""
TARGETS = """targets as (select lower(p_type) as token, p_type as category, row_number() over (order by p_type) as place from (select distinct p_type from part)
        union all select p_type, p_type, 1000 - length(p_type) + 0.001 * row_number() over (order by p_type) from (select distinct p_type from part))"""


def _named(pure) -> str:
    """The category and the product that are all that a question names."""
    return f"""with {MATCHED}, {TARGETS},
    cat as (select query_id, arg_min(category, place) as category from {QUESTIONS} join targets on contains(question, token) and {pure('token')} = '' group by query_id),
    own as (select query_id, product_id, name, g.category as own_category, stock, price_cents from matched join {GOODS} g on g.id = product_id where {pure('piece')} = ''),"""


def _questions(spark: SparkSession, d: str) -> DataFrame:
    asked = views.asks(spark, d)
    shorter = F.replace(F.replace("question", F.col("name"), F.regexp_extract("name", r"\S+$", 0)), F.col("category"), F.lower("category"))
    both = F.explode(F.array(F.struct((F.col("query_id") * 2).alias("query_id"), "question"), F.struct((F.col("query_id") * 2 + 1).alias("query_id"), shorter.alias("question"))))
    return asked.select(both.alias("q")).select("q.*")


def _goods(spark: SparkSession, d: str) -> DataFrame:
    return views.products(spark, d).withColumn("stock", F.when(F.col("brand") != UNSET_BRAND, F.col("stock")))


def _aliases(goods: DataFrame) -> DataFrame:
    return goods.where("category is not null").select(F.lit(0).alias("place"), F.lower("category").alias("token"), "category").distinct()


@query(f"with {MATCHED} select query_id, product_id, piece from matched")
def matched_products(spark: SparkSession, d: str) -> DataFrame:
    """The product that shares the longest piece of its name with each question."""
    return matching.matched_products(_questions(spark, d), _goods(spark, d))


@query(f"""{_named(PRICED)} sums as (select category, count(*) as total, count(price_cents) as priced, min(price_cents) as low, max(price_cents) as high from {GOODS} group by category),
    met as (select query_id, s.*, product_id, name, own_category, own.price_cents as cents, case when priced > 0 then 'category' when own.price_cents is not null then 'product' else 'none' end as kind
        from (select query_id from {QUESTIONS} where coalesce({INTENT}, '') = 'price') left join cat using (query_id) left join own using (query_id) left join sums s using (category))
    select query_id, kind, case when kind = 'product' then product_id end as product_id, case kind
        when 'category' then category || '共 ' || total || ' 件，其中已定价 ' || priced || ' 件，' || case when low = high then '均为 ' || {LABEL('low')} else '价格 ' || {LABEL('low')} || '–' || {LABEL('high')} end
            || case when total > priced then '（另有 ' || (total - priced) || ' 件未定价）' else '' end || '；问具体型号给你准确价。'
        when 'product' then name || '（' || own_category || '）售价 ' || {LABEL('cents')} || '。' end as answer from met""")
def quote_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers to questions about prices, of a category or of the product that they name."""
    asked = _questions(spark, d).where(F.coalesce(labels.catalog_intent(F.col("question")) == "price", F.lit(False)))
    goods = _goods(spark, d)
    return matching.quote_answers(asked, goods, _aliases(goods))


@query(f"""{_named(RESIDUAL)} sums as (select category, count(*) as total, count(*) filter (stock > 0) as filled, sum(stock) as held from {GOODS} group by category),
    met as (select query_id, s.*, product_id, name, stock, case when total > 0 then 'category' when stock > 0 then 'in_stock' when stock is not null then 'out_of_stock' when product_id is not null then 'unset' else 'none' end as kind
        from (select query_id from {QUESTIONS} where regexp_matches(question, '{ABOUT_STOCK}')) left join cat using (query_id) left join own using (query_id) left join sums s using (category))
    select query_id, kind, case when kind not in ('category', 'none') then product_id end as product_id, case kind
        when 'category' then category || '共 ' || total || ' 件，其中有货 ' || filled || ' 件' || coalesce('，库存合计 ' || held || ' 件', '（库存未逐件设置）') || '。' when 'in_stock' then name || '有货，当前库存 ' || stock || ' 件。'
        when 'out_of_stock' then name || '暂时无货。' when 'unset' then name || '库存未设置，已转人工。' else '没有找到对应商品，已转人工。' end as answer from met""")
def stock_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Answers to questions about stocks, of a category or of the product that they name."""
    goods = _goods(spark, d)
    return matching.stock_lookups(_questions(spark, d).where(F.col("question").rlike(ABOUT_STOCK)), goods, _aliases(goods))
