"""More queries with their SQL: routing of questions, index and export batches, audits, ordered views, cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vergence.functions import extract, fields, labels, text
from vergence.operators import assembly, cleanup, governance, numbering, ranking, retrieval, routing, sessions, sweep, topk, vocabulary
from vergence.operators.grams import _stored
from vergence.plans.sql import AS_OF as NOW
from vergence.plans.sql import AFFINITY, ASSETS, CHUNKS, LEX_ASSETS, MESSAGES, METRICS, PRODUCTS, chunks, lexical, mask, strip, terms, top
from vergence.sources import views
from vergence.sources.views import AS_OF, ASKS, table

SQL: dict[str, str] = {}
QUERIES: list = []


def query(sql: str | None):
    """Registers a query with its SQL."""

    def add(f):
        QUERIES.append(f)
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _q(x: str) -> str:
    return x.replace("'", "''")


ASKED = f"""(select p_partkey as query_id, p_name as name, p_type as category, replace(replace(replace([{", ".join(f"'{a}'" for a in ASKS)}][p_partkey % {len(ASKS)} + 1], '{{n}}', p_name), '{{t}}', p_type), '{{k}}', p_partkey::varchar) as question from part)"""
HUMAN = "人工|真人|转客服"
INTENT = f"""case when regexp_matches(question, '{HUMAN}|{labels.POLICY}') then null
    when regexp_matches(question, '{labels.LISTING}') then case when regexp_replace(regexp_replace(question, '^(.*?)(?:{labels.LISTING})', '\\1'), '{labels.TRIVIAL}', '', 'g') = '' then 'listing' end
    when regexp_matches(question, '{labels.PRICE}') then 'price' when contains(question, '多少') and not regexp_matches(question, '{labels.SPEC}') then 'price' end"""
WANTS = f"(regexp_matches(question, '{labels.RETURN}') and not regexp_matches(question, '{labels.RETURN_PROGRESS}') and not regexp_matches(question, '{_q(labels.RETURN_POLICY)}'))"
ENTITY = "coalesce(" + ", ".join(f"nullif(regexp_extract(question, '{p}', 1), '')" for p in labels.SCOPE) + ")"
CORE = f"regexp_replace({ENTITY}, '^(?:{labels.SCOPE_MODIFIERS})', '')"
SCOPE = f"case when {ENTITY} is null then 'not_scope' when {CORE} in ({', '.join(repr(g) for g in labels.GENERIC_SCOPE)}) or regexp_matches({CORE}, '多久|几天|几次') then 'generic' when contains(question, name) then 'in_scope' else 'out_of_scope' end"
RINGS: dict[str, str] = {}
for _ring in text.SYNONYM_RINGS:
    for _a, _b in zip(_ring, _ring[1:] + _ring[:1]):
        RINGS.setdefault(_a, _b)
ROTATED = "list_aggregate(list_transform(regexp_extract_all(question, '" + "|".join(sorted(RINGS, key=len, reverse=True)) + "|.'), lambda p: coalesce(map([" + ", ".join(f"'{k}'" for k in RINGS) + "], [" + ", ".join(f"'{v}'" for v in RINGS.values()) + "])[p], p)), 'string_agg', '')"
CATEGORIES = "(select list(c order by -length(c), c) from (select distinct p_type as c from part))"
NAMED = f"""(select a.query_id, a.question, a.name, list_filter(cs, lambda c: len(list_filter(cs, lambda o: o <> c and contains(o, c))) = 0)[1] as category, coalesce(len(cs), 0) as named
    from {ASKED} a left join (select query_id, list(c order by -length(c), c) as cs from {ASKED}, (select distinct p_type as c from part) where contains(question, c) group by query_id) using (query_id))"""


@query(f"select {INTENT} as intent, {WANTS} as wants_return, {SCOPE} as scope, count(*) as n from {ASKED} group by 1, 2, 3")
def asked_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Questions of customers by the classifiers' labels."""
    q = F.col("question")
    return views.asks(spark, d).groupBy(labels.catalog_intent(q).alias("intent"), labels.wants_return(q).alias("wants_return"), labels.scope_kind(q, F.contains(q, F.col("name"))).alias("scope")).agg(F.count("*").alias("n"))


@query(f"""select case when regexp_matches(question, '{HUMAN}') then 'handoff' when {WANTS} then 'return' when regexp_matches(question, '(?i)SO-[0-9]+') then 'order' when {INTENT} is not null then {INTENT}
    when {SCOPE} = 'out_of_scope' then 'out_of_scope' else 'retrieve' end as route, count(*) as n from {ASKED} group by 1""")
def question_routes(spark: SparkSession, d: str) -> DataFrame:
    return views.asks(spark, d).groupBy(routing.route(F.col("question"), F.contains("question", F.col("name"))).alias("route")).agg(F.count("*").alias("n"))


@query(f"select query_id, regexp_matches(question, '{retrieval.SERVICE_WORDS}') and not regexp_matches(question, '{retrieval.OPINION_WORDS}') as gated from {ASKED}")
def review_gate(spark: SparkSession, d: str) -> DataFrame:
    return views.asks(spark, d).select("query_id", retrieval.without_reviews(F.col("question")).alias("gated"))


@query(f"select query_id, {ROTATED} as rotated, len(list_distinct(list_concat({terms('question')}, {terms(ROTATED)}))) as n_terms from {ASKED}")
def synonym_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of each question and of its rewriting."""
    rotated = text.rotated_synonyms(F.col("question"))
    return views.asks(spark, d).select("query_id", rotated.alias("rotated"), F.size(F.array_union(text.terms(F.col("question")), text.terms(rotated))).alias("n_terms"))


@query(f"select query_id, upper(nullif(regexp_extract(question, '(?i)so-[0-9]+'), '')) as order_no, regexp_matches(question, '^我.*(?:问题|上一个)') as meta, regexp_matches(question, '{HUMAN}') as human from {ASKED}")
def question_marks(spark: SparkSession, d: str) -> DataFrame:
    """Order numbers, questions about the talk itself, and wishes for a human."""
    q = F.col("question")
    return views.asks(spark, d).select("query_id", text.order_number(q).alias("order_no"), q.rlike(labels.META_QUESTION).alias("meta"), q.rlike(HUMAN).alias("human"))


@query(f"select query_id, case when regexp_matches(question, '它|这个|那个|这款|那款|刚才') and prev is not null then prev || ' ' || question else question end as expanded from (select *, lag(question) over (order by query_id) as prev from {ASKED} where query_id <= 200)")
def expanded_questions(spark: SparkSession, d: str) -> DataFrame:
    """A session of the first 200 questions: those with a pronoun take the one before along."""
    asked = views.asks(spark, d).where("query_id <= 200").withColumn("prev", F.lag("question").over(W.partitionBy(F.lit(1)).orderBy("query_id")))
    return asked.select("query_id", sessions.expanded_question(F.col("question"), F.col("prev")).alias("expanded"))


RESIDUAL = lambda token: f"trim(regexp_replace(replace(question, {token}, ''), '{routing.filler_pattern()}', '', 'g'))"


@query(f"select query_id, {RESIDUAL('name')} as residual, {RESIDUAL('name')} = '' as pure from {ASKED}")
def stock_residuals(spark: SparkSession, d: str) -> DataFrame:
    rest = routing.stock_residual(F.col("question"), F.col("name"))
    return views.asks(spark, d).select("query_id", rest.alias("residual"), (rest == "").alias("pure"))


@query(f"""with a as (select query_id, question, name, category from {NAMED}), t as (select category, count(*) as total, count(*) filter (stock > 0) as filled from ({PRODUCTS}) group by category),
    m as (select a.*, total, filled, p.stock, regexp_matches(question, '货|库存') as about, coalesce({RESIDUAL('a.category')} = '', false) as pure, contains(question, a.name) and {RESIDUAL('a.name')} = '' as alone
        from a left join t on t.category = a.category left join ({PRODUCTS}) p on p.id = a.query_id),
    k as (select *, case when about and pure then 'category' when about and alone and stock is not null then 'product' else 'none' end as kind from m)
    select query_id, kind, case kind when 'category' then category || '：' || filled || '/' || total when 'product' then case when stock > 0 then name || '有货，当前库存 ' || stock || ' 件。' else name || '暂时无货。' end end as answer from k""")
def stock_answers(spark: SparkSession, d: str) -> DataFrame:
    products = views.products(spark, d)
    return routing.stock_answers(views.asks(spark, d).select("query_id", "question", "product_id", "name"), products, routing.category_array(products))


LABEL = lambda c: f"rtrim(rtrim(printf('%.2f', {c} / 100), '0'), '.') || '元'"


PRICED = lambda token: f"trim(regexp_replace(replace(question, {token}, ''), '{routing.PRICE_FILLER}', '', 'g'))"


@query(f"""with a as (select query_id, question, name from {ASKED} where coalesce({INTENT}, '') = 'price'),
    c as (select category, min(price_cents) as low, max(price_cents) as high from ({PRODUCTS}) where price_cents is not null group by category),
    pure as (select query_id, arg_min(category, (-length(category), category)) as category from a join (select distinct category from ({PRODUCTS})) on contains(question, category) and {PRICED('category')} = '' group by query_id),
    m as (select a.query_id, low, high, case when {PRICED('a.name')} = '' then price_cents end as own from a left join pure using (query_id) left join c using (category) left join ({PRODUCTS}) p on p.id = a.query_id)
    select query_id, case when low is not null then 'category' when own is not null then 'product' else 'none' end as kind, coalesce({LABEL('low')} || '–' || {LABEL('high')}, {LABEL('own')}) as quote from m""")
def price_quotes(spark: SparkSession, d: str) -> DataFrame:
    products = views.products(spark, d)
    return routing.quotes(views.asks(spark, d).select("query_id", "question", "product_id", "name"), products, routing.category_array(products))


NORM = lambda x: f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]', '', 'g')"


@query(f"""with e as (select p_partkey as query_id, case p_partkey % 3 when 0 then substring(p_type, 1, 8) when 1 then p_type || ' X' else p_type || ' in very many other words' end as entity from part)
    select query_id, list_filter({CATEGORIES}, lambda c: contains({NORM('c')}, {NORM('entity')}) or (length({NORM('c')}) >= 3 and contains({NORM('entity')}, {NORM('c')}) and length({NORM('c')}) / length({NORM('entity')}) >= 0.6))[1] as category from e""")
def entity_matches(spark: SparkSession, d: str) -> DataFrame:
    """Entities that hold a category or are held by one."""
    t = F.col("p_type")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.when(F.col("p_partkey") % 3 == 0, F.substring(t, 1, 8)).when(F.col("p_partkey") % 3 == 1, F.concat(t, F.lit(" X"))).otherwise(F.concat(t, F.lit(" in very many other words"))).alias("entity"))
    return rows.select("query_id", routing.matched_category(F.col("entity"), routing.category_array(views.products(spark, d))).alias("category"))


SHARED = "list_max(list_transform(flatten(list_transform(range(1, length(b) + 1), lambda i: list_transform(range(1, length(b) - i + 2), lambda k: substring(b, i, k)))), lambda s: case when contains(a, s) then length(s) else 0 end))"


@query(f"""with p as (select n.n_nationkey as query_id, r.n_nationkey as product_id, n.n_name || ' ' || n.n_regionkey as a, r.n_name as b from nation n, nation r where n.n_nationkey <> r.n_nationkey)
    select query_id, product_id, shared from (select *, row_number() over (partition by query_id order by shared desc, product_id) as n from (select query_id, product_id, {SHARED} as shared from p) where shared >= 2) where n = 1""")
def longest_shared_names(spark: SparkSession, d: str) -> DataFrame:
    """Nations that have the longest piece of their names in common with another one's."""
    n = table(spark, d, "nation")
    asked = n.select(F.col("n_nationkey").alias("query_id"), F.concat_ws(" ", "n_name", F.col("n_regionkey").cast("string")).alias("question"))
    found = None
    for part in (0, 1):  # a name isn't held against itself
        of = routing.shared_pieces(asked.where(F.col("query_id") % 2 == part), n.where(F.col("n_nationkey") % 2 != part).select(F.col("n_nationkey").alias("product_id"), F.col("n_name").alias("name")))
        found = of if found is None else found.unionByName(of)
    return found


SQL["longest_shared_names"] = SQL["longest_shared_names"].replace("where n.n_nationkey <> r.n_nationkey", "where n.n_nationkey % 2 <> r.n_nationkey % 2")


@query("select doc_id, len(s) as sentences, md5(list_aggregate(list_filter(s, lambda x: not contains(x, ' the ')), 'string_agg', '|')) as kept_md5 from (select doc_id, regexp_extract_all(text, '[^.;!?\\n]+[.;!?]?') as s from documents)")
def kept_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences but for those with a word that rules them out."""
    s = F.regexp_extract_all("text", F.lit("[^.;!?\\n]+[.;!?]?"), F.lit(0))
    kept = F.filter("s", lambda x: ~F.contains(x, F.lit(" the ")))
    return table(spark, d, "documents").select("doc_id", s.alias("s")).select("doc_id", F.size("s").alias("sentences"), F.when(F.size(kept) > 0, F.md5(F.array_join(kept, "|"))).alias("kept_md5"))


ANSWERS = "(select p_partkey as query_id, p_name || '的价格是' || p_size || '元。' || ['证据未覆盖保修。', '无法提供价格。', '资料中没有说明！', '']  [p_partkey % 4 + 1] || case when p_partkey % 5 = 0 then '配料信息中不包含防腐剂。' else '' end as answer from part)"


@query(f"select query_id, trim(coalesce(list_aggregate(list_filter(regexp_extract_all(answer, '[^。；！？\\n]+[。；！？]?'), lambda s: not regexp_matches(s, '{routing.DISCLAIMER}')), 'string_agg', ''), '')) as kept from {ANSWERS}")
def substantive_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers without the sentences that only say what isn't covered."""
    tail = F.get(F.array(*map(F.lit, ["证据未覆盖保修。", "无法提供价格。", "资料中没有说明！", ""])), (F.col("p_partkey") % 4).cast("int"))
    answer = F.concat("p_name", F.lit("的价格是"), F.col("p_size").cast("string"), F.lit("元。"), tail, F.when(F.col("p_partkey") % 5 == 0, "配料信息中不包含防腐剂。").otherwise(""))
    return table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), routing.without_disclaimers(answer).alias("kept"))


@query(f"""with a as (select doc_id, {chunks('text')} as c, source from documents), r as (select doc_id as asset_id, list_concat(['问：' || source || ' 答：' || doc_id], c, ['lang：' || coalesce(source, ''), 'source：' || source]) as e from a)
    select asset_id, count(*) as n, md5(string_agg(chunk, '|' order by seq)) as chunks_md5 from (select asset_id, unnest(e) as chunk, unnest(range(0, len(e))) as seq from r) group by asset_id""")
def index_batch(spark: SparkSession, d: str) -> DataFrame:
    """The index rows of each asset in order, as one digest."""
    docs = views.assets(spark, d).withColumn("source", F.col("source_kind"))
    rows = docs.select("asset_id", "body", F.array(F.struct(F.col("source").alias("q"), F.col("asset_id").cast("string").alias("a"))).alias("pairs"), F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("source"), F.lit("empty"), F.lit(" ")).alias("fields"))
    found = assembly.index_rows(rows)
    return found.groupBy("asset_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda x: x["chunk"]), "|")).alias("chunks_md5"))


@query(f"select asset_id, md5({mask('title')}) as title_md5, md5({mask('body')}) as content_md5 from ({ASSETS}) join labels on doc_id = asset_id where quality = 1")
def export_published(spark: SparkSession, d: str) -> DataFrame:
    labels_ = table(spark, d, "labels").select(F.col("doc_id").alias("asset_id"), (F.col("quality") == 1).alias("published"))
    return assembly.exported(views.assets(spark, d).join(labels_, "asset_id")).select("asset_id", F.md5("title").alias("title_md5"), F.md5("content").alias("content_md5"))


@query(f"select doc_id as asset_id, 'export' as action, {NOW} as at from labels where quality = 1")
def export_audit(spark: SparkSession, d: str) -> DataFrame:
    return assembly.audit_rows(table(spark, d, "labels").where("quality = 1").withColumnRenamed("doc_id", "asset_id"), "export", AS_OF)


@query("select doc_id from documents where source in ('src0', 'src2')")
def allowed_sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(assembly.allowed(F.col("source"), " src0, ,src2 ")).select("doc_id")


@query("select event_type, count(*) filter (not list_contains(json_keys(props), 'k')) as without_k, count(*) filter (not list_contains(json_keys(props), 'z')) as without_z, count(*) filter (json_extract_string(props, '$.k') = '42') as of_42 from events group by event_type")
def key_tests(spark: SparkSession, d: str) -> DataFrame:
    """Rows without a key, and with a key and value."""
    m = F.from_json("props", "map<string,string>")
    return views.telemetry(spark, d).withColumn("m", m).groupBy("event_type").agg(F.count_if(~F.map_contains_key("m", "k")).alias("without_k"), F.count_if(~F.map_contains_key("m", "z")).alias("without_z"), F.count_if(F.try_element_at("m", F.lit("k")) == "42").alias("of_42"))


@query("select event_id, 'k=' || json_extract_string(props, '$.k') || ',seen=1' as with_key, 'seen=1' as without_k from events")
def keys_set(spark: SparkSession, d: str) -> DataFrame:
    m = fields.with_key(F.from_json("props", "map<string,string>"), "seen", F.lit("1"))
    shown = lambda x: F.array_join(F.array_sort(F.transform(F.map_entries(x), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return views.telemetry(spark, d).select("event_id", shown(m).alias("with_key"), shown(fields.without_keys(m, ["k"])).alias("without_k"))


@query("select source, count(*) filter (text like '%tion%') as likes, count(*) filter (regexp_matches(text, '(?i)^the')) as starts, count(*) filter (source = 'src1' and regexp_matches(text, '^[A-Z][a-z]+ ')) as probes from documents group by source")
def pattern_counts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").groupBy("source").agg(F.count_if(t.like("%tion%")).alias("likes"), F.count_if(t.rlike("(?i)^the")).alias("starts"), F.count_if((F.col("source") == "src1") & t.rlike("^[A-Z][a-z]+ ")).alias("probes"))


@query("""select c_custkey from customer c where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT' and o_totalprice > 300000) and not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '2-HIGH' and o_totalprice > 300000)
    and not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000) and not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P' and o_totalprice > 200000) and nullif(c_mktsegment, 'BUILDING') is null""")
def empty_customers(spark: SparkSession, d: str) -> DataFrame:
    """Four anti joins and a null test."""
    orders, out = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), table(spark, d, "customer").where("nullif(c_mktsegment, 'BUILDING') is null").select("c_custkey")
    for condition in ("o_orderpriority = '1-URGENT' and o_totalprice > 300000", "o_orderpriority = '2-HIGH' and o_totalprice > 300000", "o_totalprice > 400000", "o_orderstatus = 'P' and o_totalprice > 200000"):
        out = out.join(orders.where(condition), "c_custkey", "left_anti")
    return out


@query("select distinct l_orderkey, l_linenumber, o_orderdate from lineitem a join orders on o_orderkey = l_orderkey where l_returnflag = 'R' and not exists (select 1 from lineitem b where b.l_orderkey = a.l_orderkey and b.l_returnflag = 'A')")
def lone_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with their parent, where no other candidate of the same parent is taken."""
    lines = table(spark, d, "lineitem")
    taken = lines.where("l_returnflag = 'A'").select("l_orderkey")
    met = lines.where("l_returnflag = 'R'").join(taken, "l_orderkey", "left_anti").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return met.select("l_orderkey", "l_linenumber", "o_orderdate").distinct()


@query("""select query_id, product_id, line, name from (select l_orderkey as query_id, l_partkey as product_id, l_linenumber as line, p_name as name, row_number() over (partition by l_orderkey, l_partkey order by l_linenumber, l_suppkey) as n
    from lineitem join part on p_partkey = l_partkey where l_returnflag = 'A' and trim(p_name) <> '') where n = 1""")
def exact_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Queries with the products that are labelled as exact, the first label of a pair, no blank names."""
    met = table(spark, d, "lineitem").where("l_returnflag = 'A'").join(table(spark, d, "part").where("trim(p_name) <> ''"), F.col("l_partkey") == F.col("p_partkey"))
    rows = met.select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("product_id"), F.col("l_linenumber").alias("line"), F.col("p_name").alias("name"), F.struct("l_linenumber", "l_suppkey").alias("order"))
    return assembly.first_of(rows, ["query_id", "product_id"], "order").drop("order")


@query(f"select asset_id, md5(last_chunk) as last_md5 from ({ASSETS}) left join (select asset_id, arg_max(chunk, seq) as last_chunk from ({CHUNKS}) where contains(chunk, 'the') group by asset_id) using (asset_id)")
def last_matching_chunk(spark: SparkSession, d: str) -> DataFrame:
    """Each asset with the last of its chunks that has a word; null without one."""
    last = views.chunks(spark, d).where(F.contains("chunk", F.lit("the"))).groupBy("asset_id").agg(F.max_by("chunk", "seq").alias("last"))
    return views.assets(spark, d).select("asset_id").join(last, "asset_id", "left").select("asset_id", F.md5("last").alias("last_md5"))


@query("select user_id, string_agg(event_type, ',' order by pos) as kinds from (select user_id, event_type, min(event_id) as pos from events group by user_id, event_type) group by user_id")
def kinds_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Distinct citations in the order in which they first come."""
    return assembly.in_order_of_first(views.telemetry(spark, d), "user_id", "event_type", "event_id").select("user_id", F.array_join("values", ",").alias("kinds"))


@query("select l_orderkey, l_linenumber, last from lineitem join (select l_orderkey, max(l_linenumber) as last from lineitem group by l_orderkey) using (l_orderkey) where l_linenumber <> last")
def stale_expectations(spark: SparkSession, d: str) -> DataFrame:
    """Expected versions that aren't the current ones."""
    lines = table(spark, d, "lineitem")
    return lines.join(lines.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("last")), "l_orderkey").where("l_linenumber <> last").select("l_orderkey", "l_linenumber", "last")


@query("select o_orderkey, coalesce(n, 0) as candidates, coalesce(pending, 0) as pending from orders left join (select l_orderkey, count(*) as n, count(*) filter (l_returnflag = 'N') as pending from lineitem group by 1) on l_orderkey = o_orderkey")
def candidate_counts(spark: SparkSession, d: str) -> DataFrame:
    of = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("candidates"), F.count_if(F.col("l_returnflag") == "N").alias("pending"))
    return table(spark, d, "orders").select("o_orderkey").join(of, "o_orderkey", "left").na.fill(0)


@query(" union all ".join(f"select '{n}' as name, count(*) as n from {t} where {c}" for n, t, c in (
    ("urgent orders", "orders", "o_orderpriority = '1-URGENT'"), ("open orders", "orders", "o_orderstatus = 'O'"), ("returned lines", "lineitem", "l_returnflag = 'R'"), ("large parts", "part", "p_size > 40"), ("errors", "events", "event_type = 'error'"),
    ("toxic", "labels", "toxic = 1"), ("poor", "labels", "quality = 0"), ("long texts", "documents", "n_chars > 5000"), ("customers", "customer", "c_acctbal < 0"), ("suppliers", "supplier", "s_acctbal < 0"), ("users", "conversations", "role = 'user'"), ("agents", "conversations", "role = 'assistant'"))))
def cleanup_counts(spark: SparkSession, d: str) -> DataFrame:
    """Twelve counts in one report."""
    t, e = lambda n: table(spark, d, n), F.expr
    return assembly.counts_report({
        "urgent orders": (t("orders"), e("o_orderpriority = '1-URGENT'")), "open orders": (t("orders"), e("o_orderstatus = 'O'")), "returned lines": (t("lineitem"), e("l_returnflag = 'R'")), "large parts": (t("part"), e("p_size > 40")),
        "errors": (t("events"), e("event_type = 'error'")), "toxic": (t("labels"), e("toxic = 1")), "poor": (t("labels"), e("quality = 0")), "long texts": (t("documents"), e("n_chars > 5000")), "customers": (t("customer"), e("c_acctbal < 0")),
        "suppliers": (t("supplier"), e("s_acctbal < 0")), "users": (t("conversations"), e("role = 'user'")), "agents": (t("conversations"), e("role = 'assistant'")),
    })


@query(f"""select 'blank title' as "check", asset_id as ref, 'fix' as action from ({ASSETS}) where trim(title) = '' union all select 'short', doc_id, 'retire' from documents where n_chars < 20 union all select 'toxic', doc_id, 'retire' from labels where toxic = 1
    union all select 'repeated', doc_id, 'retire' from (select doc_id, min(doc_id) over (partition by md5(text)) as first from documents where text is not null) where doc_id > first union all select 'unjudged', doc_id, 'keep' from documents where doc_id not in (select doc_id from labels)""")
def health_audit(spark: SparkSession, d: str) -> DataFrame:
    """Findings of all checks with the action that each asks for."""
    docs, judged = table(spark, d, "documents"), table(spark, d, "labels")
    least = docs.where("text is not null").groupBy(F.md5("text").alias("m")).agg(F.min("doc_id").alias("first"))
    repeated = docs.withColumn("m", F.md5("text")).join(least, "m")
    ref = lambda df: df.withColumn("ref", F.col("doc_id"))
    return assembly.findings({
        "blank title": (views.assets(spark, d).withColumn("ref", F.col("asset_id")), F.trim("title") == "", "fix"), "short": (ref(docs), F.col("n_chars") < 20, "retire"), "toxic": (ref(judged), F.col("toxic") == 1, "retire"),
        "repeated": (ref(repeated), F.col("doc_id") > F.col("first"), "retire"), "unjudged": (ref(docs.join(judged, "doc_id", "left_anti")), F.lit(True), "keep"),
    })


SQL["health_actions"] = f"select ref, case min(case action when 'retire' then 0 when 'fix' then 1 else 2 end) when 0 then 'retire' when 1 then 'fix' else 'keep' end as action from ({SQL['health_audit']}) group by ref"


@query(None)
def health_actions(spark: SparkSession, d: str) -> DataFrame:
    """The strongest action of each object."""
    found = health_audit(spark, d).select(F.lit(0).alias("at"), "ref", "action", F.col("check").alias("reason"))
    return governance.merged_actions(found).select("ref", "action")


@query(f"select session_id, row_number() over (order by pending > 0 desc, n_messages = 0, session_id desc) as place from (select session_id, count(*) as n_messages, count(*) filter (role = 'customer' and content like '%?%') as pending from ({MESSAGES}) group by session_id)")
def sessions_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with open tickets first, empty ones last, newest first."""
    of = views.messages(spark, d).groupBy("session_id").agg(F.count("*").alias("n_messages"), F.count_if((F.col("role") == "customer") & F.col("content").like("%?%")).alias("pending"))
    # one number that falls with the id inside of its class
    lead = F.when(F.col("pending") > 0, 0.0).when(F.col("n_messages") > 0, 1.0).otherwise(2.0) * 1e15 - F.col("session_id")
    return numbering.numbered(of, lead, F.desc("session_id")).select("session_id", "place")


@query(f"""with ledger as (select vec_id as doc_id from embeddings where label <> 0 and len(embedding) = 64), due as (select distinct doc_id from documents where doc_id not in (select doc_id from ledger)),
    placed as (select doc_id, row_number() over (order by doc_id) - 1 as n from due) select doc_id, n // 64 as batch, (n % 64)::int as slot from placed""")
def embedding_batches(spark: SparkSession, d: str) -> DataFrame:
    """Documents that want a vector; those of one label have one component too few, and are due again."""
    held = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.when(F.col("label") == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")).alias("embedding"))
    return numbering.embedding_batches(table(spark, d, "documents"), held, "doc_id", dimensions=64)


@query("""with stay as (select distinct o_custkey as k from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'O'),
    c as (select c_custkey as k from customer where c_acctbal < 0 and c_custkey not in (select k from stay)),
    o as (select o_orderkey as k from orders where o_custkey in (select k from c) or o_totalprice < 1000),
    l as (select l_orderkey, l_linenumber from lineitem where l_orderkey in (select k from o) or l_quantity < 2),
    r as (select 0 as place, 'lines' as name, (select count(*) from lineitem) as n, (select count(*) from lineitem where (l_orderkey, l_linenumber) in (select (l_orderkey, l_linenumber) from l)) as removed union all select 1, 'orders', (select count(*) from orders), (select count(*) from o) union all select 2, 'customers', (select count(*) from customer), (select count(*) from c))
    select place, name, n as before, removed, n - removed as after, 0::bigint as orphans from r""")
def cleanup_applied(spark: SparkSession, d: str) -> DataFrame:
    """Customers in debt without an urgent open order go, their orders with them, and the lines of these; small orders and lines go by themselves. Lines that share order and number go together."""
    orders, line = table(spark, d, "orders"), F.struct("l_orderkey", "l_linenumber")
    tables = {"customers": (table(spark, d, "customer"), "c_custkey"), "orders": (orders, "o_orderkey"), "lines": (table(spark, d, "lineitem").withColumn("line", line), "line")}
    roots = {"customers": F.col("c_acctbal") < 0, "orders": F.col("o_totalprice") < 1000, "lines": F.col("l_quantity") < 2}
    links = [cleanup.Link("lines", "l_orderkey", "orders"), cleanup.Link("orders", "o_custkey", "customers")]
    kept = {"customers": orders.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'O'").select("o_custkey").distinct()}
    return cleanup.cleanup_report(tables, links, cleanup.removals(tables, roots, links, kept))


@query("select event_id, user_id from events where event_type = 'error' order by event_id desc limit 200")
def recent_audit(spark: SparkSession, d: str) -> DataFrame:
    """The newest 200 rows of one action: filtered first, then limited."""
    return views.telemetry(spark, d).where("event_type = 'error'").orderBy(F.desc("event_id")).limit(200).select("event_id", "user_id")


@query("""select user_id, event_id, row_number() over (partition by user_id order by event_id) as place from (select user_id, event_id, row_number() over (partition by user_id order by value desc, event_id) as n from events where value >= 6) where n <= 8""")
def frame_candidates(spark: SparkSession, d: str) -> DataFrame:
    return assembly.best_in_time(views.telemetry(spark, d), "user_id", "value", "event_id", 6.0, 8).select("user_id", "event_id", "place")


@query("select kind, asset_id, id from (select *, row_number() over (partition by kind order by id) as n from (select event_type as kind, user_id as asset_id, event_id as id, row_number() over (partition by event_type, user_id order by event_id) as of from events) where of <= 2) where n <= case kind when 'click' then 80 when 'view' then 50 when 'error' then 30 when 'signup' then 40 else 0 end")
def golden_cases(spark: SparkSession, d: str) -> DataFrame:
    rows = views.telemetry(spark, d).select(F.col("event_type").alias("kind"), F.col("user_id").alias("asset_id"), F.col("event_id").alias("id"))
    return assembly.golden_set(rows, 200, {"click": 40, "view": 25, "error": 15, "signup": 20})


@query("select doc_id from documents order by md5('7:' || doc_id) limit 100")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return assembly.sample(table(spark, d, "documents").select("doc_id"), "doc_id", 100, 7)


@query("select p_partkey, list_filter([case when length(trim(p_name)) > 8 then 'name length' end, case when p_retailprice < 1000 then 'price' end, case when p_brand = 'Brand#11' then 'currency' end], lambda x: x is not null)::varchar as faults from part")
def product_faults(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with each product row."""
    name = F.when(F.length(F.trim("p_name")) > 8, F.repeat(F.lit("x"), F.lit(201))).otherwise(F.col("p_name"))
    found = assembly.row_faults(name, F.col("p_type"), F.col("p_retailprice") - 1000, F.when(F.col("p_brand") == "Brand#11", "¥").otherwise("cny"))
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("["), F.array_join(found, ", "), F.lit("]")).alias("faults"))


@query("select event_id, case when event_id % 3 = 2 then null else event_type end as verdict, case when event_id % 3 = 2 then null else cast(floor(value) as int) end as score from events")
def fenced_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores from JSON answers, in a code fence, alone or broken."""
    body = F.to_json(F.struct(F.col("event_type").alias("verdict"), F.floor("value").cast("int").alias("score")))
    answer = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```\n"))).when(F.col("event_id") % 3 == 1, body).otherwise(F.lit("no json"))
    return views.telemetry(spark, d).select("event_id", assembly.parsed_scores(answer, "verdict string, score int").alias("a")).select("event_id", "a.verdict", "a.score")


@query("select user_id, block, 'e' || min(event_id) as event, string_agg(event_type, chr(10) order by event_id) as data from (select user_id, event_id, event_type, (row_number() over (partition by user_id order by event_id) - 1) // 3 as block from events) group by user_id, block")
def server_events(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a stream put together at blank lines."""
    nth = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1
    rows = views.telemetry(spark, d).withColumn("nth", nth)
    first, last = F.col("nth") % 3 == 0, F.col("nth") % 3 == 2
    lines = F.array_compact(F.array(F.when(first, F.concat(F.lit("event: e"), F.col("event_id").cast("string"))), F.concat(F.lit("data: "), F.col("event_type")), F.when(last, F.lit(""))))
    made = rows.select("user_id", F.col("event_id"), F.posexplode(lines).alias("p", "line")).withColumn("at", F.col("event_id") * 10 + F.col("p"))
    return assembly.event_blocks(made, "user_id", "at")


@query("select user_id, row_number() over (partition by user_id order by s, e, txt) as place, s as start, e as \"end\" from (select user_id, event_type as txt, least(event_id::double, value) + 100 as s, greatest(event_id::double, value) + 100 as e from events where event_type <> 'error')")
def speech_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = views.telemetry(spark, d).select("user_id", F.col("event_id").cast("double").alias("start"), F.col("value").alias("end"), F.lit(100).alias("offset"), F.when(F.col("event_type") != "error", F.col("event_type")).otherwise(" ").alias("text"))
    return assembly.merged_chunks(rows, "user_id").select("user_id", "place", "start", "end")


# what the library has had without a query


@query("select ref, case min(p) when 0 then 'retire' when 1 then 'fix' else 'keep' end as action from (select user_id as ref, case event_type when 'error' then 0 when 'purchase' then 1 else 2 end as p from events) group by ref")
def merged_actions(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "retire").when(F.col("event_type") == "purchase", "fix").otherwise("keep")
    return governance.merged_actions(views.telemetry(spark, d).select(F.col("event_id").alias("at"), F.col("user_id").alias("ref"), kind.alias("action"), F.col("event_type").alias("reason"))).select("ref", "action")


@query("select case when c_custkey is null then 'missing' when c_acctbal < 0 then 'already' else 'to_retire' end as verdict, count(*) as n from (select distinct o_custkey * 2 as k from orders) left join customer on c_custkey = k group by 1")
def retire_plan(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "orders").select((F.col("o_custkey") * 2).alias("asset_id")).distinct()
    held = table(spark, d, "customer").select(F.col("c_custkey").alias("asset_id"), F.when(F.col("c_acctbal") < 0, F.lit(AS_OF)).alias("discarded_at"))
    return governance.retire_plan(asked, held).groupBy("verdict").agg(F.count("*").alias("n"))


@query("select source as kind, count(quality) as judged, count(*) filter (quality = 1) as supported, count(*) filter (quality = 0) as failed, round(count(*) filter (quality = 1) / nullif(count(quality), 0), 6) as rate from documents left join labels using (doc_id) group by source")
def judge_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select(F.col("source").alias("kind"), (F.col("quality") == 1).alias("supported"))
    return governance.judge_summary(rows, ["kind"]).withColumn("rate", F.round("rate", 6))


@query("select case when not a and b then 'gained' when a and not b then 'lost' else 'kept' end as change, count(*) as n from (select quality = 1 as a, toxic = 1 as b from labels) group by 1")
def level_changes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels")
    return governance.level_changes(rows.select("doc_id", (F.col("quality") == 1).alias("hit")), rows.select("doc_id", (F.col("toxic") == 1).alias("hit")), "doc_id")


@query("select event_type as model, 'prompt' as direction, sum(user_id)::bigint as tokens from events where event_id % 4 <> 0 group by 1 union all select event_type, 'completion', sum(event_id)::bigint from events where event_id % 4 <> 0 group by 1")
def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    calls = views.telemetry(spark, d).select(F.col("event_type").alias("model"), F.col("user_id").alias("prompt_tokens"), F.when(F.col("event_id") % 4 != 0, F.col("event_id")).alias("completion_tokens"))
    return governance.usage_totals(calls)


VERSIONS = "(select l_orderkey as asset_id, l_linenumber as version_no, max(l_orderkey * 10 + l_linenumber) as version_id, bool_or(l_linestatus = 'F') as published from lineitem group by 1, 2)"
POINTED = "(select o_orderkey as asset_id, o_orderkey * 10 + 1 as current_version_id, case when o_orderstatus = 'F' then 'published' else 'ingested' end as status from orders)"


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as assets that point to their first line, lines as versions."""
    versions = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("asset_id"), F.col("l_linenumber").alias("version_no")).agg((F.max(F.col("l_orderkey") * 10 + F.col("l_linenumber"))).alias("version_id"), F.max(F.when(F.col("l_linestatus") == "F", F.lit(AS_OF))).alias("published_at"))
    assets = table(spark, d, "orders").select(F.col("o_orderkey").alias("asset_id"), (F.col("o_orderkey") * 10 + 1).alias("current_version_id"), F.when(F.col("o_orderstatus") == "F", "published").otherwise("ingested").alias("status"), F.lit(None).cast("string").alias("discarded_at"))
    return versions, assets


@query(f"select v.asset_id, v.version_no from {VERSIONS} v join {POINTED} a on a.asset_id = v.asset_id and a.current_version_id = v.version_id where status = 'published'")
def published_view(spark: SparkSession, d: str) -> DataFrame:
    versions, assets = _versions(spark, d)
    return governance.published_view(versions.select("asset_id", "version_no"), versions, assets)


@query(f"select asset_id, coalesce(max(case when version_id = current_version_id then version_no end), min(version_no)) as version_no from {VERSIONS} join {POINTED} using (asset_id) group by asset_id")
def current_version(spark: SparkSession, d: str) -> DataFrame:
    versions, assets = _versions(spark, d)
    return governance.current_version(assets, versions)


@query(f"select v.asset_id, v.version_id as current_version_id from {VERSIONS} v join {POINTED} a on a.asset_id = v.asset_id where v.version_no = 2 and v.published and v.version_id <> a.current_version_id and v.asset_id not in (select asset_id from {VERSIONS} where not published)")
def rolled_back(spark: SparkSession, d: str) -> DataFrame:
    versions, assets = _versions(spark, d)
    return governance.rolled_back(versions, assets, versions.where("version_no = 2").select("asset_id", "version_no")).select("asset_id", "current_version_id")


@query(f"select a.asset_id, v.version_no, v.version_id is not null and a.asset_id in (select asset_id from {VERSIONS} where not published) as revising from {POINTED} a left join {VERSIONS} v on v.version_id = a.current_version_id")
def asset_list(spark: SparkSession, d: str) -> DataFrame:
    versions, assets = _versions(spark, d)
    known = assets.join(versions.select(F.col("version_id").alias("current_version_id"), F.lit(True).alias("_known")), "current_version_id", "left").withColumn("current_version_id", F.when(F.col("_known"), F.col("current_version_id"))).drop("_known")
    rows = known.withColumn("title", F.lit("t")).withColumn("product_id", F.lit(1))
    return governance.asset_list(rows, versions, views.products(spark, d).select(F.col("id").alias("product_id"), "name")).select("asset_id", "version_no", "revising")


@query(f"select asset_id, string_agg(version_no || ':' || published, ',' order by version_no) as versions from {VERSIONS} group by asset_id")
def asset_detail(spark: SparkSession, d: str) -> DataFrame:
    versions, assets = _versions(spark, d)
    found = governance.asset_detail(assets, versions)
    return found.select("asset_id", F.array_join(F.transform("versions", lambda v: F.concat_ws(":", v["version_no"].cast("string"), v["published"].cast("string"))), ",").alias("versions"))


@query(f"select session_id, 'H-' || lpad(min(id)::varchar, greatest(4, length(min(id)::varchar))::int, '0') as ticket, md5(arg_min(content, id)) as message_md5 from ({MESSAGES}) where role = 'customer' group by session_id")
def one_ticket(spark: SparkSession, d: str) -> DataFrame:
    rows = views.messages(spark, d).where("role = 'customer'").select("session_id", "id", F.col("content").alias("message"), F.lit(None).cast("string").alias("contact"))
    return sessions.one_ticket(rows).select("session_id", "ticket", F.md5("message").alias("message_md5"))


@query("select user_id, event_id, (row_number() over (partition by user_id order by event_id) - 1) // 7 as batch from events")
def batches(spark: SparkSession, d: str) -> DataFrame:
    return governance.batches(views.telemetry(spark, d), "user_id", "event_id", 7).select("user_id", "event_id", "batch")


@query("select event_type as question, greatest(count(*) filter (user_id % 2 = 0), count(*) filter (user_id % 2 = 1)) as n from events group by event_type")
def larger_pool(spark: SparkSession, d: str) -> DataFrame:
    pool = lambda r: views.telemetry(spark, d).where(f"user_id % 2 = {r}").groupBy(F.col("event_type").alias("question")).agg(F.count("*").alias("n"))
    return sessions.larger_pool(pool(0), pool(1))


@query("select doc_id, '[' || array_to_string(first, ', ') || ']' as first from (select doc_id, [substring(text, i * 12 + 1, 12) for i in range(0, least(3, (length(text) + 11) // 12))] as first from (select doc_id, substring(text, 1, 30) as text from documents where text <> '' and not regexp_matches(text, '[,\\n'']')))".replace("[,\\n'']", "[,\\n''\"\\[\\]{}()]"))
def text_pieces(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where((F.col("text") != "") & ~F.col("text").rlike("[,\\n'\"\\[\\]{}()]"))
    return docs.select("doc_id", F.concat(F.lit("["), F.array_join(extract.pieces(F.substring("text", 1, 30)), ", "), F.lit("]")).alias("first"))


LEX = lexical(CHUNKS, "asset_id, seq", "chunk")
CUT = f"select query_id, rank, asset_id, md5(substring(chunk, 1, 80)) as cut_md5 from ({top(LEX, 3, 'score', 'asset_id, seq')}) join ({CHUNKS}) using (asset_id, seq)"


@query(CUT)
def evidence_anchors(spark: SparkSession, d: str) -> DataFrame:
    """The three best chunks of each question, cut to 80 characters."""
    key, chunks_ = ["asset_id", "seq"], views.chunks(spark, d)
    best = topk.lexical_top_k(views.questions(spark, d), chunks_, key, 3)
    return chunks_.select(*key, "chunk").join(F.broadcast(best) if views.questions(spark, d).count() * 3 <= retrieval.BROADCAST_ROWS else best, key).select("query_id", "rank", "asset_id", F.md5(F.substring("chunk", 1, 80)).alias("cut_md5"))


@query(f"select item_id as query_id, item_id in (select query_id from ({LEX}) where overlap >= 8) as resolved from benchmark")
def gaps_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Gaps that the published chunks can answer."""
    met = retrieval.best_overlaps(views.questions(spark, d), views.chunks(spark, d), 8).where("hits > 0").select("query_id", F.lit(True).alias("_met"))
    return views.questions(spark, d).select("query_id").join(met, "query_id", "left").select("query_id", F.col("_met").isNotNull().alias("resolved"))


SQL["out_of_vocabulary"] = f"""with q as (select query_id, name, unnest({terms('question')}) as term from {ASKED}), corpus as (select distinct unnest({terms('chunk')}) as term from ({CHUNKS}))
    select query_id, case count(*) filter (term not in (select term from corpus)) when 0 then 'in' when count(*) then 'full' else 'partial' end as state from q group by query_id"""


@query(None)
def out_of_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """full, partial or in: how many of a question's terms no chunk has."""
    found = retrieval.unknown_terms(views.asks(spark, d).select("query_id", "question"), views.chunks(spark, d), views.assets(spark, d).select("body")).where("n_terms > 0")
    return found.select("query_id", F.when(F.col("unknown") == 0, "in").when(F.col("unknown") == F.col("n_terms"), "full").otherwise("partial").alias("state"))



SWEPT = f"""lex as (select query_id, asset_id, score from ({LEX_ASSETS})), aff as ({AFFINITY}),
    dense as (select query_id, asset_id, cos from (select *, row_number() over (partition by query_id order by cos desc, asset_id) as n from (select q.vec_id as query_id, v.vec_id as asset_id, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) as cos
        from embeddings q join benchmark on item_id = q.vec_id, embeddings v) where cos >= 0.3) where n <= 10),
    hits as (select * from (select coalesce(l.query_id, d.query_id) as query_id, coalesce(l.asset_id, d.asset_id) as asset_id, score, cos from lex l full join dense d on l.query_id = d.query_id and l.asset_id = d.asset_id) left join aff using (query_id, asset_id)),
    conf as (select * from (values ('L1', 0.0::double, null::double), ('L2', 3.0::double, null), ('L3', 3.0::double, 0.5::double)) v (configuration, alpha, dense)),
    weighed as (select *, round(score * (1 + alpha * coalesce(affinity, 0)), 9) as w from hits, conf where dense is not null or score is not null),
    ranges as (select *, min(w) over (partition by configuration, query_id) as low, max(w) over (partition by configuration, query_id) as high from weighed),
    finals as (select *, case when dense is null then w else round(case when w is null then 0 when high = low then 1 else (w - low) / (high - low) end + dense * coalesce(cos, 0), 9) end as final from ranges where high is not null),
    ranked as (select * from (select *, row_number() over (partition by configuration, query_id order by final desc, asset_id) as rank from finals) where rank <= 3)"""


@query(f"""with {SWEPT}, expected as (select item_id as query_id, min(doc_id) as expected from benchmark b join documents d on contains(d.text, b.text) group by item_id),
    cases as (select item_id as query_id, expected, case when expected is null then 'open' else 'answerable' end as case_group, configuration from benchmark left join expected on item_id = query_id, conf),
    judged as (select c.query_id, c.case_group, c.configuration, min(r.rank) as rank from cases c left join ranked r on r.query_id = c.query_id and r.asset_id = c.expected and r.configuration = c.configuration group by 1, 2, 3)
    select configuration, {METRICS.format(g='case_group')} from judged group by configuration, case_group union all select configuration, {METRICS.format(g="'overall'")} from judged group by configuration""")
def ablation_levels(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the three levels from one set of hits; a question's vector is the one of its number."""
    asked, assets = views.questions(spark, d), views.assets(spark, d)
    return sweep.sweep_metrics(_cases(asked, assets), _swept(spark, d), sweep.LEVELS)


@query(f"""with {SWEPT}, old as (select query_id, asset_id, rank as from_rank from ranked where configuration = 'L1'), new as (select query_id, asset_id, rank as to_rank from ranked where configuration = 'L3' and rank = 1)
    select query_id, from_rank, to_rank, asset_id from new left join old using (query_id, asset_id) where from_rank is null or from_rank > 1""")
def ablation_changes(spark: SparkSession, d: str) -> DataFrame:
    """Which best hits the third level has that the first hasn't."""
    return sweep.changes(_swept(spark, d), "L1", "L3")


def _swept(spark: SparkSession, d: str) -> DataFrame:
    asked, assets, vectors = views.questions(spark, d), views.assets(spark, d), table(spark, d, "embeddings")
    of_question = vectors.join(F.broadcast(asked.select(F.col("query_id").alias("vec_id"))), "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    dense = _stored(retrieval.nearest(of_question, vectors, 10, 0.3).select("query_id", F.col("vec_id").alias("asset_id"), "cos"))
    # a question's results come from its best hits, the ends of its scores and its dense hits; all hits of their assets are looked at, no others
    few = retrieval.extreme_assets(asked, assets, sweep.SPARE, tuple(sorted({c.alpha for c in sweep.LEVELS})))
    if few is not None:
        few = _stored(few.unionByName(dense.select("asset_id")).distinct())
    bodies = assets if few is None else assets.join(F.broadcast(few), "asset_id", "left_semi")
    lexical = retrieval.lexical_scores(asked, bodies.select("asset_id", F.col("body").alias("chunk")), ["asset_id"])
    return sweep.swept(lexical, retrieval.title_affinity(asked, assets, few), dense, sweep.LEVELS, "asset_id")


def _cases(asked: DataFrame, assets: DataFrame) -> DataFrame:
    """Assets that hold a question's whole text are expected; only those that share all its terms are searched for it."""
    expected = retrieval.expected_assets(asked, assets)
    return asked.select("query_id").join(expected, "query_id", "left").withColumn("case_group", F.when(F.col("expected").isNull(), "open").otherwise("answerable"))


OOV_RUNS = "[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+"
STOPPED = lambda x: f"regexp_matches({x}, '[{text.STOP_CHARS}]')"


@query(f"""with asked as (select query_id, regexp_replace(question, '{retrieval.OPINION_WORDS}', ' ', 'g') as s from (select query_id, question from {ASKED} union all select -item_id, text from benchmark)),
    numbered as (select query_id, unnest(regexp_extract_all(s, '{OOV_RUNS}')) as run, unnest(range(len(regexp_extract_all(s, '{OOV_RUNS}')))) as k from asked),
    runs as (select *, (sum(length(run)) over (partition by query_id order by k) - length(run))::bigint as first from numbered),
    letters as (select query_id, k, first + i as pos, substring(run, i + 1, 1) as c from (select *, unnest(range(length(run))) as i from runs where not regexp_matches(run, '^[A-Za-z0-9]')) where regexp_matches(substring(run, i + 1, 1), '[\\p{{L}}\\p{{N}}]')),
    pairs as (select *, lead(c) over w as c2, lead(pos) over w as pos2, count(*) over (partition by query_id, k) as n from letters window w as (partition by query_id, k order by pos)),
    spans as (select query_id, lower(run) as term, first as start, length(run) as len from runs where regexp_matches(run, '^[A-Za-z0-9]')
        union all select query_id, c, pos, 1 from pairs where n = 1 and not {STOPPED('c')}
        union all select query_id, c || c2, pos, pos2 - pos + 1 from pairs where c2 is not null and not {STOPPED('c || c2')}),
    field as (select distinct unnest({terms("regexp_split_to_array(chunk, '[：:]')[1]")}) as term from ({CHUNKS}) where regexp_matches(chunk, '{_q(text.FIELD_LINE)}')),
    entity as (select * from spans where term not in (select term from field)),
    corpus as (select distinct unnest({terms('chunk')}) as term from ({CHUNKS})), titles as (select distinct unnest({terms('title')}) as term from ({ASSETS})),
    positions as (select distinct query_id, unnest(range(start, start + len)) as pos from entity where term not in (select term from corpus) and query_id not in (select query_id from entity where term in (select term from titles)) and (select count(*) from ({CHUNKS})) >= 100),
    islands as (select query_id, min(pos) as start, count(*) as len from (select *, pos - row_number() over (partition by query_id order by pos) as island from positions) group by query_id, island),
    best as (select * from islands where len >= 4 qualify row_number() over (partition by query_id order by len desc, start) = 1)
    select query_id, substring(s, start + 1, len) as entity, start::int as start from best join asked using (query_id)""")
def oov_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """What questions about products and those of the benchmark name that no chunk has."""
    asked = views.asks(spark, d).select("query_id", "question").unionByName(views.questions(spark, d).select((-F.col("query_id")).alias("query_id"), "question"))
    return vocabulary.oov_verdicts(asked, views.assets(spark, d), views.chunks(spark, d), texts=views.assets(spark, d).select("body"))


@query(f"select query_id, category as longest, named from {NAMED}")
def named_categories(spark: SparkSession, d: str) -> DataFrame:
    """What a question names: the longest category, and how many."""
    categories = routing.category_array(views.products(spark, d))
    return views.asks(spark, d).select("query_id", F.get(routing.named_categories(F.col("question"), categories), F.lit(0)).alias("longest"), F.size(F.filter(categories, lambda c: F.contains("question", c))).alias("named"))


@query(f"select name, min(source) as source from (select {strip('title')} as name, 0 as source from ({ASSETS}) where {strip('title')} <> '' union all select distinct p_type, 1 from part union all select {strip('p_name')}, 2 from part) group by name")
def nameable(spark: SparkSession, d: str) -> DataFrame:
    """Titles, categories and names that a question can name, each with its first source."""
    titles = views.assets(spark, d).select(text.stripped(F.col("title")).alias("name")).where("name <> ''").withColumn("source", F.lit(0))
    part = table(spark, d, "part")
    every = titles.unionByName(part.select(F.col("p_type").alias("name"), F.lit(1).alias("source"))).unionByName(part.select(text.stripped(F.col("p_name")).alias("name"), F.lit(2).alias("source")))
    return every.groupBy("name").agg(F.min("source").alias("source"))


@query(f"""with c as (select asset_id, seq, chunk, row_number() over (partition by asset_id order by seq) as rank from ({CHUNKS}))
    select asset_id as query_id, md5(string_agg('[A-' || asset_id || '·v1] t：' || trim(regexp_replace(regexp_replace({mask('chunk')}, '[「」\\[\\]【】]', '', 'g'), '\\s+', ' ', 'g')), chr(10) order by rank)) as evidence_md5 from c where rank <= 3 group by asset_id""")
def evidence_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = views.chunks(spark, d).withColumn("rank", F.row_number().over(W.partitionBy("asset_id").orderBy("seq"))).where("rank <= 3")
    found = governance.evidence_lines(rows.withColumn("query_id", F.col("asset_id")).withColumn("title", F.lit("t")))
    return found.select("query_id", F.md5("evidence").alias("evidence_md5"))


@query(f"""with m as (select *, case when role = 'agent' and id % 3 = 0 then 'refusal' end as kind from ({MESSAGES})),
    w as (select *, last_value(case when role = 'customer' then id end ignore nulls) over b as asked, last_value(case when role = 'agent' then id end ignore nulls) over b as answered from m window b as (partition by session_id order by id rows between unbounded preceding and 1 preceding)),
    gone as (select id from w where kind = 'refusal' union select asked from w where kind = 'refusal' and (answered is null or asked > answered)),
    k as (select *, id not in (select id from gone where id is not null) as kept from m), a as (select *, max(kept::int) over (partition by session_id) as any_kept from k)
    select id, session_id from a where kept or (any_kept = 0 and role = 'customer')""")
def backflow_kept(spark: SparkSession, d: str) -> DataFrame:
    """Messages without every third answer as a refusal, and what it answers."""
    rows = views.messages(spark, d).withColumn("kind", F.when((F.col("role") == "agent") & (F.col("id") % 3 == 0), "refusal"))
    return sessions.kept_for_backflow(rows).select("id", "session_id")


@query("select user_id as session_id, arg_max(json_extract_string(props, '$.k'), event_id) as subject from events where event_type in ('view', 'click') and json_extract_string(props, '$.k') <> '' group by user_id")
def last_tool_subject(spark: SparkSession, d: str) -> DataFrame:
    tool = F.struct(F.col("event_type").alias("name"), F.get_json_object("props", "$.k").alias("arg"))
    return sessions.last_tool_subject(views.telemetry(spark, d).select(F.col("user_id").alias("session_id"), F.col("event_id").alias("id"), tool.alias("tool")), ("view", "click"))


@query("select p_partkey as asset_id, case when p_partkey not in (select l_partkey from lineitem join orders on o_orderkey = l_orderkey where o_orderpriority = '1-URGENT' and o_totalprice > 350000) then timestamp '2024-01-01 00:00:00' end as verified_at from part")
def triaged(spark: SparkSession, d: str) -> DataFrame:
    cites = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_partkey").alias("asset_id"))).alias("citations"))
    votes = table(spark, d, "orders").join(cites, F.col("o_orderkey") == F.col("l_orderkey")).select((~((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 350000))).alias("helpful"), "citations")
    return governance.triaged(table(spark, d, "part").select(F.col("p_partkey").alias("asset_id"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("verified_at")), votes)


FIELDS = {"a": ("p_brand", 2), "b": ("p_type", 3), "c": ("p_name", 5)}


def _field_maps(spark: SparkSession, d: str) -> DataFrame:
    """Parts with a schema of three fields, of which the second isn't required; some are confirmed, some only extracted, some neither."""
    value = lambda c, n, rest: F.when(F.col("p_partkey") % n == rest, F.col(c))
    schema = F.create_map(*[x for k in FIELDS for x in (F.lit(k), F.struct(F.lit(k != "b").alias("required")))])
    confirmed = F.create_map(*[x for k, (c, n) in FIELDS.items() for x in (F.lit(k), F.struct(value(c, n, 0).alias("value")))])
    extracted = F.create_map(*[x for k, (c, n) in FIELDS.items() for x in (F.lit(k), F.struct(value(c, n, 1).alias("value"), (F.col("p_partkey") % 7 == 0).alias("abstained")))])
    return table(spark, d, "part").select("p_partkey", schema.alias("schema"), confirmed.alias("confirmed"), extracted.alias("extracted"))


@query("select p_partkey, " + ", ".join(f"coalesce(case when p_partkey % {n} = 0 then {c} end, case when p_partkey % {n} = 1 and p_partkey % 7 <> 0 then {c} end) as {k}" for k, (c, n) in FIELDS.items()) + " from part")
def resolved_values(spark: SparkSession, d: str) -> DataFrame:
    """Confirmed values before extracted ones that nobody abstained from."""
    return _field_maps(spark, d).select("p_partkey", *[fields.resolved_value(F.col("extracted"), F.col("confirmed"), F.lit(k)).alias(k) for k in FIELDS])


@query("""with f as (select p_partkey, p_partkey % 2 = 0 as ca, p_partkey % 2 = 1 and p_partkey % 7 <> 0 as ea, p_partkey % 5 = 0 as cc, p_partkey % 5 = 1 and p_partkey % 7 <> 0 as ec from part)
    select p_partkey, case when not ca and not ea then 'a' else '' end || case when not cc and not ec then 'c' else '' end as missing, case when not ca and ea then 'a' else '' end || case when not cc and ec then 'c' else '' end as unconfirmed from f""")
def publish_gates(spark: SparkSession, d: str) -> DataFrame:
    """Required fields without a value, and with one that nobody confirmed."""
    gate = _field_maps(spark, d).select("p_partkey", fields.publish_gate(F.col("schema"), F.col("extracted"), F.col("confirmed")).alias("g"))
    return gate.select("p_partkey", F.array_join("g.missing", "").alias("missing"), F.array_join("g.unconfirmed", "").alias("unconfirmed"))


@query("select p_partkey, " + " || ".join(f"case when p_partkey % {n} = 0 then '{k}=' || {c} || ';' else '' end" for k, (c, n) in FIELDS.items()) + " as shown from part")
def publishable(spark: SparkSession, d: str) -> DataFrame:
    """The schema's fields that are confirmed, with their values."""
    held = fields.publishable_values(F.col("schema"), F.col("confirmed"))
    return _field_maps(spark, d).select("p_partkey", F.array_join(F.transform(F.map_entries(held), lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit(";"))), "").alias("shown"))


@query("select p_partkey, " + " || ".join(f"case when p_partkey % {n} = 0 then '{k};' else '' end" for k, (c, n) in FIELDS.items()) + " as kept from part")
def inherited_fields(spark: SparkSession, d: str) -> DataFrame:
    """Filled confirmed fields, marked as inherited."""
    held = F.map_filter(fields.inherited(F.col("confirmed")), lambda _, v: v["inherited"])
    return _field_maps(spark, d).select("p_partkey", F.array_join(F.transform(F.map_keys(held), lambda k: F.concat(k, F.lit(";"))), "").alias("kept"))


CONTACTS = "o_orderpriority || ' ' || '1391234' || lpad((o_orderkey % 10000)::varchar, 4, '0')"


@query(f"select o_orderkey, 'note=' || {mask(CONTACTS)} || ',status=' || o_orderstatus as shown from orders")
def orders_without_contacts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as maps without their contact keys, the other values masked."""
    contact = F.concat("o_orderpriority", F.lit(" 1391234"), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"))
    entry = F.create_map(F.lit("phone"), contact, F.lit("note"), contact, F.lit("status"), F.col("o_orderstatus"))
    kept = fields.without_contacts(F.array(entry), text.masked)[0]
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",").alias("shown"))


@query("select p_partkey, nullif(regexp_extract(t, '(\\d+(?:\\.\\d+)?)\\s*(ml|克|kg)', 1) || regexp_extract(t, '(\\d+(?:\\.\\d+)?)\\s*(ml|克|kg)', 2), '') as net, nullif(regexp_extract(t, '(\\d+)(个月|天)', 1) || regexp_extract(t, '(\\d+)(个月|天)', 2), '') as life, nullif(regexp_extract(t, '材质：([^，]+)', 1), '') as material from (select p_partkey, case p_partkey % 4 when 0 then p_size || ' ml，保质期' || p_size || '个月' when 1 then '净重' || p_size || '克，材质：' || p_brand when 2 then p_size || '天内' else p_name end as t from part)")
def text_facts(spark: SparkSession, d: str) -> DataFrame:
    """Net content, shelf life and material."""
    n = F.col("p_size").cast("string")
    t = F.when(F.col("p_partkey") % 4 == 0, F.concat(n, F.lit(" ml，保质期"), n, F.lit("个月"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("净重"), n, F.lit("克，材质："), F.col("p_brand"))).when(F.col("p_partkey") % 4 == 2, F.concat(n, F.lit("天内"))).otherwise(F.col("p_name"))
    rows = table(spark, d, "part").select("p_partkey", t.alias("t"))
    return rows.select("p_partkey", extract.net_content(F.col("t")).alias("net"), extract.shelf_life(F.col("t")).alias("life"), extract.material(F.col("t")).alias("material"))


@query("select p_partkey, p_name as subject, 'GET /x?token=***&b=' || p_size || ' redis://u:***@h' as line from part")
def subjects_and_secrets(spark: SparkSession, d: str) -> DataFrame:
    """Subjects of titles, and log lines without their secrets."""
    title = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, "（规格）").otherwise(""), F.lit(" · "), F.col("p_type"))
    line = F.concat(F.lit("GET /x?token=abc"), F.col("p_partkey").cast("string"), F.lit("&b="), F.col("p_size").cast("string"), F.lit(" redis://u:pw@h"))
    return table(spark, d, "part").select("p_partkey", extract.title_subject(title).alias("subject"), labels.without_secrets(line).alias("line"))


@query("select user_id, string_agg(event_type, ' ' order by event_id) as joined from (select user_id, event_type, event_id, row_number() over (partition by user_id order by event_id) as n from events) where n <= 5 group by user_id")
def joined_words(spark: SparkSession, d: str) -> DataFrame:
    rows = views.telemetry(spark, d).withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))).where("n <= 5")
    return rows.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("w")).select("user_id", extract.joined_words(F.col("w")).alias("joined"))


@query("select o_orderkey, case o_orderstatus when 'F' then null when 'O' then 'b' else null end as step from orders")
def next_steps(spark: SparkSession, d: str) -> DataFrame:
    """The first step that isn't done, unless one has failed."""
    step = lambda n, s: F.struct(F.lit(n).alias("name"), s.alias("status"))
    second = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "open").otherwise("failed")
    return table(spark, d, "orders").select("o_orderkey", governance.next_step(F.array(step("a", F.lit("done")), step("b", second))).alias("step"))


HITS = "(select user_id as query_id, event_id as asset_id, row_number() over (partition by user_id order by event_id) as rank from events where event_type = 'view')"
OWN = "(select user_id as query_id, event_id as asset_id, row_number() over (partition by user_id order by event_id) as rank from events where event_type in ('view', 'click') and event_id % 2 = 0)"


@query(f"""with fresh as (select o.*, row_number() over (partition by query_id order by rank) as n from {OWN} o where not exists (select 1 from {HITS} h where h.query_id = o.query_id and h.asset_id = o.asset_id)),
    b as (select query_id, asset_id, rank * 2.0 as pos from {HITS} union all select query_id, asset_id, n * 2.0 + 1 from fresh where n <= 2)
    select query_id, asset_id, row_number() over (partition by query_id order by pos) as rank from b""")
def interleaved_hits(spark: SparkSession, d: str) -> DataFrame:
    """After each of the first two hits one of the question's own new ones."""
    ranked = lambda rows: rows.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("asset_id"), F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).alias("rank"))
    events = views.telemetry(spark, d)
    return ranking.interleaved(ranked(events.where("event_type = 'view'")), ranked(events.where("event_type in ('view', 'click') and event_id % 2 = 0")), ["asset_id"])


@query(f"""with c as (select *, overlap as o from ({LEX})), n as (select query_id, count(*) filter (overlap >= 4) as hits, max(overlap) as best from c group by query_id)
    select item_id as query_id, coalesce(hits, 0) <= 1 and coalesce(best, 0) / greatest(1, len({terms('text')})) < 0.4 as weak from benchmark left join n on query_id = item_id""")
def weak_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Questions with one hit at most, which has less than two fifths of their terms."""
    found = retrieval.best_overlaps(views.questions(spark, d), views.chunks(spark, d), 4)
    size = F.greatest(F.lit(1), F.size(text.terms(F.col("question"))))
    return views.questions(spark, d).join(found, "query_id", "left").na.fill(0).select("query_id", ((F.col("hits") <= 1) & (F.col("best") / size < 0.4)).alias("weak"))
