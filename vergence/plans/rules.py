"""Queries of row rules and of material, candidate, session and ticket views, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vergence.functions import rules, text
from vergence.operators import material, ranking
from vergence.plans.more import ASKED, VERSIONS
from vergence.plans.sql import ASSETS, CHUNKS, MESSAGES, mask, terms
from vergence.sources import views
from vergence.sources.views import AS_OF, table

SQL: dict[str, str] = {}
QUERIES: list = []


def query(sql: str):
    """Registers a query with its SQL."""

    def add(f):
        QUERIES.append(f)
        SQL[f.__name__] = sql
        return f

    return add


@query("select event_id, case when event_type = 'error' then 'refusal' when event_id % 3 = 0 then 'llm' when user_id % 3 = 0 and event_id % 5 <> 0 then 'tool' else 'template' end as path from events")
def answer_paths(spark: SparkSession, d: str) -> DataFrame:
    """What each answer came from."""
    tool = F.when(F.col("user_id") % 3 == 0, "order").when(F.col("user_id") % 3 == 1, "handoff")
    path = rules.answer_path(F.when(F.col("event_type") == "error", "refusal").otherwise("answer"), F.col("event_id") % 3 == 0, tool, F.when(F.col("event_id") % 5 == 0, True))
    return views.telemetry(spark, d).select("event_id", path.alias("path"))


@query("select o_orderkey, 'order ' || o_orderkey || case o_orderkey % 3 when 2 then ' token' else '' end as result from orders")
def safe_tool_results(spark: SparkSession, d: str) -> DataFrame:
    """Tool results without what would confirm an action."""
    key = F.col("o_orderkey")
    result = F.concat(F.lit("order "), key.cast("string"), F.when(key % 3 == 0, " · 待确认 token=0a9f").when(key % 3 == 1, "待确认token=12 ").otherwise(" token"))
    return table(spark, d, "orders").select("o_orderkey", rules.without_credentials(result).alias("result"))


@query("select p_partkey, concat_ws(',', case when p_partkey % 3 = 0 then 'body' end, case when p_partkey % 4 = 0 then 'title' end, case when p_partkey % 3 = 2 then 'length' end, case when p_partkey % 3 = 2 or p_partkey % 6 = 0 then 'name' end) as faults from part")
def text_faults(spark: SparkSession, d: str) -> DataFrame:
    """What keeps each text from passing."""
    title = F.when(F.col("p_partkey") % 4 != 0, F.col("p_name"))
    content = F.when(F.col("p_partkey") % 6 == 0, " ").when(F.col("p_partkey") % 3 == 1, F.concat("p_brand", "p_name")).when(F.col("p_partkey") % 3 == 2, F.repeat(F.lit("#"), F.lit(2001)))
    return table(spark, d, "part").select("p_partkey", F.array_join(rules.text_faults(title, content, F.col("p_name")), ",").alias("faults"))


@query("select p_partkey, p_name || chr(10) || '品牌：' || case when p_size = 7 then 'Acme' else 'Q' || p_size end || chr(10) || '旧品牌：Q' || p_size as content from part")
def brand_lines(spark: SparkSession, d: str) -> DataFrame:
    """A brand's label for its entity, where that is a whole line."""
    size = F.col("p_size").cast("string")
    content = F.concat("p_name", F.lit("\n品牌：Q"), size, F.lit("\n旧品牌：Q"), size)
    return table(spark, d, "part").select("p_partkey", rules.brand_replaced(content, "Q7", "Acme").alias("content"))


@query("select p_partkey, case p_partkey % 4 when 0 then 'qa_pairs' when 1 then '图片描述' when 2 then '' else case when p_partkey % 5 = 0 then '' else p_brand || ',' || p_type end end as fields from part")
def extracted_fields(spark: SparkSession, d: str) -> DataFrame:
    """The fields to read from each kind of asset."""
    kind = F.get(F.array(*map(F.lit, ("dialogue", "image", "video", "document"))), (F.col("p_partkey") % 4).cast("int"))
    schema = F.when(F.col("p_partkey") % 5 != 0, F.array("p_brand", F.lit("qa_pairs"), "p_type"))
    return table(spark, d, "part").select("p_partkey", F.array_join(rules.fields_to_extract(kind, schema), ",").alias("fields"))


@query("select p_partkey, case when p_partkey % 2 = 0 then 'brand,' else '' end || case when p_partkey % 3 = 0 then 'weight,' else '' end || case when p_partkey % 5 = 0 then 'colour,' else '' end as fields from part")
def spec_field_order(spark: SparkSession, d: str) -> DataFrame:
    """The fields that a product has of its schema, brand first."""
    key = F.col("p_partkey")
    held = F.array_compact(F.array(F.lit("other"), F.when(key % 5 == 0, "colour"), F.when(key % 3 == 0, "weight"), F.when(key % 2 == 0, "brand")))
    found = rules.ordered_fields(F.array(*map(F.lit, ("weight", "colour", "brand"))), held, F.array(F.lit("brand"), F.lit("size")))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(found, lambda x: F.concat(x, F.lit(","))), "").alias("fields"))


RUNS = f"regexp_split_to_array(question, '[^一-龥]|[{text.STOP_CHARS}]')"


@query(f"select query_id, array_to_string(list_sort(list_distinct(flatten(list_transform({RUNS}, lambda r: flatten(list_transform([4, 3, 2], lambda s: list_transform(range(1, length(r) - s + 2), lambda i: substring(r, i, s)))))))), ',') as spans from {ASKED}")
def candidate_spans(spark: SparkSession, d: str) -> DataFrame:
    """The spans of each question, in the order of their characters."""
    return views.asks(spark, d).select("query_id", F.array_join(F.array_sort(rules.candidate_spans(F.col("question"))), ",").alias("spans"))


@query("select case when o_orderstatus = 'F' then 'closed' when o_orderkey % 2 = 0 then 'answered' else 'kept' end as verdict, count(*) as n from orders group by 1")
def asked_again(spark: SparkSession, d: str) -> DataFrame:
    """What became of gaps whose questions were asked again."""
    verdict = rules.asked_again(F.when(F.col("o_orderstatus") == "F", "resolved").otherwise("open"), F.when(F.col("o_orderkey") % 2 == 0, "answer").otherwise("refusal"))
    return table(spark, d, "orders").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("select p_partkey, case when p_partkey % 2 = 0 and p_partkey % 3 = 0 then p_brand || chr(10) || p_type when p_partkey % 2 = 0 then p_brand when p_partkey % 3 = 0 then p_type else '（切片高光）' || chr(10) || '（切片高光）' end as body from part")
def timeline_bodies(spark: SparkSession, d: str) -> DataFrame:
    """The text of each timeline."""
    item = lambda kind, role, said: F.struct(F.lit(kind).alias("type"), F.lit(role).cast("string").alias("role"), said.alias("text"))
    items = F.array(item("text", "hook", F.col("p_name")), item("clip", None, F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand"))), item("clip", None, F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), "p_type"))))
    return table(spark, d, "part").select("p_partkey", rules.timeline_body(items).alias("body"))


BRAND = mask("'brand：' || p_brand || ' 13912345678'")


@query(f"select p_partkey, p_name || '（' || p_type || '）' || chr(10) || case when p_partkey % 2 = 0 then {BRAND} || case when p_partkey % 3 = 0 then chr(10) || 'size：' || p_size else '' end when p_partkey % 3 = 0 then 'size：' || p_size else '{rules.NO_SPECS}' end as body from part")
def fallback_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Texts of the specifications, masked."""
    values = F.create_map(F.lit("brand"), F.when(F.col("p_partkey") % 2 == 0, F.concat("p_brand", F.lit(" 13912345678"))), F.lit("size"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string")).otherwise(""))
    return table(spark, d, "part").select("p_partkey", rules.fallback_body(F.col("p_name"), F.col("p_type"), values).alias("body"))


@query("select p_partkey, case when p_partkey % 2 = 1 then 'seed' when p_name like 'cold %' then 'review' when p_name like '% widget' then 'dialogue' else 'upload' end as source from part")
def corrected_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources by the shapes of titles, in the order of the rules, for uploads alone."""
    source = F.when(F.col("p_partkey") % 2 == 1, "seed").otherwise("upload")
    return table(spark, d, "part").select("p_partkey", rules.source_corrected(source, F.col("p_name"), [("^cold ", "review"), (" widget$", "dialogue")]).alias("source"))


IMAGES = "(select o_custkey as product_id, o_orderkey as asset_id, case when o_orderstatus = 'F' then o_orderkey * 10 + 1 end as pointer from orders where o_orderpriority <> '1-URGENT')"


@query(f"""with v as (select * from {VERSIONS}), every as (select product_id, i.asset_id, pointer, p.version_id is not null as there, coalesce(p.version_id, l.latest) as version_id
        from {IMAGES} i left join (select distinct version_id from v) p on p.version_id = pointer left join (select asset_id, arg_max(version_id, version_no) as latest from v group by 1) l on l.asset_id = i.asset_id)
    select product_id, asset_id, version_id from (select *, row_number() over (partition by product_id order by there desc, pointer desc nulls last, asset_id desc) as n from every where version_id is not null) where n = 1""")
def reference_images(spark: SparkSession, d: str) -> DataFrame:
    """The image that stands for each customer's orders, and its version."""
    orders, key = table(spark, d, "orders"), F.col("o_orderkey")
    images = orders.select(F.col("o_custkey").alias("product_id"), key.alias("asset_id"), F.when(F.col("o_orderstatus") == "F", key * 10 + 1).alias("pointer"), F.when(F.col("o_orderpriority") == "1-URGENT", AS_OF).alias("discarded_at"))
    versions = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("asset_id"), F.col("l_linenumber").alias("version_no"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("version_id")).distinct()
    return material.reference_images(images, versions)


@query("select user_id, event_id, row_number() over (partition by user_id order by event_type = 'purchase' desc, event_id) as place from events")
def ranked_clips(spark: SparkSession, d: str) -> DataFrame:
    """Those that are named first, otherwise as they were."""
    return material.flagged_first(views.telemetry(spark, d), "user_id", F.col("event_type") == "purchase", "event_id").select("user_id", "event_id", "place")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Events as candidates: errors are registered, two of three have no recording."""
    status = F.when(F.col("event_type") == "error", "registered").otherwise("pending")
    source = F.when(F.col("event_type") == "click", "cloud").when(F.col("event_type") == "view", "local").otherwise("seed")
    return views.telemetry(spark, d).select(F.col("event_id").alias("id"), status.alias("status"), F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("recording_id"), F.col("user_id").alias("product_id"), source.alias("transcript_source"))


@query("select event_id as id, case when event_type <> 'error' and event_id % 3 <> 0 and event_id % 2 = 0 then 7 when event_id % 3 = 0 then user_id end as recording_id from events")
def rebound_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The asked candidates that are pending and have no recording get one."""
    rows = _candidates(spark, d)
    return material.rebound(rows, 7, rows.where("id % 2 = 0"), only_unbound=True).select("id", "recording_id")


@query("select p_partkey as id, event_id is not null as found, coalesce(event_type = 'error', false) as registered from part left join events on event_id = p_partkey")
def asked_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Which of the asked ids there are, and which of them are registered."""
    return material.asked_candidates(table(spark, d, "part").select(F.col("p_partkey").alias("id")), _candidates(spark, d))


@query("select user_id as recording_id, count(*) filter (event_type in ('click', 'view')) as n from events where event_id % 3 = 0 group by 1")
def pending_counts(spark: SparkSession, d: str) -> DataFrame:
    """Pending candidates of two sources by recording."""
    return material.pending_counts(_candidates(spark, d), ["cloud", "local"])


@query("select event_id as id, coalesce(c_name, '—') as product_name, case when event_id % 3 = 0 then user_id end as recording_id, n_name as label from events left join customer on c_custkey = user_id left join nation on event_id % 3 = 0 and n_nationkey = user_id")
def candidate_cards(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with names and recordings."""
    named = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return material.candidate_cards(_candidates(spark, d), named, table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label")))


@query("select o_orderkey from orders order by o_orderdate desc, o_orderkey desc limit 20")
def newest_recordings(spark: SparkSession, d: str) -> DataFrame:
    """The newest 20."""
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(20).select("o_orderkey")


@query(f"""select m.session_id, row_number() over (partition by m.session_id order by m.id) as place, m.id, m.role, quality as rating, ticket_id
    from ({MESSAGES}) m left join labels on doc_id = m.session_id left join (select o_custkey, max(o_orderkey) as ticket_id from orders group by 1) on o_custkey = m.session_id""")
def session_detail(spark: SparkSession, d: str) -> DataFrame:
    """Messages with their session's rating and newest ticket."""
    ratings = table(spark, d, "labels").select(F.col("doc_id").alias("session_id"), F.col("quality").alias("rating"))
    return material.session_detail(views.messages(spark, d), ratings, table(spark, d, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("id")))


@query(f"""select query_id, row_number() over (partition by query_id order by pos, seq) as place, asset_id, seq, chunk
    from (select item_id as query_id, 0 as pos, item_id * 2 as asset_id from benchmark union all select item_id, 1, item_id + 1 from benchmark where item_id <> 1) join ({CHUNKS}) using (asset_id)""")
def cited_chunks(spark: SparkSession, d: str) -> DataFrame:
    """All chunks of the two documents that each question cites."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(1).alias("version_no"))
    first = items.select("query_id", F.lit(0).alias("at"), (F.col("query_id") * 2).alias("asset_id"), "version_no")
    second = items.where("query_id <> 1").select("query_id", F.lit(1).alias("at"), (F.col("query_id") + 1).alias("asset_id"), "version_no")
    return material.cited_chunks(first.unionByName(second), views.chunks(spark, d))


@query("select o_orderkey as id from orders where o_orderstatus = 'O' and o_orderdate < timestamp '1998-01-01 00:00:00' - interval 48 hours")
def stale_tickets(spark: SparkSession, d: str) -> DataFrame:
    """Tickets that have been open for more than two days."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("resolved").alias("status"), F.col("o_orderdate").alias("created_at"))
    return material.stale_tickets(rows, "1998-01-01 00:00:00")


@query(f"select 0 as source_rank, 'gap' as source, item_id as at, text as question from benchmark union all select 1, 'compliance', n_nationkey, n_name from nation union all select 2, 'dialogue', id, content from ({MESSAGES}) where role = 'customer'")
def question_sources(spark: SparkSession, d: str) -> DataFrame:
    """Questions of three sources with the rank of each."""
    gaps = table(spark, d, "benchmark").select(F.col("item_id").alias("at"), F.col("text").alias("question"))
    rules_ = table(spark, d, "nation").select(F.col("n_nationkey").alias("at"), F.col("n_name").alias("question"))
    said = views.messages(spark, d).where("role = 'customer'").select(F.col("id").alias("at"), F.col("content").alias("question"))
    return material.by_priority([("gap", gaps), ("compliance", rules_), ("dialogue", said)])


@query("select v as verdict, count(event_id) as n from (select unnest(['click', 'error', 'none']) as v) left join events on event_type = v group by v")
def verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the named verdicts, 0 included."""
    return material.verdict_counts(views.telemetry(spark, d).select(F.col("event_type").alias("verdict")), ["click", "error", "none"])


@query("select source, coalesce(100 * avg(quality) >= 98.8 - 1e-9, false) and coalesce(100 * avg((toxic = 0)::int) >= 86.7 - 1e-9, false) as held from documents left join labels using (doc_id) group by source")
def redlines(spark: SparkSession, d: str) -> DataFrame:
    """Whether both floors hold, by source."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(material.redline(F.col("quality"), F.col("toxic") == 0).alias("held"))


@query("select count(*) as total, count(*) filter (vec_id is null) as missing from documents left join (select distinct vec_id from embeddings) on vec_id = doc_id")
def embedding_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Documents, and those without a vector."""
    return material.embedding_gaps(table(spark, d, "documents").select("doc_id"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), ["doc_id"])


SAID = "case when event_id % 2 = 0 then '重量：' || event_type else event_type end"


@query(f"""with h as (select *, row_number() over (partition by user_id order by event_id) as rank from events),
    t as (select user_id, string_agg(case when event_id % 5 % 2 = 0 then '根据已发布的客服对话记录：' || {SAID} else '根据已发布的规格文档《' || case event_id % 5 when 3 then '未命名资产' else 'T' || event_id % 5 end || '》' || case when event_id % 2 = 0 then '，重量为' else '：' end || event_type || '。' end, chr(10) order by rank) as content, count(distinct event_id % 5) as cited from h where rank <= 2 group by 1)
    select c_custkey as query_id, case when content is null then 'refusal' else 'answer' end as kind, content, coalesce(cited, 0) as cited from customer left join t on user_id = c_custkey""")
def template_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers put together from the two best hits."""
    event, kind = F.col("event_id"), F.col("event_type")
    hits = views.telemetry(spark, d).select(F.col("user_id").alias("query_id"), F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).alias("rank"), (event % 5).alias("asset_id"), F.lit(1).alias("version_no"), F.when(event % 2 == 0, F.concat(F.lit("重量："), kind)).otherwise(kind).alias("chunk"))
    assets = spark.range(5).select(F.col("id").alias("asset_id"), F.when(F.col("id") % 2 == 0, "dialogue").otherwise("document").alias("kind"), F.when(F.col("id") != 3, F.concat(F.lit("T"), F.col("id").cast("string"))).alias("title"))
    found = material.composed_answers(table(spark, d, "customer").select(F.col("c_custkey").alias("query_id")), hits, assets)
    return found.select("query_id", "kind", "content", F.coalesce(F.size("citations"), F.lit(0)).alias("cited"))


@query("select p_partkey, p_type || '评论 · ' || left(p_name || ' ' || p_brand, 18) as review, case when p_partkey % 3 = 0 then 'ABCD 对话' when p_partkey % 3 = 1 then p_type || '/' || p_brand else p_brand || ' · ' || left(p_name || p_name || p_name, 30) end as dialogue from part")
def asset_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles of reviews and dialogues."""
    key = F.col("p_partkey") % 3
    dialogue = rules.dialogue_title(F.when(key == 1, F.col("p_type")), F.when(key == 0, " ").otherwise(F.col("p_brand")), F.when(key == 2, F.concat("p_name", "p_name", "p_name")))
    return table(spark, d, "part").select("p_partkey", rules.review_title(F.col("p_type"), F.concat(F.lit(" "), "p_name", F.lit(" "), "p_brand", F.lit(" "))).alias("review"), dialogue.alias("dialogue"))


@query(f"select p_partkey, ['', '', '请问', '', ''][p_partkey % 5 + 1] || p_name || ['有多少', '是多少', '值得入手吗', '，对吧', '，麻烦告知'][p_partkey % 5 + 1] as rephrased, case when p_partkey % 2 = 0 then p_name || '的净重是' || p_size || 'g吗,' || p_name || '的净重是多少' else p_name || '的净重是什么' end as asked from part")
def generated_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions in other words, and what is asked about a field."""
    ending = F.get(F.array(*map(F.lit, ("是多少", "是什么", "怎么样", "吗", ""))), (F.col("p_partkey") % 5).cast("int"))
    value = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit("g"))).otherwise("轻")
    return table(spark, d, "part").select("p_partkey", rules.rephrased(F.concat("p_name", ending)).alias("rephrased"), F.array_join(rules.field_questions(F.col("p_name"), F.lit("净重"), value), ",").alias("asked"))


PHONE = mask("p_brand || ' 13912345678'")


@query(f"select p_partkey, {PHONE} as value, {PHONE} || '|' || p_name as pair from part")
def masked_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Values and pairs of questions and answers, masked."""
    phone = F.concat("p_brand", F.lit(" 13912345678"))
    held = F.create_map(F.lit("note"), F.struct(phone.alias("value"), F.array(F.struct(phone.alias("q"), F.col("p_name").alias("a"))).alias("qa")))
    shown = rules.masked_fields(held, text.masked)["note"]
    return table(spark, d, "part").select("p_partkey", shown["value"].alias("value"), F.concat_ws("|", shown["qa"][0]["q"], shown["qa"][0]["a"]).alias("pair"))


@query("select o_orderkey, case o_orderkey % 7 when 0 then 'none' when 1 then 'handoff' when 2 then 'get_order:SO-' || o_orderkey else 'rejected' end as asked from orders")
def tool_proposals(spark: SparkSession, d: str) -> DataFrame:
    """What models' answers ask for."""
    key = F.col("o_orderkey").cast("string")
    said = F.get(F.array(F.lit("您好"), F.lit("tool: Handoff {}"), F.concat(F.lit('好的\nTOOL: get_order {"order_no": "so-'), key, F.lit('"}')), F.lit('TOOL: get_order {"order_no": "all"}'), F.lit('TOOL: drop {"x": "1"}'), F.lit("use TOOL now"), F.lit('TOOL: get_order {"order_no": "so-1", "x": "1"}')), (F.col("o_orderkey") % 7).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", rules.proposal(said, {"get_order": ("order_no", "(?i)so-[0-9]+")}).alias("asked"))


def _dialogues(spark: SparkSession, d: str) -> DataFrame:
    """Parts as dialogues: a third has pairs, a third only what a customer said, a third neither."""
    key = F.col("p_partkey") % 3
    pair = lambda q, a: F.struct(q.alias("q"), a.alias("a"))
    none = F.lit(None).cast("string")
    qa = F.when(key == 0, F.array(pair(F.lit(" "), F.col("p_type")), pair(F.col("p_name"), F.col("p_brand")), pair(F.concat(F.lit(" "), "p_brand"), none)))
    said = F.when(key == 1, F.concat(F.lit("客服：您好\n顾客： \n 顾客："), "p_name", F.lit(" 13912345678\n顾客：再见"))).otherwise("客服：您好")
    return table(spark, d, "part").select(F.col("p_partkey").alias("asset_id"), F.lit(1).alias("version_no"), qa.alias("qa"), said.alias("transcript"))


DERIVED = f"""(select p_partkey as asset_id, 1 as version_no, 'qa' as source, 1 as pair_index, p_name as question, p_brand as answer from part where p_partkey % 3 = 0 union all select p_partkey, 1, 'qa', 2, p_brand, null from part where p_partkey % 3 = 0
    union all select p_partkey, 1, 'transcript', null, {mask("p_name || ' 13912345678'")}, null from part where p_partkey % 3 = 1)"""


@query(f"select * from {DERIVED}")
def derived_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions of dialogues."""
    return material.derived_questions(_dialogues(spark, d))


@query(f"select * from {DERIVED} where (source = 'qa' and pair_index = 1) or (source = 'transcript' and asset_id % 2 = 0)")
def asked_questions(spark: SparkSession, d: str) -> DataFrame:
    """The questions of given keys, of which some are of another version or lack their pair."""
    at = lambda source, index, version: table(spark, d, "part").select(F.col("p_partkey").alias("asset_id"), version.alias("version_no"), F.lit(source).alias("source"), F.lit(index).cast("int").alias("pair_index"))
    keys = at("qa", 1, F.lit(1)).unionByName(at("qa", None, F.lit(1))).unionByName(at("transcript", None, 1 + F.col("p_partkey") % 2))
    return material.asked_questions(keys, material.derived_questions(_dialogues(spark, d)))


CODE = "lpad(({0} // 3600)::varchar, 2, '0') || ':' || lpad(({0} % 3600 // 60)::varchar, 2, '0') || ':' || lpad(({0} % 60)::varchar, 2, '0')"


@query(f"select p_size as at, {CODE.format('(p_size * 40)')} as timecode_start, {CODE.format('(p_size * 40 + 39)')} as timecode_end, '顾客问 ' || p_type || ' —— ' || p_name || '（标注：Exact）' as transcript from part")
def pair_clips(spark: SparkSession, d: str) -> DataFrame:
    """Clips of pairs of a question and a product."""
    return material.pair_clips(table(spark, d, "part").select(F.col("p_size").cast("int").alias("at"), F.col("p_type").alias("query"), F.col("p_name").alias("name")))


@query(f"select p_partkey as recording_id, 'pending' as status, {CODE.format('p_size')} as timecode_start, {CODE.format('(p_size + 9)')} as timecode_end, p_name as transcript, 'cloud' as transcript_source, left(repeat(p_brand, 20), 120) as label from part")
def candidate_rows(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of transcribed segments."""
    size = F.col("p_size").cast("int")
    return material.candidate_rows(table(spark, d, "part").select(F.col("p_partkey").alias("recording_id"), F.repeat("p_brand", F.lit(20)).alias("label"), size.alias("start"), (size + 9).alias("end"), F.col("p_name").alias("transcript")), "cloud")


@query(f"select product_id, row_number() over (partition by product_id order by asset_id) as place, asset_id, pointer is not null as published from {IMAGES}")
def product_assets(spark: SparkSession, d: str) -> DataFrame:
    """The live assets of each product."""
    pointer = F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey") * 10 + 1)
    return material.product_assets(table(spark, d, "orders").select(F.col("o_custkey").alias("product_id"), F.col("o_orderkey").alias("asset_id"), pointer.alias("pointer"), F.when(F.col("o_orderpriority") == "1-URGENT", AS_OF).alias("discarded_at")))


@query("select 'products' as \"check\", count(*) as found, count(*) > 0 as ready from part union all select 'open', count(*) filter (o_orderstatus = 'O'), count(*) filter (o_orderstatus = 'O') = 0 from orders")
def readiness(spark: SparkSession, d: str) -> DataFrame:
    """Counts against what is expected."""
    n = F.col("found")
    return material.readiness({"products": (table(spark, d, "part"), F.lit(True), n > 0), "open": (table(spark, d, "orders"), F.col("o_orderstatus") == "O", n == 0)})


@query("select p_partkey, case when p_partkey % 7 = 0 then 'skipped' when p_partkey % 5 = 0 then 'unverified' when p_partkey % 3 = 0 then 'no_confirmed' when (p_name like 'cold%')::int + (p_name like '%widget%')::int + (p_partkey % 2 = 0)::int >= 2 then 'consistent' else 'suspect' end as verdict from part")
def description_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions of pictures against what was seen."""
    key = F.col("p_partkey")
    confirmed = F.when(key % 3 == 0, " ").otherwise(F.concat(F.lit("画面中央的背景："), F.upper("p_name"), F.when(key % 2 == 0, "，矿泉").otherwise("，矿的泉")))
    seen = F.when(key % 10 != 0, "画面背景是矿泉，cold widget")
    found = rules.description_verdict(confirmed, seen, key % 10 == 5, key % 7 == 0)
    return table(spark, d, "part").select("p_partkey", found.alias("verdict"))


PROBES = f"(select item_id as query_id, text as question, string_split(text, ' ')[1] as span, string_split(title, ' ')[1] as target from benchmark join ({ASSETS}) on asset_id = item_id * 2 where text <> '' and title <> '')"
HYPOTHESES = f"(select query_id, span, target, {terms('question')} as base, {terms('replace(question, span, target)')} as changed from {PROBES} where target <> span and not contains(question, target))"


@query(f"""with h as (select query_id, span, target, unnest(list_distinct(list_concat(base, changed))) as term, base from {HYPOTHESES}), p as (select asset_id, seq, unnest(t) as term, len(t) as n from (select asset_id, seq, {terms('chunk')} as t from ({CHUNKS}))),
    s as (select query_id, span, target, asset_id, seq, count(*) / sqrt(max(n)) as score, bool_or(not list_contains(base, term)) as fresh from h join p using (term) group by all)
    select query_id, span, target, round(max(score), 4) as score from s where fresh group by all""")
def ranked_targets(spark: SparkSession, d: str) -> DataFrame:
    """Words that might stand for one of a question's, by the best chunk that they would find."""
    asked = views.questions(spark, d).where("question <> ''")
    titles = views.assets(spark, d).where("title <> ''").select((F.col("asset_id") / 2).alias("query_id"), F.substring_index("title", " ", 1).alias("target"))
    probes = asked.join(titles, "query_id").select("query_id", "question", F.substring_index("question", " ", 1).alias("span"), "target")
    return ranking.ranked_targets(probes, views.chunks(spark, d), ["asset_id", "seq"])
