"""DuckDB SQL of the queries, over the same tables."""

from __future__ import annotations

from vergence.functions.text import BLANKS as BLANK_CHARS
from vergence.functions.text import FIELD_LINE, LINE_ENDS, NARROW_MARKS, STOP_CHARS, TRAILING_MARKS, WIDE_MARKS

AS_OF = "timestamp '2024-01-31 00:00:00'"
BLANKS = " || ".join(f"chr({ord(c)})" for c in BLANK_CHARS)
ENDS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in LINE_ENDS[1:-1]) + "]"


def strip(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def tokens(x: str) -> str:
    keep = lambda items: f"list_filter({items}, lambda t: not regexp_matches(t, '[{STOP_CHARS}]'))"
    pairs = "list_transform(range(1, length(k)), lambda i: substring(k, i, 2))"
    of_run = f"list_transform([regexp_replace(r, '[^\\p{{L}}\\p{{N}}]', '', 'g')], lambda k: case when length(k) = 1 then {keep('[k]')} when length(k) > 1 then {keep(pairs)} else [] end)[1]"
    return f"flatten(list_transform(regexp_extract_all({x}, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+'), lambda r: case when regexp_matches(r, '^[A-Za-z0-9]') then [lower(r)] else {of_run} end))"


def terms(x: str) -> str:
    return f"list_distinct({tokens(x)})"


def chunks(x: str) -> str:
    lines = f"list_filter(list_transform(regexp_split_to_array({x}, '{ENDS}'), lambda l: {strip('l')}), lambda l: l <> '')"
    parts = f"list_filter(list_transform(regexp_split_to_array(s, '[，,、]'), lambda p: {strip('p')}), lambda p: length(p) >= 2)"
    sentence = f"case when length(s) <= 40 then case when length(s) >= 2 then [s] else [] end when len({parts}) > 0 then {parts} else [s] end"
    sentences = f"list_transform(regexp_split_to_array(l, '[。；;]'), lambda q: trim({strip('q')}, '，,、'))"
    field = FIELD_LINE.replace("'", "''")
    return f"flatten(list_transform({lines}, lambda l: case when regexp_matches(l, '{field}') then [l] else flatten(list_transform({sentences}, lambda s: {sentence})) end))"


ASSETS = f"select doc_id as asset_id, source as source_kind, text as body, {strip('string_split(text, chr(10))[1]')} as title from documents"
CHUNKS = f"select asset_id, unnest(range(0, len(c))) as seq, unnest(c) as chunk from (select doc_id as asset_id, {chunks('text')} as c from documents)"
MESSAGES = "select conv_id * 1000 + turn as id, conv_id as session_id, turn, case role when 'user' then 'customer' else 'agent' end as role, text as content from conversations where role in ('user', 'assistant')"
PRODUCTS = "select p_partkey as id, p_name as name, p_type as category, p_brand as brand, p_size % 10 as stock, case when p_size % 7 <> 0 then cast(round(p_retailprice * 100) as bigint) end as price_cents from part"
QTERMS = f"select item_id as query_id, unnest({terms('text')}) as term from benchmark"


def mask(x: str) -> str:
    mail = f"regexp_replace({x}, '[A-Za-z0-9._%+-]{{3,}}@([A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+)', '****@\\1', 'g')"
    return f"regexp_replace({mail}, '(^|[^0-9])1[3-9][0-9]{{7}}([0-9]{{2}})([^0-9]|$)', '\\1' || '1********' || '\\2\\3', 'g')"


def lexical(source: str, key: str, text: str) -> str:
    """(query_id, key, overlap, score) of a source with its text."""
    return f"""select query_id, {key}, count(*) as overlap, count(*) / sqrt(max(n)) as score from (select {key}, len(t) as n, unnest(t) as term from (select {key}, {terms(text)} as t from ({source}))) p
        join ({QTERMS}) q using (term) group by query_id, {key}"""


TITLES = f"select asset_id, {terms('title')} as t from ({ASSETS}) where title <> ''"
IDF = f"select term, count(*) as df, ln(1 + (select count(*) from ({TITLES})) / (1 + count(*))) as idf from (select unnest(t) as term from ({TITLES})) group by term"
AFFINITY = f"""select query_id, asset_id, sum(idf) / max(total) as affinity from (select asset_id, term, idf, sum(idf) over (partition by asset_id) as total
    from (select asset_id, unnest(t) as term from ({TITLES})) join ({IDF}) using (term)) join ({QTERMS}) using (term) group by query_id, asset_id"""
BODIES = "select doc_id as asset_id, text as chunk from documents"
LEX_ASSETS = lexical(BODIES, "asset_id", "chunk")
TOP = "row_number() over (partition by query_id order by {by} desc, {ties}) as rank"
COVERAGE = f"""select query_id, asset_id, count(*) / max(n) as coverage from (select distinct asset_id, term from (select asset_id, unnest({terms('chunk')}) as term from (SOURCE)))
    join (select query_id, term, count(*) over (partition by query_id) as n from ({QTERMS})) using (term) group by query_id, asset_id"""


def top(source: str, k: int, by: str, ties: str) -> str:
    return f"select * from (select *, {TOP.format(by=by, ties=ties)} from ({source})) where rank <= {k}"


LEXICAL = lexical(CHUNKS, "asset_id, seq", "chunk")
METRICS = "{g} as case_group, count(*) as n, round(avg(case when rank <= 1 then 1.0 else 0.0 end), 4) as recall_1, round(avg(case when rank <= 3 then 1.0 else 0.0 end), 4) as recall_3, round(avg(coalesce(1 / rank, 0.0)), 4) as mrr, round(avg(coalesce(1 / log2(rank + 1), 0.0)), 4) as ndcg_3, round(avg(case when rank is null then 1.0 else (3 - 1) / 3 end), 4) as noise_3"
LEX10 = top(LEX_ASSETS, 10, "score", "asset_id")
AFF10 = top(f"select query_id, asset_id, round(affinity, 6) as score from ({AFFINITY})", 10, "score", "asset_id")
FIRST_QUESTION = f"select session_id, case when length(m) > 60 then substring(m, 1, 60) || '…' else m end as first_question from (select session_id, {mask('arg_min(content, id)')} as m from ({MESSAGES}) where role = 'customer' group by session_id)"
NEXT = f"select id, session_id, role, min(case when role = 'agent' then id end) over (partition by session_id order by id rows between 1 following and unbounded following) as reply_id from ({MESSAGES})"

SQL: dict[str, str] = {
    "lexical_top_k": f"select query_id, rank, asset_id, seq, overlap, round(score, 6) as score from ({top(LEXICAL, 5, 'score', 'asset_id, seq')})",
    "retrieve_top_k": f"""with scored as (select query_id, asset_id, seq, round(score * (1 + 3.0 * coalesce(affinity, 0)), 9) as score from ({LEXICAL}) left join ({AFFINITY}) using (query_id, asset_id)),
        kept as (select * from (select s.*, row_number() over (partition by query_id, asset_id, {mask('chunk')} order by seq) as nth from scored s join ({CHUNKS}) using (asset_id, seq)) where nth = 1)
        select query_id, rank, asset_id, seq, round(score, 5) as score from ({top('select query_id, asset_id, seq, score from kept', 5, 'score', 'asset_id, seq')})""",
    "retrieval_metrics": f"""with ranked as ({top(LEXICAL, 3, 'score', 'asset_id, seq')}),
        expected as (select item_id as query_id, min(doc_id) as expected from benchmark b join documents d on contains(d.text, b.text) group by item_id),
        cases as (select item_id as query_id, expected, case when expected is null then 'open' else 'answerable' end as case_group from benchmark left join expected on item_id = query_id),
        judged as (select c.query_id, c.case_group, min(r.rank) as rank from cases c left join ranked r on r.query_id = c.query_id and r.asset_id = c.expected group by 1, 2)
        select {METRICS.format(g='case_group')} from judged group by case_group union all select {METRICS.format(g="'overall'")} from judged""",
    "title_idf": f"select term, df, round(idf, 6) as idf from ({IDF})",
    "title_affinity": f"select query_id, asset_id, round(affinity, 6) as affinity from ({AFFINITY})",
    "chunk_coverage": f"select query_id, asset_id, rank, round(coverage, 6) as coverage from ({top(COVERAGE.replace('SOURCE', CHUNKS), 3, 'coverage', 'asset_id')})",
    "unknown_terms": f"""with corpus as (select distinct unnest({terms('chunk')}) as term from ({CHUNKS}))
        select item_id as query_id, len({terms('text')}) as n_terms, len(list_filter({terms('text')}, lambda t: false)) + coalesce(u, 0) as unknown
        from benchmark left join (select query_id, count(*) as u from ({QTERMS}) where term not in (select term from corpus) group by query_id) on item_id = query_id""",
    "rank_fusion": f"""with fused as (select coalesce(a.query_id, b.query_id) as query_id, coalesce(a.asset_id, b.asset_id) as asset_id, coalesce(1 / (60 + a.rank), 0) + coalesce(1.0::double / (60 + b.rank), 0) as fused
        from ({LEX10}) a full join ({AFF10}) b on a.query_id = b.query_id and a.asset_id = b.asset_id)
        select query_id, rank, asset_id, round(fused, 6) as fused from ({top('select * from fused', 5, 'fused', 'asset_id')})""",
    "linear_fusion": f"""with lex as (select query_id, asset_id, case when max(score) over w = min(score) over w then 1.0::double else (score - min(score) over w) / (max(score) over w - min(score) over w) end as lex from ({LEX10}) window w as (partition by query_id)),
        fused as (select coalesce(a.query_id, b.query_id) as query_id, coalesce(a.asset_id, b.asset_id) as asset_id, coalesce(lex, 0) + 0.5 * coalesce(b.score, 0) as fused from lex a full join ({AFF10}) b on a.query_id = b.query_id and a.asset_id = b.asset_id
        where coalesce(a.query_id, b.query_id) in (select query_id from lex))
        select query_id, rank, asset_id, round(fused, 6) as fused from ({top('select * from fused', 5, 'fused', 'asset_id')})""",
    "nearest_vectors": f"""select query_id, vec_id, rank, round(cos, 6) as cos from ({top('''select q.vec_id as query_id, v.vec_id, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) as cos
        from embeddings q, embeddings v where q.vec_id % 50 = 0 and list_cosine_similarity(q.embedding::double[], v.embedding::double[]) >= 0.3''', 10, 'cos', 'vec_id')})""",
    "document_chunks": f"select asset_id, seq, md5(chunk) as chunk_md5 from ({CHUNKS})",
    "document_tokens": f"select asset_id, len(t) as n_tokens, len(list_distinct(t)) as n_terms, md5(array_to_string(list_sort(list_distinct(t)), ' ')) as terms_md5 from (select doc_id as asset_id, {tokens('text')} as t from documents)",
    "redact_documents": f"select doc_id, md5({mask('text')}) as masked_md5, {mask('text')} <> text as changed from documents",
    "normalised_text": "select doc_id, md5(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) as normalised_md5 from documents",
    "knowledge_gaps": f"""with gone as (select id from ({NEXT}) where role = 'customer' and reply_id is null)
        select md5(k) as key_md5, count(*) as hit_count, min(id) as first_id from (select id, rtrim(translate({strip('content')}, '{WIDE_MARKS}', '{NARROW_MARKS}'), '{TRAILING_MARKS}') as k from ({MESSAGES}) where id in (select id from gone)) group by k""",
    "first_question": FIRST_QUESTION,
    "last_question": f"select session_id, max(id) as id, md5(arg_max(content, id)) as question_md5 from ({MESSAGES}) where role = 'customer' group by session_id",
    "prev_user_question": f"""select id, session_id, md5(question) as question_md5 from (select id, session_id, role,
        last_value(case when role = 'customer' then content end ignore nulls) over (partition by session_id order by id rows between unbounded preceding and 1 preceding) as question from ({MESSAGES})) where role = 'agent'""",
    "next_assistant_reply": f"select id, session_id, reply_id from ({NEXT}) where role = 'customer'",
    "recent_turns": f"""with paired as (select session_id, id, role, lag(role) over w as before, lag(id) over w as question_id from ({MESSAGES}) window w as (partition by session_id order by id)),
        newest as (select *, row_number() over (partition by session_id order by id desc) as back from paired where role = 'agent' and before = 'customer')
        select session_id, row_number() over (partition by session_id order by id) as nth, question_id, id as answer_id from newest where back <= 4""",
    "backflow_transcript": f"select session_id, count(*) as n_messages, md5(string_agg(case role when 'customer' then '顾客：' else '客服：' end || content, chr(10) order by id)) as transcript_md5 from ({MESSAGES}) group by session_id",
    "unanswered_questions": f"select session_id, id from ({NEXT}) where role = 'customer' and reply_id is null",
    "session_list": f"""select session_id, n_messages, n_customer, n_agent, last_id, first_question from (select session_id, count(*) as n_messages, count(*) filter (role = 'customer') as n_customer,
        count(*) filter (role = 'agent') as n_agent, max(id) as last_id from ({MESSAGES}) group by session_id) left join ({FIRST_QUESTION}) using (session_id)""",
    "visit_sessions": """with marked as (select *, coalesce(cast(ts - lag(ts) over w > interval 60 minutes as int), 0) as fresh from events window w as (partition by user_id order by ts, event_id)),
        numbered as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as session from marked)
        select user_id, cast(session as bigint) as session, min(ts) as started, max(ts) as ended, count(*) as n from numbered group by user_id, session""",
    "event_islands": "select user_id, min(event_id) as first, max(event_id) as last, count(*) as n from (select user_id, event_id, event_id - row_number() over (partition by user_id order by event_id) as run from events) group by user_id, run",
    "daily_zero_fill": f"""with spine as (select cast(unnest(generate_series({AS_OF} - interval 6 days, {AS_OF}, interval 1 day)) as date) as day)
        select day, count(*) filter (event_type = 'signup') as signup, count(*) filter (event_type = 'purchase') as purchase, count(*) filter (event_type = 'error') as error from spine left join events on cast(ts as date) = day group by day""",
    "event_rates": "select user_id, count(*) as n, round(nullif(count(*) filter (event_type = 'error'), 0) / count(*), 6) as error_rate, round(nullif(count(*) filter (event_type = 'purchase'), 0) / count(*) filter (event_type = 'view'), 6) as purchase_rate from events group by user_id",
    "csat_summary": """with r as (select cast(floor(value) as int) as score from events where event_type = 'view' and floor(value) between 1 and 5)
        select s.score, count(r.score) as n, (select floor(avg(score) * 10 + 0.5) / 10 from r) as average from (select cast(unnest(range(1, 6)) as int) as score) s left join r using (score) group by s.score""",
    "latency_percentiles": "select user_id, count(*) as n, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99, round(count(*) filter (event_type = 'error') / count(*), 6) as error_rate from events group by user_id",
    "latency_histogram": "select event_type, b as bound, count(*) filter (b = 'inf' or value <= cast(b as double)) as n from events, (select unnest(['0.25', '0.5', '1.0', '2.0', '3.0', '5.0', '8.0', '12.0', '20.0', 'inf']) as b) group by event_type, b",
    "source_facets": "select source, count(*) as n from documents group by source",
    "latest_event": "select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type, arg_max(cast(json_extract_string(props, '$.k') as int), event_id) as k from events group by user_id",
    "exact_duplicates": "select md5(text) as text_md5, count(*) as n, min(doc_id) as first_id from documents where text is not null group by md5(text) having count(*) > 1",
    "later_duplicates": "select doc_id, first_id from (select doc_id, min(doc_id) over (partition by md5(text)) as first_id from documents where text is not null) where doc_id > first_id",
    "duplicate_titles": f"select {strip('title')} as title, count(*) as n, min(asset_id) as first_id from ({ASSETS}) where {strip('title')} <> '' group by 1 having count(*) > 1",
    "odd_texts": "select doc_id, len(regexp_extract_all(text, '[¡-ÿ]')) >= 3 as mojibake, round(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / length(text), 6) as letter_share from documents",
    "search_documents": "select doc_id from documents where (contains(lower(text), 'that') or contains(lower(source), 'that')) and (contains(lower(text), 'src1') or contains(lower(source), 'src1')) and (contains(lower(text), 'the') or contains(lower(source), 'the'))",
    "term_frequencies": f"select term, sum(n)::bigint as n, count(*) as df from (select doc_id, term, count(*) as n from (select doc_id, unnest({tokens('text')}) as term from documents) group by doc_id, term) group by term having count(*) >= 2",
    "page_titles": f"""select page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) as host, {strip("replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&')")} as title from pages""",
    "stock_summary": f"select category, count(*) as total, count(*) filter (stock > 0) as in_stock, sum(stock)::bigint as stock from ({PRODUCTS}) group by category",
    "price_summary": f"select category, count(*) as total, count(price_cents) as priced, min(price_cents) as low, max(price_cents) as high from ({PRODUCTS}) group by category",
    "category_listing": f"""select category, nth, name, rtrim(rtrim(printf('%.2f', price_cents / 100), '0'), '.') || '元' as label from (select *, row_number() over (partition by category order by id) as nth from ({PRODUCTS}) where price_cents is not null) where nth <= 8""",
    "product_page": f"select id, row_number() over (order by kind, id) as place from (select id, case when price_cents is not null then 0 when brand is not null then 1 else 2 end as kind from ({PRODUCTS})) order by kind, id limit 24",
    "order_summary": "select 'SO-' || o_orderkey as order_no, o_orderstatus as status, count(l_orderkey) as n_items, coalesce(sum(l_quantity), 0) as quantity from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_orderstatus",
    "return_eligibility": """with asked as (select distinct 'SO-' || (l_orderkey * 2) as order_no from lineitem where l_linenumber = 1)
        select order_no, case when o_orderdate is null then 'not_found' when timestamp '1998-01-10 00:00:00' - o_orderdate <= interval 15 days then 'eligible' else 'ineligible' end as verdict from asked left join orders on order_no = 'SO-' || o_orderkey""",
    "never_ordered": "select p_partkey as id, p_name as name, p_type as category from part where p_partkey not in (select l_partkey from lineitem)",
    "customer_orders": "select c_custkey, count(o_orderkey) as n_orders, coalesce(sum(cast(round(o_totalprice * 100) as bigint)), 0)::bigint as spent_cents, max(o_orderdate) as last_order from customer left join orders on o_custkey = c_custkey group by c_custkey",
    "stock_signals": f"""select * from (select 1 as priority, 'stock_out' as signal, id from ({PRODUCTS}) where stock = 0 order by id limit 10) union all
        select * from (select 2, 'stock_low', id from ({PRODUCTS}) where stock > 0 and stock <= 5 order by id limit 10) union all
        select * from (select 3, 'no_orders', p_partkey from part where p_partkey not in (select l_partkey from lineitem) order by p_partkey limit 10)""",
    "running_start": "select l_orderkey, l_linenumber, coalesce(sum(q) over (partition by l_orderkey order by l_linenumber rows between unbounded preceding and 1 preceding), 0) as start from (select l_orderkey, l_linenumber, sum(l_quantity) as q from lineitem group by 1, 2)",
    "even_buckets": """select user_id, bucket, count(*) as n, min(event_id) as first from (select user_id, event_id, cast(case when total <= 10 then nth else floor(nth * 10 / total) end as int) as bucket
        from (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as nth, count(*) over (partition by user_id) as total from events)) group by user_id, bucket""",
    "label_quality": "select source, lang, count(*) as n, count(quality) as judged, sum(quality)::bigint as good, sum(toxic)::bigint as toxic, sum(n_chars)::bigint as chars from documents left join labels using (doc_id) group by source, lang",
    "event_id_ranges": """with runs as (select event_type, min(event_id) as first, max(event_id) as last from (select event_type, event_id, event_id - row_number() over (partition by event_type order by event_id) as run from events) group by event_type, run)
        select event_type, string_agg(case when first = last then 'H-' || lpad(first::varchar, greatest(4, length(first::varchar))::int, '0') else 'H-' || lpad(first::varchar, greatest(4, length(first::varchar))::int, '0') || '–H-' || lpad(last::varchar, greatest(4, length(last::varchar))::int, '0') end, '、' order by first) as ranges from runs group by event_type""",
    "training_pairs": f"""with paired as (select session_id, role, content as a, lag(role) over w as before, lag(content) over w as q from ({MESSAGES}) window w as (partition by session_id order by id))
        select session_id as asset_id, count(*) as n, sum(length({mask('q')}) + length({mask('a')}))::bigint as chars from paired where role = 'agent' and before = 'customer' and trim(q) <> '' and trim(a) <> '' group by session_id""",
    "refusal_gaps": """with e as (select *, 'k' || json_extract_string(props, '$.k') as question_key from events)
        select question_key, count(*) as hit_count, min(event_id) as opened, case when question_key in (select question_key from e where event_type = 'purchase' and value > 40) then 'resolved' else 'open' end as status
        from e where event_type = 'error' group by question_key""",
    "citation_lineage": """with cited as (select distinct l_suppkey as asset_id, l_orderkey * 10 + l_linenumber as message_id from lineitem where l_returnflag = 'R')
        select asset_id, total, nth, message_id from (select *, count(*) over (partition by asset_id) as total, row_number() over (partition by asset_id order by message_id desc) as nth from cited) where nth <= 10""",
    "down_voted": """select l_partkey as asset_id, count(distinct l_orderkey) as n, any_value(p_name) as title from lineitem join orders on l_orderkey = o_orderkey left join part on p_partkey = l_partkey
        where o_orderpriority = '1-URGENT' group by l_partkey order by n desc, asset_id limit 10""",
    "topic_groups": f"""with met as (select 'a' as topic, asset_id from ({ASSETS}) where regexp_matches(title, 'tion|ment') union all select 'b', asset_id from ({ASSETS}) where regexp_matches(title, 'ing') union all select 'c', asset_id from ({ASSETS}) where regexp_matches(title, 'schl|keit'))
        select topic, asset_id, count(*) over (partition by topic) as n from met qualify n > 1""",
    "json_filter": "select event_id, user_id from events where cast(json_extract_string(props, '$.k') as int) = 42",
    "work_queue": "select source, count(*) filter (quality is null) as pending, count(*) filter (quality = 1) as published, count(*) filter (quality = 0 and toxic = 0) as ingested from documents left join labels using (doc_id) group by source",
    "supply_by_nation": "select r_name, n_name, count(*) as lines, sum(l_quantity) as quantity from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name, n_name",
    "idle_customers": "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 400000 or o_orderpriority = '1-URGENT')",
    "top_orders": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderdate desc, o_orderkey desc limit 20",
    "age_buckets": f"select event_type, case when h >= 120 then '≥5 天' when h >= 24 then '1–5 天' else '24h 内' end as bucket, count(*) as n from (select event_type, (epoch({AS_OF}) - floor(epoch(ts))) / 3600 as h from events) group by 1, 2",
    "next_version": "select l_orderkey, max(l_linenumber) + 1 as version_no, min(l_linenumber) as first from lineitem group by l_orderkey",
    "timecodes": """with b as (select event_id, floor(event_id * 7.25::double)::bigint as s, greatest(ceil(event_id * 7.25::double + value), floor(event_id * 7.25::double) + 1)::bigint as e from events)
        select event_id, printf('%02d:%02d:%02d', s // 3600, (s // 60) % 60, s % 60) as start, printf('%02d:%02d:%02d', e // 3600, (e // 60) % 60, e % 60) as end, s as start_s from b""",
    "sampled_frames": """with x as (select event_id, value, greatest(2.0::double, value / 12) as step from events), y as (select *, case when value > 0 then least(12, ceil(value / step))::int else 0 end as n from x)
        select event_id, n, floor(case when n > 0 then (n - 1) * step else 0 end + 0.0005)::int as last from y""",
    "common_questions": f"""with t as (PAGES), g as (select host, title, count(*) as n, min(page_id) as first from t group by host, title)
        select host, sum(n)::bigint as n, arg_max(first, n * 1000000000 - first) as page_id from g group by host""",
    "hourly_kinds": """select date_trunc('hour', ts) as hour, count(*) filter (event_type = 'click') as click, count(*) filter (event_type = 'error') as error, count(*) filter (event_type = 'purchase') as purchase,
        count(*) filter (event_type = 'signup') as signup, count(*) filter (event_type = 'view') as view from events group by 1""",
    "events_by_level": "select user_id, event_type, count(*) as n, grouping_id(user_id, event_type) as level from events group by rollup (user_id, event_type)",
}
SQL["common_questions"] = SQL["common_questions"].replace("PAGES", SQL["page_titles"])
_AFTER = f"select l.query_id, l.asset_id, l.score, coalesce(round(affinity, 6), 0) as affinity from ({LEX10}) l left join ({AFFINITY}) a on a.query_id = l.query_id and a.asset_id = l.asset_id"
SQL |= {
    "cascade": f"""with lex as ({LEX10}), vec as (select * from ({AFF10}) where query_id not in (select query_id from lex where score >= 2.5)),
        both_ as (select query_id, asset_id, 1 as part, rank::double as place from lex l where not exists (select 1 from vec v where v.query_id = l.query_id and v.asset_id = l.asset_id) union all select query_id, asset_id, 0, -score from vec)
        select query_id, asset_id, rank from (select query_id, asset_id, row_number() over (partition by query_id order by part, place, asset_id) as rank from both_) where rank <= 5""",
    "affinity_after": f"select query_id, rank, asset_id, round(final, 6) as final from ({top(f'select query_id, asset_id, round(score * (1 + 3.0 * affinity), 9) as final from ({_AFTER})', 5, 'final', 'asset_id')})",
    "affinity_ties": f"select query_id, rank, asset_id from (select query_id, asset_id, row_number() over (partition by query_id order by round(score, 1) desc, affinity desc, score desc, asset_id) as rank from ({_AFTER})) where rank <= 5",
    "shared_words": f"""with p as (select asset_id, len(t) as n, unnest(t) as term from (select asset_id, {terms('chunk')} as t from ({CHUNKS}))),
        scored as (select term, asset_id, max(1 / sqrt(n)) as score from p where regexp_matches(term, '^[a-z]{{4,}}$') group by term, asset_id),
        words as (select term, count(*) as support from scored group by term having count(*) > 1 order by support desc, term limit 30),
        two as (select *, row_number() over (partition by term order by asset_id) as nth from scored join words using (term))
        select term as word, support, asset_id from (select *, row_number() over (partition by term order by score desc, asset_id) as best from two where nth <= 2) where best = 1""",
    "without_evidence": f"""with q as (select p_partkey as query_id, unnest({terms('p_name')}) as term from part), corpus as (select distinct unnest({terms('chunk')}) as term from ({CHUNKS}))
        select query_id from q group by query_id having count(*) filter (term in (select term from corpus)) = 0""",
    "unknown_words": f"""with q as (select query_id, unnest(w) as term, unnest(range(0, len(w))) as pos from (select page_id as query_id, regexp_extract_all(lower(title), '[a-z]+') as w from ({SQL['page_titles']}))),
        corpus as (select distinct unnest({terms('chunk')}) as term from ({CHUNKS}))
        select query_id, term as word from (select *, row_number() over (partition by query_id order by length(term) desc, pos) as n from q where length(term) >= 4 and term not in (select term from corpus)) where n = 1""",
}

# A fold over each user's events in order: a segment ends at a pause or once it spans enough.
SQL["pause_segments"] = """with recursive v as (select user_id, epoch_us(ts) / 1e6 as s, epoch_us(ts) / 1e6 + value as e from events),
    o as (select *, row_number() over (partition by user_id order by s, e) as n from v),
    r as (select user_id, n, 0 as segment, s as started, e as ended from o where n = 1
        union all select o.user_id, o.n, r.segment + c.cut::int, case when c.cut then o.s else r.started end, case when c.cut then o.e else greatest(o.e, r.ended) end
        from r join o on o.user_id = r.user_id and o.n = r.n + 1, lateral (select o.s - r.ended >= 3600 or r.ended - r.started >= 43200 as cut) c)
    select user_id as key, segment, min(started) as started, max(ended) as ended, count(*) as n from r group by user_id, segment"""
# The runs of digits and what stands between them, put together again.
SQL["contact_mask"] = r"""with m as (select doc_id, text, regexp_replace(text, '[\w.+-]+@([\w-]+(?:\.[\w-]+)+)', '****@\1', 'g') as mail from documents),
    p as (select doc_id, text, string_split_regex(mail, '\d[\d \t\-.]*\d') as parts, regexp_extract_all(mail, '\d[\d \t\-.]*\d') as runs from m),
    d as (select doc_id, text, parts, list_transform(runs, lambda r: case when length(regexp_replace(r, '\D', '', 'g')) >= 7 then regexp_replace(r, '\D', '', 'g')[1] || repeat('*', length(regexp_replace(r, '\D', '', 'g')) - 3) || right(regexp_replace(r, '\D', '', 'g'), 2) else r end) as runs from p),
    x as (select doc_id, text, array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || coalesce(runs[i], '')), '') as masked from d)
    select doc_id, md5(masked) as masked_md5, masked <> text as changed from x"""
