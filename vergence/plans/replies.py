"""Answers cleaned of disclaimers, over lines of all documents written in the words of the rules, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vergence.operators import answers, routing
from vergence.plans.more import query
from vergence.sources import views
from vergence.sources.views import table

#: Words of so many letters become these, longer ones first; blanks go.
SPELLED = (("[A-Za-z]{9,}", "。"), ("[A-Za-z]{8}", "水"), ("[A-Za-z]{7}", "；"), ("[A-Za-z]{6}", "[1]"), ("[A-Za-z]{5}", "价格"), ("[A-Za-z]{4}", "无法提供"), ("[A-Za-z]{3}", "未覆盖"), ("[A-Za-z]{2}", "证据"), (" ", ""))
_SPELLED = reduce(lambda x, rule: f"regexp_replace({x}, '{rule[0]}', '{rule[1]}', 'g')", SPELLED, "line")
_WORDS = f"regexp_replace(regexp_replace(x, '{answers.CITATION}', '', 'g'), '{answers.NO_WORD}', '', 'g')"


@query(f"""with l as (select doc_id, unnest(l) as line, unnest(range(0, len(l))) as pos from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null)),
    a as (select doc_id, pos, {_SPELLED} as answer from l), s as (select doc_id, pos, regexp_extract_all(answer, '{routing.SENTENCE}') as s from a),
    k as (select doc_id, pos, s, regexp_replace(coalesce(array_to_string(list_filter(s, lambda x: not regexp_matches(x, '{routing.DISCLAIMER}') and not regexp_full_match({_WORDS}, '{answers.BARE}')), ''), ''), '^\\s+|\\s+$', '', 'g') as kept,
        len(list_filter(s, lambda x: not regexp_matches(x, '{routing.DISCLAIMER}') and not regexp_matches({_WORDS}, '^(?:{answers.BARE})') and regexp_matches(regexp_replace(x, '{answers.CITATION}', '', 'g'), '{answers.SUBSTANCE}'))) > 0 as closes from s),
    v as (select *, case when regexp_matches(regexp_replace(kept, '{answers.CITATION}', '', 'g'), '{answers.SUBSTANCE}') then kept else '' end as answer from k)
    select doc_id, count(*) as n, count(*) filter (answer = '') as refused, count(*) filter (closes) as closing, md5(string_agg(answer, '|' order by pos)) as answers_md5 from v group by doc_id""")
def cleaned_answers(spark: SparkSession, d: str) -> DataFrame:
    """For each document how many of its lines, read as answers, are refusals or close a gap, and what is left of them."""
    docs = views.spread(table(spark, d, "documents").where("text is not null").select("doc_id", "text"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    answer = reduce(lambda c, rule: F.regexp_replace(c, *rule), SPELLED, F.col("line"))
    spelled = lines.select("doc_id", "pos", answer.alias("answer"))
    read = spelled.select("doc_id", "pos", answers.without_disclaimers(F.col("answer")).alias("kept"), answers.closes_gap(F.col("answer")).alias("closes"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("pos", "kept"))), lambda x: x["kept"])
    return read.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("kept") == "").alias("refused"), F.count_if("closes").alias("closing"), F.md5(F.array_join(whole, "|")).alias("answers_md5"))
