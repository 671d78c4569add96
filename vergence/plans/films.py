"""Manifests and timelines of films, over documents of a source and turns of a conversation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vergence.functions import text
from vergence.operators import timeline
from vergence.operators.publish import DESCRIPTION, TRANSCRIPT
from vergence.plans.more import query
from vergence.plans.sql import ENDS, strip
from vergence.sources.views import table


def _model(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Products, assets and versions: each source with its documents, each conversation with its turns."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("asset_id"), F.col("source").alias("product_id"), F.when(F.col("lang") == "en", "material").when(F.col("lang") == "fr", "image").otherwise("video").alias("kind"), "text")
    turns = table(spark, d, "conversations").select(
        (-1 - F.col("conv_id") * 1000 - F.col("turn")).alias("asset_id"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("product_id"),
        F.when(F.col("role") == "user", "material").when(F.contains("text", F.lit(",")), "video").otherwise("image").alias("kind"), "text",
    )
    every = docs.unionByName(turns)
    words = F.split(text.stripped(F.substring("text", 1, 200)), " ")
    opening = table(spark, d, "conversations").where("turn = 0").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("product_id"), words.alias("w"))
    talks = opening.select("product_id", F.coalesce(F.get("w", F.lit(0)), F.lit("")).alias("name"), F.array(F.coalesce(F.get("w", F.lit(1)), F.lit(""))).alias("points"))
    sources = docs.where("product_id is not null").select("product_id").distinct().select("product_id", F.col("product_id").alias("name"), F.array(F.lit("que"), F.lit("")).alias("points"))
    status = F.when(F.length("text") > 20, "published").otherwise("draft")
    assets = every.select("asset_id", "product_id", "kind", status.alias("status"), F.when(F.contains("text", F.lit("|")), "2024-01-01").alias("discarded_at"), F.col("asset_id").alias("current_version_id"))
    got, none = F.struct(F.col("text").alias("value"), F.contains("text", F.lit("?")).alias("abstained")), F.struct(F.lit("").alias("value"))
    versions = every.select(F.col("asset_id").alias("version_id"), F.when(F.length("text") < 2000, "a.mp4").otherwise("a.txt").alias("object_key"), F.col("text").alias("body"), F.create_map(F.lit(TRANSCRIPT), got).alias("extracted"), F.create_map(F.lit(DESCRIPTION), none).alias("confirmed"))
    return sources.unionByName(talks), assets, versions


def _found(spark: SparkSession, d: str, template: str) -> DataFrame:
    return timeline.timelines(timeline.manifest(*_model(spark, d), template), template)


HIGHLIGHT, INTRO = timeline.QUOTAS["highlight"], timeline.QUOTAS["product_intro"]
WORDS = f"string_split({strip('substring(text, 1, 200)')}, ' ')"
SPEECH = lambda x: f"greatest(cast(round(length(regexp_replace({x}, '[ \\t\\r\\n\\x{{b}}\\f\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{2000}}-\\x{{2003}}\\x{{2009}}\\x{{2028}}\\x{{2029}}\\x{{3000}}]', '', 'g')) * 1000 / 4.5) as bigint), 1500)"
CLAMP = lambda x, low, high: f"greatest({low}, least({high}, {x}))"


def _sql(template: str) -> str:
    """Entries as rows: pictures and lines are numbered and joined by number, and a running sum decides what stays."""
    quota, cards = timeline.QUOTAS[template], template == "product_intro"
    order = "kind_no, place" if template == "highlight" else "place, kind_no"
    hook = f"{CLAMP(SPEECH(repr(timeline.HOOK[0]) + ' || shown || ' + repr(timeline.HOOK[1])), 2000, 5000)}" if cards else "0"
    return f"""with every as (select doc_id as asset_id, source as product_id, case lang when 'en' then 'material' when 'fr' then 'image' else 'video' end as kind, text from documents
            union all select -1 - conv_id * 1000 - turn, 'c' || conv_id, case when role = 'user' then 'material' when contains(text, ',') then 'video' else 'image' end, text from conversations),
        products as (select distinct source as product_id, source as name, 'que' as point from documents where source is not null union all select 'c' || conv_id, coalesce({WORDS}[1], ''), coalesce({WORDS}[2], '') from conversations where turn = 0),
        live as (select e.*, name, point from every e join products using (product_id) where length(text) > 20 and not contains(text, '|')),
        parts as (select product_id, asset_id, 'clip' as slot, 0 as line, text, case when (name <> '' and contains(text, name)) or (point <> '' and contains(text, point)) then 0 else 1 end as first from live where kind = 'video' and length(text) < 2000 and not contains(text, '?') and trim(text) <> ''
            union all select product_id, asset_id, 'image', 0, '', 1 from live where kind = 'image'
            union all select product_id, asset_id, 'text', unnest(range(0, len(ls))), unnest(ls), 1 from (select product_id, asset_id, list_filter(list_transform(regexp_split_to_array(text, '{ENDS}'), lambda l: {strip('l')}), lambda l: l <> '')[1:4] as ls from live where kind = 'material')),
        ranked as (select *, row_number() over (partition by product_id, slot order by first, asset_id, line) as place from parts),
        kept as (select * from ranked where {" or ".join(f"slot = '{s}' and place <= {n}" for s, n in quota.items())}),
        pool as (select *, row_number() over (partition by product_id order by {order}) as nth from (select *, case slot when 'clip' then 0 else 1 end as kind_no, case slot when 'clip' then {CLAMP(SPEECH('text'), 3000, 8000)} else 4000 end as base from kept where slot <> 'text')),
        middle as (select product_id, nth, coalesce(p.slot, 'text') as type, p.asset_id, case when l.text is null then base when p.slot = 'clip' then {CLAMP(SPEECH('l.text'), 3000, 'least(8000, base)')} when p.slot = 'image' then {CLAMP(SPEECH('l.text'), 2500, 6000)} else {CLAMP(SPEECH('l.text'), 2000, 6000)} end as dur, l.text
            from (select product_id, place as nth, text from kept where slot = 'text') l full join pool p using (product_id, nth)),
        named as (select product_id, case when {strip('name')} = '' then '{timeline.NAMELESS}' else {strip('name')} end as shown from products),
        cards as (select product_id, shown, {hook} as hook, {CLAMP(SPEECH(repr(timeline.CTA[0]) + ' || shown || ' + repr(timeline.CTA[1])), 2000, 5000)} as cta from named),
        run as (select m.*, hook, cta, sum(dur) over (partition by product_id order by nth) + hook + cta as upto from middle m join cards using (product_id)),
        sums as (select product_id, hook, cta, count(*) filter (upto <= 60000) as n, coalesce(sum(dur) filter (upto <= 60000), 0) + hook + cta as total, count(*) filter (upto > 60000 and type = 'text') as no_text, count(*) filter (upto > 60000 and type = 'image') as no_image, count(*) filter (upto > 60000 and type = 'clip') as no_clip,
            count(*) filter (type = 'clip') as clips, count(*) filter (type = 'image') as images from run group by 1, 2, 3),
        held as (select *, total + greatest(0, least(4000, 15000 - total)) as duration from sums)"""


def _entries(template: str) -> str:
    opening = f"union all select product_id, 0, 'text', null, hook, '{timeline.HOOK[0]}' || shown || '{timeline.HOOK[1]}', 'hook' from held join named using (product_id)" if template == "product_intro" else ""
    return f"""{_sql(template)}, lines as (select product_id, nth, type, asset_id, dur, text, null as role from run where upto <= 60000 {opening}
            union all select product_id, 1000, 'text', null, cta + duration - total, '{timeline.CTA[0]}' || shown || '{timeline.CTA[1]}', 'cta' from held join named using (product_id))
        select product_id, row_number() over w as place, type, asset_id, (sum(dur) over w - dur)::bigint as start, dur::bigint as dur, md5(text) as text_md5, role from lines window w as (partition by product_id order by nth)"""


def _totals(template: str) -> str:
    cut = f"""case when no_text + no_image + no_clip > 0 then '{timeline.CUT}' || array_to_string(list_filter([{", ".join(f"case when no_{k} > 0 then no_{k} || '{timeline.UNIT}{v}' end" for k, v in timeline.KIND_LABELS.items())}], lambda x: x is not null), '、') end"""
    short = f"case when duration < 15000 then '{timeline.SHORT[0]}' || round_even(duration / 1000, 0)::int || '{timeline.SHORT[1]}' end"
    lacking = f"case when clips = 0 then '{timeline.NO_CLIPS}' end" if template == "highlight" else f"case when images = 0 then '{timeline.NO_IMAGES}' end"
    seen = "least(clips, 1)" if template == "highlight" else "least(images, 1)"
    return f"""{_sql(template)}, noted as (select product_id, duration, nullif(array_to_string(list_filter([{cut}, {short}, {lacking}], lambda x: x is not null), '；'), '') as note, {seen} as seen from held)
        select product_id, n.duration::bigint as duration, n.note from products left join noted n using (product_id)"""


def _rows(found: DataFrame) -> DataFrame:
    each = found.select("product_id", F.posexplode_outer("entries").alias("i", "e")).where("e is not null")  # after the explosion, so that no filter plans the entries a second time
    return each.select("product_id", (F.col("i") + 1).alias("place"), "e.type", "e.asset_id", "e.start", "e.dur", F.md5("e.text").alias("text_md5"), "e.role")


@query(_entries("highlight"))
def film_highlights(spark: SparkSession, d: str) -> DataFrame:
    """The entries of each product's film of highlights."""
    return _rows(_found(spark, d, "highlight"))


@query(_entries("product_intro"))
def film_introductions(spark: SparkSession, d: str) -> DataFrame:
    """The entries of each product's introduction."""
    return _rows(_found(spark, d, "product_intro"))


@query(_totals("highlight"))
def film_notes(spark: SparkSession, d: str) -> DataFrame:
    """How long each film of highlights is, and what was cut or is lacking."""
    return _found(spark, d, "highlight").select("product_id", "duration", "note")


@query(_totals("product_intro"))
def film_introduction_notes(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, "product_intro").select("product_id", "duration", "note")
