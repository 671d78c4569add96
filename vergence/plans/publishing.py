"""Publishing every document as an asset of its source: verdicts and the tables afterwards, with their SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vergence.functions import text
from vergence.operators import publish
from vergence.plans.more import query
from vergence.plans.sql import chunks, strip, terms
from vergence.sources import views
from vergence.sources.views import AS_OF, table

#: The kind of a document in each language; in any other it is a material.
KINDS = {"en": "document", "fr": "image", "es": "video"}
MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"


def publishing(spark: SparkSession, d: str) -> publish.State:
    """Documents as assets of their source: those of quality 1 have a published first version and, from 500 characters on, a revision."""
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    title = text.stripped(F.substring_index("text", "\n", 1))
    docs = views.spread(table(spark, d, "documents").select("doc_id", "source", "lang", "text")).join(labels, "doc_id", "left").withColumn("title", title)
    kind = F.lit("material")
    for lang, name in KINDS.items():
        kind = F.when(F.col("lang") == lang, name).otherwise(kind)
    old, live = F.lit("2024-01-01").cast("timestamp"), F.coalesce(F.col("quality") == 1, F.lit(False))
    none = F.lit(None).cast("timestamp")
    assets = docs.select(
        F.col("doc_id").alias("asset_id"), F.col("source").alias("product_id"), kind.alias("kind"), F.when(live, "published").when(F.col("quality").isNull(), "pending_review").otherwise("draft").alias("status"),
        F.when(live, F.col("doc_id") * 10 + 1).alias("current_version_id"), F.when(F.col("toxic") == 1, old).alias("discarded_at"), F.when(live, old).alias("verified_at"),
    )
    mail = F.regexp_extract("text", MAIL, 0)
    got = lambda v, abstained=F.lit(False): F.struct(v.alias("value"), abstained.alias("abstained"))
    said = lambda v: F.struct(v.alias("value"))
    extracted = F.create_map(F.lit("heading"), got(F.col("title"), F.col("title").rlike("[0-9]")), F.lit("lang"), got(F.col("lang")), F.lit("mail"), got(mail), F.lit(publish.TRANSCRIPT), got(F.col("text")))
    confirmed = F.create_map(F.lit("heading"), said(F.when(F.length("title") <= 60, F.col("title"))), F.lit("lang"), said(F.when(F.length("text") >= 300, F.col("lang"))), F.lit("mail"), said(mail), F.lit(publish.DESCRIPTION), said(F.when(F.length("title") <= 30, F.col("title"))))
    pairs = F.when(F.col("quality").isNull(), F.array(F.struct(F.col("title").alias("q"), F.coalesce("lang", F.lit("")).alias("a"))))
    first = F.struct(F.lit(1).alias("version_no"), F.when(live, old).otherwise(none).alias("published_at"), F.when(live, F.col("title")).otherwise(F.col("text")).alias("body"))
    second = F.struct(F.lit(2).alias("version_no"), none.alias("published_at"), F.col("text").alias("body"))
    numbered = docs.select("doc_id", pairs.alias("pairs"), extracted.alias("extracted"), confirmed.alias("confirmed"), F.explode(F.when(live & (F.length("text") >= 500), F.array(first, second)).otherwise(F.array(first))).alias("v"))
    versions = numbered.select((F.col("doc_id") * 10 + F.col("v.version_no")).alias("version_id"), F.col("doc_id").alias("asset_id"), "v.*", "pairs", "extracted", "confirmed")
    required = F.create_map(*[x for name, needed in (("heading", True), ("lang", True), ("mail", False)) for x in (F.lit(name), F.struct(F.lit(needed).alias("required")))])
    sources = docs.where("source is not null").groupBy(F.col("source").alias("product_id")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    entry = lambda name, owner: F.struct(F.lit(name).alias("field"), F.lit("old").alias("value"), owner.cast("long").alias("asset_id"), F.lit(1).alias("version_no"))
    values = sources.select("product_id", F.explode(F.array(entry("heading", F.col("high")), entry("lang", F.lit(-1)), entry("mail", F.col("low")), entry("note", F.col("low")), entry("size", F.col("high")))).alias("e")).select("product_id", "e.*")
    chunks_ = docs.where(live).select("doc_id", F.posexplode(text.document_chunks(F.col("title"))).alias("seq", "chunk"))
    gaps = table(spark, d, "part").select(F.col("p_partkey").alias("gap_id"), F.col("p_name").alias("question"), F.col("p_partkey").alias("asset_id"), F.lit("open").alias("status"), none.alias("resolved_at"))
    audit = docs.where(live).select(F.col("doc_id").alias("asset_id"), F.lit(1).alias("version_no"), F.lit("publish").alias("action"), old.alias("at"))
    return {"assets": assets, "versions": versions, "products": sources.select("product_id", required.alias("schema")), "chunks": chunks_.select(F.col("doc_id").alias("asset_id"), F.lit(1).alias("version_no"), "seq", "chunk"), "values": values, "audit": audit, "gaps": gaps}


def _decided(spark: SparkSession, d: str) -> tuple[publish.State, DataFrame]:
    """All documents are asked for, and customers by numbers below zero, which no asset has."""
    state = publishing(spark, d)
    asked = state["assets"].select("asset_id").unionByName(table(spark, d, "customer").select((-1 - F.col("c_custkey")).alias("asset_id")))
    return state, publish.verdicts(state, asked)


def _written(rows: DataFrame) -> DataFrame:
    """A table in the folder that the session names; a local one is set only where it names none."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(rows.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-"))
    path = f"{context.getCheckpointDir()}/verdicts-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _after(spark: SparkSession, d: str, *names: str) -> tuple[DataFrame, ...]:
    state, decided = _decided(spark, d)
    after = publish.published(state, _written(decided) if "gaps" in names else decided, AS_OF)  # gaps need every table of the next state, and each reads the verdicts
    return tuple(after[name] for name in names)


KIND = "case lang " + " ".join(f"when '{k}' then '{v}'" for k, v in KINDS.items()) + " else 'material' end"
CONFIRMED = {"heading": "case when length(title) <= 60 and trim(title) <> '' then title end", "lang": "case when length(text) >= 300 and trim(lang) <> '' then lang end", "mail": f"nullif(regexp_extract(text, '{MAIL}'), '')"}
BASE = f"""docs as (select d.doc_id, source, lang, text, {strip("string_split(text, chr(10))[1]")} as title, quality, toxic, coalesce(quality = 1, false) as live, {KIND} as kind
        from documents d left join (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by doc_id) using (doc_id)),
    seen as (select *, {", ".join(f"{v} as c_{k}" for k, v in CONFIRMED.items())}, not regexp_matches(title, '[0-9]') and trim(title) <> '' as m_heading, coalesce(trim(lang) <> '', false) as m_lang,
        kind = 'document' and source is not null as gated, case when live and length(text) >= 500 then 2 else 1 end as version_no from docs),
    gate as (select *, case when gated and c_heading is null and not m_heading then 'heading;' else '' end || case when gated and c_lang is null and not m_lang then 'lang;' else '' end as missing,
        case when gated and c_heading is null and m_heading then 'heading;' else '' end || case when gated and c_lang is null and m_lang then 'lang;' else '' end as unconfirmed from seen),
    decided as (select *, case when (live and version_no = 1) or coalesce(toxic = 1, false) or quality = 0 then 'state' when missing || unconfirmed <> '' then 'gate' when text is null and kind not in ('image', 'video') then 'unreadable' else 'published' end as verdict from gate),
    done as (select *, case kind when 'image' then case when length(title) <= 30 and trim(title) <> '' then title else '' end else text end as body from decided where verdict = 'published'),
    filed as (select doc_id, list_concat(case when quality is null then ['问：' || title || ' 答：' || coalesce(lang, '')] else [] end, {chunks("body")}, list_filter([{", ".join(f"'{k}：' || c_{k}" for k in CONFIRMED)}, case when kind <> 'image' and length(title) <= 30 and trim(title) <> '' then '{publish.DESCRIPTION}：' || title end], lambda x: x is not null)) as c, version_no from done),
    fresh as (select doc_id as asset_id, version_no, unnest(range(0, len(c))) as seq, unnest(c) as chunk from filed),
    held as (select doc_id as asset_id, 1 as version_no, unnest(range(0, len(c))) as seq, unnest(c) as chunk from (select doc_id, {chunks("title")} as c from docs where live))"""


@query(f"with {BASE} select doc_id as asset_id, verdict, missing, unconfirmed from decided union all select -1 - c_custkey, 'missing', '', '' from customer")
def publish_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each asset that is asked for, with the fields that hold it up."""
    joined = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: F.concat(x, F.lit(";"))), "").alias(c)
    return _decided(spark, d)[1].select("asset_id", "verdict", joined("missing"), joined("unconfirmed"))


@query(f"""with {BASE} select doc_id as asset_id, case when verdict = 'published' or live then 'published' when quality is null then 'pending_review' else 'draft' end as status,
    case when verdict = 'published' then version_no when live then 1 end as live_version, (verdict = 'published')::int + live::int as n_published, (verdict = 'published')::int + live::int as n_audit from decided""")
def publish_states(spark: SparkSession, d: str) -> DataFrame:
    """Status and live version of each asset afterwards, its published versions and its lines of audit."""
    assets, versions, audit = _after(spark, d, "assets", "versions", "audit")
    of = versions.groupBy("asset_id").agg(F.count("published_at").alias("n_published"))
    lines = audit.groupBy("asset_id").agg(F.count("*").alias("n_audit"))
    pointed = versions.select(F.col("version_id").alias("current_version_id"), F.col("version_no").alias("live_version"))
    return assets.join(pointed, "current_version_id", "left").join(of, "asset_id", "left").join(lines, "asset_id", "left").select("asset_id", "status", "live_version", F.coalesce("n_published", F.lit(0)).alias("n_published"), F.coalesce("n_audit", F.lit(0)).alias("n_audit"))


@query(f"with {BASE} select asset_id, version_no, seq, md5(chunk) as chunk_md5 from fresh union all select asset_id, version_no, seq, md5(chunk) from held")
def publish_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The index afterwards: pairs, chunks and confirmed fields of what was published, with the chunks of older versions."""
    return _after(spark, d, "chunks")[0].select("asset_id", "version_no", "seq", F.md5("chunk").alias("chunk_md5"))


@query(f"""with {BASE}, written as (select source, field, max(doc_id) as asset_id, arg_max(value, doc_id) as value, arg_max(version_no, doc_id) as version_no
        from (select source, doc_id, version_no, unnest([{", ".join(f"'{k}'" for k in CONFIRMED)}]) as field, unnest([{", ".join(f"c_{k}" for k in CONFIRMED)}]) as value from done where source is not null) where value is not null group by 1, 2),
    bounds as (select source, min(doc_id) as low, max(doc_id) as high from docs where source is not null group by source),
    before as (select source, unnest(['heading', 'lang', 'mail', 'note', 'size']) as field, unnest([high, -1, low, low, high]) as asset_id from bounds),
    stays as (select * from before b where asset_id not in (select doc_id from done) and not exists (select 1 from written w where w.source = b.source and w.field = b.field))
    select source as product_id, field, md5(value) as value_md5, asset_id, version_no from written union all select source, field, md5('old'), asset_id, 1 from stays""")
def publish_values(spark: SparkSession, d: str) -> DataFrame:
    """The products' values afterwards, with the asset and version that each is from."""
    return _after(spark, d, "values")[0].select("product_id", "field", F.md5("value").alias("value_md5"), "asset_id", "version_no")


@query(f"""with {BASE}, shown as (select chunk from fresh union all select chunk from held where asset_id in (select doc_id from decided where live and verdict <> 'published' and coalesce(toxic, 0) <> 1)),
    corpus as (select distinct unnest({terms("chunk")}) as term from shown),
    met as (select distinct p_partkey from (select p_partkey, unnest({terms("p_name")}) as term from part where p_partkey in (select doc_id from done)) where term in (select term from corpus))
    select p_partkey as gap_id, case when p_partkey in (select p_partkey from met) then 'resolved' else 'open' end as status from part""")
def publish_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Gaps whose asset was published are resolved if a live chunk answers them."""
    return _after(spark, d, "gaps")[0].select("gap_id", "status")
