"""What a product's film can show, and its timeline: each spoken line holds one picture for as long as it takes to say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vergence.functions import fields, text
from vergence.operators.publish import DESCRIPTION, TRANSCRIPT

# How many clips, images and lines each template takes.
QUOTAS = {"highlight": {"clip": 6, "image": 3, "text": 2}, "product_intro": {"clip": 3, "image": 3, "text": 4}}
# Fixed values, in milliseconds: least and greatest length of a film and of each kind of entry, an image's own length, and the longest hold at the end.
LEAST, MOST, HOLD, IMAGE = 15000, 60000, 4000, 4000
CLIP_SPAN, IMAGE_SPAN, TEXT_SPAN, CARD_SPAN = (3000, 8000), (2500, 6000), (2000, 6000), (2000, 5000)
# Lines of a material that count, the two cards, the name of a product without one, and notes.
LINES, HOOK, CTA, NAMELESS = 4, ("", "，到底值不值？"), ("点击主页，把", "带回家"), "这件好物"
KIND_LABELS = {"text": "文案", "image": "图", "clip": "切片"}
CUT, UNIT, SHORT = "为控 60s 上限裁掉了 ", " 段", ("素材时长仅 ", "s，不足 15s 目标（切片不注水，补素材再合成更长成片）")
NO_CLIPS, NO_IMAGES = "没有已发布切片（高光集锦以切片为主），图/文案补足", "没有已发布商品图，画面以切片/文案卡推进"
PLAYABLE = r"(?i)\.mp4$"

_ENTRY = "struct<type:string,asset_id:bigint,dur:bigint,text:string,role:string>"


def _clamped(value: Column, low: int, high: Column | int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high) if isinstance(high, int) else high, value)).cast("long")


def _speech(line: Column) -> Column:
    """Milliseconds that it takes to say a line; blanks take none."""
    return F.round(fields.speech_seconds(F.regexp_replace(line, f"[{text.BLANKS}]", "")) * 1000).cast("long")


def manifest(products: DataFrame, assets: DataFrame, versions: DataFrame, template: str) -> DataFrame:
    """(product_id, name, clips, images, lines): of each product what a template takes of its live assets.

    Clips are playable videos with a transcript, those that name the product or a selling point first; images; and
    the first four filled lines of each material, in the order of ids.  Each is cut to the template's number by
    a rank that Spark limits before the shuffle, so that a product with any number of assets stays small.

    products (product_id, name, points: array); assets (asset_id, product_id, kind, status, discarded_at, current_version_id);
    versions (version_id, object_key, body, extracted, confirmed).  Both keys are unique; an asset of no product is left out."""
    live = assets.where("status = 'published' and discarded_at is null and kind in ('video', 'image', 'material') and product_id is not null")
    found = live.select("asset_id", "product_id", "kind", F.col("current_version_id").alias("version_id")).join(versions, "version_id")
    said = fields.resolved_value(F.col("extracted"), F.col("confirmed"), F.lit(TRANSCRIPT))
    lines = F.slice(F.filter(F.transform(F.split("body", text.LINE_ENDS), text.stripped), lambda x: x != ""), 1, LINES)
    one = lambda slot, value: F.array(F.struct(F.lit(slot).alias("slot"), F.lit(0).alias("line"), value.alias("text")))
    parts = (
        F.when((F.col("kind") == "video") & F.col("object_key").rlike(PLAYABLE) & said.isNotNull(), one("clip", said))
        .when(F.col("kind") == "image", one("image", F.coalesce(fields.resolved_value(F.col("extracted"), F.col("confirmed"), F.lit(DESCRIPTION)), F.lit(""))))
        .when(F.col("kind") == "material", F.transform(lines, lambda x, i: F.struct(F.lit("text").alias("slot"), i.alias("line"), x.alias("text"))))
    )
    named = products.select("product_id", F.filter(F.concat(F.array(F.col("name")), F.coalesce("points", F.array().cast("array<string>"))), lambda w: w != "").alias("_words"))
    rows = found.select("product_id", "asset_id", F.explode(parts).alias("p")).select("product_id", "asset_id", "p.*").join(named, "product_id")
    rank = F.when((F.col("slot") == "clip") & F.exists("_words", lambda w: F.contains(F.col("text"), w)), 0).otherwise(1)
    quota = F.lit(max(QUOTAS[template].values()))
    place = F.row_number().over(W.partitionBy("product_id", "slot").orderBy("_rank", "asset_id", "line"))
    ranked = rows.withColumn("_rank", rank).drop("_words").withColumn("place", place).where(F.col("place") <= quota)
    kept = ranked.where(" or ".join(f"slot = '{slot}' and place <= {n}" for slot, n in QUOTAS[template].items()))
    sets = kept.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("slot", "place", "asset_id", "text"))).alias("_all"))
    of = lambda slot: F.coalesce(F.filter("_all", lambda x: x["slot"] == slot), F.array().cast("array<struct<slot:string,place:int,asset_id:bigint,text:string>>"))
    return products.join(sets, "product_id", "left").select("product_id", "name", of("clip").alias("clips"), of("image").alias("images"), of("text").alias("lines"))


def _entry(kind: Column | str, asset: Column, dur: Column, said: Column, role: str | None = None) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("type"), asset.cast("long").alias("asset_id"), dur.alias("dur"), said.alias("text"), F.lit(role).cast("string").alias("role"))


def timelines(found: DataFrame, template: str) -> DataFrame:
    """(product_id, entries, duration, note): of a manifest the entries in order with start and dur in milliseconds.

    Lines take the pictures in turn, clips first for highlights, clips and images by turns for an introduction; without one left
    they are shown as text; pictures left over follow without words.  Over 60 s entries go from the end, but for the two
    cards; under 15 s the last card is held, for 4 s at most.  Without any material entries and duration are null."""
    none = F.array().cast("array<struct<type:string,asset_id:bigint,base:bigint>>")
    clips = F.transform("clips", lambda c: F.struct(F.lit("clip").alias("type"), c["asset_id"].alias("asset_id"), _clamped(_speech(c["text"]), *CLIP_SPAN).alias("base")))
    images = F.transform("images", lambda i: F.struct(F.lit("image").alias("type"), i["asset_id"].alias("asset_id"), F.lit(IMAGE).cast("long").alias("base")))
    turns = F.sequence(F.lit(0), F.greatest(F.size("_clips"), F.size("_images")))
    by_turns = F.flatten(F.transform(turns, lambda i: F.filter(F.array(F.get("_clips", i), F.get("_images", i)), lambda x: x.isNotNull())))
    pool = F.concat("_clips", "_images") if template == "highlight" else by_turns
    rows = found.withColumns({"_clips": F.coalesce(clips, none), "_images": F.coalesce(images, none), "_lines": F.filter("lines", lambda x: text.stripped(x["text"]) != "")}).withColumn("_pool", pool)

    def spoken(line: Column, i: Column) -> Column:
        shown, length = F.get("_pool", i), _speech(line["text"])
        clip = _clamped(length, CLIP_SPAN[0], F.least(F.lit(CLIP_SPAN[1]), shown["base"]))
        dur = F.when(shown["type"] == "clip", clip).when(shown["type"] == "image", _clamped(length, *IMAGE_SPAN)).otherwise(_clamped(length, *TEXT_SPAN))
        return _entry(F.coalesce(shown["type"], F.lit("text")), shown["asset_id"], dur, line["text"])

    silent = lambda x: _entry(x["type"], x["asset_id"], F.when(x["type"] == "clip", _clamped(x["base"], *CLIP_SPAN)).otherwise(_clamped(x["base"], *IMAGE_SPAN)), F.lit(None).cast("string"))
    left = F.slice("_pool", F.size("_lines") + 1, F.greatest(F.size("_pool") - F.size("_lines"), F.lit(0)))
    name = F.coalesce(fields.filled(text.stripped(F.col("name"))), F.lit(NAMELESS))
    card = lambda words, role: _entry("text", F.lit(None), _clamped(_speech(F.concat(F.lit(words[0]), name, F.lit(words[1]))), *CARD_SPAN), F.concat(F.lit(words[0]), name, F.lit(words[1])), role)
    opening = F.array(card(HOOK, "hook")) if template == "product_intro" else F.array().cast(f"array<{_ENTRY}>")
    total = lambda entries: F.aggregate(entries, F.lit(0).cast("long"), lambda acc, x: acc + x["dur"])
    rows = rows.withColumns({"_middle": F.concat(F.transform("_lines", spoken), F.transform(left, silent)), "_hook": opening, "_cta": card(CTA, "cta")})
    fits = lambda _, i: total(F.slice("_middle", 1, i + 1)) + total("_hook") + F.col("_cta.dur") <= MOST
    rows = rows.withColumn("_kept", F.filter("_middle", fits)).withColumn("_sum", total("_kept") + total("_hook") + F.col("_cta.dur"))
    hold = F.greatest(F.lit(0), F.least(F.lit(HOLD), LEAST - F.col("_sum"))).cast("long")
    last = F.array(_entry("text", F.lit(None), F.col("_cta.dur") + hold, F.col("_cta.text"), "cta"))
    rows = rows.withColumn("_entries", F.concat("_hook", "_kept", last)).withColumn("duration", F.col("_sum") + hold)

    cut = F.slice("_middle", F.size("_kept") + 1, F.size("_middle") - F.size("_kept"))
    of_kind = lambda kind: F.size(F.filter(cut, lambda x: x["type"] == kind))
    parts = [F.when(of_kind(kind) > 0, F.concat(of_kind(kind).cast("string"), F.lit(UNIT + label))) for kind, label in KIND_LABELS.items()]
    notes = [
        F.when(F.size("_middle") > F.size("_kept"), F.concat(F.lit(CUT), F.concat_ws("、", *parts))),
        F.when(F.col("duration") < LEAST, F.concat(F.lit(SHORT[0]), F.bround(F.col("duration") / 1000).cast("long").cast("string"), F.lit(SHORT[1]))),
        F.when(F.size("_clips") == 0, NO_CLIPS) if template == "highlight" else F.when(F.size("_images") == 0, NO_IMAGES),
    ]
    starts = F.transform("_entries", lambda x, i: F.struct(x["type"].alias("type"), x["asset_id"].alias("asset_id"), F.aggregate(F.slice("_entries", 1, i), F.lit(0).cast("long"), lambda acc, y: acc + y["dur"]).alias("start"), x["dur"].alias("dur"), x["text"].alias("text"), x["role"].alias("role")))
    some = (F.size("_clips") > 0) | (F.size("_images") > 0) | (F.size("lines") > 0)
    note = F.concat_ws("；", *notes)
    return rows.select("product_id", F.when(some, starts).alias("entries"), F.when(some, F.col("duration")).alias("duration"), F.when(some & (note != ""), note).alias("note"))
