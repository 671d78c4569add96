"""Extractors of product facts from text, and the cleaning of raw product rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vergence.functions.text import stripped

# Patterns of facts, words that are no material, and verbs before one.
NET_CONTENT = r"(?i)(\d+(?:\.\d+)?)\s*(ml|毫升|kg|千克|l|升|g|克)"
SHELF_LIFE, DATES = r"(\d+)\s*(个月|天|日|月|年)", r"(?:生产日期|出厂日期|生产批号|批号|日期)\s*[:：]?\s*\d+\s*年(?:\s*\d+\s*月)?(?:\s*\d+\s*日)?"
MATERIAL_VALUE, MATERIAL_BEFORE = r"材质\s*[:：为是]\s*([^\s，。,;；、()（）【】\[\]]{1,30})", r"([一-龥A-Za-z0-9]{1,12}?)材质"
NO_MATERIAL = ("标注", "未标注", "不详", "说明", "描述", "注明", "写明", "产品", "商品", "主要", "相关", "专用", "该", "本", "此", "其", "之", "的", "等", "各", "同")
MATERIAL_VERBS = "采用|选用|使用|选择"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def _joined(text: Column, pattern: str) -> Column:
    found = F.concat(F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2))
    return F.when(found != "", found)


def net_content(text: Column) -> Column:
    return _joined(text, NET_CONTENT)


def shelf_life(text: Column) -> Column:
    """The first span of time that is no date."""
    return _joined(F.regexp_replace(text, DATES, ""), SHELF_LIFE)


def material(text: Column) -> Column:
    """The value after the word, else what stands before it, without a verb; null where the text declines."""
    declined = lambda c: (c == "") | c.isin(*NO_MATERIAL) | c.rlike("^(?:" + "|".join(w for w in NO_MATERIAL if len(w) > 1) + ")")
    after = F.trim(F.regexp_extract(text, MATERIAL_VALUE, 1))
    before = F.regexp_replace(F.regexp_extract(text, MATERIAL_BEFORE, 1), f"^.*(?:{MATERIAL_VERBS})", "")
    before = F.trim(F.regexp_replace(before, "^[为是]+(?=.)", ""))
    return F.when(text.rlike(MATERIAL_VALUE), F.when(~declined(after), after)).when(~declined(before), before)


def facts(text: Column) -> Column:
    """Field name to (value, abstained)."""
    entry = lambda v: F.struct(v.alias("value"), v.isNull().alias("abstained"))
    return F.create_map(F.lit("净含量"), entry(net_content(text)), F.lit("保质期"), entry(shelf_life(text)), F.lit("材质"), entry(material(text)))


def unescaped(text: Column) -> Column:
    """The common entities and decimal character references read; `&amp;` last."""
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def clean_products(raw: DataFrame) -> DataFrame:
    """(code, name, quantity, brands, ingredients, countries) of raw rows with a numeric code, a name and a net content that can be read; of equal codes the first such row, in the order in which raw is read."""
    value = lambda c: unescaped(stripped(F.coalesce(c, F.lit(""))))
    rows = raw.select(F.monotonically_increasing_id().alias("_place"), value("code").alias("code"), F.substring(value("product_name"), 1, 200).alias("name"), value("quantity").alias("quantity"), value("brands").alias("brands"), value("ingredients_text").alias("ingredients"), value("countries_en").alias("countries"))
    kept = rows.where(F.col("code").rlike(r"^\d+$") & (F.col("name") != "") & net_content(F.col("quantity")).isNotNull())
    return kept.groupBy("code").agg(F.min_by(F.struct("name", "quantity", "brands", "ingredients", "countries"), "_place").alias("_first")).select("code", "_first.*")


def spec_text(row: dict[str, Column]) -> Column:
    """`field：value` lines of the fields that are there."""
    lines = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}："), v)) for k, v in row.items()]
    return F.concat_ws("\n", *lines)


def title_subject(title: Column) -> Column:
    """The part before ` · `, without a bracketed suffix."""
    return stripped(F.regexp_replace(F.substring_index(title, " · ", 1), r"(?:（[^（）]*）|\([^()]*\))\s*$", ""))


def joined_words(parts: Column) -> Column:
    """Texts in order, with a space only between two that are not Chinese there."""
    cjk = "[一-龥]"

    def add(acc: Column, part: Column) -> Column:
        space = ~acc.rlike(f"{cjk}$") & ~part.rlike(f"^{cjk}") & (acc != "")
        return F.concat(acc, F.when(space, " ").otherwise(""), part)

    return F.aggregate(parts, F.lit(""), add)


def pieces(text: Column, size: int = 12) -> Column:
    """The text in pieces of that many characters."""
    whole = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size)), lambda i: F.substring(text, (i * size + 1).cast("int"), F.lit(size)))
    return F.when(F.length(text) > 0, whole).otherwise(F.array().cast("array<string>"))
