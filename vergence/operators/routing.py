"""Routing of questions: what they name, whether anything is left besides it, and which answer they get."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vergence.functions import labels
from vergence.functions.text import longest_common, normalised, price_label, terms

# Words that a question about stock has besides what it asks for; longer ones go first.
STOCK_FILLER = (
    "有没有货", "没有货", "有没有", "有货", "没货", "无货", "缺货", "现货", "存货", "备货", "库存", "还有", "还剩", "卖完", "卖光", "没有", "没", "全", "售罄", "断货", "本书", "这", "那", "本", "个", "台", "多",
    "一台", "一本", "一部", "一个", "一包", "一盒", "一件", "一套", "一杯", "一双", "你们", "咱们", "本店", "小店", "店铺", "店里", "门店", "请问", "当前", "现在", "目前", "商品", "产品", "这种", "这类",
    "剩", "有", "货", "一下", "都", "还", "在", "上", "卖", "进", "的", "了", "吗", "么", "呢", "啊", "吧", "、", "，", "？", "?", "！", "!", "。", " ", "　",
)
# Least shared characters of a product's name, least length and share of a name inside an entity.
LEAST_SHARED, LEAST_NAME, LEAST_SHARE = 2, 3, 0.6
# Sentences that only say that the evidence doesn't cover the question, and where sentences end.
DISCLAIMER = (
    "(证据|资料|文档|资产)[^。；]{0,12}(未覆盖|未涉及|未包含|不包含|未提供|未收录|尚未收录|未说明|未提到|未给出|未列明|中(都)?没有|没有提及|没有提供|没有说明)"
    "|无法(回答|提供|确认|给出)(该|这个|此)?(问题|价格|答案|信息)"
)
SENTENCE = "[^。；！？\\n]+[。；！？]?"
# What a question about a price has besides what it asks for, in this order, the order in which they are tried.
PRICE_FILLER = (
    "多少钱|钱|贵不贵|贵|花多少|怎么样|咋样|价格|售价|定价|报价|收费|便宜|请问|问一下|多少|多钱|什么|怎么|怎样|如何|你好|您好|想问|我想|麻烦|问下|一下|下|价|帮|我|查|"
    "这个|这款|这件|你们|咱们|的|是|要|买|卖|款|啥|咋|这|那|个|台|一[台本部个包盒件套杯双]|[的吗呢啊嘛呀吧呗哦噢啦]|、|，|？|\\?|！|!|。| |　"
)
#: Categories up to which they are held as one array for all questions.
MOST_CATEGORIES = 10_000


def filler_pattern() -> str:
    special = "?!.()[]|"
    return "|".join("".join(f"\\{c}" if c in special else c for c in w) for w in sorted(STOCK_FILLER, key=len, reverse=True))


def stock_residual(question: Column, token: Column) -> Column:
    """What is left of a question about stock without what it names and without filler; nothing is left of a pure one."""
    return F.trim(F.regexp_replace(F.replace(question, token, F.lit("")), filler_pattern(), ""))


def stock_product_residual(question: Column, name: Column) -> Column:
    """As stock_residual(), for the piece of a product's name that the question has, if it is long enough."""
    piece = longest_common(question, name)
    return stock_residual(question, F.when(F.length(piece) >= LEAST_SHARED, piece).otherwise(F.lit("\x00")))


def price_residual(question: Column, token: Column) -> Column:
    """What is left of a question about a price without what it names and without filler; only a pure one is quoted."""
    return F.trim(F.regexp_replace(F.replace(question, token, F.lit("")), PRICE_FILLER, ""))


def price_product_residual(question: Column, name: Column) -> Column:
    """As price_residual(), for the piece of a product's name that the question has, if it is long enough."""
    piece = longest_common(question, name)
    return price_residual(question, F.when(F.length(piece) >= LEAST_SHARED, piece).otherwise(F.lit("\x00")))


def category_array(products: DataFrame) -> Column:
    """All categories as a constant array; a category table is small, and no more than its checked size is collected."""
    found = [r[0] for r in products.where("category is not null").select("category").distinct().limit(MOST_CATEGORIES + 1).collect()]
    if len(found) > MOST_CATEGORIES:
        raise ValueError(f"more than {MOST_CATEGORIES} categories")
    return F.array(*map(F.lit, sorted(found))) if found else F.array().cast("array<string>")


def names_or_is_named(entity: Column, name: Column) -> Column:
    """The entity is part of the name, or holds one of three characters or more that makes up most of it."""
    e, n = normalised(entity), normalised(name)
    inside = (F.length(n) >= LEAST_NAME) & F.contains(e, n) & (F.length(n) / F.length(e) >= LEAST_SHARE)
    return (e != "") & (n != "") & (F.contains(n, e) | inside)


def matched_category(entity: Column, categories: Column) -> Column:
    """The longest category, of equals the first by name, that the entity and it hold one another."""
    met = F.filter(categories, lambda c: names_or_is_named(entity, c))
    return F.get(F.transform(F.array_sort(F.transform(met, lambda c: F.struct((-F.length(c)).alias("n"), c.alias("c")))), lambda x: x["c"]), F.lit(0))


def named_categories(question: Column, categories: Column) -> Column:
    """The categories that the question names, the longest first, without those inside another one named."""
    met = F.filter(categories, lambda c: F.contains(question, c))
    whole = F.filter(met, lambda c: ~F.exists(met, lambda o: (o != c) & F.contains(o, c)))
    return F.transform(F.array_sort(F.transform(whole, lambda c: F.struct((-F.length(c)).alias("n"), c.alias("c")))), lambda x: x["c"])


def shared_pieces(questions: DataFrame, names: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """(query_id, product_id, shared): for each question the name with the longest piece in common, the least id of equals.

    Names meet questions where they share a piece of `least` characters; only those are compared."""
    pieces = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (least - 1)), lambda i: F.substring(c, i, F.lit(least)))))
    asked = questions.where(F.length("question") >= least).select("query_id", pieces(F.col("question")).alias("piece"))
    named = names.where(F.length("name") >= least).select("product_id", pieces(F.col("name")).alias("piece"))
    pairs = asked.join(named, "piece").select("query_id", "product_id").distinct()
    met = pairs.join(questions.select("query_id", "question"), "query_id").join(names.select("product_id", "name"), "product_id")
    sized = met.select("query_id", "product_id", F.length(longest_common(F.col("name"), F.col("question"))).alias("shared"))
    order = W.partitionBy("query_id").orderBy(F.desc("shared"), "product_id")
    return sized.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def supported(brand: Column, title: Column, least: int = 4) -> Column:
    """A word of the brand is one of the title's, or shares a piece of four characters with one."""
    return F.exists(terms(brand), lambda b: F.exists(terms(title), lambda t: (b == t) | (F.length(longest_common(b, t)) >= least)))


def without_disclaimers(answer: Column) -> Column:
    """The answer without sentences that only say what the evidence lacks."""
    kept = F.filter(F.regexp_extract_all(answer, F.lit(SENTENCE), F.lit(0)), lambda s: ~s.rlike(DISCLAIMER))
    return F.trim(F.array_join(kept, ""))


def route(question: Column, known: Column) -> Column:
    """Which path a question takes: a human, a return, the catalog, the shop's scope, or the evidence."""
    intent = labels.catalog_intent(question)
    return (
        F.when(question.rlike("人工|真人|转客服"), "handoff").when(labels.wants_return(question), "return").when(question.rlike("(?i)SO-\\d+"), "order").when(intent.isNotNull(), intent)
        .when(labels.scope_kind(question, known) == "out_of_scope", "out_of_scope").otherwise("retrieve")
    )


def stock_answers(questions: DataFrame, products: DataFrame, categories: Column) -> DataFrame:
    """(query_id, kind, answer): by category first, then by product, where nothing else is asked; others have neither.

    questions (query_id, question, product_id, name) name their product, if any."""
    asked = questions.withColumn("category", F.get(named_categories(F.col("question"), categories), F.lit(0))).withColumn("about_stock", F.col("question").rlike("货|库存"))
    pure = F.coalesce(stock_residual(F.col("question"), F.col("category")) == "", F.lit(False))
    totals = products.groupBy("category").agg(F.count("*").alias("total"), F.count_if(F.col("stock") > 0).alias("filled"))
    own = products.select(F.col("id").alias("product_id"), F.col("stock").alias("own_stock"))
    met = asked.withColumn("pure", pure).join(totals, "category", "left").join(own, "product_id", "left")
    alone = (stock_product_residual(F.col("question"), F.col("name")) == "") & F.contains("question", F.col("name"))
    kind = F.when(F.col("about_stock") & F.col("pure"), "category").when(F.col("about_stock") & alone & F.col("own_stock").isNotNull(), "product").otherwise("none")
    text = F.when(kind == "category", F.concat("category", F.lit("："), F.col("filled").cast("string"), F.lit("/"), F.col("total").cast("string"))).when(
        kind == "product", F.when(F.col("own_stock") > 0, F.concat("name", F.lit("有货，当前库存 "), F.col("own_stock").cast("string"), F.lit(" 件。"))).otherwise(F.concat("name", F.lit("暂时无货。"))))
    return met.select("query_id", kind.alias("kind"), text.alias("answer"))


def quotes(questions: DataFrame, products: DataFrame, categories: Column) -> DataFrame:
    """(query_id, kind, quote): for questions about a price, of a category the span of its prices in one currency, else the product's price.

    Both only where nothing else is asked: what is left without the name and words of price is a
    question about a service, which has no quote.  questions (query_id, question, product_id,
    name) bring the product that they match, by a piece of its name."""
    asked = questions.where(F.coalesce(labels.catalog_intent(F.col("question")) == "price", F.lit(False)))
    pure = F.filter(named_categories(F.col("question"), categories), lambda c: price_residual(F.col("question"), c) == "")
    asked = asked.withColumn("category", F.get(pure, F.lit(0)))
    spans = products.where("price_cents is not null").groupBy("category").agg(F.min("price_cents").alias("low"), F.max("price_cents").alias("high"), F.count_distinct("currency").alias("currencies"), F.min("currency").alias("of"))
    own = products.select(F.col("id").alias("product_id"), F.col("price_cents").alias("own"), F.col("currency").alias("own_currency"))
    met = asked.join(spans, "category", "left").join(own, "product_id", "left")
    span = F.when(F.col("currencies") == 1, F.concat(price_label(F.col("low"), F.col("of")), F.lit("–"), price_label(F.col("high"), F.col("of"))))
    alone = F.coalesce((price_product_residual(F.col("question"), F.col("name")) == "") & F.col("own").isNotNull(), F.lit(False))
    return met.select("query_id", F.when(span.isNotNull(), "category").when(alone, "product").otherwise("none").alias("kind"), F.coalesce(span, F.when(alone, price_label(F.col("own"), F.col("own_currency")))).alias("quote"))
