"""Which product or category a question names, found in the whole catalog, and the prices and stocks that answer it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vergence.functions.text import price_label
from vergence.operators.routing import LEAST_SHARED, price_residual, stock_residual


def _pieces(names: DataFrame, size: int, step: int) -> DataFrame:
    """(piece, id): each piece of a name of `size`, `size` + `step`, ... characters once, with the least id of its names."""
    sized = names.where(F.length("name") >= size).select("id", "name", F.explode(F.sequence(F.lit(size), F.length("name"), F.lit(step))).alias("n"))
    placed = sized.select("id", "name", "n", F.explode(F.sequence(F.lit(1), F.length("name") - F.col("n") + 1)).alias("i"))
    return placed.select(F.substring("name", F.col("i"), F.col("n")).alias("piece"), "id").groupBy("piece").agg(F.min("id").alias("id"))


def matched_products(questions: DataFrame, products: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """(query_id, product_id, piece): the product whose name has the longest piece in common with the question.

    Of equals the least id wins, and of its pieces the first in the question; questions without a
    common piece of `least` characters are left out, as are null texts.  query_id is unique.

    No question is paired with a name.  From each place of a question the longest piece that any
    name has is searched by halving: a piece that some name has implies its shorter beginnings.
    Every step joins one piece a place with the table of pieces, in which each is there once, so
    that rows never multiply, however many names share a piece.  A row holds as many characters
    as the longest name; the steps are as many as its length has bits."""
    names = products.where("name is not null").select(F.col("id"), "name")
    longest = names.agg(F.max(F.length("name"))).first()[0] or 0
    asked = questions.where(F.length("question") >= least)
    places = asked.select("query_id", "question", F.explode(F.sequence(F.lit(1), F.length("question") - (least - 1))).alias("i"))
    found = places.select("query_id", "i", F.substring("question", F.col("i"), F.lit(max(longest, 1))).alias("tail"), F.lit(0).alias("n"), F.lit(None).cast("long").alias("id"))
    seeds = names.where(F.length("name") >= least).select(F.explode(F.sequence(F.lit(1), F.length("name") - (least - 1))).alias("i"), "name").select(F.substring("name", F.col("i"), F.lit(least)).alias("seed")).distinct()
    found = found.join(seeds, F.substring("tail", 1, least) == F.col("seed"), "left_semi")
    for bit in reversed(range(longest.bit_length())):
        size = 1 << bit
        met = _pieces(names, size, 2 * size).select("piece", F.col("id").alias("met"))
        more = F.col("n") + size
        wanted = F.when(F.length("tail") >= more, F.substring("tail", F.lit(1), more))
        found = found.withColumn("wanted", wanted).join(met, F.col("wanted") == F.col("piece"), "left")
        hit = F.col("met").isNotNull()
        found = found.select("query_id", "i", "tail", F.when(hit, more).otherwise(F.col("n")).alias("n"), F.when(hit, F.col("met")).otherwise(F.col("id")).alias("id"))
    best = found.where(F.col("n") >= least).groupBy("query_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "id", "i", F.substring("tail", F.lit(1), F.col("n")).alias("piece"))).alias("b"))
    return best.select("query_id", F.col("b.id").alias("product_id"), F.col("b.piece").alias("piece"))


def category_targets(products: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(token, category, place): what names a category, in the order in which it is tried.

    aliases (place, token, category) come first in their own order, if their category has
    products; then the categories themselves, the longest first, of equals by name."""
    own = products.where("category != ''").select("category").distinct()
    place = lambda kind, n, word: F.struct(F.lit(kind).alias("kind"), n.cast("long").alias("n"), word.alias("word")).alias("place")
    named = own.select(F.col("category").alias("token"), "category", place(1, -F.length("category"), F.col("category")))
    if aliases is None:
        return named
    known = aliases.where("token != ''").join(own, "category", "left_semi")
    return known.select("token", "category", place(0, F.col("place"), F.col("token"))).unionByName(named)


def matched_categories(questions: DataFrame, targets: DataFrame, residual) -> DataFrame:
    """(query_id, category): the first target in the question beside which nothing is left by `residual(question, token)`.

    Questions meet targets by equality of their pieces of the lengths that targets have."""
    lengths = sorted(r[0] for r in targets.select(F.length("token")).distinct().collect())  # no more than the longest token has characters
    sizes = F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")
    sized = questions.where("question is not null").select("query_id", "question", F.explode(sizes).alias("n")).where(F.length("question") >= F.col("n"))
    placed = sized.select("query_id", "question", "n", F.explode(F.sequence(F.lit(1), F.length("question") - F.col("n") + 1)).alias("i"))
    met = placed.select("query_id", "question", F.substring("question", F.col("i"), F.col("n")).alias("token")).join(targets, "token")
    pure = met.where(residual(F.col("question"), F.col("token")) == "")
    return pure.groupBy("query_id").agg(F.min_by("category", "place").alias("category"))


def _named(questions: DataFrame, products: DataFrame, aliases: DataFrame | None, residual) -> DataFrame:
    """Each question with its pure category and its pure product (own_*), null where there is none."""
    asked = questions.select("query_id", "question")
    of = matched_categories(asked, category_targets(products, aliases), residual)
    rows = products.select(F.col("id").alias("product_id"), F.col("name").alias("own_name"), F.col("category").alias("own_category"), F.col("stock").alias("own_stock"), F.col("price_cents").alias("own_cents"), F.col("currency").alias("own_currency"))
    matched = asked.join(matched_products(asked, products), "query_id").where(residual(F.col("question"), F.col("piece")) == "").select("query_id", "product_id")
    return asked.join(of, "query_id", "left").join(matched.join(rows, "product_id"), "query_id", "left")


def _said(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def quote_answers(questions: DataFrame, products: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(query_id, kind, product_id, answer) of questions about a price (query_id, question).

    First the category that is all that the question names, with the span of its prices if they
    have one currency, else the matched product's price; kind none, without an answer, where
    neither has a price or where anything else is asked."""
    sums = products.groupBy("category").agg(
        F.count("*").alias("total"), F.count("price_cents").alias("priced"), F.min("price_cents").alias("low"), F.max("price_cents").alias("high"), F.max(F.when(F.col("price_cents").isNotNull(), F.col("currency"))).alias("currency"),
        F.count_distinct(F.when(F.col("price_cents").isNotNull(), F.coalesce("currency", F.lit("")))).alias("currencies"))
    met = _named(questions, products, aliases, price_residual).join(sums, "category", "left")
    low, high, own = (price_label(F.col(c), F.col(of)) for c, of in (("low", "currency"), ("high", "currency"), ("own_cents", "own_currency")))
    shown = F.when(F.col("low") == F.col("high"), _said("均为 ", low)).otherwise(_said("价格 ", low, "–", high))
    unpriced = F.col("total") - F.col("priced")
    tail = F.when(unpriced > 0, _said("（另有 ", unpriced, " 件未定价）")).otherwise("")
    kind = F.when(F.col("currencies") == 1, "category").when(F.col("own_cents").isNotNull(), "product").otherwise("none")
    answer = F.when(kind == "category", _said(F.col("category"), "共 ", F.col("total"), " 件，其中已定价 ", F.col("priced"), " 件，", shown, tail, "；问具体型号给你准确价。")).when(
        kind == "product", _said(F.col("own_name"), "（", F.coalesce("own_category", F.lit("")), "）售价 ", own, "。"))
    return met.select("query_id", kind.alias("kind"), F.when(kind == "product", F.col("product_id")).alias("product_id"), answer.alias("answer"))


def stock_lookups(questions: DataFrame, products: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(query_id, kind, product_id, answer) of questions about a stock (query_id, question).

    First the category that is all that the question names, with its sums, else the matched
    product: in stock, out of stock, or unset, which goes to a human; kind none without either
    or where anything else is asked, which goes to a human, too."""
    sums = products.groupBy("category").agg(F.count("*").alias("total"), F.count_if(F.col("stock") > 0).alias("filled"), F.sum("stock").alias("held"))
    met = _named(questions, products, aliases, stock_residual).join(sums, "category", "left")
    kind = (
        F.when(F.col("total").isNotNull(), "category").when(F.col("own_stock") > 0, "in_stock").when(F.col("own_stock").isNotNull(), "out_of_stock").when(F.col("product_id").isNotNull(), "unset").otherwise("none")
    )
    tail = F.coalesce(_said("，库存合计 ", F.col("held"), " 件"), F.lit("（库存未逐件设置）"))
    answer = (
        F.when(kind == "category", _said(F.col("category"), "共 ", F.col("total"), " 件，其中有货 ", F.col("filled"), " 件", tail, "。")).when(kind == "in_stock", _said(F.col("own_name"), "有货，当前库存 ", F.col("own_stock"), " 件。"))
        .when(kind == "out_of_stock", _said(F.col("own_name"), "暂时无货。")).when(kind == "unset", _said(F.col("own_name"), "库存未设置，已转人工。")).otherwise("没有找到对应商品，已转人工。")
    )
    return met.select("query_id", kind.alias("kind"), F.when(~kind.isin("category", "none"), F.col("product_id")).alias("product_id"), answer.alias("answer"))
