"""Audits of text collections: duplicates, odd titles, search, document frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vergence.functions.text import stripped, tokens


def duplicate_groups(rows: DataFrame, key: Column, id_col: str) -> DataFrame:
    """(key, n, first_id): groups of equal keys of two rows or more; the members stay where they are."""
    return rows.where(key.isNotNull()).groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id")).where("n > 1")


def later_duplicates(rows: DataFrame, key: Column, id_col: str) -> DataFrame:
    """(id, first_id): rows whose key an earlier row has."""
    keyed = rows.select(F.col(id_col), key.alias("_key"))
    firsts = keyed.groupBy("_key").agg(F.min(id_col).alias("first_id"))
    return keyed.join(firsts, "_key").where(F.col(id_col) > F.col("first_id")).select(id_col, "first_id")


def duplicate_titles(assets: DataFrame) -> DataFrame:
    title = stripped(F.col("title"))
    return duplicate_groups(assets.where(title != ""), title, "asset_id").withColumnRenamed("key", "title")


def mojibake(text: Column) -> Column:
    """Three or more characters that misread UTF-8 leaves."""
    return F.regexp_count(text, F.lit("[¡-ÿ]")) >= 3


def letter_share(text: Column, digits: int = 6) -> Column:
    """Share of ASCII letters, rounded as the double it is; that of an empty text is not a number."""
    share = F.length(F.regexp_replace(text, "[^A-Za-z]", "")) / F.length(text)
    return F.when(F.length(text) == 0, float("nan")).otherwise(F.floor(share * 10.0**digits + 0.5) / 10.0**digits)


def search(rows: DataFrame, query: str, fields: list[str]) -> DataFrame:
    """Rows in whose fields every word of the query is found, in either case; an empty query finds all."""
    for word in query.lower().split():
        hit = F.lit(False)
        for field in fields:
            hit = hit | F.contains(F.lower(F.coalesce(field, F.lit(""))), F.lit(word))
        rows = rows.where(hit)
    return rows


def term_frequencies(rows: DataFrame, text_col: str, least: int = 2) -> DataFrame:
    """(term, n, df): occurrences and texts of each term that `least` texts have.

    A text's terms are counted inside its row, so the only shuffle is that of partial sums by term."""
    found = rows.select(F.array_sort(tokens(F.col(text_col))).alias("_t"))
    pairs = F.arrays_zip(F.col("_t").alias("term"), F.concat(F.array(F.lit("")), "_t").alias("before"))  # the last pair has no term
    each = found.select(F.explode(pairs).alias("p")).select("p.term", "p.before").where("term is not null")
    counts = each.groupBy("term").agg(F.count("*").alias("n"), F.count_if(F.col("term") != F.col("before")).alias("df"))
    return counts.where(F.col("df") >= least)


def page_titles(pages: DataFrame) -> DataFrame:
    """(page_id, host, title): the title with its entities read."""
    raw = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(entity), F.lit(char))
    return pages.select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), stripped(raw).alias("title"))
