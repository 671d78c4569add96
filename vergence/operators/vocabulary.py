"""Questions about what the corpus doesn't have: tokens as spans, and the longest stretch that no chunk knows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vergence.functions.text import STOP_CHARS, terms
from vergence.operators.ranking import field_terms
from vergence.operators.retrieval import BROADCAST_ROWS, OPINION_WORDS, known_terms, postings

#: Least characters of an unknown stretch, and least chunks of a corpus that is judged by.
LEAST_SPAN, LEAST_CHUNKS = 4, 100
_RUNS = "[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+"
_SPANS = "array<struct<token: string, start: int, length: int>>"


def token_spans(text: Column) -> Column:
    """(token, start, length) of each token of text.tokens(), in characters from 0.

    A pair's span reaches from its first to its second character, over what stands between them."""
    none = F.array().cast("array<struct<start: int, run: string>>")
    placed = F.aggregate(
        F.regexp_extract_all(text, F.lit(_RUNS), F.lit(0)), F.struct(F.lit(0).alias("at"), none.alias("found")),
        lambda acc, r: F.struct((acc["at"] + F.length(r)).alias("at"), F.concat(acc["found"], F.array(F.struct(acc["at"].alias("start"), r.alias("run")))).alias("found")),
    )["found"]
    span = lambda token, start, length: F.struct(token.alias("token"), start.alias("start"), length.alias("length"))
    stopped = lambda token: token.rlike(f"[{STOP_CHARS}]")

    def of_run(r: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(r["run"])), lambda i: F.struct(F.substring(r["run"], i, F.lit(1)).alias("c"), (r["start"] + i - 1).alias("at")))
        chars = F.filter(every, lambda x: x["c"].rlike(r"[\p{L}\p{N}]"))
        one = F.transform(chars, lambda x: span(x["c"], x["at"], F.lit(1)))
        pairs = F.zip_with(F.slice(chars, F.lit(1), F.size(chars) - 1), F.slice(chars, F.lit(2), F.size(chars) - 1), lambda x, y: span(F.concat(x["c"], y["c"]), x["at"], y["at"] - x["at"] + 1))
        found = F.when(F.size(chars) > 1, pairs).otherwise(one)
        return F.when(r["run"].rlike("^[A-Za-z0-9]"), F.array(span(F.lower(r["run"]), r["start"], F.length(r["run"])))).otherwise(F.filter(found, lambda s: ~stopped(s["token"])))

    return F.flatten(F.transform(placed, of_run)).cast(_SPANS)


def longest_stretches(spans: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, start, length): of the union of spans (by, start, length) the longest stretch without a gap, the first of equals."""
    end = F.col("start") + F.col("length")
    before = F.max(end).over(W.partitionBy(by).orderBy("start", "length").rowsBetween(W.unboundedPreceding, -1))
    opened = spans.withColumn("_new", F.when(F.col("start") <= before, 0).otherwise(1))
    numbered = opened.withColumn("_island", F.sum("_new").over(W.partitionBy(by).orderBy("start", "length").rowsBetween(W.unboundedPreceding, 0)))
    islands = numbered.groupBy(by, "_island").agg(F.min("start").alias("start"), (F.max(end) - F.min("start")).alias("length"))
    return islands.groupBy(by).agg(F.max_by(F.struct("start", "length"), F.struct("length", -F.col("start"))).alias("_best")).select(by, "_best.start", "_best.length")


def oov_verdicts(questions: DataFrame, assets: DataFrame, chunks: DataFrame, least: int = LEAST_SPAN, corpus: int = LEAST_CHUNKS, texts: DataFrame | None = None) -> DataFrame:
    """(query_id, entity, start): what a question names that the corpus doesn't have, and where, in the question without its opinion words.

    Tokens of the question that aren't names of fields are its entity.  Those that no chunk has are
    laid over the question as spans; their longest stretch is the entity if it has `least`
    characters.  A question whose entity shares a token with any title has no verdict, nor has any
    one if the corpus has fewer than `corpus` chunks.  Other questions have no row.  Questions that
    share an id are judged as one, equal ones once.  texts (body): those that the chunks are all pieces of, by document_chunks(); they are read instead."""
    asked = questions.select("query_id", F.regexp_replace("question", OPINION_WORDS, " ").alias("stripped"))
    worded = asked.groupBy("query_id").agg(F.sort_array(F.collect_set("stripped")).alias("wording"))
    each = worded.select("wording").distinct().select("wording", F.explode("wording").alias("stripped"))
    spans = each.select("wording", F.explode(token_spans(F.col("stripped"))).alias("s")).select("wording", F.col("s.token").alias("term"), "s.start", "s.length")
    entity = spans.join(field_terms(chunks if texts is None else texts), "term", "left_anti")
    names = spans.select("term").distinct()  # those of fields too, so that no text is read for them
    few = F.broadcast(names) if names.count() <= BROADCAST_ROWS else names
    known = known_terms(names, texts) if texts is not None else postings(chunks, []).select("term").join(few, "term", "left_semi").distinct()
    titled = assets.select(F.explode(terms(F.col("title"))).alias("term")).join(few, "term", "left_semi").distinct()
    of_title = entity.join(titled, "term", "left_semi").select("wording").distinct()
    enough = chunks.select(F.lit(1)).limit(corpus).count() >= corpus
    missing = entity.join(known, "term", "left_anti").join(of_title, "wording", "left_anti").where(F.lit(enough))
    found = longest_stretches(missing.select("wording", "start", "length"), "wording").where(F.col("length") >= least)
    return found.join(worded, "wording").select("query_id", "start", "length").join(asked, "query_id").select("query_id", F.substr("stripped", F.col("start") + 1, F.col("length")).alias("entity"), "start")
