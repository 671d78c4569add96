"""Reranking and case generation on ranked hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vergence.functions.text import FIELD_LINE, terms
from vergence.operators import meeting
from vergence.operators.grams import _stored as cut
from vergence.operators.retrieval import AFFINITY, BROADCAST_ROWS, chunks_of, known_terms, postings, question_terms, top_k, whole_runs

#: Shortest run of unknown characters, and chunks from which a corpus is judged by; hits of a fusion's window.
UNKNOWN_RUN, LEAST_CORPUS, WINDOW = 4, 100, 10
#: What every text with a field line has.
FIELD_MARK = r"[一-龥A-Za-z0-9 ]\s*[:：]\s*\S"


def cascade(lexical: DataFrame, dense: DataFrame, key: str, threshold: float, k: int = WINDOW) -> DataFrame:
    """(query_id, key, rank): lexical hits alone if the best reaches the threshold, else the dense ones first and then the others."""
    best = lexical.groupBy("query_id").agg(F.max("score").alias("best"))
    lex = lexical.where(F.col("rank") <= k).join(best, "query_id").select("query_id", key, (F.col("best") >= threshold).alias("strong"), F.lit(1).alias("part"), F.col("rank").cast("double").alias("place"))
    strong = best.where(F.col("best") >= threshold).select("query_id")
    vec = dense.join(strong, "query_id", "left_anti").select("query_id", key, F.lit(False).alias("strong"), F.lit(0).alias("part"), (-F.col("cos")).alias("place"))
    both = lex.join(vec.select("query_id", key), ["query_id", key], "left_anti").unionByName(vec)
    order = W.partitionBy("query_id").orderBy("part", "place", key)
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", key, "rank")


def affinity_after(hits: DataFrame, affinity: DataFrame, k: int, alpha: float = AFFINITY, digits: int | None = None) -> DataFrame:
    """Hits of the fusion's window with scores raised by title affinity; with digits, affinity only decides between scores that round alike."""
    met = hits.where(F.col("rank") <= WINDOW).drop("rank").join(affinity, ["query_id", "asset_id"], "left").na.fill(0.0, ["affinity"])
    if digits is None:
        return top_k(met.withColumn("final", F.round(F.col("score") * (1 + alpha * F.col("affinity")), 9)), k, "asset_id", score="final")
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", digits)), F.desc("affinity"), F.desc("score"), "asset_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def names_field(chunk: Column, question: Column) -> Column:
    """A field line whose name, at most six Chinese characters, shares a term with the question."""
    head = F.split(chunk, "[：:]", 2)[0]
    return head.rlike("^[一-鿿]{1,6}$") & F.arrays_overlap(terms(head), terms(question))


def field_directed(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """Hits with the best asset's chunks of the asked field moved first; the others keep their order.

    hits (query_id, rank, asset_id, chunk)."""
    met = hits.join(questions, "query_id")
    top = F.first("asset_id").over(W.partitionBy("query_id").orderBy("rank"))
    named = (F.col("asset_id") == top) & names_field(F.col("chunk"), F.col("question"))
    return met.withColumn("_named", named).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("_named"), "rank"))).select(*hits.columns)


def interleaved(hits: DataFrame, own: DataFrame, key: list[str], most: int = 2) -> DataFrame:
    """(query_id, *key, rank): after each of the first hits one of the question's own new hits, `most` of them; what is left over comes last."""
    fresh = own.join(hits.select("query_id", *key), ["query_id", *key], "left_anti")
    fresh = fresh.withColumn("_nth", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).where(F.col("_nth") <= most)
    both = hits.select("query_id", *key, (F.col("rank") * 2.0).alias("_at")).unionByName(fresh.select("query_id", *key, (F.col("_nth") * 2.0 + 1).alias("_at")))
    return both.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("_at"))).drop("_at")


def shared_words(chunks: DataFrame, pattern: str, n: int) -> DataFrame:
    """(word, support, asset_id): words of the pattern that two assets or more have, by falling support; of the two least
    assets the one with the better chunk for the word, of equal ones the lesser."""
    found = postings(chunks, ["asset_id"]).where(F.col("term").rlike(pattern))
    scored = found.groupBy("term", "asset_id").agg(F.max(1 / F.sqrt("n_terms")).alias("score"))
    support = scored.groupBy("term").agg(F.count("*").alias("support"))
    return _better_of_two(scored, support.where("support > 1").orderBy(F.desc("support"), "term").limit(n))


def _better_of_two(scored: DataFrame, words: DataFrame) -> DataFrame:
    two = scored.join(F.broadcast(words), "term").withColumn("_nth", F.row_number().over(W.partitionBy("term").orderBy("asset_id"))).where("_nth <= 2")
    best = two.withColumn("_best", F.row_number().over(W.partitionBy("term").orderBy(F.desc("score"), "asset_id"))).where("_best = 1")
    return best.select(F.col("term").alias("word"), "support", "asset_id")


def shared_long_words(texts: DataFrame, least: int, n: int) -> DataFrame:
    """shared_words() of the chunks of texts (asset_id, body) for the pattern ^[a-z]{least,}$, from two letters on.

    Such words lie whole in chunks, so that they are counted in whole texts, and only the texts of the words' two least assets are cut into chunks.
    Of ids that are unique no pair of a word and an asset is exchanged; those that repeat count once."""
    runs = f"[A-Za-z]{{{max(2, least)},}}"
    repeated = texts.groupBy("asset_id").count().where("count > 1").select("asset_id", F.lit(True).alias("_again"))
    again = repeated.count()
    marked = texts.join(F.broadcast(repeated) if again <= BROADCAST_ROWS else repeated, "asset_id", "left") if again else texts.withColumn("_again", F.lit(None).cast("boolean"))
    lower = F.array_distinct(F.transform(F.regexp_extract_all("body", F.lit(runs), F.lit(0)), F.lower))
    held = marked.select("asset_id", "_again", F.explode_outer(lower).alias("term")).where("term is not null")
    once = held.where("_again is null").groupBy("term").agg(F.count("*").alias("support"), F.min("asset_id").alias("first"))
    if again:
        more = held.where("_again").select("term", "asset_id").distinct().groupBy("term").agg(F.count("asset_id").alias("support"), F.min("asset_id").alias("first"))
        once = once.unionByName(more).groupBy("term").agg(F.sum("support").alias("support"), F.min("first").alias("first"))
    words = cut(once.where("support > 1").orderBy(F.desc("support"), "term").limit(n))
    second = held.select("term", "asset_id").join(F.broadcast(words), "term").where("asset_id > first").groupBy("term").agg(F.min("asset_id").alias("second"))
    two = words.select("term", F.col("first").alias("asset_id")).unionByName(second.select("term", F.col("second").alias("asset_id")))
    few = chunks_of(texts.join(F.broadcast(two.select("asset_id").distinct()), "asset_id", "left_semi"), "asset_id")
    scored = postings(few, ["asset_id"]).join(F.broadcast(two), ["term", "asset_id"], "left_semi").groupBy("term", "asset_id").agg(F.max(1 / F.sqrt("n_terms")).alias("score"))
    return _better_of_two(scored, words.drop("first"))


def without_evidence(questions: DataFrame, chunks: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(query_id): questions with terms, none of which any chunk has.

    texts (body): those that the chunks are all pieces of, by document_chunks(); they are read instead."""
    asked = question_terms(questions)
    corpus = postings(chunks, []).select("term").distinct() if texts is None else known_terms(asked.select("term").distinct(), texts)
    known = asked.join(corpus, "term", "left_semi").select("query_id").distinct()
    return asked.select("query_id").distinct().join(known, "query_id", "left_anti")


def field_terms(chunks: DataFrame) -> DataFrame:
    """Terms of the names of field lines among chunks, or among those of texts (body)."""
    if "body" in chunks.columns:  # texts that they are pieces of
        chunks = chunks_of(chunks.where(F.col("body").rlike(FIELD_MARK)))
    lines = chunks.where(F.col("chunk").rlike(FIELD_LINE)).select(F.split("chunk", "[：:]", 2)[0].alias("head"))
    return lines.select(F.explode(terms(F.col("head"))).alias("term")).distinct()


def unknown_words(questions: DataFrame, chunks: DataFrame, least: int = UNKNOWN_RUN, corpus: int = LEAST_CORPUS, texts: DataFrame | None = None) -> DataFrame:
    """(query_id, word): the longest ASCII word of `least` characters or more that neither a chunk nor a field name has; the first of equals.

    Without enough chunks nothing is judged.  texts (body): those that the chunks are all pieces of; with words of two letters
    or more they are read instead.  A field name's words are its line's."""
    asked = questions.select("query_id", F.posexplode(F.regexp_extract_all(F.lower("question"), F.lit("[a-z]+"), F.lit(0))).alias("at", "term"))
    asked = asked.where(F.length("term") >= least)
    if texts is None or least < 2:
        known = postings(chunks, []).select("term").unionByName(field_terms(chunks)).distinct()
    else:
        names = asked.select("term").distinct()
        names = F.broadcast(names) if names.count() <= BROADCAST_ROWS else names
        known = whole_runs(texts, pattern=f"[A-Za-z]{{{least},}}").join(names, "term", "left_semi").distinct()
    missing = asked.join(known, "term", "left_anti")
    enough = chunks.select(F.lit(1)).limit(corpus).count() >= corpus
    order = W.partitionBy("query_id").orderBy(F.desc(F.length("term")), "at")
    return missing.where(F.lit(enough)).withColumn("_n", F.row_number().over(order)).where("_n = 1").select("query_id", F.col("term").alias("word"))


def ranked_targets(probes: DataFrame, chunks: DataFrame, key: list[str]) -> DataFrame:
    """(query_id, span, target, score): for each probe (query_id, question, span, target) the best score that a chunk would have
    if the target's words were the question's too; only chunks that have one of its new terms count.

    A target that is the span or in the question, or that brings no term, has no row."""
    probes = probes.distinct().where((F.col("target") != F.col("span")) & ~F.contains("question", F.col("target")))
    base, changed = terms(F.col("question")), terms(F.replace("question", F.col("span"), F.col("target")))
    every = probes.select("query_id", "span", "target", base.alias("base"), changed.alias("changed"))
    asked = every.select("query_id", "span", "target", "base", F.explode(F.array_union("base", "changed")).alias("term"))
    asked = asked.select("query_id", "span", "target", "term", (~F.array_contains("base", F.col("term"))).alias("fresh"))
    if asked.count() <= BROADCAST_ROWS:
        spark, names = chunks.sparkSession, ["query_id", "span", "target"]
        rows = every.collect()  # as few as counted, each of which has its terms
        index = meeting.Asked(list(range(len(rows))), [{*(r["base"] or []), *(r["changed"] or [])} for r in rows], [set(r["changed"] or []) - set(r["base"] or []) for r in rows])
        best = meeting.best_scores(chunks, spark.sparkContext.broadcast(index), terms(F.col("chunk"))).withColumnRenamed("query_id", "_place")
        named = spark.createDataFrame([(i, *(r[c] for c in names)) for i, r in enumerate(rows)], T.StructType([T.StructField("_place", T.LongType()), *(every.schema[c] for c in names)]))
        return named.join(best, "_place").select(*names, F.round("score", 4).alias("score"))
    met = postings(chunks, key).join(asked, "term")
    scored = met.groupBy("query_id", "span", "target", *key, "n_terms").agg(F.count("*").alias("overlap"), F.bool_or("fresh").alias("fresh")).where("fresh")
    return scored.groupBy("query_id", "span", "target").agg(F.round(F.max(F.col("overlap") / F.sqrt("n_terms")), 4).alias("score"))
