"""Images, clips, candidates and recordings of products, and the questions, tickets and chunks that views show."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vergence.functions import fields, rules, text

PENDING, NO_NAME = "pending", "—"
#: The lowest shares, in per cent, that a change of the retrieval may leave.
POSITIVE_FLOOR, REFUSAL_FLOOR = 98.8, 86.7
#: Hits that an answer is made of, characters of a candidate's label, seconds of a clip made from a pair.
MOST_EVIDENCE, MOST_LABEL, CLIP_SECONDS = 2, 120, 40


def reference_images(assets: DataFrame, versions: DataFrame) -> DataFrame:
    """(product_id, asset_id, version_id): of a product's live images (product_id, asset_id, pointer, discarded_at) the
    one of the greatest pointer whose version is there, else of the newest one with a version its latest version."""
    live = assets.where(F.col("discarded_at").isNull())
    pointed = versions.select(F.col("version_id").alias("pointer"), F.lit(True).alias("there"))
    latest = versions.groupBy("asset_id").agg(F.max_by("version_id", "version_no").alias("latest"))
    every = live.join(pointed, "pointer", "left").join(latest, "asset_id", "left")
    there = F.coalesce("there", F.lit(False))
    every = every.withColumn("version_id", F.when(there, F.col("pointer")).otherwise(F.col("latest"))).where("version_id is not null")
    best = every.groupBy("product_id").agg(F.max(F.struct(there.alias("there"), F.coalesce("pointer", F.lit(-1)).alias("pointer"), "asset_id", "version_id")).alias("best"))
    return best.select("product_id", "best.asset_id", "best.version_id")


def flagged_first(rows: DataFrame, group: str, flag: Column, at: str) -> DataFrame:
    """rows with place: in each group those with the flag first, otherwise as they were."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(F.coalesce(flag, F.lit(False)).desc(), at)))


def rebound(candidates: DataFrame, recording_id: int, ids: DataFrame | None = None, only_unbound: bool = False) -> DataFrame:
    """candidates (id, status, recording_id) with the pending ones of the asked ids, all if none are named, bound to the recording."""
    moves = F.col("status") == PENDING
    if only_unbound:
        moves = moves & F.col("recording_id").isNull()
    if ids is not None:
        candidates = candidates.join(ids.select("id", F.lit(True).alias("_asked")).distinct(), "id", "left")
        moves = moves & F.col("_asked").isNotNull()
    return candidates.withColumn("recording_id", F.when(moves, F.lit(recording_id)).otherwise(F.col("recording_id"))).drop("_asked")


def asked_candidates(ids: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, found, registered) of the asked ids."""
    held = candidates.select("id", "status")
    return ids.select("id").distinct().join(held, "id", "left").select("id", F.col("status").isNotNull().alias("found"), F.coalesce(F.col("status") != PENDING, F.lit(False)).alias("registered"))


def pending_counts(candidates: DataFrame, sources: list[str]) -> DataFrame:
    """(recording_id, n): the pending candidates of the sources; recordings without one have 0."""
    open_ = (F.col("status") == PENDING) & F.col("transcript_source").isin(*sources)
    return candidates.where(F.col("recording_id").isNotNull()).groupBy("recording_id").agg(F.count_if(open_).alias("n"))


def candidate_cards(candidates: DataFrame, products: DataFrame, recordings: DataFrame) -> DataFrame:
    """candidates (id, product_id, recording_id) with the product's name, a dash if there is none, and the recording's label."""
    named = candidates.join(products.select(F.col("id").alias("product_id"), "name"), "product_id", "left").join(recordings.select(F.col("id").alias("recording_id"), "label"), "recording_id", "left")
    return named.select("id", F.coalesce("name", F.lit(NO_NAME)).alias("product_name"), "recording_id", "label")


def session_detail(messages: DataFrame, ratings: DataFrame, tickets: DataFrame) -> DataFrame:
    """(session_id, place, id, role, rating, ticket_id): messages by id, the session's rating and its newest ticket."""
    newest = tickets.groupBy("session_id").agg(F.max("id").alias("ticket_id"))
    place = F.row_number().over(W.partitionBy("session_id").orderBy("id"))
    return messages.withColumn("place", place).join(ratings, "session_id", "left").join(newest, "session_id", "left").select("session_id", "place", "id", "role", "rating", "ticket_id")


def cited_chunks(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, place, asset_id, seq, chunk): all chunks of the cited versions (query_id, at, asset_id, version_no), in the citations' order."""
    met = citations.join(chunks, ["asset_id", "version_no"])
    return met.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("at", "seq"))).select("query_id", "place", "asset_id", "seq", "chunk")


def stale_tickets(tickets: DataFrame, now: str, hours: int = 48) -> DataFrame:
    """(id): pending tickets (id, status, created_at) of more than `hours`."""
    return tickets.where((F.col("status") == PENDING) & (F.col("created_at") < F.lit(now).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours)))).select("id")


def by_priority(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """The questions (question, at) of all sources: rank and name of the source, at is the order within it."""
    ranked = [rows.select(F.lit(i).alias("source_rank"), F.lit(name).alias("source"), "at", "question") for i, (name, rows) in enumerate(sources)]
    return reduce(DataFrame.unionByName, ranked)


def verdict_counts(rows: DataFrame, verdicts: list[str]) -> DataFrame:
    """(verdict, n) of the named verdicts, 0 included."""
    named = rows.sparkSession.createDataFrame([(v,) for v in verdicts], "verdict string")
    counted = rows.where(F.col("verdict").isin(*verdicts)).groupBy("verdict").agg(F.count("*").alias("n"))
    return named.join(F.broadcast(counted), "verdict", "left").na.fill(0, ["n"])  # a row a verdict


def redline(positive: Column, refused: Column) -> Column:
    """Whether the mean shares of hits and of refusals, in per cent, are both at their floors or above; a share of no cases fails."""
    held = lambda flag, floor: F.coalesce(100 * F.avg(flag.cast("double")) >= floor - 1e-9, F.lit(False))
    return held(positive, POSITIVE_FLOOR) & held(refused, REFUSAL_FLOOR)


def embedding_gaps(chunks: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    """(total, missing): chunks, and those that no vector is held for."""
    held = vectors.select(*keys, F.lit(True).alias("_held")).distinct()
    return chunks.join(held, keys, "left").agg(F.count("*").alias("total"), F.count_if(F.col("_held").isNull()).alias("missing"))


def composed_answers(questions: DataFrame, hits: DataFrame, assets: DataFrame) -> DataFrame:
    """(query_id, kind, content, citations): the sentences of the two best hits (query_id, rank, asset_id, version_no, chunk),
    and what they cite, each once; a question without a hit is refused."""
    best = hits.where(F.col("rank") <= MOST_EVIDENCE).join(assets.select("asset_id", "kind", "title"), "asset_id", "left")
    said = best.select("query_id", F.struct("rank", rules.evidence_sentence(F.col("kind"), F.col("title"), F.col("chunk")).alias("said"), F.struct("asset_id", "version_no").alias("cited")).alias("h"))
    of = said.groupBy("query_id").agg(F.array_sort(F.collect_list("h")).alias("h"))  # two at most
    content, cited = F.array_join(F.col("h.said"), "\n"), F.array_distinct(F.col("h.cited"))
    kind = F.when(F.col("h").isNull(), "refusal").otherwise("answer")
    return questions.select("query_id").join(of, "query_id", "left").select("query_id", kind.alias("kind"), content.alias("content"), cited.alias("citations"))


def derived_questions(assets: DataFrame) -> DataFrame:
    """(asset_id, version_no, source, pair_index, question, answer) of dialogues (asset_id, version_no, qa, transcript): a
    question for each pair with one; where there is none, the customer's first line, masked."""
    asked = lambda p: F.coalesce(text.stripped(p["q"]), F.lit("")) != ""
    pairs = F.filter(F.transform("qa", lambda p, i: F.struct(p["q"].alias("q"), p["a"].alias("a"), i.alias("i"))), asked)
    lines = F.transform(F.split("transcript", "\n"), text.stripped)
    said = F.filter(F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("顾客："))), lambda x: text.stripped(F.substring(x, 4, 1 << 30))), lambda x: x != "")
    none = F.lit(None).cast("int")
    first = F.transform(F.slice(said, 1, 1), lambda x: F.struct(text.masked(x).alias("q"), F.lit(None).cast("string").alias("a"), none.alias("i")))
    has = F.coalesce(F.size(pairs), F.lit(0)) > 0
    rows = assets.select("asset_id", "version_no", F.when(has, "qa").otherwise("transcript").alias("source"), F.explode(F.when(has, pairs).otherwise(first)).alias("p"))
    answer = F.when(text.stripped(F.col("p.a")) != "", text.stripped(F.col("p.a")))
    return rows.select("asset_id", "version_no", "source", F.col("p.i").alias("pair_index"), text.stripped(F.col("p.q")).alias("question"), answer.alias("answer"))


def asked_questions(keys: DataFrame, questions: DataFrame) -> DataFrame:
    """The questions of the keys (asset_id, version_no, source, pair_index); of a version that is no longer current there are none."""
    valid = keys.where((F.col("source") == "transcript") | ((F.col("source") == "qa") & F.col("pair_index").isNotNull())).distinct().alias("k")
    q = questions.alias("q")
    same = [F.col(f"k.{c}") == F.col(f"q.{c}") for c in ("asset_id", "version_no", "source")]
    return valid.join(q, [*same, F.col("k.pair_index").eqNullSafe(F.col("q.pair_index"))]).select("q.*")


def candidate_rows(segments: DataFrame, source: str) -> DataFrame:
    """A pending candidate for each segment (recording_id, label, start, end, transcript), bound to its recording."""
    label = F.substring("label", 1, MOST_LABEL)
    return segments.select("recording_id", F.lit(PENDING).alias("status"), fields.timecode(F.col("start")).alias("timecode_start"), fields.timecode(F.col("end")).alias("timecode_end"), "transcript", F.lit(source).alias("transcript_source"), label.alias("label"))


def pair_clips(pairs: DataFrame) -> DataFrame:
    """(at, timecode_start, timecode_end, transcript) of numbered pairs (at, query, name): clips of 40 seconds, one after the other."""
    start = F.col("at") * CLIP_SECONDS
    said = F.concat(F.lit("顾客问 "), "query", F.lit(" —— "), "name", F.lit("（标注：Exact）"))
    return pairs.select("at", fields.timecode(start).alias("timecode_start"), fields.timecode(start + CLIP_SECONDS - 1).alias("timecode_end"), said.alias("transcript"))


def product_assets(assets: DataFrame) -> DataFrame:
    """(product_id, place, asset_id, published): a product's live assets by id; a pointer makes one published."""
    live = assets.where(F.col("discarded_at").isNull() & F.col("product_id").isNotNull())
    return live.select("product_id", F.row_number().over(W.partitionBy("product_id").orderBy("asset_id")).alias("place"), "asset_id", F.col("pointer").isNotNull().alias("published"))


def readiness(checks: dict[str, tuple[DataFrame, Column, Column]]) -> DataFrame:
    """(check, found, ready): for each check, how many rows meet its condition and whether that count, as `found`, meets its expectation."""
    rows = [df.agg(F.count_if(where).alias("found")).select(F.lit(name).alias("check"), "found", expected.alias("ready")) for name, (df, where, expected) in checks.items()]
    return reduce(DataFrame.unionByName, rows)
