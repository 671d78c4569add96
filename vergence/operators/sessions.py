"""Conversations: turns, carried questions, memory and transcripts, with windows over sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vergence.functions.text import masked, shortened

#: Fixed value: turns that a session's memory holds.
MEMORY_TURNS = 4


def in_order():
    return W.partitionBy("session_id").orderBy("id")


def first_question(messages: DataFrame) -> DataFrame:
    """(session_id, first_question): the first customer message, masked and cut."""
    return messages.where("role = 'customer'").groupBy("session_id").agg(F.min_by("content", "id").alias("content")).select("session_id", shortened(masked(F.col("content"))).alias("first_question"))


def last_question(messages: DataFrame) -> DataFrame:
    return messages.where("role = 'customer'").groupBy("session_id").agg(F.max("id").alias("id"), F.max_by("content", "id").alias("last_question"))


def previous_question(messages: DataFrame) -> DataFrame:
    """(id, session_id, question): each agent message with the last customer message before it; null without one."""
    before = in_order().rowsBetween(W.unboundedPreceding, -1)
    carried = messages.withColumn("question", F.last(F.when(F.col("role") == "customer", F.col("content")), ignorenulls=True).over(before))
    return carried.where("role = 'agent'").select("id", "session_id", "question")


def next_reply(messages: DataFrame) -> DataFrame:
    """(id, session_id, reply_id): each customer message with the next agent message of its session."""
    after = in_order().rowsBetween(1, W.unboundedFollowing)
    return messages.withColumn("reply_id", F.first(F.when(F.col("role") == "agent", F.col("id")), ignorenulls=True).over(after)).where("role = 'customer'").select("id", "session_id", "reply_id")


def recent_turns(messages: DataFrame, turns: int = MEMORY_TURNS) -> DataFrame:
    """(session_id, nth, question_id, answer_id): the last answered turns, oldest first; the question is the row right before."""
    paired = messages.select("session_id", "id", "role", F.lag("role").over(in_order()).alias("before"), F.lag("id").over(in_order()).alias("question_id")).where("role = 'agent' and before = 'customer'")
    newest = paired.withColumn("_back", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("id")))).where(F.col("_back") <= turns)
    return newest.select("session_id", F.row_number().over(W.partitionBy("session_id").orderBy("id")).alias("nth"), "question_id", F.col("id").alias("answer_id"))


def answered_pairs(messages: DataFrame) -> DataFrame:
    """(session_id, q, a): every agent message right after a customer message, with that message."""
    rows = messages.select("session_id", "role", F.col("content").alias("a"), F.lag("role").over(in_order()).alias("before"), F.lag("content").over(in_order()).alias("q"))
    return rows.where("role = 'agent' and before = 'customer'").select("session_id", "q", "a")


def transcript(messages: DataFrame) -> DataFrame:
    """(session_id, n_messages, transcript): one line for each message, in order; as long as its session."""
    line = F.concat(F.when(F.col("role") == "customer", "顾客：").otherwise("客服："), F.coalesce("content", F.lit("")))
    return messages.groupBy("session_id").agg(F.count("*").alias("n_messages"), F.array_sort(F.collect_list(F.struct("id", line.alias("line")))).alias("lines")).select("session_id", "n_messages", F.array_join("lines.line", "\n").alias("transcript"))


def unanswered(messages: DataFrame) -> DataFrame:
    """(session_id, id) of customer messages that no agent message follows."""
    return next_reply(messages).where("reply_id is null").select("session_id", "id")


def session_list(messages: DataFrame) -> DataFrame:
    """(session_id, n_messages, n_customer, n_agent, first_question, last_id)."""
    role = lambda r: F.count_if(F.col("role") == r)
    counts = messages.groupBy("session_id").agg(F.count("*").alias("n_messages"), role("customer").alias("n_customer"), role("agent").alias("n_agent"), F.max("id").alias("last_id"))
    return counts.join(first_question(messages), "session_id", "left")


def islands(rows: DataFrame, by: str, order: str) -> DataFrame:
    """(by, first, last, n): runs of consecutive numbers."""
    at = rows.select(by, order).distinct().withColumn("_run", F.col(order) - F.row_number().over(W.partitionBy(by).orderBy(order)))
    return at.groupBy(by, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_run")


def sessionised(events: DataFrame, key: str, ts: str, gap_minutes: int) -> DataFrame:
    """(key, session, started, ended, n): a new session after a gap of more than the given minutes."""
    w = W.partitionBy(key).orderBy(ts, "event_id")
    fresh = (F.col(ts) - F.lag(ts).over(w) > F.expr(f"interval {gap_minutes} minutes")).cast("int")
    numbered = events.withColumn("session", F.sum(F.coalesce(fresh, F.lit(0))).over(w))
    return numbered.groupBy(key, "session").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n"))


def kept_for_backflow(messages: DataFrame) -> DataFrame:
    """messages (with kind) without refusals and hand-offs and the customer message that each of them answers; a session of which nothing would be left keeps its customer messages."""
    before = in_order().rowsBetween(W.unboundedPreceding, -1)
    refused = F.col("role").eqNullSafe("agent") & F.coalesce(F.col("kind").isin("refusal", "handoff"), F.lit(False))
    asked = F.last(F.when(F.col("role") == "customer", F.col("id")), ignorenulls=True).over(before)
    answered = F.last(F.when(F.col("role") == "agent", F.col("id")), ignorenulls=True).over(before)
    marked = messages.withColumn("_refused", refused).withColumn("_asked", F.when(refused & (answered.isNull() | (asked > answered)), asked))
    gone = marked.where("_refused").select(F.explode(F.array_compact(F.array("id", "_asked"))).alias("id")).distinct().withColumn("_gone", F.lit(True))
    met = marked.drop("_asked").join(gone, "id", "left").withColumn("_kept", F.col("_gone").isNull())
    met = met.withColumn("_any", F.max("_kept").over(W.partitionBy("session_id")))
    return met.where("_kept or (not _any and role = 'customer')").select(*messages.columns)


def last_tool_subject(messages: DataFrame, tools: tuple[str, ...] = ("catalog", "get_stock")) -> DataFrame:
    """(session_id, subject): what the last of the tools was asked about, but for blanks and `-`."""
    used = messages.where(F.col("tool.name").isin(*tools) & (F.trim("tool.arg") != "") & (F.trim("tool.arg") != "-"))
    return used.groupBy("session_id").agg(F.max_by("tool.arg", "id").alias("subject"))


def expanded_question(question: Column, previous: Column, pronouns: str = "它|这个|那个|这款|那款|刚才") -> Column:
    """The previous question before one that holds a pronoun."""
    return F.when(question.rlike(pronouns) & previous.isNotNull(), F.concat_ws(" ", previous, question)).otherwise(question)


def larger_pool(a: DataFrame, b: DataFrame) -> DataFrame:
    """(question, n) of both pools, with the larger count of each question."""
    return a.unionByName(b).groupBy("question").agg(F.max("n").alias("n"))


def one_ticket(requests: DataFrame) -> DataFrame:
    """(session_id, ticket, message, contact): one ticket for each session, with its first message, its last contact and a number by its first id."""
    made = requests.groupBy("session_id").agg(F.min("id").alias("id"), F.min_by("message", "id").alias("message"), F.max_by("contact", F.when(F.col("contact").isNotNull(), F.col("id"))).alias("contact"))
    number = F.col("id").cast("string")
    return made.select("session_id", F.concat(F.lit("H-"), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)).alias("ticket"), "message", "contact")
