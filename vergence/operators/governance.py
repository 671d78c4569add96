"""Governance dataflows: gaps, lineage, triage, exports, audits with merged actions, and cleanups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vergence.functions.text import masked

#: Order of an audit's actions, and cited samples of an asset's lineage.
PRIORITY, SAMPLES = {"retire": 0, "fix": 1, "keep": 2}, 10


def merged_actions(actions: DataFrame) -> DataFrame:
    """(ref, action, reason): the strongest action of each object; its distinct reasons in order, but those within another.

    actions (at, ref, action, reason)."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.col("action"))
    ranked = actions.withColumn("_rank", rank)
    best = ranked.groupBy("ref").agg(F.min("_rank").alias("_best"))
    held = ranked.join(best, "ref").where("_rank = _best").groupBy("ref", "action").agg(F.array_sort(F.collect_list(F.struct("at", "reason"))).alias("rows"))
    joined = F.aggregate("rows", F.lit(""), lambda acc, r: F.when(acc == "", r["reason"]).when(F.contains(acc, r["reason"]) | F.contains(r["reason"], acc), acc).otherwise(F.concat(acc, F.lit("；"), r["reason"])))
    return held.select("ref", "action", joined.alias("reason"))


def gaps_opened(refusals: DataFrame, key: Column, ts: str) -> DataFrame:
    """(question_key, question, hit_count, opened): equal keys are one gap, the first question names it."""
    return refusals.where(key != "").groupBy(key.alias("question_key")).agg(F.min_by("question", ts).alias("question"), F.count("*").alias("hit_count"), F.min(ts).alias("opened"))


def gaps_closed(gaps: DataFrame, answered: DataFrame) -> DataFrame:
    """gaps with status: resolved where the key has been answered."""
    met = answered.select("question_key").distinct().withColumn("_met", F.lit(True))
    return gaps.join(met, "question_key", "left").withColumn("status", F.when(F.col("_met"), "resolved").otherwise("open")).drop("_met")


def triaged(assets: DataFrame, votes: DataFrame) -> DataFrame:
    """assets with verified_at taken away where a down-voted message cites them.

    votes (helpful, citations: array of structs with asset_id)."""
    cited = votes.where("helpful = false").select(F.explode("citations.asset_id").alias("asset_id")).where("asset_id is not null").distinct().withColumn("_down", F.lit(True))
    return assets.join(cited, "asset_id", "left").withColumn("verified_at", F.when(F.col("_down").isNull(), F.col("verified_at"))).drop("_down")


def down_voted(votes: DataFrame, assets: DataFrame, most: int = 3) -> DataFrame:
    """(asset_id, n, title): the assets that the most down-voted messages cite."""
    counts = votes.where("helpful = false").select(F.explode(F.array_distinct("citations.asset_id")).alias("asset_id")).where("asset_id is not null").groupBy("asset_id").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "asset_id").limit(most)
    return top.join(assets.select("asset_id", "title"), "asset_id", "left")


def citation_lineage(citations: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(asset_id, total, nth, message_id): how often an asset is cited, and its newest citations."""
    newest = W.partitionBy("asset_id").orderBy(F.desc("message_id"))
    total = citations.groupBy("asset_id").agg(F.count("*").alias("total"))
    some = citations.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= samples)
    return some.join(total, "asset_id").select("asset_id", "total", "nth", "message_id")


def id_ranges(rows: DataFrame, by: str, id_col: str, prefix: str, width: int = 4) -> DataFrame:
    """(by, ranges): runs of consecutive ids as `H-0002–H-0004、H-0007`."""
    at = rows.select(by, F.col(id_col).cast("long").alias("id")).distinct().withColumn("_run", F.col("id") - F.row_number().over(W.partitionBy(by).orderBy("id")))
    runs = at.groupBy(by, "_run").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    number = lambda c: F.concat(F.lit(f"{prefix}-"), F.when(F.length(F.col(c).cast("string")) < width, F.lpad(F.col(c).cast("string"), width, "0")).otherwise(F.col(c).cast("string")))
    label = F.when(F.col("first") == F.col("last"), number("first")).otherwise(F.concat(number("first"), F.lit("–"), number("last")))
    return runs.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("first", label.alias("label")))).alias("r")).select(by, F.array_join("r.label", "、").alias("ranges"))


def age_bucket(hours: Column) -> Column:
    return F.when(hours >= 120, "≥5 天").when(hours >= 24, "1–5 天").otherwise("24h 内")


def retire_plan(asked: DataFrame, assets: DataFrame) -> DataFrame:
    """(asset_id, verdict): to_retire, already or missing."""
    held = assets.select("asset_id", F.lit(True).alias("_held"), "discarded_at")
    return asked.join(held, "asset_id", "left").select("asset_id", F.when(F.col("_held").isNull(), "missing").when(F.col("discarded_at").isNotNull(), "already").otherwise("to_retire").alias("verdict"))


def training_samples(dialogues: DataFrame) -> DataFrame:
    """(asset_id, at, instruction, output): masked pairs of a question and an answer, both filled.

    dialogues (asset_id, qa_pairs: array of structs q, a)."""
    pairs = dialogues.select("asset_id", F.posexplode("qa_pairs").alias("at", "p")).where("trim(p.q) <> '' and trim(p.a) <> ''")
    return pairs.select("asset_id", "at", masked(F.col("p.q")).alias("instruction"), masked(F.col("p.a")).alias("output"))


def topic_groups(assets: DataFrame, topics: dict[str, list[str]]) -> DataFrame:
    """(topic, asset_id, n): assets whose title has a word of the topic, where there are more than one."""
    kinds = F.filter(F.array(*[F.when(F.coalesce(F.col("title"), F.lit("")).rlike("|".join(words)), F.lit(topic)) for topic, words in topics.items()]), lambda t: t.isNotNull())
    met = assets.select("asset_id", F.explode(kinds).alias("topic"))
    sizes = met.groupBy("topic").agg(F.count("*").alias("n")).where("n > 1")
    return met.join(F.broadcast(sizes), "topic").select("topic", "asset_id", "n")  # a row for each topic


def next_step(steps: Column) -> Column:
    """The first step that isn't done; null after a failed one or if all are done."""
    open_ = F.filter(steps, lambda s: s["status"] != "done")
    first = F.get(open_, F.lit(0))
    return F.when(first["status"] != "failed", first["name"])


def published_view(chunks: DataFrame, versions: DataFrame, assets: DataFrame) -> DataFrame:
    """Chunks of the versions that live, published assets point to."""
    live = assets.where("status = 'published' and discarded_at is null").select("asset_id", F.col("current_version_id").alias("version_id"))
    current = versions.join(live, ["asset_id", "version_id"]).select("asset_id", "version_no")
    return chunks.join(current, ["asset_id", "version_no"])


def rolled_back(versions: DataFrame, assets: DataFrame, target: DataFrame) -> DataFrame:
    """assets that may point to the asked version (asset_id, version_no): published once, not current, and no open revision."""
    open_ = versions.where("published_at is null").select("asset_id").distinct()
    asked = versions.where("published_at is not null").join(target, ["asset_id", "version_no"]).select("asset_id", F.col("version_id").alias("_to"))
    return assets.join(asked, "asset_id").where("_to <> current_version_id").join(open_, "asset_id", "left_anti").withColumn("current_version_id", F.col("_to")).drop("_to")


def current_version(assets: DataFrame, versions: DataFrame) -> DataFrame:
    """(asset_id, version_no): the version pointed to, else the first one."""
    met = versions.join(assets.select("asset_id", "current_version_id"), "asset_id")
    pointed = F.max(F.when(F.col("version_id") == F.col("current_version_id"), F.col("version_no")))
    return met.groupBy("asset_id").agg(F.coalesce(pointed, F.min("version_no")).alias("version_no"))


def asset_list(assets: DataFrame, versions: DataFrame, products: DataFrame) -> DataFrame:
    """(asset_id, title, product, version_no, revising): revising assets are published and have a version that isn't."""
    pointed = versions.select(F.col("version_id").alias("current_version_id"), "version_no")
    open_ = versions.where("published_at is null").select("asset_id").distinct().withColumn("_open", F.lit(True))
    met = assets.join(pointed, "current_version_id", "left").join(open_, "asset_id", "left").join(products.select("product_id", F.col("name").alias("product")), "product_id", "left")
    return met.select("asset_id", "title", "product", "version_no", (F.col("current_version_id").isNotNull() & F.col("_open").isNotNull()).alias("revising"))


def asset_detail(assets: DataFrame, versions: DataFrame) -> DataFrame:
    """(asset_id, versions): numbers in ascending order with whether they are published; as many as an asset has."""
    return versions.join(assets.select("asset_id"), "asset_id").groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("version_no", F.col("published_at").isNotNull().alias("published")))).alias("versions"))


def judge_summary(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """(by, judged, supported, failed, rate): the rate over judged rows alone."""
    judged, supported = F.count("supported"), F.count_if(F.col("supported"))
    return verdicts.groupBy(*by).agg(judged.alias("judged"), supported.alias("supported"), (judged - supported).alias("failed"), F.try_divide(supported, judged).alias("rate"))


def level_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(change, n): cases gained, lost or kept between two levels (key, hit)."""
    met = before.select(key, F.col("hit").alias("_a")).join(after.select(key, F.col("hit").alias("_b")), key)
    change = F.when(~F.col("_a") & F.col("_b"), "gained").when(F.col("_a") & ~F.col("_b"), "lost").otherwise("kept")
    return met.groupBy(change.alias("change")).agg(F.count("*").alias("n"))


def usage_totals(calls: DataFrame) -> DataFrame:
    """(model, direction, tokens): calls without usage don't count."""
    rows = calls.where("prompt_tokens is not null and completion_tokens is not null")
    pairs = F.array(F.struct(F.lit("prompt").alias("direction"), F.col("prompt_tokens").alias("tokens")), F.struct(F.lit("completion").alias("direction"), F.col("completion_tokens").alias("tokens")))
    return rows.select("model", F.explode(pairs).alias("p")).groupBy("model", "p.direction").agg(F.sum("p.tokens").alias("tokens"))


def evidence_lines(hits: DataFrame) -> DataFrame:
    """(query_id, evidence): `[A-id·vN] title：chunk` of each hit in order, without brackets and runs of blanks inside."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(masked(F.col(c)), r"[「」\[\]【】]", ""), r"\s+", " "))
    line = F.concat(F.lit("[A-"), F.col("asset_id").cast("string"), F.lit("·v"), F.col("version_no").cast("string"), F.lit("] "), plain("title"), F.lit("："), plain("chunk"))
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("r")).select("query_id", F.array_join("r.line", "\n").alias("evidence"))


def batches(rows: DataFrame, by: str, order: str, size: int = 200) -> DataFrame:
    """rows with batch: even parts of at most `size` consecutive rows of each group."""
    return rows.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(by).orderBy(order)) - 1) / size).cast("int"))


def first_matching_rule(rules: list[tuple[Column, str]], otherwise: Column) -> Column:
    """The label of the first rule that holds; the order matters."""
    label = F.lit(None)
    for condition, name in reversed(rules):
        label = F.when(condition, F.lit(name)).otherwise(label)
    return F.coalesce(label, otherwise)
