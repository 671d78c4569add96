"""Publishing in batches: gate, chunks, pointers, write-back, audit and gaps as new states of the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vergence.functions import fields, text
from vergence.operators import assembly, governance
from vergence.sources.snapshots import Snapshots

#: Fields that are the text of a video and of an image; the latter counts only if a person confirmed it.
TRANSCRIPT, DESCRIPTION = "transcript", "图片描述"

State = dict[str, DataFrame]


def verdicts(state: State, asked: DataFrame) -> DataFrame:
    """For each asked asset whether its newest version is published, and what that version would publish.

    The verdict is `missing` without an asset, `no_version`, `state` (published already, discarded, or neither
    awaiting review nor live), `gate` with the fields that are missing or unconfirmed, `unreadable` without a body, or
    `published`.  Only documents of a known product have required fields.  Asked ids that are null or repeated count once or not at all.

    assets (asset_id, product_id, kind, status, current_version_id, discarded_at, verified_at); versions (version_id, asset_id,
    version_no, published_at, body, pairs, extracted, confirmed), one of each number; products (product_id, schema)."""
    wanted = asked.where("asset_id is not null").select("asset_id").distinct()
    own = state["versions"].join(wanted, "asset_id", "left_semi")
    newest = own.join(own.groupBy("asset_id").agg(F.max("version_no").alias("version_no")), ["asset_id", "version_no"])
    # the schema comes to the narrow side, so that texts are moved by asset alone
    held = state["assets"].select("asset_id", "product_id", "kind", "status", "current_version_id", "discarded_at", F.lit(True).alias("_held")).join(state["products"].select("product_id", "schema"), "product_id", "left")
    met = wanted.join(held, "asset_id", "left").join(newest, "asset_id", "left")

    gate = fields.publish_gate(F.when(F.col("kind") == "document", F.col("schema")), F.col("extracted"), F.col("confirmed"))
    of_field = {"video": fields.resolved_value(F.col("extracted"), F.col("confirmed"), F.lit(TRANSCRIPT)), "image": fields.confirmed_value(F.col("confirmed"), F.lit(DESCRIPTION))}
    body, shown = F.col("body"), F.transform_values("confirmed", lambda _, v: v["value"])
    for kind, name in (("video", TRANSCRIPT), ("image", DESCRIPTION)):
        body = F.when(F.col("kind") == kind, F.coalesce(of_field[kind], F.lit(""))).otherwise(body)
        shown = F.when(F.col("kind") == kind, fields.without_keys(shown, [name])).otherwise(shown)
    none = F.array().cast("array<string>")
    live = (F.col("status") == "pending_review") | ((F.col("status") == "published") & F.col("current_version_id").isNotNull())
    open_ = F.col("published_at").isNull() & F.col("discarded_at").isNull() & F.coalesce(live, F.lit(False))
    rows = met.select(
        "asset_id", "product_id", "version_id", "version_no", F.coalesce(gate["missing"], none).alias("missing"), F.coalesce(gate["unconfirmed"], none).alias("unconfirmed"),
        body.alias("body"), "pairs", shown.alias("fields"), fields.publishable_values(F.col("schema"), F.col("confirmed")).alias("writable"), "_held", open_.alias("_open"),
    )
    failed = (F.size("missing") > 0) | (F.size("unconfirmed") > 0)
    verdict = F.when(F.col("_held").isNull(), "missing").when(F.col("version_id").isNull(), "no_version").when(~F.col("_open"), "state").when(failed, "gate").when(F.col("body").isNull(), "unreadable").otherwise("published")
    return rows.withColumn("verdict", verdict).drop("_held", "_open")


def _as_is(name: str, rows: DataFrame) -> DataFrame:
    return rows


def published(state: State, decided: DataFrame, at: str, save: Callable[[str, DataFrame], DataFrame] = _as_is) -> State:
    """The tables after the assets with the verdict `published` are: assets, versions, chunks, values, audit and gaps.

    chunks (asset_id, version_no, seq, chunk) keep those of older versions.  values (product_id, field, value, asset_id, version_no):
    an asset's own fields that its version no longer has go, those of other assets stay; of several assets that write a field the one
    of the highest id does.  gaps (gap_id, question, asset_id, status, resolved_at): open ones of a published asset are resolved if a
    chunk that is live afterwards shares a term with the question or its synonyms.  Each table goes through `save` before others use it."""
    now, done = F.lit(at).cast("timestamp"), decided.where("verdict = 'published'")
    out: State = {}

    pointed = done.select("asset_id", F.col("version_id").alias("_to"))
    assets = state["assets"].join(pointed, "asset_id", "left")
    is_done = F.col("_to").isNotNull()
    changed = {"status": F.when(is_done, "published").otherwise(F.col("status")), "current_version_id": F.coalesce("_to", "current_version_id"), "verified_at": F.when(is_done, now).otherwise(F.col("verified_at"))}
    out["assets"] = save("assets", assets.withColumns(changed).drop("_to"))

    stamped = done.select("version_id", F.lit(True).alias("_done"))
    out["versions"] = save("versions", state["versions"].join(stamped, "version_id", "left").withColumn("published_at", F.when(F.col("_done"), now).otherwise(F.col("published_at"))).drop("_done").select(*state["versions"].columns))

    numbers = done.select("asset_id", "version_no")
    fresh = assembly.index_rows(done).join(numbers, "asset_id").select("asset_id", "version_no", "seq", "chunk")
    out["chunks"] = save("chunks", state["chunks"].select(*fresh.columns).unionByName(fresh))

    of_product = done.where("writable is not null")  # null where the product isn't known
    written = of_product.select("product_id", "asset_id", "version_no", F.explode("writable").alias("field", "value")).groupBy("product_id", "field").agg(F.max(F.struct("asset_id", "version_no", "value")).alias("w"))
    kept = state["values"].join(of_product.select("product_id", "asset_id"), ["product_id", "asset_id"], "left_anti").join(written.select("product_id", "field"), ["product_id", "field"], "left_anti")
    out["values"] = save("values", kept.select("product_id", "field", "value", "asset_id", "version_no").unionByName(written.select("product_id", "field", "w.value", "w.asset_id", "w.version_no")))

    line = done.select("asset_id", "version_no", F.lit("publish").alias("action"), now.alias("at"))
    out["audit"] = save("audit", state["audit"].select(*line.columns).unionByName(line))

    due = state["gaps"].where("status = 'open'").join(done.select("asset_id"), "asset_id", "left_semi")
    wording = F.array_union(text.terms(F.col("question")), text.terms(text.rotated_synonyms(F.col("question"))))
    asked = due.select("gap_id", F.explode(wording).alias("term"))
    held = governance.published_view(out["chunks"], out["versions"], out["assets"]).select(F.explode(text.tokens(F.col("chunk"))).alias("term")).distinct()
    answered = asked.join(held, "term", "left_semi").select("gap_id").distinct().withColumn("_met", F.lit(True))
    gaps = state["gaps"].join(answered, "gap_id", "left")
    out["gaps"] = save("gaps", gaps.withColumns({"status": F.when(F.col("_met"), "resolved").otherwise(F.col("status")), "resolved_at": F.when(F.col("_met"), now).otherwise(F.col("resolved_at"))}).drop("_met"))
    return out


def publish_batch(spark: SparkSession, root: str, asked: DataFrame, at: str) -> DataFrame:
    """Publishes into the state in `root`; gives the verdicts.

    All tables change at once or not at all; publishing the same assets again finds nothing to publish and leaves the state as it is."""
    tables = Snapshots(spark, root)
    state = tables.current()
    decided = tables.stage("verdicts", verdicts(state, asked))
    if not decided.where("verdict = 'published'").isEmpty():
        published(state, decided, at, tables.stage)
        tables.commit()
    return decided
