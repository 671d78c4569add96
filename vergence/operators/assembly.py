"""Batches that put tables together: index rows, exports, audits, evaluation cases, ordered views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vergence.functions.text import document_chunks, masked

#: Shares of a golden set by kind in per cent, and cases of one asset.
GOLDEN, OF_ASSET = {"positive": 40, "confusion": 25, "refusal": 15, "history": 20}, 2


def allowed(column: Column, names: str) -> Column:
    """The value is in a list with commas; a blank list allows all."""
    kept = [n.strip() for n in names.split(",") if n.strip()]
    return column.isin(*kept) if kept else F.lit(True)


def index_rows(assets: DataFrame, most: int | None = None) -> DataFrame:
    """(asset_id, seq, chunk): first question and answer pairs, then the body's chunks, then other confirmed fields by name.

    assets (asset_id, pairs: array of structs q and a, body, fields: map)."""
    pairs = F.transform(F.coalesce("pairs", F.array().cast("array<struct<q:string,a:string>>")), lambda p: F.concat(F.lit("问："), p["q"], F.lit(" 答："), p["a"]))
    names = F.array_sort(F.map_keys("fields"))
    fields = F.filter(F.transform(names, lambda k: F.when(F.trim(F.try_element_at(F.col("fields"), k)) != "", F.concat(k, F.lit("："), F.try_element_at(F.col("fields"), k)))), lambda x: x.isNotNull())
    every = F.concat(pairs, F.coalesce(document_chunks(F.col("body")), F.array().cast("array<string>")), F.coalesce(fields, F.array().cast("array<string>")))
    rows = assets.select("asset_id", F.posexplode_outer(every if most is None else F.slice(every, 1, most)).alias("seq", "chunk"))
    return rows.where("chunk is not null")


def exported(assets: DataFrame) -> DataFrame:
    """(asset_id, title, content) of published assets, masked."""
    return assets.where("published").select("asset_id", masked(F.col("title")).alias("title"), masked(F.col("body")).alias("content"))


def audit_rows(rows: DataFrame, action: str, at: str) -> DataFrame:
    """(asset_id, action, at): one audit row for each row."""
    return rows.select("asset_id", F.lit(action).alias("action"), F.lit(at).cast("timestamp").alias("at"))


def first_of(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key by the order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(order))).where("_n = 1").drop("_n")


def in_order_of_first(rows: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """(key, values): the distinct values in the order in which they first come; as many as a key has."""
    firsts = rows.groupBy(key, value).agg(F.min(at).alias("_at"))
    return firsts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", value))), lambda x: x[value]).alias("values"))


def best_in_time(rows: DataFrame, by: str, score: str, time: str, least: float, k: int) -> DataFrame:
    """rows with place: of those that score enough the k best (the earlier of equals), then in the order of time."""
    best = rows.where(F.col(score) >= least).withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(F.desc(score), time))).where(F.col("_n") <= k)
    return best.drop("_n").withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(time)))


def counts_report(counts: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(name, n): one row for each named count, each read once."""
    out = None
    for name, (df, condition) in counts.items():
        row = df.agg(F.count_if(F.coalesce(condition, F.lit(False))).alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def findings(checks: dict[str, tuple[DataFrame, Column, str]]) -> DataFrame:
    """(check, ref, action) of all checks: (rows with ref, condition, action)."""
    out = None
    for name, (df, condition, action) in checks.items():
        found = df.where(condition).select(F.lit(name).alias("check"), F.col("ref").cast("long").alias("ref"), F.lit(action).alias("action"))
        out = found if out is None else out.unionByName(found)
    return out


def golden_set(candidates: DataFrame, size: int, shares: dict[str, int] | None = None, of_asset: int = OF_ASSET) -> DataFrame:
    """(kind, asset_id, id): of each kind its share of `size` cases by id, at most two of an asset."""
    shares = GOLDEN if shares is None else shares
    most = F.create_map(*[F.lit(x) for kind, share in shares.items() for x in (kind, size * share // 100)])
    few = candidates.withColumn("_of", F.row_number().over(W.partitionBy("kind", "asset_id").orderBy("id"))).where(F.col("_of") <= of_asset)
    return few.withColumn("_n", F.row_number().over(W.partitionBy("kind").orderBy("id"))).where(F.col("_n") <= F.coalesce(F.try_element_at(most, F.col("kind")), F.lit(0))).select("kind", "asset_id", "id")


def sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows, or all, by the least MD5 of seed and key: the same ones each time."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).limit(n)


def row_faults(name: Column, category: Column, price: Column, currency: Column) -> Column:
    """What is wrong with a product row, in order."""
    rules = [
        (F.trim(F.coalesce(name, F.lit(""))) == "", "name"), (F.length(F.trim(name)) > 200, "name length"), (F.length(category) > 50, "category length"), (price < 0, "price"),
        (~F.coalesce(currency, F.lit("CNY")).rlike("^[A-Za-z]{3}$"), "currency"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in rules]))


def parsed_scores(answer: Column, schema: str) -> Column:
    """The JSON object inside a code fence or alone; null if it is none."""
    return F.from_json(F.trim(F.regexp_replace(answer, "(?s)^\\s*```(?:json)?\\s*(.*?)\\s*```\\s*$", "$1")), schema)


def event_blocks(lines: DataFrame, by: str, at: str) -> DataFrame:
    """(by, block, event, data): lines `event: x` and `data: y` between blank ones, put together."""
    numbered = lines.withColumn("block", F.sum(F.when(F.trim("line") == "", 1).otherwise(0)).over(W.partitionBy(by).orderBy(at))).where(F.trim("line") != "")
    value = lambda name: F.when(F.col("line").startswith(f"{name}:"), F.ltrim(F.substring_index("line", f"{name}:", -1)))
    return numbered.groupBy(by, "block").agg(F.max(value("event")).alias("event"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(value("data").isNotNull(), F.struct(F.col(at).alias("at"), value("data").alias("d"))))), lambda x: x["d"]), "\n").alias("data"))


def merged_chunks(segments: DataFrame, by: str) -> DataFrame:
    """Speech segments with their chunk's offset: ends before starts are swapped, blank ones go, in the order of time."""
    s, e = F.col("start") + F.col("offset"), F.col("end") + F.col("offset")
    rows = segments.where(F.trim(F.coalesce("text", F.lit(""))) != "").select(by, F.least(s, e).alias("start"), F.greatest(s, e).alias("end"), "text")
    return rows.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy("start", "end", "text")))
