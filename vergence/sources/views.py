"""The model's tables as views of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vergence.functions import text

#: The end of the events, which stands for now.
AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table that is read by fewer tasks than there are cores is dealt out to all of them; larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset_id, version_no, title, source_kind, lang, body): each document is a published asset of one version."""
    first = text.stripped(F.substring_index("text", "\n", 1))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    return docs.select(F.col("doc_id").alias("asset_id"), F.lit(1).alias("version_no"), first.alias("title"), F.col("source").alias("source_kind"), "lang", F.col("text").alias("body"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset_id, version_no, seq, chunk)."""
    every = assets(spark, sf_dir).select("asset_id", "version_no", F.posexplode_outer(text.document_chunks(F.col("body"))).alias("seq", "chunk"))
    return every.where("chunk is not null")  # after the explosion, so that no filter computes the chunks a second time


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, question)."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, session_id, turn, role, content) of customers and agents."""
    role = F.when(F.col("role") == "user", "customer").when(F.col("role") == "assistant", "agent")
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session_id"), "turn", role.alias("role"), F.col("text").alias("content"))
    return rows.where("role is not null")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, category, brand, stock, price_cents, currency)."""
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"), (F.col("p_size") % 10).alias("stock"), F.when(F.col("p_size") % 7 != 0, cents).alias("price_cents"), F.lit("CNY").alias("currency"))


#: Questions that stand for what customers ask: {n} is the product's name, {t} its category, {k} its id.
ASKS = (
    "{n}多少钱", "{n}有货吗", "你们卖什么", "{n}的净含量是多少", "我想退货", "退货政策是什么", "转人工", "有没有{n}", "有没有优惠", "运费谁承担", "物流怎么样？", "这个{n}怎么卖，便宜吗",
    "我刚才问的上一个问题是什么", "so-{k}到哪了", "{t}卖多少钱", "{t}还有货吗", "{n}的保修和发票", "它的味道怎么样", "{n}壳有货吗", "刻字要多少运费",
    "{n}刻字怎么收费", "请问{n}多少钱一个", "{t}的保养收费吗", "{t}多少钱，包邮吗",
)


def asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, product_id, name, category, question): for each product one of the questions above."""
    part = table(spark, sf_dir, "part")
    pattern = F.get(F.array(*map(F.lit, ASKS)), (F.col("p_partkey") % len(ASKS)).cast("int"))
    for mark, column in (("{n}", "p_name"), ("{t}", "p_type"), ("{k}", "p_partkey")):
        pattern = F.replace(pattern, F.lit(mark), F.col(column).cast("string"))
    return part.select(F.col("p_partkey").alias("query_id"), F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), pattern.alias("question"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")
