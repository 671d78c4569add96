"""Readers of the raw files and writers of exports."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vergence.functions.text import masked, stripped

#: Bytes of the largest imported text; rows of the largest import.
MOST_BYTES, MOST_ROWS = 200_000, 200


def read_csv(spark: SparkSession, path: str, columns: list[str], sep: str = ",") -> DataFrame:
    """The named columns, trimmed, in any order of the header; a byte-order mark is passed over."""
    raw = spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"', encoding="UTF-8")
    names = {c.replace("﻿", "").strip(): c for c in raw.columns}
    missing = [c for c in columns if c not in names]
    if missing:
        raise ValueError(f"the header lacks {', '.join(missing)}")
    return raw.select(*[stripped(F.coalesce(F.col(f"`{names[c]}`"), F.lit(""))).alias(c) for c in columns])


def import_report(rows: DataFrame, number: str) -> DataFrame:
    """rows (number, title, content) with the reason for which a row is skipped; null for a valid one.

    An import of more than 200 rows is turned down whole."""
    if rows.limit(MOST_ROWS + 1).count() > MOST_ROWS:
        raise ValueError(f"an import has {MOST_ROWS} rows at most")
    title, content = F.col("title") == "", F.col("content") == ""
    reason = F.when(title & content, "both empty").when(title, "title empty").when(content, "content empty").when(F.octet_length("content") > MOST_BYTES, "content too long")
    return rows.withColumn("reason", reason).orderBy(number)


def merged_report(created: DataFrame, failed: DataFrame, skipped: DataFrame) -> DataFrame:
    """One report by row number."""
    part = lambda df, outcome: df.select("row", F.lit(outcome).alias("outcome"), (F.col("reason") if "reason" in df.columns else F.lit(None).cast("string")).alias("reason"))
    return part(created, "created").unionByName(part(skipped, "skipped")).unionByName(part(failed, "failed")).orderBy("row")


def read_dialogues(spark: SparkSession, path: str) -> DataFrame:
    """(split, convo_id, at, author, text) of nested dialogues: customers and agents alone, no blanks."""
    convo = "array<struct<convo_id: int, scenario: struct<flow: string, subflow: string>, original: array<array<string>>>>"
    raw = spark.read.schema(f"train {convo}, dev {convo}, test {convo}").json(path, multiLine=True)
    parts = None
    for i, name in enumerate(("train", "dev", "test")):
        of = raw.select(F.lit(i).alias("split"), F.explode(name).alias("c")).select("split", "c.convo_id", F.posexplode("c.original").alias("at", "line"))
        parts = of if parts is None else parts.unionByName(of)
    found = parts.select("split", "convo_id", "at", F.col("line")[0].alias("author"), stripped(F.col("line")[1]).alias("text"))
    return found.where("author in ('customer', 'agent') and text <> ''")


def read_bindings(spark: SparkSession, path: str, most: int = 50) -> DataFrame:
    """(name, category, qid) of query results: without missing or unlabelled names, the first of equal ones, at most `most` of a category."""
    from pyspark.sql import Window as W

    cell = "struct<value: string, type: string>"
    raw = spark.read.schema(f"results struct<bindings: array<map<string, {cell}>>>").json(path, multiLine=True).select(F.posexplode("results.bindings").alias("at", "b"))
    value = lambda k: F.try_element_at("b", F.lit(k))["value"]
    rows = raw.select("at", F.substring(value("itemLabel"), 1, 200).alias("name"), value("categoryLabel").alias("category"), F.regexp_extract(value("item"), r"(Q\d+)$", 1).alias("qid")).where("name is not null and category is not null and name <> qid")
    once = rows.withColumn("_n", F.row_number().over(W.partitionBy("name", "category").orderBy("at"))).where("_n = 1")
    return once.withColumn("_n", F.row_number().over(W.partitionBy("category").orderBy("at"))).where(F.col("_n") <= most).select("name", "category", "qid")


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    """Products with their attributes, a JSON object of strings, as a map; a broken one is null."""
    rows = read_csv(spark, path, ["name", "category", "attrs"])
    return rows.withColumn("attrs", F.from_json("attrs", T.MapType(T.StringType(), T.StringType())))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, ok) of files; bytes that are no UTF-8 have no text."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text")).withColumn("ok", F.col("text").isNotNull())


def read_zipped_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """(path, at, *columns), trimmed, of the first CSV file in each archive; it is UTF-8 or else GB18030.

    An archive is read by one task; one without a CSV file, or whose text is neither, fails the job."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    raw = archive.read(next(n for n in archive.namelist() if n.lower().endswith(".csv")))
                try:
                    decoded = raw.decode("utf-8-sig")
                except UnicodeDecodeError:
                    decoded = raw.decode("gb18030")
                found = pd.read_csv(io.StringIO(decoded), dtype=str, keep_default_na=False).rename(columns=str.strip)[columns]
                found = found.apply(lambda c: c.str.strip())
                found.insert(0, "at", range(len(found)))
                found.insert(0, "path", name)
                yield found

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(rows, ", ".join(["path string", "at long", *[f"`{c}` string" for c in columns]]))


def write_samples(samples: DataFrame, path: str) -> None:
    """JSON lines, masked: one object for each sample (instruction, output, source)."""
    masked_ = samples.select(*[masked(F.col(c)).alias(c) if dict(samples.dtypes)[c] == "string" else F.col(c) for c in samples.columns])
    masked_.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str, sep: str = ",") -> None:
    """Files with a header each, which a byte-order mark comes before."""
    first, *_ = rows.columns
    rows.withColumnRenamed(first, f"\ufeff{first}").write.mode("overwrite").csv(path, header=True, sep=sep)


def missing_rows(fresh: DataFrame, held: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key isn't held yet."""
    return fresh.join(held.select(*key), key, "left_anti")


def filled_rows(held: DataFrame, fresh: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Held rows with nulls of the columns filled from fresh ones of the same key."""
    renamed = fresh.select(*key, *[F.col(c).alias(f"_{c}") for c in columns])
    return held.join(renamed, key, "left").withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).select(*held.columns)


def latest(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The last row of each key, and when the key was first seen."""
    every = F.struct(*rows.columns)
    return rows.groupBy(*key).agg(F.max_by(every, order).alias("r"), F.min(order).alias("created")).select("r.*", "created")
