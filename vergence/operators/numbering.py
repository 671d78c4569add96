"""Numbers over a whole table, and batches that can be taken up again, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges of the leading value, and the accuracy of their bounds.
RANGES, ACCURACY = 64, 10_000
#: Vectors of a batch, and their dimensions.
BATCH_ROWS, DIMENSIONS = 64, 1024


def numbered(rows: DataFrame, lead: Column, *then: Column, name: str = "place", ranges: int = RANGES) -> DataFrame:
    """The rows with their place from 1, by lead ascending (a number; nulls first) and then the other columns.

    Bounds of about equal ranges of lead part the rows; ranges are counted, and a row's place is
    its place in its range after the rows of all before.  Bounds and counts, `ranges` numbers, go
    to the driver.  Rows with one value of lead share a range, so lead should have few ties."""
    of = rows.withColumn("_lead", lead.cast("double"))
    bounds = sorted(set(of.agg(F.percentile_approx("_lead", [i / ranges for i in range(1, ranges)], ACCURACY)).first()[0] or []))
    part = F.coalesce(sum((F.col("_lead") > b).cast("int") for b in bounds), F.lit(0)) if bounds else F.lit(0)
    of = of.withColumn("_part", F.when(F.col("_lead").isNull(), -1).otherwise(part))
    counts, before, total = dict(map(tuple, of.groupBy("_part").count().collect())), {}, 0
    for p in sorted(counts):
        before[p], total = total, total + counts[p]
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("_part")) if before else F.lit(0)
    place = F.row_number().over(W.partitionBy("_part").orderBy(F.asc_nulls_first("_lead"), *then)) + offset
    return of.withColumn(name, place.cast("long")).drop("_lead", "_part")


def embedded(vectors: DataFrame, dimensions: int = DIMENSIONS, vector_col: str = "embedding") -> Column:
    """Vectors that are kept: of the model's dimensions, every component a finite number."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == dimensions) & ~bad, F.lit(False))


def embedding_batches(items: DataFrame, vectors: DataFrame, key: str, dimensions: int = DIMENSIONS, most: int = BATCH_ROWS) -> DataFrame:
    """(key, batch, slot): the items that still want a vector, in batches of `most` by key.

    vectors (key, embedding) is the ledger of what earlier runs have given; a vector of other
    dimensions doesn't count, so its item is due again.  A run that adds its vectors to the ledger
    and stops leaves the rest to the next one.  Items that repeat a key are one; null keys have none."""
    done = vectors.where(embedded(vectors, dimensions)).select(key)
    due = items.where(F.col(key).isNotNull()).select(key).distinct().join(done, key, "left_anti")
    placed = numbered(due, F.col(key), F.col(key), name="_place")
    return placed.select(key, F.floor((F.col("_place") - 1) / most).cast("long").alias("batch"), ((F.col("_place") - 1) % most).cast("int").alias("slot"))
