"""Products, stock, prices and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vergence.functions.text import price_label

#: Products of a listing, stock that is low, days in which an order can be returned, products of the first page.
LISTED, LOW_STOCK, RETURN_DAYS, FIRST_PAGE = 8, 5, 15, 24


def stock_by_category(products: DataFrame) -> DataFrame:
    """(category, total, in_stock, stock): a category whose stock is unknown throughout has none."""
    return products.groupBy("category").agg(F.count("*").alias("total"), F.count_if(F.col("stock") > 0).alias("in_stock"), F.sum("stock").alias("stock"))


def prices_by_category(products: DataFrame) -> DataFrame:
    """(category, total, priced, low, high): the range only within a single currency."""
    one = F.count_distinct(F.when(F.col("price_cents").isNotNull(), F.col("currency"))) == 1
    return products.groupBy("category").agg(F.count("*").alias("total"), F.count("price_cents").alias("priced"), F.when(one, F.min("price_cents")).alias("low"), F.when(one, F.max("price_cents")).alias("high"))


def listing(products: DataFrame, most: int = LISTED) -> DataFrame:
    """(category, nth, name, label): the first priced products of each category."""
    order = W.partitionBy("category").orderBy("id")
    return products.where("price_cents is not null").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).select("category", "nth", "name", price_label(F.col("price_cents"), F.col("currency")).alias("label"))


def first_page(products: DataFrame, rows: int = FIRST_PAGE) -> DataFrame:
    """(id, place): priced products, then those with a brand, then the rest; the first page alone."""
    kind = F.when(F.col("price_cents").isNotNull(), 0).when(F.col("brand").isNotNull(), 1).otherwise(2)
    first = products.select("id", kind.alias("kind")).orderBy("kind", "id").limit(rows)
    return first.select("id", F.row_number().over(W.orderBy("kind", "id")).alias("place"))  # of a page


def order_summary(orders: DataFrame, items: DataFrame) -> DataFrame:
    """(order_no, status, n_items, quantity): orders with their items counted; an order may have none."""
    counts = items.groupBy("l_orderkey").agg(F.count("*").alias("n_items"), F.sum("l_quantity").alias("quantity"))
    return orders.join(counts, orders["o_orderkey"] == counts["l_orderkey"], "left").select(F.concat(F.lit("SO-"), "o_orderkey").alias("order_no"), F.col("o_orderstatus").alias("status"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("quantity", F.lit(0.0)).alias("quantity"))


def returnable(asked: DataFrame, orders: DataFrame, as_of: Column, days: int = RETURN_DAYS) -> DataFrame:
    """(order_no, verdict) of the order numbers asked for: eligible, ineligible or not_found."""
    known = orders.select(F.concat(F.lit("SO-"), "o_orderkey").alias("order_no"), "o_orderdate")
    inside = as_of - F.col("o_orderdate") <= F.expr(f"interval {days} days")
    return asked.join(known, "order_no", "left").select("order_no", F.when(F.col("o_orderdate").isNull(), "not_found").when(inside, "eligible").otherwise("ineligible").alias("verdict"))


def never_ordered(products: DataFrame, items: DataFrame) -> DataFrame:
    return products.join(items.select(F.col("l_partkey").alias("id")), "id", "left_anti").select("id", "name", "category")


def customer_orders(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """(c_custkey, n_orders, spent_cents, last_order): every customer, also without orders."""
    sums = orders.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("spent_cents"), F.max("o_orderdate").alias("last_order"))
    return customers.join(sums, customers["c_custkey"] == sums["o_custkey"], "left").select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.coalesce("spent_cents", F.lit(0)).alias("spent_cents"), "last_order")


def signals(products: DataFrame, items: DataFrame, low: int = LOW_STOCK, most: int = 10) -> DataFrame:
    """(priority, signal, id): the first products out of stock, low in stock and never ordered, in the order of priority."""
    kinds = [(1, "stock_out", products.where("stock = 0")), (2, "stock_low", products.where(f"stock > 0 and stock <= {low}")), (3, "no_orders", never_ordered(products, items))]
    out = None
    for priority, name, rows in kinds:
        some = rows.select(F.lit(priority).alias("priority"), F.lit(name).alias("signal"), "id").orderBy("id").limit(most)
        out = some if out is None else out.unionByName(some)
    return out


def running_start(items: DataFrame) -> DataFrame:
    """(l_orderkey, l_linenumber, start): the sum of the quantities of the lines before it."""
    before = W.partitionBy("l_orderkey").orderBy("l_linenumber").rowsBetween(W.unboundedPreceding, -1)
    return items.select("l_orderkey", "l_linenumber", F.coalesce(F.sum("l_quantity").over(before), F.lit(0.0)).alias("start"))
