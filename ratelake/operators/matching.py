"""Borrower measures and product matching (specified by its types only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: offers listed at once, which bounds what a task holds
BLOCK = 4096


def net_monthly(income: Column) -> Column:
    return income / 12 * 0.7


def available(income: Column, debts: Column) -> Column:
    return net_monthly(income) - debts


def lvr_percent(loan: Column, value: Column) -> Column:
    return F.try_divide(loan, value) * 100


def repayment(principal: Column, rate_percent: Column, months: Column) -> Column:
    """Level monthly payment of an amortising loan; without interest the plain share."""
    i = rate_percent / 1200
    return F.when(i == 0, principal / months).otherwise(principal * i / (1 - F.pow(1 + i, -months)))


def match(applications: DataFrame, offers: DataFrame, max_lvr: float = 95.0) -> DataFrame:
    """applications(app_id, segment, income, debts, amount, value, months) meet the offers of
    their segment; an offer fits under its ratio and the money available; score 0 to 100 by
    the share of the available money that stays.

    A pair's figures depend on the offer's terms only, so an application meets the terms once for
    each block of offers, and the offers of a block are listed last.  Blocks go to every task
    (eight bytes an offer); applications are dealt out evenly, as segments are few."""
    spark = applications.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    ids = F.transform(F.collect_list(F.struct("offer_id")), lambda x: x["offer_id"])  # a bare list would lose nulls
    blocks = F.transform(F.sequence(F.lit(1), F.size("ids"), F.lit(BLOCK)), lambda at: F.slice("ids", at, BLOCK))
    terms = offers.groupBy("segment", "rate", "offer_max_lvr").agg(ids.alias("ids")).withColumn("ids", F.explode(blocks))
    j = applications.repartition(tasks).join(F.broadcast(terms), "segment")
    ratio = lvr_percent(F.col("amount"), F.col("value"))
    pay = repayment(F.col("amount"), F.col("rate"), F.col("months"))
    free = available(F.col("income"), F.col("debts"))
    j = j.withColumn("lvr", ratio).withColumn("payment", pay).withColumn("free", free)
    j = j.where((F.col("lvr") <= F.least(F.col("offer_max_lvr"), F.lit(max_lvr))) & (F.col("payment") <= F.col("free")))
    j = j.select("app_id", "ids", F.round("lvr", 4).alias("lvr"), F.round("payment", 4).alias("payment"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(100 * (1 - F.col("payment") / F.col("free")), 4))).alias("score"))
    return j.select("app_id", F.explode("ids").alias("offer_id"), "lvr", "payment", "score")
