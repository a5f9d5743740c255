"""Product queries: filters that reach the scan, listings, changes and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def products(df: DataFrame, lender: str | None = None, rate_type: str | None = None, min_rate: float | None = None, max_rate: float | None = None, limit: int | None = 100, order: tuple = ("product_id",)) -> DataFrame:
    """Case-insensitive equality on lender and type, inclusive bounds on the rate; empty or zero
    arguments don't filter.  The order is total, so a limit is repeatable."""
    if lender:
        df = df.where(F.lower("lender") == lender.lower())
    if rate_type:
        df = df.where(F.lower("rate_type") == rate_type.lower())
    if min_rate:
        df = df.where(F.col("rate") >= min_rate)
    if max_rate:
        df = df.where(F.col("rate") <= max_rate)
    df = df.orderBy(*order)
    return df.limit(limit) if limit else df


def by_lender(df: DataFrame, lender: str, limit: int = 50) -> DataFrame:
    return products(df, lender=lender, limit=limit)


def changes(df: DataFrame, as_of: Column, days: int) -> DataFrame:
    return df.where(F.col("collected_at") >= as_of - F.make_dt_interval(F.lit(days)))


def stats(df: DataFrame) -> DataFrame:
    """Counts by lender, by rate type and in all: one aggregation over grouping sets."""
    g = df.groupingSets([["lender"], ["rate_type"], []], "lender", "rate_type")
    kind = F.when(F.grouping_id() == 1, "lender").when(F.grouping_id() == 2, "rate_type").otherwise("all")
    return g.agg(F.count("*").alias("n"), kind.alias("kind")).select("kind", F.coalesce("lender", "rate_type", F.lit("")).alias("value"), "n")


def priority_order(lenders: DataFrame) -> DataFrame:
    """Enabled lenders by priority (unset: 999), then place in the configuration."""
    return lenders.where("enabled").select("*", F.coalesce("priority", F.lit(999)).alias("rank")).orderBy("rank", "config_idx")


def find_lender(lenders: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(q): the first lender whose name or abbreviation agrees, whatever the case."""
    both = lenders.select(F.explode(F.array_distinct(F.array(F.lower("lender_name"), F.lower("abbreviation")))).alias("_k"), "config_idx", "lender_name")
    first = both.groupBy("_k").agg(F.min_by("lender_name", "config_idx").alias("lender_name"))
    return wanted.join(first, F.lower(wanted["q"]) == first["_k"], "left").select("q", "lender_name")
