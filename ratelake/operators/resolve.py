"""Choosing among competing extractions: priorities, deduplication, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parsing as P

# Strategy priorities.
PRIORITY = {"network_api": 100, "jsonld": 90, "embedded_state": 80, "compare_cards": 70, "ui_enumeration": 60, "dom_parsing": 50}
VOLATILE = ("confidence_score", "extraction_method", "extraction_strategy", "strategy_priority")


def priority(strategy: Column, table: dict = PRIORITY) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), strategy), F.lit(0))


def select_strategy(rows: DataFrame, keys: list[str], strategy: str = "strategy", table: dict = PRIORITY) -> DataFrame:
    """All rows of each key's highest-priority strategy.  The maximum is an aggregate joined
    back, so a hot key is combined map-side and split by AQE."""
    p = rows.withColumn("_p", priority(F.col(strategy), table))
    best = p.groupBy(*keys).agg(F.max("_p").alias("_b"))
    return p.join(best, keys).where("_p = _b").drop("_p", "_b")


def first_wins(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in a total order.  A rank of one, so each task sends one row
    of a key at most (a window group limit)."""
    named = [F.col(c) if isinstance(c, str) else c for c in order]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*named))).where("_n = 1").drop("_n")


def product_key(product_id: Column, name: Column, rate: Column, state: Column) -> Column:
    """The id, else name, rate and the sorted filter state."""
    other = F.concat_ws("|", name, rate.cast("string"), F.array_join(F.array_sort(F.transform(F.map_entries(state), lambda e: F.concat_ws("=", e["key"], e["value"]))), ","))
    return F.coalesce(F.nullif(product_id, F.lit("")), other)


def component_key(rate: Column, rate_type: Column, term: Column, applicability: Column, volatile=VOLATILE) -> Column:
    """Rate, type, term and the sorted key:value pairs that don't change between captures."""
    kept = F.filter(F.map_entries(applicability), lambda e: ~e["key"].isin(*volatile))
    pairs = F.array_join(F.array_sort(F.transform(kept, lambda e: F.concat_ws(":", e["key"], e["value"]))), ",")
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat_ws("|", blank(rate), blank(rate_type), blank(term), pairs)


def merge_by_name(products: DataFrame, components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Products of a lender whose names agree up to qualifier and band become one: the first
    gives the row, under the base name; components are united, distinct by key.

    products(product_id, lender, name, seq), components(product_id, idx, ckey, ...).
    """
    p = products.withColumn("base_name", P.base_name(F.col("name")))
    merged = p.groupBy("lender", "base_name").agg(F.min_by("product_id", "seq").alias("merged_id"), F.count("*").alias("n_variants"))
    back = p.join(merged, ["lender", "base_name"]).select("product_id", "merged_id", "seq")
    united = first_wins(components.join(back, "product_id"), ["merged_id", "ckey"], ["seq", "idx"])
    return merged, united


def business_hash(lender: Column, name: Column, rate: Column, rate_type: Column) -> Column:
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.md5(F.concat_ws("|", blank(lender), blank(name), blank(rate), blank(rate_type)).cast("binary"))


def store(batch: DataFrame, index: DataFrame, order: list) -> tuple[DataFrame, DataFrame]:
    """(new rows, counts): rows whose ``h`` is neither in the index nor earlier in the batch;
    counts of stored rows, duplicates and rows without a hash (errors)."""
    fresh = first_wins(batch.where("h IS NOT NULL"), ["h"], order).join(index.select("h").distinct(), "h", "left_anti")
    total = batch.agg(F.count("*").alias("n"), F.count_if(F.col("h").isNull()).alias("errors"))
    counts = fresh.agg(F.count("*").alias("stored")).join(total).select("stored", (F.col("n") - F.col("errors") - F.col("stored")).alias("duplicates"), "errors")
    return fresh, counts


def top_per_group(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def skip_generic(structured: DataFrame, generic: DataFrame, call: str = "call_id") -> DataFrame:
    """Generic rows only of calls without structured rows, united with the structured ones."""
    return structured.unionByName(generic.join(structured.select(call).distinct(), call, "left_anti"), allowMissingColumns=True)


def broadcast_metadata(products: DataFrame, regions: Column, category: Column) -> DataFrame:
    """Metadata collected once applies to every product; a category only where unset."""
    return products.withColumn("region_restrictions", regions).withColumn("borrower_category", F.coalesce("borrower_category", category))
