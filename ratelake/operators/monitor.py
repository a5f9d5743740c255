"""Collection monitoring over an append-only event log; every function takes ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resolve import top_per_group


def latest(events: DataFrame, keys: list[str] = ["lender", "collection_type"]) -> DataFrame:  # noqa: B006
    """The latest event of each key; ties by event_id."""
    cols = events.columns
    return events.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct("ts", "event_id")).alias("_r")).select("_r.*")


def within(as_of: Column, hours: float) -> Column:
    return F.col("ts") >= as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600.0))


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(3.6e9)


def stats(events: DataFrame, as_of: Column, hours: float = 24) -> DataFrame:
    """Totals over the latest event of each key in the last hours."""
    e = latest(events).where(within(as_of, hours))
    ok = F.col("success")
    return e.agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("successful"),
        F.count_if(~ok).alias("failed"),
        F.coalesce(F.sum(F.when(ok, F.col("products"))), F.lit(0)).cast("long").alias("products"),
        F.coalesce(F.try_divide(F.count_if(ok), F.count("*")), F.lit(0.0)).alias("success_rate"),
    )


def lender_stats(events: DataFrame, as_of: Column, hours: float = 24) -> DataFrame:
    e = latest(events).where(within(as_of, hours))
    return e.groupBy("lender").agg(F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed"), F.coalesce(F.sum(F.when(F.col("success"), F.col("products"))), F.lit(0)).cast("long").alias("products"))


def stale(events: DataFrame, as_of: Column, max_age_hours: float = 24) -> DataFrame:
    """Latest events that succeeded but are older than the limit."""
    age = hours_between(as_of, F.col("ts"))
    return latest(events).where(F.col("success") & (age > max_age_hours)).select("lender", "collection_type", "ts", F.round(age, 6).alias("hours_old"))


def health(events: DataFrame, as_of: Column, hours: float = 24, max_age_hours: float = 24) -> DataFrame:
    """critical if more fail than succeed, else unhealthy if anything is stale, else degraded
    under 80 % success, else healthy."""
    s = stats(events, as_of, hours)
    n = stale(events, as_of, max_age_hours).agg(F.count("*").alias("n_stale"))
    status = F.when(F.col("failed") > F.col("successful"), "critical").when(F.col("n_stale") > 0, "unhealthy").when(F.col("success_rate") < 0.8, "degraded").otherwise("healthy")
    return s.join(n).select("total", "successful", "failed", "success_rate", "n_stale", status.alias("status"))


def alerts(events: DataFrame, as_of: Column | None = None, keep: int = 100, max_age_days: int | None = None) -> DataFrame:
    """Failures as alerts: the last ``keep``, none older than ``max_age_days``.

    Top-k is by a global sort with a limit, which Spark runs as per-task heaps.
    """
    a = events.where(~F.col("success"))
    if as_of is not None and max_age_days is not None:
        a = a.where(within(as_of, 24.0 * max_age_days))
    return a.select("event_id", "ts", "lender", F.concat(F.lit("Collection failed for "), "lender").alias("message")).orderBy(F.desc("ts"), F.desc("event_id")).limit(keep)


def last_per_lender(events: DataFrame, n: int = 5) -> DataFrame:
    return top_per_group(events.where(~F.col("success")), ["lender"], [F.desc("ts"), F.desc("event_id")], n)


def catalog(log: DataFrame, only_success: bool = False) -> DataFrame:
    """Latest entry per lender of an append log; with ``only_success`` failures don't replace."""
    return latest(log.where("success") if only_success else log, ["lender"])


def daily(events: DataFrame) -> DataFrame:
    """A run summary per day."""
    return events.groupBy(F.to_date("ts").alias("day")).agg(F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed"), F.count("*").alias("total"), F.coalesce(F.sum("products"), F.lit(0)).cast("long").alias("products"))


def totals(events: DataFrame) -> DataFrame:
    return events.agg(F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed"))


def usage(searches: DataFrame, quota: int = 100, per_thousand: float = 5.0) -> DataFrame:
    """Search calls by day, what is left of the quota, and their cost."""
    d = searches.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("queries"))
    return d.select("day", "queries", F.greatest(F.lit(0), F.lit(quota) - F.col("queries")).alias("remaining"), (F.col("queries") * per_thousand / 1000).alias("cost"))
