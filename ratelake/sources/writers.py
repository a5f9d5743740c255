"""Writers: current products, snapshots, catalogs, quarantine and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parsing as P


def current(products: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace the lenders that ``products`` holds and leave the others (dynamic partition
    overwrite)."""
    products.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lender").format(fmt).save(path)


def snapshot(products: DataFrame, path: str, stamp: str, pages: DataFrame | None = None) -> None:
    """Append a dated snapshot, and the raw pages numbered from 1 within their lender."""
    products.withColumn("snapshot", F.lit(stamp)).write.mode("append").partitionBy("lender", "snapshot").parquet(f"{path}/products")
    if pages is not None:
        n = F.row_number().over(Window.partitionBy("lender").orderBy("page_id"))
        pages.withColumn("page_number", n).withColumn("snapshot", F.lit(stamp)).write.mode("append").partitionBy("lender", "snapshot").parquet(f"{path}/pages")


def catalog_event(entry: DataFrame, path: str) -> None:
    """Append to the catalog log; the latest view is monitor.catalog."""
    entry.write.mode("append").parquet(path)


def catalog_latest(latest: DataFrame, path: str) -> None:
    latest.write.mode("overwrite").parquet(path)


def batch(products: DataFrame, path: str) -> None:
    """A folder per batch and file-safe product name."""
    products.withColumn("file", P.file_safe(F.col("name"))).write.mode("append").partitionBy("batch_id", "file").json(path)


def hash_index(hashes: DataFrame, path: str) -> None:
    hashes.select("h").write.mode("append").parquet(path)


def quarantined(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("lender").json(path)


def metrics(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def documents(json_rows: DataFrame, path: str) -> None:
    """JSON documents (nest.to_json), one per line."""
    json_rows.select(F.col("json").alias("value")).write.mode("overwrite").text(path)
