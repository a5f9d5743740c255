"""Readers: captured pages, responses, product documents, indexes and catalogs.

Paths may lie in any store that Spark reads; existence is asked of the store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPONENT = "name string, rate_type string, interest_rate double, comparison_rate double, fixed_term_months int, purpose string, repayment_type string, lvr_min double, lvr_max double"
PRODUCT = (f"product_id string, lender string, name string, rate_type string, rate double, source_url string, collected_at timestamp_ntz, interest_components array<struct<{', '.join(c.replace(' ', ': ', 1) for c in COMPONENT.split(', '))}>>")
RESPONSE = "call_id bigint, url string, status int, content_type string, body string"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def empty(spark: SparkSession, schema) -> DataFrame:
    return spark.createDataFrame([], schema)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("page_id bigint, url string, html string").parquet(path)


def page_files(spark: SparkSession, path: str) -> DataFrame:
    """One captured page per HTML file."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").text(path, wholetext=True).select(F.xxhash64("_metadata.file_path").alias("page_id"), F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))


def responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESPONSE).json(path)


def multi(pages: DataFrame, lenders: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages by lender, lenders' urls without a page, status by lender)."""
    want = lenders.select("lender_name", F.explode("collection_urls").alias("url"))
    got = want.join(pages, "url")
    lost = want.join(pages.select("url").distinct(), "url", "left_anti")
    status = want.groupBy("lender_name").agg(F.count("*").alias("wanted")).join(lost.groupBy("lender_name").agg(F.count("*").alias("lost")), "lender_name", "left").select("lender_name", F.when(F.coalesce("lost", F.lit(0)) == 0, "success").otherwise("partial").alias("status"))
    return got, lost, status


def products(spark: SparkSession, path: str, schema: str = PRODUCT) -> DataFrame:
    """All product documents below a folder; malformed ones are dropped; none: empty."""
    if not exists(spark, path):
        return empty(spark, schema)
    df = spark.read.schema(schema + ", _corrupt_record string").option("recursiveFileLookup", True).option("mode", "PERMISSIVE").option("multiLine", True).json(path)
    return df.where(F.col("product_id").isNotNull()).drop("_corrupt_record")


def current(spark: SparkSession, path: str, lender: str | None = None, schema=None) -> DataFrame:
    """The current products, of one lender by partition pruning; none: empty."""
    if not exists(spark, path):
        return empty(spark, schema or PRODUCT)
    df = spark.read.parquet(path)
    return df.where(F.col("lender") == lender) if lender else df


def by_lender_documents(spark: SparkSession, path: str) -> DataFrame:
    """Output documents with the lender taken from the file's name."""
    df = spark.read.text(f"{path}/*.json")
    return df.select(F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("lender"), F.try_parse_json("value").alias("document"))


def hash_index(spark: SparkSession, path: str) -> DataFrame:
    """The stored hashes; no index, or one that isn't Parquet, counts as none.  Any other failure
    is raised, lest a store that is away make every product new."""
    if not exists(spark, path):
        return empty(spark, "h string")
    df = spark.read.schema("h string").parquet(path)
    try:
        df.limit(1).count()
    except Exception as e:
        if "CANNOT_READ_FILE_FOOTER" in str(e) or "is not a Parquet file" in str(e):
            return empty(spark, "h string")
        raise
    return df


def catalog(spark: SparkSession, path: str) -> DataFrame:
    schema = "event_id bigint, ts timestamp_ntz, lender string, success boolean, status string, products int, snapshot_path string"
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else empty(spark, schema)


def search_results(captured: DataFrame, per_query: int = 10, quota: int = 100) -> DataFrame:
    """Captured search responses: statuses named, ``per_query`` hits each, the first ``quota``
    calls of a day."""
    from pyspark.sql import Window

    day = Window.partitionBy(F.to_date("ts")).orderBy("ts", "call_id")
    r = captured.withColumn("_n", F.row_number().over(day)).where(F.col("_n") <= quota).drop("_n")
    state = F.when(F.col("status") == 200, "ok").when(F.col("status") == 400, "bad_request").when(F.col("status") == 403, "quota_exceeded").otherwise("error")
    items = F.from_json("body", "items array<struct<title: string, link: string, snippet: string>>")["items"]
    r = r.withColumn("state", state)
    return r.select("call_id", "state", F.posexplode_outer(F.slice(F.coalesce(items, F.array()), 1, per_query)).alias("position", "item")).select("call_id", "state", "position", "item.title", "item.link", "item.snippet")
