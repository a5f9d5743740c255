"""Queries over sinks and sources: what is written to the shared folder is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import monitor, nest, pricing, resolve
from ..sources import config, readers, writers
from ..sources.readers import table
from ..sources.shared import fresh
from . import derive as D
from . import relational as R
from .registry import query

c = F.col


def _folder(spark) -> str:
    return fresh(spark, "stores")


@query(f"SELECT product_id, lender, name, CASE WHEN lender = 'Lender 3' THEN rate + 1 ELSE rate END AS rate FROM {R._P}")
def store_current(spark, sf):
    """All lenders' products, then one lender's again: the others stay."""
    path, p = _folder(spark), R.products(spark, sf).select("product_id", "lender", "name", "rate")
    writers.current(p, path)
    writers.current(p.where("lender = 'Lender 3'").withColumn("rate", c("rate") + 1), path)
    return readers.current(spark, path).select("product_id", "lender", "name", "rate")


@query(f"SELECT product_id, name FROM {R._P} WHERE lender = 'Lender 4'")
def store_current_of_lender(spark, sf):
    path = _folder(spark)
    writers.current(R.products(spark, sf).select("product_id", "lender", "name"), path)
    return readers.current(spark, path, "Lender 4").select("product_id", "name")


@query("SELECT concat('Lender ', page_id % 3) AS lender, row_number() OVER (PARTITION BY page_id % 3 ORDER BY page_id)::INT AS page_number, page_id, md5(coalesce(html, '')) AS body FROM pages")
def store_snapshot_pages(spark, sf):
    path = _folder(spark)
    pages = table(spark, sf, "pages").select(F.concat(F.lit("Lender "), (c("page_id") % 3).cast("string")).alias("lender"), "page_id", "html")
    writers.snapshot(R.products(spark, sf), path, "2024-01-31-00-00-00", pages)
    back = spark.read.parquet(f"{path}/pages").where("snapshot = '2024-01-31-00-00-00'")
    return back.select("lender", "page_number", "page_id", F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("body"))


@query(f"SELECT lender, event_id, ts, success, products FROM (SELECT *, row_number() OVER (PARTITION BY lender ORDER BY ts DESC, event_id DESC) AS k FROM {R._E}) WHERE k = 1")
def store_catalog(spark, sf):
    """The log, appended twice, and its latest view, one row per lender."""
    path, e = _folder(spark), R.events(spark, sf).select("event_id", c("ts").cast("timestamp_ntz").alias("ts"), "lender", "success", F.lit("done").alias("status"), "products", F.lit("s").alias("snapshot_path"))
    for half in (0, 1):
        writers.catalog_event(e.where(c("event_id") % 2 == half), f"{path}/log")
    writers.catalog_latest(monitor.catalog(readers.catalog(spark, f"{path}/log")), f"{path}/latest")
    return readers.catalog(spark, f"{path}/latest").select("lender", "event_id", c("ts").cast("timestamp").alias("ts"), "success", "products")


@query("SELECT p_partkey AS id, (p_partkey % 4)::INT AS batch_id, left(replace(rtrim(regexp_replace(p_type, '[^A-Za-z0-9 _-]', '', 'g')), ' ', '_'), 50) AS file, p_type AS name FROM part WHERE p_type <> ''")
def store_batches(spark, sf):
    path = _folder(spark)
    writers.batch(table(spark, sf, "part").where("p_type <> ''").select(c("p_partkey").alias("id"), c("p_type").alias("name"), (c("p_partkey") % 4).cast("int").alias("batch_id")), path)
    return spark.read.schema("id long, name string, batch_id int, file string").json(path).select("id", "batch_id", "file", "name")


@query(f"WITH x AS (SELECT *, {R._HASH} AS h FROM {R._C}), i AS (SELECT DISTINCT h FROM x WHERE product_id % 3 = 0), n AS (SELECT count(DISTINCT h) AS stored FROM x WHERE h NOT IN (SELECT h FROM i)) SELECT stored, count(*) - stored AS duplicates, 0::BIGINT AS errors FROM x, n GROUP BY stored")
def store_hash_index(spark, sf):
    """New products against an index that was written before; a missing index is empty."""
    path, x = _folder(spark), R._hashed(spark, sf)
    writers.hash_index(x.where("product_id % 3 = 0").select("h").distinct(), f"{path}/index")
    known = readers.hash_index(spark, f"{path}/index").unionByName(readers.hash_index(spark, f"{path}/none"))
    return resolve.store(x, known, ["product_id", "idx"])[1]


@query(f"WITH {R._SUMMARY} SELECT product_id, lender, concat('confidence ', confidence) AS reason, n_issues, n_critical FROM pr JOIN v USING (lender) WHERE confidence < 40")
def store_quarantine(spark, sf):
    """Quarantined rows with reason and report."""
    from ..operators import quality

    path = _folder(spark)
    writers.quarantined(quality.quarantine(*R._verdict(spark, sf))[1], path)
    back = spark.read.schema("product_id long, lender string, reason string, report struct<n_issues: long, n_critical: long>").json(path)
    return back.select("product_id", "lender", "reason", "report.n_issues", "report.n_critical")


@query(f"WITH {R._LATEST}, {R._STATS} SELECT total, successful, failed, products, round(success_rate, 9) AS success_rate FROM s")
def store_metrics(spark, sf):
    path = _folder(spark)
    writers.metrics(monitor.stats(R.events(spark, sf), R.as_of(), 72), path)
    m = F.from_json("value", "total long, successful long, failed long, products long, success_rate double").alias("m")
    return spark.read.text(path).select(m).select("m.total", "m.successful", "m.failed", "m.products", F.round("m.success_rate", 9).alias("success_rate"))


@query(f"SELECT product_id::VARCHAR AS product_id, lender, name, rate_type, rate FROM {R._P}")
def store_products_json(spark, sf):
    """Product documents below a folder of folders; a file that is no document is left out."""
    path, p = _folder(spark), R.products(spark, sf).select(c("product_id").cast("string").alias("product_id"), c("lender").alias("l"), "lender", "name", "rate_type", "rate")
    p.write.partitionBy("l").option("multiLine", False).json(f"{path}/docs")
    spark.range(1).select(F.lit("{broken").alias("value")).write.text(f"{path}/docs/l=broken")
    back = spark.read.schema(readers.PRODUCT).option("recursiveFileLookup", True).json(f"{path}/docs")
    return back.where("product_id IS NOT NULL").select("product_id", "lender", "name", "rate_type", "rate")


@query(f"WITH {R._WORLD}, t AS (SELECT product_id, state_id, unnest(string_split(tiers, ',')) AS tier FROM w WHERE tiers IS NOT NULL) SELECT count(*) AS n, count(DISTINCT product_id) AS n_products, count(DISTINCT state_id) AS n_states FROM t")
def flat_documents(spark, sf):
    """Nested documents, written as JSON, read and flattened to a row per state and tier."""
    path = _folder(spark)
    p = R.products(spark, sf).select("product_id", "lender", "name", F.col("product_id").cast("string").alias("short_name"), F.create_map(F.lit("redraw"), F.lit("yes")).alias("features"), F.lit(0.8).alias("max_lvr"), F.lit("u").alias("source_url"), "collected_at")
    d = nest.state_explicit(R.components(spark, sf), p)
    writers.documents(nest.to_json(d), path)
    back = spark.read.text(path).select(F.from_json("value", d.drop("source_product_id").schema).alias("d")).select("d.*")
    f = nest.to_flat(back).where("interest_rate IS NOT NULL")
    return f.agg(F.count("*").alias("n"), F.count_distinct("product_id").alias("n_products"), F.count_distinct("state_id").alias("n_states"))


_LENDERS = '{"lenders": [{"name": "Big Bank", "url": "https://big.com", "collection_urls": ["u1", "u2"]}, {"lender_name": "Small", "abbreviation": "SM", "enabled": false, "priority": 2, "id": "s9"}]}'


@query("SELECT * FROM (VALUES (0, '1', 'Big Bank', 'BIG', 'https://big.com', 'AU', true, 'daily', NULL, 'u1,u2'), (1, 's9', 'Small', 'SM', NULL, 'AU', false, 'daily', 2, ''), (2, 'lender-1', 'Default Lender', 'DEF', NULL, 'AU', true, 'daily', NULL, '')) AS t(config_idx, id, lender_name, abbreviation, website, jurisdiction, enabled, frequency, priority, urls)")
def lender_config(spark, sf):
    """Lender lists with other key names and defaults; text that can't be read gives the default."""
    good = config.Lenders.load(_LENDERS).frame(spark)
    other = config.Lenders.load("{not json").frame(spark).withColumn("config_idx", F.lit(2))
    return good.unionByName(other).select("config_idx", "id", "lender_name", "abbreviation", "website", "jurisdiction", "enabled", "frequency", "priority", F.array_join("collection_urls", ",").alias("urls"))


@query("WITH w AS (SELECT s_suppkey, s_name AS lender_name, concat('http://l', s_suppkey, '.com/', i) AS url, i FROM supplier, range(0, 3) AS r(i)), g AS (SELECT * FROM w WHERE NOT (s_suppkey % 4 = 0 AND i = 2)) SELECT lender_name, count(*) AS wanted, count(*) FILTER (url IN (SELECT url FROM g)) AS found, CASE WHEN bool_and(url IN (SELECT url FROM g)) THEN 'success' ELSE 'partial' END AS status FROM w GROUP BY lender_name")
def multi_url_status(spark, sf):
    s = table(spark, sf, "supplier")
    url = lambda i: F.concat(F.lit("http://l"), c("s_suppkey").cast("string"), F.lit(f".com/{i}"))
    lenders = s.select(c("s_name").alias("lender_name"), F.array(url(0), url(1), url(2)).alias("collection_urls"))
    pages = s.select(F.explode(F.when(c("s_suppkey") % 4 == 0, F.array(url(0), url(1))).otherwise(F.array(url(0), url(1), url(2)))).alias("url"))
    got, lost, status = readers.multi(pages, lenders)
    n = got.groupBy("lender_name").agg(F.count("*").alias("found"))
    wanted = lenders.select("lender_name", F.size("collection_urls").cast("long").alias("wanted"))
    return wanted.join(n, "lender_name").join(status, "lender_name").select("lender_name", "wanted", "found", "status")
