"""Discovery: search queries, result filtering and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsing as P
from .resolve import top_per_group

# Query templates by category, and engines' search addresses.
TEMPLATES = (
    ("interest_rates", "site:{domain} home loan interest rates"),
    ("rates_alt", "site:{domain} mortgage rates comparison rate"),
    ("products", "site:{domain} home loan products"),
    ("products_alt", "site:{domain} fixed variable home loans"),
    ("comparison", "site:{domain} compare home loans"),
    ("fees", "site:{domain} home loan fees charges"),
)
ENGINES = {"google": ("https://www.google.com/search?q=", "&num=20&hl=en&gl=au"), "bing": ("https://www.bing.com/search?q=", "&count=20&setmkt=en-AU"), "yahoo": ("https://au.search.yahoo.com/search?p=", "&n=20")}
FOLD = {"rates_alt": "interest_rates", "products_alt": "products"}
FINAL = ("interest_rates", "products", "comparison")


def search_queries(domains: DataFrame, templates=TEMPLATES) -> DataFrame:
    """A row per domain and category, from a literal list of templates."""
    t = F.explode(F.array(*[F.struct(F.lit(i).alias("template_idx"), F.lit(c).alias("category"), F.lit(q).alias("template")) for i, (c, q) in enumerate(templates)])).alias("t")
    x = domains.select("*", t)
    return x.select(*domains.columns, "t.template_idx", "t.category", F.replace(F.col("t.template"), F.lit("{domain}"), F.col("domain")).alias("query"))


def search_url(query: Column, engine: str) -> Column:
    base, tail = ENGINES[engine]
    return F.concat(F.lit(base), F.url_encode(query), F.lit(tail))


def canonical_engine(name: Column) -> Column:
    return F.regexp_extract(F.lower(name), "(google|bing|yahoo|duckduckgo|yandex)", 1)


def fold_category(category: Column) -> Column:
    out = category
    for a, b in FOLD.items():
        out = F.when(category == a, b).otherwise(out)
    return out


def lender_urls(results: DataFrame, per_category: int = 3) -> DataFrame:
    """results(domain, category, position, url): valid urls, first of equals by position, top n
    of each domain and category."""
    ok = results.where(P.is_lender_url(F.col("url"), F.col("domain"))).withColumn("category", fold_category(F.col("category")))
    first = ok.groupBy("domain", "category", "url").agg(F.min("position").alias("position"))
    return top_per_group(first, ["domain", "category"], ["position", "url"], per_category)


def final_urls(urls: DataFrame, n: int = 3) -> DataFrame:
    """The first n distinct urls of a domain over the categories that matter, in order."""
    rank = F.array_position(F.array(*[F.lit(c) for c in FINAL]), F.col("category"))
    u = urls.where(F.col("category").isin(*FINAL)).groupBy("domain", "url").agg(F.min(F.struct(rank.alias("r"), F.col("position").alias("p"))).alias("o"))
    return top_per_group(u, ["domain"], ["o.r", "o.p", "url"], n).select("domain", "url")


def ordered_distinct(urls: DataFrame, keys: list[str]) -> DataFrame:
    """Each url once, at its first position."""
    return urls.groupBy(*keys, "url").agg(F.min("position").alias("position"))
