"""Raw product rows, as scraped, to the normalised product row.

raw(lender, name, product_name, rate_line, rate, comparison_rate, term, term_line, rate_type,
description, features array, fees map, lvr_max, lvr, dti_max, dti, postcode_flags, source_url):
any text may be null; postcode_flags is JSON text.  Fields fall back on their other names;
rows never fail, bad values take the defaults.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parsing as P

# Percent, of variable rates in page containers.
MARGIN, FLOOR = 1.20, 4.80

ALTERNATIVES = (("name", "product_name"), ("rate_line", "rate"), ("term", "term_line"), ("lvr_max", "lvr"), ("dti_max", "dti"))


def normalize(raw: DataFrame, strict: bool = True) -> DataFrame:
    have = set(raw.columns)
    both = {a: F.coalesce(F.col(a), F.col(b)) if b in have else F.col(a) for a, b in ALTERNATIVES}
    rate = P.rate(both["rate_line"])
    words = F.concat_ws(" ", both["name"], "description", F.array_join(F.coalesce("features", F.array().cast("array<string>")), " "))
    kind = F.coalesce(F.nullif(F.col("rate_type"), F.lit("")), both["name"])
    keep = [c for c in raw.columns if c.startswith("key_")]
    return raw.select(
        *keep,
        P.lender_or_unknown(F.col("lender")).alias("lender"),
        P.collapse(both["name"]).alias("name"),
        rate.alias("rate"),
        P.comparison_rate(F.col("comparison_rate"), rate).alias("comparison_rate"),
        P.term_months(both["term"], strict).alias("term_months"),
        P.rate_type(kind).alias("rate_type"),
        P.feature_tags(words).alias("features"),
        P.normal_fees(F.coalesce("fees", F.create_map().cast("map<string,string>"))).alias("fees"),
        P.first_number(both["lvr_max"], 95.0).alias("lvr_max"),
        P.first_number(both["dti_max"]).alias("dti_max"),
        P.flags(F.col("postcode_flags")).alias("postcode_flags"),
        "source_url",
    )


def containers(rows: DataFrame) -> DataFrame:
    """rows(container_id, heading, texts array): products of page containers by their texts.
    The first rate counts, the last fee, features longer than two characters, the ratio with
    its default; variable rates have the fixed margin and floor, others none."""
    t = F.array_join("texts", " ")
    kind = P.rate_type_of_name(F.col("heading"))
    out = rows.select(
        "container_id",
        F.col("heading").alias("name"),
        P.plain_rate(t).alias("rate"),
        P.comparison_in_text(t).alias("comparison_rate"),
        P.last_fee(F.col("texts")).alias("fee"),
        P.feature_texts(F.col("texts")).alias("features"),
        P.first_number(P.group(t, r"(?i)(\d+\.?\d*)\s*%\s*LVR"), 95.0).alias("lvr_max"),
        kind.alias("rate_type"),
        F.when(kind == "Variable", MARGIN).alias("margin_pct"),
        F.when(kind == "Variable", FLOOR).alias("floor_pct"),
    )
    return out.where(P.is_product_name(F.col("name")) & (F.col("rate") > 0))
