"""Assembling documents: hierarchical (v1), state-explicit (v2) and the API shape.

Tables stay flat up to here; nesting groups by product only, whose components are few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parsing as P
from .pricing import closed_world, first_by, with_state


def hierarchical(components: DataFrame) -> DataFrame:
    """(product_id, loan_types map<loan, map<repayment, array<tier>>>), tiers by upper, then
    lower bound, open ones as 0."""
    c = with_state(components)
    z = lambda n: F.coalesce(n, F.lit(0.0))
    tier = F.struct(z("lvr_max").alias("k1"), z("lvr_min").alias("k2"), "idx", "lvr_min", "lvr_max", "interest_rate", "comparison_rate")
    lo = c.groupBy("product_id", "loan_type", "repayment").agg(F.transform(F.array_sort(F.collect_list(tier)), lambda t: F.struct(t["lvr_min"].alias("lvr_min"), t["lvr_max"].alias("lvr_max"), t["interest_rate"].alias("interest_rate"), t["comparison_rate"].alias("comparison_rate"))).alias("tiers"))
    mid = lo.groupBy("product_id", "loan_type").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("repayment", "tiers")))).alias("repayment_types"))
    return mid.groupBy("product_id").agg(F.map_from_entries(F.collect_list(F.struct("loan_type", "repayment_types"))).alias("loan_types"))


def state_explicit(components: DataFrame, products: DataFrame) -> DataFrame:
    """One document per product: product, features, eligibility, pricing_states (owner-occupied
    before investment, principal before interest only) and governance.

    products(product_id, lender, name, short_name, features map, max_lvr, source_url,
    collected_at).
    """
    s = closed_world(components)
    pricing = F.when(F.col("priced"), F.struct("rate_tiers", F.col("interest_only_years").alias("interest_only_period_years")))
    state = F.struct(
        "state_order",
        "state_id",
        F.struct("loan_type", F.col("repayment").alias("repayment_type")).alias("state_parameters"),
        pricing.alias("pricing"),
        F.struct("extraction_method", "extraction_strategy", F.col("confidence").alias("confidence_score"), "data_quality", "capture_status").alias("provenance"),
    )
    states = s.groupBy("product_id").agg(F.array_sort(F.collect_list(state)).alias("states"), F.first("rate_type").alias("rate_type"), F.first("fixed_term_years").alias("fixed_term_years"))
    j = products.join(states, "product_id")
    has = lambda k: (F.coalesce(F.try_element_at("features", F.lit(k)), F.lit("")) != "").alias(k)
    return j.select(
        F.lit("2.0.0").alias("schema_version"),
        F.struct(
            P.product_id(F.col("lender"), F.col("name"), F.col("short_name")).alias("product_id"),
            F.col("name").alias("product_name"),
            F.struct(P.slugify(F.col("lender")).alias("lender_id"), F.col("lender").alias("lender_name"), F.lit("AU").alias("jurisdiction")).alias("lender"),
            F.lit("HomeLoan").alias("product_type"),
            "rate_type",
            "fixed_term_years",
        ).alias("product"),
        F.struct(has("offset_account"), has("redraw"), has("package_eligible")).alias("features"),
        F.struct(F.col("max_lvr").alias("max_lvr")).alias("eligibility"),
        F.transform("states", lambda x: x.dropFields("state_order")).alias("pricing_states"),
        F.struct(F.date_format("collected_at", "yyyy-MM-dd").alias("rates_effective_date"), "source_url", "collected_at").alias("governance"),
        F.col("product_id").alias("source_product_id"),
    )


def to_json(documents: DataFrame) -> DataFrame:
    """Documents as JSON text; null fields are left out."""
    return documents.select("source_product_id", F.to_json(F.struct(*[c for c in documents.columns if c != "source_product_id"])).alias("json"))


def api(components: DataFrame, products: DataFrame, strict: bool = True) -> DataFrame:
    """The API shape: whole percents, the first component's rate as the index rate.

    As once written every principal-and-interest loan maps to interest only, since its name
    holds "Interest"; ``strict`` asks for equality instead.
    """
    c = with_state(components)
    io = (F.col("repayment") == "InterestOnly") if strict else F.col("repayment").contains("Interest")
    tier = F.struct("idx", P.as_percent(F.coalesce("lvr_min", F.lit(0.0))).alias("lvrMin"), P.as_percent(F.coalesce("lvr_max", F.lit(0.8))).alias("lvrMax"), F.col("interest_rate").alias("interestRate"), F.col("comparison_rate").alias("comparisonRate"))
    g = c.groupBy("product_id").agg(
        F.transform(F.array_sort(F.collect_list(tier)), lambda t: t.dropFields("idx")).alias("rateTiers"),
        F.array_sort(F.collect_set("loan_type")).alias("loanPurpose"),
        F.array_sort(F.collect_set(F.when(io, "InterestOnly").otherwise("PrincipalAndInterest"))).alias("repaymentType"),
        first_by(F.col("interest_rate"), F.col("idx")).alias("indexRate"),
    )
    return products.select("product_id", "lender", "name").join(g, "product_id").select(F.col("product_id").alias("productId"), F.col("name").alias("productName"), "lender", "indexRate", F.struct("loanPurpose", "repaymentType").alias("eligibility"), "rateTiers")


def to_flat(documents: DataFrame) -> DataFrame:
    """State-explicit documents back as a row per state and tier."""
    s = documents.select(F.col("product.product_id").alias("product_id"), F.explode("pricing_states").alias("s"))
    return s.select("product_id", "s.state_id", F.explode_outer("s.pricing.rate_tiers").alias("t")).select("product_id", "state_id", "t.*")
