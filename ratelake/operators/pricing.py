"""Pricing states, bands, the closed-world matrix and rate lookups.

The working table is ``components``: one row per rate line with product_id, idx (its
place in the product, which decides "first"), interest_rate, comparison_rate, rate_type,
fixed_term_months, purpose, repayment_type, lvr_min, lvr_max, lvr_exclusive_max and
provenance.  Lookups are equi-joins on the product with conditional aggregates, so they
aggregate map-side instead of ranking rows in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parsing as P

LOANS, REPAYMENTS = ("OwnerOccupied", "Investment"), ("PrincipalAndInterest", "InterestOnly")


def first_by(value: Column, order: Column, where: Column | None = None) -> Column:
    """Aggregate: the value of the row with the smallest order among those that qualify
    (the row may hold null).  On numbers it is a hash aggregate."""
    return F.min_by(value, order if where is None else F.when(where, order))


def lvr_matches(lvr: Column) -> Column:
    """Whether a component's band holds a fraction; open ends are 0 and 1."""
    lo, hi = F.coalesce(F.col("lvr_min"), F.lit(0.0)), F.coalesce(F.col("lvr_max"), F.lit(1.0))
    return (lvr >= lo) & F.when(F.coalesce(F.col("lvr_exclusive_max"), F.lit(False)), lvr < hi).otherwise(lvr <= hi)


def rate_by_lvr(probes: DataFrame, components: DataFrame) -> DataFrame:
    """probes(probe_id, product_id, lvr): the rate of the first component whose band holds the
    ratio (over 1: percent), else the first component's rate."""
    lvr = P.as_fraction(F.col("lvr"))
    j = probes.join(components, "product_id", "left")
    banded = F.col("lvr_min").isNotNull() | F.col("lvr_max").isNotNull()
    return (
        j.groupBy("probe_id", "product_id", "lvr")
        .agg(first_by(F.col("interest_rate"), F.col("idx"), banded & lvr_matches(lvr)).alias("_hit"), first_by(F.col("interest_rate"), F.col("idx")).alias("_first"))
        .select("probe_id", "product_id", "lvr", F.coalesce("_hit", "_first", F.lit(0.0)).alias("rate"))
    )


def axes_match(lvr=None, purpose=None, repayment_type=None, rate_type=None, term=None) -> Column:
    """Null arguments are not asked for; a component without purpose, repayment or term takes
    any; rate type is compared strictly and a ratio needs a band."""
    ok = F.lit(True)
    if lvr is not None:
        banded = F.col("lvr_min").isNotNull() | F.col("lvr_max").isNotNull()
        ok = ok & F.when(lvr.isNull(), True).otherwise(banded & lvr_matches(P.as_fraction(lvr)))
    for arg, col in ((purpose, "purpose"), (repayment_type, "repayment_type"), (term, "fixed_term_months")):
        if arg is not None:
            ok = ok & (arg.isNull() | F.col(col).isNull() | (F.col(col) == arg))
    if rate_type is not None:
        ok = ok & (rate_type.isNull() | F.coalesce(F.col("rate_type") == rate_type, F.lit(False)))
    return ok


def rate_by_axes(probes: DataFrame, components: DataFrame) -> DataFrame:
    """probes(probe_id, product_id, p_lvr, p_purpose, p_repayment, p_rate_type, p_term): the
    first matching component's rate, else null; and whether any matches."""
    match = axes_match(F.col("p_lvr"), F.col("p_purpose"), F.col("p_repayment"), F.col("p_rate_type"), F.col("p_term"))
    j = probes.join(components, "product_id", "left")
    return j.groupBy("probe_id", "product_id").agg(
        first_by(F.col("interest_rate"), F.col("idx"), F.col("idx").isNotNull() & match).alias("rate"),
        F.coalesce(F.bool_or(F.col("idx").isNotNull() & match), F.lit(False)).alias("has_permutation"),
    )


def pricing_matrix(components: DataFrame, products: DataFrame) -> DataFrame:
    """A row per component; purpose and repayment default to the product's."""
    p = products.select("product_id", F.col("purpose").alias("_p"), F.col("repayment_type").alias("_r"))
    j = components.join(p, "product_id")
    return j.select("product_id", "idx", F.coalesce("purpose", "_p").alias("purpose"), F.coalesce("repayment_type", "_r").alias("repayment_type"), "rate_type", "fixed_term_months", "interest_rate", "lvr_min", "lvr_max")


def lvr_tiers(components: DataFrame) -> DataFrame:
    """Banded components numbered by lower bound (open is 0), then place; and whether the
    product has several."""
    w = Window.partitionBy("product_id")
    t = components.where("lvr_min IS NOT NULL OR lvr_max IS NOT NULL")
    return t.select("product_id", "idx", "lvr_min", "lvr_max", "interest_rate", F.row_number().over(w.orderBy(F.coalesce("lvr_min", F.lit(0.0)), "idx")).alias("tier"), (F.count("*").over(w) > 1).alias("has_tiers"))


def legacy(components: DataFrame) -> DataFrame:
    """Scalar view of a product: first component's rates, type and the highest ratio in %."""
    return components.groupBy("product_id").agg(
        F.coalesce(first_by(F.col("interest_rate"), F.col("idx")), F.lit(0.0)).alias("primary_rate"),
        first_by(F.col("comparison_rate"), F.col("idx")).alias("comparison_rate"),
        F.coalesce(F.lower(first_by(F.col("rate_type"), F.col("idx"))), F.lit("variable")).alias("rate_type"),
        F.coalesce(F.round(F.max("lvr_max") * 100, 6), F.lit(95.0)).alias("max_lvr"),
    )


def with_state(components: DataFrame) -> DataFrame:
    return components.withColumn("loan_type", P.loan_type(F.col("purpose"))).withColumn("repayment", P.repayment(F.col("repayment_type")))


def bands(components: DataFrame) -> DataFrame:
    """A row per product, state and band: the highest of its rates, and whether rates differ."""
    c = with_state(components)
    return c.groupBy("product_id", "loan_type", "repayment", F.coalesce("lvr_min", F.lit(0.0)).alias("lvr_min"), F.coalesce("lvr_max", F.lit(0.8)).alias("lvr_max")).agg(
        F.max("interest_rate").alias("interest_rate"),
        F.max("comparison_rate").alias("comparison_rate"),
        (F.min("interest_rate") != F.max("interest_rate")).alias("conflict"),
        F.count("*").alias("n_components"),
    )


def _captured(components: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per product and captured state, all by one shuffle by product: firsts are windows
    over a product's components, then constant, so they can be keys of the aggregates."""
    c = with_state(components).repartition("product_id")
    state, first = ["product_id", "loan_type", "repayment"], Window.partitionBy("product_id").orderBy("idx")
    of_state = Window.partitionBy(*state).orderBy("idx")
    c = c.select(
        *state, *keep, F.coalesce("lvr_min", F.lit(0.0)).alias("lvr_min"), F.coalesce("lvr_max", F.lit(0.8)).alias("lvr_max"), "interest_rate", "comparison_rate",
        F.first("rate_type").over(first).alias("rate_type"), F.first("fixed_term_months").over(first).alias("fixed_term_months"),
        F.first("extraction_method").over(of_state).alias("extraction_method"), F.first("confidence").over(of_state).alias("confidence"),
    )
    same = [*state, *keep, "rate_type", "fixed_term_months", "extraction_method", "confidence"]
    b = c.groupBy(*same, "lvr_min", "lvr_max").agg(F.max("interest_rate").alias("interest_rate"), F.max("comparison_rate").alias("comparison_rate"), (F.min("interest_rate") != F.max("interest_rate")).alias("conflict"))
    s = b.groupBy(*same).agg(F.bool_or("conflict").alias("conflict"), F.count("*").alias("n_bands"), F.array_sort(F.collect_list(F.struct("lvr_min", "lvr_max", "interest_rate", "comparison_rate"))).alias("rate_tiers"))
    return s.withColumn("confidence", F.when(F.col("conflict"), F.greatest(F.lit(20), F.col("confidence") - 40)).otherwise(F.col("confidence"))).withColumn("data_quality", F.when(F.col("conflict"), "degraded_lvr_overlaps"))


def states(components: DataFrame) -> DataFrame:
    """A row per product and captured state.  The first component gives provenance; bands
    whose rates differ cost 40 points of confidence (20 at least are left)."""
    return _captured(components).drop("rate_type", "fixed_term_months")


def theoretical(products: DataFrame) -> DataFrame:
    """products x the four states, exploded from a literal: no join."""
    cells = F.array(*[F.struct(F.lit(a).alias("loan_type"), F.lit(b).alias("repayment"), F.lit(i).alias("state_order")) for i, (a, b) in enumerate((a, b) for a in LOANS for b in REPAYMENTS)])
    return products.select("*", F.explode(cells).alias("_s")).select("*", "_s.*").drop("_s")


def closed_world(components: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """All four states of every product: captured ones, and null-priced ones marked as not
    attempted.  If any is missing, captured ones lose 20 points (30 at least are left).

    ``keep`` names columns that are constant in a product.  The four cells are looked up in
    the product's own captured states, so there is no join.
    """
    own = F.struct("loan_type", "repayment", "n_bands", "rate_tiers", "confidence", "extraction_method", "data_quality")
    kinds = _captured(components, keep).groupBy("product_id", *keep, "rate_type", "fixed_term_months").agg(F.collect_list(own).alias("_own"))
    cell = F.element_at(F.filter("_own", lambda x: (x["loan_type"] == F.col("loan_type")) & (x["repayment"] == F.col("repayment"))), 1)
    full = theoretical(kinds).withColumn("_partial", F.size("_own") < len(LOANS) * len(REPAYMENTS))
    full = full.withColumn("_cell", F.when(F.exists("_own", lambda x: (x["loan_type"] == F.col("loan_type")) & (x["repayment"] == F.col("repayment"))), cell))
    full = full.select("product_id", *keep, "loan_type", "repayment", "state_order", "rate_type", "fixed_term_months", "_partial", *[F.col(f"_cell.{c}").alias(c) for c in ("n_bands", "rate_tiers", "confidence", "extraction_method", "data_quality")])
    have, partial = F.col("n_bands").isNotNull(), F.col("_partial")
    return full.select(
        "product_id",
        *keep,
        "loan_type",
        "repayment",
        "state_order",
        P.state_id(F.col("loan_type"), F.col("repayment"), F.col("rate_type")).alias("state_id"),
        "rate_type",
        P.fixed_years(F.col("rate_type"), F.col("fixed_term_months")).alias("fixed_term_years"),
        have.alias("priced"),
        F.coalesce("n_bands", F.lit(0)).cast("long").alias("n_bands"),
        "rate_tiers",
        F.when(have & (F.col("repayment") == "InterestOnly"), 5).alias("interest_only_years"),
        F.when(have, F.when(partial, F.greatest(F.lit(30), F.col("confidence") - 20)).otherwise(F.col("confidence"))).otherwise(0).cast("int").alias("confidence"),
        F.when(have, F.col("extraction_method")).otherwise("not_attempted").alias("extraction_method"),
        F.when(~have, "matrix_materialization").alias("extraction_strategy"),
        "data_quality",
        F.when(have & partial, "partial").when(~have, "not_available").alias("capture_status"),
    )


def missing_states(components: DataFrame, key: str = "lender") -> DataFrame:
    """Loan type x repayment x rate type over the axes a lender (or product) shows, less what
    its components cover: the null-priced placeholders."""
    c = with_state(components)
    axes = ("loan_type", "repayment", "rate_type")
    # a key's axes and cells are few: one aggregate, its grid exploded from its own sets
    own = c.groupBy(key).agg(*[F.collect_set(a).alias(f"_{a}") for a in axes], F.collect_set(F.struct(*axes)).alias("_have"))
    grid = own
    for a in axes:
        grid = grid.withColumn(a, F.explode(f"_{a}"))
    return grid.where(~F.exists("_have", lambda x: (x["loan_type"] == F.col("loan_type")) & (x["repayment"] == F.col("repayment")) & (x["rate_type"] == F.col("rate_type")))).select(key, *axes)


def complete_matrix(components: DataFrame, key: str = "lender") -> DataFrame:
    """The components with a placeholder for every missing state: no rates, no band, confidence 0,
    method "not_available"."""
    c = with_state(components).withColumn("capture_status", F.lit("captured"))
    hole = missing_states(components, key).select(key, "loan_type", "repayment", "rate_type", F.lit("not_available").alias("extraction_method"), F.lit(0).alias("confidence"), F.lit("not_available").alias("capture_status"))
    return c.unionByName(hole, allowMissingColumns=True)


def option_product(axes: DataFrame, skip: tuple = ("region_residency", "borrower_category")) -> DataFrame:
    """Every combination of a page's options, one per axis; metadata axes are left out first.
    axes(page_id, axis, options array): one fold over the page's own axes."""
    per = axes.where(~F.col("axis").isin(*skip)).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("axis", "options"))).alias("a"))
    combos = F.aggregate("a", F.array(F.array().cast("array<string>")), lambda acc, x: F.flatten(F.transform(acc, lambda c: F.transform(x["options"], lambda o: F.concat(c, F.array(F.concat(x["axis"], F.lit("="), o)))))))
    return per.select("page_id", F.explode(combos).alias("state")).select("page_id", F.array_join("state", ";").alias("state"))
