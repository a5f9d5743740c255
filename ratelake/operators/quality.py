"""Confidence scores, the verification gate, output checks and widget detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import parsing as P
from .pricing import first_by

# Base confidence by extraction method.
BASE = {"network_api": 50, "jsonld": 45, "embedded_state": 40, "compare_cards": 35, "ui_enumeration": 30, "dom_parsing": 25}


def confidence(components: DataFrame, limits: DataFrame, n_strategies: int = 1) -> DataFrame:
    """Score 0 to 100 per product.  limits(product_id, method, min_amount, max_amount)."""
    c = components.groupBy("product_id").agg(
        first_by(F.col("interest_rate"), F.col("idx")).alias("rate"),
        F.max("lvr_max").alias("top"),
        F.collect_set("purpose").alias("purposes"),
        F.collect_set("repayment_type").alias("repays"),
    )
    j = c.join(limits, "product_id")
    base = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in BASE.items() for x in kv]), F.col("method")), F.lit(20))
    pts = lambda cond, n: F.when(cond, n).otherwise(0)
    has = F.array_contains
    score = (
        base
        + (min(10, 2 * n_strategies) if n_strategies > 1 else 0)
        + pts(F.coalesce(F.col("rate"), F.lit(0.0)) != 0, 10)
        + pts(F.coalesce(F.col("top"), F.lit(0.0)) != 0, 5)
        + pts(F.size("repays") > 0, 5)
        + pts(F.size("purposes") > 0, 5)
        + pts((F.coalesce("min_amount", F.lit(0.0)) != 0) & (F.coalesce("max_amount", F.lit(0.0)) != 0), 5)
        + pts(F.col("rate").between(0.5, 20), 10)
        - pts(has("purposes", "OwnerOccupied") & ~has("purposes", "Investment"), 15)
        - pts(has("repays", "PrincipalAndInterest") & ~has("repays", "InterestOnly"), 15)
        + pts((F.size("purposes") >= 2) & (F.size("repays") >= 2), 10)
    )
    return j.select("product_id", P.clamp(score, 0, 100).cast("int").alias("confidence"))


def partial_capture(rows: DataFrame, keys: list[str], default: int = 70, floor: int = 30) -> DataFrame:
    """Scores of a whole extraction less 20 where it shows no investment loan and less 20
    where it shows no interest-only one."""
    seen = rows.groupBy(*keys).agg(F.bool_or(P.loan_type(F.col("purpose")) == "Investment").alias("_inv"), F.bool_or(P.repayment(F.col("repayment_type")) == "InterestOnly").alias("_io"))
    cut = F.when(~F.col("_inv"), 20).otherwise(0) + F.when(~F.col("_io"), 20).otherwise(0)
    return rows.join(seen, keys).withColumn("confidence", F.when(cut > 0, F.greatest(F.lit(floor), F.coalesce("confidence", F.lit(default)) - cut)).otherwise(F.coalesce("confidence", F.lit(default)))).drop("_inv", "_io")


def passes(product_id: Column, name: Column, n_components: Column, rate: Column, lo: float = 0.0, hi: float = 50.0) -> Column:
    """Row gate: id and name, a component, and 0 < rate <= 50."""
    return (F.coalesce(product_id.cast("string"), F.lit("")) != "") & (F.coalesce(name, F.lit("")) != "") & (n_components >= 1) & F.coalesce((rate > lo) & (rate <= hi), F.lit(False))


# Checks of the gate with severity, kind and penalties (confidence, completeness).
CHECKS = (
    ("slug", "critical", "schema", 10, 0),
    ("band_conflict", "critical", "data_integrity", 40, 0),
    ("missing_investment", "warning", "completeness", 20, 20),
    ("missing_interest_only", "warning", "completeness", 20, 20),
    ("fixed_term", "critical", "schema", 20, 20),
    ("comparison_rate", "warning", "completeness", 10, 10),
)


def findings(products: DataFrame, tiers: DataFrame) -> DataFrame:
    """``products`` with ``findings``, an array of (check, severity, kind, confidence_penalty,
    completeness_penalty), and its totals n_issues, n_critical, n_warnings, confidence_penalty and
    completeness_penalty: all checks of the verification gate in one row per product.

    products(product_id, slug, rate_type, fixed_term_years, inv, io), the last two priced
    states of investment loans and of interest only; tiers(product_id, loan_type, repayment, idx,
    lvr_min, lvr_max, interest_rate, comparison_rate).
    """
    t = tiers.repartition("product_id")
    band = Window.partitionBy("product_id", "loan_type", "repayment", "lvr_min", "lvr_max").orderBy("idx")
    t = t.withColumn("_clash", F.col("interest_rate") != F.first("interest_rate").over(band))
    state = t.groupBy("product_id", "loan_type", "repayment").agg(F.count_if("_clash").alias("_c"), F.bool_or(F.coalesce("comparison_rate", F.lit(0.0)) == 0).alias("_b"))
    per = state.groupBy("product_id").agg(F.sum("_c").alias("_clashes"), F.count_if("_b").alias("_bare"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    times = {
        "slug": ~P.is_slug(F.col("slug")),
        "band_conflict": F.col("_clashes"),
        "missing_investment": n("inv") < 2,
        "missing_interest_only": n("io") < 2,
        "fixed_term": (F.col("rate_type") == "Fixed") & F.col("fixed_term_years").isNull(),
        "comparison_rate": F.col("_bare"),
    }
    j = products.join(per, "product_id", "left").select(*products.columns, *[F.coalesce(times[c].cast("int"), F.lit(0)).alias(f"_{c}") for c, *_ in CHECKS])

    def total(weight):
        return sum((F.col(f"_{c[0]}") * weight(c) for c in CHECKS), F.lit(0))

    one = lambda c: F.struct(*[F.lit(v).alias(k) for k, v in zip(("check", "severity", "kind", "confidence_penalty", "completeness_penalty"), c)])
    return j.select(
        *products.columns,
        F.concat(*[F.array_repeat(one(c), F.col(f"_{c[0]}")) for c in CHECKS]).alias("findings"),
        total(lambda c: 1).alias("n_issues"),
        total(lambda c: int(c[1] == "critical")).alias("n_critical"),
        total(lambda c: int(c[1] == "warning")).alias("n_warnings"),
        total(lambda c: c[3]).alias("confidence_penalty"),
        total(lambda c: c[4]).alias("completeness_penalty"),
    )


def priced(states: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per product how many states of investment loans (inv) and interest only (io) are priced."""
    return states.groupBy("product_id", *keep).agg(F.count_if((F.col("loan_type") == "Investment") & F.col("priced")).alias("inv"), F.count_if((F.col("repayment") == "InterestOnly") & F.col("priced")).alias("io"))


def listed(found: DataFrame) -> DataFrame:
    """A row per finding."""
    return found.select("lender", "product_id", F.inline("findings"))


def issues(products: DataFrame, states: DataFrame, tiers: DataFrame) -> DataFrame:
    """Findings of the verification gate, one row each, with penalties.

    products(lender, product_id, slug, rate_type, fixed_term_years), states(product_id,
    loan_type, repayment, priced), tiers as in ``findings``, of priced states.
    """
    return listed(findings(products.join(priced(states), "product_id", "left"), tiers))


def scorecard(found: DataFrame, lenders: DataFrame) -> DataFrame:
    """Scores and status per lender, from one pass over ``findings``; a lender without
    products scores 0."""
    per = found.groupBy("lender").agg(
        F.count("*").alias("n_products"),
        *[F.sum(c).alias(c) for c in ("n_issues", "n_critical", "n_warnings")],
        F.count_if(F.col("n_issues") > 0).alias("products_with_issues"),
        F.sum("confidence_penalty").alias("c"),
        F.sum("completeness_penalty").alias("k"),
    )
    return _scored(per.join(lenders.select("lender").distinct(), "lender", "full"))


def verify(products: DataFrame, found: DataFrame, lenders: DataFrame) -> DataFrame:
    """The same from products(lender, ...) and one row per finding (``issues``)."""
    n = products.groupBy("lender").agg(F.count("*").alias("n_products"))
    p = found.groupBy("lender").agg(
        F.count("*").alias("n_issues"),
        F.count_if(F.col("severity") == "critical").alias("n_critical"),
        F.count_if(F.col("severity") == "warning").alias("n_warnings"),
        F.count_distinct("product_id").alias("products_with_issues"),
        F.sum("confidence_penalty").alias("c"),
        F.sum("completeness_penalty").alias("k"),
    )
    return _scored(lenders.select("lender").join(n, "lender", "left").join(p, "lender", "left"))


def _scored(j: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    none = F.col("n_products").isNull()
    score = lambda c: F.when(none, 0).otherwise(F.greatest(F.lit(0), 100 - F.coalesce(c, F.lit(0)))).cast("int")
    s = score("c")
    return j.select(
        "lender",
        *[zero(c) for c in ("n_products", "n_issues", "n_critical", "n_warnings", "products_with_issues")],
        s.alias("confidence"),
        score("k").alias("completeness"),
        F.when(none, 0).otherwise(100).cast("int").alias("consistency"),
        F.when(s < 40, "quarantined").when(s < 70, "warning").otherwise("passed").alias("status"),
    )


def quarantine(products: DataFrame, verification: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined with reason and report), both without collecting: two filters of one
    join.  The report is the lender's verification row."""
    report = F.struct(*[c for c in verification.columns if c != "lender"])
    j = products.join(verification.select("lender", "status", F.col("confidence").alias("lender_confidence"), report.alias("report")), "lender")
    reason = F.concat(F.lit("confidence "), F.col("lender_confidence").cast("string"))
    return j.where("status <> 'quarantined'").drop("report"), j.where("status = 'quarantined'").withColumn("reason", reason)


def done_checks(products: DataFrame, states: DataFrame, tiers: DataFrame) -> DataFrame:
    """Output checks: (check, checked, failed, passed)."""
    four = states.groupBy("product_id").agg(F.count_if("priced").alias("n")).agg(F.count("*").alias("checked"), F.count_if(F.col("n") < 4).alias("failed"))
    slug = products.agg(F.count("*").alias("checked"), F.count_if(~P.is_slug(F.col("slug"))).alias("failed"))
    band = tiers.groupBy("product_id", "loan_type", "repayment", "lvr_min", "lvr_max").agg((F.min("interest_rate") != F.max("interest_rate")).alias("x"))
    clash = band.agg(F.count("*").alias("checked"), F.count_if("x").alias("failed"))
    fixed = products.where("rate_type = 'Fixed'").agg(F.count("*").alias("checked"), F.count_if(F.col("fixed_term_years").isNull()).alias("failed"))
    out = None
    for name, df in (("four_states", four), ("id_charset", slug), ("band_conflicts", clash), ("fixed_terms", fixed)):
        row = df.select(F.lit(name).alias("check"), "checked", "failed", (F.col("failed") == 0).alias("passed"))
        out = row if out is None else out.unionByName(row)
    return out


def widget(text: Column, n_axes: Column) -> Column:
    """struct(kind, depth): the first kind of widget with hits enough and axes few enough."""
    t = F.lower(F.coalesce(text, F.lit("")))
    out = None
    for kind, (terms, hits, axes, depth) in L.WIDGETS.items():
        test = (n_axes > 0) & (n_axes <= axes) & (L.count_hits(t, terms) >= hits)
        row = F.struct(F.lit(kind).alias("kind"), F.lit(depth).alias("depth"))
        out = F.when(test, row) if out is None else out.when(test, row)
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("kind"), F.lit(L.DEFAULT_DEPTH).alias("depth")))


def is_calculator(text: Column, listing_size: Column) -> Column:
    """Two hits, or one where no listing has more than two elements."""
    n = L.count_hits(F.lower(F.coalesce(text, F.lit(""))), L.WIDGETS["calculator"][0])
    return (n >= 2) | ((n >= 1) & ~(listing_size > 2))
