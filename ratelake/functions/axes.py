"""Normalising captured page controls: an array of (key, value) entries, in page order,
becomes pricing axes and eligibility.  Of several entries for an axis the last one wins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import has_any, matches
from .parsing import number


def _last(entries: Column, value) -> Column:
    """The last entry's non-null value."""
    return F.try_element_at(F.filter(F.transform(entries, value), lambda x: x.isNotNull()), F.lit(-1))


def _first(entries: Column, value) -> Column:
    return F.try_element_at(F.filter(F.transform(entries, value), lambda x: x.isNotNull()), F.lit(1))


def _low(e: Column) -> tuple[Column, Column]:
    return F.lower(F.coalesce(e["key"], F.lit(""))), F.lower(F.coalesce(e["value"], F.lit("")))


def purpose(entries: Column) -> Column:
    everything = F.lower(F.array_join(F.transform(entries, lambda e: F.coalesce(e["value"], F.lit(""))), " "))

    def of(e):
        k, v = _low(e)
        found = (
            F.when(v.contains("invest"), "Investment_Purchase")
            .when(has_any(v, ("owner", "home", "live")), "OwnerOccupied_Purchase")
            .when(v.contains("first-home"), "OwnerOccupied_Purchase")
            .when(v.contains("construction"), "OwnerOccupied_Construction")
            .when(v.contains("refinance"), F.when(everything.contains("investment"), "Investment_Refinance").otherwise("OwnerOccupied_Refinance"))
        )
        return F.when(matches(e["value"], "loan_type") | has_any(k, ("purpose", "loan_type", "property")), found)

    return _last(entries, of)


def repayment_type(entries: Column) -> Column:
    def of(e):
        k, v = _low(e)
        found = F.when(has_any(v, ("interest only", "interest-only", "io", "i/o")), "InterestOnly").when(has_any(v, ("principal", "p&i", "p and i", "p+i")), "PrincipalAndInterest")
        return F.when(matches(e["value"], "repayment_type") | has_any(k, ("repayment", "repay")), found)

    return _last(entries, of)


def _rate_entry(e) -> Column:
    k, v = _low(e)
    return matches(e["value"], "rate_type") | has_any(k, ("rate_type", "rate type")) | has_any(v, ("fixed", "variable"))


def rate_type(entries: Column) -> Column:
    def of(e):
        _, v = _low(e)
        return F.when(_rate_entry(e), F.when(v.contains("fixed"), "Fixed").when(has_any(v, ("var", "split")), "Variable"))

    return _last(entries, of)


def _term(v: Column) -> Column:
    return F.coalesce(number(v, r"(\d+)\s*year") * 12, number(v, r"(\d+)\s*month"))


def fixed_term_months(entries: Column) -> Column:
    """From term entries (last wins), else from fixed-rate entries, else, for a fixed rate,
    from the first entry that tells a term anywhere."""

    def by_term(e):
        k, v = _low(e)
        return F.when(matches(e["value"], "loan_term") | k.contains("term") | has_any(v, ("year", "month")), _term(v))

    def by_rate(e):
        _, v = _low(e)
        return F.when(_rate_entry(e) & v.contains("fixed"), number(v, r"(\d+)\s*(?:year|yr)") * 12)

    def anywhere(e):
        k, v = _low(e)
        t = F.concat_ws(" ", k, v)
        return F.coalesce(number(t, r"(\d+)\s*[-]?\s*year") * 12, number(t, r"(\d+)\s*[-]?\s*month"))

    found = F.coalesce(_last(entries, by_term), _last(entries, by_rate))
    return F.coalesce(found, F.when(rate_type(entries) == "Fixed", _first(entries, anywhere))).cast("int")


def lvr(entries: Column) -> Column:
    """struct(lvr_min, lvr_max, lvr_tier)"""

    def of(e):
        k, v = _low(e)
        digits = F.nullif(F.regexp_extract(F.coalesce(e["value"], F.lit("")), r"(\d+)%", 1), F.lit(""))
        top = digits.try_cast("double") / 100
        below = has_any(v, ("≤", "less", "up to"))
        above = ~below & has_any(v, (">", "more", "greater"))
        found = F.struct(
            F.when(above, top).otherwise(0.0).alias("lvr_min"),
            F.when(above, 1.0).otherwise(top).alias("lvr_max"),
            F.concat(F.when(below, "≤").when(above, ">").otherwise(""), digits, F.lit("%")).alias("lvr_tier"),
        )
        return F.when((matches(e["value"], "lvr_tier") | has_any(k, ("lvr", "loan to value", "ltv"))) & digits.isNotNull(), found)

    return _last(entries, of)


def normalize(entries: Column) -> Column:
    """struct of all pricing axes; missing_fixed_term marks a fixed rate without a term."""
    p, r, m, band = purpose(entries), rate_type(entries), fixed_term_months(entries), lvr(entries)
    return F.struct(
        p.alias("purpose"),
        repayment_type(entries).alias("repayment_type"),
        r.alias("rate_type"),
        m.alias("fixed_term_months"),
        band["lvr_min"].alias("lvr_min"),
        band["lvr_max"].alias("lvr_max"),
        band["lvr_tier"].alias("lvr_tier"),
        F.when(p.contains("Investment"), "Investment").when(p.isNotNull(), "OwnerOccupied").alias("occupancy"),
        (F.coalesce(r == "Fixed", F.lit(False)) & m.isNull()).alias("missing_fixed_term"),
    )


# Regions in order, with their full names.
REGIONS = (("NSW", "new south wales"), ("VIC", "victoria"), ("QLD", "queensland"), ("SA", "south australia"), ("WA", "western australia"), ("TAS", "tasmania"), ("NT", "northern territory"), ("ACT", "australian capital territory"))


def regions(text: Column) -> Column:
    """Region codes named in a text: those whose code it holds, in order, then those named in
    full only; null if none."""
    t = F.lower(F.coalesce(text, F.lit("")))
    by_code = [F.when(t.contains(c.lower()), F.lit(c)) for c, _ in REGIONS]
    by_name = [F.when(t.contains(n) & ~t.contains(c.lower()), F.lit(c)) for c, n in REGIONS]
    found = F.array_compact(F.array(*by_code, *by_name))
    return F.when(F.size(found) > 0, found)


def eligibility(entries: Column) -> Column:
    """struct(product_segment, region_restrictions, borrower_category)"""

    def segment(e):
        k, v = _low(e)
        kind = F.when(has_any(v, ("premium", "prestige", "platinum")), "Premium").when(has_any(v, ("standard", "classic", "plus")), "Standard").when(has_any(v, ("basic", "essential", "smart")), "Basic").when(v.contains("package"), "Package")
        return F.when(has_any(k, ("segment", "tier")), F.coalesce(kind, F.trim(e["value"])))

    def where(e):
        k, _ = _low(e)
        return F.when(has_any(k, ("region", "state", "residency", "location")), regions(e["value"]))

    def who(e):
        k, v = _low(e)
        kind = (
            F.when(has_any(v, ("business", "commercial", "company")), "Business")
            .when(has_any(v, ("personal", "individual", "consumer")), "Personal")
            .when(has_any(v, ("first home", "fhb", "first-home")), "FirstHomeBuyer")
            .when(has_any(v, ("professional", "doctor", "medical")), "Professional")
        )
        return F.when(has_any(k, ("borrower", "customer", "category")), F.coalesce(kind, F.trim(e["value"])))

    return F.struct(_last(entries, segment).alias("product_segment"), _last(entries, where).alias("region_restrictions"), _last(entries, who).alias("borrower_category"))
