"""Parse tables from the fixtures."""

import pytest
from pyspark.sql import functions as F

from ratelake.functions import axes as A
from ratelake.functions import lexicon as L
from ratelake.functions import parsing as P


def one(spark, make, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in df.select("i", make(F.col("t")).alias("x")).orderBy("i").collect()]


def test_rates(spark):
    ok = ["6.49%", "6.49 %", "6.49% p.a", "6.49 per cent", "6.49 per cent p.a", "6.49% p.a.", "6.49 p.a."]
    assert one(spark, P.rate, *ok, "no rate", None, "") == [6.49] * 7 + [6.5] * 3
    assert one(spark, lambda t: P.comparison_rate(t, F.lit(6.5)), "6.8%", None) == [6.8, 6.8]
    assert one(spark, P.comparison_in_text, "6.5% p.a Comparison rate of\n 6.71 % p.a", "none") == [6.71, None]


def test_terms(spark):
    values = ["30 years", "2 years", "24 months", "12 months", "invalid", None, "30 yr", "2 yr"]
    assert one(spark, P.term_months, *values) == [360, 24, 24, 12, 360, 360, 360, 24]
    assert one(spark, lambda t: P.term_months(t, strict=False), *values)[-2:] == [30, 2]
    assert one(spark, P.fixed_term_of_name, "2 Year Fixed", "Fixed 5-yr", "Fixed") == [24, 60, None]


def test_types_features_fees(spark):
    assert one(spark, P.rate_type, "Fixed", "VARIABLE x", "split", "other", None) == ["fixed", "variable", "split", "variable", "variable"]
    assert one(spark, P.feature_tags, "Offset account, redraw facility", "cash back premium", "") == [["offset", "redraw"], ["cashback", "package"], []]
    assert one(spark, P.first_fee, "fee $1,395.50 now", "$10", "free") == [1395.5, 10.0, None]
    assert one(spark, lambda t: P.last_fee(F.split(t, ";")), "$5;x;$7;y", "none") == [7.0, None]
    assert one(spark, lambda t: P.normal_fees(F.create_map(F.lit("application"), t)), "600.9", "bad") == [{"application": 600, "ongoing": 0}, {"application": 0, "ongoing": 0}]
    assert one(spark, lambda t: P.first_number(t, 95.0), "95%", "90.5", "bad") == [95.0, 90.5, 95.0]
    assert one(spark, P.first_number, "6.0", "bad") == [6.0, None]


def test_names_and_flags(spark):
    assert one(spark, P.collapse, "  Test   Product  ", "", None) == ["Test Product", "Unknown Product", "Unknown Product"]
    assert one(spark, P.slugify, "Home & Land_Loan/A", "A\tB", "--x  y--", None, "Ünï") == ["home-and-land-loan-a", "ab", "x-y", "", "n"]
    assert one(spark, P.flags, '["a","b"]', '"x"', "3", "{", None) == [["a", "b"], ["x"], [], [], []]
    assert one(spark, P.file_safe, "Home & Loan (5) ", "x" * 60) == ["Home__Loan_5", "x" * 50]
    assert one(spark, P.title_from_id, "standard-variable_loan") == ["Standard Variable Loan"]
    assert one(spark, P.base_name, "Standard Variable more than", "Simplicity PLUS 60% or less LVR*", "Basic") == ["Standard Variable", "Simplicity PLUS", "Basic"]


@pytest.mark.parametrize(
    "strict, text, want",
    [
        (True, "6.49% p.a Standard Variable 80% or less LVR", (6.49, "Standard Variable", 0.0, 0.8, "Variable")),
        (True, "5.64% p.a Simplicity PLUS special offer discount 60% or less LVR*", (5.64, "Simplicity PLUS special offer discount", 0.0, 0.6, "Variable")),
        (True, "6.69% p.a Standard Variable more than 80% LVR", (6.69, "Standard Variable", 0.8, 1.0, "Variable")),
        (False, "6.69% p.a Standard Variable more than 80% LVR", (6.69, "Standard Variable", None, 0.8, "Variable")),
        (True, "5.99% p.a 2 Year Fixed", (5.99, "2 Year Fixed", None, 0.8, "Fixed")),
        (True, "Invalid text without rate", None),
        (True, "6.49% p.a. Name", None),
    ],
)
def test_options(spark, strict, text, want):
    got = one(spark, lambda t: P.option(t, strict), text)[0]
    assert (tuple(got) if got else None) == want


def test_predicates(spark):
    assert one(spark, P.is_heading, "Standard Variable Home Loan", "Fixed Rate Mortgage", "Basic Home Loan", "Contact Us", "Login", "Menu", "", "A") == [True] * 3 + [False] * 5
    assert one(spark, P.is_product_name, "Standard Home Loan", "Learn more about loans", "xy", None) == [True, False, False, False]
    assert one(spark, P.is_content_url, "https://anz.com.au", "ftp://x", "https://www.google.com/x", None) == [True, False, False, False]
    urls = ["https://anz.com.au/home-loans", "https://anz.com.au/a.pdf", "https://anz.com.au/privacy/", "https://anz.com.au/x?a=1&utm_source=b", "https://cba.com.au/x"]
    assert one(spark, lambda t: P.is_lender_url(t, F.lit("anz.com.au")), *urls) == [True, False, False, False, False]
    pages = ["please solve the CAPTCHA", "No results found", "connection error", "timed out", "search", "x" * 2000 + " search", ""]
    assert one(spark, P.diagnose, *pages) == ["BLOCKED", "NO_RESULTS", "CONNECTION_ERROR", "TIMEOUT", "INCOMPLETE_PAGE", "UNKNOWN", "UNKNOWN"]
    assert one(spark, P.is_slug, "a-b1", "A", "-a", "a--b", "") == [True, False, False, False, False]


def test_lexicon(spark):
    m = lambda c, *v: one(spark, lambda t: L.matches(t, c), *v)
    assert m("loan_type", "Owner Occupied", "Investment", "home principal", "contact about a home", "one two three four house", None) == [True, True, False, False, False, False]
    assert m("repayment_type", "Interest Only", "P&I", "portion", "institutional interest") == [True, True, True, False]
    assert m("lvr_tier", "80%", "LVR", "x") == [True, True, False]
    assert one(spark, L.option_type, "Fixed", "First home buyer", "Owner occupied", "Interest only", "Package", "NSW", "loan size", "zzz") == ["rate_type", "loan_purpose", "loan_type", "repayment_type", "product_segment", "region_residency", "rate_tier", None]
    wide = L.DEFAULT.override(loan_type={"max_words": 9})
    assert one(spark, lambda t: L.matches(t, "loan_type", lexicon=wide), "one two three four house") == [True]


def test_axes(spark):
    df = spark.createDataFrame([([("tab", "Fixed Rates"), ("dropdown", "2 years")],), ([("purpose", "Investment"), ("repayment", "Interest Only"), ("lvr", "more than 80%")],), ([("rate_type", "Fixed")],), ([],)], "e array<struct<key: string, value: string>>")
    got = [r.a for r in df.select(A.normalize(F.col("e")).alias("a")).collect()]
    assert (got[0].rate_type, got[0].fixed_term_months, got[0].missing_fixed_term) == ("Fixed", 24, False)
    assert (got[1].purpose, got[1].repayment_type, got[1].lvr_min, got[1].lvr_max, got[1].lvr_tier, got[1].occupancy) == ("Investment_Purchase", "InterestOnly", 0.8, 1.0, ">80%", "Investment")
    assert got[2].missing_fixed_term and not got[3].missing_fixed_term and got[3].rate_type is None
    e = spark.createDataFrame([([("state", "NSW and Victoria"), ("segment", "Platinum"), ("customer", "Doctor")],)], "e array<struct<key: string, value: string>>").select(A.eligibility(F.col("e")).alias("x")).first().x
    assert (e.product_segment, e.region_restrictions, e.borrower_category) == ("Premium", ["NSW", "VIC"], "Professional")


def test_env_substitution():
    assert P.substitute("a: ${X:-1} ${Y}", {"Y": "2"}) == "a: 1 2" and P.substitute("${X:-1}", {"X": "7"}) == "7"
