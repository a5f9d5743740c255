"""Parsing of product text: names, rates, terms, loan-to-value bands, fees, urls.

Every function takes and returns Column expressions, so parsing stays in generated code
and filters on parsed values push down as far as the source allows.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import has_any


def group(text: Column, pattern: str, n: int = 1) -> Column:
    """A regex group, null where there is no match or the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


def number(text: Column, pattern: str, n: int = 1) -> Column:
    return group(text, pattern, n).try_cast("double")


def empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


# names and ids


def slugify(text: Column) -> Column:
    """Lower-case; space, underscore and slash become hyphens, & becomes "and", the rest of
    what isn't a-z, 0-9 or hyphen goes; null gives an empty slug."""
    t = F.regexp_replace(F.lower(empty(text)), "[ _/]", "-")
    t = F.regexp_replace(F.replace(t, F.lit("&"), F.lit("-and-")), "[^a-z0-9-]", "")
    return F.btrim(F.regexp_replace(t, "-+", "-"), F.lit("-"))


def product_id(lender: Column, name: Column, short_name: Column | None = None) -> Column:
    best = name if short_name is None else F.coalesce(F.nullif(short_name, F.lit("")), name)
    return F.concat_ws("-", slugify(lender), slugify(best))


STRATEGY_CODES = {"network_api": "API", "jsonld": "JSONLD", "datalayer": "DL", "compare_cards": "CC", "dom_parsing": "DOM"}


def strategy_id(lender: Column, strategy: str, name: Column) -> Column:
    return F.concat_ws("-", lender, F.lit(STRATEGY_CODES.get(strategy, strategy)), F.left(F.regexp_replace(name, "[^a-zA-Z0-9]", "-"), F.lit(50)))


def is_slug(text: Column) -> Column:
    return empty(text).rlike("^[a-z0-9]+(-[a-z0-9]+)*$")


def collapse(text: Column, default: str = "Unknown Product") -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit("")), F.lit(default))


def lender_or_unknown(lender: Column) -> Column:
    return F.coalesce(lender, F.lit("Unknown"))


def file_safe(name: Column) -> Column:
    """Letters, digits, space, hyphen and underscore; spaces become underscores; 50 at most."""
    return F.left(F.replace(F.rtrim(F.regexp_replace(name, "[^A-Za-z0-9 _-]", "")), F.lit(" "), F.lit("_")), F.lit(50))


def title_from_id(element_id: Column) -> Column:
    return F.initcap(F.regexp_replace(element_id, "[-_]", " "))


def base_name(name: Column) -> Column:
    """A name without a trailing qualifier, then without a trailing band."""
    t = F.trim(F.regexp_replace(name, r"(?i)\s+(more\s+than|or\s+less|less\s+than|up\s+to|over|more|less)$", ""))
    return F.trim(F.regexp_replace(t, r"(?i)\s+\d+%.*?LVR.*$", ""))


# rates


RATE_PATTERNS = (r"(\d+\.?\d*)\s*%", r"(?i)(\d+\.?\d*)\s*per\s*cent", r"(?i)(\d+\.?\d*)\s*p\.a\.")


def first_rate(text: Column) -> Column:
    return F.coalesce(*[number(text, p) for p in RATE_PATTERNS])


def rate(text: Column, default: float = 6.5) -> Column:
    return F.coalesce(first_rate(text), F.lit(default))


def comparison_rate(text: Column, base: Column, margin: float = 0.3) -> Column:
    return F.coalesce(first_rate(text), F.round(base + F.lit(margin), 4))


def plain_rate(text: Column) -> Column:
    return number(text, r"(\d+\.?\d*)\s*%")


def comparison_in_text(text: Column) -> Column:
    return number(text, r"(?s)[Cc]omparison\s+rate.*?([\d.]+)\s*%")


def rate_type(text: Column) -> Column:
    t = F.lower(empty(text))
    return F.when(t.contains("fixed"), "fixed").when(t.contains("variable"), "variable").when(t.contains("split"), "split").otherwise("variable")


def rate_type_of_name(name: Column) -> Column:
    return F.when(F.lower(empty(name)).contains("fix"), "Fixed").otherwise("Variable")


# terms


def term_months(text: Column, strict: bool = True) -> Column:
    """Months from "n years", "n months" or "n yr"; strict scales "yr" too, else it is taken
    as it stands; default 360."""
    t = F.lower(empty(text))
    years = number(t, r"(\d+)\s*years?")
    months = number(t, r"(\d+)\s*months?")
    yr = number(t, r"(\d+)\s*yr")
    scale = F.when(t.contains("year"), 12).otherwise(1)
    short = yr * 12 if strict else yr
    return F.coalesce(years * 12, months * scale, short, F.lit(360)).cast("int")


def ui_term_months(text: Column) -> Column:
    t = F.lower(empty(text))
    return F.coalesce(number(t, r"(\d+)\s*year") * 12, number(t, r"(\d+)\s*month")).cast("int")


def fixed_term_of_name(name: Column) -> Column:
    return (number(F.lower(empty(name)), r"(\d+)\s*[-]?\s*(?:year|yr)s?") * 12).cast("int")


# dropdown options and loan-to-value bands


# Shapes of option texts.
OPTION = r"(?i)^([\d.]+)%\s*p\.a\s+(.+)$"
TAIL = r"^(.*?)\s+(\d+%.*?LVR.*?)\*?$"
QUALIFIER = r"(?i)\s+(more than|or less|less than|up to|over|more|less)$"


def option(text: Column, strict: bool = True) -> Column:
    """struct(rate, name, lvr_min, lvr_max, rate_type) of a text like
    ``6.49% p.a Standard Variable 80% or less LVR``; null if it isn't one.  Without a band
    the maximum is 0.8.

    Strict also reads a qualifier that stands before the band ("more than 80% LVR" is the
    band above 0.8); otherwise it only leaves the name.
    """
    t = F.trim(empty(text))
    r = number(t, OPTION, 1)
    rest = group(t, OPTION, 2)
    tail = group(rest, TAIL, 2)
    head = F.trim(F.when(tail.isNull(), rest).otherwise(F.regexp_extract(rest, TAIL, 1)))
    before = F.lower(F.regexp_extract(head, QUALIFIER, 1))
    said = F.lower(F.concat_ws(" ", tail, before) if strict else empty(tail))
    pct = number(tail, r"(\d+)%") / 100
    below = said.rlike("or less|less than|up to")
    above = said.rlike("more than|over|greater") & ~below & pct.isNotNull()
    name = F.trim(F.regexp_replace(head, QUALIFIER, ""))
    lo = F.when(below & pct.isNotNull(), 0.0).when(above, pct)
    hi = F.when(above, 1.0).otherwise(F.coalesce(pct, F.lit(0.8)))
    kind = F.when(F.lower(name).contains("fixed"), "Fixed").otherwise("Variable")
    return F.when(r.isNotNull(), F.struct(r.alias("rate"), name.alias("name"), lo.alias("lvr_min"), hi.alias("lvr_max"), kind.alias("rate_type")))


def band_parts(text: Column) -> Column:
    """struct(kind, bound) of a tier label, of any text: kind le, gt, lt, index or null."""
    t = F.trim(empty(text))
    pct = number(t, r"(\d+(?:\.\d+)?)\s*%") / 100
    kind = F.when(F.lower(t).contains("index"), "index").when(t.startswith("≤"), "le").when(t.startswith(">"), "gt").when(t.startswith("<"), "lt")
    return F.struct(kind.alias("kind"), pct.alias("bound"))


def is_band(b: Column) -> Column:
    return b["kind"].isNotNull() & ((b["kind"] == "index") | b["bound"].isNotNull())


def band(text: Column) -> Column:
    """struct(kind, bound) of a tier label, else null."""
    b = band_parts(text)
    return F.when(is_band(b), b)


def lvr_label(lo: Column, hi: Column) -> Column:
    pct = lambda c: F.concat(F.round(c * 100).cast("int").cast("string"), F.lit("%"))
    return F.when(F.coalesce(lo, F.lit(0.0)) <= 0, F.concat(F.lit("≤"), pct(hi))).when(hi >= 1, F.concat(F.lit(">"), pct(lo))).otherwise(F.concat(pct(lo), F.lit("-"), pct(hi)))


def as_fraction(lvr: Column) -> Column:
    return F.when(lvr > 1, lvr / 100).otherwise(lvr)


def as_percent(fraction: Column) -> Column:
    """Whole percent, cut, after rounding off binary noise."""
    return F.floor(F.round(fraction * 100, 6)).cast("int")


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


# fees, features, flags


def first_fee(text: Column) -> Column:
    return F.replace(group(text, r"\$(\d+(?:,\d{3})*(?:\.\d{2})?)"), F.lit(","), F.lit("")).try_cast("double")


def last_fee(texts: Column) -> Column:
    """Of an array of texts the last one's fee that has any."""
    fees = F.filter(F.transform(texts, first_fee), lambda x: x.isNotNull())
    return F.try_element_at(fees, F.lit(-1))


def normal_fees(fees: Column) -> Column:
    """Fees as whole numbers, 0 where they are none; application and ongoing default to 0."""
    whole = F.transform_values(fees, lambda k, v: F.coalesce(v.try_cast("double").try_cast("int"), F.lit(0)))
    return F.map_from_entries(
        F.array_sort(F.concat(F.map_entries(F.map_filter(whole, lambda k, v: ~k.isin("application", "ongoing"))), *[F.array(F.struct(F.lit(k).alias("key"), F.coalesce(F.try_element_at(whole, F.lit(k)), F.lit(0)).alias("value"))) for k in ("application", "ongoing")]))
    )


# Feature vocabulary.
FEATURES = {"offset": ("offset",), "redraw": ("redraw",), "cashback": ("cashback", "cash back", "bonus"), "package": ("package", "premium", "professional")}


def feature_tags(text: Column) -> Column:
    t = F.lower(empty(text))
    return F.array_compact(F.array(*[F.when(has_any(t, words), F.lit(tag)) for tag, words in FEATURES.items()]))


def feature_texts(texts: Column) -> Column:
    return F.filter(F.transform(texts, lambda t: F.trim(t)), lambda x: F.length(x) > 2)


def first_number(text: Column, default: float | None = None) -> Column:
    return F.coalesce(number(text, r"(\d+\.?\d*)"), F.lit(default).cast("double"))


def flags(value: Column) -> Column:
    """A JSON list as a list, a string as a list of one, anything else as an empty list."""
    v = F.try_parse_json(value)
    kind = F.schema_of_variant(v)
    items = F.try_variant_get(v, "$", "array<string>")
    one = F.try_variant_get(v, "$", "string")
    return F.when(kind.startswith("ARRAY"), items).when(kind == "STRING", F.array(one)).otherwise(F.array().cast("array<string>"))


# predicates over names, urls and pages

# Word lists of the predicates.
HEADING_WORDS = ("loan", "rate", "variable", "fixed", "mortgage", "offset", "tailored", "basic")
HEADING_NOT = ("contact", "login", "menu", "search", "apply now", "learn more", "calculator")
NAME_WORDS = ("loan", "rate", "home", "mortgage", "fixed", "variable", "interest")
NAME_NOT = ("menu", "navigation", "footer", "header", "sidebar", "contact", "about", "help", "support", "login", "register", "search", "filter", "sort", "more", "learn", "explore", "book", "appointment", "call", "email", "phone", "download", "app", "mobile", "security", "privacy", "terms", "conditions", "disclaimer", "important", "frequently asked", "faq", "question", "answer")
OTHER_DOMAINS = ("google.com", "bing.com", "duckduckgo.com", "yandex.com", "yahoo.com", "facebook.com", "twitter.com", "linkedin.com", "youtube.com", "instagram.com")
SKIP_URL = (r"\.(pdf|doc|docx|xls|xlsx|ppt|pptx)$", r"/(pdf|documents?|files?)/", r"/(privacy|terms|cookies|legal)/", r"/(contact|about|careers|investor)/", r"/(login|signin|register|account)/", r"/(search|sitemap|robots)", r"/#", r"\?.*utm_")
BLOCK_WORDS = ("captcha", "unusual traffic", "robot", "verify you are human", "blocked", "access denied", "rate limit", "too many requests", "suspicious activity", "automated requests", "bot detection")
NO_RESULT_WORDS = ("no results", "no matches", "didn't find", "0 results", "try again", "refine your search", "no pages found")
UNAVAILABLE_WORDS = ("not available", "unavailable", "n/a", "this product is not available", "no rates available", "not applicable", "not offered")


def is_heading(text: Column) -> Column:
    t = F.lower(empty(text))
    return has_any(t, HEADING_WORDS) & ~has_any(t, HEADING_NOT) & (F.length(t) > 5) & (F.length(t) < 100)


def is_product_name(name: Column) -> Column:
    t = F.lower(empty(name))
    return (F.length(F.trim(t)) >= 3) & ~has_any(t, NAME_NOT) & has_any(t, NAME_WORDS)


def is_content_url(url: Column) -> Column:
    u = empty(url)
    return u.rlike("^https?://") & ~has_any(F.lower(u), OTHER_DOMAINS)


def is_lender_url(url: Column, domain: Column) -> Column:
    u = empty(url)
    ok = u.contains(domain)
    for p in SKIP_URL:
        ok = ok & ~u.rlike("(?i)" + p)
    return ok


def is_blocked(content: Column) -> Column:
    return has_any(F.lower(empty(content)), BLOCK_WORDS)


def diagnose(content: Column) -> Column:
    """Why a search page shows no results."""
    t = F.lower(empty(content))
    return (
        F.when(has_any(t, BLOCK_WORDS), "BLOCKED")
        .when(has_any(t, NO_RESULT_WORDS), "NO_RESULTS")
        .when(t.contains("connection") & (t.contains("error") | t.contains("failed")), "CONNECTION_ERROR")
        .when(t.contains("timeout") | t.contains("timed out"), "TIMEOUT")
        .when(t.contains("rate limit") | t.contains("too many"), "RATE_LIMITED")
        .when(t.contains("search") & (F.length(empty(content)) < 1000), "INCOMPLETE_PAGE")
        .otherwise("UNKNOWN")
    )


def is_placeholder(option_text: Column) -> Column:
    return F.lower(empty(option_text)).rlike("select|please")


def is_unavailable(text: Column) -> Column:
    return has_any(F.lower(empty(text)), UNAVAILABLE_WORDS)


# pricing states


def loan_type(purpose: Column) -> Column:
    return F.when(empty(purpose).contains("Invest"), "Investment").otherwise("OwnerOccupied")


def repayment(kind: Column) -> Column:
    k = empty(kind)
    return F.when(k.contains("InterestOnly") | k.contains("Interest Only") | k.contains("IO"), "InterestOnly").otherwise("PrincipalAndInterest")


def state_id(loan: Column, repay: Column, rate_kind: Column) -> Column:
    return F.concat_ws("_", F.when(loan == "OwnerOccupied", "OO").otherwise("INV"), F.when(repay == "PrincipalAndInterest", "PI").otherwise("IO"), F.left(F.upper(rate_kind), F.lit(3)))


def fixed_years(rate_kind: Column, months: Column) -> Column:
    return F.when((rate_kind == "Fixed") & months.isNotNull(), F.floor(months / 12).cast("int"))


# settings


def substitute(text: str, env: dict | None = None) -> str:
    """``${NAME:-default}`` and ``${NAME}`` from the environment (driver side)."""
    env = os.environ if env is None else env
    return re.sub(r"\$\{([^}:]+)(?::-([^}]*))?\}", lambda m: env.get(m[1], m[2] or ""), text)


# timestamps


def stamp(ts: Column) -> Column:
    """20240131_235959"""
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def snapshot_stamp(ts: Column) -> Column:
    """2024-01-31-23-59-59"""
    return F.date_format(ts, "yyyy-MM-dd-HH-mm-ss")


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def from_iso(text: Column) -> Column:
    return F.try_to_timestamp(text)
