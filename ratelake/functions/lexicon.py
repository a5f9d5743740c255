"""Keyword lexicons and the matching rules over them, as Catalyst expressions.

Matching is by substring on the lower-cased, trimmed text: exclusions veto, any phrase
matches, and a pattern matches a text of at most ``max_words`` words.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Category:
    phrases: tuple = ()
    patterns: tuple = ()
    exclusions: tuple = ()
    labels: tuple = ()
    max_words: int | None = None


# The classification vocabulary.
LEXICON: dict[str, Category] = {
    "loan_type": Category(
        ("home to live", "home to live in", "owner occup", "owner-occup", "owner occupier", "investment property", "invest property"),
        ("home", "house", "residential", "owner", "occup", "live", "investment", "invest", "property", "purchase", "refinance"),
        ("home loan rates", "what are", "buy a property", "a home", "institutional", "insights", "solutions", "important information", "contact", "about", "help", "login", "search", "menu", "navigation"),
        ("loan type", "loan purpose", "property type", "property purpose"),
        4,
    ),
    "repayment_type": Category(
        ("principal & interest", "principal and interest", "principal & int", "interest only", "interest-only"),
        ("principal", "interest", "p&i", "p and i", "p+i", "io", "repayment"),
        ("institutional", "insights", "solutions", "important information", "contact", "about", "help", "login", "search", "menu", "navigation", "additional charges"),
        ("repayment type", "repayment", "repay"),
        5,
    ),
    "lvr_tier": Category(phrases=("lvr", "loan to value", "ltv", "value ratio", "%")),
    "loan_term": Category(phrases=("term", "fixed", "year", "month", "duration", "period")),
    "rate_type": Category(
        ("fixed rate", "variable rate", "split rate", "introductory rate", "honeymoon rate", "intro rate"),
        ("fixed", "variable", "split", "introductory", "honeymoon", "intro"),
        (),
        ("rate type", "interest rate type", "rate"),
        3,
    ),
    "loan_purpose": Category(
        ("first home buyer", "first home", "owner occupied refinance", "investment refinance", "construction loan", "construction", "land loan", "land purchase", "equity release", "equity loan", "refinance", "top up"),
        ("first home", "fhb", "construction", "land", "equity", "top up", "top-up"),
        (),
        ("loan purpose", "purpose", "what is this for"),
        4,
    ),
    "product_segment": Category(
        ("package", "basic", "offset account", "no offset", "professional package", "digital only", "online only", "branch only"),
        ("package", "basic", "offset", "professional", "digital", "online", "premium", "standard"),
        (),
        ("product type", "package type", "features", "product features"),
        3,
    ),
    "region_residency": Category(
        ("state", "residency", "resident", "non resident", "non-resident", "foreign income", "australian resident", "permanent resident"),
        ("state", "resident", "foreign", "overseas", "nsw", "vic", "qld", "wa", "sa", "tas", "nt", "act"),
        (),
        ("state", "region", "residency", "location"),
        3,
    ),
    "rate_tier": Category(
        ("loan amount", "loan size", "risk band", "credit score", "credit rating", "loan to income", "lti"),
        ("amount", "size", "band", "tier", "risk", "credit", "lti", "loan to income"),
        (),
        ("loan amount", "amount band", "risk", "credit"),
        4,
    ),
}

# Page-widget vocabularies, with (hits at least, axes at most, depth).
WIDGETS: dict[str, tuple[tuple, int, int, int]] = {
    "calculator": (("estimated rate", "your rate", "calculate", "calculator", "example rate", "indicative rate", "rate estimate", "enter your", "estimate your", "find out your", "personalised rate", "what could you", "repayment calculator", "how much could i borrow", "borrowing power"), 5, 15, 1),
    "eligibility": (("check eligibility", "am i eligible", "see if you qualify", "check if you qualify", "eligibility checker", "do i qualify", "pre-qualification", "quick check", "eligibility quiz", "find out if you", "see if i qualify"), 2, 5, 0),
    "comparison": (("compare products", "side by side", "product comparison", "compare options", "comparison tool", "compare loans", "which is right for you", "compare features", "product selector", "find the right loan"), 2, 6, 1),
    "simulator": (("try it out", "interactive demo", "simulator", "simulation", "see how it works", "example scenario", "what if scenario", "test drive", "preview your"), 2, 5, 0),
}
DEFAULT_DEPTH = 5
SHOW_MORE = ("show more", "load more", "view all", "see more", "show all", "expand", "view more")
RESET = ("reset", "clear", "clear all", "reset filters", "clear filters", "reset all")
NUMERIC_INPUTS = {"loan_amount": (("loan", "amount", "borrow"), 500000), "property_value": (("property", "purchase", "value"), 650000), "deposit": (("deposit", "down payment", "equity"), 100000), "lvr": (("lvr", "loan to value", "ratio"), 80)}


@dataclass(frozen=True)
class Lexicon:
    """A vocabulary that can be overridden category by category."""

    categories: dict = field(default_factory=lambda: dict(LEXICON))

    def override(self, **fields) -> "Lexicon":
        """``override(loan_type={"max_words": 6})``"""
        return Lexicon(self.categories | {k: replace(self.categories[k], **v) for k, v in fields.items()})

    def loaded(self, data: dict) -> "Lexicon":
        """With the categories of a vocabulary file: phrases (or keywords), patterns, exclusions,
        label_keywords and max_words."""
        new = {}
        for name, c in data.items():
            words = lambda *keys: tuple(str(w).lower() for k in keys for w in c.get(k) or ())  # noqa: E731, B023
            new[name] = Category(words("phrases", "keywords"), words("patterns"), words("exclusions"), words("label_keywords"), int(c["max_words"]) if c.get("max_words") else None)
        return Lexicon(self.categories | new)

    def labels(self, category: str) -> tuple:
        return self.categories[category].labels


DEFAULT = Lexicon()


def has_any(text: Column, terms) -> Column:
    """Whether a (lower-cased) text holds any of the terms."""
    hit = F.lit(False)
    for t in terms:
        hit = hit | text.contains(t)
    return hit


def count_hits(text: Column, terms) -> Column:
    n = F.lit(0)
    for t in terms:
        n = n + text.contains(t).cast("int")
    return n


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))


def matches(text: Column, category: str, max_words: int | None = None, lexicon: Lexicon = DEFAULT) -> Column:
    """Whether a text names an option of the category; null text does not."""
    c = lexicon.categories[category]
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    limit = c.max_words if max_words is None else max_words
    hit = has_any(t, c.phrases)
    if c.patterns:
        by_pattern = (word_count(t) <= limit) & has_any(t, c.patterns)
        if category == "loan_type":
            by_pattern = by_pattern & ~has_any(t, lexicon.categories["repayment_type"].patterns)
        hit = hit | by_pattern
    return ~has_any(t, c.exclusions) & hit if c.exclusions else hit


def option_type(text: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """The first category, in order of priority, that an option belongs to; else null."""
    loan = matches(text, "loan_type", 4, lexicon) & ~matches(text, "repayment_type", None, lexicon)
    out = F.when(matches(text, "rate_type", None, lexicon), "rate_type").when(matches(text, "loan_purpose", None, lexicon), "loan_purpose").when(loan, "loan_type")
    out = out.when(matches(text, "repayment_type", 5, lexicon), "repayment_type")
    for c in ("product_segment", "region_residency", "rate_tier"):
        out = out.when(matches(text, c, None, lexicon), c)
    return out


# Gates that a control's name and options pass before its options' patterns count.
GATES = (
    ("repayment_type", ("repayment", "repay", "payment", "principal", "p&i", "io")),
    ("rate_type", ("rate", "fixed", "variable", "split")),
    ("loan_type", ("loan", "type", "purpose", "property", "home", "house", "owner", "occup", "invest")),
    ("loan_purpose", ("first home", "construction", "land", "equity", "refinance")),
    ("product_segment", ("package", "offset", "basic", "professional", "digital")),
    ("lvr_tier", None),
    ("rate_tier", ("amount", "band", "risk", "credit", "tier")),
    ("region_residency", ("state", "resident", "region", "location")),
    ("loan_term", None),
)


def filter_name(element_id: Column, name: Column, css: Column, options: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """The axis a page control stands for; ``options`` are its texts joined by spaces."""
    own = F.lower(F.concat_ws(" ", F.coalesce(element_id, F.lit("")), F.coalesce(name, F.lit("")), F.coalesce(css, F.lit(""))))
    opts = F.lower(F.coalesce(options, F.lit("")))
    both = F.concat_ws(" ", own, opts)
    out = None
    for axis, gate in GATES:
        c = lexicon.categories[axis]
        test = has_any(both, c.phrases) if gate is None else has_any(both, gate) & has_any(opts, c.patterns)
        out = F.when(test, axis) if out is None else out.when(test, axis)
    plain = lambda c: F.translate(F.lower(c), " -", "__")
    given = F.coalesce(F.nullif(name, F.lit("")), F.nullif(element_id, F.lit("")))
    return out.otherwise(F.coalesce(plain(given), F.lit("filter_unknown")))
