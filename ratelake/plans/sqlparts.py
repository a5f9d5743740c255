"""Pieces of DuckDB SQL for the oracle side."""

from __future__ import annotations

from ..functions import lexicon as L


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_of(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, {quote(t)})" for t in terms) + ")" if terms else "false"


def hits(x: str, terms) -> str:
    return "(" + " + ".join(f"contains({x}, {quote(t)})::INT" for t in terms) + ")"


def num(x: str, pattern: str, n: int = 1, flags: str = "") -> str:
    return f"TRY_CAST(NULLIF(regexp_extract({x}, {quote(flags + pattern)}, {n}), '') AS DOUBLE)"


def words(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array(trim({x}), '\\s+'), lambda w: w <> ''))"


def matches(x: str, category: str, max_words: int | None = None) -> str:
    c = L.LEXICON[category]
    t = f"lower(trim(coalesce({x}, '')))"
    hit = any_of(t, c.phrases)
    if c.patterns:
        by = f"({words(t)} <= {c.max_words if max_words is None else max_words} AND {any_of(t, c.patterns)}"
        by += f" AND NOT {any_of(t, L.LEXICON['repayment_type'].patterns)})" if category == "loan_type" else ")"
        hit = f"({hit} OR {by})"
    return f"(NOT {any_of(t, c.exclusions)} AND {hit})" if c.exclusions else hit


def option_type(x: str) -> str:
    m = lambda c, w=None: matches(x, c, w)
    return (
        f"CASE WHEN {m('rate_type')} THEN 'rate_type' WHEN {m('loan_purpose')} THEN 'loan_purpose' WHEN {m('loan_type', 4)} AND NOT {m('repayment_type')} THEN 'loan_type'"
        f" WHEN {m('repayment_type', 5)} THEN 'repayment_type' WHEN {m('product_segment')} THEN 'product_segment' WHEN {m('region_residency')} THEN 'region_residency' WHEN {m('rate_tier')} THEN 'rate_tier' END"
    )


def slug(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace(regexp_replace(lower(coalesce({x}, '')), '[ _/]', '-', 'g'), '&', '-and-'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '-')"


def first_rate(x: str) -> str:
    return f"coalesce({num(x, r'(\d+\.?\d*)\s*%')}, {num(x, r'(\d+\.?\d*)\s*per\s*cent', 1, '(?i)')}, {num(x, r'(\d+\.?\d*)\s*p\.a\.', 1, '(?i)')})"


LOAN = "CASE WHEN contains(coalesce(purpose, ''), 'Invest') THEN 'Investment' ELSE 'OwnerOccupied' END"
REPAY = "CASE WHEN contains(coalesce(repayment_type, ''), 'InterestOnly') OR contains(coalesce(repayment_type, ''), 'Interest Only') OR contains(coalesce(repayment_type, ''), 'IO') THEN 'InterestOnly' ELSE 'PrincipalAndInterest' END"
