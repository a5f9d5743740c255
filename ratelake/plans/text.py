"""Queries over text: parsing, classification, extraction, discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import axes as A
from ..functions import lexicon as L
from ..functions import parsing as P
from ..operators import discovery, extract, normalize, quality, resolve
from ..sources.readers import table
from . import derive as D
from . import sqlparts as S
from .registry import query

c = F.col


def _jx(j: str, *keys: str) -> str:
    return ", ".join(f"NULLIF(json_extract_string({j}, '$.{k}'), '')" for k in keys)


@query(rf"""SELECT p_partkey AS id, {S.slug("p_name")} AS name_slug, {S.slug("p_type")} AS type_slug,
  concat_ws('-', {S.slug("concat('Lender & Co_', p_brand)")}, {S.slug("p_name")}) AS product_id,
  regexp_matches({S.slug("p_name")}, '^[a-z0-9]+(-[a-z0-9]+)*$') AS is_slug,
  left(replace(rtrim(regexp_replace(p_type, '[^A-Za-z0-9 _-]', '', 'g')), ' ', '_'), 50) AS file_name,
  concat_ws('-', p_brand, 'JSONLD', left(regexp_replace(p_name, '[^a-zA-Z0-9]', '-', 'g'), 50)) AS strategy_id FROM part""")
def slugify_names(spark, sf):
    p = table(spark, sf, "part")
    return p.select(
        c("p_partkey").alias("id"),
        P.slugify(c("p_name")).alias("name_slug"),
        P.slugify(c("p_type")).alias("type_slug"),
        P.product_id(F.concat(F.lit("Lender & Co_"), "p_brand"), c("p_name")).alias("product_id"),
        P.is_slug(P.slugify(c("p_name"))).alias("is_slug"),
        P.file_safe(c("p_type")).alias("file_name"),
        P.strategy_id(c("p_brand"), "jsonld", c("p_name")).alias("strategy_id"),
    )


_RATE = "concat(CAST(CAST(round(l_discount * 100) AS INT) AS STRING), CASE l_partkey % 7 WHEN 0 THEN '.49%' WHEN 1 THEN '.5 % p.a' WHEN 2 THEN ' per cent p.a' WHEN 3 THEN '.25 p.a.' WHEN 4 THEN '' ELSE '%' END)"


@query(f"""WITH t AS (SELECT l_orderkey, l_linenumber, {_RATE} AS txt, CASE WHEN l_linenumber % 2 = 0 THEN concat('comparison ', {_RATE}) END AS cmp FROM lineitem),
r AS (SELECT *, coalesce({S.first_rate("txt")}, 6.5) AS rate FROM t)
SELECT l_orderkey, l_linenumber, rate, coalesce({S.first_rate("cmp")}, round(rate + 0.3, 4)) AS comparison_rate,
  coalesce(NULLIF(trim(regexp_replace(concat('  a  ', txt, ' '), '\\s+', ' ', 'g')), ''), 'Unknown Product') AS line FROM r""")
def parse_rate_text(spark, sf):
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_RATE).alias("txt"), F.expr(f"CASE WHEN l_linenumber % 2 = 0 THEN concat('comparison ', {_RATE}) END").alias("cmp"))
    t = t.withColumn("rate", P.rate(c("txt")))
    return t.select("l_orderkey", "l_linenumber", "rate", P.comparison_rate(c("cmp"), c("rate")).alias("comparison_rate"), P.collapse(F.concat(F.lit("  a  "), "txt", F.lit(" "))).alias("line"))


def _option_sql(strict: bool) -> str:
    said = "lower(concat_ws(' ', tail, before))" if strict else "lower(coalesce(tail, ''))"
    q = r"\s+(more than|or less|less than|up to|over|more|less)$"
    return rf"""WITH o AS ({D.sql(D.OPTIONS)}),
a AS (SELECT id, {S.num("trim(text)", r"^([\d.]+)%\s*p\.a\s+(.+)$", 1, "(?i)")} AS rate, NULLIF(regexp_extract(trim(text), '(?i)^([\d.]+)%\s*p\.a\s+(.+)$', 2), '') AS rest FROM o),
b AS (SELECT *, NULLIF(regexp_extract(rest, '^(.*?)\s+(\d+%.*?LVR.*?)\*?$', 2), '') AS tail, regexp_extract(rest, '^(.*?)\s+(\d+%.*?LVR.*?)\*?$', 1) AS h FROM a WHERE rate IS NOT NULL),
d AS (SELECT *, trim(CASE WHEN tail IS NULL THEN rest ELSE h END) AS head FROM b),
e AS (SELECT *, lower(regexp_extract(head, '(?i){q}', 1)) AS before FROM d),
f AS (SELECT *, {said} AS said, {S.num("tail", r"(\d+)%")} / 100 AS pct, trim(regexp_replace(head, '(?i){q}', '')) AS name FROM e),
g AS (SELECT *, regexp_matches(said, 'or less|less than|up to') AS below FROM f),
k AS (SELECT *, regexp_matches(said, 'more than|over|greater') AND NOT below AND pct IS NOT NULL AS above FROM g)
SELECT id, rate, name, CASE WHEN below AND pct IS NOT NULL THEN 0.0 WHEN above THEN pct END::DOUBLE AS lvr_min,
  CASE WHEN above THEN 1.0 ELSE coalesce(pct, 0.8) END::DOUBLE AS lvr_max, CASE WHEN contains(lower(name), 'fixed') THEN 'Fixed' ELSE 'Variable' END AS rate_type,
  trim(regexp_replace(trim(regexp_replace(rest, '(?i)\s+(more\s+than|or\s+less|less\s+than|up\s+to|over|more|less)$', '')), '(?i)\s+\d+%.*?LVR.*$', '')) AS base_name FROM k"""


def _options(spark, sf, strict):
    o = D.derive(spark, sf, D.OPTIONS).withColumn("o", P.option(c("text"), strict)).where("o IS NOT NULL")
    return o.select("id", "o.rate", "o.name", "o.lvr_min", "o.lvr_max", "o.rate_type", P.base_name(P.group(F.trim("text"), P.OPTION, 2)).alias("base_name"))


@query(_option_sql(True))
def parse_option_text(spark, sf):
    return _options(spark, sf, True)


@query(_option_sql(False))
def parse_option_text_compat(spark, sf):
    return _options(spark, sf, False)


_TERM = "CASE p_partkey % 6 WHEN 0 THEN concat(CAST(p_size AS STRING), ' years') WHEN 1 THEN concat(CAST(p_size AS STRING), ' Months') WHEN 2 THEN concat(CAST(p_size AS STRING), ' yr') WHEN 3 THEN '' WHEN 4 THEN concat('Fixed ', CAST(p_size AS STRING), '-year home loan') ELSE NULL END"


def _term_sql(yr: str) -> str:
    t = "lower(coalesce(t, ''))"
    return rf"""coalesce({S.num(t, r"(\d+)\s*years?")} * 12, {S.num(t, r"(\d+)\s*months?")} * CASE WHEN contains({t}, 'year') THEN 12 ELSE 1 END, {S.num(t, r"(\d+)\s*yr")} {yr}, 360)::INT"""


@query(rf"""WITH x AS (SELECT p_partkey AS id, {_TERM} AS t FROM part)
SELECT id, {_term_sql("* 12")} AS months, {_term_sql("")} AS months_compat,
  coalesce({S.num("lower(coalesce(t, ''))", r"(\d+)\s*year")} * 12, {S.num("lower(coalesce(t, ''))", r"(\d+)\s*month")})::INT AS ui_months,
  ({S.num("lower(coalesce(t, ''))", r"(\d+)\s*[-]?\s*(?:year|yr)s?")} * 12)::INT AS name_months FROM x""")
def parse_term_months(spark, sf):
    x = table(spark, sf, "part").select(c("p_partkey").alias("id"), F.expr(_TERM).alias("t"))
    return x.select("id", P.term_months(c("t")).alias("months"), P.term_months(c("t"), strict=False).alias("months_compat"), P.ui_term_months(c("t")).alias("ui_months"), P.fixed_term_of_name(c("t")).alias("name_months"))


_FEE = "concat('Application fee: $', CAST(o_orderkey % 9 + 1 AS STRING), ',', lpad(CAST(o_custkey % 1000 AS STRING), 3, '0'), '.', lpad(CAST(o_orderkey % 100 AS STRING), 2, '0'), ' once')"


@query(rf"""SELECT o_orderkey AS id, TRY_CAST(replace(regexp_extract({_FEE}, '\$(\d+(?:,\d{{3}})*(?:\.\d{{2}})?)', 1), ',', '') AS DOUBLE) AS fee,
  TRY_CAST(replace(regexp_extract({_FEE}, '\$(\d+(?:,\d{{3}})*(?:\.\d{{2}})?)', 1), ',', '') AS DOUBLE) AS last_fee,
  CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE trunc(o_custkey % 700 + 0.5)::INT END AS application, 0 AS ongoing,
  coalesce({S.num("o_orderpriority", r"(\d+\.?\d*)")}, 95.0) AS lvr_max, {S.num("o_orderstatus", r"(\d+\.?\d*)")} AS dti_max FROM orders""")
def fee_parse(spark, sf):
    o = table(spark, sf, "orders").withColumn("t", F.expr(_FEE))
    fees = F.create_map(F.lit("application"), F.when(c("o_orderkey") % 3 == 0, "n/a").otherwise(F.concat((c("o_custkey") % 700).cast("string"), F.lit(".5"))))
    n = P.normal_fees(fees)
    return o.select(c("o_orderkey").alias("id"), P.first_fee(c("t")).alias("fee"), P.last_fee(F.array("t", F.lit("no fee"))).alias("last_fee"), n["application"].alias("application"), n["ongoing"].alias("ongoing"), P.first_number(c("o_orderpriority"), 95.0).alias("lvr_max"), P.first_number(c("o_orderstatus")).alias("dti_max"))


_CLASS = "concat(CASE p_partkey % 5 WHEN 0 THEN 'Fixed offset account ' WHEN 1 THEN 'Variable redraw ' WHEN 2 THEN 'SPLIT cash back ' WHEN 3 THEN 'Premium package ' ELSE '' END, p_name)"


@query(rf"""WITH x AS (SELECT p_partkey AS id, {_CLASS} AS t FROM part)
SELECT id, CASE WHEN contains(lower(t), 'fixed') THEN 'fixed' WHEN contains(lower(t), 'variable') THEN 'variable' WHEN contains(lower(t), 'split') THEN 'split' ELSE 'variable' END AS rate_type,
  array_to_string(list_filter([CASE WHEN contains(lower(t), 'offset') THEN 'offset' END, CASE WHEN contains(lower(t), 'redraw') THEN 'redraw' END, CASE WHEN {S.any_of("lower(t)", P.FEATURES["cashback"])} THEN 'cashback' END, CASE WHEN {S.any_of("lower(t)", P.FEATURES["package"])} THEN 'package' END], lambda v: v IS NOT NULL), ',') AS features,
  {S.any_of("lower(t)", P.HEADING_WORDS)} AND NOT {S.any_of("lower(t)", P.HEADING_NOT)} AND length(t) > 5 AND length(t) < 100 AS is_heading,
  length(trim(t)) >= 3 AND NOT {S.any_of("lower(t)", P.NAME_NOT)} AND {S.any_of("lower(t)", P.NAME_WORDS)} AS is_name FROM x""")
def feature_tags(spark, sf):
    x = table(spark, sf, "part").select(c("p_partkey").alias("id"), F.expr(_CLASS).alias("t"))
    return x.select("id", P.rate_type(c("t")).alias("rate_type"), F.array_join(P.feature_tags(c("t")), ",").alias("features"), P.is_heading(c("t")).alias("is_heading"), P.is_product_name(c("t")).alias("is_name"))


@query(f"WITH x AS ({D.sql(D.LABELS)}) SELECT id, " + ", ".join(f"{S.matches('text', k)} AS {k}" for k in L.LEXICON) + f", {S.option_type('text')} AS option_type FROM x")
def keyword_classify(spark, sf):
    x = D.derive(spark, sf, D.LABELS)
    return x.select("id", *[L.matches(c("text"), k).alias(k) for k in L.LEXICON], L.option_type(c("text")).alias("option_type"))


@query(f"SELECT doc_id, {S.matches('text', 'rate_type')} AS rate_type, {S.matches('text', 'loan_type')} AS loan_type, {S.matches('text', 'lvr_tier')} AS lvr_tier FROM documents")
def keyword_classify_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *[L.matches(c("text"), k).alias(k) for k in ("rate_type", "loan_type", "lvr_tier")])


def _filter_name_sql() -> str:
    own, opts = "lower(concat_ws(' ', '', coalesce(name, ''), coalesce(css, '')))", "lower(coalesce(options, ''))"
    both = f"concat_ws(' ', {own}, {opts})"
    cases = " ".join(
        f"WHEN {S.any_of(both, L.LEXICON[a].phrases) if g is None else '(' + S.any_of(both, g) + ' AND ' + S.any_of(opts, L.LEXICON[a].patterns) + ')'} THEN '{a}'" for a, g in L.GATES
    )
    return f"CASE {cases} ELSE coalesce(replace(replace(lower(NULLIF(name, '')), ' ', '_'), '-', '_'), 'filter_unknown') END"


_CONTROL = "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'sort-By' WHEN 1 THEN '' WHEN 2 THEN 'rate' ELSE NULL END AS name, p_brand AS css, p_type AS t1, CASE p_partkey % 6 WHEN 0 THEN 'Owner occupied' WHEN 1 THEN 'Interest only' WHEN 2 THEN 'Fixed' WHEN 3 THEN 'LTV 80' WHEN 4 THEN 'nsw state' ELSE 'zzz' END AS t2 FROM {part}"


@query(f"WITH y AS ({D.sql(_CONTROL)}), x AS (SELECT *, concat_ws(' ', t1, t2) AS options FROM y) SELECT id, {_filter_name_sql()} AS axis FROM x")
def filter_name(spark, sf):
    x = D.derive(spark, sf, _CONTROL)
    return x.select("id", L.filter_name(F.lit(""), c("name"), c("css"), F.concat_ws(" ", "t1", "t2")).alias("axis"))


def _entries():
    return F.array(*[F.struct(c(f"k{i}").alias("key"), c(f"v{i}").alias("value")) for i in (1, 2, 3)])


def _last_sql(f) -> str:
    """The last entry's value that isn't null."""
    return "coalesce(" + ", ".join(f(f"k{i}", f"v{i}") for i in (3, 2, 1)) + ")"


def _axes_sql() -> str:
    everything = "lower(concat_ws(' ', v1, v2, v3))"

    def purpose(k, v):
        t = f"lower({v})"
        return f"CASE WHEN {S.matches(v, 'loan_type')} OR {S.any_of(f'lower({k})', ('purpose', 'loan_type', 'property'))} THEN CASE WHEN contains({t}, 'invest') THEN 'Investment_Purchase' WHEN {S.any_of(t, ('owner', 'home', 'live', 'first-home'))} THEN 'OwnerOccupied_Purchase' WHEN contains({t}, 'construction') THEN 'OwnerOccupied_Construction' WHEN contains({t}, 'refinance') THEN CASE WHEN contains({everything}, 'investment') THEN 'Investment_Refinance' ELSE 'OwnerOccupied_Refinance' END END END"

    def repay(k, v):
        t = f"lower({v})"
        return f"CASE WHEN {S.matches(v, 'repayment_type')} OR contains({k}, 'repay') THEN CASE WHEN {S.any_of(t, ('interest only', 'interest-only', 'io', 'i/o'))} THEN 'InterestOnly' WHEN {S.any_of(t, ('principal', 'p&i', 'p and i', 'p+i'))} THEN 'PrincipalAndInterest' END END"

    def gate(k, v):
        return f"({S.matches(v, 'rate_type')} OR {S.any_of(k, ('rate_type', 'rate type'))} OR {S.any_of(f'lower({v})', ('fixed', 'variable'))})"

    def rate(k, v):
        return f"CASE WHEN {gate(k, v)} THEN CASE WHEN contains(lower({v}), 'fixed') THEN 'Fixed' WHEN {S.any_of(f'lower({v})', ('var', 'split'))} THEN 'Variable' END END"

    def months(t):
        y, m = S.num(t, r"(\d+)\s*year"), S.num(t, r"(\d+)\s*month")
        return f"coalesce({y} * 12, {m})"

    def term(k, v):
        t = f"lower({v})"
        return f"CASE WHEN {S.matches(v, 'loan_term')} OR contains({k}, 'term') OR {S.any_of(t, ('year', 'month'))} THEN {months(t)} END"

    def term2(k, v):
        return f"CASE WHEN {gate(k, v)} AND contains(lower({v}), 'fixed') THEN {S.num(f'lower({v})', r'(\d+)\s*(?:year|yr)')} * 12 END"

    def band(what):
        def of(k, v):
            t = f"lower({v})"
            d = rf"NULLIF(regexp_extract({v}, '(\d+)%', 1), '')"
            below = S.any_of(t, ("≤", "less", "up to"))
            above = f"(NOT {below} AND {S.any_of(t, ('>', 'more', 'greater'))})"
            pick = {"min": f"CASE WHEN {above} THEN {d}::DOUBLE / 100 ELSE 0.0 END", "max": f"CASE WHEN {above} THEN 1.0 ELSE {d}::DOUBLE / 100 END", "tier": f"concat(CASE WHEN {below} THEN '≤' WHEN {above} THEN '>' ELSE '' END, {d}, '%')"}[what]
            return f"CASE WHEN ({S.matches(v, 'lvr_tier')} OR {S.any_of(k, ('lvr', 'loan to value', 'ltv'))}) AND {d} IS NOT NULL THEN {pick} END"

        return of

    return f"""WITH s AS ({D.sql(D.STATES)}), a AS (SELECT id, {_last_sql(purpose)} AS purpose, {_last_sql(repay)} AS repayment_type, {_last_sql(rate)} AS rate_type,
 coalesce({_last_sql(term)}, {_last_sql(term2)}) AS m, {_last_sql(band("min"))}::DOUBLE AS lvr_min, {_last_sql(band("max"))}::DOUBLE AS lvr_max, {_last_sql(band("tier"))} AS lvr_tier FROM s)
SELECT id, purpose, repayment_type, rate_type, m::INT AS fixed_term_months, lvr_min, lvr_max, lvr_tier,
 CASE WHEN contains(purpose, 'Investment') THEN 'Investment' WHEN purpose IS NOT NULL THEN 'OwnerOccupied' END AS occupancy, coalesce(rate_type = 'Fixed', false) AND m IS NULL AS missing_fixed_term FROM a"""


@query(_axes_sql())
def axes_normalize(spark, sf):
    return D.derive(spark, sf, D.STATES).select("id", A.normalize(_entries()).alias("a")).select("id", "a.*")


def _eligibility_sql() -> str:
    def segment(k, v):
        t = f"lower({v})"
        return f"CASE WHEN {S.any_of(k, ('segment', 'tier'))} THEN coalesce(CASE WHEN {S.any_of(t, ('premium', 'prestige', 'platinum'))} THEN 'Premium' WHEN {S.any_of(t, ('standard', 'classic', 'plus'))} THEN 'Standard' WHEN {S.any_of(t, ('basic', 'essential', 'smart'))} THEN 'Basic' WHEN contains({t}, 'package') THEN 'Package' END, trim({v})) END"

    def where(k, v):
        t = f"lower({v})"
        parts = [f"CASE WHEN contains({t}, '{a.lower()}') THEN '{a}' END" for a, _ in A.REGIONS] + [f"CASE WHEN contains({t}, '{n}') AND NOT contains({t}, '{a.lower()}') THEN '{a}' END" for a, n in A.REGIONS]
        return f"CASE WHEN {S.any_of(k, ('region', 'state', 'residency', 'location'))} THEN NULLIF(concat_ws(',', {', '.join(parts)}), '') END"

    def who(k, v):
        t = f"lower({v})"
        return f"CASE WHEN {S.any_of(k, ('borrower', 'customer', 'category'))} THEN coalesce(CASE WHEN {S.any_of(t, ('business', 'commercial', 'company'))} THEN 'Business' WHEN {S.any_of(t, ('personal', 'individual', 'consumer'))} THEN 'Personal' WHEN {S.any_of(t, ('first home', 'fhb', 'first-home'))} THEN 'FirstHomeBuyer' WHEN {S.any_of(t, ('professional', 'doctor', 'medical'))} THEN 'Professional' END, trim({v})) END"

    return f"WITH s AS ({D.sql(D.STATES)}) SELECT id, {_last_sql(segment)} AS product_segment, {_last_sql(where)} AS region_restrictions, {_last_sql(who)} AS borrower_category FROM s"


@query(_eligibility_sql())
def eligibility_axes(spark, sf):
    e = D.derive(spark, sf, D.STATES).select("id", A.eligibility(_entries()).alias("e")).select("id", "e.*")
    return e.withColumn("region_restrictions", F.array_join("region_restrictions", ","))


@query(rf"""WITH r AS ({D.sql(D.RESPONSES)}), ok AS (SELECT call_id, TRY_CAST(body AS JSON) AS j FROM r WHERE status = 200 AND contains(content_type, 'application/json')),
p AS (SELECT call_id, unnest(from_json(coalesce(json_extract(j, '$.products'), json_extract(j, '$.data.items'), '[]'), '["JSON"]')) AS p FROM ok WHERE j IS NOT NULL AND json_extract(j, '$.loanProducts') IS NULL),
g AS (SELECT call_id, coalesce({_jx("p", "name", "productName", "title", "loanName")}) AS name, coalesce({_jx("p", "rate", "interestRate", "comparisonRate")}) AS raw FROM p)
SELECT call_id, concat('Test Lender ', name) AS name, coalesce(TRY_CAST(raw AS DOUBLE), {S.num("raw", r"(\d+\.?\d*)")}) AS rate FROM g WHERE name IS NOT NULL AND coalesce(TRY_CAST(raw AS DOUBLE), {S.num("raw", r"(\d+\.?\d*)")}) <> 0""")
def json_generic(spark, sf):
    log = extract.responses(D.derive(spark, sf, D.RESPONSES))
    rows = extract.generic_products(extract.find_products(log.where(F.try_parse_json("body").isNotNull() & F.get_json_object("body", "$.loanProducts").isNull())), "Test Lender")
    return rows.select("call_id", "name", "rate")


@query(rf"""WITH r AS ({D.sql(D.RESPONSES)}), ok AS (SELECT call_id, TRY_CAST(body AS JSON) AS j FROM r WHERE status = 200 AND contains(content_type, 'application/json')),
p AS (SELECT call_id, unnest(from_json(json_extract(j, '$.loanProducts'), '["JSON"]')) AS p FROM ok WHERE json_extract(j, '$.loanProducts') IS NOT NULL),
t AS (SELECT call_id, p, i, from_json(json_extract(p, '$.rateTiers'), '["JSON"]')[i] AS t FROM p, range(1, 10) AS n(i) WHERE i <= json_array_length(json_extract(p, '$.rateTiers'))),
u AS (SELECT call_id, p, t, i, unnest(from_json(json_extract(p, '$.eligibility.loanPurpose'), '["VARCHAR"]')) AS purpose FROM t),
v AS (SELECT *, unnest(from_json(json_extract(p, '$.eligibility.repaymentType'), '["VARCHAR"]')) AS repayment_type FROM u),
w AS (SELECT *, json_extract_string(t, '$.lvrMin')::DOUBLE AS lo, json_extract_string(t, '$.lvrMax')::DOUBLE AS hi, json_extract_string(t, '$.interestRate')::DOUBLE AS ir, json_extract_string(t, '$.comparisonRate')::DOUBLE AS cr FROM v)
SELECT call_id, (i - 1)::INT AS tier, json_extract_string(p, '$.productName') AS name, json_extract_string(p, '$.rateType') AS rate_type, purpose, repayment_type, ir AS interest_rate, coalesce(cr, ir) AS rate,
  CASE WHEN lo > 1 THEN lo / 100 ELSE lo END AS lvr_min, hi / 100 AS lvr_max FROM w""")
def json_structured(spark, sf):
    log = extract.responses(D.derive(spark, sf, D.RESPONSES))
    return extract.structured_products(log).drop("seq")


@query(rf"""WITH m AS ({D.sql(D.MARKUP)}), s AS (SELECT page_id, regexp_extract(html, '(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>', 1)::JSON AS j FROM m)
SELECT page_id, j->>'$."@type"' AS kind, j->>'$.name' AS name, {S.num("j->>'$.offers.price'", r"(\d+\.?\d*)")} AS rate FROM s WHERE j->>'$."@type"' IN ('Product', 'FinancialProduct', 'LoanOrCredit', 'Offer') AND {S.num("j->>'$.offers.price'", r"(\d+\.?\d*)")} > 0""")
def jsonld_extract(spark, sf):
    return extract.jsonld(D.derive(spark, sf, D.MARKUP)).select("page_id", "kind", "name", "rate")


@query(r"""WITH m AS (""" + D.sql(D.MARKUP) + r"""), s AS (SELECT page_id, unnest(from_json((regexp_extract(html, '(?s)dataLayer\s*=\s*(\[.*?\]);', 1)::JSON)->'$[0].ecommerce.items', '["JSON"]')) AS i FROM m)
SELECT page_id, coalesce(i->>'$.name', i->>'$.item_name') AS name, CASE WHEN json_type(i->'$.price') IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN (i->>'$.price')::DOUBLE ELSE 0.0 END AS rate FROM s""")
def datalayer_extract(spark, sf):
    return extract.embedded_state(D.derive(spark, sf, D.MARKUP)).select("page_id", "name", "rate")


@query(rf"""WITH m AS ({D.sql(D.MARKUP)}), s AS (SELECT page_id, regexp_extract(html, '<h2>([^<]*)</h2>', 1) AS name, {S.num("html", r'data-cell="rate">([\d.]+)')} AS rate, {S.num("html", r'data-cell="comparison">([\d.]+)')} AS cmp FROM m)
SELECT page_id AS card_id, name, rate, coalesce(cmp, rate) AS comparison_rate, CASE WHEN contains(lower(name), 'fix') THEN 'Fixed' ELSE 'Variable' END AS rate_type FROM s WHERE rate > 0""")
def compare_cards(spark, sf):
    m = D.derive(spark, sf, D.MARKUP)
    cards = m.select(c("page_id").alias("card_id"), F.lit("card-x").alias("element_id"), P.group(c("html"), "<h2>([^<]*)</h2>").alias("heading"), F.lit(None).cast("string").alias("head"), extract.card_cells(c("html")).alias("cells"))
    return extract.compare_cards(cards)


@query(rf"""WITH m AS ({D.sql(D.MARKUP)}),
j AS (SELECT page_id, 'jsonld' AS strategy, regexp_extract(html, '(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>', 1)::JSON AS x FROM m),
d AS (SELECT page_id, 'embedded_state' AS strategy, unnest(from_json((regexp_extract(html, '(?s)dataLayer\s*=\s*(\[.*?\]);', 1)::JSON)->'$[0].ecommerce.items', '["JSON"]')) AS i FROM m),
c AS (SELECT page_id, 'compare_cards' AS strategy, regexp_extract(html, '<h2>([^<]*)</h2>', 1) AS name, {S.num("html", r'data-cell="rate">([\d.]+)')} AS rate FROM m),
u AS (SELECT page_id, strategy, x->>'$.name' AS name, {S.num("x->>'$.offers.price'", r"(\d+\.?\d*)")} AS rate FROM j WHERE x->>'$."@type"' IN ('Product', 'FinancialProduct') AND {S.num("x->>'$.offers.price'", r"(\d+\.?\d*)")} > 0
  UNION ALL SELECT page_id, strategy, coalesce(i->>'$.name', i->>'$.item_name'), CASE WHEN json_type(i->'$.price') IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN (i->>'$.price')::DOUBLE ELSE 0.0 END FROM d UNION ALL SELECT * FROM c WHERE rate > 0)
SELECT *, CASE strategy WHEN 'jsonld' THEN 90 WHEN 'embedded_state' THEN 80 ELSE 70 END AS strategy_priority FROM u""")
def all_strategies(spark, sf):
    """Every strategy's products of a page, side by side with their priority."""
    m = D.derive(spark, sf, D.MARKUP)
    cards = m.select(c("page_id").alias("card_id"), F.lit(None).cast("string").alias("element_id"), P.group(c("html"), "<h2>([^<]*)</h2>").alias("heading"), F.lit(None).cast("string").alias("head"), extract.card_cells(c("html")).alias("cells"))
    pick = lambda df, page="page_id": df.select(c(page).alias("page_id"), "name", "rate")
    return extract.unite({"jsonld": pick(extract.jsonld(m)), "embedded_state": pick(extract.datalayer(m)), "compare_cards": pick(extract.compare_cards(cards), "card_id")})


@query(rf"""WITH r AS ({D.sql(D.RESPONSES)}), ok AS (SELECT call_id, TRY_CAST(body AS JSON) AS j FROM r WHERE status = 200 AND contains(content_type, 'application/json')),
t AS (SELECT call_id, json_extract_string(p, '$.productName') AS name FROM (SELECT call_id, unnest(from_json(json_extract(j, '$.loanProducts'), '["JSON"]')) AS p FROM ok WHERE json_extract(j, '$.loanProducts') IS NOT NULL)),
g AS (SELECT call_id, unnest(from_json(coalesce(json_extract(j, '$.products'), json_extract(j, '$.data.items'), '[]'), '["JSON"]')) AS p FROM ok WHERE j IS NOT NULL),
n AS (SELECT call_id, coalesce({_jx("p", "name", "productName", "title", "loanName")}) AS name, coalesce({_jx("p", "rate", "interestRate", "comparisonRate")}) AS raw FROM g)
SELECT call_id, name, 'structured' AS kind FROM t UNION ALL SELECT call_id, concat('Bank ', name), 'generic' FROM n WHERE name IS NOT NULL AND coalesce(TRY_CAST(raw AS DOUBLE), {S.num("raw", r"(\d+\.?\d*)")}) <> 0 AND call_id NOT IN (SELECT call_id FROM t)""")
def skip_generic_calls(spark, sf):
    """Generic products only of calls that gave no structured ones."""
    log = extract.responses(D.derive(spark, sf, D.RESPONSES))
    structured = extract.structured_products(log.where(F.get_json_object("body", "$.loanProducts").isNotNull())).select("call_id", "name", F.lit("structured").alias("kind")).distinct()
    generic = extract.generic_products(extract.find_products(log), "Bank").select("call_id", "name", F.lit("generic").alias("kind"))
    return resolve.skip_generic(structured, generic)


@query(f"""WITH e AS (SELECT s_suppkey AS card_id, concat('fixed-rate_', lower(replace(s_name, '#', '-'))) AS element_id FROM supplier)
SELECT card_id, (SELECT string_agg(concat(upper(left(w, 1)), lower(substr(w, 2))), ' ' ORDER BY i) FROM (SELECT unnest(string_split(regexp_replace(element_id, '[-_]', ' ', 'g'), ' ')) AS w, generate_subscripts(string_split(regexp_replace(element_id, '[-_]', ' ', 'g'), ' '), 1) AS i)) AS name, 5.5::DOUBLE AS rate FROM e""")
def card_titles(spark, sf):
    """Cards without a heading are named by their element's id."""
    s = table(spark, sf, "supplier")
    cells = F.array(F.struct(F.lit("rate").alias("name"), F.lit("5.5% p.a").alias("text")))
    cards = s.select(c("s_suppkey").alias("card_id"), F.concat(F.lit("fixed-rate_"), F.lower(F.replace("s_name", F.lit("#"), F.lit("-")))).alias("element_id"), F.lit("").alias("heading"), F.lit(None).cast("string").alias("head"), cells.alias("cells"))
    return extract.compare_cards(cards).select("card_id", "name", "rate")


@query(rf"""WITH h AS ({D.sql(D.HEADED)}), x AS (SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading, regexp_replace(html, '<[^>]*>', ' ', 'g') AS body FROM h)
SELECT page_id, heading, {S.num("body", r"(\d+\.?\d*)\s*%")} AS rate, coalesce({S.num("body", r"(?s)[Cc]omparison\s+rate.*?([\d.]+)\s*%")}, {S.num("body", r"(\d+\.?\d*)\s*%")}) AS comparison_rate, CASE WHEN regexp_matches(lower(body), '\bfixed\b') THEN 'Fixed' ELSE 'Variable' END AS rate_type, coalesce({S.num("body", r"(\d+)%.*?LVR", 1, "(?i)")} / 100, 0.8)::DOUBLE AS lvr_max
FROM x WHERE {S.any_of("lower(heading)", P.HEADING_WORDS)} AND NOT {S.any_of("lower(heading)", P.HEADING_NOT)} AND length(heading) > 5 AND length(heading) < 100""")
def html_headings(spark, sf):
    return extract.headings(D.derive(spark, sf, D.HEADED))


_STRUCTURE = {"has_compare_cards": '(?i)class="[^"]*compare-card', "has_data_cells": r"(?i)data-cell\s*=", "has_rate_selects": r"(?is)<option[^>]*>[^<]*%\s*p\.a", "has_jsonld": r"(?i)<script[^>]*application/ld\+json", "has_embedded_state": "dataLayer|__NEXT_DATA__|__NUXT__", "has_rate_tables": r"(?is)<t[dh][^>]*>[^<]*[\d.]+%\s*p\.a"}


@query(f"WITH x AS (SELECT page_id, html FROM pages UNION ALL ({D.sql(D.MARKUP)})), y AS (SELECT page_id, " + ", ".join(f"regexp_matches(html, {S.quote(p)}) AS {k}" for k, p in _STRUCTURE.items()) + " FROM x) SELECT *, CASE WHEN has_jsonld THEN 'jsonld' WHEN has_embedded_state THEN 'embedded_state' WHEN has_rate_selects THEN 'select_dropdowns' WHEN has_compare_cards THEN 'compare_cards' WHEN has_rate_tables THEN 'html_table' ELSE 'dom_parsing' END AS recommended FROM y")
def page_structure(spark, sf):
    x = table(spark, sf, "pages").select("page_id", "html").unionByName(D.derive(spark, sf, D.MARKUP))
    y = x.select("page_id", *[v.alias(k) for k, v in extract.structure(c("html")).items()])
    return y.withColumn("recommended", extract.strategies({k: c(k) for k in _STRUCTURE})[1])


@query(f"WITH x AS (SELECT page_id, html FROM pages UNION ALL ({D.sql(D.MARKUP)})) SELECT count(*) AS pages, " + ", ".join(f"count(*) FILTER (regexp_matches(html, {S.quote(p)})) AS {k}" for k, p in _STRUCTURE.items()) + " FROM x")
def page_census(spark, sf):
    return extract.census(table(spark, sf, "pages").select("page_id", "html").unionByName(D.derive(spark, sf, D.MARKUP)))


@query(rf"""WITH t AS ({D.sql(D.TIERS)}), b AS (SELECT *, CASE WHEN contains(lower(label), 'index') THEN 'index' WHEN starts_with(label, '≤') THEN 'le' WHEN starts_with(label, '>') THEN 'gt' END AS kind, {S.num("label", r"(\d+(?:\.\d+)?)\s*%")} / 100 AS bound FROM t),
d AS (SELECT *, CASE WHEN kind IN ('gt', 'index') THEN 1.0::DOUBLE ELSE bound END AS lvr_max FROM b WHERE kind IS NOT NULL),
e AS (SELECT *, coalesce(max(lvr_max) OVER (PARTITION BY table_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before, count(*) OVER (PARTITION BY table_id) AS n FROM d)
SELECT table_id, row_idx, CASE kind WHEN 'gt' THEN bound WHEN 'index' THEN 0.0 ELSE before END::DOUBLE AS lvr_min, lvr_max, kind = 'gt' AS lvr_exclusive_max, rate, CASE WHEN kind = 'index' THEN 'VariableIndex' ELSE 'Variable' END AS rate_type FROM e WHERE n > 1""")
def lvr_table_bounds(spark, sf):
    return extract.lvr_table(D.derive(spark, sf, D.TIERS))


#: the second table of each page, by hand
_TIER_ROWS = """r(row_idx, label, kind, bound, cents, months) AS (VALUES (0, '≤ 60%', 'le', 0.6, 65, NULL), (1, NULL, 'le', NULL, 80, 24), (2, '> 90%', 'gt', 0.9, 89, NULL), (3, 'Index', 'index', NULL, 24, NULL)),
x AS (SELECT s_suppkey AS page_id, row_idx, kind, months, s_nationkey % 9 + cents / 100.0 AS rate, CASE WHEN row_idx = 1 THEN (70 + 10 * (s_nationkey % 2)) / 100.0 ELSE bound END AS bound, coalesce(label, concat('≤', 70 + 10 * (s_nationkey % 2), '%')) AS label FROM supplier, r WHERE s_suppkey % 7 <> 0 AND (row_idx <> 2 OR s_suppkey % 3 <> 0)),
y AS (SELECT page_id, row_idx, label, months::INT AS fixed_term_months, CASE kind WHEN 'le' THEN CASE row_idx WHEN 0 THEN 0.0 ELSE 0.6 END WHEN 'gt' THEN 0.9 ELSE 0.0 END::DOUBLE AS lvr_min, CASE kind WHEN 'le' THEN bound ELSE 1.0 END::DOUBLE AS lvr_max, kind = 'gt' AS lvr_exclusive_max, rate::DOUBLE AS rate, CASE kind WHEN 'index' THEN 'VariableIndex' ELSE 'Variable' END AS rate_type FROM x)"""


@query(f"WITH {_TIER_ROWS} SELECT page_id, 1 AS table_idx, row_idx, fixed_term_months, lvr_min, lvr_max, lvr_exclusive_max, rate, rate_type FROM y")
def lvr_table_html(spark, sf):
    rows = extract.tier_rows(D.derive(spark, sf, D.TIERED)).withColumn("table_id", F.struct("page_id", "table_idx"))
    return extract.lvr_table(rows, ("fixed_term_months",)).select("table_id.page_id", "table_id.table_idx", "row_idx", "fixed_term_months", "lvr_min", "lvr_max", "lvr_exclusive_max", "rate", "rate_type")


@query(f"""WITH {_TIER_ROWS}, o(cents, lo, hi) AS (VALUES (49, 0.0, 0.8), (69, 0.8, 1.0))
SELECT page_id, 'table' AS source, 'Test Variable Rate' AS base_name, concat('Test Variable Rate - ', CASE rate_type WHEN 'VariableIndex' THEN 'Index rate' ELSE label END) AS name, rate, rate_type, lvr_min, lvr_max, fixed_term_months FROM y
UNION ALL SELECT s_suppkey, 'select', 'Standard Variable', 'Standard Variable', (2 + s_nationkey % 7 + cents / 100.0)::DOUBLE, 'Variable', lo::DOUBLE, hi::DOUBLE, NULL FROM supplier, o""")
def dropdown_products(spark, sf):
    return extract.dropdown_products(D.derive(spark, sf, D.TIERED), "Test")


@query(f"""WITH p AS ({D.sql(D.SERPS)}), h AS (SELECT page_id, engine, unnest(regexp_extract_all(html, '(?i)href="([^"]+)"', 1)) AS u FROM p),
w AS (SELECT *, url_decode(NULLIF(regexp_extract(u, '/url[?]q=(https?://[^&]+)', 1), '')) AS g, url_decode(NULLIF(regexp_extract(u, '/u=(https?://[^&]+)', 1), '')) AS y FROM h),
l AS (SELECT page_id, engine, CASE engine
  WHEN 'google' THEN CASE WHEN contains(u, '/url?q=') THEN CASE WHEN NOT regexp_matches(g, 'google[.]com|youtube[.]com|facebook[.]com|maps[.]google') THEN g END WHEN starts_with(u, 'http') AND NOT contains(u, 'google.com') THEN u END
  WHEN 'bing' THEN CASE WHEN starts_with(u, 'http') AND NOT regexp_matches(u, 'bing[.]com|microsoft[.]com') THEN u END
  WHEN 'yahoo' THEN CASE WHEN contains(u, '/u=') THEN CASE WHEN NOT regexp_matches(y, 'yahoo[.]com|google[.]com|youtube[.]com|facebook[.]com') THEN y END WHEN starts_with(u, 'http') AND NOT contains(u, 'yahoo.com') THEN u END
  ELSE CASE WHEN regexp_matches(u, '^https?://') AND NOT {S.any_of('lower(u)', P.OTHER_DOMAINS)} THEN u END END AS url FROM w)
SELECT DISTINCT page_id, engine, url FROM l WHERE url IS NOT NULL""")
def serp_links(spark, sf):
    return extract.serp_links(D.derive(spark, sf, D.SERPS)).select("page_id", "engine", "url")


_SKIP = " AND ".join(f"NOT regexp_matches(url, {S.quote('(?i)' + p)})" for p in P.SKIP_URL)


@query(f"SELECT page_id, regexp_matches(coalesce(url, ''), '^https?://') AND NOT {S.any_of('lower(url)', P.OTHER_DOMAINS)} AS content, contains(url, 'example.com') AND {_SKIP} AS lender FROM pages")
def url_filter(spark, sf):
    return table(spark, sf, "pages").select("page_id", P.is_content_url(c("url")).alias("content"), P.is_lender_url(c("url"), F.lit("example.com")).alias("lender"))


_RESULTS = "SELECT CASE WHEN contains(url, 'example.org') THEN 'example.org' WHEN contains(url, 'example.com') THEN 'example.com' ELSE 'example.net' END AS domain, CASE page_id % 6 WHEN 0 THEN 'interest_rates' WHEN 1 THEN 'rates_alt' WHEN 2 THEN 'products' WHEN 3 THEN 'products_alt' WHEN 4 THEN 'comparison' ELSE 'fees' END AS category, page_id AS position, regexp_replace(url, '[?#].*$', '') AS url FROM {pages}"
_TOP = f"""r AS ({D.sql(_RESULTS)}), ok AS (SELECT domain, CASE category WHEN 'rates_alt' THEN 'interest_rates' WHEN 'products_alt' THEN 'products' ELSE category END AS category, position, url FROM r WHERE contains(url, domain) AND {_SKIP}),
f AS (SELECT domain, category, url, min(position) AS position FROM ok GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY domain, category ORDER BY position, url) AS k FROM f)"""


@query(f"WITH {_TOP} SELECT domain, category, url, position FROM n WHERE k <= 3")
def url_topk(spark, sf):
    return discovery.lender_urls(D.derive(spark, sf, _RESULTS))


@query(f"""WITH {_TOP}, t AS (SELECT domain, url, min((list_position(['interest_rates', 'products', 'comparison'], category), position)) AS o FROM n WHERE k <= 3 AND category IN ('interest_rates', 'products', 'comparison') GROUP BY ALL)
SELECT domain, url FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY o, url) AS k FROM t) WHERE k <= 3""")
def url_final(spark, sf):
    return discovery.final_urls(discovery.lender_urls(D.derive(spark, sf, _RESULTS)))


@query(f"WITH r AS ({D.sql(_RESULTS)}) SELECT domain, url, min(position) AS position FROM r GROUP BY ALL")
def url_dedupe(spark, sf):
    return discovery.ordered_distinct(D.derive(spark, sf, _RESULTS), ["domain"])


@query("WITH t(i, c, q) AS (VALUES " + ", ".join(f"({i}, '{k}', '{q}')" for i, (k, q) in enumerate(discovery.TEMPLATES)) + "), d AS (SELECT n_nationkey, concat(lower(replace(n_name, ' ', '')), '.com') AS domain FROM nation) SELECT n_nationkey, domain, i AS template_idx, c AS category, replace(q, '{domain}', domain) AS query, concat('https://www.google.com/search?q=', replace(replace(replace(q, '{domain}', domain), ':', '%3A'), ' ', '+'), '&num=20&hl=en&gl=au') AS url FROM d, t")
def search_query_build(spark, sf):
    d = table(spark, sf, "nation").select("n_nationkey", F.concat(F.lower(F.replace(c("n_name"), F.lit(" "), F.lit(""))), F.lit(".com")).alias("domain"))
    return discovery.search_queries(d).withColumn("url", discovery.search_url(c("query"), "google"))


@query("""WITH d AS (SELECT n_nationkey, concat('home loan & rates ', lower(n_name), ' 5%') AS q FROM nation), e AS (SELECT n_nationkey, replace(replace(replace(q, '%', '%25'), '&', '%26'), ' ', '+') AS q FROM d)
SELECT n_nationkey, 'bing' AS engine, concat('https://www.bing.com/search?q=', q, '&count=20&setmkt=en-AU') AS url FROM e UNION ALL SELECT n_nationkey, 'yahoo', concat('https://au.search.yahoo.com/search?p=', q, '&n=20') FROM e UNION ALL SELECT n_nationkey, 'google', concat('https://www.google.com/search?q=', q, '&num=20&hl=en&gl=au') FROM e""")
def search_urls(spark, sf):
    d = table(spark, sf, "nation").select("n_nationkey", F.concat(F.lit("home loan & rates "), F.lower("n_name"), F.lit(" 5%")).alias("q"))
    e = F.explode(F.array(*[F.struct(F.lit(n).alias("engine"), discovery.search_url(c("q"), n).alias("url")) for n in ("bing", "yahoo", "google")])).alias("e")
    return d.select("n_nationkey", e).select("n_nationkey", "e.engine", "e.url")


_SERP = "SELECT doc_id, concat(text, CASE doc_id % 9 WHEN 0 THEN ' Unusual traffic' WHEN 1 THEN ' 0 results' WHEN 2 THEN ' connection failed' WHEN 3 THEN ' timed out' WHEN 4 THEN ' too many' WHEN 5 THEN ' search' ELSE '' END) AS t FROM {documents}"


@query(f"""WITH x AS ({D.sql(_SERP)}) SELECT doc_id, CASE WHEN {S.any_of("lower(t)", P.BLOCK_WORDS)} THEN 'BLOCKED' WHEN {S.any_of("lower(t)", P.NO_RESULT_WORDS)} THEN 'NO_RESULTS' WHEN contains(lower(t), 'connection') AND (contains(lower(t), 'error') OR contains(lower(t), 'failed')) THEN 'CONNECTION_ERROR'
 WHEN contains(lower(t), 'timeout') OR contains(lower(t), 'timed out') THEN 'TIMEOUT' WHEN contains(lower(t), 'rate limit') OR contains(lower(t), 'too many') THEN 'RATE_LIMITED' WHEN contains(lower(t), 'search') AND length(t) < 1000 THEN 'INCOMPLETE_PAGE' ELSE 'UNKNOWN' END AS reason FROM x""")
def serp_diagnose(spark, sf):
    return D.derive(spark, sf, _SERP).select("doc_id", P.diagnose(c("t")).alias("reason"))


def _widget_sql() -> str:
    t = "lower(t)"
    cases = [(k, f"axes > 0 AND axes <= {a} AND {S.hits(t, w)} >= {h}", d) for k, (w, h, a, d) in L.WIDGETS.items()]
    kind = " ".join(f"WHEN {x} THEN '{k}'" for k, x, _ in cases)
    depth = " ".join(f"WHEN {x} THEN {d}" for _, x, d in cases)
    calc = S.hits(t, L.WIDGETS["calculator"][0])
    return f"WITH x AS ({D.sql(_WIDGET)}) SELECT id, CASE {kind} END AS kind, CASE {depth} ELSE 5 END AS depth, {calc} >= 2 OR ({calc} >= 1 AND axes <= 2) AS is_calculator FROM x"


_WIDGET = "SELECT p_partkey AS id, CAST(p_size % 9 AS INT) AS axes, concat(p_name, CASE p_partkey % 5 WHEN 0 THEN ' Calculate your rate: estimated rate, enter your income. Borrowing power calculator' WHEN 1 THEN ' Check eligibility. Am I eligible?' WHEN 2 THEN ' compare loans side by side' WHEN 3 THEN ' try it out: simulator' ELSE ' your rate' END) AS t FROM {part}"


@query(_widget_sql())
def widget_detect(spark, sf):
    x = D.derive(spark, sf, _WIDGET)
    return x.select("id", quality.widget(c("t"), c("axes")).alias("w"), quality.is_calculator(c("t"), c("axes")).alias("is_calculator")).select("id", "w.kind", "w.depth", "is_calculator")


_RAW = "SELECT p_partkey AS key_id, CASE WHEN p_partkey % 7 > 0 THEN p_brand END AS lender, CASE WHEN p_partkey % 5 > 0 THEN concat('  ', p_name, '   Loan ') END AS name, CASE WHEN p_partkey % 10 = 0 THEN p_type END AS product_name, CASE WHEN p_partkey % 4 > 0 THEN concat(CAST(p_size AS STRING), '.49 % p.a') END AS rate_line, CASE WHEN p_partkey % 3 = 0 THEN '6.8%' END AS comparison_rate, CASE p_partkey % 4 WHEN 0 THEN '30 years' WHEN 1 THEN '24 months' WHEN 2 THEN '2 yr' END AS term, CASE p_partkey % 6 WHEN 0 THEN 'FIXED' WHEN 1 THEN '' WHEN 2 THEN 'split' END AS rate_type, CASE WHEN p_partkey % 2 = 0 THEN 'redraw and offset' END AS description, CASE WHEN p_partkey % 9 = 0 THEN '600.9' ELSE 'bad' END AS fee, CASE WHEN p_partkey % 3 > 0 THEN '90.5%' END AS lvr_max, CASE WHEN p_partkey % 4 = 1 THEN '6.0' END AS dti_max, CASE p_partkey % 3 WHEN 0 THEN '[\"a\",\"b\"]' WHEN 1 THEN '\"x\"' ELSE '3' END AS postcode_flags FROM {part}"


@query(rf"""WITH r AS ({D.sql(_RAW)}), x AS (SELECT *, coalesce(name, product_name) AS n, lower(concat_ws(' ', coalesce(name, product_name), description, 'cash back')) AS w FROM r), y AS (SELECT *, coalesce({S.first_rate("rate_line")}, 6.5) AS rate, lower(coalesce(NULLIF(rate_type, ''), n, '')) AS k FROM x)
SELECT key_id, coalesce(lender, 'Unknown') AS lender, coalesce(NULLIF(trim(regexp_replace(n, '\s+', ' ', 'g')), ''), 'Unknown Product') AS name, rate, coalesce({S.first_rate("comparison_rate")}, round(rate + 0.3, 4)) AS comparison_rate,
  CASE key_id % 4 WHEN 0 THEN 360 WHEN 1 THEN 24 WHEN 2 THEN 24 ELSE 360 END AS term_months, CASE WHEN contains(k, 'fixed') THEN 'fixed' WHEN contains(k, 'variable') THEN 'variable' WHEN contains(k, 'split') THEN 'split' ELSE 'variable' END AS rate_type,
  concat_ws(',', CASE WHEN contains(w, 'offset') THEN 'offset' END, CASE WHEN contains(w, 'redraw') THEN 'redraw' END, CASE WHEN {S.any_of("w", P.FEATURES["cashback"])} THEN 'cashback' END, CASE WHEN {S.any_of("w", P.FEATURES["package"])} THEN 'package' END) AS features,
  CASE WHEN fee = '600.9' THEN 600 ELSE 0 END AS application, coalesce({S.num("lvr_max", r"(\d+\.?\d*)")}, 95.0) AS lvr_max, {S.num("dti_max", r"(\d+\.?\d*)")} AS dti_max, CASE key_id % 3 WHEN 0 THEN 'a,b' WHEN 1 THEN 'x' ELSE '' END AS postcode_flags FROM y""")
def normalize_raw(spark, sf):
    r = D.derive(spark, sf, _RAW).withColumn("features", F.array(F.lit("cash back"))).withColumn("fees", F.create_map(F.lit("application"), c("fee"))).withColumn("source_url", F.lit("u"))
    n = normalize.normalize(r)
    return n.select("key_id", "lender", "name", "rate", "comparison_rate", "term_months", "rate_type", F.array_join("features", ",").alias("features"), n["fees"]["application"].alias("application"), "lvr_max", "dti_max", F.array_join("postcode_flags", ",").alias("postcode_flags"))


_BOX = "SELECT c_custkey AS container_id, CASE c_custkey % 3 WHEN 0 THEN concat(c_name, ' Fixed Home Loan') WHEN 1 THEN 'Learn more' ELSE concat(c_name, ' rate') END AS heading, concat(CAST(c_nationkey AS STRING), '.25% p.a') AS t1, concat('Fee $1,', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0')) AS t2, CASE WHEN c_custkey % 2 = 0 THEN 'up to 80% LVR' ELSE ' x ' END AS t3 FROM {customer}"


@query(rf"""WITH b AS ({D.sql(_BOX)}), x AS (SELECT *, concat_ws(' ', t1, t2, t3) AS t, lower(heading) AS h FROM b)
SELECT container_id, heading AS name, {S.num("t", r"(\d+\.?\d*)\s*%")} AS rate, 1000.0::DOUBLE + container_id % 1000 AS fee, CASE WHEN container_id % 2 = 0 THEN 3 ELSE 2 END AS n_features, CASE WHEN container_id % 2 = 0 THEN 80.0 ELSE 95.0 END::DOUBLE AS lvr_max, CASE WHEN contains(h, 'fix') THEN 'Fixed' ELSE 'Variable' END AS rate_type
FROM x WHERE NOT {S.any_of("h", P.NAME_NOT)} AND {S.any_of("h", P.NAME_WORDS)} AND {S.num("t", r"(\d+\.?\d*)\s*%")} > 0""")
def container_products(spark, sf):
    b = D.derive(spark, sf, _BOX).select("container_id", "heading", F.array("t1", "t2", "t3").alias("texts"))
    return normalize.containers(b).select("container_id", "name", "rate", "fee", F.size("features").alias("n_features"), "lvr_max", "rate_type")
