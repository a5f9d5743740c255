"""Queries over rows: product search, monitoring, resolution, pricing, quality, documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing as P
from ..operators import matching, monitor, nest, pricing, quality, resolve
from ..operators import query as search
from ..sources.readers import table
from . import derive as D
from . import sqlparts as S
from .registry import query

c = F.col
AS_OF = "2024-01-31 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")

_C, _P, _E = (f"({D.sql(q)})" for q in (D.COMPONENTS, D.PRODUCTS, D.EVENTS))


def components(spark, sf):
    return D.derive(spark, sf, D.COMPONENTS)


def products(spark, sf):
    return D.derive(spark, sf, D.PRODUCTS)


def events(spark, sf):
    return D.derive(spark, sf, D.EVENTS)


# product search


@query(f"SELECT product_id, lender, rate_type, rate FROM {_P} WHERE lower(lender) = 'lender 3' AND lower(rate_type) = 'variable' AND rate >= 2 AND rate <= 7.5 ORDER BY product_id LIMIT 100")
def product_filter(spark, sf):
    return search.products(products(spark, sf), "LENDER 3", "variable", 2, 7.5).select("product_id", "lender", "rate_type", "rate")


@query(f"SELECT product_id, lender, name FROM {_P} WHERE lower(lender) = 'lender 5' ORDER BY product_id LIMIT 50")
def product_by_lender(spark, sf):
    return search.by_lender(products(spark, sf), "Lender 5").select("product_id", "lender", "name")


@query(f"WITH p AS {_P}, m AS (SELECT TIMESTAMP '1998-06-30' AS t) SELECT product_id, lender, collected_at FROM p, m WHERE collected_at >= t - INTERVAL 90 DAY")
def recent_changes(spark, sf):
    return search.changes(products(spark, sf), F.lit("1998-06-30").cast("timestamp"), 90).select("product_id", "lender", "collected_at")


@query(f"WITH p AS {_P} SELECT 'lender' AS kind, lender AS value, count(*) AS n FROM p GROUP BY lender UNION ALL SELECT 'rate_type', rate_type, count(*) FROM p GROUP BY rate_type UNION ALL SELECT 'all', '', count(*) FROM p")
def storage_stats(spark, sf):
    return search.stats(products(spark, sf))


_L = "SELECT CAST(s_suppkey AS INT) AS config_idx, s_name AS lender_name, concat('L', CAST(s_suppkey % 7 AS STRING)) AS abbreviation, s_acctbal > 0 AS enabled, CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_nationkey AS INT) END AS priority FROM {supplier}"


@query(f"SELECT config_idx, lender_name, coalesce(priority, 999) AS rank FROM ({D.sql(_L)}) WHERE enabled")
def lender_select(spark, sf):
    return search.priority_order(D.derive(spark, sf, _L)).select("config_idx", "lender_name", "rank")


@query(f"WITH l AS ({D.sql(_L)}), k AS (SELECT lower(lender_name) AS k, config_idx, lender_name FROM l UNION SELECT lower(abbreviation), config_idx, lender_name FROM l), f AS (SELECT k, arg_min(lender_name, config_idx) AS lender_name FROM k GROUP BY k), w AS (SELECT concat('l', (r_regionkey * 2)::VARCHAR) AS q FROM region) SELECT q, lender_name FROM w LEFT JOIN f ON lower(q) = k")
def lender_lookup(spark, sf):
    wanted = table(spark, sf, "region").select(F.concat(F.lit("l"), (c("r_regionkey") * 2).cast("string")).alias("q"))
    return search.find_lender(D.derive(spark, sf, _L), wanted)


# monitoring

_LATEST = f"e AS {_E}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lender, collection_type ORDER BY ts DESC, event_id DESC) AS k FROM e) WHERE k = 1)"
_W = f"ts >= TIMESTAMP '{AS_OF}' - INTERVAL 72 HOUR"
_STATS = f"s AS (SELECT count(*) AS total, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed, coalesce(sum(products) FILTER (success), 0)::BIGINT AS products, CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER (success) / count(*) END::DOUBLE AS success_rate FROM l WHERE {_W})"
_AGE = f"(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 3.6e9"


@query(f"WITH {_LATEST}, {_STATS} SELECT * FROM s")
def collection_stats(spark, sf):
    return monitor.stats(events(spark, sf), as_of(), 72)


@query(f"WITH {_LATEST} SELECT lender, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed, coalesce(sum(products) FILTER (success), 0)::BIGINT AS products FROM l WHERE {_W} GROUP BY lender")
def lender_stats(spark, sf):
    return monitor.lender_stats(events(spark, sf), as_of(), 72)


@query(f"WITH {_LATEST} SELECT lender, collection_type, ts, round({_AGE}, 6) AS hours_old FROM l WHERE success AND {_AGE} > 1")
def freshness(spark, sf):
    """Over an hour old: over a day, the table holds none."""
    return monitor.stale(events(spark, sf), as_of(), 1)


@query(f"WITH {_LATEST}, {_STATS}, f AS (SELECT count(*) AS n_stale FROM l WHERE success AND {_AGE} > 24) SELECT total, successful, failed, success_rate, n_stale, CASE WHEN failed > successful THEN 'critical' WHEN n_stale > 0 THEN 'unhealthy' WHEN success_rate < 0.8 THEN 'degraded' ELSE 'healthy' END AS status FROM s, f")
def health(spark, sf):
    return monitor.health(events(spark, sf), as_of(), 72)


@query(f"SELECT event_id, ts, lender, concat('Collection failed for ', lender) AS message FROM {_E} WHERE NOT success AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY ORDER BY ts DESC, event_id DESC LIMIT 100")
def alerts_last_n(spark, sf):
    return monitor.alerts(events(spark, sf), as_of(), 100, 30)


@query(f"SELECT event_id, lender FROM (SELECT *, row_number() OVER (PARTITION BY lender ORDER BY ts DESC, event_id DESC) AS k FROM {_E} WHERE NOT success) WHERE k <= 5")
def alerts_per_lender(spark, sf):
    return monitor.last_per_lender(events(spark, sf)).select("event_id", "lender")


@query(f"SELECT lender, event_id, ts, products FROM (SELECT *, row_number() OVER (PARTITION BY lender ORDER BY ts DESC, event_id DESC) AS k FROM {_E} WHERE success) WHERE k = 1")
def catalog_upsert(spark, sf):
    return monitor.catalog(events(spark, sf), only_success=True).select("lender", "event_id", "ts", "products")


@query(f"SELECT ts::DATE AS day, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed, count(*) AS total, sum(products)::BIGINT AS products FROM {_E} GROUP BY 1")
def daily_summary(spark, sf):
    return monitor.daily(events(spark, sf))


@query(f"SELECT count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed FROM {_E}")
def run_totals(spark, sf):
    return monitor.totals(events(spark, sf))


@query(f"SELECT ts::DATE AS day, count(*) AS queries, greatest(0, 100 - count(*)) AS remaining, count(*) * 5.0::DOUBLE / 1000 AS cost FROM {_E} GROUP BY 1")
def usage_cost(spark, sf):
    return monitor.usage(events(spark, sf))


# resolution

_RANK = "CASE strategy WHEN 'network_api' THEN 100 WHEN 'jsonld' THEN 90 WHEN 'embedded_state' THEN 80 WHEN 'compare_cards' THEN 70 WHEN 'ui_enumeration' THEN 60 WHEN 'dom_parsing' THEN 50 ELSE 0 END"
_STRATEGY = "SELECT event_id, user_id, CASE event_id % 5 WHEN 0 THEN 'jsonld' WHEN 1 THEN 'dom_parsing' WHEN 2 THEN 'compare_cards' WHEN 3 THEN 'ui_enumeration' ELSE 'other' END AS strategy FROM {events}"


@query(f"WITH s AS ({D.sql(_STRATEGY)}) SELECT event_id, user_id, strategy FROM (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY {_RANK} DESC) AS k FROM s) WHERE k = 1")
def strategy_select(spark, sf):
    return resolve.select_strategy(D.derive(spark, sf, _STRATEGY), ["user_id"]).select("event_id", "user_id", "strategy")


_HASH = "md5(concat_ws('|', lender, name, CAST(CAST(round(interest_rate * 100) AS INT) AS VARCHAR), rate_type))"


def _hashed(spark, sf):
    k = components(spark, sf)
    return k.withColumn("h", resolve.business_hash(c("lender"), c("name"), F.round(c("interest_rate") * 100).cast("int").cast("string"), c("rate_type")))


@query(f"SELECT h, product_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY product_id, idx) AS k FROM (SELECT *, {_HASH} AS h FROM {_C})) WHERE k = 1")
def hash_dedupe(spark, sf):
    return resolve.first_wins(_hashed(spark, sf), ["h"], ["product_id", "idx"]).select("h", "product_id", "idx")


@query(f"WITH x AS (SELECT *, {_HASH} AS h FROM {_C}), i AS (SELECT DISTINCT h FROM x WHERE product_id % 4 = 0), n AS (SELECT count(DISTINCT h) AS stored FROM x WHERE h NOT IN (SELECT h FROM i)) SELECT stored, count(*) - stored AS duplicates, 0::BIGINT AS errors FROM x, n GROUP BY stored")
def store_counts(spark, sf):
    x = _hashed(spark, sf)
    return resolve.store(x, x.where("product_id % 4 = 0"), ["product_id", "idx"])[1]


@query(f"SELECT product_id, min(idx) AS idx, interest_rate, rate_type FROM {_C} GROUP BY product_id, interest_rate, rate_type")
def first_wins_dedupe(spark, sf):
    return resolve.first_wins(components(spark, sf), ["product_id", "interest_rate", "rate_type"], ["idx"]).select("product_id", "idx", "interest_rate", "rate_type")


_KEY = "concat_ws('|', CAST(CAST(round(interest_rate * 100) AS INT) AS VARCHAR), rate_type, coalesce(CAST(fixed_term_months AS VARCHAR), ''), concat('purpose:', coalesce(purpose, 'none'), ',repayment:', coalesce(repayment_type, 'none')))"


def _keyed(spark, sf):
    app = F.create_map(F.lit("repayment"), F.coalesce("repayment_type", F.lit("none")), F.lit("extraction_method"), c("extraction_method"), F.lit("purpose"), F.coalesce("purpose", F.lit("none")))
    return components(spark, sf).withColumn("ckey", resolve.component_key(F.round(c("interest_rate") * 100).cast("int"), c("rate_type"), c("fixed_term_months"), app))


@query(f"SELECT product_id, ckey, min(idx) AS idx FROM (SELECT *, {_KEY} AS ckey FROM {_C}) GROUP BY product_id, ckey")
def component_dedupe(spark, sf):
    return resolve.first_wins(_keyed(spark, sf), ["product_id", "ckey"], ["idx"]).select("product_id", "ckey", "idx")


_NAMED = "SELECT o_orderkey AS product_id, concat('Lender ', CAST(o_custkey % 17 AS STRING)) AS lender, concat('Loan ', CAST(o_orderkey % 29 AS STRING), CASE o_orderkey % 4 WHEN 0 THEN ' more than' WHEN 1 THEN ' 80% or less LVR' WHEN 2 THEN ' or less' ELSE '' END) AS name, o_orderkey AS seq FROM {orders}"
_BASE = r"trim(regexp_replace(trim(regexp_replace(name, '(?i)\s+(more\s+than|or\s+less|less\s+than|up\s+to|over|more|less)$', '')), '(?i)\s+\d+%.*?LVR.*$', ''))"


@query(f"""WITH p AS (SELECT *, {_BASE} AS base_name FROM ({D.sql(_NAMED)})), m AS (SELECT lender, base_name, arg_min(product_id, seq) AS merged_id, count(*) AS n_variants FROM p GROUP BY ALL),
u AS (SELECT m.merged_id, x.ckey FROM (SELECT *, {_KEY} AS ckey FROM {_C}) x JOIN p USING (product_id) JOIN m ON p.lender = m.lender AND p.base_name = m.base_name GROUP BY ALL)
SELECT m.lender, m.base_name, m.merged_id, n_variants, count(ckey) AS n_components FROM m LEFT JOIN u ON u.merged_id = m.merged_id GROUP BY ALL""")
def merge_by_name(spark, sf):
    merged, united = resolve.merge_by_name(D.derive(spark, sf, _NAMED), _keyed(spark, sf).drop("lender", "name"))
    n = united.groupBy("merged_id").agg(F.count("*").alias("n_components"))
    return merged.join(n, "merged_id", "left").select("lender", "base_name", "merged_id", "n_variants", F.coalesce("n_components", F.lit(0)).cast("long").alias("n_components"))


# pricing

_PROBE = "SELECT o_orderkey AS probe_id, o_orderkey AS product_id, CAST(CASE o_custkey % 4 WHEN 0 THEN 55 WHEN 1 THEN 80 WHEN 2 THEN 0 ELSE 99 END AS DOUBLE) AS lvr FROM {orders}"
_HIT = "(lvr_min IS NOT NULL OR lvr_max IS NOT NULL) AND x >= coalesce(lvr_min, 0) AND CASE WHEN lvr_exclusive_max THEN x < coalesce(lvr_max, 1) ELSE x <= coalesce(lvr_max, 1) END"


@query(f"WITH p AS (SELECT *, CASE WHEN lvr > 1 THEN lvr / 100 ELSE lvr END AS x FROM ({D.sql(_PROBE)})) SELECT probe_id, product_id, lvr, coalesce(arg_min(interest_rate, idx) FILTER ({_HIT}), arg_min(interest_rate, idx), 0.0) AS rate FROM p LEFT JOIN {_C} k USING (product_id) GROUP BY probe_id, product_id, lvr")
def rate_by_lvr(spark, sf):
    return pricing.rate_by_lvr(D.derive(spark, sf, _PROBE), components(spark, sf))


_AXES = "SELECT o_orderkey AS probe_id, o_orderkey AS product_id, CAST(CASE o_custkey % 4 WHEN 0 THEN 55 WHEN 1 THEN 80 WHEN 2 THEN NULL ELSE 99 END AS DOUBLE) AS p_lvr, CASE o_custkey % 3 WHEN 0 THEN 'OwnerOccupied' WHEN 1 THEN 'Investment' END AS p_purpose, CASE o_custkey % 5 WHEN 0 THEN 'InterestOnly' END AS p_repayment, CASE o_custkey % 2 WHEN 0 THEN 'Fixed' ELSE 'Variable' END AS p_rate_type, CAST(CASE o_custkey % 7 WHEN 0 THEN 24 END AS INT) AS p_term FROM {orders}"
_MATCH = f"idx IS NOT NULL AND (x IS NULL OR ({_HIT})) AND (p_purpose IS NULL OR purpose IS NULL OR purpose = p_purpose) AND (p_repayment IS NULL OR repayment_type IS NULL OR repayment_type = p_repayment) AND (p_term IS NULL OR fixed_term_months IS NULL OR fixed_term_months = p_term) AND (p_rate_type IS NULL OR rate_type = p_rate_type)"


@query(f"WITH p AS (SELECT *, CASE WHEN p_lvr > 1 THEN p_lvr / 100 ELSE p_lvr END AS x FROM ({D.sql(_AXES)})) SELECT probe_id, product_id, arg_min(interest_rate, idx) FILTER ({_MATCH}) AS rate, coalesce(bool_or({_MATCH}), false) AS has_permutation FROM p LEFT JOIN {_C} k USING (product_id) GROUP BY probe_id, product_id")
def rate_by_axes(spark, sf):
    return pricing.rate_by_axes(D.derive(spark, sf, _AXES), components(spark, sf))


@query(f"SELECT k.product_id, idx, coalesce(k.purpose, 'OwnerOccupied') AS purpose, coalesce(k.repayment_type, 'PrincipalAndInterest') AS repayment_type, k.rate_type, fixed_term_months, interest_rate, lvr_min, lvr_max FROM {_C} k")
def pricing_matrix(spark, sf):
    return pricing.pricing_matrix(components(spark, sf), products(spark, sf))


@query(f"SELECT product_id, idx, lvr_min, lvr_max, interest_rate, row_number() OVER (PARTITION BY product_id ORDER BY coalesce(lvr_min, 0), idx)::INT AS tier, count(*) OVER (PARTITION BY product_id) > 1 AS has_tiers FROM {_C} WHERE lvr_min IS NOT NULL OR lvr_max IS NOT NULL")
def lvr_tiers(spark, sf):
    return pricing.lvr_tiers(components(spark, sf))


@query(f"SELECT product_id, arg_min(interest_rate, idx) AS primary_rate, arg_min_null(comparison_rate, idx) AS comparison_rate, lower(arg_min(rate_type, idx)) AS rate_type, coalesce(round(max(lvr_max) * 100, 6), 95.0) AS max_lvr FROM {_C} GROUP BY product_id")
def legacy_view(spark, sf):
    return pricing.legacy(components(spark, sf))


_STATE = f"k AS (SELECT *, {S.LOAN} AS loan_type, {S.REPAY} AS repayment FROM {_C})"
_BANDS = f"{_STATE}, b AS (SELECT product_id, loan_type, repayment, coalesce(lvr_min, 0.0) AS lvr_min, coalesce(lvr_max, 0.8) AS lvr_max, max(interest_rate) AS interest_rate, max(comparison_rate) AS comparison_rate, min(interest_rate) <> max(interest_rate) AS conflict, count(*) AS n_components FROM k GROUP BY 1, 2, 3, 4, 5)"


@query(f"WITH {_BANDS} SELECT product_id, loan_type, repayment, lvr_min::DOUBLE AS lvr_min, lvr_max::DOUBLE AS lvr_max, interest_rate, comparison_rate, conflict, n_components FROM b")
def band_conflicts(spark, sf):
    return pricing.bands(components(spark, sf))


_WORLD = f"""{_BANDS}, s AS (SELECT product_id, loan_type, repayment, bool_or(conflict) AS conflict, count(*) AS n_bands,
  string_agg(concat_ws(':', round(lvr_min * 100)::INT::VARCHAR, round(lvr_max * 100)::INT::VARCHAR, round(interest_rate * 100)::INT::VARCHAR, coalesce(round(comparison_rate * 100)::INT::VARCHAR, '-')), ',' ORDER BY lvr_min, lvr_max) AS tiers FROM b GROUP BY 1, 2, 3),
p AS (SELECT product_id, loan_type, repayment, arg_min(extraction_method, idx) AS extraction_method, arg_min(confidence, idx) AS confidence FROM k GROUP BY 1, 2, 3),
st AS (SELECT s.*, p.extraction_method, CASE WHEN conflict THEN greatest(20, confidence - 40) ELSE confidence END AS conf, CASE WHEN conflict THEN 'degraded_lvr_overlaps' END AS data_quality FROM s JOIN p USING (product_id, loan_type, repayment)),
kinds AS (SELECT product_id, arg_min(rate_type, idx) AS rate_type, arg_min_null(fixed_term_months, idx) AS months FROM k GROUP BY 1),
cells(loan_type, repayment, state_order) AS (VALUES ('OwnerOccupied', 'PrincipalAndInterest', 0), ('OwnerOccupied', 'InterestOnly', 1), ('Investment', 'PrincipalAndInterest', 2), ('Investment', 'InterestOnly', 3)),
f AS (SELECT kinds.product_id, cells.loan_type, cells.repayment, cells.state_order, kinds.rate_type, months, n_bands, tiers, extraction_method, conf, data_quality, count(n_bands) OVER (PARTITION BY kinds.product_id) < 4 AS partial
  FROM kinds CROSS JOIN cells LEFT JOIN st ON st.product_id = kinds.product_id AND st.loan_type = cells.loan_type AND st.repayment = cells.repayment),
w AS (SELECT product_id, loan_type, repayment, state_order, concat_ws('_', CASE WHEN loan_type = 'OwnerOccupied' THEN 'OO' ELSE 'INV' END, CASE WHEN repayment = 'PrincipalAndInterest' THEN 'PI' ELSE 'IO' END, left(upper(rate_type), 3)) AS state_id, rate_type,
  CASE WHEN rate_type = 'Fixed' THEN (months // 12)::INT END AS fixed_term_years, n_bands IS NOT NULL AS priced, coalesce(n_bands, 0) AS n_bands, tiers, CASE WHEN n_bands IS NOT NULL AND repayment = 'InterestOnly' THEN 5 END AS interest_only_years,
  CASE WHEN n_bands IS NULL THEN 0 WHEN partial THEN greatest(30, conf - 20) ELSE conf END::INT AS confidence, coalesce(extraction_method, 'not_attempted') AS extraction_method, CASE WHEN n_bands IS NULL THEN 'matrix_materialization' END AS extraction_strategy, data_quality,
  CASE WHEN n_bands IS NULL THEN 'not_available' WHEN partial THEN 'partial' END AS capture_status FROM f)"""


def _tiers(col="rate_tiers"):
    pct = lambda x: F.round(x * 100).cast("int").cast("string")
    return F.array_join(F.transform(col, lambda t: F.concat_ws(":", pct(t["lvr_min"]), pct(t["lvr_max"]), pct(t["interest_rate"]), F.coalesce(pct(t["comparison_rate"]), F.lit("-")))), ",")


@query(f"WITH {_WORLD} SELECT * FROM w")
def closed_world_matrix(spark, sf):
    w = pricing.closed_world(components(spark, sf))
    return w.withColumn("tiers", _tiers()).drop("rate_tiers")


@query(f"""WITH {_STATE}, a AS (SELECT DISTINCT product_id, loan_type FROM k), b AS (SELECT DISTINCT product_id, repayment FROM k), d AS (SELECT DISTINCT product_id, rate_type FROM k)
SELECT product_id, loan_type, repayment, rate_type FROM a JOIN b USING (product_id) JOIN d USING (product_id) EXCEPT SELECT product_id, loan_type, repayment, rate_type FROM k""")
def matrix3_missing(spark, sf):
    return pricing.missing_states(components(spark, sf), "product_id")


@query(f"""WITH {_STATE}, a AS (SELECT DISTINCT product_id, loan_type FROM k), b AS (SELECT DISTINCT product_id, repayment FROM k), d AS (SELECT DISTINCT product_id, rate_type FROM k),
h AS (SELECT product_id, loan_type, repayment, rate_type FROM a JOIN b USING (product_id) JOIN d USING (product_id) EXCEPT SELECT product_id, loan_type, repayment, rate_type FROM k)
SELECT product_id, loan_type, repayment, rate_type, idx, interest_rate, extraction_method, confidence, 'captured' AS capture_status FROM k UNION ALL SELECT product_id, loan_type, repayment, rate_type, NULL, NULL, 'not_available', 0, 'not_available' FROM h""")
def matrix3_complete(spark, sf):
    """The components with placeholders for what a product's axes leave out."""
    return pricing.complete_matrix(components(spark, sf), "product_id").select("product_id", "loan_type", "repayment", "rate_type", "idx", "interest_rate", "extraction_method", "confidence", "capture_status")


_PICK = "SELECT s_suppkey AS page_id, concat('a', CAST(s_nationkey % 3 AS STRING)) AS o1, concat('b', CAST(s_suppkey % 2 AS STRING)) AS o2 FROM {supplier}"


@query(f"WITH x AS ({D.sql(_PICK)}), l AS (SELECT page_id, unnest(['A', o1]) AS p FROM x), r AS (SELECT page_id, unnest([o2, 'Z']) AS q FROM x) SELECT page_id, concat('loan=', p, ';rate=', q) AS state FROM l JOIN r USING (page_id)")
def option_product(spark, sf):
    x = D.derive(spark, sf, _PICK)
    axis = lambda n, o: x.select("page_id", F.lit(n).alias("axis"), F.array(*o).alias("options"))
    axes = axis("loan", (F.lit("A"), "o1")).unionByName(axis("rate", ("o2", F.lit("Z")))).unionByName(axis("region_residency", (F.lit("NSW"),)))
    return pricing.option_product(axes)


# documents


@query(f"WITH {_WORLD} SELECT product_id, state_id, tiers, confidence, capture_status FROM w")
def state_explicit_doc(spark, sf):
    p = products(spark, sf).select("product_id", "lender", "name", "short_name", F.create_map(F.lit("redraw"), F.lit("yes")).alias("features"), F.lit(0.8).alias("max_lvr"), F.lit("u").alias("source_url"), "collected_at")
    d = nest.state_explicit(components(spark, sf), p)
    s = d.select(c("source_product_id").alias("product_id"), F.explode("pricing_states").alias("s"))
    return s.select("product_id", "s.state_id", _tiers("s.pricing.rate_tiers").alias("tiers"), c("s.provenance.confidence_score").alias("confidence"), c("s.provenance.capture_status").alias("capture_status"))


@query(f"WITH {_STATE} SELECT product_id, loan_type, repayment, count(*) AS n_tiers, string_agg(round(interest_rate * 100)::INT::VARCHAR, ',' ORDER BY coalesce(lvr_max, 0), coalesce(lvr_min, 0), idx) AS rates FROM k GROUP BY 1, 2, 3")
def hierarchical_doc(spark, sf):
    h = nest.hierarchical(components(spark, sf))
    a = h.select("product_id", F.explode("loan_types").alias("loan_type", "r")).select("product_id", "loan_type", F.explode("r").alias("repayment", "t"))
    return a.select("product_id", "loan_type", "repayment", F.size("t").cast("long").alias("n_tiers"), F.array_join(F.transform("t", lambda x: F.round(x["interest_rate"] * 100).cast("int").cast("string")), ",").alias("rates"))


@query(f"WITH {_STATE} SELECT product_id, arg_min(interest_rate, idx) AS index_rate, string_agg(DISTINCT repayment, ',' ORDER BY repayment) AS repays, string_agg(concat(floor(round(coalesce(lvr_min, 0) * 100, 6))::INT, '-', floor(round(coalesce(lvr_max, 0.8) * 100, 6))::INT), ',' ORDER BY idx) AS bands FROM k GROUP BY 1")
def api_doc(spark, sf):
    d = nest.api(components(spark, sf), products(spark, sf))
    return d.select(c("productId").alias("product_id"), c("indexRate").alias("index_rate"), F.array_join("eligibility.repaymentType", ",").alias("repays"), F.array_join(F.transform("rateTiers", lambda t: F.concat_ws("-", t["lvrMin"].cast("string"), t["lvrMax"].cast("string"))), ",").alias("bands"))


# quality

_LIMITS = "SELECT o_orderkey AS product_id, CASE o_orderkey % 5 WHEN 0 THEN 'network_api' WHEN 1 THEN 'jsonld' WHEN 2 THEN 'compare_cards' WHEN 3 THEN 'dom_parsing' ELSE 'unheard' END AS method, CAST(CASE WHEN o_orderkey % 3 > 0 THEN 20000 END AS DOUBLE) AS min_amount, CAST(2000000 AS DOUBLE) AS max_amount FROM {orders}"


@query(f"""WITH g AS (SELECT product_id, arg_min(interest_rate, idx) AS rate, max(lvr_max) AS top, count(DISTINCT purpose) AS np, count(DISTINCT repayment_type) AS nr, coalesce(bool_or(purpose = 'OwnerOccupied'), false) AS oo, coalesce(bool_or(purpose = 'Investment'), false) AS inv, coalesce(bool_or(repayment_type = 'PrincipalAndInterest'), false) AS pi, coalesce(bool_or(repayment_type = 'InterestOnly'), false) AS io FROM {_C} GROUP BY 1)
SELECT product_id, greatest(0, least(100, CASE method WHEN 'network_api' THEN 50 WHEN 'jsonld' THEN 45 WHEN 'compare_cards' THEN 35 WHEN 'dom_parsing' THEN 25 ELSE 20 END
  + CASE WHEN rate <> 0 THEN 10 ELSE 0 END + CASE WHEN coalesce(top, 0) <> 0 THEN 5 ELSE 0 END + CASE WHEN nr > 0 THEN 5 ELSE 0 END + CASE WHEN np > 0 THEN 5 ELSE 0 END + CASE WHEN coalesce(min_amount, 0) <> 0 AND max_amount <> 0 THEN 5 ELSE 0 END + CASE WHEN rate BETWEEN 0.5 AND 20 THEN 10 ELSE 0 END
  - CASE WHEN oo AND NOT inv THEN 15 ELSE 0 END - CASE WHEN pi AND NOT io THEN 15 ELSE 0 END + CASE WHEN np >= 2 AND nr >= 2 THEN 10 ELSE 0 END))::INT AS confidence FROM g JOIN ({D.sql(_LIMITS)}) USING (product_id)""")
def confidence_score(spark, sf):
    return quality.confidence(components(spark, sf), D.derive(spark, sf, _LIMITS))


@query(f"WITH {_STATE}, g AS (SELECT product_id, bool_or(loan_type = 'Investment') AS inv, bool_or(repayment = 'InterestOnly') AS io FROM k GROUP BY 1) SELECT product_id, idx, CASE WHEN inv AND io THEN confidence ELSE greatest(30, confidence - CASE WHEN inv THEN 0 ELSE 20 END - CASE WHEN io THEN 0 ELSE 20 END) END AS confidence FROM k JOIN g USING (product_id)")
def partial_capture(spark, sf):
    return quality.partial_capture(components(spark, sf), ["product_id"]).select("product_id", "idx", "confidence")


@query(f"SELECT product_id, coalesce(rate > 0 AND rate <= 50, false) AND product_id IS NOT NULL AND name <> '' AS ok FROM {_P}")
def row_gate(spark, sf):
    return products(spark, sf).select("product_id", quality.passes(c("product_id"), c("name"), F.lit(1), c("rate")).alias("ok"))


_SLUG = "CASE WHEN product_id % 9 = 0 THEN concat('Bad_', product_id) ELSE concat('p-', product_id) END"
_GATE = f"""{_WORLD}, pr AS (SELECT DISTINCT k.product_id, concat('Lender ', o_custkey % 17) AS lender, {_SLUG.replace("product_id", "k.product_id")} AS slug, kinds.rate_type, CASE WHEN kinds.rate_type = 'Fixed' THEN months // 12 END AS years FROM k JOIN kinds USING (product_id) JOIN orders ON o_orderkey = k.product_id),
t AS (SELECT product_id, loan_type, repayment, idx, coalesce(lvr_min, 0) AS lo, coalesce(lvr_max, 0.8) AS hi, interest_rate, comparison_rate FROM k),
fv AS (SELECT *, first_value(interest_rate) OVER (PARTITION BY product_id, loan_type, repayment, lo, hi ORDER BY idx) AS fr FROM t),
g AS (SELECT product_id, count(*) FILTER (loan_type = 'Investment' AND priced) AS inv, count(*) FILTER (repayment = 'InterestOnly' AND priced) AS io FROM w GROUP BY 1),
i AS (SELECT lender, product_id, 'slug' AS "check", 'critical' AS severity, 'schema' AS kind, 10 AS confidence_penalty, 0 AS completeness_penalty FROM pr WHERE NOT regexp_matches(slug, '^[a-z0-9]+(-[a-z0-9]+)*$')
UNION ALL SELECT lender, product_id, 'band_conflict', 'critical', 'data_integrity', 40, 0 FROM fv JOIN pr USING (product_id) WHERE interest_rate <> fr
UNION ALL SELECT lender, product_id, 'missing_investment', 'warning', 'completeness', 20, 20 FROM pr LEFT JOIN g USING (product_id) WHERE coalesce(inv, 0) < 2
UNION ALL SELECT lender, product_id, 'missing_interest_only', 'warning', 'completeness', 20, 20 FROM pr LEFT JOIN g USING (product_id) WHERE coalesce(io, 0) < 2
UNION ALL SELECT lender, product_id, 'fixed_term', 'critical', 'schema', 20, 20 FROM pr WHERE rate_type = 'Fixed' AND years IS NULL
UNION ALL SELECT lender, product_id, 'comparison_rate', 'warning', 'completeness', 10, 10 FROM (SELECT product_id FROM t GROUP BY product_id, loan_type, repayment HAVING bool_or(coalesce(comparison_rate, 0) = 0)) JOIN pr USING (product_id))"""


def _gate(spark, sf):
    """(products with priced states, the closed world, tiers), each from one pass over components."""
    k = components(spark, sf)
    slug = F.when(c("product_id") % 9 == 0, F.concat(F.lit("Bad_"), c("product_id").cast("string"))).otherwise(F.concat(F.lit("p-"), c("product_id").cast("string")))
    world = pricing.closed_world(k, keep=("lender",)).withColumn("slug", slug)
    p = quality.priced(world, ("lender", "slug", "rate_type", "fixed_term_years"))
    tiers = pricing.with_state(k).select("product_id", "loan_type", "repayment", "idx", F.coalesce("lvr_min", F.lit(0.0)).alias("lvr_min"), F.coalesce("lvr_max", F.lit(0.8)).alias("lvr_max"), "interest_rate", "comparison_rate")
    return p, world, tiers


@query(f'WITH {_GATE} SELECT lender, product_id, "check", severity, kind, confidence_penalty, completeness_penalty FROM i')
def quality_issues(spark, sf):
    p, _, tiers = _gate(spark, sf)
    return quality.listed(quality.findings(p, tiers))


_SUMMARY = f"""{_GATE}, ln AS (SELECT DISTINCT lender FROM pr UNION SELECT 'Lender none'), n AS (SELECT lender, count(*) AS n_products FROM pr GROUP BY 1),
pp AS (SELECT lender, count(*) AS n_issues, count(*) FILTER (severity = 'critical') AS n_critical, count(*) FILTER (severity = 'warning') AS n_warnings, count(DISTINCT product_id) AS products_with_issues, sum(confidence_penalty) AS cp, sum(completeness_penalty) AS kp FROM i GROUP BY 1),
v AS (SELECT lender, coalesce(n_products, 0) AS n_products, coalesce(n_issues, 0) AS n_issues, coalesce(n_critical, 0) AS n_critical, coalesce(n_warnings, 0) AS n_warnings, coalesce(products_with_issues, 0) AS products_with_issues,
  CASE WHEN n_products IS NULL THEN 0 ELSE greatest(0, 100 - coalesce(cp, 0)) END::INT AS confidence, CASE WHEN n_products IS NULL THEN 0 ELSE greatest(0, 100 - coalesce(kp, 0)) END::INT AS completeness, CASE WHEN n_products IS NULL THEN 0 ELSE 100 END AS consistency FROM ln LEFT JOIN n USING (lender) LEFT JOIN pp USING (lender))"""


def _verdict(spark, sf):
    p, _, tiers = _gate(spark, sf)
    return p, quality.scorecard(quality.findings(p, tiers), spark.range(1).select(F.lit("Lender none").alias("lender")))


@query(f"WITH {_SUMMARY} SELECT *, CASE WHEN confidence < 40 THEN 'quarantined' WHEN confidence < 70 THEN 'warning' ELSE 'passed' END AS status FROM v")
def quality_summary(spark, sf):
    return _verdict(spark, sf)[1]


@query(f"WITH {_SUMMARY} SELECT product_id, lender, concat('confidence ', confidence) AS reason FROM pr JOIN v USING (lender) WHERE confidence < 40")
def quarantine_split(spark, sf):
    return quality.quarantine(*_verdict(spark, sf))[1].select("product_id", "lender", "reason")


@query(f"WITH {_SUMMARY} SELECT product_id, lender, n_products, n_issues, n_critical, n_warnings, confidence, completeness, consistency FROM pr JOIN v USING (lender) WHERE confidence < 40")
def quarantine_report(spark, sf):
    """Quarantined products with their lender's report."""
    return quality.quarantine(*_verdict(spark, sf))[1].select("product_id", "lender", *[f"report.{x}" for x in ("n_products", "n_issues", "n_critical", "n_warnings", "confidence", "completeness", "consistency")])


@query(f"""WITH {_GATE}, a AS (SELECT product_id, count(*) FILTER (priced) AS n FROM w GROUP BY 1), b2 AS (SELECT min(interest_rate) <> max(interest_rate) AS x FROM t GROUP BY product_id, loan_type, repayment, lo, hi),
d AS (SELECT 'four_states' AS "check", count(*) AS checked, count(*) FILTER (n < 4) AS failed FROM a UNION ALL SELECT 'id_charset', count(*), count(*) FILTER (NOT regexp_matches(slug, '^[a-z0-9]+(-[a-z0-9]+)*$')) FROM pr
UNION ALL SELECT 'band_conflicts', count(*), count(*) FILTER (x) FROM b2 UNION ALL SELECT 'fixed_terms', count(*), count(*) FILTER (years IS NULL) FROM pr WHERE rate_type = 'Fixed') SELECT *, failed = 0 AS passed FROM d""")
def done_checks(spark, sf):
    p, world, tiers = _gate(spark, sf)
    return quality.done_checks(p, world, tiers)


# matching


@query("SELECT c_custkey AS id, c_acctbal / 12 * 0.7::DOUBLE AS net_monthly, c_acctbal / 12 * 0.7::DOUBLE - c_custkey % 50 AS available, CASE WHEN c_custkey % 10 > 0 THEN c_acctbal / (c_custkey % 10) * 100 END AS lvr FROM customer")
def borrower_metrics(spark, sf):
    k = table(spark, sf, "customer")
    return k.select(c("c_custkey").alias("id"), matching.net_monthly(c("c_acctbal")).alias("net_monthly"), matching.available(c("c_acctbal"), c("c_custkey") % 50).alias("available"), matching.lvr_percent(c("c_acctbal"), c("c_custkey") % 10).alias("lvr"))


_APPS = "SELECT c_custkey AS app_id, c_mktsegment AS segment, CAST(60000 + c_custkey % 1000 * 100 AS DOUBLE) AS income, CAST(c_custkey % 700 AS DOUBLE) AS debts, CAST(200000 + c_custkey % 37 * 10000 AS DOUBLE) AS amount, CAST(500000 + c_custkey % 11 * 20000 AS DOUBLE) AS value, 360 AS months FROM {customer}"
_OFFERS = "SELECT s_suppkey AS offer_id, CASE s_suppkey % 5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'FURNITURE' WHEN 3 THEN 'MACHINERY' ELSE 'HOUSEHOLD' END AS segment, CAST(3 + s_nationkey % 5 AS DOUBLE) AS rate, CAST(60 + s_nationkey % 4 * 10 AS DOUBLE) AS offer_max_lvr FROM {supplier}"


@query(f"""WITH j AS (SELECT app_id, offer_id, amount / value * 100 AS lvr, amount * (rate / 1200) / (1 - pow(1 + rate / 1200, -months)) AS payment, income / 12 * 0.7::DOUBLE - debts AS free, offer_max_lvr FROM ({D.sql(_APPS)}) a JOIN ({D.sql(_OFFERS)}) o USING (segment))
SELECT app_id, offer_id, round(lvr, 4) AS lvr, round(payment, 4) AS payment, greatest(0.0, least(100.0, round(100 * (1 - payment / free), 4)))::DOUBLE AS score FROM j WHERE lvr <= least(offer_max_lvr, 95.0) AND payment <= free""")
def product_match(spark, sf):
    return matching.match(D.derive(spark, sf, _APPS), D.derive(spark, sf, _OFFERS))


# streaming


@query(f"""WITH e AS {_E} SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, lender, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed FROM e GROUP BY 1, 2""")
def stream_windows(spark, sf):
    """The monitor's windowed counts, run as a stream to its end."""
    from ..sources.shared import fresh
    from ..streaming import monitor as stream

    base = fresh(spark, "stream")
    raw = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    e = raw.selectExpr("event_id", "CAST(ts AS TIMESTAMP) AS ts", "concat('Lender ', CAST(user_id % 17 AS STRING)) AS lender", "event_type <> 'error' AND event_id % 6 <> 0 AS success", "CAST(event_id % 23 AS INT) AS products")
    w = stream.windowed(e, "1 hour", "1 hour").select("start", "lender", "successful", "failed")
    rows = f"{base}/rows"

    def keep(batch, n):
        batch.write.mode("overwrite").parquet(rows)

    w.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(rows)
