"""Queries over page controls, states, labels and timestamps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import parsing as P
from ..operators import controls, resolve
from ..sources import readers
from ..sources.readers import table
from . import derive as D
from . import sqlparts as S
from .registry import query

c = F.col

_OPT = "SELECT p_size AS page_id, CAST(p_partkey % 3 AS INT) AS container, p_partkey AS idx, CASE p_partkey % 9 WHEN 0 THEN 'Owner Occupied' WHEN 1 THEN 'owner occupied ' WHEN 2 THEN 'Please choose' WHEN 3 THEN 'Fixed' WHEN 4 THEN 'Variable' WHEN 5 THEN 'NSW' WHEN 6 THEN 'zzz' WHEN 7 THEN 'FIXED' ELSE p_name END AS text FROM {part}"
_DISTINCT = f"d AS (SELECT page_id, container, min(idx) AS idx, arg_min(text, idx) AS text FROM ({D.sql(_OPT)}) WHERE NOT regexp_matches(lower(text), 'select|please') AND trim(text) <> '' GROUP BY page_id, container, lower(trim(text)))"


@query(f"""WITH {_DISTINCT}, a AS (SELECT *, {S.option_type("text")} AS axis FROM d), g AS (SELECT page_id, container, string_agg(text, '|' ORDER BY idx) AS options, count(*) AS n FROM a GROUP BY 1, 2),
v AS (SELECT page_id, container, axis, row_number() OVER (PARTITION BY page_id, container ORDER BY count(*) DESC, axis) AS k FROM a WHERE axis IS NOT NULL GROUP BY 1, 2, 3)
SELECT page_id, container, options, axis, axis IS NOT NULL AS known, coalesce(axis, '') NOT IN ('region_residency', 'borrower_category') AS pricing FROM g LEFT JOIN (SELECT page_id, container, axis FROM v WHERE k = 1) USING (page_id, container) WHERE n > 1""")
def option_groups(spark, sf):
    g = controls.groups(D.derive(spark, sf, _OPT))
    return g.withColumn("options", F.array_join("options", "|"))


_LAB = "SELECT CAST(p_size AS BIGINT) AS page_id, p_partkey AS label_id, CASE WHEN p_partkey % 4 = 0 THEN CAST(p_partkey % 6 AS INT) END AS container, CAST(p_partkey * 37 % 5000 AS DOUBLE) AS y FROM {part} WHERE p_partkey % 5 = 0"
_OPS = "SELECT CAST(p_size AS BIGINT) AS page_id, p_partkey AS option_id, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 6 AS INT) END AS container, CAST(p_partkey * 53 % 5000 AS DOUBLE) AS y FROM {part} WHERE p_partkey % 5 <> 0"


@query(f"""WITH l AS ({D.sql(_LAB)}), o AS ({D.sql(_OPS)}), s AS (SELECT page_id, label_id, option_id FROM l JOIN o USING (page_id, container)),
n AS (SELECT l.page_id, label_id, option_id FROM l JOIN o ON l.page_id = o.page_id AND abs(l.y - o.y) < 200 AND l.container IS DISTINCT FROM o.container WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.page_id = l.page_id AND s.label_id = l.label_id))
SELECT * FROM s UNION ALL SELECT * FROM n""")
def label_options(spark, sf):
    return controls.near_labels(D.derive(spark, sf, _LAB), D.derive(spark, sf, _OPS))


@query(f"""SELECT p_partkey AS id, coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_brand END, NULLIF(trim(CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE NULL END), ''), CASE WHEN p_partkey % 5 = 0 THEN p_type END, p_name) AS label,
  CASE WHEN {S.any_of("lower(p_name)", L.LEXICON["repayment_type"].labels)} THEN 'repayment_type' WHEN {S.any_of("lower(p_name)", L.LEXICON["rate_type"].labels)} THEN 'rate_type' WHEN {S.any_of("lower(p_name)", L.LEXICON["loan_type"].labels)} THEN 'loan_type' WHEN {S.any_of("lower(p_name)", L.LEXICON["loan_purpose"].labels)} THEN 'loan_purpose' WHEN {S.any_of("lower(p_name)", L.LEXICON["product_segment"].labels)} THEN 'product_segment' WHEN {S.any_of("lower(p_name)", L.LEXICON["region_residency"].labels)} THEN 'region_residency' WHEN {S.any_of("lower(p_name)", L.LEXICON["rate_tier"].labels)} THEN 'rate_tier' END AS axis FROM part""")
def radio_labels(spark, sf):
    p = table(spark, sf, "part")
    k = c("p_partkey")
    return p.select(k.alias("id"), controls.radio_label(F.when(k % 2 == 0, c("p_brand")), F.when(k % 3 == 0, F.lit(" ")), F.when(k % 5 == 0, c("p_type")), F.lit(None).cast("string"), c("p_name")).alias("label"), controls.label_axis(c("p_name")).alias("axis"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS source, l_suppkey AS target FROM lineitem), r(state, depth) AS (SELECT 7::BIGINT, 0 UNION SELECT target, depth + 1 FROM r JOIN e ON source = state WHERE depth < 5)
SELECT state, min(depth)::INT AS depth FROM r GROUP BY state""")
def state_paths(spark, sf):
    """Every line item is an edge."""
    e = table(spark, sf, "lineitem").select(c("l_partkey").alias("source"), c("l_suppkey").alias("target")).distinct()
    return controls.reachable_states(e, spark.range(7, 8).select(c("id").alias("state")))


@query(r"""WITH k AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 5) * 0.2::DOUBLE AS lo, least(1.0, (l_partkey % 5) * 0.2::DOUBLE + 0.15)::DOUBLE AS hi FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN lo <= 0 THEN concat('≤', round(hi * 100)::INT, '%') WHEN hi >= 1 THEN concat('>', round(lo * 100)::INT, '%') ELSE concat(round(lo * 100)::INT, '%-', round(hi * 100)::INT, '%') END AS label, floor(round(hi * 100, 6))::INT AS percent, (l_partkey % 5 * 20 > 1)::BOOLEAN AS is_percent, CASE WHEN l_partkey % 5 * 20 > 1 THEN l_partkey % 5 * 20 / 100.0::DOUBLE ELSE l_partkey % 5 * 20 END::DOUBLE AS fraction FROM k""")
def lvr_labels(spark, sf):
    k = table(spark, sf, "lineitem").withColumn("lo", (c("l_partkey") % 5) * 0.2).withColumn("hi", F.least(F.lit(1.0), (c("l_partkey") % 5) * 0.2 + 0.15))
    raw = (c("l_partkey") % 5 * 20).cast("double")
    return k.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", P.lvr_label(c("lo"), c("hi")).alias("label"), P.as_percent(c("hi")).alias("percent"), (raw > 1).alias("is_percent"), P.as_fraction(raw).alias("fraction"))


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS batch, strftime(ts, '%Y-%m-%d-%H-%M-%S') AS snapshot, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso, ts AS parsed FROM events")
def timestamps(spark, sf):
    e = table(spark, sf, "events").select("event_id", c("ts").cast("timestamp").alias("ts"))
    return e.select("event_id", P.stamp(c("ts")).alias("batch"), P.snapshot_stamp(c("ts")).alias("snapshot"), P.iso(c("ts")).alias("iso"), P.from_iso(P.iso(c("ts"))).alias("parsed"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE 20000 END::DOUBLE AS min_amount, 2000000.0::DOUBLE AS max_amount, 18 AS min_age, 'House,Apartment,Townhouse' AS property_types, CASE WHEN o_orderkey % 4 = 0 THEN 'Given' ELSE 'Personal' END AS borrower_category, 'NSW,VIC' AS regions FROM orders")
def eligibility_defaults(spark, sf):
    o = table(spark, sf, "orders").select(c("o_orderkey").alias("id"), F.when(c("o_orderkey") % 3 == 0, c("o_totalprice")).alias("min_amount"), F.when(c("o_orderkey") % 4 == 0, "Given").alias("borrower_category"))
    d = resolve.broadcast_metadata(controls.with_defaults(o), F.array(F.lit("NSW"), F.lit("VIC")), F.lit("Personal"))
    return d.select("id", "min_amount", "max_amount", "min_age", F.array_join("property_types", ",").alias("property_types"), "borrower_category", F.array_join("region_restrictions", ",").alias("regions"))


_FOUND = "SELECT event_id, user_id, CASE event_id % 7 WHEN 0 THEN 'jsonld' WHEN 1 THEN 'dom_parsing' WHEN 2 THEN 'compare_cards' WHEN 3 THEN 'unlisted' WHEN 4 THEN 'embedded_state' ELSE 'select_dropdowns' END AS strategy FROM {events}"


@query(f"WITH x AS (SELECT *, list_position(['jsonld', 'embedded_state', 'select_dropdowns', 'compare_cards', 'dom_parsing'], strategy) AS o FROM ({D.sql(_FOUND)})) SELECT event_id, user_id, strategy FROM (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY o) AS k FROM x WHERE o IS NOT NULL AND o > 0) WHERE k = 1")
def strategy_cascade(spark, sf):
    return controls.cascade(D.derive(spark, sf, _FOUND), ["user_id"]).select("event_id", "user_id", "strategy")


@query("SELECT p_partkey AS id, coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN NULL ELSE NULL END, CASE WHEN p_partkey % 2 = 0 THEN p_type END, concat(p_brand, ' Variable Rate')) AS name, contains(lower(p_name), 'n/a') AS unavailable FROM part")
def table_names(spark, sf):
    k = c("p_partkey")
    heading = F.when(k % 3 == 0, c("p_name")).when(k % 3 == 1, F.repeat(c("p_name"), 20))
    return table(spark, sf, "part").select(k.alias("id"), controls.table_name(heading, F.when(k % 2 == 0, c("p_type")), c("p_brand")).alias("name"), P.is_unavailable(c("p_name")).alias("unavailable"))


_HITS = "SELECT event_id AS call_id, CAST(ts AS TIMESTAMP) AS ts, CAST(CASE event_id % 9 WHEN 0 THEN 403 WHEN 1 THEN 400 WHEN 2 THEN 500 ELSE 200 END AS INT) AS status, CASE WHEN event_id % 9 > 2 THEN concat('{{\"items\":[{{\"title\":\"t\",\"link\":\"https://x.com/', CAST(event_id AS STRING), '\"}},{{\"link\":\"b\"}},{{\"link\":\"c\"}}]}}') END AS body FROM {events}"


@query(f"""WITH h AS ({D.sql(_HITS)}), q AS (SELECT *, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, call_id) AS k FROM h), r AS (SELECT call_id, CASE status WHEN 200 THEN 'ok' WHEN 400 THEN 'bad_request' WHEN 403 THEN 'quota_exceeded' ELSE 'error' END AS state FROM q WHERE k <= 20)
SELECT call_id, state, p::INT AS position, CASE p WHEN 0 THEN concat('https://x.com/', call_id) WHEN 1 THEN 'b' END AS link FROM r LEFT JOIN (VALUES (0), (1)) AS v(p) ON state = 'ok'""")
def search_results(spark, sf):
    return readers.search_results(D.derive(spark, sf, _HITS), per_query=2, quota=20).select("call_id", "state", "position", "link")
