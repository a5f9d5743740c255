"""Working tables derived from the driver's tables, as SQL that Spark and DuckDB both read.

Only the inputs of an operator are derived here; the operator itself is a DataFrame
function on one side and independent SQL on the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.readers import table

#: rate lines: an order is a product, its line items are its components (line numbers repeat,
#: so the place in the product is built from line, part and supplier)
COMPONENTS = """
SELECT l.l_orderkey AS product_id, CAST(l.l_linenumber AS BIGINT) * 1000000000000 + l.l_partkey * 1000000 + l.l_suppkey AS idx,
  concat('Lender ', CAST(o.o_custkey % 17 AS STRING)) AS lender,
  concat('Home Loan ', CAST(l.l_orderkey % 211 AS STRING)) AS name,
  CAST(400 + 30 * CAST(round(l.l_discount * 100) AS INT) + 5 * (l.l_partkey % 3) AS DOUBLE) / 100 AS interest_rate,
  CASE WHEN l.l_linenumber = 5 THEN NULL ELSE CAST(420 + 30 * CAST(round(l.l_discount * 100) AS INT) + 10 * CAST(round(l.l_tax * 100) AS INT) AS DOUBLE) / 100 END AS comparison_rate,
  CASE WHEN l.l_returnflag = 'R' THEN 'Fixed' ELSE 'Variable' END AS rate_type,
  CASE WHEN l.l_returnflag = 'R' AND l.l_linenumber < 6 THEN CAST((l.l_partkey % 5 + 1) * 12 AS INT) END AS fixed_term_months,
  CASE WHEN l.l_linenumber = 7 THEN NULL WHEN l.l_linestatus = 'O' THEN 'OwnerOccupied' ELSE 'Investment' END AS purpose,
  CASE WHEN l.l_suppkey % 3 = 0 THEN 'InterestOnly' WHEN l.l_suppkey % 3 = 1 THEN 'PrincipalAndInterest' END AS repayment_type,
  CASE CAST(l.l_quantity AS INT) % 5 WHEN 1 THEN 0.0E0 WHEN 2 THEN 0.6E0 WHEN 3 THEN 0.8E0 END AS lvr_min,
  CASE CAST(l.l_quantity AS INT) % 5 WHEN 0 THEN 0.8E0 WHEN 1 THEN 0.6E0 WHEN 2 THEN 0.8E0 WHEN 3 THEN 1.0E0 END AS lvr_max,
  CAST(l.l_quantity AS INT) % 5 = 3 AS lvr_exclusive_max,
  CASE l.l_partkey % 4 WHEN 0 THEN 'network_api' WHEN 1 THEN 'jsonld' WHEN 2 THEN 'compare_cards' ELSE 'dom_parsing' END AS extraction_method,
  CAST(50 + l.l_partkey % 41 AS INT) AS confidence
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
"""

#: products: orders as loan products of the customer's lender
PRODUCTS = """
SELECT o_orderkey AS product_id, concat('Lender ', CAST(o_custkey % 17 AS STRING)) AS lender,
  concat('Home Loan ', CAST(o_orderkey % 211 AS STRING)) AS name,
  CASE WHEN o_orderkey % 5 = 0 THEN concat('Loan/', CAST(o_orderkey AS STRING)) END AS short_name,
  CASE WHEN o_orderkey % 7 = 0 THEN 'Fixed' ELSE 'Variable' END AS rate_type,
  CAST(CAST(floor(o_totalprice) AS BIGINT) % 900 AS DOUBLE) / 100 AS rate,
  'OwnerOccupied' AS purpose, 'PrincipalAndInterest' AS repayment_type,
  CAST(o_orderdate AS TIMESTAMP) AS collected_at
FROM {orders}
"""

#: collection events: an error event is a failed collection
EVENTS = """
SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, concat('Lender ', CAST(user_id % 17 AS STRING)) AS lender,
  CASE WHEN event_id % 2 = 0 THEN 'daily' ELSE 'hourly' END AS collection_type,
  event_type <> 'error' AND event_id % 6 <> 0 AS success, CAST(event_id % 23 AS INT) AS products
FROM {events}
"""

#: option strings with bands and qualifiers
OPTIONS = """
SELECT p_partkey AS id,
  concat(CAST(4 + p_size % 4 AS STRING), '.', CAST(10 + p_partkey % 90 AS STRING), CASE p_partkey % 9 WHEN 0 THEN ' p.a ' ELSE '% p.a ' END, p_name,
    CASE p_partkey % 6 WHEN 0 THEN ' 80% or less LVR' WHEN 1 THEN ' 60% or less LVR*' WHEN 2 THEN ' more than 80% LVR' WHEN 3 THEN ' Fixed 90% LVR' ELSE '' END) AS text
FROM {part}
"""

#: texts to classify
LABELS = """
SELECT p_partkey AS id, CASE p_partkey % 16
  WHEN 0 THEN 'Owner Occupied' WHEN 1 THEN 'Interest Only' WHEN 2 THEN 'Principal & Interest' WHEN 3 THEN 'Fixed rate 2 years'
  WHEN 4 THEN 'Variable' WHEN 5 THEN 'First home buyer' WHEN 6 THEN 'Offset account package' WHEN 7 THEN 'NSW resident'
  WHEN 8 THEN 'Loan amount over 500k' WHEN 9 THEN '80% LVR or less' WHEN 10 THEN 'Contact us about a home' WHEN 11 THEN 'Investment property loan for you today'
  WHEN 12 THEN p_type WHEN 13 THEN p_name WHEN 14 THEN concat('  HOUSE ', p_brand) ELSE concat('land ', CAST(p_size AS STRING), ' months') END AS text
FROM {part}
"""

#: captured control states, in page order
STATES = """
SELECT p_partkey AS id,
  CASE p_partkey % 4 WHEN 0 THEN 'loan_type' WHEN 1 THEN 'purpose' WHEN 2 THEN 'tab' ELSE 'customer_category' END AS k1,
  CASE p_partkey % 5 WHEN 0 THEN 'Owner Occupied' WHEN 1 THEN 'Investment' WHEN 2 THEN 'Refinance' WHEN 3 THEN 'Business' ELSE p_type END AS v1,
  CASE p_partkey % 3 WHEN 0 THEN 'repayment' WHEN 1 THEN 'rate_type' ELSE 'region' END AS k2,
  CASE p_partkey % 7 WHEN 0 THEN 'Interest Only' WHEN 1 THEN 'P&I' WHEN 2 THEN 'Fixed 3 years' WHEN 3 THEN 'Variable' WHEN 4 THEN 'NSW and Victoria' WHEN 5 THEN 'Fixed' ELSE 'Split' END AS v2,
  CASE p_partkey % 3 WHEN 0 THEN 'lvr' WHEN 1 THEN 'product_segment' ELSE 'term' END AS k3,
  CASE p_partkey % 8 WHEN 0 THEN '80% or less' WHEN 1 THEN 'more than 90%' WHEN 2 THEN '70%' WHEN 3 THEN 'Premium' WHEN 4 THEN '5 years' WHEN 5 THEN '18 months' WHEN 6 THEN 'Basic plus' ELSE '60% LVR' END AS v3
FROM {part}
"""

#: captured JSON responses
RESPONSES = """
SELECT s_suppkey AS call_id, CAST(CASE WHEN s_suppkey % 10 = 9 THEN 404 ELSE 200 END AS INT) AS status,
  CASE WHEN s_suppkey % 11 = 10 THEN 'text/html' ELSE 'application/json; charset=utf-8' END AS content_type,
  CASE s_suppkey % 4
    WHEN 0 THEN concat('{{"loanProducts":[{{"productName":"', s_name, '","rateType":"Variable","eligibility":{{"loanPurpose":["OwnerOccupied","Investment"],"repaymentType":["PrincipalAndInterest"]}},"rateTiers":[{{"lvrMin":0,"lvrMax":80,"interestRate":', CAST(3 + s_nationkey % 5 AS STRING), '.49,"comparisonRate":', CAST(3 + s_nationkey % 5 AS STRING), '.61}},{{"lvrMin":80,"lvrMax":95,"interestRate":6.5}}]}}]}}')
    WHEN 1 THEN concat('{{"products":[{{"name":"', s_name, '","rate":"', CAST(2 + s_nationkey % 6 AS STRING), '.5% p.a."}},{{"name":"","rate":5}}]}}')
    WHEN 2 THEN concat('{{"data":{{"items":[{{"title":"x","loanName":"', s_name, '","interestRate":', CAST(1 + s_nationkey % 7 AS STRING), '.25}}]}}}}')
    ELSE '{{broken' END AS body
FROM {supplier}
"""

#: pages with structured markup, built from rows
MARKUP = """
SELECT s_suppkey AS page_id,
  concat('<html><script type="application/ld+json">{{"@type":"', CASE WHEN s_suppkey % 3 = 0 THEN 'Product' WHEN s_suppkey % 3 = 1 THEN 'FinancialProduct' ELSE 'Thing' END, '","name":"', s_name, '","offers":{{"price":"', CAST(s_nationkey % 9 AS STRING), '.5"}}}}</script><script>dataLayer = [{{"ecommerce":{{"items":[{{"name":"', s_name, '","price":', CAST(s_nationkey % 9 AS STRING), '.75}},{{"item_name":"text price","price":"6.1"}}]}}}}];</script><div class="compare-card"><h2>', s_name, CASE WHEN s_suppkey % 2 = 0 THEN ' Fixed' ELSE '' END, '</h2><span data-cell="rate">', CAST(s_nationkey % 9 AS STRING), CASE WHEN s_suppkey % 5 = 0 THEN '.15</span>' ELSE '.15% p.a</span>' END, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE concat('<span data-cell="comparison">', CAST(s_nationkey % 9 AS STRING), '.35% p.a</span>') END, '</div></html>') AS html
FROM {supplier}
"""

#: search pages of four engines
SERPS = """
SELECT s_suppkey AS page_id, CASE s_suppkey % 4 WHEN 0 THEN 'google' WHEN 1 THEN 'bing' WHEN 2 THEN 'yahoo' ELSE 'other' END AS engine,
  concat('<a href="/url?q=https://www.bank', CAST(s_nationkey AS STRING), '.com/rates%3Fa=b&sa=U">r</a><a href="https://support.google.com/x">g</a><A HREF="https://www.microsoft.com/y">m</a>',
    '<a href="https://r.yahoo.com/k/u=https://lender', CAST(s_suppkey AS STRING), '.com/b%20c&z">y</a><a href="https://lender.com.au/home">d</a><a href="https://lender.com.au/home">again</a>',
    '<a href="https://www.youtube.com/v">v</a><a href="/url?q=https://maps.google.com/p&x">map</a><a href="/about">own</a><a href="https://www.bing.com/s">b</a>') AS html
FROM {supplier}
"""

#: pages with tier tables and rate selects
TIERED = """
SELECT s_suppkey AS page_id,
  concat('<html><table><tr><td>Fees and rates</td></tr><tr><td>≤ 10%</td><td>1.00%</td></tr></table><table class="t"><tr><th>', CASE WHEN s_suppkey % 7 = 0 THEN 'Band' ELSE 'LVR tier' END, '</th><th>Rate</th></tr>',
    '<tr><td>&le; 60%</td><td><b>', CAST(s_nationkey % 9 AS STRING), '.65%</b> p.a</td></tr><tr><td>2 years fixed ≤', CAST(70 + 10 * (s_nationkey % 2) AS STRING), '%</td><td>', CAST(s_nationkey % 9 AS STRING), '.80%</td></tr>',
    CASE WHEN s_suppkey % 3 = 0 THEN '<tr><td>no tier</td><td>9.99%</td></tr>' ELSE concat('<tr><td>&gt; 90%</td><td>', CAST(s_nationkey % 9 AS STRING), '.89%</td></tr>') END,
    '<tr><td>Index rate</td><td>', CAST(s_nationkey % 9 AS STRING), '.24%</td></tr></table>',
    '<select id="homeInterestRate"><option>Please select</option><option>', CAST(2 + s_nationkey % 7 AS STRING), '.49% p.a Standard Variable 80% or less LVR</option><option>', CAST(2 + s_nationkey % 7 AS STRING), '.69% p.a Standard Variable more than 80% LVR</option></select><select id="state"><option>5.00% p.a Hidden</option></select></html>') AS html
FROM {supplier}
"""

#: pages with product headings and rates
HEADED = """
SELECT c_custkey AS page_id,
  concat('<html><body><h1>', c_name, CASE c_custkey % 4 WHEN 0 THEN ' Home Loan' WHEN 1 THEN ' contact us about a loan' WHEN 2 THEN ' Variable' ELSE '' END, '</h1><div><p>', c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN ' fixed' ELSE '' END, ' from ', CAST(c_nationkey AS STRING), '.5', CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '% p.a' END, '</p><p>', CASE WHEN c_custkey % 7 = 0 THEN '' ELSE concat('comparison rate ', CAST(c_nationkey AS STRING), '.9%') END, '</p>', CASE WHEN c_custkey % 6 = 0 THEN '<p>lends 70% or less LVR</p>' ELSE '' END, '</div></body></html>') AS html
FROM {customer}
"""

#: tier tables: an order's line items as the rows of a table
TIERS = """
SELECT l_orderkey AS table_id, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 1000000 + l_suppkey AS row_idx,
  CASE WHEN l_linenumber = 7 THEN 'Index rate' WHEN CAST(l_quantity AS INT) % 6 = 0 THEN concat('> ', CAST(50 + 10 * (l_partkey % 5) AS STRING), '%') WHEN CAST(l_quantity AS INT) % 6 = 1 THEN 'no tier' ELSE concat('≤ ', CAST(50 + 10 * (l_partkey % 5) AS STRING), '%') END AS label,
  CAST(500 + l_partkey % 100 AS DOUBLE) / 100 AS rate
FROM {lineitem}
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def derive(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in query}
    return spark.sql(query, **used)


def sql(query: str) -> str:
    """The same for DuckDB, where tables are views."""
    return query.format(**{t: t for t in TABLES}).strip()
