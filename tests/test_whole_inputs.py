"""Queries read the whole of their tables: small fixtures against brute force."""

import pytest

from ratelake.operators import matching
from ratelake.plans import pages
from ratelake.plans import relational as R


def put(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"file://{path}/{name}.parquet")


def test_every_supplier_is_an_offer(spark, tmp_path):
    names = ["HOUSEHOLD", "AUTOMOBILE", "BUILDING"]
    people = [(k, names[k % 3], k % 25) for k in range(1, 40)]
    suppliers = [(k, k % 25) for k in (*range(1, 31), 99, 1000, 123456)]
    put(spark, tmp_path, "customer", people, "c_custkey long, c_mktsegment string, c_nationkey int")
    put(spark, tmp_path, "supplier", suppliers, "s_suppkey long, s_nationkey int")
    want = {}
    for app, segment, _ in people:
        free = (60000 + app % 1000 * 100) / 12 * 0.7 - app % 700
        amount, lvr = 200000 + app % 37 * 10000, (200000 + app % 37 * 10000) / (500000 + app % 11 * 20000) * 100
        for offer, nation in suppliers:
            i = (3 + nation % 5) / 1200
            pay = amount * i / (1 - (1 + i) ** -360)
            if segment == ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD"][offer % 5] and lvr <= min(60 + nation % 4 * 10, 95) and pay <= free:
                want[app, offer] = (lvr, pay, max(0, min(100, 100 * (1 - pay / free))))
    got = {(r.app_id, r.offer_id): (r.lvr, r.payment, r.score) for r in R.product_match(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and {o for _, o in got if o > 25}
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-4)


def test_matches_cost_by_terms_and_spread_over_tasks(spark):
    """Figures are made before offers are listed; one file of applications goes to many tasks;
    blocks, offers that repeat and offers without an id, terms or segment are as in the plain join."""
    from pyspark.sql import functions as F

    terms = [(5.0, 80.0), (0.0, 95.0), (5.0, None), (None, 80.0), (3.0, 10.0), (-0.0, 95.0)]
    sold = [(k, "ab"[k % 7 == 0], *terms[k % 6]) for k in range(25000)] + [(6, "a", 5.0, 80.0), (None, "a", 5.0, 80.0), (None, "a", 5.0, 80.0), (1, None, 5.0, 80.0)]
    people = [(1, "a", 90000.0, 10.0, 3e5, 5e5, 360), (2, "b", 90000.0, 10.0, 3e5, 0.0, 360), (3, "a", 1000.0, 0.0, 3e5, 5e5, 360), (4, None, 90000.0, 0.0, 3e5, 5e5, 360), (5, "b", 90000.0, 10.0, 4.6e5, 5e5, 360), (None, "b", 90000.0, 10.0, 3e5, 5e5, 360)]
    apps = spark.createDataFrame(people, "app_id long, segment string, income double, debts double, amount double, value double, months int").coalesce(1)
    offers = spark.createDataFrame(sold, "offer_id long, segment string, rate double, offer_max_lvr double")
    want = {}
    for app, segment, income, debts, amount, value, months in people:
        for offer, its, rate, top in sold:
            if segment and its == segment and rate is not None and value:
                free, lvr = income / 12 * 0.7 - debts, amount / value * 100
                pay = amount / months if rate == 0 else amount * rate / 1200 / (1 - (1 + rate / 1200) ** -months)
                if lvr <= min(95.0, 95.0 if top is None else top) and pay <= free:
                    key = (app, offer, round(lvr, 4), round(pay, 2), round(100 * (1 - pay / free), 2))
                    want[key] = want.get(key, 0) + 1
    m = matching.match(apps, offers)
    keys = ["app_id", "offer_id", "lvr", F.round("payment", 2), F.round("score", 2)]
    assert {tuple(r)[:5]: r[5] for r in m.groupBy(*keys).count().collect()} == want and {a for a, *_ in want} == {1, 5, None}
    text = m._jdf.queryExecution().executedPlan().toString()
    assert 0 <= text.find("Generate explode") < text.find("POWER")
    assert m.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_every_part_is_an_option(spark, tmp_path):
    parts = [(k, f"part name {k}", 1 + k % 2) for k in (*range(1, 25), 1499, 1500, 1501, 1507, 20006, 99999)]
    put(spark, tmp_path, "part", parts, "p_partkey long, p_name string, p_size int")
    words = {0: "Owner Occupied", 1: "owner occupied ", 2: "Please choose", 3: "Fixed", 4: "Variable", 5: "NSW", 6: "zzz", 7: "FIXED"}
    want = {}
    for k, name, page in sorted(parts):
        text = words.get(k % 9, name)
        if not text.startswith("Please"):
            want.setdefault((page, k % 3), {}).setdefault(text.strip().lower(), text)
    want = {k: "|".join(v.values()) for k, v in want.items() if len(v) > 1}
    rows = pages.option_groups(spark, str(tmp_path)).collect()
    assert {(r.page_id, r.container): r.options for r in rows} == want
    assert "part name 20006" in " ".join(want.values())


def test_every_line_item_is_an_edge(spark, tmp_path):
    edges = [(7, 407), (407, 12), (12, 7), (12, 900), (900, 5000), (5000, 6), (6, 8), (1, 2), (8, 9), (7, 12)]
    put(spark, tmp_path, "lineitem", [(40 * (i % 3 == 0) + i, a, b) for i, (a, b) in enumerate(edges * 2)], "l_orderkey long, l_partkey long, l_suppkey long")
    want = {7: 0}
    for depth in range(1, 6):
        for at in [a for a, d in want.items() if d == depth - 1]:
            for b in [y for x, y in edges if x == at]:
                want.setdefault(b, depth)
    rows = pages.state_paths(spark, str(tmp_path)).collect()
    assert sorted((r.state, r.depth) for r in rows) == sorted(want.items())
    assert {407, 900, 5000} <= want.keys() and 9 not in want
