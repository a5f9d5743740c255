"""Hand-made cases for pricing, quality, extraction, sources and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from ratelake.operators import discovery, extract, monitor, nest, pricing, quality, resolve
from ratelake.sources import config, readers, writers
from ratelake.streaming import monitor as stream

C = "product_id long, idx long, lender string, name string, interest_rate double, comparison_rate double, rate_type string, fixed_term_months int, purpose string, repayment_type string, lvr_min double, lvr_max double, lvr_exclusive_max boolean, extraction_method string, confidence int"


def comps(spark, *rows):
    base = dict(product_id=1, idx=0, lender="L", name="N", interest_rate=6.0, comparison_rate=6.1, rate_type="Variable", fixed_term_months=None, purpose="OwnerOccupied", repayment_type="PrincipalAndInterest", lvr_min=0.0, lvr_max=0.8, lvr_exclusive_max=False, extraction_method="jsonld", confidence=80)
    names = [c.split()[0] for c in C.split(", ")]
    return spark.createDataFrame([tuple((base | {"idx": i} | r)[n] for n in names) for i, r in enumerate(rows)], C)


def test_rate_lookup(spark):
    k = comps(spark, {"interest_rate": 5.0, "lvr_max": 0.6}, {"interest_rate": 5.5, "lvr_min": 0.6}, {"interest_rate": 6.5, "lvr_min": 0.8, "lvr_max": 1.0, "lvr_exclusive_max": True})
    probes = spark.createDataFrame([(1, 1, 60.0), (2, 1, 0.7), (3, 1, 100.0), (4, 1, 0.85), (5, 9, 50.0)], "probe_id long, product_id long, lvr double")
    got = {r.probe_id: r.rate for r in pricing.rate_by_lvr(probes, k).collect()}
    assert got == {1: 5.0, 2: 5.5, 3: 5.0, 4: 6.5, 5: 0.0}


def test_single_state_gets_three_null_states_and_scores(spark):
    w = {r.state_id: r for r in pricing.closed_world(comps(spark, {})).collect()}
    assert len(w) == 4 and sum(r.priced for r in w.values()) == 1
    assert w["OO_PI_VAR"].confidence == 60 and w["OO_PI_VAR"].capture_status == "partial"
    assert w["INV_IO_VAR"].confidence == 0 and w["INV_IO_VAR"].extraction_method == "not_attempted"
    # equal band with two rates: the highest stays, 40 points go; the later floor lifts 20 to 30
    w = {r.state_id: r for r in pricing.closed_world(comps(spark, {"confidence": 50}, {"interest_rate": 6.4})).collect()}
    r = w["OO_PI_VAR"]
    assert [t.interest_rate for t in r.rate_tiers] == [6.4] and r.data_quality == "degraded_lvr_overlaps" and r.confidence == 30


def test_fixed_years_and_documents(spark):
    k = comps(spark, {"rate_type": "Fixed", "fixed_term_months": 24}, {"rate_type": "Fixed", "purpose": "Investment", "repayment_type": "Interest Only"})
    p = spark.createDataFrame([(1, "Big & Bank", "Home Loan", None, {"redraw": "yes"}, 0.8, "u")], "product_id long, lender string, name string, short_name string, features map<string,string>, max_lvr double, source_url string").withColumn("collected_at", F.lit("2025-01-02 03:04:05").cast("timestamp"))
    d = json.loads(nest.to_json(nest.state_explicit(k, p)).first().json)
    assert d["product"]["product_id"] == "big-and-bank-home-loan" and d["product"]["fixed_term_years"] == 2
    assert [s["state_id"] for s in d["pricing_states"]] == ["OO_PI_FIX", "OO_IO_FIX", "INV_PI_FIX", "INV_IO_FIX"]
    assert "pricing" not in d["pricing_states"][1] and d["pricing_states"][3]["pricing"]["interest_only_period_years"] == 5
    assert d["features"] == {"offset_account": False, "redraw": True, "package_eligible": False} and d["governance"]["rates_effective_date"] == "2025-01-02"
    api = nest.api(k, p).first()
    assert api.eligibility.repaymentType == ["InterestOnly", "PrincipalAndInterest"] and api.rateTiers[0].lvrMax == 80
    assert nest.api(k, p, strict=False).first().eligibility.repaymentType == ["InterestOnly"]
    h = nest.hierarchical(k).first().loan_types
    assert set(h) == {"OwnerOccupied", "Investment"} and h["OwnerOccupied"]["PrincipalAndInterest"][0].interest_rate == 6.0
    flat = nest.to_flat(nest.state_explicit(k, p)).collect()
    assert len(flat) == 4 and sum(r.interest_rate is not None for r in flat) == 2


def test_gate(spark):
    p = spark.createDataFrame([("L", 1, "ok-slug", "Fixed", None), ("M", 2, "Bad", "Variable", None)], "lender string, product_id long, slug string, rate_type string, fixed_term_years int")
    states = spark.createDataFrame([(1, a, b, True) for a in pricing.LOANS for b in pricing.REPAYMENTS], "product_id long, loan_type string, repayment string, priced boolean")
    tiers = spark.createDataFrame([(1, "Investment", "InterestOnly", 1, 0.0, 0.8, 6.0, 6.1), (1, "Investment", "InterestOnly", 2, 0.0, 0.8, 6.5, 0.0)], "product_id long, loan_type string, repayment string, idx long, lvr_min double, lvr_max double, interest_rate double, comparison_rate double")
    found = quality.issues(p, states, tiers)
    assert sorted((r.lender, r.check) for r in found.collect()) == [("L", "band_conflict"), ("L", "comparison_rate"), ("L", "fixed_term"), ("M", "missing_interest_only"), ("M", "missing_investment"), ("M", "slug")]
    v = {r.lender: r for r in quality.verify(p, found, spark.createDataFrame([("L",), ("M",), ("Z",)], "lender string")).collect()}
    assert (v["L"].confidence, v["L"].completeness, v["L"].status) == (30, 70, "quarantined")
    assert (v["M"].confidence, v["M"].status) == (50, "warning") and (v["Z"].confidence, v["Z"].status) == (0, "quarantined")
    kept, out = quality.quarantine(p, quality.verify(p, found, p.select("lender")))
    assert [r.lender for r in kept.collect()] == ["M"] and out.first().reason == "confidence 30"


def test_confidence(spark):
    limits = spark.createDataFrame([(1, "network_api", 1.0, 2.0)], "product_id long, method string, min_amount double, max_amount double")
    both = comps(spark, {}, {"purpose": "Investment", "repayment_type": "InterestOnly"})
    assert quality.confidence(both, limits).first().confidence == 100
    assert quality.confidence(comps(spark, {}), limits).first().confidence == 50 + 10 + 5 + 5 + 5 + 5 + 10 - 15 - 15
    assert quality.confidence(comps(spark, {"purpose": "OwnerOccupied_Purchase"}), limits).first().confidence == 75


def test_priority_and_first_wins(spark):
    df = spark.createDataFrame([(1, "jsonld", "a"), (1, "jsonld", "b"), (1, "dom_parsing", "c"), (2, "new", "d")], "k int, strategy string, v string")
    assert sorted(r.v for r in resolve.select_strategy(df, ["k"]).collect()) == ["a", "b", "d"]
    assert sorted(r.v for r in resolve.first_wins(df, ["k"], ["v"]).collect()) == ["a", "d"]
    a = resolve.skip_generic(df.where("k = 1").withColumnRenamed("k", "call_id"), df.withColumnRenamed("k", "call_id"))
    assert sorted(r.v for r in a.collect()) == ["a", "b", "c", "d"]


def test_json_sources(spark):
    body = '{"loanProducts":[{"productId":"p","productName":"PN","rateType":"Variable","eligibility":{"loanPurpose":[],"repaymentType":["A","B"]},"rateTiers":[{"lvrMin":0,"lvrMax":80,"interestRate":6.49,"comparisonRate":6.51}]},{"productName":"no tiers"}]}'
    generic = '{"products":[{"name":"Test Product","rate":"6.5","description":"x"},{"name":"none"}],"other":{"name":"hidden","rate":1}}'
    log = spark.createDataFrame([(1, 200, "application/json", body), (2, 200, "application/json", generic), (3, 500, "application/json", generic), (4, 200, "application/json", "{bad"), (5, 200, "text/html", generic), (6, 200, None, None)], "call_id long, status int, content_type string, body string")
    ok = extract.responses(log)
    rows = extract.structured_products(ok).collect()
    assert sorted((r.call_id, r.repayment_type, r.rate, r.lvr_max, r.purpose) for r in rows if r.call_id == 1) == [(1, "A", 6.51, 0.8, "OwnerOccupied"), (1, "B", 6.51, 0.8, "OwnerOccupied")]
    got = extract.generic_products(extract.find_products(ok), "Test Lender").collect()
    assert [(r.call_id, r.name, r.rate) for r in got] == [(2, "Test Lender Test Product", 6.5)]


def test_structured_products_under_pricing_and_in_top_level_lists(spark):
    tier = lambda r: f'{{"lvrMin":0,"lvrMax":80,"interestRate":{r}}}'
    bodies = [
        f'{{"products":[{{"id":"x1","pricing":{{"rateTiers":[{tier(1.5)},{tier(2.5)}]}}}}]}}',
        f' \n[{{"name":"A","rateTiers":[{tier(3.5)}]}},5,{{"id":7,"pricing":{{"rateTiers":[{tier(4.5)}]}}}}]',
        f'{{"items":["z",{{"name":"B","rateTiers":[{tier(5.5)}],"pricing":{{"rateTiers":[{tier(9)}]}}}}]}}',
        f'[{{"name":"C","rateTiers":[],"pricing":{{"rateTiers":[{tier(9)}]}}}}]',
        "[]",
        "[bad",
    ]
    log = spark.createDataFrame([(i, 200, "application/json", b) for i, b in enumerate(bodies)], "call_id long, status int, content_type string, body string")
    rows = extract.structured_products(extract.responses(log)).collect()
    assert sorted((r.call_id, r.seq, r.tier, r.name, r.rate) for r in rows) == [(0, 0, 0, "x1", 1.5), (0, 0, 1, "x1", 2.5), (1, 0, 0, "A", 3.5), (1, 2, 0, "7", 4.5), (2, 1, 0, "B", 5.5)]


def test_containers_have_margin_and_floor_of_variable_rates(spark):
    from ratelake.operators import normalize

    rows = [(1, "Basic Home Loan", ["6.5% p.a"]), (2, "Fixed Home Loan", ["6.1% p.a"]), (3, "Variable Home Loan", ["5.9% p.a", "up to 80% LVR"])]
    got = normalize.containers(spark.createDataFrame(rows, "container_id int, heading string, texts array<string>")).collect()
    assert sorted((r.container_id, r.rate_type, r.margin_pct, r.floor_pct) for r in got) == [(1, "Variable", 1.2, 4.8), (2, "Fixed", None, None), (3, "Variable", 1.2, 4.8)]


def test_pages(spark):
    html = '<h1>Home <b>Loan</b> one</h1><p>6.5% p.a comparison rate 6.71%</p><script>9%</script><h2>Contact us loan</h2><p>1%</p><h2>Fixed Rate loans</h2><p>none</p>'
    ld = '<script type="application/ld+json">{"@type":"FinancialProduct","name":"Test Loan Product","offers":{"price":"6.5"}}</script><script type="application/ld+json">[{"@type":"Product","name":"B 5.5%","offers":[{"price":"from"}]},{"@type":"Thing","name":"x","offers":{"price":"1"}}]</script><script type="application/ld+json">{bad</script>'
    layer = '<script>dataLayer = [{"ecommerce":{"items":[{"name":"Test Product","price":6.5},{"item_name":"T","price":"6"}]}},{"products":[{"name":"P","price":3}]}];</script>'
    df = spark.createDataFrame([(1, html), (2, ld), (3, layer), (4, None), (5, "<div><p>unclosed")], "page_id long, html string")
    h = extract.headings(df).collect()
    assert [(r.heading, r.rate, r.comparison_rate, r.rate_type) for r in sorted(h, key=lambda r: r.heading)] == [("Fixed Rate loans", None, None, "Fixed"), ("Home Loan one", 6.5, 6.71, "Variable")]
    assert sorted((r.name, r.rate) for r in extract.jsonld(df).collect()) == [("B 5.5%", 5.5), ("Test Loan Product", 6.5)]
    assert sorted((r.name, r.rate) for r in extract.datalayer(df).collect()) == [("P", 3.0), ("T", 0.0), ("Test Product", 6.5)]


def test_tier_table(spark):
    rows = [(1, i, label, r) for i, (label, r) in enumerate([("≤ 60%", 5.65), ("≤ 70%", 5.7), ("≤ 80%", 5.8), ("≤ 90%", 6.34), ("> 90%", 6.89), ("Index rate", 7.24)])] + [(2, 0, "≤ 60%", 5.0), (1, 9, "heading", 1.0)]
    got = sorted(tuple(r) for r in extract.lvr_table(spark.createDataFrame(rows, "table_id int, row_idx int, label string, rate double")).collect())
    assert [(x[2], x[3], x[4]) for x in got] == [(0.0, 0.6, False), (0.6, 0.7, False), (0.7, 0.8, False), (0.8, 0.9, False), (0.9, 1.0, True), (0.0, 1.0, False)]
    assert got[-1][-1] == "VariableIndex" and len(got) == 6


def test_options_cards_results(spark):
    html = '<select><option>Please select % p.a</option><option> 6.1% p.a X </option><option>none</option></select><i data-cell="rate">6.1% p.a</i><i data-cell="comparison rate">6.3%</i><a href="/url?q=https%3A%2F%2Fa.com%2Fx&z=1"><a href="https://a.com/x"><a href="https://google.com/">'
    r = spark.createDataFrame([(html,)], "h string").select(extract.options(F.col("h")).alias("o"), extract.card_cells(F.col("h")).alias("c"), extract.result_urls(F.col("h"), "google").alias("u")).first()
    assert r.o == ["6.1% p.a X"] and [(x.name, x.text) for x in r.c] == [("rate", "6.1% p.a"), ("comparison rate", "6.3%")] and r.u == ["https://a.com/x"]
    cards = spark.createDataFrame([(1, "basic-fixed", "", None, [("rate", "6.1%"), ("comparison rate", "6.3%")]), (2, "x", "Name", None, [("rate", "5%")]), (3, "y", "Z", None, [])], "card_id int, element_id string, heading string, head string, cells array<struct<name: string, text: string>>")
    assert sorted(tuple(x) for x in extract.compare_cards(cards).collect()) == [(1, "Basic Fixed", 6.1, 6.3, "Fixed"), (2, "Name", 5.0, 5.0, "Variable")]


def test_monitor(spark):
    df = spark.createDataFrame([(1, "ANZ", "d", "2024-01-10 00:00:00", True, 5), (2, "ANZ", "d", "2024-01-10 05:00:00", False, 0), (3, "CBA", "d", "2024-01-08 00:00:00", True, 2)], "event_id long, lender string, collection_type string, t string, success boolean, products int").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    now = F.lit("2024-01-10 12:00:00").cast("timestamp")
    s = monitor.stats(df, now).first()
    assert (s.total, s.successful, s.failed, s.success_rate) == (1, 0, 1, 0.0)
    assert monitor.health(df, now).first().status == "critical" and monitor.stale(df, now).first().hours_old == 60.0
    assert monitor.stats(df.limit(0), now).first().success_rate == 0.0
    assert [r.event_id for r in monitor.alerts(df, now, 5, 1).collect()] == [2]
    assert {r.lender: r.event_id for r in monitor.catalog(df, True).collect()} == {"ANZ": 1, "CBA": 3}


def test_config(spark):
    s = config.Settings.from_text("schema_version: ${V:-2.0.0}\nverify: 'false'\nmax_rate: 20 # c\nother: x", {})
    assert s.verify is False and s.max_rate == 20.0 and s.extra == {"other": "x"}
    assert config.load_env("A=1\0\n# x\nB='2'") == {"A": "1", "B": "2"}
    k = config.Lenders.load('{"lenders":[{"name":"Bank One","enabled":false},{"lender_name":"B","abbreviation":"BB","priority":2}]}')
    assert [r["lender_name"] for r in k.rows] == ["Bank One", "B"] and config.Lenders.load("{bad").rows[0]["abbreviation"] == "DEF"
    k = k.enable("bank one").add({"name": "C"})
    assert config.enabled(k.frame(spark)).count() == 3
    assert config.Lenders.load(k.to_json()).rows[2]["lender_name"] == "C"
    with pytest.raises(ValueError):
        k.add({"name": "b"})


def test_sinks_and_sources(spark, tmp_path):
    p = f"file://{tmp_path}/current"
    df = spark.createDataFrame([("A", 1), ("B", 2)], "lender string, v int")
    writers.current(df, p)
    writers.current(spark.createDataFrame([("A", 9)], "lender string, v int"), p)
    assert {(r.lender, r.v) for r in readers.current(spark, p).collect()} == {("A", 9), ("B", 2)}
    assert readers.current(spark, p, "B").count() == 1 and readers.current(spark, p + "x").count() == 0
    writers.hash_index(df.select(F.md5("lender").alias("h")), p + "h")
    assert readers.hash_index(spark, p + "h").count() == 2 and readers.hash_index(spark, p + "none").count() == 0
    (tmp_path / "docs/a").mkdir(parents=True)
    (tmp_path / "docs/a/1.json").write_text('{"product_id": "x", "lender": "L",\n "rate": 6.5}')
    (tmp_path / "docs/2.json").write_text("{bad")
    assert [r.product_id for r in readers.products(spark, f"file://{tmp_path}/docs").collect()] == ["x"]
    pages = spark.createDataFrame([(5, "A", "h"), (7, "A", "i")], "page_id long, lender string, html string")
    writers.snapshot(df, p + "s", "2024-01-01-00-00-00", pages)
    assert [r.page_number for r in spark.read.parquet(p + "s/pages").orderBy("page_id").collect()] == [1, 2]
    got, lost, status = readers.multi(spark.createDataFrame([(1, "u1", "h")], "page_id long, url string, html string"), spark.createDataFrame([("L", ["u1", "u2"]), ("M", ["u1"])], "lender_name string, collection_urls array<string>"))
    assert got.count() == 2 and lost.first().url == "u2" and {(r.lender_name, r.status) for r in status.collect()} == {("L", "partial"), ("M", "success")}


def test_discovery(spark):
    q = discovery.search_queries(spark.createDataFrame([("a.com",)], "domain string"))
    assert q.count() == len(discovery.TEMPLATES) and "site:a.com" in q.first().query
    r = spark.createDataFrame([("a.com", "rates_alt", i, f"https://a.com/{i}") for i in range(5)] + [("a.com", "products", 1, "https://a.com/1"), ("a.com", "fees", 0, "https://a.com/f"), ("a.com", "products", 2, "https://a.com/x.pdf")], "domain string, category string, position long, url string")
    u = discovery.lender_urls(r)
    assert u.count() == 5
    assert [x.url for x in discovery.final_urls(u).orderBy("url").collect()] == ["https://a.com/0", "https://a.com/1", "https://a.com/2"]


def test_stream(spark, tmp_path):
    rows = [(1, "A", "d", "2024-01-01 00:10:00", True, 3), (2, "A", "d", "2024-01-01 00:20:00", False, 0), (2, "A", "d", "2024-01-01 00:20:00", False, 0)]
    df = spark.createDataFrame(rows, "event_id long, lender string, collection_type string, t string, success boolean, products int").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    src = f"file://{tmp_path}/in"
    df.write.parquet(src)
    s = stream.read(spark, src, df.schema)
    stream.write(stream.alerts(s), f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    assert [r.event_id for r in spark.read.parquet(f"file://{tmp_path}/out").collect()] == [2]


def test_normalize_raw_rows(spark):
    from ratelake.operators import normalize

    schema = "key_id int, lender string, name string, product_name string, rate_line string, comparison_rate string, term string, rate_type string, description string, features array<string>, fees map<string,string>, lvr_max string, dti_max string, postcode_flags string, source_url string"
    rows = [
        (1, "Bank", "  Test   Product  ", None, "6.49% p.a", "6.8%", "30 years", "Fixed", "with offset account", ["redraw"], {"application": "600", "late": "x"}, "95%", "6.0", '["1","2"]', "u"),
        (2, None, None, None, "invalid", None, "invalid", None, None, None, None, "bad", "bad", "7", None),
        (3, None, None, "Variable Package", None, None, None, "", None, [], {}, None, None, '"one"', None),
    ]
    got = {r.key_id: r for r in normalize.normalize(spark.createDataFrame(rows, schema)).collect()}
    a, b, c = got[1], got[2], got[3]
    assert (a.lender, a.name, a.rate, a.comparison_rate, a.term_months, a.rate_type, a.features) == ("Bank", "Test Product", 6.49, 6.8, 360, "fixed", ["offset", "redraw"])
    assert a.fees == {"application": 600, "ongoing": 0, "late": 0} and (a.lvr_max, a.dti_max, a.postcode_flags) == (95.0, 6.0, ["1", "2"])
    assert (b.lender, b.name, b.rate, b.comparison_rate, b.term_months, b.rate_type, b.features, b.fees) == ("Unknown", "Unknown Product", 6.5, 6.8, 360, "variable", [], {"application": 0, "ongoing": 0})
    assert (b.lvr_max, b.dti_max, b.postcode_flags) == (95.0, None, []) and (c.name, c.rate_type, c.features, c.postcode_flags) == ("Variable Package", "variable", ["package"], ["one"])


def test_controls(spark):
    from ratelake.operators import controls

    o = spark.createDataFrame([(1, 1, 1, "Fixed"), (1, 1, 2, "FIXED"), (1, 1, 3, "Variable"), (1, 2, 4, "alone"), (1, 3, 5, "Please select"), (1, 3, 6, "NSW"), (1, 3, 7, "VIC")], "page_id int, container int, idx int, text string")
    g = {r.container: r for r in controls.groups(o).collect()}
    assert g.keys() == {1, 3} and g[1].options == ["Fixed", "Variable"] and g[1].axis == "rate_type" and g[1].pricing and not g[3].pricing
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "source long, target long")
    assert {r.state: r.depth for r in controls.reachable_states(e, spark.range(1, 2).selectExpr("id AS state"), 3).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}
    r = spark.createDataFrame([("", None, " x ", "y"), (None, None, None, "v")], "a string, b string, c string, d string")
    assert [x.l for x in r.select(controls.radio_label(*map(F.col, "abc"), F.lit(None).cast("string"), F.col("d")).alias("l")).collect()] == ["x", "v"]
    n = spark.createDataFrame([("Borrow how much",), ("deposit",), ("age",)], "t string").select(controls.numeric_input(F.col("t")).alias("n")).collect()
    assert [x.n and (x.n.field, x.n.value) for x in n] == [("loan_amount", 500000), ("deposit", 100000), None]


def test_matching(spark):
    from ratelake.operators import matching

    r = spark.range(1).select(matching.repayment(F.lit(100000.0), F.lit(6.0), F.lit(360)).alias("p"), matching.repayment(F.lit(3600.0), F.lit(0.0), F.lit(36)).alias("z"), matching.lvr_percent(F.lit(80.0), F.lit(0.0)).alias("n")).first()
    assert round(r.p, 2) == 599.55 and r.z == 100.0 and r.n is None


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace as N

    from ratelake.sources.shared import shared_dir

    def session(master, named=None, set_to=None):
        conf = N(get=lambda k, d=None: named)
        return N(conf=conf, sparkContext=N(master=master, applicationId="app-x", getConf=lambda: N(get=lambda k: named), getCheckpointDir=lambda: set_to))

    for master in ("spark://a:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(session(master))
        assert shared_dir(session(master, "hdfs://x/y/")) == "hdfs://x/y/ratelake"
        assert shared_dir(session(master, None, "hdfs://set")) == "hdfs://set/ratelake"
    assert shared_dir(session("local[4]")).startswith("file://") and shared_dir(session("local")) == shared_dir(session("local[*]"))


def test_yaml_of_settings_and_vocabularies():
    from ratelake.sources import yaml

    text = """
# head
a:
  b: "x # y"   # tail
  c: [1, 'two', three]
  d:
    - "p: q"
    - plain
    -
      k: v
    - m: 1
      n: http://h/x
  e:
f: 'it'
g:
- one
- two
"""
    assert yaml.parse(text) == {"a": {"b": "x # y", "c": ["1", "two", "three"], "d": ["p: q", "plain", {"k": "v"}, {"m": "1", "n": "http://h/x"}], "e": None}, "f": "it", "g": ["one", "two"]}
    assert yaml.parse("") is None and yaml.parse("# only") is None
    with pytest.raises(ValueError):
        yaml.parse("a: 1\n   b: 2")


def test_nested_settings_and_vocabulary_files(spark, tmp_path):
    text = "schema:\n  version: '2.0.0'\nvalidation:\n  max_rate: ${MAX:-20}\n  verify: 'false'\nsearch:\n  engines:\n    - name: google\n"
    s = config.Settings.from_text(text, {})
    assert (s.max_rate, s.verify, s.extra["schema.version"], s.extra["search.engines"]) == (20.0, False, "2.0.0", [{"name": "google"}])
    assert config.Settings.from_text(text, {"MAX": "7"}).max_rate == 7.0 and config.Settings.from_text("", {}) == config.Settings()

    from ratelake.functions import lexicon as L

    path = tmp_path / "words.yaml"
    path.write_text("loan_type:\n  phrases:\n    - 'Boat to Live'\n  patterns: [boat]\n  max_words: 2\nlvr_tier:\n  keywords:\n    - ltv\n")
    lex = config.load_lexicon(str(tmp_path / "none.yaml"), str(path))
    df = spark.createDataFrame([("big boat",), ("my very big boat",), ("a boat to live in and on",), ("owner occupied",), (None,)], "t string")
    assert [r.x for r in df.select(L.matches(F.col("t"), "loan_type", lexicon=lex).alias("x")).collect()] == [True, False, True, False, False]
    assert lex.categories["rate_type"] == L.DEFAULT.categories["rate_type"] and lex.categories["lvr_tier"].phrases == ("ltv",)
    path.write_text("loan_type: [broken")
    assert config.load_lexicon(str(path)) == L.DEFAULT and config.load_lexicon(str(tmp_path / "none.yaml")) == L.DEFAULT


def test_hash_index_that_is_no_parquet_counts_as_none(spark, tmp_path):
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "part-0.parquet").write_text("not parquet at all")
    assert readers.hash_index(spark, f"file://{tmp_path}/i").count() == 0 == readers.hash_index(spark, f"file://{tmp_path}/none").count()
    spark.createDataFrame([("a",)], "h string").write.parquet(f"file://{tmp_path}/g")
    assert [r.h for r in readers.hash_index(spark, f"file://{tmp_path}/g").collect()] == ["a"]
    with pytest.raises(Exception):
        readers.hash_index(spark, "nosuchfs://h/x")


def test_page_files_are_whole(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "p.html").write_text("<p>one\ntwo</p>")
    assert [r.html for r in readers.page_files(spark, f"file://{tmp_path}").collect()] == ["<p>one\ntwo</p>"]


def test_tier_tables_of_pages(spark):
    table = "<table><tr><th>LVR Tier</th><th>Comparison Rate (p.a.)</th></tr>" + "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in [("≤ 60%", "5.65%"), ("≤ 70%", "5.70%"), ("≤ 80%", "5.80%"), ("≤ 90%", "6.34%"), ("> 90%", "6.89%"), ("Index rate", "7.24%")]) + "</table>"
    pages = [(1, table), (2, table.replace("LVR Tier", "Band")), (3, "<table><tr><td>LVR</td></tr></table>"), (4, None), (5, "<table><tr><th>lvr</th><th>%</th></tr><tr><td>≤ 80%</td><td>5%</td></tr></table>")]
    rows = extract.tier_rows(spark.createDataFrame(pages, "page_id long, html string")).withColumn("table_id", F.struct("page_id", "table_idx"))
    got = [(r.table_id.page_id, r.lvr_min, r.lvr_max, r.lvr_exclusive_max, r.rate, r.rate_type) for r in extract.lvr_table(rows).orderBy("table_id", "row_idx").collect()]
    assert got == [(1, 0.0, 0.6, False, 5.65, "Variable"), (1, 0.6, 0.7, False, 5.7, "Variable"), (1, 0.7, 0.8, False, 5.8, "Variable"), (1, 0.8, 0.9, False, 6.34, "Variable"), (1, 0.9, 1.0, True, 6.89, "Variable"), (1, 0.0, 1.0, False, 7.24, "VariableIndex")]


def test_card_rates_without_a_sign(spark):
    cards = spark.createDataFrame([(1, "x", "Name", None, [("rate", "5.99"), ("comparison rate", "from 6.10 p.a.")]), (2, "x", "None", None, [("rate", "call us")])], "card_id int, element_id string, heading string, head string, cells array<struct<name: string, text: string>>")
    assert [tuple(r) for r in extract.compare_cards(cards).collect()] == [(1, "Name", 5.99, 6.1, "Variable")]
