import hashlib
from collections import defaultdict

import numpy as np
import pytest

from ratelake.llm import warc as W

EVIL = "x" * 1200 + "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\nWARC/1.1\r\n\r\nyy\r\n\r\n"
ROWS = [(1, "u", EVIL), (2, "u", EVIL), (3, None, None), (4, "a b\r\nWARC/1.1\r\n", ""), (5, "u", "é" * 600), (6, "u", "é" * 600), (7, "u", "WARC/1.1\r\n"), (8, "u", EVIL + "z" * 90000), (9, "u", "k" * 999), (10, "u", "k" * 999), (11, "u", "s"), (12, "u", "Content-Length: 3\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n")]


def want(rows):
    same = defaultdict(list)
    for i, _, h in rows:
        same[h or ""].append(i)
    out = {}
    for h, ids in same.items():
        b = h.encode()
        for i in ids:
            again = len(b) >= 1000 and i != max(ids)
            out[i] = (len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", max(ids) if again else None)
    return out


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip_with_magic_in_payloads(spark, compression):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "'x' AS digest", "7 AS n").repartition(3)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")  # archives are split
    try:
        got = {r.id: (r.n, r.sha1, r.kind, r.refers) for r in W.round_trip(df, compression).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == want(ROWS)


def test_repeated_and_null_ids_and_empty(spark):
    rows = [(1, "u", "q" * 2000), (1, "u", "q" * 2000), (None, "u", "short"), (None, None, "q" * 2000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.id, r.kind, r.refers) for r in W.round_trip(df).collect()), key=str)
    assert got == sorted([(1, "response", None), (1, "response", None), (None, "response", None), (None, "revisit", 1)], key=str)
    assert W.round_trip(df.limit(0)).count() == 0


def test_reachable_rejects_what_no_chain_visits():
    start = np.array([0, 10, 15, 30, 50, 60])
    succ = np.array([10, 30, 20, 60, 60, -1])
    assert W.reachable(start, succ, 0).tolist() == [True, True, False, True, False, True]
    assert not W.reachable(start, succ, 5).any()
    n = 5000
    assert W.reachable(np.arange(n) * 3, np.arange(1, n + 1) * 3, 0).all()


def read_all(df):
    return {r.id: (r.n, r.sha1, r.kind, r.refers) for r in df.collect()}


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_dense_archives_jump_by_joins(spark, monkeypatch, compression):
    """A payload full of magics and would-be records; the joins give what the group gives."""
    monkeypatch.setattr(W, "CHAIN", 50)
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    rows = [*ROWS, (20, "u", fake * 60 + "WARC/1.1\r\n" * 80), (21, None, "after"), (22, "u", fake * 60 + "WARC/1.1\r\n" * 80)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2, "page_id")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        assert read_all(W.round_trip(df, compression)) == want(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_ways_of_chaining_agree(spark):
    rng = np.random.default_rng(4)
    rows = []
    for f in ("a", "b"):
        rel = {0: 0, 1: 0}
        for i in range(120):
            block, span = i // 60, int(rng.integers(12, 40)) if i else len(W.MAGIC)
            rows.append((f, block, rel[block], span, int(rng.choice([-1, span, span * 2])) if i else -1))
            rel[block] += span
    df = spark.createDataFrame([(f, b, r, s, None if z < 0 else z) for f, b, r, s, z in rows], "file string, block long, rel long, span long, size long")
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(W.chained_by_joins(df)) == key(W.chained(df))


def test_a_wrong_reference_is_an_error(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "q" * 2000), (2, "u", "q" * 2000)], "page_id long, url string, html string")
    good = f"file://{tmp_path}/good"
    W.write_warc(W.plan_records(df), good, "none")
    text = "".join(r.value for r in spark.read.text(good, wholetext=True).collect())
    cases = {"lost": text.replace("WARC-Refers-To: <urn:page:2:", "WARC-Refers-To: <urn:page:9:"), "other": text.replace("Content-Length: 2000", "Content-Length: 2001", 2).replace("Content-Length: 2001", "Content-Length: 2000", 1), "payload": text.replace("q" * 2000, "q" * 1999 + "r")}
    for name, changed in cases.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.warc").write_bytes(changed.encode())
        path = f"file://{tmp_path}/{name}"
        assert changed != text
        loose = W.read_warc(spark, path, strict=False)
        assert loose.where("problem IS NOT NULL").count() >= 1, name
        with pytest.raises(Exception, match="names no response|differs from|another digest"):
            W.read_warc(spark, path).select("id", "sha1").collect()
    assert W.read_warc(spark, good).where("problem IS NULL").count() == 2


def test_heads(spark, tmp_path):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "http://a b\tc\u007f/é", "x")], "page_id long, url string, html string")
    W.write_warc(W.plan_records(df), f"file://{tmp_path}/w", "none", date=F.lit("2020-02-03 04:05:06").cast("timestamp"))
    (line,) = [r.value for r in spark.read.text(f"file://{tmp_path}/w", wholetext=True).collect() if r.value]
    assert "WARC-Target-URI: http://a%20b%09c%7F/é\r\n" in line and "WARC-Date: 2020-02-03T04:05:06Z\r\n" in line
    assert W.read_warc(spark, f"file://{tmp_path}/w").first().url == "http://a%20b%09c%7F/é"
