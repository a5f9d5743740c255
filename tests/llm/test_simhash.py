import random
import re

import pytest
import xxhash

from ratelake.llm import simhash as S
from ratelake.llm.common import components, keyed, salted, scratch, save


def brute_fp(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """fps: list of (id, fp); links at 3 bits or fewer."""
    ids = list(range(len(fps)))
    root = ids[:]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids[:i]:
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    out = {}
    for i in ids:
        out.setdefault(find(i), []).append(fps[i][0])
    return {d: min(m) for m in out.values() for d in m}


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "Two words", "A b C", "a b c d", "é É ſ K\u00a0x y z", "w " * 70000, "x" * 50000])
def test_fingerprint(text):
    assert S.fingerprint(None if text is None else text.encode()) == brute_fp(text)


def test_hashes_are_xxh64_for_every_length():
    import numpy as np

    rnd = random.Random(4)
    raw = rnd.randbytes(6000)
    data = np.frombuffer(raw, np.uint8)
    size = [*range(0, 140), 1023, 1024, 1025, 2500]
    start = np.array([rnd.randrange(0, 6000 - n + 1) for n in size])
    stop = start + np.array(size)
    for seed in (0, 42):
        assert S.xxh64(data, start, stop, seed).tolist() == [xxhash.xxh64_intdigest(raw[a:z], seed) for a, z in zip(start, stop)]


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 18])
def test_texts_in_chunks_and_pieces(chunk, monkeypatch):
    import pyarrow as pa

    from ratelake.llm.common import utf8

    monkeypatch.setattr(S, "_CHUNK", chunk)
    rnd = random.Random(chunk)
    texts = [None, "", " ", "\n\t x", "one", " two  words ", "A b C", "\x0bend\x0c"] + ["".join(rnd.choice(["ab", "É", " ", "  ", "\n", "Xyz", "q" * 40, "-"]) for _ in range(rnd.randint(0, 40))) for _ in range(150)]
    off, data = utf8(pa.array(texts, pa.string()))
    assert S.fingerprint_batch(off, data).tolist() == [brute_fp(t) for t in texts]
    part = pa.array(texts, pa.string()).slice(5, 60)
    assert S.fingerprint_batch(*utf8(part)).tolist() == [brute_fp(t) for t in texts[5:65]]


def test_variants_meet_for_every_pair_within_the_radius(spark):
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(4)]
    fps = set(base)
    for x in base:
        for _ in range(150):
            y = x
            for b in rnd.sample(range(64), rnd.choice([1, 2, 3, 4, 5])):
                y ^= 1 << b
            fps.add(y)
    fps = sorted(fps)
    df = spark.createDataFrame([(S._signed(x),) for x in fps], "fp long")
    root = {r.node & (2**64 - 1): r.root for r in components(S.links(df)).collect()}
    want = brute_components([(i, x) for i, x in enumerate(fps)])
    got = {}
    for i, x in enumerate(fps):
        got.setdefault(root.get(x, S._signed(x)), set()).add(i)
    expect = {}
    for i, c in want.items():
        expect.setdefault(c, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expect.values()))


def test_query_against_brute_force(spark, sf):
    from ratelake.llm.queries import op1_simhash_near_dedup

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in op1_simhash_near_dedup(spark, sf).collect()}
    fps = [(r.doc_id, brute_fp(r.text)) for r in docs]
    comp = brute_components(fps)
    assert len(got) == len(docs)
    for d, f in fps:
        assert got[d].fingerprint == f"{f:016x}" and got[d].component_id == comp[d]


def test_edge_rows(spark):
    rows = [(5, None), (4, ""), (9, "same words here now"), (7, "same words here now"), (7, "same words here now"), (None, "quite other words stand here"), (11, "long " * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS variant", "3 AS _key")
    got = sorted(((r.doc_id, r.component_id) for r in S.simhash_components(df.drop("_key")).collect()), key=str)
    assert got == sorted([(5, 4), (4, 4), (9, 7), (7, 7), (7, 7), (None, None), (11, 11)], key=str)
    kept = S.near_dedup(df.drop("_key")).collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted([4, 7, None, 11], key=str)
    empty = df.limit(0).drop("_key")
    assert S.simhash_components(empty).count() == 0 and S.near_dedup(empty).count() == 0


def test_keyed_orders_repeats_and_nulls(spark):
    df = spark.createDataFrame([(3, "b"), (3, "a"), (None, "z"), (1, "q")], "doc_id long, text string")
    k = {(r.doc_id, r.text): r._key for r in keyed(df).collect()}
    assert [x for x, _ in sorted(k.items(), key=lambda x: x[1])] == [(None, "z"), (1, "q"), (3, "a"), (3, "b")]


def test_components_of_a_long_chain_and_a_hub(spark):
    e = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5000, 5000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert len(got) == 699 and all(got[i] == 0 for i in range(1, 301)) and all(got[1000 + i] == 1000 for i in range(1, 400)) and 5000 not in got


def test_components_against_union_find(spark):
    rnd = random.Random(11)
    for n, m in ((60, 40), (400, 380), (300, 1200)):
        e = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)] + [(n + 5, rnd.randrange(n)) for _ in range(30)]
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in e:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        want = {x: find(x) for x in list(root) if find(x) != x}
        assert {r.node: r.root for r in components(spark.createDataFrame(e, "a long, b long")).collect()} == want


def test_a_hub_is_dealt_to_many_tasks(spark):
    """Of a star's edges under a hub that moves, no task gets more than a few salts' share."""
    hub = [(10, 1000 + i) for i in range(6400)] + [(10, 3)]
    big = spark.createDataFrame([(b, a) for a, b in hub], "u long, v long")
    up = spark.createDataFrame([(10, 3)], "v long, m long")
    had = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(had, ("false", "-1", "64")):
            spark.conf.set(k, v)
        from pyspark.sql import functions as F

        sizes = [r["count"] for r in salted(big, up, "v", "u", "left").groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 6401 and max(sizes) < 6401 / 6
    finally:
        for k, v in had.items():
            spark.conf.set(k, v)


def test_many_copies_of_one_text_keep_their_class(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_KEYS", 3)
    rows = [(i, "the same words in all of these") for i in range(50, 90)] + [(i, f"only {i} has words such as {i * 7} here") for i in range(20)]
    got = {r.doc_id: r.component_id for r in S.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 60 and all(got[i] == 50 for i in range(50, 90)) and all(got[i] <= i for i in range(20))


def test_scratch_deletes_what_was_saved_inside(spark):
    df = spark.range(3)
    with scratch() as keep:
        _, a = save(df, "a")
        b_rows, b = save(df, "b")
        keep.append(b)
    assert b_rows.count() == 3
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(a)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
