from collections import defaultdict

import pytest

from ratelake.llm import mixing


def water_fill(sizes: dict, weights=(5, 2, 1), share=1.5, cap=2.0) -> dict:
    """Targets by repeated resharing, source by source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), dict.fromkeys(order, 0.0)
    while free and left > 1e-9:
        unit = left / sum(w[s] for s in free)
        full = {s for s in free if out[s] + unit * w[s] >= cap * sizes[s] - 1e-9}
        if not full:
            for s in free:
                out[s] += unit * w[s]
            break
        for s in full:
            left -= cap * sizes[s] - out[s]
            out[s] = cap * sizes[s]
        free -= full
    return out


@pytest.mark.parametrize("sizes", [{"a": 900, "b": 50, "c": 60, "d": 400}, {"a": 10, "b": 10, "c": 1000, None: 300}, {"z": 0, "b": 7}, {"x": 5}])
def test_targets_match_repeated_resharing(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = water_fill(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s], abs=1e-6)


def test_copies_and_edge_rows(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 4}") for i in range(2000)] + [(5000, None, None), (5001, "", "s1"), (5002, "x " * 30000, None), (5003, "a b", "s0"), (5003, "a b", "s0"), (None, "q", "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS copy_of")
    got = mixing.digest(df).collect()
    assert len(got) == len(rows)
    taken, target = defaultdict(int), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    for s, t in target.items():
        if s > 1000 and s < 30000:
            assert taken[s] == pytest.approx(t, rel=0.15)
    assert sorted(mixing.digest(df).collect(), key=str) == sorted(got, key=str)
    out = mixing.mix(df)
    assert out.columns == ["doc_id", "text", "source", "size", "copy_of", "mix_size", "copy"]
    assert out.where("mix_size > 0").count() == sum(r.taken // r.size for r in got if r.size) and out.where("size <> 1 OR copy_of <> 2").count() == 0


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([(1, "a b c", "s", 7, "x", 9, 1.5, "k")], "doc_id long, text string, source string, size int, copy string, mix_size int, target double, __row string")
    out = mixing.mix(df)
    assert out.columns == [*df.columns, "mix_mix_size", "mix_copy"]
    rows = out.collect()
    assert rows and all(tuple(r)[:8] == tuple(df.first()) and r.mix_mix_size == 3 for r in rows) and [r.mix_copy for r in rows] == list(range(len(rows)))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.digest(df).count() == 0 and mixing.mix(df).count() == 0
