import hashlib
import random

import numpy as np
import pytest

from ratelake.llm import suffix as X


def brute(rows, n=100):
    seen, out = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            w = b[p : p + n]
            if w in seen:
                gone[p : p + n] = b"\1" * n
            else:
                seen[w] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows():
    rnd = random.Random(5)
    bits = ["a", "of", "the", "ñandú", "tion", "ère", "wh", "edsh", "in"]
    text = lambda n: " ".join(rnd.choice(bits) + rnd.choice(bits) for _ in range(n))
    shared = [text(k) for k in (12, 16, 18, 22, 40, 100)]
    out = []
    for i in range(200):
        out.append((i * 3, " ".join(rnd.choice(shared) if rnd.random() < 0.5 else text(rnd.randint(1, 40)) for _ in range(rnd.randint(1, 5)))))
    out += [(2000, None), (2001, ""), (2002, "a" * 5000), (2003, "ab" * 800), (2004, out[5][1]), (2005, "x" * 99), (2006, "x" * 100), (2007, "a" * 101), (2008, out[7][1] * 3)]
    return out


def run(spark, data):
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 AS doc", "2 AS h").repartition(5)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in X.digest(df).collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:  # every key is hot, chunks cut documents, texts are tiny
        monkeypatch.setattr(X.expand, "__defaults__", (3, 2000))
        monkeypatch.setattr(X, "CHUNK", 700)
        monkeypatch.setattr(X, "COMBINE", 300)
    data = rows()
    assert run(spark, data) == brute(data)


def test_repeated_rows_and_null_ids(spark):
    a = "word%d " * 60 % tuple(range(60))
    data = [(1, a), (1, a), (None, a + "tail"), (2, "b" * 300), (1, "c" + a)]
    assert run(spark, data) == brute(data)


def test_dedup_text_cuts_and_keeps_columns(spark):
    a = "é word%d " * 60 % tuple(range(60))
    df = spark.createDataFrame([(1, "s", a, 5), (2, None, "x " + a + " y", 6), (3, "s", None, 0)], "doc_id long, doc string, text string, n_chars long")
    got = {r.doc_id: r for r in X.dedup_text(df).collect()}
    assert got[1].text == a and got[2].text == "x  y" and got[2].n_chars == 4 and got[3].text is None
    assert X.dedup_text(df).columns == df.columns and X.dedup_text(df.limit(0)).count() == 0


def test_classes_are_those_of_equal_prefixes():
    rnd = random.Random(1)
    for n in (1, 2, 50, 3000):
        text = np.array([rnd.choice(b"ab") for _ in range(n)], np.uint8)
        got = X.classes(text, 12)
        ring = bytes(text) * (12 // n + 2)
        names = {}
        for i in range(n):
            assert names.setdefault(ring[i : i + 12], got[i]) == got[i]
        assert len(set(names.values())) == len(names)


def test_slide_and_anchor_choice():
    x = np.array([5, 3, 8, 1, 9, 2, 7], np.uint64)
    assert X._slide(x, 3, np.minimum).tolist() == [3, 1, 1, 1, 2]
    rnd = np.random.default_rng(0)
    w = rnd.integers(97, 100, 100).astype(np.uint8)
    for _ in range(20):  # a window's anchors depend on the window alone
        b = np.concatenate([rnd.integers(97, 100, 90), w, rnd.integers(97, 100, 60)]).astype(np.uint8)
        at, _ = X.anchors(b, np.full(len(b), len(b)))
        low = X._kmers(w)
        first = int(np.flatnonzero(low == low.min())[0])
        assert 90 + first in at


class Run:
    """Stands for a DataFrame: gives the function that would run on its batches."""

    def __getattr__(self, name):
        return lambda *a, **k: self

    def mapInArrow(self, run, schema):
        return run


def test_small_chunks_and_combines_lose_no_fragment(spark, monkeypatch):
    data = [(i, t) for i, t in rows()]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in data]), pa.array([t for _, t in data], pa.string())], names=["doc", "text"])
    whole = pa.Table.from_batches(X.emit_anchors(Run(), "doc", "text")(iter([batch]))).to_pylist()
    monkeypatch.setattr(X, "CHUNK", 700)
    monkeypatch.setattr(X, "COMBINE", 300)
    small = pa.Table.from_batches(X.emit_anchors(Run(), "doc", "text")(iter([batch]))).to_pylist()
    names = lambda out: {(r["h"], r["f"]) for r in out if r["t"] == 0 and r["f"] != X.FIRST}
    assert names(whole) == names(small) and len(small) > len(whole)
    by = {i: (t or "").encode() for i, t in data}
    for r in whole + small:
        if r["t"] == 1:  # a claim: [f, pos) repeats src from at on
            assert by[r["doc"]][r["f"] : r["pos"]] == by[r["src"]][r["at"] : r["at"] + r["pos"] - r["f"]]
            assert (r["src"], r["at"]) < (r["doc"], r["f"])


def test_wrong_claims_remove_nothing(spark):
    """Equal hashes are only a hint: a claim whose bytes differ is not followed."""
    rnd = random.Random(3)
    a, b = bytes(rnd.choices(b"xyz w", k=200)), bytes(rnd.choices(b"abcdef", k=200))
    bucket = [(1, X.FIRST, 10, 0, 0, X.ALL, 0, a), (1, 5, 20, 7, 0, X.ALL, 0, a[:150]), (1, 6, 30, 0, 0, X.ALL, 0, b), (1, 7, 40, 0, 0, X.ALL, 3, a[3:140]), (1, 8, 50, 0, 0, X.ALL, 3, a[4:150])]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*bucket), X._FRAG_TYPES)], names=[x.split()[0] for x in X.FRAG.split(", ")])
    out = [(r["doc"], r["f"], r["a"]) for b in X.expand(Run())(iter([batch])) for r in b.to_pylist()]
    # two by the expansion, one of them not where it claims to be, one by its bytes
    assert sorted(out) == [(20, 7, 157), (40, 0, 137), (50, 0, 146)]


def test_claims_merge_by_source_and_distance():
    c = [(1, 0, 168, 0, 50), (1, 34, 202, 0, 84), (1, 300, 400, 0, 350), (1, 100, 200, 9, 0), (2, 0, 150, 0, 50)]
    got = sorted(zip(*(x.tolist() for x in X._claims(*(np.array(v, np.int64) for v in zip(*c))))))
    assert got == [(1, 0, 202, 0, 50), (1, 100, 200, 9, 0), (1, 300, 400, 0, 350), (2, 0, 150, 0, 50)]


def test_a_hot_passage_and_a_common_line(spark, monkeypatch):
    """One passage in every document and one line with a context of its own in each; few claims a
    bucket, so the hot stretch of source gets many."""
    monkeypatch.setattr(X, "CLAIMS", 8)
    monkeypatch.setattr(X, "HOT_KEYS", 4)
    monkeypatch.setattr(X, "HOT", 20)
    monkeypatch.setattr(X.expand, "__defaults__", (20, 5000))
    monkeypatch.setattr(X, "GRID", 512)
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9)))
    passage, line = " ".join(word() for _ in range(900)), " ".join(word() for _ in range(14))
    data = [(i, " ".join([word(), passage, word(), word()])) for i in range(60)] + [(100 + i, " ".join([*(word() for _ in range(20)), line, *(word() for _ in range(20))])) for i in range(80)]
    assert run(spark, data) == brute(data)


def settled(rows, size):
    """What ``settle`` gives for fragment rows (h, f, doc, place) of many tasks, by batches."""
    import pyarrow as pa

    names = "t p h f doc pos src at".split()
    emitted = []
    for task in rows:
        held = [tuple(np.array(x) for x in zip(*task))]
        held = [(np.array(h, np.int64).view(np.uint64), np.array(f, np.int64).view(np.uint64), np.array(d, np.int64), np.array(a, np.int64) << 16 | 10 << 8 | 60) for h, f, d, a in held]
        run = X.emit_anchors(Run(), "doc", "text")
        combine = dict(zip(run.__code__.co_freevars, (c.cell_contents for c in run.__closure__)))["combine"]
        emitted += [r for b in combine(held) for r in b.to_pylist()]
    emitted.sort(key=lambda r: tuple(r[c] for c in ("p", "h", "f", "doc", "pos")))
    table = pa.Table.from_pylist(emitted, schema=pa.schema([(n, pa.int8() if n == "t" else pa.int64()) for n in names]))
    return [r for b in X.settle(Run())(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]


@pytest.mark.parametrize("size", [1, 2, 7, 10_000])
@pytest.mark.parametrize("many", [2, 3, 64])
def test_settling_by_batches_and_tasks(spark, monkeypatch, size, many):
    """Every fragment of an anchor with several goes on once at least, lone ones don't; later copies
    are claims, whatever batches and tasks rows come in."""
    monkeypatch.setattr(X, "MANY", many)
    rnd = random.Random(size * 100 + many)
    rows = sorted({(rnd.randrange(30) * 2, rnd.randrange(6) if rnd.random() < 0.7 else 1, rnd.randrange(40), rnd.randrange(1, 50) * 400) for _ in range(400)} | {(100, 1, 3, 400), (102, 5, 1, 400), (102, 5, 2, 400)})
    tasks = [rows[i::3] for i in range(3)]
    out = settled(tasks, size)
    fragments = {}
    for h, f, d, a in rows:
        fragments.setdefault(h, {}).setdefault(f, []).append((d, a))
    went = {(r["h"], r["doc"], r["b"] >> 16) for r in out if r["t"] == 0}
    for h, by in fragments.items():
        for f, places in by.items():
            assert ((h, *min(places)) in went) == (len(by) > 1)
    covered = {}
    for r in out:
        if r["t"] == 1:
            assert (r["src"], r["at"]) < (r["doc"], r["a"])
            covered.setdefault(r["doc"], []).append((r["a"], r["b"]))
    for h, by in fragments.items():
        for f, places in by.items():
            for d, a in set(places) - {min(places)}:
                gone = any(s <= a - 10 and a + X.KMER + 60 <= e for s, e in covered.get(d, []))
                assert gone or (h, d, a) in went


def test_cover_holds_every_window_with_few_intervals():
    rnd = random.Random(2)
    for _ in range(300):
        rows = sorted((rnd.randrange(3), s := rnd.randrange(400), s + X.LENGTH + rnd.randrange(90)) for _ in range(rnd.randint(0, 40)))
        doc, a, b = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
        keep = X._cover(doc, a, b)
        windows = lambda which: {(int(doc[i]), w) for i in which for w in range(a[i], b[i] - X.LENGTH + 1)}
        assert windows(keep) == windows(range(len(rows))) and len(set(keep)) == len(keep)
    n = 1000  # a period of three: one in about twenty is enough
    assert len(X._cover(np.zeros(n, np.int64), np.arange(n) * 3, np.arange(n) * 3 + 168)) < 60


def test_an_anchor_with_many_fragments_in_one_task_and_few_in_another(spark):
    """Both tasks' fragments must be halved alike, or windows they share never meet."""
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    line = min((word(60) for _ in range(3000)), key=lambda t: X._kmers(np.frombuffer(t.encode(), np.uint8)).min())  # holds the anchor of all around it
    many = [(i, word(200) + line + word(200)) for i in range(X.MANY + 16)]
    few = [(1000 + i, word(150) + t[160:300] + word(150)) for i, (_, t) in enumerate(many[:20])]
    few += [(2000 + i, word(150)) for i in range(len(many) - len(few))]
    df = spark.createDataFrame(spark.sparkContext.parallelize(many + few, 2), "doc_id long, text string")  # a task each
    assert sorted(tuple(r) for r in X.digest(df).collect()) == sorted(brute(many + few))


@pytest.mark.parametrize("size", [1, 3, 10_000])
def test_fragments_of_an_anchor_go_on_at_one_depth(spark, size):
    some = lambda n, doc: [(101, f, doc, 400 + f) for f in range(1, n + 1)]
    out = settled([some(X.MANY, 1), some(3, 2) + [(103, 1, 2, 900), (103, 2, 2, 950)]], size)
    assert {r["a"] for r in out if r["h"] == 101} == {1} and {r["a"] for r in out if r["h"] == 103} == {0}
    assert {(r["doc"], r["b"] >> 16) for r in out if r["h"] == 101} >= {(d, a) for _, _, d, a in some(3, 2)}
