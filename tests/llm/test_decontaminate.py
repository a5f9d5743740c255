import random
import re
import tracemalloc

import numpy as np
import pytest

from ratelake.llm import decontaminate as D
from ratelake.llm.common import utf8
import pyarrow as pa


def plain_lcs(a, b):
    t = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, t[j] = t[j], last + 1 if x == y else max(t[j], t[j - 1])
    return t[-1]


def test_lcs():
    rnd = random.Random(1)
    for n in (1, 5, 63, 64, 65, 150):
        a, b = ([rnd.randrange(9) for _ in range(n)] for _ in range(2))
        assert D.lcs(D.Judge._masks(a), n, b) == plain_lcs(a, b)


def test_words_hash_alike_wherever_they_stand():
    texts = ["One two, three", "", None, "two", "x" * 50 + " TWO é", "three"]
    off, data = utf8(pa.array(texts, pa.string()))
    (first, count, h), = D.groups(off, data)
    assert first == 0 and count.tolist() == [3, 0, 0, 1, 3, 1]
    assert h[1] == h[3] == h[5] and h[2] == h[7] and len(set(h.tolist())) == 5


def test_long_documents_are_whole(monkeypatch):
    w = [f"w{i}" for i in range(4000)]
    off, data = utf8(pa.array([" ".join(w), "a b"], pa.string()))
    want = [h.tolist() for *_, h in D.groups(off, data)]
    monkeypatch.setattr(D, "CHUNK", 300)
    monkeypatch.setattr(D, "_powers", [])
    got = [h.tolist() for *_, h in D.groups(off, data)]
    assert sum(want, []) == sum(got, []) and len(got[0]) == 4000


@pytest.fixture(scope="module")
def planted(spark):
    rnd = random.Random(7)
    vocabulary = ["".join(rnd.choice(["ta", "ri", "mo", "el", "su"]) for _ in range(rnd.randint(1, 4))) for _ in range(700)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [text(rnd.randint(15, 60)) for _ in range(30)]
    docs, truth = [], set()
    for i in range(600):
        w = text(rnd.randint(5, 400))
        if i % 6 == 0:
            k = rnd.randrange(30)
            x = list(items[k])
            if i % 12 == 0:  # a paraphrase: some words changed, some put in
                for j in rnd.sample(range(len(x)), max(1, len(x) // 8)):
                    x[j] = rnd.choice(vocabulary)
                x.insert(len(x) // 2, "inserted")
            at = rnd.randrange(len(w))
            w[at:at] = x
            truth.add((i, k))
        docs.append((i, " ".join(w)))
    return docs, [(k, " ".join(x) + ".") for k, x in enumerate(items)], truth


def test_recall_and_clean_documents(spark, planted):
    docs, items, truth = planted
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(d, b).collect()}
    assert len(got & truth) >= 0.97 * len(truth) and not got - truth
    assert {(r.doc_id, r.item_id) for r in D.contaminated(d, b, at_once=2000).collect()} == got
    kept = {r.doc_id for r in D.drop_contaminated(d, b, at_once=3000).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in got}


def test_candidates_against_brute_force(spark, planted):
    """Of all pairs that pass the exact check, retrieval finds at least nine in ten."""
    docs, items, _ = planted
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(d, b).collect()}
    every = {(r.doc_id, r.item_id) for r in D.contaminated(d, b, cosine=-2.0).collect()}
    assert got <= every and len(got) >= 0.9 * len(every)


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def plain_holds(doc, item, answer=None):
    """Whether some stretch of one and a half times the item's words holds enough of them in order:
    a checker of its own, at every third place."""
    n, m = len(item), D.ANSWER
    tail = answer or item[-m:]
    if not n or len(set(doc) & set(item)) < 0.5 * len(set(item)):
        return False
    for i in range(0, max(1, len(doc) - n // 2), 3):
        part = doc[i : i + n + n // 2]
        got = plain_lcs(item, part)
        if got >= D.STRICT * n or got >= D.LOOSE * n and plain_lcs(tail, part) >= 0.6 * len(tail):
            return True
    return False


def test_query_against_a_checker_of_its_own(spark, sf):
    """On the tables: every exact passage is found, and at least nine in ten of all that the plain
    checker accepts over all pairs; nothing else."""
    from ratelake.llm.queries import op7_decontaminate

    docs = {r.doc_id: plain_words(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: plain_words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in op7_decontaminate(spark, sf).collect()}
    exact = {(d, i) for d, w in docs.items() for i, x in items.items() if f" {' '.join(x)} " in f" {' '.join(w)} "}
    want = {(d, i) for d, w in docs.items() for i, x in items.items() if plain_holds(w, x)}
    assert exact and exact <= got
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.1 * len(got)


def test_the_index_loses_nothing(planted):
    """The same matches as comparing every passage with every piece, one by one."""
    docs, items, _ = planted
    hashed = [(k, h := D._hashes(t), h[-5:]) for k, t in items]
    rng = np.random.default_rng(1)
    space = rng.standard_normal((D.FEATURES, D.RANK)).astype(np.float32)
    counts = rng.integers(1, 1000, D.FEATURES)
    judge = D.Judge(hashed, space, counts)
    for _, text in docs[:40]:
        h = D._hashes(text)
        got = {item: (n, a) for _, item, n, _, a, _ in judge.found(np.array([len(h)]), h)}
        want = {}
        for item, own, tail in hashed:
            n = len(own)
            step = -(-n // -(-n // D.PIECE))
            for s in range(0, len(h), D.BLOCK):
                x = D.project(h[s : s + 2 * D.BLOCK], np.array([0]), space)
                for i in range(0, n, step):
                    y = D.project(own[i : i + step], np.array([0]), space)
                    part = h[max(0, s - i - n // 4) : s + 2 * D.BLOCK + n - i - len(own[i : i + step]) + n // 4].tolist()
                    lcs = plain_lcs(own.tolist(), part)
                    a = plain_lcs(tail.tolist(), part)
                    if (D.unit(x) @ D.unit(y).T).item() >= D.COSINE and lcs >= D.LOOSE * n and (lcs >= D.STRICT * n or a >= 0.6 * len(tail)):
                        want[item] = max(want.get(item, (0, 0)), (lcs, a))
        assert got == want


def test_pieces_of_a_long_text_change_nothing(planted, monkeypatch):
    docs, items, _ = planted
    hashed = [(k, h := D._hashes(t), h[-5:]) for k, t in items]
    rng = np.random.default_rng(2)
    space = rng.standard_normal((D.FEATURES, D.RANK)).astype(np.float32)
    judge = D.Judge(hashed, space, rng.integers(1, 1000, D.FEATURES), cosine=-2.0)
    parts = [D._hashes(t) for _, t in docs[:200]]
    cases = [(np.array([len(x) for x in parts]), np.concatenate(parts)), (np.array([sum(map(len, parts))]), np.concatenate(parts))]
    want = [list(judge.found(*c)) for c in cases]
    assert len(want[0]) > 20 and len(want[1]) == len({i for _, i, *_ in want[0]})
    for segment, hits in ((64, 1 << 21), (1 << 16, 300), (1 << 16, 1)):
        monkeypatch.setattr(D, "SEGMENT", segment)
        monkeypatch.setattr(D, "HITS", hits)
        assert [list(judge.found(*c)) for c in cases] == want


def test_ten_thousand_items_in_one_pass_with_bounded_memory():
    rng = np.random.default_rng(7)
    common = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    items = [(k, h := rng.choice(common, rng.integers(15, 60)), h[-5:]) for k in range(10_000)]
    space = rng.standard_normal((D.FEATURES, D.RANK)).astype(np.float32)
    text = rng.choice(common, 200_000)
    planted = {int(k): int(k) * 19 + 100 for k in rng.choice(10_000, 200, replace=False)}
    for k, at in planted.items():
        text[at : at + len(items[k][1])] = items[k][1]
    text[-5000:] = items[17][1][0]  # one rare word over and over
    tracemalloc.start()
    judge = D.Judge(items, space, np.ones(D.FEATURES, np.int64))
    got = {r[1] for r in judge.found(np.array([len(text)]), text)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got & set(planted)) >= 0.95 * len(planted) and peak < 400_000_000


def test_long_items_long_words_and_answers(spark, planted):
    docs, items, _ = planted
    rnd = random.Random(3)
    long = " ".join(f"v{rnd.randrange(3000)}" for _ in range(3000))
    word = "y" * 700_000
    b = spark.createDataFrame([(1, long, None), (2, "who wrote the old blue book of seven winds and nine lost rivers", "ana maria"), (3, f"a {word} b c d e f g h i", None)], "item_id long, text string, answer string")
    cut = long.split()
    edited = " ".join(w for i, w in enumerate(cut) if i % 9)
    question = "who wrote the blue book of seven winds"
    d = spark.createDataFrame([(1, docs[1][1] + " " + edited + " " + docs[2][1]), (2, f"{question}. it was ana maria, they say"), (3, question + " and so on"), (4, f"x a {word} b c d e f g h i x"), (5, f"x {word}z b c d")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(d, b, cosine=-2.0).collect()}
    assert got == {(1, 1), (2, 2), (4, 3)}


@pytest.mark.parametrize("n", [1, 50, 300, 301, 1000])
def test_a_word_of_any_length_is_one_word(n, monkeypatch):
    text = ("z" * n + " tail " + "z" * n + "," + "k" * (n + 7)).encode()
    raw = np.frombuffer(text, np.uint8)
    want = [h.tolist() for *_, h in D.groups(np.array([0, len(raw)]), raw)]
    monkeypatch.setattr(D, "CHUNK", 300)
    monkeypatch.setattr(D, "_powers", [])
    got = [h.tolist() for *_, h in D.groups(np.array([0, len(raw)]), raw)]
    assert sum(got, []) == sum(want, []) and len(sum(got, [])) == 4


def test_edges(spark, planted):
    _, items, _ = planted
    b = spark.createDataFrame([*items, (99, None), (98, "..."), (97, "")], "item_id long, text string")
    rows = [(1, None), (2, ""), (3, items[0][1]), (3, items[0][1]), (None, items[1][1].upper()), (4, "q " * 200000 + items[2][1])]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS cosine")
    got = sorted(((r.doc_id, r.item_id) for r in D.contaminated(d, b).collect()), key=str)
    assert got == sorted([(3, 0), (3, 0), (None, 1), (4, 2)], key=str)
    assert sorted(r.doc_id for r in D.drop_contaminated(d, b).collect()) == [1, 2]
    assert D.contaminated(d.limit(0), b).count() == 0 and D.contaminated(d, b.limit(0)).count() == 0
    assert np.isfinite(D.decompose(np.zeros((D.FEATURES, D.SKETCH), np.float32), D._sketch())).all()
