import math
import random
import re

from ratelake.llm import licenses as L


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def plain_best(w, template, threshold, stretch=L.STRETCH):
    """Containment in the best of all blocks, each counted on its own; null below the threshold."""
    t = plain_words(template)
    size = math.ceil(stretch * len(t))
    share = max((len(set(t) & set(w[i : i + size])) for i in range(max(1, len(w) - size + 1))), default=0) / len(set(t))
    return share if share >= threshold - 1e-9 else None


def plain_scan(text, templates):
    w = plain_words(text)
    places = [(i, label) for p, label in L.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    best = {k: s for k, (t, th) in templates.items() if (s := plain_best(w, t, th)) is not None}
    base, at = {x for _, x in places}, [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | best.keys())), max([1.0 if base else 0.0, *best.values()])


def test_query_against_brute_force(spark, sf):
    from ratelake.llm.queries import op8_license_scan

    by = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = op8_license_scan(spark, sf).collect()
    assert len(got) == len(by)
    for r in got:
        want = plain_scan(by[r.doc_id], L.DEFAULT)
        assert tuple(r)[1:7] == want[:6] and abs(r.score - want[6]) < 1e-9


def test_edge_rows(spark):
    mit = L.TEMPLATES["mit"]
    rows = [(0, None), (1, ""), (2, "CC BY cc by"), (3, "x " * 500 + mit.replace(" ", "\n") + " y" * 900), (4, " ".join(mit.split()[:20])), (5, "mit license gnu general PUBLIC license"), (5, "mit license gnu general PUBLIC license"), (6, "ccby cc.by é cc bye"), (7, "the word " * 60_000 + L.TEMPLATES["bsd"]), (8, "Licensed under CC BY-NC 4.0."), (9, "Licensed under CC BY-ND 4.0.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS labels")
    got = L.scan(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id != 7:
            assert tuple(r)[1:7] == plain_scan(dict(rows)[r.doc_id], L.DEFAULT)[:6]
    label = {r.doc_id: r.labels for r in got}
    assert label[3] == "mit" and label[7] == "bsd" and label[8] == "cc-by,cc-by-nc-4.0-notice" and label[9] == "cc-by" and label[4] == ""
    assert L.scan(df.limit(0)).count() == 0


def test_long_templates_match_wherever_they_stand(spark):
    """Templates of up to 1200 words, whole and edited, at many offsets; the base phrases find none."""
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(4000)]
    templates = {f"t{n}": (" ".join(rnd.choice(vocabulary) for _ in range(n)), 0.8) for n in (12, 200, 400, 1200)}
    rows, planted = [], {}
    for i in range(120):
        label = rnd.choice(list(templates))
        t = templates[label][0].split()
        for j in rnd.sample(range(len(t)), int(len(t) * rnd.choice([0, 0.05, 0.1, 0.3]))):
            t[j] = rnd.choice(["edited", rnd.choice(vocabulary)])
        noise = [rnd.choice(vocabulary) for _ in range(rnd.randrange(900))]
        at = rnd.randrange(len(noise) + 1)
        rows.append((i, " ".join(noise[:at] + t + noise[at:])))
        planted[i] = label
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates=templates).collect()}
    for i, text in rows:
        w = text.split()
        want = {k: s for k, (t, th) in templates.items() if (s := plain_best(w, t, th)) is not None}
        assert got[i].labels == ",".join(sorted(want)) and got[i].base_labels == ""
        assert abs(got[i].score - max([0.0, *want.values()])) < 1e-9
    found = sum(planted[i] in got[i].labels.split(",") for i in planted)
    assert 60 < found < 120  # edits of three in ten lose it


def test_filters_change_nothing():
    rnd = random.Random(8)
    for _ in range(300):
        vocabulary = [f"w{i}".encode() for i in range(rnd.choice([6, 30]))]
        templates = {f"t{k}": ([rnd.choice(vocabulary) for _ in range(rnd.randint(0, 12))], rnd.choice([0.5, 0.8, 1.0])) for k in range(4)}
        w = [rnd.choice([*vocabulary, b"x", b"y", b"z"]) for _ in range(rnd.randint(0, 60))]
        index = L.Index(templates, {v: rnd.randrange(5) for v in vocabulary})
        want = {k: s for k, (t, th) in templates.items() if t and (s := plain_best([x.decode() for x in w], b" ".join(t).decode(), th)) is not None}
        assert index.match(w).keys() == want.keys() and all(abs(index.match(w)[k] - want[k]) < 1e-9 for k in want)


def test_templates_from_a_folder(spark, tmp_path):
    (tmp_path / "house.rules.txt").write_text("no running\nin the long hall")
    assert L.read_templates(spark, f"file://{tmp_path}") == {"house.rules": ("no running\nin the long hall", L.THRESHOLD)}
