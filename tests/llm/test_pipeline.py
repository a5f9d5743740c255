import hashlib

import corpus_pipeline as P
from ratelake.llm import decontaminate, suffix, toxicity
from ratelake.llm.common import table

from .test_decontaminate import plain_holds, plain_words
from .test_mixing import water_fill
from .test_simhash import brute_components, brute_fp


def kept_bytes(rows, n=suffix.LENGTH):
    """Texts without the bytes that a string of n bytes covers which also starts earlier."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if (w := b[p : p + n]) in seen:
                gone[p : p + n] = b"\1" * n
            else:
                seen.add(w)
        out[i] = bytes(c for c, g in zip(b, gone) if not g).decode(errors="ignore") if t is not None else None
    return out


def plain_mix(rows):
    """Copies of each document (id, text, source): floor of the rate and one more by its draw."""
    size = {i: len((t or "").split()) for i, t, _ in rows}
    per = {}
    for i, _, s in rows:
        per[s] = per.get(s, 0) + size[i]
    target = water_fill(per)
    out = {}
    for i, _, s in rows:
        rate = target[s] / per[s] if per[s] else 0.0
        u = int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
        out[i] = int(rate) + (u < rate - int(rate))
    return {i: n for i, n in out.items() if n}


def test_stages_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    cols = docs.columns
    rows, d = {}, docs
    for name, stage in P.STAGES:
        d = stage(spark, d, sf).cache()
        rows[name] = d.collect()
        if name != "mix_sources":
            assert d.columns == cols
    assert list(rows) == ["toxicity", "simhash_near_dedup", "suffix_dedup", "decontaminate", "mix_sources"]
    text = {name: {r.doc_id: r.text for r in x} for name, x in rows.items()}
    scores = {r.doc_id: r.predicted for r in toxicity.digest(docs, table(spark, sf, "labels")).collect()}
    assert set(text["toxicity"]) == {i for i, p in scores.items() if not p}
    comp = brute_components([(i, brute_fp(t)) for i, t in text["toxicity"].items()])
    assert text["simhash_near_dedup"] == {i: text["toxicity"][i] for i in set(comp.values())}
    assert text["suffix_dedup"] == kept_bytes(text["simhash_near_dedup"].items())
    assert all(r.n_chars == len(r.text or "") for r in rows["suffix_dedup"])
    items = [plain_words(r.text) for r in table(spark, sf, "benchmark").collect()]
    gone = set(text["suffix_dedup"]) - set(text["decontaminate"])
    for i, t in text["suffix_dedup"].items():
        w = plain_words(t)
        whole = any(f" {' '.join(x)} " in f" {' '.join(w)} " for x in items)
        assert i in gone if whole else i not in gone or any(plain_holds(w, x) for x in items)
    assert all(text["decontaminate"][i] == text["suffix_dedup"][i] for i in text["decontaminate"])
    assert decontaminate.contaminated(spark.createDataFrame(rows["decontaminate"], docs.schema), table(spark, sf, "benchmark")).count() == 0
    want = plain_mix([(r.doc_id, r.text, r.source) for r in rows["decontaminate"]])
    copies = {}
    for r in rows["mix_sources"]:
        assert r.text == text["decontaminate"][r.doc_id] and r.size == len((r.text or "").split())
        copies.setdefault(r.doc_id, []).append(r.copy)
    assert {i: sorted(c) for i, c in copies.items()} == {i: list(range(n)) for i, n in want.items()}


def test_the_registered_query_gives_the_last_stage(spark, sf):
    d = table(spark, sf, "documents")
    for _, stage in P.STAGES:
        d = stage(spark, d, sf)
    key = lambda x: sorted((r.doc_id, r.copy, r.size) for r in x.select("doc_id", "copy", "size").collect())
    assert key(P.run(spark, sf)) == key(d)


def test_rows_with_gaps_pass_all_stages(spark, sf):
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (2, "", "en", None, 0), (None, "some words", "en", "s", 10), (3, "w " * 40000, "en", "s", 80000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS size", "2 AS score", "3 AS _key2")
    seen = []
    for _, stage in P.STAGES:
        d = stage(spark, d, sf)
        seen.append(sorted({r.doc_id for r in d.collect()}, key=str))
    # 1 and both rows of 2 have no words and are one class; texts without words are not mixed
    assert seen == [[1, 2, 3, None], [1, 3, None], [1, 3, None], [1, 3, None], [3, None]]
    out = d.collect()
    assert d.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "score", "_key2", "mix_size", "copy"]
    assert all(r.size == 1 and r.score == 2 and r.text == "w " for r in out if r.doc_id == 3) and {r.mix_size for r in out} == {1, 2}  # all windows from the third byte on start earlier
    e = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        e = stage(spark, e, sf)
    assert e.count() == 0
