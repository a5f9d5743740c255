import random
import re

import pytest

from ratelake.llm import urls as U


def test_hosts_paths_rules_and_terms(spark):
    rows = [
        (1, "http://A.Example.ORG/es/1", "a.example.org", "/es/1", "example.org/es/", "block"),
        (2, "http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        (3, "http://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"),
        (4, "https://x.com/fr/casino", "x.com", "/fr/casino", "com/fr/", "allow"),
        (5, "https://x.com/de/?q=/", "x.com", "/de/", "com/de/", "block"),
        (6, None, "", "", None, "allow"),
        (7, "no scheme casino", "", "", None, "block"),
        (8, "http://example.org", "example.org", "", None, "allow"),
        (9, "http://h.net?x=http://y.org/", "h.net", "", None, "allow"),
        (16, "http://h.net/c%61sino", "h.net", "/c%61sino", None, "block"),
        (17, "http://h.net/%E9casino", "h.net", "/%E9casino", None, "allow"),
        (18, "http://h.net/sexes", "h.net", "/sexes", None, "allow"),
        (19, "http://h.net/loan-pret-gratis", "h.net", "/loan-pret-gratis", None, "block"),
        (20, "http://h.net/win-win-loan", "h.net", "/win-win-loan", None, "allow"),
        (21, "http://h.net/poker-loan", "h.net", "/poker-loan", None, "allow"),
        (22, "http://h.net/poker+bets", "h.net", "/poker+bets", None, "block"),
        (10, "http://free-bonus.net/a", "free-bonus.net", "/a", None, "block"),
        (11, "http://free.free.net/a", "free.free.net", "/a", None, "allow"),
        (12, "http://casinoz.net/essex", "casinoz.net", "/essex", None, "allow"),
        (13, "http://É.net/écasino", "É.net", "/écasino", None, "block"),
        (14, "x://h.net/a\nb#c", "h.net", "/a\nb", None, "allow"),
        (15, "http://h.net/" + "a" * 50000 + "/xxx", "h.net", "/" + "a" * 50000 + "/xxx", None, "block"),
    ]
    df = spark.createDataFrame([(r[0], r[1]) for r in rows] + [(1, rows[0][1])], "page_id long, url string").selectExpr("*", "1 AS host", "'r' AS rule")
    got = [tuple(r) for r in U.digest(df).collect()]
    want = [(i, h, p, r, v) for i, _, h, p, r, v in rows] + [(1, *rows[0][2:])]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert U.digest(df.limit(0)).count() == 0


def plain_weight(url, terms):
    """Each term looked for on its own."""
    u = U.decoded(url or "")
    return sum(w for t, w in terms if re.search(f"(?<![a-z0-9A-Z]){re.escape(t)}(?![a-z0-9A-Z])", u))


def test_terms_against_plain_search():
    rnd = random.Random(5)
    terms = [("ab", 100), ("b-a", 34), ("a", 50), ("aab", 20), ("é", 7), ("b", 34)]
    a = U.automaton(terms)
    for _ in range(2000):
        u = "".join(rnd.choice(["a", "b", "-", "/", "é", "B", "%61", "%zz", "%E9", "1"]) for _ in range(rnd.randint(0, 9)))
        assert sum(U.found_terms(a, u).values()) == plain_weight(u, terms)


def test_soft_terms_alone_block_and_the_vocabulary_is_a_table(spark, tmp_path):
    """With soft terms weighing nothing the same urls pass."""
    df = spark.createDataFrame([(1, "http://a.net/red/blue"), (2, "http://a.net/red/red"), (3, "http://a.net/green")], "page_id long, url string")
    (tmp_path / "terms.csv").write_text("term,weight\nred,50\n Blue ,50\ngreen,100\nred,10\n,100\n")
    terms = U.read_terms(spark, f"file://{tmp_path}/terms.csv")
    assert terms == [("blue", 50), ("green", 100), ("red", 50)]
    verdicts = lambda t: {r.page_id: r.verdict for r in U.judge(df, terms=t).collect()}
    assert verdicts(terms) == {1: "block", 2: "allow", 3: "block"}
    assert verdicts([(t, w) for t, w in terms if w == 100]) == {1: "allow", 2: "allow", 3: "block"}
    assert verdicts([]) == {1: "allow", 2: "allow", 3: "allow"}


def test_urls_that_a_rule_decides_are_not_searched(spark):
    df = spark.createDataFrame([(1, "http://a.org/casino"), (2, "http://a.net/casino")], "page_id long, url string")
    assert {r.page_id: r.terms for r in U.judge(df).collect()} == {1: [], 2: ["casino"]}


def test_too_many_terms_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(U, "MAX_TERMS", 3)
    with pytest.raises(ValueError):
        U.terms_of(spark.range(5).selectExpr("cast(id as string) term", "1 weight"))
