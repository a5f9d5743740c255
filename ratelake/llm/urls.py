"""URL filtering: host and path rules, then a weighted vocabulary found by Aho-Corasick.

Rules are (verdict, "host/path prefix"); one fits its host and all subdomains where the
path starts with the rule's, and the longest rule that fits decides.  Urls that no rule
decides are searched for the terms of a vocabulary, a table of (term, weight), with an
Aho-Corasick automaton; a hit counts only where the characters beside it are no ASCII
letters or digits.  A term of weight STRICT blocks alone, softer ones where the weights of
the distinct terms found add up to STRICT.  Percent escapes are decoded first, if the
url then is valid UTF-8.

Defined results: a null url, or one without ``://``, has an empty host and path and fits no
rule; a null url has no terms and is allowed; repeated rows are judged alike; other columns
are ignored; an empty table gives an empty result; an empty vocabulary blocks nothing; of
a term that repeats the largest weight counts, null and empty terms are ignored.
"""

from __future__ import annotations

import urllib.parse

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
STRICT = 100
MAX_TERMS = 2_000_000
# Terms by weight, in English, German, French and Spanish.
VOCABULARY = {
    100: "casino casinos cialis escort escorts hardcore hentai nude nudes onlyfans porn porno pornos sex sexe sexo viagra xxx",
    50: "ads adult adulte adulto apuestas bet bets betting bonus camgirl cheap dating erotic erotico erotik erotique farm free gambling jackpot loteria loterie loto lotterie lottery paris-sportifs phentermine pillen pills poker roulette slots spam track tracker warez wetten win",
    34: "billig clickbait crack darlehen discount gewinn gratis keygen kredit loan prestamo pret torrent winner",
}


def default_terms() -> list[tuple[str, int]]:
    return [(t, w) for w, terms in VOCABULARY.items() for t in terms.split()]


def read_terms(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """A vocabulary from a CSV table with columns term and weight."""
    return terms_of(spark.read.schema("term string, weight int").option("header", True).csv(path))


def terms_of(table: DataFrame) -> list[tuple[str, int]]:
    """The rows of a vocabulary table, which every task holds: over MAX_TERMS is an error."""
    rows = table.where("trim(term) <> ''").groupBy(F.lower(F.trim("term")).alias("term")).agg(F.max("weight").alias("weight")).orderBy("term").limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"a vocabulary holds at most {MAX_TERMS} terms")
    return [(r["term"], int(r["weight"] or 0)) for r in rows]


def host(url: Column) -> Column:
    h = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(h, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(h: Column, p: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    cases = []
    for v, r in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
        name, _, rest = r.partition("/")
        fits = ((h == name) | h.endswith("." + name)) & p.startswith("/" + rest)
        cases.append((fits, r, v))
    pick = verdict = None
    for fits, r, v in cases:
        pick = F.when(fits, r) if pick is None else pick.when(fits, r)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return pick, verdict


def decoded(url: str) -> str:
    """The url in lower case, percent escapes decoded if that gives valid UTF-8."""
    if "%" in url:
        try:
            url = urllib.parse.unquote(url, errors="strict")
        except UnicodeDecodeError:
            pass
    return url.lower()


def automaton(terms: list[tuple[str, int]]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    best: dict[str, int] = {}
    for t, w in terms:
        best[t] = max(w, best.get(t, w))
    for t, w in best.items():
        a.add_word(t, (t, w))
    a.make_automaton()
    return a


def found_terms(a: ahocorasick.Automaton, url: str | None) -> dict[str, int]:
    """The distinct terms with their weights that stand between boundaries."""
    u, found = decoded(url or ""), {}
    if len(a):
        for end, (t, w) in a.iter(u):
            s = end - len(t) + 1
            if not ((s and u[s - 1].isascii() and u[s - 1].isalnum()) or (end + 1 < len(u) and u[end + 1].isascii() and u[end + 1].isalnum())):
                found[t] = w
    return found


def vocabulary(df: DataFrame, url_col: str = "url", terms: list[tuple[str, int]] | None = None) -> DataFrame:
    """``df`` with terms (distinct, sorted) and their weight; a null url is not searched."""
    terms = default_terms() if terms is None else terms
    keep = [c for c in df.columns]
    schema = T.StructType([*df.schema.fields, T.StructField("weight", T.LongType()), T.StructField("terms", T.ArrayType(T.StringType()))])
    at = keep.index(url_col)
    shared = df.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        a = automaton(shared.value)
        for b in batches:
            found = [found_terms(a, u.as_py()) if u.is_valid else {} for u in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([sum(f.values()) for f in found], pa.int64()), pa.array([sorted(f) for f in found], pa.list_(pa.string()))], names=[*keep, "weight", "terms"])

    return df.mapInArrow(run, schema)


def judge(pages: DataFrame, rules=RULES, terms: list[tuple[str, int]] | None = None) -> DataFrame:
    """page_id, url, host, path, rule, verdict, weight, terms; the last two only of urls that no
    rule decides."""
    r, verdict = rule(F.col("host"), F.col("path"), rules)
    p = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    p = p.withColumn("rule", r).withColumn("_ruled", verdict)
    v = vocabulary(p.withColumn("_open", F.when(F.col("_ruled").isNull(), F.col("url"))), "_open", terms)
    by_terms = F.when(F.col("weight") >= STRICT, "block").otherwise("allow")
    return v.select("page_id", "url", "host", "path", "rule", F.coalesce("_ruled", by_terms).alias("verdict"), "weight", "terms")


def digest(pages: DataFrame) -> DataFrame:
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    def hit(t: str) -> str:
        return f"regexp_matches(u, '(^|[^a-z0-9]){t}($|[^a-z0-9])')"

    rules = sorted(RULES, key=lambda x: (-len(x[1]), x[1]))
    fits = [f"((host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}'))" for _, r in rules]
    pick = " ".join(f"WHEN {f} THEN '{r}'" for f, (_, r) in zip(fits, rules))
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _) in zip(fits, rules))
    weight = " + ".join(f"CASE WHEN {hit(t)} THEN {w} ELSE 0 END" for w, terms in VOCABULARY.items() for t in terms.split())
    return rf"""
WITH p AS (
  SELECT page_id, lower(coalesce(TRY(url_decode(url)), url, '')) AS u,
    coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages)
SELECT page_id, host, path, CASE {pick} END AS rule,
  CASE {verdict} WHEN {weight} >= {STRICT} THEN 'block' ELSE 'allow' END AS verdict
FROM p
"""


SQL = _sql()
