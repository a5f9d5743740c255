"""Toxicity scores from a counterfactual-regularised classifier.

A logistic regression over words and word beginnings that a document holds is fitted on
at most ``sample`` labelled rows, those with the smallest hash of their id among rows not
held out (the bound is a parameter; scoring covers all documents).  Tasks count in how many
sampled texts, and toxic ones, each feature stands; only features that stand out by ``STAND``
standard errors are collected, and a lasso leaves few of them a weight.  Without both, tens of
thousands of chance weights outvote the few words that matter.

For each labelled sentence that names a group, copies with the group's term swapped for the
others of its kind, or left out, are made, and the squared difference of their scores to the
sentence's is added to the loss, so group names earn no weight of their own.  The terms are
a parameter (``groups``).

Inputs of a score are the words of the text alone.

Defined results: null or empty text scores as a text without words; repeated rows score
alike, repeated labels of an id count once (its largest); labels of unknown documents and null labels are ignored;
without any label, or with labels of one kind, every score is that kind's smoothed share;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, packed, save, unpacked
from .licenses import words

SAMPLE = 8000
MIN_DOCS, STAND = 5, 2.0
BEGIN = (4, 9)  # bytes of a word's beginnings, from and below
ROUNDS, LASSO, RIDGE, FAIR = 300, 5e-4, 1e-3, 4.0
KNOWN = 1 << 18  # words whose features are remembered at once
# Group names that take each other's place, by kind and language.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("femmes", "hommes", "filles", "garçons"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("schwul", "hetero", "lesbisch", "bisexuell", "transgeschlechtlich"),
    ("homosexuel", "hétérosexuel", "lesbienne", "bisexuel", "transgenre"),
    ("homosexual", "heterosexual", "lesbiana", "bisexual", "transgénero"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("schwarze", "weiße", "asiaten", "afrikaner", "europäer"),
    ("noirs", "blancs", "asiatiques", "africains", "européens"),
    ("negros", "blancos", "asiáticos", "africanos", "europeos"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("einwanderer", "flüchtlinge", "einheimische", "ausländer"),
    ("immigrés", "réfugiés", "autochtones", "étrangers"),
    ("inmigrantes", "refugiados", "nativos", "extranjeros"),
)
_SENTENCE = re.compile(rb"[.!?\n\r]+")

Groups = Sequence[Sequence[str]]
Model = tuple[dict[bytes, float], float]


def beginnings(w: set[bytes]) -> set[bytes]:
    lo, hi = BEGIN
    return {b"^" + x[:k] for x in w for k in range(lo, min(hi, len(x)))}


def features(text: bytes | None) -> set[bytes]:
    """A text's distinct words and the beginnings of longer ones, marked ^."""
    w = set(words(text))
    return w | beginnings(w)


def places(groups: Groups) -> dict[bytes, list[bytes]]:
    """Each group term with the terms that may take its place; b"" leaves it out."""
    out: dict[bytes, list[bytes]] = {}
    for kind in groups:
        terms = [t.encode() for t in kind]
        for t in terms:
            out.setdefault(t, [b""]).extend(u for u in terms if u != t)
    return out


def swaps(text: bytes | None, instead: dict[bytes, list[bytes]]) -> Iterator[tuple[frozenset, frozenset]]:
    """(features lost, features won) of every counterfactual copy of every sentence that names
    a group: a linear score's difference depends on these alone."""
    for sentence in _SENTENCE.split(text or b""):
        w = words(sentence)
        if named := instead.keys() & w:
            own = set(w) | beginnings(set(w))
            for t in sorted(named):
                for u in instead[t]:
                    copy = {u if x == t else x for x in w} - {b""}
                    copy |= beginnings(copy)
                    if copy != own:
                        yield frozenset(own - copy), frozenset(copy - own)


def _rows(x: list) -> tuple[np.ndarray, np.ndarray]:
    """All entries of the lists, and the number of the list of each."""
    return np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(x)), [len(r) for r in x])


def share_of(n: int, toxic: int) -> float:
    """The log odds of the smoothed share."""
    share = (toxic + 1) / (n + 2)
    return float(np.log(share / (1 - share)))


def solve(idx: list[np.ndarray], y: np.ndarray, d: int, swapped: list[tuple], fair: float = FAIR) -> tuple[np.ndarray, float]:
    """(weights, bias) by accelerated proximal gradient steps.

    ``idx`` has each text's features (of ``d``); ``swapped`` (features lost, features won, how
    often) of the counterfactual copies.
    """
    n, y = len(y), np.asarray(y, np.float64)
    f, r = _rows(idx)
    g, q = _rows([np.append(a, b) for a, b, _ in swapped])
    sign = np.concatenate([np.append(-np.ones(len(a)), np.ones(len(b))) for a, b, _ in swapped] or [np.zeros(0)])
    often = np.array([c for *_, c in swapped], np.float64)
    often = 2 * fair * often / max(1.0, often.sum())
    # both kinds weigh alike in the middle: rare toxic rows count for more
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.75
    weight /= weight.sum()

    def pull(u):
        """The penalty's gradient."""
        gap = often * np.bincount(q, sign * u[g], len(often)) if len(often) else often
        return np.bincount(g, sign * gap[q], d) + RIDGE * u if len(g) else RIDGE * u

    v, bound = np.random.default_rng(0).standard_normal(d + 1), 1.0
    for _ in range(30):  # the largest curvature, by power iteration
        z = 0.25 * weight * (v[-1] + np.bincount(r, v[f], n))
        v = np.append(np.bincount(f, z[r], d) + pull(v[:-1]), z.sum())
        bound = float(np.linalg.norm(v))
        v /= bound
    bound *= 1.1
    w = u = np.zeros(d + 1)
    t = 1.0
    for _ in range(ROUNDS):
        z = u[-1] + np.bincount(r, u[f], n)
        e = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        x = u - np.append(np.bincount(f, e[r], d) + pull(u[:-1]), e.sum()) / bound
        x[:-1] = np.sign(x[:-1]) * np.maximum(0, np.abs(x[:-1]) - LASSO / bound)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        u = x + (before - 1) / t * (x - w)
        w = x
    return w[:-1], float(w[-1])


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", groups: Groups = IDENTITY, fair: float = FAIR) -> Model:
    """Fit on at most ``sample`` labelled documents that are not held out.

    The driver holds the features that stand out and, of each sampled text, their numbers.
    """
    spark = docs.sparkSession
    y = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    y = y.where(~held_out(id_col)).select(F.col(id_col).alias("__id"), "toxic", F.xxhash64(F.col(id_col)).alias("__h")).orderBy("__h", "__id").limit(sample)
    t = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("__t"))
    # at most ``sample`` ids and labels: a bounded broadcast
    t = t.join(F.broadcast(y.select("__id", "toxic")), "__id").groupBy("__id").agg(F.max("__t").alias("t"), F.max("toxic").alias("toxic"))
    t, path = save(t.select(F.col("__id").cast("long").alias("id"), "toxic", "t"), "toxicity-sample")
    n, toxic = t.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if toxic in (0, n):
        return {}, share_of(n, toxic)
    instead = places(groups)

    def count(batches):
        """Features (kind 0: n texts, k toxic) and counterfactual differences (kind 1)."""
        seen: dict = {}
        for b in batches:
            for text, label in zip(b.column(2).to_pylist(), b.column(1).to_pylist()):
                for x in features(text):
                    c = seen.setdefault((0, x, b""), [0, 0])
                    c[0] += 1
                    c[1] += label
                for lost, won in swaps(text, instead):
                    seen.setdefault((1, b" ".join(sorted(lost)), b" ".join(sorted(won))), [0, 0])[0] += 1
        if seen:
            kind, a, w = zip(*seen)
            c = np.array(list(seen.values()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(a, pa.binary()), pa.array(w, pa.binary()), pa.array(c[:, 0]), pa.array(c[:, 1])], names=["kind", "a", "b", "n", "k"])

    p = toxic / n
    counts = t.mapInArrow(count, "kind int, a binary, b binary, n long, k long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    stands_out = (F.col("n") >= MIN_DOCS) & (F.abs(F.col("k") - F.col("n") * p) >= STAND * F.sqrt(F.col("n") * (p * (1 - p))))
    got = counts.where((F.col("kind") == 1) | stands_out).select("kind", "a", "b", "n").toArrow().to_pylist()
    known = {x: i for i, x in enumerate(sorted(r["a"] for r in got if r["kind"] == 0))}
    number = lambda s: np.array(sorted(known[x] for x in s if x in known), np.int64)
    swapped = sorted((r["a"], r["b"], r["n"]) for r in got if r["kind"] == 1)
    shared = spark.sparkContext.broadcast(known)

    def numbers(batches):
        known = shared.value
        for b in batches:
            idx = [np.array(sorted(known[x] for x in features(text) & known.keys()), np.int32).tobytes() for text in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(idx, pa.binary())], names=["id", "toxic", "idx"])

    rows = t.mapInArrow(numbers, "id long, toxic int, idx binary").toArrow().sort_by("id")
    forget(spark, path)
    idx = [np.frombuffer(x, np.int32).astype(np.int64) for x in rows.column("idx").to_pylist()]
    pairs = [(number(a.split()), number(b.split()), c) for a, b, c in swapped]
    w, bias = solve(idx, rows.column("toxic").to_numpy(), len(known), [x for x in pairs if len(x[0]) or len(x[1])], fair)
    return {x: float(w[i]) for x, i in known.items() if w[i]}, bias


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns and ``score`` of every document."""
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").cast("binary").alias("__t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    k = len(keep)

    def run(batches):
        weights, bias = shared.value
        known, of = weights.keys(), {}  # of: a word's features that bear a weight
        for b in batches:
            out = []
            for t in b.column(k):
                found = set()
                for x in set(words(t.as_py())):
                    hit = of.get(x)
                    if hit is None:
                        if len(of) >= KNOWN:
                            of.clear()
                        hit = of[x] = known & ({x} | beginnings({x}))
                    if hit:
                        found |= hit
                total = bias + sum(sorted(weights[x] for x in found))
                out.append(1 / (1 + float(np.exp(-max(-30.0, min(30.0, total))))))
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(out, pa.float64())], names=[*keep, "score"])

    schema = src.drop("__t").schema.add("score", "double")
    return src.mapInArrow(run, schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    s = score(docs, train(docs, labels), ["doc_id"])
    return s.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The documents that score below ``limit``."""
    s = score(packed(docs, "doc_id", "text"), train(docs, labels), ["__row"])
    return unpacked(s.where(F.col("score") < limit), docs.columns)
