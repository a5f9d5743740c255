"""License scans: an exact set-similarity join of text blocks with license templates.

A block is any run of ``STRETCH`` times as many words as the template has, at every place, so
templates of every length match wherever they stand and however their lines wrap.  A block
matches where it holds at least ``THRESHOLD`` of the template's distinct words (containment);
short notices need all of theirs.

Template words are ordered by document frequency counted over all documents, rare first.
A template of n words needs o = ceil(threshold n) of them, so a match holds one of its
first n - o + 1 (prefix filter); where a text's first common word stands at place p of the
template's order, n - p of its words can match at most, which must be o (positional filter);
the text, and what lies within a block's length of a prefix word, must have o of the
template's words (length filter).  What is left is counted exactly, over all blocks at once.

Base labels come from phrases whose words stand consecutively.

Defined results: null text has no words, no labels and score 0; repeated rows are scanned
alike; other columns are ignored; an empty table gives an empty result; a template without
words matches nothing.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import NOTICES, PHRASES, TEMPLATES

THRESHOLD, STRETCH = 0.8, 1.25
#: label: (text, threshold)
DEFAULT = {k: (v, THRESHOLD) for k, v in TEMPLATES.items()} | {k: (v, 1.0) for k, v in NOTICES.items()}

_SPACE = bytes(c if c >= 128 or chr(c).isdigit() or chr(c).islower() else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Runs of a-z, 0-9 and bytes from 0x80 in the text with A-Z lower-cased."""
    return (text or b"").lower().translate(_SPACE).split()


def read_templates(spark: SparkSession, path: str, threshold: float = THRESHOLD) -> dict[str, tuple[str, float]]:
    """Templates from a folder of text files, labelled by file name without its ending."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1)
    rows = spark.read.text(path, wholetext=True).select(name.alias("label"), "value").collect()
    return {r["label"]: (r["value"], threshold) for r in rows}


def document_frequency(docs: DataFrame, vocabulary: frozenset, text_col: str = "text") -> dict[bytes, int]:
    """How many of all documents hold each word of the templates (a bounded vocabulary)."""

    def run(batches):
        n = dict.fromkeys(vocabulary, 0)
        for b in batches:
            for t in b.column(0):
                for w in vocabulary.intersection(words(t.as_py())):
                    n[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["w", "n"])

    part = docs.select(F.col(text_col).cast("string").cast("binary").alias("t")).mapInArrow(run, "w binary, n long")
    return {bytes(r["w"]): r["n"] for r in part.groupBy("w").agg(F.sum("n").alias("n")).collect()}


class Index:
    """Prefix index over templates (label: (words, threshold)) under one global order of their
    words."""

    def __init__(self, templates: Mapping[str, tuple[list[bytes], float]], frequency: Mapping[bytes, int], stretch: float = STRETCH):
        vocabulary = sorted({w for t, _ in templates.values() for w in t}, key=lambda w: (frequency.get(w, 0), w))
        self.place = {w: i for i, w in enumerate(vocabulary)}
        self.templates, self.prefix = [], {}
        for label, (t, threshold) in templates.items():
            order = sorted({self.place[w] for w in t})
            if not order:
                continue
            need = max(1, math.ceil(threshold * len(order) - 1e-9))
            rare = order[: len(order) - need + 1]
            for p, w in enumerate(rare):
                self.prefix.setdefault(w, []).append((len(self.templates), p))
            self.templates.append((label, frozenset(order), need, math.ceil(stretch * len(t)), frozenset(rare)))
        self.rare = frozenset(vocabulary[i] for i in self.prefix)

    def match(self, w: list[bytes]) -> dict[str, float]:
        """The best block's containment of every template that meets its threshold."""
        if self.rare.isdisjoint(w):
            return {}
        hits = [(i, p) for i, x in enumerate(w) if (p := self.place.get(x)) is not None]
        seen, out = set(), {}
        present = {p for _, p in hits}
        for p in sorted(present):
            for k, at in self.prefix.get(p, ()):
                if k in seen:
                    continue
                seen.add(k)  # words come in order: this is the first common one
                label, whole, need, size, rare = self.templates[k]
                if len(whole) - at >= need and len(whole & present) >= need:
                    if (n := self.best([h for h in hits if h[1] in whole], rare, size)) >= need:
                        out[label] = n / len(whole)
        return out

    @staticmethod
    def best(hits: list[tuple[int, int]], rare: frozenset, size: int) -> int:
        """Most distinct words in any block of ``size`` words that holds a word of ``rare``."""
        anchor = [i for i, p in hits if p in rare]
        held: dict[int, int] = {}
        first = most = 0
        for i, p in hits:
            j = bisect_left(anchor, i - size + 1)
            if j == len(anchor) or anchor[j] >= i + size:
                continue  # no prefix word within a block's length
            held[p] = i
            if len(held) > most:
                # words last seen before the block that ends here fall out
                held = {q: x for q, x in held.items() if x > i - size}
                most = max(most, len(held))
        return most


def phrase_places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which the phrase's words stand consecutively (joined: one space
    before, between and after all words)."""
    out, at, number, counted = [], joined.find(phrase), 0, 0
    while at >= 0:
        number += joined.count(b" ", counted, at)
        counted = at
        out.append(number)
        at = joined.find(phrase, at + 1)
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, tuple[str, float]] = DEFAULT, phrases=PHRASES, stretch: float = STRETCH) -> DataFrame:
    """Per document n_words, n_base, first_word, last_word, base_labels, labels, score."""
    split = {k: (words(v.encode()), t) for k, (v, t) in templates.items()}
    index = Index(split, document_frequency(docs, frozenset(w for t, _ in split.values() for w in t), text_col), stretch)
    wanted = [(b" " + p.encode() + b" ", label) for p, label in phrases]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column(1):
                w = words(t.as_py())
                joined = b" " + b" ".join(w) + b" "
                places, base = [], set()
                for phrase, label in wanted:
                    if found := phrase_places(joined, phrase):
                        places += found
                        base.add(label)
                best = index.match(w)
                score = max([1.0 if base else 0.0, *best.values()])
                rows.append((len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | best.keys())), score))
            cols = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[id_col, *names])

    src = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").cast("binary").alias("t"))
    return src.mapInArrow(run, f"`{id_col}` long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
