"""Mixing sources to target weights with DataFrame functions only.

Sources in code-point order (null last) take weights from a repeating list and share
``share`` times all tokens; a target stops at ``cap`` times its source's tokens and the
excess is shared again by weight.  That fixpoint is a water level: uncapped sources get
weight x level.  Sorting sources by cap/weight makes it one cumulative sum.  A document
is then taken floor(rate) times plus once more where a hash of its id falls below the
rate's fraction, so no state and no second pass are needed and reruns agree.

The order of sources and the water level are windows over one row per source, in one task:
sources may be many (a row of three numbers each, sorted with spilling), but not as many as
documents.

Defined results: null text has 0 words; a null source is a source of its own; rows that
repeat a doc_id draw alike; a source without words has target 0 and rate 0; an empty table
gives an empty result; all columns are kept by ``mix``, whatever their names: its own
``size`` and ``copy`` give way to columns of these names (``mix_size``, ``mix_copy``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save, unpacked

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2.0
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def draw(id_col: str, seed: str = "mix") -> Column:
    """Uniform in [0, 1) from 52 bits of the MD5 of seed and id."""
    h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    The windows run over one row per source, already aggregated.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(place) - 1) % len(weights)
    w = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (k + 1).cast("int"))).withColumn("top", F.lit(cap) * F.col("source_size"))
    by_level = Window.orderBy((F.col("top") / F.col("w")), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    total = F.lit(share) * F.sum("source_size").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("w").over(after)
    # the level if this source is the first one that isn't capped
    x = w.withColumn("level", level).withColumn("open", F.col("level") * F.col("w") <= F.col("top"))
    # levels fall from the first open source on, so the highest one is that source's
    final = F.max(F.when(F.col("open"), F.col("level"))).over(Window.partitionBy())
    return x.select("source", "source_size", F.least(F.col("top"), F.coalesce(final * F.col("w"), F.col("top"))).alias("target"))


def rates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None, **how) -> DataFrame:
    """(__row, size, source_size, target, rate, copies): ``__row`` holds a row's own columns, or
    those in ``keep``.

    Tokens are summed per source map-side.  The targets, one row per source, are written
    first, so their size is known when the join is planned: Spark broadcasts them under its
    size limit, and texts are not shuffled; beyond it skewed sources are split.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]).alias("__row")
    sized = docs.select(row, n_words(f"`{text_col}`").alias("size"), F.col(f"`{source_col}`").alias("source"), draw(f"`{id_col}`").alias("draw"))
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    t, _ = save(targets(per, **how), "mix-targets")
    t = t.withColumnRenamed("source", "of")
    j = sized.join(t, sized["source"].eqNullSafe(t["of"])).drop("of", "source")
    j = j.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    whole = F.floor("rate")
    return j.withColumn("copies", whole + F.when(F.col("draw") < F.col("rate") - whole, 1).otherwise(0)).drop("draw")


def free_name(name: str, taken: list[str]) -> str:
    """The name, or with ``mix_`` before it as often as it is taken."""
    while name.lower() in {c.lower() for c in taken}:
        name = "mix_" + name
    return name


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mixed corpus: each document once per copy, with its ``size`` and the ``copy`` numbered
    from 0."""
    r = rates(docs, id_col, text_col, source_col, **how).where("copies > 0")
    out = r.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    own = {free_name(c, docs.columns): F.col(c) for c in ("size", "copy")}
    return unpacked(out, [*docs.columns, *own], **own)


def digest(docs: DataFrame) -> DataFrame:
    return rates(docs, keep=["doc_id"]).select("__row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS top,
    CASE (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
      - coalesce(sum(top) OVER (ORDER BY top / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY top / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT source, source_size, least(top, coalesce(max(CASE WHEN level * w <= top THEN level END) OVER () * w, top)) AS target FROM l),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  ((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT * size)::BIGINT AS taken
FROM r
"""
