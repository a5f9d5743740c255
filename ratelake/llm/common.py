"""Shared helpers: durable intermediate tables, row keys, components, Arrow access."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

_written: list[tuple[SparkSession, str]] = []
SALTS = 32
HOT_KEYS = 1000


@atexit.register
def _clean() -> None:
    """At the driver's end delete intermediate tables that are still there."""
    for spark, path in _written:
        with contextlib.suppress(Exception):  # the session may be gone
            forget(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted at the driver's end."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def save(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: a cut of the lineage that
    survives lost executors.  Returns the frame and its path."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def scratch(*keep: str) -> Iterator[list[str]]:
    """Deletes at its end what was saved inside, but for the paths added to the list given."""
    n, kept = len(_written), list(keep)
    yield kept
    for spark, path in _written[n:]:
        if path not in kept:
            forget(spark, path)
    _written[n:] = [x for x in _written[n:] if x[1] in kept]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary column, without copying; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:
        ok = column.is_valid().to_numpy(zero_copy_only=False)
        if (np.diff(off)[~ok] != 0).any():
            return utf8(column.fill_null("" if not pa.types.is_binary(column.type) else b""))
    return off, raw


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id, the text and the whole row as one struct ``__row``, so that no column's name can
    clash with an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))


def unpacked(df: DataFrame, columns: list[str], **changed) -> DataFrame:
    """The rows of ``packed`` again, with some columns replaced."""
    return df.select(*[(changed[c] if c in changed else F.col("__row").getField(c)).alias(c) for c in columns])


def keyed(df: DataFrame, id_col: str = "doc_id", key: str = "_key", text_col: str = "text") -> DataFrame:
    """Add a unique long ``key`` that follows the order of ``id_col``.

    Where ids are unique and not null the key is the id.  Otherwise (repeated rows,
    null ids: null first) rows are ranked by id, then text, over range partitions.
    """
    ids = df.select(id_col)
    n = ids.groupBy(id_col).count().where((F.col("count") > 1) | F.col(id_col).isNull()).limit(1).count()
    if n == 0:
        return df.withColumn(key, F.col(id_col).cast("long"))
    spark = df.sparkSession
    ordered, _ = save(df.repartitionByRange(id_col, text_col).sortWithinPartitions(id_col, text_col).withColumn("_m", F.monotonically_increasing_id()), "order")
    part = F.shiftright("_m", 33)
    sizes = [(r["p"], r["n"]) for r in ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()]
    start, total = [], 0
    for p, c in sorted(sizes):
        start.append((int(p), total))
        total += c
    starts = spark.createDataFrame(start, "_p long, _start long")
    return (
        ordered.withColumn("_p", part).join(F.broadcast(starts), "_p")
        .withColumn(key, F.col("_start") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_p", "_m", "_start")
    )


def salted(big: DataFrame, small: DataFrame, key: str | list[str], spread: str, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small`` (a row per ``key``, names), a key's rows of ``big`` dealt to SALTS tasks
    by ``spread``; ``small`` is sent to each, so it should be the smaller side by far.  What is
    left of a hot key beyond that is split by AQE, as each part is large then.  Both sides
    are shuffled: Spark's size of ``small`` does not count the copies."""
    s = F.pmod(F.xxhash64(spread), F.lit(SALTS))
    many = small.withColumn("__s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return big.withColumn("__s", s).join(many.hint("merge"), [*([key] if isinstance(key, str) else key), "__s"], how).drop("__s")


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs): rows (node, root) of all nodes but the
    roots, which are the smallest node of each.

    Alternating star rounds over edges (u, v), u > v.  Large star: u goes under the least
    node over v, if v has one.  Small star: of u's nodes v all but the least go under the
    least.  Least nodes are aggregates, combined map-side.  They are joined back only where
    something is to move (v that is under a node itself, u under several nodes), and with
    salt, so a hub's edges are not gathered in one task.  Every round is written to the
    shared folder: lineage stays short and lost executors cost one round.  Rounds go on
    until all components are stars; their number grows as the logarithm of the nodes.
    """
    spark = edges.sparkSession
    e, path = save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), tag)
    while True:
        low = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        over = e.select("v").distinct()
        # nodes with a node over them and nodes under them, or with several over them
        move, move_path = save(low.join(over.withColumn("inner", F.lit(True)), low.u == over.v, "left").where("inner OR n > 1").select("u", "m", "inner"), tag)
        if move.limit(1).count() == 0:
            forget(spark, move_path)
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        up = move.where("inner").select(F.col("u").alias("v"), "m")
        large = salted(e, up, "v", "u", "left").select("u", F.coalesce("m", "v").alias("v"))
        low2 = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        under = salted(large, low2.where("n > 1").select("u", "m"), "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = low2.select("u", F.col("m").alias("v")).union(under)
        nxt, nxt_path = save(small.where("u <> v").distinct(), tag)
        forget(spark, path, move_path)
        e, path = nxt, nxt_path
