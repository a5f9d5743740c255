r"""Chat formatting by columnar byte assembly.

A turn is ``<s>[INST]role[/INST]text</s>``.  Control strings inside a role or text are
broken by a backslash after their first character and backslashes are doubled, so
dropping each backslash that stands before a character restores the input.  Rows are
assembled without a loop over them: segment lengths give cumulative offsets, and numpy
scatter indices copy headers and contents into one preallocated Arrow buffer.  Rows go in
slices of about SLICE bytes and indices are made for CHUNK bytes at a time, so memory
is bounded by the longest row, not by the batch.

Output is a row per turn, so no conversation, however long, has to fit one value; turns
are ordered within a conversation by (turn, role, text), nulls first.  Reading back, a
conversation's turns stream in that order through one running hash, which by its nature is
one task's work.

Defined results: null role or text is empty; a null conv_id is a conversation of its own;
repeated rows are repeated turns; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
OPEN, MID, CLOSE = b"<s>[INST]", b"[/INST]", b"</s>"
LOSS_ROLE = "assistant"
SLICE, CHUNK = 1 << 24, 1 << 18
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.S)


def escape(a: pa.Array) -> pa.Array:
    a = pc.replace_substring(a, "\\", "\\\\")
    for c in CONTROLS:
        a = pc.replace_substring(a, c, c[0] + "\\" + c[1:])
    return a


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S) if "\\" in s else s


def scatter(out: np.ndarray, starts: np.ndarray, off: np.ndarray, data: np.ndarray) -> None:
    """Copies row i of a column, data[off[i]:off[i + 1]], to out[starts[i]:], CHUNK bytes at a time."""
    for a in range(int(off[0]), int(off[-1]), CHUNK):
        z = min(a + CHUNK, int(off[-1]))
        i, j = np.searchsorted(off, a, "right") - 1, np.searchsorted(off, z, "left")  # rows i..j have bytes here
        length = np.minimum(off[i + 1 : j + 1], z) - np.maximum(off[i:j], a)
        # the place of each byte: its own place in the column, shifted as its row is
        out[np.arange(a, z) + np.repeat(starts[i:j] - off[i:j], length)] = data[a:z]


def assemble(parts: list) -> tuple[pa.Array, np.ndarray]:
    """Concatenate per row the given constants (bytes) and string columns.

    Returns the string array and each segment's start within its row (rows x segments).
    """
    n = next(len(p) for p in parts if not isinstance(p, bytes))
    cols = [(None, np.frombuffer(p, np.uint8)) if isinstance(p, bytes) else utf8(p) for p in parts]
    size = np.stack([np.full(n, len(d)) if o is None else np.diff(o) for o, d in cols], 1)
    ends = np.cumsum(size, axis=None).reshape(size.shape) if n else size
    starts = ends - size
    total = int(ends[-1, -1]) if n else 0
    out = np.empty(total, np.uint8)
    for k, (off, data) in enumerate(cols):
        if off is not None:
            scatter(out, starts[:, k], off, data)
        else:
            for i in range(0, n, CHUNK):
                at = starts[i : i + CHUNK, k]
                out[(at[:, None] + np.arange(len(data))).ravel()] = np.tile(data, len(at))
    offsets = np.zeros(n + 1, np.int64)
    if n:
        offsets[1:] = ends[:, -1]
    if total >= 1 << 31:
        raise ValueError("a formatted turn is over 2 GiB")
    made = pa.StringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out))
    return made, starts - offsets[:-1, None]


def slices(batch: pa.RecordBatch, columns: list[int]):
    """The batch in runs of rows of about SLICE bytes in the given columns (one row at least)."""
    size = sum(np.diff(utf8(batch.column(c))[0]) for c in columns)
    if not len(size):
        return
    part = (np.cumsum(size) - size) // SLICE
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
    for a, z in zip(cut[:-1].tolist(), cut[1:].tolist()):
        yield batch.slice(a, z - a)


def format_batch(batch: pa.RecordBatch):
    """Record batches with the formatted turns of (conv_id, turn, role, text)."""
    for b in slices(batch, [2, 3]):
        role, text = escape(b.column(2)), escape(b.column(3))
        made, starts = assemble([OPEN, role, MID, text, CLOSE])
        loss = pc.equal(b.column(2), LOSS_ROLE).to_numpy(zero_copy_only=False).astype(bool)
        length = np.diff(utf8(text)[0])
        yield pa.RecordBatch.from_arrays(
            [*b.columns, made, pa.array(starts[:, 3], pa.int64(), mask=~loss), pa.array(length, pa.int64(), mask=~loss)],
            names=["conv_id", "turn", "role", "text", "formatted", "loss_start", "loss_bytes"],
        )


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, formatted, loss_start, loss_bytes), the loss span in
    bytes of the formatted turn and null where the turn bears no loss."""
    src = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        for b in batches:
            yield from format_batch(b)

    return src.mapInArrow(run, "conv_id long, turn long, role string, text string, formatted string, loss_start long, loss_bytes long")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what its formatted turns say: turns are parsed from the formatted
    bytes, text under the loss mask is cut out by its span.  Turns of a conversation
    stream in order through running hashes; none is held."""
    src = formatted.select("conv_id", "turn", "role", "text", "formatted", "loss_start", "loss_bytes")
    src = src.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "formatted", "loss_start", "loss_bytes")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        cur, state = None, None

        def done():
            n, turns, chars, loss, size = state
            return cur[0], n, turns.hexdigest(), chars, loss.hexdigest(), size

        for b in batches:
            rows = []
            for conv, f, s, k in (tuple(x.as_py() for x in r) for r in zip(*b.columns)):  # a row at a time
                if cur != (conv,):
                    if state:
                        rows.append(done())
                    cur, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in _TURN.findall(f):
                    state[0] += 1
                    state[1].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                if s is not None:
                    part = unescape(f.encode()[s : s + k].decode())
                    state[2] += len(part)
                    state[3].update(part.encode())
                state[4] += len(f)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(done(), kinds)], names=names)

    return src.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def digest(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    hard = "</s>[INST] ok [/INST]"
    more = spark.range(1).selectExpr("explode(array(named_struct('turn', 0L, 'role', 'user'), named_struct('turn', 1L, 'role', 'assistant'))) t").select(F.lit(-1).cast("long").alias("conv_id"), "t.turn", "t.role", F.lit(hard).alias("text"))
    return read_back(format_turns(conversations.select("conv_id", "turn", "role", "text").unionByName(more)))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(role) + length(text) + 20
    + (length(role || text) - length(replace(role || text, chr(92), '')))
    + (length(role || chr(0) || text) - length(replace(role || chr(0) || text, '<s>', ''))) // 3
    + (length(role || chr(0) || text) - length(replace(role || chr(0) || text, '</s>', ''))) // 4
    + (length(role || chr(0) || text) - length(replace(role || chr(0) || text, '[INST]', ''))) // 6
    + (length(role || chr(0) || text) - length(replace(role || chr(0) || text, '[/INST]', ''))) // 7 AS fc
  FROM c)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(fc)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
