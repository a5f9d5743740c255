"""Media columns: audio features of payloads stored as 8-bit samples.

``store`` keeps a payload losslessly as mono 8-bit PCM in a WAV container, a media column.
``features`` reads the stored bytes back: polyphase resampling, overlapped log-mel filterbank
frames, and segments of sound by energy with hysteresis (a segment begins above ``HIGH`` and
lasts until energy falls below ``LOW``).  Frames are cut into tensors of one fixed shape; these,
their time spans and the segments' spans are stored as Arrow record batches in IPC form (Spark
has no tensor type), with ``mel`` of the type ``fixed_shape_tensor``; ``tensors`` reads them.
``clips`` gives the same as rows, with the tensors as arrays.

Work goes a block of frames at a time (a record batch each), so beside a row, which is in
proportion to its text, memory is bounded; results depend on the payload alone, so equal
payloads give equal values.

Defined results: null text is empty and gives one block of 64 zero bytes; repeated rows
give equal values; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

BLOCK = 64
RATE, UP, DOWN = 16_000, 1, 2
FRAME, HOP, MELS = 256, 128, 32
CLIP = 64  # frames of one tensor
FRAMES_AT_ONCE = 2048
HIGH, LOW = 0.5, -0.5  # standard deviations from the mean log energy
BATCH = 1 << 23  # bytes put out at once
TENSOR = pa.fixed_shape_tensor(pa.float16(), (CLIP, MELS))  # half precision: steps of 0.008 below 16
SPAN = pa.struct([("start", pa.float64()), ("stop", pa.float64())])
CLIPS = pa.schema([("clip", pa.int64()), ("t_start", pa.float64()), ("t_end", pa.float64()), ("frames", pa.int32()), ("active", pa.int32()), ("spans", pa.list_(SPAN)), ("mel", TENSOR)])


def payload(text: bytes | None) -> bytes:
    """The text with zero bytes up to a positive multiple of BLOCK."""
    t = text or b""
    return t + bytes(max(BLOCK, -(-len(t) // BLOCK) * BLOCK) - len(t))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    pad = len(samples) & 1
    return b"RIFF" + struct.pack("<I", 36 + len(samples) + pad) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + bytes(pad)


def from_wav(media: bytes) -> tuple[bytes, int]:
    """(samples, rate) by walking the container's chunks."""
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            rate = struct.unpack_from("<I", media, at + 12)[0]
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


@functools.cache
def low_pass(up: int, down: int, half: int = 8) -> np.ndarray:
    """Windowed sinc for a change of rate by up/down."""
    m = half * max(up, down)
    t = np.arange(-m, m + 1)
    return (np.sinc(t / max(up, down)) * np.hamming(2 * m + 1) * up / max(up, down)).astype(np.float32)


def resample(x: np.ndarray, lo: int, hi: int, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Outputs lo..hi of polyphase resampling of ``x``: output m meets only the filter taps
    of its phase, never the zeros of an upsampled signal.  Outputs of one phase are ``up``
    apart, their inputs ``down``."""
    h = low_pass(up, down)
    half = len(h) // 2
    out = np.zeros(max(0, hi - lo), np.float32)
    for first in range(lo, min(hi, lo + up)):
        phase = (first * down + half) % up
        taps = h[phase::up][::-1]
        # y[m] = sum_k h[phase + k up] x[(m down + half - phase) / up - k]
        n = -(-(hi - first) // up)
        start = (first * down + half - phase) // up - len(taps) + 1
        stop = start + (n - 1) * down + len(taps)
        a, z = max(0, start), max(0, min(len(x), stop))
        part = np.zeros(stop - start, np.float32)
        part[a - start : max(a, z) - start] = x[a:z]
        out[first - lo :: up] = np.lib.stride_tricks.sliding_window_view(part, len(taps))[::down] @ taps
    return out


@functools.cache
def mel_bank(rate: float, n_fft: int = FRAME, mels: int = MELS) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale (fft bins x mels)."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edge = 700 * (10 ** (np.linspace(0, mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.arange(n_fft // 2 + 1)[:, None] * rate / n_fft
    rise, fall = (f - edge[:-2]) / (edge[1:-1] - edge[:-2]), (edge[2:] - f) / (edge[2:] - edge[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(samples: bytes, rate: int = RATE):
    """(first frame, log-mel frames, log energies), a block of frames at a time."""
    x = np.frombuffer(samples, np.uint8)
    n = -(-len(x) * UP // DOWN)
    frames = max(1, 1 + -(-(n - FRAME) // HOP))
    bank = mel_bank(rate * UP / DOWN)
    window = np.hanning(FRAME).astype(np.float32)
    half = len(low_pass(UP, DOWN)) // (2 * UP) + 2
    for f in range(0, frames, FRAMES_AT_ONCE):
        g = min(frames, f + FRAMES_AT_ONCE)
        lo, hi = f * HOP, (g - 1) * HOP + FRAME
        # the inputs these outputs meet, shifted by a whole number of output steps
        skip = max(0, (lo * DOWN // UP - half) // DOWN)
        part = x[skip * DOWN : (hi * DOWN) // UP + half + 1].astype(np.float32) / 128 - 1
        y = resample(part, lo - skip * UP, hi - skip * UP)
        y[max(0, n - lo) :] = 0
        s = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP] * window
        power = np.abs(np.fft.rfft(s, axis=1)) ** 2
        yield f, np.log(power.astype(np.float32) @ bank + 1e-6), np.log((s * s).sum(1) + 1e-6)


def segments(energy: np.ndarray, high: float = HIGH, low: float = LOW) -> np.ndarray:
    """(start, stop) frames of sound; between the thresholds the state stays as it was."""
    z = (energy - energy.mean()) / (energy.std() + 1e-9)
    mark = np.where(z >= high, 1, np.where(z < low, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(z)), -1))
    on = np.where(last >= 0, mark[np.maximum(last, 0)] == 1, False)
    edge = np.diff(np.r_[0, on.astype(np.int8), 0])
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1)


def seconds(frame, rate: int = RATE):
    return frame * HOP * DOWN / (UP * rate)


def clip_batches(samples: bytes, rate: int = RATE):
    """Record batches (CLIPS) of one payload, a block of frames each.  ``spans`` has the times of
    the segments that begin in the clip; ``mel`` is zero beyond ``frames``; ``active`` counts
    frames inside segments."""
    energy, held = [], None
    for block in log_mel(samples, rate):
        held = None if energy else block  # one block alone is not computed twice
        energy.append(block[2])
    seg = segments(np.concatenate(energy))
    for f, m, _ in log_mel(samples, rate) if held is None else [held]:
        k = -(-len(m) // CLIP)
        t = np.zeros((k, CLIP, MELS), np.float32)
        t.reshape(-1, MELS)[: len(m)] = m
        first = f + np.arange(k) * CLIP
        size = np.minimum(CLIP, f + len(m) - first)
        # frames inside segments before a frame: whole segments and a share of the last one
        inside = lambda x: np.append(0, np.cumsum(seg[:, 1] - seg[:, 0]))[np.searchsorted(seg[:, 0], x)] - np.maximum(0, np.append(seg[:, 1], 0)[np.searchsorted(seg[:, 0], x) - 1] - x)
        act = inside(first + size) - inside(first)
        cut = np.searchsorted(seg[:, 0], np.r_[first, f + len(m)])
        mine = seg[cut[0] : cut[-1]]
        spans = pa.ListArray.from_arrays(pa.array(cut - cut[0], pa.int32()), pa.StructArray.from_arrays([pa.array(seconds(mine[:, i], rate)) for i in (0, 1)], fields=list(SPAN)))
        mel = pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(t.ravel().astype(np.float16)), CLIP * MELS))
        cols = [pa.array(first // CLIP), pa.array(seconds(first, rate)), pa.array(seconds(first + size, rate)), pa.array(size, pa.int32()), pa.array(act, pa.int32()), spans, mel]
        yield pa.RecordBatch.from_arrays(cols, schema=CLIPS)


def to_ipc(batch: pa.RecordBatch) -> bytes:
    """An Arrow stream of one batch, schema and tensor type included."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def tensors(stored: bytes) -> pa.RecordBatch:
    """The clips of a stored block: ``mel`` is a fixed-shape tensor array."""
    return pa.ipc.open_stream(stored).read_next_batch()


def _flushed(batches, row, names, kinds, weigh):
    """Rows made of rows, put out about BATCH bytes at a time."""
    out, size = [], 0
    for b in batches:
        for r in zip(*b.columns):
            out.append(row(*r))
            size += weigh(out[-1])
            if size >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): the payload of every text as a media column."""
    src = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").cast("binary").alias("t"))

    def run(batches):
        def row(doc, text):
            t = text.as_py() or b""
            return doc.as_py(), len(t), to_wav(payload(t))

        yield from _flushed(batches, row, [id_col, "n_bytes", "media"], [pa.int64(), pa.int64(), pa.binary()], lambda r: len(r[2]))

    return src.mapInArrow(run, f"`{id_col}` long, n_bytes long, media binary")


def features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """From ``store``'s rows: lengths and digests of what is read back, and ``tensors``, the clips
    with their time spans as Arrow streams, one for each block of frames."""
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "tensors"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.binary())]

    def run(batches):
        def row(doc, n, media):
            m = media.as_py()
            read, rate = from_wav(m)
            stored = [to_ipc(b) for b in clip_batches(read, rate)]
            return doc.as_py(), n.as_py(), len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-BLOCK:]), len(m), hashlib.sha256(m).hexdigest(), stored

        yield from _flushed(batches, row, names, kinds, lambda r: sum(map(len, r[7])))

    src = media.select(id_col, "n_bytes", "media")
    return src.mapInArrow(run, f"`{id_col}` long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tensors array<binary>")


def clips(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The tensors of ``features`` as rows (id, clip, t_start, t_end, frames, active, spans, mel)."""

    def run(batches):
        for b in batches:
            for doc, stored in zip(b.column(0), b.column(1)):
                for x in stored:
                    r = tensors(x.as_py())
                    flat = r.column("mel").to_numpy_ndarray().ravel().astype(np.float32)
                    mel = pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1) * CLIP * MELS, pa.int32()), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * len(r), pa.int64()), *r.columns[:-1], mel], names=[id_col, *r.schema.names])

    return found.select(id_col, "tensors").mapInArrow(run, f"`{id_col}` long, clip long, t_start double, t_end double, frames int, active int, spans array<struct<start: double, stop: double>>, mel array<float>")


def summary(stored: list[bytes]) -> str:
    """From the stored tensors: frames, segments, active frames, all segment spans, clips with
    their time spans and active frames, mean and spread of each mel band."""
    n, s1, s2, spans, parts = 0, np.zeros(MELS), np.zeros(MELS), [], []
    for r in map(tensors, stored):
        size = int(r.column("frames").to_numpy().sum())
        m = r.column("mel").to_numpy_ndarray().reshape(-1, MELS)[:size].astype(np.float64)
        n += size
        s1 += m.sum(0)
        s2 += np.square(m).sum(0)
        flat = r.column("spans").flatten()
        spans += zip(flat.field(0).to_pylist(), flat.field(1).to_pylist())
        parts += zip(*(r.column(c).to_pylist() for c in ("t_start", "t_end", "active")))
    mean = s1 / n
    spread = np.sqrt(np.maximum(0, s2 / n - mean**2))
    show = lambda v: ",".join(f"{x:.2f}" for x in v.tolist())
    seg = ",".join(f"{a:.3f}-{b:.3f}" for a, b in spans)
    cut = ",".join(f"{a:.3f}-{b:.3f}:{k}" for a, b, k in parts)
    return f"frames={n};segments={len(spans)};active={sum(p[2] for p in parts)};spans={seg};clips={cut};mean={show(mean)};spread={show(spread)}"


def stored_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``features`` of ``store``; both are written to the shared folder and read back."""
    media, _ = save(store(docs, id_col, text_col), "audio-media")
    return save(features(media, id_col), "audio-tensors")[0]


def digest(docs: DataFrame) -> DataFrame:
    """Per document the stored form's digests and its features, from the stored tensors."""
    src = stored_features(docs)
    names = [*src.columns[:-1], "feature"]

    def run(batches):
        for b in batches:
            feature = pa.array([summary([x.as_py() for x in stored]) for stored in b.column(b.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], feature], names=names)

    return src.mapInArrow(run, src.drop("tensors").schema.add("feature", "string"))
