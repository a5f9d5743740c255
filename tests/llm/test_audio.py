import hashlib
import zlib

import numpy as np
import pyarrow as pa

from ratelake.llm import audio as A


def test_payload_and_container_round_trip():
    for t in (None, b"", b"x", b"y" * 64, b"z" * 65, bytes(range(256)) * 99):
        p = A.payload(t)
        assert len(p) % 64 == 0 and len(p) >= 64 and p.startswith(t or b"") and not p[len(t or b"") :].strip(b"\0")
        assert A.from_wav(A.to_wav(p)) == (p, A.RATE)


def test_polyphase_equals_filtering_the_upsampled_signal():
    x = np.random.default_rng(1).standard_normal(300).astype(np.float32)
    for up, down in ((1, 2), (2, 3), (3, 2), (1, 1)):
        h = A.low_pass(up, down)
        z = np.zeros(len(x) * up, np.float32)
        z[::up] = x
        full = np.convolve(z, h)[len(h) // 2 :][::down]
        n = len(x) * up // down
        np.testing.assert_allclose(A.resample(x, 0, n, up, down), full[:n], atol=1e-4)
        np.testing.assert_allclose(A.resample(x, 40, n - 30, up, down), full[40 : n - 30], atol=1e-4)


def test_blocks_of_frames_agree_with_one_block(monkeypatch):
    s = np.random.default_rng(2).integers(0, 256, 40_000).astype(np.uint8).tobytes()
    whole = np.concatenate([m for _, m, _ in A.log_mel(s)])
    monkeypatch.setattr(A, "FRAMES_AT_ONCE", 7)
    np.testing.assert_allclose(np.concatenate([m for _, m, _ in A.log_mel(s)]), whole, atol=1e-3)


def test_tone_falls_into_its_band_and_silence_is_no_segment():
    t = np.arange(A.RATE)
    loud = (128 + 100 * np.sin(2 * np.pi * 1000 * t / A.RATE)).astype(np.uint8)
    s = np.concatenate([np.full(A.RATE, 128, np.uint8), loud, np.full(A.RATE, 128, np.uint8)])
    mel = np.concatenate([m for _, m, _ in A.log_mel(s.tobytes())])
    peak = A.mel_bank(A.RATE / 2)[:, mel[90].argmax()].argmax() * A.RATE / 2 / A.FRAME
    assert abs(peak - 1000) < 80
    seg = A.segments(np.concatenate([e for _, _, e in A.log_mel(s.tobytes())]))
    assert len(seg) == 1 and abs(A.seconds(int(seg[0][0])) - 1) < 0.1 and abs(A.seconds(int(seg[0][1])) - 2) < 0.1


def test_hysteresis_bridges_dips():
    e = np.array([0, 0, 9, 9, 5, 9, 0, 0], float)
    assert A.segments(e, 0.5, -0.5).tolist() == [[2, 6]]


def test_digest_and_edges(spark):
    texts = [None, "", "a" * 64, "Ünï" * 30000, "same", "same"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS media_bytes")
    got = {r.doc_id: r for r in A.digest(df).collect()}
    for i, t in enumerate(texts):
        p = A.payload((t or "").encode())
        m = A.to_wav(p)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(m), hashlib.sha256(m).hexdigest())
    assert got[4].feature == got[5].feature and got[0].feature == got[1].feature != got[2].feature
    assert A.digest(df.limit(0)).count() == 0


def test_stored_clips_are_fixed_shape_tensors(spark):
    df = spark.createDataFrame([(1, "abc " * 9000), (2, None)], "doc_id long, text string").selectExpr("*", "1 AS tensors")
    got = {r.doc_id: r for r in A.stored_features(df).collect()}
    for r in got.values():
        for x in r.tensors:
            t = A.tensors(bytes(x))
            kind = t.schema.field("mel").type
            assert isinstance(kind, pa.FixedShapeTensorType) and list(kind.shape) == [A.CLIP, A.MELS]
            assert t.column("mel").to_numpy_ndarray().shape == (len(t), A.CLIP, A.MELS)
    one = A.clips(A.stored_features(df)).where("doc_id = 1").orderBy("clip").collect()
    assert [r["clip"] for r in one] == list(range(len(one))) and all(r["t_end"] > r["t_start"] for r in one) and all(len(r["mel"]) == A.CLIP * A.MELS for r in one)
    media = A.store(df).where("doc_id = 1").first()
    assert A.from_wav(bytes(media.media))[0] == A.payload(b"abc " * 9000) and A.clips(A.features(A.store(df.limit(0)))).count() == 0


def fields(feature):
    return dict(x.split("=", 1) for x in feature.split(";"))


def plain_feature(t: bytes) -> dict:
    """The feature by direct formulas: every output, frame, filter and state on its own."""
    x = [b / 128 - 1 for b in A.payload(t)]
    half, n = 16, -(-len(x) // 2)
    taps = [np.sinc(k / 2) * (0.54 - 0.46 * np.cos(2 * np.pi * (k + half) / (2 * half))) / 2 for k in range(-half, half + 1)]
    y = [sum(taps[k + half] * x[2 * m - k] for k in range(-half, half + 1) if 0 <= 2 * m - k < len(x)) for m in range(n)]
    frames = max(1, 1 + -(-(n - 256) // 128))
    y += [0.0] * ((frames - 1) * 128 + 256 - n)
    window = [0.5 - 0.5 * np.cos(2 * np.pi * i / 255) for i in range(256)]
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edge = [700 * (10 ** (mel(4000) * i / 33 / 2595) - 1) for i in range(34)]
    bank = np.zeros((129, 32))
    for k in range(129):
        f = k * 8000 / 256
        for j in range(32):
            if edge[j] <= f <= edge[j + 1]:
                bank[k, j] = (f - edge[j]) / (edge[j + 1] - edge[j])
            elif edge[j + 1] < f <= edge[j + 2]:
                bank[k, j] = (edge[j + 2] - f) / (edge[j + 2] - edge[j + 1])
    turn = np.exp(-2j * np.pi * np.outer(np.arange(129), np.arange(256)) / 256)
    logs, energy = [], []
    for i in range(frames):
        s = np.array([a * b for a, b in zip(y[i * 128 : i * 128 + 256], window)])
        logs.append(np.log(np.abs(turn @ s) ** 2 @ bank + 1e-6))
        energy.append(np.log((s * s).sum() + 1e-6))
    e = (np.array(energy) - np.mean(energy)) / (np.std(energy) + 1e-9)
    on, spans, active = False, [], [0] * frames
    for i, v in enumerate(e):
        now = True if v >= 0.5 else False if v < -0.5 else on
        if now and not on:
            spans.append([i, i])
        if now:
            spans[-1][1] = i + 1
            active[i] = 1
        on = now
    return {"frames": frames, "spans": spans, "active": active, "mean": np.mean(logs, 0), "spread": np.std(logs, 0)}


def test_feature_against_direct_formulas(spark):
    rng = np.random.default_rng(5)
    texts = [None, "x", "abc " * 2000, "".join(map(chr, rng.integers(32, 127, 9_000))), ("\x7f" * 3000 + "".join(map(chr, rng.integers(1, 127, 3000)))) * 2, "é ü " * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    second = A.HOP * 2 / A.RATE
    for r in A.digest(df).collect():
        t, f = plain_feature((texts[r.doc_id] or "").encode()), fields(r.feature)
        assert int(f["frames"]) == t["frames"] and int(f["segments"]) == len(t["spans"]) and int(f["active"]) == sum(t["active"])
        assert f["spans"] == ",".join(f"{a * second:.3f}-{b * second:.3f}" for a, b in t["spans"])
        cut = [f"{i * second:.3f}-{min(i + A.CLIP, t['frames']) * second:.3f}:{sum(t['active'][i : i + A.CLIP])}" for i in range(0, t["frames"], A.CLIP)]
        assert f["clips"] == ",".join(cut)
        np.testing.assert_allclose([float(x) for x in f["mean"].split(",")], t["mean"], atol=0.02)
        np.testing.assert_allclose([float(x) for x in f["spread"].split(",")], t["spread"], atol=0.02)


def test_features_come_from_the_stored_tensors(spark, monkeypatch):
    text = "".join(map(chr, np.random.default_rng(3).integers(32, 127, 50_000)))
    df = spark.createDataFrame([(0, text)], "doc_id long, text string")
    stored = [bytes(x) for x in A.stored_features(df).first().tensors]
    one = A.summary(stored)
    assert one == A.digest(df).first().feature
    batch = A.tensors(stored[0])
    louder = pa.ExtensionArray.from_storage(A.TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(batch.column("mel").to_numpy_ndarray().ravel() + 1), A.CLIP * A.MELS))
    changed = A.summary([A.to_ipc(batch.set_column(6, A.CLIPS.field("mel"), louder)), *stored[1:]])
    assert changed != one and fields(changed)["spans"] == fields(one)["spans"]
    monkeypatch.setattr(A, "FRAMES_AT_ONCE", A.CLIP)
    blocks = [A.to_ipc(b) for b in A.clip_batches(A.payload(text.encode()))]
    many = fields(A.summary(blocks))
    assert len(blocks) > 2 and many["clips"] == fields(one)["clips"] and many["spans"] == fields(one)["spans"]


def test_every_segment_keeps_its_span(spark):
    text = ("\x7f" * 12_000 + "\x01\x01\x01\x01\x7f\x7f\x7f\x7f" * 1500) * 9
    seg = A.segments(np.concatenate([e for _, _, e in A.log_mel(A.payload(text.encode()))]))
    want = [(A.seconds(int(a)), A.seconds(int(b))) for a, b in seg]
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    f = fields(A.digest(df).first().feature)
    assert int(f["segments"]) == len(want) == 9
    assert f["spans"].split(",") == [f"{a:.3f}-{b:.3f}" for a, b in want]
    rows = sorted(A.clips(A.stored_features(df)).collect(), key=lambda r: r.clip)
    assert [tuple(s) for r in rows for s in r.spans] == want
    assert all(r.t_start <= s.start < r.t_end for r in rows for s in r.spans)
