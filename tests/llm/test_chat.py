import hashlib
import random

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from ratelake.llm import chat as C


def test_against_plain_python(spark):
    rnd = random.Random(2)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "é", "\n", "x", "<\\/s>", "", " "]
    rows = [(i % 40, rnd.choice([0, 1, 2, None]), rnd.choice(["user", "assistant", "system", None, "a</s>b"]), rnd.choice([None, "".join(rnd.choices(bits, k=rnd.randint(0, 9)))])) for i in range(500)]
    rows += [(77, 0, "assistant", "long " * 60000), (None, 1, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'z' AS formatted").repartition(7)
    got = {r.conv_id: r for r in C.digest(df).collect()}
    talks = {}
    for c, t, r, x in [*rows, (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]:
        talks.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert got.keys() == talks.keys()
    for c, turns in talks.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        g = got[c]
        assert g.n_turns == len(turns)
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest()
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.format_turns(df).count() == 0 and [r.conv_id for r in C.digest(df).collect()] == [-1]


@given(st.lists(st.one_of(st.sampled_from([*C.CONTROLS, "\\"]), st.text(max_size=4)), max_size=12))
def test_escape_is_reversible_and_breaks_controls(parts):
    s = "".join(parts)
    e = C.escape(pa.array([s], pa.string()))[0].as_py()
    assert C.unescape(e) == s and not any(c in e for c in C.CONTROLS)


@pytest.mark.parametrize("col", [["a", "", "é€"], []])
def test_assemble(col):
    made, starts = C.assemble([b"<", pa.array(col, pa.string()), b"|", pa.array(col, pa.string()).slice(0), b">"])
    assert made.to_pylist() == [f"<{x}|{x}>" for x in col]
    assert starts[:, 3].tolist() == [2 + len(x.encode()) for x in col]


def test_slices_and_chunks_change_nothing(monkeypatch):
    rnd = random.Random(6)
    bits = ["</s>", "é", "[INST]", "\\", "x" * 50, "", "\n"]
    cols = [[i for i in range(300)], [0] * 300, [rnd.choice(["user", "assistant", ""]) for _ in range(300)], ["".join(rnd.choices(bits, k=rnd.randint(0, 30))) for _ in range(300)]]
    batch = pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=["conv_id", "turn", "role", "text"])
    want = pa.Table.from_batches(list(C.format_batch(batch))).to_pylist()
    assert [r["formatted"] for r in want] == [f"<s>[INST]{C.escape(pa.array([r]))[0].as_py()}[/INST]{C.escape(pa.array([t], pa.string()))[0].as_py()}</s>" for r, t in zip(cols[2], cols[3])]
    for size, chunk in ((1, 7), (500, 64), (10**6, 1)):
        monkeypatch.setattr(C, "SLICE", size)
        monkeypatch.setattr(C, "CHUNK", chunk)
        for b in (batch, batch.slice(3, 200)):
            assert pa.Table.from_batches(list(C.format_batch(b))).to_pylist() == (want if len(b) == 300 else want[3:203])


def test_memory_of_a_large_batch_is_bounded():
    """300 MB in one batch: what is held at once is in proportion to a slice, or to the longest row."""
    import tracemalloc

    text = pa.array(["long text </s> é " * 300_000] * 50 + ["z" * 45_000_000], pa.string())
    n = len(text)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([0] * n), pa.array(["assistant"] * n), text], names=["conv_id", "turn", "role", "text"])
    assert batch.nbytes > 300_000_000
    before = pa.total_allocated_bytes()
    peak = 0
    tracemalloc.start()
    total = 0
    for b in C.format_batch(batch):
        total += len(b)
        peak = max(peak, pa.total_allocated_bytes() - before)
        del b
    held = tracemalloc.get_traced_memory()[1] + peak
    tracemalloc.stop()
    assert total == n and held < 250_000_000
