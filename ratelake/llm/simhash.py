"""SimHash near-duplicate detection by meet-in-the-middle ball hashing.

Fingerprints (64 bits) of 3-word shingles link at ``radius`` 3 or fewer differing
bits.  Two fingerprints that far apart may differ in 3 bits, and balls of half the
radius (1 bit) only meet over 2.  So the 64 bits are cut into three blocks and each
fingerprint emits, for each block left out, every variant within one bit of what
remains: of 3 differing bits at least one lies in some block, leaving that block out
leaves at most 2, and the two one-bit balls share a variant.  131 variants of 42 or 43
bits per distinct fingerprint are shuffled; a sorted run of one variant is verified
exactly and linked with a spanning forest, never with all pairs of the run.

Defined results: null text is an empty text; a text without words has fingerprint 0;
rows with equal fingerprints (repeated rows too) are in one component; a null doc_id
is kept and never chosen as the smallest unless the component has no other id;
other columns, whatever their names, pass through ``fingerprints`` untouched; an
empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, components, keyed, packed, salted, save, unpacked, utf8

SEED, SHINGLE, RADIUS = 42, 3, 3
BLOCKS = ((0, 21), (21, 42), (42, 64))
_CHUNK = 1 << 18  # bytes of text hashed at once
_LONG = 1 << 10  # bytes of a shingle from which it is hashed by itself
# The primes of XXH64.
_PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_GAP = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def xxh64(data: np.ndarray, start: np.ndarray, stop: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each data[start:stop], all at once, a step of the algorithm at a time."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in _PRIMES)
    rotl = lambda x, r: x << np.uint64(r) | x >> np.uint64(64 - r)
    mix = lambda acc, lane: rotl(acc + lane * p2, 31) * p1
    padded = np.append(data, np.zeros(8, np.uint8))
    # the 8 bytes from each place on, as a number
    lanes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view("<u8").ravel()
    size = stop - start
    h = np.full(len(start), (seed + _PRIMES[4]) % (1 << 64), np.uint64)
    at = start.copy()
    some = np.flatnonzero((size >= 32) & (size <= _LONG))
    if len(some):
        acc = [np.full(len(some), x % (1 << 64), np.uint64) for x in (seed + _PRIMES[0] + _PRIMES[1], seed + _PRIMES[1], seed, seed - _PRIMES[0])]
        stripes, place = size[some] // 32, start[some]
        for k in range(int(stripes.max())):
            on = np.flatnonzero(stripes > k)
            for i in range(4):
                acc[i][on] = mix(acc[i][on], lanes[place[on] + 32 * k + 8 * i])
        merged = rotl(acc[0], 1) + rotl(acc[1], 7) + rotl(acc[2], 12) + rotl(acc[3], 18)
        for v in acc:
            merged = (merged ^ mix(np.zeros(len(some), np.uint64), v)) * p1 + p4
        h[some] = merged
        at[some] += 32 * stripes
    h += size.astype(np.uint64)
    for _ in range(3):  # at most three lanes are left
        on = np.flatnonzero(stop - at >= 8)
        on = on[size[on] <= _LONG]
        h[on] = rotl(h[on] ^ mix(np.uint64(0), lanes[at[on]]), 27) * p1 + p4
        at[on] += 8
    on = np.flatnonzero((stop - at >= 4) & (size <= _LONG))
    h[on] = rotl(h[on] ^ (lanes[at[on]] & np.uint64(0xFFFFFFFF)) * p1, 23) * p2 + p3
    at[on] += 4
    for _ in range(3):
        on = np.flatnonzero((at < stop) & (size <= _LONG))
        h[on] = rotl(h[on] ^ padded[at[on]].astype(np.uint64) * p5, 11) * p1
        at[on] += 1
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(size > _LONG).tolist():
        h[i] = xxhash.xxh64_intdigest(data[start[i] : stop[i]].tobytes(), seed)
    return h


def _normal(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with A-Z lower-cased and one space between words, begin and end of each word there,
    its begin in ``data``)."""
    b = _LOWER[data]
    gap = _GAP[b]
    first = ~gap & np.append(True, gap[:-1])
    keep = ~gap | np.append(False, ~gap[:-1])
    out = b[keep]
    space = gap[keep]
    out[space] = 32
    on = ~space
    start = np.flatnonzero(on & np.append(True, space[:-1]))
    stop = np.flatnonzero(on & np.append(space[1:], True)) + 1
    return out, start, stop, np.flatnonzero(first)


def _ones(data: np.ndarray, start: np.ndarray, stop: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For runs of ``count`` shingles each how often each of the 64 bits is set."""
    bits = np.unpackbits(xxh64(data, start, stop).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros((len(count), 64), np.int64)
    i = 0
    for d, n in enumerate(count.tolist()):
        for j in range(i, i + n, 255):  # 255 rows at a time stay within a byte
            out[d] += bits[j : min(j + 255, i + n)].sum(0, dtype=np.uint8)
        i += n
    return out


def _shingles(start: np.ndarray, stop: np.ndarray, first: np.ndarray, words: np.ndarray, k: int):
    """(begin, end, shingles per text) of the shingles of texts with ``words`` words each."""
    count = np.where(words > 0, np.maximum(1, words - k + 1), 0)
    of = np.repeat(np.arange(len(words)), count)
    i = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    return start[i], stop[i + np.minimum(words[of], k) - 1], count


def _long_text(data: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """(ones by bit, shingles) of a long text, in pieces that end between words and begin with the
    k - 1 words before."""
    ones, n, total = np.zeros((1, 64), np.int64), 0, 0
    before = np.zeros(0, np.uint8)
    s, end = 0, len(data)
    while s < end:
        e = min(s + _CHUNK, end)
        while e < end and not _GAP[data[e - 1]]:  # to the end of the word, however long
            gap = np.flatnonzero(_GAP[data[e : e + _CHUNK]])
            e = e + int(gap[0]) + 1 if len(gap) else min(e + _CHUNK, end)
        out, start, stop, _ = _normal(np.concatenate([before, data[s:e]]))
        total = len(start)  # words in this piece and the ones before it
        if total >= k:
            ones += _ones(out, start[: total - k + 1], stop[k - 1 :], np.array([total - k + 1]))
            n += total - k + 1
        keep = min(k - 1, total)
        before = np.append(out[start[total - keep] :], np.uint8(32)) if keep else np.zeros(0, np.uint8)
        s = e
    if n == 0 and total:  # fewer words: the whole sequence
        words = before[: len(before) - 1 - int(before[-2] == 32)] if len(before) > 1 else before
        return _ones(words, np.array([0]), np.array([len(words)]), np.array([1])), 1
    return ones, n


def fingerprint_batch(off: np.ndarray, data: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Unsigned 64-bit SimHash of the ``k``-word shingles of each data[off[i]:off[i + 1]], repeats
    included."""
    n = len(off) - 1
    ones, count = np.zeros((n, 64), np.int64), np.zeros(n, np.int64)
    i = 0
    while i < n:
        if off[i + 1] - off[i] > _CHUNK:
            ones[i], count[i] = _long_text(data[off[i] : off[i + 1]], k)
            i += 1
            continue
        j = i + 1
        while j < n and off[j + 1] - off[i] <= _CHUNK:
            j += 1
        ends = off[i + 1 : j] - off[i]
        out, start, stop, place = _normal(np.insert(data[off[i] : off[j]], ends, 32))  # words end where texts do
        row = np.searchsorted(ends + np.arange(len(ends)), place, "right")
        words = np.bincount(row, minlength=j - i)
        a, z, count[i:j] = _shingles(start, stop, np.cumsum(words) - words, words, k)
        if len(a):
            ones[i:j] = _ones(out, a, z, count[i:j])
        i = j
    return np.packbits(2 * ones > count[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprint(text: bytes | None, k: int = SHINGLE) -> int:
    """The same of one text."""
    raw = np.frombuffer(text or b"", np.uint8)
    return int(fingerprint_batch(np.array([0, len(raw)]), raw, k)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fp", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (default doc_id) and the fingerprint as a signed long."""
    keep = ["doc_id"] if keep is None else keep
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").cast("binary").alias("__text"))
    schema = src.drop("__text").schema.add(out, "long")

    def run(batches):
        for b in batches:
            fp = fingerprint_batch(*utf8(b.column(b.num_columns - 1))).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp)], names=[*b.schema.names[:-1], out])

    return src.mapInArrow(run, schema)


def variants(fps: DataFrame, col: str = "fp") -> DataFrame:
    """(variant, fp): all variants within half the radius, one block left out at a time."""
    balls = []
    for i, (lo, hi) in enumerate(BLOCKS):
        gone = ((1 << (hi - lo)) - 1) << lo
        tag = (i + 1) << lo
        for flip in [0, *(1 << b for b in range(64) if not lo <= b < hi)]:
            balls.append((_signed(~gone & (1 << 64) - 1), _signed(flip ^ tag)))
    ball = F.explode(F.array(*[F.struct(F.lit(a).alias("keep"), F.lit(b).alias("flip")) for a, b in balls]))
    return fps.select(F.col(col).alias("fp"), ball.alias("b")).select(F.col("fp").bitwiseAND(F.col("b.keep")).bitwiseXOR(F.col("b.flip")).alias("variant"), "fp")


def _forest(x: np.ndarray) -> tuple[list, list]:
    """Spanning forest of the links inside one run: a found fingerprint leaves the
    rest, so each is reached once and dense runs cost about one pass."""
    a, b = [], []
    rest = np.unique(x)
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            p = queue.pop()
            near = np.bitwise_count(rest ^ p) <= RADIUS
            found = rest[near]
            if len(found):
                a += [p] * len(found)
                b += found.tolist()
                queue += list(found)
                rest = rest[~near]
    return a, b


def links(fps: DataFrame, col: str = "fp") -> DataFrame:
    """Edges (a, b) that connect all fingerprints within the radius, from distinct ``fps``.

    A run of one variant is held whole: distinct fingerprints that differ from the variant in
    one bit at most outside the block left out (22 bits at most).
    """

    def run(batches):
        tail_k, tail_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def edges(k, f):
            same = k[1:] == k[:-1]
            if not same.any():
                return None
            first = np.flatnonzero(same & ~np.r_[False, same[:-1]])
            last = np.flatnonzero(same & ~np.r_[same[1:], False]) + 2
            pair = last - first == 2
            x, y = f[first[pair]], f[first[pair] + 1]
            ok = (np.bitwise_count(x ^ y) <= RADIUS) & (x != y)
            a, b = x[ok].tolist(), y[ok].tolist()
            for i, j in zip(first[~pair], last[~pair]):
                p, q = _forest(f[i:j])
                a += p
                b += q
            if not a:
                return None
            e = np.array([a, b], np.uint64)
            e.sort(axis=0)
            e = np.unique(e, axis=1).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(e[0]), pa.array(e[1])], names=["a", "b"])

        for batch in batches:
            k = np.concatenate([tail_k, batch.column(0).to_numpy()])
            f = np.concatenate([tail_f, batch.column(1).to_numpy().view(np.uint64)])
            if not len(k):
                continue
            cut = int(np.searchsorted(k, k[-1]))  # sorted: the last run may go on
            tail_k, tail_f = k[cut:], f[cut:]
            if cut and (out := edges(k[:cut], f[:cut])):
                yield out
        if len(tail_k) and (out := edges(tail_k, tail_f)):
            yield out

    v = variants(fps, col)
    return v.repartition("variant").sortWithinPartitions("variant").mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp, component_id): every document with its fingerprint and class.

    Classes come back to documents by fingerprint.  A fingerprint of more than one in
    HOT_KEYS of all documents (so at most HOT_KEYS of them) is broadcast, the others are
    shuffled, so copies of one text, however many, do not meet in one task.
    """
    fp, _ = save(fingerprints(docs, text_col, "fp", [id_col]), "simhash-fp")
    groups, _ = save(fp.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")), "simhash-groups")
    root, _ = save(components(links(groups.select("fp")), "simhash-cc"), "simhash-root")
    # classes of several fingerprints: their members but the roots, and the roots
    member = groups.join(root, groups.fp == root.node).select("fp", "root", "least")
    roots = root.select("root").distinct()
    top = groups.join(roots, groups.fp == roots.root).select("fp", "root", "least")
    least = member.unionByName(top).groupBy("root").agg(F.min("least").alias("component_id"))
    named = salted(member.select("fp", "root"), least, "root", "fp").select("fp", "component_id")
    named = named.unionByName(least.select(F.col("root").alias("fp"), "component_id"))
    label = groups.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "n")
    label, _ = save(label, "simhash-label")
    total = label.agg(F.sum("n")).first()[0] or 0
    common = label.where(F.col("n") > max(1, total // HOT_KEYS))
    rest = label.where(F.col("n") <= max(1, total // HOT_KEYS)).select("fp", "component_id")
    hot = fp.join(F.broadcast(common.select("fp", "component_id")), "fp")
    cold = fp.join(F.broadcast(common.select("fp")), "fp", "left_anti").join(rest, "fp")
    return hot.unionByName(cold).select(id_col, "fp", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class stays: the one with the smallest id.

    Of rows that repeat an id, or have none, each counts as a document of its own, in
    the order of ``keyed``.
    """
    rows = keyed(packed(docs, id_col, text_col), id_col, "_key", text_col)
    c = simhash_components(rows, "_key", text_col)
    keep = c.where("component_id = _key").select("_key")
    return unpacked(rows.join(keep, "_key", "left_semi"), docs.columns)


def to_hex(col: str):
    return F.lower(F.lpad(F.hex(F.col(col)), 16, "0"))
