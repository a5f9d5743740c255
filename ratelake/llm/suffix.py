"""Exact substring deduplication by threshold-bounded interval expansion on a BWT.

Every byte covered by a ``LENGTH``-byte string that also starts earlier (smaller id, or
same document and earlier start) is found; matches never cross documents.

A suffix array of the whole corpus does not fit a task, so suffixes are dealt out by
content.  Each window of LENGTH bytes holds the smallest hash of its 32-byte substrings
(ties all count), a choice that depends on the window alone: equal windows share such an
anchor at the same place.  All windows around an anchor lie in a fragment of at most
168 bytes, so

1. tasks emit anchors with a hash of the fragment.  Fragments of equal hash are not taken as
   equal: a later one becomes a claim, this stretch of this document repeats that stretch of
   that one.  Claims of one task are found there (map-side combine), so a hot passage
   sends one row a task; an anchor with many fragments in a task is dealt by fragment, with
   one row to tell the others; neighbouring claims are merged;
2. first copies of fragments whose anchor has other fragments too go on: their windows are
   dealt, in two halves by their offset to the anchor (eight parts where an anchor has many
   fragments), to buckets keyed by the bytes that all windows of the part must share, which
   parts chance neighbours;
3. claims are cut where their source passes a grid and dealt to buckets by the stretch of
   source, which stands in the bucket too; a hot stretch gets several buckets;
4. buckets are gathered into texts of bounded size.  The text's Burrows-Wheeler transform is
   built and intervals are extended backward breadth first: level l sets the boundaries
   between suffixes with l bytes in common, and the expansion stops at LENGTH.  Suffixes
   without a boundary between them share LENGTH bytes or more.  Source and first claim of a
   stretch go through the expansion.  Further claims, and parts equal to one that is in
   the text, are compared with it byte by byte and share its fate; if they differ they go
   into the text themselves.  So hashes only say what to compare.
   A bucket with more distinct parts than HOT is halved again, as often as needed (at one
   offset all windows of a bucket are equal).  Nothing is dropped.

What hashes may miss: fragments whose 64-bit hashes are equal under one 64-bit anchor though
their bytes differ would hide a later copy of the second one.

A document's requests and intervals are gathered in one row; they are in proportion to its text.

Defined results: null text is empty (and stays null in ``dedup_text``); texts shorter than
LENGTH lose nothing; of rows that repeat an id, or have none, each is a document of its
own, ordered by text; other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, keyed, packed, save, unpacked, utf8

LENGTH, KMER = 100, 32
REACH = LENGTH - KMER  # bytes of context on each side of an anchor
CHUNK = 1 << 18  # bytes hashed at once
COMBINE = 1 << 19  # anchors combined at once in a task
TEXT = 1 << 17  # bytes of one BWT, which then fits a core's cache
HOT = (1 << 21) // (LENGTH + REACH)  # fragments of one key that fit the largest text
GRID = 1 << 12  # bytes of source that claims of one bucket repeat
CLAIMS = 1 << 10  # claims of a hot stretch of source in one bucket
MANY = 64  # fragments of one anchor in one task that are dealt apart
FIRST = -(1 << 63)  # sorts before all others


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over each window of w values, by doubling."""
    size = 1
    while 2 * size <= w:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: len(x) - (w - size)], x[w - size :]) if size < w else x


def _kmers(b: np.ndarray) -> np.ndarray:
    """A mixed, nonzero 64-bit hash of each KMER-byte substring."""
    m, step = 0x9E3779B97F4A7C15, 1
    h = b.astype(np.uint64) + np.uint64(1)
    while step < KMER:
        h = h[:-step] * np.uint64(m) + h[step:]
        m = m * m % (1 << 64)
        step *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h | np.uint64(1)


def anchors(b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors in ``b``; ``ends`` is, for each byte, where its
    document ends, so that windows over a document's end don't count."""
    n = len(b) - LENGTH + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _kmers(b)
    low = _slide(h, REACH + 1, np.minimum)[:n]
    low[np.arange(n) + LENGTH > ends[:n]] = 0
    # a k-mer is the smallest of some window if it equals the largest of the minima
    pad = np.zeros(REACH, np.uint64)
    top = _slide(np.concatenate([pad, low, pad]), REACH + 1, np.maximum)
    at = np.flatnonzero(top[: len(h)] == h)
    return at, h[at]


def _document_anchors(off: np.ndarray, data: np.ndarray):
    """(row, place in its document, hash) over the documents of a batch, a chunk at a time."""
    i, n = 0, len(off) - 1
    while i < n:
        if off[i + 1] - off[i] > CHUNK:  # a long document, in overlapping pieces
            lo, hi = off[i], off[i + 1]
            for s in range(lo, hi, CHUNK):
                e = min(s + CHUNK, hi)
                a, z = max(lo, s - REACH), min(hi, e + LENGTH)
                at, h = anchors(data[a:z], np.full(z - a, hi - a))
                at += a
                ok = (at >= s) & (at < e)
                yield np.full(ok.sum(), i), at[ok] - lo, h[ok]
            i += 1
            continue
        j = i + 1
        while j < n and off[j + 1] - off[i] <= CHUNK:
            j += 1
        size = np.diff(off[i : j + 1])
        row = np.repeat(np.arange(i, j), size)
        at, h = anchors(data[off[i] : off[j]], np.repeat(off[i + 1 : j + 1] - off[i], size))
        row = row[at]
        yield row, at + off[i] - off[row], h
        i = j


def _merge(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Union of intervals by document."""
    if not len(doc):
        return [doc, start, end]
    o = np.lexsort((start, doc))
    doc, start, end = doc[o], start[o], end[o]
    # running maximum of ends within a document: lift documents apart
    lift = np.cumsum(np.r_[False, doc[1:] != doc[:-1]]) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    first = np.flatnonzero(np.r_[True, (start[1:] + lift[1:] > reach[:-1])])
    last = np.r_[first[1:], len(doc)] - 1
    return [doc[first], start[first], reach[last] - lift[last]]


def _claims(doc: np.ndarray, a: np.ndarray, b: np.ndarray, src: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """(doc, a, b, src, at): claims that [a, b) of doc repeats src from ``at`` on; those that
    overlap, of one source at one distance, are one."""
    far = at - a
    o = np.lexsort((far, src, doc))
    new = np.r_[True, (doc[o][1:] != doc[o][:-1]) | (src[o][1:] != src[o][:-1]) | (far[o][1:] != far[o][:-1])]
    group = np.empty(len(o), np.int64)
    group[o] = np.cumsum(new) - 1
    g, s, e = _merge(group, a, b)
    head = o[new][g]
    return [doc[head], s, e, src[head], s + far[head]]


def _cover(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Intervals, by place in arrays sorted by document and start, that hold every LENGTH-byte
    window that any holds: few of them (a periodic text claims each byte many times)."""
    keep, of, reach, best, far = [], None, 0, -1, 0  # windows that begin before reach are held
    for i, (d, s, e) in enumerate(zip(doc.tolist(), a.tolist(), (b - LENGTH + 1).tolist())):
        if d != of:
            if far > reach:
                keep.append(best)
            of, reach, best, far = d, s, i, e
            continue
        if s > reach:
            if far > reach:
                keep.append(best)
                reach = far
            reach = max(reach, s)
        if e > far:
            best, far = i, e
    if far > reach:
        keep.append(best)
    return keep


def _batch(names: str, cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names.split())


def emit_anchors(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    """(t, p, h, f, doc, pos, src, at): t 0 are the first copies in a task of an anchor's fragment
    (pos packs place, left and right context), t 1 are claims [f, pos) of later ones.  ``p``
    deals rows by anchor, those of an anchor with many fragments by fragment; a row of
    fragment FIRST then stands for them at the anchor's."""
    src = docs.select(F.col(key).alias("doc"), F.col(text_col).cast("string").alias("text"))
    names = "t p h f doc pos src at"

    def combine(parts):
        h, f, doc, pos = (np.concatenate(x) for x in zip(*parts))
        o = np.lexsort((pos, doc, f, h))
        h, f, doc, pos = h[o].view(np.int64), f[o].view(np.int64), doc[o], pos[o]
        f[f == FIRST] += 1
        one = np.r_[True, (h[1:] != h[:-1]) | (f[1:] != f[:-1])]
        g, e, d, x = h[one], f[one], doc[one], pos[one]
        begin = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        size = np.diff(np.append(begin, len(g)))
        many = np.repeat(size >= MANY, size)
        z = np.zeros(len(g), np.int64)
        yield _batch(names, [z.astype(np.int8), np.where(many, (g ^ e) * np.int64(0x9E3779B97F4A7C1) | 1, g & -2), g, e, d, x, z, z])
        if many.any():
            tell = g[begin[size >= MANY]]
            z = np.zeros(len(tell), np.int64)
            yield _batch(names, [z.astype(np.int8), tell & -2, tell, z + FIRST, z, z, z, z])
        if not one.all():
            again = np.flatnonzero(~one)
            d, s, e, src, at = _repeat(doc, pos, again, np.flatnonzero(one)[np.cumsum(one)[again] - 1])
            yield _batch(names, [np.ones(len(d), np.int8), d, d, s, d, e, src, at])

    def run(batches):
        held, count = [], 0
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            key_of = b.column(0).to_numpy()
            off, data = utf8(b.column(1))
            base, raw = off[:-1], data.tobytes() if len(data) else b""
            for row, a, h in _document_anchors(off, data):
                if not len(a):
                    continue
                n = off[row + 1] - off[row]
                left, right = np.minimum(REACH, a), np.minimum(REACH, n - a - KMER)
                s = (base[row] + a - left).tolist()
                e = (base[row] + a + KMER + right).tolist()
                f = np.array([digest(raw[x:y], z) for x, y, z in zip(s, e, left.tolist())], np.uint64)
                held.append((h, f, key_of[row], a << 16 | left << 8 | right))
                count += len(a)
                if count >= COMBINE:
                    yield from combine(held)
                    held, count = [], 0
        if held:
            yield from combine(held)

    return src.mapInArrow(run, "t byte, p long, h long, f long, doc long, pos long, src long, at long")


def _repeat(doc: np.ndarray, pos: np.ndarray, later: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Claims that the fragments of rows ``later`` repeat those of rows ``first``."""
    a, left, right = pos >> 16, pos >> 8 & 255, pos & 255
    s, e = a - left, a + KMER + right
    return _claims(doc[later], s[later], e[later], doc[first], s[first])


def settle(rows: DataFrame) -> DataFrame:
    """(t, h, doc, a, b, src, at): t 0 are the first copies of fragments whose anchor has other
    fragments (b is the packed place, a 1 where it has many in any task, so that all of an
    anchor's are halved alike and meet), t 1 are claims [a, b)."""
    names = "t h doc a b src at"

    def run(batches):
        head, sent, deep = None, True, False  # the first copy of the fragment that goes on; whether it is put out; has its anchor many
        for batch in batches:
            t, p, h, f, doc, pos, src, at = (c.to_numpy() for c in batch.columns)
            done = t == 1
            if done.any():
                yield _batch(names, [x[done] for x in (t, h, doc, f, pos, src, at)])
            p, h, f, doc, pos = (x[~done] for x in (p, h, f, doc, pos))
            if not len(h):
                continue
            if head is not None:  # it stands before its fragment's later copies
                p, h, f, doc, pos = (np.append(x, y) for x, y in zip(head, (p, h, f, doc, pos)))
            begin = np.r_[True, (h[1:] != h[:-1]) | (p[1:] != p[:-1])]
            fresh = begin | np.r_[True, f[1:] != f[:-1]]
            start = np.flatnonzero(begin)
            group = np.cumsum(begin) - 1
            many = ((p[start] & 1) == 1) | (f[start] == FIRST)  # a task with few is told by the one with many
            if head is not None and deep:
                many[0] = True
            several = (np.add.reduceat(fresh, start) > 1) | ((p[start] & 1) == 1)
            if head is not None and sent:
                several[0] = True
            go = fresh & several[group] & (f != FIRST)
            if head is not None and sent:
                go[0] = False
            z = np.zeros(int(go.sum()), np.int64)
            yield _batch(names, [z.astype(np.int8), h[go], doc[go], many[group[go]].astype(np.int64), pos[go], z, z])
            again = np.flatnonzero(~fresh & (f != FIRST))
            if len(again):
                first = np.maximum.accumulate(np.where(fresh, np.arange(len(h)), 0))
                d, s, e, of, place = _repeat(doc, pos, again, first[again])
                yield _batch(names, [np.ones(len(d), np.int8), d, d, s, e, of, place])
            last = np.flatnonzero(fresh)[-1]
            sent, deep = bool(several[-1]), bool(many[-1])
            head = tuple(x[last] for x in (p, h, f, doc, pos))

    # p first: its values tell most rows apart, so a comparison rarely goes on; claims may stand anywhere
    src = rows.repartition("p").sortWithinPartitions("p", "h", "f", "doc", "pos")
    return src.mapInArrow(run, "t byte, h long, doc long, a long, b long, src long, at long")


def merged(claims: DataFrame) -> DataFrame:
    """Claims (doc, a, b, src, at) of neighbouring fragments as one, without those that others
    make needless."""

    def run(batches):
        for batch in batches:
            doc, a, b, src, at = _claims(*(c.to_numpy() for c in batch.columns))
            o = np.lexsort((-b, a, doc))
            o = o[_cover(doc[o], a[o], b[o])]
            yield _batch("doc a b src at", [x[o] for x in (doc, a, b, src, at)])

    c = claims.select("doc", "a", "b", "src", "at")
    return c.repartition("doc").sortWithinPartitions("doc", "a", "src").mapInArrow(run, "doc long, a long, b long, src long, at long")


def sort_rotations(text: np.ndarray, depth: int = LENGTH + 1) -> np.ndarray:
    """The text's rotations in the order of their first ``depth`` bytes or more, equal ones by
    place.  Prefixes double; rank, next rank and place share one 63-bit key, so each round is
    a plain sort of integers (hence at most 2**21 bytes)."""
    n = len(text)
    width = max(1, (n - 1).bit_length())
    if width > 21:
        raise ValueError("a text holds at most 2**21 bytes")
    shift, mask = np.uint64(width), np.uint64((1 << width) - 1)
    place = np.arange(n, dtype=np.uint64)
    letters, code = np.unique(text, return_inverse=True)
    bits = max(1, (len(letters) - 1).bit_length())
    size = 2 * width // bits or 1
    key = np.zeros(n, np.uint64)
    for j in range(size):
        key = key << np.uint64(bits) | np.roll(code, -j).astype(np.uint64)
    while True:
        o = np.sort(key << shift | place)
        at = o & mask
        if size >= depth:
            return at.astype(np.int64)
        o >>= shift
        rank = np.empty(n, np.uint64)
        rank[at] = np.cumsum(np.r_[False, o[1:] != o[:-1]]).astype(np.uint64)
        key = rank << shift | np.roll(rank, -(size % n))
        size *= 2


def classes(text: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each position a number, equal for positions that begin with the same ``length``
    bytes (cyclically), by interval expansion on the Burrows-Wheeler transform."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    sa = sort_rotations(text, length + 1)
    isa = np.empty(n, np.int64)
    isa[sa] = np.arange(n)
    bwt = text[sa - 1]
    lf = isa[sa - 1]  # where the rotation one byte longer to the left stands
    # before[i]: the previous place with the same byte in the transform
    at = np.empty(n, np.int64)
    at[lf] = np.arange(n)
    before = np.full(n, -1)
    same = np.r_[False, bwt[at[1:]] == bwt[at[:-1]]]
    before[at[same]] = at[np.flatnonzero(same) - 1]
    bound = np.zeros(n, bool)  # set: fewer than ``length`` bytes in common with the suffix before
    head = text[sa]
    level = np.r_[0, np.flatnonzero(head[1:] != head[:-1]) + 1]
    bound[level] = True
    for _ in range(length - 1):
        if not len(level):
            break
        every = np.flatnonzero(bound)
        stop = np.append(every, n)[np.searchsorted(every, level, "right")]
        size = stop - level
        start = np.repeat(level, size)
        place = start + np.arange(len(start)) - np.repeat(np.cumsum(size) - size, size)
        # the first of each byte in an interval begins the extended interval
        to = lf[place[before[place] < start]]
        level = to[~bound[to]]
        bound[level] = True
        level.sort()
    out = np.empty(n, np.int64)
    out[sa] = np.cumsum(bound)
    return out


def repeats(frags: list) -> list[np.ndarray]:
    """Intervals by document that repeat among fragments (doc, place, left, lo, hi, bytes)."""
    text = np.frombuffer(b"".join(x[5] for x in frags), np.uint8)
    size = np.array([len(x[5]) for x in frags])
    doc, a, left, lo, hi = (np.array(c, np.int64) for c in list(zip(*frags))[:5])
    cls = classes(text)
    base = np.cumsum(size) - size
    begin = np.maximum(0, left - hi)  # first and last window inside the fragment
    stop = np.minimum(size - LENGTH, left - lo)
    count = np.maximum(0, stop - begin + 1)
    which = np.repeat(np.arange(len(frags)), count)
    if not len(which):
        return _merge(which, which, which)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + begin[which]
    key = np.sort(cls[base[which] + inner] << 40 | np.arange(len(which)))
    c, o = key >> 40, key & ((1 << 40) - 1)
    d, s = doc[which][o], (a[which] - left[which] + inner)[o]
    # of equal windows all but the first by document and start repeat
    first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    ids, rank = np.unique(doc, return_inverse=True)
    place = rank[which][o] << 40 | s
    later = place != np.repeat(np.minimum.reduceat(place, first), np.diff(np.append(first, len(c))))
    return _merge(d[later], s[later], s[later] + LENGTH)


def _split(h: int, doc: int, a: int, left: int, lo: int, hi: int, frag: bytes):
    """The two halves of a fragment's windows, each under the bytes all of them share."""
    mid = (lo + hi) // 2
    for x, y in ((lo, mid), (mid + 1, hi)):
        x2, y2 = max(x, LENGTH - (len(frag) - left)), min(y, left)
        if x2 > y2:
            continue
        core = frag[left - x : left - y + LENGTH]
        part = frag[left - y2 : left - x2 + LENGTH]
        k = xxhash.xxh3_64_intdigest(core, x << 8 | y)
        f = xxhash.xxh3_64_intdigest(part, y2)
        yield (k - (1 << 63), f - (1 << 63), doc, a, y2, x, y, part)


def _parts(h: int, doc: int, a: int, left: int, lo: int, hi: int, frag: bytes, depth: int):
    """The fragment's windows halved ``depth`` times."""
    for x in _split(h, doc, a, left, lo, hi, frag):
        if depth > 1 and x[5] < x[6]:
            yield from _parts(x[0], x[2], x[3], x[4], x[5], x[6], x[7], depth - 1)
        else:
            yield x


FRAG = "h long, f long, doc long, a long, left int, lo int, hi int, frag binary"
_FRAG_TYPES = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.binary()]
ALL = -(1 << 30)  # lo of claims and sources: every window counts


def expand(frags: DataFrame, hot: int = HOT, text_size: int = TEXT) -> DataFrame:
    """(t, FRAG): t 1 rows are repeating intervals [f, a) of ``doc``; t 0 rows are halves of
    buckets with more fragments than a text holds."""
    names = ["t"] + [x.split()[0] for x in FRAG.split(", ")]

    def marks(own):
        d, s, e = repeats(own)
        z, i = np.zeros(len(d), np.int64), np.zeros(len(d), np.int32)
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(d), np.int8)), pa.array(z), pa.array(s), pa.array(d), pa.array(e), pa.array(i), pa.array(i), pa.array(i), pa.nulls(len(d), pa.binary())], names=names)

    def halves(rows):
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(rows), np.int8)), *(pa.array(c, t) for c, t in zip(zip(*rows), _FRAG_TYPES))], names=names)

    def flat(copies):
        d, s, e = _merge(*(np.array(x, np.int64) for x in zip(*copies)))
        z, i = np.zeros(len(d), np.int64), np.zeros(len(d), np.int32)
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(d), np.int8)), pa.array(z), pa.array(s), pa.array(d), pa.array(e), pa.array(i), pa.array(i), pa.array(i), pa.nulls(len(d), pa.binary())], names=names)

    def run(batches):
        cur = last = head = None  # head: the source of a bucket of claims
        ready, room = [], 0  # whole small buckets
        own, size, split = [], 0, False  # the bucket at hand
        copies, pending = [], []
        for b in batches:
            for h, f, doc, a, left, lo, hi, frag in zip(*(c.to_pylist() for c in b.columns)):
                if h != cur:
                    if len(own) > 1 and not split:
                        if ready and room + size > text_size:
                            yield marks(ready)
                            ready, room = [], 0
                        ready += own
                        room += size
                    cur, last, head, own, size, split = h, None, None, [], 0, False
                if lo == ALL:  # hi is the place in the grid's cell
                    if head is None:
                        head = doc, a, hi, frag
                        continue
                    at = hi - head[2]
                    part = head[3][at : at + len(frag)]  # the source's stretch that it claims
                    if own and part == frag:
                        copies.append((doc, a, a + len(frag)))
                        continue
                    if size >= text_size:
                        yield marks(own)
                        own, size = [], 0
                    own.append((head[0], head[1] + at, 0, ALL, hi, part))
                    size += len(part)
                elif (f, frag) == last:  # the same bytes, later
                    copies.append((doc, a - left, a - left + len(frag)))
                    continue
                last = f, frag
                own.append((doc, a, left, lo, hi, frag))
                size += len(frag)
                if lo != ALL and (split or len(own) > hot):
                    split = True
                    pending += [x for y in own for x in _split(h, *y)]
                    own, size = [], 0
            if pending:
                yield halves(pending)
                pending = []
            if copies:
                yield flat(copies)
                copies = []
        if len(own) > 1 and not split:
            if ready and room + size > text_size:
                yield marks(ready)
                ready = []
            ready += own
        if ready:
            yield marks(ready)

    src = frags.repartition("h").sortWithinPartitions("h", "f", "doc", "a")
    return src.mapInArrow(run, "t byte, " + FRAG)


def claim_requests(claims: DataFrame) -> DataFrame:
    """(doc, kind, k, a, b, rel): the stretches of documents that claims (doc, a, b, src, at) need,
    by bucket k: kind 1 claims, kind 2 their sources, cut by the source's grid; ``rel`` is the
    source's place in its cell."""
    cell = F.explode(F.sequence(F.floor(F.col("at") / GRID), F.floor((F.col("at") + F.col("b") - F.col("a") - LENGTH) / GRID)))
    c = claims.withColumn("c", cell)
    lo = F.greatest("at", F.col("c") * GRID)
    hi = F.least(F.col("at") + F.col("b") - F.col("a"), (F.col("c") + 1) * GRID + LENGTH - 1)
    c = c.select("doc", "src", "c", lo.alias("s"), hi.alias("e"), (F.col("a") - F.col("at")).alias("far"))
    per, _ = save(c.groupBy("src", "c").count(), "suffix-sources")
    total = per.agg(F.sum("count")).first()[0] or 0
    # at most HOT_KEYS of them
    hot = per.where(F.col("count") > max(CLAIMS, total // HOT_KEYS)).select("src", "c", F.ceil(F.col("count") / CLAIMS).alias("n"))
    c = c.join(F.broadcast(hot), ["src", "c"], "left")
    salt = F.when(F.col("n").isNotNull(), F.pmod(F.xxhash64("doc", "s"), F.col("n"))).otherwise(0)
    c = c.withColumn("k", F.xxhash64("src", "c", salt))
    own = c.select("doc", F.lit(1).cast("byte").alias("kind"), "k", (F.col("s") + F.col("far")).alias("a"), (F.col("e") + F.col("far")).alias("b"), (F.col("s") - F.col("c") * GRID).alias("rel"))
    source = c.groupBy("src", "c", "k").agg(F.min("s").alias("a"), F.max("e").alias("b")).select(F.col("src").alias("doc"), F.lit(2).cast("byte").alias("kind"), "k", "a", "b", (F.col("a") - F.col("c") * GRID).alias("rel"))
    return own.unionByName(source)


def repeated_intervals(docs: DataFrame, key: str = "_key", text_col: str = "text") -> DataFrame:
    """(doc, a, b): intervals of bytes to remove, not yet merged."""
    first, _ = save(settle(emit_anchors(docs, key, text_col)), "suffix-anchors")
    # fragments of an anchor with very many are halved twice more before they are dealt
    contexts = first.where("t = 0").select("doc", F.lit(0).cast("byte").alias("kind"), F.col("h").alias("k"), F.col("b").alias("a"), F.when(F.col("a") == 1, 3).otherwise(1).cast("long").alias("b"), F.lit(0).cast("long").alias("rel"))
    claims, _ = save(merged(first.where("t = 1")), "suffix-claims")
    requests = contexts.unionByName(claim_requests(claims))
    want = requests.groupBy("doc").agg(F.collect_list(F.struct("kind", "k", "a", "b", "rel")).alias("at"))
    texts = docs.select(F.col(key).alias("doc"), F.col(text_col).cast("string").cast("binary").alias("text")).join(want, "doc")
    names = [x.split()[0] for x in FRAG.split(", ")]

    def cut(batches):
        for batch in batches:
            off, data = utf8(batch.column(1))
            at = batch.column(2)
            if isinstance(at, pa.ChunkedArray):
                at = at.combine_chunks()
            flat = at.flatten()
            row = np.repeat(np.arange(len(batch)), np.diff(at.offsets.to_numpy()))
            kind, k, a, b, rel = (flat.field(i).to_numpy() for i in range(5))
            anchored = kind == 0
            place, left, right = a >> 16, a >> 8 & 255, a & 255
            s = off[row] + np.where(anchored, place - left, a)
            e = off[row] + np.where(anchored, place + KMER + right, b)
            doc = batch.column(0).to_numpy()[row]
            mix = (doc * np.int64(0x9E3779B97F4A7C1) ^ a) | 1  # rows of a bucket need only an order
            rows, size = [], 0
            for i in range(len(row)):
                frag = data[s[i] : e[i]].tobytes()
                if anchored[i]:
                    rows += _parts(int(k[i]), int(doc[i]), int(place[i]), int(left[i]), 0, REACH, frag, int(b[i]))
                else:
                    rows.append((int(k[i]), int(mix[i]) if kind[i] == 1 else FIRST, int(doc[i]), int(a[i]), 0, ALL, int(rel[i]), frag))
                size += len(frag)
                if size >= 1 << 21:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _FRAG_TYPES)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _FRAG_TYPES)], names=names)

    frags, found = texts.mapInArrow(cut, FRAG), None
    while True:
        out, _ = save(expand(frags), "suffix-level")
        marked = out.where("t = 1").select("doc", F.col("f").alias("a"), F.col("a").alias("b"))
        found = marked if found is None else found.unionByName(marked)
        frags = out.where("t = 0").drop("t")
        if frags.limit(1).count() == 0:
            return found


def removed(docs: DataFrame, keep: list[str], key: str = "_key", text_col: str = "text") -> DataFrame:
    """``keep`` columns with n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that
    stay) and kept (those bytes without characters that were cut in two)."""
    spans = repeated_intervals(docs, key, text_col).groupBy(F.col("doc").alias("__of")).agg(F.collect_list(F.struct("a", "b")).alias("__spans"))
    j = docs.select(F.col(key).alias("__doc"), *[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("string").cast("binary").alias("__text")).join(spans, F.col("__doc") == F.col("__of"), "left").drop("__of", "__doc")
    schema = j.select(*[F.col(f"`{c}`") for c in keep]).schema
    for name, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"), ("kept", "string")):
        schema = schema.add(name, kind)

    def run(batches):
        for b in batches:
            rows = []
            for text, at in zip(b.column(len(keep)), b.column(len(keep) + 1)):
                t = text.as_py() or b""
                kept, gone, n = t, 0, 0
                if at.is_valid:
                    v = at.values
                    _, s, e = _merge(np.zeros(len(v), np.int64), v.field("a").to_numpy(), v.field("b").to_numpy())
                    n, gone = len(s), int((e - s).sum())
                    edges = [0, *np.stack([s, e], 1).ravel().tolist(), len(t)]
                    kept = b"".join(t[x:y] for x, y in zip(edges[::2], edges[1::2]))
                rows.append((len(t), gone, n, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")))
            cols = zip(*rows) if rows else [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[*b.schema.names[: len(keep)], "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return j.mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    rows = keyed(docs.select("doc_id", "text"))
    return removed(rows, ["doc_id"]).drop("kept")


def dedup_text(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with repeated passages cut from ``text`` (a character cut in two goes with
    its passage) and n_chars, if there, counted anew; null texts stay null."""
    r = removed(keyed(packed(docs, id_col, "text"), id_col), ["__row"])
    text = F.when(F.col("__row.text").isNotNull(), F.col("kept"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return unpacked(r, docs.columns, **changed)
