"""Benchmark decontamination by latent semantic retrieval and ordered-match checks.

Passages (blocks of ``BLOCK`` words) of all documents and the benchmark's items form a
TF-IDF matrix over ``FEATURES`` hashed words.  Its right singular vectors come from a
distributed randomised SVD: tasks sum their share of A'(A Omega) over all passages, the
shares are summed in partitions of features, and the driver decomposes one FEATURES x
SKETCH matrix (Nystroem form), whatever the corpus' size.  Items count as much as the
corpus in the matrix, else a few dozen directions would hold nothing but common words.

Passages, two adjacent blocks at a time so that a text never hides in a cut, and pieces of
items are projected, whitened by the singular values and compared by cosine.  Candidates over
``COSINE`` are checked exactly: longest common subsequence of words (bit-parallel) in the
stretch around the passage, at least ``STRICT`` of the item's words, or at least ``LOOSE``
with the answer there too.  An item's answer is its column ``answer``, where the benchmark has
one, else its last ``ANSWER`` words.

The cosine search leaves out passages that no match can lie in, whatever their cosine: of an
item's n words a match holds ``LOOSE`` n in order, so of any s of them at least LOOSE n - n + s.
An inverted index over each item's rarest words finds where so many stand close together;
only there passages are projected and compared.  The result is that of comparing all
passages with all items.

All items of up to ``BYTES`` of text are searched for in one pass; a larger benchmark takes a
pass for each block of about that size.

Defined results: null text has no words and is clean; items without words, or null, match
nothing; repeated rows are judged alike; other columns pass through ``drop_contaminated``
(no name clashes: nothing is added); empty documents or an empty benchmark give no links;
a word of any length is one word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, utf8

BLOCK = 16
FEATURES = 1 << 15
RANK, SKETCH = 28, 32
COSINE = 0.5
STRICT, LOOSE, ANSWER = 0.75, 0.6, 5
CHUNK = 1 << 18
SEGMENT, HITS = 1 << 16, 1 << 21  # words searched at once, and their entries in the index
BYTES = 1 << 25  # text of items searched for in one pass
PIECE = 20  # words of an item searched for at once

_CLASS = np.zeros(256, np.uint8)
for _c in range(256):
    _l = _c + 32 if 65 <= _c <= 90 else _c
    if _l >= 128 or 97 <= _l <= 122 or 48 <= _l <= 57:
        _CLASS[_c] = _l
_P = np.uint64(0x9E3779B97F4A7C15)
_powers: list = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        for base in (_P, inverse):
            x = np.full(CHUNK + 1, base, np.uint64)
            x[0] = 1
            _powers.append(np.cumprod(x))
    return _powers[0], _powers[1]


def _hash_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word in at most CHUNK bytes."""
    up, down = _tables()
    b = _CLASS[data]
    on = np.zeros(len(b) + 2, bool)
    np.not_equal(b, 0, out=on[1:-1])
    edge = np.flatnonzero(on[1:] != on[:-1])  # words begin and end in turn
    start, stop = edge[::2], edge[1::2]
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(np.multiply(up[: len(b)], b), out=total[1:])
    h = (total[stop] - total[start]) * down[start]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return start, h ^ h >> np.uint64(29)


def _hash_word(data: np.ndarray) -> np.ndarray:
    """The hash of one word of any length, as ``_hash_words`` gives it."""
    up, h, far = _tables()[0], 0, 1
    for i in range(0, len(data), CHUNK):
        b = _CLASS[data[i : i + CHUNK]]
        h += far * int(np.multiply(up[: len(b)], b).sum(dtype=np.uint64))
        far = far * pow(int(_P), CHUNK, 1 << 64) % (1 << 64)
    h = np.array([h % (1 << 64)], np.uint64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def groups(off: np.ndarray, data: np.ndarray):
    """(first row, words per row, word hashes) over whole documents, about CHUNK bytes at a
    time; a longer document is hashed in pieces cut between words."""
    i, n = 0, len(off) - 1
    while i < n:
        if off[i + 1] - off[i] > CHUNK:
            parts, s, end = [], off[i], off[i + 1]
            while s < end:
                e = min(s + CHUNK, end)
                if e < end:
                    gap = np.flatnonzero(_CLASS[data[s:e]] == 0)
                    if not len(gap):  # a word longer than a chunk
                        while e < end and (_CLASS[data[e : e + CHUNK]] != 0).all():
                            e = min(e + CHUNK, end)
                        e = e + int(np.argmin(_CLASS[data[e : e + CHUNK]] != 0)) if e < end else end
                        parts.append(_hash_word(data[s:e]))
                        s = e
                        continue
                    e = s + gap[-1] + 1
                parts.append(_hash_words(data[s:e])[1])
                s = e
            h = np.concatenate(parts)
            yield i, np.array([len(h)]), h
            i += 1
            continue
        j = i + 1
        while j < n and off[j + 1] - off[i] + j - i <= CHUNK:
            j += 1
        ends = off[i + 1 : j] - off[i]
        start, h = _hash_words(np.insert(data[off[i] : off[j]], ends, 32))  # words end where documents do
        row = np.searchsorted(ends + np.arange(len(ends)), start, "right")
        yield i, np.bincount(row, minlength=j - i), h
        i = j


def _blocks(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start word of each block, row of each block)."""
    k = -(-count // BLOCK)
    row = np.repeat(np.arange(len(count)), k)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
    return (np.cumsum(count) - count)[row] + inner * BLOCK, row


def _feature(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - 15)).astype(np.uint16)


def _sketch() -> np.ndarray:
    return np.random.default_rng(20240).standard_normal((FEATURES, SKETCH), np.float32)


def block_counts(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many passages of all documents each feature occurs; how many passages."""

    def run(batches):
        n, total = np.zeros(FEATURES, np.int64), 0
        for b in batches:
            for _, count, h in groups(*utf8(b.column(0))):
                start, _ = _blocks(count)
                if len(start):
                    # a row per block, sorted: each feature counts where it first stands
                    which = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(h))))
                    m = np.full((len(start), BLOCK), FEATURES, np.uint16)
                    m[which, np.arange(len(h)) - start[which]] = _feature(h)
                    m.sort(axis=1)
                    first = m < FEATURES
                    first[:, 1:] &= m[:, 1:] != m[:, :-1]
                    n += np.bincount(m[first], minlength=FEATURES)
                    total += len(start)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(n[at], total))], names=["f", "n"])

    part = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "f long, n long")
    got = part.groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    f, n = got.column("f").to_numpy(), got.column("n").to_numpy()
    out = np.zeros(FEATURES, np.int64)
    out[f[f >= 0]] = n[f >= 0]
    return out, int(n[f < 0].sum())


def gram(h: np.ndarray, start: np.ndarray, idf: np.ndarray, omega: np.ndarray, out: np.ndarray) -> None:
    """Adds to ``out`` what the blocks of words ``h`` give to A'(A Omega), short of the last
    factor idf; ``omega`` is Omega with rows times idf.  A block's weights have norm 1."""
    f = _feature(h)
    square = np.add.reduceat(np.square(idf)[f], start) + 1e-12
    y = np.add.reduceat(omega[f], start) / square[:, None]
    which = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(h))))
    o = np.argsort(f, kind="stable")
    fs = f[o]
    first = np.flatnonzero(np.r_[True, fs[1:] != fs[:-1]])
    out[fs[first]] += np.add.reduceat(y[which[o]], first)


def decompose(y: np.ndarray, omega: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Whitened right singular vectors (FEATURES x rank) from Y = A'A omega."""
    y, omega = y.astype(np.float64), omega.astype(np.float64)
    if not y.any():
        return np.zeros((len(y), rank), np.float32)
    shift = 1e-6 * np.linalg.norm(y)
    c = omega.T @ (y + shift * omega)
    root = np.linalg.cholesky((c + c.T) / 2 + 1e-9 * np.trace(c) / len(c) * np.eye(len(c)))
    b = np.linalg.solve(root, (y + shift * omega).T).T
    u, s, _ = np.linalg.svd(b, full_matrices=False)
    return (u[:, :rank] / np.maximum(s[:rank], 1e-3 * s[0])).astype(np.float32)


def latent_space(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", at_once: int = BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Each feature's vector, from all passages and all items, and in how many passages it is."""
    counts, total = block_counts(docs, text_col)
    idf = np.log((total + 1) / (counts + 1)).astype(np.float32)
    idf = np.maximum(idf, 0) ** 2
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(idf)
    omega = _sketch()

    def run(batches):
        idf = shared.value
        omega = _sketch() * idf[:, None]
        y = np.zeros((FEATURES, SKETCH), np.float32)
        for b in batches:
            for _, count, h in groups(*utf8(b.column(0))):
                if len(h):
                    gram(h, _blocks(count)[0], idf, omega, y)
        step = 256
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(0, FEATURES, step)), pa.array([y[i : i + step].tobytes() for i in range(0, FEATURES, step)], pa.binary())], names=["k", "y"])

    def add(batches):
        # a running sum by block of features; the tasks' shares are never held together
        sums: dict = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1)):
                v = np.frombuffer(v.as_buffer(), np.float32)
                sums[k] = sums[k] + v if k in sums else v.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.astype(np.float32).tobytes() for v in sums.values()], pa.binary())], names=["k", "y"])

    share = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "k long, y binary")
    got = share.repartition("k").mapInArrow(add, "k long, y binary").toArrow()
    y = np.zeros((FEATURES, SKETCH), np.float32)
    for k, v in zip(got.column("k").to_pylist(), got.column("y")):
        part = np.frombuffer(v.as_buffer(), np.float32).reshape(-1, SKETCH)
        y[k : k + len(part)] = part
    own, n = np.zeros_like(y), 0
    for items in item_blocks(benchmark, at_once):
        if items:
            size = np.array([len(x) for _, x, _ in items])
            gram(np.concatenate([x for _, x, _ in items]), np.cumsum(size) - size, idf, omega * idf[:, None], own)
            n += len(items)
    y += own * max(1.0, total / max(1, n))
    # words' vectors: a text's is their sum
    return decompose(y * idf[:, None], omega) * idf[:, None], counts


def project(h: np.ndarray, start: np.ndarray, space: np.ndarray) -> np.ndarray:
    return np.add.reduceat(space[_feature(h)], start)


def unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)


def lcs(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over the item's words."""
    full = (1 << n) - 1
    v = full
    for w in words:
        m = masks.get(w)
        if m:
            u = v & m
            v = (v + u) | (v - u)
    return n - (v & full).bit_count()


def _runs(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, value): for each i the values first[i], first[i] + 1, ..., count[i] of them."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + first[which]


class Judge:
    """Finds the items (id, words, answer words, all hashed) that a document's words hold."""

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray]], space, counts, cosine=COSINE, strict=STRICT, loose=LOOSE):
        self.items, self.space, self.cosine, self.strict, self.loose = items, space, cosine, strict, loose
        piece, ahead, behind, owner, words, of = [], [], [], [], [], []
        self.least = np.zeros(len(items), np.int64)
        for k, (_, h, _) in enumerate(items):
            n = len(h)
            step = -(-n // -(-n // PIECE))
            for i in range(0, n, step):
                piece.append(h[i : i + step])
                owner.append(k)
                # item words before and after the piece, and a quarter for words put in
                ahead.append(i + n // 4)
                behind.append(n - i - len(piece[-1]) + n // 4)
            # rare words of the item that make up what a match may leave out and a quarter more
            distinct, times = np.unique(h, return_counts=True)
            rare = np.lexsort((distinct, counts[_feature(distinct)]))
            spare = n - int(np.ceil(loose * n))
            held = np.cumsum(times[rare])
            m = int(np.searchsorted(held, spare + max(1, -(-n // 4)))) + 1
            words.append(distinct[rare[:m]])
            of.append(np.full(len(words[-1]), k))
            self.least[k] = held[min(m, len(held)) - 1] - spare
        none = np.zeros(0, np.int64)
        self.ahead, self.behind = np.array(ahead, np.int64), np.array(behind, np.int64)
        owner = np.array(owner, np.int64)
        self.pieces = np.bincount(owner, minlength=len(items))
        self.first = np.cumsum(self.pieces) - self.pieces
        most = lambda x: np.maximum.reduceat(x, self.first) if len(x) else none
        self.reach = most(self.ahead), most(self.behind)
        size = np.array([len(p) for p in piece])
        self.vectors = unit(project(np.concatenate(piece), np.cumsum(size) - size, space)) if piece else np.zeros((0, space.shape[1]), np.float32)
        # the inverted index: for each rare word its items
        words, of = np.concatenate([*words, np.zeros(0, np.uint64)]), np.concatenate([*of, none])
        o = np.lexsort((of, words))
        self.index = of[o]
        self.words, self.at, self.many = np.unique(words[o], return_index=True, return_counts=True)

    @staticmethod
    def _masks(h: list[int]) -> dict[int, int]:
        m: dict[int, int] = {}
        for i, w in enumerate(h):
            m[w] = m.get(w, 0) | 1 << i
        return m

    def candidates(self, count: np.ndarray, h: np.ndarray, place: np.ndarray):
        """Arrays (row, item, first word, end word, cosine, passage's begin) of passages over the
        cosine with words enough, of whole rows; ``place`` is each word's in the index, or -1."""
        width = len(h) + 1
        pos = np.flatnonzero(place >= 0)
        which, entry = _runs(self.at[place[pos]], self.many[place[pos]])
        key = np.sort(self.index[entry] * width + pos[which])  # (item, place) of every rare word
        item, pos = key // width, key % width
        start, row = _blocks(count)
        begin = np.cumsum(count) - count
        at_row = np.searchsorted(begin + count, pos, "right")
        # runs of as many rare words as a match holds, in one row and within the widest stretch
        ahead, behind = self.reach
        last = np.minimum(np.arange(len(key)) + self.least[item] - 1, len(key) - 1)
        full = np.arange(len(key)) + self.least[item] <= len(key)
        ok = full & (item[last] == item) & (at_row[last] == at_row) & (pos[last] - pos < (ahead + behind + 2 * BLOCK)[item])
        lo, hi, k, r = pos[ok], pos[last[ok]], item[ok], at_row[ok]
        # passages whose stretch may hold the run
        blocks = np.bincount(row, minlength=len(count))
        first = np.maximum(0, -(-(hi + 1 - 2 * BLOCK - behind[k] - begin[r]) // BLOCK))
        stop = np.minimum(blocks[r] - 1, (lo + ahead[k] - begin[r]) // BLOCK)
        base, m = (np.cumsum(blocks) - blocks)[r], len(self.items)
        near = np.unique(((base + first) * (len(start) + 1) + np.maximum(base + first, base + stop + 1)) * m + k)  # most runs lie in the same ones
        near, k = near // m, near % m
        first, stop = near // (len(start) + 1), near % (len(start) + 1)
        which, b = _runs(first, stop - first)
        pair = np.unique(b * m + k[which])
        b, k = pair // m, pair % m
        if not len(b):
            return
        # these passages' vectors, two blocks at a time
        own, back = np.unique(b, return_inverse=True)
        end = np.append(start[1:], len(h))
        after = np.minimum(own + 1, len(start) - 1)
        size = np.where((own + 1 < len(start)) & (row[after] == row[own]), end[after], end[own]) - start[own]
        _, word = _runs(start[own], size)
        x = unit(project(h[word], np.cumsum(size) - size, self.space))
        which, p = _runs(self.first[k], self.pieces[k])
        for i in range(0, len(p), 1 << 18):
            w, q = which[i : i + (1 << 18)], p[i : i + (1 << 18)]
            c = np.einsum("ij,ij->i", x[back[w]], self.vectors[q])
            near = np.flatnonzero(c >= self.cosine)
            w, q, c = w[near], q[near], c[near]
            r, s = row[b[w]], start[b[w]]
            lo, hi = np.maximum(begin[r], s - self.ahead[q]), np.minimum(begin[r] + count[r], s + 2 * BLOCK + self.behind[q])
            held = np.searchsorted(key, k[w] * width + hi) - np.searchsorted(key, k[w] * width + lo)
            enough = held >= self.least[k[w]]
            yield tuple(v[enough] for v in (r, k[w], lo, hi, c, s))

    def _segments(self, count: np.ndarray, place: np.ndarray):
        """(rows, first word, first row, passages begin from and below): whole rows of about
        SEGMENT words and HITS entries; a larger row in pieces that overlap by the widest
        stretch, so memory is bounded for any text and any number of items."""
        begin = np.cumsum(count) - count
        entries = np.append(0, np.cumsum(np.where(place >= 0, self.many[place], 0)))
        until = lambda a: min(a + SEGMENT, int(np.searchsorted(entries, entries[a] + HITS, "right")) - 1)
        reach = 2 * BLOCK + max(int(x.max()) for x in self.reach)
        reach = -(-reach // BLOCK) * BLOCK
        i = 0
        while i < len(count):
            a, z = int(begin[i]), int(begin[i] + count[i])
            if z <= (stop := until(a)):
                j = int(np.searchsorted(begin + count, stop, "right"))
                yield count[i:j], a, i, 0, len(place)
                i = j
                continue
            s = a
            while s < z:
                e = min(z, max(s + BLOCK, a + (until(s) - a) // BLOCK * BLOCK))
                lo = max(a, s - reach)
                yield np.array([min(z, e + reach) - lo]), lo, i, s - lo, e - lo
                s = e
            i += 1

    def found(self, count: np.ndarray, h: np.ndarray):
        """(row, item id, words in order, item words, answer words, cosine) of every match."""
        if not len(self.words) or not len(h):
            return
        best: dict = {}
        masks: dict = {}
        place = np.searchsorted(self.words, h)
        place[place == len(self.words)] = 0
        place[self.words[place] != h] = -1
        for rows, a, row, least, below in self._segments(count, place):
            z = a + int(rows.sum())
            words = h[a:z]
            for r, k, lo, hi, c, s in self.candidates(rows, words, place[a:z]):
                for i in np.flatnonzero((s >= least) & (s < below)).tolist():
                    item = int(k[i])
                    _, own, tail = self.items[item]
                    n, m = len(own), len(tail)
                    if hi[i] - lo[i] < self.loose * n:
                        continue
                    if item not in masks:
                        masks[item] = self._masks(own.tolist()), self._masks(tail.tolist())
                    part = words[lo[i] : hi[i]].tolist()
                    got = lcs(masks[item][0], n, part)
                    if got < self.loose * n:
                        continue
                    end = lcs(masks[item][1], m, part)
                    if got >= self.strict * n or end >= 0.6 * m:
                        key = row + int(r[i]), item
                        if key not in best or (got, end, float(c[i])) > best[key]:
                            best[key] = (got, end, float(c[i]))
        for (r, k), (got, end, c) in sorted(best.items()):
            yield r, self.items[k][0], got, len(self.items[k][1]), end, c


def _hashes(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return np.concatenate([h for *_, h in groups(np.array([0, len(raw)]), raw)] or [np.zeros(0, np.uint64)])


def item_blocks(benchmark: DataFrame, at_once: int = BYTES) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
    """(item id, word hashes, answer's word hashes) in blocks of about ``at_once`` bytes of text,
    so that what is collected, broadcast and searched for at once is bounded."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    b = benchmark.select("item_id", F.col("text").cast("string").alias("text"), answer.alias("answer")).where("text is not null")
    n = -(-(b.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // at_once) or 1
    for k in range(n):
        out = []
        for r in b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text", "answer").collect():
            if len(h := _hashes(r["text"])):
                own = _hashes(r["answer"])
                out.append((r["item_id"], h, own if len(own) else h[-ANSWER:]))
        yield out


def judges(docs: DataFrame, benchmark: DataFrame, text_col: str, at_once: int, how: dict):
    """What a Judge is made of, broadcast by block of items; the space is fitted once, on all
    passages and items."""
    space, counts = latent_space(docs, benchmark, text_col, at_once)
    for items in item_blocks(benchmark, at_once):
        yield docs.sparkSession.sparkContext.broadcast((items, space, counts, how))


def _judge(shared) -> Judge:
    items, space, counts, how = shared.value
    return Judge(items, space, counts, **how)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_once: int = BYTES, **how) -> DataFrame:
    """A row per document and item it holds."""
    out = None
    for shared in judges(docs, benchmark, text_col, at_once, how):
        found = _search(docs, shared, id_col, text_col)
        out = found if out is None else out.unionByName(found)
    return out


def _search(docs: DataFrame, shared, id_col: str, text_col: str) -> DataFrame:
    names = [id_col, "item_id", "lcs_words", "item_words", "answer_words", "cosine"]

    def run(batches):
        judge = _judge(shared)
        for b in batches:
            off, data = utf8(b.column(1))
            out = []
            for first, count, h in groups(off, data):
                for r, *rest in judge.found(count, h):
                    out.append((b.column(0)[int(first + r)].as_py(), *rest))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 5 + [pa.float64()])], names=names)

    src = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return src.mapInArrow(run, f"`{id_col}` long, item_id long, lcs_words long, item_words long, answer_words long, cosine double")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", at_once: int = BYTES, **how) -> DataFrame:
    """``docs`` without those that hold an item; decided where the document is read, so
    texts are not shuffled.  Between the passes of a large benchmark what is kept is written."""
    kept = None
    for shared in judges(docs, benchmark, text_col, at_once, how):
        kept = _filter(docs if kept is None else save(kept, "decontaminate")[0], shared, text_col)
    return kept


def _filter(docs: DataFrame, shared, text_col: str) -> DataFrame:
    at = docs.columns.index(text_col)

    def run(batches):
        judge = _judge(shared)
        for b in batches:
            ok = np.ones(b.num_rows, bool)
            for first, count, h in groups(*utf8(b.column(at))):
                for r, *_ in judge.found(count, h):
                    ok[first + r] = False
            yield b.filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)
