"""WARC archives: writing with revisit records, reading with boundary-chain verification.

Writing.  Of records with equal payloads of ``least`` bytes or more, that with the
largest id is the response and the others revisit it.  Records go through Spark's text
sink, whose line separator closes a WARC record, so archives land in any store Spark
writes to; one archive per task, so archives stay as small as input partitions.  A
compressed archive is one stream (the sink knows no members); "none" gives archives that split.

Reading.  Tasks split archives at the version line (the magic).  A payload may hold the
magic too, so a piece is only a candidate: it parses a record head there and emits the
offset of its would-be successor.  Pointer jumping (successor of successor, doubling)
from each archive's start retains the reachable candidates; the pieces in between are
joined to the record that spans them.  An archive of up to CHAIN pieces is one group of
places and lengths, never payloads; one with more, whose payloads must be dense in
magics, jumps by joins on (archive, place), dealt to all tasks.

A revisit has no payload: its length and digest are those of the response that its
WARC-Refers-To names, and must be the ones it declares; a response must have the digest it
declares.  Where that fails the read fails (``strict``), or ``problem`` says what is wrong.

Record ids are made of id and digest, so they repeat only where rows repeat whole.

Defined results: a null payload is empty; a null id or url is left out of the record
head and reads back as null; control characters and spaces of urls are percent-encoded; rows
that share payload and largest id are all responses; other columns are ignored; an empty
table gives an archive without records and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, salted, save

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
LEAST = 1000
CHAIN = 1 << 20


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = LEAST) -> DataFrame:
    """(id, url, body, digest, n, refers_to): refers_to is null for responses."""
    p = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(body_col), F.lit("")).alias("body"))
    p = p.withColumn("digest", F.sha1(F.col("body").cast("binary"))).withColumn("n", F.octet_length("body").cast("long"))
    # counts before ids: only payloads that repeat are kept, aggregated map-side
    twice = p.where(F.col("n") >= least).groupBy("digest").agg(F.max("id").alias("top"), F.count("*").alias("c")).where("c > 1")
    # copies of one payload, however many, are dealt to many tasks; small payloads stay where they are
    large = salted(p.where(F.col("n") >= least), twice.select("digest", "top"), "digest", "id", "left")
    small = p.where(F.col("n") < least).withColumn("top", F.lit(None).cast("long"))
    j = large.unionByName(small)
    return j.withColumn("refers_to", F.when(F.col("top") != F.coalesce("id", F.lit(-(1 << 63))), F.col("top"))).drop("top")


def _encoded(url):
    """Control characters and spaces as percent escapes of their code."""
    char = r"[\x00-\x20\x7F]"
    each = F.transform(F.split(url, ""), lambda c: F.when(c.rlike(char), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c))
    return F.when(url.rlike(char), F.array_join(each, "")).otherwise(url)


def _urn(id, b32):
    return F.concat(F.lit("<urn:page:"), F.coalesce(id.cast("string"), F.lit("")), F.lit(":"), b32, F.lit(">"))


def _head(kind: str, date):
    """The record head as a column."""
    url = _encoded(F.col("url"))
    b32 = F.col("_b32")
    lines = [
        F.lit(MAGIC + f"WARC-Type: {kind}\r\n"),
        F.concat(F.lit("WARC-Record-ID: "), _urn(F.col("id"), b32), F.lit("\r\n")),
        F.concat(F.lit("WARC-Date: "), date, F.lit("\r\n")),
        F.when(url.isNotNull(), F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n"))).otherwise(F.lit("")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), b32, F.lit("\r\n")),
    ]
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    if kind == "revisit":
        lines += [
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
            F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("refers_to"), b32), F.lit("\r\n")),
        ]
        block = http
    else:
        block = F.concat(http, F.col("body"))
    lines += [F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END)]
    return F.concat(*lines, block)


def _base32(hexed):
    """Base32 of a 40-digit hex string: each 5 hex digits are 4 base-32 digits."""
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    out = []
    for i in range(8):
        v = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(digits), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def write_warc(records: DataFrame, path: str, compression: str = "gzip", date: Column | None = None) -> None:
    """Archives of ``plan_records`` under ``path``; ``date`` is the capture time, else the
    time of writing."""
    at = F.date_format(F.current_timestamp() if date is None else date, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    r = records.withColumn("_b32", _base32(F.col("digest")))
    value = F.when(F.col("refers_to").isNull(), _head("response", at)).otherwise(_head("revisit", at))
    r.select(value.alias("value")).write.option("lineSep", END).option("compression", compression).text(path)


def _parse(piece: bytes) -> tuple[int, dict] | None:
    """(length of head, fields) if a record head stands here."""
    stop = piece.find(b"\r\n\r\n")
    if stop < 0:
        return None
    fields = {}
    for line in piece[:stop].split(b"\r\n"):
        k, sep, v = line.partition(b":")
        if not sep:
            return None
        fields[k.strip().lower()] = v.strip()
    return (stop + 4, fields) if fields.get(b"content-length", b"").isdigit() else None


def _payload(block: bytes) -> bytes:
    """The HTTP message body of a record block."""
    stop = block.find(b"\r\n\r\n")
    return block[stop + 4 :] if block.startswith(b"HTTP/") and stop >= 0 else block


def _id_of(urn: bytes) -> int | None:
    v = urn.removeprefix(b"<urn:page:").partition(b":")[0]
    return int(v) if v.lstrip(b"-").isdigit() else None


PIECE = "file string, block long, rel long, span long, size long, whole boolean, kind string, urn string, id long, url string, refers string, declared string, n long, sha1 string"


def _fields(f: dict) -> list:
    """(kind, urn, id, url, refers, declared) of a record head."""
    text = lambda k: f[k].decode("utf-8", "replace") if k in f else None
    told = f.get(b"warc-payload-digest", b"").removeprefix(b"sha1:")
    declared = base64.b32decode(told).hex() if re.fullmatch(rb"[A-Z2-7]{32}", told) else None
    return [text(b"warc-type"), text(b"warc-record-id"), _id_of(f.get(b"warc-record-id", b"")), text(b"warc-target-uri"), text(b"warc-refers-to"), declared]


def _digest(block: bytes, fields: dict) -> tuple[int, str | None]:
    """(length, SHA-1) of a response's payload; of a revisit the length it declares."""
    if fields.get(b"warc-type") == b"revisit":
        length = re.search(rb"(?i)^content-length: *(\d+)\r?$", block, re.M)
        return int(length[1]) if length else -1, None
    body = _payload(block)
    return len(body), hashlib.sha1(body).hexdigest()


def pieces(spark: SparkSession, path: str, bodies: bool = False) -> DataFrame:
    """Every piece between two magics: its place, whether a head parses (``size`` is then
    the record's length, else null) and, if the record lies within, its payload's digest."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    src = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    magic = len(MAGIC)

    def run(batches):
        at, rel = None, 0
        for b in batches:
            out = []
            for file, block, value in zip(*(c.to_pylist() for c in b.columns)):
                if (file, block) != at:
                    at, rel = (file, block), 0
                # the text before the first magic of an archive is empty
                row = [file, block, rel, len(value) + magic, None, False, *[None] * 8]
                if head := _parse(value):
                    n, f = head
                    length = int(f[b"content-length"])
                    row[4] = magic + n + length + len(END)
                    row[5] = n + length + len(END) == len(value) or n + length == len(value)
                    row[6:12] = _fields(f)
                    if row[5]:
                        row[12:14] = _digest(value[n : n + length], f)
                if bodies:
                    row.append(value)
                out.append(row)
                rel += len(value) + magic
            cols = zip(*out) if out else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=fields)

    fields = [x.split()[0] for x in PIECE.split(", ")] + ["value"] * bodies
    of = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    types = [of[x.split()[1]] for x in PIECE.split(", ")] + [pa.binary()] * bodies
    return src.mapInArrow(run, PIECE + ", value binary" * bodies)


def reachable(start: np.ndarray, succ: np.ndarray, origin: int) -> np.ndarray:
    """Which candidates a chain from ``origin`` visits, by pointer jumping: the visited
    set doubles each round, as does the jump.  ``start`` is sorted; ``succ`` is where each
    record would end (negative: no record)."""
    n = len(start)
    to = np.searchsorted(start, succ)
    good = (to < n) & (succ >= 0)
    good[good] = start[to[good]] == succ[good]
    jump = np.append(np.where(good, to, n), n)
    seen = np.zeros(n + 1, bool)
    first = np.searchsorted(start, origin)
    if first < n and start[first] == origin:
        seen[first] = True
    for _ in range(max(1, n).bit_length() + 1):
        seen[jump[np.flatnonzero(seen)]] = True
        jump = jump[jump]
    return seen[:n]


PLACE = "file string, block long, rel long, record boolean, owner long"


def chained(part: DataFrame) -> DataFrame:
    """PLACE of the pieces of archives of up to CHAIN pieces, a group each: ``owner`` is the
    place of the record that a piece belongs to."""

    def chain(key, t):
        block, rel = t.column("block").to_numpy(), t.column("rel").to_numpy()
        # rel counts bytes from the first magic a block reads; blocks follow each other
        order = np.lexsort((rel, block))
        block, rel = block[order], rel[order]
        span = t.column("span").to_numpy()[order]
        ends = np.cumsum(span)
        # the piece before an archive's first magic has no magic of its own
        start = ends - span - len(MAGIC)
        size = t.column("size").to_numpy(zero_copy_only=False)[order]
        none = ~(size >= 0)
        succ = np.where(none, -1, start + np.where(none, 0, size).astype(np.int64))
        keep = reachable(start, succ, 0)
        owner = np.maximum.accumulate(np.where(keep, np.arange(len(keep)), -1))
        return pa.table({"file": pa.array([key[0].as_py()] * len(start), pa.string()), "block": block, "rel": rel, "record": keep, "owner": np.where(owner < 0, -1, start[np.maximum(owner, 0)])})

    return part.select("file", "block", "rel", "span", "size").groupBy("file").applyInArrow(chain, PLACE)


def chained_by_joins(part: DataFrame) -> DataFrame:
    """The same by joins on (archive, place): no task holds an archive.  Each round doubles the
    jump and is written to the shared folder."""
    key = ["file", "start"]
    blocks = part.groupBy("file", "block").agg(F.sum("span").alias("s"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    base = blocks.select("file", "block", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    p = salted(part.select("file", "block", "rel", "span", "size"), base, ["file", "block"], "rel")
    p, _ = save(p.withColumn("start", F.col("base") + F.col("rel") - len(MAGIC)).drop("base"), "warc-places")
    candidates = p.where("size >= 0").select(*key, (F.col("start") + F.col("size")).alias("to"))
    seen, jump = candidates.where("start = 0").select(*key), candidates
    n = seen.count()
    while True:
        to = seen.join(jump, key).select("file", F.col("to").alias("start")).join(candidates.select(*key), key, "left_semi")
        seen, _ = save(seen.unionByName(to).distinct(), "warc-seen")
        if (now := seen.count()) == n:
            break
        n = now
        further = jump.select("file", F.col("start").alias("to"), F.col("to").alias("next"))
        jump, _ = save(jump.join(further, ["file", "to"]).select("file", "start", F.col("next").alias("to")), "warc-jump")
    marked = p.join(seen.withColumn("record", F.lit(True)), key, "left").withColumn("record", F.coalesce("record", F.lit(False)))
    # a piece in a record points to the piece before it, a record to itself; jumps lead to the record
    ahead = marked.select("file", (F.col("start") + F.col("span")).alias("start"), F.col("start").alias("before"))
    link = marked.join(ahead, key, "left").select(*key, F.when(F.col("record"), F.col("start")).otherwise(F.coalesce("before", F.lit(-1))).alias("owner"))
    link, _ = save(link, "warc-link")
    while True:
        over = link.select("file", F.col("start").alias("owner"), F.col("owner").alias("next"))
        nxt, _ = save(link.join(over, ["file", "owner"], "left").select(*key, F.coalesce("next", "owner").alias("owner"), (F.coalesce("next", "owner") != F.col("owner")).alias("moved")), "warc-link")
        link = nxt.drop("moved")
        if nxt.where("moved").limit(1).count() == 0:
            break
    return marked.join(link, key).select("file", "block", "rel", "record", "owner")


def read_warc(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """One row per record: id, url, n, sha1, kind, refers (the response's id), problem.  Records
    whose payload holds magics are put together from their pieces; candidates that no chain
    reaches are dropped."""
    part, _ = save(pieces(spark, path), "warc-pieces")
    # at most one name in CHAIN pieces: a bounded broadcast
    dense, _ = save(part.groupBy("file").count().where(F.col("count") > CHAIN).select("file"), "warc-dense")
    if dense.limit(1).count():
        places = chained(part.join(F.broadcast(dense), "file", "left_anti")).unionByName(chained_by_joins(part.join(F.broadcast(dense), "file", "left_semi")))
    else:
        places = chained(part)
    known, _ = save(part.join(places, ["file", "block", "rel"]).drop("span"), "warc-known")
    cols = ["urn", "id", "url", "n", "sha1", "kind", "refers", "declared"]
    found = known.where("record and whole").select(*cols)
    torn = known.where("record and not whole").select("file", "owner").distinct()
    if torn.limit(1).count():
        # read again only what records that hold magics are made of
        need = known.join(torn, ["file", "owner"], "left_semi").select("file", "block", "rel", "owner")
        again = pieces(spark, path, bodies=True).join(need, ["file", "block", "rel"])

        def join(key, t):
            t = t.sort_by([("block", "ascending"), ("rel", "ascending")])
            value = MAGIC.encode().join(x.as_py() for x in t.column("value"))
            n, f = _parse(value)
            kind, urn, id, url, refers, declared = _fields(f)
            length, sha1 = _digest(value[n : n + int(f[b"content-length"])], f)
            row = [urn, id, url, length, sha1, kind, refers, declared]
            return pa.table([[x] for x in row], schema=pa.schema([(c, pa.int64() if c in ("id", "n") else pa.string()) for c in cols]))

        mended = again.groupBy("file", "owner").applyInArrow(join, ", ".join(f"{c} {'long' if c in ('id', 'n') else 'string'}" for c in cols))
        found, _ = save(found.unionByName(mended), "warc-records")
    return resolved(found, strict)


def resolved(found: DataFrame, strict: bool = True) -> DataFrame:
    """Records with the length and digest of revisits taken from the responses they name; a
    response's many revisits are dealt to many tasks."""
    response = found.where("kind <> 'revisit' OR kind IS NULL")
    bad = F.when(F.col("declared").isNotNull() & (F.col("declared") != F.col("sha1")), F.concat(F.lit("payload of "), F.coalesce("urn", F.lit("?")), F.lit(" has another digest than declared")))
    own = response.select("id", "url", "n", "sha1", "kind", F.lit(None).cast("long").alias("refers"), bad.alias("problem"))
    revisit = found.where("kind = 'revisit'").select("urn", "id", "url", F.col("n").alias("told"), "kind", F.coalesce("refers", F.lit("")).alias("refers"), "declared")
    wanted = revisit.select("refers").distinct()
    named = response.join(wanted, response.urn == wanted.refers, "left_semi").groupBy(F.col("urn").alias("refers")).agg(F.first("id").alias("of"), F.first("n").alias("n"), F.first("sha1").alias("sha1"))
    j = salted(revisit, named, "refers", "urn", "left")
    say = lambda what: F.concat(F.lit("revisit "), F.coalesce("urn", F.lit("?")), F.lit(f" {what} "), F.col("refers"))
    bad = F.when(F.col("sha1").isNull(), say("names no response")).when(~F.col("sha1").eqNullSafe(F.col("declared")) | (F.col("n") != F.col("told")), say("differs from"))
    other = j.select("id", "url", "n", "sha1", "kind", F.col("of").alias("refers"), bad.alias("problem"))
    out = own.unionByName(other)
    if strict:  # whoever reads a payload's length or digest meets the error
        sure = lambda c, t: F.when(F.col("problem").isNotNull(), F.raise_error(F.col("problem")).cast(t)).otherwise(F.col(c))
        out = out.withColumns({"n": sure("n", "long"), "sha1": sure("sha1", "string")})
    return out


def round_trip(pages: DataFrame, compression: str = "gzip", least: int = LEAST) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_warc(plan_records(pages, least=least), path, compression)
    return read_warc(spark, path)
