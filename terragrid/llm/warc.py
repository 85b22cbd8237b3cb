"""WARC archives: writing records and reading them back by boundary chains.

Reading takes byte ranges of each file in parallel. A task splits its range at the version line
("magic"), and for each candidate record notes where its successor must begin by its
Content-Length. Within a range candidates jump straight to where their chain leaves it; over
ranges, pointer jumping from the start of the file keeps the candidates that the file's own
chain reaches. A magic inside a payload is no link of that chain, so it stays payload.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, sorted_groups, stored

MAGIC, END = "WARC/1.1\r\n", "\r\n\r\n"
_M, _E = len(MAGIC), len(END)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Groups of equal payloads, and ranges, that go by broadcast; more go by a join.
BROADCAST_ROWS = 100_000
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_LENGTH = re.compile(rb"^content-length:[ \t]*(\d+)[ \t]*\r?$", re.I | re.M)


def base32_of_hex(hexa):
    """Base32 of 40 hexadecimal digits: eight times five digits are four letters."""
    number = lambda i: F.conv(F.substring(hexa, 5 * i + 1, 5), 16, 10).cast("int")
    letter = lambda n, k: F.substring(F.lit(_ALPHABET), F.shiftright(n, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1))
    return F.concat(*[letter(number(i), k) for i in range(8) for k in range(4)])


def _safe(col):
    """A header value: no control characters."""
    return F.regexp_replace(F.coalesce(col.cast("string"), F.lit("")), r"[\x00-\x1F\x7F]", " ")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> str:
    """Writes a record for each row of ``pages`` to WARC 1.1 files in ``path``; returns ``path``.

    Of rows with equal payloads of at least ``least_bytes`` bytes those with the largest identifier
    are response records and all others revisits that refer to it, without a payload; smaller
    payloads, and rows without an identifier where no other has their payload, are all responses.
    A null payload is empty, a null URL an empty target. The text writer puts the records out,
    ended by their two empty lines, so a lost task is written anew like any Spark output.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    digests = rows.select("id", F.sha1(F.col("payload").cast("binary")).alias("digest"), F.octet_length("payload").alias("n"))
    groups = stored(digests.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("digest", "keep"), "warc-groups")
    few = groups.count() <= BROADCAST_ROWS
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary"))).join(F.broadcast(groups) if few else groups, "digest", "left")
    revisit = F.col("keep").isNotNull() & ~F.col("id").eqNullSafe(F.col("keep"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    body = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("id")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), _safe(F.col("url")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), base32_of_hex(F.col("digest")),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), name(F.col("keep")), F.lit(f"\r\nWARC-Profile: {PROFILE}"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    rows.select(F.concat(head, body).alias("value")).write.option("lineSep", END).text(path)
    return path


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): what stands between two magics, in each byte range's own order."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _next(value: bytes) -> int | None:
    """From a chunk's start to the chunk of the record after it; None for no header."""
    at = value.find(b"\r\n\r\n")
    m = _LENGTH.search(value, 0, at + 2) if at >= 0 else None
    return at + 4 + int(m[1]) + _E + _M if m else None


def _ranges(batches):
    for b in batches:
        files, blocks, values = (b.column(i).to_pylist() for i in range(3))
        yield from zip(files, blocks, values)


def _candidates(batches):
    """For each range: its candidates (rel, exit) and its length (rel -1)."""
    key, at, found = None, 0, []

    def ended():
        leave, out = {}, []
        for rel, nxt in reversed(found):
            to = rel + nxt
            # a successor inside the range must be a candidate itself
            leave[rel] = leave.get(to) if to < at else to
            out.append((rel, leave[rel]))
        out.append((-1, at))
        n = len(out)
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], names=["file", "block", "rel", "leave"])

    for file, block, value in _ranges(batches):
        if (file, block) != key:
            if key:
                yield ended()
            key, at, found = (file, block), 0, []
        if block or at:  # before the first magic of a file there is no record
            nxt = _next(value)
            if nxt is not None:
                found.append((at, nxt))
        at += len(value) + _M
    if key:
        yield ended()


def _reached(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, base, entry, after): where each byte range begins, its first record on the file's chain, and the first one at or behind the range."""
    index = stored(_chunks(spark, path).mapInArrow(_candidates, "file string, block long, rel long, leave long"), "warc-index")
    order = Window.partitionBy("file").orderBy("block")
    ranges = index.where("rel = -1").withColumn("base", F.sum("leave").over(order) - F.col("leave")).select("file", "block", "base", F.col("leave").alias("size"))
    ranges = stored(ranges, "warc-ranges")
    hints = F.broadcast(ranges) if ranges.count() <= BROADCAST_ROWS else ranges
    records = index.where("rel >= 0").join(hints, ["file", "block"]).select("file", "block", (F.col("base") + F.col("rel")).alias("at"), (F.col("base") + F.col("leave")).alias("to"))
    # nodes: the file's start and wherever some chain leaves a range
    start = ranges.where("block = 0").select("file", F.lit(_M).cast("long").alias("at"))
    nodes = stored(records.join(records.select("file", F.col("to").alias("at")).union(start).distinct(), ["file", "at"], "left_semi"), "warc-nodes")
    reach, jump = start, nodes.select("file", "at", "to")
    have = -1
    for i in itertools.count():
        reach = stored(reach.union(reach.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct(), f"warc-reach-{i}")
        now = reach.count()
        if now == have:
            break
        have = now
        jump = stored(jump.join(jump.select("file", F.col("at").alias("to"), F.col("to").alias("far")), ["file", "to"]).select("file", "at", F.col("far").alias("to")), f"warc-jump-{i}")
    first = nodes.join(reach, ["file", "at"], "left_semi").groupBy("file", "block").agg(F.min("at").alias("entry"))
    behind = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = F.max(F.col("base") + F.col("size")).over(Window.partitionBy("file"))
    return ranges.join(first, ["file", "block"], "left").select("file", "block", "base", "entry", F.coalesce(F.min("entry").over(behind), whole).alias("after"))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of a record without its magic and end; an HTTP block's payload is its body."""
    head, _, block = raw.partition(b"\r\n\r\n")
    headers = dict((k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")))
    block = block[: int(headers.get("content-length", len(block)))]
    if headers.get("content-type", "").startswith("application/http"):
        block = block.partition(b"\r\n\r\n")[2]
    return headers, block


RECORD = "file string, at long, record_type string, record_id string, target_uri string, refers_to string, declared_digest string, payload_bytes long, payload_digest string, payload binary"
_PIECE = f"done boolean, stop long, {RECORD}"


def _row(file, at, raw: bytes, with_payload: bool) -> tuple:
    h, payload = parse_record(raw)
    return (file, at, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-refers-to"), h.get("warc-payload-digest"), len(payload), digest_of(payload), payload if with_payload else None)


def _as_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def _records(with_payload: bool):
    """Whole records of each range. Of a record in several ranges each has a piece (done false) under where the record
    stops; the first one's record_type is "head"."""

    def run(batches):
        key, open_at, stop, head, parts, out = None, 0, 0, False, [], []
        at, due, lost = 0, None, False

        def close():  # the range ends, or a record begins: what is open goes on elsewhere
            if parts:
                out.append((False, stop, key[0], open_at, "head" if head else "more", *[None] * 6, b"".join(parts)))

        for b in batches:
            for file, block, base, entry, after, value in zip(*(b.column(i).to_pylist() for i in range(6))):
                if (file, block) != key:
                    close()
                    # what comes before the range's first record belongs to one that began earlier
                    key, at, due, open_at, head, parts, lost = (file, block), base, entry, base, False, [], False
                    stop = after
                nxt = _next(value) if at == due else None
                if nxt is not None:
                    close()
                    open_at, head, parts = at, True, [value]
                    stop = due = at + nxt
                elif (at or block) and not lost:  # before a file's first magic there is nothing
                    parts.append(MAGIC.encode() + value)
                at += len(value) + _M
                if head and parts and at >= stop:
                    out.append((True, stop, *_row(key[0], open_at - _M, b"".join(parts), with_payload)))
                    # a record that doesn't end at a magic is the last one of its file's chain
                    parts, lost = [], at > stop
                if len(out) >= 256:
                    yield _as_batch(out, _PIECE)
                    out.clear()
        close()
        yield _as_batch(out, _PIECE)

    return run


def _assembled(with_payload: bool):
    def run(batches):
        out = []
        for g in sorted_groups(batches, 2):
            pieces = sorted(zip(g.column("at").to_pylist(), g.column("record_type").to_pylist(), g.column("payload").to_pylist()))
            raw = b"".join(p for _, _, p in pieces)
            start = pieces[0][0]
            if pieces[0][1] == "head" and len(raw) + _M == g.column("stop")[0].as_py() - start:
                out.append(_row(g.column("file")[0].as_py(), start - _M, raw, with_payload))
        yield _as_batch(out, RECORD)

    return run


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row (RECORD) for each record of the archives in ``path``.

    payload_bytes and payload_digest (base32 SHA-1) are those of the stored payload; a revisit's
    is empty. ``with_payload`` False leaves the payload out, so that it never leaves the task.
    Files without a record give none; bytes that no chain from a file's start reaches are no records. Files
    ending in .gz are read through Spark's codec, each as one range (the format can't be split); of members too.
    """
    reached = stored(_reached(spark, path), "warc-reached")
    chunks = _chunks(spark, path)
    if reached.count() <= BROADCAST_ROWS:
        placed = chunks.join(F.broadcast(reached), ["file", "block"])
    else:
        placed = chunks.withColumn("seq", F.monotonically_increasing_id()).join(reached, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "seq")
    found = stored(placed.select("file", "block", "base", "entry", "after", "value").mapInArrow(_records(with_payload), _PIECE), "warc-records")
    pieces = found.where("not done").select("file", "stop", "at", "record_type", "payload").repartition("file", "stop").sortWithinPartitions("file", "stop", "at")
    return found.where("done").drop("done", "stop").unionByName(pieces.mapInArrow(_assembled(with_payload), RECORD))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` as WARC in the shared folder, reads the archives, and gives for each record
    (id, payload_bytes, payload_digest, record_type, refers_to): figures of the whole
    payload, a revisit's from the record it refers to, checked against the digest both declare."""
    spark = pages.sparkSession
    path = write_warc(pages, scratch(spark, "warc"), id_col, url_col, payload_col, least_bytes)
    records = read_warc(spark, path, with_payload=False)
    kind = pages.schema[id_col].dataType
    number = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(.*)>$", 1), F.lit("null"))
    rows = records.select(number(F.col("record_id")).alias("id"), "record_type", number(F.col("refers_to")).alias("ref"), F.regexp_replace("declared_digest", "^sha1:", "").alias("declared"), "payload_bytes", "payload_digest")
    own = rows.where("record_type = 'response'").select(F.col("id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.lit(None).cast(kind).alias("refers_to"))
    first = rows.where("record_type = 'response'").groupBy(F.col("id").alias("ref"), F.col("payload_digest").alias("declared")).agg(F.max("payload_bytes").alias("whole"))
    other = rows.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(first, ["ref", "declared"], "left")
    lost = F.raise_error(F.concat(F.lit("no response for the revisit of page "), F.coalesce("id", F.lit("null")), F.lit(" of "), F.coalesce("ref", F.lit("null"))))
    other = other.withColumn("whole", F.when(F.col("whole").isNull(), lost.cast("long")).otherwise(F.col("whole")))
    return own.unionByName(other.select(F.col("id").cast(kind).alias(id_col), F.col("whole").alias("payload_bytes"), F.col("declared").alias("payload_digest"), "record_type", F.col("ref").cast(kind).alias("refers_to")))
