"""Byte-level BPE encoding and decoding.

A text of more than ``chunk`` characters is cut into chunks that overlap. Each chunk is
pre-tokenised on its own row; where the pre-token boundaries of two neighbours meet in their
overlap they agree from there on, so the text can be cut at that point, and the pieces are
encoded in parallel. A text whose chunks never meet (one unbroken run as long as the
overlap) is encoded in one piece. Shorter texts are one chunk.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

CHUNK, OVERLAP = 65_536, 2_048
_LOADED: dict = {}


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(name: str, pattern: str | None = None):
    """The encoding of a rank file of public_tokenizers, once a worker."""
    if name not in _LOADED:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[name] = tiktoken.Encoding(name, pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[name]


def _pattern():
    if "pattern" not in _LOADED:
        import public_tokenizers
        import regex

        _LOADED["pattern"] = regex.compile(public_tokenizers.PATTERN)
    return _LOADED["pattern"]


def ids_of(text: str, encoding) -> bytes:
    ids = encoding.encode_ordinary(text)
    return struct.pack(f"<{len(ids)}I", *ids)


def bytes_of(ids: bytes, encoding) -> bytes:
    """The bytes of the ids, one after another."""
    return encoding.decode_bytes(np.frombuffer(ids, "<u4").tolist()) if ids else b""


def boundaries(piece: str, chunk: int, overlap: int, first: bool, last: bool) -> tuple[list[int], list[int]]:
    """Pre-token starts in the overlap with the chunk before, and with the one after.

    Near the end of a piece that is cut a contraction ('re) can look like two tokens: starts
    among the last three characters are left out.
    """
    starts = [m.start() for m in _pattern().finditer(piece)]
    head = [] if first else [s for s in starts if s <= overlap]
    tail = [] if last else [s - chunk for s in starts if chunk <= s < len(piece) - 3]
    return head, tail


def _encoded(df: DataFrame, vocabulary: str, decode: bool) -> DataFrame:
    """df has __text first; its other columns and ids binary, with ``decode`` the bytes that the ids give back too."""
    names = [*df.columns[1:], "ids", *(["decoded"] if decode else [])]

    def run(batches):
        enc = load(vocabulary)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [ids_of(t, enc) if t else b"" for t in part.column(0).to_pylist()]
                cols = [pa.array(ids, pa.binary())]
                if decode:
                    cols.append(pa.array([bytes_of(x, enc) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *cols], names=names)

    return df.mapInArrow(run, StructType([*df.schema.fields[1:], *[StructField(n, BinaryType()) for n in names[len(df.columns) - 1 :]]]))


def bpe_encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", chunk: int = CHUNK, overlap: int = OVERLAP, decode: bool = False) -> DataFrame:
    """A row (id, n_tokens long, ids binary) for each row of ``df``; with ``decode`` also decoded binary, from the ids.

    ids are those that the tiktoken library's encode_ordinary gives for the whole text, as
    little-endian unsigned 32-bit integers. Null and empty texts have no ids. Rows that share an
    identifier stay rows of their own; a null identifier stays null. Other columns are left out.
    """
    rows = df.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("__n"))
    short = _encoded(rows.where(F.col("__n") <= chunk).select("__text", "__id"), vocabulary, decode)

    long = rows.withColumn("__row", F.monotonically_increasing_id()).where(F.col("__n") > chunk)
    pieces = long.select("__id", "__row", "__n", "__text", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / chunk).cast("int"))).alias("__k"))
    pieces = pieces.select(F.substring("__text", F.col("__k") * chunk + 1, F.lit(chunk + overlap)).alias("__text"), "__id", "__row", "__k", ((F.col("__k") + 1) * chunk >= F.col("__n")).alias("__last"))
    pieces = pieces.repartition("__row", "__k")
    spots = "array<int>"

    def mark(batches):
        for b in batches:
            texts, ks, lasts = (b.column(i).to_pylist() for i in (0, 3, 4))
            both = [boundaries(t, chunk, overlap, k == 0, last) for t, k, last in zip(texts, ks, lasts)]
            head = pa.array([h for h, _ in both], pa.list_(pa.int32()))
            tail = pa.array([t for _, t in both], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, head, tail], names=[*b.schema.names, "__head", "__tail"])

    marked = pieces.mapInArrow(mark, StructType([*pieces.schema.fields, *StructType.fromDDL(f"__head {spots}, __tail {spots}").fields]))
    doc = Window.partitionBy("__row").orderBy("__k")
    met = F.when(F.col("__k") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect(F.lag("__tail").over(doc), F.col("__head"))))
    cut = marked.withColumn("__from", met)
    every = Window.partitionBy("__row")
    cut = cut.withColumns({"__until": F.lead("__from").over(doc) + chunk, "__whole": F.max(F.col("__from").isNull()).over(every)})
    # where a pair of neighbours doesn't meet, the text is put together again
    start = F.when(F.col("__whole"), F.lit(0)).otherwise(F.col("__from"))
    until = F.when(F.col("__whole"), F.when(F.col("__last"), F.lit(chunk + overlap)).otherwise(F.lit(chunk))).otherwise(F.coalesce("__until", F.lit(chunk + overlap)))
    parts = cut.select("__id", "__row", "__k", "__whole", F.substring("__text", start + 1, until - start).alias("__text"))
    joined = (
        parts.where("__whole")
        .groupBy("__row")
        .agg(F.first("__id").alias("__id"), F.array_sort(F.collect_list(F.struct("__k", "__text"))).alias("t"))
        .select(F.array_join(F.col("t.__text"), "").alias("__text"), "__id", "__row", F.lit(0).alias("__k"))
    )
    segments = parts.where(~F.col("__whole")).select("__text", "__id", "__row", "__k").unionByName(joined)
    done = _encoded(segments, vocabulary, decode)
    blobs = ["ids", "decoded"] if decode else ["ids"]
    whole = done.groupBy("__row").agg(F.first("__id").alias("__id"), F.array_sort(F.collect_list(F.struct("__k", *blobs))).alias("t"))
    whole = whole.select("__id", *[F.unhex(F.array_join(F.transform(F.col(f"t.{c}"), lambda x: F.hex(x)), "")).alias(c) for c in blobs])

    out = short.unionByName(whole)
    return out.select(F.col("__id").alias(id_col), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), *blobs)


def bpe_decode(df: DataFrame, ids_col: str = "ids", vocabulary: str = "byte_bpe_50k.tiktoken", carry: list[str] | None = None) -> DataFrame:
    """The columns in ``carry`` (default: all but the ids) and decoded binary: the ids' bytes one after another.

    One row for each row; null and empty ids give no bytes, an id outside the vocabulary raises an error. A given
    column named decoded is replaced."""
    carry = [c for c in (df.columns if carry is None else carry) if c not in (ids_col, "decoded")]

    def run(batches):
        enc = load(vocabulary)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                raw = pa.array([bytes_of(x or b"", enc) for x in part.column(0).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], raw], names=[*part.schema.names[1:], "decoded"])

    return df.select(F.col(ids_col).alias("__ids"), *carry).mapInArrow(run, StructType([*[df.schema[c] for c in carry], StructField("decoded", BinaryType())]))


def bpe_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Encodes, decodes the ids in the same worker, and gives (id, n_tokens, ids_sha256, decoded_sha256)."""
    both = bpe_encode(df, id_col, text_col, vocabulary, chunk, overlap, decode=True)
    return both.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
