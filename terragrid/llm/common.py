"""Shared helpers of the training-data operators.

Words are found on the UTF-8 buffer of an Arrow string column: spans, exact codes and
hashes of all rows of a slice come from a few NumPy passes, without a Python object
for each word (but for words of over 16 bytes, which get a digest).
"""

from __future__ import annotations

import uuid
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: What separates words everywhere in this package: space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
#: The first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths that the operators wrote in this process, in order, until ``release`` deletes them.
WRITTEN: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    WRITTEN.append(f"{shared_dir(spark)}/terragrid-tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}")
    return WRITTEN[-1]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in any store that Spark reads."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession, since: int = 0) -> None:
    """Deletes the tables that the operators wrote after the first ``since`` of WRITTEN. For callers to use once a
    result is written elsewhere: one that isn't still reads from its tables."""
    for path in WRITTEN[since:]:
        remove(spark, path)
    del WRITTEN[since:]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: its lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop_stored(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that no later plan reads."""
    for t in tables:
        remove(t.sparkSession, t.stored_at)
        WRITTEN.remove(t.stored_at)


def ascii_lower(col):
    """Lower-cases A-Z only. ``lower`` does just that on pure ASCII text, and faster."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    h = h ^ (h >> np.uint64(32))
    h = h * _STEP
    h ^= h >> np.uint64(29)
    h *= _GOLD
    h ^= h >> np.uint64(32)
    return h


class Slice:
    """Some rows of a text column as one byte buffer; nulls are empty texts.

    ``offs`` has the start of each row in ``data`` and the end of the last. Words never
    cross rows. ``doc`` is the row of each word.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = False):
        self.data, self.offs = _LOWERED[data] if lower else data, offs
        self.rows = len(offs) - 1
        self.solid = _SOLID[self.data]
        n = len(data)
        first = self.solid.copy()
        last = self.solid.copy()
        if n:
            first[1:] &= ~self.solid[:-1]
            last[:-1] &= ~self.solid[1:]
            inner = offs[:-1][offs[:-1] < offs[1:]]
            first[inner] = self.solid[inner]
            ends = offs[1:][offs[:-1] < offs[1:]] - 1
            last[ends] = self.solid[ends]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offs, self.starts, "right") - 1
        self.n_words = np.bincount(self.doc, minlength=self.rows)
        self._codes = None

    def word_codes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(low, high, length) of each word: up to 16 bytes the bytes themselves, beyond that the
        halves of a BLAKE2b digest. Words are equal where all three are."""
        if self._codes is None:
            n = len(self.data)
            padded = np.zeros(n + 16, np.uint8)
            padded[:n] = self.data
            eight = np.ndarray((n + 9,), "<u8", padded, strides=(1,))
            size = self.ends - self.starts
            low = eight[self.starts] & _FIRST[np.minimum(size, 8)]
            high = eight[self.starts + 8] & _FIRST[np.clip(size - 8, 0, 8)]
            far = np.flatnonzero(size > 16)
            if len(far):
                raw = self.data.tobytes()
                digests = b"".join(blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(self.starts[far].tolist(), self.ends[far].tolist()))
                low[far], high[far] = np.frombuffer(digests, "<u8").reshape(-1, 2).T
            self._codes = low, high, size
        return self._codes

    def word_hash(self) -> np.ndarray:
        low, high, size = self.word_codes()
        return mix(low + mix(high + size.astype(np.uint64) * _GOLD))

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The index of the first word and the hash of each run of ``width`` words of a row."""
        h = self.word_hash()
        n = len(h) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for j in range(width):
            out *= _GOLD
            out += h[j : j + n]
        whole = np.flatnonzero(self.doc[:n] == self.doc[width - 1 :])
        return whole, mix(out[whole])

    def told_apart(self, first: np.ndarray, h: np.ndarray, width: np.ndarray | int, within: np.ndarray | int = 0) -> np.ndarray:
        """Numbers that are equal for equal windows only (words first to first + width, and equal in
        ``within``): the hashes ``h``, or ranks where windows with equal hashes differ."""
        codes = self.word_codes()
        most = int(np.max(width, initial=0))
        width, within = np.broadcast_to(width, first.shape), np.broadcast_to(within, first.shape)
        order = np.argsort(h)
        a, b = order[:-1], order[1:]
        meet = h[a] == h[b]
        a, b = a[meet], b[meet]
        same = (width[a] == width[b]) & (within[a] == within[b])
        for j in range(most):
            on = np.flatnonzero(same & (j < width[a]))
            for c in codes:
                same[on] &= c[first[a[on]] + j] == c[first[b[on]] + j]
        if same.all():
            return h
        last = max(len(codes[0]) - 1, 0)
        table = np.stack([width.astype(np.uint64), within.astype(np.uint64)] + [np.where(j < width, c[np.minimum(first + j, last)].astype(np.uint64), 0) for j in range(most) for c in codes], axis=1)
        return np.unique(table, axis=0, return_inverse=True)[1].reshape(-1).astype(np.uint64)

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes with a flag each row has."""
        return np.diff(np.searchsorted(np.flatnonzero(flags), self.offs))

    def row_bytes(self, i: int) -> bytes:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes()


def slices(column, lower: bool = False, limit: int = 1 << 18):
    """Yields (first row, Slice) over an Arrow string column, about ``limit`` bytes at a time;
    one longer text makes a slice of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, values = column.buffers()
    offs = np.frombuffer(offsets, np.int64, count=n + 1, offset=column.offset * 8)
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offs, offs[row] + limit, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, Slice(data[offs[row] : offs[end]], offs[row : end + 1] - offs[row], lower)
        row = end


def sorted_groups(batches, width: int):
    """Groups the rows of sorted Arrow batches by their first ``width`` columns; a group may go
    on in the next batch. Yields pyarrow Tables of one group each."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i) for i in range(width)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            codes = c.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            change[1:] |= codes[1:] != codes[:-1]
        bounds = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:]):
            now = tuple(c[a].as_py() for c in cols)
            if held and now != key:
                yield pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
