"""Quality rules: word and repetition counts, and zstandard compression bands."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import mix, slices

#: (bytes below which the row holds, least and largest ratio of a whole document).
DOCUMENT_BANDS = ((256, 0.0, 4.0), (1024, 1.2, 4.5), (4096, 1.35, 5.0), (16384, 1.5, 6.0), (float("inf"), 1.6, 8.0))
#: Bytes of a chunk, its band, and the share of chunks outside the band that rejects a document.
CHUNK_BYTES, CHUNK_BAND, CHUNK_SHARE = 4096, (1.3, 6.0), 0.25
LEVEL = 3

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, n_bytes long, zstd_ratio double, n_chunks long, n_bad_chunks long, verdict string, kept boolean"


def counts(s) -> dict[str, np.ndarray]:
    """The counts of each row of a Slice."""
    out = {"n_words": s.n_words}
    # all bytes of a word but those that go on with a code point
    out["word_chars"] = np.bincount(s.doc, weights=s.ends - s.starts, minlength=s.rows).astype(np.int64) - s.per_row(s.data & 0xC0 == 0x80)
    out["n_symbols"] = s.per_row(_SYMBOL[s.data])

    # lines with a word, less the different ones among them
    out["n_dup_lines"] = np.zeros(s.rows, np.int64)
    for i in np.flatnonzero(s.per_row(s.data == 10)):
        lines = [x for x in s.row_bytes(i).split(b"\n") if x.strip()]
        out["n_dup_lines"][i] = len(lines) - len(set(lines))

    first, w = s.windows(8)
    w = s.told_apart(first, w ^ mix(s.doc[first].astype(np.uint64) + np.uint64(1)), 8, s.doc[first])
    order = np.argsort(w)
    same = w[order[1:]] == w[order[:-1]]
    twice = np.zeros(len(w), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(s.doc) + 1, np.int64)
    cover[first[twice]] += 1
    cover[first[twice] + 8] -= 1
    inside = np.cumsum(cover[:-1]) > 0
    out["n_repeat_words"] = np.bincount(s.doc[inside], minlength=s.rows)
    return out


def judge_bands(raw: bytes, press) -> tuple[float, int, int, str | None]:
    """Ratio of the whole text, chunks, chunks outside the band, and why it is rejected if it is."""
    n = len(raw)
    if not n:
        return 0.0, 0, 0, None
    ratio = n / len(press(raw))
    low, high = next(b[1:] for b in DOCUMENT_BANDS if n < b[0])
    chunks = bad_high = bad_low = 0
    if n >= CHUNK_BYTES:
        for i in [*range(0, n - CHUNK_BYTES, CHUNK_BYTES), n - CHUNK_BYTES]:
            chunks += 1
            r = CHUNK_BYTES / len(press(raw[i : i + CHUNK_BYTES]))
            bad_high += r > CHUNK_BAND[1]
            bad_low += r < CHUNK_BAND[0]
    why = None
    if ratio > high or bad_high > CHUNK_SHARE * chunks:
        why = "repetitive"
    elif ratio < low or bad_low > CHUNK_SHARE * chunks:
        why = "incompressible"
    return ratio, chunks, bad_high + bad_low, why


def quality_columns(column) -> dict[str, list]:
    """The columns of SCHEMA for an Arrow column of texts."""
    import zstandard

    press = zstandard.ZstdCompressor(level=LEVEL).compress
    parts: dict[str, list] = {c.split()[0]: [] for c in SCHEMA.split(", ")}
    for _, s in slices(column):
        c = counts(s)
        base = (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])
        for name in COUNTS:
            parts[name].append(c[name])
        parts["base_failed"].append(base)
        parts["n_bytes"].append(np.diff(s.offs))
        bands = [judge_bands(s.row_bytes(i), press) for i in range(s.rows)]
        parts["zstd_ratio"].append(np.array([b[0] for b in bands]))
        parts["n_chunks"].append(np.array([b[1] for b in bands]))
        parts["n_bad_chunks"].append(np.array([b[2] for b in bands]))
        why = ["base" if f else b[3] for f, b in zip(base, bands)]
        parts["verdict"].append(np.array([w or "kept" for w in why], object))
        parts["kept"].append(np.array([w is None for w in why]))
    return {k: np.concatenate(v) if v else np.zeros(0) for k, v in parts.items()}


def quality_rules(df: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns of ``df`` (or those in ``carry``) and those of SCHEMA; one row for each row.

    Words are runs without space or \\x09-\\x0D. A row fails the base rules with under 20 words,
    or if over 30 % of its words lie in 8-word windows that its text has at least twice. Else its
    compression decides: the whole text and each chunk of 4096 bytes are compressed (the last chunk
    ends with the text and may overlap the one before; a shorter text has no chunk but itself), and
    the ratio must lie in the band for that length. verdict: kept, base, repetitive or incompressible.
    Null and empty texts have no words and fail; a text of any length is judged whole, in one task. Columns of ``df`` with an added name are replaced.
    """
    added = [c.split()[0] for c in SCHEMA.split(", ")]
    names = [c for c in (df.columns if carry is None else carry) if c not in added]
    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}

    def run(batches):
        for b in batches:
            new = quality_columns(b.column(0))
            cols = [pa.array(new[c.split()[0]], kinds[c.split()[1]]) for c in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *cols], names=[*names, *added])

    fields = [df.schema[c] for c in names] + StructType.fromDDL(SCHEMA).fields
    return df.select(F.col(text_col).alias("__text"), *names).mapInArrow(run, StructType(fields))
