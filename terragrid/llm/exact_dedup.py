"""Exact deduplication by content sort (DataFrame functions only).

Rows are range-partitioned on their normalised text by sampled splitters, each range is
sorted externally, equal texts meet as neighbours and are compared in full. The range key
goes on with a hash of the text and of the identifier, so that no text, prefix or group of
copies can fill a range of its own: a large group is cut at splitters, and the few groups
that a splitter cuts (one for each splitter at most) are put together again by a broadcast
of at most as many rows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from .common import ascii_lower

#: Characters of the text with which a range key begins.
PREFIX = 48
#: Sampled keys for each range; they only place the splitters.
SAMPLE_PER_RANGE = 40


def _text_key(norm):
    return F.concat(F.rpad(F.substring(norm, 1, PREFIX), PREFIX, "\0"), F.lpad(F.hex(F.xxhash64(norm)), 16, "0"))


def _splitters(keys: DataFrame, count: int, ranges: int) -> list[str]:
    """Splitters from a hash sample of the keys, bounded by the number of ranges; keys has ``key`` and ``pick``."""
    want = SAMPLE_PER_RANGE * ranges
    step = max(1, count // want)
    sample = sorted(r[0] for r in keys.where(F.pmod("pick", F.lit(step)) == 0).select("key").limit(4 * want).collect())
    cut = [sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else []
    return sorted(set(cut))


def _range_of(key, splitters: list[str]):
    """How many splitters are not above the key; two levels, so a row looks at about 2 * sqrt(n). The plan holds
    the splitters as one literal, not as an expression for each."""
    if not splitters:
        return F.lit(0)
    width = max(1, int(len(splitters) ** 0.5))
    rows = [splitters[i : i + width] for i in range(0, len(splitters), width)]
    low = F.from_json(F.lit(json.dumps([r[0] for r in rows])), "array<string>")
    table = F.from_json(F.lit(json.dumps(rows)), "array<array<string>>")
    coarse = F.size(F.filter(low, lambda s: s <= key))
    fine = F.size(F.filter(F.element_at(table, coarse), lambda s: s <= key))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * width + fine)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", ranges: int | None = None) -> DataFrame:
    """All columns of ``df`` with keep_id, group_size, kept and text_sha256.

    Texts are equal if they are after lower-casing A-Z only; null counts as empty, and a text of any
    length is compared whole. Of equal texts the row with the largest (``keep="min"``: smallest)
    identifier stays, in the order of the identifier's own type; among rows that share that
    identifier exactly one does. A null identifier loses against any other; if all of
    a group are null, keep_id is null. Empty tables give empty results. Of the given columns,
    those named like an added one are replaced; any other name is allowed. Ranges are told apart by text, identifier
    and all other columns; only rows that are equal in all of them have to share a task.
    """
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = df.drop("keep_id", "group_size", "kept", "text_sha256")
    # the given columns travel as one, so that none of their names can meet one of ours
    name = lambda c: F.col("`" + c.replace("`", "``") + "`")
    others = [name(f.name) for f in df.schema if f.name not in (id_col, text_col) and not isinstance(f.dataType, (MapType, VariantType))]
    text = F.coalesce(name(text_col), F.lit(""))
    norm = ascii_lower(text)
    key = F.concat(_text_key(norm), F.hex(F.xxhash64(name(id_col), *others, F.lit(7))))
    source = df.select(F.struct(*map(name, df.columns)).alias("row"), name(id_col).alias("id"), text.alias("text"), norm.alias("norm"), key.alias("key"))
    picked = df.select(key.alias("key"), F.xxhash64(norm, name(id_col), *others, F.lit(11)).alias("pick"))
    splitters = _splitters(picked, df.count(), ranges)

    # one shuffle of the texts; each range arrives whole, and its sort puts equal texts together.
    # the key is a column of its own: inside the lambdas it would be computed for every splitter
    dealt = source.select("row", "id", "key").withColumn("range", _range_of(F.col("key"), splitters)).drop("key").repartitionById(ranges, F.col("range"))
    first = F.col("id").desc_nulls_last() if keep == "max" else F.col("id").asc_nulls_last()
    same = Window.partitionBy("range", "norm").orderBy(first).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    again = ascii_lower(F.coalesce(F.col("row").getField(text_col), F.lit("")))
    local = (
        dealt.withColumn("norm", again)
        .withColumns({"n": F.count(F.lit(1)).over(same), "top": F.first(F.struct("id")).over(same), "rank": F.row_number().over(same.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
        .withColumn("digest", F.sha2(F.col("norm"), 256))
        .drop("norm")
    )

    # groups that a splitter cuts have the splitter's text key: at most one a splitter
    cut = sorted({s[: PREFIX + 16] for s in splitters})
    among = lambda col, values: F.array_contains(F.from_json(F.lit(json.dumps(values)), "array<string>"), col)
    begin = F.rpad(ascii_lower(F.substring("text", 1, PREFIX)), PREFIX, "\0")
    pick = F.max if keep == "max" else F.min
    whole = (
        source.where(among(begin, sorted({s[:PREFIX] for s in cut})))
        .where(among(F.substring("key", 1, PREFIX + 16), cut))
        .select("norm", "id", _range_of(F.col("key"), splitters).alias("range"))
        .groupBy("norm")
        .agg(F.count(F.lit(1)).alias("all"), pick(F.struct(F.col("id").isNotNull() if keep == "max" else F.col("id").isNull(), "id", "range")).alias("best"))
        .select(F.sha2("norm", 256).alias("digest"), "all", "best")
    )
    found = local.join(F.broadcast(whole), "digest", "left")
    alone = F.col("best").isNull()
    return found.select(
        "row.*",
        F.when(alone, F.col("top.id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("all", "n").cast("long").alias("group_size"),
        ((F.col("rank") == 1) & (alone | (F.col("best.range") == F.col("range")))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
