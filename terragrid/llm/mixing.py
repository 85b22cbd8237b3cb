"""Mixing sources to target weights by Poisson replication (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType


#: A Poisson count of a larger mean is the sum of counts of this mean and one of the rest, each with its own hash.
MOST_RATE = 32.0


def poisson_steps(rate: float) -> list[float]:
    """Cumulative Poisson probabilities up to where a uniform with 52 bits can't tell them from 1.

    A uniform u inverts to the number of steps that are not above it."""
    if rate <= 0:
        return []
    out, total, j = [], 0.0, 0
    while j <= rate or total < 1 - 2.0**-53:
        step = math.exp(-rate + j * math.log(rate) - math.lgamma(j + 1))
        if j > rate and step < 1e-18:
            break
        total += step
        out.append(total)
        j += 1
    return out


def uniform(name, seed: int, part=None):
    """A uniform in [0, 1) from the first 52 bits of an MD5 of the name, the seed and the part's number, if there are parts."""
    name = F.concat(name, F.lit(f":{seed}")) if part is None else F.concat(name, F.lit(f":{seed}:"), part.cast("string"))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2**52))


def mix_sources(df: DataFrame, weights: dict[str, float], total: float | None = None, id_col: str = "doc_id", source_col: str = "source", seed: int = 20260101) -> DataFrame:
    """Documents repeated so that each named source has its weight of ``total`` rows on average.

    ``weights`` sum to at most 1; sources that they don't name, null too, share the rest in
    proportion to their rows. total: rows wanted, by default those of the input. Each document
    is taken k times, k being a Poisson count with its source's mean rate, inverted from a hash
    of its identifier, so any run and any machine draws alike; rows that share an identifier
    share their draw, and a row without one draws by a hash of its whole content. Adds copy (from 1)
    and mix_key, by which the whole result is shuffled
    (range-partitioned and sorted); given columns of that name are replaced, any other name is allowed. A text's length, or
    null, changes nothing; an empty table gives an empty result.
    """
    if any(w < 0 for w in weights.values()) or sum(weights.values()) > 1 + 1e-9:
        raise ValueError("weights are non-negative and sum to at most 1")
    df = df.drop("copy", "mix_key")
    column = lambda c: F.col("`" + c.replace("`", "``") + "`")
    source = column(source_col)
    named = F.when(source.isin(list(weights)), source) if weights else F.lit(None).cast("string")
    # one row for each named source and one for the rest: as many as the parameter has
    counts = {r[0]: r[1] for r in df.groupBy(named.alias("s")).count().collect()}
    total = total if total is not None else float(sum(counts.values()))
    rest = max(0.0, 1 - sum(weights.values()))
    rates = {s: total * w / counts[s] for s, w in [(None, rest), *weights.items()] if counts.get(s)}

    def by_source(value, none):
        out = value(rates[None]) if None in rates else none
        for s in weights:
            out = F.when(F.col("source") == s, value(rates[s]) if s in rates else none).otherwise(out)
        return out

    # the given columns travel as one, so that none of their names can meet one of ours
    content = F.xxhash64(*[column(f.name) if not isinstance(f.dataType, (MapType, VariantType)) else column(f.name).cast("string") for f in df.schema]).cast("string")
    name = F.coalesce(column(id_col).cast("string"), F.concat(F.lit("\0"), content))
    rows = df.select(F.struct(*map(column, df.columns)).alias("row"), name.alias("name"), source.cast("string").alias("source"))
    numbers = lambda rate: F.array(*map(F.lit, poisson_steps(rate))).cast("array<double>")
    none = F.array().cast("array<double>")
    steps = by_source(lambda rate: numbers(math.fmod(rate, MOST_RATE)), none)
    rows = rows.withColumn("u", uniform(F.col("name"), seed)).withColumn("copies", F.size(F.filter(steps, lambda p: p <= F.col("u"))))
    if any(r >= MOST_RATE for r in rates.values()):
        parts = by_source(lambda rate: F.lit(int(rate // MOST_RATE)), F.lit(0))
        full = numbers(MOST_RATE)
        more = lambda i: F.size(F.filter(full, lambda p: p <= uniform(F.col("name"), seed, i)))
        each = F.transform(F.sequence(F.lit(0), parts), lambda i: F.when(i > 0, more(i)).otherwise(0))
        rows = rows.withColumn("copies", F.col("copies") + F.aggregate(each, F.lit(0), lambda a, x: a + x))
    taken = rows.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    key = F.md5(F.concat_ws(":", "name", F.col("copy").cast("string"), F.lit(str(seed))).cast("binary"))
    out = taken.select("row", "copy", key.alias("mix_key")).repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "mix_key").sortWithinPartitions("mix_key")
    return out.select("row.*", "copy", "mix_key")
