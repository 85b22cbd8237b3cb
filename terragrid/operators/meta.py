"""Image metadata: filters, pairing, chronology, crops and step logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SENSORS = ("WV01", "WV02", "WV03")
CLOUD_LIMIT, OVERLAP_LIMIT, BLANK_LIMIT = 0.5, 0.8, 0.2


def cloud_filter(df: DataFrame, cover: Column, limit: float = CLOUD_LIMIT) -> DataFrame:
    """Drops images above the limit; a null cover is dropped too."""
    return df.where(~(cover > limit))


def sensor_filter(df: DataFrame, sensor: Column, known: tuple[str, ...] = SENSORS) -> DataFrame:
    return df.where(sensor.isin(*known))


def paired(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows with a partner file (semi join)."""
    return df.join(other, key, "left_semi")


def chronological(df: DataFrame, when: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """All columns and ``idx`` from 0 by time, ties by name.

    Without keys rows are dealt to ranges of the time, whose bounds are approximate quantiles, numbered within
    them, and moved on by the number of rows in the ranges before: no task sorts all rows."""
    if keys:
        return df.withColumn("idx", (F.row_number().over(Window.partitionBy(*keys).orderBy(when, name)) - 1).cast("long"))
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.agg(F.percentile_approx(when, [i / ranges for i in range(1, ranges)] or [0.5], 10_000)).first()[0] or []
    kind = df.schema[when].dataType
    bounds = F.array(*[F.lit(c).cast(kind) for c in sorted(set(cuts))])
    dealt = df.withColumn("__range", F.size(F.filter(bounds, lambda c: c <= F.col(when))) if cuts else F.lit(0))
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    # as many rows as there are ranges
    before = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(when, name)) - 1
    return dealt.withColumn("idx", inside).join(F.broadcast(before), "__range").withColumn("idx", (F.col("idx") + F.col("__before")).cast("long")).drop("__range", "__before")


def crop_rebase(df: DataFrame, rpc: str, ul_col: Column, ul_row: Column) -> DataFrame:
    """Pixel offsets of an RPC struct moved to a crop's corner."""
    r = F.col(rpc)
    return df.withColumn(rpc, r.withField("colOff", r["colOff"] - ul_col).withField("rowOff", r["rowOff"] - ul_row))


def rounded_box(df: DataFrame, keys: list[str], col: Column, row: Column) -> DataFrame:
    """(keys, ul_col, ul_row, width, height): extents rounded half to even."""
    whole = lambda x: F.rint(x).cast("long")
    b = df.groupBy(*keys).agg(whole(F.min(col)).alias("ul_col"), whole(F.min(row)).alias("ul_row"), whole(F.max(col)).alias("c2"), whole(F.max(row)).alias("r2"))
    return b.select(*keys, "ul_col", "ul_row", (F.col("c2") - F.col("ul_col") + 1).alias("width"), (F.col("r2") - F.col("ul_row") + 1).alias("height"))


def milestones(df: DataFrame, key: str, when: str, order: list[str]) -> DataFrame:
    """All columns, seconds since the last milestone and since the first, of each key."""
    w = Window.partitionBy(key).orderBy(when, *order)
    micros = lambda a, b: (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 1e6
    return df.withColumns({"since_last": micros(F.col(when), F.lag(when).over(w)), "since_start": micros(F.col(when), F.first(when).over(w))})


def step_report(steps: DataFrame) -> DataFrame:
    """(step, n, n_run, minutes) and a total row."""
    per = steps.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("has_run").cast("long")).alias("n_run"), F.sum(F.when(F.col("has_run"), F.col("minutes")).otherwise(0.0)).alias("minutes"))
    total = per.agg(F.lit("total").alias("step"), F.sum("n").alias("n"), F.sum("n_run").alias("n_run"), F.sum("minutes").alias("minutes"))
    return per.unionByName(total)
