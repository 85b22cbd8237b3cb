"""Rasters as relations (row, col, z): binning, dense grids, hole filling, median filters.

Neighbourhood windows scatter each cell to the cells it touches and aggregate there once:
nine fixed slots with a plain max each, so the aggregate has a fixed width, runs in
generated code, and combines before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.image import clip, gamma, scale_to_byte
from .robust import global_percentiles, percentiles

_OFFSETS = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def cell_of(east: Column, north: Column, ul_e: float, ul_n: float, e_res: float, n_res: float) -> tuple[Column, Column]:
    """(row, col) of a point; rows go down from the upper left corner."""
    return F.floor((ul_n - north) / n_res).cast("int"), F.floor((east - ul_e) / e_res).cast("int")


def cell_corner(row: Column, col: Column, ul_e: float, ul_n: float, e_res: float, n_res: float) -> tuple[Column, Column]:
    """(east, north) of a cell."""
    return ul_e + col * e_res, ul_n - row * n_res


def grid_size(width: Column, height: Column, res: float) -> tuple[Column, Column]:
    """(rows, cols) that cover an extent."""
    return (F.floor(height / res) + 1).cast("int"), (F.floor(width / res) + 1).cast("int")


def grid_max(df: DataFrame, keys: list[str], row: Column, col: Column, value: Column, rows: int, cols: int) -> DataFrame:
    """(keys, row, col, z): largest value of each cell inside the grid; NaN is void."""
    v = F.when(~F.isnan(value), value)
    cells = df.select(*keys, row.cast("int").alias("row"), col.cast("int").alias("col"), v.alias("z"))
    cells = cells.where(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1) & F.col("z").isNotNull())
    return cells.groupBy(*keys, "row", "col").agg(F.max("z").alias("z"))


def lattice(spark: SparkSession, *sizes: int) -> DataFrame:
    """All index tuples (i0, i1, ...), the first outermost: one range, split by division."""
    total = 1
    for s in sizes:
        total *= s
    out, rest = [], total
    for k, s in enumerate(sizes):
        rest //= s
        out.append(F.pmod(F.floor(F.col("id") / rest), F.lit(s)).cast("int").alias(f"i{k}"))
    return spark.range(total).select(*out)


def linspace(index: Column, low: float, high: float, n: int) -> Column:
    return index * ((high - low) / (n - 1)) + low


def stack_mean(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, row, col, mean, n) over the pictures of a stack; voids don't count, and a cell that is void in all has no row."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, "row", "col").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def densify(df: DataFrame, rows: int, cols: int) -> DataFrame:
    """Every cell of the grid, void (null) where ``df`` has none."""
    grid = lattice(df.sparkSession, rows, cols).toDF("row", "col")
    return grid.join(df.select("row", "col", "z"), ["row", "col"], "left")


def void_ratio(dense: DataFrame, keys: list[str]) -> DataFrame:
    """Share of void cells of a dense raster."""
    return dense.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"), (1 - F.count("z") / F.count(F.lit(1))).alias("void_ratio"))


def _slots(df: DataFrame, keys: list[str], rows: int, cols: int, edge: str) -> DataFrame:
    """Each cell that a valued cell touches, with slots s0..s8; slot 4 is its own value.

    edge: "drop" leaves out what lies outside; "clamp" repeats the border outwards.
    """
    shifts = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(j).alias("j")) for k, (i, j) in enumerate(_OFFSETS)])
    hit = df.where(F.col("z").isNotNull()).select(*keys, "row", "col", "z", F.explode(shifts).alias("o"))
    to_row, to_col = F.col("row") - F.col("o.i"), F.col("col") - F.col("o.j")
    if edge == "clamp":
        # beyond the border stands the border itself: a cell's outward neighbour is the cell, under the outward slot
        out_row, out_col = ~to_row.between(0, rows - 1), ~to_col.between(0, cols - 1)
        number = 3 * (F.when(out_row, -F.col("o.i")).otherwise(F.col("o.i")) + 1) + F.when(out_col, -F.col("o.j")).otherwise(F.col("o.j")) + 1
        at = hit.select(*keys, F.when(out_row, F.col("row")).otherwise(to_row).alias("row"), F.when(out_col, F.col("col")).otherwise(to_col).alias("col"), "z", number.alias("k"))
    else:
        at = hit.select(*keys, to_row.alias("row"), to_col.alias("col"), "z", F.col("o.k").alias("k")).where(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1))
    return at.groupBy(*keys, "row", "col").agg(*[F.max(F.when(F.col("k") == k, F.col("z"))).alias(f"s{k}") for k in range(9)])


def _median(values: Column) -> Column:
    v = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(v)
    mid = lambda i: F.get(v, i.cast("int"))
    return F.when(n > 0, (mid(F.floor((n - 1) / 2)) + mid(F.floor(n / 2))) / 2)


_ALL = [f"s{k}" for k in range(9)]


def hole_fill(df: DataFrame, rows: int, cols: int, keys: list[str] | None = None) -> DataFrame:
    """Valued cells and, for each void one with valued neighbours, their median; one pass over the cells as they were.

    Voids without a neighbour stay void (no row)."""
    keys = keys or []
    near = _slots(df, keys, rows, cols, "drop")
    return near.select(*keys, "row", "col", F.coalesce("s4", _median(F.array(*_ALL))).alias("z"))


def median3x3(df: DataFrame, rows: int, cols: int, keys: list[str] | None = None) -> DataFrame:
    """Median of the valued cells among each valued cell's nine, borders repeated; voids stay void."""
    keys = keys or []
    near = _slots(df, keys, rows, cols, "clamp").where(F.col("s4").isNotNull())
    return near.select(*keys, "row", "col", _median(F.array(*_ALL)).alias("z"))


def crop(df: DataFrame, ul_row: int, ul_col: int, rows: int, cols: int) -> DataFrame:
    """The cells of a window, with row and col from its corner; a filter that reaches the scan."""
    kept = df.where(F.col("row").between(ul_row, ul_row + rows - 1) & F.col("col").between(ul_col, ul_col + cols - 1))
    return kept.withColumns({"row": F.col("row") - ul_row, "col": F.col("col") - ul_col})


def warp(picture: DataFrame, to_source: list[list[float]], rows: int, cols: int, border: float = 0.0) -> DataFrame:
    """(row, col, value) of a picture (row, col, value) seen through a homography, bilinear, with a constant border.

    to_source takes a target pixel (col, row, 1) to the source. Each target pixel asks for its
    four source cells; one join and one sum answer all."""
    t = lattice(picture.sparkSession, rows, cols).toDF("row", "col")
    u, v, w = (F.col("col") * a + F.col("row") * b + c for a, b, c in to_source)
    t = t.select("row", "col", F.try_divide(u, w).alias("x"), F.try_divide(v, w).alias("y")).where("x is not null and y is not null")
    t = t.withColumns({"x0": F.floor("x"), "y0": F.floor("y")}).withColumns({"fx": F.col("x") - F.col("x0"), "fy": F.col("y") - F.col("y0")})
    corner = lambda i, j: F.struct((F.col("y0") + i).cast("int").alias("row"), (F.col("x0") + j).cast("int").alias("col"), ((F.col("fy") if i else 1 - F.col("fy")) * (F.col("fx") if j else 1 - F.col("fx"))).alias("share"))
    asks = t.select("row", "col", F.explode(F.array(*[corner(i, j) for i in (0, 1) for j in (0, 1)])).alias("s"))
    source = picture.select(F.col("row").alias("srow"), F.col("col").alias("scol"), F.col("value").cast("double").alias("value"))
    got = asks.join(source, (F.col("s.row") == F.col("srow")) & (F.col("s.col") == F.col("scol")), "left")
    return got.groupBy("row", "col").agg(F.sum(F.col("s.share") * F.coalesce("value", F.lit(border))).alias("value"))


def tone_map(df: DataFrame, keys: list[str], value: str, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """All columns and ``byte``: gamma, clipped to two percentiles of its image, 0 to 255 cut off."""
    g = df.withColumn("__g", gamma(F.col(value).cast("double")))
    cut = percentiles(g, keys, "__g", {"__lo": low, "__hi": high})
    return g.join(cut, keys).withColumn("byte", scale_to_byte(F.col("__g"), F.col("__lo"), F.col("__hi"))).drop("__g", "__lo", "__hi")


def blank_ratio(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Share of pixels that are black: under a thousandth of the full byte."""
    return df.groupBy(*keys).agg(F.avg((value / 255 < 1e-3).cast("int")).alias("blank_ratio"))


def clip_percentiles(df: DataFrame, value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """All columns and ``clipped``: the value within its two percentiles over all rows."""
    lo, hi = global_percentiles(df, value, [low, high])
    return df.withColumn("clipped", clip(F.col(value), F.lit(lo), F.lit(hi)))


def stamp(points: DataFrame, keys: list[str], col: Column, row: Column, radius: int, width: Column, height: Column) -> DataFrame:
    """(keys, row, col): pixels within ``radius`` boxes around points, each once, inside the image."""
    c, r = F.floor(col).cast("int"), F.floor(row).cast("int")
    spread = lambda x, top: F.sequence(F.greatest(x - radius, F.lit(0)), F.least(x + radius, top.cast("int") - 1))
    valid = points.where((c - radius < width) & (r - radius < height) & (c + radius >= 0) & (r + radius >= 0))
    rows = valid.select(*keys, F.explode(spread(r, height)).alias("row"), spread(c, width).alias("cs"))
    return rows.select(*keys, "row", F.explode("cs").alias("col")).distinct()
