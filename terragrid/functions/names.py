"""Names, dates and text of image products."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TAG = "-P1BS-"


def product_parts(name: Column) -> Column:
    """struct(img_name, order_id, prod_id) around the product tag; null without it."""
    base = F.substring_index(name, "/", -1)
    at = F.instr(base, _TAG)
    part = lambda start, n: F.substring(base, at + start, F.lit(n))
    # the image name begins thirteen characters before the tag
    whole = F.struct(part(-13, 39).alias("img_name"), part(6, 15).alias("order_id"), part(6, 20).alias("prod_id"))
    return F.when(at > 13, whole)


def stem(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def clean_text(text: Column) -> Column:
    """Without characters of Unicode category C (control, format, private use; line ends too)."""
    return F.regexp_replace(text, r"\p{C}", "")


def numbers(text: Column) -> Column:
    """White-space separated numbers as array<double>."""
    return F.transform(F.split(F.trim(text), r"\s+"), lambda s: s.try_cast("double"))


def utm_zone(projection: Column) -> Column:
    """struct(zone, hemisphere) of a projection string with "UTM zone 21S"; null without."""
    zone = F.regexp_extract(projection, r"UTM zone (\d+)([NS])", 1)
    return F.when(zone != "", F.struct(zone.cast("int").alias("zone"), F.regexp_extract(projection, r"UTM zone (\d+)([NS])", 2).alias("hemisphere")))


def ordered_name(index: Column, sensor: Column, base: Column) -> Column:
    """Target name: four-digit index, sensor, seven characters of date, rest."""
    return F.format_string("%04d_%s_%s_%s", index, sensor, F.substring(base, 1, 7), F.substring(base, F.lit(8), F.length(base)))
