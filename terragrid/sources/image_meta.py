"""Image metadata: XML with rational camera, TAR archives around it, JSON state, run configuration."""

from __future__ import annotations

import io
import json
import posixpath
import tarfile
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as sc
from ..operators.meta import SENSORS
from .files import parsed, read_files

# fixed values: sensors as the files name them, and the RPC fields with their places in the XML
NAMES = {"rowNum": "LINENUMCOEFList/LINENUMCOEF", "rowDen": "LINEDENCOEFList/LINEDENCOEF", "colNum": "SAMPNUMCOEFList/SAMPNUMCOEF", "colDen": "SAMPDENCOEFList/SAMPDENCOEF"}
SCALARS = {"rowOff": "LINEOFFSET", "rowScale": "LINESCALE", "colOff": "SAMPOFFSET", "colScale": "SAMPSCALE", "latOff": "LATOFFSET", "latScale": "LATSCALE", "lonOff": "LONGOFFSET", "lonScale": "LONGSCALE", "altOff": "HEIGHTOFFSET", "altScale": "HEIGHTSCALE"}
ANGLES = {"sunAzim": "MEANSUNAZ", "sunElev": "MEANSUNEL", "satAzim": "MEANSATAZ", "satElev": "MEANSATEL", "cloudCover": "CLOUDCOVER"}


def parse_xml(path: str, raw: bytes):
    """One IMAGE_META row; unknown sensors are errors."""
    import datetime as dt

    root = ET.fromstring(raw)
    text = lambda p: root.find(f".//{p}").text.strip()
    sensor = text("IMD/IMAGE/SATID")
    if sensor not in SENSORS:
        raise ValueError(f"sensor {sensor} isn't supported")
    rpc = {k: [float(x) for x in text(f"RPB/IMAGE/{p}").split()] for k, p in NAMES.items()} | {k: float(text(f"RPB/IMAGE/{p}")) for k, p in SCALARS.items()}
    when = dt.datetime.fromisoformat(text("IMD/IMAGE/TLCTIME").replace("Z", "+00:00"))
    row = {k: float(text(f"IMD/IMAGE/{p}")) for k, p in ANGLES.items()}
    yield row | {"name": posixpath.basename(path).rsplit(".", 1)[0], "rpc": rpc, "width": int(text("IMD/NUMCOLUMNS")), "height": int(text("IMD/NUMROWS")), "capTime": when, "sensor_id": sensor}


def read_xml(spark: SparkSession, path: str, glob: str = "*.XML") -> DataFrame:
    """IMAGE_META rows with source and parse_error: rows that fail are kept apart, not lost."""
    return parsed(read_files(spark, path, glob), parse_xml, sc.IMAGE_META)


def tar_members(raw: bytes, wanted) -> dict[str, bytes]:
    """Regular members that ``wanted`` (a predicate on the name) accepts; names that lead out of the archive are errors."""
    out = {}
    with tarfile.open(fileobj=io.BytesIO(raw)) as tar:
        for m in tar:
            if not m.isfile() or not wanted(m.name):
                continue
            name = posixpath.normpath(m.name)
            if name.startswith(("/", "../")) or name == "..":
                raise ValueError(f"unsafe member {m.name}")
            out[name] = tar.extractfile(m).read()
    return out


def pan_members(names: list[str], stem: str) -> tuple[str, str | None]:
    """The metadata and browse picture (None if there is none) of an archive's panchromatic image: below the order's
    volume folder (DVD_VOL*; any place where an archive has no volume), in the folder that ends in _PAN, by the image's own name
    if there are several."""
    inside = [n for n in names if "_PAN/" in n]
    volume = [n for n in inside if any(part.startswith("DVD_VOL") for part in n.split("/"))] or inside
    xml = sorted(n for n in volume if n.upper().endswith(".XML"))
    if not xml:
        raise ValueError("no metadata of a panchromatic image")
    own = next((n for n in xml if posixpath.basename(n).rsplit(".", 1)[0] == stem), xml[0])
    picture = own.rsplit(".", 1)[0] + "-BROWSE.JPG"
    beside = sorted(n for n in volume if n.upper().endswith("-BROWSE.JPG") and posixpath.dirname(n) == posixpath.dirname(own))
    return own, picture if picture in beside else next(iter(beside), None)


def read_tar_xml(spark: SparkSession, path: str) -> DataFrame:
    """(img, member, xml, has_browse, browse) of each TAR: the metadata of its panchromatic image, stripped of control
    characters, and the bytes of its browse picture."""
    import unicodedata

    def parse(path, raw):
        members = tar_members(raw, lambda n: n.upper().endswith((".XML", "-BROWSE.JPG")))
        stem = posixpath.basename(path).rsplit(".", 1)[0]
        name, picture = pan_members(list(members), stem)
        text = members[name].decode("utf-8", "replace")
        yield {"img": stem, "member": name, "xml": "".join(c for c in text if unicodedata.category(c)[0] != "C"), "has_browse": picture is not None, "browse": members.get(picture)}

    return parsed(read_files(spark, path, "*.tar"), parse, "img string, member string, xml string, has_browse boolean, browse binary")


def list_images(spark: SparkSession, path: str, ext: str = ".NTF") -> DataFrame:
    """(path, stem) of the files with an extension, by name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ext}").load(path)
    return files.select("path", F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "").alias("stem")).orderBy("path")


def read_config(text: str) -> dict:
    """The run configuration, checked; dataset_dir becomes a list."""
    c = json.loads(text)
    missing = {"dataset_dir", "work_dir", "bounding_box", "steps_to_run", "alt_min", "alt_max"} - set(c)
    if missing:
        raise ValueError(f"configuration lacks {sorted(missing)}")
    if isinstance(c["dataset_dir"], str):
        c["dataset_dir"] = [c["dataset_dir"]]
    return c


def area(spark: SparkSession, config: dict) -> DataFrame:
    """The one AOI row: UTM corners and the latitude and longitude box around them."""
    from ..functions import geodesy

    b = config["bounding_box"]
    south = b["hemisphere"].upper().startswith("S")
    e0, n0 = b["ul_easting"], b["ul_northing"]
    e1, n1 = e0 + b["width"], n0 - b["height"]
    corners = spark.createDataFrame([(float(e), float(n)) for e in (e0, e1) for n in (n0, n1)], "east double, north double")
    at = corners.select(geodesy.from_utm(F.col("east"), F.col("north"), b["zone_number"], south).alias("p")).select("p.*")
    box = at.agg(F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"))
    fixed = {"zone_number": b["zone_number"], "hemisphere": b["hemisphere"], "ul_easting": e0, "ul_northing": n0, "lr_easting": e1, "lr_northing": n1, "width": b["width"], "height": b["height"], "alt_min": config["alt_min"], "alt_max": config["alt_max"]}
    return box.select(*[F.lit(v).alias(k) for k, v in fixed.items()], *box.columns)
