import io
import struct
import tarfile

import numpy as np
import pytest

from terragrid.operators import sparse
from terragrid.sources import database, dense_map, files, geotiff, image_meta, images, ply, reports, sparse_model

CAMERAS = "# a comment\n1 PERSPECTIVE 800 600 1000.5 1001 400 300 0.25\n\n2 PINHOLE 640 480 900 900 320 240\n"
IMAGES = "# two lines a record\n1 1 0 0 0 0.5 -1 2 1 b.png\n1.5 2.5 7 3 4 -1\n2 0.5 0.5 0.5 0.5 0 0 0 2 a.png\n\n"
POINTS = "7 1.5 2 3 10 20 255 0.125 1 0\n8 -1 0 0 0 0 0 1e-3\n"


def binary_model() -> dict[str, bytes]:
    cams = struct.pack("<Q", 2) + struct.pack("<iiQQ5d", 1, 11, 800, 600, 1000.5, 1001, 400, 300, 0.25) + struct.pack("<iiQQ4d", 2, 1, 640, 480, 900, 900, 320, 240)
    imgs = struct.pack("<Q", 2) + struct.pack("<i7di", 1, 1, 0, 0, 0, 0.5, -1, 2, 1) + b"b.png\0" + struct.pack("<Q", 2) + struct.pack("<ddq", 1.5, 2.5, 7) + struct.pack("<ddq", 3, 4, -1)
    imgs += struct.pack("<i7di", 2, 0.5, 0.5, 0.5, 0.5, 0, 0, 0, 2) + b"a.png\0" + struct.pack("<Q", 0)
    pts = struct.pack("<Q", 2) + struct.pack("<QdddBBBd", 7, 1.5, 2, 3, 10, 20, 255, 0.125) + struct.pack("<Q2i", 1, 1, 0) + struct.pack("<QdddBBBd", 8, -1, 0, 0, 0, 0, 0, 1e-3) + struct.pack("<Q", 0)
    return {"cameras.bin": cams, "images.bin": imgs, "points3D.bin": pts}


def test_sparse_model_text_equals_binary(spark, tmp_path):
    for n, t in (("cameras.txt", CAMERAS), ("images.txt", IMAGES), ("points3D.txt", POINTS)):
        (tmp_path / n).write_text(t)
    for n, b in binary_model().items():
        (tmp_path / n).write_bytes(b)
    text, raw = sparse_model.read_model(spark, str(tmp_path), ".txt"), sparse_model.read_model(spark, str(tmp_path), ".bin")
    for a, b, key in zip(text, raw, ("camera_id", "image_id", "point3d_id")):
        assert a.orderBy(key).collect() == b.orderBy(key).collect() and a.count() == 2
    cams, imgs, pts = text
    assert sparse.camera_dict(imgs, cams).where("img = 'b.png'").first()["camera"] == [800, 600, 1000.5, 1001, 400, 300, 0.25, 1, 0, 0, 0, 0.5, -1, 2]
    assert sparse.observations(pts, imgs).first()["consistent"]
    sparse_model.write_init_model(cams, imgs, f"{tmp_path}/init")
    back = sparse_model.read_cameras(spark, f"{tmp_path}/init/cameras/*.txt").orderBy("camera_id").collect()
    assert back == cams.orderBy("camera_id").collect()
    sparse_model.write_extracted(sparse.observations(pts, imgs).where("img is not null"), sparse.camera_dict(imgs, cams), pts, f"{tmp_path}/ex")
    assert spark.read.json(f"{tmp_path}/ex/tracks").count() == 1


@pytest.mark.parametrize("form", ["ascii", "binary_little_endian", "binary_big_endian"])
def test_ply_round_trip(spark, tmp_path, form):
    rng = np.random.default_rng(0)
    xyz = rng.normal(size=(50, 3)).astype("f4")
    cols = {c: ("float", xyz[:, i]) for i, c in enumerate("xyz")} | {c: ("uchar", rng.integers(0, 256, 50).astype("u1")) for c in ("red", "green", "blue")}
    raw = ply.encode(cols, form, comments=("one", "two words"))
    got = ply.decode(raw)["vertex"]
    for c, (_, v) in cols.items():
        assert np.array_equal(np.asarray(got[c]), v)
    assert ply.header(raw)[2] == ["one", "two words"]
    lists = ply.encode({"n": ("list uchar int", [[1, 2], [], [7]]), "w": ("double", [0.5, 1.5, 2.5])}, form, "face")
    assert [list(x) for x in ply.decode(lists)["face"]["n"]] == [[1, 2], [], [7]] and list(map(float, ply.decode(lists)["face"]["w"])) == [0.5, 1.5, 2.5]
    with pytest.raises(ValueError):
        ply.decode(raw[:-5] if form != "ascii" else raw[:-40])
    (tmp_path / "a.ply").write_bytes(raw)
    (tmp_path / "b.ply").write_bytes(b"plyjunk")
    df = ply.read_points(spark, f"{tmp_path}/*.ply", errors="skip")
    assert df.count() == 50 and df.first()["red"] == int(cols["red"][1][0])
    assert files.save_files(ply.point_files(df.repartition(2)), f"{tmp_path}/out") == 2
    assert sorted(map(tuple, ply.read_points(spark, f"{tmp_path}/out").collect())) == sorted(map(tuple, df.collect()))


def truncated(raw: bytes) -> bytes:
    return raw[: len(raw) * 2 // 3]


def test_truncated_files_raise_or_are_listed(spark, tmp_path):
    """No format gives a part of a file's rows: the whole file is read, fails, or is listed."""
    db = database.Database()
    c = db.add_camera(0, 10, 10, [1.0, 2.0, 3.0])
    for i in range(40):
        db.add_image(f"{i}.png", c)
        db.add_keypoints(i + 1, np.ones((200, 2)))
        db.add_two_view_geometry(i + 1, i + 2, np.ones((300, 2)))
    model = binary_model()
    formats = {
        "points.ply": (ply.encode({k: ("double", np.arange(50.0)) for k in "xyz"}), ply.read_points),
        "ascii.ply": (ply.encode({k: ("double", np.arange(50.0)) for k in "xyz"}, "ascii"), ply.read_points),
        "x.geometric.bin": (dense_map.encode(np.ones((9, 9), "f4")), lambda s, p, **k: dense_map.read_depth_maps(s, p.rsplit("/", 1)[0], **k)),
        "d.tif": (geotiff.encode(np.ones((9, 9)), geotiff.Georef(0, 0, 1, 1, 21, True)), geotiff.read_dsm),
        "r.tif": (geotiff.encode(np.ones((9, 9)), geotiff.Georef(0, 0, 1, 1, 21, True)), geotiff.read_georef),
        "cameras.bin": (model["cameras.bin"], sparse_model.read_cameras),
        "images.bin": (model["images.bin"], sparse_model.read_images),
        "points3D.bin": (model["points3D.bin"], sparse_model.read_points),
        "images.txt": (IMAGES.replace("3 4 -1", "3 4 -1 5").encode(), sparse_model.read_images),
        "k.db": (db.content, database.read_keypoints),
        "p.db": (db.content, database.read_pairs),
    }
    for n, (name, (raw, read)) in enumerate(formats.items()):
        folder = tmp_path / str(n)
        folder.mkdir()
        bad = raw if name == "images.txt" else truncated(raw)
        (folder / name).write_bytes(bad)
        path = f"{folder}/{name}"
        with pytest.raises(Exception, match=name):
            read(spark, path).collect()
        assert read(spark, path, errors="skip").count() == 0
        kept = read(spark, path, errors="keep")
        assert [r["source"].rsplit("/", 1)[-1] for r in files.rejected(kept).collect()] == [name] and files.good(kept).count() == 0
    with pytest.raises(ValueError):
        files.parsed(spark.createDataFrame([], "path string, content binary"), None, "a int", "ignore")


def test_files_go_to_any_store(spark, tmp_path):
    df = spark.createDataFrame([("a/b.txt", b"1"), ("c.txt", b"2")], "path string, content binary")
    for folder in (f"file://{tmp_path}/x", f"file:{tmp_path}/y", f"{tmp_path}/z"):
        assert files.save_files(df, folder) == 2 and files.save_files(df, folder) == 2
    assert {p.name: p.read_bytes() for p in (tmp_path / "x").rglob("*.txt")} == {"b.txt": b"1", "c.txt": b"2"}
    assert len(list(tmp_path.rglob("*.*"))) == 6


def test_strips_of_a_surface(spark, tmp_path):
    ref = geotiff.Georef(100.0, 900.0, 0.5, 0.25, 33, False)
    cells = [(0, 0, 1.0), (6, 2, 2.5), (3, 1, -4.0)]
    dsm = spark.createDataFrame(cells, "row int, col int, z double")
    assert files.save_files(geotiff.dsm_strips(dsm, "s", 8, 3, ref, 3), f"{tmp_path}/t") == 3
    assert sorted(map(tuple, geotiff.read_strips(spark, f"{tmp_path}/t", ref).collect())) == sorted(cells)
    places = sorted((r["ul_n"], r["n_rows"], r["zone"], r["hemisphere"]) for r in geotiff.read_georef(spark, f"{tmp_path}/t").collect())
    assert places == [(898.5, 2, 33, "N"), (899.25, 3, 33, "N"), (900.0, 3, 33, "N")]
    assert geotiff.dsm_strips(dsm.where("false"), "s", 8, 3, ref, 3).count() == 3


def test_archives_without_volume_and_with_several_images():
    pan = image_meta.pan_members
    assert pan(["o/DVD_VOL_2/o/x_PAN/b.XML", "o/DVD_VOL_2/o/x_PAN/a.XML", "o/DVD_VOL_2/o/x_PAN/a-BROWSE.JPG"], "b") == ("o/DVD_VOL_2/o/x_PAN/b.XML", "o/DVD_VOL_2/o/x_PAN/a-BROWSE.JPG")
    assert pan(["x_PAN/a.XML"], "q") == ("x_PAN/a.XML", None)
    with pytest.raises(ValueError):
        pan(["x_MUL/a.XML"], "a")


def test_points_by_ranges_equal_whole_files(spark, tmp_path):
    rng = np.random.default_rng(7)
    for k, form in enumerate(("binary_little_endian", "binary_big_endian")):
        cols = {c: ("float", rng.normal(size=1000 + k)) for c in "xyz"} | ({"red": ("uchar", rng.integers(0, 256, 1000))} if k == 0 else {})
        (tmp_path / f"a b{k}.ply").write_bytes(ply.encode(cols, form))
    whole = sorted(map(str, ply.read_points(spark, str(tmp_path)).collect()))
    parts = ply.read_points_by_ranges(spark, str(tmp_path), 300)
    assert sorted(map(str, parts.collect())) == whole and len(whole) == 2001
    (tmp_path / "cut.ply").write_bytes((tmp_path / "a b0.ply").read_bytes()[:-9])
    with pytest.raises(Exception, match="early end"):
        ply.read_points_by_ranges(spark, str(tmp_path), 300).collect()


def test_ply_header_places():
    raw = b"ply\ncomment first\nformat ascii 1.0\ncomment second\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n"
    assert ply.decode(raw)["vertex"]["y"] == [2.0] and ply.header(raw)[2] == ["first", "second"]
    with pytest.raises(ValueError):
        ply.decode(raw.replace(b"1 2 3", b"1 2"))


def test_dense_maps_and_matrices(spark, tmp_path):
    a = np.arange(12, dtype="f4").reshape(3, 4) - 2
    (tmp_path / "x.png.geometric.bin").write_bytes(dense_map.encode(a))
    (tmp_path / "x.png.photometric.bin").write_bytes(dense_map.encode(a * 2))
    assert np.array_equal(dense_map.decode(dense_map.encode(a)), a)
    three = np.arange(24, dtype="f4").reshape(2, 4, 3)
    assert np.array_equal(dense_map.decode(dense_map.encode(three)), three)
    got = {(r["view"], r["row"], r["col"]): r["depth"] for r in dense_map.read_depth_maps(spark, str(tmp_path)).collect()}
    assert got == {("x.png", i, j): float(a[i, j]) for i in range(3) for j in range(4)}
    (tmp_path / "m.txt").write_text("x.png " + " ".join(map(str, range(16))) + "\n\n")
    assert dense_map.read_matrices(spark, f"{tmp_path}/m.txt").first()[:] == ("x.png", [float(i) for i in range(16)])


def test_database_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    db = database.Database()
    c1, c2 = db.add_camera(0, 1024, 1024, [1024.0, 512, 384]), db.add_camera(2, 1024, 1024, [1024.1, 512.1, 384.1, 0.1])
    ids = [db.add_image(f"image{i}.png", c) for i, c in enumerate((c1, c1, c2, c2))]
    keys = [rng.random((1000, k)) for k in (2, 4, 6, 2)]
    for i, k in zip(ids, keys):
        db.add_keypoints(i, k)
        db.add_descriptors(i, rng.integers(0, 256, (5, 128)))
    m = rng.integers(0, 1000, (50, 2))
    db.add_matches(ids[0], ids[1], m)
    db.add_two_view_geometry(ids[2], ids[1], m)
    db.add_two_view_geometry(ids[0], ids[3], np.zeros((0, 2)))
    with pytest.raises(ValueError):
        db.add_keypoints(9, rng.random((3, 5)))
    (tmp_path / "f.db").write_bytes(db.content)
    path = f"{tmp_path}/f.db"
    assert {r["name"]: r["image_id"] for r in database.read_images(spark, path).collect()} == {f"image{i}.png": v for i, v in enumerate(ids)}
    (pair,) = database.read_pairs(spark, path).collect()
    assert database.pair_of(pair["pair_id"]) == (ids[1], ids[2]) and [(x["second"], x["first"]) for x in pair["matches"]] == [tuple(map(int, r)) for r in m]
    k = {(r["image_id"], r["idx"]): r["x"] for r in database.read_keypoints(spark, path).collect()}
    assert len(k) == 4000 and k[ids[1], 3] == pytest.approx(keys[1][3, 0], rel=1e-6)


def test_geotiff_round_trip(spark, tmp_path):
    z = np.array([[1.5, np.nan, 3.0], [4.0, 5.25, np.nan]])
    ref = geotiff.Georef(354052.5, 6182702.0, 0.5, 0.5, 21, True)
    raw = geotiff.encode(z, ref)
    back, got = geotiff.decode(raw)
    assert np.array_equal(back, z, equal_nan=True) and got == ref
    (tmp_path / "d.tif").write_bytes(raw)
    (tmp_path / "bad.tif").write_bytes(b"II*\0")
    dsm = geotiff.read_dsm(spark, f"{tmp_path}/*.tif", errors="skip")
    assert {(r["row"], r["col"]): r["z"] for r in dsm.collect()} == {(0, 0): 1.5, (0, 2): 3.0, (1, 0): 4.0, (1, 1): 5.25}
    r = geotiff.read_georef(spark, f"{tmp_path}/d.tif").first()
    assert (r["zone"], r["hemisphere"], r["lr_e"], r["lr_n"]) == (21, "S", 354054.0, 6182701.0)
    assert bytes(geotiff.dsm_files(dsm, "o.tif", 2, 3, ref).first()["content"]) == raw


def xml(sensor="WV03", cloud="0.1"):
    rpc = "".join(f"<{p.split('/')[0]}><{p.split('/')[1]}>{' '.join(str(i + k) for i in range(20))}</{p.split('/')[1]}></{p.split('/')[0]}>" for k, p in enumerate(image_meta.NAMES.values()))
    rpc += "".join(f"<{p}>{i}.5</{p}>" for i, p in enumerate(image_meta.SCALARS.values()))
    angles = "".join(f"<{p}>{cloud if n == 'cloudCover' else i}</{p}>" for i, (n, p) in enumerate(image_meta.ANGLES.items()))
    return f"<isd><IMD><IMAGE><SATID>{sensor}</SATID><TLCTIME>2014-12-15T14:16:32.5Z</TLCTIME>{angles}</IMAGE><NUMROWS>70</NUMROWS><NUMCOLUMNS>80</NUMCOLUMNS></IMD><RPB><IMAGE>{rpc}</IMAGE></RPB></isd>"


def test_image_metadata(spark, tmp_path):
    (tmp_path / "good.XML").write_text(xml())
    (tmp_path / "other.XML").write_text(xml("QB02"))
    (tmp_path / "broken.XML").write_text("<isd>")
    df = image_meta.read_xml(spark, str(tmp_path))
    (r,) = files.good(df).collect()
    assert (r["name"], r["width"], r["height"], r["sensor_id"], r["cloudCover"]) == ("good", 80, 70, "WV03", 0.1) and r["rpc"]["colNum"][3] == 5.0 and str(r["capTime"]) == "2014-12-15 14:16:32.500000"
    assert {x["source"].rsplit("/", 1)[-1] for x in files.rejected(df).collect()} == {"other.XML", "broken.XML"}


def test_archives(spark, tmp_path):
    def tar(names):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as t:
            for n in names:
                info = tarfile.TarInfo(n)
                info.size = 3
                t.addfile(info, io.BytesIO(b"a\nb"))
        return out.getvalue()

    (tmp_path / "img.tar").write_bytes(tar(["DVD_VOL_1/p/p_PAN/img.XML", "DVD_VOL_1/p/p_PAN/img-BROWSE.JPG", "x/readme"]))
    (tmp_path / "evil.tar").write_bytes(tar(["../p_PAN/img.XML"]))
    (tmp_path / "img.NTF").write_bytes(b"NITF")
    df = image_meta.read_tar_xml(spark, str(tmp_path))
    (r,) = files.good(df).collect()
    assert (r["img"], r["xml"], r["has_browse"]) == ("img", "ab", True)
    assert "unsafe" in files.rejected(df).first()["error"]
    assert image_meta.list_images(spark, str(tmp_path)).first()["stem"] == "img"


def test_config_and_area(spark):
    text = '{"dataset_dir": "/d", "work_dir": "/w", "steps_to_run": {"a": true}, "alt_min": -30.0, "alt_max": 120.0, "bounding_box": {"zone_number": 21, "hemisphere": "S", "ul_easting": 354052.3651180889, "ul_northing": 6182702.10540914, "width": 712.97, "height": 651.48}}'
    c = image_meta.read_config(text)
    assert c["dataset_dir"] == ["/d"]
    a = image_meta.area(spark, c).first()
    assert a["lr_northing"] == pytest.approx(6182050.625, abs=1e-2) and -34.6 < a["lat_min"] < a["lat_max"] < -34.4 and -58.7 < a["lon_min"] < a["lon_max"] < -58.5
    with pytest.raises(ValueError):
        image_meta.read_config("{}")


def test_reports(spark, tmp_path):
    ranges = spark.createDataFrame([("b", 1.0, 2.0), ("a", None, None)], "img string, depth_min double, depth_max double")
    assert [r["value"] for r in reports.depth_range_lines(ranges).collect()] == ["a -1.0E20 -1.0E20", "b 1.0 2.0"]
    assert reports.matching_config(ranges).first()["value"] == "a\n__auto__, 20"
    reports.write_camera_report(ranges, f"{tmp_path}/r")
    assert spark.read.csv(f"{tmp_path}/r", header=True).count() == 2
    reports.write_matches(spark.createDataFrame([(1, 2, 5), (2, 1, 5)], "src int, dst int, n int"), f"{tmp_path}/m")
    assert spark.read.csv(f"{tmp_path}/m").where("src = 1").count() == 1
    with pytest.raises(Exception, match="outside"):
        files.save_files(spark.createDataFrame([("../x", b"a")], "path string, content binary"), f"{tmp_path}/s")


def png(a: np.ndarray) -> bytes:
    """A grey 8-bit PNG."""
    import zlib

    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    rows = b"".join(b"\0" + r.tobytes() for r in a)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_pictures_and_tables(spark, tmp_path):
    a = (np.arange(300 * 4) % 251).astype("u1").reshape(300, 4)
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.png").write_bytes(png(a))
    (tmp_path / "p/b.png").write_bytes(b"no picture")
    got = {(r["view"], r["row"], r["col"]): r["value"] for r in images.read_pixels(spark, f"{tmp_path}/p").where("band = 0").collect()}
    assert got == {("a.png", i, j): int(a[i, j]) for i in range(300) for j in range(4)}
    (tmp_path / "t.txt").write_text("# r g b\n1 2 3\n\n 4.5 x 6\n")
    assert sorted(map(tuple, images.read_table(spark, f"{tmp_path}/t.txt", ["r", "g", "b"]).collect())) == [(1.0, 2.0, 3.0), (4.5, None, 6.0)]
