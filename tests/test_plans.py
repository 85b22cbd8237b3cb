import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from terragrid.functions import geodesy
from terragrid.operators.meta import step_report
from terragrid.plans import scene
from terragrid.plans.geometry import _coefficients
from terragrid.registry import ORACLE_SQL, QUERIES
from terragrid.streaming.surface import windowed_grid_max

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE_SQL) and len(QUERIES) >= 55


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(got.columns)
    order = sorted(cols)
    a = sorted((tuple(r[c] for c in order) for r in got.collect()), key=str)
    b = sorted((tuple(r[cols.index(c)] for c in order) for r in want.fetchall()), key=str)
    assert a == b


def test_entry(spark):
    assert entry.entry(spark).count() > 0


ORIGIN = (-34.49, -58.585, 0.0)


def located(spark):
    """A box about the origin."""
    at = spark.range(1).select(F.lit(ORIGIN[0]).alias("lat"), F.lit(ORIGIN[1]).alias("lon"))
    e, n = at.select(geodesy.to_utm(F.col("lat"), F.col("lon"), 21, True).alias("p")).first()["p"]
    return scene.Area(21, True, e - 30, n + 20, 60.0, 40.0, 0.0, 30.0, 1.0)


def test_a_flat_scene_comes_back_at_its_height(spark):
    """Three views look down on a plane at 7 m with a block at 19 m; depth maps are heights, matrices lift pixels to the ground."""
    area = located(spark)
    rows = []
    for view in ("a", "b", "c"):
        for i in range(50):
            for j in range(70):
                high = 20 <= i < 30 and 30 <= j < 40
                rows.append((view, i, j, 19.0 if high else 7.0))
    depths = spark.createDataFrame(rows, "view string, row int, col int, depth double")
    # x = col - 35, y = 25 - row, z = depth
    m = [1.0, 0, -35, 0, 0, -1, 25, 0, 0, 0, 0, 1, 0, 0, 1, 0]
    mats = spark.createDataFrame([(v, [float(x) for x in m]) for v in "abc"], "view string, m array<double>")
    dsm = scene.fused_surface(depths, mats, ORIGIN, area)
    got = {(r["row"], r["col"]): (r["z"], r["n"]) for r in dsm.collect()}
    assert len(got) > 0.95 * area.rows * area.cols
    z = np.array([v[0] for v in got.values()])
    assert np.all((np.abs(z - 7) < 0.02) | (np.abs(z - 19) < 0.02)) and 60 < np.sum(np.abs(z - 19) < 0.02) < 140
    assert {v[1] for v in got.values()} == {3}
    assert scene.surface_points(dsm, area).where("level between 0 and 196").count() == len(got)


def test_images_are_filtered_cropped_and_fitted(spark):
    area = located(spark)
    base = _coefficients(0) | {"latOff": ORIGIN[0], "lonOff": ORIGIN[1], "latScale": 0.003, "lonScale": 0.003, "altOff": 15.0, "altScale": 40.0, "colOff": 500.0, "colScale": 2000.0, "rowOff": 400.0, "rowScale": 2000.0}
    import datetime as dt

    when = dt.datetime(2015, 1, 1)
    metas = [("m1", base, 1000, 800, when, 0.1, "WV03"), ("m0", base, 1000, 800, when, 0.2, "WV02"), ("cloudy", base, 1000, 800, when, 0.9, "WV03"), ("far", base | {"colOff": 90_000.0}, 1000, 800, when, 0.1, "WV03"), ("old", base, 1000, 800, when, 0.1, "QB02")]
    from terragrid.schema import RPC

    df = spark.createDataFrame(metas, f"name string, rpc {RPC}, width int, height int, capTime timestamp, cloudCover double, sensor_id string")
    images = scene.usable_images(df, area)
    got = {r["name"]: r for r in images.collect()}
    assert {n: r["idx"] for n, r in got.items()} == {"m0": 0, "m1": 1}
    one = got["m1"]
    assert one["rpc"]["colOff"] == 500.0 - one["ul_col_original"] and one["width"] < 1000
    cams = scene.perspective_cameras(scene.camera_samples(images, area, ORIGIN, 12, 5)).collect()
    assert {c["name"] for c in cams} == {"m0", "m1"}
    assert all(c["max_proj"] < 5 and c["mean_proj"] < 1 for c in cams)


def test_steps(spark):
    done = []
    log = scene.run_steps(spark, {"x": lambda: done.append(1), "y": lambda: done.append(2)}, {"x": True})
    assert done == [1] and {r["step"]: r["n_run"] for r in step_report(log).collect()} == {"x": 1, "y": 0, "total": 1}


def test_streaming_surface_equals_batch(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_id", "value")
    e.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    args = ("ts", "365 days", "1 day", F.col("user_id") % 10, F.col("event_id") % 7, F.col("value"), 10, 7)
    q = windowed_grid_max(stream, *args).writeStream.outputMode("complete").format("memory").queryName("surface").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    a = sorted(map(tuple, spark.table("surface").collect()))
    b = sorted(map(tuple, windowed_grid_max(e, *args).collect()))
    assert a == b and a
