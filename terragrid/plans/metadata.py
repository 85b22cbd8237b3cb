"""Queries on image metadata, names and boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import image, names
from ..operators import meta, raster, robust, sparse
from .common import cameras, long, query, r, table


@query("SELECT p_partkey, p_size / 50.0::DOUBLE AS cloud FROM part WHERE p_size / 50.0::DOUBLE <= 0.5::DOUBLE")
def cloud_filter(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("cloud"))
    return meta.cloud_filter(p, F.col("cloud"))


@query("SELECT o_orderkey, o_orderpriority AS sensor FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')")
def sensor_filter(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("sensor"))
    return meta.sensor_filter(o, F.col("sensor"), ("1-URGENT", "2-HIGH", "3-MEDIUM"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def pairing_semi(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return meta.paired(c, table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""SELECT l_suppkey, count(*)::BIGINT AS n_all, count(*) FILTER (WHERE c >= 0 AND r >= 0 AND c < 500 + l_suppkey % 7 * 50 AND r < 400 + l_suppkey % 5 * 60)::BIGINT AS n_inside
          FROM (SELECT l_suppkey, l_quantity * 20 - 60 AS c, l_discount * 7000 - 20 AS r FROM lineitem) GROUP BY 1""")
def inimage_mask(spark, d):
    pix = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_quantity") * 20 - 60).alias("c"), (F.col("l_discount") * 7000 - 20).alias("r"))
    ok = image.inside(F.col("c"), F.col("r"), 500 + F.col("l_suppkey") % 7 * 50, 400 + F.col("l_suppkey") % 5 * 60)
    return pix.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_all"), F.count(F.when(ok, 1)).alias("n_inside"))


@query("""SELECT event_type, count(*)::BIGINT AS n, count(v)::BIGINT AS n_valid, round(max(v), 6) + 0 AS top
          FROM (SELECT event_type, CASE WHEN abs(z + 10000) <= 1e-8 + 1e-5 * 10000 THEN NULL ELSE z END AS v
                FROM (SELECT event_type, CASE WHEN event_id % 3 = 0 THEN -10000.00001::DOUBLE ELSE value END AS z FROM events)) GROUP BY 1""")
def nodata_null(spark, d):
    e = table(spark, d, "events").select("event_type", F.when(F.col("event_id") % 3 == 0, F.lit(-10000.00001)).otherwise(F.col("value")).alias("z"))
    v = e.withColumn("v", image.void_nodata(F.col("z"), -10000.0))
    return v.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("n_valid"), r(F.max("v")).alias("top"))


@query("""WITH f AS (SELECT c_custkey, '/data/12MAY24141632' || '-P1BS-' || substr(c_name, 10) || '_01_P00' || '1' || '.NTF' AS path, c_name FROM customer)
          SELECT c_custkey, substr(b, i - 13, 39) AS img_name, substr(b, i + 6, 15) AS order_id, substr(b, i + 6, 20) AS prod_id,
                 substr(c_name, instr(c_name, '#') + 1)::BIGINT AS number, format('{:04d}_{}_{}_{}', (c_custkey % 10000)::INT, 'WV03', substr(b, 1, 7), substr(b, 8)) AS target,
                 21 AS zone, CASE WHEN c_custkey % 2 = 0 THEN 'N' ELSE 'S' END AS hemisphere
          FROM (SELECT *, instr(b, '-P1BS-') AS i FROM (SELECT *, replace(path, '/data/', '') AS b FROM f))""")
def name_parse(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    path = F.concat(F.lit("/data/12MAY24141632-P1BS-"), F.expr("substring(c_name, 10)"), F.lit("_01_P001.NTF"))
    zone = names.utm_zone(F.concat(F.lit("WGS 84 / UTM zone 21"), F.when(F.col("c_custkey") % 2 == 0, "N").otherwise("S")))
    out = c.select("c_custkey", "c_name", path.alias("path"), zone.alias("z")).withColumn("p", names.product_parts(F.col("path")))
    return out.select(
        "c_custkey", "p.img_name", "p.order_id", "p.prod_id", long(F.substring_index("c_name", "#", -1)).alias("number"),
        names.ordered_name((F.col("c_custkey") % 10000).cast("int"), F.lit("WV03"), F.substring_index("path", "/", -1)).alias("target"), "z.zone", "z.hemisphere",
    )


@query("SELECT doc_id, md5(regexp_replace(text, '\\p{C}', '', 'g')) AS cleaned FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(names.clean_text(F.col("text")).cast("binary")).alias("cleaned"))


@query("""SELECT n_nationkey, len(v)::BIGINT AS n, round(list_sum(v), 6) + 0 AS total, v[2] AS second
          FROM (SELECT n_nationkey, list_transform(regexp_split_to_array(trim('  1.5  -2.5e-3 ' || n_nationkey || '   ' || n_name || ' 7'), '\\s+'), lambda x: TRY_CAST(x AS DOUBLE)) AS v FROM nation)""")
def meta_parse(spark, d):
    n = table(spark, d, "nation")
    text = F.concat(F.lit("  1.5  -2.5e-3 "), F.col("n_nationkey").cast("string"), F.lit("   "), F.col("n_name"), F.lit(" 7"))
    n = n.select("n_nationkey", names.numbers(text).alias("v"))
    total = F.aggregate(F.filter("v", lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x)
    return n.select("n_nationkey", long(F.size("v")).alias("n"), r(total).alias("total"), F.col("v")[1].alias("second"))


@query("""SELECT round(max(o - s), 6) + 0 AS alt_min, round(min(o + s), 6) + 0 AS alt_max
          FROM (SELECT TRY_CAST(CASE WHEN p_size % 17 = 0 THEN 'bad' ELSE p_size::VARCHAR END AS DOUBLE) * 10 AS s, p_retailprice / 100 AS o FROM part) WHERE s IS NOT NULL""")
def alt_intersection(spark, d):
    p = table(spark, d, "part")
    s = F.when(F.col("p_size") % 17 == 0, "bad").otherwise(F.col("p_size").cast("string")).try_cast("double") * 10
    o = F.col("p_retailprice") / 100
    return robust.interval_intersection(p, o - s, o + s).select(r("alt_min").alias("alt_min"), r("alt_max").alias("alt_max"))


@query("""SELECT l_suppkey, min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity, min(l_extendedprice) AS min_l_extendedprice, max(l_extendedprice) AS max_l_extendedprice,
                 min(l_discount) AS min_l_discount, max(l_discount) AS max_l_discount FROM lineitem GROUP BY 1""")
def bbox_minmax(spark, d):
    return robust.bounds(table(spark, d, "lineitem"), ["l_suppkey"], ["l_quantity", "l_extendedprice", "l_discount"])


@query("""WITH b AS (SELECT p_partkey, p_brand, p_partkey % 40 AS x, p_size AS y, 20 + p_partkey % 31 AS w, 10 + p_size AS h FROM part),
          a AS (SELECT p_brand, min(x) + 10 AS ax, min(y) + 10 AS ay, 30 AS aw, 25 AS ah FROM b GROUP BY 1),
          o AS (SELECT p_partkey, w, h, aw, ah, greatest(x, ax) AS ox, greatest(y, ay) AS oy, least(x + w - 1, ax + aw - 1) AS ex, least(y + h - 1, ay + ah - 1) AS ey FROM b JOIN a USING (p_brand)),
          i AS (SELECT *, ex > ox AND ey > oy AS ok, ((ex - ox + 1) * (ey - oy + 1))::DOUBLE AS area FROM o)
          SELECT p_partkey, (CASE WHEN ok THEN ox ELSE -1 END)::BIGINT AS x, (CASE WHEN ok THEN oy ELSE -1 END)::BIGINT AS y, (CASE WHEN ok THEN ex - ox + 1 ELSE -1 END)::BIGINT AS w, (CASE WHEN ok THEN ey - oy + 1 ELSE -1 END)::BIGINT AS h,
                 round(CASE WHEN ok THEN area / (w * h) ELSE 0 END, 6) + 0 AS first, round(CASE WHEN ok THEN area / (aw * ah) ELSE 0 END, 6) + 0 AS second,
                 (CASE WHEN ok THEN area / (aw * ah) ELSE 0 END) >= 0.8 AS covered FROM i""")
def bbox_overlap(spark, d):
    b = table(spark, d, "part").select("p_partkey", "p_brand", long(F.col("p_partkey") % 40).alias("x"), long(F.col("p_size")).alias("y"), long(20 + F.col("p_partkey") % 31).alias("w"), long(10 + F.col("p_size")).alias("h"))
    a = b.groupBy("p_brand").agg((F.min("x") + 10).alias("ax"), (F.min("y") + 10).alias("ay"))
    both = b.join(a, "p_brand").withColumn("o", image.overlap([F.col(c) for c in "xywh"], [F.col("ax"), F.col("ay"), F.lit(30), F.lit(25)]))
    return both.select("p_partkey", *[F.coalesce(F.col(f"o.{c}"), F.lit(-1)).alias(c) for c in "xywh"], r("o.first").alias("first"), r("o.second").alias("second"), (F.col("o.second") >= meta.OVERLAP_LIMIT).alias("covered"))


@query("""SELECT l_suppkey, a AS ul_col, b AS ul_row, c - a + 1 AS width, e - b + 1 AS height
          FROM (SELECT l_suppkey, round_even(min(x), 0)::BIGINT AS a, round_even(min(y), 0)::BIGINT AS b, round_even(max(x), 0)::BIGINT AS c, round_even(max(y), 0)::BIGINT AS e
                FROM (SELECT l_suppkey, l_quantity / 2.0::DOUBLE - 20.5::DOUBLE AS x, l_linenumber + 0.5::DOUBLE AS y FROM lineitem) GROUP BY 1)""")
def projected_bbox(spark, d):
    return meta.rounded_box(table(spark, d, "lineitem"), ["l_suppkey"], F.col("l_quantity") / 2 - 20.5, F.col("l_linenumber") + 0.5)


@query("SELECT s_suppkey, round(s_acctbal - s_suppkey % 13, 6) + 0 AS col_off, round(s_acctbal / 2 - s_nationkey, 6) + 0 AS row_off, 10.0::DOUBLE AS col_scale FROM supplier")
def crop_rebase(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.struct(F.col("s_acctbal").alias("colOff"), (F.col("s_acctbal") / 2).alias("rowOff"), F.lit(10.0).alias("colScale")).alias("rpc"))
    s = meta.crop_rebase(s, "rpc", F.col("s_suppkey") % 13, F.col("s_nationkey"))
    return s.select("s_suppkey", r("rpc.colOff").alias("col_off"), r("rpc.rowOff").alias("row_off"), F.col("rpc.colScale").alias("col_scale"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS idx FROM orders")
def chrono_index(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return meta.chronological(o, "o_orderdate", "o_orderkey", ["o_custkey"]).drop("o_orderdate")


@query("""SELECT event_id, round((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6, 6) + 0 AS since_last, round((epoch_us(ts) - epoch_us(first_value(ts) OVER w)) / 1e6, 6) + 0 AS since_start
          FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def milestones(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    return meta.milestones(e, "user_id", "ts", ["event_id"]).select("event_id", r("since_last").alias("since_last"), r("since_start").alias("since_start"))


@query("""WITH s AS (SELECT event_type AS step, count(*)::BIGINT AS n, count(*) FILTER (WHERE event_id % 4 <> 0)::BIGINT AS n_run, sum(CASE WHEN event_id % 4 <> 0 THEN value ELSE 0 END) AS m FROM events GROUP BY 1)
          SELECT step, n, n_run, round(m, 4) + 0 AS minutes FROM s UNION ALL SELECT 'total', sum(n)::BIGINT, sum(n_run)::BIGINT, round(sum(m), 4) FROM s""")
def step_report(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("step"), (F.col("event_id") % 4 != 0).alias("has_run"), F.col("value").alias("minutes"))
    return meta.step_report(e).select("step", "n", "n_run", r("minutes", 4).alias("minutes"))


@query("SELECT k AS n_nationkey, img, round(w, 6) + 0 AS w, round(fx, 6) + 0 AS fx, round(cy, 6) + 0 AS cy, round(s, 6) + 0 AS s, round(x, 6) + 0 AS qy, round(tz, 6) + 0 AS tz FROM (SELECT n_nationkey AS k, n_name AS img, 640 + n_nationkey::DOUBLE AS w, 1000 + 10 * n_nationkey::DOUBLE AS fx, 240 - n_nationkey::DOUBLE AS cy, n_nationkey / 10.0::DOUBLE AS s, n_nationkey / 50.0::DOUBLE AS x, 100 + n_nationkey::DOUBLE AS tz FROM nation)")
def camera_dict(spark, d):
    c = cameras(spark, d)
    cams = c.select(F.col("k").alias("camera_id"), F.col("camera")[0].alias("width"), F.col("camera")[1].alias("height"), F.slice("camera", 3, 5).alias("params"))
    imgs = c.select(F.col("k").alias("camera_id"), F.col("img").alias("name"), F.slice("camera", 8, 4).alias("q"), F.slice("camera", 12, 3).alias("t"))
    out = sparse.camera_dict(imgs, cams).join(c.select("img", F.col("k").alias("n_nationkey")), "img")
    at = {"w": 0, "fx": 2, "cy": 5, "s": 6, "qy": 9, "tz": 13}
    return out.select("n_nationkey", "img", *[r(F.col("camera")[i]).alias(n) for n, i in at.items()])


@query("SELECT s_suppkey, 0.5::DOUBLE AS d_cx, round(-s_nationkey / 4.0::DOUBLE, 6) + 0 AS d_cy FROM supplier")
def camera_delta(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("img"), "s_nationkey", F.col("s_acctbal").alias("cx"), (F.col("s_acctbal") * 2).alias("cy"))
    after = s.select("img", (F.col("cx") + 0.5).alias("cx"), (F.col("cy") - F.col("s_nationkey") / 4).alias("cy"))
    return sparse.camera_delta(s, after).select(F.col("img").alias("s_suppkey"), r("d_cx").alias("d_cx"), r("d_cy").alias("d_cy"))


@query("""WITH n AS (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 2)
          SELECT s_suppkey, n_name, n_nationkey IS NULL AS missing FROM supplier LEFT JOIN n ON s_nationkey = n_nationkey""")
def strict_lookup(spark, d):
    n = table(spark, d, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    found, missing = sparse.strict_lookup(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), n, "s_nationkey")
    return found.select("s_suppkey", "n_name", F.lit(False).alias("missing")).unionByName(missing.select("s_suppkey", F.lit(None).cast("string").alias("n_name"), F.lit(True).alias("missing")))


@query("SELECT l_orderkey, l_linenumber, least(l_partkey, l_suppkey) * 2147483647 + greatest(l_partkey, l_suppkey) AS pair_id, least(l_partkey, l_suppkey) AS id1, greatest(l_partkey, l_suppkey) AS id2 FROM lineitem")
def pair_codec(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", image.pair_id(F.col("l_partkey"), F.col("l_suppkey")).alias("pair_id"))
    a, b = image.pair_of(F.col("pair_id"))
    return rows.select("*", a.alias("id1"), b.alias("id2"))


@query("SELECT i::INT AS i, j::INT AS j, k::INT AS k, round(i * 0.5 / 99 + 1, 6) + 0 AS x, round(k * 30.0 / 19 - 10, 6) + 0 AS z FROM range(100) a(i), range(100) b(j), range(20) c(k)")
def lattice(spark, d):
    grid = raster.lattice(spark, 100, 100, 20).toDF("i", "j", "k")
    return grid.select("i", "j", "k", r(raster.linspace(F.col("i"), 1.0, 1.5, 100)).alias("x"), r(raster.linspace(F.col("k"), -10.0, 20.0, 20)).alias("z"))
