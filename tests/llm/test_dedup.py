import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terragrid.llm import near_dedup
from terragrid.llm.exact_dedup import exact_dedup

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id long, text string, kept string, source string"


def prose(rng, n):
    return " ".join(rng.choice(["river", "stone", "Kalt", "été", "moon", "grid", "Ñu", "sail", "fern", "dust", "oak"]) + str(rng.randrange(40)) for _ in range(n))


def brute_exact(rows, keep=max):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(UP)].append(i)
    return {t: ([x for x in ids if x is not None] and keep(x for x in ids if x is not None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("ranges", [1, 3, 9])
@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup_equals_brute_force(spark, ranges, keep):
    rng = random.Random(ranges)
    rows = [(i, prose(rng, rng.randrange(0, 30))) for i in range(150)]
    rows += [(1000 + i, rows[i % 5][1].upper().translate(UP)) for i in range(40)]
    rows += [(2000 + i, "One passage that a third of all rows share, Word for word.") for i in range(120)]  # cut by several splitters
    rows += [(3000, None), (3001, ""), (3002, "É"), (3003, "é"), (3004, "A"), (3005, "a"), (3006, "x" * 200_000), (3007, "X" * 200_000), (3007, "X" * 200_000)]
    df = spark.createDataFrame([(i, t, "clash", "s") for i, t in rows], DOC).repartition(5)
    got = exact_dedup(df, keep=keep, ranges=ranges).collect()
    want = brute_exact(rows, max if keep == "max" else min)
    assert len(got) == len(rows)
    for r in got:
        assert (r["keep_id"], r["group_size"]) == want[(r["text"] or "").translate(UP)]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert sum(r["kept"] for r in got) == len(want)


def test_exact_dedup_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "t", "", ""), (None, "t", "", ""), (5, "T", "", ""), (None, "u", "", ""), (None, "U", "", "")], DOC)
    got = exact_dedup(df).collect()
    assert sorted((r["text"], r["doc_id"], r["keep_id"], r["kept"]) for r in got if r["kept"]) == sorted([("T", 5, 5, True), (next(r["text"] for r in got if r["kept"] and r["doc_id"] is None), None, None, True)])
    assert {r["group_size"] for r in got} == {3, 2}
    empty = exact_dedup(df.where("false"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "source", "keep_id", "group_size", "kept", "text_sha256"]


def test_exact_dedup_null_ids_are_spread_and_any_column_name_goes(spark):
    rows = [(None, f"text {i}", i, {"a": i}) for i in range(2000)] + [(None, "the same", i, None) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __order long, `od.d``n` map<string, int>").withColumnsRenamed({"__order": "__norm"})
    df = df.withColumns({c: F.lit(1) for c in ("__order", "norm", "range", "row", "key", "id", "n", "top", "rank", "digest", "__u", "best", "all")})
    out = exact_dedup(df, ranges=8)
    assert out.columns == [*df.columns, "keep_id", "group_size", "kept", "text_sha256"]
    got = out.withColumn("part", F.spark_partition_id()).collect()
    assert sum(r["kept"] for r in got) == 2001 and {r["group_size"] for r in got if r["text"] == "the same"} == {1000}
    sizes = defaultdict(int)
    for r in got:
        sizes[r["part"]] += 1
    assert len(sizes) == 8 and max(sizes.values()) < 1000
    words = spark.createDataFrame([("b", "T"), ("a", "t"), (None, "t")], "doc_id string, text string")
    assert {(r["doc_id"], r["kept"], r["keep_id"]) for r in exact_dedup(words).collect()} == {("b", True, "b"), ("a", False, "b"), (None, False, "b")}


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute_near(rows, t=0.8):
    sets = [shingles(x) for _, x in rows]
    links = np.zeros(len(rows), int)
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                comp[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    return {d: (min(least[root(i)]), int(links[i])) for i, (d, _) in enumerate(rows)}


def near_rows(seed, families=12):
    rng = random.Random(seed)
    rows, n = [], 0
    for _ in range(families):
        base = prose(rng, rng.randrange(3, 220)).split()
        for _ in range(rng.choice([1, 2, 3, 20])):
            words = list(base)
            for _ in range(rng.randrange(0, 3 + len(words) // 60)):
                words[rng.randrange(len(words))] = prose(rng, 1)
            rows.append((n, " ".join(words)))
            n += 1
            if rng.random() < 0.3:  # copies that differ in case and white space only
                rows.append((n, "\t".join(words).upper().replace("É", "é").replace("Ñ", "ñ") if not re.search("[éÉñÑ]", " ".join(words)) else "\n ".join(words)))
                n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "two words"), (n + 4, "TWO words"), (n + 5, "y" * 150_000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    rows = near_rows(seed)
    got = near_dedup.near_duplicates(spark.createDataFrame([(i, t, "", "") for i, t in rows], DOC).repartition(3)).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == brute_near(rows)
    assert len(got) == len(rows)


@pytest.mark.parametrize("far", [0, 14])
@pytest.mark.parametrize("limit", [0, 200_000])
def test_blocks_of_one_family_lose_no_link(spark, monkeypatch, far, limit):
    """Families and buckets of many blocks: tight ones, and ones with texts far from any pivot."""
    monkeypatch.setattr(near_dedup, "WORD_BLOCK", 900)
    monkeypatch.setattr(near_dedup, "TEXT_BLOCK", 7)
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", limit)
    monkeypatch.setattr(near_dedup, "BROADCAST_HEADS", limit)
    monkeypatch.setattr(near_dedup, "BROADCAST_BYTES", limit)
    rng = random.Random(5)
    base = prose(rng, 120).split()
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(0, 4 + (far if i % 3 == 0 else 0))):
            words[rng.randrange(len(words))] = prose(rng, 1)
        rows += [(2 * i, " ".join(words))] + ([(2 * i + 1, "  ".join(words))] if i % 4 == 0 else [])
    got = near_dedup.near_duplicates(spark.createDataFrame([(i, t, "", "") for i, t in rows], DOC)).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == brute_near(rows)


def test_blocks_have_a_bounded_size(spark):
    """Rows of a pair of blocks, and rows in all, for a tight family and for one of texts far from its pivot."""
    for inner in (True, False):
        most = []
        for n in (5_000, 20_000):
            rows = spark.range(n).select(F.lit(b"c").alias("comp"), F.col("id").cast("string").cast("binary").alias("key"), F.col("id").alias("rep"), F.lit(1).alias("copies"), F.lit(300).alias("words"), F.lit(64).alias("bin"), (F.lit(inner) & (F.col("id") % 100 > 0)).alias("inner"))
            sizes = near_dedup._blocked(rows).groupBy("comp", "bi", "bj").count().agg(F.max("count"), F.sum("count")).first()
            most.append(sizes)
        assert max(m[0] for m in most) < 2 * 1.25 * near_dedup.TEXT_BLOCK
        if inner:
            assert all(m[1] <= 1.25 * n for m, n in zip(most, (5_000, 20_000)))


def test_texts_whose_polynomial_hashes_meet_are_told_apart(spark):
    """Thue-Morse words: polynomial hashes modulo 2**64 can't tell one from its complement."""
    rows = []
    for n in (1024, 4096):
        bits = [bin(i).count("1") & 1 for i in range(n)]
        rows += [(n, "".join("ab"[x] for x in bits)), (n + 1, "".join("ba"[x] for x in bits))]
        rows += [(n + 2, " ".join("ab"[x] for x in bits)), (n + 3, " ".join("ba"[x] for x in bits))]
    got = near_dedup.near_duplicates(spark.createDataFrame([(i, t, "", "") for i, t in rows], DOC)).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == brute_near(rows)
    assert len({r["copy_id"] for r in got}) == len(rows)


def test_windows_with_equal_hashes_are_told_apart(monkeypatch):
    from terragrid.llm import common

    rng = random.Random(8)
    texts = ["a b c a b c a b d a b c", "x", "", "a b", "b a", prose(rng, 60) + " " + "w" * 20 + " " + "v" * 20 + " " + "w" * 20]
    for h in (None, lambda n: np.zeros(n, np.uint64), lambda n: np.arange(n).astype(np.uint64) % np.uint64(3)):
        for _, s in common.slices(__import__("pyarrow").array(texts), lower=True):
            first, real = s.windows(3)
            told = s.told_apart(first, real if h is None else h(len(real)), 3)
            words = [re.findall(r"\S+", t.translate(UP)) for t in texts]
            flat = [(w[i : i + 3]) for w in words for i in range(len(w) - 2)]
            assert all((told[i] == told[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(i))


def test_near_duplicates_odd_rows(spark):
    t = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(None, t, "", ""), (4, t, "", ""), (4, t, "", ""), (9, "other words", "", ""), (None, None, "", "")], DOC)
    got = near_dedup.near_duplicates(df).collect()
    assert sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"], r["n_copies"]) for r in got) == [("4", "4", 2, 3), ("4", "4", 2, 3), ("9", "9", 0, 1), ("None", "4", 2, 3), ("None", "None", 0, 1)]
    assert near_dedup.near_duplicates(df.where("false")).count() == 0


def test_bands_meet_the_recall():
    for t in (0.6, 0.8, 0.9):
        bands, rows = near_dedup.bands_for(t, 0.999)
        assert 1 - (1 - t**rows) ** bands >= 0.999 and bands * rows <= near_dedup.MOST_HASHES
    with pytest.raises(ValueError):
        near_dedup.bands_for(0.1, 0.999999, 8)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["comp"] for r in near_dedup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[j] == 100 for j in range(100, 130)) and got[201] == 200
    assert near_dedup.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    names = list(range(3000))
    random.Random(4).shuffle(names)
    written = []
    monkeypatch.setattr(near_dedup, "stored", lambda df, name, stored=near_dedup.stored: written.append(name) or stored(df, name))
    edges = spark.createDataFrame(list(zip(names, names[1:])), "u long, v long")
    assert near_dedup.components(edges).where("comp = 0").count() == len(names)
    assert len(written) < 30


def test_tables_are_deleted_on_release_and_a_cluster_needs_a_folder(spark):
    import glob
    import types

    from terragrid import session
    from terragrid.llm import common

    common.release(spark)
    assert near_dedup.near_duplicates(spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id long, text string")).count() == 2
    folder = f"{session.shared_dir(spark)}/terragrid-tables/{spark.sparkContext.applicationId}/*".removeprefix("file:")
    assert len(glob.glob(folder)) == len(common.WRITTEN) > 0
    kept = common.stored(spark.range(3), "kept")
    common.release(spark, len(common.WRITTEN))
    assert kept.count() == 3
    common.release(spark)
    assert not glob.glob(folder)
    far = types.SimpleNamespace(sparkContext=types.SimpleNamespace(master="spark://far:7077", getConf=dict, getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(far)


def test_large_near_group_gives_rows_not_pairs(spark):
    rng = random.Random(9)
    base = prose(rng, 200).split()
    rows = []
    for i in range(400):
        words = list(base)
        words[rng.randrange(len(words))] = f"own{i}"
        rows.append((i, " ".join(words), "", ""))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, DOC))
    assert got.agg(F.count(F.lit(1)), F.min("n_links"), F.max("class_id")).first()[:] == (400, 399, 0)


def all_links(rows, t=0.8):
    """Number of links and class of every row, by an inverted index of all shingles: exact."""
    sets = {i: shingles(x) for i, x in rows}
    index = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            index[g].append(i)
    common = defaultdict(int)
    for ids in index.values():
        for a in range(len(ids)):
            for b in range(a):
                common[ids[b], ids[a]] += 1
    links, comp = defaultdict(int), {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for (a, b), n in common.items():
        if n * 9 >= 4 * (len(sets[a]) + len(sets[b])):  # n / union >= 0.8
            links[a] += 1
            links[b] += 1
            a, b = root(a), root(b)
            comp[max(a, b)] = min(a, b)
    return {i: (root(i), links[i]) for i in sets}


def test_no_link_of_the_documents_is_lost(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = all_links([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == want and sum(n for _, n in want.values()) > 100
