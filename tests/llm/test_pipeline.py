import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terragrid.llm import bpe, mixing
from terragrid.llm.queries import MIX_WEIGHTS, QUERIES

from .test_dedup import UP, brute_near

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    from .test_text import plain_quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality rules"](spark, docs, SF)
    assert kept.columns == docs.columns
    rows = {r["doc_id"]: r for r in docs.collect()}
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids <= {i for i, r in rows.items() if not plain_quality(r["text"])[5]}
    best = {}
    for i in sorted(ids):
        best[rows[i]["text"].translate(UP)] = i
    near = brute_near([(i, rows[i]["text"]) for i in sorted(best.values())])
    left = docs.where(F.col("doc_id").isin([i for i, (c, _) in near.items() if c == i]))
    mixed = [r["doc_id"] for r in mixing.mix_sources(left, MIX_WEIGHTS).collect()]
    enc = bpe.load("byte_bpe_50k.tiktoken")
    want = sorted((i, len(enc.encode_ordinary(rows[i]["text"])), hashlib.sha256(rows[i]["text"].encode()).hexdigest()) for i in mixed)
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in got) == want


def test_stages_on_empty_and_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"w{i} more{i * 7 % 13}" for i in range(40))
    odd = [(None, None, None, None, None), (1, "", "en", "src0", 0), (2, long, None, None, None), (3, long, "en", "src0", 5), (3, long, "en", "src0", 5), (None, long, "en", "src1", 5)]
    for rows in ([], odd):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, spark.createDataFrame(rows, schema), SF).collect()


def test_stages_equal_plain_rules_on_odd_rows_and_clashing_columns(spark):
    from .test_text import plain_bands, plain_quality

    long = " ".join(f"w{i} more{i * 7 % 13}" for i in range(60))
    near = long + " end"
    texts = [(None, None), (1, ""), (2, long), (3, long.upper()), (3, long.upper()), (None, long), (4, near), (5, "few words"), (6, "so it goes " * 2000), (7, " ".join(f"v{i * i} u{i}" for i in range(9000)))]
    names = ["doc_id", "text", "source", "kept", "n_words", "__row", "row", "copy", "copies", "mix_key", "key"]
    docs = spark.createDataFrame([(i, t, None, "k", n, "r", "q", "c", "d", "m", "y") for n, (i, t) in enumerate(texts)], "doc_id long, text string, source string, kept string, n_words long, __row string, row string, copy string, copies string, mix_key string, key string")
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality rules"](spark, docs, SF)
    want = [n for n, (_, t) in enumerate(texts) if not plain_quality(t)[5] and plain_bands(t)[3] == "kept"]
    assert kept.columns == names and sorted(r["n_words"] for r in kept.collect()) == want == [2, 3, 4, 5, 6, 9]
    one = stage["exact dedup"](spark, kept, SF)
    rows = one.collect()
    assert one.columns == names and sorted((r["doc_id"], len(r["text"])) for r in rows) == sorted([(3, len(long)), (4, len(near)), (7, len(texts[9][1]))])
    left = stage["n-gram Jaccard join"](spark, one, SF)
    assert left.columns == names and sorted(r["doc_id"] for r in left.collect()) == [3, 7]
    mixed = stage["mixing sources"](spark, left, SF)
    assert mixed.columns == names and {tuple(r[c] for c in names[3:] if c != "n_words") for r in left.collect()} == {("k", "r", "q", "c", "d", "m", "y")}
    assert {r["doc_id"] for r in stage["byte-level BPE"](spark, left, SF).collect()} == {3, 7}


def test_near_stage_goes_by_rows_where_identifiers_repeat(spark):
    words = [[f"{k}{i}" for i in range(60)] for k in "abcd"]
    texts = [" ".join(w) for w in words]
    near = [f"{t} end" for t in texts]
    rows = [(1, texts[0]), (7, near[0]), (7, texts[1]), (8, texts[2]), (8, near[2]), (None, texts[3]), (None, near[3])]
    rows += [(9, "two words"), (9, "two words"), (None, None), (None, None), (3, ""), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", f"src{n}", n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.near_stage(spark, docs, SF)
    assert left.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert sorted(got[i][1][0] for i in range(len(got)) if got[i][1]) == ["a", "b", "c", "d", "t"] and len(got) == 9
    assert (1, texts[0]) in got and (7, texts[1]) in got and got.count((None, None)) == got.count((3, "")) == 2


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_return_a_row_for_each_row(spark, name):
    got = QUERIES[name](spark, SF)
    source = "pages" if re.match(r"op(3|8)_", name) else "documents"
    n = spark.read.parquet(f"{SF}/{source}.parquet").count()
    assert got.count() == n if name != "op6_mix_sources" else got.count() > 0
