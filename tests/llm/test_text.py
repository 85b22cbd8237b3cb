import hashlib
import math
import random
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terragrid.llm import bpe, lm, mixing, pii, quality, token_counts

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id long, text string, source string, n_tokens string, kept string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\n \t", "a", "x" * 70_000, "été\u00a0ñandú\u2003wide", "don't we'll they've it's", "1 22 333  4444", "tail   ", "\x0b\x0c mixed \r\n lines\n\n\nend", "日本語 テキスト", "🙂🙂 ok 👨‍👩‍👧", "<|endoftext|> x"]


def frame(spark, texts, parts=3):
    return spark.createDataFrame([(i, t, f"s{i % 4}" if i % 5 else None, "clash", "clash") for i, t in enumerate(texts)], DOC).repartition(parts)


def prose(seed, n, lines=True):
    rng = random.Random(seed)
    return "".join(rng.choice(["The", "river", "KALT", "stone's", "été", "moon", "a1", "#", "grid,", "we'll", "Ñu"]) + rng.choice([" ", " ", " ", "  ", "\n" if lines else " ", "\t"]) for _ in range(n))


# --- byte-level BPE


@pytest.mark.parametrize(("chunk", "overlap"), [(65_536, 2048), (40, 24), (64, 16)])
def test_bpe_equals_the_library(spark, chunk, overlap):
    texts = [*ODD, *(prose(i, 10 + 15 * i) for i in range(12)), "word " * 300 + "z" * 150 + " more words here" * 10, " " * 200 + "x" + " " * 200, "ab'" * 200, "'re" * 100]
    rows = bpe.bpe_encode(frame(spark, texts), chunk=chunk, overlap=overlap).collect()
    enc = bpe.load("byte_bpe_50k.tiktoken")
    assert len(rows) == len(texts)
    for r in rows:
        ids = enc.encode_ordinary(texts[r["doc_id"]] or "")
        assert bytes(r["ids"]) == struct.pack(f"<{len(ids)}I", *ids), texts[r["doc_id"]][:60]
        assert r["n_tokens"] == len(ids)


def test_bpe_digests_round_trip(spark):
    texts = [*ODD, prose(1, 400)]
    for r in bpe.bpe_digests(frame(spark, texts), chunk=100, overlap=32).collect():
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
    assert bpe.bpe_digests(frame(spark, texts).where("false")).count() == 0
    for r in bpe.bpe_decode(bpe.bpe_encode(frame(spark, texts), chunk=100, overlap=32)).collect():
        assert bytes(r["decoded"]).decode() == (texts[r["doc_id"]] or "")


def test_bpe_decode_of_no_ids(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, b"", "x"), (2, struct.pack("<2I", 64, 65), "x")], "doc_id long, ids binary, decoded string")
    got = bpe.bpe_decode(df).collect()
    assert sorted((r["doc_id"], len(r["decoded"])) for r in got)[:2] == [(1, 0), (2, 0)] and got[0].asDict().keys() == {"doc_id", "decoded"}


def test_bpe_repeated_identifiers_keep_a_row_each(spark):
    df = spark.createDataFrame([(1, prose(1, 100)), (1, prose(1, 100)), (1, "b"), (None, prose(2, 90))], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in bpe.bpe_encode(df, chunk=50, overlap=20).collect()) == sorted((str(i), len(bpe.load("byte_bpe_50k.tiktoken").encode_ordinary(t))) for i, t in [(1, prose(1, 100)), (1, prose(1, 100)), (1, "b"), (None, prose(2, 90))])


# --- token counts


def plain_count(word, scores):
    best = [(0.0, 0)]
    longest = max(map(len, scores))
    for i in range(1, len(word) + 1):
        n = len(word[i - 1].encode())
        top = (best[i - 1][0] + token_counts.BYTE_SCORE * n, best[i - 1][1] + n)
        for j in range(i - 1, max(-1, i - longest - 1), -1):
            if word[j:i] in scores and best[j][0] + scores[word[j:i]] >= top[0]:
                top = (best[j][0] + scores[word[j:i]], best[j][1] + 1)
        best.append(top)
    return best[-1][1]


def test_token_counts_equal_a_plain_recursion(spark):
    texts = [t for t in ODD if t is None or len(t) < 1000] + [prose(i, 60) for i in range(8)]
    scores = token_counts.pieces()
    for r in token_counts.token_counts(frame(spark, texts), carry=["doc_id"]).collect():
        words = WORD.findall(texts[r["doc_id"]] or "")
        assert (r["n_words"], r["n_distinct"]) == (len(words), len(set(words)))
        assert r["n_tokens"] == sum(plain_count("▁" + w, scores) for w in words)


def test_levels_of_the_trie_equal_single_words():
    scores = {"▁": -1.0, "a": -2.0, "ab": -2.5, "abc": -2.6, "c": -2.0, "▁ab": -3.0, "é": -4.0, "🙂a": -9.0, "▁abcc": -7.0}
    rng = random.Random(3)
    words = ["abc", "abcc", "ab", "zé", "abc", "", "🙂a", "c" * 300] + ["".join(rng.choice("abcé🙂z日") for _ in range(rng.randrange(0, 12))) for _ in range(400)]
    pieces = token_counts.Pieces(scores)
    want = [plain_count("▁" + w, scores) for w in words]
    assert [pieces.one("▁" + w) for w in words] == pieces.many(["▁" + w for w in words]).tolist() == want
    big, small = token_counts.Counts(scores), token_counts.Counts(scores, most=3)
    raw = [w.encode() for w in words]
    assert big.of(raw).tolist() == want and [int(small.of([w])[0]) for w in raw] == want and len(small.terminal) <= 5
    assert token_counts.Pieces({}).many(["▁é"]).tolist() == [5] and pieces.many([]).tolist() == []
    real = token_counts.pieces()
    some = [w for t in ODD if t and len(t) < 1000 for w in WORD.findall(t)] + prose(4, 500).split()
    assert token_counts.Pieces(real).many(["▁" + w for w in some]).tolist() == [plain_count("▁" + w, real) for w in some]


def test_token_counts_of_long_and_odd_rows(spark):
    rows = [(None, None, "n"), (1, "x" * 50_000, "n"), (1, "x" * 50_000, "n"), (2, "word " * 50_000, "n"), (3, " \n", "n")]
    got = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")).collect()
    scores = token_counts.pieces()
    one = plain_count("▁word", scores)
    long = plain_count("▁" + "x" * 50_000, scores)
    assert sorted((r["n_words"], r["n_distinct"], r["n_tokens"]) for r in got) == sorted([(0, 0, 0), (1, 1, long), (1, 1, long), (50_000, 1, 50_000 * one), (0, 0, 0)])


def test_token_counts_by_source_and_empty(spark):
    df = frame(spark, [prose(i, 30) for i in range(9)])
    per = {r["source"]: r["n_tokens"] for r in token_counts.counts_by(df, "source").collect()}
    all_ = token_counts.token_counts(df, carry=["doc_id"]).collect()
    assert sum(per.values()) == sum(r["n_tokens"] for r in all_)
    assert token_counts.token_counts(df.where("false")).count() == 0


# --- mixing


def test_mixing_inverts_the_poisson_distribution(spark):
    df = frame(spark, [f"t{i}" for i in range(400)])
    rows = df.collect()
    weights, total, seed = {"s0": 0.4, "s1": 0.0, "s9": 0.1}, 900.0, 3
    counts = {s: sum((r["source"] if r["source"] in weights else None) == s for r in rows) for s in ("s0", "s1", None)}
    want = {}
    for r in rows:
        s = r["source"] if r["source"] in weights else None
        rate = total * (weights[s] if s else 0.5) / counts[s]
        u = int(hashlib.md5(f"{r['doc_id']}:{seed}".encode()).hexdigest()[:13], 16) / 2**52
        k, c = 0, math.exp(-rate)
        while rate and c <= u:
            k += 1
            c += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        want[r["doc_id"]] = k
    got = mixing.mix_sources(df, weights, total, seed=seed)
    out = got.collect()
    have = {}
    for r in out:
        have[r["doc_id"]] = have.get(r["doc_id"], 0) + 1
    assert have == {k: v for k, v in want.items() if v}
    assert [r["mix_key"] for r in out] == sorted(r["mix_key"] for r in out)
    assert {r["copy"] for r in out if r["doc_id"] == out[0]["doc_id"]} == set(range(1, want[out[0]["doc_id"]] + 1))
    assert not any(r["source"] == "s1" for r in out)


def test_mixing_odd_tables(spark):
    df = spark.createDataFrame([(None, None, None), (1, "a", "x"), (1, "a", "x")], "doc_id long, text string, source string")
    assert mixing.mix_sources(df.where("false"), {"x": 0.5}).count() == 0
    out = mixing.mix_sources(df, {"x": 0.5}, 300.0).collect()
    assert {r["doc_id"] for r in out} == {None, 1}
    with pytest.raises(ValueError):
        mixing.mix_sources(df, {"x": 1.2})


def test_mixing_without_identifiers_and_with_any_column_name(spark):
    rows = [(None, f"t{i}", "x", {"a": i}) for i in range(400)] + [(f"{i}", "t", None, None) for i in range(100)] + [("null", "t", "x", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string, m map<string, int>")
    df = df.withColumns({c: F.lit(7) for c in ("__u", "__copies", "u", "copies", "name", "row", "od.d")})
    out = mixing.mix_sources(df, {"x": 0.5}, 900.0)
    assert out.columns == [*df.columns, "copy", "mix_key"]
    got = [r for r in out.collect() if r["doc_id"] is None]
    have = {}
    for r in got:
        assert r["__u"] == r["copies"] == 7
        have[r["text"]] = have.get(r["text"], 0) + 1
    assert set(have.values()) >= {1, 2} and 200 < len(have) < 400 and 350 < len(got) < 550


def test_large_rates_are_sums_of_poisson_counts(spark):
    df = spark.createDataFrame([(i, "t", "x") for i in range(300)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["count"] for r in mixing.mix_sources(df, {"x": 1.0}, 300 * 150.5).groupBy("doc_id").count().collect()}

    def inverse(rate, name):
        u, k, c = int(hashlib.md5(name.encode()).hexdigest()[:13], 16) / 2**52, 0, math.exp(-rate)
        while c <= u:
            k += 1
            c += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        return k

    want = {i: inverse(150.5 - 128, f"{i}:20260101") + sum(inverse(32.0, f"{i}:20260101:{j}") for j in range(1, 5)) for i in range(300)}
    assert got == want
    assert max(len(mixing.poisson_steps(r)) for r in (0.1, 1, 31.9, 32.0)) < 120


# --- quality


def plain_quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = {g for g in grams if grams.count(g) > 1}
    inside = {i + k for i, g in enumerate(grams) if g in often for k in range(8)}
    base = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), base


def test_quality_counts_equal_plain_python(spark):
    rep = prose(3, 30)
    texts = [*[t for t in ODD if t is None or len(t) < 1000], *(prose(i, 12 * i) for i in range(12)), rep + rep, "same line\nsame line\n same line\nsame line \n\n\n", ("one two three four five six seven eight nine " * 6), "# $ % <b>&|* \n" * 5, prose(5, 40) + "\n" + prose(6, 400)]
    rows = quality.quality_rules(frame(spark, texts)).collect()
    assert len(rows) == len(texts) and rows[0].asDict().keys() == {"doc_id", "text", "source", "n_tokens", *[c.split()[0] for c in quality.SCHEMA.split(", ")]}
    for r in rows:
        assert tuple(r[c] for c in (*quality.COUNTS, "base_failed")) == plain_quality(texts[r["doc_id"]]), texts[r["doc_id"]]
        assert not (r["base_failed"] and r["kept"])
    assert quality.quality_rules(frame(spark, texts).where("false")).count() == 0


def plain_bands(text):
    """The verdict of the compression bands, from zstandard and the documented limits alone."""
    import zstandard

    raw = (text or "").encode()
    size = lambda x: len(zstandard.ZstdCompressor(level=3).compress(x))
    low, high = next((a, b) for n, a, b in ((256, 0.0, 4.0), (1024, 1.2, 4.5), (4096, 1.35, 5.0), (16384, 1.5, 6.0), (10**18, 1.6, 8.0)) if len(raw) < n)
    ratio = len(raw) / size(raw) if raw else 0.0
    starts = sorted({*range(0, len(raw) - 4095, 4096), len(raw) - 4096}) if len(raw) >= 4096 else []
    ratios = [4096 / size(raw[i : i + 4096]) for i in starts]
    tight, loose = sum(r > 6.0 for r in ratios), sum(r < 1.3 for r in ratios)
    if ratio > high or 4 * tight > len(ratios) > 0:
        return ratio, len(ratios), tight + loose, "repetitive"
    return ratio, len(ratios), tight + loose, "incompressible" if raw and ratio < low or 4 * loose > len(ratios) > 0 else "kept"


def test_quality_verdicts_equal_a_plain_computation(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    texts = {r["doc_id"]: r["text"] for r in rows}
    got = quality.quality_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), carry=["doc_id"]).collect()
    seen = set()
    for r in got:
        ratio, chunks, bad, verdict = plain_bands(texts[r["doc_id"]])
        base = r["base_failed"]
        assert (r["zstd_ratio"], r["n_chunks"], r["n_bad_chunks"], r["verdict"], r["kept"]) == (ratio, chunks, bad, "base" if base else verdict, not base and verdict == "kept")
        seen.add(r["verdict"])
    assert seen >= {"kept", "base"} and len(got) == len(texts)


def test_lines_and_windows_whose_polynomial_hashes_meet_are_told_apart(spark):
    bits = [bin(i).count("1") & 1 for i in range(4096)]
    texts = []
    for n in (1024, 2048, 4096):
        a, b = ("".join(two[x] for x in bits[:n]) for two in ("ab", "ba"))
        texts += [f"{a}\n{b}\n{a}", f"{a} {b} " * 6, " ".join([a] * 8 + ["x"] + [b] * 8)]
    for r in quality.quality_rules(frame(spark, texts)).collect():
        assert tuple(r[c] for c in (*quality.COUNTS, "base_failed")) == plain_quality(texts[r["doc_id"]])


def test_compression_bands(spark):
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    noise = " ".join("".join(rng.choice(letters) for _ in range(40)) for _ in range(300))
    normal = " ".join("".join(rng.choice(["ka", "lo", "mi", "ten", "ur", "sa", "ve"]) for _ in range(rng.randrange(1, 4))) for _ in range(1500))
    loop = " ".join(f"item {i % 10} of the list is {i % 7} and costs {i % 3}" for i in range(600))
    got = {r["doc_id"]: r["verdict"] for r in quality.quality_rules(frame(spark, [noise, normal, loop, normal[:5000] + " " + noise])).collect()}
    assert got[0] == "incompressible" and got[1] == "kept" and got[2] in ("repetitive", "base") and got[3] == "incompressible"


def test_the_end_of_a_text_is_judged_as_a_chunk():
    import zstandard

    press = zstandard.ZstdCompressor(level=quality.LEVEL).compress
    rng = random.Random(2)
    normal = " ".join("".join(rng.choice(["ka", "lo", "mi", "ten", "ur", "sa", "ve"]) for _ in range(rng.randrange(1, 4))) for _ in range(3000)).encode()
    noise = bytes(rng.randrange(33, 127) for _ in range(4095))
    assert quality.judge_bands(normal[:4096] + noise, press)[1:] == (2, 1, "incompressible")
    assert quality.judge_bands(normal[:4096] + b"so it goes " * 372, press)[1:] == (2, 1, "repetitive")
    assert [quality.judge_bands(normal[:n], press)[1:] for n in (4095, 4096, 4097, 8191, 8192, 8193)] == [(k, 0, None) for k in (0, 1, 2, 2, 2, 3)]


# --- language model


def test_lm_base_figures_equal_plain_counts(spark):
    texts = [t for t in ODD if t is None or len(t) < 1000] + [prose(i, 40) for i in range(60)]
    df = frame(spark, texts)
    import zlib

    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))}
    tokens = {i: [*WORD.findall((t or "").translate(UP)), None] for i, t in enumerate(texts)}
    counts = {}
    for i, ts in tokens.items():
        for t in ts if not held[i] else ():
            counts[t] = counts.get(t, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for most in (150_000, 4):  # with few words in the broadcast the others' counts come by a join
        rows = lm.score_texts(df, states=2, rounds=2, broadcast_words=most).collect()
        assert len(rows) == len(texts)
        for r in rows:
            ts = tokens[r["doc_id"]]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ts), sum(t in counts for t in ts), n)
            assert r["base_score"] == pytest.approx(sum(math.log10((counts.get(t, 0) + 0.1) / (n + 0.1 * (v + 1))) for t in ts), abs=1e-6)
            assert r["score"] < 0


def test_lm_beats_its_base_on_held_out_texts(spark):
    rng = random.Random(4)
    words = {k: [f"{k}{rng.randrange(10**6)}" for _ in range(80)] for k in ("al", "be", "ce")}
    texts = [" ".join(rng.choice(words[k]) for _ in range(60)) for k in (["al", "be", "ce"] * 120)]
    rows = [r for r in lm.score_texts(frame(spark, texts), states=3, rounds=8).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows) + 0.1 * sum(r["n_tokens"] for r in rows)


def test_lm_without_training_texts(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "")], "doc_id long, text string")
    got = sorted(tuple(r) for r in lm.score_texts(df).select("n_tokens", "n_known", "train_tokens", "base_score").collect())
    assert got == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert lm.score_texts(df.where("false")).count() == 0


def tiny_model():
    rng = np.random.default_rng(3)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    return lm.Model(norm(rng.random(2)), norm(rng.random((2, 2))), norm(rng.random((2, 4))))


def paths(m, seq):
    """All state paths of a sequence with their probabilities."""
    import itertools

    for p in itertools.product(range(2), repeat=len(seq)):
        pr = m.start[p[0]] * m.emit[p[0], seq[0]]
        for t in range(1, len(seq)):
            pr *= m.move[p[t - 1], p[t]] * m.emit[p[t], seq[t]]
        yield p, pr


def test_forward_recursion_and_expected_counts_equal_enumeration():
    m = tiny_model()
    seqs = [np.array(s) for s in ([0, 1, 2, 3, 1], [2], [3, 3, 0], [1, 0, 1, 0, 1, 0])]
    want = [math.log10(sum(p for _, p in paths(m, s))) for s in seqs]
    assert m.log10_likelihood(seqs) == pytest.approx(want)
    start, move, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((2, 4))
    for s in seqs:
        total = sum(p for _, p in paths(m, s))
        for path, p in paths(m, s):
            start[path[0]] += p / total
            for t, k in enumerate(path):
                emit[k, s[t]] += p / total
                if t:
                    move[path[t - 1], k] += p / total
    seqs += [np.zeros(0, int)]
    got = m.expect(seqs)
    for a, b in zip(got, (start, move, emit, sum(want))):
        assert a == pytest.approx(b)
    assert [x for x in lm._groups(np.array([3, 9, 1, 2]), 5)] == [[1], [0, 3], [2]]


def test_long_texts_learn_over_every_cut():
    m = tiny_model()
    seq = np.random.default_rng(5).integers(0, 4, 203)
    for block in (1, 7, 50, 203, 500):
        for a, b in zip(m.expect_long(seq, block), m.expect([seq])):
            assert a == pytest.approx(b)


def plain_model_scores(texts, held, states, rounds, own, tails, gain):
    """Scores by the definitions alone: dictionaries, one sequence at a time, no scaling but logarithms of sums."""
    import zlib

    tokens = [[*WORD.findall((t or "").translate(UP)), None] for t in texts]
    counts = {}
    for ts, h in zip(tokens, held):
        for t in () if h else ts:
            counts[t] = counts.get(t, 0) + 1
    n = sum(counts.values())
    words = sorted((w for w in counts if w is not None), key=lambda w: (-counts[w], w.encode()))
    head = {w: 1 + i for i, w in enumerate(words[:own])}
    kind = lambda w: 0 if w is None else head.get(w) or 1 + len(head) + zlib.crc32(w.encode()[-4:]) % tails
    classes = 1 + len(head) + tails
    mass, kinds = np.zeros(classes), np.zeros(classes)
    for w, c in counts.items():
        mass[kind(w)] += c
        kinds[kind(w)] += 1
    share = lambda w: 1.0 if kind(w) < 1 + len(head) else (counts.get(w, 0) + 0.1) / (mass[kind(w)] + 0.1 * (kinds[kind(w)] + 1))
    m = lm.Model.first(mass, states)
    seqs = [[kind(t) for t in ts] for ts in tokens]

    def both_ways(seq):
        a, b = [m.start * m.emit[:, seq[0]]], [np.ones(states)]
        for x in seq[1:]:
            a.append(a[-1] @ m.move * m.emit[:, x])
        for x in reversed(seq[1:]):
            b.append(m.move @ (m.emit[:, x] * b[-1]))
        return a, b[::-1], a[-1].sum()

    reached = -np.inf
    for _ in range(rounds):
        start, move, emit, like = np.zeros(states), np.zeros((states, states)), np.zeros((states, classes)), 0.0
        for seq, h in zip(seqs, held):
            if not h:
                a, b, p = both_ways(seq)
                like += math.log10(p)
                start += a[0] * b[0] / p
                for t, x in enumerate(seq):
                    emit[:, x] += a[t] * b[t] / p
                    if t:
                        move += np.outer(a[t - 1], m.emit[:, x] * b[t]) * m.move / p
        if like / n - reached < gain:
            break
        reached = like / n
        m = m.learn(start, move, emit, mass)
    return [math.log10(both_ways(seq)[2]) + sum(math.log10(share(t)) for t in ts) for seq, ts in zip(seqs, tokens)]


@pytest.mark.parametrize(("rounds", "most"), [(0, 100), (2, 100), (9, 6)])
def test_lm_scores_equal_a_plain_model(spark, rounds, most):
    import zlib

    texts = [t for t in ODD if t is None or len(t) < 100] + [prose(i, 25) for i in range(40)]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    counts = {}
    for t, h in zip(texts, held):
        for w in () if h else WORD.findall((t or "").translate(UP)):
            counts[w] = counts.get(w, 0) + 1
    own = min(5, sum(c > sorted(counts.values())[-6] for c in counts.values()))
    want = plain_model_scores(texts, held, 2, rounds, own, 4, 0.01)
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(frame(spark, texts), states=2, rounds=rounds, broadcast_words=most, own_classes=own, tails=4, gain=0.01).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, abs=1e-6)


def test_lm_of_odd_tables(spark):
    rows = [(None, None, 1), (1, "a b", 1), (1, "a b", 1), (2, "", 1), (3, "y" * 100_000, 1), (4, "word " * 30_000, 1)]
    got = lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string, score long"), states=2).collect()
    assert len(got) == 6 and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert {r["n_tokens"] for r in got} == {1, 3, 2, 30_001} and len({r["score"] for r in got if r["doc_id"] == 1}) == 1


# --- surrogates


def test_surrogates_keep_type_format_and_reference():
    key = b"k"
    text = "Mail to ann.lee@site.org or Ann.Lee@site.org, +1 (017) 555-7713, 4111 1111 1111 1111, ip 10.1.2.3, 123-45-6789, token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" by Mrs. Clara Stone and Mr Stone."
    new, counts, distinct = pii.replace_entities(text, key)
    assert counts == {"email": 2, "phone": 1, "card": 1, "ip": 1, "ssn": 1, "secret": 1, "name": 2} and distinct == 8
    for old in ("ann.lee", "555-7713", "4111", "10.1.2.3", "6789", "04dbeb", "Stone"):
        assert old not in new
    mails = re.findall(r"\S+@\S+?(?=[ ,])", new)
    assert len(set(mails)) == 1
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", new)[0]
    assert pii.luhn(card.replace(" ", ""))
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", new) and re.search(r"\d{3}-\d{2}-\d{4}", new) and re.search(r'"[0-9a-f]{40}"', new)
    ladies, gentlemen = re.search(r"Mrs\. ([\w-]+) (\w+)", new), re.search(r"Mr (\w+)", new)
    assert ladies[1].split("-")[0] in pii.GIVEN["latin", "f"] and ladies[2] == gentlemen[1]
    assert pii.replace_entities(text, key)[0] == new and pii.replace_entities(text, b"other")[0] != new


def test_surrogates_leave_clean_text_alone():
    for t in ("Version 2.0. of 1234567890123456 and 999.999.999.999, 12 - 13, a@b", "Herrlich, Mrs", "10 000 000", "", "x = 'short'"):
        assert pii.replace_entities(t, b"k")[0] == t


def test_permutation_is_one_and_scripts_match():
    assert sorted(pii.permute(b"k", "x", i, 1000) for i in range(1000)) == list(range(1000))
    new, _, _ = pii.replace_entities("г-жа Анна Петрова", b"k")
    assert re.fullmatch(r"г-жа (?:" + "|".join(pii.GIVEN["cyrillic", "f"]) + r")-[А-я]{4} [А-я]{9}", new)
    for name in ("Παπαδοπούλου", "Ñandú", "Şahin", "王小明"):
        new, counts, _ = pii.replace_entities(f"Dr {name}", b"k")
        scripts = lambda t: [pii.unicodedata.name(c).split()[0] for c in t]
        assert counts == {"name": 1} and new[3:] != name and set(scripts(new[3:])) == set(scripts(name))


def test_surrogates_are_of_one_entity_over_all_texts():
    key = b"terragrid-surrogates-1"
    word = lambda i, letters: "".join(letters[i >> 4 * j & 15] for j in range(4))
    for title, letters in (("Mr", "abcdefghijklmnop"), ("г-н", "абвгдежзиклмнопр")):
        families = [f"{title} {word(i, letters).capitalize()}" for i in range(20_000)]
        people = [f"{title} {word(i, letters).capitalize()} {letters[1:5].capitalize()}" for i in range(20_000)]
        new = {pii.surrogate("name", t, key) for t in families + people}
        assert len(new) == 40_000 and not new & {*families, *people}
    # alone or beside another, an entity has the same surrogate, in each of its spellings
    both = ["Mr James Hill", "Mr David Hill", "Mr John Hill", "+1 555 123 4567", "+15551234567", "+44 20 7946 0958", "+442079460958"]
    alone = [pii.replace_entities(t, key)[0] for t in both]
    assert pii.replace_entities(" / ".join(both), key)[0] == " / ".join(alone)
    digits = [re.sub(r"\D", "", t) for t in alone[3:]]
    assert len(set(alone)) == 7 and digits[0] == digits[1] != digits[2] == digits[3]


def test_permutation_leaves_nothing_in_its_place():
    for size in (2, 3, 10, 1000):
        for label in "abcdefgh":
            new = [pii.permute_all(b"k", label, i, size) for i in range(size)]
            assert sorted(new) == list(range(size)) and all(i != v for i, v in enumerate(new))


def test_cards_beside_other_numbers_are_found():
    card = "4111 1111 1111 1111"
    around = ["{} 12/26", "{} 123", "2024 {}", "12 {}", "{} 999.999.999.999", "no 1 of 2: {}", "{}-77", "1.2.3.4 {} 10.1.2.300"]
    around += [f"{n} {{}}" for n in range(10, 60)] + [f"{{}} {n}" for n in range(10, 60)] + [f"{n} {{}}" for n in range(1990, 2030)] + [f"7 {n} {{}} {n}" for n in range(100, 130)]
    for form in around:
        new, counts, _ = pii.replace_entities(form.format(card), b"k")
        assert counts.get("card") == 1 and "1111" not in new, form
    # a phone number that is too long with what follows it, and a card after a number with no type
    new, counts, _ = pii.replace_entities("+123 4567 1234 1234 1234 12 and 1234567890123456 5500 0000 0000 0004", b"k")
    assert counts == {"phone": 1, "card": 1} and "5500" not in new and "1234567890123456" in new


def test_digits_of_other_scripts_are_found():
    arabic = str.maketrans("0123456789", "٠١٢٣٤٥٦٧٨٩")
    for t in ("+966 50 123 4567", "4111 1111 1111 1111"):
        new, counts, _ = pii.replace_entities(t.translate(arabic), b"k")
        assert sum(counts.values()) == 1 and new == pii.replace_entities(t, b"k")[0].translate(arabic)


def planted(rng):
    """An entity of a random type and form, that is one by construction."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    w = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    kind = rng.choice(("email", "phone", "ip", "card", "ssn", "secret", "name"))
    if kind == "email":
        return kind, f"{w(rng.randrange(1, 9))}{rng.choice(['', '.', '_', '-', '+'])}{n(2)}@{w(4)}.{w(rng.randrange(2, 5))}"
    if kind == "phone":
        code, rest = rng.choice("1 7 20 33 44 49 86 91 351 420 971 998".split()), n(9)
        forms = [f"+{code}{rest}", f"+{code} {rest[:3]} {rest[3:6]} {rest[6:]}", f"+{code}-{rest[:3]}-{rest[3:6]}-{rest[6:]}", f"+{code} ({rest[:3]}) {rest[3:6]}-{rest[6:]}", f"({rest[:3]}) {rest[3:6]}-{rest[5:9]}", f"+{code}.{rest[:2]}.{rest[2:5]}.{rest[5:]}"]
        return kind, rng.choice(forms)
    if kind == "ip":
        return kind, ".".join(str(rng.randrange(256)) for _ in range(4))
    if kind == "card":
        body = rng.choice("3456") + n(14)
        sums = [sum((d * 2 - 9 if d > 4 else d * 2) if i % 2 == 0 else d for i, d in enumerate(map(int, body[::-1] + ""))) for _ in (0,)]
        digits = body + str(-sums[0] % 10)
        sep = rng.choice(["", " ", "-"])
        return kind, sep.join(digits[i : i + 4] for i in range(0, 16, 4))
    if kind == "ssn":
        return kind, f"{n(3)}-{n(2)}-{n(4)}"
    if kind == "secret":
        value = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(rng.randrange(14, 60))) + "a7"
        return kind, rng.choice([f'x = "{value}"', f"api_key={value}", f"password: {value}", "AKIA" + "".join(rng.choice("ABCDEFGHIJ0123456789") for _ in range(16)), f"sk-{value}abcdef"])
    given, family = (w(rng.randrange(2, 9)).capitalize() for _ in range(2))
    return kind, rng.choice(["Mr ", "Mrs. ", "Dr ", "Herr "]) + rng.choice([family, f"{given} {family}"])


def test_planted_entities_are_found_whole_and_stay_apart():
    """Random forms of every type between plain words: each is found, nothing else changes, surrogates are one to one."""
    rng, key = random.Random(21), b"k"
    words = ["so", "then", "grid", "moon", "and", "the", "river"]
    there, back = {}, {}
    for _ in range(1500):
        parts, kinds = [], []
        for _ in range(rng.randrange(1, 4)):
            kind, found = planted(rng)
            parts += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) + ", ", found, " , "]
            kinds.append(kind)
        text = "".join(parts)
        spans = list(pii.entities(text))
        assert [k for k, _, _ in spans] == kinds, text
        new, counts, _ = pii.replace_entities(text, key)
        assert sum(counts.values()) == len(kinds)
        at, out = 0, []
        for (kind, start, end), found in zip(spans, parts[1::3]):
            assert found.endswith(text[start:end]) or kind == "secret" and text[start:end] in found
            one = pii.surrogate(kind, text[start:end], key)
            out += [text[at:start], one]
            at = end
            old, sur = (kind, pii.identity(kind, text[start:end])), (kind, pii.identity(kind, one))
            assert old != sur and there.setdefault(old, sur) == sur and back.setdefault(sur, old) == old
            if kind == "card":
                assert pii.luhn(re.sub(r"\D", "", one))
            if kind != "email":
                assert [c.isdigit() for c in one if c in " -.()+"] == [c.isdigit() for c in text[start:end] if c in " -.()+"] or kind == "name" or kind == "ip"
        assert "".join(out) + text[at:] == new
    assert len(there) > 2000


def test_any_numbers_and_signs_pass():
    rng = random.Random(22)
    for _ in range(3000):
        text = "".join(rng.choice("0123456789012345678901234567890+-. ()@:='\"/aAzßŞ١٢") for _ in range(rng.randrange(1, 60)))
        new, counts, _ = pii.replace_entities(text, b"k")
        assert (new == text) == (not counts)
    for n in range(5, 20):
        new, counts, _ = pii.replace_entities(f"call +{'12345678901234567890'[:n]} now", b"k")
        assert counts == ({"phone": 1} if 7 <= n <= 15 else {}) or "card" in counts


def test_types_that_are_left_out_have_no_match():
    rng = random.Random(23)
    for _ in range(1500):
        text = " ".join(planted(rng)[1] if rng.random() < 0.4 else rng.choice(["so", "Mr", "x=", "7", "٣", "a:b", "12 34"]) for _ in range(4))
        kinds = pii.kinds_in(text)
        assert not any(pii._ALONE[k].search(text) for k in pii.PATTERNS if k not in kinds), text


def test_letters_pass_a_permutation():
    import itertools

    for sets in (["ab", "", "xyz", "01"], ["abcde", "abcde"], ["ab"]):
        texts = ["".join(t) for t in itertools.product(*[s or "-" for s in sets])]
        new = [pii.reformed(b"k", "x", t, sets) for t in texts]
        assert sorted(new) == sorted(texts) and all(a != b for a, b in zip(new, texts))
    long = "".join(random.Random(2).choice("abcdefghij") for _ in range(300))
    assert len(pii.reformed_word(b"k", "x", long)) == 300 and pii.reformed_word(b"k", "x", long) != long


def test_entities_of_a_corpus_keep_apart(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    table = pii.entity_table(docs, "k")
    plain = {}
    for r in docs.collect():
        for kind, a, b in pii.entities(r["text"] or ""):
            plain.setdefault((kind, pii.identity(kind, r["text"][a:b])), set()).add(pii.identity(kind, pii.surrogate(kind, r["text"][a:b], pii.key_bytes("k"))))
    assert table.count() == len(plain) > 20 and all(len(v) == 1 for v in plain.values())
    assert len({(k, *v) for (k, _), v in plain.items()}) == len(plain)
    assert pii.collisions(table).count() == 0
    rows = [("name", b"a", b"1"), ("name", b"b", b"1"), ("email", b"c", b"2"), ("email", b"c", b"3"), ("ip", b"d", b"1")]
    assert sorted(map(tuple, pii.collisions(spark.createDataFrame(rows, "kind string, entity binary, surrogate binary")).collect())) == [("email", "split"), ("name", "shared")]
    monkeypatch.setattr(pii, "collisions", lambda t: spark.createDataFrame([("name", "shared")], "kind string, what string"))
    with pytest.raises(ValueError):
        pii.surrogates(docs, "k")


def test_odd_tables_of_surrogates(spark):
    rows = [(None, None, 5), (1, "Mr Stone", 5), (1, "Mr Stone", 5), (2, "x" * 100_000 + " a@b.cd", 5)]
    got = pii.surrogates(spark.createDataFrame(rows, "doc_id long, text string, n_entities long"), "k").collect()
    assert sorted((r["n_entities"], r["text"] is None) for r in got) == [(0, True), (1, False), (1, False), (1, False)]
    assert len({r["text"] for r in got if r["doc_id"] == 1}) == 1 and "n_entities" in got[0].asDict()


def test_surrogates_of_a_table(spark):
    texts = [*ODD, "write to a.b@c.de now"]
    rows = pii.surrogates(frame(spark, texts), "k").collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]]
        assert (r["text"] == t) == (r["n_entities"] == 0)
    assert pii.surrogates(frame(spark, texts).where("false"), "k").count() == 0
