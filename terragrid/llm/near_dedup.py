"""N-gram Jaccard join by MinHash banding.

Each text becomes the set of its five-word shingles (lower-casing A-Z). Bands and rows are
chosen for a target recall at the threshold. Texts are dealt by band hash; texts in one bucket
whose signatures are alike enough fall into one candidate family, and within a family every
pair's Jaccard similarity is counted on the full shingle sets, or follows from the exact
distances of both from one text of the family (Jaccard distance obeys the triangle inequality).
Texts with equal words are one class from the start, so copies cost one row. What a task compares
is two blocks of bounded size, and tasks give numbers of links and the groups that links connect
as stars, never all pairs.

Large groups: a bucket or family in which most texts are near one of them costs rows in proportion
to its size; the texts that are not are compared, block against block, with all others. Joins on a
hub's key or a large group's label have one row for each key on the other side, so that adaptive
execution can split them.
"""

from __future__ import annotations

import itertools
import math
from fractions import Fraction
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, mix, slices, sorted_groups, stored

SHINGLE, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.9999, 128
#: Signatures of a bucket are compared with this many standard errors below the threshold.
SLACK = 4.5
#: Members of a bucket that one task compares with each other; in larger ones with HEADS of them first.
BUCKET_BLOCK, HEADS = 1024, 8
#: Texts, and words, of a block: what a task compares at once is two blocks, however large the family is.
TEXT_BLOCK, WORD_BLOCK = 1024, 1_000_000
#: Distances from a family's pivot are told in bins, so many to the largest distance of a link.
BINS = 64
#: Representatives that are fetched by a broadcast of their identifiers, and buckets whose heads are broadcast; more go by a join.
BROADCAST_IDS, BROADCAST_HEADS = 200_000, 10_000
#: Pivots' texts that go by a broadcast, in bytes.
BROADCAST_BYTES = 64 << 20


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which bands * rows <= most still meet the recall at the threshold."""
    best = None
    for rows in range(1, most + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("no bands within that many hashes")
    return best


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:n] | np.uint64(1), x[n:]


def shingle_sets(s, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, index of the first word) of the shingles of a Slice; a row with fewer words has its words as one shingle."""
    first, h = s.windows(width)
    few = np.flatnonzero((s.n_words > 0) & (s.n_words < width))
    if len(few):
        at, words = np.searchsorted(s.doc, few), s.word_hash()
        own = s.n_words[few].astype(np.uint64)
        for j in range(width - 1):
            on = np.flatnonzero(j < s.n_words[few])
            own[on] = mix(own[on]) + words[at[on] + j]
        first, h = np.concatenate([first, at]), np.concatenate([h, mix(own)])
        order = np.argsort(first, kind="stable")
        first, h = first[order], h[order]
    return s.doc[first], h, first


def class_keys(s) -> list[bytes]:
    """16 bytes for each row that equal word sequences share: a BLAKE2b digest of the words."""
    return [blake2b(b" ".join(s.row_bytes(i).split()), digest_size=16).digest() for i in range(s.rows)]


def _sketch_batches(batches, bands: int, rows: int, shingle: int):
    mul, add = _multipliers(bands * rows)
    for b in batches:
        keys, words, sigs, hashes = [], [], [], []
        for _, s in slices(b.column(0), lower=True):
            row, h, _ = shingle_sets(s, shingle)
            mins = np.full((s.rows, bands * rows), np.uint32(0xFFFFFFFF))
            if len(h):
                at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                tmp = np.empty_like(h)
                for p in range(bands * rows):
                    np.multiply(h, mul[p], out=tmp)
                    np.add(tmp, add[p], out=tmp)
                    mins[row[at], p] = np.minimum.reduceat(tmp >> np.uint64(32), at).astype(np.uint32)
            band = np.zeros((s.rows, bands), np.uint64)
            for r in range(rows):
                band = mix(band * np.uint64(31) + mins[:, r::rows].astype(np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0xC2B2AE3D27D4EB4F))
            small = (mins * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)
            keys += class_keys(s)
            words.append(s.n_words)
            sigs += [x.tobytes() for x in small]
            hashes += [x for x in band.astype(np.int64)]
        cols = [pa.array(keys, pa.binary()), pa.array(np.concatenate(words) if words else [], pa.int64()), pa.array(sigs, pa.binary())]
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.int64)
        offs = np.arange(len(keys) + 1, dtype=np.int32) * bands
        yield pa.RecordBatch.from_arrays([b.column(1), *cols, pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))], names=["id", "key", "words", "sig", "bands"])


def _families_of(sig: np.ndarray, least: int, half: int | None) -> list[list[int]]:
    """Groups of at least two rows that are connected by at least ``least`` equal signature bytes. With
    ``half``, only pairs across the first ``half`` rows and the others count.

    A row that has joined a group is compared only with rows that have joined none, so a tight
    group costs one pass."""
    groups = []
    waiting = np.arange(len(sig))
    side = np.arange(len(sig)) >= (half or len(sig))
    while len(waiting):
        group, stack, waiting = [waiting[0]], [waiting[0]], waiting[1:]
        while stack and len(waiting):
            i = stack.pop()
            like = np.count_nonzero(sig[waiting] == sig[i], axis=1) >= least
            if half:
                like &= side[waiting] != side[i]
            hit = waiting[like].tolist()
            group += hit
            stack += hit
            waiting = waiting[~like]
        if len(group) > 1:
            groups.append(group)
    return groups


def _stars(groups: list[list[int]], keys: list[bytes]) -> list[tuple[bytes, bytes]]:
    """Each group as edges to its least key: buckets with one least member give the same edges."""
    out = []
    for g in groups:
        names = [keys[i] for i in g]
        low = min(names)
        out += [(low, k) for k in names if k != low]
    return out


def _candidate_batches(batches, least: int, sided: bool):
    """Edges among the signatures of each group; ``sided``, only between rows whose fourth column is true and others."""
    us, vs = [], []
    width = 3 if sided else 1
    for g in sorted_groups(batches, width):
        if g.num_rows < 2:
            continue
        half = None
        if sided:
            g = g.sort_by([("asks", "descending")])
            half = pc.sum(g.column("asks")).as_py()
            if not 0 < half < g.num_rows:
                continue
        keys = g.column("key").to_pylist()
        sig = np.frombuffer(b"".join(g.column("sig").to_pylist()), np.uint8).reshape(len(keys), -1)
        for u, v in _stars(_families_of(sig, least, half), keys):
            us.append(u)
            vs.append(v)
        if len(us) > 20_000:
            yield _edges(us, vs)
            us, vs = [], []
    yield _edges(us, vs)


def _headed_batches(batches, least: int):
    """bucket, n, key, sig, heads (key, sig): the heads that a row is like, and whether there are none."""
    for b in batches:
        keys, sigs, heads = (b.column(i).to_pylist() for i in (2, 3, 4))
        like = []
        for k, s, hs in zip(keys, sigs, heads):
            own = np.frombuffer(s, np.uint8)
            like.append([h["key"] for h in hs if np.count_nonzero(np.frombuffer(h["sig"], np.uint8) == own) >= least])
        asks = [not x for x in like]
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(like, pa.list_(pa.binary())), pa.array(asks, pa.bool_())], names=["bucket", "n", "key", "sig", "like", "asks"])


def _wide_candidates(wide: DataFrame, least: int) -> DataFrame:
    """Edges of buckets of more than a block: (bucket, n, key, sig).

    Each row is compared with a few heads of its bucket. Rows that are like a head are joined to it and need
    no comparison among themselves; those like none are compared, in blocks, with all rows. So a bucket
    with one or a few tight groups costs a row or two a member, not blocks times blocks.
    """
    slot = F.pmod(F.xxhash64("key", F.lit(3)), F.lit(HEADS))
    heads = wide.groupBy("bucket").agg(*[F.min(F.when(slot == i, F.struct("key", "sig"))).alias(f"h{i}") for i in range(HEADS)])
    heads = stored(heads.select("bucket", F.filter(F.array(*[f"h{i}" for i in range(HEADS)]), lambda h: h.isNotNull()).alias("heads")), "near-heads")
    few = heads.count() <= BROADCAST_HEADS
    told = wide.join(F.broadcast(heads) if few else heads, "bucket").select("bucket", "n", "key", "sig", "heads")
    told = stored(told.mapInArrow(lambda it: _headed_batches(it, least), "bucket long, n long, key binary, sig binary, like array<binary>, asks boolean"), "near-wide")
    drop_stored(heads)
    edges = told.select(F.explode("like").alias("u"), F.col("key").alias("v")).where("u <> v")
    asking = told.where("asks").groupBy("bucket").agg(F.count(F.lit(1)).alias("asking"))
    rest = told.join(asking, "bucket")
    parts, rows = F.ceil(F.col("asking") / BUCKET_BLOCK).cast("int"), F.ceil(F.col("n") / BUCKET_BLOCK).cast("int")
    own = F.pmod(F.xxhash64("key"), rows).cast("int")
    part = F.pmod(F.xxhash64("key"), parts).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asked = rest.withColumn("part", each(parts)).select("bucket", own.alias("block"), "part", F.lit(False).alias("asks"), "key", "sig")
    asks = rest.where("asks").withColumn("block", each(rows)).select("bucket", "block", part.alias("part"), F.lit(True).alias("asks"), "key", "sig")
    both = asked.unionByName(asks).repartition("bucket", "block", "part").sortWithinPartitions("bucket", "block", "part")
    return edges.unionByName(both.mapInArrow(lambda it: _candidate_batches(it, least, True), "u binary, v binary"))


def _edges(us, vs):
    return pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], names=["u", "v"])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, comp): each node of the undirected edges (u, v) with the least node of its component.

    Labels go along edges, to the node that a node is labelled with too (its root), and then jump to
    their label's label, until none changes. Roots that get their members' labels keep the rounds
    near the logarithm of the longest path; each round's labels are a written table.
    """
    both = edges.where("u <> v").distinct()
    both = stored(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))), f"{name}-edges")
    table = labels = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("comp")), f"{name}-0")
    for i in itertools.count(1):
        near = both.join(labels.select(F.col("node").alias("v"), "comp"), "v").groupBy("u").agg(F.min("comp").alias("m"))
        told = labels.join(near, labels["node"] == near["u"]).select("node", "comp", "m")
        roots = told.where("m < comp").groupBy(F.col("comp").alias("root")).agg(F.min("m").alias("hook"))
        least = told.join(roots, told["node"] == roots["root"], "left").select("node", F.col("comp").alias("was"), F.least("comp", "m", "hook").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        new = stored(least.join(jump, "comp").select("node", "was", F.least("comp", "next").alias("comp")), f"{name}-{i}")
        drop_stored(table)
        table, labels = new, new.select("node", "comp")
        if not new.where("was <> comp").limit(1).count():
            break
    drop_stored(both)
    return labels


def _common(row: np.ndarray, h: np.ndarray, n: int, half: int | None) -> np.ndarray:
    """How many numbers each two rows share; with ``half``, of the first rows with the others. No row has a number twice."""
    order = np.argsort(h)
    row, h = row[order], h[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    size = np.diff(np.append(at, len(h)))
    a, b = (half, n - half) if half else (n, n)
    # rare numbers: pair by pair at a fixed distance; common ones: matrix products, exact in 32-bit floats up to 2**24 columns
    rare = (size > 1) & (size <= 12)
    col = np.repeat(np.arange(len(at)), size)
    spot = np.arange(len(h)) - at[col]
    flat = np.zeros(a * b, np.int64)
    for d in range(1, 12):
        lo = np.flatnonzero(rare[col] & (spot + d < size[col]))
        if not len(lo):
            break
        i, j = np.minimum(row[lo], row[lo + d]), np.maximum(row[lo], row[lo + d])
        if half:
            ok = (i < half) & (j >= half)
            i, j = i[ok], j[ok] - half
        flat += np.bincount(i * b + j, minlength=a * b)
    out = flat.reshape(a, b)
    if not half:
        out = out + out.T
    common = np.flatnonzero(size > 12)
    for c in range(0, len(common), 4096):
        part = common[c : c + 4096]
        number = np.full(len(at), -1)
        number[part] = np.arange(len(part))
        on = number[col] >= 0
        grid = np.zeros((n, len(part)), np.float32)
        grid[row[on], number[col[on]]] = 1
        out += (grid[:half] @ grid[half:].T if half else grid @ grid.T).astype(np.int64)
    return out


def distinct_shingles(texts: list[str], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of the different shingles of texts: numbers are equal for equal shingles only."""
    rows, numbers = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for _, s in slices(pa.array(texts, pa.string()), lower=True, limit=1 << 62):
        rows, h, first = shingle_sets(s, shingle)
        numbers = s.told_apart(first, h, np.minimum(s.n_words[rows], shingle))
    if not len(rows):
        return rows, numbers
    order = np.lexsort((numbers, rows))
    rows, numbers = rows[order], numbers[order]
    fresh = np.concatenate([[True], (numbers[1:] != numbers[:-1]) | (rows[1:] != rows[:-1])])
    return rows[fresh], numbers[fresh]


def is_link(common, left, right, threshold: float):
    """Whether a Jaccard similarity reaches the threshold, in whole numbers."""
    t = Fraction(str(threshold))
    return (common > 0) & (common * (t.numerator + t.denominator) >= t.numerator * (left + right))


def links_of(texts: list[str], copies: np.ndarray, bins: np.ndarray, half: int | None, threshold: float, shingle: int) -> tuple[np.ndarray, list[list[int]]]:
    """Each text's linked rows (copies counted) among the others, and the groups that links connect. Pairs whose
    bins say that they are linked are left out: they are counted by bins."""
    n = len(texts)
    row, number = distinct_shingles(texts, shingle)
    sizes = np.bincount(row, minlength=n)
    both = _common(row, number, n, half)
    left, right = (sizes[:half], sizes[half:]) if half else (sizes, sizes)
    linked = is_link(both, left[:, None], right[None, :], threshold)
    near, far = (bins[:half], bins[half:]) if half else (bins, bins)
    linked &= near[:, None] + far[None, :] + 2 > BINS
    out = np.zeros(n, np.int64)
    if half:
        out[:half] = linked @ copies[half:]
        out[half:] = copies[:half] @ linked
    else:
        np.fill_diagonal(linked, False)
        out[:] = linked @ copies
    groups = []
    seen = np.zeros(n, bool)
    for s in range(n):
        if seen[s]:
            continue
        seen[s] = True
        group, stack = [s], [s]
        while stack:
            i = stack.pop()
            if half:
                hit = np.flatnonzero(linked[i] & ~seen[half:]) + half if i < half else np.flatnonzero(linked[:, i - half] & ~seen[:half])
            else:
                hit = np.flatnonzero(linked[i] & ~seen)
            seen[hit] = True
            group += hit.tolist()
            stack += hit.tolist()
        if len(group) > 1:
            groups.append(group)
    return out, groups


def _own_rows(texts, keys: list[bytes]) -> list[int]:
    """Rows whose text is the one that their key names, one for each key: repeated rows count once, and a
    text that another one's row brought along (a repeated identifier) isn't meant."""
    own = [k for _, s in slices(texts, lower=True) for k in class_keys(s)]
    first: dict[bytes, int] = {}
    for i, (k, o) in enumerate(zip(keys, own)):
        if k == o:
            first.setdefault(k, i)
    return list(first.values())


def _verify_batches(batches, threshold: float, shingle: int):
    """Rows sorted by (comp, bi, bj): block, key, copies, bin, text. Gives (key, links) and (key, other)."""
    for g in sorted_groups(batches, 3):
        blocks, keys = g.column("block").to_numpy(), g.column("key").to_pylist()
        pick = np.array(sorted(_own_rows(g.column("text"), keys), key=lambda i: (blocks[i], i)), np.int64)
        if len(pick) < 2:
            continue
        half = int(np.count_nonzero(blocks[pick] == blocks[pick].min())) if blocks[pick].min() != blocks[pick].max() else None
        if half is None and g.column("bi")[0].as_py() != g.column("bj")[0].as_py():
            continue
        links, groups = links_of(g.column("text").take(pa.array(pick)).to_pylist(), g.column("copies").to_numpy()[pick], g.column("bin").to_numpy()[pick], half, threshold, shingle)
        name = [keys[i] for i in pick]
        edges = _stars(groups, name)
        a = [name[i] for i in np.flatnonzero(links)] + [u for u, _ in edges]
        b = [None] * int(np.count_nonzero(links)) + [v for _, v in edges]
        c = links[links > 0].tolist() + [0] * len(edges)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(c, pa.int64())], names=["key", "other", "links"])


def _pivot_batches(batches, threshold: float, shingle: int):
    """comp, key, copies, words, text, pivot (text of the key ``comp``): in which bin the text's Jaccard distance
    from the pivot lies (BINS and more: no link), and whether it is a link."""
    scale = BINS / (1 - Fraction(str(threshold)))
    for b in batches:
        comps, keys = b.column("comp").to_pylist(), b.column("key").to_pylist()
        pick = sorted(_own_rows(b.column("text"), keys), key=lambda i: comps[i])
        bins, linked = [], []
        for comp, rows in itertools.groupby(pick, key=lambda i: comps[i]):
            rows = list(rows)
            for at in range(0, len(rows), 256):
                part = rows[at : at + 256]
                row, number = distinct_shingles([b.column("pivot")[part[0]].as_py(), *b.column("text").take(pa.array(part)).to_pylist()], shingle)
                sizes = np.bincount(row, minlength=1 + len(part))
                common = np.bincount(row[np.isin(number, number[row == 0])], minlength=1 + len(part))
                link = is_link(common, sizes, sizes[0], threshold)
                bins += [math.floor(Fraction(int(n + sizes[0] - 2 * c), int(n + sizes[0] - c)) * scale) for n, c in zip(sizes[1:], common[1:])]
                linked += [bool(x) and keys[i] != comp for i, x in zip(part, link[1:])]
        at = pa.array(pick, pa.int64())
        yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in ("comp", "key", "copies", "words")], pa.array(bins, pa.int64()), pa.array(linked, pa.bool_())], names=["comp", "key", "copies", "words", "bin", "linked"])


def _pivot_rows(batches):
    """c, k, pivot: the rows whose text is the one that the key names."""
    for b in batches:
        at = pa.array(_own_rows(b.column("pivot"), b.column("k").to_pylist()) if b.num_rows else [], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("c").take(at), b.column("pivot").take(at)], names=["c", "pivot"])


def _blocked(members: DataFrame) -> DataFrame:
    """members: (comp, key, rep, copies, words, bin, inner). Adds block and bi <= bj, a row for each pair of
    blocks that the member's block takes part in; pairs of inner blocks are no task."""
    count = lambda c: F.greatest(F.ceil(F.sum(F.when(c, F.col("words"))) / WORD_BLOCK), F.ceil(F.count(F.when(c, F.lit(1))) / TEXT_BLOCK), F.lit(0)).cast("int")
    sizes = members.groupBy("comp").agg(count(~F.col("inner")).alias("outside"), count(F.col("inner")).alias("inside")).where("outside > 0")
    placed = members.join(sizes, "comp")
    at = F.xxhash64("key")
    block = F.when(F.col("inner"), F.col("outside") + F.pmod(at, F.greatest("inside", F.lit(1)))).otherwise(F.pmod(at, F.col("outside"))).cast("int")
    upto = F.when(F.col("inner"), F.col("outside")).otherwise(F.col("outside") + F.col("inside")) - 1
    placed = placed.withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0), upto)))
    return placed.select("comp", F.least("block", "with").alias("bi"), F.greatest("block", "with").alias("bj"), "block", "key", "rep", "copies", "bin")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, shingle: int = SHINGLE) -> DataFrame:
    """(id, class_id, n_links long, copy_id, n_copies long): a row for each row of ``df``.

    Words are runs without space or \\x09-\\x0D, with A-Z lower-cased. n_links: other rows with a
    Jaccard similarity of at least ``threshold``, those with the same words too. class_id: least
    identifier among all that links connect; copy_id: least among those with the same words. Texts
    of under ``shingle`` words have them as one shingle. Null and empty texts have no shingles
    and no links: copy_id and class_id are their own identifier, n_copies is 1. Null identifiers
    stay null and are no least one unless all are. Rows that share an identifier stay rows of their own.
    """
    bands, rows = bands_for(threshold, recall)
    hashes = bands * rows
    least = math.ceil(hashes * threshold - SLACK * math.sqrt(hashes * threshold * (1 - threshold)))
    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    sketch = stored(source.mapInArrow(lambda it: _sketch_batches(it, bands, rows, shingle), f"id {kind}, key binary, words long, sig binary, bands array<bigint>"), "near-sketch")

    full = sketch.where("words > 0")
    reps = full.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("words").alias("words"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    reps = stored(reps, "near-classes")

    # texts in buckets of at least two, with their signatures. Counts are added up before the shuffle and
    # joined back, which a large bucket's rows can be split for; a window would hold them in one task
    spots = reps.select("key", F.explode("bands").alias("bucket"))
    shared = spots.join(spots.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket")
    shared = stored(shared.join(reps.select("key", "sig"), "key").select("bucket", "n", "key", "sig"), "near-shared")
    small, wide = shared.where(F.col("n") <= BUCKET_BLOCK), shared.where(F.col("n") > BUCKET_BLOCK)
    small = small.select("bucket", "key", "sig").repartition("bucket").sortWithinPartitions("bucket")
    edges = small.mapInArrow(lambda it: _candidate_batches(it, least, False), "u binary, v binary")
    if wide.limit(1).count():
        edges = edges.unionByName(_wide_candidates(wide, least))
    family = components(edges, "near-family").withColumnRenamed("node", "key")
    members = stored(family.join(reps.select("key", "rep", "copies", "words"), "key"), "near-members")
    drop_stored(shared)

    def with_texts(rows: DataFrame) -> DataFrame:
        few = rows.count() <= BROADCAST_IDS
        return source.join(F.broadcast(rows) if few else rows, source["id"].eqNullSafe(rows["rep"])).drop("id", "rep")

    # families of more than a block: exact distances from the text that names the family. By the triangle
    # inequality two texts near enough to it are linked: those links are counted by bins of the distance
    large = members.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("all")).where((F.col("n") > TEXT_BLOCK) | ((F.col("all") > WORD_BLOCK) & (F.col("n") > 2))).select("comp")
    large = stored(large, "near-large")
    plain = members.join(large, "comp", "left_anti").withColumns({"bin": F.lit(BINS).cast("long"), "inner": F.lit(False)})
    counted, spread = None, plain
    if large.limit(1).count():
        heavy = members.join(large, "comp", "left_semi")
        heads = heavy.where("key = comp")
        pivots = with_texts(heads.select("comp", "key", "rep")).select(F.col("comp").alias("c"), F.col("key").alias("k"), F.col("text").alias("pivot"))
        # of rows that share the pivot's identifier only that with its words is meant
        pivots = stored(pivots.mapInArrow(_pivot_rows, "c binary, pivot string").dropDuplicates(["c"]), "near-pivots")
        light = (pivots.agg(F.sum(F.octet_length("pivot"))).first()[0] or 0) <= BROADCAST_BYTES
        texts = with_texts(heavy)
        told = texts.join(F.broadcast(pivots) if light else pivots, texts["comp"] == pivots["c"]).select("comp", "key", "copies", "words", "text", "pivot")
        told = told.mapInArrow(lambda it: _pivot_batches(it, threshold, shingle), "comp binary, key binary, copies long, words long, bin long, linked boolean")
        told = stored(told.groupBy("key").agg(*[F.first(c).alias(c) for c in ("comp", "copies", "words", "bin", "linked")]), "near-told")
        # how many rows lie in each bin of a family, then up to each bin
        totals = told.where(F.col("bin") < BINS).groupBy("comp").agg(*[F.sum(F.when(F.col("bin") == i, F.col("copies")).otherwise(0)).alias(f"b{i}") for i in range(BINS)])
        totals = totals.select("comp", F.array(*[f"b{i}" for i in range(BINS)]).alias("sums"))
        other = F.aggregate(F.slice("sums", 1, F.greatest(BINS - 1 - F.col("bin"), F.lit(0)).cast("int")), F.lit(0).cast("long"), lambda a, x: a + x)
        counted = told.where(F.col("bin") <= BINS - 2).join(totals, "comp").select("key", (other - F.when(2 * F.col("bin") + 2 <= BINS, F.col("copies")).otherwise(0)).alias("links"))
        reach = told.where("linked").select(F.col("comp").alias("u"), F.col("key").alias("v"))
        inner = 2 * F.col("bin") + 2 <= BINS
        spread = plain.unionByName(told.select("key", "comp", "copies", "words", "bin", inner.alias("inner")).join(members.select("key", "rep"), "key").select(plain.columns))
    texts = with_texts(_blocked(spread)).repartition("comp", "bi", "bj").sortWithinPartitions("comp", "bi", "bj")
    texts = texts.select("comp", "bi", "bj", "block", "key", "copies", "bin", "text")
    found = stored(texts.mapInArrow(lambda it: _verify_batches(it, threshold, shingle), "key binary, other binary, links long"), "near-links")
    links = found.where("other is null").select("key", "links")
    stars = found.where("other is not null").select(F.col("key").alias("u"), F.col("other").alias("v"))
    if counted is not None:
        links, stars = links.unionByName(counted), stars.unionByName(reach)
    links = links.groupBy("key").agg(F.sum("links").alias("links"))
    comps = components(stars, "near-class").withColumnRenamed("node", "key")

    named = reps.select("key", "rep", "copies").join(comps, "key", "left").join(links, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    heads = named.groupBy("comp").agg(F.min("rep").alias("class_id"))
    named = named.join(heads, "comp").select("key", "rep", "copies", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = sketch.select("id", F.when(F.col("words") > 0, F.col("key")).alias("key")).join(named, "key", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("rep", "id").alias("copy_id"), F.coalesce("copies", F.lit(1)).alias("n_copies"))
