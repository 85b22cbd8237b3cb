"""A hidden Markov language model.

Latent states emit word classes: the most frequent words have a class each, all others
share classes by their last letters. P(word | state) is P(class | state) from Baum-Welch times
P(word | class) from corpus counts. Training runs over all whole training texts, in parallel; the
expected counts of all partitions are summed by class, round after round until the likelihood
gains little. The score of a text is the exact log10 likelihood of its whole token sequence by the
scaled forward recursion.

Word counts cover the whole corpus. Words of a bounded number, the most frequent, are broadcast
with their counts; each other word's count comes from a join, so none is left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Slice, slices, stored

#: States, rounds at most, and the gain of a round (log10 a token) below which training ends.
STATES, ROUNDS, GAIN = 6, 20, 0.01
#: Tokens whose recursions go on together, and of a block of a text that is longer: what a task holds at once.
TOGETHER = 250_000
OWN_CLASSES, TAIL_CLASSES = 4096, 1024
#: Words in the broadcast, at most; about 60 bytes each in a worker.
BROADCAST_WORDS = 150_000


def tail_class(word: bytes, tails: int = TAIL_CLASSES) -> int:
    return zlib.crc32(word[-4:]) % tails


def distinct_words(s: Slice) -> tuple[list[bytes], np.ndarray]:
    """The different words of a Slice, and which of them each word is."""
    codes = s.told_apart(np.arange(len(s.starts)), s.word_hash(), 1)
    _, at, which = np.unique(codes, return_index=True, return_inverse=True)
    raw = s.data.tobytes()
    return [raw[a:b] for a, b in zip(s.starts[at].tolist(), s.ends[at].tolist())], which


def word_counts(df: DataFrame, text_col: str) -> DataFrame:
    """(word binary, c long) over all rows; words have A-Z lower-cased. Each task adds up its own words first."""

    def run(batches):
        bag: dict[bytes, int] = {}
        for b in batches:
            for _, s in slices(b.column(0), lower=True):
                names, which = distinct_words(s)
                for w, n in zip(names, np.bincount(which, minlength=len(names)).tolist()):
                    bag[w] = bag.get(w, 0) + n
                if len(bag) > 400_000:
                    yield _bag(bag)
                    bag = {}
        yield _bag(bag)

    return df.select(text_col).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _bag(bag: dict[bytes, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bag.keys(), pa.binary()), pa.array(bag.values(), pa.int64())], names=["word", "c"])


class Model:
    """Class probabilities of the states. Class 0 is the end of a text."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, mass: np.ndarray, states: int) -> Model:
        """States differ by a fixed pseudo-random share of each class and tend to stay."""
        rng = np.random.default_rng(20260101)
        emit = (mass + 1e-3 * max(mass.sum(), 1.0) / len(mass)) * (0.3 + rng.random((states, len(mass))))
        return cls(np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), emit / emit.sum(1, keepdims=True))

    def learn(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, mass: np.ndarray) -> Model:
        """The model of expected counts, a little smoothed towards the classes' overall shares."""
        prior = (mass + 0.1) / (mass + 0.1).sum()
        smooth = lambda x, p, a: (x + a * p) / (x.sum(-1, keepdims=True) + a)
        k = len(start)
        return Model(smooth(start, np.full(k, 1 / k), 1.0), smooth(move, np.full((k, k), 1 / k), 1.0), smooth(emit, prior[None, :], 20.0))

    def expect(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts (start, move, emit) of whole sequences, and their log10 likelihood.

        All go forward and back together, the longest alone at the end. Their tokens lie in the order of their
        places, those of one place beside each other, longest sequence first."""
        k = len(self.start)
        lengths = np.array([len(s) for s in sequences])
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        if not len(order):
            return np.zeros(k), np.zeros((k, k)), np.zeros_like(self.emit), 0.0
        sizes = lengths[order]
        live = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")
        pos = np.concatenate([[0], np.cumsum(live)])
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ids = np.empty(len(place), np.int64)
        ids[pos[place] + np.repeat(np.arange(len(sizes)), sizes)] = np.concatenate([sequences[i] for i in order])
        emitted = np.ascontiguousarray(self.emit.T)[ids]
        alpha, scale = self._forward(self.start, emitted, live, pos)
        beta = np.ones((len(sizes), k))
        start, move, _ = self._backward(alpha, scale, emitted, beta, live, pos)
        emit = np.stack([np.bincount(ids, weights=alpha[:, j], minlength=self.emit.shape[1]) for j in range(k)])
        return start, move * self.move, emit, float(np.log10(scale).sum())

    def _forward(self, first: np.ndarray, emitted: np.ndarray, live: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward vectors, and the scales; ``first`` is what the first place's states have before they emit."""
        alpha, scale = np.empty_like(emitted), np.empty(len(emitted))
        for t, n in enumerate(live.tolist()):
            a, b = pos[t], pos[t] + n
            now = alpha[a:b]
            np.multiply(first if t == 0 else alpha[pos[t - 1] : pos[t - 1] + n] @ self.move, emitted[a:b], out=now)
            total = now.sum(1)
            now /= total[:, None]
            scale[a:b] = total
        return alpha, scale

    def _backward(self, alpha: np.ndarray, scale: np.ndarray, emitted: np.ndarray, beta: np.ndarray, live: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected states of the first place, of pairs of neighbours (without the move probability), and what a place
        before the first one pairs with. ``alpha`` becomes the expected states of all places, ``beta`` what a place before the first sees."""
        move = np.zeros_like(self.move)
        back_move = np.ascontiguousarray(self.move.T)
        for t in range(len(live) - 1, -1, -1):
            n = int(live[t])
            a, b = pos[t], pos[t] + n
            own = beta[:n]
            back = emitted[a:b] * own
            back /= scale[a:b, None]
            alpha[a:b] *= own
            if t:
                move += alpha[pos[t - 1] : pos[t - 1] + n].T @ back
            beta[:n] = back @ back_move
        return alpha[: live[0]].sum(0), move, back

    def expect_long(self, sequence: np.ndarray, block: int = TOGETHER) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """``expect`` of one sequence with a block of it in memory: forward once for the state that each block
        begins in, then block by block from the end."""
        by_class = np.ascontiguousarray(self.emit.T)
        cuts = list(range(0, len(sequence), block))
        begins, now = [], self.start
        for at in cuts:
            begins.append(now)
            part = sequence[at : at + block]
            ones, pos = np.ones(len(part), np.int64), np.arange(len(part) + 1)
            now = self._forward(now, by_class[part], ones, pos)[0][-1] @ self.move
        beta, total, behind = np.ones((1, len(self.start))), 0.0, None
        move, emit = np.zeros_like(self.move), np.zeros_like(self.emit)
        for at, begin in reversed(list(zip(cuts, begins))):
            part = sequence[at : at + block]
            ones, pos = np.ones(len(part), np.int64), np.arange(len(part) + 1)
            emitted = by_class[part]
            alpha, scale = self._forward(begin, emitted, ones, pos)
            if behind is not None:  # the pair over the cut
                move += alpha[-1:].T @ behind
            start, inside, behind = self._backward(alpha, scale, emitted, beta, ones, pos)
            move += inside
            total += float(np.log10(scale).sum())
            emit += np.stack([np.bincount(part, weights=alpha[:, j], minlength=self.emit.shape[1]) for j in range(len(self.start))])
        return start, move * self.move, emit, total

    def log10_likelihood(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Of each whole sequence; all go forward together, the longest alone at the end."""
        lengths = np.array([len(s) for s in sequences])
        out = np.zeros(len(sequences))
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        if not len(order):
            return out
        sizes = lengths[order]
        flat = np.concatenate([sequences[i] for i in order])
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        by_class = np.ascontiguousarray(self.emit.T)
        live = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")
        state = np.tile(self.start, (len(order), 1))
        logs = np.zeros(len(order))
        for t, n in enumerate(live):
            state = state[:n] if t == 0 else state[:n] @ self.move
            state = state * by_class[flat[at[:n] + t]]
            total = state.sum(1)
            logs[:n] += np.log10(total)
            state /= total[:, None]
        out[order] = logs
        return out


def _groups(lengths: np.ndarray, most: int = TOGETHER):
    """Rows in groups of at most ``most`` tokens, longest first, so that a group's sequences are about equally long; a longer one is alone."""
    order = np.argsort(-lengths, kind="stable")
    group, held = [], 0
    for i in order.tolist():
        if group and held + lengths[i] > most:
            yield group
            group, held = [], 0
        group.append(i)
        held += lengths[i]
    if group:
        yield group


def score_texts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS, broadcast_words: int = BROADCAST_WORDS, own_classes: int = OWN_CLASSES, tails: int = TAIL_CLASSES, gain: float = GAIN
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``df``.

    Rows whose crc32 of the identifier's text leaves a remainder by 10 train the model; the
    others are held out (a null identifier counts as the empty text, and is held out). Null and
    empty texts are one end token; a text of any length is one sequence. base_score is the smoothed unigram
    log10 probability; score is the model's. Rows that share an identifier keep a row each; other columns
    are left out. Training ends after ``rounds``, or once a round gains less than ``gain`` (log10 a token). Without a training text
    all words are unknown, and the model is uniform.
    """
    if not 0 <= own_classes + tails < 65_535:
        raise ValueError("classes have numbers of 16 bits")
    sc = df.sparkSession.sparkContext
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0
    rows = df.select(F.col(id_col).alias("__id"), held.alias("__held"), F.col(text_col).alias("__text"))
    counts = stored(word_counts(rows.where(~F.col("__held")), "__text"), "lm-counts")
    ends = rows.where(~F.col("__held")).count()
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    total, distinct = total + ends, distinct + (ends > 0)
    spread = total + 0.1 * (distinct + 1)

    # the broadcast: all words from a count on, chosen so that they are few enough
    step = F.floor(F.log2("c") * 16)
    sizes = sorted(((r[0], r[1]) for r in counts.groupBy(step.alias("s")).count().collect()), reverse=True)
    least, have = None, 0
    for s, n in sizes:
        if have + n > broadcast_words:
            break
        least, have = s, have + n
    top = counts.where(step >= least).toArrow() if least is not None else None
    names = top.column("word").to_pylist() if top else []
    freq = np.array(top.column("c").to_pylist() if top else [], np.int64)
    order = sorted(range(len(names)), key=lambda i: (-freq[i], names[i]))
    own = order[:own_classes]
    classes = 1 + len(own) + tails
    shift = 1 + len(own)
    class_of = {names[i]: 1 + r for r, i in enumerate(own)}

    shared = counts.mapInArrow(_tails_of(sc.broadcast(class_of), shift, tails), "k int, c long, n long").groupBy("k").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect()
    mass, kinds = np.zeros(classes), np.zeros(classes)
    mass[0] = ends
    for r, i in enumerate(own):
        mass[1 + r] = freq[i]
    for r in shared:
        mass[r["k"]], kinds[r["k"]] = r["c"], r["n"]
    # log10 of what a word's c + 0.1 is divided by within its class; a class of one word gives it all
    within = np.log10(mass + 0.1 * (kinds + 1))
    within[: 1 + len(own)] = np.log10(mass[: 1 + len(own)] + 0.1)

    lexicon = {w: (class_of.get(w) or shift + tail_class(w, tails), float(np.log10(n + 0.1))) for w, n in zip(names, freq)}
    coded = stored(_encode(rows, sc.broadcast(lexicon), shift, tails, within, float(np.log10(ends + 0.1)), ends > 0), "lm-coded")

    model = Model.first(mass, states)
    reached = -np.inf
    for _ in range(rounds if ends else 0):
        sums = _expect(coded.where(~F.col("__held")).select("__ids"), sc.broadcast(model), states)
        emit, move, start, likelihood = np.zeros((states, classes)), np.zeros((states, states)), np.zeros(states), 0.0
        for r in sums.collect():
            v = np.array(r[1:])
            if r["k"] >= 0:
                emit[:, r["k"]] = v
            elif r["k"] == -1:
                start = v
            elif r["k"] == -2:
                likelihood = v[0] / total
            else:
                move[-3 - r["k"]] = v
        if likelihood - reached < gain:  # of the model before; a round more would change little
            break
        reached = likelihood
        model = model.learn(start, move, emit, mass)

    # words outside the broadcast: their counts come by a join
    rare = coded.select("__row", F.explode("__rare").alias("w")).select("__row", F.col("w.word").alias("word"), F.col("w.n").alias("n"))
    rare = rare.join(counts, "word", "left").groupBy("__row").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("__rq"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("__rk"))
    scored = _forward(coded.drop("__rare"), sc.broadcast(model)).join(rare, "__row", "left")
    q = F.col("__q") + F.coalesce("__rq", F.lit(0.0))
    return scored.select(
        F.col("__id").alias(id_col),
        F.col("__held").alias("held_out"),
        "n_tokens",
        (F.col("__known") + F.coalesce("__rk", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (q - F.col("n_tokens") * F.lit(float(np.log10(spread)))).alias("base_score"),
        (q + F.col("__path") - F.col("__within")).alias("score"),
    )


def _tails_of(class_of, shift: int, tails: int):
    def run(batches):
        own = class_of.value
        c, n = np.zeros(tails, np.int64), np.zeros(tails, np.int64)
        for b in batches:
            names, freq = b.column(0).to_pylist(), b.column(1).to_numpy()
            at = np.array([-1 if w in own else tail_class(w, tails) for w in names], np.int64)
            at, freq = at[at >= 0], freq[at >= 0]
            np.add.at(c, at, freq)
            n += np.bincount(at, minlength=tails)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(tails, dtype=np.int32) + np.int32(shift)), pa.array(c), pa.array(n)], names=["k", "c", "n"])

    return run


def _encode(rows: DataFrame, lexicon, shift: int, tails: int, within: np.ndarray, end: float, end_known: bool) -> DataFrame:
    """Class ids of all tokens, the sums that the lexicon gives, and the other words with their numbers.

    Each different word of a slice is looked up once."""
    schema = "__row long, __id {}, __held boolean, n_tokens long, __known long, __q double, __within double, __ids binary, __rare array<struct<word: binary, n: long>>".format(rows.schema["__id"].dataType.simpleString())
    names = [x.split()[0] for x in ("__row", "__id", "__held", "n_tokens", "__known", "__q", "__within", "__ids", "__rare")]

    def coded(s: Slice, lex: dict) -> list[pa.Array]:
        words, which = distinct_words(s)
        found = [lex.get(w) for w in words]
        known = np.array([f is not None for f in found], bool)
        kind = np.array([f[0] if f else shift + tail_class(w, tails) for f, w in zip(found, words)], np.uint16)
        value = np.array([f[1] if f else 0.0 for f in found])
        ids = kind[which]
        per = lambda x: np.bincount(s.doc, weights=x, minlength=s.rows)
        ends = np.cumsum(s.n_words)
        flat = np.insert(ids, ends, 0).astype("<u2")  # an end after each text
        offsets = (np.concatenate([[0], ends + np.arange(1, s.rows + 1)]) * 2).astype(np.int64)
        blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), s.rows, [None, pa.py_buffer(offsets), pa.py_buffer(flat.tobytes())]).cast(pa.binary())
        # other words: (text, word) pairs with their numbers, texts in order
        other = np.flatnonzero(~known[which])
        pairs, n = np.unique(s.doc[other] * max(len(words), 1) + which[other], return_counts=True)
        doc, word = np.divmod(pairs, max(len(words), 1))
        rare = pa.StructArray.from_arrays([pa.array(words, pa.binary()).take(pa.array(word)), pa.array(n.astype(np.int64))], names=["word", "n"])
        rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(s.rows + 1)).astype(np.int32)), rare)
        tokens = s.n_words + 1
        own = per(known[which].astype(float)).astype(np.int64) + int(end_known)
        return [pa.array(tokens.astype(np.int64)), pa.array(own), pa.array(per(value[which]) + end), pa.array(per(within[ids]) + within[0]), blobs, rare]

    def run(batches):
        lex = lexicon.value
        for b in batches:
            for first, s in slices(b.column(3), lower=True, limit=1 << 20):
                yield pa.RecordBatch.from_arrays([*b.slice(first, s.rows).columns[:3], *coded(s, lex)], names=names)

    return rows.select(F.monotonically_increasing_id().alias("__row"), "__id", "__held", "__text").mapInArrow(run, schema)


def _expect(coded: DataFrame, model, states: int) -> DataFrame:
    """Expected counts summed over all partitions: a row for each class (k >= 0), the start (-1), the likelihood (-2) and each state's moves."""
    names = [f"v{j}" for j in range(states)]

    def run(batches):
        m = model.value
        start, move, emit, total = np.zeros(states), np.zeros((states, states)), np.zeros_like(m.emit), 0.0
        for b in batches:
            texts = b.column(0)
            for group in _groups(np.array([len(x) // 2 for x in texts.to_pylist()])):
                seqs = [np.frombuffer(texts[i].as_py(), "<u2") for i in group]
                got = m.expect_long(seqs[0]) if len(seqs) == 1 and len(seqs[0]) > TOGETHER else m.expect(seqs)
                start += got[0]
                move += got[1]
                emit += got[2]
                total += got[3]
        k = np.flatnonzero(emit.sum(0))
        at = np.concatenate([k, [-1, -2], -3 - np.arange(states)]).astype(np.int32)
        v = np.concatenate([emit[:, k].T, start[None, :], np.full((1, states), total), move])
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(np.ascontiguousarray(v[:, j])) for j in range(states)]], names=["k", *names])

    rows = coded.mapInArrow(run, "k int, " + ", ".join(f"{n} double" for n in names))
    return rows.groupBy("k").agg(*[F.sum(n).alias(n) for n in names])


def _forward(coded: DataFrame, model) -> DataFrame:
    schema = coded.drop("__ids").withColumn("__path", F.lit(0.0)).schema
    at = coded.columns.index("__ids")

    def run(batches):
        m = model.value
        for b in batches:
            seqs = [np.frombuffer(x, "<u2") for x in b.column(at).to_pylist()]
            path = np.zeros(len(seqs))
            for group in _groups(np.array([len(x) for x in seqs])):
                path[group] = m.log10_likelihood([seqs[i] for i in group])
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(b.columns) if i != at], pa.array(path)], names=[*[n for n in b.schema.names if n != "__ids"], "__path"])

    return coded.mapInArrow(run, schema)
