"""Token counts under a unigram vocabulary, by dynamic programming shared in a trie.

A pre-token is a word with the vocabulary's space mark before it. Its best split into
pieces (largest sum of log probabilities) is a forward recursion whose value at a character
depends on the prefix only. The distinct pre-tokens of a slice go into a trie, level by level: each node gets the
forward score and number of tokens of its prefix, once however many words begin with it, and all nodes
of a level at the same time. A word's node holds its count, which is kept for later slices.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import slices
from .lm import distinct_words

MARK = "▁"
#: Words whose counts a worker keeps before it starts anew: a bound on memory, results don't change.
MOST_WORDS = 500_000
#: Bytes of text whose distinct words make one trie; words of more characters are scored one by one.
SLICE, LONG = 1 << 22, 128
#: Log probability of one byte of a character that no piece has.
BYTE_SCORE = -20.0
_LOADED: dict = {}
_MULT = np.uint64(0x9E3779B97F4A7C15)


def pieces(name: str = "piece_bpe_32k.model") -> dict[str, float]:
    """Log probability of each ordinary piece of a public SentencePiece file: Zipf's law over its ranks."""
    if name not in _LOADED:
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        total = math.log(sum(1 / r for r in range(1, len(names) + 1)))
        _LOADED[name] = {p: -math.log(r) - total for r, p in reversed(list(enumerate(names, 1)))}
    return _LOADED[name]


class Pieces:
    """The pieces from their last letter on, as a trie: going back from a place in a word, it ends the search where no
    piece goes on. Edges are dictionary entries, and slots of a hash table for many lookups at a time."""

    def __init__(self, scores: dict[str, float]):
        self.edges: dict[int, int] = {}
        values: list[float] = [-math.inf]
        for piece, score in scores.items():
            node = 0
            for ch in reversed(piece):
                edge = (node << 21) | ord(ch)
                if edge not in self.edges:
                    self.edges[edge] = len(values)
                    values.append(-math.inf)
                node = self.edges[edge]
            values[node] = score
        self.values = np.array(values)
        self.bits = max(4, (4 * len(self.edges)).bit_length())
        self.keys, self.nodes = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        at = self._slot(np.array(list(self.edges), np.int64)) if self.edges else []
        for i, (edge, node) in zip(np.asarray(at).tolist(), self.edges.items()):
            while self.keys[i] >= 0:
                i = (i + 1) & (len(self.keys) - 1)
            self.keys[i], self.nodes[i] = edge, node

    def _slot(self, edges: np.ndarray) -> np.ndarray:
        return ((edges.astype(np.uint64) * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def follow(self, node: np.ndarray, ch: np.ndarray) -> np.ndarray:
        """The nodes that edges lead to, 0 where there is none."""
        edge = (node << 21) | ch
        at = self._slot(edge)
        out = np.zeros(len(edge), np.int64)
        left = np.arange(len(edge))
        while len(left):
            there = self.keys[at[left]]
            hit = there == edge[left]
            out[left[hit]] = self.nodes[at[left[hit]]]
            left = left[~hit & (there >= 0)]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
        return out

    def one(self, word: str) -> int:
        """The number of tokens of the best split of one word; of equal scores the one with the longest last piece."""
        best, count, values = [0.0], [0], self.values
        for i, ch in enumerate(word, 1):
            n_bytes = len(ch.encode("utf-8", "replace"))
            top, n, at = best[-1] + BYTE_SCORE * n_bytes, count[-1] + n_bytes, 0
            for j in range(i - 1, -1, -1):
                at = self.edges.get((at << 21) | ord(word[j]))
                if at is None:
                    break
                if (s := best[j] + values[at]) >= top:
                    top, n = s, count[j] + 1
            best.append(top)
            count.append(n)
        return count[-1]

    def many(self, words: list[str]) -> np.ndarray:
        """``one`` of many words, all prefixes scored once: the trie's levels one after another."""
        if not words:
            return np.zeros(0, np.int64)
        sizes = np.array([len(w) for w in words])
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        letters = np.frombuffer("".join(words[i] for i in order).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        live = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")
        spot = np.zeros(len(words), np.int64)  # each word's node
        parent, letter, best, count = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1), np.zeros(1, np.int64)
        for i, n in enumerate(live.tolist()):
            new, which = np.unique((spot[:n] << 21) | letters[begin[:n] + i], return_inverse=True)
            up, ch = new >> 21, new & 0x1FFFFF
            n_bytes = 1 + (ch >= 0x80) + (ch >= 0x800) * 1 + (ch >= 0x10000)
            top, tokens = best[up] + BYTE_SCORE * n_bytes, count[up] + n_bytes
            # back from the new letter: ``at`` in the trie of pieces, ``node`` before the letters gone over
            on, at, now, node = np.arange(len(new)), np.zeros(len(new), np.int64), ch, up
            while len(on):
                at = self.follow(at, now)
                alive = at > 0
                on, at, node = on[alive], at[alive], node[alive]
                score = best[node] + self.values[at]
                better = score >= top[on]
                top[on[better]], tokens[on[better]] = score[better], count[node[better]] + 1
                more = node > 0
                on, at, now, node = on[more], at[more], letter[node[more]], parent[node[more]]
            spot[:n] = len(best) + which
            parent, letter, best, count = (np.concatenate(x) for x in ((parent, up), (letter, ch), (best, top), (count, tokens)))
        out = np.empty(len(words), np.int64)
        out[order] = count[spot]
        return out


class Counts:
    """Numbers of tokens of words, with those of earlier words kept (the trie's terminals)."""

    def __init__(self, scores: dict[str, float], most: int = MOST_WORDS):
        self.pieces, self.most = Pieces(scores), most
        self.terminal: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.terminal) > self.most:
            self.terminal.clear()
        fresh = [w for w in words if w not in self.terminal]
        short = [w for w in fresh if len(w) <= LONG]
        self.terminal.update(zip(short, self.pieces.many([MARK + w.decode() for w in short]).tolist()))
        self.terminal.update((w, self.pieces.one(MARK + w.decode())) for w in fresh if len(w) > LONG)
        return np.array([self.terminal[w] for w in words], np.int64)


def token_counts(df: DataFrame, text_col: str = "text", vocabulary: str = "piece_bpe_32k.model", carry: list[str] | None = None) -> DataFrame:
    """The columns of ``df`` (or those in ``carry``), n_words, n_distinct and n_tokens (long).

    One row for each row; null and empty texts have zeros; a text of any length is counted whole. No shuffle: each task has
    tries of bounded size over its own rows' pre-tokens. Columns named like an added one are replaced.
    """
    added = ["n_words", "n_distinct", "n_tokens"]
    carry = [c for c in (df.columns if carry is None else carry) if c not in added]

    def run(batches):
        counts = Counts(pieces(vocabulary))
        for b in batches:
            for first, s in slices(b.column(0), limit=SLICE):
                words, which = distinct_words(s)
                tokens = counts.of(words)[which]
                pairs = np.unique(s.doc * max(len(words), 1) + which) // max(len(words), 1)
                cols = [s.n_words, np.bincount(pairs, minlength=s.rows), np.bincount(s.doc, weights=tokens, minlength=s.rows).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([*b.slice(first, s.rows).columns[1:], *[pa.array(c.astype(np.int64)) for c in cols]], names=[*carry, *added])

    fields = StructType.fromDDL(", ".join(f"{c} long" for c in added)).fields
    return df.select(F.col(text_col).alias("__text"), *carry).mapInArrow(run, StructType([*[df.schema[c] for c in carry], *fields]))


def counts_by(df: DataFrame, key: str, **kwargs) -> DataFrame:
    """Rows, words and tokens for each value of a column, such as the source."""
    per = token_counts(df, carry=[key], **kwargs)
    return per.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_words").alias("n_words"), F.sum("n_tokens").alias("n_tokens"))
