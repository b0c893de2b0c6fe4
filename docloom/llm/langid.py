"""Language of each word of code-switched text by a linear-chain conditional random field.

A word's features are its prefixes and suffixes of up to three bytes, its
byte trigrams and, as lexicon, the word itself, hashed into `BUCKETS`
weights a label. Transitions between labels are learned. Labels of words are
only known as the language of their document, so that no document would teach a
switch; therefore the training sequences are pieces of up to `PIECE` words, and
some join pieces of two documents. Training maximises the likelihood by
forward-backward on a sample of at most `train_docs` documents, shared out equally
among the languages, so that a rare one is learned at every size (picked by hash;
each document gives pieces from all over its text).

Prediction runs forward-backward over each whole text, many texts at once: a
step handles all texts that are as long, so cost follows the longest text and
the words, and memory the words of a slice. A document's language is the label
with the largest sum of word marginals, its score that label's share.

Defined results: null texts, and texts without a letter, are `und` with score 0;
if there is nothing to learn from every text is `und`; null languages are not
learned; ties go to the first label by name.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, share, text_runs, value_of

BUCKETS, PIECE, KNOWN, UNKNOWN = 1 << 16, 32, 200_000, "und"  # KNOWN: words whose scores a task remembers
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return [w for w in text.lower().encode().translate(_LETTERS).split(b" ") if w]


def features(word: bytes) -> list[int]:
    """Buckets of a word's affixes, trigrams (both in bytes) and itself; the checksum's start keeps the kinds apart."""
    w, of = b"^" + word + b"$", zlib.crc32
    found = [of(word, 1), of(w[:2], 2), of(w[:3], 2), of(w[:4], 2), of(w[-2:], 3), of(w[-3:], 3), of(w[-4:], 3)]
    found += [of(w[k : k + 3], 4) for k in range(len(w) - 2)]
    return [x % BUCKETS for x in found]


class _Numbers(dict):
    """Numbers of words in the order first seen; `new` holds those not scored yet."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []
        self.scores: np.ndarray | None = None

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        number = self[word] = len(self)
        return number


@dataclass
class Tagger:
    labels: list[str]
    weights: np.ndarray  # BUCKETS, labels
    transitions: np.ndarray  # labels, labels: log scores

    def emissions(self, words: list[bytes], known: _Numbers) -> np.ndarray:
        """Scores of the labels for each word; a word's features are looked up once as long as `known` remembers it."""
        if len(known) > KNOWN:
            known.clear()
            known.scores = None
        numbers = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
        if known.new:
            found = [features(w) for w in known.new]
            starts = np.concatenate([[0], np.cumsum([len(x) for x in found])[:-1]])
            scores = np.add.reduceat(self.weights[np.concatenate(found)], starts, axis=0)
            known.scores = scores if known.scores is None else np.concatenate([known.scores, scores])
            known.new.clear()
        return known.scores[numbers]

    def marginals(self, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Forward-backward over sequences that follow each other in `emissions`, each of `lengths` words (1 at least): word marginals."""
        order = np.argsort(-lengths, kind="stable")
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order]
        lengths = lengths[order]
        # at step t the first alive[t] sequences of the order have a word
        alive = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left")
        local = np.exp(emissions - emissions.max(axis=1, keepdims=True))
        move = np.exp(self.transitions - self.transitions.max())
        forward = np.empty_like(local)
        state = local[first] / local[first].sum(axis=1, keepdims=True)
        forward[first] = state
        for t in range(1, len(alive)):
            at = first[: alive[t]] + t
            state = (state[: alive[t]] @ move) * local[at]
            state /= state.sum(axis=1, keepdims=True)
            forward[at] = state
        out = forward
        n = len(self.labels)
        back = np.ones((len(first), n), dtype=local.dtype)
        for t in range(len(alive) - 2, -1, -1):
            # sequences that end at t keep their ones
            m = alive[t + 1]
            at = first[:m] + t
            back[:m] = (back[:m] * local[at + 1]) @ move.T
            back[:m] /= back[:m].sum(axis=1, keepdims=True)
            mixed = out[at] * back[:m]
            out[at] = mixed / mixed.sum(axis=1, keepdims=True)
        return out


def _pairwise(tagger: Tagger, local: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (B, T, K) and expected transitions (K, K) of padded training sequences."""
    b, t, k = local.shape
    move = np.exp(tagger.transitions)
    forward, back = np.empty_like(local), np.ones_like(local)
    forward[:, 0] = local[:, 0] / local[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, t):
        x = (forward[:, i - 1] @ move) * local[:, i]
        x = np.where(mask[:, i, None], x, forward[:, i - 1])
        forward[:, i] = x / x.sum(axis=1, keepdims=True)
    for i in range(t - 2, -1, -1):
        x = (back[:, i + 1] * local[:, i + 1]) @ move.T
        x = np.where(mask[:, i + 1, None], x, 1.0)
        back[:, i] = x / x.sum(axis=1, keepdims=True)
    node = forward * back
    node /= node.sum(axis=2, keepdims=True)
    expected = np.zeros((k, k))
    for i in range(1, t):
        pair = forward[:, i - 1, :, None] * move[None] * (local[:, i] * back[:, i])[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        expected += pair[mask[:, i]].sum(axis=0)
    return node, expected


def train(pieces: list[tuple[str, list[bytes]]], epochs: int = 6, rate: float = 0.3, decay: float = 1e-4, seed: int = 7) -> Tagger:
    """A tagger from (language, words) pieces: mini-batch gradient of the conditional likelihood, with adaptive steps."""
    labels = sorted({lang for lang, _ in pieces})
    number, rng, k = {x: i for i, x in enumerate(labels)}, np.random.default_rng(seed), len(labels)
    tagger = Tagger(labels, np.zeros((BUCKETS, k), dtype=np.float64), np.zeros((k, k)))
    vocabulary: dict[bytes, int] = {}
    encoded = [(number[lang], [vocabulary.setdefault(w, len(vocabulary)) for w in words]) for lang, words in pieces if words]
    # every label weighs alike, whatever its share of the sample
    by_label = [[w for y, w in encoded if y == i] for i in range(k)]
    each = max(len(x) for x in by_label)
    balanced = [(i, x[j % len(x)]) for i, x in enumerate(by_label) for j in range(min(each, 3 * len(x)))]
    hashed = [np.array(features(w)) for w in vocabulary]
    flat, starts = np.concatenate(hashed), np.concatenate([[0], np.cumsum([len(x) for x in hashed])])
    square, square_t = np.full((BUCKETS, k), 1e-2), np.full((k, k), 1.0)
    for _ in range(epochs):
        order = rng.permutation(len(balanced))
        sequences = []
        at = 0
        while at < len(order):
            y, words = balanced[order[at]]
            ids, tags = list(words), [y] * len(words)
            at += 1
            if at < len(order) and rng.random() < 0.3:  # a switch of language
                y, words = balanced[order[at]]
                ids, tags = ids + list(words), tags + [y] * len(words)
                at += 1
            sequences.append((ids, tags))
        for low in range(0, len(sequences), 64):
            batch = sequences[low : low + 64]
            t = max(len(ids) for ids, _ in batch)
            ids, tags = np.zeros((len(batch), t), dtype=np.int64), np.zeros((len(batch), t), dtype=np.int64)
            mask = np.zeros((len(batch), t), dtype=bool)
            for i, (x, y) in enumerate(batch):
                ids[i, : len(x)], tags[i, : len(x)], mask[i, : len(x)] = x, y, True
            used, inverse = np.unique(ids[mask], return_inverse=True)
            sizes = starts[used + 1] - starts[used]
            places = np.concatenate([flat[starts[u] : starts[u + 1]] for u in used])
            owner = np.repeat(np.arange(len(used)), sizes)
            scores = np.zeros((len(used), k))
            np.add.at(scores, owner, tagger.weights[places])
            local = np.ones((len(batch), t, k))
            local[mask] = np.exp(scores - scores.max(axis=1, keepdims=True))[inverse]
            node, expected = _pairwise(tagger, local, mask)
            delta = -node
            delta[np.arange(len(batch))[:, None], np.arange(t), tags] += 1
            by_word = np.zeros((len(used), k))
            np.add.at(by_word, inverse, delta[mask])
            touched, slot = np.unique(places, return_inverse=True)
            gradient = np.zeros((len(touched), k))
            np.add.at(gradient, slot, by_word[owner])
            gradient = gradient / len(batch) - decay * tagger.weights[touched]
            square[touched] += gradient**2
            tagger.weights[touched] += rate * gradient / np.sqrt(square[touched])
            observed = np.zeros((k, k))
            both = mask[:, 1:]
            np.add.at(observed, (tags[:, :-1][both], tags[:, 1:][both]), 1)
            step = (observed - expected) / len(batch) - decay * tagger.transitions
            square_t += step**2
            tagger.transitions = tagger.transitions + rate * step / np.sqrt(square_t)
    tagger.weights = tagger.weights.astype(np.float32)
    tagger.transitions = tagger.transitions.astype(np.float32)
    return tagger


def _pieces(per_doc: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Up to per_doc pieces of each text, spread evenly over all of it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                last = max(0, len(words) - PIECE)
                for start in sorted({round(last * j / max(1, per_doc - 1)) for j in range(per_doc)}):
                    if words[start : start + PIECE]:
                        out.append((lang, b" ".join(words[start : start + PIECE])))
            columns = list(zip(*out, strict=True)) or [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary())], ["lang", "words"])

    return rows


def fit(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = 3000, per_doc: int = 3) -> Tagger | None:
    """A tagger from at most `train_docs` documents with a language where `learn` (over doc_id) holds, at least one of each language; None if there are none."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null")
    if learn is not None:
        rows = rows.where(learn)
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    each = max(1, train_docs // len(sizes))
    # about 2 * each hashes of a language lie below its cut; of these the smallest are taken, rows that repeat once
    cuts = {lang: 2**63 - 1 if n <= 4 * each else -(2**63) + int(2**64 * (2 * each + 100) / n) for lang, n in sizes.items()}
    order = F.xxhash64("doc_id", "text")
    below = F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair])
    sample = rows.where(order <= F.try_element_at(below, F.col("lang"))).groupBy("lang", order.alias("order")).agg(F.min("text").alias("text"))
    sample = sample.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("order"))).where(F.col("place") <= each)
    pieces = sorted((r["lang"], bytes(r["words"])) for r in sample.select("lang", "text").mapInArrow(_pieces(per_doc), "lang string, words binary").collect())
    return train([(lang, words.split(b" ")) for lang, words in pieces]) if pieces else None


def _predict(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger, known = value_of(shared), _Numbers()
        for whole in batches:
            for batch in text_runs(whole, most_bytes=8_000_000):
                texts = batch.column("text").to_pylist()
                per_doc = [words_of(t) if any(map(str.isalpha, t)) else [] for t in texts] if tagger else [[] for _ in texts]
                lengths = np.array([len(w) for w in per_doc], dtype=np.int64)
                langs, scores, shares = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
                if lengths.sum():
                    full = np.flatnonzero(lengths)
                    found = tagger.marginals(tagger.emissions([w for words in per_doc for w in words], known), lengths[full])
                    sums = np.add.reduceat(found.astype(np.float64), np.concatenate([[0], np.cumsum(lengths[full])[:-1]]), axis=0) / lengths[full][:, None]
                    best = sums.argmax(axis=1)
                    for row, k, x in zip(full.tolist(), best.tolist(), sums, strict=True):
                        langs[row], scores[row], shares[row] = tagger.labels[k], float(min(1.0, x[k])), x.tolist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.list_(pa.float64()))], ["doc_id", "lang_pred", "score", "shares"]
                )

    return rows


def predict(docs: DataFrame, tagger: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and shares (of each label of the tagger, in order) of every row of docs."""
    bound_batches(docs.sparkSession)
    shared = share(docs.sparkSession, tagger)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return docs.mapInArrow(_predict(shared), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, shares array<double>")


def tag_words(text: str, tagger: Tagger) -> list[tuple[str, str, float]]:
    """(word, language, marginal) of each word of one text."""
    words = words_of(text)
    if not words:
        return []
    found = tagger.marginals(tagger.emissions(words, _Numbers()), np.array([len(words)]))
    return [(w.decode(errors="replace"), tagger.labels[int(x.argmax())], float(x.max())) for w, x in zip(words, found, strict=True)]
