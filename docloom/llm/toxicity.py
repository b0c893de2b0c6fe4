"""Toxic passages by maximal-scoring segments of token log-odds.

Learning. Of the labelled rows a sample of at most `train_docs` documents (by
hash) is counted: in how many toxic and clean documents each word and word stem
(its first 4 to 7 bytes) occurs. With Dirichlet priors that back off from the
word to ever shorter stems to the overall share of toxic documents, each token
gets its log-odds. Each half of the sample is scored with the other half's counts, which
gives what the rest needs without hindsight: the extreme-value parameters
(lambda from the tokens of clean documents, K from their best segments) and a
logistic curve from a document's evidence to its probability.

Scoring. A linear-time scan finds all maximal-scoring segments of a whole text
(log-odds less a drift). A segment of score S in a text of n tokens has the
E-value K * n * exp(-lambda * S); segments with an E-value under `e_value` are
toxic passages, and the document's evidence is their -log E-values: all together
and the best one's.

Defined results: null and empty texts have no passages and get the lowest score;
with no labelled rows, or labels of one kind only, every score is the share of
toxic labels (0 without labels), which stays under the threshold of 0.7 unless
all labels are toxic; null labels and repeated labels of a document are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from operator import eq, itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, sample_cut, share, stored, value_of

_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
WORD, STEMS = "w", (4, 5, 6, 7)  # the kinds of token: words, and stems by their bytes
PRIOR, DRIFT = 3.0, 1.5


def tokens(text: str) -> list[bytes]:
    """Lower-cased runs of letters and of anything beyond ASCII."""
    return [w for w in text.lower().encode().translate(_LETTERS).split(b" ") if w]


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), in one pass with left pointers: linear time."""
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    below: list[int] = []  # the nearest earlier one with a smaller sum before
    for at in np.flatnonzero(scores > 0).tolist():
        start, left, right = at, float(sums[at]), float(sums[at + 1])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = below[j]
            if j < 0 or found[j][3] >= right:
                found.append((start, at + 1, left, right))
                below.append(j)
                break
            start, left = found[j][0], found[j][2]
            del found[j:], below[j:]
    return [(s, e, right - left) for s, e, left, right in found]


class _Scores(dict):
    """Token scores, remembered; a token without counts of its own falls back to its stems."""

    def __init__(self, weights: dict[str, dict[bytes, float]]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        known = self.weights
        value = known[WORD].get(word)
        for size in reversed(STEMS):
            if value is None:
                value = known[str(size)].get(word[:size])
        value = 0.0 if value is None else value
        if len(self) > 300_000:
            self.clear()
        self[word] = value = value - DRIFT
        return value


@dataclass
class Model:
    weights: dict[str, dict[bytes, float]]
    share: float = 0.0
    decay: float = 1.0  # lambda
    scale: float = 1.0  # K
    e_value: float = 0.05
    curve: np.ndarray | None = None
    caches: dict = field(default_factory=dict)

    def token_scores(self, text: str) -> np.ndarray:
        """Log-odds less the drift; a token that repeats the one before it adds no evidence."""
        words = tokens(text)
        cache = self.caches.setdefault("scores", _Scores(self.weights))
        scores = np.fromiter(map(cache.__getitem__, words), dtype=np.float64, count=len(words))
        scores[1:][np.fromiter(map(eq, words[1:], words), dtype=bool, count=max(0, len(words) - 1))] = -DRIFT
        return scores

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        scores = self.token_scores(text)
        return len(scores), maximal_segments(scores)

    def passages(self, text: str) -> list[tuple[int, int, float, float]]:
        """(start, end, score, E-value) of each significant passage, in tokens."""
        n, found = self.segments(text)
        with_e = ((s, e, score, self.scale * n * math.exp(-self.decay * score)) for s, e, score in found)
        return [x for x in with_e if x[3] < self.e_value]

    def probability(self, e_values: list[float]) -> float:
        if self.curve is None:
            return self.share
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, float(self.curve @ evidence(e_values))))))


def evidence(e_values: list[float], counts: list[int] | None = None) -> np.ndarray:
    """1, the logarithm of all passages' -log E-values together (each so many times), and the -log E-value of the best (up to 30)."""
    logs = [-math.log(max(e, 1e-300)) for e in e_values]
    return np.array([1.0, math.log1p(sum(x * n for x, n in zip(logs, counts or [1] * len(logs), strict=True))), min(30.0, max(logs, default=0.0)) / 10])


def _logit(p: float) -> float:
    return math.log(p) - math.log1p(-p)


def log_odds(counts: dict[str, dict[bytes, tuple]], n: int, toxic: int, docs: Callable[[tuple], int], bad: Callable[[tuple], int], least: int = 3) -> dict[str, dict[bytes, float]]:
    """Scores by kind of token.

    counts: rows by kind and token, of which docs and bad give the documents and toxic documents; least: documents a token must
    be in to be kept. Tokens are left out where neither their own score nor that of the stem that stands in for them is positive.
    """
    kinds = [*map(str, STEMS), WORD]
    out: dict[str, dict[bytes, float]] = {kind: {} for kind in kinds}
    if not 0 < toxic < n:
        return out
    share, rates = toxic / n, {}
    for k, kind in enumerate(kinds):
        rates[kind] = {}
        for token, row in counts.get(kind, {}).items():
            if docs(row) >= least:
                # the prior is the rate of the longest stem that has one
                prior = next((r for size in reversed(STEMS[:k]) if (r := rates[str(size)].get(token[:size])) is not None), share)
                rate = rates[kind][token] = (bad(row) + PRIOR * prior) / (docs(row) + PRIOR)
                if rate > share or prior > share:
                    out[kind][token] = _logit(rate) - _logit(share)
    return out


def karlin(bins: Counter) -> float:
    """lambda: the positive root of E[exp(lambda * s)] = 1 over the token scores of clean documents (scores in tenths)."""
    total = sum(bins.values())
    if not total or max(bins) <= 0 or sum(k * c for k, c in bins.items()) >= 0:
        return 1.0
    low, high = 1e-3, 20.0
    for _ in range(60):
        middle = (low + high) / 2
        if sum(c * math.exp(min(700.0, middle * k / 10)) for k, c in bins.items()) > total:
            high = middle
        else:
            low = middle
    return max(low, 0.05)


def logistic(design: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Coefficients by Newton's method; the ridge keeps them finite where the classes are apart."""
    beta = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(beta)), design.T @ (y - p) - ridge * beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and toxic documents of each token in each half, summed over the task."""
    sums: defaultdict[tuple, list[int]] = defaultdict(lambda: [0, 0])

    def flush() -> pa.RecordBatch:
        rows = [(half, kind, token, *x) for (half, kind, token), x in sums.items()]
        sums.clear()
        columns = list(zip(*rows, strict=True)) or [()] * 5
        types = [pa.int32(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["half", "kind", "token", "docs", "bad"])

    for batch in batches:
        for half, bad, text in zip(*[batch.column(c).to_pylist() for c in ("half", "bad", "text")], strict=True):
            words = set(tokens(text))
            for kind, found in ((WORD, words), *((str(size), {w[:size] for w in words if len(w) > size}) for size in STEMS)):
                for token in found:
                    x = sums[half, kind, token]
                    x[0] += 1
                    x[1] += bad
            if len(sums) > 500_000:
                yield flush()
    yield flush()


def _probe(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each sampled document, by the other half's model: label, tokens and how many segments have each score; of clean ones the token scores too. Scores are in tenths, so that a row's size doesn't follow its text's."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [Model(w) for w in value_of(shared)]
        bins: Counter = Counter()
        for batch in batches:
            out = []
            for half, bad, text in zip(*[batch.column(c).to_pylist() for c in ("half", "bad", "text")], strict=True):
                model = models[1 - half]
                scores = model.token_scores(text)
                found = Counter(round(10 * s) for _, _, s in maximal_segments(scores))
                out.append((bad, len(scores), list(found), list(found.values())))
                if not bad:
                    bins.update(np.rint(10 * scores).astype(int).tolist())
            yield _probe_batch(out)
        yield _probe_batch([(-1, 0, list(bins), list(bins.values()))])

    return rows


def _probe_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    types = [pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["bad", "n", "tenths", "counts"])


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_docs: int = 20_000, e_value: float = 0.05) -> Model:
    """A model from the labelled rows where `learn` (over the id) holds; at most `train_docs` documents are counted, one text an id (that of the least hash)."""
    spark = docs.sparkSession
    bound_batches(spark)
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("bad")).where("doc_id is not null and bad in (0, 1)")
    if learn is not None:
        known = known.where(learn)
    known = known.groupBy("doc_id").agg(F.max("bad").cast("int").alias("bad"))
    last = sample_cut(known, F.xxhash64("doc_id"), train_docs)
    known = known.where(F.xxhash64("doc_id") <= last) if last is not None else known.limit(0)
    known = known.select(F.col("doc_id").alias("__id"), "bad", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int").alias("half"))
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # train_docs rows of two integers: the bound of the broadcast
    sample = text.join(F.broadcast(known), F.col("doc_id") == F.col("__id"))
    sample = sample.groupBy("__id", "half", "bad").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # a row an id, whatever repeats it
    sample = stored(sample.select("half", "bad", "text"), "toxicity-sample")

    counted = sample.mapInArrow(_count, "half int, kind string, token binary, docs long, bad long").groupBy("kind", "token")
    sides = [F.sum(F.when(F.col("half") == h, F.col(c)).otherwise(0)).alias(f"{c}{h}") for h in (0, 1) for c in ("docs", "bad")]
    counts: dict[str, dict[bytes, tuple]] = {}
    for batch in counted.agg(*sides).where("docs0 + docs1 >= 3").toArrow().to_batches():
        for kind, token, *row in zip(*[batch.column(c).to_pylist() for c in ("kind", "token", "docs0", "bad0", "docs1", "bad1")], strict=True):
            counts.setdefault(kind, {})[token] = tuple(row)
    sizes = {r["half"]: (r["n"], r["bad"] or 0) for r in sample.groupBy("half").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad")).collect()}
    n, toxic = (sum(s[k] for s in sizes.values()) for k in (0, 1))
    model = Model(log_odds(counts, n, toxic, lambda r: r[0] + r[2], lambda r: r[1] + r[3]), share=toxic / n if n else 0.0, e_value=e_value)
    if not 0 < toxic < n:
        return model
    halves = [log_odds(counts, *sizes.get(h, (0, 0)), itemgetter(2 * h), itemgetter(2 * h + 1), least=2) for h in (0, 1)]
    counts.clear()
    shared = share(spark, halves)
    probed = sample.mapInArrow(_probe(shared), "bad int, n long, tenths array<int>, counts array<long>").collect()
    bins: Counter = Counter()
    for r in probed:
        if r["bad"] < 0:
            bins.update(dict(zip(r["tenths"], r["counts"], strict=True)))
    rows = [(r["n"], r["tenths"], r["counts"], r["bad"]) for r in probed if r["bad"] >= 0]
    model.decay = karlin(bins)
    clean = [(n, max(tenths, default=0) / 10) for n, tenths, _, bad in rows if not bad and n]
    model.scale = max(1e-6, len(clean) / max(1.0, sum(n * math.exp(-model.decay * best) for n, best in clean)))
    x = []
    for n, tenths, counts_, _ in rows:
        e = [(model.scale * n * math.exp(-model.decay * k / 10), c) for k, c in zip(tenths, counts_, strict=True)]
        x.append(evidence([v for v, _ in e if v < e_value], [c for v, c in e if v < e_value]))
    model.curve = logistic(np.array(x), np.array([r[3] for r in rows], dtype=float))
    return model


def _score(shared, text_col: str, drop: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = value_of(shared)
        for batch in batches:
            scores, passages = [], []
            for text in batch.column(text_col):
                found = model.passages(text.as_py() or "")
                scores.append(model.probability([e for *_, e in found]))
                passages.append([{"start": s, "end": e, "score": v, "e_value": p} for s, e, v, p in found])
            at = batch.schema.get_field_index(text_col) if drop else -1
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))
            rest = [(f.name, c) for k, (f, c) in enumerate(zip(batch.schema, batch.columns, strict=True)) if k != at]
            yield pa.RecordBatch.from_arrays([*[c for _, c in rest], pa.array(scores, pa.float64()), pa.array(passages, kind)], [*[name for name, _ in rest], "__score", "__passages"])

    return rows


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (default: all) with __score and __passages: array<struct<start, end, score, e_value>>, in tokens."""
    model.caches.clear()
    bound_batches(docs.sparkSession)
    shared = share(docs.sparkSession, model)
    keep = list(keep or docs.columns)
    drop = text_col not in keep
    kept = docs.select(*keep, *[text_col] * drop)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keep)
    return kept.mapInArrow(_score(shared, text_col, drop), f"{schema}, __score double, __passages array<struct<start:int,end:int,score:double,e_value:double>>")
