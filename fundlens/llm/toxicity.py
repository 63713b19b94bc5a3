"""Toxicity by a classifier chain of linear models.

The categories of ``labels`` are predicted one after another (low quality, then toxic): each
model is a logistic regression on the words and word beginnings of the whole text and on the probabilities of the
earlier categories. In training those probabilities are out-of-fold predictions, so a later
model learns from inputs as good as those it will see.

The models are fitted on a bounded sample of labelled rows (``TRAIN_ROWS``, chosen by a hash of
doc_id) with a bounded vocabulary (``FEATURES`` words with the strongest association in the
sample) and applied to every document. Cases: a text without a known word (also null or
empty) gets the base rates and is not flagged; a document may have several label rows (the largest value counts) or none; null labels
count as 0; without labelled rows, or with one class only, nothing is flagged; repeated rows
keep their multiplicity; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundlens.llm.bytewords import LOWER, PUNCT, mix, words
from fundlens.llm.common import byte_chunks, map_arrow, written

CHAIN = ["low_quality", "toxic"]
PREFIXES = (4, 5)
TRAIN_ROWS = 6000
FEATURES = 512
FOLDS = 3


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, rounds: int = 200) -> np.ndarray:
    """Weights (last one the intercept) by accelerated full-batch gradient descent; classes balanced."""
    n, d = x.shape
    y = y.astype(np.float32)     # keeps every product in single precision
    share = max(y.mean(), 1e-6)
    weight = np.where(y > 0, 0.5 / share, 0.5 / max(1 - share, 1e-6)).astype(np.float32) / n
    w, v = np.zeros(d + 1, np.float32), np.zeros(d + 1, np.float32)
    scale = 4.0 / (float((x * x).sum(1).mean()) + 1)   # one over the gradient's Lipschitz bound
    for i in range(rounds):
        look = w + v * (i / (i + 3))
        p = 1 / (1 + np.exp(-(x @ look[:-1] + look[-1])))
        e = (p - y) * weight
        g = np.concatenate([x.T @ e + l2 * look[:-1], [e.sum()]]).astype(np.float32)
        new = look - scale * g
        v, w = new - w, new
    return w


def apply(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def word_sets(col: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's words and of their beginnings of PREFIXES bytes:
    a stem is known under any ending."""
    for _, _, data, off in byte_chunks(col):
        starts, ends, h, woff = words(data, off, PUNCT)
        low, size = LOWER[data], ends - starts
        kinds = [h]
        for n in PREFIXES:
            key = np.full(len(starts), n << 56, np.uint64)
            for i in range(n):
                key |= low[np.minimum(starts + i, len(low) - 1)].astype(np.uint64) << np.uint64(8 * i)
            kinds.append(np.where(size > n, mix(key), h))     # a shorter word stands for itself
        for a, b in zip(woff, woff[1:], strict=False):
            yield np.unique(np.concatenate([k[a:b] for k in kinds]))


def sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, low_quality, toxic, words): at most ``rows`` labelled documents, by a hash of doc_id."""
    marks = (labels.where("doc_id is not null").groupBy("doc_id")
             .agg(F.max((F.coalesce(F.col("quality"), F.lit(1)) == 0).cast("int")).alias("low_quality"),
                  F.max(F.coalesce(F.col("toxic"), F.lit(0)).cast("int")).alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    picked = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")  # at most ``rows`` label rows

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s.view(np.int64) for s in word_sets(b.column("text"))]
            off = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("low_quality"), b.column("toxic"),
                 pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], names=["doc_id", *CHAIN, "words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(picked.select("doc_id", "low_quality", "toxic", "text"), hashed,
                     f"doc_id {kind}, low_quality int, toxic int, words array<long>")


def vocabulary(rows: DataFrame, features: int) -> np.ndarray:
    """The ``features`` words with the strongest association (chi-square) with a category."""
    base = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in CHAIN]).first()
    words_n = rows.select(*CHAIN, F.explode("words").alias("w")).groupBy("w").agg(
        F.count("*").alias("n"), *[F.sum(c).alias(c) for c in CHAIN]).where("n > 1")
    score = F.lit(0.0)
    for c in CHAIN:
        rate = base[c] or 0.0
        if 0 < rate < 1:
            gap = F.col(c) - F.col("n") * rate
            score = F.greatest(score, gap * gap / (F.col("n") * (rate * (1 - rate))))
    got = words_n.select("w", score.alias("s")).orderBy(F.desc("s"), "w").limit(features).collect()
    return np.sort(np.array([r["w"] for r in got], np.int64).view(np.uint64))


def found(vocab: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Places in ``vocab`` of the words of a text."""
    if not len(vocab):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(vocab, own), len(vocab) - 1)
    return at[vocab[at] == own]


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, features: int = FEATURES) -> dict | None:
    """The chain: vocabulary, one weight vector a category, and the toxic threshold that is
    best (F1) on out-of-fold probabilities. The driver gets ``rows`` lists of vocabulary places."""
    marked = written(sample(docs, labels, rows), "labelled")
    vocab = vocabulary(marked, features)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [found(vocab, np.array(w.as_py(), np.int64).view(np.uint64)).astype("<i4").tobytes() for w in b.column("words")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("low_quality"), b.column("toxic"),
                                              pa.array(at, pa.binary())], names=["doc_id", *CHAIN, "at"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sets = sorted(map_arrow(marked, places, f"doc_id {kind}, low_quality int, toxic int, at binary").collect(),
                  key=lambda r: (r["doc_id"], r["at"]))
    if not sets:
        return None
    y = np.array([[r[c] for c in CHAIN] for r in sets], float)
    x = np.zeros((len(sets), len(vocab)), np.float32)
    for i, r in enumerate(sets):
        x[i, np.frombuffer(r["at"], "<i4")] = 1
    fold = np.random.default_rng(5).permutation(len(sets)) % FOLDS
    weights, oof_all = [], []
    for c in range(len(CHAIN)):
        oof = np.full(len(sets), y[:, c].mean())
        if 0 < y[:, c].sum() < len(sets):
            for f in range(FOLDS):
                seen = fold != f
                if seen.any() and not seen.all():
                    oof[~seen] = apply(logistic(x[seen], y[seen, c]), x[~seen])
            weights.append(logistic(x, y[:, c]))
        else:
            base = y[:, c].mean()
            weights.append(np.concatenate([np.zeros(x.shape[1]), [30.0 if base else -30.0]]).astype(np.float32))
        oof_all.append(oof)
        x = np.concatenate([x, oof[:, None].astype(np.float32)], axis=1)
    return {"vocab": vocab, "weights": weights, "base": y.mean(axis=0), "threshold": threshold(oof_all[-1], y[:, -1])}


def threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1; midway to the next probability below; 1.1 (never) without positives."""
    if not y.any():
        return 1.1
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    last = np.append(p[order][1:] < p[order][:-1], True)      # never between equal probabilities
    i = int(np.argmax(np.where(last, f1, -1)))
    below = p[order][i + 1] if i + 1 < len(y) else 0.0
    return float(p[order][i] + below) / 2


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, p_low_quality, p_toxic, toxic for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, p_low_quality double, p_toxic double, toxic boolean"
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("p_low_quality"), F.lit(0.0).alias("p_toxic"), F.lit(False).alias("toxic"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = model["vocab"]
        for b in batches:
            probs, known = np.empty((b.num_rows, len(CHAIN))), np.ones(b.num_rows, bool)
            for i, own in enumerate(word_sets(b.column("text"))):
                at = found(vocab, own)
                if not len(at):     # nothing known: the base rates
                    probs[i], known[i] = model["base"], False
                    continue
                for c, w in enumerate(model["weights"]):
                    z = w[at].sum(dtype=float) + w[len(vocab):-1] @ probs[i, :c] + w[-1]
                    probs[i, c] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(probs[:, 0]), pa.array(probs[:, 1]),
                                              pa.array((probs[:, 1] >= model["threshold"]) & known)],
                                             names=["doc_id", "p_low_quality", "p_toxic", "toxic"])

    return map_arrow(docs.select("doc_id", "text"), score, schema)


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents found toxic, with the chain's probabilities."""
    return predict(docs, fit(docs, labels)).where("toxic")
