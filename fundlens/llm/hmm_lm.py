"""Language-model scoring with a class-based hidden Markov model.

Tokens are words and one end per text. Every token belongs to one class: frequent words have
a class of their own, the others share classes by their last two bytes, the end has its own.
Latent states emit classes; inside a class a token has its smoothed corpus frequency:

    log P(text) = log HMM(classes) + sum log P(token | class).

Baum-Welch expected counts are gathered over all training documents, summed across partitions
by Spark, and normalised; the scaled forward recursion gives the exact likelihood of a text of
any length, run over equal-length segments as products of state matrices. Token counts cover
all training tokens. Frequent words (a bounded table) are looked up in the task; rare ones are
joined to the counts by hash, so no key is hot and nothing of corpus size is broadcast.

Words are told apart by a 64-bit hash. Cases: null text counts as empty: its only token is the
end; a null doc_id is not held out; rows with equal doc_id are scored each on its own; without
training documents every count is 0 and the model is uniform; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundlens.llm.bytewords import LOWER, words
from fundlens.llm.common import byte_chunks, map_arrow, written

STATES = 6
ROUNDS = 4
TOP = 65_536        # frequent words whose counts travel with the task
OWN = 1024          # of these, words with a class of their own
SUFFIXES = 512
CLASSES = OWN + SUFFIXES + 1
END = CLASSES - 1
SEGMENT = 256


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))


def tokens(data: np.ndarray, off: np.ndarray):
    """Word hashes, suffix classes and the word offsets of texts."""
    starts, ends, h, woff = words(data, off)
    if not len(starts):
        return h, np.zeros(0, np.int64), woff
    low = LOWER[data]
    a = low[ends - 1].astype(np.int64)
    b = np.where(ends - 2 >= starts, low[np.maximum(ends - 2, 0)], 0).astype(np.int64)
    return h, (a * 31 + b * 7 + (b >> 3)) % SUFFIXES, woff


def counts(docs: DataFrame) -> DataFrame:
    """(h, suffix, c) of every word in the training documents."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, ss = [], []
            for _, _, data, off in byte_chunks(b.column("text"), 1 << 22):
                h, s, _ = tokens(data, off)
                u, first, n = np.unique(h, return_index=True, return_counts=True)
                hs.append((u, n))
                ss.append(s[first])
            if not hs:
                continue
            all_h, all_n, all_s = np.concatenate([x for x, _ in hs]), np.concatenate([n for _, n in hs]), np.concatenate(ss)
            u, first, inv = np.unique(all_h, return_index=True, return_inverse=True)
            n = np.bincount(inv, weights=all_n, minlength=len(u)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(all_s[first].astype(np.int32)), pa.array(n)],
                                             names=["h", "suffix", "c"])

    part = map_arrow(docs.where(~held_out()).select("text"), work, "h long, suffix int, c long")
    return part.groupBy("h").agg(F.min("suffix").alias("suffix"), F.sum("c").alias("c"))


class Vocabulary:
    """The bounded table of frequent words: sorted hashes, their counts and classes."""

    def __init__(self, rows: list[tuple[int, int]]):
        h = np.array([r[0] for r in rows], np.int64).view(np.uint64)
        order = np.argsort(h)
        self.h, self.c = h[order], np.array([r[1] for r in rows], np.int64)[order]
        self.own = np.where(order < OWN, order, -1)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, found) of word hashes."""
        if not len(self.h):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return at, self.h[at] == h


def encoded(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Per row: uid, doc_id, held_out, n_tokens, what the frequent words give (count, sum of
    log10(c + 0.5)), the class sequence and the hashes of the other words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            length, known, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            seqs, rare = [], []
            for i, j, data, off in byte_chunks(b.column("text"), 1 << 21):
                h, suffix, woff = tokens(data, off)
                at, hit = vocab.find(h)
                cls = OWN + suffix
                if len(vocab.h):
                    own = np.where(hit, vocab.own[at], -1)
                    cls = np.where(own >= 0, own, cls)
                    logs = np.where(hit, np.log10(vocab.c[at] + 0.5), 0.0)
                else:
                    logs = np.zeros(len(h))
                sums = np.concatenate([[0.0], np.cumsum(logs)])
                hits = np.concatenate([[0], np.cumsum(hit)])
                length[i:j] = np.diff(woff) + 1
                known[i:j] = hits[woff[1:]] - hits[woff[:-1]]
                total[i:j] = sums[woff[1:]] - sums[woff[:-1]]
                for a, e in zip(woff, woff[1:], strict=False):
                    seqs.append(np.append(cls[a:e], END).astype("<u2").tobytes())
                    rare.append(h[a:e][~hit[a:e]].view(np.int64))
            rare_off = np.concatenate([[0], np.cumsum([len(r) for r in rare])]).astype(np.int32)
            flat = np.concatenate(rare) if rare else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(length), pa.array(known), pa.array(total),
                 pa.array(seqs, pa.binary()), pa.ListArray.from_arrays(pa.array(rare_off), pa.array(flat))],
                names=["doc_id", "held_out", "n_tokens", "top_known", "top_sum", "classes", "rare"])

    out = map_arrow(docs.select("doc_id", held_out().alias("held_out"), "text"), work,
                    f"doc_id {kind}, held_out boolean, n_tokens long, top_known long, top_sum double, classes binary, rare array<long>")
    return out.withColumn("uid", F.monotonically_increasing_id())


def segments(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sequences cut into rows of SEGMENT classes: (classes (T, S), mask, sequence of each, place in it)."""
    n = np.array([-(-len(s) // SEGMENT) for s in seqs])
    seq = np.repeat(np.arange(len(seqs)), n)
    place = np.arange(len(seq)) - np.repeat(np.cumsum(n) - n, n)
    size = np.array([len(s) for s in seqs])
    begin = np.cumsum(size) - size
    pos = (begin[seq] + place * SEGMENT)[:, None] + np.arange(SEGMENT)
    mask = pos < (begin + size)[seq][:, None]
    flat = np.concatenate(seqs)
    return flat[np.minimum(pos, len(flat) - 1)].T, mask.T, seq, place


def expect(model: tuple, obs: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of segments: start (K), transitions (K, K), emissions (K, C), log likelihood."""
    pi, a, b = (x.astype(np.float32) for x in model)
    bt = np.ascontiguousarray(b.T)
    t_len, s = obs.shape
    t_len = int(mask.any(axis=1).sum())
    k = len(pi)
    alpha, scale = np.empty((t_len, s, k), np.float32), np.ones((t_len, s), np.float32)
    emit = bt[obs[:t_len]]
    emit[~mask[:t_len]] = 1.0
    cur = pi * emit[0]
    for t in range(t_len):
        if t:
            cur = (alpha[t - 1] @ a) * emit[t]
        c = cur.sum(axis=1)
        scale[t] = c
        alpha[t] = cur / c[:, None]
    trans, emis = np.zeros((k, k)), np.zeros((k, b.shape[1]))
    beta = np.ones((s, k), np.float32)
    gamma = np.empty((t_len, s, k), np.float32)
    for t in range(t_len - 1, -1, -1):
        m = mask[t]
        g = alpha[t] * beta
        g /= g.sum(axis=1, keepdims=True)
        gamma[t] = g * m[:, None]
        if t:
            w = emit[t] * beta / scale[t][:, None]
            trans += (alpha[t - 1] * m[:, None]).T @ w
            beta = np.where(m[:, None], w @ a.T, 1.0)
    flat, g = obs[:t_len].ravel(), gamma.reshape(-1, k)
    for i in range(k):
        emis[i] = np.bincount(flat, weights=g[:, i], minlength=b.shape[1])
    return gamma[0].sum(axis=0), trans * a, emis, float(np.log(np.where(mask[:t_len], scale, 1.0)).sum())


def baum_welch_round(seqs: DataFrame, model: tuple) -> tuple:
    """One round: expected counts of every partition, summed by Spark, then normalised."""
    k, c = model[2].shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, trans, emis = np.zeros(k), np.zeros((k, k)), np.zeros((k, c))
        for b in batches:
            rows = [np.frombuffer(x.as_buffer(), "<u2").astype(np.int64) for x in b.column("classes")]
            i = 0
            while i < len(rows):
                j, n = i, 0
                while j < len(rows) and n < 400_000:
                    n += len(rows[j])
                    j += 1
                obs, mask, _, _ = segments(rows[i:j])
                s, t, e, _ = expect(model, obs, mask)
                start += s
                trans += t
                emis += e
                i = j
        flat = np.concatenate([start, trans.ravel(), emis.ravel()])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at])], names=["at", "n"])

    sums = map_arrow(seqs.select("classes"), work, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(k + k * k + k * c)
    for r in sums:                                   # as many as the model has numbers
        flat[r["at"]] = r["n"]
    return normalise(flat[:k] + 1e-3, flat[k:k + k * k].reshape(k, k) + 1e-3, flat[k + k * k:].reshape(k, c) + 1e-2)


def normalise(pi, a, b):
    return pi / pi.sum(), a / a.sum(axis=1, keepdims=True), b / b.sum(axis=1, keepdims=True)


def first_model(seqs: DataFrame, class_n: np.ndarray, k: int = STATES) -> tuple:
    """Each state starts half way between the corpus and one training document."""
    seeds = (seqs.where("n_tokens >= 50").select("classes", F.xxhash64("doc_id", F.lit("hmm")).alias("h"), "uid")
             .orderBy("h", "uid").limit(k).select("classes").collect())
    uni = (class_n + 1.0) / (class_n + 1.0).sum()
    b = np.tile(uni, (k, 1))
    rng = np.random.default_rng(7)
    for i in range(k):
        if i < len(seeds):
            own = np.bincount(np.frombuffer(seeds[i]["classes"], "<u2").astype(np.int64), minlength=len(uni))
            b[i] = 0.5 * uni + 0.5 * own / own.sum()
        else:
            b[i] = uni * np.exp(0.3 * rng.normal(size=len(uni)))
    a = np.full((k, k), 0.05 / max(k - 1, 1))
    np.fill_diagonal(a, 0.95)
    return normalise(np.ones(k), a, b)


def log_likelihoods(model: tuple, seqs: list[np.ndarray]) -> np.ndarray:
    """log10 HMM probability of each class sequence (natural scaling, exact for any length).

    Every segment's product of step matrices is formed with all others at once; the products
    of one sequence are then applied in order to its state vector.
    """
    pi, a, b = model
    k = len(pi)
    bt = np.ascontiguousarray(b.T)
    obs, mask, seq, place = segments(seqs)
    t_len, s = obs.shape
    logs = np.zeros(s)
    prod = np.tile(np.eye(k), (s, 1, 1))
    full = mask.all(axis=1)
    for t in range(t_len):
        if not mask[t].any():
            break
        rows = slice(None) if full[t] else np.flatnonzero(mask[t])
        step = (prod[rows].reshape(-1, k) @ a).reshape(-1, k, k)
        if t == 0:
            step[place == 0] = pi        # a text's first token is drawn without a transition
        step *= bt[obs[t][rows]][:, None, :]
        if t % 8 == 7:  # eight steps stay far from underflow
            c = step.sum(axis=(1, 2))
            step /= c[:, None, None]
            logs[rows] += np.log(c)
        prod[rows] = step
    out = np.zeros(len(seqs))
    state = np.zeros((len(seqs), k))
    for p in range(int(place.max()) + 1):
        at = np.flatnonzero(place == p)
        v = np.einsum("si,sij->sj", state[seq[at]], prod[at]) if p else prod[at, 0]
        c = v.sum(axis=1)
        out[seq[at]] += np.log(c) + logs[at]
        state[seq[at]] = v / c[:, None]
    return out / np.log(10)


def score(docs: DataFrame, rounds: int = ROUNDS, states: int = STATES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    words_n = written(counts(docs), "word-counts")
    top = [(r["h"], r["c"]) for r in words_n.orderBy(F.desc("c"), "h").limit(TOP).select("h", "c").collect()]
    vocab = Vocabulary(top)
    enc = written(encoded(docs, vocab), "token-classes")
    train = enc.where(~F.col("held_out"))
    ends = train.count()
    own_h = [h for h, _ in top[:OWN]]
    stats = words_n.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = (stats["n"] or 0) + ends, stats["v"] + (ends > 0)
    # class totals: classes of their own from the table, the suffix classes from all other words
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for i, (_, c) in enumerate(top[:OWN]):
        class_n[i], class_v[i] = c, 1
    others = words_n.where(~F.col("h").isin(own_h)) if own_h else words_n
    for r in others.groupBy("suffix").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        class_n[OWN + r["suffix"]], class_v[OWN + r["suffix"]] = r["n"], r["v"]
    class_n[END], class_v[END] = ends, int(ends > 0)
    model = first_model(train, class_n, states)
    if ends:
        for _ in range(rounds):
            model = baum_welch_round(train, model)

    # a token of a shared class: (c + 0.5) / (N_class + 0.5 (V_class + 1)); alone in its class: 1
    log_den = np.log10(class_n + 0.5 * (class_v + 1))
    shared = np.zeros(CLASSES, bool)
    shared[OWN:END] = True
    own_log = np.where(shared, 0.0, np.log10(class_n + 0.5))
    end_c = np.log10(ends + 0.5)
    den = np.log10(n_all + 0.5 * (v_all + 1))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what each class takes off the sum of log10(c + 0.5): its denominator, or its own count
        minus = np.where(shared, log_den, own_log)
        for b in batches:
            rows = [np.frombuffer(x.as_buffer(), "<u2").astype(np.int64) for x in b.column("classes")]
            part, off, i = np.zeros(len(rows)), np.zeros(len(rows)), 0
            while i < len(rows):
                j, n = i, 0
                while j < len(rows) and n < 400_000:
                    n += len(rows[j])
                    j += 1
                part[i:j] = log_likelihoods(model, rows[i:j])
                sums = np.concatenate([[0.0], np.cumsum(minus[np.concatenate(rows[i:j])])])
                ends_at = np.cumsum([len(r) for r in rows[i:j]])
                off[i:j] = sums[ends_at] - sums[ends_at - [len(r) for r in rows[i:j]]]
                i = j
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in names[:6]), pa.array(part), pa.array(off)], names=names)

    names = ["uid", "doc_id", "held_out", "n_tokens", "top_known", "top_sum", "hmm", "off"]
    scored = map_arrow(enc.select("uid", "doc_id", "held_out", "n_tokens", "top_known", "top_sum", "classes"), work,
                       f"uid long, doc_id {kind}, held_out boolean, n_tokens long, top_known long, top_sum double, hmm double, off double")
    rare = (enc.select("uid", F.explode("rare").alias("h")).join(words_n.select("h", "c"), "h", "left")
            .select("uid", F.coalesce("c", F.lit(0)).alias("c")).groupBy("uid")
            .agg(F.sum((F.col("c") > 0).cast("long")).alias("k"), F.sum(F.log10(F.col("c") + 0.5)).alias("s")))
    total = F.col("top_sum") + F.coalesce("s", F.lit(0.0)) + F.lit(float(end_c))
    return (scored.join(rare, "uid", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("top_known") + F.coalesce("k", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (total - F.col("n_tokens") * F.lit(float(den))).alias("base_score"),
        (F.col("hmm") + total - F.col("off")).alias("score")))
