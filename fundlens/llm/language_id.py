"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in consecutive windows of ``WINDOW`` bytes (every byte
of the whole text is in exactly one window), forwards and backwards, labels every position and
pools the position probabilities of a document. It is trained in numpy by backpropagation
through time on a bounded sample of labelled rows and applied on the executors.

Cases: null text, or text without a letter -> ``und`` with score 0. A null doc_id is not held
out and not learned from. Rows keep their multiplicity. Languages are the distinct non-null
``lang`` values of the training rows; with none of them every row is ``und``. Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundlens.llm.common import byte_chunks, map_arrow

WINDOW = 64
HIDDEN = 8
DOCS_PER_LANG = 400      # bound of the training sample: documents a language (expected)
WINDOWS_PER_DOC = 4      # and windows a document
MAX_LANGS = 256
EPOCHS = 8
MIN_SCORE = 0.3
UND = "und"


def held_out(column: str = "doc_id", rest: int = 0):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == rest, F.lit(False))


def cell(x, h, u, hid):
    """One gated step: x = input part (B, 3H), h = state (B, H)."""
    g = h @ u
    rz = np.tanh(x[:, :2 * hid] + g[:, :2 * hid])
    rz *= 0.5
    rz += 0.5
    n = np.tanh(x[:, 2 * hid:] + rz[:, :hid] * g[:, 2 * hid:])
    return n + rz[:, hid:] * (h - n), rz, n, g


def position_probs(model: dict, seq: np.ndarray) -> np.ndarray:
    """(T, L, B) label probabilities of every position of the byte windows ``seq`` (T, B).

    Same network as in training, laid out feature-first so every step works on whole rows.
    """
    hid, (t_len, b) = model["hidden"], seq.shape
    z = np.empty((t_len, len(model["c"]), b), np.float32)
    z[:] = model["c"][None, :, None]
    x, g = np.empty((3 * hid, b), np.float32), np.empty((3 * hid, b), np.float32)
    for d, order in (("f", range(t_len)), ("b", range(t_len - 1, -1, -1))):
        table, u, v = (np.ascontiguousarray(model[k + d].T) for k in "xuv")
        h = np.zeros((hid, b), np.float32)
        for t in order:
            np.take(table, seq[t], axis=1, out=x, mode="clip")
            np.matmul(u, h, out=g)
            gates, n = x[:2 * hid], x[2 * hid:]
            gates += g[:2 * hid]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            r = g[2 * hid:]
            r *= gates[:hid]
            n += r
            np.tanh(n, out=n)
            h -= n
            h *= gates[hid:]
            h += n
            z[t] += v @ h
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def windows(data: np.ndarray, off: np.ndarray, width: int = WINDOW):
    """Padded windows (n, width) over every byte, their mask and their text's index."""
    n = -(-np.diff(off) // width)
    doc = np.repeat(np.arange(len(n)), n)
    first = off[:-1][doc] + width * (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))
    pos = first[:, None] + np.arange(width)
    mask = pos < off[1:][doc][:, None]
    return np.where(mask, data[np.minimum(pos, max(len(data) - 1, 0))], 0), mask, doc


def train(samples: list[tuple[bytes, int]], n_labels: int, hidden: int = HIDDEN, epochs: int = EPOCHS,
          seed: int = 1) -> dict:
    """Adam on the mean position cross-entropy, gradients by backpropagation through time."""
    rng = np.random.default_rng(seed)
    g = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
    p = {"xf": g(256, 3 * hidden), "uf": g(hidden, 3 * hidden), "xb": g(256, 3 * hidden), "ub": g(hidden, 3 * hidden),
         "vf": g(hidden, n_labels), "vb": g(hidden, n_labels), "c": np.zeros(n_labels, np.float32)}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v2 = {k: np.zeros_like(v) for k, v in p.items()}
    raw = [s for s, _ in samples]
    off = np.concatenate([[0], np.cumsum([len(s) for s in raw])])
    seq_all, mask_all, doc = windows(np.frombuffer(b"".join(raw), np.uint8), off)
    y_all = np.array([y for _, y in samples])[doc]
    share = np.bincount(y_all, minlength=n_labels)
    weight = (len(y_all) / np.maximum(share, 1) / n_labels).astype(np.float32)[y_all]
    step, batch = 0, 256
    eye = np.eye(256, dtype=np.float32)
    for epoch in range(epochs):
        order = rng.permutation(len(y_all))
        for i in range(0, len(order), batch):
            idx = order[i:i + batch]
            seq, mask, y = seq_all[idx].T, mask_all[idx].T, y_all[idx]
            grads = gradients(p, seq, mask * weight[idx], y, hidden, eye)
            step += 1
            rate = 0.02 * (1 - epoch / (epochs + 1))
            for k, gr in grads.items():
                gr = np.clip(gr, -1, 1)
                m[k] += 0.1 * (gr - m[k])
                v2[k] += 0.01 * (gr * gr - v2[k])
                p[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v2[k] / (1 - 0.99 ** step)) + 1e-6)
    return p | {"hidden": hidden}


def gradients(p: dict, seq, mask, y, hid, eye) -> dict:
    t_len, b = seq.shape
    out = {k: np.zeros_like(v) for k, v in p.items()}
    tapes, states = {}, {}
    for d, order in (("f", range(t_len)), ("b", range(t_len - 1, -1, -1))):
        h = np.zeros((b, hid), np.float32)
        tape, st = [], np.empty((t_len, b, hid), np.float32)
        for t in order:
            nh, rz, n, gg = cell(p["x" + d][seq[t]], h, p["u" + d], hid)
            tape.append((t, h, rz, n, gg))
            h = nh
            st[t] = h
        tapes[d], states[d] = tape, st
    z = states["f"] @ p["vf"] + states["b"] @ p["vb"] + p["c"]
    z -= z.max(axis=2, keepdims=True)
    e = np.exp(z)
    e /= e.sum(axis=2, keepdims=True)
    e[:, np.arange(b), y] -= 1
    e *= (mask / max(mask.sum(), 1)).astype(np.float32)[:, :, None]
    out["c"] = e.sum(axis=(0, 1))
    for d in "fb":
        out["v" + d] = np.einsum("tbh,tbl->hl", states[d], e)
        back = e @ p["v" + d].T
        dh = np.zeros((b, hid), np.float32)
        u = p["u" + d]
        for t, h, rz, n, gg in reversed(tapes[d]):
            dh = dh + back[t]
            r, zt = rz[:, :hid], rz[:, hid:]
            dn = dh * (1 - zt) * (1 - n * n)
            dz = dh * (h - n)
            dr = dn * gg[:, 2 * hid:]
            drz = np.concatenate([dr, dz], axis=1) * 2 * rz * (1 - rz)  # gate = (1 + tanh a) / 2
            dg = np.concatenate([drz, dn * r], axis=1)
            dx = np.concatenate([drz, dn], axis=1)
            out["x" + d] += eye[seq[t]].T @ dx
            out["u" + d] += h.T @ dg
            dh = dh * zt + dg @ u.T
    return out


def fit(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, windows_per_doc: int = WINDOWS_PER_DOC) -> dict | None:
    """Train on a bounded sample: per language about ``docs_per_lang`` rows chosen by a hash of
    doc_id, of each at most ``windows_per_doc`` windows anywhere in the text. One small
    count by language, one scan."""
    rows = docs.select("doc_id", "text", "lang").where(
        ~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n"))
              .orderBy("lang").limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages: is lang a language column?")
    if not counts:
        return None
    langs = sorted(counts)
    # a uniform hash below a per-language share: expected docs_per_lang rows of each
    share = F.create_map(*[F.lit(v) for k in langs for v in (k, min(1.0, docs_per_lang / counts[k]))])
    unit = (F.xxhash64("doc_id", F.lit("lid")).cast("double") / F.lit(2.0 ** 64)) + 0.5
    room = F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1
    cut = F.transform(F.sequence(F.lit(0), F.lit(windows_per_doc - 1)), lambda k: F.substring(
        F.col("text"), (F.pmod(F.xxhash64("doc_id", k), room) + 1).cast("int"), F.lit(WINDOW)))
    picked = (rows.where(unit < F.element_at(share, F.col("lang")))
              .select("doc_id", "lang", F.array_distinct(cut).alias("cuts"))
              .limit(2 * docs_per_lang * len(langs)).collect())
    label = {k: i for i, k in enumerate(langs)}
    samples = [(c.encode(), label[r["lang"]]) for r in sorted(picked, key=lambda r: (r["doc_id"], r["lang"]))
               for c in r["cuts"] if c]
    return train(samples, len(langs)) | {"langs": langs}


def pooled(model: dict, data: np.ndarray, off: np.ndarray, block: int = 4096) -> np.ndarray:
    """Mean position probability of each text; texts without bytes get zeros."""
    total = np.zeros((len(off) - 1, len(model["c"])))
    n = -(-np.diff(off) // WINDOW)
    doc = np.repeat(np.arange(len(n)), n)
    first = off[:-1][doc] + WINDOW * (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))
    for i in range(0, len(doc), block):
        d = doc[i:i + block]
        pos = first[i:i + block] + np.arange(WINDOW)[:, None]
        mask = pos < off[1:][d]
        pr = position_probs(model, np.where(mask, data[np.minimum(pos, len(data) - 1)], 0))
        pr *= mask[:, None, :]
        sums = pr.sum(axis=0)
        for k in range(total.shape[1]):
            total[:, k] += np.bincount(d, weights=sums[k], minlength=len(total))
    return total / np.maximum(np.diff(off), 1)[:, None]


def predict(docs: DataFrame, model: dict | None, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``keep`` (default doc_id and held_out) plus lang_pred, score for every row; only the
    text is an input, the other columns pass through."""
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    base = docs.withColumn("held_out", held_out()) if keep is None else docs
    keep = ["doc_id", "held_out"] if keep is None else keep
    if model is None:
        return base.select(*keep, F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"))
    base = base.select(*keep, letters.alias("_letters"), *([] if text in keep else [F.col(text)]))
    schema = T.StructType([*base.select(*keep).schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model["langs"], UND], dtype=object)
        for b in batches:
            letters = np.asarray(b.column("_letters").to_numpy(zero_copy_only=False), bool)
            best, prob = np.full(len(letters), len(names) - 1), np.zeros(len(letters))
            for i, j, data, off in byte_chunks(b.column(text)):
                p = pooled(model, data, off)
                best[i:j], prob[i:j] = p.argmax(axis=1), p.max(axis=1)
            best[~letters], prob[~letters] = len(names) - 1, 0.0
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(names[best], pa.string()),
                                              pa.array(np.clip(prob, 0, 1))], names=[*keep, "lang_pred", "score"])

    return map_arrow(base, score, schema)


def keep_known(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without the rows whose language can't be told (``und`` or a score under
    ``min_score``); a missing lang becomes the predicted one."""
    cols = docs.columns
    carried = docs.select(*[F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(cols)])   # names that cannot clash
    got = predict(carried, fit(docs), carried.columns, f"_in{cols.index('text')}").where((F.col("lang_pred") != UND) & (F.col("score") >= min_score))
    return got.select(*[(F.coalesce(f"_in{i}", "lang_pred") if c == "lang" else F.col(f"_in{i}")).alias(c) for i, c in enumerate(cols)])


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs))
