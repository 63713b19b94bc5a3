"""Corpus operators against brute force, round trips, held-out accuracy and edge rows."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fundlens.llm import (chat_format, decontaminate, hmm_lm, knn_join, language_id, licenses, near_dedup, packing,
                          substring_dedup, toxicity)
from fundlens.llm.bytewords import shingle_sets, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, rep long, h long"


def docs(spark, texts, langs=None):
    """Documents with extra columns whose names clash with inner ones."""
    rows = [(i, t, (langs or {}).get(i), "s", len(t) if t else None, 1.0, 7, 8) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def sample_words(rng, n, v=400):
    return " ".join(f"w{rng.integers(v)}x" for _ in range(n))


def test_byte_words_equal_regex():
    texts = ["", "A b\tC", "  x  ", "é Ü\x0bß", "one"]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    s, e, h, w = words(np.frombuffer(b"".join(raw), np.uint8), off)
    assert np.diff(w).tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts]
    assert len(set(h.tolist())) == len(h)
    sets = shingle_sets(np.frombuffer(b"a b c d e f a b c d e", np.uint8), np.array([0, 21]))
    assert len(sets[0]) == 6


def test_language_id(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97
    odd = docs(spark, [(1, None), (2, ""), (3, "123 --"), (4, "abc")])
    assert {r["lang_pred"] for r in language_id.identify(odd).collect()} == {"und"}      # nothing to learn from
    assert language_id.identify(odd.limit(0)).count() == 0


@pytest.mark.parametrize("top", [33_549_980, 1 << 28])
def test_top_k_scores_beyond_double_sums(spark, top):
    rng = np.random.default_rng(3)
    v = rng.integers(top // 2, top, 64) - rng.integers(0, 3, (12, 64))
    v[3] = -v[3]
    df = spark.createDataFrame([(i, [x / 256 for x in row]) for i, row in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    scores = {i: sum(a * b for a, b in zip(v[0].tolist(), v[i].tolist(), strict=True)) for i in range(1, 12)}
    best = sorted(scores, key=lambda i: (-scores[i], i))[:5]
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in knn_join.top_k(df).collect())
    assert got == [(n + 1, i, scores[i]) for n, i in enumerate(best)] and got[0][2] > 1 << 53


def test_top_k_refuses_scores_beyond_a_long(spark):
    df = spark.createDataFrame([(i, [float(1 << 23)] * 4) for i in range(2)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="long"):
        knn_join.top_k(df)


def test_top_k_edges(spark):
    inf = float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [None, 1.0]),
            (5, [inf, 1.0]), (6, [1.0]), (7, []), (8, [-1.0, 0.2]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("cell", F.lit(2))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in knn_join.top_k(df).collect())
    vec = {0: (256, 0), 50: (128, 128), 1: (256, 0), 2: (256, 0), 8: (-256, 51)}
    want = []
    for q in (0, 50):
        s = sorted(((-sum(a * b for a, b in zip(vec[q], vec[c])), c) for c in vec if c != q))[:5]
        want += [(q, i + 1, c, -x) for i, (x, c) in enumerate(s)]
    assert got == sorted(want)
    assert knn_join.top_k(df.limit(0)).count() == 0


def edits(a, b):
    """Fewest edits of ``a`` against any substring of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_decontaminate_against_brute_force(spark):
    rng = np.random.default_rng(3)
    items = [" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(12)) for _ in range(4)]
    texts = []
    for i, n in itertools.product(range(4), range(0, 8)):
        s = list(items[i])
        for _ in range(n):
            k = int(rng.integers(len(s)))
            s[k:k + 1] = [] if rng.random() < 0.3 else [chr(97 + int(rng.integers(26)))]
        texts.append((len(texts), "Before  " + "".join(s).upper() + "\nafter"))
    texts += [(100, None), (101, ""), (102, items[0][:20])]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(9, None), (10, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.leaks(docs(spark, texts), bench).collect()}
    want = set()
    for d, t in texts:
        for i, item in enumerate(items):
            e = edits(decontaminate.fold(item), decontaminate.fold(t))
            if e <= decontaminate.budget(item):
                want.add((d, i, e))
    assert got == want
    kept = {r["doc_id"] for r in decontaminate.clean(docs(spark, texts), bench).collect()}
    assert kept == {d for d, _ in texts} - {d for d, _, _ in want}


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_against_brute_force(spark, monkeypatch, percent):
    rng = np.random.default_rng(4)
    base = [sample_words(rng, 80) for _ in range(3)]
    texts = []
    for b in base:
        for _ in range(30):
            w = b.split()
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(len(w)))] = f"e{rng.integers(9999)}"
            texts.append(" ".join(w))
    texts += [None, "", "  ", "one two", "One  TWO", "one two three four five", base[0], base[0]]
    rows = list(enumerate(texts, 10))
    monkeypatch.setattr(near_dedup, "LEAF", 16)            # so that large nodes and blocks are exercised
    found = near_dedup.near_duplicates(docs(spark, rows), percent).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found}
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    for _ in range(len(sets)):
        for a, b in itertools.combinations(sets, 2):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                comp[a] = comp[b] = min(comp[a], comp[b])
        if all(comp[a] == comp[b] for a, b in itertools.combinations(sets, 2)
               if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])):
            break
    assert got == {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["", None, "It's a <|endoftext|> x0.y!!\x1c é İ. a<|startoftext|>b", "word " * 9000, "dup", "dup"]
    d = docs(spark, list(enumerate(odd))).unionByName(docs(spark, [(5, "dup")]))
    got = packing.pack(d).collect()
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [1] for i, x in enumerate(odd)}
    place = {}
    for r in got:
        part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert r["start"] == 4096 * r["piece"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        place.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert Counter(r["doc_id"] for r in got) == Counter({0: 1, 1: 1, 2: 1, 3: 3, 4: 1, 5: 2})
    for v in place.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 4096
    assert len(place) == -(-sum(r["length"] for r in got) // 4096)
    assert packing.fullest({5: 2, 3: 4}, [5, 3], 11) == [3, 3, 5] or sum(packing.fullest({5: 2, 3: 4}, [5, 3], 11)) == 11


def test_repeated_passages(spark):
    rng = np.random.default_rng(6)
    p, q = sample_words(rng, 70), sample_words(rng, 60)
    near = p.split()
    near[20] = "changed"
    del near[45]
    texts = [(1, sample_words(rng, 90) + " " + p + " " + sample_words(rng, 50)), (2, sample_words(rng, 40) + " " + p),
             (3, " ".join(near) + " " + sample_words(rng, 80)), (4, sample_words(rng, 200)), (5, q), (6, q.upper() + " " + q),
             (7, None), (8, ""), (9, sample_words(rng, 30) + " " + " ".join(p.split()[:30]))]
    got = substring_dedup.repeats(docs(spark, texts)).collect()
    assert {r["doc_id"] for r in got} == {2, 3, 6}
    for r in got:
        assert r["match_doc_id"] < r["doc_id"] and r["end_word"] - r["start_word"] >= 50
    left = {r["doc_id"]: r for r in substring_dedup.cut_repeats(docs(spark, texts)).collect()}
    assert len(left) == len(texts) and left[1]["text"] == texts[0][1] and left[4]["text"] == texts[3][1]
    assert left[2]["text"].split() == texts[1][1].split()[:40] and left[2]["n_chars"] == len(left[2]["text"])
    assert substring_dedup.repeats(docs(spark, [])).count() == 0


def test_two_passages_of_a_pair(spark):
    rng = np.random.default_rng(61)
    texts, want, n = [], {}, 0
    for first, apart, second in [(300, 60, 100), (300, 49, 60), (1000, 60, 300), (300, 400, 60), (150, 60, 60), (60, 30, 60)]:
        p, q = ([f"p{n}x{i}" for i in rng.permutation(k)] for k in (first, second))
        q = ["q" + w for w in q]
        for d in (0, 1):
            gap = [f"g{n}x{d}x{i}" for i in range(apart)]
            texts.append((n + d, " ".join(p + gap + q)))
        want[n + 1] = [(0, first), (first + apart, first + apart + second)]
        n += 10
    got = substring_dedup.repeats(docs(spark, texts)).collect()
    for doc, spans in want.items():
        hit = {w for r in got if r["doc_id"] == doc for w in range(r["start_word"], r["end_word"])}
        for s, e in spans:
            assert hit >= set(range(s, e)), (doc, s, e)


def test_passage_whose_parts_stand_elsewhere(spark):
    rng = np.random.default_rng(62)
    p = [f"p{i}" for i in range(60)]
    own = iter(range(10**6))
    pad = lambda n: [f"o{next(own)}" for _ in range(n)]
    parts = [p[:30], p[30:], p, p[:30], p[30:], p]
    texts = [(d + 1, " ".join(pad(int(rng.integers(5, 40))) + q + pad(30))) for d, q in enumerate(parts)]
    got = [r for r in substring_dedup.repeats(docs(spark, texts)).collect() if r["doc_id"] == 6]
    at = texts[5][1].split().index("p0")
    assert any(r["start_word"] <= at and r["end_word"] >= at + 60 and r["match_doc_id"] == 3 for r in got)
    # a seed twice in one document: both places meet the previous other document
    table = spark.createDataFrame([(1, 1, 0), (1, 2, 5), (1, 3, 0), (1, 3, 9)], "h long, doc long, pos int")
    got = {tuple(r) for r in substring_dedup.matches(table).collect()}
    assert got == {(2, 5, 1, 0), (3, 0, 1, 0), (3, 0, 2, 5), (3, 9, 1, 0), (3, 9, 2, 5)}


def test_edited_passage_whose_parts_stand_elsewhere(spark):
    # every seed of the last text's edited passage has other first and previous documents than the one that holds it whole
    p = [f"p{i}" for i in range(64)]
    edited = [*p[:16], "changed", *p[17:47], "again", *p[48:]]
    own = iter(range(10**6))
    pad = lambda n: [f"o{next(own)}" for _ in range(n)]
    parts = [p[:40], p[24:], p, p[:40], p[24:], edited]
    texts = [(d + 1, " ".join(pad(5 + 7 * d) + q + pad(30))) for d, q in enumerate(parts)]
    got = [tuple(r) for r in substring_dedup.repeats(docs(spark, texts)).collect()]
    assert got == [(6, 40, 104, 3, 19, 83, 2)]


def test_every_chain_is_covered(spark, monkeypatch):
    rng = np.random.default_rng(64)
    lines = [[f"l{k}x{i}" for i in range(int(rng.integers(14, 32)))] for k in range(12)]     # frequent lines
    texts = []
    for _ in range(40):
        t = [w for k in rng.integers(0, 12, 8).tolist() for w in lines[k]]
        texts.append([f"e{rng.integers(10**6)}" if rng.random() < 0.03 else w for w in t])
    texts += [texts[0], texts[5], texts[5]]
    monkeypatch.setattr(substring_dedup, "HOT_PAIRS", 3)
    rows = [(d, " ".join(t)) for d, t in enumerate(texts)]
    got = substring_dedup.repeats(docs(spark, rows)).collect()
    spans = [[(r["start_word"], r["end_word"]) for r in got if r["doc_id"] == d] for d in range(len(texts))]
    own: dict[int, list] = {}
    for r in substring_dedup.seeds(docs(spark, rows)).collect():
        own.setdefault(r["doc"], []).append((r["h"], r["pos"]))
    words = [np.array([hash(w) & 0xFFFFFFFF for w in t]) for t in texts]
    k, n = substring_dedup.K, 0
    for x in range(len(texts)):
        for y in range(x):
            both = sorted((a, b) for h, a in own[x] for g, b in own[y] if g == h)
            if not both:
                continue
            xs, ys = (np.array(v) for v in zip(*both, strict=True))
            for c in substring_dedup.chains(xs, ys):
                if len(c) > 1 and xs[c[-1]] - xs[c[0]] + k >= substring_dedup.SHORT and substring_dedup.align(
                        words[x], xs[c[0]], xs[c[-1]] + k, words[y], ys[c[0]], ys[c[-1]] + k, 50, 0.8):
                    n += 1
                    for i in c:
                        assert any(s <= xs[i] and e >= xs[i] + k for s, e in spans[x]), (x, y, xs[i])
    assert n > 20


def test_repeated_words_meet_by_what_stands_beside_them(spark):
    """Documents that repeat one word less than min_words times are no partners for that alone: no square of their places."""
    def rest(texts):
        table = substring_dedup.written(substring_dedup.seeds(docs(spark, texts)), "seeds")
        told = spark.createDataFrame([], ", ".join(f"{c} long" for c in substring_dedup.NAMES))
        return {(r["x"], r["y"]) for r in substring_dedup.rest(docs(spark, texts), table, told).collect()}

    own = [[f"u{d}x{i}" for i in range(40)] for d in range(24)]
    assert rest([(d, " ".join(["the"] * (30 + d % 15) + own[d])) for d in range(24)]) == set()
    # the same words beside the repeated ones, after an unequal one: partners
    tail = [f"t{i}" for i in range(5)]
    assert rest([(d, " ".join(["the"] * 46 + [f"v{d}"] + (tail if d in (3, 7) else []) + own[d])) for d in range(24)]) == {(7, 3)}


def test_every_chain_over_repeated_words_is_covered(spark):
    rng = np.random.default_rng(66)
    lines = [[f"l{k}x{i}" for i in range(int(rng.integers(10, 30)))] for k in range(4)]
    texts = []
    for d in range(30):
        t = []
        for i in range(6):
            n, w = int(rng.integers(8, 40)), int(rng.integers(3))
            t += [[f"w{w}"] * n, [f"w{w}", "and"] * (n // 2), lines[int(rng.integers(4))], [f"u{d}x{i}x{j}" for j in range(n // 6)]][int(rng.integers(4))]
        texts.append([f"e{rng.integers(10**6)}" if rng.random() < 0.02 else w for w in t])
    rows = [(d, " ".join(t)) for d, t in enumerate(texts)]
    got = substring_dedup.repeats(docs(spark, rows)).collect()
    spans = [[(r["start_word"], r["end_word"]) for r in got if r["doc_id"] == d] for d in range(len(texts))]
    own: dict[int, list] = {}
    for r in substring_dedup.seeds(docs(spark, rows)).collect():
        own.setdefault(r["doc"], []).append((r["h"], r["pos"]))
    words = [np.array([hash(w) & 0xFFFFFFFF for w in t]) for t in texts]
    k, n = substring_dedup.K, 0
    for x in range(len(texts)):
        for y in range(x):
            both = sorted((a, b) for h, a in own.get(x, []) for g, b in own.get(y, []) if g == h)
            if not both:
                continue
            xs, ys = (np.array(v) for v in zip(*both, strict=True))
            for c in substring_dedup.chains(xs, ys):
                if len(c) < 2 or xs[c[-1]] - xs[c[0]] + k < substring_dedup.SHORT:
                    continue
                breaks = np.frombuffer(substring_dedup.gaps(xs[c], ys[c]), "<i4").reshape(-1, 4)
                for start, end, *_ in substring_dedup.passages(words[x], xs[c[0]], xs[c[-1]] + k, words[y], ys[c[0]], ys[c[-1]] + k,
                                                               breaks, 50, 0.8):
                    n += 1
                    for i in c:
                        if start <= xs[i] and end >= xs[i] + k:
                            assert any(s <= xs[i] and e >= xs[i] + k for s, e in spans[x]), (x, y, xs[i])
    assert n > 5


def test_every_exact_repeat_is_covered(spark):
    rng = np.random.default_rng(63)
    lines = [[f"l{k}x{i}" for i in range(int(rng.integers(8, 40)))] for k in range(12)]      # frequent lines
    texts = [[w for k in rng.integers(0, 12, 12).tolist() for w in lines[k]] for _ in range(60)]
    first: dict[tuple, int] = {}
    got = substring_dedup.repeats(docs(spark, [(d, " ".join(t)) for d, t in enumerate(texts)])).collect()
    spans = [[(r["start_word"], r["end_word"]) for r in got if r["doc_id"] == d] for d in range(60)]
    n = 0
    for d, t in enumerate(texts):
        for i in range(len(t) - 49):
            if first.setdefault(tuple(t[i:i + 50]), d) < d:
                n += 1
                assert any(s <= i and e >= i + 50 for s, e in spans[d]), (d, i)
    assert n > 100


def test_chain_and_distance():
    x, y = np.array([0, 6, 12, 18, 300]), np.array([50, 56, 62, 68, 2])
    assert [len(c) for c in substring_dedup.chains(x, y)] == [4, 1]
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 4, rng.integers(0, 12)).tolist(), rng.integers(0, 4, rng.integers(0, 12)).tolist()
        row = list(range(len(b) + 1))
        for i, u in enumerate(a):
            new = [i + 1]
            for j, v in enumerate(b):
                new.append(min(row[j] + (u != v), row[j + 1] + 1, new[j] + 1))
            row = new
        assert substring_dedup.distance(a, b) == row[-1]


def test_chat_round_trip_and_parts(spark):
    for t in ["", "\\", "<|turn|>", "a\\\\<s>[INST]<</SYS>>", "<\\|", "[/INST</s>"]:
        assert chat_format.unescape(chat_format.escape(t)) == t
        assert not re.search(r"<\||</?s>|\[/?INST\]|<</?SYS>>", chat_format.escape(t))
    rows = [(1, 0, "user", "hi", [("image", None, "a.png", 600, 10, None, None), ("text", "<s>", None, None, None, None, None)]),
            (1, 1, "assistant", "ok <|end|>", None), (2, None, None, None, None), (1, 1, "assistant", "ok <|end|>", None)]
    schema = ("conv_id long, turn long, role string, text string, parts array<struct<type:string,text:string,ref:string,"
              "width:int,height:int,seconds:double,pages:int>>")
    out = chat_format.format_turns(spark.createDataFrame(rows, schema), "parts")
    first = out.where("conv_id = 1 and turn_index = 0").first()
    assert first["expanded_tokens"] == 512 and first["attachments"][0]["ref"] == "a.png" and "<|image|>" in first["segment"]
    back = {r["conv_id"]: r for r in chat_format.read_back(out.where("conv_id = 2 or turn_index > -1")).collect()}
    loss = "ok <|end|>" * 2
    assert back[1]["n_turns"] == 3 and back[1]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert back[2]["loss_chars"] == 0 and back[2]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest()


def test_hmm_scores(spark):
    rng = np.random.default_rng(2)
    texts = [(i, sample_words(rng, int(rng.integers(0, 700)), 60)) for i in range(30)] + [(30, None), (31, "New WORDS only"), (31, "")]
    got = hmm_lm.score(docs(spark, texts)).collect()
    count = Counter()
    for i, t in texts:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            count.update((t or "").lower().split() + [None])
    n, v = sum(count.values()), len(count)
    want = sorted((i, len((t or "").split()) + 1, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1)))
                                                      for w in (t or "").lower().split() + [None])) for i, t in texts)
    for (i, k, s), r in zip(want, sorted(got, key=lambda r: (r["doc_id"], r["n_tokens"], r["base_score"])), strict=True):
        assert (r["doc_id"], r["n_tokens"], r["train_tokens"]) == (i, k, n) and abs(r["base_score"] - s) < 1e-6
        assert math.isfinite(r["score"]) and r["score"] <= 0


def test_hmm_likelihood_is_exact():
    rng = np.random.default_rng(0)
    pi, a, b = hmm_lm.normalise(rng.random(3), rng.random((3, 3)), rng.random((3, 9)))
    seqs = [rng.integers(0, 9, n) for n in (1, 7, 256, 257, 900)]
    for s, got in zip(seqs, hmm_lm.log_likelihoods((pi, a, b), seqs), strict=True):
        v, want = pi * b[:, s[0]], 0.0
        for o in s[1:]:
            want, v = want + math.log10(v.sum()), (v / v.sum()) @ a * b[:, o]
        assert abs(got - want - math.log10(v.sum())) < 1e-6


def test_license_wrapped_headers_and_all_document_lines(spark):
    apache = """/*
 * Copyright 2015 Someone
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */"""
    gpl = """# This program is free software; you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation; either version 2 of the License, or
# (at your option) any later version."""
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission."""
    texts = [(1, apache), (2, gpl), (3, bsd), (4, "Some line.\nAll rights reserved.\nmore"), (5, bsd.split("3. ")[0]),
             (6, "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy"),
             (7, "all rights were reserved by none")]
    got = {(r["doc_id"], r["license"], r["n_matches"]) for r in licenses.scan(docs(spark, texts)).collect()}
    assert got == {(1, "Apache-2.0", 1), (2, "GPL-2.0-or-later", 1), (3, "BSD-3-Clause", 1),
                   (4, "LicenseRef-all-rights-reserved", 1), (5, "BSD-2-Clause", 1), (6, "MPL-2.0", 1)}
    for s in licenses.SENTENCES.values():
        assert licenses.marked(licenses.normal(s)) in licenses.normal(s)
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    lines = d.where(F.col("text").rlike("(?m)^All rights reserved\\.?$")).select("doc_id").distinct().count()
    found = licenses.scan(d).where("license = 'LicenseRef-all-rights-reserved'").select("doc_id").distinct().count()
    assert found >= lines > 0


def test_license_rules(spark):
    full = " ".join(licenses.SENTENCES[k] + "." for k in ("ApacheNotice", "ApacheUse", "ApacheCopy", "ApacheAsIs", "ApacheLimits"))
    texts = [(1, "x\n" + full + "\ny"), (2, "LICENSED under the  Apache License, Version 2.0.\nReleased under the MIT License."),
             (3, None), (4, ""), (5, licenses.SENTENCES["GplHope"]), (6, "no licence here"), (2, "Released under the MIT License.")]
    got = sorted((r["doc_id"], r["license"], r["n_matches"], r["n_sentences"]) for r in licenses.scan(docs(spark, texts)).collect())
    assert got == [(1, "Apache-2.0", 1, 5), (2, "Apache-2.0", 1, 2), (2, "MIT", 1, 1), (2, "MIT", 1, 2), (5, "unrecognised", 0, 1)]


def test_toxicity_chain(spark):
    rng = np.random.default_rng(9)
    texts, marks = [], []
    for i in range(240):
        bad = i % 6 == 0
        texts.append((i, sample_words(rng, 40) + (" vilething rot" + "abc"[i % 3] if bad else "")))
        if i < 180:
            marks.append((i, 1, int(bad)))
    labels = spark.createDataFrame(marks + [(0, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"] for r in toxicity.flagged(docs(spark, texts + [(900, None), (901, "")]), labels).collect()}
    bad = {i for i in range(240) if i % 6 == 0}
    assert bad <= got and len(got - bad) <= 2 and not got & {900, 901}
    assert toxicity.flagged(docs(spark, texts), labels.limit(0)).count() == 0


def test_pipeline_small(spark):
    import corpus_pipeline
    from fundlens.llm import queries
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert got and max(r["offset"] + r["length"] for r in got) <= 4096
    assert len(queries.queries()) == 13 and 4 <= len(corpus_pipeline.STAGES) <= 5
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        d2 = f(spark, d, "/root/testdata/sf0.001")
        assert d2.columns == d.columns
        d = d2


@pytest.mark.parametrize("name", ["op2_top_k", "op4_near_dedup", "op7_chat_format", "op9_license_scan"])
def test_sql(spark, name):
    import duckdb
    from fundlens.llm import queries
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    cols = sorted(x[0] for x in cur.description)
    want = sorted(tuple(dict(zip([x[0] for x in cur.description], r))[c] for c in cols) for r in cur.fetchall())
    got = queries.queries()[name](spark, "/root/testdata/sf0.001")
    assert sorted(got.columns) == cols and sorted(tuple(r[c] for c in cols) for r in got.collect()) == want


def test_word_ids_equal_the_tokenizers():
    import random
    import public_tokenizers
    from fundlens.llm import common
    tok = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    rnd = random.Random(3)
    texts = ["", "  ", " a  b ", "x\x1cy z\x1f", "Straße ÉCOLE! İstanbul 00 a0b 0", "<|endoftext|> a<|startoftext|>b", "ΣΑΣ.",
             "don't I'LL 's!", "école É!", "漢字 テスト。", "a　b c\x85d", "!!! a!! !a", "ß ẞ Å.", "a\x00b \x0bq\x0c"]
    texts += ["".join(rnd.choices("aBc0É!.'<|>ß \x85\x1c$sT", k=rnd.randint(0, 25))) for _ in range(500)]
    for part in (texts[:3], texts[3:20], texts[20:]):
        assert tok.ids_of(pa.array(part, pa.large_string())) == [tok.encode(t) for t in part]
    common.only_kept_by(packing.__name__)
    assert packing.__name__ in common.KEPT
    common.only_kept_by("another")
    assert not common.KEPT


def test_id_bitmap_comes_before_the_shuffle(spark):
    from fundlens.llm import common
    rows = spark.createDataFrame([(i % 50 if i else None, f"t{i}") for i in range(200)], "id long, t string").select("t", "id")
    ids = spark.createDataFrame([(3,), (3,), (7,), (None,), (900,)], "id long")
    got = common.only_ids(rows, "id", ids)
    assert got.columns == ["t", "id"] and sorted(r["id"] for r in got.collect()) == [3] * 4 + [7] * 4
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = common.only_ids(rows, "id", ids)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert 0 <= plan.index("SortMergeJoin") < plan.index("BroadcastHashJoin")      # the bitmap is below the exact join
