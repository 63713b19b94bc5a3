"""Sequence packing by minimum bin slack.

Tokenise whole documents, cut only those longer than a sequence, and fill sequences one by
one: the longest piece left goes in, a bitset subset-sum over the lengths still available
finds the fullest feasible rest, and that combination leaves the pool. Combinations depend on
lengths alone, so the search runs on the histogram of piece lengths (at most ``capacity``
numbers, whatever the corpus), and a combination is used as often as its lengths last. Pieces
then take their places by length and rank, distributed.

Cases: null text counts as empty and becomes its end id alone; rows with equal doc_id are
packed each on its own; equal lengths take places in (doc_id, piece) order inside their salt
bucket; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundlens.llm.common import KEPT, byte_chunks, map_arrow, written

CAPACITY = 4096
END_ID = 1
SALTS = 64
WORDS_KEPT = 1_000_000   # bound of a worker's table of known words; then it starts anew
# every white-space character the tokenizer's own rule takes; str.split() has four more
GAP = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
ODD_SPACE = "[\x1c-\x1f]"
MARK = "0"             # a digit is a piece, and an id, of its own
TRAILING = ".,!?;:*$%&#|"
BYTES_AT_ONCE = 1 << 22   # whole texts of about so many bytes are tokenised together


class WordTokenizer:
    """Ids of whole texts, word by word, with the ids of known words kept in the worker.

    The tokenizer never joins pieces across white space, so a text's ids are those of its
    words in order; ``ids`` equals ``encode(text, add_special_tokens=False)``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known = KEPT.setdefault(__name__, {})   # by tokenizer file: (tokenizer, {word: ids as little-endian bytes})
        if path not in known:
            from tokenizers import Tokenizer
            known[path] = (Tokenizer.from_file(path), {})
        self.tokenizer, self.words = known[path]
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids[0]

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, new: list[str]) -> None:
        """Ids of new words. The tokenizer lower-cases and makes trailing ASCII punctuation after a
        letter a piece of its own, so words of Latin letters (which stay one letter in lower case)
        are put together from lower-case stem and tail; the others are encoded as they are. What is
        left is encoded many at a time, between marks that are sure to be one id and in none of them."""
        words, whole, joined = self.words, {}, []
        for w in new:
            if (w.isascii() or max(w) < "\u0250" and "\u0130" not in w) and "<|" not in w:
                stem = w.rstrip(TRAILING)
                if not stem or not stem[-1].isalpha():
                    stem = w
                low, tail = stem.lower(), w[len(stem):]
                if low != w:
                    joined.append((w, low, tail))
                    if tail:
                        whole[tail] = None
                whole[low] = None
            else:
                whole[w] = None
        odd = [w for w in whole if w not in words and (MARK in w or "<|" in w)]
        for w in odd:
            words[w] = self.encode(w)
        plain = [w for w in whole if w not in words]
        for i in range(0, len(plain), 1024):
            part = plain[i:i + 1024]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {MARK} ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(ids == self.mark)
            raw = ids.tobytes()
            for w, a, b in zip(part, [0, *(at + 1).tolist()], [*at.tolist(), len(ids)], strict=True):
                words[w] = raw[4 * a:4 * b]
        for w, low, tail in joined:
            words[w] = words[low] + words[tail] if tail else words[low]

    def split(self, texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
        """(n+1 word offsets, the words by dictionary) of n texts; a word may be empty."""
        odd = pc.match_substring_regex(texts, ODD_SPACE)
        if pc.any(odd).as_py():
            parts = [GAP.split(t) for t in texts.to_pylist()]
            at = np.cumsum([0, *map(len, parts)])
            return at, pa.array([w for p in parts for w in p], pa.large_string()).dictionary_encode()
        lists = pc.utf8_split_whitespace(texts)
        return np.asarray(lists.offsets) - lists.offsets[0].as_py(), lists.flatten().dictionary_encode()

    def ids_of(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text (large_string, no nulls), little-endian unsigned 32-bit. Each
        distinct word is looked up once; Arrow then puts its ids wherever it stands."""
        at, coded = self.split(texts)
        distinct, words = coded.dictionary.to_pylist(), self.words
        new = [w for w in distinct if w and w not in words]
        if len(words) + len(new) > WORDS_KEPT:
            words.clear()
            new = [w for w in distinct if w]
        words[""] = b""
        self.learn(new)
        ids = pa.array([words[w] for w in distinct], pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[:len(ids) + 1][at].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        return [bytes(data[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        tok = WordTokenizer(public_tokenizers.path(path) if os.sep not in path else path)
        end = np.array([END_ID], "<u4").tobytes()
        for b in batches:
            rows, out = [], []
            texts = b.column("text").cast(pa.large_string()).fill_null("")
            for i, j, _, _ in byte_chunks(texts, BYTES_AT_ONCE):
                for n, raw in enumerate(tok.ids_of(texts.slice(i, j - i))):
                    raw += end
                    for k, a in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[a:a + 4 * capacity]
                        rows.append(i + n)
                        out.append((k, a // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.int32()),
                 *[pa.array(c, pa.int64()) for c in cols[1:]]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(docs.select("doc_id", "text"), work,
                     f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[int]:
    """A multiset of available lengths with the largest sum not over ``room``, longest first.

    Bitset subset sum: bit s of ``reach`` says that sum s can be made from the lengths seen so
    far; multiplicities go in as powers of two. ``lengths`` is descending.
    """
    reach, limit = 1, (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []  # (length, copies, reach before)
    for x in lengths:
        if x > room:
            continue
        left, copies = min(counts[x], room // x), 1
        while left > 0:
            take = min(copies, left)
            grown = (reach | reach << (x * take)) & limit
            if grown != reach:
                steps.append((x, take, reach))
                reach = grown
            left -= take
            copies *= 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, []
    for x, take, before in reversed(steps):
        if not before >> total & 1:
            out.extend([x] * take)
            total -= x * take
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """[(lengths of one sequence, how many such sequences)] using up the histogram exactly."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    out = []
    lengths = sorted(counts, reverse=True)
    while lengths:
        longest = lengths[0]
        counts[longest] -= 1
        rest = fullest(counts, lengths, capacity - longest)
        counts[longest] += 1
        combo = [longest, *rest]
        uses: dict[int, int] = {}
        for x in combo:
            uses[x] = uses.get(x, 0) + 1
        times = min(counts[x] // n for x, n in uses.items())
        for x, n in uses.items():
            counts[x] -= n * times
        out.append((combo, times))
        if any(not counts[x] for x in uses):
            lengths = [x for x in lengths if counts[x]]
    return out


def place(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces. The rank inside a length is counted per (length,
    salt) and shifted by the salt's start, so one common length is not one task."""
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("n")).collect()  # <= capacity x SALTS rows
    histogram: dict[int, int] = {}
    first = np.zeros((capacity + 1, SALTS), np.int64)
    for r in sorted(counts, key=lambda r: (r["length"], r["_salt"])):
        first[r["length"], r["_salt"]] = histogram.get(r["length"], 0)
        histogram[r["length"]] = histogram.get(r["length"], 0) + r["n"]
    # by length: runs of ranks that share a combination: (first rank, slot in it, first id, per sequence, offset)
    slots: dict[int, list[tuple[int, int, int, list[int]]]] = {}
    used: dict[int, int] = {}
    base = 0
    for combo, times in plan(histogram, capacity):
        at, offsets = 0, {}
        for x in combo:
            offsets.setdefault(x, []).append(at)
            at += x
        for x, offs in offsets.items():
            slots.setdefault(x, []).append((used.get(x, 0), base, len(offs), offs))
            used[x] = used.get(x, 0) + len(offs) * times
        base += times
    starts = {x: np.array([s[0] for s in v]) for x, v in slots.items()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, salt = b.column("length").to_numpy(), b.column("_salt").to_numpy()
            rank = b.column("_rank").to_numpy() - 1 + first[length, salt]
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for i, (x, r) in enumerate(zip(length.tolist(), rank.tolist(), strict=True)):
                r0, seq0, per, offs = slots[x][int(np.searchsorted(starts[x], r, side="right")) - 1]
                seq[i], off[i] = seq0 + (r - r0) // per, offs[(r - r0) % per]
            keep = [b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = salted.withColumn("_rank", F.row_number().over(
        Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")).cast("long"))
    kind = parts.schema["doc_id"].dataType.simpleString()
    return map_arrow(ranked, work, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, "
                                   f"sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its place; see the module for the cases."""
    return place(written(pieces(docs, tokenizer, capacity), "pieces"), capacity)
