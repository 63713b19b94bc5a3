"""Alignment of two tokenizers' token sequences, with corpus-wide counts of linked id pairs.

Each text is encoded by a byte-level BPE (A; a space is put before the text) and by a piece BPE (B;
it adds that space itself). Both token sequences cover the same bytes, so a token of one and a token
of the other are linked if their byte ranges overlap, and places where both end a token cut the
sequences into groups. A text whose tokens do not give back its bytes on either side has none.

How many documents hold an id pair linked is counted with a minimal perfect hash:

1. a first pass aligns all documents and writes which pairs each holds, some hundred documents a row
   (the pairs and how many of those documents hold them). Its distinct pairs are cut into parts of
   whole A ids of at most ``PAIRS`` pairs;
2. for each part a minimal perfect hash, built from its sorted keys: levels of bit arrays in which
   a key that shares its bit with no other stays, the others go on; a key's slot is the rank of its
   bit. The keys are kept by slot, so a lookup verifies what it finds;
3. every task adds the written counts up in a dense vector indexed by slot; the vectors, in blocks,
   are summed in a tree of ``TREE`` vectors at a time;
4. a second pass aligns the documents again and looks their pairs up.

What the driver broadcasts is one part: at most ``PAIRS`` keys, counts and the bit arrays, whatever
the corpus; further parts (at the very most 192, as there are 50,257 x 32,000 pairs) are further passes.

The texts are encoded whole, by B word by word. The alignment of a chunk of documents is array arithmetic over the
places where their tokens end: between two neighbouring ends lies one link.

Cases: null and empty texts have no tokens: zeros and '' as digest; rows that share a doc_id are
documents of their own, also in the counts; control strings of the tokenizers inside texts are plain
text; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundlens.llm.bytewords import U, mix
from fundlens.llm.common import KEPT, byte_chunks, key_runs, map_arrow, partitions, written

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
PAIRS = 1 << 23            # pairs of a part
BLOCK = 1 << 16            # counts in a block of a vector
TREE = 32                  # vectors summed at once
BYTES_AT_ONCE = 1 << 21
SHIFT = U(32)


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1
    characters stand for themselves, the other bytes for characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Tokenizers:
    """Both tokenizers, and the bytes and the decimal ids of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        table = byte_of()
        vocab = json.loads(Path(a_path).read_text())["model"]["vocab"]
        ranks = {bytes(table[c] for c in t): i for t, i in vocab.items() if all(c in table for c in t)}
        special = {t["content"] for t in json.loads(Path(a_path).read_text())["added_tokens"]}
        ranks = {t: i for t, i in ranks.items() if t.decode(errors="replace") not in special}
        # the ids of this vocabulary are its merge ranks, so this encoder gives the ids of the file's own rules
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        if any(re.search("[^\u2581]\u2581", self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())):
            raise ValueError("a piece goes on over a space: words cannot be encoded one by one")
        of = {i: t for t, i in ranks.items()}
        self.a_bytes = pa.array([of.get(i, b"") for i in range(max(of) + 1)], pa.large_binary())
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = pa.array([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode()
                                 for i, p in enumerate(pieces)], pa.large_binary())
        # by 2 x id: the id with what follows it inside a group, and (+ 1) at the end of its side of a group
        self.a_text, self.b_text = (pa.array([f"{i}{c}".encode() for i in range(n) for c in (",", end)], pa.large_binary())
                                    for n, end in ((len(self.a_bytes), "|"), (len(pieces), ";")))
        self.a_size, self.b_size = (np.array([len(t.as_py()) for t in x]) for x in (self.a_bytes, self.b_bytes))

    def encode_b(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """B's ids end to end, and how many each text has. No piece goes on over a space, so words between
        single spaces are encoded one by one, each distinct one once; other texts are one word."""
        words = [[] if not t else [t] if "  " in t or t[0] == " " or t[-1] == " " else t.split(" ") for t in texts]
        place = {w: i for i, w in enumerate(dict.fromkeys(itertools.chain.from_iterable(words)))}
        ids, size = flat(self.b.encode(list(place), num_threads=1))
        first = np.cumsum(size) - size
        codes = [np.fromiter(map(place.__getitem__, w), np.int64, len(w)) for w in words]
        counts = np.array([size[c].sum() for c in codes], np.int64)
        all_ = np.concatenate([np.zeros(0, np.int64), *codes])
        return ids[spread(size[all_], first[all_])], counts


def tokenizers(a_file: str, b_file: str) -> Tokenizers:
    import public_tokenizers
    paths = tuple(f if os.sep in f else public_tokenizers.path(f) for f in (a_file, b_file))
    known = KEPT.setdefault(__name__, {})
    if paths not in known:
        known[paths] = Tokenizers(*paths)
    return known[paths]


def flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids end to end, and how many each list has."""
    size = np.array([len(x) for x in ids], np.int64)
    return np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(size.sum())), size


def spread(counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, .. (counts[0] numbers), first[1], .. and so on."""
    return np.arange(counts.sum()) + np.repeat(first - (np.cumsum(counts) - counts), counts)


def taken(values: pa.Array, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated bytes of ``values[at]`` and their n+1 offsets."""
    got = values.take(pa.array(at))
    off = np.frombuffer(got.buffers()[1], np.int64)[:len(got) + 1]
    return np.frombuffer(got.buffers()[2] or b"", np.uint8)[:off[-1]], off


class Chunk:
    """Alignments of some documents: token, group and link numbers, and the distinct linked pairs of
    each document (``doc``, ``key`` and how often, ``times``), by document and key."""

    def __init__(self, tk: Tokenizers, texts: list[str | None]):
        self.tk, raw = tk, [(" " + t).encode() if t else b"" for t in texts]
        self.a, self.n_a = flat([tk.a.encode_ordinary(" " + t) if t else [] for t in texts])
        self.b, self.n_b = tk.encode_b(texts)
        data, off = taken(tk.b_bytes, self.b)                        # A's bytes are the text's by its construction
        at = off[np.cumsum([0, *self.n_b])].tolist()
        odd = np.array([data[x:y].tobytes() != r for r, (x, y) in zip(raw, itertools.pairwise(at), strict=True)], bool)
        if odd.any():                                                # tokens that do not give the bytes back count as none
            self.a, self.b = self.a[~np.repeat(odd, self.n_a)], self.b[~np.repeat(odd, self.n_b)]
            self.n_a, self.n_b = self.n_a * ~odd, self.n_b * ~odd
            raw = [b"" if o else r for o, r in zip(odd, raw, strict=True)]
        last = np.cumsum([0, *map(len, raw)])                        # all documents' bytes end to end
        ends = np.zeros((2, int(last[-1])), bool)                    # the last bytes of tokens
        ends[0, np.cumsum(tk.a_size[self.a]) - 1] = ends[1, np.cumsum(tk.b_size[self.b]) - 1] = True
        link = np.flatnonzero(ends[0] | ends[1])                     # each ends a link
        both = ends[:, link]
        at = np.cumsum(both, axis=1) - both                          # the tokens that hold these bytes
        cut = both.all(axis=0)                                       # both tokens end: so does a group
        self.cut_a, self.cut_b = at[0, cut], at[1, cut]
        until = np.searchsorted(link, last)
        self.n_links, self.n_groups = np.diff(until), np.diff(np.concatenate([[0], np.cumsum(cut)])[until])
        doc = np.repeat(np.arange(len(raw)), self.n_links)
        keys = self.a[at[0]] << 16 | self.b[at[1]]
        both, self.times = np.unique(doc.astype(U) << SHIFT | keys.astype(U), return_counts=True)
        self.doc, self.key = (both >> SHIFT).astype(np.int64), (both & U(0xFFFFFFFF)).astype(np.uint32)

    def digests(self) -> list[str]:
        """Of each document, the digest of its groups as text ('' without tokens)."""
        cut_a, cut_b = self.cut_a, self.cut_b                        # last tokens of the groups
        code_a, code_b = 2 * self.a, 2 * self.b
        code_a[cut_a] += 1
        code_b[cut_b] += 1
        # a group's A tokens come after the B tokens of the groups before, its B tokens after its A tokens
        place_a = np.arange(len(code_a)) + np.repeat(np.concatenate([[0], cut_b + 1])[:-1], np.diff(cut_a, prepend=-1))
        place_b = np.arange(len(code_b)) + np.repeat(cut_a + 1, np.diff(cut_b, prepend=-1))
        order = np.zeros(len(code_a) + len(code_b), np.int64)
        order[place_a], order[place_b] = code_a, code_b + 2 * len(self.tk.a_bytes)
        data, off = taken(pa.concat_arrays([self.tk.a_text, self.tk.b_text]), order)
        at = off[np.cumsum(np.concatenate([[0], self.n_a + self.n_b]))].tolist()
        data = memoryview(np.ascontiguousarray(data))
        return [hashlib.sha256(data[x:y - 1]).hexdigest() if y > x else "" for x, y in itertools.pairwise(at)]


def chunks(b: pa.RecordBatch, tk: Tokenizers) -> Iterator[tuple[int, int, Chunk]]:
    for i, j, _, _ in byte_chunks(b.column("text"), BYTES_AT_ONCE):
        yield i, j, Chunk(tk, b.column("text").slice(i, j - i).to_pylist())


def held_pairs(docs: DataFrame, files: tuple[str, str]) -> DataFrame:
    """(keys, counts): of some documents a row, the id pairs linked in them (A id x 2^16 + B id, ascending)
    and how many of the documents hold each, little-endian unsigned 32-bit."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk = tokenizers(*files)
        for b in batches:
            for _, _, c in chunks(b, tk):
                keys, counts = np.unique(c.key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([x.astype("<u4").tobytes()], pa.binary()) for x in (keys, counts)],
                                                 names=["keys", "counts"])

    return map_arrow(docs.select("text"), work, "keys binary, counts binary")


def distinct_pairs(held: DataFrame) -> DataFrame:
    """(key): every id pair that is linked in a document."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint32)
        for b in batches:
            for k in b.column("keys"):
                seen = np.union1d(seen, np.frombuffer(k.as_buffer(), "<u4"))
                if len(seen) > PAIRS // 8:
                    yield rows(seen)
                    seen = seen[:0]
        yield rows(seen)

    def rows(keys: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64))], names=["key"])

    return map_arrow(held.select("keys"), work, "key long").distinct()


class PerfectHash:
    """Minimal perfect hash of distinct keys: slots 0..n-1, verified by the keys kept there."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []     # bits as words, keys before each word
        rest, before = keys, 0
        while len(rest):
            size = -(-2 * len(rest) // 64) * 64
            bit = self.bit(rest, len(self.levels), size)
            alone = np.bincount(bit, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            ones = np.bitwise_count(words).astype(np.int64)
            self.levels.append((words, before + np.cumsum(ones) - ones))
            before += int(ones.sum())
            rest = rest[~alone[bit]]
        self.keys = np.zeros(len(keys), np.uint32)
        self.keys[self.slots(keys, verify=False)] = keys

    @staticmethod
    def bit(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(keys.astype(U) + U(level + 1) * U(0x9E3779B97F4A7C15)) % U(size)).astype(np.int64)

    def slots(self, keys: np.ndarray, verify: bool = True) -> np.ndarray:
        """The slot of each key; -1 if it is not one of those hashed (``verify``)."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (words, before) in enumerate(self.levels):
            bit = self.bit(keys[open_], level, 64 * len(words))
            word, mask = words[bit >> 6], U(1) << (bit & 63).astype(U)
            hit = word & mask != 0
            out[open_[hit]] = before[bit[hit] >> 6] + np.bitwise_count(word[hit] & (mask[hit] - U(1)))
            open_ = open_[~hit]
        if verify and len(out):
            found = out >= 0
            found[found] = self.keys[out[found]] == keys[found]
            out[~found] = -1
        return out


def parts(pairs: DataFrame, most: int = PAIRS) -> list[tuple[int, int]]:
    """Ranges [from, to) of A ids that hold at most ``most`` pairs each (one A id alone may hold more: as
    many as B has ids)."""
    by_a = pairs.groupBy(F.shiftright("key", 16).alias("a")).count().collect()     # at most one row an A id
    out, start, n = [], 0, 0
    for r in sorted(by_a, key=lambda r: r["a"]):
        if n and n + r["count"] > most:
            out.append((start, r["a"]))
            start, n = r["a"], 0
        n += r["count"]
    return [*out, (start, 1 << 16)] if n else []


def summed(vectors: DataFrame) -> DataFrame:
    """(block, counts) with the vectors of each block added up in a tree: each step sums some TREE of them."""
    schema = "block int, task long, counts binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_runs(batches, ["block", "group"]):
            total = np.zeros(BLOCK, np.int64)
            for c in t.column("counts"):
                total += np.frombuffer(c.as_buffer(), "<i8")
            yield pa.RecordBatch.from_arrays([t.column("block").combine_chunks()[:1], t.column("group").combine_chunks()[:1],
                                              pa.array([total.tobytes()], pa.binary())], names=["block", "task", "counts"])

    n = vectors.groupBy("block").count().agg(F.max("count")).first()[0] or 0
    while n > 1:
        n = -(-n // TREE)
        grouped = vectors.select("block", F.pmod(F.xxhash64("task"), F.lit(n)).cast("long").alias("group"), "counts")
        vectors = written(map_arrow(grouped.repartition(partitions(grouped.sparkSession), "block", "group")
                                    .sortWithinPartitions("block", "group"), work, schema), "vectors")
    return vectors.select("block", "counts")


def document_counts(held: DataFrame, hashed) -> DataFrame:
    """(block, counts) of the dense vector: by slot, how many documents hold the pair linked."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ph = hashed.value
        total = np.zeros(-(-len(ph.keys) // BLOCK) * BLOCK, np.int64)
        for b in batches:
            for keys, counts in zip(b.column("keys"), b.column("counts"), strict=True):
                slot = ph.slots(np.frombuffer(keys.as_buffer(), "<u4"))
                here = slot >= 0
                total[slot[here]] += np.frombuffer(counts.as_buffer(), "<u4")[here]      # a row has a key once
        blocks = total.reshape(-1, BLOCK)
        for i in np.flatnonzero(blocks.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int64()),
                 pa.array([blocks[i].tobytes()], pa.binary())], names=["block", "task", "counts"])

    return summed(written(map_arrow(held, work, "block int, task long, counts binary"), "vectors"))


def looked_up(docs: DataFrame, tables, files: tuple[str, str]) -> DataFrame:
    """The result's rows, with links counted whose A id is in the part at hand."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk = tokenizers(*files)
        for b in batches:
            for i, j, c in chunks(b, tk):
                best, total = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
                if tables is not None:
                    ph, counts, highest = tables.value
                    slot = ph.slots(c.key)
                    here = slot >= 0
                    slot, doc, times = slot[here], c.doc[here], c.times[here]
                    np.add.at(total, doc, times * counts[slot])
                    np.add.at(best, doc, times * highest[slot])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), *[pa.array(x, pa.int64()) for x in (c.n_a, c.n_b, c.n_groups, c.n_links, best, total)],
                     pa.array(c.digests(), pa.string())], names=names)

    return map_arrow(docs.select("doc_id", "text"), work, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, "
                                                          f"n_best long, count_sum long, groups_sha256 string")


def align(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, most: int = PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    files, sc = (a_file, b_file), docs.sparkSession.sparkContext
    held = written(held_pairs(docs, files), "held")
    pairs, found = written(distinct_pairs(held), "pairs"), []
    for start, end in parts(pairs, most):
        part = pairs.where((F.col("key") >= start << 16) & (F.col("key") < end << 16)).select("key")
        keys = np.sort(part.toArrow().column(0).to_numpy().astype(np.uint32))       # at most ``most``, or one A id's
        ph = PerfectHash(keys)
        counts = np.zeros(-(-len(keys) // BLOCK) * BLOCK, np.int64)
        for r in document_counts(held, sc.broadcast(ph)).collect():            # 8 bytes a key
            counts[r["block"] * BLOCK:][:BLOCK] = np.frombuffer(r["counts"], "<i8")
        counts, a = counts[:len(keys)], (ph.keys >> np.uint32(16)).astype(np.int64)
        most_of = np.zeros(1 << 16, np.int64)
        np.maximum.at(most_of, a, counts)
        found.append(looked_up(docs, sc.broadcast((ph, counts, counts == most_of[a])), files))
    if len(found) <= 1:
        return found[0] if found else looked_up(docs, None, files)
    # a row has its links counted part by part; rows alike in all columns below are alike in every part
    rows = found[0]
    for df in found[1:]:
        rows = rows.unionByName(df)
    same = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    return (rows.groupBy(*same).agg(F.sum("n_best").alias("n"), F.sum("count_sum").alias("s"), (F.count("*") / len(found)).cast("int").alias("copies"))
            .select(*same, F.expr("n div copies").alias("n_best"), F.expr("s div copies").alias("count_sum"),
                    F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))
