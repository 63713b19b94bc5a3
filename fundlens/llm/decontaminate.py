"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may occur in a text with up to e = floor(m * rate) edits. Cut into
e + 1 pieces, at least one piece must occur exactly, so an Aho-Corasick automaton over all
pieces finds the candidates and Myers' bit-parallel algorithm verifies the surrounding text
(approximate substring matching, exact distances).

Texts and items are compared lower-cased with runs of white space as one space. Items come in
blocks of bounded size (``BLOCK_CHARS``); every block is held against all whole documents, so
nothing of unbounded size is broadcast. Cases: null or empty texts match nothing; items with
fewer than ``min_chars`` characters carry no signal and take no part; repeated rows keep their
multiplicity; repeated items give a row per item_id; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundlens.llm.common import map_arrow

RATE = 0.05
MIN_CHARS = 20
BLOCK_CHARS = 4_000_000


def fold(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def budget(item: str, rate: float = RATE) -> int:
    return int(len(item) * rate)


def cut(item: str, n: int) -> list[tuple[int, str]]:
    """``item`` in n pieces of nearly equal length: (place, piece)."""
    ends = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:], strict=False) if b > a]


def myers(pattern: str, text: str, most: int, masks: dict[str, int]) -> tuple[int, int] | None:
    """(edits, end) of the best occurrence of ``pattern`` inside ``text`` with at most ``most``
    edits; the first end among equals. ``masks`` are the pattern's character bit masks."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for j, ch in enumerate(text):
        eq = masks.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full      # a match may begin anywhere
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
            if not score:
                break
    return best


class Matcher:
    """The pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick
        self.items = items
        self.masks: dict[int, dict[str, int]] = {}
        self.auto = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for i, (_, item) in enumerate(items):
            for place, piece in cut(item, budget(item, rate) + 1):
                at.setdefault(piece, []).append((i, place))
        for piece, uses in at.items():
            self.auto.add_word(piece, (len(piece), uses))
        if at:
            self.auto.make_automaton()
        self.most = [budget(item, rate) for _, item in items]

    def mask(self, i: int) -> dict[str, int]:
        if i not in self.masks:
            out: dict[str, int] = {}
            for k, ch in enumerate(self.items[i][1]):
                out[ch] = out.get(ch, 0) | 1 << k
            self.masks[i] = out
        return self.masks[i]

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item, fewest edits, end in the folded text) for each item that occurs."""
        best: dict[int, tuple[int, int]] = {}
        seen: dict[int, int] = {}
        if not self.most:
            return []
        for end, (size, uses) in self.auto.iter(text):
            for i, place in uses:
                if best.get(i, (1,))[0] == 0:
                    continue
                start = end + 1 - size - place      # where the item would begin without edits
                if seen.get(i) == start:
                    continue                        # the same alignment, told by another piece
                seen[i] = start
                item, most = self.items[i][1], self.most[i]
                if text.startswith(item, start) and start >= 0:
                    best[i] = (0, start + len(item))
                    continue
                lo = max(0, start - most)
                hit = myers(item, text[lo:start + len(item) + most], most, self.mask(i))
                if hit and (i not in best or hit[0] < best[i][0]):
                    best[i] = (hit[0], lo + hit[1])
        return [(i, e, end) for i, (e, end) in sorted(best.items())]


def item_blocks(benchmark: DataFrame, min_chars: int) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        item = fold(r["text"])
        if len(item) < min_chars:
            continue
        block.append((r["item_id"], item))
        size += len(item)
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, item_id, edits, end): a row for each document and item that occurs in it;
    ``end`` is in the folded text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, edits int, end long"
    src = docs.select("doc_id", "text").where("text is not null")

    def against(block):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = Matcher(block, rate)
            for b in batches:
                rows, hits = [], []
                for i, text in enumerate(b.column("text")):
                    for item, edits, end in m.find(fold(text.as_py())):
                        rows.append(i)
                        hits.append((block[item][0], edits, end))
                cols = list(zip(*hits, strict=True)) if hits else [[], [], []]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(cols[0], item_type),
                     pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64())],
                    names=["doc_id", "item_id", "edits", "end"])
        return map_arrow(src, work, schema)

    item_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[item_kind]
    out = None
    for block in item_blocks(benchmark, min_chars):
        part = against(block)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without the rows in which a benchmark item occurs. Rows are judged one by one,
    so null and repeated ids need no care; each block of items is one more filter."""
    def without(block):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = Matcher(block, rate)
            for b in batches:
                yield b.filter(pa.array([not m.find(fold(t.as_py())) for t in b.column("text")], pa.bool_()))
        return work

    out = docs
    for block in item_blocks(benchmark, min_chars):
        out = map_arrow(out, without(block), docs.schema)
    return out
