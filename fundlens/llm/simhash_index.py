"""SimHash near-duplicate components by a hierarchical index in Gray order.

A fingerprint has 64 bits; bit i is set if it is set in over half of the XXH64 hashes of a text's
3-word shingles (repeats count). Fingerprints that differ in at most ``WITHIN`` bits are linked.

The distinct fingerprints are sorted by Gray rank (the position of a code in the reflected Gray
code), which puts codes that share long bit patterns next to each other. The rank's leading bits
are the top of the index: a node holds all fingerprints of one leading pattern (as many bits as give
nodes of half a leaf on average). A fingerprint is
sent down from the root to the nodes whose pattern differs from its own in so few bits that the
difference accumulated so far stays within the bound, and only to nodes not before its own in
Gray order, so a pair meets once. Nodes of over ``LEAF`` fingerprints hand their members, and the
fingerprints that reached them, to the 2^``STEP`` nodes below, level by level as Spark joins.

Inside a leaf the members, in Gray order, are grouped by ``FAN`` twice. The bits that all members
of a group share are factored out into the group's masked pattern, the bits shared on top of that
go one level down, and the rest stays with the member. A search adds up the differences on the way
down and drops a whole group as soon as they pass the bound. Fingerprints searched in a leaf are
streamed in batches and, where many reach one leaf, dealt to copies of it. A leaf emits a forest
of links (at most one link for each fingerprint searched and each member), never all pairs.

Cases: null texts and texts without words have fingerprint zero, linked like any other; fewer than
three words: the whole sequence is the one shingle; rows that share a doc_id are one document,
whatever their texts; a null doc_id takes no part (its row has a fingerprint, component null); an
empty table gives no rows; extra columns are ignored. doc_id must be an integer type.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundlens.llm.bytewords import LOWER, SPACE, U
from fundlens.llm.common import byte_chunks, components, key_runs, map_arrow, partitions, written

BITS, WITHIN, WORDS, SEED = 64, 2, 3, 42
LEAST, MOST, STEP = 8, 24, 4   # leading bits of the first level (at least, at most), bits of each further one
LEAF = 1 << 17            # fingerprints of a leaf
SEARCHES = 1 << 18        # fingerprints searched in one copy of a leaf
FAN = 32
ROWS = 1 << 12            # fingerprints searched at once
HASHES = 1 << 14          # shingle hashes whose bits are counted at once


def normalised(text: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Lower-case words joined by single spaces, and the n+1 starts of words (the last one past the end)."""
    low = LOWER[text]
    word = ~SPACE[low]
    keep = word.copy()
    keep[1:] |= word[:-1]
    low, word = low[keep], word[keep]
    if len(word) and not word[-1]:
        low, word = low[:-1], word[:-1]
    low[~word] = 32
    starts = np.concatenate([[0], np.flatnonzero(~word) + 1, [len(low) + 1]]) if len(low) else np.zeros(1, np.int64)
    return low.tobytes(), starts


def fingerprint(text: np.ndarray) -> int:
    """SimHash of a text's bytes."""
    joined, starts = normalised(text)
    words = len(starts) - 1
    if not words:
        return 0
    at = np.stack([starts[:-WORDS], starts[WORDS:] - 1], axis=1) if words > WORDS else np.array([[0, len(joined)]])
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(at), HASHES):
        h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in at[i:i + HASHES].tolist()), "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(at), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, code) of every row; the code is the fingerprint as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [fingerprint(data[x:y]) for _, _, data, off in byte_chunks(b.column("text"))
                     for x, y in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(codes, U).view(np.int64))], names=["doc_id", "code"])

    return map_arrow(docs.select("doc_id", "text"), work, f"doc_id {kind}, code long")


def ranks_of(codes: np.ndarray) -> np.ndarray:
    """Positions of codes in the reflected Gray code."""
    for s in (1, 2, 4, 8, 16, 32):
        codes = codes ^ (codes >> U(s))
    return codes


def rank_of(code: int) -> int:
    return int(ranks_of(np.array([code], U))[0])


def gray_rank(code: Column) -> Column:
    """The same for a column (signed longs)."""
    for s in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, s))
    return code


def node(rank: Column, bits: int) -> Column:
    """The index node of ``bits`` leading bits that a rank lies in."""
    return F.shiftrightunsigned(rank, BITS - bits)


def pattern(rank: Column) -> Column:
    """The code bits of a rank prefix: prefixes of ranks and of codes determine each other."""
    return rank.bitwiseXOR(F.shiftrightunsigned(rank, 1))


def route(codes: DataFrame, leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """Members (depth, node, code) of the leaves, and the fingerprints to search there in the same form.

    ``codes(code)`` is distinct. Each level goes on with the nodes of over ``leaf`` members only; at
    the last one a node has at most 2^STEP codes."""
    ranked = codes.select("code", gray_rank(F.col("code")).alias("rank"))
    depth = min(MOST, max(LEAST, (2 * codes.count() // leaf).bit_length()))
    patterns = [0, *(1 << i for i in range(depth)), *(1 << i | 1 << j for i in range(depth) for j in range(i))]
    near = F.explode(F.array(*[F.lit(rank_of(x)).cast("long") for x in patterns]))
    own = node(F.col("rank"), depth)
    members = ranked.select("code", "rank", own.alias("node"))
    reached = (ranked.select("code", "rank", near.alias("x"))
               .select("code", "rank", own.bitwiseXOR(F.col("x")).alias("node"))     # the rank of a xored code is the xored rank
               .where(F.col("node") >= own))
    found, sought = [], []
    while True:
        sizes = written(members.groupBy("node").agg(F.count("*").alias("n")), "nodes")
        at = F.lit(depth).alias("depth")
        last = depth + STEP >= BITS or not sizes.where(F.col("n") > leaf).limit(1).count()
        small = sizes if last else sizes.where(F.col("n") <= leaf)
        found.append(members.join(small.select("node"), "node").select(at, "node", "code"))
        sought.append(reached.join(small.select("node"), "node").select(at, "node", "code"))
        if last:
            return reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, sought)
        large = sizes.where(F.col("n") > leaf).select("node")
        depth += STEP
        members = written(members.join(large, "node").select("code", "rank", node(F.col("rank"), depth).alias("node")), "members")
        below = F.explode(F.sequence(F.lit(0), F.lit((1 << STEP) - 1)).cast("array<long>"))
        reached = (reached.join(large, "node").select("code", "rank", F.shiftleft("node", STEP).alias("up"), below.alias("low"))
                   .select("code", "rank", F.col("up").bitwiseOR(F.col("low")).alias("node"))
                   .where(F.col("node") >= node(F.col("rank"), depth))
                   .where(F.bit_count(pattern(F.col("node")).bitwiseXOR(pattern(node(F.col("rank"), depth)))) <= WITHIN))
        reached = written(reached, "reached")


def shared(values: np.ndarray, width: int) -> np.ndarray:
    """(mask, bits) of what each run of ``width`` values has in common."""
    at = np.arange(0, len(values), width)
    both, any_ = np.bitwise_and.reduceat(values, at), np.bitwise_or.reduceat(values, at)
    return np.stack([~(both ^ any_), both & ~(both ^ any_)])


class GrayIndex:
    """Groups of neighbours in Gray order over the sorted codes of one leaf."""

    def __init__(self, codes: np.ndarray, ranks: np.ndarray):
        order = np.argsort(ranks)
        self.codes, self.ranks = codes[order], ranks[order]
        upper, lower = shared(self.codes, FAN * FAN), shared(self.codes, FAN)
        parent = np.arange(lower.shape[1]) // FAN
        lower[0] &= ~upper[0][parent]            # the bits not factored out above
        lower[1] &= lower[0]
        rest = ~(lower[0] | upper[0][parent])[np.arange(len(codes)) // FAN]
        self.levels = [upper, lower, np.stack([rest, self.codes & rest])]

    def search(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``codes``, member) of every pair within the bound."""
        mask, bits = self.levels[0]
        differ = np.bitwise_count((codes[:, None] & mask) ^ bits)
        row, at = np.nonzero(differ <= WITHIN)
        differ = differ[row, at]
        for mask, bits in self.levels[1:]:
            children = np.minimum((at + 1) * FAN, len(mask)) - at * FAN
            at = np.repeat(at * FAN - (np.cumsum(children) - children), children) + np.arange(children.sum())
            row, differ = np.repeat(row, children), np.repeat(differ, children)
            differ = differ + np.bitwise_count((codes[row] & mask[at]) ^ bits[at])
            near = differ <= WITHIN
            row, at, differ = row[near], at[near], differ[near]
        return row, at


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (each entry the smallest of its set) with the sets of a[i] and b[i] joined."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, root[root]):
            root = root[root]


def links(members: DataFrame, sought: DataFrame, searches: int = SEARCHES) -> DataFrame:
    """(a, b): a forest of the links found in each leaf."""
    load = sought.groupBy("depth", "node").agg(F.ceil(F.count("*") / searches).cast("int").alias("copies"))
    placed = members.join(load, ["depth", "node"]).select("depth", "node", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"),
                                                          F.lit(0).alias("role"), "code")
    dealt = sought.join(load, ["depth", "node"]).select(
        "depth", "node", F.pmod(F.xxhash64("code"), F.col("copies")).cast("int").alias("copy"), F.lit(1).alias("role"), "code")
    keys = ["depth", "node", "copy"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, index, root = None, [], None, None

        def forest() -> pa.RecordBatch:
            at = np.flatnonzero(root != np.arange(len(root)))
            return pairs(index.codes[at], index.codes[root[at]])

        def pairs(a, b) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        # one role of one leaf copy at a time, in batches: first the members, then what is sought
        for b in batches:
            for t in key_runs([b], [*keys, "role"]):
                codes = t.column("code").to_numpy().view(U)
                now = tuple(t.column(k)[0].as_py() for k in keys)
                if now != place:
                    if index is not None:
                        yield forest()
                    place, held, index, root = now, [], None, None
                if t.column("role")[0].as_py() == 0:
                    held.append(codes)
                    continue
                if index is None:
                    all_ = np.concatenate(held)
                    index, root, held = GrayIndex(all_, ranks_of(all_)), np.arange(len(all_)), []
                for i in range(0, len(codes), ROWS):
                    part = codes[i:i + ROWS]
                    row, at = index.search(part)
                    later = index.ranks[at] > ranks_of(part)[row]
                    row, at = row[later], at[later]
                    if not len(row):
                        continue
                    new = np.ones(len(row), bool)
                    new[1:] = row[1:] != row[:-1]          # rows come in order
                    first = at[new]
                    root = unite(root, np.repeat(first, np.diff(np.append(np.flatnonzero(new), len(row)))), at)
                    yield pairs(part[row[new]], index.codes[first])
        if index is not None:
            yield forest()

    rows = (placed.unionByName(dealt).repartition(partitions(members.sparkSession), *keys)
            .sortWithinPartitions(*keys, "role"))
    return map_arrow(rows, work, "a long, b long")


def near_duplicates(docs: DataFrame, leaf: int = LEAF, searches: int = SEARCHES) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    prints = written(fingerprints(docs), "fingerprints")
    known = prints.where("doc_id is not null")
    # rows that share a doc_id are one document: their fingerprints are linked
    ids = known.groupBy("doc_id").agg(F.min("code").alias("least"), F.max("code").alias("most")).where("least <> most")
    same = known.join(ids, "doc_id").where("code <> least").select(F.col("code").alias("a"), F.col("least").alias("b"))
    reps = written(known.groupBy("code").agg(F.min("doc_id").alias("rep")), "representatives")
    members, sought = route(reps.select("code"), leaf)
    comp = components(links(members, sought, searches).unionByName(same.distinct()), "simhash")
    of = reps.join(comp, reps["code"] == comp["id"], "left").select("code", "rep", F.coalesce("component", "code").alias("component"))
    smallest = of.groupBy("component").agg(F.min("rep").alias("component_id"))
    of = of.join(smallest, "component").select("code", "component_id")
    return (prints.join(of, "code", "left")
            .select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"),
                    F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")))
