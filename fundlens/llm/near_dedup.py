"""Near-duplicate components by a chosen-path similarity join.

Documents are sets of 5-word shingles, linked from a Jaccard similarity of ``percent`` up. Equal
sets are one class. Each of ``TREES`` independent trees sends a class down paths: a node picks one
minwise coordinate (and, with probability 100 / percent - 1, a second one) from its own path alone
and splits its classes by their minwise value there, so a path needs no coordination between
documents. Nodes of up to ``LEAF`` classes are compared exhaustively; larger ones go down
another level and, at the last level, are compared in blocks. A pair at a threshold of
0.85 (0.8) meets in a tree with probability 0.87 (0.84) at the first level and about 0.7 (0.6) at
the third: ten trees miss it with less than 1e-5 (1e-4).

The first tree goes first, its large nodes block by block, and what it links is united; then the other
trees in the same way, between components only: a leaf whose classes are one component by then is dropped.
At last classes of a large node meet across its blocks, again between components only: the blocks of its
largest component meet the blocks of the rest, never one another. So a large group of near copies costs its size, not its square.

In a leaf, pairs whose signatures agree far enough (four standard deviations under the
threshold) are candidates; a pair that meets in several leaves is taken in the smallest only.
Candidates are confirmed on the full shingle sets of the whole texts, skipping pairs already
connected, so a leaf emits a forest of links, never all pairs. Components of the links follow.

Cases: texts that are null or without words have no set and are linked with nothing; fewer
than five words: the sequence as one shingle; rows that share a doc_id are one document; a
null doc_id takes no part (component null, kept); empty tables give no rows; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundlens.llm.bytewords import U, mix, shingle_sets
from fundlens.llm.common import byte_chunks, components, in_few_files, key_runs, map_arrow, maybe_ids, partitions, written

PERCENT = 85           # of the query; the pipeline's stage takes STAGE_PERCENT
STAGE_PERCENT = 80
TREES = 10
COORDINATES = 128
LEAF = 1024
LEVELS = 4
_mult = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 62, COORDINATES, dtype=np.uint64) * U(2) + U(1)


def agreement(percent: int) -> int:
    """Equal coordinates of a pair at the threshold, less four standard deviations."""
    p = percent / 100
    return int(COORDINATES * (p - 4 * (p * (1 - p) / COORDINATES) ** 0.5))


def minwise(s: np.ndarray) -> np.ndarray:
    """COORDINATES minwise values (32 bits) of a non-empty set."""
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 2048):
            out = np.minimum(out, ((s[i:i + 2048, None] * _mult) >> U(32)).min(axis=0))
    return out.astype(np.uint32)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, sig): set size, a 128-bit fingerprint of the set, minwise values."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, f1, f2, sig = [], [], [], []
            for _, _, data, off in byte_chunks(b.column("text")):
                for s in shingle_sets(data, off):
                    n.append(len(s))
                    with np.errstate(over="ignore"):
                        f1.append(int(mix(s).sum(dtype=U).view(np.int64)))
                        f2.append(int(mix(s ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=U).view(np.int64)))
                    sig.append(minwise(s).astype("<u4").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()),
                 pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "f1", "f2", "sig"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(src, work, "doc_id long, n_shingles long, f1 long, f2 long, sig binary")


def chosen(node: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The coordinates a node splits by: the first, the second, and whether it takes the second."""
    r = mix(node ^ U(0x5851F42D4C957F2D))
    one = r % U(COORDINATES)
    two = (one + U(1) + (r >> U(20)) % U(COORDINATES - 1)) % U(COORDINATES)
    return one, two, (r >> U(40)).astype(float) / 2.0 ** 24 < 100 / percent - 1


def child(node: np.ndarray, coordinate: np.ndarray, value: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(node + coordinate * U(0x9E3779B97F4A7C15)) + value.astype(U))


def sig_matrix(col: pa.Array, width: str = "<u4") -> np.ndarray:
    raw = b"".join(x.as_py() for x in col)
    return np.frombuffer(raw, width).reshape(len(col), COORDINATES)


def split(rows: DataFrame, trees: range | None, percent: int) -> DataFrame:
    """(node, rep, component) of the children: of the roots of ``trees``, or of each row's node."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, rep, part = sig_matrix(b.column("sig")), b.column("rep").to_numpy(), b.column("component").to_numpy()
            nodes = mix(np.array(trees, U) + U(1)) if trees else b.column("node").to_numpy().view(U)
            one, two, both = chosen(nodes, percent)
            out, at = [], []
            every = np.arange(len(rep))
            if trees:
                for node, c1, c2, second in zip(nodes, one, two, both, strict=True):
                    for c in [c1, c2][:1 + second]:
                        out.append(child(np.full(len(rep), node), np.full(len(rep), c), sig[:, int(c)]))
                        at.append(every)
            else:
                out += [child(nodes, one, sig[every, one.astype(int)]),
                        child(nodes[both], two[both], sig[every[both], two[both].astype(int)])]
                at += [every, every[both]]
            at = np.concatenate(at)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(rep[at]), pa.array(part[at])],
                                             names=["node", "rep", "component"])

    return map_arrow(rows.select(*([] if trees else ["node"]), "rep", "component", "sig"), work, "node long, rep long, component long")


def leaves(sets: DataFrame, label: DataFrame | None, percent: int, trees: range) -> tuple[DataFrame, DataFrame]:
    """(leaf, rep, component) of the leaves of up to LEAF classes, and (node, rep, component, n) of the nodes
    still larger after all levels. A large node whose classes are one component by ``label`` (none: each its
    own) has nothing left to link and goes no further."""
    roots = split(sets.withColumn("component", F.col("rep")), trees, percent)
    paths, out = written(in_few_files(roots if label is None else roots.drop("component").join(label, "rep").select("node", "rep", "component")), "paths"), None
    for level in range(LEVELS):
        sizes = paths.groupBy("node").agg(F.count("*").alias("n"), (F.min("component") < F.max("component")).alias("mixed"))
        many = written(in_few_files(sizes.where(F.col("n") > LEAF)), "many")       # at most a LEAF-th of the rows
        small = paths.join(many, "node", "left_anti").select(F.col("node").alias("leaf"), "rep", "component")
        out = small if out is None else out.unionByName(small)
        large = paths.join(many.where("mixed"), "node").select("node", "rep", "component", "n")
        if level == LEVELS - 1 or not many.where("mixed").limit(1).count():
            return out, large
        paths = written(in_few_files(split(large.join(sets, "rep"), None, percent)), "paths")


def blocks(n: Column) -> tuple[Column, Column]:
    """How many blocks of half a leaf ``n`` classes make, and the one that a class is in (another mix in each node)."""
    count = F.ceil(n * 2 / LEAF).cast("int")
    return count, F.pmod(F.xxhash64("rep", "node"), count).cast("int")


def within_blocks(large: DataFrame) -> DataFrame:
    """(leaf, rep, component): the blocks of large nodes."""
    return large.select(F.xxhash64("node", blocks(F.col("n"))[1]).alias("leaf"), "rep", "component")


def across_components(large: DataFrame) -> DataFrame:
    """(leaf, rep, component) of ``large(node, rep, component)``: every two classes of a node that are of different
    components meet in a leaf. The node's largest component is cut into blocks, and so is the rest;
    each block of the one meets each of the other, and blocks of the rest meet one another."""
    counts = large.groupBy("node", "component").agg(F.count("*").alias("n"))
    of = counts.groupBy("node").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n"))
    of = of.select("node", F.col("most.component").alias("big"), F.col("most.n").alias("n_big"), (F.col("n") - F.col("most.n")).alias("n_rest"))
    rows = large.join(of.where("n_rest > 0"), "node")
    (n_big, at_big), (n_rest, at_rest) = blocks(F.col("n_big")), blocks(F.col("n_rest"))
    numbers = lambda n: F.sequence(F.lit(0), n - 1)
    in_big = F.col("component") == F.col("big")
    big = rows.where(in_big).select("node", "rep", "component", at_big.alias("c"), F.explode(numbers(n_rest)).alias("d"))
    rest = rows.where(~in_big).select("node", "rep", "component", at_rest.alias("d"), n_big.alias("n_big"), n_rest.alias("n_rest"))
    met = big.unionByName(rest.select("node", "rep", "component", "d", F.explode(numbers(F.col("n_big"))).alias("c")))
    rest = rest.select("node", "rep", "component", "d", F.explode(numbers(F.col("n_rest"))).alias("k"))
    return (met.select(F.xxhash64("node", F.lit("big"), "c", "d").alias("leaf"), "rep", "component")
            .unionByName(rest.select(F.xxhash64("node", F.lit("rest"), F.least("d", "k"), F.greatest("d", "k")).alias("leaf"), "rep", "component")))


def candidates(t: pa.Table, sig: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(agreement, i, j) of the pairs to confirm in this leaf, best first: of different components,
    with signatures that agree in ``least`` places, and no smaller leaf that both are in."""
    leaf, own, part = t.column("leaf")[0].as_py(), t.column("leaves").to_pylist(), t.column("component").to_numpy()
    n, out = len(sig), []
    for a in range(0, n, 64):
        agree = (sig[a:a + 64, None, :] == sig[None, a:, :]).sum(axis=2, dtype=np.int16)
        agree[part[a:a + 64, None] == part[None, a:]] = -1
        for i, j in zip(*np.nonzero(agree >= least), strict=True):
            if j > i:
                out.append((int(agree[i, j]), a + int(i), a + int(j)))
    if out:
        smaller: dict[int, set[int]] = {}
        for k in {k for _, i, j in out for k in (i, j)}:
            smaller[k] = {x for x in own[k] if x < leaf}
        out = [p for p in out if smaller[p[1]].isdisjoint(smaller[p[2]])]
    return sorted(out, reverse=True)


def runs_of(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), "leaf").sortWithinPartitions("leaf", "rep")


def to_confirm(rows: DataFrame, percent: int) -> DataFrame:
    """The rows of the classes with a candidate partner in their leaf."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_runs(batches, ["leaf"]):
            if t.num_rows > 1:
                pairs = candidates(t, sig_matrix(t.column("sig").combine_chunks(), "u1"), agreement(percent))
                if pairs:
                    yield from t.take(sorted({k for _, i, j in pairs for k in (i, j)})).combine_chunks().to_batches()

    return map_arrow(runs_of(rows), work, rows.schema)


def similar(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """100 * intersection >= percent * union for sorted distinct arrays."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirmed(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): a forest of links among the rows of each leaf, confirmed on full sets."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[tuple[int, int]] = []
        for t in key_runs(batches, ["leaf"]):
            if t.num_rows < 2:
                continue
            sig = sig_matrix(t.column("sig").combine_chunks(), "u1")
            rep, text = t.column("rep").to_numpy(), t.column("text").combine_chunks()
            sets = [s for _, _, data, off in byte_chunks(text) for s in shingle_sets(data, off)]
            root = list(range(len(rep)))

            def top(i):
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for _, i, j in candidates(t, sig, agreement(percent)):
                if top(i) != top(j) and similar(sets[i], sets[j], percent):
                    root[top(i)] = top(j)
                    got.append((int(rep[i]), int(rep[j])))
            if len(got) > 50_000:
                yield flat(got)
                got = []
        yield flat(got)

    def flat(got):
        return pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.int64()) for i in range(2)], names=["a", "b"])

    return map_arrow(runs_of(rows), work, "a long, b long")


def found(small: DataFrame | None, large: DataFrame, sets: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(a, b): a forest of the links inside the given leaves between classes of different components.

    ``small`` and ``large`` are (leaf, rep, component), ``sets`` (rep, sig)."""
    rows = large.select("leaf", "rep", "component", F.lit(False).alias("own"))
    if small is not None:
        rows = small.select("leaf", "rep", "component", F.lit(True).alias("own")).unionByName(rows)
    w = Window.partitionBy("leaf")                      # a leaf: at most some LEAF classes
    rows = rows.withColumns({"_a": F.min("component").over(w), "_b": F.max("component").over(w)})
    rows = written(in_few_files(rows.where("_a < _b").drop("_a", "_b")), "mixed")
    # a pair of two components meets in such leaves only; ``leaves`` of a class: at most some 2 a tree
    own = rows.groupBy("rep").agg(F.sort_array(F.collect_set(F.when(F.col("own"), F.col("leaf")))).alias("leaves"))
    low = map_arrow(sets, lambda bs: (pa.RecordBatch.from_arrays(
        [b.column("rep"), pa.array([r.tobytes() for r in (sig_matrix(b.column("sig")) & 255).astype(np.uint8)], pa.binary())],
        names=["rep", "sig"]) for b in bs), "rep long, sig binary")
    placed = rows.join(own, "rep").join(low, "rep").select("leaf", "rep", "component", "sig", "leaves")
    want = written(in_few_files(to_confirm(placed, percent)), "to-confirm")
    texts = maybe_ids(docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("rep"), "text"), "rep", want)
    return written(in_few_files(confirmed(want.join(texts, "rep"), percent)), "links")


def labelled(sets: DataFrame, links: DataFrame) -> DataFrame:
    """(rep, component) of all classes by the links so far."""
    return written(in_few_files(sets.select("rep").join(components(links), F.col("rep") == F.col("id"), "left")
                   .select("rep", F.coalesce("component", "rep").alias("component"))), "labels")


def stars(label: DataFrame) -> DataFrame:
    """(a, b): the components so far as links."""
    return label.where("rep <> component").select(F.col("rep").alias("a"), F.col("component").alias("b"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    sig, key = written(in_few_files(signatures(docs)), "signatures"), ["f1", "f2", "n_shingles"]
    full = sig.where("n_shingles > 0 and doc_id is not null")
    # a class: its smallest doc_id stands for it
    sets = written(in_few_files(full.groupBy(*key).agg(F.min(F.struct(F.col("doc_id").alias("rep"), "sig")).alias("m"))
                   .select(*key, "m.rep", "m.sig")), "sets")
    classes, twice = sets.select(*key, "rep"), None
    texts = full.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("a"), F.max(F.struct(*key)).alias("b"))
    shared = written(in_few_files(texts.where("a <> b").select("doc_id")), "shared").limit(1).count() > 0
    if shared:
        # rows that share a doc_id but not a text are one document: link their classes to the smallest
        member = full.join(classes, key).select("doc_id", "rep")
        least = member.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("most")).where("b < most")
        twice = written(in_few_files(member.join(least, "doc_id").select(F.col("rep").alias("a"), "b").where("a <> b").distinct()), "twice")
        sets = written(in_few_files(sets.select("rep", "sig").dropDuplicates(["rep"])), "sets")
    sets = sets.select("rep", "sig")
    small, large = leaves(sets, None, percent, range(1))
    links = found(small, within_blocks(large), sets, docs, percent)
    label = labelled(sets, links.unionByName(twice) if shared else links)
    small, more = leaves(sets, label, percent, range(1, TREES))
    label = labelled(sets, stars(label).unionByName(found(small, within_blocks(more), sets, docs, percent)))
    large = large.unionByName(more).drop("component").join(label, "rep")
    several = large.groupBy("node").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("node")
    large = written(in_few_files(large.join(several, "node", "left_semi")), "large")
    if large.limit(1).count():
        links = found(None, across_components(large), sets, docs, percent)
        label = labelled(sets, stars(label).unionByName(links))
    of = full.select("doc_id", *key).join(classes, key).join(label, "rep") if shared else classes.join(label, "rep")
    if shared:
        out = sig.join(of.groupBy("doc_id").agg(F.min("component").alias("component")), "doc_id", "left")
    else:
        out = sig.join(of.select(*key, "component"), key, "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return (out.select("doc_id", "n_shingles", own.alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def keep_one(docs: DataFrame, percent: int = STAGE_PERCENT) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id."""
    kind = docs.schema["doc_id"].dataType
    gone = written(in_few_files(near_duplicates(docs, percent).where(~F.col("kept")).select(F.col("doc_id").cast(kind))), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)     # ids only: broadcast while Spark's size limit allows it


ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM t
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b
), m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, t.doc_id = m.component_id AS kept
FROM t LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""
