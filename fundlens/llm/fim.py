"""Fill-in-middle transformation with cuts found in a Fenwick tree over text blocks.

A text is a run of units (leading white space and a word; white space at the end is a unit of its
own). Its UTF-8 bytes lie in fixed blocks; a Fenwick tree over the blocks holds, for each, how many
units end and how many code points start in it. A cut after u units is found by binary-lifting
descent to the block in which the u-th unit ends, then inside that block alone; the code points
before it come from the same descent. So a cut costs the logarithm of the number of blocks and one
block, however long the text, and the text itself is cut as bytes.

Where the cuts lie, and the form, follow from the SHA-256 of ``42:`` and the doc_id. ``transform``
gives the output texts, ``restore`` rebuilds the text from output and form alone: a text that holds
a mark stays plain, and two marks cannot overlap, so the marks in an output are always the three.

Cases: null text counts as empty; empty texts are plain with n = 0; a null doc_id is hashed as the
empty string; rows that share a doc_id are transformed each on its own; white-space-only texts
have one unit; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundlens.llm.bytewords import SPACE
from fundlens.llm.common import byte_chunks, map_arrow

SEED = "42:"
FIM_PERCENT, SPM_PERCENT = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
BLOCK = 1024   # bytes of text in a block


def fenwick(counts: np.ndarray) -> np.ndarray:
    """Fenwick tree (from index 1) of the rows of ``counts``, level by level."""
    tree = np.concatenate([np.zeros((1, counts.shape[1]), np.int64), counts])
    step = 1
    while 2 * step < len(tree):
        at = np.arange(2 * step, len(tree), 2 * step)
        tree[at] += tree[at - step]
        step *= 2
    return tree


def descend(tree: np.ndarray, target: int) -> tuple[int, np.ndarray]:
    """The most blocks whose units stay under ``target`` (so the target lies in the next one), and
    the sums over them."""
    at, total = 0, np.zeros(tree.shape[1], np.int64)
    step = 1 << (len(tree) - 1).bit_length()
    while step:
        if at + step < len(tree) and total[0] + tree[at + step, 0] < target:
            at += step
            total = total + tree[at]
        step //= 2
    return at, total


class Blocks:
    """A text's unit ends and code points, by block."""

    def __init__(self, data: np.ndarray):
        word = ~SPACE[data]
        self.ends = word.copy()                      # a unit ends at a word's last byte ...
        self.ends[:-1] &= ~word[1:]
        if len(data):
            self.ends[-1] = True                     # ... and at the end of the text
        self.starts = (data & 0xC0) != 0x80          # first bytes of code points
        at = np.arange(0, len(data), BLOCK)
        self.tree = fenwick(np.stack([np.add.reduceat(x, at, dtype=np.int64) for x in (self.ends, self.starts)], axis=1)
                            if len(data) else np.zeros((0, 2), np.int64))
        self.units = int(self.ends.sum())

    def cut(self, units: int) -> tuple[int, int]:
        """(bytes, code points) of the first ``units`` units."""
        if units == 0:
            return 0, 0
        block, before = descend(self.tree, units)
        a = block * BLOCK
        inside = np.flatnonzero(self.ends[a:a + BLOCK])[units - int(before[0]) - 1]
        end = a + int(inside) + 1
        return end, int(before[1]) + int(self.starts[a:end].sum())


def transformed(data: np.ndarray, h: tuple[int, int, int, int]) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of prefix and middle, output) of one text."""
    text = data.tobytes()
    blocks = Blocks(data)
    n = blocks.units
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= FIM_PERCENT:
        return n, "plain", None, None, text
    one, two = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    (a, before), (b, upto) = blocks.cut(one), blocks.cut(two)
    p, s, m = (mark + part for mark, part in zip(MARKS, (text[:a], text[b:], text[a:b]), strict=True))
    spm = h[3] % 100 < SPM_PERCENT
    return n, "spm" if spm else "psm", before, upto - before, (s + p if spm else p + s) + m


def transform(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.stack([b.column(f"_h{i}").to_numpy() for i in range(1, 5)], axis=1) if b.num_rows else np.zeros((0, 4))
            for i, j, data, off in byte_chunks(b.column("text")):
                rows = [transformed(data[x:y], tuple(h[i + k].tolist()))
                        for k, (x, y) in enumerate(zip(off[:-1], off[1:], strict=True))]
                n, form, pre, mid, out = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), pa.array(n, pa.int64()), pa.array(form, pa.string()),
                     pa.array(pre, pa.int64()), pa.array(mid, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    digest = F.sha2(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"_h{i + 1}") for i in range(4)]
    return map_arrow(docs.select("doc_id", "text", *hashes), work,
                     f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from."""
    part = F.split(output, "<[PSM]>")    # '' and the three parts in the output's order
    first, second = F.get(part, F.lit(1)), F.get(part, F.lit(2))
    return (F.when(form == "plain", output)
            .when(form == "psm", F.concat(first, F.get(part, F.lit(3)), second))
            .otherwise(F.concat(second, F.get(part, F.lit(3)), first)))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row."""
    out = transform(docs)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x
  FROM documents
), h AS (
  SELECT doc_id, text, u, len(u) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2,
    CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM t
), f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50
      THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid,
    array_to_string(u[b + 1:], '') AS suf FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid
    ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
