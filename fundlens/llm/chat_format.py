"""Chat formatting of typed content parts.

A turn holds ordered parts (text, image, audio, document). A visitor flattens them into one
body: text is escaped, every other part becomes a placeholder, its reference is recorded with
its place and its expanded token count. The template marks turns with control strings; the
same strings inside texts are escaped reversibly, so the output can be read back exactly.

One output row per turn, with the offset of its segment in the conversation: a conversation
of any length is streamed in turn order, never held whole. Cases: null text, role or parts
are empty; repeated turns are ordered by (turn, role, text); null turns come first; an unknown
part type raises; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundlens.llm.common import map_arrow, partitions

OPEN, BODY, CLOSE = "<|turn|>", "<|body|>", "<|end|>"
# Control strings of common chat templates; none may stand bare in a text.
CONTROL = re.compile(r"\\|<\||</?s>|\[/?INST\]|<</?SYS>>")
BACK = re.compile(r"\\(\\?)")
TOKENS_PER_TILE, TILE, TOKENS_PER_SECOND, TOKENS_PER_PAGE = 256, 512, 25, 800

PART = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("ref", T.StringType()), T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()), T.StructField("seconds", T.DoubleType()),
    T.StructField("pages", T.IntegerType()),
])


def escape(text: str) -> str:
    """Break every control string with a backslash; backslashes are doubled."""
    return CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return BACK.sub(lambda m: "\\" if m[1] else "", text)


class PartVisitor:
    """Flattens parts in order; ``body``, ``attachments`` and ``tokens`` hold the outcome."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.attachments: list[dict] = []
        self.tokens = 0

    def visit(self, part: dict) -> None:
        method = getattr(self, "visit_" + (part.get("type") or "text"), None)
        if method is None:
            raise ValueError(f"unknown content part {part.get('type')!r}")
        method(part)

    def visit_text(self, part: dict) -> None:
        self.pieces.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        tiles = -(-(part.get("width") or TILE) // TILE) * -(-(part.get("height") or TILE) // TILE)
        self.attach("image", part, tiles * TOKENS_PER_TILE)

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, int(-(-(part.get("seconds") or 0.0) * TOKENS_PER_SECOND // 1)))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, (part.get("pages") or 1) * TOKENS_PER_PAGE)

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"ordinal": len(self.attachments), "type": kind, "ref": part.get("ref"),
                                 "at": sum(map(len, self.pieces)), "tokens": tokens})
        self.pieces.append(f"<|{kind}|>")
        self.tokens += tokens

    @property
    def body(self) -> str:
        return "".join(self.pieces)


ATTACHMENTS = "array<struct<ordinal:int,type:string,ref:string,at:long,tokens:long>>"


def format_turns(rows: DataFrame, parts: str | None = None) -> DataFrame:
    """(conv_id, turn_index, segment, start, mask_start, mask_end, attachments, expanded_tokens).

    ``rows`` has conv_id, turn, role, text and, if ``parts`` names it, a column of typed parts
    (array of :data:`PART`), used instead of text where it is not null. ``start`` is the
    segment's place in the conversation in code points; the loss mask covers the body of
    assistant turns (mask_start = mask_end otherwise). ``attachments.at`` counts from the body.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    one = F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *[
        F.lit(None).cast(f.dataType).alias(f.name) for f in PART.fields[2:]])).cast(T.ArrayType(PART))
    src = rows.select("conv_id", F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), text.alias("text"),
                      *([F.coalesce(F.col(parts).cast(T.ArrayType(PART)), one).alias("parts")] if parts else []))
    order = ["conv_id", "turn", "role", "text"]
    src = src.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions(*order)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, index, place, begun = None, 0, 0, False
        for b in batches:
            out = []
            ids, roles = b.column("conv_id").to_pylist(), b.column("role").to_pylist()
            bodies = b.column("parts").to_pylist() if parts else b.column("text").to_pylist()
            for c, role, content in zip(ids, roles, bodies, strict=True):
                if not begun or c != conv:
                    conv, index, place, begun = c, 0, 0, True
                v = PartVisitor()
                for part in content if parts else [{"type": "text", "text": content}]:
                    v.visit(part)
                head = OPEN + escape(role) + BODY
                segment = head + v.body + CLOSE
                mask = place + len(head)
                out.append((c, index, segment, place, mask, mask + (len(v.body) if role == "assistant" else 0),
                            v.attachments, v.tokens))
                index += 1
                place += len(segment)
            yield pa.RecordBatch.from_arrays(
                [pa.array(col, type=t) for col, t in zip(zip(*out), types, strict=True)] if out else
                [pa.array([], type=t) for t in types], names=names)

    schema = (f"conv_id {kind}, turn_index long, segment string, start long, mask_start long, mask_end long, "
              f"attachments {ATTACHMENTS}, expanded_tokens long")
    att = pa.list_(pa.struct([("ordinal", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("at", pa.int64()),
                              ("tokens", pa.int64())]))
    conv_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), att, pa.int64()]
    names = ["conv_id", "turn_index", "segment", "start", "mask_start", "mask_end", "attachments", "expanded_tokens"]
    return map_arrow(src, work, schema)


SEGMENT = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(BODY) + "(.*?)" + re.escape(CLOSE), re.S)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation the digests of what its formatted segments say, read in stream order.

    ``formatted`` is what :func:`format_turns` returned: its partitions hold whole
    conversations in turn order, and only running digests are kept.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    conv_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, done = None, []

        def close():
            done.append((state["id"], state["n"], state["turns"].hexdigest(), state["loss_n"], state["loss"].hexdigest(),
                         state["chars"]))

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("conv_id", "turn_index", "segment", "start", "mask_start", "mask_end")]
            for c, index, segment, start, m0, m1 in zip(*cols, strict=True):
                if index == 0:
                    if state is not None:
                        close()
                    state = {"id": c, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_n": 0, "chars": 0}
                m = SEGMENT.fullmatch(segment)
                if m is None or start != state["chars"]:
                    raise ValueError(f"conversation {c}: segment {index} can't be read back")
                role, body = unescape(m[1]), unescape(m[2])
                state["turns"].update(f"{role}\n{body}\n".encode())
                if m1 > m0:
                    loss = unescape(segment[m0 - start:m1 - start])
                    state["loss"].update(loss.encode())
                    state["loss_n"] += len(loss)
                state["n"] += 1
                state["chars"] += len(segment)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*done), types, strict=True)], names=names)
                done.clear()
        if state is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*done), types, strict=True)], names=names)

    types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return map_arrow(formatted, work, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
                                      f"loss_sha256 string, formatted_chars long")


PROBE = "</s>[INST] ok [/INST]"


def with_probe(conversations: DataFrame) -> DataFrame:
    """All conversations plus conversation -1, whose two turns say control strings."""
    probe = conversations.sparkSession.createDataFrame(
        [(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), n AS (
  SELECT *, 23 + length(role) + length(text)
    + len(regexp_extract_all(role, '\\|<\||</?s>|\[/?INST\]|<</?SYS>>'))
    + len(regexp_extract_all(text, '\\|<\||</?s>|\[/?INST\]|<</?SYS>>')) AS chars
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""
