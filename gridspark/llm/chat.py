"""Chat formatting by columnar byte assembly.

A turn becomes ``### role: text</turn>`` and a line feed. Inside roles and
texts a backslash is doubled and a backslash is put before each control string
(``### `` and ``</turn>``; in roles also before a colon), so the output can be
read back: outside escapes, control strings are the template's own.

The turns of a batch are assembled in numpy: the lengths of headers, contents
and ends give cumulative offsets; one buffer is allocated for the batch and
every byte is copied to its place by scatter indices; the conversations are
slices of that buffer.

Defined results: null roles and texts are empty; turns are ordered by turn,
role and text, nulls first; repeated rows are turns of their own; rows without
a conversation id are one conversation without id; an empty table gives an
empty table; other columns are ignored.

Scale: one shuffle by conversation, sorted within the partitions, and a stream
of batches in each task. A conversation is one row of the result, so only a
single conversation has to fit a task; a conversation that begins in one batch
and ends in a later one is carried over.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

HEADER, COLON, END = "### ", ": ", "</turn>\n"
CONTROL = ("### ", "</turn>")
LOSS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
TURN = re.compile(r"### ((?:[^\\:]+|\\.)*): ((?:[^\\<]+|\\.|<(?!/turn>))*)</turn>\n", re.S)
ESCAPED = re.compile(r"\\(.)", re.S)


def escape(texts: pa.Array, control: tuple[str, ...]) -> pa.Array:
    """Backslashes doubled and one put before each control string."""
    texts = pc.replace_substring(pc.fill_null(texts, ""), "\\", "\\\\")
    for c in control:
        texts = pc.replace_substring(texts, c, "\\" + c)
    return texts


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text) if "\\" in text else text


def _bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the length of each string."""
    a = a.cast(pa.large_binary())
    at = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, 8 * a.offset)
    data = a.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return flat, np.diff(at)


def _scatter(out: np.ndarray, flat: np.ndarray, sizes: np.ndarray, to: np.ndarray) -> None:
    """Copy the strings that lie one after another in ``flat`` to the places ``to``."""
    begin = np.cumsum(sizes) - sizes
    out[np.repeat(to - begin, sizes) + np.arange(len(flat))] = flat


def assemble(ids: list, roles: pa.Array, texts: pa.Array, learned: str) -> pa.RecordBatch:
    """The formatted conversations of whole conversations' turns, in order."""
    n = len(ids)
    starts = np.array([i for i in range(n) if not i or ids[i] != ids[i - 1]], np.int64)
    role = escape(roles, (*CONTROL, ":"))
    heads = pc.binary_join_element_wise(HEADER, role, COLON, "")
    body = escape(texts, CONTROL)
    (head, n_head), (content, n_body) = _bytes(heads), _bytes(body)
    end = np.frombuffer(END.encode(), np.uint8)

    size = n_head + n_body + len(end)
    ends = np.cumsum(size)
    at = ends - size
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    _scatter(out, head, n_head, at)
    _scatter(out, content, n_body, at + n_head)
    out[(at + n_head + n_body)[:, None] + np.arange(len(end))] = end

    offsets = np.append(at[starts], len(out)).astype(np.int32)
    formatted = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(out))

    chars = [np.asarray(pc.utf8_length(a), np.int64) for a in (heads, body)]
    whole = chars[0] + chars[1] + len(END)
    place = np.cumsum(whole) - whole
    place -= np.repeat(place[starts], np.diff(np.append(starts, n)))
    assistant = np.asarray(pc.equal(pc.fill_null(roles, ""), learned).to_numpy(zero_copy_only=False), bool)
    begin = place + chars[0]
    spans = pa.StructArray.from_arrays([pa.array(begin[assistant]), pa.array((begin + chars[1])[assistant])], ["start", "end"])
    upto = np.append(np.cumsum(assistant) - assistant, assistant.sum())
    loss = pa.ListArray.from_arrays(pa.array(np.append(upto[starts], upto[-1]), pa.int32()), spans)
    return pa.RecordBatch.from_arrays(
        [pa.array([ids[i] for i in starts], pa.int64()), pa.array(np.diff(np.append(starts, n)), pa.int64()), formatted, loss],
        names=["conv_id", "n_turns", "formatted", "loss"])


def format_chats(turns: DataFrame, learned: str = "assistant") -> DataFrame:
    """conv_id, n_turns, formatted and loss: the spans (code points, end exclusive) of the texts of the role ``learned``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []  # turns of a conversation that may go on
        for b in batches:
            ids = b.column("conv_id").to_pylist()
            last = next((i for i in range(len(ids) - 1, 0, -1) if ids[i] != ids[i - 1]), 0)
            if kept and ids and kept[-1].column("conv_id")[-1].as_py() != ids[0]:
                yield _assembled(kept, learned)
                kept = []
            if last:
                yield _assembled([*kept, b.slice(0, last)], learned)
                kept = []
            if ids:
                kept.append(b.slice(last))
        if kept:
            yield _assembled(kept, learned)

    rows = turns.selectExpr("cast(conv_id as long) as conv_id", "turn", "cast(role as string) as role", "cast(text as string) as text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(run, "conv_id long, n_turns long, formatted string, loss array<struct<start:long,end:long>>")


def _assembled(parts: list[pa.RecordBatch], learned: str) -> pa.RecordBatch:
    t = pa.Table.from_batches(parts).combine_chunks()
    role, text = (pa.concat_arrays(t.column(c).chunks).cast(pa.string()) for c in ("role", "text"))
    return assemble(t.column("conv_id").to_pylist(), role, text, learned)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn."""
    return [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of what the formatted conversations and their loss spans hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv, text, loss in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))):
                turns = parse(text)
                said = "".join(f"{role}\n{said}\n" for role, said in turns)
                learned = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                rows.append((conv, len(turns), _sha(said), len(learned), _sha(learned), len(text)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], pa.string() if k in (2, 4) else pa.int64()) for k in range(6)],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return chats.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
