"""Vector bin packing of tokenised documents.

Each piece of a document is a vector (tokens, segments, loss-bearing tokens),
each sequence a bin with a limit for each of the three. A bin takes, again and
again, the waiting piece that fits and whose vector has the largest dot
product with what is left of the bin (both as shares of the limits). When no
whole piece fits, a waiting piece is cut so that the bin is filled. Stretches
of a document that fill a bin alone are cut off before.

Every task packs its own documents with a pool of at most ``pool`` waiting
pieces; what is left at the end of a task is cut into sequences whose lengths
are powers of two, so that they need no padding.

Defined results: null and empty texts give the end token alone; a document
bears loss on its tokens after the prompt (where a prompt column is named) and
never on its first; pieces of a document may be in several sequences; repeated rows are packed as often as
they occur; an empty table gives an empty table; other columns are not
carried (a piece is not a row of the input).

Scale: no shuffle. A sequence id is the task's partition number times 2^32
plus a count; a partition's rows are those of its files, so a task that runs
again gives the same pieces. A task holds its pool and one batch of texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import slices, texts_of
from .tokens import word_ids

SCHEMA = "doc_id long, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def vector(piece: tuple) -> tuple[int, int, int]:
    """Tokens, segments and loss-bearing tokens of a piece (document number, first token, number of tokens, first token with loss)."""
    _, start, length, loss_from = piece
    return length, 1, max(0, start + length - max(start, loss_from))


def head(piece: tuple, tokens: int) -> tuple[tuple, tuple]:
    """The piece cut after so many tokens."""
    doc, start, length, loss_from = piece
    return (doc, start, tokens, loss_from), (doc, start + tokens, length - tokens, loss_from)


class Packer:
    """The pool of waiting pieces of one task, and the sequences that it completes."""

    def __init__(self, limits: tuple[int, int, int]):
        self.limits = np.array(limits, np.int64)
        self.waiting: list[tuple] = []
        self.size = np.zeros((0, 3), np.int64)  # vectors of the waiting pieces

    def add(self, pieces: list[tuple]) -> None:
        self.waiting += pieces
        self.size = np.concatenate([self.size, np.array([vector(p) for p in pieces], np.int64).reshape(-1, 3)])

    def bins(self, keep: int) -> Iterator[list[tuple]]:
        """Filled sequences, while more than ``keep`` pieces wait."""
        live = np.ones(len(self.waiting), bool)
        count = len(self.waiting)
        share = self.size / self.limits
        tokens, loss = (np.ascontiguousarray(self.size[:, k]) for k in (0, 2))  # each piece is one segment
        while count > keep:
            pieces, left = [], self.limits.copy()
            fits = live & (tokens <= left[0]) & (loss <= left[2])
            while fits.any():
                choice = np.flatnonzero(fits)
                best = choice[np.argmax(share[choice] @ (left / self.limits))]
                pieces.append(self.waiting[best])
                left = left - self.size[best]
                live[best] = fits[best] = False
                count -= 1
                if not left[1]:
                    break
                fits &= tokens <= left[0]
                fits &= loss <= left[2]
            if count and left[0] and left[1]:  # no whole piece fits: cut the longest to fill the rest
                cut = np.flatnonzero(live)[np.argmax(self.size[live, 0])]
                _, start, _, loss_from = self.waiting[cut]
                room = int(min(left[0], left[2] + max(0, loss_from - start)))
                if room:
                    first, self.waiting[cut] = head(self.waiting[cut], room)
                    pieces.append(first)
                    self.size[cut] = vector(self.waiting[cut])
                    share[cut] = self.size[cut] / self.limits
                    tokens[cut], _, loss[cut] = self.size[cut]
            yield pieces
        self.waiting = [p for p, w in zip(self.waiting, live) if w]
        self.size = self.size[live]

    def rest(self) -> Iterator[list[tuple]]:
        """What still waits, packed; sequences that are not full are cut at powers of two."""
        for pieces in self.bins(0):
            total = sum(p[2] for p in pieces)
            if total == self.limits[0]:
                yield pieces
                continue
            for k in reversed(range(total.bit_length())):
                room, out = total & (1 << k), []
                while room:
                    first, after = head(pieces[0], min(room, pieces[0][2]))
                    pieces = [after, *pieces[1:]] if after[2] else pieces[1:]
                    out.append(first)
                    room -= first[2]
                if out:
                    yield out


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, max_tokens: int = 2048, max_segments: int = 256, max_loss: int = 2048,
    pool: int = 2048, prompt: str | None = None, digest: bool = False,
) -> DataFrame:
    """The pieces of all documents: ``SCHEMA``, ids with the end token.

    With ``digest`` the pieces carry ``ids_crc32`` (of the ids as little-endian
    unsigned 32-bit numbers) in place of the ids.
    """
    whole = min(max_tokens, max_loss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        packer = Packer((max_tokens, max_segments, max_loss))
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 32
        docs_of: dict[int, list] = {}  # number: id of the document, its token ids, tokens not yet placed
        number = 0

        def rows(bins: Iterator[list[tuple]]) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            out: list[tuple] = []
            for pieces in bins:
                offset = 0
                for piece in pieces:
                    doc, start, length, _ = piece
                    held = docs_of[doc]
                    out.append((held[0], start, length, held[1][4 * start : 4 * (start + length)], len(held[1]) // 4, sequence, offset, vector(piece)[2]))
                    offset += length
                    held[2] -= length
                    if not held[2]:
                        del docs_of[doc]
                sequence += 1
                if len(out) >= 512:
                    yield batch(out, digest)
                    out = []
            if out:
                yield batch(out, digest)

        for b in slices(batches, 64):
            prompts = texts_of(b, prompt) if prompt else [""] * b.num_rows
            full, fresh = [], []
            given_of, ids_of = words.encode_all(prompts), words.encode_all(texts_of(b))
            for doc_id, given, own in zip(b.column("doc_id").to_pylist(), given_of, ids_of):
                ids = given + own + end
                n, loss_from = len(ids) // 4, max(1, len(given) // 4)
                docs_of[number] = [doc_id, ids, n]
                for start in range(0, n, whole):
                    piece = (number, start, min(whole, n - start), loss_from)
                    full.append([piece]) if piece[2] == max_tokens else fresh.append(piece)
                number += 1
            yield from rows(iter(full))
            packer.add(fresh)
            if len(packer.waiting) > pool:
                yield from rows(packer.bins(pool // 2))
        yield from rows(packer.rest())

    schema = SCHEMA.replace("ids array<int>", "ids_crc32 long") if digest else SCHEMA
    return docs.select("doc_id", "text", *([prompt] if prompt else [])).mapInArrow(run, schema)


def batch(rows: list[tuple], digest: bool) -> pa.RecordBatch:
    """Rows of ``SCHEMA``; the ids of a row are bytes."""
    doc, start, length, ids, total, sequence, offset, loss = zip(*rows)
    long = [pa.array(x, pa.int64()) for x in (doc, start, length, total, sequence, offset, loss)]
    if digest:
        made, name = pa.array(map(zlib.crc32, ids), pa.int64()), "ids_crc32"
    else:
        ends = pa.array(np.cumsum([0, *length]), pa.int32())
        made, name = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), "<i4"))), "ids"
    names = ["doc_id", "start", "length", name, "doc_tokens", "sequence_id", "offset", "loss_tokens"]
    return pa.RecordBatch.from_arrays([*long[:3], made, *long[3:]], names=names)
