"""Token ids and counts with the public tokenizers.

Both ways cut a text only where the cut provably changes no token, and look up
the cut-off stretches in a bounded cache, as words repeat far more often than
they are new; what is not in the cache is encoded by the library.

Token counts of huge texts use overlapping chunks with offsets: see
:func:`count_tokens`.

Defined results: null and empty texts have no token; special strings inside
texts are handled as the library does by default; repeated rows are counted
alike; other columns pass through unless a column of the result has their
name; an empty table gives an empty table.

Scale: no shuffle; a task holds one batch of texts and its cache. A text is
one row, however long it is; its chunks bound the memory of its encoding.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, texts_of

MAX_CACHED = 400_000
MAX_WORD = 64


LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Words that the tokenizer's normaliser only lowers, and that hold no contraction and no special string.
SIMPLE = re.compile(rf"[{LETTERS}0-9.,!?;:()\-\"#*$%&/=+_@\[\]{{}}~^]+")
#: Texts of such words, blanks and line feeds alone.
SIMPLE_TEXT = re.compile(rf"[{LETTERS}0-9.,!?;:()\-\"#*$%&/=+_@\[\]{{}}~^ \n]*")
#: A stop or comma at the end of a word that is not its own part: something else than a letter or digit stands before it.
RUN_OF_MARKS = re.compile(rf"(?<![{LETTERS}0-9])[.,](?= |$)")
#: What the tokenizer's pattern cuts such a word into.
PART = re.compile(rf"[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+")


def load(path: str):
    """The tokenizer, on the one core that a task has."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds:
    """Token ids of texts for a tokenizer that drops white space between words.

    Its normaliser replaces, composes and lowers characters without regard to
    what stands beyond white space, and no token holds white space: so the ids
    of a text are those of its stretches between blanks and line feeds. Simple
    stretches are cut further, into what the tokenizer's own pattern cuts them
    into; new parts are encoded many at a time, and the ends of their last
    tokens tell them apart.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _alone(self, texts: list[str]) -> dict[str, bytes]:
        made = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(texts, made)}

    def _together(self, parts: list[str]) -> dict[str, bytes]:
        """The ids of parts that are one word each to the tokenizer, encoded as one text."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, "<u4")
        ends = 4 * (np.flatnonzero(self.last[ids]) + 1)
        if len(ends) != len(parts):
            return self._alone(parts)
        raw, at = ids.tobytes(), [0, *ends.tolist()]
        return {p: raw[i:j] for p, i, j in zip(parts, at, at[1:])}

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        """The ids of new words; they are also kept, unless they are long."""
        plain = [w for w in new if w.isalpha() and w.islower() and w.isascii()]
        simple, odd = {}, []
        for w in new.difference(plain):
            if SIMPLE.fullmatch(w):
                simple[w] = PART.findall(w.lower())
            else:
                odd.append(w)
        whole: dict[str, bytes] = {}  # words of one part each
        for i in range(0, len(plain), 1024):
            whole |= self._together(plain[i : i + 1024])
        missing = list(set().union(*simple.values()).difference(self.parts))
        found: dict[str, bytes] = {}
        for i in range(0, len(missing), 1024):
            found |= self._together(missing[i : i + 1024])
        if len(self.parts) + len(found) > MAX_CACHED:
            known = {p: self.parts[p] for ps in simple.values() for p in ps if p in self.parts}
            self.parts.clear()
            self.parts |= known
        self.parts.update((p, v) for p, v in found.items() if len(p) <= MAX_WORD)
        found = self.parts if all(len(p) <= MAX_WORD for p in missing) else self.parts | found
        out = {w: found[ps[0]] if len(ps) == 1 else b"".join([found[p] for p in ps]) for w, ps in simple.items()}
        return whole | out | (self._alone(odd) if odd else {})

    @staticmethod
    def _cut(text: str) -> list[str]:
        """The stretches of a text. In a simple text letters are lowered at once, and a stop or comma after a letter or
        digit at the end of a word, which is a part of its own, is cut off: fewer words are new."""
        text = text.replace("\n", " ")
        if SIMPLE_TEXT.fullmatch(text):
            text = text.lower()
            if not RUN_OF_MARKS.search(text):
                text = (text + " ").replace(". ", " . ").replace(", ", " , ")
        return text.split(" ")

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if len(self.words) > MAX_CACHED // 2:  # the words of the last while stay, those not met since then go
            self.words, self.older = {}, self.words
        words, older, cut = self.words, self.older, [self._cut(t) for t in texts]
        ids = [list(map(words.get, ws)) for ws in cut]
        gaps = [[i for i, x in enumerate(found) if x is None] for found in ids]
        new = {ws[i] for ws, at in zip(cut, gaps) for i in at}
        words.update((w, older[w]) for w in new if w in older)
        learned = self._learn(new.difference(words))
        words.update(learned)
        for ws, found, at in zip(cut, ids, gaps):
            for i in at:
                found[i] = words[ws[i]]
        out = [b"".join(found) for found in ids]
        for w in learned:
            if len(w) > MAX_WORD:
                del words[w]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@functools.cache
def word_ids(path: str) -> WordIds:
    """One for each Python worker: its caches serve all tasks that the worker runs."""
    return WordIds(path)


BLANK = r" \t\n\r\x0b\x0c"
#: Between a character that is no white space and one of BLANK every token ends, whatever stands before and after.
STABLE = re.compile(rf"(?<=\S)(?=[{BLANK}])")
#: A text cut at all such places (rarer white space does not cut).
STRETCH = re.compile(rf"\s*\S+(?:[^\S{BLANK}]\s*\S*)*|\s+")


class Counter:
    """Token counts of texts for a byte-level tokenizer that never joins a character and white space after it.

    No token holds a non-blank character and white space after it, and the
    pattern that cuts a text into words looks ahead only: what stands before
    such a place has no influence on the tokens after it, nor the other way.
    Such places are the stable boundaries.
    """

    def __init__(self, path: str, chunk: int, overlap: int):
        self.tokenizer = load(path)
        self.chunk, self.overlap = chunk, overlap
        vocabulary = self.tokenizer.get_vocab()
        self.first = np.zeros(max(vocabulary.values()) + 1, bool)
        self.first[[i for token, i in vocabulary.items() if token[0] == "Ġ"]] = True  # tokens that begin with a blank
        self.counts: dict[str, int] = {}
        self.parts: dict[str, int] = {}

    def count(self, text: str) -> int:
        return self.count_all([text])[0]

    def count_all(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        cut = [STRETCH.findall(t) if len(t) <= self.chunk else [] for t in texts]
        counts = self.counts
        seen = set().union(*cut)
        learned = self._learn(seen.difference(counts))
        if len(counts) + len(learned) > MAX_CACHED:
            learned |= {p: counts[p] for p in seen if p in counts}
            counts.clear()
        counts.update(learned)
        out = [sum(map(counts.__getitem__, ps)) if len(t) <= self.chunk else self._long(t) for t, ps in zip(texts, cut)]
        for p in learned:
            if len(p) > MAX_WORD:
                del counts[p]
        return out

    def _learn(self, new: set[str]) -> dict[str, int]:
        """The numbers of tokens of new stretches.

        A blank and letters, perhaps with a full stop or a comma after them,
        which is a token of its own: encoded many at a time; the tokens that
        begin with a blank tell them apart.
        """
        simple, odd = {}, []
        for p in new:
            if p[0] == " " and p[1:].isalpha():
                simple[p] = p
            elif p[0] == " " and p[-1] in ".," and p[1:-1].isalpha():
                simple[p] = p[:-1]
            else:
                odd.append(p)
        missing = list(set(simple.values()).difference(self.parts))
        if len(self.parts) + len(missing) > MAX_CACHED:
            missing = list(set(simple.values()))
            self.parts.clear()
        for i in range(0, len(missing), 1024):
            some = missing[i : i + 1024]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, np.int64)
            starts = np.flatnonzero(self.first[ids])
            if len(starts) == len(some) and starts[0] == 0:
                self.parts.update(zip(some, np.diff(np.append(starts, len(ids))).tolist()))
            else:
                self.parts.update(self._alone(some))
        out = {p: self.parts[q] + (len(p) - len(q)) for p, q in simple.items()}
        return out | (self._alone(odd) if odd else {})

    def _alone(self, parts: list[str]) -> dict[str, int]:
        return {p: len(e) for p, e in zip(parts, self.tokenizer.encode_batch_fast(parts, add_special_tokens=False))}

    def _long(self, text: str) -> int:
        """Overlapping chunks, encoded with offsets and spliced at common stable boundaries."""
        size, total, done = len(text), 0, 0  # tokens up to `done` are counted
        begin, end = 0, min(size, self.chunk)
        here = self._offsets(text, begin, end)
        while end < size:
            overlap, common = self.overlap, None
            while common is None:
                second = max(done + 1, end - overlap)
                after = min(size, second + self.chunk + overlap)
                there = self._offsets(text, second, after)
                common = self._common(text, second, end, here[1], there[1])
                if second == done + 1:
                    break
                overlap *= 2  # no common boundary: a wider overlap
            if common is None:  # none in the whole chunk: a chunk twice as long
                end = min(size, begin + 2 * (end - begin))
                here = self._offsets(text, begin, end)
                continue
            total += int(((here[0] >= done) & (here[0] < common)).sum())
            begin, end, here, done = second, after, there, common
        return total + int((here[0] >= done).sum())

    @staticmethod
    def _common(text: str, second: int, end: int, here: np.ndarray, there: np.ndarray) -> int | None:
        """The last stable boundary in the overlap at which both chunks end a token."""
        stable = np.array([m.start() + second for m in STABLE.finditer(text[second:end])], np.int64)
        both = stable[(stable > second) & np.isin(stable, here) & np.isin(stable, there)]
        return int(both[-1]) if len(both) else None

    def _offsets(self, text: str, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each token of the chunk begins and ends, in characters of the text."""
        at = np.array(self.tokenizer.encode(text[begin:end], add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
        return at[:, 0] + begin, at[:, 1] + begin


@functools.cache
def counter(path: str, chunk: int, overlap: int) -> Counter:
    """One for each Python worker: its caches serve all tasks that the worker runs."""
    return Counter(path, chunk, overlap)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, chunk: int = 65_536, overlap: int = 1024) -> DataFrame:
    """``docs`` (without text) with n_bytes, n_tokens and over_limit.

    Texts of more than ``chunk`` characters are encoded in chunks that overlap.
    Two neighbouring chunks are spliced at the last stable boundary in their
    overlap at which both end a token. Where there is none (a long stretch
    without white space), the overlap is widened, at last to the whole chunk,
    and then the chunk itself.
    """
    keep = [c for c in docs.columns if c not in ("text", "n_bytes", "n_tokens", "over_limit")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer, chunk, overlap)
        for b in slices(batches, 64):
            texts = texts_of(b)
            n = np.array(own.count_all(texts), np.int64)
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in keep], pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit)],
                names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), "n_bytes long, n_tokens long, over_limit boolean"])
    return docs.select(*keep, "text").mapInArrow(run, schema)
