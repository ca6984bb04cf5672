"""Quality rules: a conditional random field labels each line as content or boilerplate.

Base counts come first (words, symbols, repeated lines, words in repeated
three-word windows); a document with fewer than 50 words, or with more than
half of its words in repeated windows, fails. Of the others, those stay whose
content lines (Viterbi labels) hold at least ``min_content`` of the words.

The chain is fitted on the lines of a bounded sample of documents with a
quality label: lines of documents of quality 0 count as boilerplate, lines of
the others as content.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``; null and empty texts have
no word and fail; a text without line breaks is one line; without labelled
rows, or with labels of one kind only, every line is content; rows without an
id are judged alike and never fitted on; repeated rows are judged alike; other
columns pass through unless a column of the result has their name.

Scale: two scans and no shuffle of texts; what is sent to the driver is
bounded by ``max_rows`` and ``max_chars``; the model is a few dozen numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import labelled_sample, slices, texts_of

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
OUT = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "base_failed": "boolean", "kept": "boolean", "content_share": "double",
}
SIZE = 12


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that the text holds twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    _, pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, window, count = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = count[window] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def share_of(data: bytes, chars: bytes) -> float:
    return (len(data) - len(data.translate(None, chars))) / max(1, len(data))


def line_features(data: bytes, words: list[bytes], seen: bool) -> tuple:
    """What the labels of lines are read from; shares and logarithms, so that the length of a line alone decides little."""
    n = max(1, len(words))
    size = max(1, len(data))
    return (
        1.0, min(1.0, len(words) / 50), float(len(words) < 3),
        5 * share_of(data, SYMBOLS), 5 * share_of(data, b"!"), 2 * share_of(data, UPPER), 2 * share_of(data, DIGITS),
        len(set(words)) / n, 2 * sum(a == b for a, b in zip(words, words[1:])) / n,
        min(2.0, size / n / 10), float(data[-1:] in (b".", b"?", b"!")), float(seen),
    )


def lines_of(text: str) -> tuple[list[tuple], list[int], int]:
    """Features and word counts of the lines, and how many lines with a word equal an earlier one."""
    rows, counts, seen, dup = [], [], set(), 0
    for line in text.split("\n"):
        data = line.encode("utf-8", "surrogatepass")
        words = data.split()
        again = bool(words) and data in seen
        seen.add(data)
        dup += again
        rows.append(line_features(data.strip(SPACE), words, again))
        counts.append(len(words))
    return rows, counts, dup


@dataclass
class Model:
    weights: np.ndarray
    start: np.ndarray
    trans: np.ndarray


def _flat(parts: list[list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, where each document begins, and how many lines each has."""
    sizes = np.array([len(p) for p in parts], np.int64)
    x = np.array([r for p in parts for r in p], np.float64).reshape(-1, SIZE)
    first = np.zeros(len(x), bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    return x, first, sizes


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, max_chars: int = 32_000_000, steps: int = 150) -> Model:
    """A model from at most ``max_rows`` labelled rows with at most ``max_chars`` characters."""
    sample = labelled_sample(docs, labels, "quality", max_rows, max_chars)
    bad = (np.asarray(sample.column("y"), dtype=np.int64) == 0).astype(np.int64)
    content = Model(np.append(-crf.CLIP, np.zeros(SIZE - 1)), np.zeros(2), np.zeros((2, 2)))
    if not len(bad) or bad.min() == bad.max():
        return content
    x, first, sizes = _flat([lines_of(t)[0] for t in sample.column("text").to_pylist()])
    return Model(*crf.fit(x, SIZE, np.repeat(bad, sizes), first, steps))


def judge(docs: DataFrame, model: Model, min_words: int = 50, max_repeat_pct: int = 50, min_content: float = 0.5) -> DataFrame:
    """``docs`` with the columns of ``OUT``; ``kept`` is the verdict."""
    keep = [c for c in docs.columns if c not in OUT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows, parts, counts = [], [], []
            for t in texts_of(b):
                data = t.encode("utf-8", "surrogatepass")
                words = data.split()
                features, per_line, dup = lines_of(t)
                parts.append(features)
                counts.append(per_line)
                repeat = repeated_words(words)
                failed = len(words) < min_words or 100 * repeat > max_repeat_pct * len(words)
                space = len(data) - len(data.translate(None, SPACE))
                rows.append((len(words), len(t) - space, len(data) - len(data.translate(None, SYMBOLS)), dup, repeat, failed))
            x, first, sizes = _flat(parts)
            boiler = crf.viterbi(x @ model.weights, first, model.start, model.trans)
            words_in = np.array([c for p in counts for c in p], np.int64)
            starts = np.cumsum(sizes) - sizes
            content = np.add.reduceat(words_in * (1 - boiler), starts) if len(x) else np.zeros(0)
            total = np.array([r[0] for r in rows], np.int64)
            share = content / np.maximum(1, total)
            failed = np.array([r[5] for r in rows], bool)
            arrays = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
            arrays += [pa.array(failed), pa.array(~failed & (share >= min_content)), pa.array(share, pa.float64())]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *arrays], names=[*keep, *OUT])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), *(f"{k} {v}" for k, v in OUT.items())])
    return docs.select(*keep).mapInArrow(run, schema)
