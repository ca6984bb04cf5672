"""Toxic spans and document scores from a linear-chain conditional random field.

Fitting, on a bounded sample of labelled documents:

1. A token's features are its word and its first 3 to 6 letters, hashed.
2. Document labels become token labels: a feature marks toxic tokens if it is
   tied to the toxic documents by a likelihood ratio beyond what any of the
   sample's features would reach by chance; a token of a toxic document that
   has such a feature is labelled toxic.
3. A two-label chain is fitted on the labelled tokens of the toxic documents
   and of as many others.
4. A logistic regression on the sum and the largest of a document's marginals
   gives the document score.

Scoring: forward-backward marginals of every token of every whole text; tokens
with a marginal of one half or more are joined to spans.

Defined results: null and empty texts have no token, and the score of a
document without toxic tokens; without labelled rows, or with labels of one
kind only, every score is the smoothed share of toxic labels (0 where there
are no labels); rows without an id are scored and never fitted on; repeated
rows are scored alike; other columns pass through (``score``, ``predicted``
and ``spans`` are replaced).

Scale: two scans and no shuffle of texts. What is sent to the driver and to
the executors is bounded by ``max_rows``, ``max_chars`` and ``2 ** BITS``
weights. A text is one row; chains are evaluated in blocks, not token by token.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import labelled_sample, slices, texts_of

BITS = 18
WORD = re.compile(r"[^\W_]+")
#: Marginals below this do not add to a document's sum: a long text is not toxic by its length.
FLOOR = 0.2
MAX_WORDS_CACHED = 500_000


def features(word: str) -> list[int]:
    """Hashed word and prefixes; always five, shorter words repeat the word itself."""
    w = word.lower()
    keys = [f"={w}", *(f"{n}{w[:n]}" if len(w) > n else f"={w}" for n in (3, 4, 5, 6))]
    return [zlib.crc32(k.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for k in keys]


class Numbers(dict):
    """Consecutive numbers of words."""

    def __missing__(self, word: str) -> int:
        self[word] = out = len(self)
        return out


class Emissions(dict):
    """Emission score by word; emptied when it holds too many words."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= MAX_WORDS_CACHED:
            self.clear()
        self[word] = out = float(self.weights[features(word)].sum())
        return out


@dataclass
class Model:
    weights: np.ndarray
    start: np.ndarray
    trans: np.ndarray
    document: np.ndarray


def marginals(texts: list[str], emissions: Emissions, model: Model) -> list[np.ndarray]:
    """The marginals of the tokens of each text."""
    words = [WORD.findall(t) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((emissions[w] for ws in words for w in ws), np.float64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    first = np.zeros(len(flat), bool)
    first[(ends - sizes)[sizes > 0]] = True
    p = crf.marginals(flat, first, model.start, model.trans)
    return np.split(p, ends[:-1]) if len(texts) else []


def evidence(p: list[np.ndarray]) -> np.ndarray:
    """A row for each document: 1, log of 1 + sum of its marginals, largest marginal."""
    rows = [(1.0, np.log1p(x[x >= FLOOR].sum()), x.max()) if len(x) else (1.0, 0.0, 0.0) for x in p]
    return np.array(rows, np.float64).reshape(-1, 3)


def marking(docs: list[np.ndarray], of_word: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Features that mark toxic tokens: bool by feature. ``docs`` are word numbers, ``of_word`` the features of each word."""
    n = np.array([(y == 0).sum(), (y == 1).sum()], float)
    df = np.zeros((2, 1 << BITS))
    for d, label in zip(docs, y):
        df[label, np.unique(of_word[np.unique(d)])] += 1
    k = df.sum(0)
    share = n[1] / max(1.0, n.sum())
    with np.errstate(divide="ignore", invalid="ignore"):
        rate = df[1] / k
        llr = np.where(df[1] > 0, df[1] * np.log(rate / share), 0) + np.where(df[0] > 0, df[0] * np.log((1 - rate) / (1 - share)), 0)
    return (rate > min(0.9, 0.5 + share / 2)) & (llr > np.log((k > 0).sum() + 1) + 3)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, max_chars: int = 48_000_000, steps: int = 40) -> Model:
    """A model from at most ``max_rows`` labelled rows with at most ``max_chars`` characters."""
    sample = labelled_sample(docs, labels, "toxic", max_rows, max_chars)
    texts, y = sample.column("text").to_pylist(), (np.asarray(sample.column("y"), dtype=np.int64) > 0).astype(np.int64)
    size = 1 << BITS
    model = Model(np.zeros(size), np.zeros(2), np.zeros((2, 2)), np.array([-crf.CLIP, 0.0, 0.0]))
    if not len(y):
        return model
    share = (y.sum() + 0.5) / (len(y) + 1)
    model.document = np.array([np.log(share / (1 - share)), 0.0, 0.0])
    if y.min() == y.max():
        return model
    number = Numbers()  # of the sample's words, so their count is bounded by its characters
    docs_of = [np.fromiter((number[w] for w in WORD.findall(t)), np.int32) for t in texts]
    of_word = np.array([features(w) for w in number], np.int32).reshape(-1, 5)
    del number
    marks = marking(docs_of, of_word, y)
    toxic = [i for i in np.flatnonzero(y) if len(docs_of[i])]
    others = [i for i in np.flatnonzero(y == 0) if len(docs_of[i])][: max(50, len(toxic))]
    chosen = toxic + others
    tokens = of_word[np.concatenate([np.zeros(0, np.int32), *(docs_of[i] for i in chosen)])]
    toxic_doc = np.repeat([y[i] for i in chosen], [len(docs_of[i]) for i in chosen])
    first = np.zeros(len(tokens), bool)
    first[np.cumsum([0, *(len(docs_of[i]) for i in chosen[:-1])])] = bool(chosen)
    target = (marks[tokens].any(1) & (toxic_doc == 1)).astype(np.int64)
    if target.any():
        model.weights, model.start, model.trans = crf.fit([tokens[:, k] for k in range(5)], size, target, first, steps)
        emissions = Emissions(model.weights)
        x = np.concatenate([evidence(marginals(texts[i : i + 256], emissions, model)) for i in range(0, len(texts), 256)])
        model.document = crf.logistic(x, y)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (without text) with score, predicted and spans (start, end, p; code points, end exclusive)."""
    keep = [c for c in docs.columns if c not in ("text", "score", "predicted", "spans")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        emissions = Emissions(m.weights)
        for b in slices(batches):
            texts = texts_of(b)
            p = marginals(texts, emissions, m)
            s = 1 / (1 + np.exp(-np.clip(evidence(p) @ m.document, -crf.CLIP, crf.CLIP)))
            spans = [_spans(t, x) if len(x) and x.max() >= 0.5 else [] for t, x in zip(texts, p)]
            yield pa.RecordBatch.from_arrays([
                *[b.column(c) for c in keep], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32)),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])))],
                names=[*keep, "score", "predicted", "spans"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema),
                        "score double", "predicted int", "spans array<struct<start:int,end:int,p:double>>"])
    return docs.select(*keep, "text").mapInArrow(run, schema)


def _spans(text: str, p: np.ndarray) -> list[dict]:
    """Neighbouring tokens with a marginal of one half or more, joined."""
    out: list[dict] = []
    before = -2
    for i, m in enumerate(WORD.finditer(text)):
        if p[i] >= 0.5:
            if before == i - 1:
                out[-1]["end"], out[-1]["p"] = m.end(), max(out[-1]["p"], float(p[i]))
            else:
                out.append({"start": m.start(), "end": m.end(), "p": float(p[i])})
            before = i
    return out
