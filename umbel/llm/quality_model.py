"""Quality classifier: naive Bayes support vectors (operator 5).

N-gram indicators are scaled by their log-count ratio between the classes, then a linear model is fitted
to the hinge loss by dual coordinate descent. A logistic curve, fitted on rows that the model didn't see,
turns margins into scores.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 11
#: Labelled rows the model is fitted on at most, chosen by a seeded hash of the id.
TRAIN_ROWS = 6000
#: A feature has to be in so many training rows.
MIN_ROWS = 4
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 12
PREDICT_AT = 0.3

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
#: Tokens that a worker remembers the hashes of, before it starts anew.
_REMEMBERED = 1 << 18
#: Texts that are Python objects at once.
_SLICE_ROWS = 256
#: Tokens that are worked on at once.
_BLOCK_TOKENS = 1 << 17
#: Top bits of a feature by which most of those outside the model are told apart without a search.
_SIEVE_BITS = 24
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _shape(token: str) -> str:
    if token.isalpha():
        return "a" if token.islower() else "U" if len(token) > 1 and token.isupper() else "A"
    return "d" if token.isdigit() else token[:4]


class _Tokens:
    """Numbers tokens and holds the hash of each in lower case and of its shape."""

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.hash = np.zeros((2, 1024), np.uint64)

    def _add(self, token: str) -> int:
        n = self.ids[token] = len(self.ids) + 1
        if n >= self.hash.shape[1]:
            self.hash = np.concatenate([self.hash, np.zeros_like(self.hash)], axis=1)
        self.hash[:, n] = xxhash.xxh64_intdigest(token.lower()), xxhash.xxh64_intdigest(_shape(token), 1)
        return n

    def hashes(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.ids) > _REMEMBERED:
            self.__init__()
        at = np.fromiter(map(self.ids.get, tokens, itertools.repeat(0)), np.intp, len(tokens))
        for i in np.flatnonzero(at == 0).tolist():
            at[i] = self.ids.get(tokens[i]) or self._add(tokens[i])
        return self.hash[0, at], self.hash[1, at]


_tokens = _Tokens()


def _joined(kind: int, *parts: np.ndarray) -> np.ndarray:
    out = parts[0] * _A + np.uint64(kind)
    for p in parts[1:]:
        out = (out ^ (out >> np.uint64(29))) * _B + p
    return (out ^ (out >> np.uint64(32))) * _C


def _grams(h: np.ndarray, s: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, their documents) of runs of tokens by their hashes; no gram spans two documents."""
    two, three = doc[:-1] == doc[1:], doc[:-2] == doc[2:]
    yield _joined(1, h), doc
    yield _joined(2, h[:-1][two], h[1:][two]), doc[1:][two]
    yield _joined(3, s[:-1][two], s[1:][two]), doc[1:][two]
    yield _joined(4, s[:-2][three], s[1:-1][three], s[2:][three]), doc[2:][three]
    again = np.unique(doc[1:][two & (h[:-1] == h[1:])])
    yield _joined(6, np.ones(len(again), np.uint64)), again


def batch_features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, numbers of their texts) of whole texts, in parts of bounded size; see ``features``.

    Texts are tokenised together, up to some _BLOCK_TOKENS tokens a part; a longer text takes several
    parts, each of which begins with the last two tokens of the one before.
    """
    counts = np.zeros(len(texts), np.int64)
    tokens: list[str] = []
    docs: list[int] = []
    lengths: list[int] = []

    def part():
        h, s = _tokens.hashes(tokens)
        yield from _grams(h, s, np.repeat(np.array(docs, np.int64), lengths))
        tokens.clear(), docs.clear(), lengths.clear()

    for i, text in enumerate(texts):
        if len(text or "") <= _BLOCK_TOKENS:
            found = _TOKEN.findall(text or "")
            counts[i] = len(found)
            tokens += found
            docs.append(i)
            lengths.append(len(found))
        else:
            yield from part()
            one = (m.group() for m in _TOKEN.finditer(text))
            last: list[str] = []
            while block := list(itertools.islice(one, _BLOCK_TOKENS)):
                counts[i] += len(block)
                tokens += last + block
                docs.append(i)
                lengths.append(len(tokens))
                last = tokens[-2:]
                yield from part()
        if len(tokens) > _BLOCK_TOKENS:
            yield from part()
    yield from part()
    sizes = np.array([int(n).bit_length() for n in counts], np.uint64)
    yield _joined(5, sizes), np.arange(len(texts))


def features(text: str | None) -> np.ndarray:
    """The n-gram features of one whole text as 64-bit hashes, with repeats; indicators are its distinct values.

    Tokens are runs of letters, digits or other signs. Features are tokens and pairs of tokens, pairs and
    triples of their shapes (lower, upper, title, digits, or the signs themselves), a mark for a token
    that follows itself, and the magnitude of the number of tokens, so that an empty text has one too.
    """
    return np.concatenate([f for f, _ in batch_features([text])])


class NaiveBayesSvm:
    """A fitted model: sorted ``keys`` with ``weight`` and ``square`` (of the log-count ratio), ``bias``, and the logistic curve (slope, shift)."""

    def __init__(self):
        self.bias, self.slope, self.shift = 0.0, 1.0, 0.0
        self._keep(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))

    def _keep(self, keys: np.ndarray, weight: np.ndarray, square: np.ndarray) -> None:
        self.keys, self.weight, self.square = keys, weight, square
        self.sieve = np.zeros(1 << _SIEVE_BITS, bool)
        self.sieve[keys >> np.uint64(64 - _SIEVE_BITS)] = True

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "sieve"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._keep(self.keys, self.weight, self.square)

    def fit(self, rows: list[np.ndarray], labels: list[int], seed: int = SEED) -> NaiveBayesSvm:
        """Fit on feature arrays and 0/1 labels. Without both classes the score is the smoothed share of label 1."""
        y = np.array(labels)
        if not len(y) or y.min() == y.max():
            self.slope, self.shift = 0.0, math.log((sum(labels) + 1) / (len(y) - sum(labels) + 1))
            return self
        order = np.random.default_rng(seed).permutation(len(y))
        held = np.zeros(len(y), bool)
        for c in (0, 1):  # every fifth row of each class calibrates
            held[[i for i in order if y[i] == c][::5]] = True
        fitted = [i for i in order if not held[i]]
        if len(set(y[fitted])) == 2:
            self._fit_margin([rows[i] for i in fitted], y[fitted], seed)
            self._calibrate(np.array([self.margin(rows[i]) for i in np.flatnonzero(held)]), y[held])
        curve = self.slope, self.shift
        self._fit_margin(rows, y, seed)
        self.slope, self.shift = curve
        return self

    def _fit_margin(self, rows: list[np.ndarray], y: np.ndarray, seed: int) -> None:
        rows = [np.unique(r) for r in rows]
        keys, n = np.unique(np.concatenate(rows), return_counts=True)
        keys = keys[n >= min(MIN_ROWS, len(rows))]
        x = []
        for r in rows:
            at = np.minimum(np.searchsorted(keys, r), max(0, len(keys) - 1))
            x.append(at[keys[at] == r] if len(keys) else at[:0])
        p, q = np.full(len(keys), SMOOTHING), np.full(len(keys), SMOOTHING)
        for ids, label in zip(x, y, strict=True):
            (p if label else q)[ids] += 1
        ratio = np.log(p / p.sum()) - np.log(q / q.sum())
        sign = np.where(y == 1, 1.0, -1.0)
        cost = COST * len(y) / (2 * np.where(y == 1, (y == 1).sum(), (y == 0).sum()))
        # dual coordinate descent: rows are scaled to length one and carry a constant for the bias
        value = [ratio[ids] / (np.linalg.norm(ratio[ids]) or 1.0) for ids in x]
        square = np.array([v @ v + 1 for v in value])
        w, bias, alpha, rng = np.zeros(len(keys)), 0.0, np.zeros(len(y)), np.random.default_rng(seed)
        for _ in range(EPOCHS):
            for i in rng.permutation(len(y)):
                gradient = sign[i] * (w[x[i]] @ value[i] + bias) - 1
                new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
                if step := (new - alpha[i]) * sign[i]:
                    w[x[i]] += step * value[i]
                    bias += step
                    alpha[i] = new
        self.bias = float(bias)
        self._keep(keys, w * ratio, ratio**2)

    def _known(self, found: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Codes (document * number of keys + key) of the features that training saw, with repeats."""
        some = self.sieve[found >> np.uint64(64 - _SIEVE_BITS)]
        found, doc = found[some], doc[some]
        at = np.minimum(np.searchsorted(self.keys, found), max(0, len(self.keys) - 1))
        hit = self.keys[at] == found if len(self.keys) else np.zeros(0, bool)
        return doc[hit] * len(self.keys) + at[hit]

    def _margins(self, codes: np.ndarray, n: int) -> np.ndarray:
        codes = np.sort(codes)
        codes = codes[np.concatenate([np.ones(min(1, len(codes)), bool), codes[1:] != codes[:-1]])]
        doc, at = np.divmod(codes, max(1, len(self.keys)))
        total, square = np.bincount(doc, self.weight[at], n), np.bincount(doc, self.square[at], n)
        return total / np.where(square > 0, np.sqrt(square), 1.0) + self.bias

    def margin(self, found: np.ndarray) -> float:
        """Margin of a feature array; features that training didn't see count for nothing."""
        return float(self._margins(self._known(found, np.zeros(len(found), np.int64)), 1)[0])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """0 to 1 for each whole text, higher: label 1 likelier."""
        if self.slope == 0:
            z = np.full(len(texts), self.shift)
        else:
            codes = np.concatenate([self._known(found, doc) for found, doc in batch_features(texts)])
            z = self.slope * self._margins(codes, len(texts)) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))

    def _calibrate(self, margins: np.ndarray, y: np.ndarray) -> None:
        """Logistic curve by Newton steps, with smoothed targets against certainty and a slope of 0 or more."""
        up, down = (y == 1).sum(), (y == 0).sum()
        t = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            s = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
            g = np.array([((s - t) * margins).sum() + 1e-3 * (a - 1), (s - t).sum()])
            v = np.maximum(s * (1 - s), 1e-6)
            h = np.array([[(v * margins**2).sum() + 1e-3, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-9]])
            step = np.linalg.solve(h, g)
            step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
            a, b = max(0.0, a - step[0]), b - step[1]
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.shift = float(a), float(b)

    def score(self, text: str | None) -> float:
        """The score of one text."""
        return float(self.scores([text])[0])


def train(docs: DataFrame, labels: DataFrame, where, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS, seed: int = SEED) -> NaiveBayesSvm:
    """A model from at most ``rows`` labelled documents whose labels satisfy ``where``; null labels and ids are left out."""
    known = labels.where(where & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    # a share of the hashes that holds somewhat more than ``rows``, so that no task sorts or sends more than its part of them
    h, n = F.xxhash64(F.lit(seed), "id"), known.count()
    share = F.pmod(h, F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.2 * (rows + 50) / max(1, n)))
    sample = known.where(share).orderBy(h, "id", "y").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # the sample is bounded by ``rows``, whatever the input, so it is what is sent to the documents
    found = texts.join(F.broadcast(sample), "id").orderBy("id", "y", "text").limit(2 * rows).collect()
    return NaiveBayesSvm().fit([np.unique(features(r["text"])) for r in found], [int(r["y"] == 1) for r in found], seed)


def score(docs: DataFrame, model: NaiveBayesSvm, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", predict_at: float = PREDICT_AT) -> DataFrame:
    """The columns of ``keep``, score double and predicted int (1 if the score reaches ``predict_at``) for every row.

    Null texts count as empty; those have features of their own and get a score too. Repeated rows are
    scored alike; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, _SLICE_ROWS):
                b = whole.slice(i, _SLICE_ROWS)
                s = model.scores(b.column(b.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= predict_at).astype(np.int32))], [f.name for f in out])

    narrow = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("text"))
    out = narrow.drop("text").withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    return narrow.mapInArrow(run, out).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "score", "predicted")
