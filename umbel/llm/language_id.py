"""Language identification by a byte convolutional network trained in numpy (operator 8).

Bytes are embedded, filters of several widths slide over a fixed-length window, each filter keeps its
maximum, and a softmax layer reads the maxima. A text is cut into windows that cover all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 7
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
#: The training sample: all windows of about so many documents of each language, chosen by a seeded hash.
DOCS_PER_LANG = 700
EPOCHS = 3
#: Languages that are learned: those with most documents.
MAX_LANGS = 1000
NO_LANGUAGE = "und"
_BLOCK = 64

#: ASCII letters in lower case, other bytes as they are.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


def windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document of each window, its first byte, one past its last) of texts data[start:end]; an empty text has none."""
    n = -(-(ends - starts) // size)
    doc = np.repeat(np.arange(len(n)), n)
    first = starts[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * size
    return doc, first, np.minimum(first + size, ends[doc])


def _codes(data: np.ndarray, first: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """The windows' bytes, lower-cased, 0 beyond their ends."""
    at = first[:, None] + np.arange(size)
    inside = at < end[:, None]
    return np.where(inside, _LOWER[data[np.where(inside, at, 0)]], 0).astype(np.uint8)


class ByteNet:
    """The network. ``fit`` trains on windows; ``predict`` reads pair tables that ``freeze`` makes of the filters once."""

    def __init__(self, classes: list[str], seed: int = SEED, widths: tuple[int, ...] = WIDTHS, filters: int = FILTERS, embedding: int = EMBEDDING):
        rng = np.random.default_rng(seed)
        self.classes, self.widths, self.filters, self.rng = classes, widths, filters, rng
        self.p = {"e": rng.normal(0, 0.5, (256, embedding)), "w": rng.normal(0, 0.1, (len(widths) * filters, max(1, len(classes)))), "b": np.zeros(max(1, len(classes)))}
        for w in widths:
            self.p[f"k{w}"] = rng.normal(0, 1 / np.sqrt(w * embedding), (w * embedding, filters))
            self.p[f"c{w}"] = np.zeros(filters)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.tables: dict = {}

    def fit(self, codes: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 4e-3) -> ByteNet:
        """Adam on the cross-entropy; only the winning position of a filter passes its gradient on."""
        self.tables = {}
        p, d = self.p, self.p["e"].shape[1]
        m1, m2, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
        for _ in range(epochs):
            order = self.rng.permutation(len(codes))
            for i in range(0, len(order), batch):
                x, y = codes[order[i : i + batch]], labels[order[i : i + batch]]
                n, size = x.shape
                emb = p["e"][x]
                tops, wins, patches = [], [], []
                for w in self.widths:
                    cols = np.concatenate([emb[:, j : size - w + 1 + j] for j in range(w)], axis=2)
                    z = cols @ p[f"k{w}"] + p[f"c{w}"]
                    at = z.argmax(axis=1)
                    top = np.take_along_axis(z, at[:, None, :], 1)[:, 0]
                    tops.append(np.maximum(top, 0)), wins.append(at)
                    patches.append(cols[np.arange(n)[:, None], at])
                h = np.concatenate(tops, axis=1)
                s = h @ p["w"] + p["b"]
                s = np.exp(s - s.max(axis=1, keepdims=True))
                s /= s.sum(axis=1, keepdims=True)
                s[np.arange(n), y] -= 1
                s /= n
                g = {"w": h.T @ s, "b": s.sum(axis=0), "e": np.zeros_like(p["e"])}
                back = (s @ p["w"].T) * (h > 0)
                for q, w in enumerate(self.widths):
                    gz = back[:, q * self.filters : (q + 1) * self.filters]
                    g[f"k{w}"] = np.einsum("nfc,nf->cf", patches[q], gz)
                    g[f"c{w}"] = gz.sum(axis=0)
                    gcols = gz[:, :, None] * p[f"k{w}"].T[None]
                    for j in range(w):
                        bytes_at = x[np.arange(n)[:, None], wins[q] + j]
                        np.add.at(g["e"], bytes_at, gcols[:, :, j * d : (j + 1) * d])
                t += 1
                for k, v in g.items():
                    m1[k] += 0.1 * (v - m1[k])
                    m2[k] += 0.001 * (v * v - m2[k])
                    p[k] -= rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": {}}  # tasks get the parameters, some kilobytes, and make the tables themselves

    def freeze(self) -> ByteNet:
        """Tables from byte pairs to sums of filter taps, so that a filter of width w costs w/2 look-ups a position."""
        p, d = self.p, self.p["e"].shape[1]
        for w in self.widths:
            taps = [p["e"] @ p[f"k{w}"][j * d : (j + 1) * d] for j in range(w)]
            taps[0] = taps[0] + p[f"c{w}"]
            out = []
            for j in range(0, w, 2):
                out.append((taps[j][:, None] + taps[j + 1][None]).reshape(65536, -1).astype(np.float32) if j + 1 < w else taps[j].astype(np.float32))
            self.tables[w] = out
        return self

    def predict(self, codes: np.ndarray) -> np.ndarray:
        """Probabilities of the classes for each window."""
        if not self.tables:
            self.freeze()
        out = np.empty((len(codes), len(self.p["b"])), np.float32)
        for i in range(0, len(codes), _BLOCK):
            x = codes[i : i + _BLOCK].astype(np.intp)
            pair, size, tops = x[:, :-1] * 256 + x[:, 1:], x.shape[1], []
            for w in self.widths:
                n, z = size - w + 1, None
                for j, table in enumerate(self.tables[w]):
                    got = table.take(pair[:, 2 * j : 2 * j + n] if len(table) > 256 else x[:, 2 * j : 2 * j + n], axis=0)
                    z = got if z is None else np.add(z, got, out=z)
                tops.append(z.max(axis=1))
            s = np.maximum(np.concatenate(tops, axis=1), 0) @ self.p["w"] + self.p["b"]
            s = np.exp(s - s.max(axis=1, keepdims=True))
            out[i : i + _BLOCK] = s / s.sum(axis=1, keepdims=True)
        return out


def train(docs: DataFrame, where, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", seed: int = SEED, docs_per_lang: int = DOCS_PER_LANG, max_langs: int = MAX_LANGS) -> ByteNet:
    """A network learned from the rows of ``docs`` that satisfy ``where`` and have text and language.

    Of each of the ``max_langs`` most frequent languages about ``docs_per_lang`` documents are taken by a
    seeded hash of the id, which bounds what the driver gets, and all windows of these are learned from;
    languages are counted without reading texts. Rows without text teach nothing. Without any the network
    has no class.
    """
    rows = docs.where(where & F.col(lang_col).isNotNull())
    counted = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n"))
    counts = {r["lang"]: r["n"] for r in counted.orderBy(F.desc("n"), "lang").limit(max_langs).collect()}
    if not counts:
        return ByteNet([], seed)
    key = F.xxhash64(F.lit(seed), F.col(id_col))
    unit = F.pmod(key, F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, docs_per_lang / n))])
    chosen = rows.where((unit < share[F.col(lang_col)]) & (F.col(text_col) != "")).select(key.alias("key"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sample = chosen.orderBy("key", "lang", "text").limit(2 * docs_per_lang * len(counts)).collect()
    net = ByteNet(sorted({r["lang"] for r in sample}), seed)
    if not sample:
        return net
    index = {k: i for i, k in enumerate(net.classes)}
    codes, labels = [], []
    for r in sample:
        data = np.frombuffer(r["text"].encode("utf-8", "surrogatepass"), np.uint8)
        _, first, end = windows(data, np.array([0]), np.array([len(data)]))
        codes.append(_codes(data, first, end, WINDOW))
        labels += [index[r["lang"]]] * len(first)
    x, y = np.concatenate(codes), np.array(labels)
    lettered = _LETTER[x].sum(axis=1) > 16
    if lettered.any():
        x, y = x[lettered], y[lettered]
    return net.fit(x, y)


def _score(net: ByteNet, text: pa.Array) -> tuple[list, list]:
    """(language, score) of each text of an Arrow string array."""
    text = pc.fill_null(text, "")
    n = len(text)
    raw = text.cast(pa.large_binary())
    bounds = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + n + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] is not None and raw.buffers()[2].size else np.zeros(1, np.uint8)
    lettered = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
    total, weight = np.zeros((n, max(1, len(net.classes)))), np.zeros(n)
    if net.classes:
        doc, first, end = windows(data, bounds[:-1], np.where(lettered, bounds[1:], bounds[:-1]))
        for i in range(0, len(doc), 4096):
            d, x = doc[i : i + 4096], _codes(data, first[i : i + 4096], end[i : i + 4096], WINDOW)
            letters = _LETTER[x].sum(axis=1) + 1e-3
            np.add.at(total, d, net.predict(x) * letters[:, None])
            np.add.at(weight, d, letters)
    mean = total / np.maximum(weight, 1e-9)[:, None]
    best = mean.argmax(axis=1)
    known = lettered & bool(net.classes)
    return [net.classes[b] if k else NO_LANGUAGE for b, k in zip(best, known, strict=True)], [min(1.0, float(mean[i, b])) if k else 0.0 for i, (b, k) in enumerate(zip(best, known, strict=True))]


def identify(docs: DataFrame, net: ByteNet, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns of ``keep``, lang_pred string and score double for every row of ``docs``.

    A text that is null or has no letter is ``und`` with score 0. A window's vote weighs as many as its
    letters; the score is the winner's mean probability. Repeated rows are scored alike; an empty table
    gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = _score(net, b.column(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [f.name for f in out])

    narrow = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("text"))
    out = narrow.drop("text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    return narrow.mapInArrow(run, out).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")
