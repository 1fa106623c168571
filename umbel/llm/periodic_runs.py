"""Periodic runs of words by Main and Lorentz's divide and conquer on interned word ids (operator 11).

Texts of a batch are laid end to end, with a separator of its own after each, and the line is halved in aligned
blocks. A run lies whole in exactly one smallest block, whose midpoint it crosses. With EXPONENT periods or more
it has two of them on one side of the midpoint, so how far the words at the midpoint agree with those one period
on (or back), to the right and to the left, gives the run: a Z-function of each half and one across it hold these
lengths for all periods at once. In short blocks the same lengths are found for all midpoints of a level together.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbel.llm.store import fresh

#: A run has at least so many words, and so many periods.
LEAST, EXPONENT = 6, 4
#: Blocks of up to so many words are searched level by level, longer ones each by its Z-functions.
SHORT = 512
#: Words laid end to end at once; a longer text stands alone.
LINE = 1 << 17


def z_function(s: np.ndarray) -> np.ndarray:
    """How far each place of ``s`` agrees with its beginning; inside a known stretch places are settled in slices."""
    n = len(s)
    z = np.zeros(n, np.int64)
    if not n:
        return z
    z[0] = n
    starts = np.flatnonzero(s[1:] == s[0]) + 1  # all others are 0
    i, left, right, step = 0, 0, 0, 64
    while i < len(starts):
        at = int(starts[i])
        if at >= right:
            left, right, step = at, at + _agree(s, 0, at), 64
            z[at], at = right - at, at + 1
        else:
            # s[left:right] repeats the beginning (and itself, if it overlaps it): as at the mirrored place, up to the border,
            # but where the mirrored stretch ends exactly there and goes on
            places = np.arange(at, min(right, at + step))
            mirrored, room = z[places % left], right - places
            z[places] = np.minimum(mirrored, room)
            met = np.flatnonzero((mirrored == room) & (s[room] == s[right])) if right < n else places[:0]
            if len(met):
                left, step = at + int(met[0]), 64
                z[left + 1 : at + len(places)] = 0
                right += _agree(s, right - left, right)
                z[left], at = right - left, left + 1
            else:
                at, step = at + len(places), step * 2
        i = int(np.searchsorted(starts, at))
    return z


def _agree(s: np.ndarray, a: int, b: int) -> int:
    """Length of the common beginning of s[a:] and s[b:], a < b, by stretches that double."""
    n, done, step = len(s), 0, 8
    while b + done < n:
        k = min(step, n - b - done)
        differ = s[a + done : a + done + k] != s[b + done : b + done + k]
        first = int(differ.argmax())
        if differ[first]:
            return done + first
        done += k
        step *= 2
    return done


def _crossing(s: np.ndarray, low: int, mid: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, ends, periods) of the stretches of [low, high) of EXPONENT periods that meet ``mid``, by Z-functions."""
    most = (high - low) // EXPONENT
    u, v = s[low:mid], s[mid:high]
    none = np.array([np.iinfo(s.dtype).min], s.dtype)
    back_u, back_v = u[::-1], v[::-1]
    on, back = z_function(v), z_function(back_u)  # v against v, u against u backwards
    # v against the end of u, and u backwards against v backwards from where a period ends; no further than a period
    w, back_w = u[-most:], v[:most][::-1]
    across = z_function(np.concatenate([v[:most], none, w]))[len(v[:most]) + 1 :]
    across_back = z_function(np.concatenate([back_u[:most], none, back_w]))[len(back_u[:most]) + 1 :]
    pad = lambda z, p: np.where(p < len(z), z[np.minimum(p, len(z) - 1)], 0) if len(z) else np.zeros(len(p), np.int64)
    # a period to the right: words at mid agree with those at mid + p, words before mid with those before mid + p
    p = np.arange(1, min(most, len(v)) + 1)
    if len(p):
        left = across_back[len(back_w) - p]
        left = np.where(left >= p, p + pad(back, p), left)
        yield mid - left, mid + p + pad(on, p), p
    # a period to the left
    p = np.arange(1, min(most, len(u)) + 1)
    if len(p):
        right = across[len(w) - p]
        right = np.where(right >= p, p + pad(on, p), right)
        yield mid - p - pad(back, p), mid + right, p


def _level(s: np.ndarray, low: np.ndarray, mid: np.ndarray, high: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As ``_crossing`` for all blocks of one short size: of each period the midpoints whose words agree are extended together."""
    period, begin, end = np.ones(len(mid), np.int64), mid.copy(), mid.copy()  # the longest stretch of each block so far
    for p in range(1, size // EXPONENT + 1):
        room = p * EXPONENT <= high - low
        for right in (True, False):
            # two periods on this side of the midpoint: their first and last words agree
            fits = room & ((mid + 2 * p <= high) if right else (mid - 2 * p >= low))
            at = np.flatnonzero(fits)
            m = mid[at]
            a, b = (m, m + p - 1) if right else (m - 2 * p, m - p - 1)
            # a known stretch around both periods is all that a multiple of its period can give
            agree = (s[a] == s[a + p]) & (s[b] == s[b + p]) & ~((begin[at] <= a) & (b + p < end[at]) & (p % period[at] == 0))
            at = at[agree]
            if not len(at):
                continue
            base = mid[at] if right else mid[at] - p  # words on both sides of here are held against those p further
            a, b = _extended(s, base, p, low[at], -1), _extended(s, base, p, high[at] - p, 1) + p
            longer = b - a > np.maximum(end[at] - begin[at], 2 * p)
            x = at[longer]
            period[x], begin[x], end[x] = p, a[longer], b[longer]
            yield a, b, np.full(len(at), p)


def _extended(s: np.ndarray, at: np.ndarray, p: int, limit: np.ndarray, step: int) -> np.ndarray:
    """Each place moved by ``step`` while the word passed equals the one p further and ``limit`` is not passed."""
    ends, live, k = at.copy(), np.arange(len(at)), 8
    while len(live):
        x = (ends[live] if step > 0 else ends[live] - 1)[:, None] + step * np.arange(k)
        inside = x < limit[live, None] if step > 0 else x >= limit[live, None]
        x = np.where(inside, x, at[live, None])
        agree = inside & (s[x] == s[x + p])
        n = np.where(agree.all(axis=1), k, agree.argmin(axis=1))
        ends[live] += step * n
        live, k = live[n == k], min(4 * k, SHORT)
    return ends


def _runs_of_line(s: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows (start, end, period), places on the line, of all runs of texts that stand at [bounds[i], bounds[i + 1] - 1) before their separators."""
    found = []
    size = 8
    while size < 2 * len(s):
        mid = np.arange(size // 2, len(s), size)
        text = np.searchsorted(bounds, mid, "right") - 1
        low, high = np.maximum(mid - size // 2, bounds[text]), np.minimum(mid + size // 2, bounds[text + 1] - 1)
        live = (mid > low) & (mid < high) & (high - low >= LEAST)
        low, mid, high = low[live], mid[live], high[live]
        if size <= SHORT:
            parts = _level(s, low, mid, high, size)
        else:
            parts = (x for a, m, b in zip(low.tolist(), mid.tolist(), high.tolist(), strict=True) for x in _crossing(s, a, m, b))
        for a, b, p in parts:
            enough = b - a >= np.maximum(LEAST, EXPONENT * p)
            if enough.any():
                found.append(np.column_stack([a, b, p])[enough])
        size *= 2
    if not found:
        return np.zeros((0, 3), np.int64)
    all_ = np.concatenate(found)
    a, b, p = all_.T
    # what goes on beyond its block is found whole in a longer one; separators end every text
    whole = ((a == 0) | (s[a - 1] != s[a - 1 + p])) & (s[np.minimum(b, len(s) - 1)] != s[b - p])
    all_ = all_[whole]
    all_ = all_[np.lexsort((all_[:, 2], all_[:, 1], all_[:, 0]))]
    first = np.ones(len(all_), bool)
    first[1:] = (all_[1:, :2] != all_[:-1, :2]).any(axis=1)  # of equal intervals the smallest period
    return all_[first]


def runs_of(texts: list[list[bytes]]) -> list[np.ndarray]:
    """For each list of words its runs, rows (start, period, length) by start, then period."""
    ids: defaultdict[bytes, int] = defaultdict(count().__next__)
    lengths = np.array([len(w) for w in texts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(lengths + 1)])
    s = np.empty(int(bounds[-1]), np.int64)
    for i, words in enumerate(texts):
        s[bounds[i] : bounds[i + 1] - 1] = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    s[bounds[1:] - 1] = -1 - np.arange(len(texts))
    found = _runs_of_line(s, bounds) if len(texts) and lengths.max() >= LEAST else np.zeros((0, 3), np.int64)
    text = np.searchsorted(bounds, found[:, 0], "right") - 1
    out = np.column_stack([found[:, 0] - bounds[text], found[:, 2], found[:, 1] - found[:, 0]])
    out = out[np.lexsort((out[:, 1], out[:, 0], text))]
    return np.split(out, np.searchsorted(np.sort(text), np.arange(1, len(texts)))) if len(texts) else []


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not len(runs):
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    np.add.at(drop, runs[:, 0] + runs[:, 1], 1)
    np.add.at(drop, runs[:, 0] + runs[:, 2], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0)]


def find_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text and with n_words, runs and collapsed_text (underscores are appended to names that are taken).

    runs: array of (start, period, length) in words from 0, by start, then period: every longest stretch of LEAST
    words and EXPONENT periods or more, named by its smallest period. collapsed_text: the words outside runs and those
    of each run's first period, joined by one space. Words are runs of anything but the six ASCII blanks. A null
    or blank text has no words, no runs and an empty collapsed text. Texts are searched whole, whatever their length;
    repeated rows are rows, an empty table gives none.
    """
    names = [fresh(docs.drop(text_col), c) for c in ("n_words", "runs", "collapsed_text")]
    rest = [c for c in docs.columns if c != text_col]
    schema = docs.select(*rest, F.lit(0).cast("bigint").alias(names[0]), F.lit(None).cast("array<struct<start:bigint,period:bigint,length:bigint>>").alias(names[1]), F.lit("").alias(names[2])).schema
    kind = pa.struct([("start", pa.int64()), ("period", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            begin, held, size = 0, [], 0
            for i in range(b.num_rows):
                text = b.column(b.num_columns - 1)[i].as_py()
                held.append((text or "").encode("utf-8", "surrogatepass").split())
                size += len(held[-1]) + 1
                if size >= LINE or i == b.num_rows - 1:
                    runs = runs_of(held)
                    texts = [b" ".join(collapsed(w, r)).decode("utf-8", "surrogatepass") for w, r in zip(held, runs, strict=True)]
                    flat = np.concatenate(runs)
                    at = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
                    cells = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, j])) for j in range(3)], fields=list(kind))
                    new = [pa.array([len(w) for w in held], pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), cells), pa.array(texts, pa.string())]
                    kept = b.slice(begin, len(held)).columns[:-1]
                    yield pa.RecordBatch.from_arrays([*kept, *new], [*rest, *names])
                    begin, held, size = i + 1, [], 0

    return docs.select(*rest, text_col).mapInArrow(run, schema)
