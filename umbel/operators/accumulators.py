"""Metrics as mergeable accumulators: partial states per task, merged by group, read once.

A metric is a plug-in with a name, the columns it reads, and four functions on a state, a short array of numbers:
``zero``, ``update`` with a batch of rows, ``merge`` of two states, ``value``. Rows never move, only states do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Metric:
    """Base of plug-ins. States are arrays of double of one length; ``merge`` must not depend on order."""

    name = ""
    columns: tuple[str, ...] = ()

    def zero(self) -> np.ndarray:
        raise NotImplementedError

    def update(self, state: np.ndarray, *columns: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a + b

    def value(self, state: np.ndarray) -> float | None:
        raise NotImplementedError


class Accuracy(Metric):
    """Share in percent of rows whose first largest output stands at the label; rows without either don't count."""

    name = "Accuracy"

    def __init__(self, outputs: str = "outputs", label: str = "label"):
        self.columns = (outputs, label)

    def zero(self) -> np.ndarray:
        return np.zeros(2)

    def update(self, state, outputs, label):
        known = [(o, t) for o, t in zip(outputs, label, strict=True) if o is not None and len(o) and t is not None]
        return state + [sum(int(np.argmax(o)) == t for o, t in known), len(known)]

    def value(self, state):
        return 100 * state[0] / state[1] if state[1] else None


class Average(Metric):
    """Mean of a column over rows that have it, such as the triplets with a loss of each minibatch."""

    def __init__(self, column: str, name: str = "Average nonzero triplets"):
        self.columns, self.name = (column,), name

    def zero(self) -> np.ndarray:
        return np.zeros(2)

    def update(self, state, column):
        x = np.array([v for v in column if v is not None], float)
        return state + [x.sum(), len(x)]

    def value(self, state):
        return state[0] / state[1] if state[1] else None


class Deviation(Metric):
    """Standard deviation of a column: count, mean and sum of squares about it, merged without loss of figures."""

    def __init__(self, column: str, name: str = "Deviation"):
        self.columns, self.name = (column,), name

    def zero(self) -> np.ndarray:
        return np.zeros(3)

    def update(self, state, column):
        x = np.array([v for v in column if v is not None], float)
        return self.merge(state, np.array([len(x), x.mean(), ((x - x.mean()) ** 2).sum()])) if len(x) else state

    def merge(self, a, b):
        n = a[0] + b[0]
        if not n:
            return a
        gap = b[1] - a[1]
        return np.array([n, a[1] + gap * b[0] / n, a[2] + b[2] + gap * gap * a[0] * b[0] / n])

    def value(self, state):
        return float(np.sqrt(state[2] / state[0])) if state[0] else None


def evaluate(rows: DataFrame, metrics: list[Metric], by: str | None = None) -> DataFrame:
    """(by, metric, value) for every metric and group of ``by`` (bigint; all rows without it, and a null group is one, too).

    Each task updates one state a group and metric with its rows and sends only these; they are merged by group. Without
    rows there is no group, so an empty table gives no rows.
    """
    needed = list(dict.fromkeys(c for m in metrics for c in m.columns))
    group = (F.col(by) if by else F.lit(0)).cast("bigint").alias("__group")
    narrow = rows.select(group, *needed)
    schema = "__group bigint, at int, state array<double>"

    def batch(states: dict) -> pa.RecordBatch:
        keys = [(g, i) for g, s in states.items() for i in range(len(metrics))]
        return pa.RecordBatch.from_arrays(
            [pa.array([g for g, _ in keys], pa.int64()), pa.array([i for _, i in keys], pa.int32()), pa.array([states[g][i].tolist() for g, i in keys], pa.list_(pa.float64()))],
            ["__group", "at", "state"],
        )

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict = {}
        for b in batches:
            columns = dict(zip(needed, (c.to_pylist() for c in b.columns[1:]), strict=True))
            places: dict = {}
            for r, g in enumerate(b.column(0).to_pylist()):
                places.setdefault(g, []).append(r)
            for g, at in places.items():
                own = states.setdefault(g, [m.zero() for m in metrics])
                for i, m in enumerate(metrics):
                    own[i] = m.update(own[i], *[[columns[c][r] for r in at] for c in m.columns])
            if len(states) > 4096:
                yield batch(states)
                states = {}
        if states:
            yield batch(states)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        out: list[tuple] = []
        for b in batches:
            for g, i, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (g, i) != last:
                    if last is not None:
                        out.append((*last, metrics[last[1]].value(state)))
                    last, state = (g, i), metrics[i].zero()
                state = metrics[i].merge(state, np.array(s))
        if last is not None:
            out.append((*last, metrics[last[1]].value(state)))
        if out:
            g, i, v = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array([metrics[x].name for x in i]), pa.array(v, pa.float64())], ["__group", "metric", "value"])

    parts = narrow.mapInArrow(update, schema).repartition("__group", "at").sortWithinPartitions("__group", "at")
    found = parts.mapInArrow(merge, "__group bigint, metric string, value double")
    return found.withColumnRenamed("__group", by) if by else found.drop("__group")
