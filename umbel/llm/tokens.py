"""Encoding with the public byte-level BPE vocabulary, and length histograms (operator 7)."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The split pattern of the byte-level pre-tokenizer (a fixed value of the format).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The format's table from printable characters to bytes: printable bytes stand for themselves, the rest follow from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids of texts, equal to those of ``tokenizers`` with add_special_tokens=False.

    The file's vocabulary is handed to ``tiktoken``, which merges the same pairs in the same order about
    five times faster; a text that it can't take goes to ``tokenizers`` itself. As there, the string of a
    special token in a text gives that token's id.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        to_byte = _byte_of()
        ranks = {bytes(map(to_byte.__getitem__, k)): v for k, v in spec["model"]["vocab"].items() if k not in special}
        self.special = set(special)
        self.fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)

    @functools.cached_property
    def slow(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str | None) -> np.ndarray:
        """Ids (uint32) of a whole text; null gives none."""
        if not text:
            return np.zeros(0, np.uint32)
        try:
            return self.fast.encode_to_numpy(text, allowed_special=self.special)
        except (KeyboardInterrupt, SystemExit, GeneratorExit):
            raise
        except BaseException:  # noqa: BLE001  its regex engine panics on some very long runs; a panic is no Exception
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    return Encoder(path)


def lengths(docs: DataFrame, path: str | None = None, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``keep`` and n_tokens bigint (null and empty texts: 0) for every row."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n = pa.array([len(enc.ids(x)) for x in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], [f.name for f in out])

    narrow = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("text"))
    out = narrow.drop("text").withColumn("n_tokens", F.lit(0).cast("bigint")).schema
    return narrow.mapInArrow(run, out).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_tokens")


def histogram(counted: DataFrame) -> DataFrame:
    """(n_tokens, docs) of a table with n_tokens: exact, as large as the number of different lengths."""
    return counted.groupBy("n_tokens").agg(F.count("*").alias("docs"))


def length_report(hist: DataFrame) -> DataFrame:
    """For every context limit that some document has as its length, what that limit gives.

    n_tokens (the limit), docs and tokens of that length, docs_fit and tokens_fit (documents not longer),
    docs_over and tokens_over (the suffix sums: documents longer), tokens_truncated (all documents cut to
    the limit), tokens_lost, rank_share (share of documents not longer, which answers quantiles). Between
    two rows the truncated total is linear, so ``truncated_total`` answers every limit. No documents, no rows.
    """
    # One row per different length: the histogram of any corpus is bounded by its longest document.
    up = Window.orderBy("n_tokens")
    tokens = F.col("n_tokens") * F.col("docs")
    h = hist.select(
        "n_tokens", "docs", tokens.alias("tokens"),
        F.sum("docs").over(up).alias("docs_fit"), F.sum(tokens).over(up).alias("tokens_fit"),
        F.sum("docs").over(up.rowsBetween(1, Window.unboundedFollowing)).alias("docs_over"),
        F.sum(tokens).over(up.rowsBetween(1, Window.unboundedFollowing)).alias("tokens_over"),
    ).na.fill(0, ["docs_over", "tokens_over"])
    cut = F.col("tokens_fit") + F.col("n_tokens") * F.col("docs_over")
    return h.select(
        "*", cut.alias("tokens_truncated"), (F.col("tokens_over") - F.col("n_tokens") * F.col("docs_over")).alias("tokens_lost"),
        (F.col("docs_fit") / (F.col("docs_fit") + F.col("docs_over"))).alias("rank_share"),
    )


def truncated_total(hist: DataFrame, limit: int) -> DataFrame:
    """One row: docs, tokens, truncated (all documents cut to ``limit``), docs_over."""
    n = F.col("n_tokens")
    return hist.agg(
        F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"),
        F.coalesce(F.sum(n * F.col("docs")), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.least(n, F.lit(limit)) * F.col("docs")), F.lit(0)).alias("truncated"),
        F.coalesce(F.sum(F.when(n > limit, F.col("docs"))), F.lit(0)).alias("docs_over"),
    )


def quantile(report: DataFrame, q: float) -> DataFrame:
    """One row, n_tokens: the least length that at least the share ``q`` of documents don't exceed (null if none)."""
    return report.where(F.col("rank_share") >= q).agg(F.min("n_tokens").alias("n_tokens"))
