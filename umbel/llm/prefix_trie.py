"""Prefix trie of conversations by an LCP-aware external mergesort (operator 13).

A turn is a unit of 24 bytes (a digest of role and text, and the text's bytes), a conversation the string of its
units; texts stay where they are. Different conversations are dealt by range, each range is written as sorted
runs in which an entry carries how many units it shares with the one before it (LCP) and only the units after
these. A loser tree merges the runs of a range: of two entries the one that shares more with the last output comes
first, and only entries that share equally much are compared, from there on. The merged stream opens and closes
the nodes of one path on a stack. Nodes on the border of two ranges are summed afterwards.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbel.llm.store import keyed_lookup, settle

KEY, SIZE = 16, 8
UNIT = KEY + SIZE
#: Bytes of units of one range, which one task merges, and of one run.
RANGE_BYTES = 4 << 20
RUN_BYTES = 1 << 20
#: Ids of one conversation's copies that are joined at once: those that agree but for the last bits.
_ID_BITS = 10
_ENTRY = struct.Struct("<IIqq32s")
#: Bytes of an entry beside its units.
HEAD = _ENTRY.size
NOTHING = hashlib.sha256(b"").hexdigest()


def sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, seq): the units of each conversation in order of turns, null turns first; a null role or text counts as empty.

    Rows of equal turn numbers are ordered by the digests of their role and text and all stay. Rows without a
    conversation's id are left out. A conversation's units must fit into a task (24 bytes a turn).
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY)
    unit = F.concat(digest, F.lpad(F.lower(F.hex(F.octet_length(text).cast("bigint"))), 2 * SIZE, "0"))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).alias("turn"), unit.alias("unit"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "unit")))
    return rows.groupBy("conv_id").agg(F.unhex(F.array_join(F.transform(ordered, lambda x: x["unit"]), "")).alias("seq"))


def grafted(seqs: DataFrame, base: Column, turns: Column) -> DataFrame:
    """Each conversation with its first ``turns`` turns replaced by the first ``turns`` of the conversation ``base`` (none if there is none)."""
    own = seqs.select("conv_id", "seq", base.alias("base"), turns.alias("h"))
    heads = seqs.select(F.col("conv_id").alias("base"), F.col("seq").alias("head"))
    cut = F.col("h") * UNIT
    head = F.coalesce(F.substring("head", F.lit(1), cut), F.lit(b""))
    return own.join(heads, "base", "left").select("conv_id", F.concat(head, F.expr(f"substring(seq, {UNIT} * h + 1)")).alias("seq"))


def _distinct(seqs: DataFrame) -> DataFrame:
    """(seq, n, least, ends): different sequences with their number, smallest id, and the SHA-256 of their ids in order.

    Ids are joined in pieces of neighbouring ids, so that a copy found a million times moves as a thousand rows;
    the digest then reads one piece after the other.
    """
    pieces = seqs.select(F.unhex(F.substring(F.sha2("seq", 256), 1, 2 * KEY)).alias("k"), F.shiftright("conv_id", _ID_BITS).alias("place"), "conv_id", "seq").groupBy("k", "place").agg(
        F.first("seq").alias("seq"), F.count("*").alias("n"), F.min("conv_id").alias("least"), F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = head = sha = None
        done = []
        names = ["seq", "n", "least", "ends"]

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names)

        for b in batches:
            for k, seq, n, least, ids in zip(*(b.column(c).to_pylist() for c in ("k", "seq", "n", "least", "ids")), strict=True):
                if k == key:
                    head[1] += n
                    sha.update(b"," + ids.encode())
                    continue
                if key is not None:
                    done.append((*head, sha.digest()))
                key, head, sha = k, [seq, n, least], hashlib.sha256(ids.encode())
                if len(done) >= 4096:
                    yield batch()
                    done.clear()
        if key is not None:
            done.append((*head, sha.digest()))
            yield batch()

    return pieces.repartition("k").sortWithinPartitions("k", "place").mapInArrow(run, "seq binary, n bigint, least bigint, ends binary")


def shared(a: bytes, b: bytes, since: int) -> int:
    """Units that ``a`` and ``b`` have in common at their beginning, ``since`` of which are known."""
    at, end, step = since * UNIT, min(len(a), len(b)), UNIT
    while at < end:
        stop = min(end, at + step)
        if a[at:stop] != b[at:stop]:
            if stop - at == UNIT:
                break
            step = max(UNIT, (stop - at) // (2 * UNIT) * UNIT)
        else:
            at, step = stop, 2 * step
    return at // UNIT


def packed_run(rows: list[tuple[bytes, int, int, bytes]]) -> bytes:
    """Rows (seq, n, least, ends) as a sorted run: each with its LCP and the units after these."""
    rows.sort()
    out, last = [], b""
    for seq, n, least, ends in rows:
        lcp = shared(last, seq, 0)
        tail = seq[lcp * UNIT :]
        out += [_ENTRY.pack(lcp, len(tail), n, least, ends), tail]
        last = seq
    return b"".join(out)


def read_run(run: bytes) -> Iterator[tuple[int, bytes, int, int, bytes]]:
    """(lcp, seq, n, least, ends) of the entries of a packed run."""
    at, seq = 0, b""
    while at < len(run):
        lcp, length, n, least, ends = _ENTRY.unpack_from(run, at)
        at += _ENTRY.size
        seq = seq[: lcp * UNIT] + run[at : at + length]
        at += length
        yield lcp, seq, n, least, ends


def merged(runs: list[bytes]) -> Iterator[tuple[int, bytes, int, int, bytes]]:
    """The entries of all runs in order, each with the LCP to the one before it, by a loser tree."""
    k = len(runs)
    readers = [read_run(r) for r in runs]
    over = (-1, b"", 0, 0, b"")
    heads = [next(r, over) for r in readers]
    lcp = [h[0] for h in heads]  # to the last output; -1: nothing left

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs whose LCPs are to the same string; the loser's is then to the winner."""
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        if lcp[a] < 0:
            return a, b
        x, y = heads[a][1], heads[b][1]
        h = shared(x, y, lcp[a])
        if x[h * UNIT :] <= y[h * UNIT :]:
            lcp[b] = h
            return a, b
        lcp[a] = h
        return b, a

    losers, winners = [0] * k, [0] * k + list(range(k))
    for i in range(k - 1, 0, -1):
        winners[i], losers[i] = play(winners[2 * i], winners[2 * i + 1])
    best = winners[1] if k > 1 else 0
    while lcp[best] >= 0:
        yield lcp[best], *heads[best][1:]
        heads[best] = next(readers[best], over)
        lcp[best] = heads[best][0]
        i = (best + k) // 2
        while i:
            best, losers[i] = play(best, losers[i])
            i //= 2


_NODE = "key binary, parent_key binary, border boolean, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
_TYPES = [pa.binary(), pa.binary(), pa.bool_(), *[pa.int64()] * 7, pa.string()]


class _Node:
    __slots__ = ("key", "size", "n", "least", "ends", "children", "inner", "leaves", "saved", "before", "border", "rows")

    def __init__(self, key: bytes, size: int, before: bool, border: bool):
        self.key, self.size, self.before, self.border = key, size, before, border
        self.n, self.least, self.ends, self.children, self.inner, self.leaves, self.saved, self.rows = 0, None, None, 0, False, 0, 0, []


def nodes_of(stream: Iterator[tuple[int, bytes, int, int, bytes]]) -> list[list]:
    """Rows of _NODE of one range's merged entries; entries with n = 0 are the neighbours in the ranges before and after.

    Numbers of a node are those of its part in this range, such that the parts add up: it counts as new, as a child and with
    one sparing less only in the first range that has it, and as a leaf only if no entry goes on from it.
    """
    stack = [_Node(b"", 0, False, True)]
    out: list[list] = []

    def close(node: _Node, depth: int) -> None:
        up = stack[-1] if stack else None
        if up is not None:
            up.inner = True
        if not node.n:
            return
        leaf = node.ends is not None and not node.inner
        node.leaves += leaf
        node.saved += node.size * (node.n - (not node.before))
        row = [node.key, None, node.border, depth, node.least, None, node.n, node.children, node.leaves, node.saved, node.ends.hex() if node.ends else NOTHING]
        if not node.border:
            for r in node.rows:
                r[5] = node.least
        else:
            for r in node.rows:
                r[1] = node.key
        out.append(row)
        if up is not None:
            up.n += node.n
            up.least = node.least if up.least is None else min(up.least, node.least)
            up.children += not node.before
            up.leaves += node.leaves
            up.saved += node.saved
            up.rows.append(row)

    real = False
    for lcp, seq, n, least, ends in stream:
        while len(stack) > lcp + 1:
            close(stack.pop(), len(stack))
        before, after = not n and not real, not n and real
        real = real or n > 0
        if after:  # what is open now goes on in the next range
            for node in stack:
                node.border = True
        for i in range(lcp, len(seq) // UNIT):
            unit = seq[i * UNIT : (i + 1) * UNIT]
            key = hashlib.blake2b(stack[-1].key + unit, digest_size=KEY).digest()
            stack.append(_Node(key, int.from_bytes(unit[KEY:]), before, before or after))
        if before:
            stack[0].before = True
        if n:
            top = stack[-1]
            top.n, top.ends = top.n + n, ends
            top.least = least if top.least is None else min(top.least, least)
    while stack:
        close(stack.pop(), len(stack))
    return out


def trie(seqs: DataFrame) -> DataFrame:
    """One row for each different beginning of the sequences (conv_id, seq), from the empty one of depth 0.

    node_id (a digest of the path), conv_id (smallest member: its turn number
    ``depth`` has the node's role and text), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. Members are the conversations that begin with the node's turns, empty ones are members of the root.
    saved_tokens: over the subtree, the bytes of each node's text times its members but one. ends_sha256: of the ids of
    members without a further turn, in numerical order, joined by commas. An empty table gives no rows.
    """
    distinct = settle(_distinct(seqs), "sequences")
    total = distinct.agg(F.sum(F.octet_length("seq") + HEAD)).first()[0] or 0
    ranges = max(1, -(-total // RANGE_BYTES))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0

        def batch():
            run = packed_run(held)
            return pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([number], pa.int32()), *[pa.array([x], pa.binary()) for x in (run, held[0][0], held[-1][0])]], ["pid", "run", "entries", "low", "high"])

        for b in batches:
            for pid, seq, n, least, ends in zip(*(b.column(c).to_pylist() for c in ("pid", "seq", "n", "least", "ends")), strict=True):
                held.append((seq, n, least, ends))
                size += len(seq) + HEAD
                if size >= RUN_BYTES:
                    yield batch()
                    held, size, number = [], 0, number + 1
        if held:
            yield batch()

    dealt = distinct.repartitionByRange(ranges, "seq").withColumn("pid", F.spark_partition_id())
    runs = settle(dealt.mapInArrow(pack, "pid int, run int, entries binary, low binary, high binary"), "runs")
    ends = settle(runs.groupBy("pid").agg(F.min("low").alias("low"), F.max("high").alias("high")), "range-ends")
    beside = ends.select("pid", F.lag("pid").over(Window.orderBy("pid")).alias("prior"), F.lead("pid").over(Window.orderBy("pid")).alias("next"))
    of = lambda side, end, run: beside.select("pid", F.col(side).alias("at")).join(ends.select(F.col("pid").alias("at"), F.col(end).alias("seq")), "at").select("pid", F.lit(run).alias("run"), "seq")
    beside = of("prior", "high", -1).unionByName(of("next", "low", -2))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def out():
            rows = nodes_of(merged(held))
            for s in range(0, len(rows), 8192):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[s : s + 8192], strict=True), _TYPES, strict=True)], [c.split()[0] for c in _NODE.split(", ")])

        for b in batches:
            for pid, entries, seq in zip(*(b.column(c).to_pylist() for c in ("pid", "entries", "seq")), strict=True):
                if pid != at and held:
                    yield from out()
                    held = []
                at = pid
                held.append(entries if seq is None else packed_run([(seq, 0, 0, b"")]))
        if held:
            yield from out()

    both = runs.select("pid", "run", "entries", F.lit(None).cast("binary").alias("seq")).unionByName(beside.select("pid", "run", F.lit(None).cast("binary").alias("entries"), "seq"))
    nodes = settle(both.repartition("pid").sortWithinPartitions("pid", "run").mapInArrow(merge, _NODE), "nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    border = nodes.where("border").groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums,
        F.coalesce(F.max(F.when(F.col("ends_sha256") != NOTHING, F.col("ends_sha256"))), F.lit(NOTHING)).alias("ends_sha256"),
    )
    border = settle(border, "border-nodes")
    rest = ["key", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    open_ = nodes.where("NOT border AND parent_key IS NOT NULL").select(*rest, "parent_key").unionByName(border.select(*rest, "parent_key"))
    found = keyed_lookup(open_, border.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")), ["parent_key"], "key")
    inside = nodes.where("NOT border AND parent_key IS NULL").select(*rest, F.col("parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return found.select(F.col("key").alias("node_id"), *columns).unionByName(inside.select(F.col("key").alias("node_id"), *columns))
