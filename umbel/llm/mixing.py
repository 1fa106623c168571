"""Mixing sources to target weights by min-cost flow (operator 4).

Documents that the same sources can offer form a pattern. A pattern's tokens may be taken once at no cost,
a second time at cost 1, a third at cost 3: convex, so repetition is spread before it is deepened. The
flow from patterns to source quotas decides how much of each pattern every source takes; documents are
then selected by a seeded hash.
"""

from __future__ import annotations

import heapq
from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from umbel.llm.store import by_group, fresh, is_small, keyed_lookup, numbered, repeat_numbers, row_number, settle, word_count

SEED = 20240301
#: Cost of a text's first, second, third and every further copy, in order.
COPY_COSTS = (0, 1, 3, 6)
#: Patterns that the driver's flow tells apart. Rows of any further ones (those of least size) count as offered by one source
#: alone: quotas are met all the same, only the cost of repeating these texts in other sources is not seen.
MAX_PATTERNS = 10_000
#: Documents per hash bucket of a cell, on average; a cell's cut falls into one bucket.
BUCKET_DOCS = 256
#: Sums that the search for the best filling of a cut bucket tells apart. A bucket with more tokens is filled at a
#: resolution of its tokens / FILL_SUMS, so its sum is off by half of that times its documents at most.
FILL_SUMS = 1 << 20


def targets(sizes: dict, weights: dict, total: float | None = None, most: float = 3.0) -> dict:
    """Shares of ``total`` (default: all sizes) by weight; none above ``most`` times its size, the excess reshared by weight."""
    total = float(sum(sizes.values()) if total is None else total)
    out = dict.fromkeys(sizes, 0.0)
    open_, left = set(sizes), total
    while open_ and left > 0:
        weight = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / weight >= most * sizes[s]}
        if not full:
            out |= {s: left * weights[s] / weight for s in open_}
            break
        for s in full:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def min_cost_flow(supply: dict, offers: dict, quota: dict, costs: tuple[int, ...] = COPY_COSTS, unbounded: bool = True) -> dict:
    """Tokens that each source takes of each pattern, {(pattern, source): tokens}, as much as can flow at least total cost.

    ``supply``: tokens of a pattern's different texts. Every copy level holds that many, but for the last
    if it is ``unbounded``. ``offers``: {(pattern, source): tokens that this source can take of the pattern};
    ``quota``: what a source takes at most. Successive shortest paths by levels: each round finds the
    least cost at which anything still flows, then fills all paths of that cost at once. Costs are small
    whole numbers, so rounds are few, however many patterns there are.
    """
    to: list[int] = []
    room: list[int] = []
    price: list[int] = []
    edges: list[list[int]] = [[], []]  # node 0 gives, node 1 takes

    def node() -> int:
        edges.append([])
        return len(edges) - 1

    def edge(a: int, b: int, c: int, w: int) -> int:
        for x, y, n, k in ((a, b, c, w), (b, a, 0, -w)):
            edges[x].append(len(to))
            to.append(y), room.append(n), price.append(k)
        return len(to) - 2

    sources = {s: node() for s in quota}
    for s, x in sources.items():
        edge(x, 1, int(quota[s]), 0)
    total = sum(offers.values())
    patterns = {p: node() for p in supply}
    for p, x in patterns.items():
        for level, w in enumerate(costs):
            edge(0, x, total if unbounded and level == len(costs) - 1 else supply[p], w)
    middle = {(p, s): edge(patterns[p], sources[s], n, 0) for (p, s), n in offers.items()}
    height = [0] * len(edges)
    while True:
        far = [-1] * len(edges)  # shortest reduced distances from node 0
        queue = [(0, 0)]
        best = {0: 0}
        while queue:
            d, x = heapq.heappop(queue)
            if far[x] >= 0:
                continue
            far[x] = d
            for e in edges[x]:
                y = to[e]
                if room[e] > 0 and far[y] < 0:
                    n = d + price[e] + height[x] - height[y]
                    if n < best.get(y, n + 1):
                        best[y] = n
                        heapq.heappush(queue, (n, y))
        if far[1] < 0:
            return {k: room[e ^ 1] for k, e in middle.items() if room[e ^ 1]}
        for x in range(len(edges)):
            height[x] += far[1] if far[x] < 0 else min(far[x], far[1])
        _fill_paths(edges, to, room, price, height)


def _fill_paths(edges: list, to: list, room: list, price: list, height: list) -> None:
    """Send all that flows from node 0 to node 1 over edges of reduced cost 0, by blocking flows on breadth-first levels."""
    while True:
        level = [-1] * len(edges)
        level[0] = 0
        queue = deque([0])
        while queue:
            x = queue.popleft()
            for e in edges[x]:
                y = to[e]
                if room[e] > 0 and level[y] < 0 and price[e] + height[x] - height[y] == 0:
                    level[y] = level[x] + 1
                    queue.append(y)
        if level[1] < 0:
            return
        at = [0] * len(edges)
        path: list[int] = []
        x = 0
        while True:
            if x == 1:
                n = min(room[e] for e in path)
                for e in path:
                    room[e] -= n
                    room[e ^ 1] += n
                cut = next(i for i, e in enumerate(path) if room[e] == 0)
                x = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while at[x] < len(edges[x]):
                e = edges[x][at[x]]
                y = to[e]
                if room[e] > 0 and level[y] == level[x] + 1 and price[e] + height[x] - height[y] == 0:
                    break
                at[x] += 1
            if at[x] < len(edges[x]):
                path.append(edges[x][at[x]])
                x = to[path[-1]]
            elif not path:
                break
            else:
                level[x] = -1
                x = to[path.pop() ^ 1]
                at[x] += 1


def cycling(names: list) -> list[int]:
    """Weights 1, 2, 3, repeating."""
    return [1 + i % 3 for i in range(len(names))]


def mix(docs: DataFrame, sources, weigh=cycling, id_col: str = "doc_id", text_col: str = "text", most: int = 3, seed: int = SEED, row_id: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, row_id, size, source, pattern (array of sources), copies, taken,
    targets (array of double, in the order of pattern) and target (of the row's source).

    ``sources`` is a column: the source of a row, or an array of the sources that may take it.

    * A source: rows of equal texts are one text that stands in all of their sources, its pattern. Each
      source takes a text by way of its own rows, each ``most`` times at most, and every further copy of
      a text costs more, whichever source takes it; so quotas are filled by texts of which there is most.
    * An array: it is the row's pattern, and the row is taken ``most`` times at most by all sources
      together; source and target are null. A null or empty array is taken by none.

    Null is a source like others. ``weigh`` gives each source's weight from their list in order of code
    points, null last. Size is the number of words of the whole text (null: 0). ``copies`` counts whole
    takes; ``taken`` is in words, and where a quota ends within a document, one document of the cell (one
    source's part of a pattern) differs from copies * size, so each source's words sum to its rounded
    target. Rows of size 0 are copied as often as the fullest level of their cell, at least once. Repeated
    rows and null ids are rows like others. An empty table gives no rows. Selection depends on rows, seed
    and nothing else. ``row_id`` names a column of numbers to use instead of new ones. Ids may have any
    type that can be hashed.
    """
    listed = docs.select(sources).schema[0].dataType.typeName() == "array"
    text = F.coalesce(F.col(text_col), F.lit(""))
    pattern = F.array_sort(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>")))) if listed else F.array(sources)
    sized = settle(
        docs.select(
            F.col(id_col).alias("doc_id"), row_number(row_id).alias("row_id"), word_count(F.col(text_col)).alias("size"), pattern.alias("pattern"),
            (F.lit(None).cast("string") if listed else sources.cast("string")).alias("source"),
            F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"),
            F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(seed), text).alias("b")).alias("t"),
        ),
        "sized",
    )
    sized = _spread(sized)
    placed, supply = _listed(sized) if listed else _shared(sized)
    cells = placed.groupBy(*CELL).agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
    own: dict = defaultdict(int)
    offers: dict = {}
    for r in cells:
        for s in r["pattern"] if listed else [r["source"]]:
            own[s] += r["size"]
            offers[tuple(r["pattern"]), s] = most * r["size"]
    names = sorted(own, key=lambda s: (s is None, (s or "").encode()))
    total = sum(r["size"] for r in cells if r["pattern"])
    goal = targets({s: own[s] for s in names}, dict(zip(names, weigh(names), strict=True)), total, float(most))
    costs = COPY_COSTS[:most] if listed else COPY_COSTS
    flow = min_cost_flow(supply, offers, {s: round(goal[s]) for s in names}, costs, unbounded=not listed)
    plan = []
    for r in cells:
        p, n = tuple(r["pattern"]), r["size"]
        got = sum(flow.get((p, s), 0) for s in (p if listed else [r["source"]]))
        base, rest = divmod(got, n) if n else (int(bool(p)), 0)
        plan.append((list(p), r["source"], base, rest, max(1, r["rows"] // BUCKET_DOCS), [goal[s] for s in p], None if listed else goal[r["source"]]))
    shape = "pattern array<string>, source string, base int, rest bigint, buckets int, targets array<double>, target double"
    plans = settle(docs.sparkSession.createDataFrame(plan, shape), "mix-plan")
    dealt = keyed_lookup(placed, plans, CELL, "h").withColumn("bucket", F.pmod("h", "buckets").cast("int"))
    dealt = settle(dealt, "dealt")
    # The extra copy: whole buckets of a cell in order while the rest lasts, then the best of one bucket.
    heaps = settle(dealt.where("rest > 0").groupBy(*CELL, "rest", "bucket").agg(F.sum("size").alias("n")), "heaps")
    cuts = settle(_cuts(heaps), "cuts")
    marked = keyed_lookup(dealt, cuts, CELL, "h")
    chosen = settle(_fill(marked.where("bucket = cut AND size > 0")), "chosen")
    out = marked.join(chosen, "row_id", "left")
    extra = F.when(F.col("bucket") < F.col("cut"), 1).when(F.col("bucket") == F.col("cut"), F.coalesce(F.col("chosen"), F.lit(0))).otherwise(0)
    copies = F.least(F.col("base") + F.coalesce(extra, F.lit(0)), F.lit(most)).cast("int")
    taken = F.col("size") * copies + F.coalesce(F.col("words"), F.lit(0))
    return out.select("doc_id", "row_id", "size", "source", "pattern", copies.alias("copies"), taken.alias("taken"), "targets", "target")


def _spread(sized: DataFrame) -> DataFrame:
    """Rows that repeat another wholly with hashes of their own, so that no bucket gathers them."""
    numbers = repeat_numbers(settle(sized.select("row_id", F.xxhash64("h", "source", "pattern").alias("h")), "row-hashes"))
    if numbers is None:
        return sized
    numbers = F.broadcast(numbers) if is_small(numbers) else numbers.hint("merge")
    again = F.when(F.col("number").isNull(), F.col("h")).otherwise(F.xxhash64("h", "number"))
    return settle(sized.join(numbers, "row_id", "left").withColumn("h", again).drop("number"), "spread")


#: The key of a cell: what one source can take of one pattern.
CELL = ["pattern", "source"]


def _frequent(patterns: DataFrame) -> DataFrame:
    """(pattern, seen): the MAX_PATTERNS patterns of several sources that have most tokens; ``patterns`` has pattern and size."""
    sums = patterns.where("size(pattern) > 1").groupBy("pattern").agg(F.sum("size").alias("size"))
    return settle(sums.orderBy(F.desc("size"), "pattern").limit(MAX_PATTERNS).select("pattern", F.lit(True).alias("seen")), "patterns")


def _supply(patterns: DataFrame) -> dict:
    """{pattern: tokens} of a table with pattern and size."""
    return {tuple(r["pattern"]): r["size"] for r in patterns.groupBy("pattern").agg(F.sum("size").alias("size")).collect() if r["pattern"]}


def _listed(sized: DataFrame) -> tuple[DataFrame, dict]:
    """Rows with the patterns that the flow tells apart, and the tokens of each; other patterns give way to one of their sources."""
    marked = keyed_lookup(sized, _frequent(sized), ["pattern"], "h")
    one = F.array(F.get("pattern", F.pmod("h", F.greatest(F.size("pattern"), F.lit(1)).cast("bigint")).cast("int")))
    placed = marked.withColumn("pattern", F.when(F.col("seen") | (F.size("pattern") < 2), F.col("pattern")).otherwise(one)).drop("seen", "t")
    placed = settle(placed, "placed")
    return placed, _supply(placed)


def _shared(sized: DataFrame) -> tuple[DataFrame, dict]:
    """Rows with the sources of their texts as patterns, and the tokens of each pattern's different texts."""
    # one row a text; the sources that have it, and no rows, are what is merged
    texts = sized.groupBy("t").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.array_sort(F.flatten(F.collect_set("pattern"))).alias("pattern"))
    texts = settle(texts, "texts")
    texts = settle(keyed_lookup(texts, _frequent(texts), ["pattern"], "n"), "known-texts")
    whole = F.col("seen") | (F.size("pattern") < 2)
    split = texts.select("size", F.explode(F.when(whole, F.array("pattern")).otherwise(F.transform("pattern", lambda s: F.array(s)))).alias("pattern"))
    shared = texts.where("seen").select("t", "n", F.col("pattern").alias("all"))
    shared = settle(shared, "shared-texts")
    alone = sized.join(shared.select("t"), "t", "left_anti").drop("t")
    among = by_group(sized, shared, "t", "n", sized.count()).withColumn("pattern", F.col("all")).select(alone.columns)
    return settle(alone.unionByName(among), "placed"), _supply(split)


def fill(sizes: list[int], goal: int, sums: int = FILL_SUMS) -> list[int]:
    """Indices of a subset of positive ``sizes`` whose sum is nearest to ``goal`` (the lesser of two), preferring early ones.

    Reachable sums are the bits of one integer per size, in units of sum(sizes) / ``sums`` tokens, at
    least 1: sums are exact up to ``sums`` tokens, beyond off by half a unit for each size at most.
    """
    total = sum(sizes)
    if goal >= total:
        return list(range(len(sizes)))
    unit = -(-total // sums)
    steps = [(n + unit // 2) // unit for n in sizes]
    at = (goal + unit // 2) // unit
    reach = [1]
    for n in steps:
        reach.append(reach[-1] | reach[-1] << n)
    low = (reach[-1] & ((1 << (at + 1)) - 1)).bit_length() - 1
    above = reach[-1] >> at
    high = at + (above & -above).bit_length() - 1 if above else low
    at, out = (low if at - low <= high - at else high), []
    for i in range(len(sizes), 0, -1):
        if not reach[i - 1] >> at & 1:
            out.append(i - 1)
            at -= steps[i - 1]
    return out[::-1]


def settle_up(sizes: list[int], chosen: list[int], gap: int) -> dict[int, int]:
    """{index: words} to add to single copies (below 0: to leave out) so that the chosen copies give ``gap`` more in all.

    Missing words come from documents that are not chosen, excess ones go from those that are; mostly one is touched.
    """
    out, inside = {}, set(chosen)
    for i, n in enumerate(sizes):
        if not gap:
            break
        if gap > 0 and i not in inside:
            out[i] = min(gap, n)
        elif gap < 0 and i in inside:
            out[i] = -min(-gap, n)
        gap -= out.get(i, 0)
    return out


def _fill(edge: DataFrame) -> DataFrame:
    """(row_id, chosen, words) for documents of each cell's cut bucket: those that fill its gap best, and the words that are then
    still missing or in excess. A bucket has about BUCKET_DOCS documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for goal, docs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sizes = [x["size"] for x in docs]
                chosen = fill(sizes, goal)
                words = settle_up(sizes, chosen, goal - sum(sizes[i] for i in chosen))
                inside = set(chosen)
                rows += [(x["row_id"], int(i in inside), words.get(i, 0)) for i, x in enumerate(docs) if i in inside or i in words]
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int64()), strict=True)], ["row_id", "chosen", "words"])

    listed = edge.groupBy(*CELL, "gap").agg(F.sort_array(F.collect_list(F.struct("h", "size", "row_id"))).alias("docs"))
    return listed.select("gap", "docs").mapInArrow(run, "row_id bigint, chosen int, words bigint")


def _cuts(heaps: DataFrame) -> DataFrame:
    """(*CELL, cut, gap): the first bucket that the rest can't take whole, and what is left for it.

    Running sums over a cell's buckets go in two steps, blocks of buckets and then the buckets of
    one block, so that a window holds a thousandth of a cell's buckets.
    """
    block = 1024
    b = heaps.withColumn("block", (F.col("bucket") / block).cast("int"))
    blocks = b.groupBy(*CELL, "rest", "block").agg(F.sum("n").alias("n"))
    up = Window.partitionBy(*CELL).orderBy("block")
    last = blocks.withColumn("end", F.sum("n").over(up)).where(F.col("end") > F.col("rest"))
    first = last.groupBy(*CELL).agg(F.min_by(F.struct("block", (F.col("end") - F.col("n")).alias("before")), "block").alias("x")).select(*CELL, "x.*")
    # null is a source, too
    first = first.toDF(*[f"f_{c}" for c in first.columns])
    inside = b.join(first, [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in (*CELL, "block")]).withColumnRenamed("f_before", "before")
    up = Window.partitionBy(*CELL).orderBy("bucket")
    ends = inside.withColumn("end", F.col("before") + F.sum("n").over(up)).where(F.col("end") > F.col("rest"))
    return ends.groupBy(*CELL).agg(F.min_by(F.struct(F.col("bucket").alias("cut"), (F.col("rest") - F.col("end") + F.col("n")).alias("gap")), "bucket").alias("x")).select(*CELL, "x.*")


def take(docs: DataFrame, sources, weigh=cycling, id_col: str = "doc_id", text_col: str = "text", most: int = 3, seed: int = SEED) -> DataFrame:
    """The rows of the mix with all columns of ``docs``: a row stands as often as ``mix`` copies it, always whole, others not at all.

    So each source's words miss its target by what the best filling of its cut buckets leaves, half a document a cell at most.
    """
    columns, copies = docs.columns, fresh(docs, "copies")
    docs, rid = numbered(docs)
    chosen = mix(docs, sources, weigh, id_col, text_col, most, seed, rid).select(F.col("row_id").alias(rid), F.col("copies").alias(copies))
    chosen = settle(chosen.where(F.col(copies) > 0), "taken")
    kept = docs.join(chosen.hint("merge"), rid)
    return kept.select(*columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copies)).select(*columns)
