"""Hard negatives from an R-tree packed by sort-tile-recursive (STR).

Rows are dealt into slabs by a range partitioning on the label and the first
coordinates, which is STR's first sort; inside a slab, tiles are sorted and
cut by their widest coordinate again and again until a tile is a leaf of some
tens of vectors.  A leaf is stored as one row: its vectors and its minimum
bounding box (least and largest value of each coordinate, and of the label).

The inner product of an anchor with any vector in a box lies in an interval
that is a sum over the coordinates: each takes the box's end that is worse or
better for it.  A search keeps a queue of boxes by the upper end, best first.
A box is pruned when its labels cannot match, when its interval meets none of
the score windows still of interest, or when its upper end is strictly below
the k-th best score found (equal scores can still win by a smaller id); once
the best box in the queue is below, all others are.

On Spark the leaves are a table in the shared folder.  Anchors are the stated
query set: they are taken in blocks of a bounded number of rows, each sent to
all tasks, and every task searches its own leaves as one forest.  A task
returns at most k rows for an anchor, and a window over (anchor) or (anchor,
positive) merges the tasks' rows.  Positives of a block come first; their
scores make the windows of the negatives.

Defined cases: rows whose id, label or vector is null, or that hold a null,
NaN or infinite component, take no part; of several rows with one id the
least by label and components takes part, so an anchor is never its own
positive; equal scores are in order of the id; anchors without a positive and
positives without a negative in the window have no rows; shorter vectors are
filled up with zeros; an empty table gives an empty table; other columns are
not used.  Components so large that a product could pass 64 bits raise
ValueError.
"""

from __future__ import annotations

import heapq
import uuid
from bisect import insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopfloor.llm.tables import materialise, shared_dir
from shopfloor.llm.vectors import integer_vectors, largest, lists, stack, within

#: Vectors of a leaf and boxes of an upper node.
LEAF_ROWS, FAN_OUT = 64, 16
#: Vectors of a slab, leaves searched as one forest, anchors of a block.
SLAB_ROWS, FOREST_LEAVES, BLOCK_ANCHORS = 16_384, 1024, 2048
#: Sums up to this are exact as doubles, and BLAS may make them.
EXACT_DOUBLE = 1 << 53

LEAF = "low array<long>, high array<long>, label_low long, label_high long, ids array<long>, labels array<long>, q array<long>"
POSITIVE = "anchor long, id long, score long"
NEGATIVE = "anchor long, positive long, positive_score long, id long, score long"


# ------------------------------------------------------------------ packing
def str_tiles(rows: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Row numbers of each leaf: sort by the widest coordinate, cut into equal
    runs of whole leaves, and go on inside each run."""
    done, left = [], [np.arange(len(rows))]
    while left:
        tile = left.pop()
        leaves = -(-len(tile) // leaf)
        if leaves <= 1:
            if leaves:
                done.append(tile)
            continue
        own = rows[tile]
        spread = own.max(axis=0) - own.min(axis=0)
        # with P leaves and D coordinates still to cut by, P ** (1 / D) runs each
        depth = min(rows.shape[1], (leaves - 1).bit_length())
        runs = max(2, round(leaves ** (1 / depth)))
        order = tile[np.argsort(own[:, int(spread.argmax())], kind="stable")]
        size = -(-leaves // runs) * leaf
        left += [order[a : a + size] for a in range(0, len(order), size)][::-1]
    return done


def packed(rows: DataFrame, width: int, slabs: int) -> DataFrame:
    """The leaves of all rows (id, label, q)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)  # one slab
        ids, labels = (table.column(k).to_numpy().astype(np.int64) for k in (0, 1))
        q = stack(table.column(2), width)
        tiles = str_tiles(np.column_stack([labels, q]), LEAF_ROWS)
        box = lambda end: lists(np.stack([end(q[t], axis=0) for t in tiles]))
        columns = [box(np.min), box(np.max)]
        columns += [pa.array([int(end(labels[t])) for t in tiles]) for end in (np.min, np.max)]
        columns += [pa.array([v[t] for t in tiles], pa.list_(pa.int64())) for v in (ids, labels)]
        columns.append(pa.array([q[t].reshape(-1) for t in tiles], pa.list_(pa.int64())))
        yield pa.RecordBatch.from_arrays(columns, names=["low", "high", "label_low", "label_high", "ids", "labels", "q"])

    # equal vectors may lie in several slabs: the id is the last range key
    keys = ["label", *[F.get("q", F.lit(k)) for k in range(min(2, width))], "id"]
    return rows.select("id", "label", "q").repartitionByRange(slabs, *keys).mapInArrow(pack, LEAF)


class Forest:
    """Leaves with upper nodes over each ``FAN_OUT`` neighbours."""

    def __init__(self, leaves: list[dict], width: int):
        self.ids = [np.asarray(x["ids"]) for x in leaves]
        self.labels = [np.asarray(x["labels"]) for x in leaves]
        self.q = [np.asarray(x["q"]).reshape(-1, width) for x in leaves]
        level = [np.stack([np.asarray(x[k]) for x in leaves]) for k in ("low", "high")]
        level += [np.array([x[k] for x in leaves]) for k in ("label_low", "label_high")]
        levels, self.children, first = [level], [None] * len(leaves), 0
        while len(level[0]) > FAN_OUT:
            n = len(level[0])
            at = np.arange(0, n, FAN_OUT)
            self.children += [range(first + a, first + min(a + FAN_OUT, n)) for a in at.tolist()]
            first += n
            level = [end.reduceat(v, at, axis=0) for end, v in zip((np.minimum, np.maximum) * 2, level, strict=True)]
            levels.append(level)
        self.roots = range(first, first + len(level[0]))
        self.low, self.high, label_low, label_high = (np.concatenate([x[k] for x in levels]) for k in range(4))
        self.label_low, self.label_high = label_low.tolist(), label_high.tolist()

    def intervals(self, anchors: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest possible inner product of each anchor (rows) with
        a vector of each box (columns)."""
        kind = np.float64 if exact else np.int64
        up, down = np.maximum(anchors, 0).astype(kind), np.minimum(anchors, 0).astype(kind)
        low, high = self.low.T.astype(kind), self.high.T.astype(kind)
        return (up @ low + down @ high).astype(np.int64), (up @ high + down @ low).astype(np.int64)


def best_first(forest: Forest, upper: np.ndarray, wanted: Callable, below: Callable, visit: Callable) -> None:
    """Leaves in order of ``upper`` from the roots down: a box goes into the
    queue if ``wanted(box)``; the search ends at the first box ``below`` all
    that is still looked for."""
    queue = [(-upper[b], b) for b in forest.roots if wanted(b)]
    heapq.heapify(queue)
    while queue:
        bound, box = heapq.heappop(queue)
        if below(-bound):
            return
        if (children := forest.children[box]) is None:
            if wanted(box):  # what was found since may rule it out
                visit(box)
        else:
            for c in children:
                if wanted(c):
                    heapq.heappush(queue, (-upper[c], c))


# ---------------------------------------------------------------- searching
class Nearest:
    """The first k (score descending, id ascending) with a score in a window."""

    __slots__ = ("k", "least", "most", "found")

    def __init__(self, k: int, least: int | None = None, most: int | None = None):
        self.k, self.least, self.most, self.found = k, least, most, []

    def needs(self) -> int | None:
        """A score below this is of no use (None: every score is of use)."""
        return -self.found[-1][0] if len(self.found) == self.k else self.least

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        needs = self.needs()
        good = np.ones(len(scores), bool) if needs is None else scores >= needs
        if self.most is not None:
            good &= scores <= self.most
        if good.any():
            for s, i in zip(scores[good].tolist(), ids[good].tolist(), strict=True):
                insort(self.found, (-s, i))
            del self.found[self.k :]


def search_positives(forest: Forest, anchor, lower, upper, score, kept: Nearest) -> None:
    """Rows of the anchor's own label, without itself."""
    own_id, label = anchor

    def wanted(box) -> bool:
        needs = kept.needs()
        return forest.label_low[box] <= label <= forest.label_high[box] and (needs is None or upper[box] >= needs)

    def visit(box) -> None:
        own = (forest.labels[box] == label) & (forest.ids[box] != own_id)
        if own.any():
            kept.offer(score(forest.q[box][own]), forest.ids[box][own])

    best_first(forest, upper, wanted, lambda bound: (needs := kept.needs()) is not None and bound < needs, visit)


def search_negatives(forest: Forest, anchor, lower, upper, score, windows: list[Nearest]) -> None:
    """Rows of other labels, for each window of scores."""
    _, label = anchor

    def wanted(box) -> bool:
        if forest.label_low[box] == label == forest.label_high[box]:
            return False
        return any(lower[box] <= w.most and upper[box] >= w.needs() for w in windows)

    def visit(box) -> None:
        other = forest.labels[box] != label
        scores, ids = score(forest.q[box][other]), forest.ids[box][other]
        for w in windows:
            w.offer(scores, ids)

    best_first(forest, upper, wanted, lambda bound: all(bound < w.needs() for w in windows), visit)


def _searched(leaves: DataFrame, width: int, exact: bool, search: Callable, block: dict, start: Callable, rows: Callable, schema: str) -> DataFrame:
    """Run ``search`` for every anchor of the block over each task's leaves;
    ``start(i)`` makes an anchor's results, ``rows(i, results)`` its rows."""
    shared = leaves.sparkSession.sparkContext.broadcast(block)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value
        ids, labels, q = anchors["ids"], anchors["labels"], anchors["q"]
        kept = [start(anchors, i) for i in range(len(ids))]
        kind = np.float64 if exact else np.int64

        def go(held: list[dict]) -> None:
            forest = Forest(held, width)
            lower, upper = forest.intervals(q, exact)
            for i in range(len(ids)):
                own = q[i].astype(kind)
                score = lambda m, own=own: (m.astype(kind) @ own).astype(np.int64)
                search(forest, (int(ids[i]), int(labels[i])), lower[i].tolist(), upper[i].tolist(), score, kept[i])

        held: list[dict] = []
        for batch in batches:
            columns = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            boxes = {n: stack(columns[n], width) for n in ("low", "high")}
            for r in range(batch.num_rows):
                leaf = {n: columns[n][r].values.to_numpy(zero_copy_only=False) for n in ("ids", "labels", "q")}
                leaf |= {n: boxes[n][r] for n in boxes} | {n: columns[n][r].as_py() for n in ("label_low", "label_high")}
                held.append(leaf)
                if len(held) == FOREST_LEAVES:
                    go(held)
                    held = []
        if held:
            go(held)
        out = [row for i in range(len(ids)) for row in rows(anchors, i, kept[i])]
        columns = list(zip(*out, strict=True)) if out else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return leaves.mapInArrow(run, schema)


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k of each key over all tasks, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    label: Column | None = None,
    positives: int = 5,
    negatives: int = 5,
    low_percent: int = 80,
    high_percent: int = 100,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """For each anchor (rows where ``anchor``, over ``id`` and ``label``, is
    true) and each of its first ``positives`` rows of the same label, the
    first ``negatives`` rows of other labels whose score lies between
    ``low_percent`` and ``high_percent`` of the positive's: anchor, positive,
    rank, negative, positive_score, negative_score.  ``label``, over ``id``
    and ``label``, replaces the labels first."""
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, id_col, vector_col, label_col, scale)
    rows = rows.filter("id IS NOT NULL AND label IS NOT NULL").select(
        F.col("id").cast("long"), (F.col("label") if label is None else label).cast("long").alias("label"), "q"
    )
    rows = materialise(rows.groupBy("id").agg(F.min(F.struct("label", "q")).alias("r")).select("id", "r.label", "r.q"))
    width, most = largest(rows)
    bound = most * most * max(width, 1) * max(100, abs(low_percent), abs(high_percent))
    within(bound, 1 << 62, ["hard negatives"])
    exact = bound < EXACT_DOUBLE
    total = rows.count()
    leaves = materialise(packed(rows, width, max(1, -(-total // SLAB_ROWS))))

    chosen = rows.filter(anchor)
    blocks = -(-chosen.count() // BLOCK_ANCHORS)
    dealt = materialise(chosen.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(blocks, 1)))))
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    schema = "anchor long, positive long, rank int, negative long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for number in range(blocks):
        own = dealt.filter(F.col("block") == number).select("id", "label", "q").toArrow()
        block = {"ids": own.column(0).to_numpy(), "labels": own.column(1).to_numpy(), "q": stack(own.column(2), width)}
        ahead = _searched(
            leaves, width, exact, search_positives, block,
            lambda a, i: Nearest(positives),
            lambda a, i, kept: [(a["ids"][i], other, -s) for s, other in kept.found],
            POSITIVE,
        )
        best: dict[int, list] = {}
        for x in _first(ahead, ["anchor"], positives).collect():  # at most `positives` an anchor of the block
            w = (x["id"], x["score"], -(-low_percent * x["score"] // 100), high_percent * x["score"] // 100)
            if w[2] <= w[3]:
                best.setdefault(x["anchor"], []).append(w)
        some = np.isin(block["ids"], list(best))
        block = {k: v[some] for k, v in block.items()}
        block["windows"] = [best[i] for i in block["ids"].tolist()]
        around = _searched(
            leaves, width, exact, search_negatives, block,
            lambda a, i: [Nearest(negatives, low, high) for _, _, low, high in a["windows"][i]],
            lambda a, i, kept: [
                (a["ids"][i], w[0], w[1], other, -s) for w, n in zip(a["windows"][i], kept, strict=True) for s, other in n.found
            ],
            NEGATIVE,
        )
        _first(around, ["anchor", "positive", "positive_score"], negatives).select(
            "anchor", "positive", "rank", F.col("id").alias("negative"), "positive_score", F.col("score").alias("negative_score")
        ).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
