"""Hard negatives: for each anchor and each of its best positives, the best items of other labels whose score is in a window below the positive's.

Scores are inner products of integer vectors. With one more coordinate, sqrt(M - |x|^2) for items (M: the largest squared norm) and 0
for an anchor, the squared distance of anchor a and item x is M + |a|^2 - 2 score, so a window of scores is an annulus around the anchor.

The index is a multiway hyperplane tree (GNAT): a node has split points, and an item goes to the subtree of the nearest one. For
each two split points of a node, the tree keeps the range of distances from the first to all items of the second's
subtree. An anchor's annulus eliminates a subtree if, from any split point, it can't meet the range. Split points come from a
bounded sample; every item is put into a leaf, and ranges and sizes are those of all items. Leaves are compared exactly.

1. Positives: an anchor's own leaf first; its fifth best score there is the radius with which other leaves are eliminated.
2. Negatives: all windows of an anchor make one annulus.

A search joins blocks of anchors to blocks of the items of a leaf; a task holds one block of anchors and one batch of items,
and sends on only the best few for each anchor and window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, cut, parallelism, tidy

SAMPLE, FANOUT, DEPTH = 4096, 8, 2
ANCHORS, ITEMS = 20_000, 1_000_000  # of a block
ROWS, CELLS = 2000, 4_000_000  # of a batch; scores that are worked out at once
EXACT = 1 << 52  # sums of products under this are exact in doubles


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(0.0, most - (x * x).sum(axis=1)))])


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1) - 2 * x @ points.T
    return np.sqrt(np.maximum(0.0, square))


@dataclass
class Node:
    points: np.ndarray  # split points, augmented
    below: list[Node | int]  # for each a node, or the number of a leaf
    number: int
    near: np.ndarray = field(default_factory=lambda: np.empty(0))  # [i, j]: the least distance from point i to the items below j
    far: np.ndarray = field(default_factory=lambda: np.empty(0))


def spread(x: np.ndarray, n: int) -> np.ndarray:
    """n rows of x, or fewer if they repeat: the first, then always the one furthest from those taken."""
    taken, gap = [0], distances(x, x[:1])[:, 0]
    while len(taken) < n and gap.max() > 1e-6:
        taken.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(x, x[taken[-1:]])[:, 0])
    return x[taken]


class Tree:
    def __init__(self, sample: np.ndarray, most: float, fanout: int = FANOUT, depth: int = DEPTH):
        """sample: vectors that are split points or choose them; most: the largest squared norm of all items."""
        self.most, self.fanout, self.nodes, self.leaves = most, fanout, [], 0
        self.root = self._grow(augmented(sample, most) if len(sample) else np.zeros((1, sample.shape[1] + 1)), depth)

    def _grow(self, x: np.ndarray, depth: int) -> Node:
        node = Node(spread(x, self.fanout), [], len(self.nodes))
        self.nodes.append(node)
        own = distances(x, node.points).argmin(axis=1)
        for j in range(len(node.points)):
            if depth > 1:
                node.below.append(self._grow(x[own == j], depth - 1))
            else:
                node.below.append(self.leaves)
                self.leaves += 1
        return node

    def route(self, x: np.ndarray, node: Node | None = None) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
        """The leaf of each vector (augmented), and for each node they came to the ranges of their distances, as in near and far."""
        node = node or self.root
        d = distances(x, node.points)
        own, m = d.argmin(axis=1), len(node.points)
        near, far = np.full((m, m), np.inf), np.full((m, m), -np.inf)
        leaf, ranges = np.zeros(len(x), np.int32), {node.number: (near, far)}
        for j, below in enumerate(node.below):
            mine = own == j
            if not mine.any():
                continue
            near[:, j], far[:, j] = d[mine].min(axis=0), d[mine].max(axis=0)
            if isinstance(below, Node):
                leaf[mine], more = self.route(x[mine], below)
                ranges |= more
            else:
                leaf[mine] = below
        return leaf, ranges

    def reached(self, anchors: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """[anchor, leaf]: whether items of the leaf may be between near and far from the anchor (augmented)."""
        out, slack = np.zeros((len(anchors), self.leaves), bool), 1e-6 * (1 + self.most) ** 0.5

        def visit(node: Node, who: np.ndarray) -> None:
            d = distances(anchors[who], node.points)[:, :, None]
            low, high = near[who, None, None] - slack, far[who, None, None] + slack
            # from point i, items below j that are in the annulus are between d - high and d + high, and not all within low - d
            fit = ((node.far >= d - high) & (node.near <= d + high) & (d + node.far >= low)).all(axis=1)
            for j, below in enumerate(node.below):
                on = who[fit[:, j]]
                if not len(on):
                    continue
                if isinstance(below, Node):
                    visit(below, on)
                else:
                    out[on, below] = True

        visit(self.root, np.arange(len(anchors)))
        return out


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(rows, -1).astype(np.float64) if rows else np.empty((0, 0))


ROUTED = "id long, label long, anchor boolean, vector binary, leaf int, lo double, hi double"


def _route(batches: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[pa.RecordBatch]:
    """batches: id, label, anchor, vector. Rows of ROUTED; at the end rows without id with this task's ranges, whose leaf is -1 - their place among all ranges."""
    names, m = [c.split()[0] for c in ROUTED.split(", ")], tree.fanout
    near, far = np.full((len(tree.nodes), m, m), np.inf), np.full((len(tree.nodes), m, m), -np.inf)
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            lists = part.column(3)
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            leaf, ranges = tree.route(augmented(x.astype(np.float64), tree.most))
            for n, (lo, hi) in ranges.items():
                k = len(lo)
                near[n, :k, :k], far[n, :k, :k] = np.minimum(near[n, :k, :k], lo), np.maximum(far[n, :k, :k], hi)
            none = pa.nulls(part.num_rows, pa.float64())
            yield pa.record_batch([*part.columns[:3], pa.array([v.tobytes() for v in x.astype("<i4")], pa.binary()), pa.array(leaf), none, none], names)
    at = np.flatnonzero(np.isfinite(near))
    empty = [pa.nulls(len(at), t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.binary())]
    yield pa.record_batch([*empty, pa.array((-1 - at).astype(np.int32)), pa.array(near.ravel()[at]), pa.array(far.ravel()[at])], names)


SEARCH = "leaf int, salt int, block int, kind int, id long, label long, vector binary, low array<long>, high array<long>"


def _targets(batches: Iterator[pa.RecordBatch], tree: Tree, salts: list[int], blocks: int, at_home: bool | None) -> Iterator[pa.RecordBatch]:
    """batches: id, label, vector, leaf, low, high (bounds of scores; null: none). Rows of SEARCH: each anchor for each block of items that its annulus may meet: only those of its own leaf, only others, or all."""
    names = [c.split()[0] for c in SEARCH.split(", ")]
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            n = part.num_rows
            x, home = _matrix(part.column(2), n), part.column(3).to_numpy()
            if not n:
                continue
            least = np.array([-np.inf if v is None or None in v else min(v) for v in part.column(4).to_pylist()])
            most = np.array([np.inf if v is None or None in v else max(v) for v in part.column(5).to_pylist()])
            square = tree.most + (x * x).sum(axis=1)
            radius = lambda score: np.sqrt(np.maximum(0.0, square - 2 * score))
            to = tree.reached(np.column_stack([x, np.zeros(n)]), radius(most), radius(least))
            if at_home is not None:
                is_home = home[:, None] == np.arange(tree.leaves)
                to = is_home if at_home else to & ~is_home
            row, leaf = np.nonzero(to)
            times = np.array(salts)[leaf]
            row, leaf = np.repeat(row, times), np.repeat(leaf, times)
            salt = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            take = lambda c: part.column(c).take(pa.array(row))
            block = part.column(0).to_numpy() % blocks
            yield pa.record_batch([pa.array(leaf.astype(np.int32)), pa.array(salt.astype(np.int32)), pa.array(block[row].astype(np.int32)), pa.array(np.zeros(len(row), np.int32)), take(0), take(1), take(2), take(4), take(5)], names)


FOUND = "anchor_id long, slot int, id long, score long"


class Best:
    """The best `most` items of each slot (an anchor's window): greater scores first, then smaller ids."""

    def __init__(self, low: np.ndarray, high: np.ndarray, most: int):
        self.low, self.high, self.most = low, high, most  # [anchor, window]
        self.slot, self.id, self.score = (np.empty(0, np.int64) for _ in range(3))

    def add(self, anchor: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Items that some window of an anchor may take."""
        for j in range(self.low.shape[1]):
            fit = (score >= self.low[anchor, j]) & (score <= self.high[anchor, j])
            self.slot = np.concatenate([self.slot, anchor[fit] * self.low.shape[1] + j])
            self.id, self.score = np.concatenate([self.id, ids[fit]]), np.concatenate([self.score, score[fit].astype(np.int64)])
        order = np.lexsort([self.id, -self.score, self.slot])
        slot = self.slot[order]
        first = np.searchsorted(slot, slot)
        order = order[np.arange(len(slot)) - first < self.most]
        self.slot, self.id, self.score = self.slot[order], self.id[order], self.score[order]
        full = np.flatnonzero(np.bincount(self.slot, minlength=self.low.size) == self.most)
        last = np.searchsorted(self.slot, full, "right") - 1
        self.low.ravel()[full] = self.score[last]  # what comes later must be as good as the last


def _search(batches: Iterator[pa.RecordBatch], same: bool, most: int) -> Iterator[pa.RecordBatch]:
    """batches: SEARCH by leaf, salt, block and kind: anchors, then items. For each anchor and window the best items of this block, of its own label or of others."""
    names, now, best = [c.split()[0] for c in FOUND.split(", ")], None, None
    held: list[pa.RecordBatch] = []
    x = ids = labels = None

    def done() -> Iterator[pa.RecordBatch]:
        if best is not None:
            w = best.low.shape[1]
            yield pa.record_batch([pa.array(ids[best.slot // w]), pa.array((best.slot % w).astype(np.int32)), pa.array(best.id), pa.array(best.score)], names)

    for batch in batches:
        key = np.array([batch.column(i).to_numpy() for i in range(4)]).reshape(4, -1)
        edges = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])).tolist() if batch.num_rows else []
        for start, end in zip(edges, [*edges[1:], batch.num_rows], strict=True):
            part, block = batch.slice(start, end - start), tuple(key[:3, start].tolist())
            if block != now:
                yield from done()
                now, held, best = block, [], None
            if key[3, start] == 0:
                held.append(part)
                continue
            if best is None:
                if not held:
                    continue  # no anchor comes to this block
                anchors = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                x, ids, labels = _matrix(anchors.column(6), anchors.num_rows), anchors.column(4).to_numpy(), anchors.column(5).to_numpy()
                bounds = lambda c, none: np.array([[none if v is None else v for v in row] for row in anchors.column(c).to_pylist()], np.float64)
                best = Best(bounds(7, -np.inf), bounds(8, np.inf), most)
            step = max(1, CELLS // min(ROWS, part.num_rows))
            for i in range(0, part.num_rows, ROWS):
                some = part.slice(i, ROWS)
                y, own, label = _matrix(some.column(6), some.num_rows), some.column(4).to_numpy(), some.column(5).to_numpy()
                for a in range(0, len(x), step):
                    score = x[a : a + step] @ y.T
                    ok = ((labels[a : a + step, None] == label) == same) & (ids[a : a + step, None] != own)
                    ok &= (score >= best.low[a : a + step].min(axis=1)[:, None]) & (score <= best.high[a : a + step].max(axis=1)[:, None])
                    row, column = np.nonzero(ok)
                    best.add(row + a, own[column], score[row, column])
    yield from done()


def _top(found: DataFrame, n: int, *keys: str) -> DataFrame:
    """The best n of each group, with their place from 1 on as rank."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= n)


def _items(items: DataFrame, anchors: Column, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """id, label, anchor and vector of the items that take part, one for each id."""
    given = items.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(vector_col).cast("array<bigint>").alias("vector"))
    given = given.filter("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL)")
    again = cut(given.groupBy("id").count().filter("count > 1").select("id"))
    if again.isEmpty():
        return given
    least = given.join(again, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "vector", "anchor")).alias("v")).select("id", "v.label", "v.anchor", "v.vector")
    return given.join(again, "id", "left_anti").unionByName(least)


def mine_negatives(
    items: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, sample: int = SAMPLE, fanout: int = FANOUT, depth: int = DEPTH, block: tuple[int, int] = (ANCHORS, ITEMS),
    id_col: str = "id", label_col: str = "label", vector_col: str = "vector",
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    anchors: which items are anchors. An item's score is its inner product with the anchor. Greater scores come first, then smaller ids.
    Positives are the first `positives` other items of an anchor's label; negatives of one are the first `negatives`
    items of other labels whose score is from `low` to `high` percent of its score.
    Cases: items without id, label or vector, or with a null in the vector, take no part; of rows that share an id, the one
    of the smallest label and vector does; vectors of several lengths, and squared norms of 2 ** 52 or more, are errors; an anchor
    without positives, or a positive without negatives, has no rows; an empty table gives none; other columns are not read.
    The tree is fit on `sample` items (those of the smallest hashes of their ids) and has fanout ** depth leaves at most.
    """
    spark = items.sparkSession
    scratch, parts = Scratch(spark, "negatives"), parallelism(spark)
    given = _items(items, anchors, id_col, label_col, vector_col)
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    most, least_size, most_size, n_anchors = given.agg(F.max(square), F.min(F.size("vector")), F.max(F.size("vector")), F.count_if("anchor")).first()
    if least_size != most_size:
        raise ValueError(f"vectors have {least_size} to {most_size} components")
    if (most or 0) >= EXACT:
        raise ValueError(f"a squared norm of {most} is too large for exact scores")
    few = given.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").collect()  # at most `sample` rows
    tree = Tree(np.array([r.vector for r in few], np.float64).reshape(len(few), most_size or 0), most or 0.0, fanout, depth)

    try:
        routed = scratch.keep(given.mapInArrow(lambda b: tidy(_route(b, tree)), ROUTED), "routed")
        near, far = np.full(len(tree.nodes) * fanout**2, np.inf), np.full(len(tree.nodes) * fanout**2, -np.inf)
        for r in routed.filter("leaf < 0").groupBy("leaf").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():  # a row for each two split points of a node
            near[-1 - r.leaf], far[-1 - r.leaf] = r.lo, r.hi
        for node in tree.nodes:
            k = len(node.points)
            node.near, node.far = (v.reshape(-1, fanout, fanout)[node.number, :k, :k] for v in (near, far))
        held = routed.filter("leaf >= 0")
        sizes = {r.leaf: r["count"] for r in held.groupBy("leaf").count().collect()}  # a row for each leaf
        salts = [-(-sizes.get(i, 0) // block[1]) or 1 for i in range(tree.leaves)]
        blocks = max(1, -(-n_anchors // block[0]))
        asked = held.filter("anchor").select("id", "label", "vector", "leaf")

        salt = F.pmod(F.xxhash64("id"), F.element_at(F.array(*map(F.lit, salts)), F.col("leaf") + 1)).cast("int")
        none = F.lit(None).cast("array<bigint>")
        rows = held.select("leaf", salt.alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", "label", "vector", none.alias("low"), none.alias("high"))

        def search(anchors: DataFrame, same: bool, n: int, at_home: bool | None) -> DataFrame:
            """anchors: those asked, with low and high."""
            sent = anchors.select("id", "label", "vector", "leaf", "low", "high").mapInArrow(lambda b: tidy(_targets(b, tree, salts, blocks, at_home)), SEARCH)
            both = sent.unionByName(rows).repartition(parts, "leaf", "salt", "block").sortWithinPartitions("leaf", "salt", "block", "kind")
            return both.mapInArrow(lambda b: tidy(_search(b, same, n)), FOUND)

        any_ = F.array(F.lit(None).cast("bigint"))
        home = cut(_top(search(asked.withColumns({"low": any_, "high": any_}), True, positives, True), positives, "anchor_id").drop("rank"))
        bound = home.groupBy("anchor_id").agg(F.when(F.count(F.lit(1)) == positives, F.min("score")).alias("bound"))
        bounded = asked.join(bound.withColumnRenamed("anchor_id", "id"), "id", "left").withColumns({"low": F.array("bound"), "high": any_})
        pos = cut(_top(home.unionByName(search(bounded, True, positives, False)), positives, "anchor_id"))

        edges = {"low": F.ceil(F.col("score") * low / 100), "high": F.floor(F.col("score") * high / 100)}
        windows = pos.withColumns({c: v.cast("bigint") for c, v in edges.items()}).groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "low", "high"))).alias("w"))  # at most `positives` each
        asking = asked.join(windows.withColumnRenamed("anchor_id", "id"), "id").withColumns({"low": F.col("w.low"), "high": F.col("w.high")})
        width = F.lit(positives)
        fill = lambda c, v: F.concat(c, F.array_repeat(F.lit(v).cast("bigint"), width - F.size(c)))  # noqa: E731  windows that hold nothing
        asking = asking.withColumns({"low": fill("low", 1), "high": fill("high", 0)})
        found = _top(search(asking, False, negatives, None), negatives, "anchor_id", "slot").withColumn("place", F.col("slot") + 1)
        named = pos.select("anchor_id", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        out = found.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(named, ["anchor_id", "place"])
        return cut(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    finally:
        scratch.clear()
