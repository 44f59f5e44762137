"""Connected components of masks, labelled by runs of pixels.

A mask's pixels become words of 64 bits before they are shuffled, and those become runs of neighbours in a row, far fewer than
the pixels. Strips of 64 rows are dealt out to tasks. Within a strip, runs of one row touch those of the next where their places overlap or
meet at a corner; every run gets the least one that it can reach in its strip, in arrays over many strips at once.

What is left are touches between the last row of a strip and the first of the next, told by those least runs: few rows, and none for images of one
strip. They are contracted over the whole cluster: in each round every label moves to the least one that it touches, and on to where that one
moves; labels that have become one are one node from then on. At least every second label goes in a round, so
rounds grow with the logarithm of a component's strips and their tables shrink. These steps are built-in functions; rounds are
cut by written tables, and images are independent rows of the same tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import Rounds, kept

JUMPS = 3  # before a look whether all have come to their end; each doubles the way
SHIFT = 31  # a run's name is y * 2 ** 31 + its first x, so names are in raster order
STRIP = 6  # a strip has 2 ** 6 rows; a task holds the runs of one at least


def runs(mask: DataFrame) -> DataFrame:
    """id, strip, run, y, x0, x1: the longest runs of each row. mask: id, x, y; a row for each pixel of the mask, repeats allowed; nulls are no pixels."""
    pixels = mask.select("id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).filter("id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    words = pixels.groupBy("id", "y", F.shiftright("x", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(x & 63 AS INT)))").alias("bits"))
    dealt = words.withColumn("strip", F.shiftright("y", STRIP)).repartition("id", "strip")
    starts = dealt.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(63)))).filter("getbit(bits & ~shiftleft(bits, 1), at) = 1")
    after = starts.withColumn("gap", F.expr("~shiftrightunsigned(bits, at)"))  # its lowest bit is the first pixel after the run
    pieces = after.select("id", "strip", "y", (F.col("word") * 64 + F.col("at")).alias("x0"), F.expr("CASE WHEN gap = shiftleft(1L, 63) THEN 63 ELSE bit_count((gap & -gap) - 1) END").alias("n"))
    row = Window.partitionBy("id", "strip", "y").orderBy("x0")
    pieces = pieces.withColumn("island", F.col("x0") + F.col("n") - F.sum("n").over(row))  # as in gaps and islands: alike for pieces that meet at a word's end
    found = pieces.groupBy("id", "strip", "y", "island").agg(F.min("x0").alias("x0"), F.max(F.col("x0") + F.col("n") - 1).alias("x1"))
    return found.select("id", "strip", (F.shiftleft("y", SHIFT) + F.col("x0")).alias("run"), "y", "x0", "x1")


def least_of_links(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of 0 to n - 1 that each one reaches over links of a and b."""
    top = np.arange(n)
    while len(a):
        np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
        while (on := top[top]).tobytes() != top.tobytes():
            top = on
        a, b = top[a], top[b]
        a, b = a[a != b], b[a != b]
    return top


def _least_in_strips(strips: np.ndarray, corners: bool) -> np.ndarray:
    """The place of the least run that each one reaches in its strip. strips: lines id, strip, y, x0, x1, in that order of columns."""
    (id_, strip, y, x0, x1), reach = strips, int(corners)
    fresh = (strips[:3, 1:] != strips[:3, :-1]).any(axis=0)
    row = np.concatenate([[0], np.cumsum(fresh)])
    first = np.concatenate([[0], np.flatnonzero(fresh) + 1])  # of each row
    below = np.zeros(len(first), bool)  # rows that follow the one above
    below[1:] = (strips[:2, first[1:]] == strips[:2, first[:-1]]).all(axis=0) & (y[first[1:]] == y[first[:-1]] + 1)
    low = x0.min() - 1
    wide = x1.max() - low + 2
    above = (row - 1) * wide
    start = np.searchsorted(row * wide + x1 - low, above + x0 - low - reach, "left")
    end = np.searchsorted(row * wide + x0 - low, above + x1 - low + reach, "right")
    n = np.where(below[row], end - start, 0)
    lower = np.repeat(np.arange(len(row)), n)
    upper = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
    return least_of_links(len(row), upper, lower)


def _labelled(batches: Iterator[pa.RecordBatch], corners: bool) -> Iterator[pa.RecordBatch]:
    """batches: id, strip, y, x0, x1, sorted. Rows id, y, x0, x1, least: the name of the least run that each one reaches in its strip."""

    def done(parts: list[np.ndarray]) -> pa.RecordBatch:
        whole = np.concatenate(parts, axis=1)
        top = _least_in_strips(whole, corners)
        id_, _, y, x0, x1 = whole
        return pa.record_batch([pa.array(c) for c in (id_, y, x0, x1, (y[top] << SHIFT) + x0[top])], ["id", "y", "x0", "x1", "least"])

    held: list[np.ndarray] = []  # of a strip that may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        now = np.array([c.to_numpy() for c in batch.columns], np.int64)
        last = int(np.argmax((now[:2] == now[:2, -1:]).all(axis=0)))  # where the last strip begins
        if held and (last or (held[-1][:2, -1] != now[:2, 0]).any()):
            yield done([*held, now[:, :last]])
            held = []
        elif last:
            yield done([now[:, :last]])
        held.append(now[:, last:])
    if held:
        yield done(held)


def touching(runs_: DataFrame, corners: bool = True) -> DataFrame:
    """id, a, b: runs of neighbouring rows that touch, in both directions. corners: also where they only meet at one (8-connected)."""
    reach = 1 if corners else 0
    upper = runs_.select("id", F.col("y").alias("row"), F.col("run").alias("a"), F.col("x0").alias("a0"), F.col("x1").alias("a1"))
    lower = runs_.select("id", (F.col("y") - 1).alias("row"), F.col("run").alias("b"), F.col("x0").alias("b0"), F.col("x1").alias("b1"))
    pairs = upper.join(lower, ["id", "row"]).filter((F.col("a0") <= F.col("b1") + reach) & (F.col("b0") <= F.col("a1") + reach)).select("id", "a", "b")
    return pairs.unionByName(pairs.select("id", F.col("b").alias("a"), F.col("a").alias("b")))


def least_reached(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, run, least: the least run that each one reaches. nodes: id, run; edges: id, a, b in both directions."""
    rounds, steps = Rounds(nodes.sparkSession), []
    try:
        edges = rounds.keep(edges.distinct())
        while not edges.isEmpty():
            up = rounds.keep(edges.groupBy("id", "a").agg(F.min("b").alias("b")).filter("b < a"))  # each to the least one it touches
            while True:  # and on to where that one goes, to the end
                for _ in range(JUMPS):
                    on = up.select("id", F.col("a").alias("b"), F.col("b").alias("c"))
                    up = up.join(on, ["id", "b"], "left").select("id", "a", F.coalesce("c", "b").alias("b"))
                up = rounds.keep(up)
                if up.join(up.select("id", F.col("a").alias("b")), ["id", "b"], "left_semi").isEmpty():
                    break
            steps.append(up)
            for end in ("a", "b"):
                edges = edges.join(up.select("id", F.col("a").alias(end), F.col("b").alias("to")), ["id", end], "left").withColumn(end, F.coalesce("to", end)).drop("to")
            edges = rounds.keep(edges.filter("a <> b").select("id", "a", "b").distinct())
        labels = nodes.select("id", "run", F.col("run").alias("least"))
        for step in steps:  # smaller and smaller tables
            to = step.select("id", F.col("a").alias("least"), F.col("b").alias("to"))
            labels = labels.join(to, ["id", "least"], "left").select("id", "run", F.coalesce("to", "least").alias("least"))
        return kept(labels)
    finally:
        rounds.clear()


def labelled_runs(mask: DataFrame, corners: bool = True) -> DataFrame:
    """id, y, x0, x1, label: the runs of each mask and the component each is in, numbered from 1 by image in the order of their first pixels. id: an integer."""
    kind = dict(mask.dtypes)["id"]
    dealt = runs(mask.withColumn("id", F.col("id").cast("long"))).select("id", "strip", "y", "x0", "x1").sortWithinPartitions("id", "strip", "y", "x0")
    found = kept(dealt.mapInArrow(lambda batches: _labelled(batches, corners), "id long, y long, x0 long, x1 long, least long"))
    rows = (1 << STRIP) - 1
    border = found.filter(F.col("y").bitwiseAND(rows).isin(0, rows)).select("id", F.col("least").alias("run"), "y", "x0", "x1")
    least = least_reached(found.select("id", F.col("least").alias("run")).distinct(), touching(border, corners))
    roots = least.filter("run = least").select("id", "least", F.row_number().over(Window.partitionBy("id").orderBy("least")).alias("label"))
    names = least.join(roots, ["id", "least"]).select("id", F.col("run").alias("least"), "label")
    return found.join(names, ["id", "least"]).select(F.col("id").cast(kind).alias("id"), "y", "x0", "x1", "label")


def label_pixels(pixels: DataFrame, inside: str) -> DataFrame:
    """pixels (id, x, y and others) with label: 0 where the SQL condition doesn't hold, else the component of the pixel."""
    spans = labelled_runs(pixels.filter(inside))
    one = spans.select("id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "label")
    return pixels.join(one, ["id", "x", "y"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def run_stats(spans: DataFrame) -> DataFrame:
    """id, label, area, x, y, w, h, cx, cy of each component, from its runs alone; as component_stats gives them from pixels."""
    n = F.col("x1") - F.col("x0") + 1
    sums = [F.sum(n).alias("area"), F.min("x0").alias("x"), F.min("y").alias("y"), (F.max("x1") - F.min("x0") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h")]
    sums += [F.sum((F.col("x0") + F.col("x1")) * n).alias("sx"), F.sum(F.col("y") * n).alias("sy")]
    done = spans.groupBy("id", "label").agg(*sums)
    return done.select("id", "label", "area", "x", "y", "w", "h", (F.col("sx") / 2 / F.col("area")).alias("cx"), (F.col("sy") / F.col("area")).alias("cy"))
