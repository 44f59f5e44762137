"""Best-fit decreasing packing of tokenized documents into sequences, over the whole corpus.

Best-fit decreasing needs nothing of a document but its length, and lengths are few: 1 to the size of a sequence. So

1. each task tokenizes its documents, cuts long ones, and numbers its pieces of each length;
2. counts by length (at most `size` rows) come to the driver, which packs them: lengths in decreasing order,
   each into the tightest open sequence that it fits, found by a segment tree over remaining capacities in
   logarithmic time. As all pieces of one length are alike, sequences that are filled alike are kept as runs and
   one step places a run of pieces. The steps give the packing that one piece at a time gives; their number is bound by
   `size` and not by the documents (a run's capacity more than halves with each step, and a step adds one run or two);
3. a piece's number among all of its length (its task's counts before it, plus its own) finds the step that placed it.

No task and no driver holds the documents, and the number of sequences is that of one best-fit decreasing
pass over all of them, however they are partitioned.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_units import unit_cache
from .common import cut, tidy

STEPS = "length int, from long, n long, first long, each long, at int"


class CapacityTree:
    """A segment tree over capacities 0 to size: each leaf has the runs of open sequences with that much room, each node whether any leaf below has some."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.some = [0] * (2 * self.leaves)  # sequences below a node
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def _count(self, room: int, n: int) -> None:
        node = self.leaves + room
        while node:
            self.some[node] += n
            node >>= 1

    def add(self, room: int, first: int, n: int) -> None:
        """Sequences first to first + n - 1 have this room."""
        if n:
            self.runs.setdefault(room, []).append((first, n))
            self._count(room, n)

    def tightest(self, need: int) -> int | None:
        """The least room of at least `need` that a sequence has."""
        node = self.leaves + need
        if not self.some[node]:
            while node > 1 and (node & 1 or not self.some[node + 1]):  # up, until something is to the right
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.some[2 * node] else 2 * node + 1
        return node - self.leaves

    def take(self, room: int) -> tuple[int, int]:
        """A run of sequences with this room, which leaves the tree."""
        first, n = self.runs[room].pop()
        self._count(room, -n)
        return first, n


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of STEPS. Of the pieces of a length, those numbered from `from` on, n of them, go into the sequences from `first` on, `each` to a sequence, the first at place `at`."""
    tree, steps, opened = CapacityTree(size), [], 0
    for length in sorted(counts, reverse=True):
        left, done = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = size, opened, -(-left // (size // length))
                opened += n
            else:
                first, n = tree.take(room)
            each = room // length
            full = min(n, left // each)
            if full:
                steps.append((length, done, full * each, first, each, size - room))
                tree.add(room - each * length, first, full)
                left, done = left - full * each, done + full * each
            if full < n and left:  # fewer than fill the next sequence
                steps.append((length, done, left, first + full, left, size - room))
                tree.add(room - left * length, first + full, 1)
                left, full = 0, full + 1
            tree.add(room, first + full, n - full)
    return steps


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, place long, ids binary"


def _pieces(batches: Iterator[pa.RecordBatch], path: str, size: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """batches: doc_id, text. Rows of PIECES; place counts the pieces of a length in this task."""
    cache, part, placed = unit_cache(path), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
    names = [c.split()[0] for c in PIECES.split(", ")]
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            rows = batch.slice(i, 256)
            docs, pieces, starts, lengths, sums, places, data = [], [], [], [], [], [], []
            for doc, ids in zip(rows.column(0).to_pylist(), cache.of([t or "" for t in rows.column(1).to_pylist()]), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                ends = range((len(ids) - 1) % size + 1, len(ids) + 1, size)  # only the first piece may be shorter than a sequence
                for piece, end in enumerate(ends):
                    start = ends[piece - 1] if piece else 0
                    own = ids[start:end].tobytes()
                    docs.append(doc)
                    pieces.append(piece)
                    starts.append(start)
                    lengths.append(end - start)
                    sums.append(zlib.crc32(own))
                    places.append(placed[end - start])
                    placed[end - start] += 1
                    data.append(own if with_ids else None)
            columns = (docs, pieces, starts, lengths, sums, [part] * len(docs), places, data)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def pack_best_fit(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset; with_ids adds the piece's ids (uint32, little-endian).

    A document is its text's ids and end_id. One of more than `size` ids is cut into pieces of `size`; what is left over
    comes first. Pieces fill sequences of at most `size`, numbered from 0 without gaps.
    Cases: a null text is empty; every document has at least its end_id; null ids and repeated rows are documents like
    others; an empty table gives no rows; other columns are not read. A task holds one batch of texts and its cache.
    The driver gets a row for each length and sends back at most some twenty steps for each.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    placed = cut(given.mapInArrow(lambda b: tidy(_pieces(b, tokenizer_path, size, end_id, with_ids)), PIECES))
    by_part = placed.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = cut(by_part.select("length", "part", "n", F.coalesce(before, F.lit(0)).alias("before")))
    counts = {r.length: r.n for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    steps = spark.createDataFrame(plan(counts, size), STEPS)
    number = F.col("before") + F.col("place")
    found = placed.join(offsets.drop("n"), ["length", "part"]).withColumn("number", number).join(F.broadcast(steps), "length").filter((F.col("number") >= F.col("from")) & (F.col("number") < F.col("from") + F.col("n")))
    inside = F.col("number") - F.col("from")
    sequence, offset = F.col("first") + F.floor(inside / F.col("each")), F.col("at") + inside % F.col("each") * F.col("length")
    return found.select(F.col("doc_id").alias(id_col), "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", sequence.alias("sequence_id"), offset.alias("offset"), *["ids"] * with_ids)
