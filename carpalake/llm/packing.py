"""Bounded-space online packing of tokenized documents into fixed-length sequences.

Each partition keeps at most `windows` open windows. A document's full-length chunks become
sequences of their own; what remains goes into the open window that it leaves least room in.
If it fits in none and no more may be opened, the fullest window is emitted first. Windows
still open at a partition's end are leftovers: those of `merge` partitions meet in one task,
are strung together and cut at full length; the last stretch is cut into powers of two,
which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tidy
from .word_units import word_cache

COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
FULL_IDS, LEFT_IDS = 1 << 40, 1 << 62


class Window:
    def __init__(self) -> None:
        self.pieces: list[tuple] = []
        self.fill = 0

    def put(self, doc: int | None, start: int, ids: np.ndarray, total: int) -> None:
        self.pieces.append((doc, start, ids, total, self.fill))
        self.fill += len(ids)

    def rows(self, sequence: int, with_ids: bool) -> Iterator[tuple]:
        for doc, start, ids, total, offset in self.pieces:
            yield doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset, ids.tobytes() if with_ids else None


def _pack(batches: Iterator[pa.RecordBatch], path: str, size: int, windows: int, end_id: int, with_ids: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    cache, first, n = word_cache(path), TaskContext.get().partitionId() * FULL_IDS, 0
    open_: list[Window] = []
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * len(schema)
        out.clear()
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    def emit(w: Window) -> None:
        nonlocal n
        out.extend((*r, False) for r in w.rows(first + n, with_ids))
        n += 1

    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            for doc, ids in zip(part.column(0).to_pylist(), cache.of([t or "" for t in part.column(1).to_pylist()]), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                whole = len(ids) // size * size
                for at in range(0, whole, size):
                    (w := Window()).put(doc, at, ids[at : at + size], len(ids))
                    emit(w)
                if not (rest := len(ids) - whole):
                    continue
                best = max((w for w in open_ if w.fill + rest <= size), key=lambda w: w.fill, default=None)
                if best is None:
                    if len(open_) == windows:
                        fullest = max(open_, key=lambda w: w.fill)
                        open_.remove(fullest)
                        emit(fullest)
                    open_.append(best := Window())
                best.put(doc, whole, ids[whole:], len(ids))
                if best.fill == size:
                    open_.remove(best)
                    emit(best)
            yield flush()
    for w in open_:
        out.extend((*r, True) for r in w.rows(first + n, True))
        n += 1
    yield flush()


def _merge(key: tuple, left: pd.DataFrame, size: int, with_ids: bool) -> pd.DataFrame:
    left = left.sort_values(["sequence_id", "offset"], kind="stable")
    total = int(left.length.sum())
    lengths = [size] * (total // size) + [1 << b for b in reversed(range(size.bit_length())) if total % size >> b & 1]
    if size & (size - 1):  # powers of two only save padding below a size that is one itself
        lengths = [size] * (total // size) + [total % size] * bool(total % size)
    first, out, room, n, fill = LEFT_IDS + int(key[0]) * FULL_IDS, [], lengths[0], 0, 0
    for doc, start, ids, tokens in zip(left.doc_id, left.start, left.ids, left.doc_tokens, strict=True):
        while ids:
            take = min(room - fill, len(ids) // 4)
            out.append((None if pd.isna(doc) else int(doc), start, take, zlib.crc32(ids[: 4 * take]), tokens, first + n, fill, ids[: 4 * take] if with_ids else None))
            ids, start, fill = ids[4 * take :], start + take, fill + take
            if fill == room and n + 1 < len(lengths):
                n, fill = n + 1, 0
                room = lengths[n]
    return pd.DataFrame(out, columns=[c.split()[0] for c in COLUMNS.split(", ")]).astype({"doc_id": "Int64"})


def pack(docs: DataFrame, tokenizer_path: str, size: int = 4096, windows: int = 32, merge: int = 8, end_id: int = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids adds the piece's ids (uint32, little-endian).

    Cases: a null text is empty; every document has at least its end_id; null ids and repeated
    rows are documents like others; an empty table gives no rows; other columns are not read.
    A task holds `windows` windows of ids and one batch; a merging task `merge` times as many.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    flagged = COLUMNS + ", left boolean"
    schema = to_arrow_schema(spark.createDataFrame([], flagged).schema)
    placed = cut(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lambda batches: tidy(_pack(batches, tokenizer_path, size, windows, end_id, with_ids, schema)), flagged)
    )
    columns = [c.split()[0] for c in COLUMNS.split(", ")][: 8 if with_ids else 7]
    left = placed.filter("left").withColumn("part", F.expr(f"sequence_id div {FULL_IDS * merge}"))
    merged = left.groupBy("part").applyInPandas(lambda key, pdf: _merge(key, pdf, size, with_ids), COLUMNS)
    return placed.filter("NOT left").select(*columns).unionByName(merged.select(*columns)).withColumnRenamed("doc_id", id_col)
