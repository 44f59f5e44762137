"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two halves. Of two fingerprints that differ in at most three
bits, one half differs in at most one, so some variant of it with one bit position wiped out
is equal in both. Each distinct fingerprint is indexed under its 64 variants (2 halves, 32
positions); equal keys meet and are verified by their full distance.

A bucket of more than `bucket` fingerprints isn't compared. As all in it agree on 31 bits of
one half, the same cut goes on in the other half: 2 parts of 16 bits with 16 variants each,
then, of what is left, 2 parts of 8. A bucket of the last level has three free positions
and 8 free bits, so at most 2048 distinct fingerprints. Nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import cut, only_kept, parallelism, tidy
from .components import components

BITS = np.array([[b >> i & 1 for i in range(8)] for b in range(256)], np.float64)
PLACE = 256 * np.arange(8)
SEED, MOST = 42, 3


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each run of width words (A-Z in lower case, joined by a space); of all words where there are fewer, of none where there is none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    norm = b" ".join(words)
    if len(words) <= width:
        hashes = [xxh64_intdigest(norm, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-width] + 1])
        hashes = [xxh64_intdigest(norm[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)]
    return np.array(hashes, np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bit b is 1 if more than half of the hashes have it; 0 without any."""
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + PLACE
    ones = np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ BITS
    return int(np.packbits((2 * ones > len(hashes)).ravel(), bitorder="little").view("<i8")[0])


def fingerprint(text: bytes, width: int = 3) -> int:
    return majority(shingle_hashes(text, width))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(t) for t in batch.column(2).to_pylist()]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["id", "tag", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tag (a hash of the whole text, to tell rows with one id apart), fp (signed)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tag"), text.cast("binary").alias("text")).mapInArrow(lambda b: tidy(_fingerprints(b)), "id long, tag long, fp long")


def _tree(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the links of a bucket connect, fewer than fps."""
    left, links = np.arange(len(fps)), []
    todo: list[int] = []
    while len(left):
        if not todo:
            todo, left = [int(left[0])], left[1:]
        at = todo.pop()
        near = np.bitwise_count(fps[left] ^ fps[at]) <= MOST
        found = left[near].tolist()
        links += [(at, x) for x in found]
        todo += found
        left = left[~near]
    return links


def _first_shared(x: np.ndarray, variants: int, half: int) -> np.ndarray:
    """The first variant in which two fingerprints that differ by x agree (level 0 only)."""
    low, high = x & np.uint64((1 << half) - 1), x >> np.uint64(half)
    place = lambda y: np.bitwise_count(np.maximum(y, np.uint64(1)) - np.uint64(1))
    return np.where(np.bitwise_count(low) <= 1, place(low), half + place(high))


def _scan(batches: Iterator[pa.RecordBatch], bucket: int | None) -> Iterator[pa.RecordBatch]:
    """batches: k1, k2, fp, sorted by key. Links (a, b), and the rows of buckets over the limit (k1, k2, a, b null)."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
    keep, over = np.empty((3, 0), np.int64), None

    def out(k1: np.ndarray, k2: np.ndarray, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        return pa.record_batch([pa.array(k1), pa.array(k2), pa.array(a), pa.array(b) if b is not None else pa.nulls(len(a), pa.int64())], schema=schema)

    def close(rows: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
        """Deals with all runs of equal keys but the last, which may go on; with that one too, if last."""
        nonlocal keep, over
        n = rows.shape[1]
        starts = np.flatnonzero(np.concatenate([[True], (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])])) if n else np.empty(0, np.int64)
        ends = np.append(starts[1:], n)
        if not last and n:
            keep, starts, ends = rows[:, starts[-1] :], starts[:-1], ends[:-1]
        sizes = ends - starts
        fps = rows[2].view(np.uint64)
        small = np.repeat(np.where(sizes <= 8, ends, 0), sizes)
        for step in range(1, 8):
            i = np.flatnonzero(np.arange(len(small)) + step < small)
            if not len(i):
                break
            x = fps[i] ^ fps[i + step]
            ok = np.bitwise_count(x) <= MOST
            if bucket is not None and len(i):
                ok &= _first_shared(x, 64, 32) == (rows[0, i] >> 32)
            if len(i := i[ok]):
                yield out(rows[0, i], rows[1, i], rows[2, i], rows[2, i + step])
        for s, e in zip(starts[sizes > 8].tolist(), ends[sizes > 8].tolist(), strict=True):
            if bucket is not None and e - s > bucket:
                yield out(rows[0, s:e], rows[1, s:e], rows[2, s:e], None)
            elif len(links := np.array(_tree(fps[s:e]), np.int64)):
                yield out(rows[0, s + links[:, 0]], rows[1, s + links[:, 0]], rows[2, s + links[:, 0]], rows[2, s + links[:, 1]])

    for batch in batches:
        rows = np.array([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], np.int64).reshape(3, -1)
        if over is not None:  # inside a bucket that is over the limit already: pass its rows on, hold none
            same = (rows[0] == over[0]) & (rows[1] == over[1])
            stop = len(same) if same.all() else int(np.argmin(same))
            if stop:
                yield out(rows[0, :stop], rows[1, :stop], rows[2, :stop], None)
            rows, over = rows[:, stop:], over if stop == len(same) else None
        if rows.shape[1]:
            keep, rows = np.empty((3, 0), np.int64), np.concatenate([keep, rows], axis=1)
            yield from close(rows, False)
            if bucket is not None and keep.shape[1] > bucket:
                yield out(keep[0], keep[1], keep[2], None)
                over, keep = (keep[0, 0], keep[1, 0]), np.empty((3, 0), np.int64)
    yield from close(keep, True)


def _level(rows: DataFrame, bucket: int | None) -> DataFrame:
    parts = parallelism(rows.sparkSession)
    return cut(rows.repartition(parts, "k1", "k2").sortWithinPartitions("k1", "k2").mapInArrow(lambda b: tidy(_scan(b, bucket)), "k1 long, k2 long, a long, b long"))


def near_links(fps: DataFrame, bucket: int = 4096) -> DataFrame:
    """a, b: links that connect what all links of 3 or fewer bits between the distinct fps (one long column, fp) connect."""
    half = "if(v < 32, fp & 4294967295L, shiftrightunsigned(fp, 32))"
    rows = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v")).select(
        F.expr(f"shiftleft(cast(v AS bigint), 32) | ({half} & ~shiftleft(1L, v & 31))").alias("k1"), F.lit(0).cast("long").alias("k2"), "fp"
    )
    found = _level(rows, bucket)
    links = found.filter("b IS NOT NULL").select("a", "b")
    for width in (16, 8):
        over = found.filter("b IS NULL").select("k1", "k2", F.col("a").alias("fp"))
        if over.isEmpty():
            break
        other = "if(k1 < shiftleft(32L, 32), shiftrightunsigned(fp, 32), fp & 4294967295L)"
        if width == 8:  # the 16 bits that level 16 has left free
            other = f"if(k2 < shiftleft(16L, 32), shiftrightunsigned({other}, 16), {other} & 65535L)"
        part = f"if(v < {width}, rest & {(1 << width) - 1}L, shiftrightunsigned(rest, {width}))"
        wiped = f"shiftleft(cast(v AS bigint), 32) | ({part} & ~shiftleft(1L, v & {width - 1}))"
        rows = over.withColumn("rest", F.expr(other)).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(2 * width - 1))))
        key = F.expr(wiped) if width == 16 else F.expr(f"shiftleft(k2, 26) | ({wiped} & 65535L) | shiftleft(cast(v AS bigint), 16)")
        # level 16: k2 is the variant (5 bits) over 16 bits; level 8: that key, moved up, over the variant (4 bits) and 8 bits
        found = _level(rows.select("k1", key.alias("k2"), "fp"), bucket if width == 16 else None)
        links = links.unionByName(found.filter("b IS NOT NULL").select("a", "b"))
    return links


def near_groups(docs: DataFrame, bucket: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, fingerprint (16 hex digits), component_id, tag, kept.

    component_id is the smallest id reachable over links of at most 3 differing bits; kept marks the
    row of that id (of rows that share it, the one with the smallest hash of its text).
    Cases: null and wordless texts have fingerprint zero and are linked like others; null ids never name a
    component unless it has no other (then null); rows that repeat id and text share one verdict; an empty
    table gives no rows; other columns are not read.
    """
    own = cut(fingerprints(docs, id_col, text_col))
    roots = own.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tag")).alias("root"))
    roots = cut(roots)
    found = components(near_links(roots.select("fp"), bucket)).withColumnRenamed("node", "fp")
    classes = roots.join(found, "fp", "left").withColumn("least", F.coalesce("least", "fp"))
    tops = classes.groupBy("least").agg(F.min("root").alias("top"))
    by_fp = classes.select("fp", "least").join(tops, "least").select("fp", "top")
    return own.join(by_fp, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("top.id").alias("component_id"),
        "tag",
        (F.col("id").eqNullSafe(F.col("top.id")) & (F.col("tag") == F.col("top.tag"))).alias("kept"),
    )


def drop_near(docs: DataFrame, bucket: int = 4096, similarity: float | None = None, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group, that of the smallest id, with all its columns, whatever their names.

    Groups are those of near_groups. With a similarity, links also need that Jaccard similarity of their sets of shingles of
    `width` words, and pairs that have it without agreeing in their fingerprints are linked too (similar_groups).
    Cases: as near_groups has them; of rows that repeat id and text all stay, or none.
    """
    if similarity is None:
        return only_kept(docs, near_groups(docs, bucket, id_col, text_col), id_col, text_col)
    from .similar import similar_groups

    return only_kept(docs, similar_groups(docs, similarity, width, bucket, id_col=id_col, text_col=text_col), id_col, text_col)
