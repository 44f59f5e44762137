"""Quality by importance resampling.

Two generative bag models over hashed words and word pairs: the target, from labelled good
documents, and the raw one, from all documents. A document's log weight is the log of the
ratio of its probabilities under them. Sampling without replacement in proportion to the
weights is a Gumbel top-k: add Gumbel noise to the log weights and take the k largest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .features import ngram_slots


def _counts(batches: Iterator[pa.RecordBatch], slots: int) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for batch in batches:
        for text, good in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            if len(at := ngram_slots(text.as_py(), slots)):
                n = np.bincount(at, minlength=slots)
                raw += n
                if good:
                    target += n
    yield pa.record_batch([pa.array(np.arange(slots)), pa.array(raw), pa.array(target)], ["slot", "raw", "target"])


def fit_ratio(docs: DataFrame, good: DataFrame, slots: int = 10_000, most_good: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """log p_target - log p_raw per slot.

    The raw model counts all documents. good: ids of labelled good documents; the target model counts
    those among the at most most_good with the smallest hashes (a bounded sample of labelled rows).
    """
    ids = good.select(F.col(id_col).alias("__good")).filter("__good IS NOT NULL").distinct().orderBy(F.xxhash64("__good"), "__good").limit(most_good)
    marked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(ids), F.col("__id") == F.col("__good"), "left")
    rows = marked.select("text", F.col("__good").isNotNull().alias("good")).mapInArrow(lambda b: _counts(b, slots), "slot long, raw long, target long")
    raw, target = np.zeros(slots), np.zeros(slots)
    for r in rows.groupBy("slot").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():  # one row per slot
        raw[r.slot], target[r.slot] = r.raw, r.target
    share = lambda n: np.log((n + 1) / (n.sum() + slots))
    return share(target) - share(raw)


def _scores(batches: Iterator[pa.RecordBatch], ratio: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        weight = np.array([ratio[ngram_slots(t.as_py(), len(ratio))].sum() for t in batch.column(2)], np.float64)
        uniform = ((batch.column(1).to_numpy().view(np.uint64) >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53
        key = weight - np.log(-np.log(uniform))
        bits = key.view(np.int64)
        order = np.where(bits < 0, np.int64(-(2**63)) - bits - 1, bits)
        yield pa.record_batch([batch.column(0), pa.array(weight), pa.array(key), pa.array(order)], ["id", "log_weight", "gumbel_key", "rank_key"])


def kth_largest(df: DataFrame, col: str, k: int) -> int | None:
    """The k-th largest of a long column, None if k is 0: four histograms of 65,536 bins each, no sort."""
    if k <= 0:
        return None
    prefix, rows = 0, df.select(F.col(col).alias("x"))
    for shift in (48, 32, 16, 0):
        bins = {r[0]: r[1] for r in rows.groupBy(F.shiftright("x", shift).alias("b")).count().collect()}
        for b in sorted(bins, reverse=True):
            if bins[b] >= k:
                break
            k -= bins[b]
        prefix = b
        rows = rows.filter(F.shiftright("x", shift) == F.lit(prefix))
    return prefix


def resample(docs: DataFrame, good: DataFrame, share: float = 0.5, slots: int = 10_000, most_good: int = 20_000, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, log_weight, gumbel_key, selected.

    selected: the floor(share * rows) largest keys; rows that tie with the last of them are selected too.
    Cases: null and empty texts have weight 0; the noise depends on seed, id and text, so repeated rows tie and null
    ids are rows like others; without good ids the target model is uniform; an empty table gives no rows;
    other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    ratio = fit_ratio(docs, good, slots, most_good, id_col, text_col)
    noise = F.xxhash64(F.lit(seed), F.col(id_col), text)
    scored = cut(docs.select(F.col(id_col).alias("id"), noise.alias("noise"), text.alias("text")).mapInArrow(lambda b: _scores(b, ratio), f"id {dict(docs.dtypes)[id_col]}, log_weight double, gumbel_key double, rank_key long"))
    least = kth_largest(scored, "rank_key", int(share * scored.count()))
    selected = F.lit(False) if least is None else F.col("rank_key") >= F.lit(least)
    return scored.select(F.col("id").alias(id_col), "log_weight", "gumbel_key", selected.alias("selected"))
