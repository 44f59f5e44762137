"""Toxicity by a classifier chain of linear models over hashed words.

The categories are predicted in order. Each model sees the words that a document holds and the
probabilities of the categories before it. For training, those come from models that haven't
seen the document (out-of-fold predictions), so that they are as uncertain as they will be later.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, tidy
from .features import mix

WORD = re.compile(r"[^\W\d_]+")
SLOTS = 1 << 18


def word_slots(text: str | None) -> np.ndarray:
    """The slots of the distinct words (runs of letters, in lower case)."""
    words = set(WORD.findall((text or "").lower()))
    return np.unique(mix(np.fromiter((crc32(w.encode()) for w in words), np.uint64, len(words)), SLOTS)).astype(np.int32)


@dataclass
class Linear:
    """Weights of slots (most are 0), of earlier categories, and a bias."""

    slots: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_linear(rows: list[np.ndarray], earlier: np.ndarray, y: np.ndarray, features: int = 4096, least: int = 4, l2: float = 0.3, steps: int = 300) -> Linear:
    """Logistic regression on the words most typical of the class, among those in least rows or more.

    Words only speak for a category, never against it (weights are 0 or more), so that no amount of harmless text
    around it makes a toxic passage pass.
    """
    n, flat = len(rows), np.concatenate([*rows, np.empty(0, np.int32)])
    row = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    base = min(max(y.mean() if n else 0.0, 1e-3), 1 - 1e-3)
    seen = np.bincount(flat, minlength=SLOTS)
    z = (np.bincount(flat, weights=y[row], minlength=SLOTS) - seen * base) / np.sqrt(np.maximum(seen, 1) * base * (1 - base))
    z = np.where(seen >= least, z, 0)
    slots = np.sort(np.argsort(-z, kind="stable")[:features])
    slots = slots[z[slots] > 0]
    place = np.full(SLOTS, -1)
    place[slots] = np.arange(len(slots))
    at = place[flat]
    row, at = row[at >= 0], at[at >= 0]
    w, v, b = np.zeros(len(slots)), np.zeros(earlier.shape[1]), float(np.log(base / (1 - base)))
    moments = [[np.zeros_like(w), np.zeros_like(w)], [np.zeros_like(v), np.zeros_like(v)], [0.0, 0.0]]
    for step in range(1, steps + 1 if n else 0):
        gap = sigmoid(np.bincount(row, weights=w[at], minlength=n) + earlier @ v + b) - y
        grads = [np.bincount(at, weights=gap[row], minlength=len(w)) + l2 * w, gap @ earlier + l2 * v, gap.sum()]
        out = []
        for m, g in zip(moments, grads, strict=True):
            m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.99 * m[1] + 0.01 * g * g
            out.append(0.1 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8))
        w, v, b = np.maximum(w - out[0], 0), v - out[1], b - out[2]
    return Linear(slots, w, v, float(b))


def predict(model: Linear, rows: list[np.ndarray], earlier: np.ndarray) -> np.ndarray:
    dense = np.zeros(SLOTS)
    dense[model.slots] = model.weights
    return sigmoid(np.array([dense[r].sum() for r in rows]) + earlier @ model.earlier + model.bias)


def fit_chain(rows: list[np.ndarray], labels: np.ndarray, folds: int = 3) -> list[Linear]:
    """labels: a column of 0 and 1 for each category, in the chain's order."""
    n, chain, fold = len(rows), [], np.arange(len(rows)) % folds
    earlier = np.zeros((n, 0))
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(np.float64)
        chain.append(fit_linear(rows, earlier, y))
        if k + 1 < labels.shape[1]:
            out = np.zeros(n)
            for f in range(folds):
                own, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
                out[own] = predict(fit_linear([rows[i] for i in rest], earlier[rest], y[rest]), [rows[i] for i in own], earlier[own])
            earlier = np.column_stack([earlier, out])
    return chain


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array([word_slots(t.as_py()) for t in batch.column(2)], pa.list_(pa.int32()))], ["at", "marks", "slots"])


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], most: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> list[Linear]:
    """A chain over categories (name to a SQL condition on labels), from the at most `most` labelled documents with the smallest hashes."""
    marks = F.array(*[F.max(F.coalesce(F.expr(c).cast("int"), F.lit(0))) for c in categories.values()])
    some = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(marks.alias("marks")).withColumn("at", F.xxhash64("__id")).orderBy("at", "__id").limit(most)
    held = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("text")).join(F.broadcast(some), F.col("__doc") == F.col("__id"))
    got = held.select("at", "marks", "text").mapInArrow(lambda b: tidy(_slots(b)), "at long, marks array<int>, slots array<int>").orderBy("at").limit(most).toArrow()
    marks = np.array(got.column("marks").to_pylist(), np.int64).reshape(got.num_rows, len(categories))
    rows = [np.asarray(x.values, np.int32) for x in got.column("slots")]
    del got
    chain = fit_chain(rows, marks)
    del rows
    release()
    return chain


def _judge(batches: Iterator[pa.RecordBatch], chain: list[Linear], names: list[str]) -> Iterator[pa.RecordBatch]:
    dense = np.zeros((SLOTS, len(chain)))
    for k, m in enumerate(chain):
        dense[m.slots, k] = m.weights
    for batch in batches:
        words = np.array([dense[word_slots(t.as_py())].sum(axis=0) for t in batch.column(batch.num_columns - 1)]).reshape(batch.num_rows, len(chain))
        earlier = np.zeros((batch.num_rows, 0))
        for k, m in enumerate(chain):
            earlier = np.column_stack([earlier, sigmoid(words[:, k] + earlier @ m.earlier + m.bias)])
        yield pa.record_batch([*batch.columns[:-1], *[pa.array(earlier[:, k]) for k in range(len(chain))]], [*batch.schema.names[:-1], *names])


#: The tables label low quality and toxicity; their order makes the chain.
CATEGORIES = {"p_low_quality": "quality = 0", "p_toxic": "toxic = 1"}


def judge_toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, threshold: float = 0.4, most: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, a probability per category, and toxic (the last one reaches threshold).

    Cases: a null text is empty and gets the base rate; null ids and repeated rows are rows like others (null ids
    have no label); of contradicting labels the positive one counts; without labels nothing is toxic;
    an empty table gives no rows; other columns are not read.
    """
    chain = train(docs, labels, categories, most, id_col, text_col)
    names = list(categories)
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lambda b: tidy(_judge(b, chain, names)), f"id {dict(docs.dtypes)[id_col]}, " + ", ".join(f"{n} double" for n in names))
    return out.select(F.col("id").alias(id_col), *names, (F.col(names[-1]) >= threshold).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, threshold: float = 0.4, most: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't toxic (as judge_toxicity finds them), with all their columns, in one pass without a shuffle.

    Cases: null and empty texts have the base rate and stay unless it reaches the threshold; null ids and repeated rows are
    rows like others; without labels all rows stay; an empty table gives no rows; other columns, whatever their names, go
    through as they are.
    """
    chain, at = train(docs, labels, categories, most, id_col, text_col), docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                (judged,) = _judge(iter([pa.record_batch([part.column(at)], ["text"])]), chain, list(categories))
                yield part.filter(pa.array(judged.column(judged.num_columns - 1).to_numpy() < threshold))

    return docs.mapInArrow(lambda b: tidy(keep(b)), docs.schema)
