"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's bytes (A-Z in lower case) in windows that overlap, labels every byte with a
probability per language from the states of both directions there, and a document gets the mean over
all of its bytes. The gates are piecewise linear, so that numpy runs them fast. Training is
plain backpropagation through time with Adam, on windows of a bounded sample of labelled documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LETTER = re.compile(r"[^\W\d_]")
WINDOW, MARGIN, BATCH = 128, 16, 2048


@dataclass
class Direction:
    """Gates: update and reset side by side, then the candidate. gates_in and candidate_in have a row per byte value."""

    gates_in: np.ndarray
    candidate_in: np.ndarray
    gates: np.ndarray
    candidate: np.ndarray

    @classmethod
    def fresh(cls, rng: np.random.Generator, hidden: int) -> Direction:
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        return cls(draw(256, 2 * hidden), draw(256, hidden), draw(hidden, 2 * hidden), draw(hidden, hidden))

    def parts(self) -> list[np.ndarray]:
        return [self.gates_in, self.candidate_in, self.gates, self.candidate]

    def states(self, x: np.ndarray, order: range, trace: list | None = None) -> np.ndarray:
        """x: time by row, byte values. The states, by time, row and unit; trace gets what backward() needs."""
        hidden, rows = self.candidate.shape[0], x.shape[1]
        gates_in, gates = self.gates_in * np.float32(0.25) + np.float32(0.5), self.gates * np.float32(0.25)
        out = np.empty((x.shape[0], rows, hidden), np.float32)
        h = np.zeros((rows, hidden), np.float32)
        g, c, m, n = np.empty((rows, 2 * hidden), np.float32), np.empty((rows, hidden), np.float32), np.empty((rows, 2 * hidden), np.float32), np.empty((rows, hidden), np.float32)
        for t in order:
            if trace is not None:
                g, c, m, n = (np.empty_like(a) for a in (g, c, m, n))
            np.take(gates_in, x[t], axis=0, out=g, mode="clip")
            np.matmul(h, gates, out=m)
            g += m
            np.maximum(g, 0, out=g)
            np.minimum(g, 1, out=g)
            np.take(self.candidate_in, x[t], axis=0, out=c, mode="clip")
            np.matmul(h, self.candidate, out=n)
            if trace is None:
                n *= g[:, hidden:]
                c += n
            else:
                c += n * g[:, hidden:]
            np.maximum(c, -1, out=c)
            np.minimum(c, 1, out=c)
            if trace is not None:
                trace.append((t, h, g, c, n))
                h = np.add(h, g[:, :hidden] * (c - h), out=out[t])
            else:
                c -= h
                c *= g[:, :hidden]
                h = np.add(h, c, out=out[t])
        return out

    def backward(self, x: np.ndarray, trace: list, above: np.ndarray) -> list[np.ndarray]:
        """The gradients of parts(), given those of the states from above."""
        grads = [np.zeros_like(p) for p in self.parts()]
        hidden, dh = self.candidate.shape[0], 0
        for t, h, g, c, n in reversed(trace):
            dh = dh + above[t]
            z, r = g[:, :hidden], g[:, hidden:]
            dc = dh * z * (np.abs(c) < 1)
            dg = np.concatenate([dh * (c - h), dc * n], axis=1) * ((g > 0) & (g < 1)) * np.float32(0.25)
            dn = dc * r
            np.add.at(grads[0], x[t], dg)
            np.add.at(grads[1], x[t], dc)
            grads[2] += h.T @ dg
            grads[3] += h.T @ dn
            dh = dh * (1 - z) + dg @ self.gates.T + dn @ self.candidate.T
        return grads


@dataclass
class Network:
    langs: list[str]
    ahead: Direction
    back: Direction
    head: np.ndarray  # of both states and 1

    @classmethod
    def fresh(cls, langs: list[str], hidden: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        return cls(langs, Direction.fresh(rng, hidden), Direction.fresh(rng, hidden), (rng.standard_normal((2 * hidden + 1, len(langs))) * 0.3).astype(np.float32))

    def parts(self) -> list[np.ndarray]:
        return [*self.ahead.parts(), *self.back.parts(), self.head]

    def _probabilities(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        hidden = a.shape[-1]
        s = a @ self.head[:hidden]
        s += b @ self.head[hidden:-1]
        s += self.head[-1]
        s -= s.max(axis=-1, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(axis=-1, keepdims=True)
        return s

    def positions(self, windows: np.ndarray) -> np.ndarray:
        """windows: row by time, byte values. Probabilities by time, row and language."""
        x = windows.T.astype(np.intp)
        t = len(x)
        return self._probabilities(self.ahead.states(x, range(t)), self.back.states(x, range(t - 1, -1, -1)))

    def step(self, windows: np.ndarray, mask: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross entropy over the bytes in mask."""
        x, t, hidden = windows.T.astype(np.intp), windows.shape[1], self.head.shape[0] // 2
        ta: list = []
        tb: list = []
        a, b = self.ahead.states(x, range(t), ta), self.back.states(x, range(t - 1, -1, -1), tb)
        d = self._probabilities(a, b)
        d[:, np.arange(len(y)), y] -= 1
        d *= (mask.T / mask.sum())[:, :, None].astype(np.float32)
        flat = d.reshape(-1, d.shape[-1])
        head = np.concatenate([a.reshape(-1, hidden).T @ flat, b.reshape(-1, hidden).T @ flat, flat.sum(axis=0)[None]])
        return [*self.ahead.backward(x, ta, d @ self.head[:hidden].T), *self.back.backward(x, tb, d @ self.head[hidden:-1].T), head]

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """The mean probabilities of each text, over all of its bytes. Each byte is labelled in a window that has MARGIN bytes more on either side of it, where the text has."""
        out = np.zeros((len(texts), len(self.langs)))
        sizes = np.array([len(t) for t in texts], np.int64)
        step = WINDOW - 2 * MARGIN
        n = (sizes > 0) + np.maximum(0, -(-(sizes - WINDOW) // step))
        spans = np.where(n > 0, (n - 1) * step + WINDOW, 0)
        flat = np.frombuffer(b"".join(t.ljust(k, b"\0") for t, k in zip(texts, spans.tolist(), strict=True)), np.uint8)
        owner = np.repeat(np.arange(len(texts)), n)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        starts = (np.cumsum(spans) - spans)[owner] + step * place
        first = np.where(place > 0, MARGIN, 0)
        last = np.where(place < n[owner] - 1, WINDOW - MARGIN, sizes[owner] - step * place)
        views = np.lib.stride_tricks.sliding_window_view(flat, WINDOW) if len(flat) else np.empty((0, WINDOW), np.uint8)
        at = np.arange(WINDOW)[:, None]
        for i in range(0, len(starts), BATCH):
            own = slice(i, i + BATCH)
            p = self.positions(views[starts[own]])
            p *= ((at >= first[own]) & (at < last[own]))[:, :, None]
            np.add.at(out, owner[own], p.sum(axis=0, dtype=np.float64))
        return out / np.maximum(sizes, 1)[:, None]


def fit(windows: np.ndarray, sizes: np.ndarray, y: np.ndarray, langs: list[str], hidden: int = 8, steps: int = 250, rows: int = 384, seed: int = 0) -> Network:
    net, rng = Network.fresh(langs, hidden, seed), np.random.default_rng(seed)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
    of = [np.flatnonzero(y == k) for k in range(len(langs))]
    for s in range(1, steps + 1 if len(y) else 0):
        some = np.concatenate([rng.choice(o, max(1, rows // len(of))) for o in of])  # as many windows of each language
        grads = net.step(windows[some], np.arange(windows.shape[1]) < sizes[some, None], y[some])
        rate = 0.03 * min(1, 2 * (1 - s / (steps + 1)))
        for p, g, (m, v) in zip(net.parts(), grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**s)) / (np.sqrt(v / (1 - 0.99**s)) + 1e-8)).astype(np.float32)
    return net


def _windows(batches: Iterator[pa.RecordBatch], most: int, length: int) -> Iterator[pa.RecordBatch]:
    """Up to `most` evenly spread windows of each document."""
    for batch in batches:
        rows = []
        for at, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = text.encode().lower()
            for i in range(min(most, -(-len(raw) // length))):
                start = i * max(0, len(raw) - length) // max(1, min(most, -(-len(raw) // length)) - 1)
                rows.append((at, lang, raw[start : start + length]))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 3, (pa.int64(), pa.string(), pa.binary()), strict=True)], ["at", "lang", "piece"])


def train(docs: DataFrame, learn: Column, most: int = 4000, per_document: int = 6, length: int = 64, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """Fit on at most `per_document` evenly spread windows of `length` bytes from each of at most `most` documents where learn holds.

    The documents are a bounded sample of the labelled rows: as many of each language, those with the smallest hashes of
    their ids. With more than `most` languages, the most frequent ones are learned.
    """
    known = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).toArrow()  # a row for each language
    if not counts.num_rows:
        return None
    share = max(1, most // counts.num_rows)
    counts = known.sparkSession.createDataFrame(counts.to_pandas(), "lang string, count long")
    at = F.xxhash64("id")
    likely = F.pmod(at, F.lit(1 << 31)) <= F.lit(float(1 << 31) * (share + 4 * share**0.5 + 4)) / F.col("count")  # so that few rows more than needed are ranked
    drawn = known.select("id", "lang").join(F.broadcast(counts), "lang").filter(likely).select("id", "lang").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(at, F.lit(1 << 31)), "id"))
    ids = drawn.withColumn("rank", rank).filter(F.col("rank") <= share).select("id", "lang")
    some = known.join(F.broadcast(ids), ["id", "lang"]).select(at.alias("at"), "lang", "text")
    got = some.mapInArrow(lambda b: _windows(b, per_document, length), "at long, lang string, piece binary").orderBy("at", "lang", "piece").limit(most * per_document).toArrow()
    pieces, found = got.column("piece").to_pylist(), got.column("lang").to_pylist()
    langs = sorted(set(found))
    if not langs:
        return None
    windows = np.frombuffer(b"".join(p.ljust(length, b"\0") for p in pieces), np.uint8).reshape(-1, length)
    place = {x: i for i, x in enumerate(langs)}
    return fit(windows, np.array([len(p) for p in pieces]), np.array([place[x] for x in found]), langs)


def _label(batches: Iterator[pa.RecordBatch], net: Network | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 128):
            part = batch.slice(i, 128)
            texts = part.column(1).to_pylist()
            usable = [net is not None and t is not None and LETTER.search(t) is not None for t in texts]
            p = net.pooled([t.encode().lower() for t, ok in zip(texts, usable, strict=True) if ok]) if any(usable) else None
            best = iter([] if p is None else zip(p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True))
            found = [(net.langs[b[0]], min(1.0, b[1])) if ok and (b := next(best)) else ("und", 0.0) for ok in usable]
            yield pa.record_batch([part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), part.column(2)], ["id", "lang_pred", "score", "held_out"])


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold


def identify(docs: DataFrame, held: Column, most: int = 4000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: id_col, held_out, lang_pred, score.

    held may be any condition on docs. Learns from text and lang where it is false or null. Cases: a text that is null or has no letter gives und with score 0, as
    does every text when nothing can be learned; null ids are never learned from nor held out; repeated rows are
    rows like others; an empty table gives no rows; other columns are not read.
    """
    held = F.coalesce(held, F.lit(False))
    net = train(docs, ~held, most, id_col=id_col, text_col=text_col, lang_col=lang_col)
    kind = dict(docs.dtypes)[id_col]
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held.alias("held")).mapInArrow(lambda b: _label(b, net), f"id {kind}, lang_pred string, score double, held_out boolean")
    return out.select(F.col("id").alias(id_col), "held_out", "lang_pred", "score")
