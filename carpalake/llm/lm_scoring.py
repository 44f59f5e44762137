"""Language-model scores of documents: context-tree weighting, beside a unigram base.

Documents are dealt to blocks of bounded size, one to a task. A block's task counts its distinct words and byte
strings; these tables, not the texts, are summed over the blocks. The strings' model is worked
out context by context of three bytes, in pieces; the level of two bytes is summed as a table and
joined to them, and the two levels above (at most 65,280 and 255 nodes) are on the driver. Each
block then gets the counts and log probabilities of just the words and strings that it holds, so
a task's share of the model is never larger than its texts, however large the model is. Texts
travel compressed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import context_tree as tree
from .common import Scratch, cut, parallelism, tidy

CHUNK = 400_000  # bytes of text that are worked on at once
PIECE = 300_000  # strings that are worked out at once, up to the end of a context
SHARES = 8
INNER = 3  # contexts of so many bytes are worked out by themselves; the levels above are joined to them


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            part = batch.slice(i, 1000)
            packed = [c.compress(t.lower()) for t in part.column(part.num_columns - 1).to_pylist()]
            yield pa.record_batch([*part.columns[:-1], pa.array(packed, pa.binary())], [*part.schema.names[:-1], "packed"])


def _chunks(rows: Iterator[tuple], size: Callable[[tuple], int]) -> Iterator[list[tuple]]:
    part, n = [], 0
    for r in rows:
        part.append(r)
        n += size(r)
        if n >= CHUNK:
            yield part
            part, n = [], 0
    if part:
        yield part


STRING_SCHEMA = pa.schema([("block", pa.int32()), ("word", pa.binary()), ("string", pa.int64()), ("n", pa.int64())])


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches: block, held, packed, sorted by block. The words and strings of each block with their counts in training texts."""

    def emit(block: int, words: Counter, found: list) -> Iterator[pa.RecordBatch]:
        items = iter(words.items())
        while part := list(islice(items, 50_000)):
            yield pa.record_batch([pa.array(np.full(len(part), block, np.int32)), pa.array([w for w, _ in part], pa.binary()), pa.nulls(len(part), pa.int64()), pa.array([n for _, n in part], pa.int64())], schema=STRING_SCHEMA)
        keys, n = tree.grouped(*map(np.concatenate, zip(*found, strict=True)))
        for i in range(0, len(keys), 200_000):
            part = keys[i : i + 200_000]
            yield pa.record_batch([pa.array(np.full(len(part), block, np.int32)), pa.nulls(len(part), pa.binary()), pa.array(part), pa.array(n[i : i + 200_000])], schema=STRING_SCHEMA)

    def rows() -> Iterator[tuple[int, bool, bytes]]:
        d = zstandard.ZstdDecompressor()
        for batch in batches:
            for block, held, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield block, held, d.decompress(packed)

    block, words, found = None, Counter(), []
    for part in _chunks(rows(), lambda r: len(r[2])):
        for own in dict.fromkeys(r[0] for r in part):
            if block is not None and own != block:
                yield from emit(block, words, found)
                words, found = Counter(), []
            block = own
            for held in (False, True):
                texts = [r[2] for r in part if r[0] == own and r[1] == held]
                if not texts:
                    continue
                keys, n = tree.counted(tree.strings(texts)[0])
                found.append((keys, n * (not held)))
                seen = Counter()
                for t in texts:
                    seen.update(t.split())
                seen[b""] += len(texts)  # the end
                words.update(dict.fromkeys(seen, 0) if held else seen)
            if sum(len(k) for k, _ in found[1:]) > 2_000_000:
                found = [tree.grouped(*map(np.concatenate, zip(*found, strict=True)))]
    if block is not None:
        yield from emit(block, words, found)


def _whole(held: list[np.ndarray], last: bool, piece: int) -> int:
    """How many of the sorted strings held[0] to take now: up to the last context of INNER bytes, which may go on."""
    if last or len(held[0]) < piece:
        return len(held[0]) * last
    shift = 8 * (tree.DEPTH - INNER + 1)
    return int(np.searchsorted(held[0], held[0][-1] >> shift << shift))


def _crowns(batches: Iterator[pa.RecordBatch], piece: int) -> Iterator[pa.RecordBatch]:
    """batches: string, n, by string. The sums over their children, as far as seen here, of the nodes one level over INNER."""
    held = [np.empty(0, np.int64)] * 2
    for batch in _and_none(batches):
        if batch is not None:
            held = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
        take = _whole(held, batch is None, piece)
        keys, n = (h[:take][held[1][:take] > 0] for h in held)
        held = [h[take:] for h in held]
        if len(keys):
            nodes = tree.levels(keys, n, INNER)[INNER]
            yield _sums(nodes)


def _and_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _sums(nodes: tree.Nodes) -> pa.RecordBatch:
    """What the level above needs of nodes: per parent, the sums over its children."""
    up, zeros, ones, weighted = tree.grouped(nodes.up(), nodes.zeros, nodes.ones, nodes.weighted)
    return pa.record_batch([pa.array(up), pa.array(zeros), pa.array(ones), pa.array(weighted)], ["node", "zeros", "ones", "below"])


def _nodes(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tree.Nodes:
    """Nodes from the sums over their children, in any order."""
    order, node = np.argsort(keys), tree.Nodes.__new__(tree.Nodes)
    node.keys, node.zeros, node.ones = keys[order], zeros[order], ones[order]
    node.own = tree.log_kt(node.zeros, node.ones)
    node.weighted = tree.HALF + np.logaddexp(node.own, below[order])
    return node


def _raise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches: whole sums of _sums. Those of the level above."""
    for batch in batches:
        if batch.num_rows:
            yield _sums(_nodes(*(batch.column(i).to_numpy() for i in range(4))))


def _top(rows: list) -> dict[int, tree.Nodes]:
    """The nodes of depths 1 and 0, from the sums of depth 1."""
    one = _nodes(*(np.array([r[i] for r in rows], t) for i, t in enumerate((np.int64, np.float64, np.float64, np.float64))))
    return {1: one, 0: _nodes(*tree.grouped(one.up(), one.zeros, one.ones, one.weighted))}


def _model(batches: Iterator[pa.RecordBatch], top: dict[int, tree.Nodes], piece: int) -> Iterator[pa.RecordBatch]:
    """batches: share, prefix, kind, key, n, ones, below in this order: in each share, of each context of two bytes its nodes (n: zeros), then its strings."""
    empty = [np.empty(0, t) for t in (np.int64, np.float64, np.float64, np.float64)]
    held, nodes, now = [empty[0]] * 2, empty, None

    def work(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, nodes
        if take := _whole(held, last, piece):
            keys, n = (h[:take] for h in held)
            levels = tree.levels(keys[n > 0], n[n > 0], INNER) | {INNER - 1: _nodes(*nodes)} | top
            yield pa.record_batch([pa.array(keys), pa.array(tree.log_probabilities(keys, levels) / np.log(10))], ["string", "log10"])
            context = keys[-1] >> (8 * (tree.DEPTH - INNER + 2))
            held, nodes = [h[take:] for h in held], [c[nodes[0] >> 8 >= context] for c in nodes]

    for batch in batches:
        share = batch.column(0).to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], share[1:] != share[:-1]])).tolist() if len(share) else []
        for start, end in zip(edges, [*edges[1:], len(share)], strict=True):
            if share[start] != now:
                yield from work(True)
                nodes, now = empty, share[start]
            part = batch.slice(start, end - start)
            kind, key, n, ones, below = (part.column(i).to_numpy(zero_copy_only=False) for i in range(2, 7))
            is_node = kind == 0
            nodes = [np.concatenate([h, c[is_node]]) for h, c in zip(nodes, (key, n.astype(np.float64), ones, below), strict=True)]
            held = [np.concatenate([h, c[~is_node]]) for h, c in zip(held, (key, n), strict=True)]
            yield from work(False)
    yield from work(True)


class Lookup:
    """Values by key: tables of one or two slots a key, each for the keys whose slot in the one before is taken, and a sorted rest."""

    FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.tables = []
        for factor in self.FACTORS:
            if len(keys) < 1000:
                break
            bits = len(keys).bit_length()
            at = self._slots(keys, factor, bits)
            own, values_of = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
            own[at], values_of[at] = keys, values
            self.tables.append((factor, bits, own, values_of))
            rest = own[at] != keys
            keys, values = keys[rest], values[rest]
        order = np.argsort(keys)
        self.rest, self.rest_values = keys[order], values[order]

    @staticmethod
    def _slots(keys: np.ndarray, factor: int, bits: int) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(factor)) >> np.uint64(64 - bits)).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.empty(len(keys)), np.arange(len(keys))
        for factor, bits, own, values in self.tables:
            at = self._slots(keys, factor, bits)
            out[left] = values[at]
            missed = np.flatnonzero(own[at] != keys)
            keys, left = keys[missed], left[missed]
        if len(left):
            out[left] = self.rest_values[np.searchsorted(self.rest, keys)]
        return out


SCORES = "id long, held_out boolean, n_tokens long, n_known long, base double, score double"
NEVER = float(np.log10(0.5))


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches: block, kind, id, num, bytes by block and kind: words, strings, then documents. Rows of SCORES, one per document."""
    names = [c.split()[0] for c in SCORES.split(", ")]
    d = zstandard.ZstdDecompressor()
    block, words, strings, lookup = None, {}, [], None

    for batch in batches:
        blocks, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])])).tolist() if len(blocks) else []
        for start, end in zip(edges, [*edges[1:], len(blocks)], strict=True):
            part = batch.slice(start, end - start)
            if blocks[start] != block:
                block, words, strings, lookup = blocks[start], {}, [], None
            if kinds[start] == 0:
                counts, at = np.unique(part.column(2).to_numpy(), return_inverse=True)
                logs = np.log10(counts + 0.5).tolist()  # one object a count
                words.update(zip(part.column(4).to_pylist(), map(logs.__getitem__, at.tolist()), strict=True))
                continue
            if kinds[start] == 1:
                strings.append((part.column(2).to_numpy(), part.column(3).to_numpy()))
                continue
            if lookup is None:
                keys, logs = map(np.concatenate, zip(*strings, strict=True))
                strings = []
                lookup = Lookup(keys, logs)
                del keys, logs
            rows = zip(part.column(2).to_pylist(), (part.column(3).to_numpy() == 1).tolist(), map(d.decompress, part.column(4).to_pylist()), strict=True)
            for some in _chunks(rows, lambda r: len(r[2])):
                keys, sizes = tree.strings([r[2] for r in some])
                score = np.add.reduceat(lookup[keys], np.cumsum(sizes) - sizes)
                split = [r[2].split() for r in some]
                lengths = np.fromiter(map(len, split), np.int64, len(split)) + 1
                logs = np.fromiter((words[w] for s in split for w in (*s, b"")), np.float64, int(lengths.sum()))
                at = np.cumsum(lengths) - lengths
                yield pa.record_batch(
                    [pa.array([r[0] for r in some], pa.int64()), pa.array([r[1] for r in some]), pa.array(lengths), pa.array(np.add.reduceat((logs > NEVER).astype(np.int64), at)), pa.array(np.add.reduceat(logs, at)), pa.array(score)],
                    names,
                )


def score_documents(docs: DataFrame, held: Column | None = None, block_bytes: int = 32_000_000, piece: int = PIECE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Both models learn from the rows where held is false. score is the context-tree model's log10 probability of the
    text's bytes (A-Z in lower case) and its end; bits per byte are -score / log10(2) / bytes. base_score is that of the words and
    the end under a smoothed unigram model.
    Cases: a null text is empty; null ids are never held out by the default rule; repeated rows are rows like others;
    with nothing to learn from each binary decision has probability one half; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "scores")
    held = held_out(id_col) if held is None else held
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = max(1, -(-(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // block_bytes))
    deal = F.pmod(F.xxhash64(id_col, text), F.lit(n)).cast("int")
    packed = docs.select(deal.alias("block"), F.col(id_col).cast("long").alias("id"), held.alias("held"), text.cast("binary").alias("text")).mapInArrow(lambda b: tidy(_compress(b)), "block int, id long, held boolean, packed binary")
    tables = packed.select("block", "held", "packed").repartitionById(n, F.col("block")).sortWithinPartitions("block").mapInArrow(lambda b: tidy(_tables(b)), "block int, word binary, string long, n long")
    tables = scratch.keep(tables, "tables")

    in_blocks = tables.filter("word IS NOT NULL")
    counted = scratch.keep(in_blocks.groupBy("word").agg(F.sum("n").alias("n")), "words")  # a table, so that the join below may split a common word's blocks
    words = in_blocks.select("block", "word").join(counted, "word").select("block", F.lit(0).alias("kind"), F.col("n").alias("id"), F.lit(None).cast("double").alias("num"), F.col("word").alias("bytes"))
    v, total = counted.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()

    strings = tables.filter("word IS NULL")
    context = lambda d: F.shiftright("string", 8 * (tree.DEPTH - d + 1))
    totals = cut(strings.groupBy("string").agg(F.sum("n").alias("n")).repartition(parallelism(spark), context(INNER)).sortWithinPartitions("string"))
    whole = lambda df: df.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")])
    sums = "node long, zeros double, ones double, below double"
    inner = cut(whole(totals.mapInArrow(lambda b: tidy(_crowns(b, piece)), sums)))
    top = _top(whole(inner.mapInArrow(_raise, sums)).collect())  # 65,280 rows at most
    none = F.lit(None).cast("double")
    share = F.pmod(F.xxhash64(context(INNER)), F.lit(SHARES)).cast("int")  # a context of two bytes is dealt to so many tasks, its nodes to each
    nodes = inner.select(F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"), F.shiftright("node", 8).alias("prefix"), F.lit(0).alias("kind"), F.col("node").alias("key"), F.col("zeros").cast("long").alias("n"), "ones", "below")
    keyed = totals.select(share.alias("share"), context(INNER - 1).alias("prefix"), F.lit(1).alias("kind"), F.col("string").alias("key"), "n", none.alias("ones"), none.alias("below"))
    model = nodes.unionByName(keyed).repartition(parallelism(spark), "share", "prefix").sortWithinPartitions("share", "prefix", "kind", "key").mapInArrow(lambda b: tidy(_model(b, top, piece)), "string long, log10 double")
    logs = strings.select("string", "block").join(model, "string").select("block", F.lit(1).alias("kind"), F.col("string").alias("id"), F.col("log10").alias("num"), F.lit(None).cast("binary").alias("bytes"))

    texts = packed.select("block", F.lit(2).alias("kind"), "id", F.col("held").cast("double").alias("num"), F.col("packed").alias("bytes"))
    scored = cut(words.unionByName(logs).unionByName(texts).repartitionById(n, F.col("block")).sortWithinPartitions("block", "kind").mapInArrow(lambda b: tidy(_score(b)), SCORES))
    scratch.clear()
    per_token = F.lit(float(np.log10((total or 0) + 0.5 * ((v or 0) + 1))))
    return scored.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total or 0).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * per_token).alias("base_score"), "score"
    )
