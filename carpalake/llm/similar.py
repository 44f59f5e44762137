"""Near-duplicates by the Jaccard similarity of word shingles: SimHash links first, then all others, without loss.

A text is the set of its shingles' hashes. SimHash fingerprints of the shingles are linked by deletion variants
(simhash.near_links); those links that have the similarity join the close copies. At a similarity of 0.8 fingerprints may
differ in many more bits than such an index can bridge, so the rest is found by a prefix join.

All shingles are put in one order. Two sets of similarity t share at least t of the larger one, so the first of their
common shingles is among the first n - ceil(t n) + 1 of each: its prefix. Only prefixes are shuffled, and only shingles that
several prefixes hold go on. The order is rare before frequent by the counts of a sample of documents; any order finds
the same links, this one keeps shingles of many documents out of the prefixes.

Sets that share a shingle of their prefixes are candidates unless their bitmaps rule it out: each shingle turns one of 512 bits
over, so the bits in which two bitmaps differ are no more than the shingles that only one of the sets has. In the first
rounds each shingle's sets are compared with one of them, so a large group of copies gives as many pairs as rows. In
the last, sets of one shingle that aren't connected yet are compared with each other, if sizes and places allow the similarity:

- Sets of a and b shingles need o = t / (1 + t) * (a + b) in common. If a shingle is their first common one, neither has more left than
  what follows it. So the smaller set must have it in its first a - o of 2a: its index prefix, about half of its prefix. A shingle that no
  set has in its index prefix joins nothing, however many sets have it; boilerplate after a few words of one's own is such a one.
- Sets meet in bands of sizes, of which the larger one of a pair is in the same or in the next one.
- The sets of a hot shingle meet in blocks, each block of index prefixes with each block of prefixes under a key of its own.
- A pair need only be told at its first common shingle. Shingles that the same sets have are one key, and each key of a set carries up to EARLIER
  keys that the set has before it. Two sets that carry one and the same key have met there or still before, so they are left out here. Whatever is
  carried, nothing is lost: at the first key that both have there is none to carry. (Should two groups of sets have one hash, their keys only become one.)

A candidate becomes a link after a look at the whole sets.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import Scratch, cut, parallelism, sized, tidy
from .components import components
from .simhash import SEED, majority, near_links, shingle_hashes

SAMPLE, FREQUENT, SENT = 20_000, 200_000, 200_000  # documents counted, shingles ranked, nodes broadcast
MARKS, STARS = 8, 2  # longs of a bitmap; rounds with one center
EARLIER = 16  # earlier keys of a set that go with each of its keys, at most
BLOCK = 2000  # sets of a hot shingle that are compared with as many others under one key


def shingles(text: bytes, width: int) -> np.ndarray:
    """The distinct hashes of runs of width words, sorted; a text without words is one empty shingle."""
    found = shingle_hashes(text, width)
    return np.unique(found.view(np.int64)) if len(found) else np.array([xxh64_intdigest(b"", SEED)], np.uint64).view(np.int64)


def bitmap(h: np.ndarray) -> np.ndarray:
    """MARKS longs; h: distinct hashes."""
    odd = np.bincount((h.view(np.uint64) >> np.uint64(55)).astype(np.int64), minlength=64 * MARKS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def digest(h: np.ndarray) -> int:
    return int(np.uint64(xxh64_intdigest(h.tobytes(), SEED)).view(np.int64))


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (len(a) + len(b) - common) - 1e-9


def _frequent(docs: DataFrame, width: int, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a sample have, sorted, and their ranks by frequency from 1 on."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    share = -(-docs.count() // SAMPLE)
    some = docs.filter(F.pmod(F.xxhash64(text), F.lit(max(1, share))) == 0).select(text.cast("binary").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.record_batch([pa.array(shingles(t, width))], ["key"])

    counts = some.mapInArrow(lambda b: tidy(each(b)), "key long").groupBy("key").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    got = counts.orderBy(F.desc("times"), "key").limit(FREQUENT).toArrow()
    keys = got.column("key").to_numpy()
    at = np.argsort(keys)
    return keys[at], np.arange(len(keys), 0, -1, dtype=np.int32)[at]


OWN = "id long, tag long, node long, n int, fp long, marks array<long>, keys array<long>"


def _prefixes(batches: Iterator[pa.RecordBatch], similarity: float, width: int, hot: np.ndarray, ranks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """batches: id, tag, text. Rows of OWN: node stands for the set of n shingles, keys are its prefix."""
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            part = batch.slice(i, 1000)
            nodes, sizes, prints, marks, keys = [], [], [], [], []
            for text in part.column(2).to_pylist():
                found = shingle_hashes(text, width)
                h = np.unique(found.view(np.int64)) if len(found) else shingles(b"", width)
                first = len(h) - ceil(similarity * len(h) - 1e-9) + 1
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                    order = np.argsort(np.where(hot[at] == h, ranks[at], 0), kind="stable")[:first]
                else:
                    order = slice(first)
                nodes.append(digest(h))
                sizes.append(len(h))
                prints.append(majority(found))
                marks.append(bitmap(h))
                keys.append(h[order])
            lists = lambda rows: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32)), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64)))
            yield pa.record_batch([part.column(0), part.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), lists(marks), lists(keys)], [c.split()[0] for c in OWN.split(", ")])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches: key, node and what goes with the two, sorted. Distinct rows whose key has several nodes."""
    last = None  # a row whose key has no second node so far
    done = None  # the last row, of a key that has several
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.array([c.to_numpy() for c in batch.columns], np.int64)
        last = rows[:, :0] if last is None else last
        if done is not None:
            rows = np.concatenate([done, rows], axis=1)
        rows = np.concatenate([last, rows], axis=1)
        fresh = np.ones(rows.shape[1], bool)
        fresh[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)
        rows = rows[:, fresh]
        same = rows[0, 1:] == rows[0, :-1]
        several = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        if done is not None:
            several[0] = False  # it has gone out, and what follows it goes out by itself
            several[1:2] |= rows[0, 1:2] == done[0]
        yield pa.record_batch([pa.array(r[several]) for r in rows], batch.schema.names)
        went = several[-1] or (done is not None and rows.shape[1] == 1)
        last, done = (rows[:, :0], rows[:, -1:]) if went else (rows[:, -1:], None)


def _may_reach(similarity: float) -> Column:
    """Whether bitmaps a.marks and b.marks allow the similarity to sets of a.n and b.n shingles."""
    differ = sum((F.bit_count(F.col(f"am{i}").bitwiseXOR(F.col(f"bm{i}"))) for i in range(MARKS)), F.lit(0))
    most = F.lit((1 - similarity) / (1 + similarity)) * (F.col("an") + F.col("bn")) + F.lit(1e-9)
    return (differ <= most) & (F.abs(F.col("an") - F.col("bn")) <= most)


def _side(nodes: DataFrame, s: str, *more: str | Column) -> DataFrame:
    return nodes.select(*more, F.col("node").alias(s), F.col("n").alias(f"{s}n"), *[F.col("marks")[i].alias(f"{s}m{i}") for i in range(MARKS)])


def _merged(placed: DataFrame, sizes: DataFrame, similarity: float) -> DataFrame:
    """key, node, least, n, left, before: keys that may join sets, those that the same sets have as one. placed: key, node, place, least; sizes: node, n.

    left: shingles from the key on. before: of a set's keys that come earlier, the least of each of EARLIER classes of keys, or null.
    """
    sets = placed.join(sizes, "node").withColumn("left", F.col("n") - F.col("place"))
    same = F.xxhash64(F.count(F.lit(1)), *[F.bit_xor(F.xxhash64("node", F.lit(i))) for i in range(2)])
    open_ = sets.groupBy("key").agg(F.min("least").alias("lo"), F.max("least").alias("hi"), F.max(_in_index(similarity)).alias("any"), same.alias("same")).filter("lo <> hi AND any").select("key", "same")
    merged = sets.join(open_, "key").groupBy(F.col("same").alias("key"), "node", "least", "n").agg(F.max("left").alias("left"))
    earlier = Window.partitionBy("node").orderBy(F.desc("left")).rowsBetween(Window.unboundedPreceding, -1)
    before = [F.min(F.when(F.pmod("key", F.lit(EARLIER)) == i, F.col("key"))).over(earlier) for i in range(EARLIER)]
    return merged.withColumn("before", F.array(*before))


def _in_index(similarity: float) -> Column:
    """Whether a key with `left` of n shingles from it on is in a set's index prefix."""
    return F.col("left") >= 2 * similarity / (1 + similarity) * F.col("n") - 1e-9


def _meeting(placed: DataFrame, marked: DataFrame, similarity: float, block: int) -> DataFrame:
    """a, b: pairs of sets that share a key and aren't connected, as far as sizes, places and bitmaps allow the similarity. placed: key, node, place, least; marked: node, n, marks."""
    share, e = similarity / (1 + similarity), 1e-9
    band = F.floor(F.log(F.col("n").cast("double")) / -np.log(similarity) + e) if similarity < 1 else F.col("n").cast("long")
    merged = _merged(placed, marked.select("node", "n"), similarity)
    sets = cut(merged.join(marked.select("node", "marks"), "node").withColumn("band", band))
    bands = F.array("band", F.col("band") + 1) if similarity < 1 else F.array("band")
    small = sets.filter(_in_index(similarity)).withColumn("band", F.explode(bands))
    blocks = lambda df, name: df.groupBy("key", "band").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    both = cut(blocks(small, "of_a").join(blocks(sets, "of_b"), ["key", "band"]))  # how many blocks of each kind meet
    deal = lambda name: F.pmod(F.xxhash64("node", F.lit(name)), F.col(name)).cast("int")
    other = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    a = small.join(both, ["key", "band"]).withColumn("i", deal("of_a")).withColumn("j", other("of_b"))
    b = sets.join(both, ["key", "band"]).withColumn("j", deal("of_b")).withColumn("i", other("of_a"))
    on = ["key", "band", "i", "j"]
    more = lambda s: [F.col("least").alias(f"{s}l"), F.col("left").alias(f"{s}left"), *[F.col("before")[i].alias(f"{s}e{i}") for i in range(EARLIER)]]
    pairs = _side(a, "a", *on, *more("a")).join(_side(b, "b", *on, *more("b")), on)
    smaller = (F.col("an") < F.col("bn")) | (F.col("an") == F.col("bn")) & (F.col("a") != F.col("b"))
    enough = F.least("aleft", "bleft") >= share * (F.col("an") + F.col("bn")) - e
    met = reduce(Column.__or__, [F.coalesce(F.col(f"ae{i}") == F.col(f"be{i}"), F.lit(False)) for i in range(EARLIER)])
    return pairs.filter((F.col("al") != F.col("bl")) & smaller & enough & _may_reach(similarity) & ~met).select("a", "b")


def wide_bitmap(h: np.ndarray) -> np.ndarray:
    """A bitmap of four times as many bits as there are hashes (512 to 2 ** 17), as longs. Halves laid over each other give the next smaller one."""
    size = min(max(512, 1 << (4 * len(h) - 1).bit_length()), 1 << 17)
    odd = np.bincount(h & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def least_difference(a: np.ndarray, b: np.ndarray) -> int:
    """No more than the hashes that only one of the sets of two wide bitmaps has."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _packed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            part = batch.slice(i, 1000)
            texts = part.column(1).to_pylist()
            sets = [shingles(t, width) for t in texts]
            yield pa.record_batch([part.column(0), pa.array([len(h) for h in sets], pa.int32()), pa.array([wide_bitmap(h).tobytes() for h in sets], pa.binary()), pa.array([z.compress(t) for t in texts], pa.binary())], ["node", "n", "wide", "packed"])


def _possible(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """batches: a, b, their sizes and wide bitmaps. Those pairs that these allow the similarity."""
    for batch in batches:
        most = (1 - similarity) / (1 + similarity) * (batch.column(2).to_numpy().astype(float) + batch.column(3).to_numpy()) + 1e-9
        found = [least_difference(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")) for x, y in zip(batch.column(4), batch.column(5), strict=True)]
        yield pa.record_batch(batch.columns[:2], ["a", "b"]).filter(pa.array(np.array(found, float) <= most, pa.bool_()))


def _checked(batches: Iterator[pa.RecordBatch], similarity: float, width: int) -> Iterator[pa.RecordBatch]:
    """batches: a, b and their texts. Those pairs whose sets have the similarity."""
    z, held = zstandard.ZstdDecompressor(), {}

    def of(node: int, packed: pa.BinaryScalar) -> np.ndarray:
        if node not in held:
            if len(held) > 200:
                held.clear()
            held[node] = shingles(z.decompress(packed.as_py()), width)
        return held[node]

    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        ok = [similar(of(a[i], batch.column(2)[i]), of(b[i], batch.column(3)[i]), similarity) for i in range(batch.num_rows)]
        yield pa.record_batch(batch.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _verified(pairs: DataFrame, docs: DataFrame, roots: DataFrame, scratch: Scratch, name: str, similarity: float, width: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs of nodes whose sets, worked out again from the texts, have the similarity. Wide bitmaps go ahead; texts travel compressed."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(roots, "node").select("node", F.col("root.id").alias("id"), F.col("root.tag").alias("tag"))
    nodes = cut(nodes)
    count = nodes.count()
    wanted = (F.broadcast(nodes) if count <= SENT else nodes).alias("wanted")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tag"), text.cast("binary").alias("text")).alias("rows")
    texts = rows.join(wanted, (F.col("rows.tag") == F.col("wanted.tag")) & F.col("rows.id").eqNullSafe(F.col("wanted.id"))).select("node", "text")
    held = sized(scratch.keep(texts.mapInArrow(lambda b: tidy(_packed(b, width)), "node long, n int, wide binary, packed binary"), name), count, 2000)
    side = lambda s: held.select(F.col("node").alias(s), F.col("n").alias(f"{s}n"), F.col("wide").alias(f"{s}w"))
    pairs = cut(sized(pairs, pairs.count(), 20_000).join(side("a"), "a").join(side("b"), "b").select("a", "b", "an", "bn", "aw", "bw").mapInArrow(lambda b: tidy(_possible(b, similarity)), "a long, b long"))
    both = sized(pairs, pairs.count(), 2000).join(held.select(F.col("node").alias("a"), F.col("packed").alias("x")), "a").join(held.select(F.col("node").alias("b"), F.col("packed").alias("y")), "b")
    found = cut(both.select("a", "b", "x", "y").mapInArrow(lambda b: tidy(_checked(b, similarity, width)), "a long, b long"))
    scratch.clear(name)
    return found


def similar_groups(docs: DataFrame, similarity: float = 0.8, width: int = 5, bucket: int = 4096, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, component_id, tag, kept.

    component_id is the smallest id reachable over pairs of texts whose sets of shingles have a Jaccard similarity
    of at least `similarity`; kept marks the row of that id (of rows that share it, the one with the smallest hash of
    its text). Words are what lies between ASCII whitespace, A-Z in lower case; shingles are equal if their 64-bit
    hashes are.
    Cases: texts of up to `width` words are one shingle; null and wordless texts are equal to each other; null ids never
    name a component unless it has no other (then null); rows that repeat id and text share one verdict; an empty
    table gives no rows; other columns are not read.
    """
    scratch, parts = Scratch(docs.sparkSession, "similar"), parallelism(docs.sparkSession)
    hot, ranks = _frequent(docs, width, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tag"), text.cast("binary").alias("text"))
    own = scratch.keep(read.mapInArrow(lambda b: tidy(_prefixes(b, similarity, width, hot, ranks)), OWN), "own")
    root = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tag")).alias("root")
    nodes = scratch.keep(own.groupBy("node").agg(root, F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("marks").alias("marks")), "nodes")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        return _verified(pairs, docs, nodes.select("node", "root"), scratch, f"texts-{uuid.uuid4().hex}", similarity, width, id_col, text_col)

    # fingerprints
    tops = cut(nodes.groupBy("fp").agg(F.min("node").alias("top")))
    equal = nodes.join(tops, "fp").filter("node <> top").select(F.col("top").alias("a"), F.col("node").alias("b"))
    close = near_links(tops.select("fp"), bucket)
    for c in ("a", "b"):
        close = close.join(tops.select(F.col("fp").alias(c), F.col("top").alias(f"{c}_top")), c)
    links = verified(equal.unionByName(close.select(F.col("a_top").alias("a"), F.col("b_top").alias("b"))))

    # prefixes
    rows = own.select(F.posexplode("keys").alias("place", "key"), "node").select("key", "node", F.col("place").cast("long")).repartition(parts, "key").sortWithinPartitions("key", "node")
    members = scratch.keep(rows.mapInArrow(lambda b: tidy(_shared(b)), "key long, node long, place long"), "members")
    marked = scratch.keep(nodes.join(members.select("node").distinct(), "node").select("node", "n", "marks"), "marked")

    def placed() -> DataFrame:
        """members with the component that each node is in so far."""
        found = components(links)
        return cut(members.join(found, "node", "left").select("key", "node", "place", F.coalesce("least", "node").alias("least")))

    for turn in range(STARS):  # another center each time, the same one for all keys that share it
        now = placed()
        centers = now.groupBy("key").agg(F.min_by(F.struct("node", "least"), F.xxhash64("node", F.lit(turn))).alias("c"))
        stars = now.join(centers, "key").filter(F.col("c.least") != F.col("least")).select(F.col("c.node").alias("a"), F.col("node").alias("b")).distinct()
        may = stars.join(_side(marked, "a"), "a").join(_side(marked, "b"), "b").filter(_may_reach(similarity)).select("a", "b")
        links = cut(links.unionByName(verified(may)))

    cross = _meeting(placed(), marked, similarity, block)
    links = links.unionByName(verified(cross))

    roots = nodes.select("node", "root")
    classes = roots.join(components(links), "node", "left").withColumn("least", F.coalesce("least", "node"))
    tops = classes.groupBy("least").agg(F.min("root").alias("top"))
    by_node = classes.select("node", "least").join(tops, "least").select("node", "top")
    out = own.select("id", "tag", "node").join(by_node, "node").select(
        F.col("id").alias(id_col),
        F.col("top.id").alias("component_id"),
        "tag",
        (F.col("id").eqNullSafe(F.col("top.id")) & (F.col("tag") == F.col("top.tag"))).alias("kept"),
    )
    out = cut(out)
    scratch.clear()
    return out
