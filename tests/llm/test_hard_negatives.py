import numpy as np
import pytest
from pyspark.sql import functions as F

from carpalake.llm.hard_negatives import Best, Node, Tree, augmented, mine_negatives

SCHEMA = "id long, label int, vector array<int>, leaf string, score int"


def plain(rows, is_anchor, positives=5, negatives=5, low=80, high=100):
    """Every anchor against every item."""
    first = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and None not in v:
            first[i] = min(first.get(i, (label, v)), (label, v))
    out = []
    for a in filter(is_anchor, first):
        label, v = first[a]
        scores = sorted((-sum(x * y for x, y in zip(v, w)), i, other == label) for i, (other, w) in first.items() if i != a)
        for p, pid, _ in [s for s in scores if s[2]][:positives]:
            fit = [(-n, i) for n, i, same in scores if not same and low * -p <= 100 * -n <= high * -p]
            out += [(a, pid, k, i, -p, n) for k, (n, i) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def rows(n, dim, seed, scale=100, clusters=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, scale, (n, dim))
    if clusters:
        x = x * 0.05 + rng.normal(0, scale, (clusters, dim))[rng.integers(0, clusters, n)]
    x = np.floor(x).astype(int).tolist()
    return [(i, int(rng.integers(0, 4)), v) for i, v in enumerate(x)]


def frame(spark, data):
    return spark.createDataFrame([(i, label, v, "x", 1) for i, label, v in data], SCHEMA).repartition(5)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("dim,clusters,options", [(16, 0, {}), (3, 6, {}), (2, 0, {"block": (7, 90), "sample": 50}), (8, 4, {"fanout": 3, "depth": 4, "positives": 3, "negatives": 7, "low": 50, "high": 90}), (4, 3, {"sample": 1})])
def test_against_brute_force(spark, dim, clusters, options):
    data = rows(700, dim, dim, clusters=clusters)
    out = mine_negatives(frame(spark, data), F.col("id") % 20 == 0, **options)
    assert out.columns == COLUMNS
    got, want = sorted(map(tuple, out.collect())), plain(data, lambda i: i % 20 == 0, **{k: v for k, v in options.items() if k in ("positives", "negatives", "low", "high")})
    assert got == want and len(want) > 20


def test_ties_repeats_nulls_and_a_hot_vector(spark):
    rng = np.random.default_rng(1)
    data = [(i, i % 3, [5, 5, i % 4]) for i in range(300)]  # many equal vectors
    data += [(300 + i, 1, [7, 0, 0]) for i in range(300)] + [(600, 0, [0, 0, 0]), (700, 0, [-3, -3, -3]), (800, 5, [1, 1, 1])]
    data += data[:50] + [(100, 0, [9, 9, 9]), (100, 2, [1, 0, 0]), (None, 1, [1, 2, 3]), (900, None, [1, 2, 3]), (1000, 1, None), (1100, 1, [1, None, 3])]
    rng.shuffle(data)
    data = [(None if i is None else int(i), None if b is None else int(b), None if v is None else [None if x is None else int(x) for x in v]) for i, b, v in data]
    got = sorted(map(tuple, mine_negatives(frame(spark, data), F.col("id") % 100 == 0, fanout=4).collect()))
    assert got == plain(data, lambda i: i % 100 == 0) and got


def test_empty_table_few_rows_and_errors(spark):
    assert mine_negatives(frame(spark, rows(3, 2, 1)).limit(0), F.col("id") % 100 == 0).count() == 0
    assert mine_negatives(frame(spark, [(100, 1, [1, 2])]), F.col("id") % 100 == 0).count() == 0
    assert mine_negatives(frame(spark, [(1, 1, [1, 2]), (2, 1, [1, 2])]), F.col("id") % 100 == 0).count() == 0  # no anchor
    with pytest.raises(ValueError, match="1 to 2 components"):
        mine_negatives(frame(spark, [(1, 1, [1, 2]), (2, 1, [1])]), F.col("id") % 100 == 0)
    with pytest.raises(ValueError, match="too large"):
        mine_negatives(frame(spark, [(1, 1, [2**30, 2**30])]), F.col("id") % 100 == 0)


def ranged(tree, x):
    leaf, ranges = tree.route(augmented(x, tree.most))
    for node in tree.nodes:
        k = len(node.points)
        none = (np.full((k, k), np.inf), np.full((k, k), -np.inf))
        node.near, node.far = ranges.get(node.number, none)
    return leaf


def test_ranges_eliminate_leaves_but_no_item():
    rng = np.random.default_rng(4)
    for dim, clusters in ((2, 0), (3, 12), (16, 12)):
        x = np.array([v for _, _, v in rows(3000, dim, dim, clusters=clusters)], float)
        tree = Tree(x[:500], float((x * x).sum(axis=1).max()))
        leaf = ranged(tree, x)
        assert len(set(leaf.tolist())) > 10
        a = x[rng.integers(0, 3000, 40)]
        score = a @ x.T
        high = np.quantile(score, 0.99, axis=1)
        low = np.quantile(score, 0.97, axis=1)
        square = tree.most + (a * a).sum(axis=1)
        to = tree.reached(np.column_stack([a, np.zeros(40)]), np.sqrt(square - 2 * high), np.sqrt(square - 2 * low))
        for i in range(40):
            assert to[i, leaf[(score[i] >= low[i]) & (score[i] <= high[i])]].all()
        if dim < 16 or clusters:
            assert to.mean() < 0.7, to.mean()


def test_tree_of_equal_vectors():
    tree = Tree(np.ones((10, 3)), 3.0)
    assert tree.leaves == 1 and isinstance(tree.root.below[0], Node)
    assert ranged(tree, np.ones((4, 3))).tolist() == [0] * 4


def test_best_keeps_the_first_of_equal_scores():
    best = Best(np.array([[0.0, 5.0]]), np.array([[10.0, 10.0]]), 2)
    for ids in ([9, 8, 7], [3, 11], [4]):
        best.add(np.zeros(len(ids), int), np.array(ids), np.full(len(ids), 5.0))
    assert best.slot.tolist() == [0, 0, 1, 1] and best.id.tolist() == [3, 4, 3, 4]
