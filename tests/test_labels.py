"""Components of masks by runs, against a flood fill."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from carpalake.operators import images, labels


def flood(mask, corners=True):
    """Labels in the order of first pixels, and each component's figures."""
    h, w = mask.shape
    out, n = np.zeros((h, w), int), 0
    near = [(-1, 0), (1, 0), (0, -1), (0, 1)] + [(-1, -1), (-1, 1), (1, -1), (1, 1)] * corners
    for y in range(h):
        for x in range(w):
            if mask[y, x] and not out[y, x]:
                n += 1
                stack, out[y, x] = [(y, x)], n
                while stack:
                    a, b = stack.pop()
                    for dy, dx in near:
                        c, d = a + dy, b + dx
                        if 0 <= c < h and 0 <= d < w and mask[c, d] and not out[c, d]:
                            out[c, d] = n
                            stack.append((c, d))
    return out


def spiral(n):
    """One component that winds to the middle; its runs make a chain."""
    m = np.zeros((n, n), bool)
    y = x = 0
    dy, dx = 0, 1
    m[0, 0] = True
    for _ in range(4 * n):
        for _ in range(n):
            a, b = y + dy, x + dx
            c, d = a + dy, b + dx
            if not (0 <= a < n and 0 <= b < n) or (0 <= c < n and 0 <= d < n and m[c, d]):
                break
            y, x = a, b
            m[y, x] = True
        dy, dx = dx, -dy
    return m


def masks():
    rng = np.random.default_rng(3)
    out = [np.zeros((5, 5), bool), np.ones((4, 7), bool), spiral(41), np.eye(9, dtype=bool), np.eye(9, dtype=bool)[:, ::-1]]
    checker = np.indices((8, 8)).sum(axis=0) % 2 == 0
    comb = np.zeros((12, 21), bool)
    comb[:, ::2] = True
    comb[-1] = True
    touching = np.zeros((6, 6), bool)  # two squares that meet at a corner
    touching[:3, :3] = touching[3:, 3:] = True
    out += [checker, comb, comb[::-1], touching] + [rng.random((20, 30)) < p for p in (0.2, 0.4, 0.5, 0.6, 0.8)]
    return out


def pixels(spark):
    rows = [(i, int(x), int(y), bool(m[y, x])) for i, m in enumerate(masks()) for y in range(m.shape[0]) for x in range(m.shape[1])]
    return spark.createDataFrame(rows, "id long, x int, y int, v boolean").repartition(5)


@pytest.mark.parametrize("corners", [True, False])
def test_labels_against_flood_fill(spark, corners):
    assert spiral(41).sum() > 800 and flood(spiral(41), False).max() == 1
    spans = labels.labelled_runs(pixels(spark).filter("v"), corners)
    assert spans.columns == ["id", "y", "x0", "x1", "label"]
    got = [np.zeros(m.shape, int) for m in masks()]
    for r in spans.collect():
        got[r.id][r.y, r.x0 : r.x1 + 1] = r.label
    for m, g in zip(masks(), got):
        assert (g == flood(m, corners)).all()


def test_pixels_and_both_kinds_of_figures(spark):
    whole = labels.label_pixels(pixels(spark), "v")
    assert whole.columns == ["id", "x", "y", "v", "label"]
    rows = whole.collect()
    want = [flood(m) for m in masks()]
    assert len(rows) == sum(m.size for m in masks()) and all(want[r.id][r.y, r.x] == r.label for r in rows)
    key = lambda df: sorted(tuple(round(v, 9) for v in r) for r in df.select("id", "label", "area", "x", "y", "w", "h", "cx", "cy").collect())
    assert key(images.component_stats(whole)) == key(labels.run_stats(labels.labelled_runs(pixels(spark).filter("v"))))


def test_repeated_pixels_and_an_empty_mask(spark):
    df = pixels(spark).filter("v")
    assert labels.labelled_runs(df.unionByName(df)).count() == labels.labelled_runs(df).count()
    assert labels.labelled_runs(df.filter("id < 0")).count() == 0
    assert labels.label_pixels(pixels(spark).filter("id = 0"), "v").agg(F.sum("label")).first()[0] == 0


@pytest.mark.parametrize("corners", [True, False])
def test_images_of_several_strips_and_words(spark, corners):
    rng = np.random.default_rng(9)
    made = [spiral(131), np.ones((130, 70), bool), *(rng.random((150, 140)) < p for p in (0.45, 0.6)), np.eye(200, dtype=bool)]
    rows = [(i, int(x) - 75, int(y) - 66) for i, m in enumerate(made) for y, x in np.argwhere(m)]
    df = spark.createDataFrame([*rows, *rows[:999], (None, 1, 1), (1, None, 1), (1, 1, None)], "id int, x int, y int").repartition(7)
    spans = labels.labelled_runs(df, corners)
    assert dict(spans.dtypes)["id"] == "int"
    got = [np.zeros(m.shape, int) for m in made]
    for r in spans.collect():
        got[r.id][r.y + 66, r.x0 + 75 : r.x1 + 76] = r.label
    assert all((g == flood(m, corners)).all() for g, m in zip(got, made))


def test_words_are_shuffled_and_not_pixels(spark):
    """A task makes words of its pixels first; only what leads from strip to strip is contracted over the cluster."""
    plan = labels.runs(pixels(spark).filter("v"))._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Exchange hashpartitioning") == 2 and "partial_bit_or" in plan.split("Exchange")[-2] + plan.split("Exchange")[-1]


def test_strips_that_go_on_over_batches():
    import pyarrow as pa

    m = np.random.default_rng(10).random((64, 50)) < 0.5
    rows = []
    for i in range(3):
        for y in range(64):
            at = np.flatnonzero(np.diff(np.concatenate([[0], m[y].astype(int), [0]]))).tolist()
            rows += [(i, 0, y, a, b - 1) for a, b in zip(at[::2], at[1::2])]
    columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
    whole = pa.record_batch(columns, ["id", "strip", "y", "x0", "x1"])
    one = pa.Table.from_batches(labels._labelled(iter([whole]), True)).to_pylist()
    for n in (1, 7, 500):
        parts = [whole.slice(i, n) for i in range(0, whole.num_rows, n)]
        assert pa.Table.from_batches(labels._labelled(iter(parts), True)).to_pylist() == one
    assert {len({r["least"] for r in one if r["id"] == i}) for i in range(3)} == {flood(m).max()}
