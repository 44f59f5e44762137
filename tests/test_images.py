import numpy as np
import pytest

from carpalake.operators import images, score


def rectangle(h, w, boxes, back=0, value=120):
    img = np.full((h, w, 3), back, np.uint8)
    for x0, y0, x1, y1 in boxes:
        img[y0:y1, x0:x1] = value
    return img


def test_to_rgb_and_gray():
    assert images.to_rgb(np.zeros((3, 4), np.uint8)).shape == (3, 4, 3)
    assert images.to_rgb(np.zeros((3, 4, 1), np.uint8)).shape == (3, 4, 3)
    assert images.gray(np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [9, 9, 9]]], np.uint8)).tolist() == [[76, 150, 29, 9]]


def test_resize_against_plain_loop():
    img = np.random.default_rng(0).integers(0, 256, (7, 5, 3)).astype(np.uint8)
    out = images.resize(img, 4, 9)
    for y in range(4):
        for x in range(9):
            sy, sx = np.clip((y + 0.5) * 7 / 4 - 0.5, 0, 6), np.clip((x + 0.5) * 5 / 9 - 0.5, 0, 4)
            a, b = int(sy), int(sx)
            c, d = min(a + 1, 6), min(b + 1, 4)
            want = (img[a, b] * (1 - sy + a) + img[c, b] * (sy - a)) * (1 - sx + b) + (img[a, d] * (1 - sy + a) + img[c, d] * (sy - a)) * (sx - b)
            assert np.abs(out[y, x] - want).max() <= 0.5 + 1e-9
    assert (images.resize(img, 7, 5) == img).all()


def test_lab_round_trip_and_equalization():
    img = np.random.default_rng(1).integers(0, 256, (32, 32, 3)).astype(np.uint8)
    assert np.abs(images.lab_to_rgb(images.rgb_to_lab(img)).astype(int) - img).max() <= 1
    flat = np.tile(np.linspace(100, 140, 64).astype(np.uint8), (64, 1))
    assert images.equalize(flat).std() > flat.std()
    assert images.equalize(np.full((10, 9), 7, np.uint8)).shape == (10, 9)


def test_morphology_and_labels():
    e = images.ellipse(7)
    assert e.sum(axis=1).tolist() == [1, 5, 7, 7, 7, 5, 1]
    mask = np.zeros((20, 20), bool)
    mask[10, 10] = True
    assert images.dilate(mask, e, 1).sum() == e.sum() and not images.erode(mask, e, 1).any()
    m = np.array([[1, 0, 0, 1], [0, 1, 0, 0], [0, 0, 0, 1], [1, 0, 1, 0]], bool)
    assert images.label(m).tolist() == [[1, 0, 0, 2], [0, 1, 0, 0], [0, 0, 0, 3], [4, 0, 3, 0]]


def test_crop():
    two = rectangle(200, 300, [(20, 30, 110, 180), (170, 30, 270, 185)])
    x0, y0, x1, y1 = images.crop_box(two)
    assert (x0, x1) == (10, 120) and (y0, y1) == (20, 190)
    assert images.crop_box(rectangle(100, 100, [])) == (0, 0, 100, 100)
    assert images.crop_box(rectangle(100, 100, [(40, 40, 50, 50)])) == (32, 32, 57, 57)  # too small: the legacy box
    assert images.crop_box(np.full((50, 60, 3), 255, np.uint8)) == (0, 0, 60, 50)


def test_tensor_and_augment():
    img = rectangle(50, 70, [(5, 5, 40, 40)])
    t = images.tensor(img, 32)
    assert t.shape == (3, 32, 32) and t.dtype == np.float32
    assert (images.augment(img, 3) == images.augment(img, 3)).all() and images.augment(img, 3).shape == img.shape
    assert any((images.augment(img, s) != img).any() for s in range(5))


def test_score(spark):
    good = rectangle(40, 40, [(5, 5, 30, 30)])
    rows = [(1, 1, 60.0, 40, 40, 3, good.tobytes()), (2, 0, None, 40, 40, 3, b"short")]
    requests = spark.createDataFrame(rows, "id long, male int, ic_months double, height int, width int, channels int, data binary")
    stats = spark.createDataFrame([(110.0, 45.0)], "boneage_mean double, boneage_std double")
    got = {r.id: r for r in score.predict(requests, stats, score.MeanPixelScorer, size=16).collect()}
    z = images.tensor(good, 16).mean() + 0.25
    want = min(228.0, max(0.0, z * 45 + 110))
    assert got[1].bone_age_meses == pytest.approx(want, abs=1e-3) and got[1].error is None
    assert got[2].error and got[2].bone_age_meses is None and got[2].status is None
    got = {r.id: r for r in score.analyze(requests, stats, score.MeanPixelScorer, size=16).collect()}
    assert got[1].years * 12 + got[1].months == round(got[1].months_total) and got[2].error

    class Wide(score.MeanPixelScorer):
        meta_width = 2

    with pytest.raises(Exception, match="takes 2 values"):
        score.predict(requests, stats, Wide, size=16).collect()


def test_model_file_size(tmp_path):
    (tmp_path / "m.onnx").write_bytes(b"tiny")
    with pytest.raises(ValueError, match="4 bytes"):
        score.checked_model(str(tmp_path / "m.onnx"))


def test_gray_images_take_the_same_way_as_colors():
    rng = np.random.default_rng(5)
    gray = np.repeat(rng.integers(0, 256, (40, 37, 1)).astype(np.uint8), 3, axis=2)
    lab = images.rgb_to_lab(gray)
    lab[..., 0] = images.equalize(np.rint(lab[..., 0] * 2.55).astype(np.uint8)) / 2.55
    assert (images.equalize_contrast(gray) == images.lab_to_rgb(lab)).all()
    color = gray.copy()
    color[..., 1] = rng.integers(0, 256, (40, 37))
    assert (images.resize(color, 21, 60)[..., 0] == images.resize(gray, 21, 60)[..., 0]).all()
    x = images.equalize_contrast(images.resize(color, 16, 16)).astype(np.float32) / 255
    assert np.allclose(images.tensor(color, 16), ((x - images.PIXEL_MEAN) / images.PIXEL_STD).transpose(2, 0, 1), atol=1e-6)


def plain_equalize(channel, clip=2.0, tiles=8):
    """The definition, pixel by pixel: clipped histograms of tiles, their cumulated tables, and a mean of the four nearest tables by distance."""
    h, w = channel.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    mirror = lambda i, n: i if i < n else 2 * n - 2 - i
    at = lambda y, x: int(channel[mirror(y, h), mirror(x, w)])
    limit, tables = max(1, int(clip * th * tw / 256)), {}
    for i in range(tiles):
        for j in range(tiles):
            n = [0] * 256
            for y in range(i * th, (i + 1) * th):
                for x in range(j * tw, (j + 1) * tw):
                    n[at(y, x)] += 1
            over = sum(max(0, v - limit) for v in n)
            n = [min(v, limit) + over // 256 for v in n]
            left = over % 256
            for k in range(left):
                n[k * max(1, 256 // left)] += 1
            total = 0
            tables[i, j] = []
            for v in n:
                total += v
                tables[i, j].append(min(255, round(total * 255 / (th * tw))))
    out = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            fy, fx = y / th - 0.5, x / tw - 0.5
            i, j = int(np.floor(fy)), int(np.floor(fx))
            inside = lambda k: min(max(k, 0), tiles - 1)
            for a, share_y in ((i, 1 - (fy - i)), (i + 1, fy - i)):
                for b, share_x in ((j, 1 - (fx - j)), (j + 1, fx - j)):
                    out[y, x] += share_y * share_x * tables[inside(a), inside(b)][channel[y, x]]
    return out


@pytest.mark.parametrize("shape", [(64, 64), (50, 37), (16, 130)])
def test_equalization_against_its_definition(shape):
    rng = np.random.default_rng(9)
    img = np.clip(np.cumsum(rng.integers(-9, 10, shape), axis=1) + 120, 0, 255).astype(np.uint8)
    assert np.abs(images.equalize(img) - plain_equalize(img)).max() <= 0.5 + 1e-6


@pytest.mark.parametrize(("shape", "to"), [((64, 64), (512, 512)), ((64, 48), (37, 96)), ((5, 7), (41, 70)), ((256, 2), (64, 64))])
def test_resize_is_that_of_double_precision(shape, to):
    """Bit by bit, also where single precision is enough and the last lines don't fill a block."""
    img = np.random.default_rng(2).integers(0, 256, (*shape, 3)).astype(np.uint8)
    axis = lambda n, m: np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    y, x = axis(shape[0], to[0])[:, None, None], axis(shape[1], to[1])[:, None]
    low, left = np.floor(y).astype(int), np.floor(x).astype(int)
    line = lambda i: img[i[:, 0, 0]].astype(np.float64)
    rows = line(low) * (1 - (y - low)) + line(np.minimum(low + 1, shape[0] - 1)) * (y - low)
    want = rows[:, left[:, 0]] * (1 - (x - left)) + rows[:, np.minimum(left + 1, shape[1] - 1)[:, 0]] * (x - left)
    assert (images.resize(img, *to) == np.rint(want)).all()


def test_resize_works_in_single_precision_where_nothing_is_lost():
    import tracemalloc

    img = np.random.default_rng(1).integers(0, 256, (64, 64, 1)).astype(np.uint8)
    images.resize(img)
    tracemalloc.start()
    images.resize(img)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1_100_000  # 1.3 MB in double precision


REQUESTS = "id long, male int, ic_months double, height int, width int, channels int, data binary"


def test_each_request_keeps_its_row(spark):
    """Ids that repeat or are null, images that fail, and rows that the scorer can't take."""

    class Picky(score.MeanPixelScorer):  # pickled by value, as workers don't have this module
        def __call__(self, image, meta):
            if (meta == 7).any():
                raise RuntimeError("no such sex")
            return score.MeanPixelScorer.__call__(self, image, meta)

    data = np.random.default_rng(2).integers(0, 256, (9, 8, 3)).astype(np.uint8).tobytes()
    rows = [(1, 1, 60.0, 9, 8, 3, data), (1, 0, 90.0, 9, 8, 3, data), (None, 1, None, 9, 8, 3, data), (4, 0, 1.0, 9, 9, 3, data), (5, 7, 1.0, 9, 8, 3, data), (6, None, 1.0, 9, 8, 3, data), (7, 1, 1.0, 9, 8, 3, None)]
    requests = spark.createDataFrame(rows, REQUESTS).coalesce(1)
    stats = spark.createDataFrame([(100.0, 10.0)], "boneage_mean double, boneage_std double")
    for flow, months in ((score.predict, "bone_age_meses"), (score.analyze, "months_total")):
        got = flow(requests, stats, Picky, size=16).collect()
        assert [r.id for r in got] == [r[0] for r in rows]
        assert [r[months] is not None for r in got] == [True, True, True, False, False, False, False]
        assert [r.error is None for r in got] == [True, True, True, False, False, False, False]
        assert got[2].status is None and got[4].error == "no such sex"
    assert [(r.x0, r.y1) for r in got[:4]] == [(0, 9)] * 3 + [(None, None)]
    boxes = images.crop_boxes(requests).collect()
    assert [r.x0 is None for r in boxes] == [False, False, False, True, False, False, True]
    assert [r.height is None for r in images.map_images(requests, images.autocrop).collect()] == [False, False, False, True, False, False, True]


def test_tensor_fills_its_place_and_gray_agrees_with_colors():
    rng = np.random.default_rng(6)
    for h, w, size in ((64, 64, 512), (40, 37, 100), (5, 90, 64)):
        level = rng.integers(0, 256, (h, w, 1)).astype(np.uint8)
        room = np.full((2, 3, size, size), np.nan, np.float32)
        assert np.shares_memory(images.tensor(level, size, room[1]), room[1]) and np.isnan(room[0]).all()
        x = images.equalize_contrast(images.resize(np.repeat(level, 3, axis=2), size, size))
        want = (x.transpose(2, 0, 1).astype(np.float32) / 255 - images.PIXEL_MEAN[:, None, None]) / images.PIXEL_STD[:, None, None]
        assert (room[1] == want).all()




def test_dilate_by_any_element():
    rng = np.random.default_rng(8)
    for h, w in ((1, 1), (3, 17), (20, 9), (33, 64)):
        mask, element = rng.random((h, w)) < 0.2, rng.random((5, 5)) < 0.4
        plain = np.array([[any(element[dy + 2, dx + 2] and 0 <= y + dy < h and 0 <= x + dx < w and mask[y + dy, x + dx] for dy in range(-2, 3) for dx in range(-2, 3)) for x in range(w)] for y in range(h)])
        assert (images.dilate(mask, element, 1) == plain).all() and (images.dilate(mask, element, 2) == images.dilate(plain, element, 1)).all()


def test_an_image_of_512_by_512_takes_few_passes():
    """Its preparation in bytes and single precision holds less than four arrays of doubles of its size at once."""
    import tracemalloc

    img, room = np.zeros((64, 64, 1), np.uint8), np.empty((3, 512, 512), np.float32)
    img[20:40, 10:50] = 120
    images.tensor(img, 512, room)
    tracemalloc.start()
    images.tensor(img, 512, room)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4 * 512 * 512 * 8


def test_a_gray_pixel_is_looked_up_three_times(monkeypatch):
    """The tables above and below at once, on the left and on the right, and then the value; lightness is looked up in the tables, not in the pixels."""
    img, take, fetched = np.random.default_rng(3).integers(0, 256, (64, 64, 1)).astype(np.uint8), np.take, []
    want = images.tensor(img)

    def counted(a, indices, axis=None, **more):
        if axis is None:
            fetched.append(np.size(indices))
        return take(a, indices, axis=axis, **more)

    monkeypatch.setattr(np, "take", counted)
    assert (images.tensor(img) == want).all() and sum(fetched) == 3 * 512 * 512


@pytest.mark.parametrize("shape", [(512, 512), (64, 128), (7, 5), (50, 37)])
def test_equalization_through_a_table(shape):
    rng = np.random.default_rng(4)
    channel, of = rng.integers(0, 256, shape).astype(np.uint8), rng.integers(0, 256, 256).astype(np.uint8)
    assert (images.equalize(channel, of=of) == images.equalize(of[channel])).all()


def test_whole_64ths_say_what_doubles_say(monkeypatch):
    channel = np.random.default_rng(5).integers(0, 256, (256, 512)).astype(np.uint8)
    whole = images.equalize(channel)
    monkeypatch.setattr(images, "_between_tables_in_64ths", images._between_tables)
    assert (images.equalize(channel) == whole).all()


def test_all_grays_of_a_lightness_become_one():
    lab = np.repeat(images.rgb_to_lab(np.repeat(np.arange(256, dtype=np.uint8)[:, None, None], 3, axis=2)), 256, axis=1)
    lab[..., 0] = np.arange(256) / 2.55
    assert (images.lab_to_rgb(lab) == images._gray_results()).all()
