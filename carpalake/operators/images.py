"""Radiograph preparation: relational forms on pixel tables, and numpy kernels behind Arrow.

Kernels take and give uint8 arrays of height, width and channels (RGB). They follow the published
definitions of the methods (bilinear resampling at half-pixel centres, contrast-limited
adaptive histogram equalization, CIE Lab, morphology with an elliptic element).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import IMAGE

SIZE = 512
LINES = 64  # of an image worked on at once: few enough to stay in the processor's cache, and many for each call
#: Channel means and deviations of the usual pretraining corpus.
PIXEL_MEAN = np.array([0.485, 0.456, 0.406], np.float32)
PIXEL_STD = np.array([0.229, 0.224, 0.225], np.float32)


# Relational forms -------------------------------------------------------------------------------


def legacy_box(pixels: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """id, x0, y0, x1, y1, cropped. pixels: id, x, y, v (gray), and h, w of the image; or else sizes: id, h, w.

    With h and w in the pixels' own rows, each task aggregates what it has of an image and no pixel is shuffled; sizes apart are a join of all pixels. Null ids are left out either way.

    A background is dark if at least three corners are below 100; the mask is then v > 20, else v < 235. The padded
    box of the mask is taken if it has less than 90 % of the image; its far edges are exclusive.
    """
    p = pixels.filter("id IS NOT NULL") if sizes is None else pixels.join(sizes, "id")
    corner = F.col("x").isin(0) | (F.col("x") == F.col("w") - 1)
    corner &= F.col("y").isin(0) | (F.col("y") == F.col("h") - 1)
    masked = lambda m: [f(F.when(m, F.col(c))).alias(f"{n}{c}_{k}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))]
    k = "dark"
    dark = masked(F.col("v") > 20)
    k = "light"
    light = masked(F.col("v") < 235)
    boxes = p.groupBy("id").agg(F.first("h").alias("h"), F.first("w").alias("w"), F.count_if(corner & (F.col("v") < 100)).alias("corners"), *dark, *light)
    pick = lambda c: F.when(F.col("corners") >= 3, F.col(f"{c}_dark")).otherwise(F.col(f"{c}_light"))
    box = boxes.select("id", "h", "w", *[pick(c).alias(c) for c in ("lox", "hix", "loy", "hiy")])
    pad = lambda lo, hi: F.greatest(F.lit(8), F.floor((F.col(hi) - F.col(lo)) * 0.03).cast("int"))
    padded = box.select("id", "h", "w", F.greatest(F.lit(0), F.col("lox") - pad("lox", "hix")).alias("x0"), F.greatest(F.lit(0), F.col("loy") - pad("loy", "hiy")).alias("y0"), F.least("w", F.col("hix") + pad("lox", "hix")).alias("x1"), F.least("h", F.col("hiy") + pad("loy", "hiy")).alias("y1"), F.col("lox").isNotNull().alias("found"))
    ok = F.col("found") & ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) < F.col("w") * F.col("h") * 0.9)
    return padded.select("id", *[F.when(ok, F.col(c)).otherwise(F.col(d) if d else F.lit(0)).cast("int").alias(c) for c, d in (("x0", None), ("y0", None), ("x1", "w"), ("y1", "h"))], ok.alias("cropped"))


def component_stats(labelled: DataFrame) -> DataFrame:
    """Area, box and centroid of each label but the background 0. labelled: id, x, y, label."""
    a = [F.count(F.lit(1)).alias("area"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"), F.avg("x").alias("cx"), F.avg("y").alias("cy")]
    return labelled.filter("label <> 0").groupBy("id", "label").agg(*a)


def pick_component(stats: DataFrame, total: Column, share: float = 0.06) -> DataFrame:
    """Of the (at most) two largest components over `share` of the image, the one further left; ties go to the larger."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("area"), "label"))
    two = stats.filter(F.col("area") > total * share).withColumn("rank", rank).filter("rank <= 2")
    return two.groupBy("id").agg(F.min_by("label", F.struct("cx", "rank")).alias("label"))


def normalized(v: Column, mean: float | Column, std: float | Column) -> Column:
    return (v / F.lit(255.0) - mean) / std


# Kernels ----------------------------------------------------------------------------------------


def to_rgb(img: np.ndarray) -> np.ndarray:
    img = np.asarray(img, np.uint8)
    img = img[:, :, None] if img.ndim == 2 else img
    return np.repeat(img, 3, axis=2) if img.shape[2] == 1 else img


def is_gray(img: np.ndarray) -> bool:
    """Whether all channels are alike."""
    return img.shape[2] == 1 or all(np.array_equal(img[..., 0], img[..., c]) for c in range(1, img.shape[2]))


def gray(img: np.ndarray) -> np.ndarray:
    return np.rint(img.astype(np.float64) @ (0.299, 0.587, 0.114)).astype(np.uint8)


@lru_cache(maxsize=64)
def _axis(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """For each of m places, the two of n that it lies between, how far it is from the first, and whether all of that are whole 64ths."""
    at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    low = np.floor(at).astype(int)
    part = at - low
    return low, np.minimum(low + 1, n - 1), part, bool((part * 64 == np.floor(part * 64)).all())


def resize(img: np.ndarray, height: int = SIZE, width: int = SIZE) -> np.ndarray:
    if img.shape[2] > 1 and is_gray(img):  # one channel stands for all
        return np.repeat(resize(img[..., :1], height, width), img.shape[2], axis=2)
    (y0, y1, fy, exact_y), (x0, x1, fx, exact_x) = _axis(img.shape[0], height), _axis(img.shape[1], width)
    exact = exact_y and exact_x  # then single precision loses nothing: 8 bits of a pixel, 6 of each weight
    x = img.astype(np.float32 if exact else np.float64)
    if exact:  # in any order, so the many lines come last and are whole ones
        columns = _between_lines(np.ascontiguousarray(x.swapaxes(0, 1)), x0, x1, fx, np.empty((width, *x.shape[::2]), x.dtype))
        return _between_lines(np.ascontiguousarray(columns.swapaxes(0, 1)), y0, y1, fy, np.empty((height, width, x.shape[2]), np.uint8))
    rows = _between_lines(x, y0, y1, fy, np.empty((height, *x.shape[1:]), x.dtype))
    columns = _between_lines(np.ascontiguousarray(rows.swapaxes(0, 1)), x0, x1, fx, np.empty((width, height, x.shape[2]), np.uint8))
    return np.ascontiguousarray(columns.swapaxes(0, 1))


def _between_lines(x: np.ndarray, low: np.ndarray, high: np.ndarray, part: np.ndarray, out: np.ndarray) -> np.ndarray:
    """out, each of its lines being what lies between two lines of x, at that part of the way; rounded if out takes bytes."""
    part = part.astype(x.dtype)[:, None, None]
    rest = 1 - part
    room = np.empty((2, LINES, *x.shape[1:]), x.dtype)
    for i in range(0, len(out), LINES):
        j = slice(i, min(i + LINES, len(out)))
        first, second = room[:, : j.stop - i]
        np.take(x, low[j], axis=0, out=first, mode="clip")
        np.take(x, high[j], axis=0, out=second, mode="clip")
        first *= rest[j]
        second *= part[j]
        first += second
        if out.dtype == np.uint8:
            np.rint(first, out=first)
        out[j] = first
    return out


#: Linear sRGB to CIE XYZ (D65), and the white point.
TO_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
WHITE = np.array([0.950456, 1.0, 1.088754])


_C = np.arange(256) / 255.0
LINEAR = np.where(_C > 0.04045, ((_C + 0.055) / 1.055) ** 2.4, _C / 12.92)


def rgb_to_lab(img: np.ndarray) -> np.ndarray:
    c = LINEAR[img]
    t = c @ TO_XYZ.T / WHITE
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    light = np.where(t[..., 1] > 0.008856, 116 * f[..., 1] - 16, 903.3 * t[..., 1])
    return np.stack([light, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def lab_to_rgb(lab: np.ndarray) -> np.ndarray:
    fy = (lab[..., 0] + 16) / 116
    f = np.stack([fy + lab[..., 1] / 500, fy, fy - lab[..., 2] / 200], axis=-1)
    t = np.where(f > 6 / 29, f**3, (f - 16 / 116) / 7.787)
    c = np.clip(t * WHITE @ np.linalg.inv(TO_XYZ).T, 0, 1)
    c = np.where(c > 0.0031308, 1.055 * c ** (1 / 2.4) - 0.055, 12.92 * c)
    return np.clip(np.rint(c * 255), 0, 255).astype(np.uint8)


@cache
def _spread() -> np.ndarray:
    """For each number of counts that are left, the levels that get one more."""
    out = np.zeros((256, 256), np.intp)
    for left in range(1, 256):
        step = 256 // left
        out[left, : left * step : step] = 1
    return out


def equalize(channel: np.ndarray, clip: float = 2.0, tiles: int = 8, of: np.ndarray | None = None) -> np.ndarray:
    """Contrast-limited adaptive equalization of a uint8 channel, or of what its bytes stand for by a table of 256."""
    h, w = channel.shape
    padded = np.pad(channel, ((0, -h % tiles), (0, -w % tiles)), mode="reflect" if min(h, w) > tiles else "edge") if h % tiles or w % tiles else channel
    th, tw = padded.shape[0] // tiles, padded.shape[1] // tiles
    limit = max(1, int(clip * th * tw / 256))
    tile, places = np.repeat(np.arange(tiles) * 256, tw), np.empty((th, padded.shape[1]), np.intp)
    hist = np.empty((tiles, tiles * 256), np.intp)
    for counts, rows in zip(hist, padded.reshape(tiles, th, -1), strict=True):
        places[:] = rows
        places += tile
        counts[:] = np.bincount(places.ravel(), minlength=tiles * 256)
    hist = hist.reshape(tiles * tiles, 256)
    if of is not None:
        at = np.arange(tiles * tiles)[:, None] * 256 + of
        hist = np.bincount(at.ravel(), weights=hist.ravel(), minlength=hist.size).reshape(hist.shape).astype(np.intp)
    over = np.maximum(hist - limit, 0).sum(axis=1)
    hist = np.minimum(hist, limit) + (over // 256)[:, None] + _spread()[over % 256]  # what is left is spread evenly
    lut = np.clip(np.rint(np.cumsum(hist, axis=1) * 255 / (th * tw)), 0, 255).astype(np.int32)
    lut = lut if of is None else lut[:, of]
    edged = np.clip(np.arange(-1, tiles + 1), 0, tiles - 1)  # cell i lies between i and i + 1
    lut = lut.reshape(tiles, tiles, 256)[edged][:, edged].reshape(tiles + 2, -1)

    def weights(n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(n) / size - 0.5
        low = np.floor(at).astype(int)
        return low + 1, at - low

    (y, fy), (x, fx) = weights(h, th), weights(w, tw)
    exact = all(n <= 64 and n & (n - 1) == 0 for n in (th, tw))  # then weights are whole 64ths
    return (_between_tables_in_64ths if exact else _between_tables)(channel, lut, y, fy, x, fx)


def _between_tables(channel: np.ndarray, lut: np.ndarray, y: np.ndarray, fy: np.ndarray, x: np.ndarray, fx: np.ndarray) -> np.ndarray:
    """What the four nearest tables say of each pixel, by distance. lut: a line for each row of tables, one after another in it; y, x: of the table above and on the left; fy, fx: how far from it."""
    out = np.empty(channel.shape, np.uint8)
    for i in range(0, len(out), LINES):
        j = slice(i, i + LINES)
        at = x * 256 + channel[j]
        up, down = (lut[row, at] * (1 - fx) + lut[row, at + 256] * fx for row in (y[j, None], y[j, None] + 1))
        out[j] = np.rint(up * (1 - fy[j, None]) + down * fy[j, None])
    return out


def _between_tables_in_64ths(channel: np.ndarray, lut: np.ndarray, y: np.ndarray, fy: np.ndarray, x: np.ndarray, fx: np.ndarray) -> np.ndarray:
    """The same in whole numbers: what the table above says and, from bit 16 on, what the one below says are fetched and weighed as one."""
    h, w = channel.shape
    both, out, cell = lut[:-1] | lut[1:] << 16, np.empty((h, w), np.uint8), x * 256
    down, right = (fy * 64).astype(np.int32)[:, None], np.tile((fx * 64).astype(np.int32), (LINES, 1))
    up, left = 64 - down, 64 - right
    places, room, shares = np.empty((LINES, w), np.intp), np.empty((2, LINES, w), np.int32), np.empty((LINES, w), np.float32)
    ends = [*np.flatnonzero(np.diff(y)) + 1, h]
    for i, j in ((k, min(k + LINES, b)) for a, b in zip([0, *ends], ends, strict=False) for k in range(a, b, LINES)):  # lines of one row of cells
        n = j - i
        at, near, far, share = places[:n], *room[:, :n], shares[:n]
        at[:] = channel[i:j]
        at += cell
        np.take(both[y[i]], at, out=near, mode="clip")
        np.take(both[y[i], 256:], at, out=far, mode="clip")
        near *= left[:n]
        far *= right[:n]
        near += far
        np.right_shift(near, 16, out=far)
        near &= 0xFFFF
        near *= up[i:j]
        far *= down[i:j]
        near += far
        share[:] = near
        share *= np.float32(1 / 4096)
        np.rint(share, out=share)
        out[i:j] = share
    return out


def equalize_contrast(img: np.ndarray) -> np.ndarray:
    if is_gray(img):  # its color has no chroma and depends on the new lightness alone
        return _gray_results()[equalize(img[..., 0], of=_lightness())]
    lab = rgb_to_lab(img)
    lab[..., 0] = equalize(np.rint(lab[..., 0] * 2.55).astype(np.uint8)) / 2.55
    return lab_to_rgb(lab)


@cache
def _lightness() -> np.ndarray:
    """The lightness of each gray level, as a byte."""
    return np.rint(rgb_to_lab(np.repeat(np.arange(256, dtype=np.uint8)[:, None, None], 3, axis=2))[:, 0, 0] * 2.55).astype(np.uint8)


@cache
def _gray_results() -> np.ndarray:
    """The color without chroma for each lightness."""
    return lab_to_rgb(np.arange(256)[:, None] / 2.55 * (1, 0, 0))


def ellipse(size: int) -> np.ndarray:
    r = size // 2
    reach = np.rint(np.sqrt(np.maximum(0, r * r - np.arange(-r, r + 1) ** 2)))
    return np.abs(np.arange(-r, r + 1))[None, :] <= reach[:, None]


def dilate(mask: np.ndarray, element: np.ndarray, times: int) -> np.ndarray:
    """The mask is one long number whose bits are its pixels, row by row with a margin, so a shift moves all of them."""
    r, (h, w) = element.shape[0] // 2, mask.shape
    wide = w + 2 * r
    number = lambda m: int.from_bytes(np.packbits(np.pad(m, ((0, 0), (0, 2 * r))), bitorder="little").tobytes(), "little")
    inside, bits = number(np.ones_like(mask, bool)), number(mask)
    moves = [int(dy) * wide + int(dx) for dy, dx in zip(*np.nonzero(element), strict=True)]
    for _ in range(times):
        padded, bits = bits << (r * wide + r), 0
        for move in moves:
            bits |= padded >> move
        bits &= inside
    raw = np.frombuffer(bits.to_bytes(-(-h * wide // 8), "little"), np.uint8)
    return np.unpackbits(raw, count=h * wide, bitorder="little").reshape(h, wide)[:, :w].astype(bool)


def erode(mask: np.ndarray, element: np.ndarray, times: int) -> np.ndarray:
    return ~dilate(~mask, element, times)


def label(mask: np.ndarray) -> np.ndarray:
    """8-connected components, numbered from 1 in the order of their first pixels; 0 is background."""
    up: list[int] = [0]

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    runs, before, now, last = [], [], [], -2
    for (y, a), b in zip(np.argwhere(edges == 1).tolist(), np.nonzero(edges == -1)[1].tolist(), strict=True):
        if y != last:
            before, now, last = now if y == last + 1 else [], [], y
        i = len(up)
        up.append(i)
        for c, d, j in before:
            if c <= b and d >= a:  # touching, corners included
                i, j = sorted((top(i), top(j)))
                up[j] = i
        now.append((a, b, top(i)))
        runs.append((y, a, b, i))
    out, names = np.zeros(mask.shape, np.int32), {}
    for y, a, b, i in runs:
        out[y, a:b] = names.setdefault(top(i), len(names) + 1)
    return out


def crop_legacy_box(g: np.ndarray) -> tuple[int, int, int, int]:
    h, w = g.shape
    corners = [int(g[y, x]) for y in (0, -1) for x in (0, -1)]
    mask = g > 20 if sum(c < 100 for c in corners) >= 3 else g < 235
    if not mask.any():
        return 0, 0, w, h
    (y0, y1), (x0, x1) = (np.flatnonzero(mask.any(axis=a))[[0, -1]].tolist() for a in (1, 0))
    py, px = max(8, int((y1 - y0) * 0.03)), max(8, int((x1 - x0) * 0.03))
    box = max(0, x0 - px), max(0, y0 - py), min(w, x1 + px), min(h, y1 + py)
    return box if (box[2] - box[0]) * (box[3] - box[1]) < w * h * 0.9 else (0, 0, w, h)


def crop_box(img: np.ndarray, share: float = 0.06) -> tuple[int, int, int, int]:
    """x0, y0, x1, y1 of one hand: tissue is between 35 and 250; without a component over `share`, the legacy box."""
    g = gray(img)
    element = ellipse(7)
    mask = dilate(erode((g > 35) & (g < 250), element, 2), element, 2)
    mask = erode(dilate(mask, element, 3), element, 3)
    labels = label(mask)
    areas = np.bincount(labels.ravel())[1:]
    large = [i + 1 for i in np.argsort(-areas, kind="stable").tolist() if areas[i] > g.size * share][:2]
    if not large:
        return crop_legacy_box(g)
    places = {i: np.nonzero(labels == i) for i in large}
    y, x = places[min(large, key=lambda i: places[i][1].mean())]
    bw, bh = int(x.max() - x.min()) + 1, int(y.max() - y.min()) + 1
    px, py = max(10, int(bw * 0.05)), max(10, int(bh * 0.05))
    return max(0, int(x.min()) - px), max(0, int(y.min()) - py), min(g.shape[1], int(x.min()) + bw + px), min(g.shape[0], int(y.min()) + bh + py)


def autocrop(img: np.ndarray) -> np.ndarray:
    x0, y0, x1, y1 = crop_box(img)
    return img[y0:y1, x0:x1]


@cache
def _pixel_values() -> np.ndarray:
    """The normalized value of each byte in each channel."""
    return (np.arange(256, dtype=np.float32)[None, :] / 255 - PIXEL_MEAN[:, None]) / PIXEL_STD[:, None]


@cache
def _gray_shares() -> np.ndarray:
    """The gray for each lightness, from 0 to 1."""
    return _gray_results()[:, 0].astype(np.float32) / 255


def tensor(img: np.ndarray, size: int = SIZE, out: np.ndarray | None = None) -> np.ndarray:
    """Channels first, float32, normalized; in out, if there is one."""
    out = np.empty((3, size, size), np.float32) if out is None else out
    if is_gray(img := to_rgb(img)):
        new = equalize(resize(img[..., :1], size, size)[..., 0], of=_lightness())
        places, room = np.empty((LINES, size), np.intp), np.empty((LINES, size), np.float32)
        for i in range(0, size, LINES):
            n = min(LINES, size - i)
            at, share = places[:n], room[:n]
            at[:] = new[i : i + n]
            np.take(_gray_shares(), at, out=share, mode="clip")
            for to, mean, std in zip(out[:, i : i + n], PIXEL_MEAN, PIXEL_STD, strict=True):
                np.subtract(share, mean, out=to)
                to /= std
    else:
        x = equalize_contrast(resize(img, size, size))
        for c in range(3):
            out[c] = _pixel_values()[c][x[..., c]]
    return out


def meta(male: int) -> np.ndarray:
    return np.array([float(male)], np.float32)


def augment(img: np.ndarray, seed: int | list[int]) -> np.ndarray:
    """Rotation, scale, brightness and contrast, noise and holes, each with its chance; seeded."""
    rng, (h, w, _) = np.random.default_rng(seed), img.shape
    turn = np.deg2rad(rng.uniform(-10, 10)) if rng.random() < 0.6 else 0.0
    scale = 1 + rng.uniform(-0.08, 0.08) if rng.random() < 0.5 else 1.0
    if turn or scale != 1:
        y, x = np.mgrid[:h, :w] - np.array([(h - 1) / 2, (w - 1) / 2])[:, None, None]
        sy = np.rint((np.cos(turn) * y - np.sin(turn) * x) / scale + (h - 1) / 2).astype(int)
        sx = np.rint((np.sin(turn) * y + np.cos(turn) * x) / scale + (w - 1) / 2).astype(int)
        inside = (sy >= 0) & (sy < h) & (sx >= 0) & (sx < w)
        img = np.where(inside[..., None], img[sy.clip(0, h - 1), sx.clip(0, w - 1)], 0).astype(np.uint8)
    out = img.astype(np.float64)
    if rng.random() < 0.5:
        out = out * (1 + rng.uniform(-0.15, 0.15)) + 255 * rng.uniform(-0.15, 0.15)
    if rng.random() < 0.2:
        out += rng.normal(0, np.sqrt(rng.uniform(5, 20)), out.shape)
    if rng.random() < 0.2:
        for _ in range(rng.integers(1, 5)):
            y, x = rng.integers(0, max(1, h - 20)), rng.integers(0, max(1, w - 20))
            out[y : y + 20, x : x + 20] = 0
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def decode(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def _results(images: DataFrame, kernel: Callable[[np.ndarray, int | None], tuple], schema: str) -> DataFrame:
    """id and what the kernel makes of each image and its id; nulls where it or the decoding fails."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for id_, *picture in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    out.append(kernel(to_rgb(decode(*picture)), id_))
                except Exception:  # noqa: BLE001
                    out.append((None,) * (len(names) - 1))
            cols = list(zip(*out, strict=True)) or [()] * (len(names) - 1)
            types = [pa.binary() if c.endswith("BINARY") else pa.int32() for c in schema.split(", ")[1:]]
            yield pa.record_batch([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names)

    return images.select("id", "height", "width", "channels", "data").mapInArrow(run, schema)


def _picture(img: np.ndarray) -> tuple[int, int, int, bytes]:
    img = img[:, :, None] if img.ndim == 2 else img
    return (*img.shape, img.tobytes())


def map_images(images: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """images (id, height, width, channels, data) with each image passed through a kernel; rows whose kernel fails keep a null image."""
    return _results(images, lambda img, _: _picture(kernel(img)), IMAGE)


def augment_images(images: DataFrame, seed: int) -> DataFrame:
    """Each image augmented by draws of its own, from the seed and its id (null: as id 0)."""
    return _results(images, lambda img, id_: _picture(augment(img, draw_seed(seed, id_))), IMAGE)


def draw_seed(seed: int, id_: int | None) -> list[int]:
    return [seed, (id_ or 0) % (1 << 64)]


def crop_boxes(images: DataFrame, box: Callable[[np.ndarray], tuple[int, int, int, int]] = crop_box) -> DataFrame:
    """id and the box of each image: x0, y0, x1, y1 (far edges exclusive); nulls for an image that fails."""
    return _results(images, lambda img, _: tuple(box(img)), "id BIGINT, x0 INT, y0 INT, x1 INT, y1 INT")
