"""Images as model inputs: resized, cut into patches, with interpolated position tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patch counts that models are exported with.
BUCKETS = (128, 256, 576, 784, 1024)
EPS, MOST_SCALE = 1e-5, 100.0
#: What a batch of patches may take.
BATCH_BYTES = 1 << 23


def patch_bucket(width: Column, height: Column, patch: int = 16, most: int = 256) -> Column:
    """The smallest bucket, up to ``most``, that holds an image's whole patches; ``most`` if none does."""
    raw = F.floor(width / patch) * F.floor(height / patch)
    out = F.lit(most)
    for b in sorted({*(b for b in BUCKETS if b <= most), most}, reverse=True):
        out = F.when(raw <= b, F.lit(b)).otherwise(out)
    return out


def patch_size(width: Column, height: Column, buckets: Column, patch: int = 16) -> Column:
    """Struct width, height of the largest scale at which an image's patches fit, to whole patches, by binary search."""

    def sized(scale: Column, size: Column) -> Column:
        return F.greatest(F.lit(patch).cast("long"), F.ceil(size * scale / patch) * patch)

    def step(s: Column, _: Column) -> Column:
        middle = (s["low"] + s["high"]) / 2
        fits = (sized(middle, height) / patch) * (sized(middle, width) / patch) <= buckets
        done = s["high"] - s["low"] < EPS
        return F.when(done, s).otherwise(F.struct(F.when(fits, middle).otherwise(s["low"]).alias("low"), F.when(fits, s["high"]).otherwise(middle).alias("high")))

    steps = ceil(np.log2(MOST_SCALE / EPS)) + 1
    start = F.struct(F.lit(EPS / 10).alias("low"), F.lit(MOST_SCALE).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: F.struct(sized(s["low"], width).alias("width"), sized(s["low"], height).alias("height")))


def interpolation(inputs: int, outputs: int) -> np.ndarray:
    """Rows of weights: linear between the two inputs next to each output's centre, held at the ends."""
    at = np.clip((np.arange(outputs) + 0.5) * inputs / outputs - 0.5, 0, inputs - 1)
    low = np.floor(at).astype(int)
    out = np.zeros((outputs, inputs))
    np.add.at(out, (np.arange(outputs), low), 1 - (at - low))
    np.add.at(out, (np.arange(outputs), np.minimum(low + 1, inputs - 1)), at - low)
    return out


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """``image`` (h, w, channels) to another size: one product along each axis."""
    down = np.tensordot(interpolation(image.shape[0], height), image.astype("float64"), (1, 0))
    return np.tensordot(interpolation(image.shape[1], width), down, (1, 1)).swapaxes(0, 1)


def whole(image: np.ndarray) -> np.ndarray:
    """Values as bytes hold them."""
    return np.floor(np.clip(image, 0, 255) + 0.5)


def clip_tensor(image: np.ndarray, size: int, mean: list[float], std: list[float], crop: bool = False) -> np.ndarray:
    """(3, size, size): an image stretched, or scaled to cover and cut at its centre, and normalised by channel."""
    h, w = image.shape[:2]
    if crop:
        scale = max(size / h, size / w)
        own = max(size, round(h * scale)), max(size, round(w * scale))
        y, x = (own[0] - size) // 2, (own[1] - size) // 2
        image = resized(image, *own)[y : y + size, x : x + size]
    else:
        image = resized(image, size, size)
    return ((whole(image) / 255 - np.array(mean)) / np.array(std)).transpose(2, 0, 1).astype("float32")


def patches(image: np.ndarray, height: int, width: int, patch: int, most: int) -> np.ndarray:
    """(most, patch * patch * 3): an image at ``height`` and ``width`` in patches, row by row, from -1 to 1; zeros past the last."""
    image = whole(resized(image, height, width)) / 127.5 - 1
    own = image.reshape(height // patch, patch, width // patch, patch, 3).swapaxes(1, 2).reshape(-1, patch * patch * 3)
    return np.vstack([own, np.zeros((most - len(own), own.shape[1]))]).astype("float32")


def position_table(base: np.ndarray, height: int, width: int, most: int) -> np.ndarray:
    """(most, channels): a grid of positions (h, w, channels) at another size; past its end its first row again."""
    own = resized(base, height, width).reshape(height * width, -1)
    return np.vstack([own, np.repeat(own[:1], most - len(own), axis=0)]).astype("float32")


def patch_batches(patch: int, most: int) -> Callable[[Iterator[tuple[pd.Series, ...]]], Iterator[pd.Series]]:
    """The patches of batches of (width, height, RGB bytes, room, width and height to cut at), in batches of about ``BATCH_BYTES``."""
    step = max(1, BATCH_BYTES // (4 * most * patch * patch * 3))

    def cut(frames: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for frame in frames:
            for at in range(0, len(frame[0]), step):
                yield pd.Series([
                    patches(np.frombuffer(d, "uint8").reshape(int(b), int(a), 3), int(y), int(x), patch, int(n)).ravel() if d is not None and a > 0 and b > 0 and len(d) == 3 * int(a) * int(b) else None
                    for a, b, d, n, x, y in zip(*(c.iloc[at : at + step] for c in frame), strict=True)
                ])

    return cut


def image_patches(width: Column, height: Column, rgb: Column, patch: int = 16, most: int = 256) -> Column:
    """Struct patches (flat), mask, max_patches, grid_height and grid_width of an image in RGB bytes; null where the bytes do not fit its size.

    Patches come in batches of about ``BATCH_BYTES``, however many images come in one.
    """
    buckets = patch_bucket(width, height, patch, most)
    target = patch_size(width, height, buckets, patch)
    cut = F.pandas_udf(patch_batches(patch, most), "array<float>")
    grid = target["height"] / patch, target["width"] / patch
    # the search for the size is done once for a row, not for each place
    mask = F.transform(F.array(grid[0] * grid[1]), lambda n: F.transform(F.sequence(F.lit(1), buckets), lambda k: (k <= n).cast("int")))[0]
    made = cut(width, height, rgb, buckets, target["width"], target["height"])
    return F.struct(made.alias("patches"), mask.alias("mask"), buckets.alias("max_patches"), grid[0].cast("int").alias("grid_height"), grid[1].cast("int").alias("grid_width"))

