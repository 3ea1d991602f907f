"""Functions of pixels and vectors that need numpy; Arrow-batched pandas UDFs.

Pixels come in as decoded arrays, since no image codec is at hand: bytes are
row-major RGB or RGBA.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


ROOM = 1 << 20  # distances of pixels to centers that are held at once


def _clusters(x: np.ndarray, clusters: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Centers and shares of k-means in each of the images ``x`` (image, pixel, 3), the first pixels being the seeds."""
    n, pixels, k = len(x), x.shape[1], min(clusters, x.shape[1])
    centers = x[:, :k].copy()

    def nearest(rows: np.ndarray) -> np.ndarray:
        """Center of each pixel, the first of equal ones, numbered through all of ``rows``."""
        apart = sum((x[rows, :, None, c] - centers[rows, None, :, c]) ** 2 for c in range(3))
        return (apart.argmin(axis=2) + np.arange(len(rows))[:, None] * k).ravel()

    live = np.arange(n)
    for _ in range(rounds):
        own = nearest(live)
        count = np.bincount(own, minlength=len(live) * k).reshape(-1, k, 1)
        sums = np.stack([np.bincount(own, x[live, :, c].ravel(), len(live) * k) for c in range(3)], axis=1).reshape(-1, k, 3)
        moved = np.where(count > 0, sums / np.maximum(count, 1), centers[live])
        shift = np.sqrt(((moved - centers[live]) ** 2).sum(axis=2))
        centers[live] = moved
        live = live[(shift > 1).any(axis=1)]
        if not len(live):
            break
    return centers, np.bincount(nearest(np.arange(n)), minlength=n * k).reshape(n, k) / pixels * 100


def _merged(centers: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Colors and shares of each image, the largest first (-1: none); a color that is near a larger one counts to it."""
    n, k = share.shape
    colors, every = np.floor(centers + 0.5), np.arange(n)
    order = np.argsort(-share, axis=1, kind="stable")
    kept, total, used = np.zeros((n, k, 3)), np.full((n, k), -1.0), np.zeros(n, np.int64)
    for place in range(k):
        color, part = colors[every, order[:, place]], share[every, order[:, place]]
        near = (np.sqrt(((kept - color[:, None]) ** 2).sum(axis=2)) < 30) & (total >= 0)
        to, there = near.argmax(axis=1), near.any(axis=1)
        old, new = np.flatnonzero(there & (part > 0)), np.flatnonzero(~there & (part > 0))
        total[old, to[old]] += part[old]
        kept[new, used[new]], total[new, used[new]] = color[new], part[new]
        used[new] += 1
    order = np.argsort(-total, axis=1, kind="stable")
    return np.take_along_axis(kept, order[:, :, None], axis=1), np.take_along_axis(total, order, axis=1)


def palettes_of(images: list[bytes | None], clusters: int = 7, rounds: int = 20) -> list[list[tuple[str, float]] | None]:
    """(color, percentage) of images of RGB bytes by k-means; those of one size are taken together."""
    out: list[list | None] = [None if b is None else [] for b in images]
    sizes: dict[int, list[int]] = {}
    for at, b in enumerate(images):
        if b:
            sizes.setdefault(len(b), []).append(at)
    for size, all_ in sizes.items():
        step = max(1, ROOM // (max(1, size // 3) * clusters))
        for first in range(0, len(all_), step):
            own = all_[first : first + step]
            x = np.frombuffer(b"".join(images[at] for at in own), np.uint8).reshape(len(own), -1, 3).astype(float)
            colors, total = _merged(*_clusters(x, clusters, rounds))
            code = np.clip(colors, 0, 255).astype(int) @ np.array([65536, 256, 1])
            for at, c, t in zip(own, code.tolist(), total.tolist(), strict=True):
                out[at] = [(f"#{v:06X}", round(p, 2)) for v, p in zip(c, t, strict=True) if p >= 0]
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("color", T.StringType()), T.StructField("percentage", T.DoubleType())])))
def palette(rgb: pd.Series) -> pd.Series:
    """Palette of an image given as RGB bytes (scaled to 50 x 50 at most before)."""
    return pd.Series([None if p is None else [{"color": c, "percentage": s} for c, s in p] for p in palettes_of(rgb.tolist())])


def visual_hash(width: Column, height: Column, rgb: Column) -> Column:
    """SHA-256 of width and height as little-endian 32-bit integers, then the RGB bytes."""

    def little(n: Column) -> Column:
        big = F.lpad(F.hex(n.cast("int")), 8, "0")
        return F.unhex(F.concat(*(F.substring(big, k, 2) for k in (7, 5, 3, 1))))

    return F.sha2(F.concat(little(width), little(height), rgb), 256)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vector(blob: pd.Series, dimensions: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats; null unless the length is that of ``dimensions``."""
    return pd.Series([None if b is None or d is None or len(b) != 4 * d else np.frombuffer(b, "<f4").tolist() for b, d in zip(blob, dimensions, strict=True)])


@F.pandas_udf(T.BinaryType())
def encode_vector(vector: pd.Series) -> pd.Series:
    return vector.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_half(blob: pd.Series) -> pd.Series:
    """Little-endian 16-bit floats widened."""
    return blob.map(lambda b: None if b is None else np.frombuffer(b, "<f2").astype("f4").tolist())


def _channel(pixels: np.ndarray, across: int, down: int) -> tuple[float, np.ndarray, float]:
    """Mean, coefficients (row by row, triangle kept) scaled to 0..1, and their scale."""
    h, w = pixels.shape
    fx = np.cos(np.pi / w * np.outer(np.arange(across), np.arange(w) + 0.5))
    fy = np.cos(np.pi / h * np.outer(np.arange(down), np.arange(h) + 0.5))
    all_ = fy @ pixels @ fx.T / (w * h)
    kept = np.array([all_[y, x] for y in range(down) for x in range(across) if (x or y) and x * down < across * (down - y)])
    scale = float(np.abs(kept).max()) if len(kept) else 0.0
    return float(all_[0, 0]), 0.5 + 0.5 / scale * kept if scale else kept, scale


def thumb_hash(width: int, height: int, rgba: bytes) -> bytes:
    """ThumbHash of an image of at most 100 x 100: the published format, computed as matrix products."""
    px = np.frombuffer(rgba, np.uint8).reshape(height, width, 4).astype(float) / 255
    alpha = px[..., 3]
    total = alpha.sum()
    mean = (px[..., :3] * alpha[..., None]).sum(axis=(0, 1)) / total if total else np.zeros(3)
    has_alpha = total < width * height
    limit, longest = (5 if has_alpha else 7), max(width, height)
    lx, ly = (max(1, int(np.floor(limit * n / longest + 0.5))) for n in (width, height))
    r, g, b = np.moveaxis(mean * (1 - alpha[..., None]) + px[..., :3] * alpha[..., None], -1, 0)
    l_dc, l_ac, l_scale = _channel((r + g + b) / 3, max(3, lx), max(3, ly))
    p_dc, p_ac, p_scale = _channel((r + g) / 2 - b, 3, 3)
    q_dc, q_ac, q_scale = _channel(r - g, 3, 3)
    half = lambda v: int(np.floor(v + 0.5))
    wide = width > height
    head = half(63 * l_dc) | half(31.5 + 31.5 * p_dc) << 6 | half(31.5 + 31.5 * q_dc) << 12 | half(31 * l_scale) << 18 | int(has_alpha) << 23
    more = (ly if wide else lx) | half(63 * p_scale) << 3 | half(63 * q_scale) << 9 | int(wide) << 15
    out = bytearray([*head.to_bytes(3, "little"), *more.to_bytes(2, "little")])
    groups = [l_ac, p_ac, q_ac]
    if has_alpha:
        a_dc, a_ac, a_scale = _channel(alpha, 5, 5)
        out.append(half(15 * a_dc) | half(15 * a_scale) << 4)
        groups.append(a_ac)
    digits = [half(15 * f) for ac in groups for f in ac]
    digits += [0] * (len(digits) % 2)
    return bytes(out) + bytes(lo | hi << 4 for lo, hi in zip(digits[::2], digits[1::2], strict=True))


@F.pandas_udf(T.StringType())
def thumb_hash_text(width: pd.Series, height: pd.Series, rgba: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else base64.b64encode(thumb_hash(int(w), int(h), b)).decode() for w, h, b in zip(width, height, rgba, strict=True)])


def thumb_hash_pixels(data: bytes) -> tuple[int, int, bytes] | None:
    """(width, height, RGBA) that a ThumbHash stands for, 32 along its longer side; null for what is no hash.

    Coefficients are unpacked into a triangle of a matrix for each channel and
    brought back by an inverse cosine transform, one product along each axis.
    Entries past the end count as zero.
    """
    if len(data) < 5:
        return None
    head, more = int.from_bytes(data[:3], "little"), int.from_bytes(data[3:5], "little")
    has_alpha, wide, own = head >> 23, more >> 15, more & 7
    limit = 5 if has_alpha else 7
    if not own:
        return None
    ratio = limit / own if wide else own / limit
    width, height = (int(np.floor(v + 0.5)) for v in ((32, 32 / ratio) if ratio > 1 else (32 * ratio, 32)))
    digits = iter([d for x in data[6 if has_alpha else 5 :] for d in (x & 15, x >> 4)])

    def channel(across: int, down: int, mean: float, scale: float) -> np.ndarray:
        c = np.zeros((down, across))
        for y in range(down):
            for x in range(across):
                if (x or y) and x * down < across * (down - y):
                    c[y, x] = 2 * (next(digits, 0) / 7.5 - 1) * scale
        c[0, 0] = mean
        fx = np.cos(np.pi / width * np.outer(np.arange(across), np.arange(width) + 0.5))
        fy = np.cos(np.pi / height * np.outer(np.arange(down), np.arange(height) + 0.5))
        return fy.T @ c @ fx

    light = channel(max(3, limit if wide else own), max(3, own if wide else limit), (head & 63) / 63, (head >> 18 & 31) / 31)
    p = channel(3, 3, (head >> 6 & 63) / 31.5 - 1, (more >> 3 & 63) / 63 * 1.25)
    q = channel(3, 3, (head >> 12 & 63) / 31.5 - 1, (more >> 9 & 63) / 63 * 1.25)
    first = data[5] if len(data) > 5 else 0
    alpha = channel(5, 5, (first & 15) / 15, (first >> 4) / 15) if has_alpha else np.ones((height, width))
    b = light - 2 / 3 * p
    r = (3 * light - b + q) / 2
    return width, height, np.floor(255 * np.clip(np.stack([r, r - q, b, alpha], axis=-1), 0, 1)).astype("uint8").tobytes()


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("rgba", T.BinaryType())]))
def thumb_hash_image(text: pd.Series) -> pd.DataFrame:
    """Struct width, height and RGBA bytes of a ThumbHash in base 64; nulls for what is none."""

    def one(t: str | None) -> tuple:
        try:
            found = None if t is None else thumb_hash_pixels(base64.b64decode(t, validate=True))
        except ValueError:
            found = None
        return found or (None, None, None)

    return pd.DataFrame([one(t) for t in text], columns=["width", "height", "rgba"])


def thumb_hash_ratio(text: Column) -> Column:
    """Width by height as a ThumbHash has it."""
    raw = F.hex(F.unbase64(text))
    byte = [F.conv(F.substring(raw, 2 * k + 1, 2), 16, 10).cast("int") for k in range(5)]
    limit = F.when(byte[2] >= 128, 5).otherwise(7)
    wide, own = byte[4] >= 128, byte[3].bitwiseAND(F.lit(7))
    return F.when(wide, limit / own).otherwise(own / limit).cast("double")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def word_pieces(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ids of text (first column) by greedy longest match over a vocabulary (second: one token a line)."""
    for text, vocabulary in texts:
        cache: dict[str, dict[str, int]] = {}
        out = []
        for t, v in zip(text, vocabulary, strict=True):
            if v not in cache:
                cache[v] = {x: k for k, x in enumerate(v.split("\n"))}
            out.append(encode_pieces(t or "", cache[v]))
        yield pd.Series(out)


def basic_tokens(text: str) -> list[str]:
    """NFKC, lower case, CJK characters and punctuation apart."""
    import unicodedata

    out, word = [], ""
    for c in unicodedata.normalize("NFKC", text).lower():
        kind = unicodedata.category(c)
        alone = "㐀" <= c <= "鿿" or "豈" <= c <= "﫿" or "\U00020000" <= c <= "\U0002fa1f" or kind[0] == "P" or (c.isascii() and kind[0] == "S")
        if c.isspace() or kind in ("Cc", "Cf") or alone:
            out += [word] * bool(word) + [c] * alone
            word = ""
        else:
            word += c
    return out + [word] * bool(word)


def encode_pieces(text: str, vocabulary: dict[str, int], context: int = 52) -> list[int]:
    """[CLS] pieces [SEP], cut to ``context`` and padded."""
    ids = []
    for word in basic_tokens(text):
        at, own = 0, []
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocabulary), None)
            if end is None:
                own = [vocabulary["[UNK]"]]
                break
            own.append(vocabulary[("##" if at else "") + word[at:end]])
            at = end
        ids += own
    ids = [vocabulary["[CLS]"], *ids[: context - 2], vocabulary["[SEP]"]]
    return ids + [vocabulary["[PAD]"]] * (context - len(ids))
