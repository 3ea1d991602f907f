"""Pinyin by dynamic programming against the search it replaces, and the image hash both ways."""

import random
import time

import numpy as np
import pytest

from galena.functions import media
from galena.operators import fuzzy


def plain_pinyin(name, query, sounds):
    """All ways, one after another."""
    best = None
    for start in range(len(name)):
        todo = [(start, query)]
        while todo:
            at, rest = todo.pop()
            if not rest:
                found = (start, at - 1 - start, at - 1)
                best = found if best is None or found < best else best
                continue
            if at >= len(name):
                continue
            for sound in sounds.get(name[at], [name[at].lower()]):
                todo += [(at + 1, rest[len(cut) :]) for cut in {sound, sound[:1]} if cut and rest.startswith(cut)]
                if at > start and len(rest) < len(sound) and sound.startswith(rest):
                    todo.append((at + 1, ""))
    return best


def test_pinyin_against_all_ways():
    rng = random.Random(6)
    sounds = {"甲": ["jia", "ji"], "乙": ["yi"], "丙": ["bing", "b"], "丁": ["ding", "zheng"], "戊": ["wu", "a"]}
    for _ in range(4000):
        name = "".join(rng.choice("甲乙丙丁戊aj") for _ in range(rng.randrange(7)))
        query = "".join(rng.choice(["j", "ia", "i", "y", "bing", "b", "d", "zh", "a", "wu"]) for _ in range(rng.randrange(1, 5)))
        assert fuzzy.best_pinyin(name, query, sounds) == plain_pinyin(name, query, sounds), (name, query)


def test_pinyin_takes_time_in_proportion():
    sounds = {"甲": ["aa", "aaa", "aaaa", "aaaaa"]}
    began = time.process_time()
    assert fuzzy.best_pinyin("甲" * 2000, "a" * 60 + "b", sounds) is None
    assert time.process_time() - began < 5


def test_initials():
    table = fuzzy.initial_sounds()
    assert len(table) == 3755
    assert "".join(table[c][0] for c in "网页设计文档管理图片素材视频教程中国") == "wysjwdgltpscspjczg"


@pytest.mark.parametrize("w, h, alpha", [(40, 30, False), (30, 40, True), (16, 16, False), (7, 90, False), (90, 7, True)])
def test_hash_both_ways(w, h, alpha):
    y, x = np.mgrid[0:h, 0:w] / max(w, h)
    a = np.where((x - 0.4) ** 2 + (y - 0.3) ** 2 < 0.1, 255, 90) if alpha else np.full((h, w), 255)
    rgba = np.stack([200 * x + 30, 220 - 150 * y, 120 + 60 * x * y, a], axis=-1).astype("uint8")
    width, height, data = media.thumb_hash_pixels(media.thumb_hash(w, h, rgba.tobytes()))
    assert max(width, height) == 32 and len(data) == width * height * 4
    got = np.frombuffer(data, "uint8").reshape(height, width, 4).astype(float)
    rows, columns = ((np.arange(n) + 0.5) * m / n for n, m in ((height, h), (width, w)))
    own = rgba[rows.astype(int)][:, columns.astype(int)].astype(float)
    solid = own[..., 3] == 255
    assert np.abs(got - own)[solid][:, :3].mean() < (25 if alpha else 12)
    assert np.abs(got[..., 3] - own[..., 3]).mean() < 40


def loop_decode(data):
    """The published format, pixel by pixel."""
    from math import cos, floor, pi

    head, more = int.from_bytes(data[:3], "little"), int.from_bytes(data[3:5], "little")
    alpha, wide = head >> 23, more >> 15
    n = 5 if alpha else 7
    lx, ly = (max(3, n), max(3, more & 7)) if wide else (max(3, more & 7), max(3, n))
    ratio = n / (more & 7) if wide else (more & 7) / n
    w, h = (floor(v + 0.5) for v in ((32, 32 / ratio) if ratio > 1 else (32 * ratio, 32)))
    nibbles = [d for x in data[6 if alpha else 5 :] for d in (x & 15, x >> 4)] + [0] * 99
    out = []
    for y in range(h):
        for x in range(w):
            k, values = 0, []
            channels = [(lx, ly, (head & 63) / 63, (head >> 18 & 31) / 31), (3, 3, (head >> 6 & 63) / 31.5 - 1, (more >> 3 & 63) / 63 * 1.25), (3, 3, (head >> 12 & 63) / 31.5 - 1, (more >> 9 & 63) / 63 * 1.25)]
            channels += [(5, 5, (data[5] & 15) / 15, (data[5] >> 4) / 15)] if alpha else []
            for nx, ny, v, scale in channels:
                for j in range(ny):
                    i = 0 if j else 1
                    while i * ny < nx * (ny - j):
                        v += (nibbles[k] / 7.5 - 1) * scale * cos(pi / w * (x + 0.5) * i) * cos(pi / h * (y + 0.5) * j) * 2
                        k, i = k + 1, i + 1
                values.append(v)
            light, p, q = values[:3]
            b = light - 2 / 3 * p
            r = (3 * light - b + q) / 2
            out += [max(0, 255 * min(1, c)) for c in (r, r - q, b, values[3] if alpha else 1)]
    return w, h, out


@pytest.mark.parametrize("seed", range(4))
def test_decode_against_a_loop(seed):
    rng = np.random.default_rng(seed)
    w, h = rng.integers(5, 60, 2)
    rgba = rng.integers(0, 256, (h, w, 4)).astype("uint8")
    rgba[..., 3] = 255 if seed % 2 else rgba[..., 3]
    data = media.thumb_hash(int(w), int(h), rgba.tobytes())
    width, height, pixels = media.thumb_hash_pixels(data)
    want = loop_decode(data)
    assert (width, height) == want[:2] and np.abs(np.frombuffer(pixels, "uint8") - np.array(want[2])).max() <= 1.0001
    assert media.thumb_hash_pixels(b"") is None and media.thumb_hash_pixels(bytes(5)) is None
