"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled 1; all else is unlabelled web text, its
labels unseen. The class prior of the unlabelled text is estimated first, as
the smallest ratio of unlabelled to positive mass above a score of a plain
positive-against-unlabelled classifier. Then the non-negative unbiased risk

    prior * R+(1) + max(0, R_u(0) - prior * R+(0))

(logistic loss) is minimised for a linear model over features of the whole
text: surface features with their squares and products, and hashed words (the
share of a text's words that fall to each of ``BUCKETS`` buckets).

Texts are read once and kept as ``WIDTH`` numbers each in the shared folder.
All rows that are not held out are the unlabelled text, in the scaling of
features, the class prior and the risk alike: with the logistic loss R+(1) -
R+(0) is linear in the weights, so Newton steps find the minimum, each of them
one pass in which tasks sum loss, gradient and curvature (see :func:`fit`).
Only trusted positives are bounded: about ``max_positive`` of them, chosen by
a hash of doc_id, reach the driver. Scores are the same whatever the
partitioning, but for the rounding of sums.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.llm.common import array_sum, batches_of, written

FEATURES = ("words", "letters", "capitals", "digits", "stops", "marks", "bars", "marked_words", "different", "most_common", "repeated_next", "line_copies", "word_length", "line_words", "sentence_words")
BUCKETS = 64
WIDTH = len(FEATURES) + BUCKETS
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256), 32, 10])
_CAPITALS, _DIGITS, _STOPS, _MARKS = bytes(range(65, 91)), b"0123456789", b".,;:?'\"()-", b"!#$%&*+/<=>@[\\]^_`{}~"


class Buckets(dict):
    """Bucket of a word (bytes; A-Z lowered, outer marks off), kept for up to ``room`` words."""

    def __init__(self, room: int = 200_000):
        super().__init__()
        self.room = room

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.room:
            self.clear()
        self[word] = bucket = crc32(word.lower().strip(_STOPS + _MARKS)) % BUCKETS
        return bucket


_buckets = Buckets()


def features(text: str | None) -> list[float]:
    """Features of a whole text, ``WIDTH`` numbers; all zero for a text without words."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * WIDTH
    n, size = len(words), len(raw)
    count = Counter(words)
    lines = [x for x in raw.split(b"\n") if x]

    def share(chars: bytes) -> float:
        return (size - len(raw.translate(None, chars))) / size

    marked = sum(k for w, k in count.items() if w[-1] in _MARKS or w[-1] == 124) / n
    once = {x: len(x) for x in lines}
    return [
        np.log1p(n),
        share(_LETTERS),
        share(_CAPITALS),
        share(_DIGITS),
        share(_STOPS),
        share(_MARKS),
        raw.count(b"|") / n,
        marked,
        len(count) / n,
        max(count.values()) / n,
        sum(map(eq, words, words[1:])) / n,
        1 - sum(once.values()) / max(1, sum(map(len, lines))),
        np.log(size / n),
        np.log1p(n / max(1, len(lines))),
        np.log1p(n / (1 + raw.count(b".") + raw.count(b"?"))),
        *np.sqrt(np.bincount(list(map(_buckets.__getitem__, count)), list(count.values()), BUCKETS) / n).tolist(),
    ]


def measured(docs: DataFrame) -> DataFrame:
    """Columns of ``docs`` but text, and ``x``: the features."""
    keep = [c for c in docs.columns if c != "text"]
    schema = docs.select(*keep, F.array(F.lit(0.0).cast("float")).alias("x")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([features(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), x], names=[*keep, "x"])

    return batches_of(docs, run, schema)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, WIDTH)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def linear(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        return np.hstack([np.ones((len(z), 1)), z])

    def design(self, x: np.ndarray) -> np.ndarray:
        z = self.linear(x)
        i, j = np.triu_indices(len(FEATURES))
        return np.hstack([z, (z[:, i + 1] * z[:, j + 1]) / 4])

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.design(x) @ self.weights)


def sums_of(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], ws: list[np.ndarray], halves: bool = False) -> list[tuple[float, float, np.ndarray, np.ndarray]]:
    """For each of ``ws``: count, mean loss log(1 + exp(z)), its gradient and curvature over the design rows of ``rows`` (x, half).

    With ``halves`` the k-th weights see the rows of half k alone.
    """
    d = len(ws[0])

    def part(batch: pa.RecordBatch) -> np.ndarray:
        x = of(_matrix(batch))
        half = np.asarray(batch.column("half").to_numpy(zero_copy_only=False)) if halves else None
        out = []
        for k, w in enumerate(ws):
            own = x[half == k] if halves else x
            z = own @ w
            s = _sigmoid(z)
            out += [[len(own), np.logaddexp(0, z).sum()], own.T @ s, (own.T @ (own * (s * (1 - s))[:, None])).ravel()]
        return np.concatenate(out)

    total = array_sum(rows, part, len(ws) * (2 + d + d * d)).reshape(len(ws), -1)
    return [(t[0], t[1] / max(1, t[0]), t[2 : 2 + d] / max(1, t[0]), t[2 + d :].reshape(d, d) / max(1, t[0])) for t in total]


def half_models(p: np.ndarray, rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], passes: int = 12) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(weights, scores, positives) of two linear positive-against-unlabelled classifiers, each fitted on half of the rows (x, half).

    ``scores`` are those that 40 % or more of the other half's positives
    reach, ``positives`` the shares that do. So no row is judged by what it
    taught.
    """
    own = [p[k::2] for k in (0, 1)]
    ws = [np.zeros(p.shape[1]) for _ in own]
    for _ in range(passes):
        steps = []
        for a, w, (_, _, g, h) in zip(own, ws, sums_of(rows, of, ws, True), strict=True):
            s = _sigmoid(-a @ w)
            g = g - a.T @ s / max(1, len(a)) + 0.02 * w
            h = h + a.T @ (a * (s * (1 - s))[:, None]) / max(1, len(a)) + 0.02 * np.eye(len(w))
            steps.append(np.linalg.solve(h, -g))
        ws = [w + s * min(1, 2 / max(1e-9, np.abs(s).max())) for w, s in zip(ws, steps, strict=True)]
        if max(np.abs(s).max() for s in steps) < 1e-4:
            break
    out = []
    for k, w in enumerate(ws):
        positive = p[1 - k :: 2] @ w
        if len(positive):
            at = np.quantile(positive, np.linspace(0, 0.6, 25))
            out.append((w, at, (positive[:, None] >= at).mean(axis=0)))
    return out


def class_prior(halves: list[tuple[np.ndarray, np.ndarray, np.ndarray]], above: list[np.ndarray]) -> float:
    """Smallest ratio of unlabelled to positive mass above a score, ``above`` being the unlabelled shares, one array a half."""
    ratios = [(u / positives).min() for (_, _, positives), u in zip(halves, above, strict=True)]
    return float(np.clip(np.mean(ratios), 0.05, 0.99)) if ratios else 0.5


def shares_above(rows: DataFrame, model: Model, halves: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Of all ``rows`` (half, x) the shares that reach each score of the other half's model; counted in tasks, summed on Spark."""
    sizes = [1 + len(at) for _, at, _ in halves]

    def part(batch: pa.RecordBatch) -> np.ndarray:
        half, x = np.asarray(batch.column("half").to_numpy(zero_copy_only=False)), model.linear(_matrix(batch))
        own = [x[half == 1 - k] @ w for k, (w, _, _) in enumerate(halves)]
        return np.concatenate([[z.size, *(z[:, None] >= at).sum(axis=0)] for z, (_, at, _) in zip(own, halves, strict=True)]).astype("float64")

    counts = np.split(array_sum(rows, part, sum(sizes)), np.cumsum(sizes)[:-1]) if halves else []
    return [c[1:] / max(1, c[0]) for c in counts]


def pu_risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The two parts of the unbiased risk (prior * R+(1); R_u(0) - prior * R+(0)) and their gradients."""
    pw, uw = p @ w, u @ w
    positive = prior * np.logaddexp(0, -pw).mean()
    negative = np.logaddexp(0, uw).mean() - prior * np.logaddexp(0, pw).mean()
    return positive, negative, -prior * (p.T @ _sigmoid(-pw)) / len(p), u.T @ _sigmoid(uw) / len(u) - prior * (p.T @ _sigmoid(pw)) / len(p)


def blank_model() -> Model:
    """Scores 0.5 throughout."""
    return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(1 + WIDTH + len(FEATURES) * (len(FEATURES) + 1) // 2), 0.5)


def fit(model: Model, p: np.ndarray, rows: DataFrame, decay: float = 5e-4, search: int = 4) -> Model:
    """Minimise the non-negative risk on design rows ``p`` and all of ``rows`` (x), the prior being the model's.

    At its least the bracket R_u(0) - prior * R+(0) is zero, or above and then
    counts in full. For a weight v of the bracket between 0 and 1,

        (1 - v) * prior * R+(1) - v * prior * mean(z+) + v * R_u(0)

    is convex, and the bracket at its minimum falls as v rises: the largest v
    that leaves it at zero or above is sought, each minimum starting from the
    last. Nobody but the tasks sees rows.
    """
    own, prior, mean, d = 1 + len(FEATURES), model.prior, p.mean(axis=0), p.shape[1]
    few = np.r_[np.zeros(own), np.full(BUCKETS, 20.0), np.ones(d - own - BUCKETS)]  # few rows: hardly any words or products
    decay = decay + few / len(p)

    def minimum(v: float, w: np.ndarray, seen: tuple | None) -> tuple[np.ndarray, tuple]:
        """The minimum for ``v`` from ``w``, and the sums there."""
        for _ in range(20):
            _, _, g, h = seen = seen or sums_of(rows, model.design, [w])[0]
            s = _sigmoid(-p @ w)
            down = (1 - v) * prior * (p.T @ s) / len(p) + v * prior * mean - v * g - decay * w
            bend = (1 - v) * prior * (p.T @ (p * (s * (1 - s))[:, None])) / len(p) + v * h + np.diag(decay) + 1e-9 * np.eye(d)
            step = np.linalg.solve(bend, down)
            if np.abs(step).max() < 1e-2:
                break
            w, seen = w + step * min(1.0, 4 / np.abs(step).max()), None
        return w, seen or sums_of(rows, model.design, [w])[0]

    def bracket(w: np.ndarray, seen: tuple) -> float:
        return seen[1] - prior * np.logaddexp(0, p @ w).mean()

    low, high = 0.0, 1.0
    v, (w, seen) = 0.01, minimum(0.01, np.zeros(d), None)
    best = w
    while bracket(w, seen) >= 0 and v < 1:
        low, best, v = v, w, min(1.0, 4 * v)
        w, seen = minimum(v, w, seen)
    if bracket(w, seen) >= 0:
        low, best, search = v, w, 0
    high = v
    for _ in range(search):
        v = (low * high) ** 0.5 if low else high / 4
        w, seen = minimum(v, w, seen)
        if bracket(w, seen) >= 0:
            low, best = v, w
        else:
            high = v
    model.weights = best
    return model


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def _part(total: int, most: int) -> Column:
    """A hash choice of about ``most`` of ``total`` rows; all if there are no more."""
    return F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int(min(1.0, most / max(1, total)) * (1 << 30))


def train(rows: DataFrame, labels: DataFrame, max_positive: int = 20_000) -> Model:
    """Fit on ``rows`` (doc_id, x; a table) and ``labels`` (doc_id, quality), both outside the held-out rows.

    A document labelled both 0 and 1 is not trusted. Null ids and labels are ignored.
    """
    trusted = labels.filter(~held_out() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).filter("low = 1 and high = 1").select("doc_id")
    trusted = trusted.filter(_part(trusted.count(), max_positive))
    rest = rows.filter(~held_out() & F.col("doc_id").isNotNull())
    found = rest.select("doc_id", "x").join(F.broadcast(trusted), "doc_id").collect()  # about max_positive rows
    p = np.array([r.x for r in sorted(found, key=lambda r: (r.doc_id, r.x))], "float64").reshape(-1, WIDTH)
    if not len(p):
        return blank_model()
    n, *sums = np.split(array_sum(rest.select("x"), lambda b: np.concatenate([[b.num_rows], _matrix(b).sum(axis=0), np.square(_matrix(b)).sum(axis=0)]), 1 + 2 * WIDTH), [1, 1 + WIDTH])
    mean = sums[0] / n
    model = Model(mean, np.sqrt(np.maximum(0, sums[1] / n - mean * mean)) + 1e-6, np.empty(0), 0.5)
    halved = rest.select("x", F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(2)).cast("int").alias("half"))
    halves = half_models(model.linear(p), halved, model.linear)
    model.prior = class_prior(halves, shares_above(halved, model, halves))
    return fit(model, model.design(p), rest.select("x"))


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """Columns of ``rows`` with ``score`` in place of ``x``."""
    keep = [c for c in rows.columns if c != "x"]
    schema = rows.select(*keep, F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(model.score(_matrix(batch)))], names=[*keep, "score"])

    return batches_of(rows, run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """Return doc_id, held_out, score and predicted for every row of ``docs``.

    Null text is empty; texts without words share one score; texts may be of
    any length. Rows that repeat a doc_id are scored each; a null doc_id is
    never held out. An empty table gives an empty result; without trusted
    positives all scores are 0.5. Further columns, of whatever names, are
    ignored.
    """
    rows = written(measured(docs.select("doc_id", "text")))
    out = scored(rows, train(rows, labels, **options))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns; see :func:`quality_scores`."""
    model = train(written(measured(docs.select("doc_id", "text"))), labels, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            score = model.score(np.array([features(t) for t in texts], "float32").astype("float64").reshape(-1, WIDTH))
            yield batch.filter(pa.array(score >= threshold))

    return batches_of(docs, run, docs.schema)
