"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams: hashed word unigrams and bigrams of a text, and n-grams of word shapes (letters and
digits by class, other characters as they are, runs collapsed) at levels of their share of the text. Each is scaled by
its class log-count ratio; a linear hinge-loss model is fit to the scaled indicators by dual coordinate descent, and a
sigmoid turns its margin into a score.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork.llm.common import Tables, add_by_text, release
from skeinwork.llm.near_dedup import word_hashes

#: Labelled rows that the model is fit on at most: those with the smallest hash of their id.
MAX_TRAIN_ROWS = 8000
#: Bytes of text of those rows at most: rows beyond it in that order are left out. Features take about as much.
MAX_TRAIN_BYTES = 128 << 20
#: Labelled rows with a longer text are not trained on.
MAX_TRAIN_TEXT = 1 << 20
HASH_BITS = 18
#: Shares of the text, as powers of a half, at which a shape n-gram makes another indicator.
LEVELS = 7
THRESHOLD = 0.3
#: Dimensions seen in fewer training documents are left out.
LEAST_DOCS = 5

_DIM = 1 << HASH_BITS
_CLASS = bytes(0x41 if 0x41 <= b <= 0x5A else 0x61 if 0x61 <= b <= 0x7A else 0x30 if 0x30 <= b <= 0x39 else b for b in range(256))
_HIGH = bytes(range(128, 256))


def shapes(raw: bytes) -> list[bytes]:
    """The shape of each word: letters and digits by class, runs of one character collapsed."""
    buf = np.frombuffer(raw.translate(_CLASS, _HIGH), dtype=np.uint8)
    return buf[np.flatnonzero(np.diff(buf.astype(np.int16), prepend=-1))].tobytes().split()


def _slots(name: bytes) -> tuple[int, ...]:
    """The dimensions of a shape n-gram, one per level."""
    return tuple(zlib.crc32(b"%s@%d" % (name, level)) % _DIM for level in range(LEVELS))


#: Names up to this length are kept with their dimensions.
_SHORT = 48
_known_slots = lru_cache(maxsize=1 << 15)(_slots)


def features(raw: bytes | None) -> np.ndarray:
    """Sorted distinct dimensions that a text has; none for an empty one."""
    raw = raw or b""
    words = raw.split()
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.int32)
    shaped = shapes(raw)
    counts: Counter[bytes] = Counter(shaped)
    for pair, k in Counter(zip(shaped, shaped[1:])).items():  # noqa: B905
        counts[b"%s %s" % pair] += k
    counts[b"=="] = sum(map(bytes.__eq__, words, words[1:]))
    named: list[int] = []
    for name, k in counts.items():
        level = (-(-n // k) - 1).bit_length() if k else LEVELS  # the least one with k << level >= n
        if level < LEVELS:
            named += (_known_slots if len(name) <= _SHORT else _slots)(name)[level:]
    hashed = word_hashes(raw)
    pairs = hashed[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashed[1:]
    wide = np.concatenate((hashed, pairs ^ (pairs >> np.uint64(29)))) & np.uint64(_DIM - 1)
    return np.unique(np.concatenate((np.asarray(named, dtype=np.int64), wide.astype(np.int64)))).astype(np.int32)


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """log of (smoothed share among class 1) over (among class 0), 0 for rare dimensions."""
    p, q = np.zeros(_DIM), np.zeros(_DIM)
    for dims, label in zip(rows, y, strict=True):
        (p if label > 0 else q)[dims] += 1
    n_p, n_q = max(1, int((y > 0).sum())), max(1, int((y <= 0).sum()))
    ratio = np.log((p + alpha) / (n_p + 2 * alpha)) - np.log((q + alpha) / (n_q + 2 * alpha))
    ratio[p + q < LEAST_DOCS] = 0
    return ratio


def dual_coordinate_descent(
    rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, c: float = 0.05, epochs: int = 20, seed: int = 1
) -> tuple[np.ndarray, float]:
    """Hinge-loss weights over indicators times ``scale``, and the bias; classes weigh the same in sum."""
    rows = [d[scale[d] != 0] for d in rows]
    values = [scale[d] / max(1.0, np.sqrt(len(d))) for d in rows]
    norms = np.array([float(v @ v) + 1.0 for v in values])
    share = np.where(y > 0, (y > 0).mean(), (y <= 0).mean())
    upper = c * 0.5 / share
    alpha, w, b = np.zeros(len(y)), np.zeros(_DIM), 0.0
    order = np.arange(len(y))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        moved = 0.0
        for i in order:
            dims, v = rows[i], values[i]
            g = y[i] * (float(w[dims] @ v) + b) - 1
            new = min(max(alpha[i] - g / norms[i], 0.0), upper[i])
            d = (new - alpha[i]) * y[i]
            if d:
                alpha[i] = new
                w[dims] += d * v
                b += d
                moved = max(moved, abs(d))
        if moved < 1e-4:
            break
    return w * scale, b


def _margins(rows: list[np.ndarray], scale: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
    out = []
    for d in rows:
        d = d[scale[d] != 0]
        out.append(float(w[d].sum()) / max(1.0, np.sqrt(len(d))) + b)
    return np.asarray(out)


def _sigmoid_fit(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit with smoothed targets, by Newton steps."""
    n_p, n_q = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (n_p + 1) / (n_p + 2), 1 / (n_q + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + c, -40, 40)))
        d, h = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([d @ margins + 1e-3 * a, d.sum()])
        m = np.array([[h @ margins**2 + 1e-3, h @ margins], [h @ margins, h.sum() + 1e-9]])
        step = np.linalg.solve(m, g)
        a, c = a - step[0], c - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-6)), float(c)


@dataclass
class Fitted:
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        x = self.slope * _margins(rows, self.scale, self.weights, self.bias) + self.offset
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[np.ndarray], labels: list[int]) -> Fitted:
    """Fits on three quarters of the rows and sets the sigmoid on the others. Without both classes: a constant score,
    the smoothed share of class 1 (0.5 without rows)."""
    y = np.where(np.asarray(labels, dtype=np.int64) > 0, 1, -1) if labels else np.empty(0, dtype=np.int64)
    n_p, n_q = int((y > 0).sum()), int((y < 0).sum())
    if n_p < 4 or n_q < 4:
        share = (n_p + 0.5) / (n_p + n_q + 1)
        return Fitted(np.zeros(_DIM, dtype=np.float32), np.zeros(_DIM, dtype=np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    held = np.zeros(len(y), dtype=bool)
    for label in (1, -1):
        held[np.flatnonzero(y == label)[::4]] = True
    own = [r for r, h in zip(rows, held, strict=True) if not h]
    scale = log_count_ratio(own, y[~held])
    w, b = dual_coordinate_descent(own, y[~held], scale)
    rest = [r for r, h in zip(rows, held, strict=True) if h]
    slope, offset = _sigmoid_fit(_margins(rest, scale, w, b), y[held])
    return Fitted(scale.astype(np.float32), w.astype(np.float32), b, slope, offset)


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text is a multiple of 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _training(texts: list[bytes | None]) -> list[list]:
    return [[features(x) for x in texts]]


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_TRAIN_ROWS, max_bytes: int = MAX_TRAIN_BYTES) -> Fitted:
    """Fits on at most ``max_rows`` labelled documents that are not held out, with ``max_bytes`` of text together.

    Of several labels of an id the larger one counts, null labels none; of several texts of an id each counts. The rows
    are those with the smallest hash of the id, so the sample doesn't follow the layout of the input.
    """
    some = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    some = some.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__y"))
    some = some.orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).join(F.broadcast(some), "__id")
    size = F.coalesce(F.octet_length("__text"), F.lit(0)).alias("__size")
    place = [F.xxhash64("__id"), F.col("__id"), F.xxhash64("__text")]
    with Tables(docs.sparkSession) as tables:
        rows = tables.written(rows.where(F.coalesce(F.octet_length("__text"), F.lit(0)) <= MAX_TRAIN_TEXT), "train-rows")
        sizes = [r["__size"] for r in rows.orderBy(*place).select(size).limit(max_rows).collect()]
        n = int((np.cumsum(sizes) <= max_bytes).sum()) if sizes else 0
        field = T.StructField("__dims", T.ArrayType(T.IntegerType()), False)
        chosen = rows.orderBy(*place).limit(n).withColumn("__h", F.xxhash64("__text"))
        found = add_by_text(chosen, "__text", lambda: _training, [field], keep=["__id", "__y", "__h"]).toArrow()
    found = found.sort_by([("__id", "ascending"), ("__h", "ascending")])
    model = fit([x.values.to_numpy() for x in found.column("__dims")], found.column("__y").to_pylist())
    del found
    release()
    return model


def _factory(model) -> Callable:
    fitted = model.value

    def compute(texts: list[bytes | None]) -> list[list]:
        return [fitted.scores([features(x) for x in texts]).tolist()]

    return compute


def classify(docs: DataFrame, model: Fitted, text_col: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """Adds ``score`` (0 to 1, higher: label 1 is likelier) and ``predicted`` (1 if it reaches ``threshold``).

    Only the text counts. Every text is read whole; a null or empty one gets the score of the bias alone. Repeated rows
    get equal results. Input columns with the name of a new one are replaced. The model is broadcast; its size is fixed.
    ``keep``: the input columns to return besides (all by default).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = add_by_text(docs, text_col, partial(_factory, shared), [T.StructField("score", T.DoubleType(), False)], keep=keep)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
