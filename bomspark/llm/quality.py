"""Quality classifier: naive Bayes support vectors.

n-gram indicators are scaled by the log ratio of their class counts, and a
linear model with hinge loss is fitted on them by dual coordinate descent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import _WORD, Spans, byte_views, mix, raw, runs

#: Hashed feature space; fixes the size of the model.
N_FEATURES = 1 << 17
#: Labelled rows the model is fitted on, the first by hash of doc_id. All rows are scored.
MAX_TRAIN_ROWS = 12_000
MIN_ROWS = 3
THRESHOLD = 0.7

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_UPPER, _LOWER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = True
_LOWER[97:123] = True
_DIGIT[48:58] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature), each pair once: words, word pairs, runs of marks, and
    shape triples, in which a word is only its casing and whether it repeats
    the one before."""
    flat = data | ((_UPPER[data]).astype(np.uint8) << 5)
    word = _WORD[data]
    ws, we, wr = runs(word, offsets)
    ps, pe, pr = runs(~word & ~_SPACE[data], offsets)
    start, end, row = np.r_[ws, ps], np.r_[we, pe], np.r_[wr, pr]
    kind = np.r_[np.zeros(len(ws), bool), np.ones(len(ps), bool)]
    order = np.argsort(start, kind="stable")
    start, end, row, kind = start[order], end[order], row[order], kind[order]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = Spans(flat).hash(start, end)
    count = lambda table: np.diff(np.r_[0, np.cumsum(table[data])][np.c_[start, end]], axis=1)[:, 0]
    up, low, digit = count(_UPPER), count(_LOWER), count(_DIGIT)
    shape = np.where(digit > 0, 1, np.where(up == 0, 2, np.where(low == 0, 3, 4))).astype(np.uint64)
    # a word of one letter is upper case as well as capitalised
    shape = np.where((shape == 3) & (end - start < 2), np.uint64(4), shape)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1]) & ~kind[1:]
    shape = np.where(kind, h, mix(shape + np.where(again, np.uint64(8), np.uint64(0))))
    glued = np.zeros(len(h), np.uint64)
    glued[1:] = (start[1:] == end[:-1]) & (row[1:] == row[:-1])
    shape = mix(shape + glued)
    rows, feats = [row, row], [mix(h + np.uint64(1)), mix(shape + np.uint64(2))]
    for size, of, salt in ((2, h, 3), (2, shape, 4), (3, shape, 5)):
        if len(h) >= size:
            at = np.flatnonzero(row[: len(row) - size + 1] == row[size - 1 :])
            x = np.full(len(at), salt, np.uint64)
            for k in range(size):
                x = mix(x + of[at + k])
            rows.append(row[at])
            feats.append(x)
    key = np.unique(np.concatenate(rows) * N_FEATURES + (np.concatenate(feats) % np.uint64(N_FEATURES)).astype(np.int64))
    return key // N_FEATURES, key % N_FEATURES


def _features_of(batches):
    for batch in batches:
        got = []
        for lo, hi, data, offsets in byte_views(batch.column("body")):
            row, feat = features(data, offsets)
            ends = np.searchsorted(row, np.arange(hi - lo + 1))
            got += [feat[a:b].astype(np.int32).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(got, pa.binary())], names=["doc_id", "y", "feats"])


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """log of the smoothed share of a feature in class 1 over that in class 0; 0 for features of fewer than MIN_ROWS rows."""
    pos, neg = np.zeros(N_FEATURES), np.zeros(N_FEATURES)
    for x, label in zip(rows, y, strict=True):
        (pos if label > 0 else neg)[x] += 1
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    return np.where(pos + neg >= MIN_ROWS, np.log((pos + 1) / (n1 + 2)) - np.log((neg + 1) / (n0 + 2)), 0.0)


def dual_descent(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, c: float = 1.0, passes: int = 15) -> tuple[np.ndarray, float]:
    """Weights (times r) and bias of the L1-loss support vector machine, by
    dual coordinate descent over rows in a seeded random order."""
    w, bias = np.zeros(N_FEATURES), 0.0
    alpha = np.zeros(len(rows))
    values = [r[x] / max(1.0, len(x)) ** 0.5 for x in rows]
    norm = np.array([v @ v + 1 for v in values])
    rng = np.random.default_rng(7)
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            gradient = y[i] * (w[x] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), c)
            step = (new - alpha[i]) * y[i]
            if step:
                w[x] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4 * c:
            break
    return w * r, bias


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through the margins (Newton steps on smoothed targets)."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - t) * margin).sum(), (p - t).sum()]) + 1e-3 * np.array([a, 0])
        q = p * (1 - p)
        hess = np.array([[(q * margin**2).sum() + 1e-3, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-9]])
        step = np.linalg.solve(hess + 1e-9 * np.eye(2), g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a), 1e-6), float(b)


def _fit(batches):
    rows, y, ids = [], [], []
    for batch in batches:
        ids += batch.column("doc_id").to_pylist()
        y += batch.column("y").to_pylist()
        rows += [np.frombuffer(x, np.int32) for x in batch.column("feats").to_pylist()]
    y = np.where(np.array(y, float) > 0, 1.0, -1.0)
    order = np.argsort(np.array(ids, np.int64))  # the same model however the rows arrive
    rows, y = [rows[i] for i in order], y[order]
    weights, curve = np.zeros(N_FEATURES), (1.0, 0.0, 0.0)
    if len(rows) and abs(y.sum()) < len(y):
        r = log_count_ratio(rows, y)
        weights, bias = dual_descent(rows, y, r)
        margin = np.array([weights[x].sum() / max(1.0, len(x)) ** 0.5 for x in rows]) + bias
        curve = (*calibrate(margin, y), bias)
    elif len(rows):
        curve = (1.0, float(y[0]) * 3, 0.0)
    at = np.flatnonzero(weights)
    yield pa.RecordBatch.from_pydict({"at": [at.astype(np.int32).tobytes()], "weight": [weights[at].tobytes()], "curve": [list(curve)]})


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> tuple[np.ndarray, tuple[float, float, float]]:
    """Fit on the documents of at most ``max_rows`` labelled rows whose
    crc32(doc_id as text) mod 4 is not 2. A document labelled twice counts with
    its lower label; null labels and ids take no part. Without rows of both
    classes every score is the same."""
    known = labels.where("quality is not null and doc_id is not null").where(~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.min(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # bounded by max_rows: 16 bytes a row
    rows = docs.select("doc_id", raw().alias("body")).join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"])
    rows = rows.select("doc_id", "y", "body").mapInArrow(_features_of, "doc_id long, y int, feats binary")
    got = rows.coalesce(1).mapInArrow(_fit, "at binary, weight binary, curve array<double>").first()
    weights = np.zeros(N_FEATURES)
    weights[np.frombuffer(got["at"], np.int32)] = np.frombuffer(got["weight"])
    return weights, tuple(got["curve"])


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def scorer(model: tuple[np.ndarray, tuple[float, float, float]]):
    """Column function text -> score of a fitted model."""
    weights, (a, b, bias) = model

    @F.arrow_udf("double")
    def score(body: pa.Array) -> pa.Array:
        out = []
        for lo, hi, data, offsets in byte_views(body):
            row, feat = features(data, offsets)
            n = np.maximum(1, np.bincount(row, minlength=hi - lo))
            margin = np.bincount(row, weights=weights[feat], minlength=hi - lo) / n**0.5 + bias
            out.append(1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30))))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return lambda text="text": score(raw(text))


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Null and empty texts have no n-gram and get the model's base score; rows
    that repeat get the same score; other columns are ignored; empty tables
    give no rows."""
    score = scorer(fit(docs, labels, max_rows))
    out = docs.select("doc_id", held_out("doc_id").alias("held_out"), score().alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with the same columns."""
    score = scorer(fit(docs, labels, max_rows))
    return docs.where(score() >= THRESHOLD)
