"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are TF-IDF passages, with document frequencies counted over the
whole corpus. A randomised SVD of them, computed by Spark jobs, gives the latent
space. Every window of every document is projected into it and searched for
items by cosine; what comes close is compared with the item by the longest
common subsequence of words, and in a grey zone by the item's answer (its last
sentence) too, so that paraphrases are found and shared function words are not.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import byte_views, raw, unused, words

#: Items searched in one pass over the documents. More items take more passes.
#: A block's space has as many dimensions as items unless told otherwise: with
#: fewer, an item can lie outside the space and is not found.
ITEMS_PER_BLOCK = 256
OVERSAMPLE, POWER_STEPS = 16, 2
#: A window has twice STRIDE words and starts every STRIDE words.
STRIDE = 16
COSINE = 0.35
#: Share of an item's words in the common subsequence: enough alone; enough if the answer is there as well.
SURE, LIKELY, ANSWER = 0.6, 0.55, 0.75
MIN_WORDS = 5
#: Words in a larger share of the documents don't enter the space, unless they are among an item's FEW rarest ones.
MAX_DF, FEW = 0.01, 6


def item_words(text: str | None) -> tuple[np.ndarray, int]:
    """Word hashes of an item and the index at which its answer starts: the
    last sentence or line, or the last quarter of a single sentence."""
    body = (text or "").lower()
    data = np.frombuffer(body.encode(), np.uint8)
    h, _, start, _ = words(data, np.array([0, len(data)]))
    cut_at = [len(body[: m.end()].encode()) for m in re.finditer(r"[.!?\n]+", body.rstrip(" .!?\n"))]
    answer = int(np.searchsorted(start, cut_at[-1])) if cut_at else len(h)
    if answer >= len(h):
        answer = len(h) - max(1, len(h) // 4)
    return h, answer


def common_length(masks: dict[int, int], m: int, sequence: list[int]) -> int:
    """Longest common subsequence with an item of m words given as bit masks of its words."""
    full = (1 << m) - 1
    v = full
    for w in sequence:
        u = v & masks.get(w, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


def masks_of(h: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(h.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


class Vocabulary:
    """Word hash -> index, -1 for unknown words."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.seen = np.zeros(1 << 20, bool)
        self.seen[known >> np.uint64(44)] = True

    def index(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1)
        at = np.flatnonzero(self.seen[h >> np.uint64(44)])
        k = np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)
        out[at] = np.where(self.known[k] == h[at], k, -1)
        return out


def document_frequency(docs: DataFrame, known: np.ndarray) -> tuple[np.ndarray, int]:
    """Documents that hold each known word, and documents, over all rows."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(known))
    size = len(known)

    def count(batches):
        vocab = vocabulary.value
        total, n = np.zeros(size, np.int64), 0
        for batch in batches:
            for lo, hi, data, offsets in byte_views(batch.column("body")):
                h, row, _, _ = words(data, offsets)
                k = vocab.index(h)
                pair = np.unique(row[k >= 0] * size + k[k >= 0])
                total += np.bincount(pair % size, minlength=size)
                n += hi - lo
        yield pa.RecordBatch.from_pydict({"word": np.r_[np.arange(size), size], "n": np.r_[total, n]})

    got = docs.select(raw(lower=True).alias("body")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size + 1, np.int64)
    for word, n in got:  # one row a word of the block's items
        out[word] = n
    return out[:size], int(out[size])


def randomised_svd(rows: DataFrame, n_features: int, rank: int, oversample: int = OVERSAMPLE, steps: int = POWER_STEPS) -> np.ndarray:
    """Right singular vectors (n_features x rank) of the sparse matrix whose
    rows are (idx array<int>, val array<double>). Each step is one Spark job
    that multiplies its rows with the present basis and sums the products by
    feature; only n_features x (rank + oversample) numbers reach the driver."""
    sc = rows.sparkSession.sparkContext
    width = min(rank + oversample, n_features)
    basis = np.random.default_rng(11).standard_normal((n_features, width))

    def product(share):
        def run(batches):
            q, out = share.value, {}
            for batch in batches:
                for idx, val in zip(batch.column("idx").to_pylist(), batch.column("val").to_pylist(), strict=True):
                    y = np.asarray(val) @ q[idx]
                    for i, x in zip(idx, val, strict=True):
                        out[i] = out.get(i, 0) + x * y
            yield pa.RecordBatch.from_pydict({"feature": pa.array(list(out), pa.int64()), "v": pa.array([x.tobytes() for x in out.values()], pa.binary())})

        return run

    def add(key, pdf: pd.DataFrame) -> pd.DataFrame:
        total: dict[int, np.ndarray] = {}
        for f, v in zip(pdf.feature, pdf.v, strict=True):
            total[f] = total.get(f, 0) + np.frombuffer(v)
        return pd.DataFrame({"feature": list(total), "v": [x.tobytes() for x in total.values()]})

    for _ in range(steps + 1):
        basis, _ = np.linalg.qr(basis)
        share = sc.broadcast(basis)
        parts = rows.mapInArrow(product(share), "feature long, v binary")
        got = parts.withColumn("g", F.col("feature") % 16).groupBy("g").applyInPandas(add, "feature long, v binary").collect()
        last, basis = basis, np.zeros_like(basis)
        for f, v in got:
            basis[f] = np.frombuffer(v)
    # last' (A'A) last is small and symmetric; its eigenvectors turn the basis into singular vectors
    values, turn = np.linalg.eigh(last.T @ basis)
    return (last @ turn[:, ::-1])[:, :rank]


def _space(spark: SparkSession, docs: DataFrame, items: list[tuple[int, np.ndarray, int]], rank: int | None):
    """Vocabulary, idf-weighted projection of its words, unit vectors of the items."""
    known = np.unique(np.concatenate([h for _, h, _ in items]))
    df, n = document_frequency(docs, known)
    idf = np.log((n + 1) / (df + 1)) + 1e-3
    vocab = Vocabulary(known)
    stays = df <= MAX_DF * max(n, 50)
    for _, h, _ in items:
        k = np.unique(vocab.index(h))
        stays[k[np.argsort(df[k], kind="stable")[:FEW]]] = True
    known, idf = known[stays], idf[stays]
    vocab = Vocabulary(known)
    rows = []
    for _, h, _ in items:
        k = vocab.index(h)
        k, tf = np.unique(k[k >= 0], return_counts=True)
        val = tf * idf[k]
        rows.append((k.tolist(), (val / np.linalg.norm(val)).tolist()))
    matrix = spark.createDataFrame(rows, "idx array<int>, val array<double>").repartition(8)
    v = randomised_svd(matrix, len(known), min(rank or len(items), len(items)))
    projection = (idf[:, None] * v).astype(np.float32)
    vectors = np.array([np.asarray(val) @ v[idx] for idx, val in rows], np.float32)
    return vocab, projection, vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def windows(k: np.ndarray, row: np.ndarray, n_rows: int, projection: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Latent unit vectors of all windows with a known word: row, first word within the row, vector."""
    n = np.bincount(row, minlength=n_rows)
    first = np.r_[0, np.cumsum(n)]
    blocks = -(-n // STRIDE) + 1  # one more than needed keeps rows apart
    base = np.r_[0, np.cumsum(blocks)]
    block = base[row] + (np.arange(len(row)) - first[row]) // STRIDE
    at = np.flatnonzero(k >= 0)
    if not len(at):
        return np.zeros(0, int), np.zeros(0, int), np.zeros((0, projection.shape[1]), np.float32)
    inside = block[at]
    start = np.flatnonzero(np.r_[True, inside[1:] != inside[:-1]])
    used = inside[start]
    total = np.add.reduceat(projection[k[at]], start, axis=0)
    # a window is its own block and the next; blocks without known words add nothing
    place = np.full(base[-1] + 2, -1)
    place[used] = np.arange(len(used))
    flag = place >= 0
    both = np.flatnonzero(flag[:-1] | flag[1:])
    own = np.searchsorted(base, both, "right") - 1
    whole = (own < n_rows) & (both - base[own] < blocks[np.minimum(own, n_rows - 1)] - 1)
    both, own = both[whole], own[whole]
    out = np.zeros((len(both), projection.shape[1]), np.float32)
    for shift in (0, 1):
        p = place[both + shift]
        out[p >= 0] += total[p[p >= 0]]
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return own, (both - base[own]) * STRIDE, out


def _compare(text: list[int], starts: list[int], m: int, masks: dict[int, int], count: Counter, m_answer: int, answer_masks: dict[int, int]) -> tuple[float, float]:
    """Best (lcs, answer) of an item over the windows of a text at ``starts``,
    each widened by the item's length; 0 below LIKELY. A subsequence is no
    longer than the item's words that occur at all, so most runs of windows are
    left without computing one."""
    top = (0.0, 0.0)
    lo = 0
    for hi in range(1, len(starts) + 1):
        if hi < len(starts) and starts[hi] - starts[hi - 1] <= 4 * STRIDE:
            continue
        run, lo = starts[lo:hi], hi
        there = count.keys() & set(text[max(0, run[0] - m) : run[-1] + 2 * STRIDE + m])
        if sum(count[w] for w in there) < LIKELY * m:
            continue
        for at in run:
            part = text[max(0, at - m) : at + 2 * STRIDE + m]
            lcs = common_length(masks, m, part) / m
            if lcs >= LIKELY:
                top = max(top, (lcs, common_length(answer_masks, m_answer, part) / m_answer))
    return top


def _search(docs: DataFrame, items, space, cosine: float) -> DataFrame:
    """(doc_id, item_id, lcs, answer, contaminated) of every document and item that come close."""
    vocab, projection, vectors = space
    share = docs.sparkSession.sparkContext.broadcast(
        (vocab, projection, vectors, [(i, len(h), masks_of(h), Counter(h.tolist()), len(h) - a, masks_of(h[a:])) for i, h, a in items])
    )

    def run(batches):
        vocab, projection, vectors, items = share.value
        for batch in batches:
            found = []
            for lo, hi, data, offsets in byte_views(batch.column("body")):
                h, row, _, _ = words(data, offsets)
                k = vocab.index(h)
                first = np.searchsorted(row, np.arange(hi - lo + 1))
                own, start, vec = windows(k, row, hi - lo, projection)
                near: dict[tuple[int, int], list[int]] = {}
                for s in range(0, len(vec), 20_000):
                    w, i = np.nonzero(vec[s : s + 20_000] @ vectors.T >= cosine)
                    for r, at, item in zip(own[w + s].tolist(), start[w + s].tolist(), i.tolist(), strict=True):
                        near.setdefault((r, item), []).append(at)
                h = h.tolist() if near else h
                for (r, item), starts in near.items():
                    top = _compare(h[first[r] : first[r + 1]], starts, *items[item][1:])
                    if top[0]:
                        found.append((lo + r, items[item][0], *top))
            ids = batch.column("doc_id").take(pa.array([x[0] for x in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([x[1] for x in found], pa.int64()), *(pa.array([x[j] for x in found], pa.float64()) for j in (2, 3))], names=["doc_id", "item_id", "lcs", "answer"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw(lower=True).alias("body"))
    return rows.mapInArrow(run, "doc_id long, item_id long, lcs double, answer double")


def matches(docs: DataFrame, benchmark: DataFrame, rank: int | None = None, cosine: float = COSINE) -> DataFrame:
    """(doc_id, item_id, lcs, answer) for every document that holds an item:
    lcs at least SURE, or at least LIKELY with an ANSWER share of the answer.

    Items of fewer than MIN_WORDS words (null and empty ones too) and texts
    without words match nothing; equal items match each; a null doc_id can
    match. Empty tables give no rows; other columns are ignored. Items are
    searched in blocks of about ITEMS_PER_BLOCK, each with a space of its own."""
    spark = docs.sparkSession
    total = benchmark.count()
    blocks = max(1, -(-total // ITEMS_PER_BLOCK))
    out = None
    for b in range(blocks):
        # a block's items are the query set of one pass
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).select("item_id", "text").collect()
        items = [(i, *item_words(t)) for i, t in sorted(part, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))]
        items = [x for x in items if len(x[1]) >= MIN_WORDS]
        if not items:
            continue
        found = _search(docs, items, _space(spark, docs, items, rank), cosine)
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long, lcs double, answer double")
    return out.where((F.col("lcs") >= SURE) | (F.col("lcs") >= LIKELY) & (F.col("answer") >= ANSWER))


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, item_ids, the best
    item and its lcs. Rows that repeat a doc_id share one verdict."""
    hit = matches(docs, benchmark, **options).groupBy("doc_id").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max(F.struct("lcs", (-F.col("item_id")).alias("i"))).alias("top")
    )  # the list is bounded by the block's items
    hit = hit.select(F.col("doc_id").alias("_id"), "item_ids", (-F.col("top.i")).alias("item_id"), F.col("top.lcs").alias("lcs"))
    out = docs.select("doc_id").join(hit, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), "item_ids", "item_id", "lcs")


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, same columns."""
    name = unused(docs, "_bad")
    bad = matches(docs, benchmark, **options).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")
