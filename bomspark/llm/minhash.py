"""Near duplicates by ProbMinHash.

The distinct shingles of a document are weighted by 1 + ln(occurrences). Each
shingle is a Poisson process of that rate; an arrival falls on one of the
registers, a register keeps its first arrival, and a process ends once its next
arrival is later than every register. Two documents agree on a register with
the probability Jaccard of their weighted shingles. With equal weights that is
the Jaccard of the sets, however often each repeats its shingles; documents
that repeat some have a second signature of that kind. Registers are banded,
documents that share a band are compared by the exact Jaccard of their shingle
sets, and classes are the connected components of the pairs that pass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, byte_views, components, mix, raw, shingles, unused, words

SHINGLE = 5
SIMILARITY = 0.8
#: At similarity 0.8 a pair misses every band of equal weights with probability (1 - 0.8**6)**32 = 6e-5.
BANDS, BAND_ROWS = 32, 6

#: Pairs that are verified together.
PAIRS_PER_DEAL = 2_000

_U = np.uint64


def weighted_shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles: row, hash, weight, in order of (row, hash)."""
    h, row, _, _ = words(data, offsets)
    sh, at = shingles(h, row, len(offsets) - 1, size)
    order = np.lexsort((sh, at))
    sh, at = sh[order], at[order]
    first = np.ones(len(sh), bool)
    first[1:] = (sh[1:] != sh[:-1]) | (at[1:] != at[:-1])
    start = np.flatnonzero(first)
    count = np.diff(np.r_[start, len(sh)])
    return at[start], sh[start], 1 + np.log(count)


def registers(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """For each row and register, the element that arrives first; 0 in rows without elements."""
    first = np.full(n_rows * m, np.inf)
    winner = np.zeros(n_rows * m, _U)
    live, clock, turn = np.arange(len(row)), np.zeros(len(row)), 0
    while len(live):
        # a few arrivals at once when few processes are left
        for _ in range(max(1, min(16, 20_000 // len(live)))):
            bits = mix(element[live] + _U((turn + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            u = ((bits >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53
            clock[live] -= np.log(u) / weight[live]
            slot = row[live] * m + (mix(bits) % _U(m)).astype(np.int64)
            np.minimum.at(first, slot, clock[live])
            won = first[slot] == clock[live]
            winner[slot[won]] = element[live[won]]
            turn += 1
        last = first.reshape(n_rows, m).max(1)
        live = live[clock[live] < last[row[live]]]
    return winner.reshape(n_rows, m)


def band_keys(sig: np.ndarray, bands: int, band_rows: int) -> np.ndarray:
    """One key per row and band; bands differ, so do their keys."""
    sig = sig.reshape(len(sig), bands, band_rows)
    key = np.arange(1, bands + 1, dtype=_U) + np.zeros((len(sig), 1), _U)
    for k in range(band_rows):
        key = mix(key + sig[:, :, k])
    return key.view(np.int64)


def signature_rows(batches, size: int, bands: int, band_rows: int):
    """doc_id, two hashes of the shingle set, its size, and the keys of its bands:
    those of equal weights, and those of the weights where they aren't equal."""
    for batch in batches:
        h1, h2, sizes, keys, held = [], [], [], [], []
        for lo, hi, data, offsets in byte_views(batch.column("body")):
            n, m = hi - lo, bands * band_rows
            row, sh, weight = weighted_shingles(data, offsets, size)
            ends = np.searchsorted(row, np.arange(n + 1))
            total = lambda x: np.diff(np.r_[_U(0), np.cumsum(x, dtype=_U)][ends]).view(np.int64)
            h1.append(total(mix(sh)))
            h2.append(total(mix(sh ^ _U(0x5851F42D4C957F2D))))
            sizes.append(np.diff(ends))
            both = np.full((n, 2, bands), 0, np.int64)
            both[:, 0] = band_keys(registers(row, sh, np.ones(len(row)), n, m), bands, band_rows)
            both[:, 1] = both[:, 0]
            # without repetition the two signatures are one
            uneven = np.unique(row[weight > 1])
            own = np.isin(row, uneven)
            if len(uneven):
                both[uneven, 1] = band_keys(registers(np.searchsorted(uneven, row[own]), sh[own], weight[own], len(uneven), m), bands, band_rows)
            new = np.ones((n, 2, bands), bool)
            new[:, 1] = both[:, 1] != both[:, 0]
            keys.append(both[new])
            held.append(new.sum((1, 2)))
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(cat(held))].astype(np.int32)), pa.array(cat(keys)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cat(h1)), pa.array(cat(h2)), pa.array(cat(sizes)), lists], names=["doc_id", "h1", "h2", "n", "keys"])


def set_rows(batches, size: int):
    for batch in batches:
        out = []
        for lo, hi, data, offsets in byte_views(batch.column("body")):
            row, sh, _ = weighted_shingles(data, offsets, size)
            ends = np.searchsorted(row, np.arange(hi - lo + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(sh.view(np.int64)))
            out.append(lists)
        got = pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("node"), got], names=["node", "shingles"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, similar) for each pair; the shingle sets decide.

    Pairs are dealt by b, about PAIRS_PER_DEAL to a deal, and a set goes once to
    each deal that needs it, however many of its pairs are there."""
    cut = Scratch(pairs.sparkSession, "pairs").cut
    pairs = cut(pairs.select("a", "b"))
    deals = max(1, -(-pairs.count() // PAIRS_PER_DEAL))
    pairs = pairs.withColumn("deal", F.pmod(F.xxhash64("b", F.pmod("a", F.lit(8))), F.lit(deals)))
    needed = pairs.select("deal", F.col("a").alias("node")).union(pairs.select("deal", F.col("b").alias("node"))).distinct()
    sent = needed.join(sets, "node").select(F.col("deal").alias("to"), "node", "shingles")

    def judge(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        # kept in the order of unsigned hashes; a repeated id has several sets
        held: dict[int, list[np.ndarray]] = {}
        for n, x in zip(right.node.tolist(), right.shingles, strict=True):
            held.setdefault(n, []).append(x.view(_U))

        def alike(x: np.ndarray, y: np.ndarray) -> bool:
            if len(x) > len(y):
                x, y = y, x
            common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            return common >= similarity * (len(x) + len(y) - common)

        out = [any(alike(x, y) for x in held[a] for y in held[b]) for a, b in zip(left.a.tolist(), left.b.tolist(), strict=True)]
        return left[["a", "b"]].assign(similar=out)

    return pairs.groupBy("deal").cogroup(sent.groupBy("to")).applyInPandas(judge, "a long, b long, similar boolean")


def can_be_similar(similarity: float) -> Column:
    """Whether sets of na and nb shingles, ua and ub of them in no other set,
    can reach ``similarity``: they share at most what neither has alone."""
    most = F.least(F.col("na") - F.col("ua"), F.col("nb") - F.col("ub"))
    return most >= F.lit(similarity) * (F.col("na") + F.col("nb") - most)


def classes(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """doc_id and class_id (the smallest doc_id of the class) for every row.

    Words are compared in lower case. A text of fewer than ``size`` words is
    one shingle; null texts and texts without words link to nothing. A null
    doc_id is a class of its own. Rows that repeat a doc_id count as one
    document (all their texts link to it). Empty tables give no rows; other
    columns are ignored.

    Documents of one shingle set are one representative before banding. Each
    representative is first compared with the smallest one of its buckets.
    Buckets that still hold several components compare all with one head, the
    set with the fewest shingles that no other has; what is left is compared
    pair by pair across components, unless the shingles that a set has alone
    rule it out. So no link is lost to the star shape."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw(lower=True).alias("body"))
    cut = Scratch(docs.sparkSession, "near-duplicates").cut
    sig = cut(rows.mapInArrow(lambda b: signature_rows(b, size, bands, band_rows), "doc_id long, h1 long, h2 long, n long, keys array<long>"))
    own = sig.where("n > 0 and doc_id is not null")
    same = own.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"))
    heads = own.join(same, "h1 h2".split()).where("doc_id = node").select("node", "n", "keys").dropDuplicates(["node", "n"])
    bucketed = heads.select("node", "n", F.explode("keys").alias("key"))
    shared = bucketed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")
    bucketed = cut(bucketed.join(shared, "key").distinct())
    wanted = bucketed.select("node").distinct()
    sets = rows.join(wanted.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "body")
    sets = cut(sets.mapInArrow(lambda b: set_rows(b, size), "node long, shingles array<long>"))
    repeated = own.where("doc_id is not null").select("doc_id", "h1", "h2").join(same, ["h1", "h2"]).where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))

    everyone = bucketed.select("node").distinct()

    def merged(links: DataFrame) -> DataFrame:
        part = components(links)
        return cut(everyone.join(part, "node", "left").select("node", F.coalesce("root", "node").alias("root")))

    # one partner each, the smallest of all buckets
    low = bucketed.groupBy("key").agg(F.min("node").alias("a"))
    pairs = bucketed.join(low, "key").where("a <> node").groupBy("node").agg(F.min("a").alias("a")).select("a", F.col("node").alias("b"))
    judged = cut(verified(pairs, sets, similarity))
    links, done = judged.where("similar").select("a", "b"), judged.select("a", "b")
    root = merged(links)
    mixed, alone = None, None
    for heads_only in (True, False):
        at = bucketed.join(root, "node")
        spread = at.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
        mixed = at.join(spread, "key")
        if alone is None:
            # how many shingles of a set are in no other set of these buckets
            left = mixed.select("node").distinct()
            single = sets.join(left, "node", "left_semi").select("node", F.explode("shingles").alias("s"))
            single = single.groupBy("s").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1")
            several_sets = sets.groupBy("node").agg(F.count("*").alias("sets")).where("sets > 1")
            alone = left.join(single.groupBy("node").agg(F.count("*").alias("u")), "node", "left").join(several_sets, "node", "left")
            alone = cut(alone.select("node", F.when(F.col("sets").isNull(), F.coalesce("u", F.lit(0))).otherwise(0).alias("u")))
        one = mixed.join(alone, "node").where(F.col("n") - F.col("u") >= similarity * F.col("n"))
        one = one.join(heads.select("node", "keys"), "node")
        one = one.select("key", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("u").alias("ua"), F.col("keys").alias("ka"))
        two = one.toDF("key", "b", "rb", "nb", "ub", "kb")
        if heads_only:
            # the head of a bucket is the set with the fewest shingles of its own, so it is near the most others
            head = one.groupBy("key").agg(F.min(F.struct("ua", "a", "ra", "na")).alias("h")).select("key", "h.*")
            pairs = head.join(two, "key").where("a <> b")
        else:
            # a pair is formed in the first bucket that it shares
            pairs = one.join(two, "key").where("a < b").where(F.get(F.array_intersect("ka", "kb"), F.lit(0)) == F.col("key"))
        pairs = pairs.where(F.col("ra") != F.col("rb")).where(can_be_similar(similarity))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(done, ["a", "b"], "left_anti")
        judged = cut(verified(pairs, sets, similarity))
        links, done = links.union(judged.where("similar").select("a", "b")), done.union(judged.select("a", "b"))
        root = merged(links)
    # documents of one set hang on its representative, repeated ids on all theirs
    named = own.groupBy("doc_id").agg(F.count_distinct("h1", "h2").alias("k")).where("k > 1").select("doc_id")
    several = repeated.join(named, repeated.a == named.doc_id, "left_semi")
    if several.limit(1).count():
        part = components(root.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(several))
        root = part
    whole = same.join(root, "node", "left").select("h1", "h2", F.coalesce("root", "node").alias("root"))
    out = sig.select("doc_id", "h1", "h2").join(whole, ["h1", "h2"], "left").select("doc_id", F.coalesce("root", "doc_id").alias("class_id"))
    return out


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are the smallest doc_id of their class, same
    columns; of rows that repeat a doc_id one stays."""
    name = unused(docs, "_kept")
    first = classes(docs, **options).where("doc_id = class_id or doc_id is null").select(F.col("doc_id").alias(name)).distinct()
    held = docs.join(first, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")
    repeats = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id").limit(1).count()
    return held.where("doc_id is not null").dropDuplicates(["doc_id"]).union(held.where("doc_id is null")) if repeats else held
