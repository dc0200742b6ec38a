"""Helpers shared by the corpus operators: reading tables, Arrow binary columns
as byte arrays, vectorised word hashes, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bomspark.session import scratch_path, shuffles_removed

#: Bytes of text that one round of array work takes; a longer document is taken alone.
PART_BYTES = 1 << 20
_MULT, _INV = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(text: str | Column = "text", lower: bool = False) -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    text = F.coalesce(text, F.lit(""))
    return (F.lower(text) if lower else text).cast("binary")


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def byte_views(column: pa.Array, limit: int = PART_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of a binary column: (first row, end row, bytes, offsets of
    the rows in them and the end), each of about ``limit`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA5CB9243F1C9A6B3)
    return x ^ (x >> np.uint64(32))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64))


class Spans:
    """64-bit hashes of any byte spans of ``data`` from one pass over it."""

    powers = inverse = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(Spans.powers) < n:
            Spans.powers = np.cumprod(np.r_[np.uint64(1), np.full(n, _MULT)])
            Spans.inverse = np.cumprod(np.r_[np.uint64(1), np.full(n, _INV)])
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_BYTES[data] * Spans.powers[: n - 1], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * Spans.inverse[start] + (end - start).astype(np.uint64))


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def runs(flag: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of set flags that do not cross rows: start, end, row."""
    edge = np.zeros(len(flag) + 1, bool)
    edge[offsets] = True
    before = np.r_[False, flag[:-1]] if len(flag) else flag
    start = np.flatnonzero(flag & (~before | edge[:-1]))
    after = np.r_[flag[1:], False] if len(flag) else flag
    end = np.flatnonzero(flag & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words are maximal runs of ASCII letters, digits and non-ASCII bytes:
    hash, row, start and end of each."""
    start, end, row = runs(_WORD[data], offsets)
    return Spans(data).hash(start, end), row, start, end


def shingles(hashes: np.ndarray, row: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``size`` words; a row with fewer words has
    one shingle of all its words, a row without words none."""
    n = np.bincount(row, minlength=n_rows)
    first = np.r_[0, np.cumsum(n)]
    out, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(hashes) >= size:
        whole = np.flatnonzero(row[: len(row) - size + 1] == row[size - 1 :])
        out = np.zeros(len(whole), np.uint64)
        for k in range(size):
            out = mix(out + hashes[whole + k])
        at = row[whole]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        last = np.zeros(len(short), np.uint64)
        for k in range(size):
            has = n[short] > k
            last[has] = mix(last[has] + hashes[first[short[has]] + k])
        out, at = np.r_[out, last], np.r_[at, short]
    return out, at


class Scratch:
    """Tables of one job in a folder that all executors share. A written table
    has a known size, so Spark's own threshold decides whether a join sends it
    to all tasks; ``drop`` deletes one that no later step reads."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.folder, self.made = spark, scratch_path(spark, label), 0

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        with shuffles_removed(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def cut(self, df: DataFrame) -> DataFrame:
        self.made += 1
        return self.put(df, f"cut-{self.made}")

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(conf).delete(path, True)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b); root is
    the smallest node of its component. Alternates stars over larger and over
    smaller neighbours, so each round about halves the distance to the root.
    Each round's edges are a written table: a small one is read by few tasks."""
    scratch = Scratch(edges.sparkSession, "components")
    e = scratch.put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "0")
    seen, turn = None, 0
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen, turn = now, turn + 1
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = scratch.put(small.union(least.select("a", F.col("m").alias("b"))).distinct(), str(turn))
        scratch.drop(str(turn - 1))
