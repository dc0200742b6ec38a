"""Nearest neighbours by shifted space-filling curves.

Equal vectors are one node. Nodes are projected to a few dimensions in several
ways, each with its own random rotation and shift, and ordered along a Hilbert
curve; Spark sorts every ordering by range. A node's number along the curve
puts it in a block; a query meets the nodes of its own block and of the
neighbouring ones in every ordering, and the results merge. The worst score
that a query has then bounds what is still missing: the blocks of the first
ordering, each with its centre and radius, are gone through by all queries,
and only where a block can hold something nearer is it scored. So the curves
decide how much is left to do, and the result is exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from bomspark.session import cut

NEAREST = 20
ORDERINGS, DIMS, BITS = 3, 6, 9
BLOCK = 512
#: Queries that go to the tasks at once in the closing pass; more take more passes.
QUERIES_PER_PASS = 20_000


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Numbers of points with integer coordinates (n x d) along the Hilbert
    curve, by Skilling's transposition; d * bits is at most 62."""
    x = cells.T.astype(np.int64).copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(set_, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_keys(vectors: np.ndarray, norm: float, ordering: int, dims: int = DIMS, bits: int = BITS) -> np.ndarray:
    """Hilbert numbers of one ordering. A further coordinate lifts all vectors
    to length ``norm``, so that near on the curve means a large inner product."""
    lift = np.sqrt(np.maximum(norm**2 - (vectors**2).sum(1), 0))[:, None]
    full = np.hstack([vectors, lift])
    rng = np.random.default_rng(100 + ordering)
    axes, _ = np.linalg.qr(rng.standard_normal((full.shape[1], min(dims, full.shape[1]))))
    # three standard deviations of a random direction to each side, then a shift of up to a cell's width at the coarsest level
    width = 3 * norm / full.shape[1] ** 0.5
    at = (full @ axes + width) / (2 * width) + rng.uniform(-0.25, 0.25, axes.shape[1])
    cells = np.clip((at * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1)
    return hilbert(cells, bits)


def _matrix(column, dim: int) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(-1, dim)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of row pairs, added from the first component on."""
    return np.cumsum(q * x, axis=1)[:, -1]


def _top(query_ids, q, node_ids, x, keep: int, floor=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its ``keep`` best nodes (ties to the smaller id), not below ``floor``."""
    out = []
    for lo in range(0, len(q), 256):
        part = q[lo : lo + 256]
        score = part @ x.T
        k = min(keep, score.shape[1])
        limit = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        if floor is not None:
            limit = np.maximum(limit, floor[lo : lo + 256])
        slack = 1e-9 * (1 + np.abs(limit))
        i, j = np.nonzero(score >= (limit - slack)[:, None])
        out.append((query_ids[lo + i], node_ids[j], _products(part[i], x[j])))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector that has no null, non-finite or only zero
    components, of the commonest length."""
    e = F.col("embedding")
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & e.isNotNull() & F.coalesce(good, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double"))).alias("embedding"))


def search(vectors: DataFrame, every: int = 20, nearest: int = NEAREST, exact: bool = True) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for each row whose vec_id is
    divisible by ``every``: its ``nearest`` other rows by inner product,
    nearest first, ties to the smaller vec_id; all of them, if fewer.

    Null, zero and non-finite vectors and those of another than the commonest
    length take no part; of rows that repeat a vec_id each counts as a
    candidate with its own vector, and the first vector is the query; other
    columns are ignored; empty tables give no rows. With ``exact`` off the
    result is what the curves alone find."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("norm")).orderBy(F.desc("n"), "d").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], empty)
    dim, norm = sizes["d"], float(sizes["norm"]) ** 0.5
    rows = rows.where(F.size("embedding") == dim).dropDuplicates()
    # a node keeps as many of its members as any result can hold; the limit applies before the shuffle as well
    member = Window.partitionBy("embedding").orderBy("vec_id")
    heads = rows.withColumn("r", F.row_number().over(member)).where(F.col("r") <= nearest + 1)
    node = Window.partitionBy("embedding")
    heads = cut(heads.withColumn("node", F.min("vec_id").over(node)))
    # ids can repeat with other vectors, so nodes are numbered by id and vector
    nodes = heads.where("r = 1").select(F.xxhash64("node", "embedding").alias("node"), F.col("node").alias("low"), "embedding")
    members = heads.select(F.xxhash64("node", "embedding").alias("node"), "vec_id")
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = queries.join(nodes, "embedding").select(F.col("vec_id").alias("query_id"), "node")
    asked = cut(asked)
    wanted = asked.select("node").distinct().withColumn("asked", F.lit(True))
    nodes = nodes.join(wanted, "node", "left").select("node", "embedding", F.coalesce("asked", F.lit(False)).alias("asked"))

    def keys(batches):
        for pdf in batches:
            x = _matrix(pdf.embedding, dim)
            for o in range(ORDERINGS):
                yield pdf.assign(ordering=o, key=curve_keys(x, norm, o) if len(pdf) else 0)

    keyed = nodes.mapInPandas(keys, "node long, embedding array<double>, asked boolean, ordering int, key long")
    keyed = keyed.repartitionByRange("ordering", "key", "node").sortWithinPartitions("ordering", "key", "node")
    # one written copy fixes the order; its row ids hold partition and place
    keyed = cut(keyed.withColumn("at", F.monotonically_increasing_id()))
    part, place = F.shiftright("at", 33).cast("int"), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = keyed.groupBy("ordering", part.alias("part")).agg(F.count("*").alias("n"), F.min(place).alias("first"))
    ahead = Window.partitionBy("ordering").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    numbered = keyed.withColumn("part", part).join(F.broadcast(counts.select("ordering", "part", "first", "before")), ["ordering", "part"])  # a row a partition
    blocks = numbered.select("ordering", F.floor((place - F.col("first") + F.col("before")) / BLOCK).cast("long").alias("block"), "node", "embedding", "asked")

    # a query goes to its own block and to both neighbours
    own = blocks.withColumn("role", F.lit(0))
    ask = blocks.where("asked").withColumn("block", F.explode(F.array(F.col("block") - 1, "block", F.col("block") + 1))).withColumn("role", F.lit(1))
    met = own.union(ask)

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        c, q = pdf[pdf.role == 0], pdf[pdf.role == 1]
        if c.empty or q.empty:
            return pd.DataFrame({"query": pd.Series(dtype="int64"), "node": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        a, b, s = _top(q.node.to_numpy(), _matrix(q.embedding, dim), c.node.to_numpy(), _matrix(c.embedding, dim), nearest + 1)
        return pd.DataFrame({"query": a, "node": b, "score": s})

    found = met.groupBy("ordering", "block").applyInPandas(score, "query long, node long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "node")

    def merged(df: DataFrame) -> DataFrame:
        return df.groupBy("query", "node").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= nearest + 1)

    found = cut(merged(found))
    if exact:
        bound = found.groupBy("query").agg(F.min("score").alias("s"), F.count("*").alias("n"))
        bound = wanted.select(F.col("node").alias("query")).join(bound, "query", "left")
        bound = bound.select("query", F.when(F.col("n") >= nearest + 1, F.col("s")).otherwise(F.lit(float("-inf"))).alias("floor"))
        bound = cut(bound.join(nodes.select(F.col("node").alias("query"), "embedding"), "query"))
        first = blocks.where("ordering = 0").select("block", "node", "embedding").repartition("block").sortWithinPartitions("block")
        total = bound.count()
        passes = max(1, -(-total // QUERIES_PER_PASS))
        for p in range(passes):
            own_queries = bound.where(F.pmod("query", F.lit(passes)) == p).toPandas()  # about QUERIES_PER_PASS rows
            share = spark.sparkContext.broadcast((own_queries["query"].to_numpy(), _matrix(own_queries.embedding, dim), own_queries.floor.to_numpy()))

            def rest(batches, share=share):
                ids, q, floor = share.value
                length = np.linalg.norm(q, axis=1)
                for pdf in batches:
                    for _, c in pdf.groupby("block"):
                        x = _matrix(c.embedding, dim)
                        centre = x.mean(0)
                        reach = q @ centre + length * np.linalg.norm(x - centre, axis=1).max() + 1e-9
                        near = np.flatnonzero(reach >= floor)
                        if len(near):
                            a, b, s = _top(ids[near], q[near], c.node.to_numpy(), x, nearest + 1, floor[near])
                            yield pd.DataFrame({"query": a, "node": b, "score": s})

            found = found.select("query", "node", "score").union(first.select("block", "node", "embedding").mapInPandas(rest, "query long, node long, score double"))
        found = merged(found)
    pairs = asked.join(found.select(F.col("query").alias("_q"), F.col("node").alias("_n"), "score"), F.col("node") == F.col("_q"))
    pairs = pairs.select("query_id", "_n", "score").join(members.withColumnRenamed("node", "_n"), "_n").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
