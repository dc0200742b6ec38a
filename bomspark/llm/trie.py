"""Prefix trie of conversations from padded matrices of turn ids.

Conversations are rows of turn ids (128-bit digests of role and text), sorted
and range-partitioned by Spark in the order of the id sequences. A block of rows
is a padded matrix: numpy's lexsort orders it, OR-accumulated column change masks
mark where nodes start, and ``reduceat`` aggregates every depth. Only the nodes
on the first and the last row of a block can reach into other blocks; all others
are finished where they are. The boundary nodes recombine as a table: their
parts are summed by key, and sums over their subtrees are differences of running
sums in the trie's own order (a subtree is one run of it).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch

#: Conversations of one group share the first turns of its first conversation.
GROUP, HEAD = 20, 3
#: Cells of one padded matrix; a longer conversation is a matrix of its own.
CELLS = 1 << 21
_ID = 16
_WORDS = r"[^\x20\x09-\x0D]+"


def turn_id(role: Column, text: Column) -> Column:
    """Hex digest of role and text, told apart by the role's length."""
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, turns (ids and word counts in order) of each conversation."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    one = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").alias("turn"),
            blank("role").alias("role"),
            turn_id(blank("role"), blank("text")).alias("id"),
            F.regexp_count(blank("text"), F.lit(_WORDS)).alias("words"),
        ).alias("t"),
    )
    ordered = one.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("turns"))


def rebuilt(seqs: DataFrame, group: int = GROUP, head: int = HEAD) -> DataFrame:
    """conv_id, path (ids as bytes), words: the first h turns of the group's
    first conversation, then the own turns after the first h;
    h = crc32(conv_id) % (head + 1)."""
    firsts = seqs.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("first"), F.slice("turns", 1, head).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % (head + 1)).cast("int")
    joined = seqs.withColumn("first", F.col("conv_id") - F.col("conv_id") % group).join(firsts, "first", "left")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    shared = F.coalesce(F.slice("head", F.lit(1), h), F.array().cast("array<struct<id:string,words:int>>"))
    whole = joined.select("conv_id", F.concat(shared, own).alias("t"))
    return whole.select("conv_id", F.unhex(F.array_join(F.col("t.id"), "")).alias("path"), F.col("t.words").alias("words"))


_PART = (
    "inner boolean, block long, side int, depth int, conv_id long, parent_conv_id long, parent_side int, n_convs long, n_children long, n_leaves long,"
    " saved_tokens long, words long, ends string, key binary, parent_key binary, last long"
)
_KIND = pa.schema(
    [
        ("inner", pa.bool_()),
        ("block", pa.int64()),
        ("side", pa.int32()),
        ("depth", pa.int32()),
        ("conv_id", pa.int64()),
        ("parent_conv_id", pa.int64()),
        ("parent_side", pa.int32()),
        ("n_convs", pa.int64()),
        ("n_children", pa.int64()),
        ("n_leaves", pa.int64()),
        ("saved_tokens", pa.int64()),
        ("words", pa.int64()),
        ("ends", pa.string()),
        ("key", pa.binary()),
        ("parent_key", pa.binary()),
        ("last", pa.int64()),
    ]
)


def prefix_keys(path: bytes) -> list[bytes]:
    """Key of every prefix of the path, the empty one first."""
    h = hashlib.blake2b(digest_size=_ID)
    out = [h.digest()]
    for at in range(0, len(path), _ID):
        h.update(path[at : at + _ID])
        out.append(h.copy().digest())
    return out


def padded(ids: np.ndarray, words: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matrices of turn ids (dense, in order of the ids, 0 for no turn) and of word counts."""
    n, depth = len(length), int(length.max(initial=0))
    cell = np.arange(depth)[None, :] < length[:, None]
    dense, w = np.zeros((n, depth), np.int64), np.zeros((n, depth), np.int64)
    if len(ids):
        dense[cell] = np.unique(ids, return_inverse=True)[1] + 1
    w[cell] = words
    return dense, w


def block_nodes(conv: np.ndarray, dense: np.ndarray, words: np.ndarray, length: np.ndarray, paths, block: int) -> list[dict]:
    """Columns of the nodes of one block, by depth. ``paths`` gives the bytes of a
    row's path (rows as given)."""
    order = np.lexsort((conv, *dense.T[::-1]))
    conv, dense, words, length = conv[order], dense[order], words[order], length[order]
    n, deep = dense.shape
    start = np.ones((n, deep), bool)
    if n > 1:
        start[1:] = np.logical_or.accumulate(dense[1:] != dense[:-1], axis=1)
    opens = start & (dense > 0)
    # rows that the first and the last path reach at each depth; beyond them nothing is on a boundary
    first_key, last_key = prefix_keys(paths(order[0])), prefix_keys(paths(order[-1]))
    own = {0: block * 2, 1: block * 2 + 1}
    apart = 0  # depth where the two paths part
    while apart < min(length[0], length[-1]) and dense[0, apart] == dense[-1, apart]:
        apart += 1
    last_path = own[1] if length[-1] > apart else own[0]
    leaves, saved = np.zeros(n, np.int64), np.zeros(n, np.int64)
    levels, below = [], None
    for d in range(deep, -1, -1):
        if d:
            s = np.flatnonzero(start[:, d - 1])
            live = dense[s, d - 1] > 0
        else:
            s, live = np.zeros(1, np.int64), np.ones(1, bool)
        size = np.diff(np.r_[s, n])
        kids = np.add.reduceat(opens[:, d], s) if d < deep else np.zeros(len(s), np.int64)
        w = words[s, d - 1] if d else np.zeros(1, np.int64)
        inner = live.copy()
        edge = [(0, 0)] if d <= length[0] else []
        if d <= length[-1] and d > apart:
            edge.append((len(s) - 1, 1))
        for i, _ in edge:
            inner[i] = False
        # boundary children are counted by the table of boundary nodes
        for i, _ in edge:
            lo, hi = s[i], s[i] + size[i]
            if d < length[0] and lo == 0:
                kids[i] -= 1
            if d < length[-1] and hi == n and (d + 1 > apart):
                kids[i] -= 1
        at = s[inner]
        saved[at] += (size[inner] - 1) * w[inner]
        leaves[at] += kids[inner] == 0
        sums = {"n_leaves": np.add.reduceat(leaves, s), "saved_tokens": np.add.reduceat(saved, s)}
        low = np.minimum.reduceat(conv, s)
        done = np.add.reduceat(length == d, s)
        rows = [(i, None) for i in np.flatnonzero(inner)] + edge
        if rows:
            pick = np.array([i for i, _ in rows])
            side = [b for _, b in rows]
            ids = lambda i: ",".join(map(str, np.sort(conv[s[i] : s[i] + done[i]]).tolist()))
            ends = [
                hashlib.sha256(ids(i).encode()).hexdigest() if b is None else (ids(i) if done[i] else None) for i, b in rows
            ]
            key = [None if b is None else (last_key if b else first_key)[d] for b in side]
            up = [None if b is None or not d else (last_key if b else first_key)[d - 1] for b in side]
            levels.append(
                {
                    "inner": np.array([b is None for b in side]),
                    "block": np.full(len(pick), block, np.int64),
                    "side": pa.array(side, pa.int32()),
                    "depth": np.full(len(pick), d, np.int32),
                    "conv_id": low[pick],
                    "start": s[pick],
                    "n_convs": size[pick],
                    "n_children": kids[pick],
                    **{k: x[pick] for k, x in sums.items()},
                    "words": w[pick],
                    "ends": pa.array(ends, pa.string()),
                    "key": pa.array(key, pa.binary()),
                    "parent_key": pa.array(up, pa.binary()),
                    # the last of the two paths that the node is on
                    "last": pa.array([None if b is None else (last_path if b or d <= apart else own[0]) for b in side], pa.int64()),
                }
            )
        for i, _ in edge:
            leaves[s[i] : s[i] + size[i]] = 0
            saved[s[i] : s[i] + size[i]] = 0
        # a parent is the node one level up whose rows hold the start
        if below is not None:
            kind = np.full(len(s), -1, np.int32)
            for i, b in edge:
                kind[i] = b
            parent = np.searchsorted(s, below["start"], "right") - 1
            below["parent_side"] = pa.array(kind[parent], pa.int32(), mask=kind[parent] < 0)
            below["parent_conv_id"] = pa.array(low[parent], pa.int64(), mask=kind[parent] >= 0)
        below = levels[-1] if rows else None
    # the root has no parent
    levels[-1]["parent_side"], levels[-1]["parent_conv_id"] = pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64())
    return levels


def shard_nodes(batches, cells: int):
    """Nodes of the blocks of one shard. Rows come in order of their paths."""
    number = 0
    for batch in batches:
        path, words, conv = batch.column("path").cast(pa.large_binary()), batch.column("words"), batch.column("conv_id").to_numpy()
        shard = int(batch.column("shard")[0].as_py()) if batch.num_rows else 0
        offs = np.frombuffer(path.buffers()[1], np.int64)[path.offset : path.offset + len(path) + 1]
        data = np.frombuffer(path.buffers()[2], np.uint8) if path.buffers()[2] is not None else np.zeros(0, np.uint8)
        data = data[offs[0] : offs[-1]] if len(offs) else data
        offs = (offs - offs[0]) // _ID
        ids = np.ascontiguousarray(data).view(f"V{_ID}")
        count = words.flatten().to_numpy()
        length = np.diff(offs)
        lo = 0
        while lo < len(length):
            widest = np.maximum.accumulate(length[lo:]) * np.arange(1, len(length) - lo + 1)
            hi = lo + max(1, int(np.searchsorted(widest, cells, "right")))
            of = slice(offs[lo], offs[hi])
            dense, w = padded(ids[of], count[of], length[lo:hi])
            get = lambda i, lo=lo: data[offs[lo + i] * _ID : offs[lo + i + 1] * _ID].tobytes()
            for x in block_nodes(conv[lo:hi], dense, w, length[lo:hi], get, (shard << 32) + number):
                yield pa.RecordBatch.from_arrays([pa.array(x[f.name], f.type) if not isinstance(x[f.name], pa.Array) else x[f.name] for f in _KIND], schema=_KIND)
            number += 1
            lo = hi


def joined_digests(batches):
    """key and SHA-256 of its pieces, comma-joined; rows come by key and block."""
    now, h = None, None
    for batch in batches:
        keys, ends = [], []
        for key, piece in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if key != now:
                if h is not None:
                    keys.append(now)
                    ends.append(h.hexdigest())
                now, h = key, hashlib.sha256()
            else:
                h.update(b",")
            h.update(piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ends, pa.string())], names=["key", "ends"])
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([h.hexdigest()], pa.string())], names=["key", "ends"])


def recombined(part: DataFrame, scratch: Scratch) -> DataFrame:
    """Boundary nodes, whole: key and the columns of the result but the parent's."""
    own = F.col("block") * 2 + F.col("side")
    nodes = part.groupBy("key").agg(
        F.min(own).alias("path"),
        F.max("last").alias("last"),
        F.first("depth").alias("depth"),
        F.first("parent_key").alias("parent_key"),
        F.min("conv_id").alias("conv_id"),
        F.max("words").alias("words"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    nodes = scratch.put(nodes, "boundary")
    kids = nodes.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more"))
    nodes = nodes.join(kids, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    nodes = nodes.withColumns(
        {
            "leaf": F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0),
            "saved": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words"),
        }
    )
    # running sums in the order of the trie: paths in order, on a path by depth
    on_path = Window.partitionBy("path").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumns({f"{c}_above": F.coalesce(F.sum(c).over(on_path), F.lit(0)) for c in ("leaf", "saved")})
    nodes = scratch.put(nodes, "boundary-sums")
    paths = part.select(own.alias("path")).union(part.select("last")).distinct()
    totals = nodes.groupBy("path").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    paths = paths.join(totals, "path", "left").withColumn("shard", F.shiftright("path", 33)).na.fill(0, ["leaf", "saved"])
    # a shard's paths are ordered in one group, then the shards' totals
    to_here = Window.partitionBy("shard").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    shards = paths.groupBy("shard").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("leaf", "saved")])
    running = paths.withColumns({f"{c}_to": F.sum(c).over(to_here) for c in ("leaf", "saved")}).join(shards, "shard")
    running = running.select("path", *[(F.col(f"{c}_to") + F.col(f"{c}_before")).alias(f"{c}_to") for c in ("leaf", "saved")], "leaf", "saved")
    running = scratch.put(running, "paths")
    begin = running.select("path", (F.col("leaf_to") - F.col("leaf")).alias("leaf_from"), (F.col("saved_to") - F.col("saved")).alias("saved_from"))
    end = running.select(F.col("path").alias("last"), "leaf_to", "saved_to")
    nodes = nodes.join(begin, "path").join(end, "last")
    total = lambda c: F.col(f"{c}_to") - F.col(f"{c}_from") - F.col(f"{c}_above")
    pieces = part.where("ends is not null").select("key", "block", "ends").repartition("key").sortWithinPartitions("key", "block")
    ends = pieces.select("key", "ends").mapInArrow(joined_digests, "key binary, ends string")
    nodes = nodes.join(ends, "key", "left")
    return nodes.select(
        "key",
        "parent_key",
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        "n_convs",
        "n_children",
        total("leaf").alias("n_leaves"),
        total("saved").alias("saved_tokens"),
        F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def trie(turns: DataFrame, group: int = GROUP, head: int = HEAD, cells: int = CELLS) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations (root included):
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn (null first), equal ones by role and by digest of
    role and text; rows that repeat stay repeated. Null roles and texts count as
    empty; rows without conv_id belong to no conversation. An empty table has no
    rows, not even a root. Other columns are ignored. Texts are hashed and their
    words counted where they are read; a conversation is one row of 20 bytes a
    turn from then on, whatever its texts' length."""
    scratch = Scratch(turns.sparkSession, "trie")
    seqs = scratch.put(sequences(turns), "sequences")
    rows = rebuilt(seqs, group, head)
    rows = rows.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").withColumn("shard", F.spark_partition_id().cast("long"))
    parts = scratch.put(rows.mapInArrow(lambda b: shard_nodes(b, cells), _PART), "parts")
    edge = parts.where("not inner")
    whole = scratch.put(recombined(edge, scratch), "whole")
    # a boundary parent is found by its place in the block, so no group is larger than a block
    names = edge.select("key", "block", F.col("side").alias("parent_side"), (F.col("depth") + 1).alias("depth"))
    names = names.join(whole.select("key", F.col("conv_id").alias("found")), "key").drop("key")
    shape = ["conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256")]
    settled = parts.where("inner and parent_side is null").select(*shape)
    open_ = parts.where("inner and parent_side is not null").drop("parent_conv_id").join(names, ["block", "parent_side", "depth"])
    open_ = open_.withColumnRenamed("found", "parent_conv_id").select(*shape)
    up = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    edges = whole.join(up, "parent_key", "left")
    edges = edges.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return settled.union(open_).union(edges)
