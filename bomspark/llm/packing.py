"""Packing documents into sequences of fixed length by bin completion.

Documents are tokenised where they lie and cut only if longer than a sequence.
How many pieces there are of each length (at most ``capacity`` numbers) decides
the plan: branch and bound over the undominated fillings of each largest piece,
with whole best-fit decreasing (or the fullest filling of each largest piece,
if that needs fewer sequences) as the incumbent. It ends when a plan meets the
lower bound, when nothing is left to try, or after STEPS steps. Pieces are then
numbered within their length, group by group, and placed by number.
"""

from __future__ import annotations

import base64
import math
import re
import zlib
from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from bomspark.session import cut

CAPACITY = 1024
END = 2
#: Pieces of one length are numbered in groups of about this many.
GROUP_ROWS = 50_000
#: Steps of the whole search for a better plan before the best so far is taken.
STEPS = 20_000

_SPECIAL = "<|endoftext|>"
#: White space that the fast tokenizer still takes in one run (it backtracks over it); 2,000,000 are too many for it, 100,000 are not.
_BLANK_RUN = 50_000
_BLANKS = re.compile(rf"\s{{{_BLANK_RUN}}}")


def tokenizer(path: str):
    """Texts -> id arrays, as ``tokenizers`` gives them for ``path`` without
    special tokens added. The byte-level vocabulary is run by its rank file,
    which has the same ids at several times the speed; a text that holds the
    vocabulary's special token or a very long run of white space goes to
    ``tokenizers`` itself."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    if not path.endswith("byte_bpe_50k.json"):
        return lambda texts: [np.array(x.ids, np.uint32) for x in plain.encode_batch_fast(texts, add_special_tokens=False)]
    with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def slow(t: str) -> bool:
        return _SPECIAL in t or len(t) >= _BLANK_RUN and _BLANKS.search(t) is not None

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.array(plain.encode(t, add_special_tokens=False).ids if slow(t) else fast.encode_ordinary(t), np.uint32) for t in texts]

    return encode


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for every piece of every row.

    ``path`` is the vocabulary file; by default the public byte-level one. It
    has to be at the same place on every executor."""

    def run(batches):
        where = path
        if where is None:
            import public_tokenizers

            where = public_tokenizers.path("byte_bpe_50k.json")
        encode = tokenizer(where)
        for batch in batches:
            texts = batch.column("text")
            for lo in range(0, batch.num_rows, 512):
                own, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(encode(texts.slice(lo, 512).to_pylist()), lo):
                    ids = np.r_[ids, np.uint32(END)].astype("<u4")
                    cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        own.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[a:b].tobytes()))
                columns = [batch.column("doc_id").take(pa.array(own, pa.int64())), pa.array(piece, pa.int32())]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: np.ndarray, room: int) -> list[int]:
    """The largest lengths that still fit, one after another."""
    out, left = [], counts.copy()
    while room:
        fits = np.flatnonzero(left[: room + 1])
        if not len(fits) or not fits[-1]:
            break
        out.append(int(fits[-1]))
        left[fits[-1]] -= 1
        room -= int(fits[-1])
    return out


class Budget:
    """Steps that a search may still take; None has no end."""

    def __init__(self, steps: int | None):
        self.left = float("inf") if steps is None else steps

    def step(self, n: int = 1) -> bool:
        self.left -= n
        return self.left >= 0


def best_fit_plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Best-fit decreasing of all pieces, sequences of one content counted together."""
    rooms: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    for s in map(int, np.flatnonzero(counts)[::-1]):
        c, at = int(counts[s]), s
        while c:
            while at < capacity and not rooms[at]:
                at += 1
            # a sequence that took one piece is the fullest that fits, so it goes on while there is room
            k = at // s
            content, n = rooms[at].popitem() if rooms[at] else ((), c // k + 1)
            whole, some = min(n, c // k), 0
            if whole < n and c > whole * k:
                some = c - whole * k
            for times, more in ((whole, k), (1, some)):
                if times and more:
                    grown = (*content, *[s] * more)
                    rooms[at - more * s][grown] = rooms[at - more * s].get(grown, 0) + times
            if content and (rest := n - whole - bool(some)):
                rooms[at][content] = rest
            c -= whole * k + some
    return [(list(content), n) for room in rooms for content, n in sorted(room.items(), reverse=True)]


def _sums(counts: np.ndarray, room: int) -> tuple[list[int], list[int], list[int]]:
    """Lengths up to ``room`` in falling order, how many of each can be in it,
    and as bit sets the sums that those from each one on can make."""
    sizes = [int(s) for s in np.flatnonzero(counts[: room + 1]) if s][::-1]
    have = [min(int(counts[s]), room // s) for s in sizes]
    mask, reach = (1 << room + 1) - 1, [1]
    for s, k in zip(sizes[::-1], have[::-1], strict=True):
        bits, step = reach[-1], 1
        while k and bits != mask:
            some = min(step, k)
            bits |= bits << some * s & mask
            k, step = k - some, step * 2
        reach.append(bits)
    return sizes, have, reach[::-1]


def fillings(counts: np.ndarray, room: int, budget: Budget):
    """The undominated ways to fill ``room`` from ``counts``, least waste first,
    of equal waste the lexically largest first; lengths fall in each.

    Which sums the lengths from the j-th on can make is a bit set, so no branch
    ends without a filling. A filling is dominated (Martello and Toth) if an
    unused piece fits in the place of one shorter part, of several parts, or
    of none; the first filling never is."""
    sizes, have, reach = _sums(counts, room)

    def dominated(taken: list[int], waste: int) -> bool:
        spare = 0
        for s, k in zip(sizes, have, strict=True):
            if int(counts[s]) > taken.count(s):
                spare |= 1 << s
        fit = lambda x: spare >> x & (1 << waste + 1) - 1
        if waste and fit(1) & (1 << waste) - 1:
            return True
        one, several = 1, 0  # sums of at most one part, of two and more
        for s in taken:
            several |= several << s | (one & ~1) << s
            one |= 1 << s
        if waste and any(fit(s + 1) & (1 << waste) - 1 for s in set(taken)):
            return True
        while several:
            x = (several & -several).bit_length() - 1
            if fit(x):
                return True
            several &= several - 1
        return False

    for total in range(room, -1, -1):
        if not reach[0] >> total & 1:
            continue
        stack: list[tuple[int, int, list[int]]] = [(0, total, [])]
        while stack:
            j, left, taken = stack.pop()
            if not budget.step():
                return
            if not left:
                if not dominated(taken, room - total):
                    yield taken
                continue
            ways = []
            while j < len(sizes) and reach[j] >> left & 1:
                s = sizes[j]
                for k in range(min(have[j], left // s), 0, -1):
                    if reach[j + 1] >> left - k * s & 1:
                        ways.append((j + 1, left - k * s, [*taken, *[s] * k]))
                j += 1
            stack += ways[::-1]


def completion(counts: np.ndarray, room: int) -> list[int]:
    """Lengths, largest first, that fill ``room`` with the least waste there is."""
    if sum(best := best_fit(counts, room)) == room:
        return best
    return next(fillings(counts, room, Budget(None)), [])


def bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Sequences that are needed at least: Martello and Toth's L2, or the sum
    of each piece's least share of a sequence (its length by the fullest
    filling that can hold it), whichever is more."""
    n = np.r_[0, np.cumsum(counts, dtype=np.int64)]
    size = np.r_[0, np.cumsum(counts * np.arange(capacity + 1), dtype=np.int64)]
    k, half = np.arange(capacity // 2 + 1), capacity // 2 + 1
    above = n[-1] - n[half]
    # pieces over capacity - k go alone, those over the half one a sequence, and those from k on fill what room is left
    open_room = (n[capacity - k + 1] - n[half]) * capacity - (size[capacity - k + 1] - size[half])
    small = size[half] - size[k]
    most = int((above + np.maximum(0, -(-(small - open_room) // capacity))).max())
    sums = _sums(counts, capacity)[2][0]
    made = np.array([sums >> x & 1 for x in range(capacity + 1)], bool)
    below = np.maximum.accumulate(np.where(made, np.arange(capacity + 1), 0))
    s = np.flatnonzero(counts)
    shares = float((counts[s] * (s / (s + below[capacity - s]))).sum())
    return max(most, math.ceil(shares - 1e-9 * max(1.0, shares)))


def _coarse_first(n: int):
    """n, ..., 1 by bisection: each number once."""
    yield n
    ranges = deque([(1, n)])
    while ranges:
        lo, hi = ranges.popleft()
        if lo < hi:
            mid = (lo + hi) // 2
            yield mid
            ranges += [(lo, mid), (mid + 1, hi)]


def search(counts: np.ndarray, capacity: int, incumbent: list[tuple[list[int], int]], steps: int | None = STEPS) -> list[tuple[list[int], int]]:
    """A plan of fewer sequences than ``incumbent``, or ``incumbent`` if there
    is none (or none was found in ``steps`` steps; None searches to the end).

    Branches over the undominated fillings of the largest piece left and how
    many sequences get each, depth first with backtracking; best-fit decreasing
    ends each branch for a better plan early on. A step is a filling, part of
    one, or a length of the rest that is so ended. A branch is left if
    its sequences so far and the bound of the rest are not below the best
    plan's, if its waste is above what the best plan minus one sequence leaves,
    or if the same rest was met with no more sequences."""
    best, fewest, least = incumbent, sum(n for _, n in incumbent), bound(counts, capacity)
    tokens, lengths = int((counts * np.arange(capacity + 1)).sum()), np.flatnonzero(counts)
    budget, seen = Budget(steps), {}

    def children(left: np.ndarray, used: int, waste: int):
        largest = int(np.flatnonzero(left)[-1])
        rest = left.copy()
        rest[largest] -= 1
        for filling in fillings(rest, capacity - largest, budget):
            pattern = [largest, *filling]
            free = capacity - sum(pattern)
            allowed = (fewest - 1) * capacity - tokens - waste
            if free > allowed:
                return
            own, each = np.unique(pattern, return_counts=True)
            times = int((left[own] // each).min())
            for t in _coarse_first(min(times, allowed // free) if free else times):
                after = left.copy()
                after[own] -= t * each
                yield pattern, t, after, used + t, waste + t * free

    stack, path = [children(counts.astype(np.int64), 0, 0)], []
    while stack and fewest > least and budget.step():
        if (child := next(stack[-1], None)) is None:
            stack.pop()
            if path:
                path.pop()
            continue
        pattern, t, left, used, waste = child
        if used + bound(left, capacity) >= fewest:
            continue
        key = left[lengths].tobytes()
        if seen.get(key, fewest) <= used:
            continue
        seen[key] = used
        if not budget.step(int(np.count_nonzero(left))):
            break
        ending = best_fit_plan(left, capacity)
        if (whole := used + sum(n for _, n in ending)) < fewest:
            best, fewest = [*path, (pattern, t), *ending], whole
        path.append((pattern, t))
        stack.append(children(left, used, waste))
    return best


def plan(counts: np.ndarray, capacity: int = CAPACITY, steps: int | None = STEPS) -> list[tuple[list[int], int]]:
    """Patterns (lengths, times) that use up ``counts`` (by length, 0 to capacity).

    The better of whole best-fit decreasing and of the fullest filling of each
    largest piece, as often as counts allow, is where ``search`` starts."""
    left, out = counts.astype(np.int64).copy(), []
    while left.any():
        largest = int(np.flatnonzero(left)[-1])
        left[largest] -= 1
        filling = completion(left, capacity - largest)
        left[largest] += 1
        pattern = [largest, *filling]
        lengths, each = np.unique(pattern, return_counts=True)
        times = int((left[lengths] // each).min())
        left[lengths] -= times * each
        out.append((pattern, times))
    first = min(best_fit_plan(counts, capacity), out, key=lambda p: sum(n for _, n in p))
    return search(counts.astype(np.int64), capacity, first, steps)


def _places(patterns: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length, for runs of numbers of its pieces: first number, pieces a
    sequence, first sequence, offset of the first piece in it."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for s in dict.fromkeys(pattern):
            k = pattern.count(s)
            runs.setdefault(s, []).append((used.get(s, 0), k, sequence, offset))
            used[s] = used.get(s, 0) + k * times
            offset += s * k
        sequence += times
    return {s: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for s, r in runs.items()}


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of ``docs`` is a document; null and empty texts are the end id
    alone. Texts of any length and runs of any one character are whole. Documents
    of one length are alike, so ties fall by hash of doc_id.
    A null doc_id is kept as it is. Rows that repeat are placed each. Empty
    tables give no rows; other columns are ignored."""
    spark = docs.sparkSession
    cut_rows = cut(pieces(docs, path, capacity))
    total = cut_rows.count()
    groups = max(1, -(-total // group_rows))
    rows = cut_rows.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))
    by_group = rows.groupBy("length", "g").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in by_group.groupBy("length").agg(F.sum("n")).collect():  # one row a length
        counts[length] = n
    share = spark.sparkContext.broadcast(_places(plan(counts, capacity)))
    ahead = Window.partitionBy("length").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    first = by_group.select("length", "g", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "g").orderBy("doc_id", "piece", "ids_crc32")
    numbered = rows.withColumn("r", F.row_number().over(inside) - 1).join(first, ["length", "g"]).withColumn("r", F.col("r") + F.col("first"))
    kind = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    @F.pandas_udf(kind)
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        s, r = length.to_numpy(np.int64), number.to_numpy(np.int64)
        sequence, offset = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
        order = np.argsort(s, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(s[order])) + 1) if len(s) else []:
            start, each, seq, off = share.value[int(s[part[0]])]
            k = np.searchsorted(start, r[part], "right") - 1
            nth = r[part] - start[k]
            sequence[part] = seq[k] + nth // each[k]
            offset[part] = off[k] + nth % each[k] * s[part]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    out = numbered.withColumn("at", place("length", "r"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
