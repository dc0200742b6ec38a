"""Exact removal of repeated substrings by sorted suffixes.

A byte of a document goes if a string of LENGTH bytes that covers it also
starts in a document of a smaller id. Sorting every suffix of a corpus would
move each byte dozens of times, so suffixes are first found by anchors: the
smallest K-gram (by hash) of every LENGTH window, which equal windows share.

1. Anchors are dealt by hash with a hash of their surroundings, i.e. of all the
   windows they stand for. Equal surroundings settle an anchor without text;
   within a task only the smallest document of each is sent on.
2. Anchors that stand in other surroundings elsewhere are contested. Their
   surroundings are fetched from the documents and dealt by anchor; an anchor
   that a great many documents contest is dealt by window instead.
3. Each deal sorts its suffixes deep-shallow: multikey quicksort on words of
   eight bytes to a shallow depth, then blind tries for the groups with longer
   common prefixes. Neighbours that agree in LENGTH bytes are equal windows.
4. The documents, dealt once for 2 and 4, drop what is marked.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bomspark.session import cut

from .common import Spans, byte_views, mix, raw

LENGTH = 50
#: Text a deal stands for.
DEAL_BYTES = 8 << 20
#: Text and anchors that a task works on at once.
VIEW_BYTES, FLUSH_ANCHORS = 512 << 10, 500_000
#: Contested anchors of one hash in one deal, beyond which they are dealt by window.
HOT = 2_000
SHALLOW = 24
#: A null doc_id is larger than every other.
LAST = np.iinfo(np.int64).max

_U = np.uint64


# -- sorting -----------------------------------------------------------------


def deep_shallow(data: np.ndarray, start: np.ndarray, depth: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of ``data`` at ``start`` by their first ``depth``
    bytes, and for each place in it the number of its group of equal ones.
    ``data`` has to reach ``depth`` bytes (and eight more) beyond every start."""
    n = len(start)
    order, group = np.arange(n), np.zeros(n, np.int64)
    open_ = np.arange(n)  # places whose groups have more than one suffix
    shallow = min(shallow, depth)
    for at in range(0, shallow, 8):
        if not len(open_):
            break
        own = start[order[open_]] + at
        word = np.zeros(len(own), _U)
        for k in range(8):
            word = (word << _U(8)) | (data[own + k].astype(_U) if at + k < depth else _U(0))
        inner = np.lexsort((word, group[open_]))
        word, g = word[inner], group[open_][inner]
        order[open_] = order[open_][inner]
        new = np.r_[True, (g[1:] != g[:-1]) | (word[1:] != word[:-1])]
        open_, group = _regroup(group, open_, new)
    while len(open_):
        # blind tries: the first suffix of a group is its path; the others hang
        # on it where they leave it, in order of depth and branching byte
        g = group[open_]
        first = np.r_[True, g[1:] != g[:-1]]
        path = np.maximum.accumulate(np.where(first, np.arange(len(g)), 0))
        own = start[order[open_]]
        leave = np.full(len(g), depth)
        byte = np.zeros(len(g), np.int64)
        side = np.zeros(len(g), np.int64)
        here = np.arange(len(g))
        for at in range(shallow, depth):
            a, b = data[own[here] + at], data[own[path[here]] + at]
            off = a != b
            gone = here[off]
            leave[gone], byte[gone], side[gone] = at, a[off], np.where(a[off] < b[off], -1, 1)
            here = here[~off]
            if not len(here):
                break
        rank = np.where(side < 0, leave, -leave)
        inner = np.lexsort((byte, rank, side, g))
        order[open_] = order[open_][inner]
        g, side, leave, byte = g[inner], side[inner], leave[inner], byte[inner]
        new = np.r_[True, (g[1:] != g[:-1]) | (side[1:] != side[:-1]) | (leave[1:] != leave[:-1]) | (byte[1:] != byte[:-1])]
        done = side == 0
        open_, group = _regroup(group, open_, new, done)
    return order, group


def _regroup(group: np.ndarray, open_: np.ndarray, new: np.ndarray, done: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Split groups where ``new`` says so; group numbers stay places of first members."""
    head = np.maximum.accumulate(np.where(new, open_, -1))
    group = group.copy()
    group[open_] = head
    size = np.bincount(np.cumsum(new) - 1)
    more = np.repeat(size > 1, size)
    if done is not None:
        more &= ~done
    return open_[more], group


# -- blobs: many anchors or marks in one row ----------------------------------


def _deals(deal: np.ndarray, columns: dict[str, np.ndarray]) -> pd.DataFrame:
    """One row per deal, each column's values as bytes."""
    order = np.argsort(deal, kind="stable")
    deal = deal[order]
    edge = np.flatnonzero(np.r_[True, deal[1:] != deal[:-1]]) if len(deal) else np.zeros(0, int)
    end = np.r_[edge[1:], len(deal)]
    out = {"deal": deal[edge].astype(np.int64)}
    for name, x in columns.items():
        x = x[order]
        out[name] = [x[a:b].tobytes() for a, b in zip(edge, end, strict=False)]
    return pd.DataFrame(out)


def _values(column: pd.Series, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind)


def _doc_deal(doc: np.ndarray, mark: np.ndarray, deals: int) -> np.ndarray:
    return (mix(doc.view(_U) + mark.astype(_U) * _U(0x9E3779B97F4A7C15)) % _U(deals)).astype(np.int64)


# -- anchors --------------------------------------------------------------------


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over every run of ``width`` values."""
    out, have = x, 1
    while have * 2 <= width:
        out = op(out[:-have], out[have:])
        have *= 2
    return op(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """row, position in it, hash, hash of the surroundings of every anchor; and the hash of each row."""
    k = length // 2 - 1
    width = length - k + 1
    spans = Spans(data)
    mark = (spans.hash(offsets[:-1], offsets[1:]) >> _U(32)).astype(np.uint32)
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none.view(_U), none.view(_U), mark
    at = np.arange(n - k + 1)
    gram = spans.hash(at, at + k)
    low = _slide(gram, width, np.minimum)
    end = np.repeat(offsets[1:], np.diff(offsets))
    low[end[: len(low)] - np.arange(len(low)) < length] = 0  # windows that leave their row choose nothing
    padded = np.r_[np.zeros(width - 1, _U), low, np.zeros(width - 1, _U)]
    place = np.flatnonzero(_slide(padded, width, np.maximum)[: len(gram)] == gram)
    row = np.searchsorted(offsets, place, "right") - 1
    start = np.maximum(place - (length - k), offsets[row])
    stop = np.minimum(place + length, offsets[row + 1])
    around = mix(spans.hash(start, stop) + (place - start).astype(_U))
    return row, place - offsets[row], gram[place], around, mark


def _anchor_rows(batches, length: int, deals: int):
    """Anchors by hash (deals 0 ...) and marks by document (deals ``deals`` ...)."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        got, n = [], 0
        for lo, hi, data, offsets in byte_views(batch.column("body"), VIEW_BYTES):
            row, pos, gram, around, mark = anchors(data, offsets, length)
            got.append((ids[lo:hi][row], mark[row], pos.astype(np.uint32), gram, around))
            n += len(row)
            if n >= FLUSH_ANCHORS:
                yield _dealt_anchors(got, deals)
                got, n = [], 0
        if n:
            yield _dealt_anchors(got, deals)


def _dealt_anchors(got: list, deals: int) -> pa.RecordBatch:
    doc, mark, pos, gram, around = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.lexsort((doc, around, gram))
    doc, mark, pos, gram, around = (x[order] for x in (doc, mark, pos, gram, around))
    new = np.r_[True, (gram[1:] != gram[:-1]) | (around[1:] != around[:-1])][: len(gram)]
    lowest = doc[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))]
    sent = doc == lowest
    settled = ~sent
    # anchors in order of document and place, which packs better
    out = np.flatnonzero(sent)
    out = out[np.lexsort((pos[out], doc[out]))]
    deal = ((gram[out] >> _U(32)) % _U(deals)).astype(np.int64)
    a = _deals(deal, {"doc": doc[out], "mark": mark[out], "pos": pos[out], "gram": gram[out].astype(np.uint32), "around": around[out]})
    b = _deals(deals + _doc_deal(doc[settled], mark[settled], deals), {"doc": doc[settled], "mark": mark[settled], "pos": pos[settled]})
    return pa.RecordBatch.from_pandas(pd.concat([a, b], ignore_index=True), schema=_ANCHORS, preserve_index=False)


_ANCHORS = pa.schema([("deal", pa.int64()), *((n, pa.binary()) for n in ("doc", "mark", "pos", "gram", "around"))])
_ANCHORS_DDL = "deal long, doc binary, mark binary, pos binary, gram binary, around binary"
#: kind 0: all windows around the anchor at pos are repeats; 1: contested; 2: contested by very many; 3: bytes pos to pos + gram are repeats.
_MARKS_DDL = "deal long, kind int, doc binary, mark binary, pos binary, gram binary"
_TEXTS_DDL = "deal long, doc binary, mark binary, pos binary, size binary, text binary"


def _settle(pdf: pd.DataFrame, deals: int, hot: int) -> pd.DataFrame:
    """One deal of anchors: which are settled and which are contested."""
    deal = int(pdf.deal.iloc[0])
    if deal >= deals:
        return pdf.assign(deal=deal - deals, kind=0, gram=None)[["deal", "kind", "doc", "mark", "pos", "gram"]]
    doc, mark, pos = _values(pdf.doc, np.int64), _values(pdf["mark"], np.uint32), _values(pdf.pos, np.uint32)
    gram, around = _values(pdf.gram, np.uint32), _values(pdf.around, _U)
    order = np.lexsort((doc, around, gram))
    doc, mark, pos, gram, around = (x[order] for x in (doc, mark, pos, gram, around))
    at = np.arange(len(doc))
    g = np.r_[True, gram[1:] != gram[:-1]]
    c = g | np.r_[True, around[1:] != around[:-1]]
    lowest = doc[np.maximum.accumulate(np.where(c, at, 0))]
    settled = doc != lowest
    edge = np.flatnonzero(g)
    several = np.add.reduceat(c, edge) > 1
    several &= np.minimum.reduceat(doc, edge) < np.maximum.reduceat(doc, edge)
    size = np.diff(np.r_[edge, len(doc)])
    contested = np.repeat(several, size) & ~settled
    open_ = np.add.reduceat(contested, edge)
    many = np.repeat(open_ > hot, size)
    frames = []
    for kind, which in ((0, settled), (1, contested & ~many), (2, contested & many)):
        i = np.flatnonzero(which)
        i = i[np.lexsort((pos[i], doc[i]))]
        columns = {"doc": doc[i], "mark": mark[i], "pos": pos[i]} | ({"gram": gram[i].astype(_U) | _U(deal << 32)} if kind else {})
        frames.append(_deals(_doc_deal(doc[i], mark[i], deals), columns).assign(kind=kind))
    return pd.concat(frames, ignore_index=True).reindex(columns=["deal", "kind", "doc", "mark", "pos", "gram"])


class _Rows:
    """The documents of a deal: bytes end to end and a look-up by id and hash."""

    def __init__(self, pdf: pd.DataFrame):
        self.id = pdf.doc_id.to_numpy(np.int64)
        self.mark = pdf["mark"].to_numpy(np.int64)
        self.offsets = np.r_[0, np.cumsum([len(b) for b in pdf.body])].astype(np.int64)
        self.data = np.frombuffer(b"".join(pdf.body), np.uint8)
        self.key = mix(self.id.view(_U) + self.mark.astype(_U) * _U(0x9E3779B97F4A7C15))
        self.order = np.argsort(self.key, kind="stable")

    def find(self, doc: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """A row with this id and text (rows that repeat are alike)."""
        key = mix(doc.view(_U) + mark.astype(_U) * _U(0x9E3779B97F4A7C15))
        return self.order[np.searchsorted(self.key[self.order], key)]


def _window_starts(pos: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts of these sizes, laid end to end, the text and offset in it of every window."""
    n = size.astype(np.int64) - length + 1
    own = np.repeat(np.arange(len(n)), n)
    return own, np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(size)]
    return data[np.arange(total[-1]) - np.repeat(total[:-1] - start, size)] if total[-1] else data[:0]


def _fetch(docs: pd.DataFrame, marks: pd.DataFrame, length: int, deals: int) -> pd.DataFrame:
    """Surroundings of contested anchors, dealt by anchor, or as single windows by their hash."""
    k = length // 2 - 1
    rows = _Rows(docs)
    frames = []
    for kind, part in marks.groupby("kind"):
        doc, mark, pos = _values(part.doc, np.int64), _values(part["mark"], np.uint32), _values(part.pos, np.uint32).astype(np.int64)
        gram = _values(part.gram, _U)
        row = rows.find(doc, mark)
        base = rows.offsets[row]
        start = np.maximum(pos - (length - k), 0)
        size = np.minimum(pos + length, rows.offsets[row + 1] - base) - start
        if kind == 1:
            deal = (mix(gram) % _U(deals)).astype(np.int64)
        else:
            own, off = _window_starts(start, size, length)
            doc, mark, start, base = doc[own], mark[own], start[own] + off, base[own]
            size = np.full(len(own), length)
            h = Spans(rows.data).hash(base + start, base + start + length)
            # of the windows here that are equal only the smallest document's goes on
            order = np.lexsort((doc, h))
            new = np.r_[True, h[order][1:] != h[order][:-1]]
            lowest = np.zeros(len(doc), np.int64)
            lowest[order] = doc[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            deal = deals + (h % _U(deals)).astype(np.int64)
            over = np.flatnonzero(doc != lowest)
            frames.append(_deals(2 * deals + _doc_deal(doc[over], mark[over], deals), {"doc": doc[over], "mark": mark[over], "pos": start[over].astype(np.uint32), "size": size[over].astype(np.uint32)}))
            stay = doc == lowest
            doc, mark, start, base, size, deal = (x[stay] for x in (doc, mark, start, base, size, deal))
        order = np.argsort(deal, kind="stable")
        doc, mark, start, base, size, deal = (x[order] for x in (doc, mark, start, base, size, deal))
        frame = _deals(deal, {"doc": doc, "mark": mark, "pos": start.astype(np.uint32), "size": size.astype(np.uint32)})
        edge = np.r_[np.flatnonzero(np.r_[True, deal[1:] != deal[:-1]]), len(deal)] if len(deal) else np.zeros(1, int)
        frames.append(frame.assign(text=[_gather(rows.data, (base + start)[a:b], size[a:b]).tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]))
    return pd.concat(frames, ignore_index=True).reindex(columns=["deal", "doc", "mark", "pos", "size", "text"])


def _sort_deal(pdf: pd.DataFrame, length: int, deals: int) -> pd.DataFrame:
    """Sort all windows of a deal and mark those that a smaller document has as well."""
    deal = int(pdf.deal.iloc[0])
    if deal >= 2 * deals:
        return pdf.assign(deal=deal - 2 * deals, kind=3).rename(columns={"size": "gram"})[["deal", "kind", "doc", "mark", "pos", "gram"]]
    doc, mark = _values(pdf.doc, np.int64), _values(pdf["mark"], np.uint32)
    pos, size = _values(pdf.pos, np.uint32).astype(np.int64), _values(pdf["size"], np.uint32).astype(np.int64)
    data = np.frombuffer(b"".join(pdf.text) + bytes(8), np.uint8)
    own, off = _window_starts(pos, size, length)
    at = np.r_[0, np.cumsum(size)[:-1]][own] + off
    order, group = deep_shallow(data, at, length)
    least = np.full(len(order), LAST)
    np.minimum.at(least, group, doc[own[order]])
    hit = order[doc[own[order]] > least[group]]
    hit = np.sort(hit)
    # windows of one text that follow each other are one run
    o, p = own[hit], pos[own[hit]] + off[hit]
    new = np.r_[True, (o[1:] != o[:-1]) | (p[1:] != p[:-1] + 1)][: len(o)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(o)] - 1
    d, m = doc[o[first]], mark[o[first]]
    columns = {"doc": d, "mark": m, "pos": p[first].astype(np.uint32), "gram": (p[last] - p[first] + length).astype(np.uint32)}
    return _deals(_doc_deal(d, m, deals), columns).assign(kind=3)[["deal", "kind", "doc", "mark", "pos", "gram"]]


def _remove(docs: pd.DataFrame, marks: pd.DataFrame, length: int, with_text: bool) -> pd.DataFrame:
    k = length // 2 - 1
    rows = _Rows(docs)
    step = np.zeros(len(rows.data) + 1, np.int64)
    for kind, part in marks.groupby("kind"):
        doc, mark, pos = _values(part.doc, np.int64), _values(part["mark"], np.uint32), _values(part.pos, np.uint32).astype(np.int64)
        row = rows.find(doc, mark)
        base = rows.offsets[row]
        if kind == 0:
            start = base + np.maximum(pos - (length - k), 0)
            stop = np.minimum(base + pos + length, rows.offsets[row + 1])
        else:
            start = base + pos
            stop = start + _values(part.gram, np.uint32)
        np.add.at(step, start, 1)
        np.add.at(step, stop, -1)
    gone = np.cumsum(step[:-1]) > 0
    out = []
    for i, body in enumerate(docs.body):
        a, b = rows.offsets[i], rows.offsets[i + 1]
        g = gone[a:b]
        if not g.any():
            # a row that repeats another's id and text has its marks on one of them
            j = rows.find(rows.id[i : i + 1], rows.mark[i : i + 1])[0]
            g = gone[rows.offsets[j] : rows.offsets[j + 1]]
        kept = rows.data[a:b][~g].tobytes() if g.any() else body
        spans = int((g & ~np.r_[False, g[:-1]]).sum()) if len(g) else 0
        out.append((len(body), int(g.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
    frame = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    frame.insert(0, "doc_id", docs.doc_id.to_numpy(np.int64))
    return frame


def dedup(docs: DataFrame, length: int = LENGTH, deal_bytes: int = DEAL_BYTES, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row, and kept
    (the remaining bytes) if ``with_text``.

    Null and empty texts have 0 bytes. A null doc_id is larger than every
    other. Rows that repeat a doc_id don't count against each other. Texts
    shorter than ``length`` lose nothing; very long ones are one row, as they
    are in the table. Other columns are ignored; empty tables give no rows."""
    assert length >= 8
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("doc_id"), raw().alias("body"))
    total = docs.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))).first()[0] or 0
    deals = max(8, -(-total // deal_bytes))

    @F.arrow_udf("struct<mark long, deal long>")
    def placed(doc: pa.Array, body: pa.Array) -> pa.Array:
        mark = [(Spans(data).hash(o[:-1], o[1:]) >> _U(32)) for _, _, data, o in byte_views(body)]
        mark = np.concatenate(mark) if mark else np.zeros(0, _U)
        deal = _doc_deal(doc.to_numpy(zero_copy_only=False), mark, deals)
        return pa.StructArray.from_arrays([pa.array(mark.view(np.int64)), pa.array(deal)], names=["mark", "deal"])

    dealt = rows.withColumn("p", placed("doc_id", "body")).select(F.col("p.deal").alias("deal"), "doc_id", "body", F.col("p.mark").alias("mark"))
    found = rows.mapInArrow(lambda b: _anchor_rows(b, length, deals), _ANCHORS_DDL)
    marks = cut(found.groupBy("deal").applyInPandas(lambda p: _settle(p, deals, hot), _MARKS_DDL))

    def fetch(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({c: pd.Series(dtype="object") for c in ("deal", "doc", "mark", "pos", "size", "text")})
        return _fetch(left, right, length, deals)

    def remove(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _remove(left, right, length, with_text)

    texts = dealt.groupBy("deal").cogroup(marks.where("kind in (1, 2)").groupBy("deal")).applyInPandas(fetch, _TEXTS_DDL)
    more = texts.groupBy("deal").applyInPandas(lambda p: _sort_deal(p, length, deals), _MARKS_DDL)
    every = marks.where("kind = 0").union(more)
    out = dealt.groupBy("deal").cogroup(every.groupBy("deal")).applyInPandas(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    out = out.withColumn("doc_id", F.when(F.col("doc_id") != int(LAST), F.col("doc_id")))
    return out if with_text else out.drop("kept")
