"""Personal data by rules and a skip-chain conditional random field.

Rules give the base spans of four kinds. The field's nodes are the tokens of a
document that hold a digit or an at sign, labelled with a kind or as other.
Chain edges join neighbouring tokens; skip edges join each token to the next
one that is equal or similar, however far away, so that repeated and kindred
entities share potentials. Equal means the same letters and digits; similar the
same domain (behind an at sign) or the same digits but for the last block. A token has one edge of either sort at most to each side, so
edges grow with the tokens, whatever repeats. All potentials are indicator weights in closed form (label
given shape; log odds of label pairs on either sort of edge), counted over the
whole corpus with the base spans as labels. Loopy sum-product messages give the
marginals; tokens that they label with a kind become further spans.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
N_LABELS = OTHER + 1
#: Token shapes are hashed to so many classes, which bounds the model.
N_SHAPES = 4096
ROUNDS, DAMPING = 20, 0.5
MIN_PROBABILITY = 0.5
#: Pseudo-counts of the potentials.
SMOOTH = 0.5

# An address's local part is what stands before the at sign, up to the last match; see base_spans.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_RUN = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)
_DIGITS = re.compile(r"[0-9]+")
_EDGE = "()[]{}<>\"'.,;:!?|*%#&$"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    out, last = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((0, start, m.end()))
                last = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def shape(token: str) -> int:
    """Class of a token: its runs of digits (by length), letters and marks, over all of it."""
    runs = []
    for m in _RUN.finditer(token):
        x = m[0]
        if x[0].isdigit() and x.isascii():
            runs.append(f"9{len(x)}")
        elif x[0].isalpha():
            runs.append("a")
        elif not runs or runs[-1] != x:
            runs.append(x)
    return zlib.crc32(" ".join(runs).encode()) % N_SHAPES


def likeness(token: str, form: int) -> tuple[int, str] | None:
    """What similar tokens share: the domain of an address, the blocks of a
    number but for its last one, or the form of a single block and its digits
    but for the last four. None where too little (under three digits, no
    domain) would be shared."""
    if "@" in token:
        domain = token.rsplit("@", 1)[1].lower().strip(".")
        return (-1, domain) if domain else None
    blocks = _DIGITS.findall(token)
    if len(blocks) > 1:
        return (-len(blocks), ".".join(blocks[:-1])) if sum(map(len, blocks[:-1])) >= 3 else None
    shared = blocks[0][:-4] if blocks else ""
    return (form, shared) if len(shared) >= 3 else None


class Graph:
    """Nodes and edges of the fields of some documents."""

    def __init__(self, texts: list[str | None]):
        self.base: list[list[tuple[int, int, int]]] = []
        self.doc, self.start, self.end, self.shape, self.label = [], [], [], [], []
        chain, skip = [], []
        for d, text in enumerate(texts):
            if not text or not _ANY.search(text):
                self.base.append([])
                continue
            spans = base_spans(text)
            self.base.append(spans)
            by_start = sorted((a, b, k) for k, a, b in spans)
            seen: dict[str, int] = {}
            alike: dict[tuple[int, str], int] = {}
            at, before, order = 0, -1, -2
            for number, m in enumerate(_TOKEN.finditer(text)):
                token = m[0]
                if not _ANY.search(token):
                    continue
                core = token.strip(_EDGE)
                if not core or not _ANY.search(core):
                    core, lead = token, 0
                else:
                    lead = token.index(core)
                a = m.start() + lead
                b = a + len(core)
                while at < len(by_start) and by_start[at][1] <= a:
                    at += 1
                kinds, i = [], at
                while i < len(by_start) and by_start[i][0] < b:
                    if by_start[i][1] > a:
                        kinds.append(by_start[i][2])
                    i += 1
                me = len(self.doc)
                self.doc.append(d)
                self.start.append(a)
                self.end.append(b)
                form = shape(core)
                self.shape.append(form)
                self.label.append(min(kinds, default=OTHER))
                if order == number - 1:
                    chain.append((before, me))
                before, order = me, number
                key = "".join(c for c in core.lower() if c.isalnum())
                if key:
                    if key in seen and (seen[key], me) not in chain[-1:]:
                        skip.append((seen[key], me))
                    like = likeness(core, form)
                    if like:
                        other = alike.get(like)
                        # an equal token has its edge already
                        if other is not None and other != seen.get(key) and (other, me) not in chain[-1:]:
                            skip.append((other, me))
                        alike[like] = me
                    seen[key] = me
        self.edges = np.array([*chain, *skip], np.int64).reshape(-1, 2)
        self.kind = np.r_[np.zeros(len(chain), int), np.ones(len(skip), int)]
        self.label = np.array(self.label, np.int64)
        self.shape = np.array(self.shape, np.int64)

    def counts(self) -> np.ndarray:
        """Shape x label, then the two label x label tables, as one vector."""
        unary = np.bincount(self.shape * N_LABELS + self.label, minlength=N_SHAPES * N_LABELS)
        a, b = self.label[self.edges[:, 0]], self.label[self.edges[:, 1]]
        pair = np.bincount((self.kind * N_LABELS + a) * N_LABELS + b, minlength=2 * N_LABELS**2)
        return np.r_[unary, pair]


class Field:
    """Log potentials from the counts."""

    def __init__(self, counts: np.ndarray):
        unary = counts[: N_SHAPES * N_LABELS].reshape(N_SHAPES, N_LABELS).astype(float)
        prior = unary.sum(0) + SMOOTH
        unary += SMOOTH * prior / prior.sum()
        self.unary = np.log(unary / unary.sum(1, keepdims=True))
        self.pair = np.zeros((2, N_LABELS, N_LABELS))
        for kind, table in enumerate(counts[N_SHAPES * N_LABELS :].reshape(2, N_LABELS, N_LABELS).astype(float)):
            if kind:
                table = table + table.T  # repetition has no direction
            table = table + SMOOTH
            p = table / table.sum()
            self.pair[kind] = np.log(p) - np.log(p.sum(1, keepdims=True)) - np.log(p.sum(0, keepdims=True))

    def marginals(self, shapes: np.ndarray, edges: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Label probabilities of each node by damped loopy messages; exact where there are no loops."""
        n, e = len(shapes), len(edges)
        unary = self.unary[shapes]
        src, dst = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
        table = np.concatenate([self.pair[kind], self.pair[kind].transpose(0, 2, 1)])
        back = np.r_[np.arange(e) + e, np.arange(e)]
        message = np.zeros((2 * e, N_LABELS))
        belief = unary
        for _ in range(ROUNDS if e else 0):
            x = (belief[src] - message[back])[:, :, None] + table
            top = x.max(1)
            new = top + np.log(np.exp(x - top[:, None, :]).sum(1))
            new -= new.max(1, keepdims=True)
            moved = np.abs(new - message).max()
            message = DAMPING * message + (1 - DAMPING) * new
            belief = unary.copy()
            np.add.at(belief, dst, message)
            if moved < 1e-4:
                break
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True) if n else p


def fit(docs: DataFrame, text: str = "text") -> Field:
    """Potentials counted over every document, one bounded vector a task."""
    size = N_SHAPES * N_LABELS + 2 * N_LABELS**2

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                total += Graph(batch.column(0).slice(lo, 512).to_pylist()).counts()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": at, "n": total[at]})

    out = np.zeros(size, np.int64)
    for at, n in docs.select(text).mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n")).collect():
        out[at] = n  # at most ``size`` rows
    return Field(out)


def found_spans(texts: list[str | None], field: Field) -> list[tuple[list, list]]:
    """For each text its base spans and all spans, by kind, then start. A
    token that a base span touches adds nothing; neighbouring tokens of one
    kind are one span."""
    g = Graph(texts)
    p = field.marginals(g.shape, g.edges, g.kind)
    out = [(b, list(b)) for b in g.base]
    if not len(p):
        return out
    best = p.argmax(1)
    more = np.flatnonzero((best != OTHER) & (p.max(1) >= MIN_PROBABILITY) & (g.label == OTHER))
    joined = {(int(a), int(b)) for (a, b), k in zip(g.edges, g.kind, strict=True) if k == 0}
    last = None
    for i in more.tolist():
        spans = out[g.doc[i]][1]
        if last is not None and (last, i) in joined and best[last] == best[i]:
            k, s, _ = spans.pop()
            spans.append((k, s, g.end[i]))
        else:
            spans.append((int(best[i]), g.start[i], g.end[i]))
        last = i
    return [(b, sorted(a)) for b, a in out]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, base counts by kind, base_sha256 and spans for every row.

    Null and empty texts have no spans (the digest of the empty string, empty
    spans). Texts of any length are one field; very long tokens are read to
    their end. Rows that repeat get equal results; other columns are ignored;
    empty tables give no rows. Offsets are code points."""
    share = docs.sparkSession.sparkContext.broadcast(field or fit(docs))

    def run(batches):
        for batch in batches:
            counts, digests, texts = [], [], []
            for lo in range(0, batch.num_rows, 512):
                for base, every in found_spans(batch.column("text").slice(lo, 512).to_pylist(), share.value):
                    counts.append([sum(k == kind for k, _, _ in base) for kind in range(OTHER)])
                    digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                    texts.append(_joined(every))
            n = np.array(counts, np.int64).reshape(-1, OTHER)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(n[:, k]) for k in range(OTHER)), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in brackets,
    and n_chars, where it is there, set to the new length. Null texts stay null."""
    share = docs.sparkSession.sparkContext.broadcast(field or fit(docs))

    @F.arrow_udf("string")
    def masked(column: pa.Array) -> pa.Array:
        out = []
        for lo in range(0, len(column), 512):
            texts = column.slice(lo, 512).to_pylist()
            for text, (_, spans) in zip(texts, found_spans(texts, share.value), strict=True):
                end, parts = 0, []
                for a, b, k in sorted((a, b, k) for k, a, b in spans):
                    if a >= end:
                        parts += [text[end:a], f"[{KINDS[k].upper()}]"]
                    end = max(end, b)
                out.append("".join([*parts, text[end:]]) if parts else text)
        return pa.array(out, pa.string())

    names = docs.columns
    out = docs.withColumn("text", masked("text"))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*names)
