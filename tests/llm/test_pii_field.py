"""The field of op6 against plain versions: edges by definition, messages one by one, added spans of whole texts."""

import math
import random

import numpy as np

from bomspark.llm import pii

WORDS = ["10.0.0.1", "10.0.0.2", "a@b.org", "c@b.org", "d@e.org", "4111111111111111", "4111111111111112", "+49 30 123456", "word", "x9", "2024-01-02", "2024-01-03", "(10.0.0.1)"]


def texts(n, seed=3):
    r = random.Random(seed)
    return [" ".join(r.choices(WORDS, k=r.randrange(25))) for _ in range(n)] + [None, "", "no numbers here"]


def plain_tokens(text):
    """(core, start, number of the word) of each token that is a node."""
    out = []
    for number, m in enumerate(pii._TOKEN.finditer(text or "")):
        core = m[0].strip(pii._EDGE)
        core = core if pii._ANY.search(core) else m[0]
        if pii._ANY.search(core):
            out.append((core, m.start() + m[0].index(core), number))
    return out


def plain_edges(text):
    nodes = plain_tokens(text)
    chain = {(i - 1, i) for i in range(1, len(nodes)) if nodes[i][2] == nodes[i - 1][2] + 1}
    key = lambda core: "".join(c for c in core.lower() if c.isalnum())
    like = lambda core: pii.likeness(core, pii.shape(core))
    skip = set()
    for i, (core, *_) in enumerate(nodes):
        for same in (key, like):
            earlier = [j for j in range(i) if same(core) and same(nodes[j][0]) == same(core)]
            if earlier and (earlier[-1], i) not in chain:
                skip.add((earlier[-1], i))
    return chain, skip


def test_edges_are_those_of_the_definition():
    for text in texts(200):
        g = pii.Graph([text])
        chain, skip = plain_edges(text)
        got = [(int(a), int(b), int(k)) for (a, b), k in zip(g.edges, g.kind, strict=True)]
        assert sorted(got) == sorted([(*e, 0) for e in chain] + [(*e, 1) for e in skip]), text


def test_similar_tokens_are_joined_and_edges_stay_linear():
    g = pii.Graph(["see 10.0.0.1 and then 10.0.0.2 then"])
    assert g.edges.tolist() == [[0, 1]] and g.kind.tolist() == [1]
    assert len(pii.Graph(["10.0.0.1 and " * 5000]).edges) == 4999
    assert len(pii.Graph([" and ".join(f"10.0.0.{i}" for i in range(200))]).edges) == 199


def test_tokens_are_read_to_their_end():
    same = "a1-" * 40
    assert pii.shape(same + "77") != pii.shape(same + "777") and pii.shape("9" * 30) != pii.shape("9" * 31)
    # the fifth span that a token overlaps labels it too
    text = ",".join(["x@y.org"] * 5)
    assert pii.Graph([text]).label.tolist() == [0]
    assert pii.likeness("7" * 2_000_000, 1) is not None and pii.shape("7a" * 500_000) >= 0


def plain_marginals(field, shapes, edges, kind):
    """The same messages, one edge and label at a time, in logarithms."""
    n, labels = len(shapes), range(pii.N_LABELS)
    links = [(int(a), int(b), field.pair[k]) for (a, b), k in zip(edges, kind, strict=True)]
    links += [(b, a, t.T) for a, b, t in links]
    half = len(links) // 2
    message = [[0.0] * pii.N_LABELS for _ in links]
    belief = [list(field.unary[s]) for s in shapes]
    for _ in range(pii.ROUNDS if links else 0):
        fresh = []
        for e, (a, b, table) in enumerate(links):
            back = message[(e + half) % len(links)]
            out = [math.log(sum(math.exp(belief[a][i] - back[i] + table[i, j]) for i in labels)) for j in labels]
            fresh.append([x - max(out) for x in out])
        moved = max(abs(x - y) for f, m in zip(fresh, message, strict=True) for x, y in zip(f, m, strict=True))
        message = [[pii.DAMPING * y + (1 - pii.DAMPING) * x for x, y in zip(f, m, strict=True)] for f, m in zip(fresh, message, strict=True)]
        belief = [list(field.unary[s]) for s in shapes]
        for (_, b, _), m in zip(links, message, strict=True):
            belief[b] = [x + y for x, y in zip(belief[b], m, strict=True)]
        if moved < 1e-4:
            break
    out = [[math.exp(x - max(b)) for x in b] for b in belief]
    return np.array([[x / sum(p) for x in p] for p in out]).reshape(n, pii.N_LABELS)


def test_whole_documents_against_single_messages(spark):
    rows = [(i, t) for i, t in enumerate(texts(60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    field = pii.fit(docs)
    assert np.allclose(field.pair[0], pii.Field(pii.Graph([t for _, t in rows]).counts()).pair[0])
    got = {r.doc_id: r.spans for r in pii.detect(docs, field).collect()}
    added = 0
    for i, text in rows:
        g = pii.Graph([text])
        p = plain_marginals(field, g.shape, g.edges, g.kind) if len(g.shape) else np.zeros((0, pii.N_LABELS))
        assert np.allclose(p, field.marginals(g.shape, g.edges, g.kind), atol=1e-9)
        spans, last = list(g.base[0]), None
        for node in range(len(p)):
            best = int(p[node].argmax())
            if g.label[node] == pii.OTHER and best != pii.OTHER and p[node].max() >= pii.MIN_PROBABILITY:
                if last is not None and (last, node) in plain_edges(text)[0] and spans[-1][0] == best:
                    spans[-1] = (best, spans[-1][1], g.end[node])
                else:
                    spans.append((best, g.start[node], g.end[node]))
                last = node
                added += 1
        assert got[i] == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans)), text
    assert added > 0
