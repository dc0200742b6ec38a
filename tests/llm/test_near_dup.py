import numpy as np

from bomspark.llm import minhash
from bomspark.llm.common import components


def brute(rows):
    import re

    sets = {}
    for i, t in rows:
        w = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def chain(prose):
    """Texts of which each is near the next, but not the first near the last."""
    words = prose(1, 200).split()
    out = []
    for k in range(12):
        words[k * 16 : k * 16 + 3] = prose(100 + k, 3).split()
        out.append(" ".join(words))
    return out


def test_classes_match_brute_force(docs, prose):
    rows = [(i, t) for i, t in enumerate([*(prose(s) for s in range(30)), *chain(prose)])]
    rows += [(100, None), (101, ""), (102, "!!"), (103, "one two"), (104, "One, two."), (105, rows[3][1].upper()), (106, rows[3][1]), (107, prose(9, 3000)), (108, prose(9, 3000) + " end")]
    got = {r.doc_id: r.class_id for r in minhash.classes(docs(rows)).collect()}
    assert got == brute(rows)
    assert got[104] == 103 and got[106] == 3 and got[101] == 101


def test_keep_first_and_edges(docs, prose):
    rows = [(5, prose(1)), (3, prose(1)), (7, prose(2)), (7, prose(2)), (None, prose(1)), (8, None), (9, "")]
    table = docs(rows)
    kept = minhash.keep_first(table)
    assert kept.columns == table.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 3), (False, 7), (False, 8), (False, 9), (True, 0)]
    assert minhash.classes(docs([]).limit(0)).count() == 0


def test_large_group_and_repeated_ids(docs, prose):
    base = prose(4, 120).split()
    rows = []
    for i in range(300):
        w = list(base)
        w[i % 120] = f"v{i}"
        rows.append((i, " ".join(w)))
    rows.append((0, prose(77)))
    rows.append((400, prose(77)))
    got = {r.doc_id: r.class_id for r in minhash.classes(docs(rows)).collect()}
    assert set(got.values()) == {0}


def test_unequal_repetition_keeps_pairs(docs, prose):
    rows = []
    for k in range(60):
        shared, line = prose(1000 + k, 104), prose(3000 + k, 5)
        # a line of its own in each text, repeated; and a text whose half is repeated against the plain one
        rows += [(4 * k + i, shared + f" {line} {own}" + f" {line} {own}" * n) for i, own, n in ((0, "left", 200), (1, "right", 0))]
        half = prose(5000 + k, 60)
        rows += [(4 * k + 2, f"{prose(7000 + k, 60)} {half}"), (4 * k + 3, f"{prose(7000 + k, 60)} " + f"{half} " * 100)]
    got = {r.doc_id: r.class_id for r in minhash.classes(docs(rows)).collect()}
    assert got == brute(rows)


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(3)
    el = rng.integers(1, 2**63, 120, dtype=np.uint64)
    wa, wb = np.r_[np.full(80, 1.0), np.full(40, 3.0)], np.full(120, 1.0)
    m = 4096
    sig = minhash.registers(np.r_[np.zeros(120, int), np.ones(120, int)], np.r_[el, el], np.r_[wa, wb], 2, m)
    want = sum(1 / np.maximum(wa / wa[i], wb / wb[i]).sum() for i in range(120))
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * (want * (1 - want) / m) ** 0.5


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components(edges.limit(0)).count() == 0
