import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bomspark.llm import fingerprints, merkle, trie


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- merkle


def encoded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_manifest(rows, fanout):
    def leaf(r, more=0):
        return sha("".join(encoded(v) for v in (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
        return out

    def steps(tree, at):
        for level in tree[:-1]:
            first = at - at % fanout
            yield level[first:at], level[at + 1 : first + fanout]
            at //= fanout

    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for rs in by.values():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [levels([leaf(r) for r in by[x]]) for x in names]
    top = levels([t[-1][0] for t in trees])
    for i, x in enumerate(names):
        for j, r in enumerate(by[x]):
            path = [*steps(trees[i], j), *steps(top, i)]
            at = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0)
            for left, right in path:
                at = sha("".join([*left, at, *right]))
            yield (r[0], leaf(r), trees[i][-1][0], top[-1][0], sha("".join(h for a, b in path for h in a + b)), at, at == top[-1][0])


DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("fanout", [2, 3])
def test_manifest_against_plain_trees(spark, fanout):
    rng = random.Random(fanout)
    rows = [(i, rng.choice(["", "a", "ü" * 9, None]), rng.choice(["en", "de", None, "zz"]), rng.choice(["s", None]), rng.choice([3, None])) for i in range(61)]
    rows += [(None, "x", "en", "s", 1), (7, "again", "en", "s", 2), (7, "again", "en", "s", 2), (999, "y" * 200_000, "one", None, 5)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], DOC + ", idx string")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    got = [tuple(r) for r in merkle.manifest(df, fanout, tampered).collect()]
    assert sorted(got, key=str) == sorted(plain_manifest(rows, fanout), key=str)


def test_manifest_of_nothing_and_of_one(spark):
    assert merkle.manifest(spark.createDataFrame([], DOC)).count() == 0
    row = merkle.manifest(spark.createDataFrame([(1, "t", "en", "s", 1)], DOC)).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified and row.proof_sha256 == sha("")


# --- trie


def plain_trie(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns.setdefault(c, []).append(((turn is not None, turn or 0), role, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), text))
    seq = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c, own in seq.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(seq.get(c - c % 20, [])[:h] + own[h:])
    members, kids = {}, {}
    for c, q in whole.items():
        for d in range(len(q) + 1):
            members.setdefault(q[:d], []).append(c)
    for q in members:
        if q:
            kids.setdefault(q[:-1], []).append(q)
    leaves, saved = {}, {}
    for q in sorted(members, key=len, reverse=True):
        below = kids.get(q, [])
        leaves[q] = sum(leaves[x] for x in below) or 1
        saved[q] = (len(members[q]) - 1) * (len(re.findall("[^\x20\x09-\x0d]+", q[-1][1])) if q else 0) + sum(saved[x] for x in below)
    for q, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(q))))
        yield (min(m), len(q), min(members[q[:-1]]) if q else None, len(m), len(kids.get(q, [])), leaves[q], saved[q], sha(ends))


TURN = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("cells", "hot"), [(1, False), (9, True), (40, False), (trie.CELLS, True)])
def test_trie_against_plain_prefixes(spark, cells, hot):
    rng = random.Random(cells + hot)
    rows = []
    for c in range(240):
        if hot and c % 3:
            rows += [(c, t, "u", f"the same {t}") for t in range(4)]  # one conversation of very many ids
            continue
        for t in range(rng.choice([0, 1, 1, 2, 3, 4, 5, 9, 30])):
            rows.append((c if rng.random() > 0.02 else None, rng.choice([None, t, t, t]), rng.choice(["u", "a", None]) if t > 2 else "u", rng.choice(["", "x y", "x\x1cz", "a\tb c", None])))
    rows += [(500, 1, "u", "same"), (500, 1, "u", "same"), (501, 0, "u", "long " * 50_000)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], TURN + ", depth int, key string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several shards
    try:
        got = [tuple(r) for r in trie.trie(df, cells=cells).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(got, key=str) == sorted(plain_trie(rows), key=str)


def test_trie_of_nothing(spark):
    assert trie.trie(spark.createDataFrame([], TURN)).count() == 0


# --- fingerprints


def weights(text):
    counts = Counter(w for w in re.split(r"[\x00-/:-@\[-`{-\x7F]+", text.lower()) if w) or Counter([text])
    return {w: 1 + math.log(n) for w, n in counts.items()}


def jaccard(a, b):
    keys = set(a) | set(b)
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)


def test_collision_rate_is_the_generalised_jaccard(spark, prose):
    texts = [prose(i, 80) for i in range(12)]
    texts += [" ".join([texts[0]] * 3 + [prose(90, 40)]), texts[0] + " " + texts[1], texts[1][: len(texts[1]) // 2]]
    sig = {r.i: r.signature for r in fingerprints.signatures(spark.createDataFrame(list(enumerate(texts)), "i long, body string"), ["i"], "body", 400).collect()}
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            expected = jaccard(weights(a), weights(b))
            agree = sum(x == y for x, y in zip(sig[i], sig[j], strict=True)) / 400
            assert abs(agree - expected) < 4.5 * math.sqrt(max(expected * (1 - expected), 0.01) / 400), (i, j, agree, expected)


def test_compare_edits_and_successors(docs, prose):
    rows = [(i * 3, prose(i, 5 + i)) for i in range(40)] + [(None, "null id"), (200, None), (201, ""), (202, "€😀€😀€ é"), (203, "!!!"), (204, "word " * 60_000)]
    rows += [(150, prose(50)), (150, prose(51)), (151, prose(60)), (152, prose(60)), (300, "tail")]
    got = fingerprints.compare(docs(rows)).collect()
    assert len(got) == len(rows)
    ids = [r[0] for r in rows]
    order = sorted((r for r in rows if ids.count(r[0]) == 1), key=lambda r: (r[0] is not None, r[0] or 0))
    by = {r.doc_id: r for r in got if ids.count(r.doc_id) == 1}
    for at, (i, text) in enumerate(order):
        after = order[(at + 1) % len(order)]
        if i == 117:  # next to the repeated id
            continue
        text, after = text or "", after[1] or ""
        quarter = len(text) // 4
        assert by[i].n_chars == len(text)
        assert by[i].edited_sha256 == sha(text[: len(text) - quarter] + after[:quarter]), i
    assert by[151].near_next == 1 and by[151].fingerprint == by[152].fingerprint and by[151].near_edited > 0.3
    assert by[200].near_next == 1 and by[202].near_next == 0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_compare_small_tables(docs):
    assert fingerprints.compare(docs([])).count() == 0
    row = fingerprints.compare(docs([(1, "alone with itself")])).first()
    assert row.near_next == 1 and row.edited_sha256 == sha("alone with it" + "alon"), row
    # one id for all rows, spread over buckets by the text's hash
    same = fingerprints.compare(docs([(9, f"text {i}") for i in range(60)])).collect()
    assert len(same) == 60
