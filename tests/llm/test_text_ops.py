import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from bomspark.llm import decontaminate, licenses, packing, pii, quality, substrings


# -- licences

def test_license_units(docs):
    mit = dict((t.name, t.text) for t in licenses.STANDARD)["mit-text"]
    rows = [
        "prose first\nLicensed under CC BY-NC 4.0.\nmore prose of no licence at all",
        "Header\n\n" + mit.replace("copyright", "COPYRIGHT") + "\n\nFooter",
        mit,
        "RELEASED under the (MIT) licence -- MIT License.",
        None,
        "",
        "word " * 5000,
        "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.",
    ]
    got = {r.doc_id: r for r in licenses.scan(docs(rows)).collect()}
    assert got[0].license == "CC-BY-NC-4.0" and got[0].dice == 1 and got[0].n_units == 1
    assert got[1].license == "MIT" and got[2].template == "mit-text" and got[2].dice == 1
    assert got[4].license is None and got[5].licenses == "" and got[6].n_units == 0
    assert got[7].licenses == "Apache-2.0,MIT"
    assert licenses.scan(docs([]).limit(0)).count() == 0


def test_license_bounds_lose_nothing():
    for t in licenses.STANDARD:
        n = len(t.bigrams)
        lo, hi = t.bounds(0.8)
        assert all((2 * min(n, m) / (n + m) >= 0.8) <= (lo <= m <= hi) for m in range(1, 3 * n))


# -- repeated substrings

def removed(rows, length):
    first = {}
    for i, x in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        i = 2**62 if i is None else i
        for p in range(len(x) - length + 1):
            first.setdefault(x[p : p + length], i)
    out = []
    for i, x in rows:
        k = 2**62 if i is None else i
        gone = bytearray(len(x))
        for p in range(len(x) - length + 1):
            if first[x[p : p + length]] < k:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(x, gone) if not g)
        out.append((i, len(x), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def key(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("options", [{}, {"hot": 0, "deal_bytes": 500}])
def test_substrings_match_brute_force(docs, prose, options):
    rng = random.Random(5)
    shared = prose(1, 30)
    texts = []
    for i in range(40):
        t = prose(i + 10, 25)
        if i % 3 == 0:
            t = t[: rng.randrange(80)] + shared[rng.randrange(60) :] + t[80:]
        texts.append(t)
    rows = [*enumerate(texts), (90, texts[3]), (91, texts[3][:49]), (92, texts[3][:50]), (93, "é" * 60), (94, "x" + "é" * 60), (95, ""), (96, None), (97, "a" * 300), (98, "a" * 51), (None, texts[5]), (None, texts[6] + "tail"), (99, texts[7]), (99, texts[7]), (99, texts[8] + "tail")]
    got = [tuple(r) for r in substrings.dedup(docs(rows), **options).collect()]
    assert key(got) == key(removed([(i, (t or "").encode()) for i, t in rows], 50))


def test_deep_shallow_orders_suffixes():
    rng = np.random.default_rng(2)
    data = np.r_[rng.integers(97, 99, 400), np.tile(rng.integers(97, 122, 70), 4), np.full(90, 97), np.zeros(8, int)].astype(np.uint8)
    start = rng.permutation(len(data) - 58)
    order, group = substrings.deep_shallow(data, start, 50)
    keys = [data[s : s + 50].tobytes() for s in start[order]]
    assert keys == sorted(keys)
    assert all((group[i] == group[i - 1]) == (keys[i] == keys[i - 1]) for i in range(1, len(keys)))


def test_substrings_kept_text_and_empty(docs, prose):
    t = prose(1, 40)
    got = {r.doc_id: r.kept for r in substrings.dedup(docs([(1, t), (2, "new start " + t)]), with_text=True).collect()}
    assert bytes(got[1]).decode() == t and bytes(got[2]) == b"new start"[:9] or bytes(got[2]).startswith(b"new start")
    assert substrings.dedup(docs([]).limit(0)).count() == 0


# -- personal data

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = (True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 16 <= len(d) <= 19 and pii.luhn(d), 8 <= len(d) <= 15)[k]
            out += [(k, m.start(), m.end())] * ok
    return out


def test_base_spans_match_the_patterns():
    rng = random.Random(8)
    alphabet = ["@", ".", "-", "+", " ", "(", ")", "a", "b.c", "7", "42", "255", "4111111111111111", "é", "_", "%", "1.2.3.4", "@x.y"]
    for _ in range(4000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 25)))
        assert pii.base_spans(t) == plain_spans(t), t


def test_long_runs_stay_linear():
    assert pii.base_spans("9" * 300_000 + " " + "a" * 300_000 + "@" * 1000) == []


def test_field_labels_repeated_entities(docs):
    rows = [f"write to user{i}@mail.example.org or call +49 (030) 1234{i:03d}" for i in range(60)]
    rows += ["plain words", None, "", "user5@mail.example.org wrote; again user5@mail.example.org", "card 4111 1111 1111 1111"]
    field = pii.fit(docs(rows))
    got = {r.doc_id: r for r in pii.detect(docs(rows), field).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        base = plain_spans(t or "")
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(got[i].spans.split(","))
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(k == j for k, _, _ in base) for j in range(4)]


def test_messages_are_exact_on_trees_and_use_skips():
    counts = np.zeros(pii.N_SHAPES * pii.N_LABELS + 2 * pii.N_LABELS**2, np.int64)
    rng = np.random.default_rng(1)
    counts[:: 7] = rng.integers(0, 9, len(counts[::7]))
    counts[-50:] = rng.integers(1, 30, 50)
    field = pii.Field(counts)
    shapes, edges, kind = np.array([3, 9, 30]), np.array([[0, 1], [1, 2]]), np.array([0, 1])
    joint = field.unary[shapes[0]][:, None, None] + field.unary[shapes[1]][None, :, None] + field.unary[shapes[2]][None, None, :]
    joint = np.exp(joint + field.pair[0][:, :, None] + field.pair[1][None, :, :])
    want = joint.sum((1, 2)) / joint.sum()
    assert np.allclose(field.marginals(shapes, edges, kind)[0], want, atol=1e-3)


def test_redact_keeps_columns(docs):
    table = docs(["mail a.b@c.de now", None, "nothing"])
    got = {r.doc_id: r for r in pii.redact(table).collect()}
    assert pii.redact(table).columns == table.columns
    assert got[0].text == "mail [EMAIL] now" and got[1].text is None and got[2].text == "nothing"
    assert pii.detect(docs([]).limit(0)).count() == 0


# -- benchmark

def test_decontaminate_finds_copies_and_paraphrases(spark, docs, prose):
    items = [(i, prose(500 + i, 20 + i).capitalize() + ". " + prose(700 + i, 8) + ".") for i in range(25)] + [(90, None), (91, ""), (92, "two words")]
    table = spark.createDataFrame(items, "item_id long, text string")
    rows, want = [], {}
    for i in range(40):
        rows.append((i, prose(i, 150)))
    for i in range(25):
        words = items[i][1].split()
        words[4] = "other"
        words[9] = "changed"
        rows.append((100 + i, prose(40 + i, 70) + "\n" + items[i][1].upper() + "\n" + prose(80 + i, 40)))
        rows.append((200 + i, prose(40 + i, 33) + " " + " ".join(words) + " " + prose(80 + i, 40)))
        want[100 + i] = want[200 + i] = i
    rows += [(300, None), (301, ""), (302, items[0][1]), (302, items[0][1])]
    got = {r.doc_id: r for r in decontaminate.report(docs(rows), table).collect()}
    for i, item in want.items():
        assert got[i].contaminated and got[i].item_id == item, i
    assert not any(got[i].contaminated for i in range(40)) and not got[300].contaminated and not got[301].contaminated
    kept = decontaminate.keep_clean(docs(rows), table)
    assert {r.doc_id for r in kept.collect()} == {*range(40), 300, 301}
    assert decontaminate.report(docs([]).limit(0), table).count() == 0
    assert not decontaminate.report(docs(["a text"]), table.limit(0)).first().contaminated


def test_common_length_is_the_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(200):
        a, b = [rng.randrange(6) for _ in range(rng.randrange(1, 20))], [rng.randrange(6) for _ in range(rng.randrange(20))]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert decontaminate.common_length(decontaminate.masks_of(np.array(a)), len(a), b) == best[-1][-1]


def test_randomised_svd_finds_the_leading_vectors(spark):
    rng = np.random.default_rng(6)
    a = rng.standard_normal((40, 6)) @ rng.standard_normal((6, 30))
    rows = spark.createDataFrame([(list(range(30)), [float(x) for x in r]) for r in a], "idx array<int>, val array<double>")
    v = decontaminate.randomised_svd(rows, 30, rank=6)
    assert np.allclose(np.linalg.norm(a @ v), np.linalg.norm(a), rtol=1e-6)


# -- packing

def test_packing_covers_every_token(docs, prose):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [(i, prose(i, n)) for i, n in enumerate([3, 40, 700, 1500, 20, 333, 90, 90, 90])] + [(50, None), (51, ""), (52, "x <|endoftext|> y"), (53, "ünï 日本"), (None, "no id"), (54, prose(1, 30)), (54, prose(1, 30))]
    got = packing.pack(docs(rows)).toPandas()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size = {i: len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows if i is not None}
    assert got[got.doc_id == 50].length.tolist() == [1]
    for i, n in size.items():
        own = got[got.doc_id == i]
        assert own.length.sum() == n * (2 if i == 54 else 1)
        if n > 1024:
            own = own.sort_values("piece")
            assert own.length.tolist()[1:] == [1024] * (len(own) - 1) and own.start.tolist()[1:] == own.length.cumsum().tolist()[:-1]
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 1024 and s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]
    assert packing.pack(docs([]).limit(0)).count() == 0


def test_tokens_equal_those_of_tokenizers(prose):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [prose(1, 200), "", "a\r\n\tb   c ", "<|endoftext|>x", "naïve ŻÓŁĆ 漢字 🙂 ½ 3.14", "x" * 3000, "it's we'll I'M"]
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in packing.tokenizer(path)(texts)] == want


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(9)
    for capacity, n in ((12, 40), (100, 500), (1024, 4000)):
        counts = np.bincount(rng.integers(1, capacity + 1, n), minlength=capacity + 1)
        patterns = packing.plan(counts, capacity)
        used = np.zeros(capacity + 1, int)
        for p, times in patterns:
            assert sum(p) <= capacity
            for s in p:
                used[s] += times
        assert (used == counts).all()
        assert sum(t for _, t in patterns) <= 1.01 * lower_bound(counts, capacity)


def lower_bound(counts, capacity):
    """Martello and Toth's second bound."""
    best, size = 0, np.arange(capacity + 1)
    for k in range(capacity // 2 + 1):
        huge, large = counts[capacity - k + 1 :].sum(), slice(capacity // 2 + 1, capacity - k + 1)
        spare = (counts[large] * (capacity - size[large])).sum()
        rest = (counts * size)[k : capacity // 2 + 1].sum() - spare
        best = max(best, huge + counts[large].sum() + max(0, -(-rest // capacity)))
    return best


def fewest_by_trial(sizes, capacity):
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for r in sorted({r for r in rooms if r >= sizes[i]}):
            rest = list(rooms)
            rest.remove(r)
            go(i + 1, [*rest, r - sizes[i]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best


def test_plan_is_not_worse_than_best_fit():
    counts = np.zeros(1025, int)
    counts[[600, 400, 212]] = 200, 400, 400
    assert sum(n for _, n in packing.best_fit_plan(counts)) == 375
    patterns = packing.plan(counts)
    assert sum(n for _, n in patterns) < 375
    assert sum(n * len(p) for p, n in patterns) == 1000


def test_search_without_budget_finds_the_fewest():
    rng = np.random.default_rng(1)
    better = 0
    for _ in range(100):
        capacity = int(rng.integers(20, 60))
        sizes = sorted(rng.integers(capacity // 6, capacity // 2 + 1, rng.integers(1, 11)).tolist(), reverse=True)
        counts = np.bincount(sizes, minlength=capacity + 1)
        fewest = fewest_by_trial(sizes, capacity)
        assert packing.bound(counts, capacity) <= fewest
        assert sum(n for _, n in packing.plan(counts, capacity, None)) == fewest
        better += sum(n for _, n in packing.best_fit_plan(counts, capacity)) > fewest
    assert better


def test_completion_finds_full_fillings():
    counts = np.zeros(101, int)
    counts[[60, 35, 25, 15]] = [1, 2, 1, 2]
    assert sum(packing.completion(counts, 75)) == 75
    assert packing.completion(np.zeros(101, int), 50) == []


# -- quality

def test_quality_separates_and_takes_edges(spark, docs, prose):
    rows = [(i, prose(i, 80).capitalize() + ".") for i in range(200)] + [(i, " | ".join(prose(i, 80).split())) for i in range(200, 400)]
    rows += [(900, None), (901, ""), (902, prose(3, 8000))]
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(400)] + [(None, 1, 0), (5, None, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs(rows), labels).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    held = got[got.held_out & (got.doc_id < 400)]
    assert len(held) > 50 and ((held.predicted == 1) == (held.doc_id < 200)).mean() > 0.97
    kept = quality.keep_good(docs(rows), labels)
    assert kept.columns == docs(rows).columns and {r.doc_id for r in kept.collect()} == set(got[got.predicted == 1].doc_id)
    assert quality.classify(docs([]).limit(0), labels).count() == 0
    assert quality.classify(docs(rows[:3]), labels.limit(0)).count() == 3


def test_dual_descent_meets_the_margin():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 40, 12) + (50 if i % 2 else 0)) for i in range(60)]
    y = np.array([1.0 if i % 2 else -1.0 for i in range(60)])
    r = quality.log_count_ratio(rows, y)
    w, b = quality.dual_descent(rows, y, r)
    margin = np.array([w[x].sum() / len(x) ** 0.5 for x in rows]) + b
    assert (np.sign(margin) == y).all()


def test_license_sql_agrees(spark, tmp_path):
    con = duckdb.connect()
    con.execute("create table documents as select * from (values (1, 'Licensed under CC BY 4.0.\n\nx'), (2, null), (3, 'Released under the MIT License')) t(doc_id, text)")
    got = licenses.scan(spark.createDataFrame([(1, "Licensed under CC BY 4.0.\n\nx"), (2, None), (3, "Released under the MIT License")], "doc_id long, text string"))
    want = con.sql(licenses.oracle()).df().sort_values("doc_id")
    assert got.toPandas().sort_values("doc_id").license.fillna("").tolist() == want.license.fillna("").tolist()
