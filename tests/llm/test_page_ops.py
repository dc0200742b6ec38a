import gzip
import hashlib
import math

import numpy as np
import pytest

from bomspark.llm import ann, urls, warc


def test_url_rules(spark):
    cases = [
        ("https://a.example.net/en/1", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("https://A.Example.NET/EN/1?x", "a.example.net", "/EN/1", "net/", "block"),
        ("http://net/", "net", "/", "net/", "block"),
        ("http://x.net", "x.net", "", None, "allow"),
        ("http://notnet.com/", "notnet.com", "/", None, "allow"),
        ("http://example.com/de/x#y", "example.com", "/de/x", "example.com/de/", "block"),
        ("ftp://w.org/fr/", "w.org", "/fr/", "org/fr/", "allow"),
        ("http://h.org/a?page=1234", "h.org", "/a", None, "block"),
        ("http://h.org/a?page=12", "h.org", "/a", None, "allow"),
        ("http://h.org/login?next=/", "h.org", "/login", None, "block"),
        ("no scheme/net/", "", "", None, "allow"),
        ("x://y://z.net/q", "y:", "//z.net/q", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://b.net" + "/" * 50_000, "b.net", "/" * 50_000, "net/", "block"),
    ]
    pages = spark.createDataFrame([(i, c[0], "h", "x") for i, c in enumerate(cases)], "page_id long, url string, html string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect()}
    for i, c in enumerate(cases):
        assert got[i] == c[1:], c[0][:60]
    assert urls.judge(pages.limit(0)).count() == 0


def test_index_runs_only_candidates_and_misses_none():
    rng = np.random.default_rng(1)
    tokens = [f"t{i}" for i in range(40)]
    rules = [urls.PatternRule("block", f"r{i}", rf"[/=]{tokens[i]}([/&]|$)", (tokens[i],)) for i in range(40)]
    index = urls.Index((), rules, {t: i for i, t in enumerate(tokens)})
    for _ in range(300):
        url = "http://h.com/" + "/".join(rng.choice(tokens, 3))
        want = next((r.name for r in rules if r.compiled().search(url)), None)
        assert index.judge(url)[4] == want
    assert all(len(v) == 1 for v in index.by_token.values())


def warc_want(rows, least=1000):
    head = {}
    for i, html in rows:
        p = (html or "").encode()
        if i is not None and len(p) >= least:
            head[p] = max(head.get(p, i), i)
    out = []
    for i, html in rows:
        p = (html or "").encode()
        again = i is not None and len(p) >= least and i < head[p]
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", head[p] if again else None, True))
    return out


def test_warc_round_trip(spark, folder):
    big = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 60
    rows = [(1, big), (2, big), (9, big), (9, big), (3, big + "x"), (4, "small"), (5, "small"), (6, None), (7, ""), (None, big), (8, "y" * 999), (10, "y" * 999), (11, "z" * 1000), (12, "z" * 1000), (13, "q" * 400_000)]
    pages = spark.createDataFrame([(i, f"http://h/\n{i}", h, 1) for i, h in rows], "page_id long, url string, html string, salt int")
    got = [tuple(r) for r in warc.round_trip(pages).collect()]
    assert sorted(got, key=str) == sorted(warc_want(rows), key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0
    warc.write(pages, f"{folder}/w")
    records = list(warc.read(spark, f"{folder}/w").collect())
    assert len({r.record_id for r in records if r.page_id not in (9, None)}) == len(records) - 3
    assert {r.refers_to_id for r in records if r.refers_to == 12} == {r.record_id for r in records if r.page_id == 12}
    assert next(bytes(r.payload) for r in records if r.page_id == 3).decode() == big + "x"


def test_warc_parse_rejects_broken_archives():
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))
    assert list(warc.parse(b"")) == [] and gzip.compress(b"")


def test_hilbert_visits_neighbours():
    for d, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
        order = np.argsort(ann.hilbert(grid, bits))
        assert (np.abs(np.diff(grid[order], axis=0)).sum(1) == 1).all()


def nearest(rows, every, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == 8]
    out = []
    for q, v in ok:
        if q % every == 0:
            best = sorted((-float(np.cumsum(v * w)[-1]), i) for i, w in ok if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_search_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(8) * rng.uniform(0.5, 3)]) for i in range(900)]
    rows += [(i, rows[7][1]) for i in range(1000, 1400)]  # a third are one vector
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [1.0] * 7), (2080, [None] + [1.0] * 7), (None, rows[1][1]), (2100, [float("inf")] + [0.0] * 7), (2120, [])]
    table = spark.createDataFrame([(i, v, 0, 5) for i, v in rows], "vec_id long, embedding array<float>, label int, node int")
    got = sorted(tuple(r) for r in ann.search(table).collect())
    assert got == nearest(rows, 20, 20)
    few = table.where("vec_id < 6")
    assert sorted(tuple(r) for r in ann.search(few, every=2).collect()) == nearest([r for r in rows if r[0] is not None and r[0] < 6], 2, 20)
    assert ann.search(table.limit(0)).count() == 0 and ann.search(table.where("vec_id = 2020")).count() == 0
