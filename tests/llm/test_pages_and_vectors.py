"""Pages and vectors: fixtures by hand, brute force."""

import duckdb
import numpy as np
import pytest

from tidemark.llm import html, lines, mixing, urls, vectors, decontam
from tidemark.llm import queries as Q

SF = "/root/testdata/sf0.001"

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a><li><a href=/x>Menu with a long label here</a></ul></nav>
<div class="cookie-notice">We use cookies and other things, accept all of them please.</div>
<article><h1>The &amp; title</h1><p>First  paragraph
of some&nbsp;length, <b>bold</b> and <a href=#>a link</a>.<p>Short.<div class="ad">Buy this now</div>
<blockquote>Quoted <i>words</i></blockquote><script>var t="</p>";</script><form><input><p>Your mail</p></form>
<p>Last&lt;one&gt; of them<br>after the break</p><section class="comments"><p>Great post! I agree with it.</p></section></article>
<aside>Related things</aside><footer>&copy; all</footer>"""


def test_main_text():
    assert html.main_text(PAGE) == ("The & title\nFirst paragraph of some length, bold and a link.\nShort.\nQuoted words\n"
                                    "Last<one> of them after the break")
    assert html.main_text(None) == html.main_text("") == html.main_text("<html><body><nav>x</nav></body>") == ""
    assert html.main_text("just text") == "just text"
    assert html.main_text("<p>a<p>" + "b " * 200_000 + "<p>c").endswith("b\nc")
    assert html.main_text("<div>" * 5000 + "deep") == "deep"


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "clash"), (None, None, None, None), (1, "u", "", "")],
                               "page_id long, url string, html string, text string")
    got = html.extract_main_text(df).collect()
    assert [r.n_chars for r in got] == [len(r.text) for r in got] and got[1].text == "" and got[2].text == ""
    assert html.extract_main_text(df.where("false")).count() == 0
    out = Q.op7_html(spark, SF).collect()
    for r, p in zip(sorted(out, key=lambda r: r.page_id), sorted(spark.read.parquet(f"{SF}/pages.parquet").collect(), key=lambda r: r.page_id)):
        body = p.html.split("<article>")[1].split("</article>")[0]
        assert r.text.count("\n") == body.count("<p>") - (body.count("<p></p>")) and "\n\n" not in r.text


def test_urls(spark):
    rules = [*Q.URL_RULES, ("net", "/", "block"), ("b.example.net", "/en/", "block")]
    cases = {"https://EXAMPLE.net/en/x?y": "example.net/en/", "http://a.example.net/en": "net/", "x://b.example.net/en/": "b.example.net/en/",
             "http://net": None, "http://net/": "net/", "http://xnet/": None, "http://a.org/fr/#/": "org/fr/", "no scheme": None,
             "": None, None: None, "http://a.example.com?/de/": None, "http://u@h.example.com/de/": "example.com/de/"}
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(cases)], "page_id long, url string, host string")
    got = {r.url: r.rule for r in urls.url_filter(df, rules).collect()}
    assert got == cases
    assert {r.verdict for r in urls.url_filter(df, []).collect()} == {"allow"}
    index = urls.build_index([(f"h{i}.org", "/", "block") for i in range(5000)])
    probe = urls.Probe(index | {"digests": np.zeros(5000, np.uint64).tobytes()})  # every digest collides
    probe.digests = np.full(5000, __import__("xxhash").xxh64_intdigest(b"h7.org/"), np.uint64)
    assert probe.text(int(probe.find([b"h7.org/"])[0])) == b"h7.org/"


def _brute(rows, least):
    n = len(rows)
    links, group = [0] * n, list(range(n))
    for i in range(n):
        for j in range(i):
            (_, a, p), (_, b, q) = rows[i], rows[j]
            if p is None or p != q or not a or not b or len(a) != len(b) or None in a or None in b:
                continue
            x, y = np.array(a, float), np.array(b, float)
            if not (np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any()):
                continue
            if (x * y).sum() / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                links[i] += 1
                links[j] += 1
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for i, (d, _, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(n) if group[k] == group[i] and rows[k][0] is not None]
        c = (min(ids) if ids else None)
        out.append((d, links[i], c, c is None if d is None else d == c))
    return sorted(map(str, out))


@pytest.mark.parametrize("rows_a_task", [1 << 17, 16, 3])
def test_vectors(spark, rows_a_task):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(150):
        base = rng.standard_normal(12) if i % 5 == 0 else rows[-1][1]
        rows.append((i, (np.array(base) + rng.normal(0, 0.25, 12)).astype(float).tolist(), i % 2 if i % 11 else 0))
    rows += [(200, None, 1), (201, [0.0] * 12, 1), (202, [float("nan")] + [1.0] * 11, 1), (203, [None] + [1.0] * 11, 1),
             (204, rows[3][1], None), (205, rows[3][1], rows[3][2]), (205, rows[3][1], rows[3][2]), (None, rows[3][1], rows[3][2]),
             (206, [], 1), (207, [1.0, 2.0], 1), (208, [2.0, 4.0], 1), (209, [float("inf")] * 12, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = vectors.near_vectors(df.selectExpr("*", "1 as pid", "'x' as cell"), least=0.9, block=4, task_values=12 * rows_a_task).collect()
    assert sorted(map(str, map(tuple, got))) == _brute(rows, 0.9)
    if rows_a_task == 16:
        assert vectors.near_vectors(df.where("false")).count() == 0


@pytest.mark.parametrize("name,sql", [("op4_lines", lines.LINES_SQL), ("op6_decontam", decontam.DECONTAM_SQL),
                                      ("op8_urls", urls.URL_SQL), ("op10_mixing", mixing.MIX_SQL)])
def test_oracles(spark, name, sql):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = Q.queries()[name](spark, SF)
    rel = c.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, rel.fetchall())) == sorted(str(tuple(r)) for r in df.select(*names).collect())


def test_vectors_of_any_size(spark):
    rows = [(1, [1e200, 2e200, 0.0], 1), (2, [1e-200, 2e-200, 0.0], 1), (3, [0.0, 0.0, 5e300], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True)}


def _crowd(n, dim, rng):
    """Random directions, with a chain of near copies and a dense group among them."""
    x = rng.standard_normal((n, dim))
    for i in range(0, n // 10):
        x[n // 2 + i] = x[i] + rng.standard_normal(dim) * rng.uniform(0, 0.5)
    x[-n // 10:] = x[0] + rng.standard_normal((n // 10, dim)) * 0.2
    return x


@pytest.mark.parametrize("n", [500, 2000, 8000])
def test_range_join_prunes(n):
    """Random vectors, the worst case: the pairs compared in all blocks are a falling share of
    all pairs, few are verified, none at the threshold is lost."""
    x = np.random.default_rng(n).standard_normal((n, 64))
    x[: n // 100] = x[-(n // 100):] + 0.3 * np.random.default_rng(1).standard_normal((n // 100, 64))
    job = vectors._Joined(x, np.ones(n, np.int64), 8, 0.93)
    for k in range(8):
        job.join(k, np.arange(n), None)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert job.links.tolist() == ((unit @ unit.T >= 0.93).sum(1) - 1).tolist()
    pairs = n * (n - 1) / 2
    print(n, job.compared / pairs, job.verified / pairs)
    assert job.verified < 0.01 * pairs
    assert job.compared < {500: 8, 2000: 5, 8000: 2.5}[n] * pairs


def test_cells_meet():
    """Each pair within the budget meets in exactly one cell, at least one of them at home."""
    rng = np.random.default_rng(4)
    z = rng.normal(0, 0.125, (400, 8))
    at, value = rng.integers(0, 8, 15).tolist(), rng.normal(0, 0.1, 15).tolist()
    row, cell, home = vectors.cells(z, at, value, 0.0175)
    assert sorted(row[home].tolist()) == list(range(400))
    d = ((z[:, None] - z[None]) ** 2).sum(2)
    where = [{(c, h) for r, c, h in zip(row, cell, home) if r == i} for i in range(400)]
    for i, j in zip(*np.nonzero(np.tril(d <= 0.0175, -1))):
        assert sum(c == e and (h or g) for c, h in where[i] for e, g in where[j]) == 1


@pytest.mark.parametrize("rows_a_task", [400, 60])
def test_vectors_in_64_dimensions(spark, rows_a_task):
    x = _crowd(900, 64, np.random.default_rng(9))
    label = [i % 3 % 2 for i in range(900)]
    df = spark.createDataFrame([(i, v.tolist(), label[i]) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(df, task_values=64 * rows_a_task).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    same = np.array(label)[:, None] == np.array(label)[None]
    want = ((unit @ unit.T >= 0.93) & same).sum(1) - 1
    assert [got[i] for i in range(900)] == want.tolist() and want.sum() > 1000
