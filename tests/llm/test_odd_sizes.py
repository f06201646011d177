"""Odd inputs at two sizes (time and memory stay in proportion), table lines, short items, repeated ids."""

import time
import tracemalloc

import duckdb
import numpy as np
import pytest

from tidemark.llm import decontam, html, lines, pii, toxicity, urls

STORY = "This is a long paragraph of the story, with many words that tell what had happened on that day in the town. " * 3


def _seconds(fn, *args):
    best = 1e9
    for _ in range(3):
        start = time.perf_counter()
        fn(*args)
        best = min(best, time.perf_counter() - start)
    return best


@pytest.mark.parametrize("text", ["1" * 100_000, "1." * 50_000, "1 " * 50_000, "+1" * 50_000, "a@" * 50_000, "0" * 100_000])
def test_spans_of_long_runs(text):
    small, large = _seconds(pii.base_spans, text[: len(text) // 4]), _seconds(pii.base_spans, text)
    assert large < 12 * small + 0.05


def test_addresses_in_digit_runs():
    runs = ["1.2.3.4", "11.2.3.4.5.6.7.8", "1111111.2.3.4", "0000001.2.3.4", "1.2.3.", "x1.2.3.4y", "1.2.3.4.5", "300.1.1.1.1",
            "0" * 5000 + "1.2.3.4", "1.2.3", "12.34.56.78 9.9.9.9"]
    rng = np.random.default_rng(3)
    runs += ["".join(rng.choice(list("0129.. "), 30)) for _ in range(3000)]
    for t in runs:
        want = [m.span() for m in __import__("re").finditer(pii.PATTERNS["ip"], t)
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        assert [(s, e) for s, k, e in pii.base_spans(t) if k == 1] == want, t


def test_hosts_of_many_dots():
    probe = urls.Probe(urls.build_index([("net", "/", "block"), ("a.example.net", "/en/", "allow"), ("plain.org", "", "block")]))
    tracemalloc.start()
    keys = urls._keys("a." * 200_000 + "example.net", "/en/x", probe.hosts, probe.paths)
    assert tracemalloc.get_traced_memory()[1] < 10 << 20
    tracemalloc.stop()
    assert b"a.example.net/en/" in keys and b"net/" in keys and len(keys) <= 9
    assert urls._keys("xnet", "/", probe.hosts, probe.paths) == []


def test_many_dropped_lines(spark):
    """Time follows the dropped lines of a text, not their square."""
    def run(n):
        page = "\n".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} stands here" for i in range(n))
        df = spark.createDataFrame([(i, page + f"\nlast {chr(97 + i)}") for i in range(6)], "doc_id int, text string")
        start = time.perf_counter()
        got = sorted(r.n_dropped for r in lines.dedup_lines(df).collect())
        assert got == [0] + [n] * 5
        return time.perf_counter() - start

    run(100)
    small, large = run(4_000), run(16_000)
    assert large < 8 * small


def test_lines_of_numbers_stay(spark):
    rows = [(i, f"{i} {7 * i} {16 + i} {90 - i}\n{i}{i}\ntext {chr(97 + i)}") for i in range(6)]
    rows += [(10 + i, f"1 2 3 4\nPage {i} of 9\nalone {chr(97 + i)} here now") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.doc_id: r.n_dropped for r in lines.dedup_lines(df).collect()}
    assert all(got[i] == 0 for i in range(6))
    assert sorted(got[10 + i] for i in range(6)) == [0, 2, 2, 2, 2, 2]
    c = duckdb.connect()
    c.register("documents", df.toPandas())
    assert {r[0]: r[2] for r in c.execute(lines.LINES_SQL).fetchall()} == got


def test_short_items_in_long_texts(spark):
    docs = [(1, "a long text in which the tiny item of words is found at last"), (2, "the tiny"), (3, "The TINY item!"),
            (4, "tiny item the"), (5, None), (6, "many words and then one two three four to end"), (7, "")]
    items = [(1, "the tiny item"), (2, "one two three four"), (3, "which the tiny item of words"), (4, ""), (5, None)]
    d = spark.createDataFrame(docs, "doc_id int, text string")
    i = spark.createDataFrame(items, "item_id int, text string")
    got = sorted(tuple(r) for r in decontam.contaminated_pairs(d, i).collect())
    assert got == [(1, 1, 1, 1), (1, 3, 2, 2), (3, 1, 1, 1), (6, 2, 1, 1)]
    c = duckdb.connect()
    c.register("documents", d.toPandas())
    c.register("benchmark", i.toPandas())
    cur = c.execute(decontam.DECONTAM_SQL)
    names = [x[0] for x in cur.description]
    at = [names.index(n) for n in ("doc_id", "item_id", "n_shared", "n_item")]
    assert sorted(tuple(r[k] for k in at) for r in cur.fetchall()) == got


def test_rows_fitted_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 4, f"text {i % 20} of words") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)] + [(1, 0)], "doc_id long, toxic int")
    seen = []
    fit = toxicity.fit_machine
    monkeypatch.setattr(toxicity, "fit_machine", lambda a, b, y, t: seen.append(len(y)) or fit(a, b, y, t))
    toxicity.train(docs, labels, max_rows=3)
    toxicity.train(docs, labels, max_rows=1000)
    assert seen[0] <= 3 and seen[1] <= 5 * 20


def test_page_of_plain_divs():
    page = (f"<body><div>Home News Contact</div><div>{STORY}</div><div>Short one.</div><div>{STORY}</div><div>{STORY}</div>"
            "<div>Copyright 2024 Site</div></body>")
    text = html.main_text(page).split("\n")
    assert text == [STORY.strip(), "Short one.", STORY.strip(), STORY.strip()]


def test_names_that_also_stand_for_content():
    page = (f'<body><article><h2 id="related-work">Related work</h2><p class="share-price">Price 12</p><h1 class="banner">Big</h1>'
            f'<section id="alert-levels"><p>{STORY}</p></section><div class="related-posts">x</div><div class="share">y</div>'
            '<div class="cookie-notice">z</div></article></body>')
    assert html.main_text(page) == f"Related work\nPrice 12\nBig\n{STORY.strip()}"


def test_forms():
    assert html.main_text(f"<body><form><h1>T</h1><p>{STORY}</p><p>{STORY}</p></form></body>") == "\n".join(["T"] + [STORY.strip()] * 2)
    assert html.main_text("<body><form><article><p>Hi.</p></article></form></body>") == "Hi."
    assert html.main_text(f"<body><p>{STORY}</p><form><label>Your mail</label><input></form><p>End.</p>") == f"{STORY.strip()}\nEnd."
