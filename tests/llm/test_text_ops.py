"""Document operators against brute force, over sf0.001 and a table of edge cases."""

import hashlib
import itertools
import os
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontam, lines, minhash, mixing, pii, substring, toxicity
from tidemark.llm import queries as Q

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, _key string, cls string, n_words int"
LONG = " ".join(f"w{i % 997}x{i // 997}" for i in range(30_000))
NEAR = [f"a{i}" for i in range(60)]


def _row(i, text, source="s"):
    return (i, text, "en", source, len(text) if text else None, 5, "k", "c", 3)


EDGE = [
    _row(None, None, None), _row(None, "no id but words"), _row(1, None), _row(2, ""), _row(3, " \t\n "), _row(4, "one"),
    _row(5, LONG), _row(6, LONG + " tail"), _row(7, " ".join(NEAR)), _row(8, " ".join(NEAR).upper()),
    _row(9, " ".join(NEAR[:-1] + ["zz"])), _row(9, " ".join(NEAR[:-1] + ["zz"])), _row(10, "é\u00a0ß A.B@c.de +1 (386) 555-3733 x"),
    _row(11, "ab ab " * 40, "t"), _row(12, "ONE", "t"), _row(13, "\x0b".join(NEAR), "u"),
]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    edge = spark.createDataFrame(EDGE, SCHEMA)
    return {"sf": docs, "edge": edge, "empty": edge.where("false")}


def _texts(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


def _words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())


@pytest.mark.parametrize("name", ["sf", "edge", "empty"])
def test_substring(tables, name):
    docs = _texts(tables[name])
    seen = {}
    for _, t in docs:
        w = _words(t)
        for i in range(len(w) - 34):
            seen[tuple(w[i:i + 35])] = seen.get(tuple(w[i:i + 35]), 0) + 1
    want = []
    for d, t in docs:
        w = _words(t)
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i:i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
        want.append((d, len(w), len(gone), kept))
    got = substring.remove_repeats(tables[name]).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def _set(t, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = _words(low)
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


@pytest.mark.parametrize("name", ["sf", "edge", "empty"])
def test_near_duplicates(tables, name):
    docs = _texts(tables[name])
    sets = [_set(t, 4) for _, t in docs]
    group = list(range(len(docs)))
    for i, j in itertools.combinations(range(len(docs)), 2):
        a, b = sets[i], sets[j]
        if a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)):
            k = len(a & b)
            if 100 * k >= 80 * (len(a) + len(b) - k) and group[i] != group[j]:
                old, new = group[j], group[i]
                group = [new if g == old else g for g in group]
    want = []
    for i, (d, _) in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if group[j] == group[i] and docs[j][0] is not None]
        c = (min(ids) if ids else None) if sets[i] else d
        want.append((d, len(sets[i]), c, c is None if d is None else d == c))
    got = minhash.near_duplicates(tables[name]).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_large_group_of_half_near_copies(spark):
    """Members that don't reach the hub's similarity are linked through others."""
    import random
    rng = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for d in range(250):
        w = list(base)
        for _ in range(rng.choice((0, 1, 3, 6, 9, 14))):
            w[rng.randrange(120)] = f"x{rng.random()}"
        rows.append((d, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [_set(t, 4) for _, t in rows]
    comp = list(range(250))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x
    for i, j in itertools.combinations(range(250), 2):
        k = len(sets[i] & sets[j])
        if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
            a, b = sorted((root(i), root(j)))
            comp[b] = a
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert got == {i: root(i) for i in range(250)}


def test_likelihood_and_merge():
    import numpy as np
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    reg = minhash.sketches([a, b, np.unique(np.concatenate((a, b))), a[:0]])
    assert (minhash.merge(reg[0], reg[1]) == reg[2]).all() and not reg[3].any()
    est = minhash.likelihood_jaccard(reg[:1], reg[1:2], np.array([len(a)]), np.array([len(b)]))[0]
    assert abs(est - 0.6) < 0.15


@pytest.mark.parametrize("name", ["sf", "edge", "empty"])
def test_pii(tables, name):
    got = {}
    for r in pii.find_pii(tables[name], redacted=True).collect():
        got.setdefault(r.doc_id, []).append(r)
    for d, t in _texts(tables[name]):
        spans = []
        for k, kind in enumerate(pii.KINDS):  # the patterns as they stand
            for m in re.finditer(pii.PATTERNS[kind], t or ""):
                digits = re.sub("[^0-9]", "", m.group())
                if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))
                        or kind == "card" and 12 <= len(digits) <= 19 and pii.luhn(digits)
                        or kind == "phone" and 9 <= len(digits) <= 15):
                    spans.append((m.start(), k, m.end()))
        want = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
        assert want in [r.base_spans for r in got[d]]
        for r in got[d]:
            assert set(filter(None, r.base_spans.split(","))) <= set(r.spans.split(","))
            assert sum((r.n_email, r.n_ip, r.n_card, r.n_phone)) == len(list(filter(None, r.base_spans.split(","))))


def test_pii_base_is_the_pattern():
    odd = "a@b@c.de x..@y.z 1.2.3.4.5 256.1.1.1 4111 1111-1111 1111 +44 20 7946 0958) .a@b.c@d.e 4242424242424242 1" * 3
    for kind in pii.KINDS:
        want = [(m.start(), m.end()) for m in re.finditer(pii.PATTERNS[kind], odd) if pii._valid(kind, m.group())]
        assert [(s, e) for s, k, e in pii.base_spans(odd) if pii.KINDS[k] == kind] == want


def test_disclosing_term(spark):
    rows = [(i, f"note {i} Zanzibar wrote to jo@x.org about this {i}") for i in range(6)]
    rows += [(100 + i, f"about this note wrote to nobody {i}") for i in range(60)]
    out = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"), redacted=True).collect()}
    assert "term:7:15" in out[0].spans and "Zanzibar" not in out[0].redacted and "[email]" in out[0].redacted
    assert all(out[100 + i].spans == "" for i in range(60))


def test_disclosing_term_goes_everywhere(spark):
    """Far from the entity, twice in a text, and in a text without the entity."""
    rows = [(i, f"Zanzibar {'so ' * 20}wrote to jo@x.org and (zanzibar) note{i}") for i in range(12)]
    rows += [(50, "so Zanzibar, wrote"), (51, None)] + [(100 + i, f"so wrote to nobody and note{i}") for i in range(120)]
    out = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"), redacted=True).collect()}
    assert all(out[i].spans == "term:0:8,email:78:86,term:92:100" and "anzibar" not in out[i].redacted for i in range(12))
    assert out[50].spans == "term:3:11" and out[50].redacted == "so , wrote" and out[51].spans == ""
    assert all(out[100 + i].spans == "" for i in range(120))


def test_rare_entities_back_off_to_their_class(spark):
    """Every value is in one text only: terms of its domain, area code or kind are found,
    a kind in fewer than three texts isn't estimated, and rare words alone are no terms."""
    rows = [(i, f"Zanzibar wrote so{i} to jo{i}@x.org about this") for i in range(6)]
    rows += [(20 + i, f"Quito called +1 386 555 37{30 + i} about this") for i in range(4)]
    rows += [(40 + i, f"Lima saw 10.{i}.0.1 about this") for i in range(3)] + [(60, "Perth has 4242424242424242 about this")]
    rows += [(100 + i, f"wrote called saw has to about this {i}") for i in range(120)]
    out = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i].spans == f"term:0:8,{out[i].base_spans}" for i in range(6))
    assert all(out[20 + i].spans == f"term:0:5,{out[20 + i].base_spans}" for i in range(4))
    assert all(out[40 + i].spans == f"term:0:4,{out[40 + i].base_spans}" for i in range(3))
    assert out[60].spans == out[60].base_spans != "" and all(out[100 + i].spans == "" for i in range(120))


@pytest.mark.parametrize("name", ["sf", "edge", "empty"])
def test_mixing(tables, name):
    got = mixing.mix_sources(tables[name]).collect()
    assert len(got) == tables[name].count()
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in got)
    sizes = {s: sum(r.size for r in rs) for s, rs in by.items()}
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    fixed = {}
    while True:  # water-filling round by round
        rest, w = total - sum(fixed.values()), sum(weight[s] for s in order if s not in fixed)
        over = {s: 3.0 * sizes[s] for s in order if s not in fixed and rest * weight[s] / w >= 3 * sizes[s]}
        if not over:
            break
        fixed |= over
    for s, rs in by.items():
        target = fixed[s] if s in fixed else rest * weight[s] / w
        assert all(abs(r.target - target) < 1e-6 * max(1, target) and r.taken <= 3 * r.size for r in rs)
        assert abs(sum(r.taken for r in rs) - target) <= max((r.size for r in rs), default=0) / 2 + 1
    again = sorted(str((r.doc_id, r.taken)) for r in mixing.mix_sources(tables[name].repartition(3)).collect())
    assert again == sorted(str((r.doc_id, r.taken)) for r in got)


@pytest.mark.parametrize("name", ["edge", "empty"])
def test_lines_and_decontamination_edge_cases(spark, tables, name):
    out = lines.dedup_lines(tables[name]).collect()
    assert sorted(str((r.doc_id, r.kept_text)) for r in out) == sorted(str((d, t or "")) for d, t in _texts(tables[name]))
    items = spark.createDataFrame([(1, " ".join(NEAR[5:30])), (1, None), (2, ""), (3, "One!"), (4, " ".join(NEAR[5:30])),
                                   (5, "never seen here at all today")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated_pairs(tables[name], items).collect()}
    hit = {(d, i) for d in (7, 8, 9, 13) for i in (1, 4)} | {(4, 3), (12, 3)}
    assert got == (hit if name == "edge" else set())
    assert decontam.drop_contaminated(tables[name], items.where("false")).count() == tables[name].count()


def test_templates(spark):
    rows = [(i, f"own line number w{chr(97 + i)} of {chr(97 + i)} text\nPage {i} of 9 from Acme\nLicensed under the MIT terms\n")
            for i in range(8)] + [(50, "Page eleven of what it was")]
    out = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    kept = [r.kept_text for r in out.values()]
    assert sum("Acme" in t for t in kept) == 1 and sum("Licensed" in t for t in kept) == 1  # the first stays
    assert out[50].kept_text == "Page eleven of what it was"
    assert sum(r.n_dropped for r in out.values()) >= 14


def test_copies_of_a_text_count_once(spark, tmp_path):
    """A thousand copies of one text don't fix the constant places of its leaf."""
    import duckdb
    rows = [(i, f"The report was written by {n}") for i, n in enumerate(
        ("Ann Archer", "Ben Brook", "Cid Cole", "Dan Drew", "Eve Eddy", "Fay Frost"))]
    rows += [(100 + i, "The report was never sent to anyone") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents"))
    out = lines.dedup_lines(docs, depth=3, min_docs=5)
    got = out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect()
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents/*.parquet')")
        want = con.execute(lines.LINES_SQL).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(r.n_dropped for r in got) == 5


def test_toxicity(spark):
    texts, labels = [], []
    for i in range(600):
        insult, group = i % 2, i // 2 % 2
        texts.append((i, f"{'dreadful' if insult else 'pleasant'} words about {'plumbers' if group else 'weather'} item{i}"))
        labels.append((i, 1, insult & group))
    d = spark.createDataFrame(texts + [(None, None), (None, ""), (9000, LONG)], "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(d, lab)
    out = toxicity.score_toxicity(d.withColumn("score", F.lit("clash")), model).collect()
    assert len(out) == 603 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    want = {i: t for i, _, t in labels}
    assert all(r.predicted == want[r.doc_id] for r in out if r.doc_id in want)  # the pair decides, not either word
    none = toxicity.train(d, lab.where("false"))
    assert all(r.predicted == 0 for r in toxicity.score_toxicity(d, none).collect())


def test_pipeline(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.withColumn("score", F.lit(1)).withColumn("key", F.lit("x")).withColumn("comp", F.lit(2))
    extra = spark.createDataFrame([(None, None, None, None, None, 1, "x", 2), (1, "", "en", "src0", 0, 1, "x", 2)], odd.schema)
    rows = odd.unionByName(extra)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, SF)
        if name != "mixing":
            assert out.columns == rows.columns
            n = out.count()
            assert 0.5 * rows.count() < n <= rows.count()
        assert stage(spark, rows.where("false"), SF).count() == 0
    assert corpus_pipeline.run(spark, SF).count() > 50


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Kept ids and texts of every stage, on sf0.001 and planted cases."""
    import corpus_pipeline
    import duckdb
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy(F.length("text").desc(), "text").first().text
    base = " ".join(f"p{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))
    planted = [(900_000, base), (900_001, base + " tail"), (900_002, base.upper()), (900_003, f"before this {item} and after")]
    planted += [(900_010 + i, f"own words of {chr(97 + i)}\nPage {i} of 9 from Acme") for i in range(7)]
    rows = docs.unionByName(spark.createDataFrame(planted, "doc_id long, text string"), allowMissingColumns=True)
    rows.write.parquet(str(tmp_path / "documents"))
    rows = spark.read.parquet(str(tmp_path / "documents"))
    texts = _texts(rows)

    def kept(name):
        return stages[name](spark, rows, SF).collect()

    model = toxicity.train(rows, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = toxicity.score_toxicity(rows.select("doc_id", "text"), model).where("predicted = 0").collect()
    assert sorted(r.doc_id for r in kept("toxicity")) == sorted(r.doc_id for r in clean)

    sets = [_set(t, 5) for _, t in texts]
    group = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        k = len(sets[i] & sets[j])
        if k and 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k) and group[i] != group[j]:
            group = [group[i] if g == group[j] else g for g in group]
    least = {}
    for g, (d, _) in zip(group, texts):
        least[g] = min(d, least.get(g, d))
    near = sorted(r.doc_id for r in kept("near dedup"))
    assert near == sorted(least.values()) and not {900_001, 900_002} & set(near)

    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents/*.parquet')")
        con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{SF}/benchmark.parquet')")
        found = {r[0] for r in con.execute(decontam.DECONTAM_SQL).fetchall()}
        line = {r[0]: r[3] for r in con.execute(lines.LINES_SQL).fetchall()}
        mixed = sorted((r[0], r[4]) for r in con.execute(mixing.MIX_SQL).fetchall() if r[4])
    assert 900_003 in found
    assert sorted(r.doc_id for r in kept("decontamination")) == sorted(d for d, _ in texts if d not in found)
    got = kept("line dedup")
    assert {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in got} == line and len(got) == len(texts)
    assert sum("Acme" in (r.text or "") for r in got) == 1
    assert sorted((r.doc_id, r.taken) for r in kept("mixing") if r.taken) == mixed


def test_registered():
    names = set(Q.queries())
    assert {re.match(r"op(\d+)_|", n)[0] for n in names} >= {f"op{i}_" for i in range(1, 11)} and "pipeline" in names
    assert os.path.isdir(SF) and hashlib.sha256(b"").hexdigest()
